"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .alignment import op12_cross_tokenizer_alignment
from .bpe import op3_byte_bpe
from .embedding_dedup import op9_embedding_dedup
from .exact_dedup import op11_exact_dedup
from .ngram_join import op4_ngram_jaccard_join
from .packing import op2_packing
from .periodic_runs import op13_periodic_runs
from .quality import RULES, STOP_WORDS, op10_quality_rules
from .records import op5_token_id_output
from .secret_scan import op6_secret_scan
from .substring_dedup import op1_substring_dedup
from .token_counts import op7_token_counts
from .toxicity import op8_toxicity

QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_packing, op3_byte_bpe, op4_ngram_jaccard_join, op5_token_id_output,
    op6_secret_scan, op7_token_counts, op8_toxicity, op9_embedding_dedup, op10_quality_rules,
    op11_exact_dedup, op12_cross_tokenizer_alignment, op13_periodic_runs)}

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k HAVING count(*) > 1),
p AS (SELECT DISTINCT doc_id, i + o AS pos FROM (SELECT g.doc_id, g.i, unnest(range(0, 13)) AS o FROM g JOIN f USING (k) WHERE f.first < g.doc_id)),
r AS (SELECT doc_id, list(pos) AS gone FROM p GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)"""

_OP4 = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 4), ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
t AS (SELECT DISTINCT x AS v, x AS r FROM e UNION SELECT t.v, e.y FROM t JOIN e ON e.x = t.r),
m AS (SELECT v, min(r) AS r FROM t GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.r, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.v = d.doc_id"""

_OP9 = """
WITH RECURSIVE u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
t AS (SELECT DISTINCT x AS v, x AS r FROM l UNION SELECT t.v, l.y FROM t JOIN l ON l.x = t.r),
m AS (SELECT v, min(r) AS r FROM t GROUP BY v),
k AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT e.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, coalesce(m.r, e.vec_id) AS component_id, e.vec_id = coalesce(m.r, e.vec_id) AS kept
FROM embeddings e LEFT JOIN k ON k.x = e.vec_id LEFT JOIN m ON m.v = e.vec_id"""


def _op10() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words.split()}))
    rules = []
    for top, under, least, most in RULES.values():
        value = f"CAST({top} AS DOUBLE) / nullif({under}, 0)" if under else f"CAST({top} AS DOUBLE)"
        rules += [f"coalesce({value} >= CAST({least} AS DOUBLE), true)"] * (least is not None) + [f"coalesce({value} <= CAST({most} AS DOUBLE), true)"] * (most is not None)
    bare = "translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')"
    lines = "list_filter(string_split(t, chr(10)), lambda x: length(translate(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 2), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i, unnest(range(0, 3)) AS o FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length({bare}) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len({lines}) AS BIGINT) AS n_lines,
  CAST(len({lines}) - len(list_distinct({lines})) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words,
  CAST(length({bare}) - length(translate({bare}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS BIGINT) AS n_upper
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(rules)} AS kept FROM b"""


_OP11 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW same AS (PARTITION BY t)"""

# crc32 bit by bit: a byte goes in, then eight shifts, of which the first is that byte's own step
_CRC32 = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"""

_OP13 = f"""
WITH d AS (SELECT doc_id, {_CRC32} AS h, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
e AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
s AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(w[1:g % n], list_transform(range(g % n, n), lambda i: w[1 + g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8))])) ELSE w END AS w FROM e),
x AS (SELECT doc_id, unnest(w) AS v, unnest(range(0, len(w))) AS i FROM s),
y AS (SELECT a.doc_id, b.i - a.i AS q, a.i, a.i - row_number() OVER (PARTITION BY a.doc_id, b.i - a.i ORDER BY a.i) AS island FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.v = b.v AND a.i < b.i),
z AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM y GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM z GROUP BY doc_id, start, length),
f AS (SELECT doc_id, count(*) AS n_runs, first(struct_pack(start := start, length := length, period := period) ORDER BY length DESC, start, period) AS most,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told FROM r GROUP BY doc_id),
g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS p FROM r) GROUP BY doc_id)
SELECT s.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(most.start AS BIGINT) AS start, CAST(most.length AS BIGINT) AS length, CAST(most.period AS BIGINT) AS period,
  CAST(1000 * most.length // most.period AS BIGINT) AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda v, i: NOT list_contains(gone, i - 1)) END, ' '), '')) AS collapsed_sha256
FROM s LEFT JOIN f USING (doc_id) LEFT JOIN g USING (doc_id)"""


ORACLES = {"op1_substring_dedup": _OP1, "op4_ngram_jaccard_join": _OP4, "op9_embedding_dedup": _OP9, "op10_quality_rules": _op10(),
           "op11_exact_dedup": _OP11, "op13_periodic_runs": _OP13}
