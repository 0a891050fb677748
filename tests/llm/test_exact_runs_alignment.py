"""Exact dedup, periodic runs and cross-tokenizer alignment against brute force, with edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scopesift.llm import alignment, exact_dedup, periodic_runs

LONG = " ".join(f"w{i % 9973}x{i % 31}" for i in range(60_000))
ROWS = [(None, "a null id"), (None, "a null id"), (1, None), (2, ""), (3, "same text"), (3, "same text"), (9, "same text"), (4, LONG), (5, LONG), (6, LONG + "x"),
        (7, "é 日本 ́ \x1c tail \n"), (8, "a b " * 40), (10, "<|endoftext|> and ▁ here"), (11, "  two\t spaces \x00  end "), (12, "<|endoftext|> plain 'll 've")]


@pytest.fixture(scope="module")
def docs(spark):
    names = ["n", "keep", "g", "rest", "sha", "digit", "links", "groups", "runs", "pair", "text_sha256"]
    return spark.createDataFrame([(*r, *["clash"] * len(names)) for r in ROWS], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)).repartition(3).cache()


def classes(rows):
    same = defaultdict(list)
    for d, t in rows:
        same[t or ""].append(d)
    out = []
    for d, t in rows:
        ids = same[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((d, keep, len(ids), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_dedup_edges(docs):
    assert sorted((tuple(r) for r in exact_dedup.exact_classes(docs).collect()), key=repr) == classes(ROWS)
    assert exact_dedup.exact_classes(docs.limit(0)).count() == 0


def test_exact_dedup_hot_groups_and_shared_prefixes(spark):
    rng, rows = random.Random(5), []
    for i in range(600):
        head = "shared head " * 3 if i % 3 else ""
        rows.append((i, "hot copy " * 20 if i % 3 == 1 else head + "".join(rng.choice("ab") for _ in range(rng.randrange(60)))))
    rows += [(1000 + i, x) for i, x in enumerate(["ab", "ab\0", "ab\0\0", "b", "", "abababab", "abababa"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for kw in ({"width": 2, "grow": 2, "least": 3, "hot_bytes": 64 * 66}, {"width": 1, "grow": 4}, {"least": 10}):
        assert sorted((tuple(r) for r in exact_dedup.exact_classes(df, **kw).collect()), key=repr) == classes(rows)


def runs_by_hand(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        at = 0
        for same, part in groupby(range(len(words) - q), lambda i: words[i] == words[i + q]):
            n = len(list(part))
            if same and n + q >= max(6, 4 * q):
                found.setdefault((at, n + q), q)
            at += n
    return sorted((s, n, q) for (s, n), q in found.items())


def caught(texts):
    """Runs of several lists of words, numbered at random, in one call."""
    ids = {w: k for k, w in enumerate({w for t in texts for w in t})}
    flat = [np.append(np.asarray([ids[w] for w in t], np.uint64), np.uint64(len(ids) + k)) for k, t in enumerate(texts)]
    got = periodic_runs.catch_runs(periodic_runs.mix(np.concatenate(flat)), np.asarray([len(t) for t in texts]))
    return [sorted(map(tuple, got[1:, got[0] == k].T.tolist())) for k in range(len(texts))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=80), min_size=1, max_size=6))
def test_runs_of_few_words(texts):
    assert caught(texts) == [runs_by_hand(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=24), st.integers(1, 9)), max_size=5), min_size=1, max_size=4))
def test_runs_of_repeated_blocks(texts):
    texts = [[w for block, n in t for w in block * n] for t in texts]
    assert caught(texts) == [runs_by_hand(t) for t in texts]


def test_runs_of_nested_and_long_periods():
    rng = random.Random(2)
    inner = [rng.randrange(3) for _ in range(37)]
    texts = [[0] * 5, [0] * 6, [0, 1] * 200, (inner * 4 + [7]) * 5, ([0] * 64 + [1] * 64) * 5, [rng.randrange(10**6) for _ in range(700)] * 4 + [5], ([0] * 127 + [1]) * 4,
             [rng.randrange(2) for _ in range(1500)], [], [3]]
    assert caught(texts) == [runs_by_hand(t) for t in texts]


def told(d, text):
    words = (text or "").encode().split()
    runs = runs_by_hand(words) if len(words) < 5_000 else []
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    most = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return d, len(runs), *most, runs, b" ".join(w for i, w in enumerate(words) if i not in gone)


def test_periodic_runs_edges(docs):
    got = [(r.doc_id, r.n_runs, r.start, r.length, r.period, [tuple(x) for x in r.runs], bytes(r.collapsed)) for r in periodic_runs.periodic_runs(docs, slice_bytes=1 << 10).collect()]
    assert sorted(got, key=repr) == sorted((told(*r) for r in ROWS), key=repr)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_runs_by_numbers_of_words():
    words = b"a b c d e f g h a b c d".split()
    assert periodic_runs._exact(words).shape[1] == 0 and periodic_runs._exact([b"a"] * 7)[:, 0].tolist() == [0, 0, 7, 1]


def test_repeating_rewrites_as_defined(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 60))) for i in range(300)] + [(None, "no id"), (10**12, None)]
    got = {r.doc_id: r.text for r in periodic_runs.repeating(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    changed = 0
    for d, t in rows:
        h, w = zlib.crc32(str(d).encode()) if d is not None else 1, (t or "").split()
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            changed += 1
        assert (got[d] or "").split() == w
    assert changed > 10


def by_hand(rows):
    """Both libraries on whole texts, groups by a walk over all ends, counts in one place."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    tok, sp = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    tok.encode_special_tokens = True
    of_a = alignment.token_bytes(tok)
    piece = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
    out, count = [], Counter()
    for d, t in rows:
        a, b = (tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)) if t else ([], [])
        if t and not (b"".join(of_a[x] for x in a) == b"".join(piece[x] for x in b) == (" " + t).encode()):
            a, b = [], []
        ends = [np.cumsum([len(of[x]) for x in ids]).tolist() for ids, of in ((a, of_a), (b, piece))]
        groups, links, i, j = [], [], 0, 0
        for e in sorted({*ends[0]} & {*ends[1]}):
            x, y = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            links.append((a[x - 1], b[y - 1]))
            i, j = x, y
        count.update(links)
        out.append((d, len(a), len(b), ";".join(groups), links))
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return sorted(((d, n, m, len(links), g.encode(), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links)) for d, n, m, g, links in out), key=repr)


def aligned(df, spark, **kw):
    rows = alignment.align(df, **kw)
    first = {(r.doc_id, r.n_a, r.n_b, r.n_groups): bytes(r.groups) for r in rows.collect()}
    support = alignment.link_support(rows).collect()
    assert all(r.n_links == r.n_groups for r in support)
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, first[r.doc_id, r.n_a, r.n_b, r.n_groups], r.n_best, r.count_sum) for r in support), key=repr)


def test_alignment_edges(spark, docs):
    assert aligned(docs, spark, lane_parts=5) == by_hand(ROWS)
    assert alignment.link_support(alignment.align(docs.limit(0))).count() == 0


def test_alignment_of_a_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    for kw in ({}, {"lane_parts": 1, "memo": 500}, {"lane_parts": 100_000, "slice_bytes": 1 << 14}):
        assert aligned(df, spark, **kw) == by_hand(rows)


def test_alignment_of_one_long_piece(spark):
    rng = random.Random(1)
    rows = [(1, "".join(rng.choice("abcdef") for _ in range(100_000))), (2, "a" * 50_000), (3, " " * 3_000), (4, "\n \n" * 500), (5, "日本語" * 4_000)]
    assert aligned(spark.createDataFrame(rows, "doc_id long, text string"), spark) == by_hand(rows)


def test_kinds_of_pairs_are_bounded_by_the_vocabularies():
    """Of two tokens that end together one ends with the other, so both vocabularies' bytes bound the pairs."""
    import public_tokenizers

    models = alignment.Models(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), 10)
    assert sum(int(w.sum()) for w in models.width) < 1_000_000


def test_new_queries_on_a_whole_table(spark):
    from scopesift.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op11_exact_dedup"](spark, sf).collect()), key=repr)
    assert got == classes(texts)
    want = [(d, n, m, k, k, best, total, hashlib.sha256(g).hexdigest() if n else "") for d, n, m, k, g, best, total in by_hand(texts)]
    assert sorted((tuple(r) for r in queries.QUERIES["op12_cross_tokenizer_alignment"](spark, sf).collect()), key=repr) == sorted(want, key=repr)


def test_both_libraries_encode_the_first_model_alike():
    import public_tokenizers

    m = alignment.Models(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), 10)
    assert m.fast is not None
    rng = random.Random(3)
    letters = [c for c in map(chr, range(0x21, 0x100)) if m.PLAIN.fullmatch(c)]
    words = [t.decode() for t in m.bytes_a if t.isascii()] + ["".join(rng.choice(letters[: rng.choice((90, 200))]) for _ in range(rng.randrange(1, 12))) for _ in range(20_000)]
    words = [w for w in (x.strip() for x in words) if m.PLAIN.fullmatch(w)]
    assert len(words) > 50_000
    for w, x in zip(words, m.a.encode_batch([" " + w for w in words], add_special_tokens=False)):
        assert m.fast.encode_ordinary(" " + w) == x.ids
