"""Byte-level BPE encoding and decoding.

Spark higher-order functions fold the ranked merges over the bytes of distinct
pieces. The rank map is a literal: the two ids that a merge joins make a key,
keys and ranks stand in small arrays at places that the key tells, and the rank
of a pair is also the id of what it becomes, so the state is ids and pair ranks.

One pass over the texts, without a shuffle: each scan task first names the
pieces that are new to it beside the slice of texts in which they first stand,
the fold turns those into ids in the JVM, and a second step gathers the ids of
whole texts. Both steps forget what they know when a slice is marked, so memory
is bounded whatever a task holds. Decoding joins the binary pieces of the ids.

Null and empty texts have no ids; repeated rows give repeated rows; other
columns are ignored; an empty table gives an empty result. A piece of one
pattern match is folded whole: n bytes take n steps over arrays of n.
"""

from __future__ import annotations

import base64
import json
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import table
from ._text import slices

NO_RANK = 2**31 - 1
_CUTS = re.compile(r"(?<=\S)(?= \S)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The ranked merges of one piece, lowest rank first, leftmost of equal ones."""
    t = [piece[i : i + 1] for i in range(len(piece))]
    while len(t) > 1:
        low, p = min((ranks.get(t[i] + t[i + 1], NO_RANK), i) for i in range(len(t) - 1))
        if low == NO_RANK:
            break
        t[p : p + 2] = [t[p] + t[p + 1]]
    return t


def rank_literals(ranks: dict[bytes, int], buckets: int) -> tuple[str, str, str, str]:
    """SQL of four literals: keys of mergeable pairs and their ranks, ids of the 256 bytes, and the tokens that merges do not reach.

    A key stands in bucket key % buckets at place key % length of the bucket, which is as long as it takes for no two to meet.
    """
    dealt: list[dict[int, int]] = [{} for _ in range(buckets)]
    for token, to in ranks.items():
        for k in range(1, len(token)):
            left, right = ranks.get(token[:k]), ranks.get(token[k:])
            if left is not None and right is not None:
                key = (left << 32) + right
                dealt[key % buckets][key] = to
    keys, rank = [], []
    for some in dealt:
        n = max(len(some), 1)
        while len({k % n for k in some}) < len(some):
            n += 1
        at = {k % n: k for k in some}
        keys.append([at.get(i, -1) for i in range(n)])
        rank.append([some.get(k, NO_RANK) for k in keys[-1]])
    alone = {t.decode("latin-1"): r for t, r in ranks.items() if len(merged(t, ranks)) > 1}
    names = ", ".join(f"'{''.join(f'\\u{ord(c):04x}' for c in t)}', {r}L" for t, r in alone.items())

    def nested(lists) -> str:
        return f"from_json('{json.dumps(lists, separators=(',', ':'))}', 'array<array<bigint>>')"

    bytes_ = ", ".join(f"{ranks[bytes([i])]}L" for i in range(256))
    return nested(keys), nested(rank), f"array({bytes_})", f"map({names})" if alone else "cast(map() AS map<string,bigint>)"


def _let(name: str, value: str, start: str, body: str) -> str:
    """SQL of ``body`` with ``name`` bound to ``value``. It is of the type of ``start``; an aggregate of one element, since transform would copy its result."""
    return f"aggregate(array({value}), {start}, (start_{name}, {name}) -> {body})"


def fold(pieces: str, literals: tuple[str, str, str, str], buckets: int) -> Column:
    """Ids of every piece in the array column ``pieces``: array<array<bigint>>. literals: names of the columns that are the rank literals."""
    keys, ranks, bytes_, alone = literals
    none = f"{NO_RANK}L"

    def rank(x: str, y: str) -> str:
        place = f"cast(pmod(k, size(get(ks, h))) AS int)"
        found = f"if(get(get(ks, h), {place}) = k, get(get(vs, h), {place}), {none})"
        return _let("k", f"{x} * 4294967296L + {y}", none, _let("h", f"cast(pmod(k, {buckets}L) AS int)", none, found))

    # t has -1 at both ends, so that every pair has two neighbours; the least of rank and place is the next merge
    merge = f"""named_struct(
      't', flatten(array(slice(s.t, 1, p), array(low), slice(s.t, p + 3, size(s.t)))),
      'r', flatten(array(slice(s.r, 1, p - 1), array({rank('get(s.t, p - 1)', 'low')}, {rank('low', 'get(s.t, p + 2)')}), slice(s.r, p + 3, size(s.r)))))"""
    best = "array_min(transform(s.r, (x, i) -> shiftleft(x, 31) + i))"
    step = f"if(array_min(s.r) = {none}, s, {_let('m', best, 's', _let('p', 'cast(m & 2147483647L AS int)', 's', _let('low', 'shiftright(m, 31)', 's', merge)))})"
    state = f"named_struct('t', t, 'r', transform(slice(t, 1, size(t) - 1), (x, i) -> {rank('x', 'get(t, i + 1)')}))"
    ends = f"aggregate(sequence(1, size(t) - 3), {state}, (s, z) -> {step}, s -> slice(s.t, 2, size(s.t) - 2))"
    folded = _let("t", f"concat(array(-1L), transform(split(b, ''), c -> get(bs, ascii(c))), array(-1L))", "cast(array() AS array<bigint>)", f"if(size(t) > 3, {ends}, slice(t, 2, 1))")
    whole = f"if(size({alone}) > 0 AND {alone}[b] IS NOT NULL, array({alone}[b]), {folded})"
    each = f"transform({pieces}, w -> {_let('b', 'decode(encode(w, ' + repr('UTF-8') + '), ' + repr('ISO-8859-1') + ')', 'cast(array() AS array<bigint>)', whole)})"
    # each literal is named once, so that a task is sent it once
    for name, value in (("ks", keys), ("vs", ranks), ("bs", bytes_)):
        each = _let(name, value, "cast(array() AS array<array<bigint>>)", each)
    return F.expr(each)


def _parts(text: str) -> list[str]:
    """Divided at stable borders; all but the first stood behind a space, which is left out."""
    p = _CUTS.split(text)
    return [p[0], *(q[1:] for q in p[1:])]


class _Coded:
    """The parts of a slice's texts, numbered: distinct ``keys`` (a part with its space, or a text's first part), ``entry`` of every part, ``first`` part of every text."""

    def __init__(self, texts: pa.Array):
        texts = texts.fill_null("")
        lists = pa.compute.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        # a space is a stable border only between two characters that are no white space
        odd = np.fromiter((not w or w[0].isspace() or w[-1].isspace() for w in words), bool, len(words))
        at = coded.indices.to_numpy()
        first = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        if odd.any():
            bad = np.add.reduceat(odd[at], first[:-1]) > 0
            each = lists.to_pylist()
            again = [_parts(x) if b else p for x, p, b in zip(texts.to_pylist(), each, bad.tolist())]
            lists = pa.array(again, pa.list_(pa.string()))
            coded = lists.flatten().dictionary_encode()
            words, at, first = coded.dictionary.to_pylist(), coded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        lead = np.zeros(len(at), bool)
        lead[first[:-1]] = True
        place = np.zeros((2, len(words)), np.int64)
        self.keys: list[str] = []
        for k, some in enumerate((at[~lead], at[lead])):
            used = np.flatnonzero(np.bincount(some, minlength=len(words)))
            place[k, used] = len(self.keys) + np.arange(len(used))
            self.keys += [words[i] if k else " " + words[i] for i in used.tolist()]
        self.entry, self.first = place[lead.astype(np.int64), at], first


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ranks: str | None = None, pattern: str | None = None,
           buckets: int = 32_749, known: int = 1_000_000, slice_bytes: int = 1 << 20) -> DataFrame:
    """One row per text: id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded (bytes)."""
    path = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    # the pattern's \s is the White_Space property; Python's own takes in more
    exact = (pattern or public_tokenizers.PATTERN).replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    kind = docs.schema[id_col].dataType.simpleString()

    def name_pieces(batches):
        import regex

        find = regex.compile(exact).findall
        keys, pieces = set(), set()
        for b in slices(batches, bytes_=slice_bytes):
            met = set(_Coded(b.column(1)).keys)
            if marked := len(keys) + len(pieces) > known:
                keys, pieces = set(), set()
            met -= keys
            keys |= met
            new = {q for k in met for q in find(k)} - pieces
            pieces |= new
            rest = b.num_rows - 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([marked] + [False] * rest, pa.bool_()), pa.array([list(new)] + [None] * rest, pa.list_(pa.string()))], names=["i", "t", "forget", "new"])

    def put_together(batches):
        import regex

        find = regex.compile(exact).findall
        of = {rank: token for token, rank in read_ranks(path).items()}
        tokens = pa.array([of.get(i, b"") for i in range(max(of) + 1)], pa.large_binary())
        ids: dict[str, bytes] = {}
        where: dict[str, int] = {}
        flat, used, size = np.zeros(1 << 16, np.uint32), 0, np.zeros(1 << 14, np.int64)
        start = size.copy()

        def parts(batches):
            """Cut where something is forgotten."""
            for b in slices(batches, bytes_=slice_bytes):
                at = [0, *(i for i in np.flatnonzero(b.column(2).to_numpy(zero_copy_only=False)).tolist() if i), b.num_rows]
                for lo, hi in zip(at[:-1], at[1:]):
                    yield b.slice(lo, hi - lo)

        for b in parts(batches):
            if b.column(2)[0].as_py():
                ids, where, used = {}, {}, 0
            for words, got in zip(b.column(3).drop_null().to_pylist(), b.column(4).drop_null()):
                if words:
                    folded = got.values
                    at = folded.offsets.to_numpy().astype(np.int64) * 4
                    raw = folded.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
                    ids.update(zip(words, (raw[x:y] for x, y in zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist()))))
            c = _Coded(b.column(1))
            new = [k for k in c.keys if k not in where]
            raws = [b"".join([ids[q] for q in find(k)]) for k in new]
            n, more = np.fromiter(map(len, raws), np.int64, len(raws)) // 4, np.frombuffer(b"".join(raws), "<u4")
            had = len(where)
            while used + len(more) > len(flat):
                flat = np.append(flat, np.zeros_like(flat))
            while had + len(new) > len(start):
                start, size = np.append(start, np.zeros_like(start)), np.append(size, np.zeros_like(size))
            flat[used : used + len(more)] = more
            size[had : had + len(new)], start[had : had + len(new)] = n, used + np.cumsum(n) - n
            used += len(more)
            where.update(zip(new, range(had, had + len(new))))
            entry = np.fromiter(map(where.__getitem__, c.keys), np.int64, len(c.keys))[c.entry]
            n = size[entry]
            end = np.cumsum(n)
            out = flat[np.repeat(start[entry] - (end - n), n) + np.arange(end[-1])]
            stop = np.append(0, end)[c.first]
            back = tokens.take(pa.array(out))
            cut = np.frombuffer(back.buffers()[1], np.int64)[: len(out) + 1][stop]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(np.diff(stop), pa.int64()),
                pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(b), [None, pa.py_buffer(stop * 4), pa.py_buffer(out.astype("<u4"))]).cast(pa.binary()),
                pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(b), [None, pa.py_buffer(cut), back.buffers()[2]]).cast(pa.binary()),
            ], names=[id_col, "n_tokens", "ids", "decoded"])

    named = docs.selectExpr(f"`{id_col}` AS i", f"`{text_col}` AS t").mapInArrow(name_pieces, f"i {kind}, t string, forget boolean, new array<string>")
    names = ("__keys", "__ranks", "__bytes", "__alone")
    for name, sql in zip(names, rank_literals(read_ranks(path), buckets)):
        named = named.withColumn(name, F.expr(sql))
    return named.select("i", "t", "forget", "new", fold("new", names, buckets).alias("ids")).mapInArrow(put_together, f"`{id_col}` {kind}, n_tokens long, ids binary, decoded binary")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = encode(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
