"""Alignment of two tokenizers' tokens of the same text by diagonal run skipping.

Both token sequences are arrays of the bytes at which tokens end. From a common
end on, exponential probing compares the arrays at the current shift of their
indexes, 4 ends, then 8, 16 and so on, and jumps over the stretch in which every
token of one is a token of the other. Where they part, the group is resolved
locally: the side that ends earlier steps on until both end together, and the
shift changes by the difference of the steps. The stretches of many documents
are walked at once, from borders that are known to be common: a space between
two characters that are no white space, before which both models end a token.

A first pass tokenizes and aligns; its table holds each text's linked pairs.
Pairs are then counted over the corpus. Two tokens that end together are equal
or one is a suffix of the other, so there are at most as many kinds of pairs as
both vocabularies have bytes, less than a million; their counts may go to the
driver and to every task.

Null and empty texts, and texts that a model writes with other bytes (the
character U+2581), have no tokens. Repeated rows give repeated rows and count
each. Very long texts are a slice by themselves. Other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import json
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import saved, table
from ._text import slices
from .bpe import _parts

_MEMO: dict = {}
#: All characters that Unicode or Python call white space.
_WHITE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class Models:
    """Ids of both models for the parts of texts between stable borders, each behind a space; one for each Python worker and setting. About ``limit`` parts are kept, then all are forgotten."""

    #: Characters that every version of Unicode sorts alike.
    PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+(\n[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)*")

    def __init__(self, path_a: str, path_b: str, limit: int):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b, self.limit = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b), limit
        self.a.encode_special_tokens = True  # their strings are plain text
        self.fast = _by_ranks(path_a, self.a)
        piece = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(y == "▁" != x for p in piece for x, y in zip(p, p[1:])):
            raise ValueError("a piece goes on behind a space: texts can't be divided there")
        self.bytes_a = token_bytes(self.a)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(piece)]
        self.width = [np.fromiter(map(len, x), np.int32, len(x)) for x in (self.bytes_a, self.bytes_b)]
        self.forget()

    @classmethod
    def of(cls, *key) -> "Models":
        if key not in _MEMO:
            _MEMO[key] = cls(*key)
        return _MEMO[key]

    def forget(self) -> None:
        self.parts: dict[str, int] = {}
        self.good = np.zeros(1 << 14, bool)
        # for each model the ids of all parts, and where a part's begin and how many they are
        self.flat, self.used = [np.zeros(1 << 16, np.uint16) for _ in range(2)], [0, 0]
        self.start, self.size = (np.zeros((2, 1 << 14), np.int64) for _ in range(2))

    def learn(self, parts: list[str]) -> None:
        new = [p for p in parts if p not in self.parts]
        if self.parts and len(self.parts) + len(new) > self.limit:
            self.forget()
            new = parts
        # many parts are encoded as one text where a stable border lies between every two of them
        plain = [p for p in new if self.PLAIN.fullmatch(p)] if self.fast else []
        have = set(plain)
        rest = [p for p in new if p not in have]
        joint = [p for p in rest if p and not p[0].isspace() and not p[-1].isspace() and "▁" not in p]
        for some, fast in ((plain, True), (joint, False)):
            for i in range(0, len(some), 2_048):
                self._encode(some[i : i + 2_048], fast)
        if len(joint) < len(rest):
            have = set(joint)
            for p in rest:
                if p not in have:
                    self._encode([p], False)

    def _encode(self, parts: list[str], fast: bool) -> None:
        had, n, text = len(self.parts), len(parts), " ".join(parts)
        while had + n > len(self.good):
            self.good = np.append(self.good, np.zeros_like(self.good))
            self.start, self.size = (np.append(x, np.zeros_like(x), 1) for x in (self.start, self.size))
        raw, good = b" " + text.encode(), True
        end = np.cumsum(np.fromiter((len(p.encode()) for p in parts), np.int64, n) + 1)
        ids_a = self.fast.encode_ordinary(" " + text) if fast else self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        both = ids_a, self.b.encode(text)
        for k, (ids, of) in enumerate(zip(both, (self.bytes_a, self.bytes_b))):
            good &= b"".join([of[i] for i in ids]) == raw
            more = np.asarray(ids, np.uint16)
            stop = np.searchsorted(np.cumsum(self.width[k][more]), end, "right") if good else np.full(n, len(more))
            while self.used[k] + len(more) > len(self.flat[k]):
                self.flat[k] = np.append(self.flat[k], np.zeros_like(self.flat[k]))
            self.flat[k][self.used[k] : self.used[k] + len(more)] = more
            self.size[k, had : had + n] = np.diff(stop, prepend=0)
            self.start[k, had : had + n] = self.used[k] + stop - self.size[k, had : had + n]
            self.used[k] += len(more)
            if n > 1 and not (good and (np.cumsum(self.width[k][more])[stop - 1] == end).all()):
                raise ValueError("two parts were not divided by a model")
        self.good[had : had + n] = good
        self.parts.update(zip(parts, range(had, had + n)))

    def ids(self, k: int, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the k-th model for parts in a row, and the number of them for each part."""
        size = self.size[k][entry]
        end = np.cumsum(size)
        return self.flat[k][np.repeat(self.start[k][entry] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)], size


def _by_ranks(path: str, tok):
    """The same model for a faster library, where its merges are in the order of the ids that they give (else None)."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in json.load(f)["model"]["merges"]]
    ids = [tok.token_to_id(m) for m in made]
    if ids != [256 + k for k in range(len(ids))]:
        return None
    ranks = {t: i for i, t in enumerate(token_bytes(tok)) if t}
    return tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_bytes(tok) -> list[bytes]:
    """Bytes of every id of a byte-level model: its entry's characters stand for bytes, printable ones for themselves, the others from U+0100 on in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(x): x for x in printable} | {chr(0x100 + k): x for k, x in enumerate(sorted({*range(256)} - {*printable}))}
    vocabulary = tok.get_vocab(with_added_tokens=False)
    out = [b""] * (max(tok.get_vocab().values()) + 1)
    for entry, i in vocabulary.items():
        out[i] = bytes(byte.get(c, 0) for c in entry)
    return out


def parts_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct parts of the texts between stable borders without the space before them, the number of every part in a row, and where each text's begin and end. A null or empty text has none."""
    texts = texts.fill_null("")
    lists = pa.compute.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary
    # a space is a stable border only between two characters that are no white space
    edges = [pa.compute.utf8_slice_codeunits(words, 0, 1), pa.compute.utf8_slice_codeunits(words, -1, 1 << 30)]
    odd = np.logical_or.reduce([np.asarray(pa.compute.equal(words, "")), *(np.asarray(pa.compute.match_substring_regex(x, _WHITE)) for x in edges)])
    if odd.any():
        first = lists.offsets.to_numpy().astype(np.int64)
        bad = np.add.reduceat(odd[coded.indices.to_numpy()], first[:-1] - first[0]) > 0
        again = pa.array([_parts(x) if x else [] for x in texts.filter(pa.array(bad)).to_pylist()], lists.type)
        order = np.empty(len(bad), np.int64)
        order[np.append(np.flatnonzero(~bad), np.flatnonzero(bad))] = np.arange(len(bad))
        lists = pa.concat_arrays([lists.filter(pa.array(~bad)), again]).take(pa.array(order))
        coded = lists.flatten().dictionary_encode()
    first = lists.offsets.to_numpy().astype(np.int64)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), first - first[0]


def common_ends(a: np.ndarray, b: np.ndarray, lane_a: np.ndarray, lane_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a, b: rising bytes at which tokens end. Lanes: lane_a[x]:lane_a[x + 1] and lane_b[x]:lane_b[x + 1] begin and end together. Which tokens of a and of b end together with one of the other."""
    ends = [np.zeros(len(a) + 1, np.int32), np.zeros(len(b) + 1, np.int32)]
    a, b = np.append(a, np.full(4, -1)), np.append(b, np.full(4, -2))
    live = np.flatnonzero((lane_a[1:] > lane_a[:-1]) & (lane_b[1:] > lane_b[:-1]))
    i, j, stop_a, stop_b = lane_a[live], lane_b[live], lane_a[live + 1], lane_b[live + 1]
    while len(i):
        # the stretch at this shift of indexes
        run, rows, width = np.zeros(len(i), np.int64), np.arange(len(i)), 4
        most = np.minimum(stop_a - i, stop_b - j)
        while len(rows):
            go = np.arange(width)
            x, y = (np.minimum((z[rows] + run[rows])[:, None] + go, len(w) - 1) for z, w in ((i, a), (j, b)))
            same = a[x] == b[y]
            whole = same.all(1)
            run[rows] += np.where(whole, width, same.argmin(1))
            rows = rows[whole & (run[rows] < most[rows])]
            width = min(width * 2, 1 << 10)
        run = np.minimum(run, most)
        some = run > 0
        for end, z in zip(ends, (i, j)):  # no two stretches begin or end at the same token
            end[z[some]] += 1
            end[(z + run)[some]] -= 1
        i, j = i + run, j + run
        # what is left begins with a group that isn't one to one
        left = i < stop_a
        i, j, stop_a, stop_b = i[left], j[left], stop_a[left], stop_b[left]
        rows = np.arange(len(i))
        while len(rows):
            x, y = a[i[rows]], b[j[rows]]
            i[rows[x < y]] += 1
            j[rows[x > y]] += 1
            rows = rows[x != y]
        # they now stand at the group's common end, with which the next stretch begins
    return np.cumsum(ends[0][:-1]) > 0, np.cumsum(ends[1][:-1]) > 0


def _decimals() -> tuple[np.ndarray, np.ndarray]:
    """For every 16-bit integer its decimal digits as the first bytes of eight, and how many they are."""
    n = np.arange(1 << 16, dtype=np.uint64)
    size = np.char.str_len(n.astype("U5")).astype(np.uint64)
    out = np.zeros(1 << 16, np.uint64)
    for k in range(5):  # the k-th digit from the right
        have = size > k
        out[have] |= (n[have] // np.uint64(10**k) % np.uint64(10) + np.uint64(48)) << (np.uint64(8) * (size[have] - np.uint64(k + 1)))
    return out, size


_DECIMAL, _SIZE = _decimals()
_FIRST = np.asarray([[k < n for k in range(8)] for n in range(8)])


def group_texts(ids: tuple[np.ndarray, np.ndarray], end: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Groups of all documents in a row as `a1,a2|b1;` each: the bytes, and where each group ends in them."""
    a, b = ids
    stop_a, stop_b = (np.flatnonzero(x).astype(np.int32) + 1 for x in end)
    n_a, n_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
    # a group's tokens of a, then those of b
    at_a = np.arange(len(a), dtype=np.int32) + np.repeat(stop_b - n_b, n_a)
    at_b = np.arange(len(b), dtype=np.int32) + np.repeat(stop_a, n_b)
    every, mark = np.empty(len(a) + len(b), np.uint16), np.full(len(a) + len(b), ord(","), np.uint64)
    every[at_a], every[at_b] = a, b
    last = at_b[end[1]]
    mark[at_a[end[0]]], mark[last] = ord("|"), ord(";")
    size = _SIZE[every]
    mark <<= size * np.uint64(8)
    mark |= _DECIMAL[every]
    size += np.uint64(1)
    return mark.view(np.uint8).reshape(-1, 8)[_FIRST[size]], np.cumsum(size.astype(np.int64))[last]


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model_a: str | None = None, model_b: str | None = None,
          lane_parts: int = 48, memo: int = 300_000, slice_bytes: int = 2 << 20) -> DataFrame:
    """One row per text: id, n_a, n_b, n_groups, groups (`a1,a2|b1;a3|b2,b3`, decimal ids) and links: one unsigned 32-bit integer (a * 65536 + b, little-endian) for each two tokens that end together.

    model_a: a byte-level model of the tokenizers library; model_b: a sentencepiece model that puts a space before the text. lane_parts: parts of a text that are walked as one.
    """
    paths = model_a or public_tokenizers.path("byte_bpe_50k.json"), model_b or public_tokenizers.path("piece_bpe_32k.model")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        models = Models.of(*paths, memo)
        for batch in slices(batches, bytes_=slice_bytes):
            parts, entry, first = parts_of(batch.column(1))
            models.learn(parts)
            entry = np.fromiter(map(models.parts.__getitem__, parts), np.int64, len(parts))[entry]
            owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
            bad = np.bincount(owner[~models.good[entry]], minlength=len(first) - 1) > 0
            entry, owner = entry[~bad[owner]], owner[~bad[owner]]
            first = np.searchsorted(owner, np.arange(len(first)))
            ids, size = zip(*(models.ids(k, entry) for k in range(2)))
            ends = [np.cumsum(w[x]) for w, x in zip(models.width, ids)]
            lane = np.unique(np.append(np.arange(0, len(entry), lane_parts), first))
            before = [np.append(0, np.cumsum(x)) for x in size]  # tokens before a part
            end = common_ends(*ends, *(x[lane] for x in before))
            texts, stop = group_texts(ids, end)
            a, b = (x[e].astype(np.uint32) for x, e in zip(ids, end))
            links = a << np.uint32(16) | b
            n_groups = np.searchsorted(np.flatnonzero(end[0]), before[0][first])
            stop, raw, held = np.append(0, stop)[n_groups].tolist(), texts.tobytes(), links.astype("<u4").tobytes()
            at = n_groups.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.diff(x[first]), pa.int64()) for x in before), pa.array(np.diff(n_groups), pa.int64()),
                pa.array([raw[x : max(y - 1, x)] for x, y in zip(stop[:-1], stop[1:])], pa.binary()), pa.array([held[4 * x : 4 * y] for x, y in zip(at[:-1], at[1:])], pa.binary())],
                names=[id_col, "n_a", "n_b", "n_groups", "groups", "links"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, groups binary, links binary")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair (a * 65536 + b), n: how many links of the whole corpus hold it. Each task sums its own first."""

    def run(batches):
        pairs, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for b in batches:
            values = np.frombuffer(b"".join(b.column(0).drop_null().to_pylist()), "<u4")
            more, k = np.unique(values, return_counts=True)
            pairs, back = np.unique(np.append(pairs, more), return_inverse=True)
            n = np.bincount(back, np.append(n, k), len(pairs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n)], names=["pair", "n"])

    return aligned.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def link_support(aligned: DataFrame) -> DataFrame:
    """Each row of ``align`` (written, since it is read twice) with n_links, n_best (links whose count is the highest of their b id) and count_sum instead of groups and links; other columns stay."""
    spark = aligned.sparkSession
    counts = pair_counts(aligned).orderBy("pair").toArrow()  # bounded by the vocabularies' bytes
    pairs, n = (counts.column(k).to_numpy().astype(np.int64) for k in ("pair", "n"))
    best = np.zeros(1 << 16, np.int64)
    np.maximum.at(best, pairs & 0xFFFF, n)
    sent = spark.sparkContext.broadcast((pairs.astype(np.uint32), n, n == best[pairs & 0xFFFF]))
    others = [c for c in aligned.columns if c not in ("links", "groups")]

    def run(batches):
        pairs, n, is_best = sent.value
        for b in batches:
            raw = b.column("links").to_pylist()
            size = np.fromiter((len(x) // 4 for x in raw), np.int64, len(raw))
            at = np.searchsorted(pairs, np.frombuffer(b"".join(raw), "<u4"))
            stop = np.append(0, np.cumsum(size))
            sums = [np.diff(np.append(0, np.cumsum(x[at]))[stop]) for x in (is_best.astype(np.int64), n)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), *(pa.array(x, pa.int64()) for x in (size, *sums))], names=[*others, "n_links", "n_best", "count_sum"])

    schema = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in others)
    return aligned.drop("groups").mapInArrow(run, f"{schema}, n_links long, n_best long, count_sum long")


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    aligned = saved(align(table(spark, sf_dir, "documents")).withColumn("groups_sha256", told).drop("groups"), "aligned")
    return link_support(aligned).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
