"""Substring dedup: repeated windows of words found with a compressed FM-index per shard.

Texts are cut into segments by minimizers: each window of ``window`` words
belongs to its least hashed run of ``gram`` words (the leftmost of equal
ones), and a segment is a run of windows that share one. Equal windows have
equal minimizers, so all places of a window meet in the shard of its
minimizer. Minimizers that only one document holds cannot start a repeat and
are dropped by an aggregation before any words move; the words of the other
segments are shipped once for each distinct segment, with the smallest
document id that holds it.

Minimizers that stand in over ``hot`` texts are divided: their segments are sent
as single windows, dealt by the window's first and last word too, which equal
windows share. A shard is a run of whole minimizers of about ``most`` segments
inside a partition; one is held at a time. It joins its distinct segments to one sequence over
the alphabet of its words, sorts suffixes up to ``window`` words, and keeps the
Burrows-Wheeler transform as a wavelet matrix. Every window is then searched
backward, all at once, by rank queries; a search whose interval shrinks to its
own row stops, so unique windows cost two or three steps. The length reached
is the window's matching statistic; windows that reach ``window`` report the
smallest document of their suffix interval. Back at the documents, words that
are covered by a window with a smaller document are removed.

Words are told by 48-bit hashes inside a shard, segments by 128-bit hashes. Null and empty texts
have no words and lose none; equal texts under one id do not repeat each
other, only smaller ids count; a null id counts as the smallest, and null ids
as one document; rows of one id with different texts are kept apart; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import saved, ship, table
from ._text import Words, few, mix, runs

NULL_ID = -(2**63)


class WaveletMatrix:
    """Rank queries over a sequence of small integers, level by level from the highest bit."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.n = bits, len(seq)
        self.ones, self.words, self.zeros = [], [], []
        for b in reversed(range(bits)):
            bit = ((seq >> b) & 1).astype(np.uint8)
            words = np.packbits(np.append(bit, np.zeros(-len(bit) % 64 + 64, np.uint8)), bitorder="little").view("<u8")
            self.words.append(words)
            self.ones.append(np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            self.zeros.append(len(bit) - int(bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, off = at >> 6, (at & 63).astype(np.uint64)
        return self.ones[level][word] + np.bitwise_count(self.words[level][word] & ((np.uint64(1) << off) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of each symbol stand before lo and before hi, less the symbols' own start in the last level."""
        base = np.zeros(len(symbol), np.int64)
        for level, b in enumerate(reversed(range(self.bits))):
            one = ((symbol >> b) & 1).astype(bool)
            out = []
            for at in (base, lo, hi):
                k = self._ones(level, at)
                out.append(np.where(one, self.zeros[level] + k, at - k))
            base, lo, hi = out
        return lo - base, hi - base


class FMIndex:
    """Suffixes of a sequence of symbols 1.., with 0 as separator, sorted by their first 2**doublings symbols."""

    def __init__(self, seq: np.ndarray, depth: int):
        n = len(seq)
        key = seq.astype(np.int64)
        done, order = 1, None
        while done < depth:
            then = np.zeros(n, np.int64)
            then[: n - done] = key[done:] + 1
            both = key * (int(key.max()) + 3) + then
            order = np.argsort(both, kind="stable")
            s = both[order]
            rank = np.cumsum(np.append(0, s[1:] != s[:-1]))
            key = np.empty(n, np.int64)
            key[order] = rank
            done *= 2
        self.order = np.argsort(key, kind="stable") if order is None else order
        top = int(seq.max()) if n else 0
        self.before = np.append(0, np.cumsum(np.bincount(seq, minlength=top + 1)))
        self.bwt = WaveletMatrix(seq[self.order - 1], max(1, top.bit_length()))

    def matching(self, seq: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place in ends: how many symbols that end there also stand elsewhere (up to most), and their suffix interval."""
        lo, hi = self.before[seq[ends]].copy(), self.before[seq[ends] + 1].copy()
        length = np.ones(len(ends), np.int64)
        live = np.flatnonzero(hi - lo > 1)
        length[hi - lo <= 1] = 0
        for k in range(1, most):
            c = seq[ends[live] - k]
            a, b = self.bwt.rank(c, lo[live], hi[live])
            a, b = a + self.before[c], b + self.before[c]
            on = (b - a > 1) & (c > 0)
            live = live[on]
            if not len(live):
                break
            lo[live], hi[live], length[live] = a[on], b[on], k + 1
        return length, lo, hi


def segments(words: Words, window: int, gram: int):
    """Segments of a batch: text number, place of the first window, windows, minimizer, 128-bit key (two columns)."""
    h, n_words = words.hashes, np.diff(words.first)
    has = np.flatnonzero(n_words >= window)
    if not len(has):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64), z.astype(np.uint64)
    g = runs(h, gram)
    wide = window - gram + 1
    best, at = g[: len(h) - window + 1].copy(), np.arange(len(h) - window + 1)
    for j in range(1, wide):
        other = g[j : j + len(best)]
        less = other < best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + j
    doc = np.repeat(np.arange(len(n_words)), n_words)[: len(best)]
    place = np.arange(len(best)) - words.first[doc]
    inside = place <= n_words[doc] - window
    new = inside.copy()
    new[1:] &= ~(inside[:-1] & (at[1:] == at[:-1]) & (doc[1:] == doc[:-1]))
    first = np.flatnonzero(new)
    where = np.flatnonzero(inside)
    count = np.diff(np.append(np.searchsorted(where, first), len(where)))
    k1, k2 = run_keys(h, first, count + window - 1)
    return doc[first], place[first], count, best[first], k1, k2


def run_keys(h: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """128 bits (two columns) for each run of words: sums of the words' hashes times powers, twice."""
    keys = []
    for mult in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        m = np.uint64(mult)
        out = mix(size.astype(np.uint64) + m)
        for j in range(int(size.max()) if len(size) else 0):
            rows = np.flatnonzero(size > j)
            out[rows] = out[rows] * m + mix(h[first[rows] + j] ^ m)
        keys.append(mix(out))
    return keys


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def _short(minimizer: np.ndarray) -> np.ndarray:
    """48 bits are sent; a collision only lets a segment through to the index in vain."""
    return minimizer & np.uint64((1 << 48) - 1)


def _six(hashes: np.ndarray) -> bytes:
    """48 bits of each word's hash: words need only be told apart inside one shard."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def search_shard(k1: np.ndarray, k2: np.ndarray, ids: np.ndarray, words: list[bytes], window: int):
    """Per distinct segment of a shard: its key and, per window, the smallest document that holds it.

    Only segments that hold a window of a smaller document for some of their own documents are returned.
    """
    order = np.lexsort((ids, k2, k1))
    k1, k2, ids = k1[order], k2[order], ids[order]
    begin = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
    most = ids[np.append(begin[1:], len(ids)) - 1]
    k1, k2, ids, words = k1[begin], k2[begin], ids[begin], [words[i] for i in order[begin]]
    size = np.fromiter(map(len, words), np.int64, len(words)) // 6
    stop = np.cumsum(size + 1)
    start = stop - size - 1
    flat = np.zeros((int(size.sum()), 8), np.uint8)
    flat[:, :6] = np.frombuffer(b"".join(words), np.uint8).reshape(-1, 6)
    flat = flat.view("<u8").ravel()
    seq = np.zeros(int(stop[-1]), np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    seq[np.arange(len(flat)) + owner] = np.unique(flat, return_inverse=True)[1] + 1
    index = FMIndex(seq, window + 1)
    windows = size - window + 1
    seg = np.repeat(np.arange(len(size)), windows)
    first = np.cumsum(windows) - windows
    ends = np.arange(len(seg)) - first[seg] + start[seg] + window - 1
    length, lo, hi = index.matching(seq, ends, window)
    holder = np.repeat(ids, size + 1)[index.order]
    least = ids[seg].copy()
    hit = np.flatnonzero(length >= window)
    if len(hit):
        los, back = np.unique(lo[hit], return_inverse=True)
        his = np.zeros(len(los), np.int64)
        his[back] = hi[hit]
        least[hit] = np.minimum.reduceat(np.append(holder, 0), np.stack([los, his], 1).ravel())[::2][back]
    told = np.flatnonzero(np.minimum.reduceat(least, first) < most)
    return k1[told], k2[told], [least[first[i] : first[i] + windows[i]] for i in told]


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 13, gram: int = 6, hot: int = 5_000, most: int = 150_000) -> DataFrame:
    """One row per text with repeats: d (its id, NULL_ID for null), h (xxhash64 of the text), whole (sha256 of its words), gone (words removed), sha, kept (the words that stay, joined by one space)."""
    ship(docs.sparkSession)
    named = docs.selectExpr(f"cast(`{id_col}` AS long) AS d", f"`{text_col}` AS t")

    def anchors(batches):
        for b in few(batches):
            ids, (doc, _, _, a, _, _) = _ids(b.column(0)), segments(Words(b.column(1)), window, gram)
            a = _short(a)
            order = np.lexsort((doc, a))
            a, doc = a[order], doc[order]
            keep = np.ones(len(a), bool)
            keep[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
            yield pa.RecordBatch.from_arrays([_long(a[keep]), pa.array(ids[doc[keep]], pa.int64())], names=["a", "d"])

    def found(batch):
        """Segments of a batch of candidates whose minimizer is shared."""
        w = Words(batch.column(1))
        doc, at, n, a, k1, k2 = segments(w, window, gram)
        a = _short(a)
        shared = batch.column(2)
        of = np.repeat(np.arange(len(shared), dtype=np.uint64), pa.compute.list_value_length(shared).to_numpy(zero_copy_only=False))
        mine = mix(shared.flatten().to_numpy(zero_copy_only=False).view(np.uint64) + mix(of))
        own = mix(a + mix(doc.astype(np.uint64)))
        on = np.isin(own, mine)
        many = batch.column(3)
        of = np.repeat(np.arange(len(many), dtype=np.uint64), pa.compute.list_value_length(many).to_numpy(zero_copy_only=False))
        much = on & np.isin(own, mix(many.flatten().to_numpy(zero_copy_only=False).view(np.uint64) + mix(of)))
        if not much.any():
            return w, doc[on], at[on], n[on], a[on], k1[on], k2[on]
        rest, rows = np.flatnonzero(on & ~much), np.flatnonzero(much)
        row = np.repeat(rows, n[rows])
        place = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
        first = w.first[doc[row]] + place
        part = _short(mix(a[row] + mix(w.hashes[first]) + np.uint64(3) * mix(w.hashes[first + window - 1])))
        p1, p2 = run_keys(w.hashes, first, np.full(len(row), window))
        return (w, *(np.concatenate([x[rest], y]) for x, y in ((doc, doc[row]), (at, place), (n, np.ones(len(row), n.dtype)), (a, part), (k1, p1), (k2, p2))))

    def pieces(batches):
        for b in few(batches):
            w, doc, at, n, a, k1, k2 = found(b)
            ids = _ids(b.column(0))[doc]
            order = np.lexsort((ids, k2, k1))  # one row per distinct segment and end of its range of documents
            same = (k1[order][1:] == k1[order][:-1]) & (k2[order][1:] == k2[order][:-1])
            take = np.ones(len(order), bool)
            take[1:-1] = ~(same[:-1] & same[1:])
            r = order[take]
            size = n[r] + window - 1
            stop = np.cumsum(size)
            rows = np.repeat(w.first[doc[r]] + at[r] - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)
            for lo in range(0, len(r), 50_000):
                hi = min(lo + 50_000, len(r))
                x, y = int(stop[lo] - size[lo]), int(stop[hi - 1])
                offs = pa.array(np.append(0, stop[lo:hi] - x) * 6, pa.int32())
                blob = pa.Array.from_buffers(pa.binary(), hi - lo, [None, offs.buffers()[1], pa.py_buffer(_six(w.hashes[rows[x:y]]))])
                yield pa.RecordBatch.from_arrays([_long(a[r[lo:hi]]), _long(k1[r[lo:hi]]), _long(k2[r[lo:hi]]), pa.array(ids[r[lo:hi]], pa.int64()), blob], names=["a", "k1", "k2", "d", "words"])

    def places(batches):
        for b in few(batches):
            _, doc, at, _, _, k1, k2 = found(b)
            yield pa.RecordBatch.from_arrays([_long(k1), _long(k2), pa.array(_ids(b.column(0))[doc], pa.int64()), b.column(4).take(pa.array(doc, pa.int64())), pa.array(at, pa.int64())], names=["k1", "k2", "d", "h", "at"])

    def shard(batches):
        """Rows arrive sorted by minimizer."""
        held = []
        for b in batches:
            a = b.column(0).to_numpy()
            new = np.flatnonzero(a[1:] != a[:-1]) + 1
            if held and b.num_rows and a[0] != held[-1].column(0)[held[-1].num_rows - 1].as_py():
                new = np.append(0, new)
            if len(new) and sum(x.num_rows for x in held) + new[-1] >= most:
                cut = int(new[-1])
                yield from search([*held, b.slice(0, cut)])
                held, b = [], b.slice(cut)
            if b.num_rows:
                held.append(b)
        if held:
            yield from search(held)

    def search(rows):
        t = pa.Table.from_batches(rows)
        k1, k2, least = search_shard(*(t.column(i).to_numpy() for i in (1, 2, 3)), t.column(4).to_pylist(), window)
        for lo in range(0, len(k1), 20_000):
            part = least[lo : lo + 20_000]
            offs = pa.array(np.append(0, np.cumsum([len(x) for x in part])), pa.int32())
            yield pa.RecordBatch.from_arrays([_long(k1[lo : lo + 20_000]), _long(k2[lo : lo + 20_000]), pa.ListArray.from_arrays(offs, pa.array(np.concatenate(part), pa.int64()))], names=["k1", "k2", "least"])

    def strip(batches):
        for b in few(batches):
            out = []
            for d, h, x, hits in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                words = x.encode().split()
                begin = hits.values.to_numpy()
                edge = np.bincount(begin, minlength=len(words) + 1) - np.bincount(begin + window, minlength=len(words) + 1)[: len(words) + 1]
                gone = np.cumsum(edge)[: len(words)] > 0
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((d, h, _sha(words), int(gone.sum()), _sha(kept), b" ".join(kept).decode()))
            c = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.string()), pa.array(c[5], pa.string())], names=["d", "h", "whole", "gone", "sha", "kept"])

    import pyarrow.compute  # noqa: F401

    shared = saved(named.mapInArrow(anchors, "a long, d long").groupBy("a").agg(F.min("d").alias("x"), F.max("d").alias("y"), F.count("*").alias("n")).filter("x < y").select("a", (F.col("n") > hot).alias("hot")), "shared")
    by_doc = named.mapInArrow(anchors, "a long, d long").join(shared, "a").groupBy("d").agg(F.collect_set("a").alias("a"), F.collect_set(F.when(F.col("hot"), F.col("a"))).alias("many"))
    candidates = saved(named.withColumn("d", F.coalesce("d", F.lit(NULL_ID))).join(by_doc, "d").select("d", "t", "a", "many", F.xxhash64("t").alias("h")), "candidates")
    least = candidates.mapInArrow(pieces, "a long, k1 long, k2 long, d long, words binary").repartition("a").sortWithinPartitions("a").mapInArrow(shard, "k1 long, k2 long, least array<long>")
    hits = saved((candidates.mapInArrow(places, "k1 long, k2 long, d long, h long, at long").join(least, ["k1", "k2"])
            .selectExpr("d", "h", "filter(transform(least, (x, i) -> if(x < d, at + i, null)), x -> x IS NOT NULL) AS begin").filter("size(begin) > 0")
            .groupBy("d", "h").agg(F.flatten(F.collect_list("begin")).alias("begin"))), "hits")
    return (candidates.select("d", "h", "t").join(hits, ["d", "h"]).select("d", "h", "t", "begin")
            .mapInArrow(strip, "d long, h long, whole string, gone long, sha string, kept string").dropDuplicates(["d", "h"]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 13, gram: int = 6, **options) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by one space; null where none went)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def plain(batches):
        for b in few(batches):
            words = [[] if x is None else x.encode().split() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([_sha(w) for w in words], pa.string())], names=["d", "n_words", "whole"])

    stripped = repeats(docs, id_col, text_col, window=window, gram=gram, **options).drop("h")
    named = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("d"), F.col(text_col).alias("t"))
    return named.mapInArrow(plain, "d long, n_words long, whole string").join(stripped, ["d", "whole"], "left").select(
        F.when(F.col("d") != NULL_ID, F.col("d")).cast(kind).alias(id_col), "n_words", F.coalesce("gone", F.lit(0)).alias("n_removed"),
        F.coalesce("sha", "whole").alias("kept_sha256"), "kept")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with repeated words taken out of their texts; texts of which no word stays go, others are left as they are."""
    cut = repeats(docs, id_col, text_col, **options).select(F.col("d").alias("__d"), F.col("h").alias("__h"), F.col("kept").alias("__kept"))
    keys = (F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)) == F.col("__d")) & (F.xxhash64(text_col) == F.col("__h"))
    joined = docs.join(cut, keys, "left").where("__kept IS NULL OR __kept <> ''")
    return joined.withColumn(text_col, F.coalesce("__kept", text_col)).select(docs.columns)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
