"""Jaccard join on sets of word n-grams by PartEnum signatures, and the classes that its links make.

Two sets of a and b elements with Jaccard similarity t differ in at most
(a + b)(1 - t)/(1 + t) elements. Sizes are dealt to bands [L, 2L), each
beginning in the middle of the one before, so two similar sets always share a
band. In a band the feature domain is divided into slices, and each slice into
three parts; more slices are cut than two differences each could spoil, so some
slice has at most one, hence two equal parts. Every set enumerates the two-part
subsets of every slice, and similar sets share a signature.

Empty parts say nothing, so empty signatures are not sent. A set that has too
many empty parts for the count above also sends each of its elements as a
signature; if only one of two sets is such, its partner's count still holds, if
both are, they share an element. So no similar pair is missed.

Equal sets are one node from the start. A first look joins most near copies: the
signatures of the first ``quick`` slices alone, made where the sets are first
read. Then each node sends all its signatures, with the class that the first
look gave it. They are gathered per shard; a group whose members are all of one
class says nothing new and goes, so near copies don't meet again in as many
shards as they share signatures. The members of any other group all go to the
group's hub, its first member in a hashed order; groups that overlap mostly share their hub, so a set goes to few
hubs however many signatures it shares. Inside a hub every two sets are looked
at in one task, block by block: first sizes and parity sketches (the differing
bits of two sketches never outnumber the differing elements) tell which sets
may have a partner at all; only those are sent on as whole sets, which are
compared exactly and joined at once, so a hub of n sets gives n - 1 links at
most and never its pairs. Hubs over ``block`` sets are dealt out as pairs of
blocks over many tasks. Those over ``huge`` sets are divided before by
signatures of another seed, in ``rounds`` at most; no group is cut.

Sets are told by 64-bit hashes of their elements. Null texts and texts without
words have empty sets, linked with nothing. Rows that repeat an id with another
text are told apart by text and linked by their id. An empty table gives an
empty result; null ids are one id; columns other than the two named are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import dealt, per_block
from ._spark import drop, saved, ship, table
from ._text import Words, few, mix, runs
from .components import components

NULL_ID = -(2**63)
SKETCH_BITS = 1024


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text (lower-cased A-Z): text number and hash, sorted by both."""
    w = Words(texts, lower=True)
    count = np.diff(w.first)
    long = count >= n
    h = runs(w.hashes, n) if len(w.hashes) >= n else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(count)), np.where(long, count - n + 1, 0))
    first = np.cumsum(np.where(long, count - n + 1, 0)) - np.where(long, count - n + 1, 0)
    h = h[np.arange(len(doc)) - first[doc] + w.first[doc]]
    for i in np.flatnonzero(~long & (count > 0)):  # fewer words: the whole sequence is one shingle
        doc = np.append(doc, i)
        h = np.append(h, runs(w.hashes[w.first[i] : w.first[i + 1]], int(count[i]), seed=int(count[i])))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[keep], h[keep]


def bands(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each size every band j with 1.5**j <= size < 2 * 1.5**j: index into size, j."""
    low = np.floor(np.log(np.maximum(size, 1)) / np.log(1.5)).astype(np.int64)
    out = []
    for step in (-2, -1, 0, 1):
        j = low + step
        on = np.flatnonzero((1.5 ** j.astype(float) <= size) & (size < 2 * 1.5 ** j.astype(float)))
        out.append((on, j[on]))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def signatures(doc: np.ndarray, h: np.ndarray, n_docs: int, similar: tuple[int, int], seed: int, only: int | None = None, slack: float = 0.18):
    """PartEnum signatures of sets: number of the set and 64-bit signature. similar: the least similarity as a fraction. only: those of the first ``only`` slices, a part of what finds all."""
    up, down = similar
    size = np.bincount(doc, minlength=n_docs)
    first = np.append(0, np.cumsum(size))
    some = np.flatnonzero(size)
    which, j = bands(size[some])
    which = some[which]
    most = np.ceil(2 * 1.5 ** j.astype(float)).astype(np.int64) - 1
    differ = (2 * most * (down - up)) // (down + up)
    slices = np.ceil((differ // 2 + 1) / (1 - slack)).astype(np.int64)
    kept = slices if only is None else np.minimum(slices, only)
    begin = np.append(0, np.cumsum(3 * kept))
    # rows of elements for every set and band
    n = size[which]
    row = np.repeat(np.arange(len(which)), n)
    el = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[which][row]
    x = mix(h + np.uint64((2 * seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))[el]
    part = (x >> np.uint64(32)).astype(np.int64) * (3 * slices)[row] >> 32
    if only is not None:
        on = np.flatnonzero(part < (3 * kept)[row])
        row, x, part = row[on], x[on], part[on]
    part += begin[row]
    total = np.zeros(int(begin[-1]), np.uint64)
    np.add.at(total, part, mix(x))
    has = np.bincount(part, minlength=int(begin[-1])) > 0
    total, has = total.reshape(-1, 3), has.reshape(-1, 3)
    of = np.repeat(np.arange(len(which)), kept)
    number = np.arange(len(of)) - np.repeat(np.cumsum(kept) - kept, kept)
    tag = mix((j[of] + 64).astype(np.uint64) * np.uint64(1 << 40) + number.astype(np.uint64) * np.uint64(4))
    sets, sigs = [], []
    for k, (p, q) in enumerate(((0, 1), (0, 2), (1, 2))):
        on = np.flatnonzero(has[:, p] | has[:, q])
        sets.append(which[of[on]])
        sigs.append(mix(tag[on] + np.uint64(k) + mix(total[on, p]) + total[on, q] * np.uint64(3)))
    if only is not None:
        return np.concatenate(sets), np.concatenate(sigs)
    # sets whose empty parts leave the count open send their elements too
    bad = np.bincount(of, weights=(has.sum(1) <= 1), minlength=len(which)).astype(np.int64)
    partner = np.minimum((size[which] * down) // up, most)
    spoilt = ((size[which] + partner) * (down - up) // (down + up)) // 2
    open_ = np.flatnonzero(bad >= slices - spoilt)
    mark = np.zeros(len(which), bool)
    mark[open_] = True
    on = np.flatnonzero(mark[row])
    sets.append(which[row[on]])
    sigs.append(mix(mix(h[el[on]]) + (j[row[on]] + 64).astype(np.uint64)))
    return np.concatenate(sets), np.concatenate(sigs)


def sketch(doc: np.ndarray, h: np.ndarray, n_docs: int, width: int = SKETCH_BITS) -> np.ndarray:
    """Parity of the number of elements in each of ``width`` places (a power of two), a row of bytes for each set. Places are hashes modulo width, so the two halves of a row add up to the row of half the width."""
    bit = (mix(h) >> np.uint64(24)).astype(np.int64) % width
    odd = np.bincount(doc * width + bit, minlength=n_docs * width).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n_docs, width), axis=1)


def set_keys(doc: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
    """64 bits for each set, equal for equal sets."""
    out = np.bincount(doc, minlength=n_docs).astype(np.uint64)
    np.add.at(out, doc, mix(h))
    return mix(out)


def hubs_of(sig: np.ndarray, d: np.ndarray, named: bool, cls: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hub and member of each group of ids that share a signature and are not all of one class, once each. cls: classes of the ids, each its own if not given. named: a group is called by its members instead."""
    cls = d if cls is None else cls
    order = np.lexsort((mix(d.view(np.uint64)), sig))
    sig, d, cls = sig[order], d[order], cls[order]
    keep = np.ones(len(sig), bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (d[1:] != d[:-1])
    sig, d, cls = sig[keep], d[keep], cls[keep]
    at = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
    n = np.diff(np.append(at, len(sig)))
    of = np.repeat(np.arange(len(at)), n)
    if named:
        name = np.zeros(len(at), np.uint64)
        np.add.at(name, of, mix(d.view(np.uint64) * np.uint64(3)))
        hub = mix(name).view(np.int64)
    else:
        hub = d[at]
    on = (np.minimum.reduceat(cls, at) != np.maximum.reduceat(cls, at))[of] if len(at) else np.zeros(0, bool)
    both = np.unique(np.stack([hub[of[on]], d[on]]), axis=1)
    return both[0], both[1]


def _arr(x: np.ndarray, kind=pa.int64()) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), kind)


def _blob(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    width = values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    offs = pa.array(np.append(0, ends) * width, pa.int64())
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, offs.buffers()[1], pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def levels(size: np.ndarray) -> np.ndarray:
    """How often SKETCH_BITS is doubled for a set's sketch: until it has a bit for each element."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(size, 1) / SKETCH_BITS))).astype(np.int64)


def sketches(doc: np.ndarray, h: np.ndarray, size: np.ndarray) -> list[bytes]:
    """A sketch for each set, as wide as its level says."""
    level, out = levels(size), [b""] * len(size)
    for k in np.unique(level).tolist():
        rows = np.flatnonzero(level == k)
        for some in np.split(rows, range(1_024 >> min(k, 10) or 1, len(rows), 1_024 >> min(k, 10) or 1)):
            to = np.full(len(size), -1)
            to[some] = np.arange(len(some))
            on = to[doc] >= 0
            for i, x in zip(some.tolist(), sketch(to[doc[on]], h[on], len(some), SKETCH_BITS << k)):
                out[i] = x.tobytes()
    return out


def halved(bits: np.ndarray) -> np.ndarray:
    """Sketches as they would be at half the width."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:]


def near_members(size: np.ndarray, raw: list[bytes], first: np.ndarray | None, similar: tuple[int, int], block: int = 256) -> np.ndarray:
    """Which sets have a partner that sizes and sketches leave open. raw: sketches. first: only partners on the other side of it count.

    Sizes of similar sets differ by less than a factor of two, so their levels by one at most; the wider sketch is halved then.
    """
    up, down = similar
    out, level = np.zeros(len(size), bool), levels(size)

    def look(rows: np.ndarray, bits: np.ndarray, own: int) -> None:
        """Pairs whose smaller set is one of the first ``own`` rows, which ascend by size."""
        n, side = size[rows], None if first is None else first[rows]
        for a in range(0, own, block):
            b = min(a + block, own)
            for c in range(a, len(rows), block):
                m, k = n[a:b, None], n[None, c : c + block]
                if down * m[-1, 0] < up * k[0, 0]:
                    break  # all further blocks are too large
                if out[rows[a:b]].all() and out[rows[c : c + block]].all():
                    continue
                ok = (down * m >= up * k) & (down * k >= up * m)
                if side is not None:
                    ok &= side[a:b, None] != side[None, c : c + block]
                if a == c:
                    np.fill_diagonal(ok, False)
                i, j = np.nonzero(ok)
                for at in range(0, len(i), 4_096):
                    x, y = i[at : at + 4_096] + a, j[at : at + 4_096] + c
                    differ = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
                    yes = (down + up) * differ <= (down - up) * (n[x] + n[y])
                    out[rows[x[yes]]] = True
                    out[rows[y[yes]]] = True

    order = np.argsort(size, kind="stable")
    for k in np.unique(level).tolist():
        rows = [order[level[order] == k], order[level[order] == k + 1]]
        bits = [np.frombuffer(b"".join(raw[i] for i in r), "<u8").reshape(len(r), -1) for r in rows if len(r)]
        if len(bits) > 1:
            bits[1] = halved(bits[1])
        look(np.concatenate(rows), np.concatenate(bits), len(rows[0]))
    return out


def links_of(sets: list[np.ndarray], first: np.ndarray | None, similar: tuple[int, int]) -> list[tuple[int, int]]:
    """Links that join the sets as all pairs of similar sets do, one fewer than the sets at most. first: only pairs of a set on each side of it."""
    up, down = similar
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.argsort(size, kind="stable")
    size = size[order]
    flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    stop = np.cumsum(size)
    start = stop - size
    bits = sketch(np.repeat(np.arange(len(size)), size), flat.astype(np.uint64), len(size)).view("<u8")
    side = None if first is None else first[order]
    cls, mark, out = np.arange(len(size)), np.zeros(int(flat.max()) + 1, bool), []
    for a in range(len(size)):
        most = int(np.searchsorted(size, down * size[a] // up, side="right"))
        on = cls[a + 1 : most] != cls[a]
        if side is not None:
            on &= side[a + 1 : most] != side[a]
        y = np.flatnonzero(on) + a + 1
        if not len(y):
            continue
        differ = np.bitwise_count(bits[y] ^ bits[a]).sum(1, dtype=np.int64)
        y = y[(down + up) * differ <= (down - up) * (size[y] + size[a])]
        mark[flat[start[a] : stop[a]]] = True
        for part in np.split(y, np.flatnonzero(np.diff(np.cumsum(size[y]) // 1_000_000)) + 1):
            part = part[cls[part] != cls[a]]
            if len(part):
                n = size[part]
                ends = np.cumsum(n)
                same = np.add.reduceat(mark[flat[np.repeat(start[part] - (ends - n), n) + np.arange(int(ends[-1]))]], ends - n, dtype=np.int64)
                yes = part[down * same >= up * (size[a] + n - same)]
                classes, lead = np.unique(cls[yes], return_index=True)
                out += [(int(order[a]), int(order[i])) for i in yes[lead]]
                if len(classes):
                    cls[np.isin(cls, classes)] = cls[a]
        mark[flat[start[a] : stop[a]]] = False
    return out


def _sent(ids: np.ndarray, s: np.ndarray, sig: np.ndarray, shards: int, cls: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each shard that signatures of sets go to. ids: of the sets; s: number of the set of each signature; cls: classes of the sets."""
    other = np.zeros_like(ids) if cls is None else ids ^ cls  # nought for most, so it packs well
    shard = (sig >> np.uint64(40)).astype(np.int64) % shards
    order = np.lexsort((ids[s], shard))
    s, sig, shard = s[order], sig[order], shard[order]
    at = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(s) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(s)) if len(s) else at
    head = np.ones(len(s), bool)
    head[1:] = (s[1:] != s[:-1]) | (shard[1:] != shard[:-1])
    first = np.flatnonzero(head)
    times = np.diff(np.append(first, len(s))).astype("<u4")
    who = np.searchsorted(first, ends)
    # 48 bits of a signature are left beside the shard's number
    low = (sig & np.uint64((1 << 48) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return pa.RecordBatch.from_arrays([_arr(shard[at]), _blob(low, ends), _blob(ids[s[first]].astype("<i8"), who), _blob(times, who), _blob(other[s[first]].astype("<i8"), who)], names=["shard", "sig", "ids", "times", "other"])


def _gathered(named: DataFrame, send, shards: int, divided: bool, distinct: bool = True) -> DataFrame:
    """g (the hub, or the group's number if groups are divided), v: what ``send`` sends, gathered. A row stands in several shards; distinct: once in all."""
    def close(rows):
        low = np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(-1, 6)
        sig = np.zeros((len(low), 8), np.uint8)
        sig[:, :6] = low
        times = np.frombuffer(b"".join(r[2] for r in rows), "<u4")
        ids, other = (np.repeat(np.frombuffer(b"".join(r[k] for r in rows), "<i8"), times) for k in (1, 3))
        g, v = hubs_of(sig.view("<u8").ravel(), ids, divided, ids ^ other)
        for lo in range(0, len(g), 100_000):
            yield pa.RecordBatch.from_arrays([_arr(g[lo : lo + 100_000]), _arr(v[lo : lo + 100_000])], names=["g", "v"])

    def gather(batches):
        """Rows arrive sorted by shard; one shard at a time is held."""
        now, rows = None, []
        for b in batches:
            for shard, *row in zip(*(c.to_pylist() for c in b.columns)):
                if shard != now and rows:
                    yield from close(rows)
                    rows = []
                now = shard
                rows.append(row)
        if rows:
            yield from close(rows)

    sent = named.mapInArrow(send, "shard long, sig binary, ids binary, times binary, other binary").repartition(shards, "shard").sortWithinPartitions("shard")
    got = sent.mapInArrow(gather, "g long, v long")
    return got.distinct() if distinct else got


def _quick_groups(nodes: DataFrame, shards: int) -> DataFrame:
    """nodes: key, quick (their first signatures). Rows: g (the hub), v, both keys of nodes."""
    def send(batches):
        for b in batches:
            lists = b.column(1)
            count = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            yield _sent(b.column(0).to_numpy(), np.repeat(np.arange(b.num_rows), count), lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), shards)

    return _gathered(nodes, send, shards, False)


def _groups(named: DataFrame, n: int, similar, seed: int, shards: int) -> DataFrame:
    """named: d, t, c (an id that stands for the class, null: d is alone), and p (array of group numbers) if groups are being divided. Rows: g (the hub, or the group's number if groups are divided), v."""
    divided = "p" in named.columns

    def send(batches):
        for b in few(batches, 500):
            ids = b.column(0).to_numpy()
            cls = pa.compute.coalesce(b.column(2), b.column(0)).to_numpy()
            doc, h = shingle_sets(b.column(1), n)
            if not divided:  # of equal sets in a batch one stands for all
                _, lead = np.unique(set_keys(doc, h, len(ids)), return_index=True)
                on = np.isin(doc, lead)
                doc, h = doc[on], h[on]
            s, sig = signatures(doc, h, len(ids), similar, seed)
            if divided:
                groups = b.column(3)
                count = pa.compute.list_value_length(groups).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = groups.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                start = np.cumsum(count) - count
                rep = np.repeat(np.arange(len(s)), count[s])
                k = np.arange(len(rep)) - np.repeat(np.cumsum(count[s]) - count[s], count[s]) + start[s[rep]]
                s, sig = s[rep], mix(sig[rep] + mix(flat[k]))
            yield _sent(ids, s, sig, shards, cls)

    return _gathered(named, send, shards, divided)


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 5, similar: tuple[int, int] = (75, 100),
                    block: int = 4_000, weight: int = 3_000_000, huge: int = 40_000, rounds: int = 2, quick: int = 2, shards: int | None = None) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links). shards: four times the session's shuffle partitions if not given."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    shards = shards or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("d"), F.col(text_col).alias("t"))

    def describe(batches):
        for b in few(batches):
            doc, h = shingle_sets(b.column(1), n)
            size = np.bincount(doc, minlength=b.num_rows)
            of_set, sig = signatures(doc, h, b.num_rows, similar, 0, only=quick)
            ends = np.append(0, np.cumsum(np.bincount(of_set, minlength=b.num_rows)))
            told = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _arr(sig[np.argsort(of_set, kind="stable")]))
            yield pa.RecordBatch.from_arrays([b.column(0), _arr(size), _arr(set_keys(doc, h, b.num_rows)), pa.array(sketches(doc, h, size), pa.binary()), told], names=["d", "s", "key", "sketch", "quick"])

    def whole(batches):
        for b in few(batches):
            doc, h = shingle_sets(b.column(1), n)
            yield pa.RecordBatch.from_arrays([_arr(set_keys(doc, h, b.num_rows)), _blob(h.astype("<u8"), np.cumsum(np.bincount(doc, minlength=b.num_rows)))], names=["key", "set"])

    def by_sketch(batches):
        def close(t, first):
            bits = t.column("sketch").to_pylist()
            yield pa.RecordBatch.from_arrays([c.combine_chunks() for c in t.select(["g", "key"]).filter(pa.array(near_members(t.column("s").to_numpy(), bits, first, similar))).columns], names=["g", "key"])

        return per_block(batches, close)

    def by_set(batches):
        def close(t, first):
            key = t.column("key").to_numpy()
            _, once = np.unique(key, return_index=True)  # rows that repeat id and text give their set twice
            sets = [np.frombuffer(x.as_buffer(), "<u8") for x in t.column("set").take(pa.array(once))]
            got = links_of(sets, None if first is None else first[once], similar)
            if got:
                x, y = key[once][np.array(got).T]
                yield pa.RecordBatch.from_arrays([_arr(x), _arr(y)], names=["x", "y"])

        return per_block(batches, close)

    about = saved(named.mapInArrow(describe, "d long, s long, key long, sketch binary, quick array<long>"), "sets")
    some = about.where("s > 0")
    node = saved(some.groupBy("key").agg(F.min("d").alias("rep"), F.first("s").alias("s"), F.first("sketch").alias("sketch"), F.first("quick").alias("quick")), "nodes")
    of = some.select(F.col("d").alias("v"), "key").distinct()

    def linked(members: DataFrame) -> DataFrame:
        """members: g, key. Links inside groups."""
        sized = dealt(members.join(node.select("key", "s", "sketch"), "key"), block, 40 * weight).select("g", "i", "j", "key", "s", "sketch", "first")
        near = saved(sized.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(by_sketch, "g long, key long").distinct(), "near")
        used = near.select("key").distinct().join(node.select("key", "rep"), "key").select(F.col("rep").alias("d")).distinct()
        sets = saved(named.join(used, "d", "left_semi").mapInArrow(whole, "key long, set binary"), "whole")
        both = dealt(near.join(node.select("key", "s"), "key"), block, weight).join(sets, "key").select("g", "i", "j", "key", "set", "first")
        out = saved(both.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(by_set, "x long, y long"), "links")
        drop(near, sets)
        return out

    # rows of one id are linked, whatever their texts
    own = some.groupBy("d").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x < y").select("d", "x")
    links = some.select("d", "key").join(own, "d").select("x", F.col("key").alias("y"))

    def within(groups: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """members: g, key; counts: g, n of the groups of several sets; groups of one have nothing to compare."""
        members = saved(groups, name)
        return members, saved(members.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "counts")

    members, counts = within(_quick_groups(node.select("key", "quick"), shards).withColumnRenamed("v", "key"), "first_members")
    links = links.unionByName(linked(members.join(counts.where(F.col("n") <= huge), "g").select("g", "key")))
    drop(members, counts)
    # each id that has a class with others, or no set of its own: one id that stands for the class, and whether another row gives all its sets
    sets_of = of.join(node.select("key", "rep"), "key").join(components(links).toDF("key", "component"), "key", "left")
    of_class = sets_of.where("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("c"))
    told = sets_of.join(of_class, "component", "left").groupBy(F.col("v").alias("d")).agg(F.min("c").alias("c"), F.bool_and(F.col("v") != F.col("rep")).alias("copy")).where("c IS NOT NULL OR copy")
    told = saved(told, "told")
    alone = named.where("t IS NOT NULL").join(told, "d", "left").where(~F.coalesce("copy", F.lit(False))).select("d", "t", "c")
    open_ = alone
    for r in range(rounds):
        groups = saved(_groups(open_, n, similar, r, shards), "groups")
        # copies of a set are one member
        members, counts = within(groups.join(of, "v").select("g", "key").distinct(), "members")
        drop(groups)
        last = r == rounds - 1
        links = links.unionByName(linked(members.join(counts if last else counts.where(F.col("n") <= huge), "g").select("g", "key")))
        divide = None if last else saved(members.join(counts.where(F.col("n") > huge), "g").join(node.select("key", "rep"), "key").groupBy(F.col("rep").alias("d")).agg(F.collect_set("g").alias("p")), "open")
        drop(members, counts)
        if divide is None or divide.isEmpty():
            break
        open_ = alone.join(divide, "d").select("d", "t", "c", "p")
    reached = components(links)
    least = reached.join(node.selectExpr("key AS v", "rep"), "v").groupBy("component").agg(F.min("rep").alias("least"))
    named_by = node.select(F.col("key").alias("v"), "rep").join(reached.join(least, "component").select("v", "least"), "v", "left").select(F.col("v").alias("key"), F.coalesce("least", "rep").alias("c"))
    out = about.select("d", "s", "key").join(named_by, "key", "left")
    return out.select(F.when(F.col("d") != NULL_ID, F.col("d")).cast(kind).alias(id_col), F.col("s").alias("n_shingles"), F.when(F.col("s") > 0, F.col("c")).otherwise(F.col("d")).alias("component_id"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))
