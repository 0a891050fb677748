"""Embedding near-dedup with randomised-rotation binary codes.

Each distinct vector of a label is made a unit vector o and coded once, in a
written table: the signs x of its coordinates after a random rotation, and the
correction factor f = <o, x / sqrt(d)>. For another unit vector q, rotated but
not made into signs, <x / sqrt(d), q> / f estimates the inner product <o, q>
without bias; its error is sqrt(1 - <o, q>^2) sqrt(1 - f^2) / f times one
coordinate of a random unit vector in d - 1 dimensions. So a pair at cosine
``least`` or above has an estimate below

    least - spread sqrt(1 - least^2) sqrt(1 - f^2) / (f sqrt(d - 1))

with a probability under ``error`` only (spread = sqrt(2 ln(2 / error))). Pairs
below that bound are dropped, all others are computed exactly in double
precision, and only exact values make links. Rotated coordinates are kept as 8
bits with a step, whose rounding is added to the bound in full.

Vectors meet in buckets: runs of ``band`` bits of further rotations' signs. Two
vectors at cosine 0.98 differ in 6 % of the bits, so with the bands used here a
pair at the threshold is missed with probability under 1e-6, less above it. A
pair counts in the first band where it meets, so it is counted once. Codes
without vectors go to the buckets first; vectors follow only where an estimate
stays above the bound. Large buckets are dealt out as pairs of blocks over many
tasks; none is cut. A task gives counts of links per vector and the links that
join its members, never all pairs.

Equal vectors are one node from the start and counted as links after. Vectors
that are null, zero, of another length than their partners, or hold null or
non-finite components, and null labels link with nothing. Repeated ids are
counted as separate vectors; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import dealt, per_block
from ._spark import drop, saved, ship, table
from .components import components


def rotations(dim: int, count: int, seed: int) -> np.ndarray:
    """count random orthogonal matrices, dim x dim each."""
    rng = np.random.default_rng([seed, dim])
    out = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.stack(out)


_TURNS: dict = {}


def turns_of(dim: int, count: int, seed: int) -> np.ndarray:
    key = (dim, count, seed)
    if key not in _TURNS:
        _TURNS[key] = rotations(*key)
    return _TURNS[key]


def units(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signs (n, dim) as booleans, factors, rotated coordinates in 8 bits and their step."""
    turned = unit @ turn
    step = np.abs(turned).max(1) / 127
    return turned > 0, np.abs(turned).sum(1) / np.sqrt(unit.shape[1]), np.rint(turned / step[:, None]).astype(np.int8), step


def estimates(signs: np.ndarray, factor: np.ndarray, coords: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Inner products of coded vectors (rows) with rotated ones (columns), without bias."""
    x = np.where(signs, np.float32(1), np.float32(-1)) @ coords.T.astype(np.float32)
    return x * step[None, :] / (np.sqrt(signs.shape[1]) * factor[:, None])


def bound(factor: np.ndarray, step: np.ndarray, dim: int, least: float, error: float) -> np.ndarray:
    """The estimate that a pair at ``least`` or above stays under with a probability of ``error`` at most: (coded, rotated)."""
    spread = np.sqrt(2 * np.log(2 / error))
    own = np.minimum(spread / np.sqrt(max(dim - 1, 1)), 1) * np.sqrt(1 - least**2) * np.sqrt(np.maximum(1 - factor**2, 0)) / factor
    return least - own[:, None] - np.sqrt(dim) * step[None, :] / (2 * factor[:, None]) - 1e-6


def bands_of(unit: np.ndarray, band: int, bands: int, seed: int) -> np.ndarray:
    """The bands of every vector, band bits each: (n, bands)."""
    dim = unit.shape[1]
    turned = np.einsum("nd,rde->nre", unit, turns_of(dim, -(-band * bands // dim), seed))
    bits = (turned > 0).reshape(len(unit), -1)[:, : band * bands].reshape(len(unit), bands, band)
    return (bits @ (1 << np.arange(band, dtype=np.int64))).astype("<u4")


def open_pairs(signs, factor, coords, step, bands: np.ndarray, k: int, kin: np.ndarray, first: np.ndarray | None, least: float, error: float, block: int = 1_024):
    """Pairs of a bucket of band k whose estimate is above the bound and that meet in no earlier band, block by block. kin: label and length; first: pairs of one side with the other only."""
    one = np.arange(len(factor)) if first is None else np.flatnonzero(first)
    two = one if first is None else np.flatnonzero(~first)
    for a in range(0, len(one), block):
        p = one[a : a + block]
        for c in range(a if first is None else 0, len(two), block):
            q = two[c : c + block]
            i, j = np.nonzero((estimates(signs[p], factor[p], coords[q], step[q]) >= bound(factor[p], step[q], signs.shape[1], least, error)) & (kin[p][:, None] == kin[q][None, :]))
            x, y = p[i], q[j]
            if first is None:
                x, y = x[x < y], y[x < y]
            if k:
                new = ~(bands[x, :k] == bands[y, :k]).any(1)
                x, y = x[new], y[new]
            if len(x):
                yield x, y


def spanning(p: np.ndarray, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same members as the links (p, q) do: each member with the smallest of its class."""
    to = np.arange(n)
    while True:
        low = np.minimum(to[p], to[q])
        new = to.copy()
        np.minimum.at(new, to[p], low)
        np.minimum.at(new, to[q], low)
        new = new[new]
        if (new == to).all():
            break
        to = new
    on = np.flatnonzero(to != np.arange(n))
    return on, to[on]


def _rows(column: pa.Array, kind) -> np.ndarray:
    """A binary column of equal lengths as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, least: float = 0.98,
                 band: int = 16, bands: int = 40, error: float = 1e-9, seed: int = 7, block: int = 4_000) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    ship(rows.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()
    named = rows.select(F.col(id_col).cast("long").alias("v"), F.col(vector_col).cast("array<double>").alias("e"), F.col(label_col).alias("l"))
    fine = F.col("l").isNotNull() & F.coalesce(F.size("e") > 0, F.lit(False)) & F.coalesce(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("e", lambda x: x != 0), F.lit(False))
    told = F.xxhash64(F.sha2(F.concat_ws(",", F.col("l").cast("string"), F.transform("e", lambda x: (x + F.lit(0.0)).cast("string"))), 256))
    keyed = named.withColumn("key", F.when(F.coalesce(fine, F.lit(False)), told))
    whole = saved(keyed.select("v", "key"), "vectors")

    def code(batches):
        for b in batches:
            lens = pa.compute.list_value_length(b.column(4)).to_numpy(zero_copy_only=False)
            for dim in np.unique(lens).tolist():
                some = b.take(pa.array(np.flatnonzero(lens == dim)))
                e = some.column(4).flatten().to_numpy().reshape(-1, dim)
                unit = units(e)
                signs, factor, coords, step = encode(unit, turns_of(dim, 1, seed + 1)[0])
                packed = np.packbits(signs, axis=1)
                raw = lambda m: pa.array([x.tobytes() for x in m], pa.binary())
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(4)), raw(e), raw(bands_of(unit, band, bands, seed)), raw(packed), pa.array(factor), raw(coords), pa.array(step)],
                                                 names=["key", "rep", "n", "kin", "e", "bands", "signs", "factor", "coords", "step"])

    def opened(t):
        dims = np.array([len(x) for x in t.column("coords").to_pylist()])
        bits = _rows(t.column("signs"), np.uint8)
        return dims, np.unpackbits(bits, axis=1)[:, : dims[0]].astype(bool), t.column("factor").to_numpy(), _rows(t.column("coords"), np.int8), t.column("step").to_numpy(), _rows(t.column("bands"), "<u4")

    def alike(t, first):
        """A bucket's rows by vector length; buckets are told by a hash, so lengths could in principle be mixed."""
        lens = pa.compute.binary_length(t.column("coords")).to_numpy()
        for dim in np.unique(lens).tolist():
            on = np.flatnonzero(lens == dim)
            yield t.take(pa.array(on)), None if first is None else first[on]

    def by_code(batches):
        def close(t, first):
            for some, side in alike(t, first):
                _, signs, factor, coords, step, near = opened(some)
                out = np.zeros(len(factor), bool)
                for x, y in open_pairs(signs, factor, coords, step, near, int(some.column("band")[0].as_py()), some.column("kin").to_numpy(), side, least, error):
                    out[x] = out[y] = True
                yield pa.RecordBatch.from_arrays([c.combine_chunks() for c in some.select(["g", "band", "key"]).filter(pa.array(out)).columns], names=["g", "band", "key"])

        return per_block(batches, close)

    def by_vector(batches):
        def close(t, first):
            for some, side in alike(t, first):
                _, signs, factor, coords, step, near = opened(some)
                key, n, unit = some.column("key").to_numpy(), some.column("n").to_numpy(), units(_rows(some.column("e"), "<f8"))
                count, xs, ys = np.zeros(len(key), np.int64), [], []
                for x, y in open_pairs(signs, factor, coords, step, near, int(some.column("band")[0].as_py()), some.column("kin").to_numpy(), side, least, error):
                    yes = np.concatenate([np.einsum("nd,nd->n", unit[x[i : i + 65_536]], unit[y[i : i + 65_536]]) >= least for i in range(0, len(x), 65_536)])
                    x, y = x[yes], y[yes]
                    count += np.bincount(x, weights=n[y], minlength=len(key)).astype(np.int64) + np.bincount(y, weights=n[x], minlength=len(key)).astype(np.int64)
                    x, y = spanning(x, y, len(key))
                    xs.append(x)
                    ys.append(y)
                on = np.flatnonzero(count)
                if len(on):
                    x, y = spanning(np.concatenate(xs), np.concatenate(ys), len(key))
                    yield pa.RecordBatch.from_arrays([pa.array(np.append(key[on], key[x])), pa.array(np.append(count[on], np.zeros(len(x), np.int64))), pa.concat_arrays([pa.nulls(len(on), pa.int64()), pa.array(key[y])])], names=["key", "links", "y"])

        return per_block(batches, close)

    import pyarrow.compute  # noqa: F401

    distinct = keyed.where("key IS NOT NULL").groupBy("key").agg(F.min("v").alias("rep"), F.count("*").alias("n"), F.first(F.xxhash64("l", F.size("e"), F.lit(5))).alias("kin"), F.first("e").alias("e"))
    coded = saved(distinct.mapInArrow(code, "key long, rep long, n long, kin long, e binary, bands binary, signs binary, factor double, coords binary, step double"), "coded")
    number = F.expr(f"transform(sequence(0, {bands - 1}), k -> struct(k AS band, xxhash64(kin, k, substring(bands, 4 * k + 1, 4)) AS g))")
    met = coded.select("key", "kin", F.explode(number).alias("at")).select("key", F.col("at.g").alias("g"), F.col("at.band").cast("long").alias("band"), F.lit(0).alias("s"))
    shared = saved(met, "met")
    several = shared.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    codes = dealt(shared.join(several, "g"), block, 1 << 60).join(coded.select("key", "kin", "bands", "signs", "factor", "coords", "step"), "key")
    columns = ["g", "i", "j", "key", "band", "kin", "bands", "signs", "factor", "coords", "step", "first"]
    near = saved(codes.select(columns).repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(by_code, "g long, band long, key long").distinct(), "near")
    drop(shared)
    vectors = dealt(near.withColumn("s", F.lit(0)), block, 1 << 60).join(coded.drop("rep"), "key")
    got = saved(vectors.select(*columns, "n", "e").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(by_vector, "key long, links long, y long"), "links")
    drop(near)
    count = got.where("y IS NULL").groupBy("key").agg(F.sum("links").alias("links"))
    reached = components(got.where("y IS NOT NULL").select(F.col("key").alias("x"), "y"))
    least_of = reached.join(coded.select(F.col("key").alias("v"), "rep"), "v").groupBy("component").agg(F.min("rep").alias("least"))
    told_by = (coded.select("key", "rep", "n").join(count, "key", "left").join(reached.join(least_of, "component").select(F.col("v").alias("key"), "least"), "key", "left")
               .select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("c")))
    out = whole.join(told_by, "key", "left")
    return out.select(F.col("v").cast(kind).alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("key").isNotNull(), F.col("c")).otherwise(F.col("v")).alias("component_id")).withColumn("kept", F.col(id_col) == F.col("component_id"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
