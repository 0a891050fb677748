"""All pairs of a group's members, dealt over tasks: every two blocks of a group meet in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt(members: DataFrame, block: int, weight: int) -> DataFrame:
    """members: g, key, s (size of the set) and more. Each for every pair of blocks i <= j of its group that its own block is in (first: it is i). A block holds about ``block`` sets and ``weight`` elements."""
    n = members.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("s") / weight)).cast("int").alias("k"))
    own = members.join(n, "g").withColumn("own", F.expr("CAST(pmod(xxhash64(key, 17L), k) AS INT)"))
    met = own.withColumn("with", F.explode(F.expr("sequence(0, k - 1)")))
    return met.withColumn("i", F.least("own", "with")).withColumn("j", F.greatest("own", "with")).withColumn("first", F.col("own") == F.col("i")).drop("k", "own", "with")


def per_block(batches, close):
    """Rows sorted by g, i, j; one pair of blocks is held at a time and given to ``close`` as a table and its ``first`` (None inside one block)."""
    now, held = None, []

    def end():
        t = pa.Table.from_batches(held).combine_chunks()
        yield from close(t, None if now[1] == now[2] else t.column("first").to_numpy())

    for b in batches:
        key = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if hi > lo:
                if held and tuple(key[lo]) != now:
                    yield from end()
                    held = []
                now = tuple(key[lo])
                held.append(b.slice(lo, hi - lo))
    if held:
        yield from end()
