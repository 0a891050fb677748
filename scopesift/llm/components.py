"""Connected components by contraction, as DataFrame jobs.

In each round every node goes to the first of itself and its neighbours in an
order that is drawn anew for the round (a hash), edges follow, loops and
repeats go. On a chain about half of the nodes stay in a round, on denser
graphs fewer, in whatever order their ids stand; so rounds grow with the
logarithm of the longest chain. Each round is written in the shared folder and
replaces the one before; the moves of all rounds, which shrink alike, are
followed backward at the end. Nothing is collected. Null ends and loops are no edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import drop, saved


def components(edges: DataFrame) -> DataFrame:
    """edges: x long, y long. One row per node that has an edge: v, component (the smallest node it reaches)."""
    some = edges.where("x <> y")
    now, moves = saved(some.select("x", "y").union(some.select("y", "x")).toDF("x", "y").distinct(), "edges"), []
    while not now.isEmpty():
        place = lambda c: F.struct(F.xxhash64(c, F.lit(len(moves))).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        first = now.groupBy("x").agg(F.min(place("y")).alias("m"))
        moves.append(saved(first.select(F.col("x").alias("v"), F.least("m", place("x"))["v"].alias("to")), "moves"))
        to = moves[-1]
        moved = saved(now.join(to.toDF("x", "a"), "x").join(to.toDF("y", "b"), "y").where("a <> b").select(F.col("a").alias("x"), F.col("b").alias("y")).distinct(), "edges")
        drop(now)
        now = moved
    drop(now)
    if not moves:
        return edges.select(F.col("x").alias("v"), F.col("y").alias("component")).limit(0)
    while len(moves) > 1:
        last, to = moves.pop(), moves.pop()
        moves.append(saved(to.join(last.toDF("to", "then"), "to", "left").select("v", F.coalesce("then", "to").alias("to")), "moves"))
        drop(last, to)
    least = moves[0].groupBy("to").agg(F.min("v").alias("component"))
    out = saved(moves[0].join(least, "to").select("v", "component"), "components")
    drop(moves[0])
    return out
