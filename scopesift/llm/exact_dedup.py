"""Exact dedup by distributed MSD radix partitioning.

Documents are split by successive bytes, most significant first, until a group
is one document or its texts have ended. A digit is a run of bytes, 64 at first
and wider at each level, so that long copies take few levels. Two texts are
equal because every byte of both was a digit of the same groups: no digest is
compared.

One level: count the digits of each open group with partial aggregation, keep
those that repeat, join them to the rows. A digit that stands once makes its
document a group of one, a digit with which its texts end makes a class; the
rest of the rows is open and goes to the next level with what is left of its
text. Digits of very many rows are few, since each takes up a set share of the
rows: at most ``hot_bytes`` of them are broadcast, and their rows, copies or
not, never move. All other digits have a small share of the rows at most.

Null counts as empty text. Ties: rows are documents by their id, so rows that
repeat the id that stays stay all; a null id is less than any other and stays
only where all ids of its class are null. Very long texts take a level for each
eightfold length. An empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import drop, saved, table

_KEY = ["g", "digit", "ended"]


def _level(rows: DataFrame, width: int, hot_bytes: int, least: int) -> DataFrame:
    """rows: i, g (open group), rest, sha. Adds n and keep, null for a group of one; rest is null where the document is done, else what is left, and g its new group."""
    digits = rows.withColumn("digit", F.substring("rest", 1, width)).withColumn("ended", F.length("rest") <= width)
    seen = digits.groupBy(*_KEY).agg(F.count("*").alias("n"), F.max("i").alias("keep"))
    # as written, so that the number of a new group is fixed
    again = saved(seen.where("n > 1").withColumn("next", F.monotonically_increasing_id()), "digits")
    # so many digits at most can have more than this share of the rows
    share = max(hot_bytes // (width + 64), 1)
    bound = max(rows.count() // share, least)
    # the others are joined by a shuffle at every size
    hot, cold = again.where(F.col("n") > bound), again.where(F.col("n") <= bound).hint("merge")
    if hot.isEmpty():
        joined = digits.join(cold, _KEY, "left")
    else:
        few = F.broadcast(hot)
        joined = digits.join(few, _KEY).unionByName(digits.join(few.select(*_KEY), _KEY, "left_anti").join(cold, _KEY, "left"))
    done = F.col("n").isNull() | F.col("ended")
    out = saved(joined.select("i", "sha", "n", "keep", F.col("next").alias("g"), F.when(~done, F.expr(f"substring(rest, {width + 1})")).alias("rest")), "level")
    drop(again)
    return out


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 64, grow: int = 8, hot_bytes: int = 8 << 20, least: int = 200) -> DataFrame:
    """One row per row of docs: id, keep_id (the greatest id of equal texts), group_size, kept, text_sha256.

    width: bytes of the first digit; each level's is ``grow`` times as wide. hot_bytes: most that a level broadcasts. least: a digit of fewer rows is never broadcast.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("i"), F.lit(0).cast("long").alias("g"), text.alias("rest"), F.sha2(text, 256).alias("sha"))
    levels: list[DataFrame] = []
    while not levels or not rows.isEmpty():
        levels.append(_level(rows, width, hot_bytes, least))
        rows = levels[-1].where("rest IS NOT NULL").select("i", "g", "rest", "sha")
        width *= grow
    done = reduce(DataFrame.unionByName, (x.where("rest IS NULL").drop("rest", "g") for x in levels))
    keep = F.when(F.col("n").isNull(), F.col("i")).otherwise(F.col("keep"))
    return done.select(F.col("i").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                       F.col("i").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_classes(table(spark, sf_dir, "documents"))
