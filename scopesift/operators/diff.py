"""Snapshot diff: what changed for each program since the last poll."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CORE = ["name", "platform", "url", "status", "paid", "currency", "min_reward", "max_reward", "safe_harbor", "disclosure_allowed", "launched_at", "resolved_reports", "invite_only", "kyc_required", "countries", "source_ids", "tags", "languages"]


def diff_targets(now: DataFrame, before: DataFrame) -> DataFrame:
    """Added and removed targets per program that stands in both snapshots' targets or in one. A key that stands in a snapshot several times counts once; a missing key is like no other.

    Rows are dealt out after the union: Spark would else take over how both sides are dealt out, and fail where it joins one side another way once it knows its size."""
    none = F.col("merge_key").isNull() | F.col("target_key").isNull()
    side = lambda df, a: df.select("merge_key", "target_key", F.lit(a).alias("a"), F.lit(not a).alias("b"), F.when(none, F.lit(a)).alias("alone"))
    each = side(now, True).unionByName(side(before, False)).repartition("merge_key", "target_key").groupBy("merge_key", "target_key", "alone").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    return each.groupBy("merge_key").agg(F.count_if(~F.col("b")).alias("added"), F.count_if(~F.col("a")).alias("removed"))


def count_changes(scope: DataFrame) -> DataFrame:
    """diff_targets of the merged targets of merge.scope, whose rows know whether the other snapshot has their key."""
    return scope.groupBy("merge_key").agg(F.count_if(F.col("top") & ~F.col("seen_before")).alias("added"), F.count_if(F.col("top_before") & ~F.col("seen")).alias("removed"))


def classify_change(programs: DataFrame, before: DataFrame, diff: DataFrame, baseline: bool = False, now: str | None = None) -> DataFrame:
    """program_id, merge_key, change_type, change_at, added, removed, is_new. Where nothing changed the previous change stays (change_type and change_at of before; a baseline where it has none).
    baseline: a first import, whose programs are no news. now: when changes of this run are; null without it."""
    for c, kind in (("change_type", "string"), ("change_at", "timestamp_ntz")):
        if c not in before.columns:
            before = before.withColumn(c, F.lit(None).cast(kind))
    at = F.lit(now).cast("timestamp_ntz")
    old = before.select("merge_key", *(F.col(c).alias(f"old_{c}") for c in CORE), F.col("change_type").alias("old_change"), F.col("change_at").alias("old_at"), F.lit(True).alias("old"))
    same = F.lit(True)
    for c in CORE:
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    zero = F.lit(0.0)
    kind = (F.when(F.col("old").isNull(), "baseline" if baseline else "new_program").when(F.col("added") > 0, "new_target")
            .when(F.coalesce("max_reward", zero) > F.coalesce("old_max_reward", zero), "reward_up")
            .when((F.col("old_status") != "open") & (F.col("status") == "open"), "reactivated")
            .when((F.col("removed") > 0) | ~same, "scope_updated"))
    df = programs.join(old, "merge_key", "left").join(diff, "merge_key", "left").withColumns({"added": F.coalesce("added", F.lit(0)), "removed": F.coalesce("removed", F.lit(0))})
    return df.select("program_id", "merge_key", F.coalesce(kind, "old_change", F.lit("baseline")).alias("change_type"), F.when(kind.isNull(), F.col("old_at")).otherwise(at).alias("change_at"), "added", "removed", F.coalesce(kind != "baseline", F.lit(False)).alias("is_new"))


def missing_grace(before: DataFrame, now: DataFrame) -> DataFrame:
    """Programs that went: kept once as stale with their count of misses, dropped at the second."""
    gone = before.join(now.select("merge_key"), "merge_key", "left_anti")
    return gone.withColumn("missing_count", F.coalesce("missing_count", F.lit(0)) + 1).where("missing_count < 2").select("program_id", F.lit("stale").alias("status"), F.col("missing_count").cast("long").alias("missing_count"))


def change_events(changes: DataFrame, now: str) -> DataFrame:
    """One event for each new change; changes that are carried over give none."""
    return changes.where("is_new").select(F.concat_ws(":", F.lit(now), "program_id", "change_type").alias("event_id"), "program_id", "change_type")
