"""Polls as a stream: each landed snapshot is compared with the state of the run before.

A poll lands as two tables, ``programs/run_ts=...`` and ``targets/run_ts=...``; the folder of its programs is landed last.
State is three tables that are published together: programs, targets and the run's events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import diff, state
from ..sources.sinks import read_state, versions, write_state

SEEN = ["first_seen_at", "last_seen_at", "last_changed_at"]


def _set_of(targets: DataFrame) -> DataFrame:
    """merge_key and an order-free fingerprint of its set of target keys: their count and two sums of 64-bit hashes. Two sets differ unseen with a probability under 1e-30."""
    h = [F.sum(F.xxhash64("target_key", F.lit(i)).cast("decimal(20,0)")).cast("string") for i in (0, 1)]
    return targets.groupBy("merge_key").agg(F.concat_ws(":", F.count("*").cast("string"), *h).alias("target_set"))


def reconcile(programs: DataFrame, targets: DataFrame, before: DataFrame | None, before_targets: DataFrame | None, run_ts: str) -> dict[str, DataFrame]:
    """The new state as programs, targets and events. before: the programs of the state (None: a first import, whose programs are no news).

    programs: program_id, merge_key and the columns of diff.CORE; targets: merge_key, target_key, added_at and more. Only targets of
    programs whose set of keys differs are compared one by one. Programs that went are kept for one run as stale, with their targets.
    """
    now = F.lit(run_ts).cast("timestamp_ntz")
    baseline = before is None
    sets = programs.join(_set_of(targets), "merge_key", "left")
    if baseline:
        spark = programs.sparkSession
        kinds = {"change_type": "string", "change_at": "timestamp_ntz", "missing_count": "long"} | dict.fromkeys(SEEN, "timestamp_ntz")
        before = sets.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()}).limit(0)
        before_targets = targets.withColumn("first_seen_at", F.lit(None).cast("timestamp_ntz")).limit(0)
        differ = spark.createDataFrame([], "merge_key string")
    else:
        differ = sets.select("merge_key", "target_set").join(before.select("merge_key", F.col("target_set").alias("old_set")), "merge_key").where("NOT target_set <=> old_set").select("merge_key")
    some = lambda t: t.join(differ, "merge_key", "left_semi").select("merge_key", "target_key")
    changes = diff.classify_change(programs, before, diff.diff_targets(some(targets), some(before_targets)), baseline, run_ts)
    lives = state.program_lifecycle(changes, before.select("merge_key", *SEEN), run_ts)
    here = sets.join(changes.select("merge_key", "change_type", "change_at"), "merge_key").join(lives, "program_id")
    gone = before.join(programs.select("merge_key"), "merge_key", "left_anti").withColumns({"missing_count": F.coalesce("missing_count", F.lit(0)) + 1, "status": F.lit("stale")}).where("missing_count < 2")
    rest = [c for c in targets.columns if c not in ("merge_key", "target_key", "first_seen_at")]
    seen = state.target_lifecycle(targets, before_targets, run_ts, baseline, also=rest)
    kept = before_targets.join(gone.select("merge_key"), "merge_key", "left_semi")
    columns = here.columns
    return {"programs": here.unionByName(gone.select(columns)), "targets": seen.unionByName(kept.select(seen.columns)),
            "events": diff.change_events(changes, run_ts).withColumn("happened_at", now)}


def incremental_reconcile(spark: SparkSession, landed: str, to: str, checkpoint: str, programs: StructType, targets: StructType) -> None:
    """Takes in all polls that have landed and ends. programs, targets: the schemas of the landed tables.

    Runs are taken in order, each on the state of the run before it. A run that is repeated after a failure publishes its state
    anew; until then readers see the version before, whole.
    """
    def take(batch: DataFrame, _: int) -> None:
        own = batch.sparkSession
        for run in sorted(r.run_ts for r in batch.select("run_ts").distinct().collect()):
            old = [v for v in versions(own, to) if v < run]
            before = [read_state(own, to, n, old[-1]) if old else None for n in ("programs", "targets")]
            landed_targets = own.read.schema(targets).parquet(f"{landed}/targets/run_ts={run}")
            write_state(reconcile(batch.where(F.col("run_ts") == run).drop("run_ts"), landed_targets, *before, run), to, run)

    stream = spark.readStream.schema(StructType([*programs.fields]).add("run_ts", "string")).option("basePath", f"{landed}/programs").parquet(f"{landed}/programs/run_ts=*")
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
