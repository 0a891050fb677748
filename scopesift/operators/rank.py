"""Roll-up of targets to programs, ranking and the query surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .value import LIVE

FIELDS = ["workflow", "findable_class", "ceiling", "floor", "hardening_index", "fresh_code_index", "known_issue_risk", "p_findable", "p_payable", "p_first", "effective_reward", "ev_score", "exclude_reason", "reason"]


def best_target(evaluated: DataFrame) -> DataFrame:
    """One row per program: its best target that is not excluded, else its first; with the number of its targets.

    A window limited to its first row: each task keeps one row per program before the shuffle, so a program with very many targets
    sends one row a task. They are counted by hash from the ids alone.
    """
    w = Window.partitionBy("program_id").orderBy(F.col("exclude_reason").isNotNull(), F.desc("ev_score"), F.desc("p_findable"), "target_key")
    best = evaluated.select("program_id", "target_key", "name", "platform", "url", "max_reward", "resolved_reports", *FIELDS).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    return evaluated.groupBy("program_id").agg(F.count("*").alias("targets")).join(best, "program_id")


def program_traps(evaluated: DataFrame) -> DataFrame:
    return evaluated.select("program_id", F.explode_outer("trap_tags").alias("t")).groupBy("program_id").agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("traps"))


def rank_programs(programs: DataFrame) -> DataFrame:
    return programs.orderBy(F.col("exclude_reason").isNotNull(), F.desc("ev_score"), F.desc("p_findable"), F.collate("name", "UNICODE"), "program_id")


def lane_filter(programs: DataFrame, lane: str = "default") -> DataFrame:
    df = programs.where("exclude_reason IS NULL AND ev_score > 0")
    if lane == "live":
        return df.where(F.col("workflow").isin(LIVE))
    if lane == "fresh-source":
        return df.where("fresh_code_index > 50 AND workflow = 'static-source'")
    return df.where("workflow <> 'static-source-hardened'")


def shortlist(programs: DataFrame, lane: str = "default", limit: int = 25) -> DataFrame:
    return lane_filter(programs, lane).orderBy(F.desc("ev_score"), F.collate("name", "UNICODE"), "program_id").limit(max(1, min(500, limit)))


def facet_platforms(programs: DataFrame) -> DataFrame:
    return programs.select("platform").distinct().orderBy("platform")


def ev_tier(programs: DataFrame) -> DataFrame:
    tier = F.when(F.col("ev_score") >= 5000, "High").when(F.col("ev_score") >= 1500, "Strong").when(F.col("ev_score") >= 500, "Plausible").otherwise("Thin")
    return programs.groupBy(tier.alias("tier")).agg(F.count("*").alias("programs"))


def summary_metrics(programs: DataFrame, evaluated: DataFrame) -> DataFrame:
    open_ = F.col("exclude_reason").isNull()
    a = programs.agg(F.count_if(open_ & F.col("workflow").isin(LIVE)).alias("live"), F.count_if(open_ & (F.col("workflow") == "static-source") & (F.col("fresh_code_index") > 50)).alias("fresh_source"))
    return a.crossJoin(evaluated.where("repo_status = 'ok'").agg(F.count_distinct("repo_key").alias("enriched_repos")))


def run_meta(programs: DataFrame, events: DataFrame, health: DataFrame, coverage: DataFrame, checks: DataFrame) -> DataFrame:
    """One row about a run: counts of programs (ranked: neither excluded nor worth nothing), events and sources, the coverage gate and the checks of traps.

    programs: of best_target; events: of change_events; health: of src_health; coverage: of coverage_gate; checks: of trap_assertions. Each is reduced to one row where it is.
    """
    out = F.col("exclude_reason").isNotNull()
    df = programs.agg(F.count("*").alias("programs"), F.coalesce(F.sum("targets"), F.lit(0)).alias("targets"), F.count_if(~out & (F.col("ev_score") > 0)).alias("ranked"), F.count_if(out).alias("excluded"))
    one = {"events": events.agg(F.count("*")), "sources": health.agg(F.count("*")), "healthy_sources": health.agg(F.count_if(F.col("status") == "ok")),
           **{f"coverage_{c}": coverage.select(c) for c in ("n", "measured", "required", "ready")}, "coverage_ratio": coverage.select(F.round("ratio", 3)),
           **{f"checks_{c}": checks.select(c) for c in ("sentinels", "managed", "sentinel_ok", "ceiling_ok", "ready")}}
    return df.select("*", *(q.scalar().alias(name) for name, q in one.items()))
