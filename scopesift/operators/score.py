"""The first attention score of a program, from what changed, rewards, and how much of it can be inspected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import texts, yes

# Freshness by change, reward points by ceiling, and the tags that lower friction.
CHANGE_BASE = {"new_target": 32, "new_program": 27, "reward_up": 24, "reactivated": 22, "scope_updated": 18}
REWARD_STEPS = [(100_000, 22), (50_000, 20), (25_000, 18), (10_000, 15), (5_000, 12), (1_000, 8)]
PLAIN_TAGS = ["source-code", "api", "smart-contract", "firmware", "hardware"]


def _steps(value: Column, steps, other: int) -> Column:
    out = F.lit(other)
    for least, points in reversed(steps):
        out = F.when(value >= least, points).otherwise(out)
    return out


def score_programs(programs: DataFrame, now: str) -> DataFrame:
    """Adds freshness, reward, inspectability, authorization, friction, their sum, up to five reasons and the attention pressure.

    programs: change_type, change_label, change_at, min_reward, max_reward, source_code, repository_count, tags, local_testing_hint, languages, paid, status, safe_harbor, disclosure_allowed, target_count.
    """
    base = F.lit(5)
    for name, points in CHANGE_BASE.items():
        base = F.when(F.col("change_type") == name, points).otherwise(base)
    age = F.greatest(F.lit(0), F.floor((F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis(F.col("change_at").cast("timestamp"))) / F.lit(86400000.0)))
    ceiling, low, n = F.coalesce("max_reward", F.lit(0.0)), F.coalesce("min_reward", F.lit(0.0)), F.col("target_count")
    step = _steps(ceiling, REWARD_STEPS, 0)
    step = F.when((step == 0) & (ceiling > 0), 4).otherwise(step)
    point = lambda c, k: F.when(yes(c), k).otherwise(0)
    tagged = lambda t: F.array_contains("tags", t)
    some = F.col("change_type") != "baseline"
    df = programs.withColumns({
        "freshness": F.greatest(F.lit(2), base - 3 * F.coalesce(age, F.lit(0))).cast("long"),
        "reward": F.when(low >= 1000, F.least(F.lit(22), step + 2)).otherwise(step).cast("long"),
        "inspectability": F.least(F.lit(24), point(F.col("source_code"), 14) + F.least(F.lit(6), F.coalesce("repository_count", F.lit(0)) * 2) + F.when(tagged("smart-contract"), 5).when(tagged("api"), 4).otherwise(0)
                                  + point(F.col("local_testing_hint"), 3) + point(F.size("languages") > 0, 2)).cast("long"),
        "authorization": (point(F.col("paid"), 6) + point(F.col("status") == "open", 4) + point(F.col("safe_harbor"), 3) + point(F.col("disclosure_allowed"), 1)).cast("long"),
        "friction": F.least(F.lit(8), F.when(n <= 3, 5).when(n <= 10, 3).when(n <= 25, 1).otherwise(0) + point(F.col("max_reward").isNotNull(), 1) + point(F.arrays_overlap("tags", F.array(*map(F.lit, PLAIN_TAGS))), 2)).cast("long")})
    said = texts((some, F.col("change_label")), (F.col("source_code"), F.lit("Inspectable source-code scope")), (~yes(F.col("source_code")) & tagged("api"), F.lit("Structured API surface")),
                 (F.col("local_testing_hint"), F.lit("Local, sandbox, or testnet testing language detected")), (ceiling >= 1000, F.lit("Confirmed reward ceiling clears $1,000")),
                 (n <= 5, F.concat(F.lit("Small scope with "), n.cast("string"), F.lit(" tracked target"), F.when(n == 1, "").otherwise("s"))), (F.col("safe_harbor"), F.lit("Safe-harbor field is present, verify the official wording")))
    return df.withColumns({"score": F.col("freshness") + F.col("reward") + F.col("inspectability") + F.col("authorization") + F.col("friction"),
                           "reasons": F.when(F.size(said) == 0, F.array(F.lit("Paid public program with structured scope data"))).otherwise(F.slice(said, 1, 5)),
                           "attention_pressure": F.when((F.col("freshness") >= 26) & (F.col("inspectability") >= 16) & (n <= 10), "lower").when(F.col("freshness") >= 18, "medium").otherwise("unknown")})


def rank_v1(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc("score"), F.collate("name", "UNICODE"), "program_id")
