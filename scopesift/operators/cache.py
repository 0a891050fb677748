"""Caches of policy and live evidence, audit memory and checks of traps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import fold_words, yes
from .evidence import policy_useful
from .value import HOSTED


def _at(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def _fresh(now: str, hours: int) -> Column:
    return yes((F.col("status") == "ok") & (F.col("fetched_at") > _at(now) - F.make_dt_interval(hours=F.lit(hours))))


def policy_refresh(programs: DataFrame, cache: DataFrame, now: str, budget: int = 80, ttl_hours: int = 168) -> DataFrame:
    """What to do with each program's policy, and whether its own text is read anew (``reread``: the text's hash differs from the cached one).

    ``inline``: the text that is read anew yields something; that will do. ``keep``: a good row is fresh. Of all others, those whose text yields
    nothing included, ``fetch`` goes to ``budget`` ones and ``wait`` to the rest: rows that were fresh before their text changed come last, then by
    priority of the change. programs: program_id, change_type, policy_text; cache: program_id, status, fetched_at, inline_hash.

    Texts are taken apart only where their hash differs, so an unchanged corpus costs a join of hashes.
    """
    text = F.trim(F.coalesce("policy_text", F.lit("")))
    df = programs.join(cache, "program_id", "left").withColumns({"fresh": _fresh(now, ttl_hours), "new_hash": F.when(text != "", F.sha2(text, 256)), "own": text})
    df = df.withColumn("reread", F.col("new_hash").isNotNull() & ~F.col("new_hash").eqNullSafe(F.col("inline_hash")))
    useful = policy_useful(df.where("reread").select(F.col("program_id").alias("page_id"), F.col("program_id").alias("url"), F.col("own").alias("text"))).withColumnRenamed("url", "program_id")
    rank = F.when(F.col("change_type") == "new_target", 3).when(F.col("change_type") == "new_program", 2).when(F.col("change_type") == "scope_updated", 1).otherwise(0)
    df = df.select("program_id", "fresh", "reread", rank.alias("rank")).join(useful, "program_id", "left")
    df = df.withColumn("action", F.when(F.col("reread") & F.col("useful"), "inline").when(~F.col("reread") & F.col("fresh"), "keep"))
    due = df.where("action IS NULL").orderBy("fresh", F.desc("rank"), "program_id").limit(budget).select("program_id", F.lit("fetch").alias("due"))
    return df.join(due, "program_id", "left").select("program_id", "reread", F.coalesce("action", "due", F.lit("wait")).alias("action"))


def upsert(cache: DataFrame, results: DataFrame, key: str, now: str) -> DataFrame:
    """A cache after a run. results: key, status (ok, partial or failed), error and the values of a good row; cache: key, status, fetched_at, last_error and the same values.

    Good and partial results replace the row; a failed one leaves a good row as it is but for its error, and any other row pending.
    """
    values = [c for c in cache.columns if c not in (key, "status", "fetched_at", "last_error")]
    old = cache.select(key, *(F.col(c).alias(f"old_{c}") for c in ("status", "fetched_at", "last_error", *values)))
    df = old.join(results, key, "full")
    new, tried = yes(F.col("status").isin("ok", "partial")), F.col("status").isNotNull()
    good = yes(F.col("old_status") == "ok")
    keep = ~tried | good
    return df.select(key, F.when(new, F.col("status")).when(keep, F.col("old_status")).otherwise("pending").alias("status"),
                     F.when(new, _at(now)).when(keep, F.col("old_fetched_at")).alias("fetched_at"),
                     F.when(new, None).when(tried, F.substring(F.coalesce("error", F.lit("failed")), 1, 180)).otherwise(F.col("old_last_error")).alias("last_error"),
                     *(F.when(new, F.col(c)).when(keep, F.col(f"old_{c}")).alias(c) for c in values))


def upsert_stats(cache: DataFrame, results: DataFrame) -> DataFrame:
    """One row: attempted, updated, failed and pending."""
    pending = cache.agg(F.count_if(F.col("status") != "ok").alias("n")).scalar()
    return results.agg(F.count("*").alias("attempted"), F.count_if(F.col("status").isin("ok", "partial")).alias("updated"), F.count_if(F.col("status") == "failed").alias("failed"), F.first(pending).cast("long").alias("pending"))


def live_results(codes: DataFrame, activity: DataFrame, cache: DataFrame, now: str, ttl_hours: int = 6) -> DataFrame:
    """Results of the addresses that are due (no row, or one of ttl_hours and older). codes: address, code (null: the call failed). deployed: there is code."""
    due = codes.join(cache.select("address", "fetched_at"), "address", "left").where(F.col("fetched_at").isNull() | (F.col("fetched_at") <= _at(now) - F.make_dt_interval(hours=F.lit(ttl_hours))))
    df = due.select("address", "code").join(activity, "address", "left")
    known = F.col("code").isNotNull()
    return df.select("address", F.when(known, "ok").otherwise("failed").alias("status"), F.when(~known, "no answer").alias("error"), F.when(known, ~F.col("code").isin("0x", "0x0")).alias("deployed"), F.coalesce("tx_30d", F.lit(0)).alias("tx_30d"))


def _aliases(audited: DataFrame) -> DataFrame:
    return audited.select("no", F.explode(F.concat(F.array("key"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias")).select("no", fold_words(F.col("alias")).alias("alias")).where("alias <> ''").distinct()


def audited_programs(programs: DataFrame, audited: DataFrame) -> DataFrame:
    """program_id, a: the first audit entry that names the program (program_id, name); others go."""
    told = F.transform(F.array(F.regexp_replace("program_id", "^program:", ""), F.col("name")), fold_words)
    prefixes = F.flatten(F.transform(told, lambda v: F.transform(F.sequence(F.lit(1), F.size(F.split(v, " "))), lambda n: F.array_join(F.slice(F.split(v, " "), 1, n), " "))))
    each = programs.select("program_id", "name").distinct().select("program_id", F.explode(F.array_distinct(prefixes)).alias("alias"))
    return each.join(_aliases(audited), "alias").groupBy("program_id").agg(F.min("no").alias("a"))


def audited_sites(sites: DataFrame, audited: DataFrame, gram: int = 5) -> DataFrame:
    """value, repo_key, b: the first audit entry whose alias stands in a hosted target's value or repository; others go."""
    names = _aliases(audited)
    hosted = F.col("repo_key").isNotNull() | F.coalesce("value", F.lit("")).rlike(HOSTED)
    repos = sites.where(hosted).select("value", "repo_key").distinct().select("value", "repo_key", fold_words(F.coalesce("value", F.lit(""))).alias("v"), fold_words(F.coalesce("repo_key", F.lit(""))).alias("r"))
    # aliases shorter than a gram are looked for by grams of their own length
    sizes = sorted(r.n for r in names.select(F.least(F.length("alias"), F.lit(gram)).alias("n")).distinct().collect())
    grams = F.flatten(F.array(*(F.expr(f"if(length({x}) >= {n}, transform(sequence(1, length({x}) - {n - 1}), i -> substring({x}, i, {n})), array())") for x in ("v", "r") for n in sizes or [gram])))
    near = repos.withColumn("start", F.explode(F.array_distinct(grams))).join(names.withColumn("start", F.substring("alias", 1, gram)), "start")
    return near.where(F.contains("v", F.col("alias")) | F.contains("r", F.col("alias"))).groupBy("value", "repo_key").agg(F.min("no").alias("b"))


def audit_named(df: DataFrame, audited: DataFrame) -> DataFrame:
    """df with a and b of the two above: the first of both with its key, verdict and index."""
    first = audited.select(F.col("no").alias("audit_no"), F.col("key").alias("audit_key"), "verdict", "fresh_at_audit")
    return df.withColumn("audit_no", F.least("a", "b")).drop("a", "b").join(F.broadcast(first), "audit_no", "left")


def audit_match(targets: DataFrame, audited: DataFrame, gram: int = 5, programs: DataFrame | None = None, sites: DataFrame | None = None) -> DataFrame:
    """targets (program_id, name, target_key, value, repo_key) with audit_no, audit_key, verdict and fresh_at_audit of the first audit entry that names the program or its repository.

    audited: no, key, aliases (array), verdict, fresh_at_audit. An alias names a program whose id or name it equals or begins, at a word's end: an equi-join on
    word prefixes. It names a repository that contains it: an equi-join of the alias's first ``gram`` letters with those that stand anywhere in the distinct
    repositories, then a look at the whole. Both lists may grow; no pair is tried that shares no letters.

    Names are looked for in the programs (program_id, name) and sites (value, repo_key) of the targets. Where targets come from a long plan, give both, or that
    plan is run for each. What is joined to programs and sites before their targets are goes by ``audited_programs`` and ``audited_sites``.
    """
    by_program = audited_programs(targets if programs is None else programs, audited)
    by_repo = audited_sites(targets if sites is None else sites, audited, gram)
    df = targets.join(by_program, "program_id", "left").join(by_repo.withColumnsRenamed({"value": "v_", "repo_key": "r_"}), F.col("value").eqNullSafe(F.col("v_")) & F.col("repo_key").eqNullSafe(F.col("r_")), "left").drop("v_", "r_")
    return audit_named(df, audited)


def audit_excluded(matched: DataFrame, jump: float = 40.0) -> DataFrame:
    """Adds audit_reason: audited targets stay out unless their code has become fresher by more than ``jump`` since. matched: of audit_match, with fresh_code_index."""
    still = F.col("audit_no").isNotNull() & (F.col("fresh_code_index") - F.coalesce("fresh_at_audit", F.lit(0.0)) <= jump)
    return matched.withColumn("audit_reason", F.when(still, F.concat(F.lit("audited "), "verdict", F.lit(" target: "), "audit_key")))


def trap_assertions(evaluated: DataFrame, sentinel: str) -> DataFrame:
    """One row: whether the sentinel repository, where there is one, is known to be marked, and every managed parser above a low floor carries its ceiling."""
    own = F.lower("repo_key") == sentinel.lower()
    dos = (F.col("findable_class") == "managed-parser-dos") & F.col("floor").isin("MEDIUM", "HIGH", "CRITICAL")
    df = evaluated.agg(F.count_if(own).alias("sentinels"), F.count_if(own & (F.col("repo_status") == "ok") & F.array_contains("trap_tags", "DEV_KNOWN")).alias("marked"), F.count_if(dos).alias("managed"), F.count_if(dos & ~F.array_contains("trap_tags", "DOS_CEILING")).alias("unmarked"))
    return df.select("sentinels", "managed", ((F.col("sentinels") == 0) | (F.col("marked") > 0)).alias("sentinel_ok"), (F.col("unmarked") == 0).alias("ceiling_ok")).withColumn("ready", F.col("sentinel_ok") & F.col("ceiling_ok"))
