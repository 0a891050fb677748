"""State between polls: sources, life cycles, event log, schedules, gates and what is published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .diff import CORE
from .evidence import repo_resolve as resolved
from .evidence import scannable
from .value import HOSTED, LIVE


def src_health(records: DataFrame, sources: DataFrame, least: int = 1) -> DataFrame:
    """One row per source, also for those without records."""
    n = records.groupBy("source_id").agg(F.count("*").alias("n"))
    df = sources.join(n, "source_id", "left").withColumn("records", F.coalesce("n", F.lit(0)).cast("long"))
    return df.select("source_id", "records", F.when(F.col("records") >= least, "ok").otherwise("failed").alias("status"))


def src_snapshot_fallback(now: DataFrame, before: DataFrame, least: int) -> DataFrame:
    """Records of the sources with enough of them; every other source keeps its previous snapshot."""
    good = now.groupBy("source_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("source_id")
    return now.join(good, "source_id", "left_semi").unionByName(before.join(good, "source_id", "left_anti"))


def diff_fingerprint(programs: DataFrame, before: DataFrame, diff: DataFrame) -> DataFrame:
    """program_id, changed: a core field or the set of targets differs; programs of both snapshots."""
    old = before.select("merge_key", *(F.col(c).alias(f"old_{c}") for c in CORE))
    differs = F.coalesce(F.col("added") + F.col("removed"), F.lit(0)) > 0
    for c in CORE:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return programs.join(old, "merge_key").join(diff, "merge_key", "left").select("program_id", differs.alias("changed"))


def dataset_changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """One row: whether the rows differ as a multiset. Each side is reduced to a count and a sum of hashes, in any order."""
    def told(df: DataFrame, side: int) -> DataFrame:
        return df.select(F.lit(side).alias("side"), F.xxhash64(*df.columns).cast("decimal(20,0)").alias("h"))

    sign = F.when(F.col("side") == 0, 1).otherwise(-1)
    sums = told(now, 0).unionAll(told(before, 1)).agg(F.sum(sign).alias("n"), F.sum(F.col("h") * sign).alias("h"))
    return sums.select((F.coalesce("n", F.lit(0)) != 0).__or__(F.coalesce("h", F.lit(0)) != 0).alias("changed"))


def _at(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def program_lifecycle(changes: DataFrame, previous: DataFrame, now: str) -> DataFrame:
    """First seen stays; last seen and last changed move where the run has a new change or the program is new, not where an old change is carried over.
    previous: merge_key, first_seen_at, last_seen_at, last_changed_at."""
    df = changes.join(previous.withColumn("known", F.lit(True)), "merge_key", "left")
    moved = F.col("is_new") | F.col("known").isNull()
    return df.select("program_id", F.coalesce("first_seen_at", _at(now)).alias("first_seen_at"), *(F.when(moved, _at(now)).otherwise(F.coalesce(c, _at(now)) if c == "last_seen_at" else F.col(c)).alias(c) for c in ("last_seen_at", "last_changed_at")),
                     F.lit(0).cast("long").alias("missing_count"))


def target_lifecycle(targets: DataFrame, previous: DataFrame, now: str, baseline: bool = False, also: list[str] | None = None) -> DataFrame:
    """first_seen_at: as before, else the day it was added, else now, or null in a first import. also: columns of the targets that stay."""
    df = targets.join(previous.select("merge_key", "target_key", "first_seen_at"), ["merge_key", "target_key"], "left")
    return df.select("merge_key", "target_key", *(also or []), F.coalesce("first_seen_at", "added_at", F.lit(None) if baseline else _at(now)).cast("timestamp_ntz").alias("first_seen_at"))


def event_score_join(events: DataFrame, programs: DataFrame) -> DataFrame:
    return events.join(programs.select("program_id", "ev_score", "workflow", "exclude_reason"), "program_id", "left")


def event_log_roll(new: DataFrame, old: DataFrame, keep: int = 200) -> DataFrame:
    """The newest events, one for each id; a new one goes before an old one. Both hold happened_at, event_id and other columns alike."""
    rest = [c for c in new.columns if c != "event_id"]
    both = new.withColumn("age", F.lit(0)).unionByName(old.withColumn("age", F.lit(1)))
    return both.groupBy("event_id").agg(F.min_by(F.struct(*rest), "age").alias("e")).select("event_id", "e.*").orderBy(F.desc("happened_at"), "event_id").limit(keep)


def alert_digest(scored: DataFrame, first: int = 8) -> DataFrame:
    """The first alerts and how many more there are. Baselines, excluded programs and those worth nothing give none."""
    fine = scored.where("exclude_reason IS NULL AND ev_score > 0 AND change_type <> 'baseline'")
    more = fine.agg(F.greatest(F.lit(0), F.count("*") - first).cast("long").alias("n")).scalar()
    return fine.orderBy(F.desc("ev_score"), "event_id").limit(first).select("event_id", "program_id", "change_type", "ev_score", more.alias("more"))


def repo_priority(repos: DataFrame) -> DataFrame:
    """One row per repository: the highest priority of the changes that touch it. repos: repo_key, change_type."""
    p = F.when(F.col("change_type") == "new_target", 3).when(F.col("change_type") == "new_program", 2).otherwise(1)
    return repos.groupBy("repo_key").agg(F.max(p).alias("priority"))


def staleness(repos: DataFrame, cache: DataFrame, now: str, ttl_hours: int = 168, forced: bool = False) -> DataFrame:
    """repos with fetched_at and stale: forced, no good row, or too old."""
    old = F.col("fetched_at") <= _at(now) - F.make_dt_interval(hours=F.lit(ttl_hours))
    df = repos.join(cache.select("repo_key", "status", "fetched_at"), "repo_key", "left")
    return df.withColumn("stale", F.lit(forced) | ~F.coalesce(F.col("status") == "ok", F.lit(False)) | F.coalesce(old, F.lit(True))).drop("status")


def refresh_schedule(stale: DataFrame, limit: int = 250) -> DataFrame:
    """What to fetch next: stale ones first, then by priority, then the oldest. stale: of staleness."""
    return stale.orderBy(F.desc("stale"), F.desc("priority"), F.asc_nulls_first("fetched_at"), "repo_key").limit(limit)


def enrich_stats(stale: DataFrame, results: DataFrame, cache: DataFrame, limit: int = 250) -> DataFrame:
    """One row about a refresh of repositories: found, stale, scheduled and deferred ones, tried, updated and failed ones, those without a good row after it, and how many each host has.

    stale: of staleness; results: repo_key, status of the tried ones; cache: of cache_upsert.
    """
    n, tried = F.count_if("stale"), F.col("result").isNotNull()
    df = stale.join(results.select("repo_key", F.col("status").alias("result")), "repo_key", "left").join(cache.select("repo_key", F.col("status").alias("after")), "repo_key", "left")
    lab = F.startswith("repo_key", F.lit("gitlab.com/"))
    return df.agg(F.count("*").alias("discovered"), n.alias("stale"), F.least(n, F.lit(limit)).cast("long").alias("scheduled"), F.greatest(n - limit, F.lit(0)).cast("long").alias("deferred"),
                  F.count_if(tried).alias("attempted"), F.count_if(tried & (F.col("result") == "ok")).alias("updated"), F.count_if(tried & (F.col("result") != "ok")).alias("failed"),
                  F.count_if(~F.col("after").eqNullSafe(F.lit("ok"))).alias("pending"), F.count_if(~lab).alias("github"), F.count_if(lab).alias("gitlab"))


def cache_upsert(cache: DataFrame, fresh: DataFrame, referenced: DataFrame) -> DataFrame:
    """Good new rows replace; a failed refresh keeps a good row with its error; what nothing refers to any more goes."""
    a = cache.select("repo_key", F.col("status").alias("s0"), F.col("fetched_at").alias("f0"))
    b = fresh.select("repo_key", F.col("status").alias("s1"), F.col("fetched_at").alias("f1"))
    df = a.join(b, "repo_key", "full").join(referenced.select("repo_key").distinct(), "repo_key", "left_semi")
    new, good = F.coalesce(F.col("s1") == "ok", F.lit(False)), F.coalesce(F.col("s0") == "ok", F.lit(False))
    return df.select("repo_key", F.when(new | good, "ok").otherwise("pending").alias("status"), F.when(new, F.col("f1")).when(good, F.col("f0")).alias("fetched_at"),
                     F.when(good & ~new & F.col("s1").isNotNull(), F.col("s1")).alias("last_error"))


def scan_coverage(blobs: DataFrame, picked: DataFrame, max_size: int = 500_000) -> DataFrame:
    """Per repository: files that could be read, files chosen, their bytes, and whether that is all."""
    may = scannable(blobs, max_size).groupBy("repo_key").agg(F.count("*").alias("eligible"))
    got = picked.groupBy("repo_key").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    df = may.join(got, "repo_key", "left").withColumns({"selected": F.coalesce("n", F.lit(0)).cast("long"), "bytes": F.coalesce("b", F.lit(0)).cast("long")})
    return df.select("repo_key", "eligible", "selected", "bytes", F.when(F.col("selected") == F.col("eligible"), "complete").otherwise("bounded").alias("status"))


def coverage_gate(evaluated: DataFrame, floor: int = 400, ratio: float = 0.8) -> DataFrame:
    """One row: targets with a repository, those measured, how many are required, whether they are enough."""
    df = evaluated.where("repo_status IS NOT NULL").agg(F.count("*").alias("n"), F.count("hardening_index").alias("measured"))
    df = df.withColumn("required", F.least(F.lit(floor), F.ceil(F.col("n") * F.lit(ratio))).cast("long"))
    return df.select("n", "measured", "required", (F.col("measured") >= F.col("required")).alias("ready"), F.when(F.col("n") == 0, 1.0).otherwise(F.col("measured") / F.col("n")).alias("ratio"))


def publish_gate(coverage: DataFrame, health: DataFrame, changed: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """checks: of cache.trap_assertions; a run whose checks fail is not published."""
    healthy = health.agg((F.count_if(F.col("status") == "ok") > 0).alias("h")).scalar()
    ready = F.col("ready") if checks is None else F.col("ready") & checks.select("ready").scalar()
    df = coverage.select(ready.alias("ready"), healthy.alias("healthy"), changed.select("changed").scalar().alias("dataset_changed"))
    return df.select(F.expr("ready AND healthy").alias("publish"), F.expr("ready AND healthy AND dataset_changed").alias("changed"))


def policy_lookup(programs: DataFrame, policy: DataFrame) -> DataFrame:
    """Policy signals of each program's address; resolved reports fall back to the policy's."""
    df = programs.join(policy, "url", "left")
    return df.select("program_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("policy_invite_only", "policy_kyc", "excludes_in")), F.coalesce("resolved_reports", "policy_reports").cast("long").alias("resolved_reports"))


def fallback_target(programs: DataFrame) -> DataFrame:
    """A program without targets gets one: its own address."""
    kind = F.when(F.array_contains("tags", "api"), "api").otherwise("web")
    return programs.where("target_count = 0").select("merge_key", F.concat("program_id", F.lit(":policy")).alias("target_key"), kind.alias("type"), F.col("url").alias("value"))


def live_match(targets: DataFrame, rules: list[dict]) -> DataFrame:
    """The number of the first rule that fits, compiled into one expression: the same key, an address in the value, or a pattern over
    the program's id and name, the key and the value. No join. targets: program_id, name, target_key, value."""
    out = F.lit(None).cast("int")
    for i, r in reversed(list(enumerate(rules))):
        fits = F.lit(False)
        if r.get("key"):
            fits = fits | (F.col("target_key") == r["key"])
        if r.get("address"):
            fits = fits | F.contains(F.lower("value"), F.lit(r["address"].lower()))
        if r.get("pattern"):
            fits = fits | F.concat_ws(" ", "program_id", "name", "target_key", "value").rlike("(?i)" + r["pattern"])
        out = F.when(fits, F.lit(i)).otherwise(out)
    return targets.withColumn("rule", out).where("rule IS NOT NULL")


def override_join(programs: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides by id, then name, then lower-case name: the first of these that has one, whole. overrides: key, floor and more; each column of the result begins with override_."""
    fields = [c for c in overrides.columns if c != "key"]
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), k.alias("key")) for i, k in enumerate((F.col("program_id"), F.col("name"), F.lower("name"))))))
    df = programs.select("program_id", keys.alias("k")).select("program_id", "k.*").join(F.broadcast(overrides), "key")
    return df.groupBy("program_id").agg(F.min_by(F.struct(*fields), "rank").alias("o")).select("program_id", *(F.col(f"o.{c}").alias(f"override_{c}") for c in fields))


def signals_lookup(targets: DataFrame, signals: DataFrame) -> DataFrame:
    """target_key, repo_key and the signals of each target's repository: those under its key, else those under the older form ``host:owner/name``, else a pending row; null for other targets.

    targets: target_key, value; signals: repo_key (either form), status and more. Both forms are looked up in one join over distinct repositories, and the better one stays.
    """
    fields = [c for c in signals.columns if c != "repo_key"]
    keys = resolved(targets)
    lab = F.startswith("repo_key", F.lit("gitlab.com/"))
    full = F.when(lab, F.substring("repo_key", len("gitlab.com/") + 1, 2**31 - 1)).otherwise(F.col("repo_key"))
    provider = F.when(lab, "gitlab").otherwise("github")
    repos = keys.select("repo_key").distinct().withColumns({"provider": provider, "full_name": full})
    forms = F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("repo_key").alias("form")), F.struct(F.lit(1).alias("rank"), F.concat_ws(":", "provider", "full_name").alias("form"))))
    found = repos.select("repo_key", forms.alias("f")).select("repo_key", "f.*").join(signals.withColumnRenamed("repo_key", "form"), "form")
    got = found.groupBy("repo_key").agg(F.min_by(F.struct(*fields), "rank").alias("s"))
    known = repos.join(got, "repo_key", "left").select("repo_key", "provider", "full_name", *(F.coalesce("s.status", F.lit("pending")).alias(c) if c == "status" else F.col(f"s.{c}").alias(c) for c in fields))
    return targets.select("target_key").distinct().join(keys.join(known, "repo_key"), "target_key", "left").select("target_key", "repo_key", "provider", "full_name", *fields)


#: Signals that are published as they are; all others only of repositories that were measured.
_ALWAYS = ["status", "provider", "full_name", "url", "age_y", "default_branch", "languages", "files_added_90d_list", "files_90d_truncated", "security_workflows", "advisory_coverage", "trap_hits", "scan_coverage"]


def compact_signals(signals: DataFrame, added: int = 40, hits: int = 10) -> DataFrame:
    """repo_key and one struct: what is published of a repository. A measure is null, not zero, where the repository was not measured; lists are cut."""
    fields = [c for c in signals.columns if c != "repo_key"]
    ok = F.col("status") == "ok"
    cut = {"files_added_90d_list": F.slice(F.coalesce("files_added_90d_list", F.array().cast("array<string>")), 1, added), "trap_hits": F.slice("trap_hits", 1, hits)}
    cut = {c: x for c, x in cut.items() if c in fields}
    return signals.select("repo_key", F.struct(*(cut.get(c, F.col(c)).alias(c) if c in _ALWAYS else F.when(ok, F.col(c)).alias(c) for c in fields)).alias("repo_signals"))


def public_projection(evaluated: DataFrame, best: DataFrame, signals: DataFrame, top: int = 16) -> DataFrame:
    """One row per program: ``targets``, an array of its best target and the ones of the greatest value behind it, each with the published signals of its repository (null without one).

    evaluated: of evaluate_targets; best: program_id, target_key; signals: of compact_signals. Groups are cut to ``top`` before the shuffle, and only what is left is joined with signals.
    """
    first = best.select("program_id", F.col("target_key").alias("best_key"))
    rows = evaluated.select("program_id", "target_key", "type", "value", "repo_key", "workflow", "findable_class", "ceiling", "hardening_index", "fresh_code_index", "p_findable", "ev_score", "exclude_reason")
    rows = rows.join(first, "program_id").withColumn("is_best", F.col("target_key") == F.col("best_key"))
    w = Window.partitionBy("program_id").orderBy(F.desc("is_best"), F.desc("ev_score"), "target_key")
    rows = rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= top).drop("best_key")
    one = F.struct("position", "target_key", "type", "value", "is_best", "workflow", "findable_class", "ceiling", "hardening_index", "fresh_code_index", "p_findable", "ev_score", "exclude_reason", "repo_signals")
    return rows.join(signals, "repo_key", "left").groupBy("program_id").agg(F.collect_list(one).alias("targets")).select("program_id", F.array_sort("targets", lambda a, b: a["position"] - b["position"]).alias("targets"))


def browse(programs: DataFrame, targets: DataFrame, tab: str = "top", platform: str | None = None, workflow: str | None = None, least: float = 0.0, words: str = "", reviewed: DataFrame | None = None, watchlist: DataFrame | None = None) -> DataFrame:
    """Programs that are not excluded and worth something, by tab (top, live, fresh-source, watchlist), platform, workflow and value; words are looked for in the
    program's fields, tags and target values (targets: program_id, value). reviewed: program_id, name; watchlist: program_id."""
    df = programs.where("exclude_reason IS NULL AND ev_score > 0").where(F.col("ev_score") >= least)
    if tab == "top":
        df = df.where("workflow <> 'static-source-hardened'")
    elif tab == "live":
        df = df.where(F.col("workflow").isin(LIVE))
    elif tab == "fresh-source":
        df = df.where("workflow = 'static-source' AND fresh_code_index > 50")
    elif tab == "watchlist":
        df = df.join(watchlist.select("program_id"), "program_id", "left_semi")
    if platform:
        df = df.where(F.col("platform") == platform)
    if workflow:
        df = df.where(F.col("workflow") == workflow)
    if words:
        term = F.lit(words.strip().lower())
        hit = targets.where(F.contains(F.lower("value"), term)).select("program_id", F.lit(True).alias("hit")).distinct()
        tags = F.array_join("tags", " ") if "tags" in programs.columns else F.lit("")
        df = df.join(hit, "program_id", "left").where(F.col("hit") | F.contains(F.lower(F.concat_ws(" ", "name", "platform", "workflow", "findable_class", "reason", tags)), term)).drop("hit")
    if reviewed is not None:
        plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
        df = df.join(reviewed.select("program_id"), "program_id", "left_anti")
        df = df.withColumn("plain", plain("name")).join(reviewed.where("name IS NOT NULL").select(plain("name").alias("plain")).distinct(), "plain", "left_anti").drop("plain")
    return df


def browse_sort(programs: DataFrame, by: str = "ev", limit: int = 25) -> DataFrame:
    """by: ev, reward, fresh or name."""
    first = {"ev": [F.desc("ev_score"), F.desc("p_findable")], "reward": [F.desc(F.coalesce("max_reward", F.lit(0.0)))], "fresh": [F.desc("fresh_code_index")], "name": []}[by]
    return programs.orderBy(*first, F.collate("name", "UNICODE"), "program_id").limit(limit)
