"""The registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cache, diff, evidence, facts, merge, rank, state
from ..sources.fixtures import BEFORE, LIVE_RULES, NOW, NOW_LIVE, OVERRIDE_FIELDS, OVERRIDES, SOURCES, present, view
from . import flow
from .oracle import ORACLES, SENTINEL  # noqa: F401

_ID = ["program_id", "target_key"]


def _evaluated(*columns):
    return lambda s, d: flow.evaluated(s, d).selectExpr(*_ID, *columns)


def _programs(*columns):
    return lambda s, d: flow.programs(s, d).select("program_id", *columns)


def _events(s, d):
    return diff.change_events(flow.changes(s, d), NOW)


def _scored(s, d):
    return state.event_score_join(_events(s, d), flow.best(s, d))


def _log(s, d):
    at = F.lit(BEFORE).cast("timestamp_ntz")
    old = flow.programs(s, d, True).select(F.concat_ws(":", F.lit(BEFORE), "program_id", F.lit("new_program")).alias("event_id"), "program_id", F.lit("new_program").alias("change_type"), at.alias("happened_at"))
    return state.event_log_roll(_events(s, d).withColumn("happened_at", F.lit(NOW).cast("timestamp_ntz")), old, 700)


def _diff(s, d):
    return flow.differences(s, d)


def _previous(s, d):
    at = F.lit(BEFORE).cast("timestamp_ntz")
    return flow.programs(s, d, True).select("merge_key", *(at.alias(c) for c in ("first_seen_at", "last_seen_at", "last_changed_at")))


def _commits(s, d):
    """Read by the cache and by what is fetched anew."""
    return flow.stored(s, d, "commits", lambda: view(s, d, "fx_repo_commits").groupBy("repo_key").agg(F.max("committed_at").alias("fetched_at"), F.count("*").alias("n")))


def _cache(s, d):
    return _commits(s, d).select("repo_key", F.when(F.col("n") % 5 == 0, "failed").otherwise("ok").alias("status"), "fetched_at")


def _fresh(s, d):
    return _commits(s, d).where("n % 3 = 0").select("repo_key", F.when(F.col("n") % 2 == 0, "failed").otherwise("ok").alias("status"), F.lit(NOW).cast("timestamp_ntz").alias("fetched_at"))


def _repos(s, d):
    """Read by the schedule and by the cache; only targets at a host have a repository."""
    def build():
        return _prioritised(flow.changes(s, d), flow.hosted(s, d).select("merge_key", "target_key", "value"))

    return flow.stored(s, d, "repos", build)


def _prioritised(changes, t):
    keys = evidence.repo_resolve(t.select("target_key", "value").distinct()).where("repo_key IS NOT NULL")
    return state.repo_priority(t.select("merge_key", "target_key").join(keys, "target_key").join(changes.select("merge_key", "change_type"), "merge_key").select("repo_key", "change_type"))


def _sites(s, d):
    """target_key, value of all merged targets; the value only of those that can have a repository."""
    rest = flow.targets(s, d).where("NOT at_host").select("target_key", F.lit(None).cast("string").alias("value"))
    return flow.stored(s, d, "sites", lambda: flow.hosted(s, d).select("target_key", "value").distinct()).unionByName(rest.distinct())


def _stale(s, d):
    return state.staleness(_repos(s, d), _cache(s, d), NOW)


def _core(df):
    return df.select("merge_key", *diff.CORE)


def _health(s, d):
    return state.src_health(flow.records(s, d), s.createDataFrame([(x,) for x in SOURCES], "source_id string"), 10)


def _classified(s, d):
    before = flow.programs(s, d, True).withColumns({"change_type": F.when(F.col("target_count") % 2 == 0, "reward_up"), "change_at": F.lit(BEFORE).cast("timestamp_ntz")})
    return diff.classify_change(flow.programs(s, d), before, flow.differences(s, d), now=NOW).drop("merge_key")


def _browsed(s, d):
    evaluated = flow.evaluated(s, d)
    best = rank.best_target(evaluated).join(flow.programs(s, d).select("program_id", "tags"), "program_id")
    reviewed = s.createDataFrame([("program:program-1", None), ("x", "PROGRAM 2!")], "program_id string, name string")
    return state.browse(best, evaluated.select("program_id", "value"), platform="BUILDING", least=1.0, words="oauth", reviewed=reviewed)


QUERIES = {
    "norm_targets": lambda s, d: merge.norm_targets(view(s, d, "fx_targets")).drop("added_at"),
    "dedupe_targets": lambda s, d: merge.dedupe_targets(merge.norm_targets(view(s, d, "fx_targets"))).drop("added_at"),
    "merge_lead": _programs("name", "platform", "url"),
    "merge_rewards": _programs("min_reward", "max_reward", "currency"),
    "merge_flags": _programs("status", "paid", "invite_only", "kyc_required", "safe_harbor", "disclosure_allowed", "source_code", "local_testing_hint", "invite_words"),
    "merge_sets": lambda s, d: flow.programs(s, d).select("program_id", F.array_join("source_ids", ",").alias("source_ids"), F.array_join("tags", ",").alias("tags"), F.array_join("languages", ",").alias("languages"), F.array_join("countries", ",").alias("countries"), "repository_count", "target_count"),
    "merge_targets": lambda s, d: flow.merged(s, d)[1].select("merge_key", "target_key", "type", "value"),
    "merge_dates": _programs("launched_at", "resolved_reports"),
    "merge_policy_text": lambda s, d: merge.merge_policy_text(flow.records(s, d)).select("merge_key", F.length("policy_text").cast("long").alias("length"), F.sha2("policy_text", 256).alias("text_sha256")),
    "diff_targets": lambda s, d: flow.differences(s, d),
    "classify_change": _classified,
    "missing_grace": lambda s, d: diff.missing_grace(flow.programs(s, d, True).withColumn("missing_count", F.lit(0)), present(flow.programs(s, d))),
    "change_events": lambda s, d: diff.change_events(flow.changes(s, d), NOW),
    "repo_resolve": lambda s, d: evidence.repo_resolve(flow.hosted(s, d).select("target_key", "value").distinct()),
    "repo_activity": lambda s, d: evidence.repo_activity(view(s, d, "fx_repo_commits"), view(s, d, "fx_repo_pulls"), NOW),
    "repo_profile": lambda s, d: evidence.repo_profile(flow.repo_meta(s, d), view(s, d, "fx_repo_commits"), NOW).withColumn("languages", F.array_join(F.transform(F.array_sort(F.map_entries("languages")), lambda x: F.concat_ws(":", x["key"], x["value"])), ",")),
    "scan_priority_pick": lambda s, d: evidence.scan_priority_pick(view(s, d, "fx_blobs")),
    "detect_traps": lambda s, d: evidence.detect_traps(view(s, d, "fx_blobs"), view(s, d, "fx_tree").select("repo_key", "path")),
    "trap_rollup": lambda s, d: flow.traps(s, d).withColumn("trap_hits", F.array_join(F.transform("trap_hits", lambda h: F.concat_ws(":", h["kind"], h["path"], h["line"], h["match"])), ";")),
    "policy_text": lambda s, d: flow.texts(s, d).select("url", F.sha2("text", 256).alias("text_sha256")),
    "policy_rewards": lambda s, d: evidence.policy_rewards(flow.texts(s, d)),
    "policy_floor": lambda s, d: evidence.policy_floor(evidence.policy_rewards(flow.texts(s, d)), flow.texts(s, d)),
    "policy_restrictions": lambda s, d: evidence.policy_restrictions(flow.texts(s, d)),
    "live_activity": lambda s, d: evidence.live_activity(view(s, d, "fx_live_tx"), NOW_LIVE),
    "hardening_index": _evaluated("hardening_index"),
    "fresh_code_index": _evaluated("fresh_code_index"),
    "known_issue_risk": _evaluated("known_issue_risk"),
    "recent_scope": _evaluated("recent_scope"),
    "workflow_route": _evaluated("base_workflow", "workflow"),
    "findable_class": _evaluated("findable_class", "ceiling", "label"),
    "policy_floor_resolve": _evaluated("floor", "floor_source"),
    "eligibility": _evaluated("reasons"),
    "p_first": _evaluated("p_first", "reports_estimated"),
    "p_findable": _evaluated("p_findable"),
    "p_payable": _evaluated("p_payable"),
    "dormant": _evaluated("dormant"),
    "hard_exclusions": _evaluated("exclude_reason"),
    "trap_tags": _evaluated("array_join(trap_tags, ',') AS trap_tags"),
    "ev_score": _evaluated("effective_reward", "ev_score"),
    "reason_text": _evaluated("reason"),
    "evaluate_targets": _evaluated("workflow", "findable_class", "ceiling", "floor", "hardening_index", "fresh_code_index", "known_issue_risk", "p_findable", "p_payable", "p_first", "ev_score", "exclude_reason", "reason"),
    "best_target": lambda s, d: flow.best(s, d).select("program_id", "target_key", "targets", "workflow", "ev_score", "exclude_reason"),
    "program_traps": lambda s, d: rank.program_traps(flow.evaluated(s, d)),
    "rank_programs": lambda s, d: rank.rank_programs(flow.best(s, d)).select("program_id", "name", "ev_score", "p_findable"),
    "lane_filter": lambda s, d: rank.lane_filter(flow.best(s, d)).select("program_id", "workflow", "ev_score"),
    "shortlist": lambda s, d: rank.shortlist(flow.best(s, d)).select("program_id", "name", "workflow", "ev_score", "reason"),
    "shortlist_live": lambda s, d: rank.shortlist(flow.best(s, d), "live").select("program_id", "name", "workflow", "ev_score", "reason"),
    "shortlist_fresh_source": lambda s, d: rank.shortlist(flow.best(s, d), "fresh-source").select("program_id", "name", "workflow", "ev_score", "reason"),
    "facet_platforms": lambda s, d: rank.facet_platforms(flow.programs(s, d)),
    "summary_metrics": lambda s, d: rank.summary_metrics(flow.best(s, d), flow.evaluated(s, d)),
    "ev_tier": lambda s, d: rank.ev_tier(flow.best(s, d)),
    "run_meta": lambda s, d: rank.run_meta(flow.best(s, d), _events(s, d), _health(s, d), state.coverage_gate(flow.evaluated(s, d)), cache.trap_assertions(flow.evaluated(s, d), SENTINEL)),
    "src_health": _health,
    "src_snapshot_fallback": lambda s, d: state.src_snapshot_fallback(flow.records(s, d), flow.records(s, d, True), 290).select("source_id", "record_no", "name", "raw_status"),
    "norm_programs": lambda s, d: flow.records(s, d).select("record_no", "merge_key", "url", "status", "paid"),
    "norm_counts": lambda s, d: facts.record_tags(flow.said(s, d)).drop("tags", "languages"),
    "norm_tags": lambda s, d: facts.record_tags(flow.said(s, d)).select("record_no", F.array_join("tags", ",").alias("tags"), F.array_join("languages", ",").alias("languages")),
    "diff_fingerprint": lambda s, d: state.diff_fingerprint(flow.programs(s, d), flow.programs(s, d, True), _diff(s, d)),
    "dataset_changed": lambda s, d: state.dataset_changed(_core(flow.programs(s, d)), _core(flow.programs(s, d, True))),
    "program_lifecycle": lambda s, d: state.program_lifecycle(flow.changes(s, d), _previous(s, d), NOW),
    "target_lifecycle": lambda s, d: state.target_lifecycle(flow.merged(s, d)[1], flow.merged(s, d, True)[1].withColumn("first_seen_at", F.lit(BEFORE).cast("timestamp_ntz")), NOW),
    "event_score_join": lambda s, d: _scored(s, d).select("event_id", "program_id", "change_type", "ev_score", "workflow", "exclude_reason"),
    "event_log_roll": lambda s, d: _log(s, d).select("event_id", "program_id", "change_type", "happened_at"),
    "alert_digest": lambda s, d: state.alert_digest(_scored(s, d)),
    "refresh_schedule": lambda s, d: state.refresh_schedule(_stale(s, d)).select("repo_key", "priority", "fetched_at", "stale"),
    "enrich_stats": lambda s, d: state.enrich_stats(_stale(s, d), _fresh(s, d), state.cache_upsert(_cache(s, d), _fresh(s, d), _repos(s, d))),
    "cache_upsert": lambda s, d: state.cache_upsert(_cache(s, d), _fresh(s, d), _repos(s, d)),
    "scan_coverage": lambda s, d: state.scan_coverage(view(s, d, "fx_blobs"), evidence.scan_priority_pick(view(s, d, "fx_blobs"))),
    "signals_lookup": lambda s, d: state.signals_lookup(_sites(s, d), view(s, d, "fx_signals_old")),
    "repo_status": flow.repo_status,
    "merge_key": lambda s, d: merge.merge_keys(view(s, d, "fx_names")),
    "coverage_gate": lambda s, d: state.coverage_gate(flow.evaluated(s, d)),
    "publish_gate": lambda s, d: state.publish_gate(state.coverage_gate(flow.evaluated(s, d)), _health(s, d), state.dataset_changed(_core(flow.programs(s, d)), _core(flow.programs(s, d, True))), cache.trap_assertions(flow.evaluated(s, d), SENTINEL)),
    "policy_lookup": lambda s, d: state.policy_lookup(flow.programs(s, d), evidence.policy_restrictions(flow.texts(s, d))),
    "policy_fallback_target": lambda s, d: state.fallback_target(flow.programs(s, d)),
    "live_match": lambda s, d: state.live_match(flow.merged(s, d)[1].join(flow.programs(s, d).select("merge_key", "program_id", "name"), "merge_key"), LIVE_RULES).select("merge_key", "target_key", "rule"),
    "override_join": lambda s, d: state.override_join(flow.programs(s, d), s.createDataFrame(OVERRIDES, OVERRIDE_FIELDS)).withColumn("override_countries", F.array_join("override_countries", ",")),
    "browse": lambda s, d: _browsed(s, d).select("program_id", "name", "workflow", "ev_score"),
    "browse_sort": lambda s, d: state.browse_sort(flow.best(s, d), "reward").select("program_id", "name", "max_reward", "ev_score"),
}
