"""Queries of feeds, scores, repository and policy evidence, sinks and the stream, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cache, diff, evidence, feeds, normal, repo, score, state
from ..sources import sinks
from ..sources.fixtures import AUDITED, BEFORE, FEEDS, NOW, NOW_LIVE, present, view
from ..streaming import reconcile
from . import flow
from .oracle import AT, CTES, LIVE_AT, SENTINEL, SNAPSHOT, D, chain, hit, literal, q

_RUN, _RUN_BEFORE = NOW[:10], BEFORE[:10]


def _records(s, d):
    return feeds.src_feeds(view(s, d, "fx_feeds"))


def _scored(s, d):
    programs = flow.programs(s, d)
    df = programs.join(flow.changes(s, d).select("merge_key", "change_type"), "merge_key")
    age = F.make_dt_interval(days=(F.col("target_count") % 9).cast("int"))
    df = df.drop("change_at").withColumns({"change_label": F.replace("change_type", F.lit("_"), F.lit(" ")), "change_at": F.lit(NOW).cast("timestamp_ntz") - age, "safe_harbor": F.col("safe_harbor").isNotNull()})
    return score.score_programs(df, NOW)


def _tooling(s, d):
    tree = view(s, d, "fx_tree")
    got = repo.detect_tooling(tree.select("repo_key", "path"), tree.where("NOT failed"), tree.where("failed").select("repo_key"))
    return got.withColumn("tools", F.array_join("tools", ","))


def _advisories(s, d):
    return repo.advisory_signals(view(s, d, "fx_advisories").withColumn("packages", F.array("package")), view(s, d, "fx_tree").select("repo_key", "path"), NOW)


def _policy_cache(s, d):
    n = F.col("target_count")
    return flow.programs(s, d, True).select("program_id", F.when(n % 4 == 0, "failed").otherwise("ok").alias("status"), (F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(days=(n % 14).cast("int"))).alias("fetched_at"),
                                             F.when(n % 2 == 0, F.sha2(F.concat(F.lit("policy "), "merge_key"), 256)).alias("inline_hash"), n.alias("reports"), F.lit(None).cast("string").alias("last_error"))


def _policy_refresh(s, d):
    texted = flow.changes(s, d).withColumn("policy_text", F.when(F.col("added") % 3 == 0, F.concat(F.lit(" policy "), "merge_key", F.when(F.col("added") % 4 == 0, " pays $2,000 at most for a critical one").when(F.col("added") % 4 == 1, ": 1,204 resolved reports").when(F.col("removed") % 2 == 1, ", low ones are out of scope").otherwise(""))))
    return cache.policy_refresh(texted, _policy_cache(s, d), NOW)


def _policy_upsert(s, d):
    n = F.col("target_count")
    got = flow.programs(s, d).where(n % 3 == 0).select("program_id", F.when(n % 2 == 0, "failed").when(n % 9 == 0, "partial").otherwise("ok").alias("status"), F.lit("timeout").alias("error"), (n + 1).alias("reports"))
    return cache.upsert(_policy_cache(s, d).drop("inline_hash"), got, "program_id", NOW)


def _live_upsert(s, d):
    address = view(s, d, "fx_live_tx").select("address").distinct()
    last = F.substring("address", -1, 1)
    codes = address.select("address", F.when(last.isin("1", "2"), None).when(last == "3", "0x").otherwise("0x60fe").alias("code"))
    hours = F.when(last == "5", 3).otherwise(10)
    old = address.where(last.isin("1", "5", "3")).select("address", F.when(last == "3", "pending").otherwise("ok").alias("status"), (F.lit(NOW_LIVE).cast("timestamp_ntz") - F.make_dt_interval(hours=hours)).alias("fetched_at"), F.lit(None).cast("string").alias("last_error"),
                                                         F.lit(True).alias("deployed"), F.lit(7).cast("long").alias("tx_30d"))
    return cache.upsert(old, cache.live_results(codes, evidence.live_activity(view(s, d, "fx_live_tx"), NOW_LIVE), old, NOW_LIVE), "address", NOW_LIVE)


def _audit(s, d):
    audited = s.createDataFrame(AUDITED, "no int, key string, aliases array<string>, verdict string, fresh_at_audit double")
    return cache.audit_excluded(cache.audit_match(flow.evaluated(s, d).select("program_id", "name", "target_key", "value", "repo_key", "fresh_code_index"), audited)).select("program_id", "target_key", "audit_no", "audit_reason")


def _union(s, d):
    columns = ["source_id", "record_no", "name", "source_priority", "max_reward"]
    rows = view(s, d, "fx_records").select(columns)
    manual = s.createDataFrame([(-1, "By hand"), (-2, "Also by hand")], "record_no long, name string")
    return feeds.src_union([rows.where("source_priority <= 20"), rows.where("source_priority > 20")], manual).select(columns)


def _state(s, d):
    to = sinks.folder(s, "state")
    columns = ["program_id", "name", "status", "max_reward"]
    for run, before in ((_RUN_BEFORE, True), (_RUN, False), (_RUN, False)):  # the last run is repeated
        programs, targets = flow.merged(s, d, before)
        sinks.write_state({"programs": programs.select(columns), "targets": targets.select("merge_key", "target_key")}, to, run)
    n = sinks.read_state(s, to, "targets").groupBy(F.concat(F.lit("program:"), "merge_key").alias("program_id")).agg(F.count("*").alias("targets"))
    return sinks.read_state(s, to, "programs").join(n, "program_id", "left")


def _exports(s, d):
    to = sinks.folder(s, "export")
    sinks.export_csv(flow.best(s, d), to)
    got = s.read.option("header", True).option("escape", '"').csv(to)
    return got.select("name", "platform", "workflow", F.col("ev_score").cast("double"), F.col("max_reward").cast("double"), F.col("reward_capped").cast("boolean"), "reason", "url")


def _polled(s, d) -> str:
    """Both snapshots landed and taken in; where the state is."""
    landed, to, at = (sinks.folder(s, x) for x in ("landed", "state", "stream"))
    for run, before in ((_RUN_BEFORE, True), (_RUN, False)):
        programs, targets = flow.merged(s, d, before)
        programs = (programs if before else present(programs)).select("program_id", "merge_key", *diff.CORE)
        targets = targets.select("merge_key", "target_key", "type", "value", "added_at").join(programs.select("merge_key"), "merge_key", "left_semi")
        targets.write.parquet(f"{landed}/targets/run_ts={run}")
        programs.write.parquet(f"{landed}/programs/run_ts={run}")
    reconcile.incremental_reconcile(s, landed, to, at, programs.schema, targets.schema)
    return to


def _stream(s, d):
    seen = ("first_seen_at", "last_seen_at", "last_changed_at")
    return sinks.read_state(s, _polled(s, d), "programs").select("merge_key", "status", "max_reward", "currency", "change_type", "change_at", *seen, "missing_count")


def _stream_targets(s, d):
    return sinks.read_state(s, _polled(s, d), "targets").select("merge_key", "target_key", "first_seen_at")


def _sources(s):
    return s.createDataFrame(FEEDS, "source_id string, homepage string, url_template string, paid_only boolean, priority int")


def _feed_programs(s, d):
    return normal.norm_programs(_records(s, d), _sources(s)).withColumn("countries", F.array_join("countries", ",")).drop("own_text")


def _fed(s, d):
    made = lambda i: lambda: normal.feed_rows(_records(s, d), _sources(s))[i]
    return normal.feed_merge(flow.stored(s, d, "feed_rows", made(0)), flow.stored(s, d, "feed_targets", made(1)))


def _feed_merge(s, d):
    programs = _fed(s, d)[0]
    return programs.select("program_id", "name", "platform", "url", "status", "paid", "currency", "min_reward", "max_reward", "safe_harbor", "disclosure_allowed", "invite_only", "kyc_required", F.array_join("source_ids", ",").alias("source_ids"), F.array_join("countries", ",").alias("countries"),
                           "launched_at", "resolved_reports", F.array_join("tags", ",").alias("tags"), F.array_join("languages", ",").alias("languages"), "local_testing_hint", "source_code", "repository_count", "target_count", "invite_words")


def _public(s, d):
    df = state.public_projection(flow.evaluated(s, d), flow.best(s, d), flow.published_signals(s, d))
    t = df.select("program_id", F.explode("targets").alias("t")).select("program_id", "t.*")
    plain = [c for c in t.schema["repo_signals"].dataType.names if c not in ("languages", "files_added_90d_list", "security_workflows", "advisories", "trap_hits", "scan_coverage")]
    of = lambda c: F.col(f"repo_signals.{c}")
    return t.select("program_id", "position", "target_key", "is_best", "workflow", "ev_score", *(of(c).alias(c) for c in plain), F.array_join(F.array_sort(F.map_keys(of("languages"))), ",").alias("languages"), *(F.array_join(of(c), ",").alias(c) for c in ("files_added_90d_list", "security_workflows")),
                    *(of(f"advisories.{c}").alias(f"advisories_{c}") for c in ("open", "resolved", "total")), F.array_join(F.transform(of("trap_hits"), lambda h: F.concat_ws(":", h["kind"], h["path"], h["line"], h["match"])), ";").alias("trap_hits"), *(of(f"scan_coverage.{c}").alias(f"scan_{c}") for c in ("eligible", "selected", "bytes")))


QUERIES = {
    "public_projection": _public,
    "src_feeds": lambda s, d: _records(s, d).select("source_id", "page_no", "ordinal", "name"),
    "src_nested_targets": lambda s, d: feeds.src_nested_targets(_records(s, d)),
    "norm_feed_programs": _feed_programs,
    "feed_merge": _feed_merge,
    "feed_merge_targets": lambda s, d: _fed(s, d)[1].select("merge_key", "target_key", "type", "value", "description"),
    "norm_feed_targets": lambda s, d: normal.norm_targets(_records(s, d)),
    "norm_rewards": lambda s, d: feeds.norm_rewards(_records(s, d)),
    "src_union": _union,
    "score_programs": lambda s, d: _scored(s, d).select("program_id", "freshness", "reward", "inspectability", "authorization", "friction", "score", F.array_join("reasons", "; ").alias("reasons"), "attention_pressure"),
    "rank_v1": lambda s, d: score.rank_v1(_scored(s, d)).select("program_id", "name", "score"),
    "repo_file_churn": lambda s, d: repo.repo_file_churn(view(s, d, "fx_compare")).withColumn("added_list", F.array_join("added_list", ",")),
    "repo_tree_top2": lambda s, d: repo.repo_tree_top2(view(s, d, "fx_tree").select("repo_key", "path")).withColumn("paths", F.array_join("paths", ",")),
    "detect_tooling": _tooling,
    "advisory_signals": _advisories,
    "policy_refresh": _policy_refresh,
    "policy_upsert": _policy_upsert,
    "live_upsert": _live_upsert,
    "audit_match": _audit,
    "trap_assertions": lambda s, d: cache.trap_assertions(flow.evaluated(s, d), SENTINEL),
    "sink_state": _state,
    "sink_exports": _exports,
    "incremental_reconcile": _stream,
    "incremental_targets": _stream_targets,
}

# --- SQL ---

_NAMES = ", ".join(f"CASE WHEN json_type(raw, '$.{k}') <> 'NULL' THEN raw->>'$.{k}' END" for k in feeds.NAME_KEYS)
CTES["feed_a"] = "SELECT *, CASE WHEN json_type(p) = 'ARRAY' THEN p {} END AS arr FROM (SELECT source_id, adapter, page_no, CAST(payload AS JSON) AS p FROM fx_feeds)".format(" ".join(f"WHEN json_type(p, '$.{k}') = 'ARRAY' THEN p->'$.{k}'" for k in feeds.RECORD_PATHS))
CTES["feed_r"] = f"""SELECT *, trim(coalesce({_NAMES})) AS name FROM (SELECT source_id, adapter, page_no, i AS ordinal, arr->i AS raw FROM (SELECT *, CAST(unnest(range(0, CAST(json_array_length(arr) AS BIGINT))) AS INTEGER) AS i FROM feed_a))
 WHERE json_type(raw) = 'OBJECT' AND coalesce(raw->>'$.public', 'true') <> 'false'"""
CTES["feed_n"] = "SELECT * FROM feed_r WHERE name <> ''"
_PATHS = " ".join(f"WHEN json_type(raw, '$.{k}') IN ('ARRAY', 'OBJECT') THEN raw->'$.{k}'" for k in feeds.TARGET_PATHS)
CTES["feed_c"] = f"SELECT source_id, page_no, ordinal, CASE WHEN adapter = 'projectdiscovery' THEN raw->'$.domains' ELSE CASE {_PATHS} END END AS c, adapter = 'projectdiscovery' AS plain FROM feed_n"
CTES["feed_l"] = """SELECT source_id, page_no, ordinal, plain, CASE WHEN json_type(c) = 'ARRAY' THEN CAST(c AS JSON[]) ELSE flatten(list_transform(list_sort(json_keys(c)), lambda k: CASE WHEN json_type(c->k) = 'ARRAY' THEN CAST(c->k AS JSON[]) ELSE CAST([] AS JSON[]) END)) END AS l FROM feed_c WHERE c IS NOT NULL"""
_VALUES = ", ".join(f"t->>'$.{k}'" for k in feeds.TARGET_VALUES)
_KINDS = ", ".join(f"t->>'$.{k}'" for k in feeds.TARGET_TYPES)
CTES["feed_t"] = f"""SELECT source_id, page_no, ordinal, target_no, CASE WHEN plain THEN 'domain' WHEN json_type(t) = 'OBJECT' THEN coalesce({_KINDS}) END AS raw_type, trim(CASE WHEN json_type(t) = 'VARCHAR' THEN t->>'$' WHEN json_type(t) = 'OBJECT' THEN coalesce({_VALUES}) END) AS value
 FROM (SELECT *, unnest(l) AS t, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS target_no FROM feed_l)"""


def _sql_told(x: str, path: str) -> str:
    return f"CASE WHEN json_type({x}, '$.{path}') <> 'NULL' THEN {x}->'$.{path}' END"


def _sql_money(x: str, *keys: str) -> tuple[str, str]:
    v = "coalesce(" + ", ".join(_sql_told(x, k) for k in keys) + ")"
    value = f"(CASE WHEN json_type({v}) = 'OBJECT' THEN coalesce({_sql_told(v, 'value')}, {_sql_told(v, 'amount')}, {_sql_told(v, 'max')}) ELSE {v} END)"
    bare = f"regexp_replace({value}->>'$', '[^0-9.-]+', '', 'g')"
    number = f"CASE WHEN json_type({value}) = 'VARCHAR' THEN CASE WHEN {bare} = '' THEN {D(0)} ELSE TRY_CAST({bare} AS DOUBLE) END WHEN json_type({value}) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST({value}->>'$' AS DOUBLE) END"
    return number, f"CASE WHEN json_type({v}) = 'OBJECT' THEN coalesce({_sql_told(v, 'currency')}, {_sql_told(v, 'currency_code')}, {_sql_told(v, 'code')}) END"


_LOW, _HIGH, _PAYOUT = _sql_money("raw", "min_bounty", "minBounty"), _sql_money("raw", "max_bounty", "maxBounty"), _sql_money("raw", "max_payout", "maxPayout")
_SUB_LOW, _SUB_HIGH = _sql_money("sub", "min_bounty", "minimum"), _sql_money("sub", "max_bounty", "maximum")
CTES["feed_m"] = f"""SELECT source_id, page_no, ordinal, coalesce({_LOW[0]}, {_SUB_LOW[0]}) AS min_reward, coalesce({_HIGH[0]}, {_PAYOUT[0]}, {_SUB_HIGH[0]}) AS max_reward,
 coalesce({_LOW[1]}, {_HIGH[1]}, {_PAYOUT[1]}, {_SUB_LOW[1]}, {_SUB_HIGH[1]}, {_sql_told('raw', 'currency')}, {_sql_told('raw', 'currency_code')}) AS c FROM (SELECT *, CASE WHEN json_type(raw, '$.rewards') = 'OBJECT' THEN raw->'$.rewards' END AS sub FROM feed_n)"""
CTES["feed_w"] = f"SELECT source_id, page_no, ordinal, min_reward, max_reward, CASE {' '.join(f'WHEN code = {q(k)} THEN {q(v)}' for k, v in feeds.CURRENCY_SIGNS.items())} WHEN length(code) = 3 THEN code END AS currency FROM (SELECT *, CASE WHEN json_type(c) = 'VARCHAR' THEN upper(trim(c->>'$')) END AS code FROM feed_m)"


def _sql_first(x: str, *keys: str) -> str:
    return "coalesce(" + ", ".join(_sql_told(x, k) for k in keys) + ")"


def _sql_truth(v: str) -> str:
    return f"coalesce(CASE WHEN json_type({v}) = 'BOOLEAN' THEN {v}->>'$' = 'true' WHEN json_type({v}) = 'VARCHAR' THEN {v}->>'$' <> '' WHEN json_type({v}) IN ('ARRAY', 'OBJECT') THEN true WHEN json_type({v}) <> 'NULL' THEN TRY_CAST({v}->>'$' AS DOUBLE) <> 0 END, false)"


def _sql_text(v: str) -> str:
    return f"CASE WHEN json_type({v}) = 'OBJECT' THEN '[object Object]' WHEN json_type({v}) = 'ARRAY' THEN array_to_string({v}->>'$[*]', ',') ELSE {v}->>'$' END"


def _sql_is(v: str, kind: str) -> str:
    return f"CASE WHEN json_type({v}) = '{kind}' THEN {v}->>'$' END"


def _sql_moment(v: str) -> str:
    return f"CASE WHEN json_type({v}) = 'VARCHAR' THEN TRY_CAST(replace(replace({v}->>'$', 'T', ' '), 'Z', '') AS TIMESTAMP) WHEN json_type({v}) IN ('UBIGINT', 'BIGINT') THEN make_timestamp(TRY_CAST({v}->>'$' AS BIGINT) * 1000) END"


def _sql_number(v: str) -> str:
    return f"CASE WHEN json_type({v}) = 'VARCHAR' THEN TRY_CAST(regexp_replace({v}->>'$', '[^0-9.-]+', '', 'g') AS DOUBLE) WHEN json_type({v}) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN TRY_CAST({v}->>'$' AS DOUBLE) END"


CTES["feeding"] = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(str(x) if isinstance(x, int) and not isinstance(x, bool) else literal(x) for x in f) + ")" for f in FEEDS) + ") AS f(source_id, homepage, url_template, paid_only, priority)"
CTES["feed_f"] = f"""SELECT *, {_sql_first('raw', 'submission_state', 'status', 'state', 'program_status')} AS a_status, {_sql_first('raw', 'safe_harbor', 'safeHarbor')} AS a_harbor, {_sql_first('raw', 'allows_disclosure', 'disclosure_allowed', 'disclosureAllowed')} AS a_disclosure,
 {_sql_first('raw', 'url', 'program_url', 'policy_url', 'link')} AS a_url, {_sql_first('raw', 'handle', 'slug', 'id')} AS a_id, {_sql_first('raw', 'offers_bounties', 'offers_awards', 'bounty', 'paid', 'rewarded')} AS a_paid, {_sql_first('raw', 'launched_at', 'started_at', 'created_at', 'createdAt')} AS a_launched,
 {_sql_first('raw', 'resolved_reports', 'reports_resolved', 'resolvedReports', 'valid_reports')} AS a_reports, {_sql_first('raw', 'invite_only', 'inviteOnly', 'private')} AS a_invite, {_sql_first('raw', 'kyc_required', 'kycRequired')} AS a_kyc FROM feed_n"""
_ENCODED = f"url_encode({_sql_text('a_id')})"
for _a, _b in (("+", "%20"), ("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*"), ("%7E", "~")):
    _ENCODED = f"replace({_ENCODED}, '{_a}', '{_b}')"
_POLICY = ", ".join("CASE WHEN " + _sql_truth(f"(raw->'$.{k}')") + " THEN " + _sql_text(f"(raw->'$.{k}')") + " END" for k in ("description", "policy", "rules", "notes", "eligibility"))
_OWN = _POLICY.rpartition(", CASE WHEN coalesce(")[0]
CTES["feed_p"] = f"""SELECT source_id, page_no, ordinal, trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', '-', 'g'), '-') AS merge_key, name,
 CASE WHEN regexp_matches({_sql_is('a_url', 'VARCHAR')}, '(?i)^https?://') THEN a_url->>'$' WHEN url_template IS NOT NULL AND {_sql_truth('a_id')} THEN replace(url_template, '{{id}}', {_ENCODED}) ELSE homepage END AS url,
 CASE WHEN raw->>'$.disabled' = 'true' OR raw->>'$.closed' = 'true' OR regexp_matches(st, '(?i)(closed|disabled|paused|retired|ended|inactive)') THEN 'closed' WHEN st = '' OR regexp_matches(st, '(?i)^(active|enabled|open|opened|public|accepting|live)$') THEN 'open' ELSE lower(st) END AS status,
 CASE WHEN json_type(a_paid) = 'BOOLEAN' THEN a_paid->>'$' = 'true' WHEN coalesce(max_reward, 0) > 0 OR coalesce(min_reward, 0) > 0 THEN true WHEN adapter = 'projectdiscovery' THEN {_sql_truth("(raw->'$.bounty')")} ELSE false END AS paid, currency, min_reward, max_reward,
 CASE WHEN json_type(a_harbor) = 'BOOLEAN' AND a_harbor->>'$' = 'true' THEN 'program-defined' ELSE nullif(lower(trim({_sql_is('a_harbor', 'VARCHAR')})), '') END AS safe_harbor, {_sql_is('a_disclosure', 'BOOLEAN')} = 'true' AS disclosure_allowed, {_sql_moment('a_launched')} AS launched_at, {_sql_number('a_reports')} AS resolved_reports,
 {_sql_truth('a_invite')} AS invite_only, {_sql_truth('a_kyc')} AS kyc_required, CASE WHEN json_type(raw, '$.excluded_countries') = 'ARRAY' THEN array_to_string(raw->>'$.excluded_countries[*]', ',') ELSE '' END AS countries,
 left(concat_ws(' ', {_POLICY}), 100000) AS policy_text, coalesce(priority, 100) AS source_priority, paid_only, concat_ws(' ', {_OWN}) AS own_text, CASE WHEN json_type(raw, '$.excluded_countries') = 'ARRAY' THEN raw->>'$.excluded_countries[*]' ELSE [] END AS listed
 FROM (SELECT *, trim(coalesce({_sql_text('a_status')}, 'open')) AS st FROM feed_f) JOIN feed_w USING (source_id, page_no, ordinal) JOIN feeding USING (source_id)"""
CTES["feed_x"] = f"""SELECT *, {_sql_first('t', 'eligible_for_bounty', 'eligible', 'bounty_eligible')} AS a_may, {_sql_first('t', 'description', 'instructions', 'notes')} AS a_said, {_sql_first('t', 'impact', 'tier', 'severity')} AS a_hurt, {_sql_first('t', 'added_at', 'created_at', 'first_seen_at', 'addedAt')} AS a_added,
 {_sql_first('t', 'asset_type', 'type', 'target_type', 'category')} AS a_type, {_sql_first('t', 'asset_identifier', 'identifier', 'target', 'endpoint', 'uri', 'url', 'name')} AS a_value FROM (SELECT *, unnest(l) AS t, generate_subscripts(l, 1) AS target_no FROM feed_l)"""
CTES["feed_y"] = f"""SELECT source_id, page_no, ordinal, target_no, value, description, impact, added_at, CASE WHEN x IN ('url', 'domain') THEN 'web' ELSE x END AS type FROM (SELECT *, trim(CASE WHEN json_type(t) = 'VARCHAR' THEN t->>'$' ELSE {_sql_text('a_value')} END) AS value,
 CASE WHEN {_sql_truth('a_said')} THEN left({_sql_text('a_said')}, 600) END AS description, CASE WHEN {_sql_truth('a_hurt')} THEN left({_sql_text('a_hurt')}, 120) END AS impact, {_sql_moment('a_added')} AS added_at, CASE WHEN plain THEN 'domain' ELSE coalesce(nullif(lower({_sql_text('a_type')}), ''), 'other') END AS x FROM feed_x WHERE a_may IS NULL OR {_sql_truth('a_may')}) WHERE value <> ''"""
_KEYED = """SELECT *, substr(sha256(type || ':' || lower(regexp_replace(value, '\\s+', ' ', 'g'))), 1, 16) AS target_key FROM feed_y"""
CTES["rec_feed"] = """SELECT *, row_number() OVER (PARTITION BY merge_key ORDER BY source_priority, coalesce(max_reward, 0) DESC, record_no) AS lead_rank FROM (SELECT * EXCLUDE (countries), listed AS countries, source_id || ':' || page_no || ':' || ordinal AS record_no FROM feed_p WHERE paid OR paid_only = false)"""
CTES["dedupe_t_feed"] = f"SELECT source_id || ':' || page_no || ':' || ordinal AS record_no, target_key, 0 AS ordinal, type, value, added_at, description, impact FROM ({_KEYED}) WHERE source_id || ':' || page_no || ':' || ordinal IN (SELECT record_no FROM rec_feed) QUALIFY row_number() OVER (PARTITION BY source_id, page_no, feed_y.ordinal, target_key ORDER BY target_no DESC) = 1".replace("feed_y.ordinal, target_key ORDER", "record_no, target_key ORDER")
for _k, _sql in SNAPSHOT.items():
    CTES[f"{_k}_feed"] = _sql.replace("{s}", "_feed").replace("r.policy_text", "r.own_text") if _k == "texted" else _sql.replace("{s}", "_feed")
CTES["v1_in"] = "SELECT p.*, c.change_type, p.repository_count AS repos, p.target_count % 9 AS age, p.source_code AS src, p.target_count AS tc FROM prog p JOIN chg c ON c.merge_key = p.merge_key"
CTES["v1_points"] = """SELECT *, greatest(2, CASE change_type WHEN 'new_target' THEN 32 WHEN 'new_program' THEN 27 WHEN 'reward_up' THEN 24 WHEN 'reactivated' THEN 22 WHEN 'scope_updated' THEN 18 ELSE 5 END - 3 * age) AS freshness,
 least(22, CASE WHEN m >= 100000 THEN 22 WHEN m >= 50000 THEN 20 WHEN m >= 25000 THEN 18 WHEN m >= 10000 THEN 15 WHEN m >= 5000 THEN 12 WHEN m >= 1000 THEN 8 WHEN m > 0 THEN 4 ELSE 0 END + CASE WHEN min_reward >= 1000 THEN 2 ELSE 0 END) AS reward,
 least(24, CASE WHEN src THEN 14 ELSE 0 END + least(6, 2 * repos) + CASE WHEN list_contains(tags, 'smart-contract') THEN 5 WHEN list_contains(tags, 'api') THEN 4 ELSE 0 END + CASE WHEN local_testing_hint THEN 3 ELSE 0 END + CASE WHEN len(languages) > 0 THEN 2 ELSE 0 END) AS inspectability,
 CASE WHEN paid THEN 6 ELSE 0 END + CASE WHEN status = 'open' THEN 4 ELSE 0 END + CASE WHEN safe_harbor IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN disclosure_allowed THEN 1 ELSE 0 END AS "authorization",
 least(8, CASE WHEN tc <= 3 THEN 5 WHEN tc <= 10 THEN 3 WHEN tc <= 25 THEN 1 ELSE 0 END + CASE WHEN max_reward IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN list_has_any(tags, ['source-code', 'api', 'smart-contract', 'firmware', 'hardware']) THEN 2 ELSE 0 END) AS friction FROM (SELECT *, coalesce(max_reward, 0) AS m FROM v1_in)"""
CTES["v1"] = """SELECT program_id, name, CAST(freshness AS BIGINT) AS freshness, CAST(reward AS BIGINT) AS reward, CAST(inspectability AS BIGINT) AS inspectability, CAST("authorization" AS BIGINT) AS "authorization", CAST(friction AS BIGINT) AS friction, CAST(freshness + reward + inspectability + "authorization" + friction AS BIGINT) AS score,
 coalesce(nullif(array_to_string(list_filter([CASE WHEN change_type <> 'baseline' THEN replace(change_type, '_', ' ') END, CASE WHEN src THEN 'Inspectable source-code scope' WHEN list_contains(tags, 'api') THEN 'Structured API surface' END, CASE WHEN local_testing_hint THEN 'Local, sandbox, or testnet testing language detected' END,
  CASE WHEN m >= 1000 THEN 'Confirmed reward ceiling clears $1,000' END, CASE WHEN tc <= 5 THEN 'Small scope with ' || tc || ' tracked target' || CASE WHEN tc = 1 THEN '' ELSE 's' END END, CASE WHEN safe_harbor IS NOT NULL THEN 'Safe-harbor field is present, verify the official wording' END], lambda x: x IS NOT NULL)[1:5], '; '), ''), 'Paid public program with structured scope data') AS reasons,
 CASE WHEN freshness >= 26 AND inspectability >= 16 AND tc <= 10 THEN 'lower' WHEN freshness >= 18 THEN 'medium' ELSE 'unknown' END AS attention_pressure FROM v1_points"""
CTES["tool_n"] = f"""SELECT repo_key, lower(unnest(regexp_extract_all(x, '{repo.TOOLS}', 1))) AS tool FROM (SELECT repo_key, path AS x FROM fx_tree WHERE {hit('path', repo.WORKFLOW_PATH)} UNION ALL SELECT repo_key, text FROM fx_tree WHERE NOT failed)"""
CTES["tool_r"] = f"""SELECT repo_key, bool_or({hit('path', repo.SECURITY_FILE)}) AS security_md, bool_or({hit('path', repo.FUZZ_PATH)}) AS fuzz_path, bool_or(NOT failed AND {hit('text', repo.FUZZ_FUNCTION)}) AS fuzz_function, count(*) FILTER (WHERE {hit('path', repo.WORKFLOW_PATH)}) AS workflows, bool_or(failed) AS bad FROM fx_tree GROUP BY 1"""
CTES["tooled"] = "SELECT r.*, coalesce(t.tools, '') AS tools FROM tool_r r LEFT JOIN (SELECT repo_key, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools FROM tool_n GROUP BY 1) t ON t.repo_key = r.repo_key"
CTES["adv"] = f"SELECT *, lower(state) IN ('open', 'draft', 'triage') AS o, lower(state) IN ('open', 'draft', 'triage') AND updated_at >= {AT} - INTERVAL 365 DAYS AS recent FROM fx_advisories"
CTES["adv_hit"] = "SELECT DISTINCT t.repo_key FROM fx_tree t JOIN adv a ON a.repo_key = t.repo_key WHERE a.recent AND length(a.package) > 2 AND contains(lower(t.path), lower(a.package))"
CTES["churned"] = "SELECT repo_key, count(DISTINCT path) AS touched, count(DISTINCT path) FILTER (WHERE status = 'added') AS added, coalesce(array_to_string(list_sort(list(DISTINCT path) FILTER (WHERE status = 'added'))[1:40], ','), '') AS forty FROM fx_compare GROUP BY 1"
CTES["advises"] = "SELECT repo_key, count(*) FILTER (WHERE o) AS n_open, count(*) FILTER (WHERE lower(state) IN ('published', 'closed')) AS n_resolved, count(*) AS n_total, repo_key IN (SELECT repo_key FROM adv_hit) AS path_match FROM adv GROUP BY 1"
# a column of a repository that was measured, null for others
_IF = lambda x, name: f"CASE WHEN m.status = 'ok' THEN {x} END AS {name}"
CTES["pub"] = "SELECT m.repo_key, m.status, 'github' AS provider, m.repo_key AS full_name, 'https://github.com/' || m.repo_key AS url, f.age_y, m.default_branch, coalesce(c.touched, 0) >= 300 AS files_90d_truncated, CASE WHEN v.repo_key IS NULL THEN 'unavailable' ELSE 'repository-advisories' END AS advisory_coverage, k.ten_hits AS trap_hits, coalesce(c.forty, '') AS files_added_90d_list, coalesce(t.tools, '') AS security_workflows, array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split(m.languages, ','), lambda x: x <> ''), lambda x: lower(string_split(x, ':')[1])))), ',') AS languages, s.eligible AS scan_eligible, s.selected AS scan_selected, s.bytes AS scan_bytes, " + ", ".join(_IF(x, n) for n, x in {
    "stars": "m.stars", "forks": "m.forks", "contributors": "f.contributors", "releases": "m.releases", "commits_7d": "coalesce(a.commits_7d, 0)", "commits_30d": "coalesce(a.commits_30d, 0)", "commits_90d": "coalesce(a.commits_90d, 0)", "files_touched_90d": "coalesce(c.touched, 0)", "files_added_90d": "coalesce(c.added, 0)",
    "merged_prs_90d": "coalesce(a.merged_prs_90d, 0)", "max_merged_pr_additions_90d": "CAST(coalesce(a.max_additions_90d, 0) AS BIGINT)", "security_md": "coalesce(t.security_md, false)", "fuzz_path": "coalesce(t.fuzz_path, false)", "fuzz_function": "coalesce(t.fuzz_function, false)",
    "sec_tooling": "coalesce(t.security_md OR t.fuzz_path OR t.fuzz_function OR t.tools <> '', false)", "advisories_open": "v.n_open", "advisories_resolved": "v.n_resolved", "advisories_total": "v.n_total", "dev_known": "coalesce(k.dev_known, false)", "security_fix_gated": "coalesce(k.security_fix_gated, false)",
    "advisory_match": "coalesce(v.path_match, false)", "trap_scan_status": "coalesce(s.status, 'unknown')"}.items()) + " FROM fx_repo_meta m LEFT JOIN activity a ON a.repo_key = m.repo_key LEFT JOIN profile f ON f.repo_key = m.repo_key LEFT JOIN churned c ON c.repo_key = m.repo_key LEFT JOIN tooled t ON t.repo_key = m.repo_key LEFT JOIN advises v ON v.repo_key = m.repo_key LEFT JOIN trap_r k ON k.repo_key = m.repo_key LEFT JOIN scanned s ON s.repo_key = m.repo_key"
CTES["pub_t"] = "SELECT e.program_id, e.target_key, e.target_key = b.target_key AS is_best, e.workflow, e.ev_score, e.repo_key AS home, CAST(row_number() OVER (PARTITION BY e.program_id ORDER BY e.target_key = b.target_key DESC, e.ev_score DESC, e.target_key) AS INTEGER) AS position FROM ev e JOIN best b ON b.program_id = e.program_id"
CTES["pcache"] = f"SELECT program_id, CASE WHEN target_count % 4 = 0 THEN 'failed' ELSE 'ok' END AS status, {AT} - to_days(CAST(target_count % 14 AS INTEGER)) AS fetched_at, CASE WHEN target_count % 2 = 0 THEN sha256('policy ' || merge_key) END AS inline_hash, target_count AS reports FROM prog_before"
CTES["pwork"] = f"""SELECT c.program_id, c.change_type, coalesce(k.status = 'ok' AND k.fetched_at > {AT} - INTERVAL 168 HOURS, false) AS fresh, coalesce(x.text IS NOT NULL AND k.inline_hash IS DISTINCT FROM sha256(x.text), false) AS reread, coalesce(x.useful, false) AS useful FROM chg c LEFT JOIN pcache k ON k.program_id = c.program_id LEFT JOIN pown x ON x.program_id = c.program_id"""
CTES["pown"] = "SELECT program_id, 'policy ' || merge_key || CASE WHEN added % 4 = 0 THEN ' pays $2,000 at most for a critical one' WHEN added % 4 = 1 THEN ': 1,204 resolved reports' WHEN removed % 2 = 1 THEN ', low ones are out of scope' ELSE '' END AS text, added % 4 IN (0, 1) OR removed % 2 = 1 AS useful FROM chg WHERE added % 3 = 0"
CTES["pdue"] = "SELECT program_id FROM pwork WHERE NOT (reread AND useful) AND NOT (fresh AND NOT reread) ORDER BY fresh, CASE change_type WHEN 'new_target' THEN 3 WHEN 'new_program' THEN 2 WHEN 'scope_updated' THEN 1 ELSE 0 END DESC, program_id LIMIT 80"
CTES["presult"] = "SELECT program_id, CASE WHEN target_count % 2 = 0 THEN 'failed' WHEN target_count % 9 = 0 THEN 'partial' ELSE 'ok' END AS status, target_count + 1 AS reports FROM prog WHERE target_count % 3 = 0"
CTES["lcache"] = f"SELECT DISTINCT address, CASE WHEN address LIKE '%3' THEN 'pending' ELSE 'ok' END AS status, CASE WHEN address LIKE '%5' THEN {LIVE_AT} - INTERVAL 3 HOURS ELSE {LIVE_AT} - INTERVAL 10 HOURS END AS fetched_at FROM fx_live_tx WHERE right(address, 1) IN ('1', '5', '3')"
CTES["lresult"] = f"SELECT l.address, l.tx_30d, CASE WHEN right(l.address, 1) IN ('1', '2') THEN 'failed' ELSE 'ok' END AS status FROM live l LEFT JOIN lcache c ON c.address = l.address WHERE c.address IS NULL OR c.fetched_at <= {LIVE_AT} - INTERVAL 6 HOURS"

_WAS = f"TIMESTAMP '{BEFORE}'"
CTES["here"] = "SELECT * FROM prog WHERE CAST(substr(merge_key, 9) AS INTEGER) % 37 <> 0"

ORACLES = {k: chain(x) for k, x in {
    "src_feeds": "SELECT source_id, page_no, ordinal, name FROM feed_n",
    "src_nested_targets": "SELECT * FROM feed_t WHERE value <> ''",
    "norm_rewards": "SELECT * FROM feed_w",
    "public_projection": "SELECT t.* EXCLUDE (home), p.* EXCLUDE (repo_key) FROM pub_t t LEFT JOIN pub p ON p.repo_key = t.home WHERE position <= 16",
    "norm_feed_programs": "SELECT * EXCLUDE (paid_only, own_text, listed) FROM feed_p WHERE paid OR paid_only = false",
    "feed_merge": "SELECT program_id, name, platform, url, status, paid, currency, min_reward, max_reward, safe_harbor, disclosure_allowed, invite_only, kyc_required, array_to_string(source_ids, ',') AS source_ids, array_to_string(countries, ',') AS countries, launched_at, resolved_reports, array_to_string(tags, ',') AS tags, array_to_string(languages, ',') AS languages, local_testing_hint, source_code, repository_count, target_count, invite_words FROM prog_feed",
    "feed_merge_targets": "SELECT merge_key, target_key, type, value, description FROM merged_t_feed",
    "norm_feed_targets": r"SELECT source_id, page_no, ordinal, target_key, type, value, description, impact, added_at FROM (SELECT *, substr(sha256(type || ':' || lower(regexp_replace(value, '\s+', ' ', 'g'))), 1, 16) AS target_key FROM feed_y) QUALIFY row_number() OVER (PARTITION BY source_id, page_no, ordinal, target_key ORDER BY target_no DESC) = 1",
    "src_union": "SELECT source_id, record_no, name, source_priority, max_reward FROM fx_records UNION ALL SELECT 'manual', -1, 'By hand', 5, NULL UNION ALL SELECT 'manual', -2, 'Also by hand', 5, NULL",
    "score_programs": "SELECT * EXCLUDE (name) FROM v1",
    "rank_v1": "SELECT program_id, name, score FROM v1",
    "repo_file_churn": "SELECT repo_key, count(DISTINCT path) AS files_touched, count(DISTINCT path) FILTER (WHERE status = 'added') AS files_added, coalesce(array_to_string(list_sort(list(DISTINCT path) FILTER (WHERE status = 'added'))[1:300], ','), '') AS added_list, count(DISTINCT path) >= 300 AS truncated FROM fx_compare GROUP BY 1",
    "repo_tree_top2": "SELECT repo_key, array_to_string(list_sort(list(path))[1:2000], ',') AS paths, count(*) > 2000 AS truncated FROM fx_tree WHERE len(string_split(path, '/')) <= 2 GROUP BY 1",
    "detect_tooling": "SELECT repo_key, security_md, fuzz_path, fuzz_function, workflows, tools, CASE WHEN security_md OR fuzz_path OR fuzz_function OR tools <> '' THEN true WHEN bad THEN NULL ELSE false END AS sec_tooling FROM tooled",
    "advisory_signals": "SELECT repo_key, count(*) FILTER (WHERE o) AS open, count(*) FILTER (WHERE lower(state) IN ('published', 'closed')) AS resolved, count(*) AS total, count(*) FILTER (WHERE recent) AS recent, repo_key IN (SELECT repo_key FROM adv_hit) AS path_match FROM adv GROUP BY 1",
    "policy_refresh": "SELECT program_id, reread, CASE WHEN reread AND useful THEN 'inline' WHEN fresh AND NOT reread THEN 'keep' WHEN program_id IN (SELECT program_id FROM pdue) THEN 'fetch' ELSE 'wait' END AS action FROM pwork",
    "policy_upsert": f"SELECT program_id, CASE WHEN r.status IN ('ok', 'partial') THEN r.status WHEN r.status IS NULL OR c.status = 'ok' THEN c.status ELSE 'pending' END AS status, CASE WHEN r.status IN ('ok', 'partial') THEN {AT} WHEN r.status IS NULL OR c.status = 'ok' THEN c.fetched_at END AS fetched_at, CASE WHEN r.status = 'failed' THEN 'timeout' END AS last_error, CAST(CASE WHEN r.status IN ('ok', 'partial') THEN r.reports WHEN r.status IS NULL OR c.status = 'ok' THEN c.reports END AS BIGINT) AS reports FROM pcache c FULL JOIN presult r USING (program_id)",
    "live_upsert": f"SELECT address, CASE WHEN r.status = 'ok' THEN 'ok' WHEN r.status IS NULL OR c.status = 'ok' THEN c.status ELSE 'pending' END AS status, CASE WHEN r.status = 'ok' THEN {LIVE_AT} WHEN r.status IS NULL OR c.status = 'ok' THEN c.fetched_at END AS fetched_at, CASE WHEN r.status = 'failed' THEN 'no answer' END AS last_error, CASE WHEN r.status = 'ok' THEN right(address, 1) <> '3' WHEN r.status IS NULL OR c.status = 'ok' THEN true END AS deployed, CAST(CASE WHEN r.status = 'ok' THEN r.tx_30d WHEN r.status IS NULL OR c.status = 'ok' THEN 7 END AS BIGINT) AS tx_30d FROM lcache c FULL JOIN lresult r USING (address)",
    "audit_match": "SELECT program_id, target_key, aud.no AS audit_no, CASE WHEN fresh_code_index - fresh_at <= 40 THEN 'audited ' || verdict || ' target: ' || key END AS audit_reason FROM aud JOIN ev USING (program_id, target_key) LEFT JOIN audits ON audits.no = aud.no",
    "trap_assertions": "SELECT * FROM checks",
    "sink_state": "SELECT program_id, name, status, max_reward, CASE WHEN target_count > 0 THEN target_count END AS targets FROM prog",
    "sink_exports": "SELECT name, platform, workflow, ev_score, max_reward, coalesce(max_reward > 50000, false) AS reward_capped, reason, url FROM best",
    "incremental_reconcile": f"""SELECT merge_key, CASE WHEN p.merge_key IS NULL THEN 'stale' ELSE p.status END AS status, CASE WHEN p.merge_key IS NULL THEN o.max_reward ELSE p.max_reward END AS max_reward, CASE WHEN p.merge_key IS NULL THEN o.currency ELSE p.currency END AS currency,
 coalesce(c.change_type, 'baseline') AS change_type, CASE WHEN c.change_type <> 'baseline' THEN {AT} ELSE {_WAS} END AS change_at, CASE WHEN o.merge_key IS NULL THEN {AT} ELSE {_WAS} END AS first_seen_at,
 CASE WHEN c.change_type <> 'baseline' THEN {AT} ELSE {_WAS} END AS last_seen_at, CASE WHEN c.change_type <> 'baseline' THEN {AT} ELSE {_WAS} END AS last_changed_at, CAST(CASE WHEN p.merge_key IS NULL THEN 1 ELSE 0 END AS BIGINT) AS missing_count
 FROM here p FULL JOIN prog_before o USING (merge_key) LEFT JOIN (SELECT c.* FROM chg c JOIN here USING (merge_key)) c USING (merge_key)""",
    "incremental_targets": f"""SELECT merge_key, target_key, coalesce(b.added_at, t.added_at, {AT}) AS first_seen_at FROM (SELECT t.* FROM merged_t t JOIN here USING (merge_key)) t FULL JOIN merged_t_before b USING (merge_key, target_key)
 WHERE t.target_key IS NOT NULL OR merge_key NOT IN (SELECT merge_key FROM here)""",
}.items()}
