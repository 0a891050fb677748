"""DuckDB SQL for each registered query: a chain of common table expressions and a final selection."""

from __future__ import annotations

import re
import unicodedata

from ..operators import evidence as e
from ..sources.fixtures import AUDITED, BEFORE, LIVE_RULES, NOW, NOW_LIVE, OVERRIDES, SOURCES, VIEWS

D = "CAST({} AS DOUBLE)".format


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def literal(x) -> str:
    if isinstance(x, list):
        return "[" + ", ".join(map(literal, x)) + "]"
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else q(x)


def hit(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def up(x: str, places: int) -> str:
    f = D(10**places)
    return f"floor(({x} + CAST(2.220446049250313e-16 AS DOUBLE)) * {f} + {D(0.5)}) / {f}"


def clamp(x: str, low=0, high=1) -> str:
    return f"least({D(high)}, greatest({D(low)}, coalesce({x}, {D(low)})))"


def days(a: str, b: str) -> str:
    return f"(CASE WHEN {a} IS NOT NULL THEN greatest({D(0)}, CAST(epoch_ms({b}) - epoch_ms({a}) AS DOUBLE) / {D(86400000)}) END)"


def joined_texts(*pairs, sep="; ") -> str:
    return f"array_to_string(list_filter([{', '.join(f'CASE WHEN {c} THEN {t} END' for c, t in pairs)}], lambda x: x IS NOT NULL), '{sep}')"


AT, LIVE_AT = f"TIMESTAMP '{NOW}'", f"TIMESTAMP '{NOW_LIVE}'"


def rank_of(x: str) -> str:
    return f"CASE {x} WHEN 'INFORMATIVE' THEN 0 WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END"


CTES: dict[str, str] = {k: x.replace("TIMESTAMP_NTZ", "TIMESTAMP") for k, x in VIEWS.items()}
CTES["norm_t"] = r"""SELECT record_no, ordinal, added_at, description, impact, type, value, substr(sha256(type || ':' || lower(regexp_replace(value, '\s+', ' ', 'g'))), 1, 16) AS target_key FROM
 (SELECT record_no, ordinal, trim(value) AS value, added_at, eligible, substr(description, 1, 600) AS description, substr(impact, 1, 120) AS impact,
  CASE WHEN regexp_matches(x, '(source|repository|github|gitlab)') THEN 'source-code' WHEN regexp_matches(x, '(smart.?contract|blockchain-contract)') THEN 'smart-contract' WHEN regexp_matches(x, '(api|graphql)') THEN 'api'
   WHEN regexp_matches(x, '(android|ios|mobile|apk)') THEN 'mobile' WHEN regexp_matches(x, '(firmware)') THEN 'firmware' WHEN regexp_matches(x, '(hardware|device|iot)') THEN 'hardware'
   WHEN regexp_matches(x, '(executable|binary|desktop)') THEN 'executable' WHEN regexp_matches(x, '(domain|url|website|web-application|wildcard|cidr|ip-address)') THEN 'web' ELSE x END AS type
  FROM (SELECT *, replace(lower(raw_type), '_', '-') AS x FROM fx_targets{s})) WHERE value <> '' AND eligible"""
CTES["dedupe_t"] = "SELECT record_no, target_key, ordinal, type, value, added_at, description, impact FROM (SELECT *, row_number() OVER (PARTITION BY record_no, target_key ORDER BY ordinal DESC, coalesce(description, '') DESC, coalesce(impact, '') DESC) AS n FROM norm_t{s}) WHERE n = 1"
CTES["rec"] = """SELECT *, row_number() OVER (PARTITION BY merge_key ORDER BY source_priority, coalesce(max_reward, 0) DESC, record_no) AS lead_rank FROM
 (SELECT * EXCLUDE (countries), list_filter(string_split(countries, ','), lambda x: x <> '') AS countries, regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', '-', 'g') AS merge_key,
  CASE WHEN regexp_matches(raw_status, '(?i)(closed|disabled|paused|retired|ended|inactive)') THEN 'closed' WHEN regexp_matches(raw_status, '(?i)^(active|enabled|open|opened|public|accepting|live)$') THEN 'open' ELSE lower(raw_status) END AS status,
  coalesce(max_reward, 0) > 0 OR coalesce(min_reward, 0) > 0 AS paid FROM fx_records{s} {w})"""
# Words of a record's text and what they stand for.
TAGS = {
    "ai/ml": r"\bai\b|machine learning|llm",
    "api": r"\bapi\b|graphql",
    "blockchain": r"smart.?contract|blockchain|web3|testnet",
    "firmware": r"firmware",
    "security-tooling": r"security tool|scanner|sast|dependency",
    "source-code": r"source[ -]?code|repository|\brepo\b|github\.com|gitlab\.com|open[ -]?source",
}
LANGUAGES = {
    "solidity": r"\bsolidity\b",
    "rust": r"\brust\b|\.rs\b",
    "go": r"\bgolang\b|\bgo code\b|\.go\b",
    "typescript": r"\btypescript\b|\.tsx?\b",
    "javascript": r"\bjavascript\b|\.jsx?\b",
    "python": r"\bpython\b|\.py\b",
    "java": r"\bjava\b",
    "kotlin": r"\bkotlin\b",
    "swift": r"\bswift\b",
    "c++": r"\bc\+\+\b|\.cpp\b",
    "c": r"\bc language\b|\.c\b",
    "php": r"\bphp\b",
    "ruby": r"\bruby\b",
}
LOCAL = r"local(?:ly)?|testnet|sandbox|docker|self-host|researcher-owned|own account"


def found(x: str, words: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {hit(x, p)} THEN {q(n)} END" for n, p in words.items()) + "], lambda y: y IS NOT NULL)"


CTES["texted"] = """SELECT r.record_no, r.merge_key, coalesce(t.n, 0) AS target_count, coalesce(t.repos, 0) AS repository_count, coalesce(t.types, []) AS types, lower(concat_ws(' ', nullif(r.policy_text, ''), t.x)) AS x FROM rec{s} r
 LEFT JOIN (SELECT record_no, count(*) AS n, count(*) FILTER (WHERE type = 'source-code' OR regexp_matches(value, '(?i)github[.]com|gitlab[.]com')) AS repos, list(DISTINCT type) AS types,
  string_agg(concat_ws(' ', nullif(value, ''), nullif(description, ''), nullif(impact, '')), ' ' ORDER BY target_key) AS x FROM dedupe_t{s} GROUP BY 1) t ON t.record_no = r.record_no"""
CTES["facts"] = f"SELECT record_no, merge_key, target_count, repository_count, list_sort(list_distinct(list_concat(types, {found('x', TAGS)}))) AS tags, {found('x', LANGUAGES)} AS languages, {hit('x', LOCAL)} AS local_testing_hint FROM texted{{s}}"
CTES["ptexts"] = "SELECT merge_key, left(string_agg(trim(policy_text), ' ' ORDER BY lead_rank), 150000) AS policy_text FROM rec{s} WHERE trim(coalesce(policy_text, '')) <> '' GROUP BY 1"
CTES["merged_t"] = "SELECT merge_key, target_key, type, value, added_at, description, impact FROM (SELECT *, row_number() OVER (PARTITION BY merge_key, target_key ORDER BY lead_rank DESC, ordinal DESC) AS n FROM dedupe_t{s} JOIN (SELECT record_no, merge_key, lead_rank FROM rec{s}) USING (record_no)) WHERE n = 1"
CTES["prog"] = """SELECT 'program:' || r.merge_key AS program_id, r.merge_key, l.name, l.source_id AS platform, l.url, CASE WHEN any_open THEN 'open' ELSE l.status END AS status, r.paid, r.currency, r.min_reward, r.max_reward, r.safe_harbor, r.disclosure_allowed,
 r.invite_only, r.kyc_required, r.source_ids, r.countries, r.launched_at, r.resolved_reports, f.tags, f.languages, f.local_testing_hint, f.repository_count, list_contains(f.tags, 'source-code') AS source_code, coalesce(t.n, 0) AS target_count,
 regexp_matches(lower(concat_ws(' ', l.name, x.policy_text)), '\\b(?:invite[- ]only|invitational)\\b') AS invite_words
 FROM (SELECT merge_key, max(CASE WHEN max_reward IS NOT NULL OR min_reward IS NOT NULL THEN coalesce(max_reward, 0) END) AS max_reward, min(CASE WHEN min_reward > 0 THEN min_reward END) AS min_reward,
  (list(currency ORDER BY coalesce(max_reward, 0) DESC, lead_rank) FILTER (WHERE max_reward IS NOT NULL OR min_reward IS NOT NULL))[1] AS currency, bool_or(status = 'open') AS any_open, bool_or(paid) AS paid,
  (list(safe_harbor ORDER BY lead_rank) FILTER (WHERE safe_harbor IS NOT NULL))[1] AS safe_harbor, (list(disclosure_allowed ORDER BY lead_rank) FILTER (WHERE disclosure_allowed IS NOT NULL))[1] AS disclosure_allowed,
  bool_or(invite_only) AS invite_only, bool_or(kyc_required) AS kyc_required, list_sort(list(DISTINCT source_id)) AS source_ids, list_sort(list_distinct(flatten(list(countries)))) AS countries, min(launched_at) AS launched_at, max(resolved_reports) AS resolved_reports FROM rec{s} GROUP BY merge_key) r
 JOIN rec{s} l ON l.merge_key = r.merge_key AND l.lead_rank = 1 LEFT JOIN (SELECT merge_key, count(*) AS n FROM merged_t{s} GROUP BY merge_key) t ON t.merge_key = r.merge_key LEFT JOIN ptexts{s} x ON x.merge_key = r.merge_key
 JOIN (SELECT merge_key, list_sort(list_distinct(flatten(list(tags)))) AS tags, list_sort(list_distinct(flatten(list(languages)))) AS languages, bool_or(local_testing_hint) AS local_testing_hint, max(repository_count) AS repository_count FROM facts{s} GROUP BY 1) f ON f.merge_key = r.merge_key"""
#: The chain of one snapshot: {s} is the snapshot's suffix.
SNAPSHOT = {k: CTES[k] for k in ("texted", "facts", "ptexts", "merged_t", "prog")}
for _k in ("norm_t", "dedupe_t", "rec", "texted", "facts", "ptexts", "merged_t", "prog"):
    _sql = CTES.pop(_k)
    CTES[_k + "_before"] = _sql.replace("{s}", "_before").replace("{w}", "")
    CTES[_k] = _sql.replace("{s}", "").replace("{w}", "")
CTES["diff"] = "SELECT coalesce(a.merge_key, b.merge_key) AS merge_key, count(*) FILTER (WHERE b.target_key IS NULL) AS added, count(*) FILTER (WHERE a.target_key IS NULL) AS removed FROM merged_t a FULL JOIN merged_t_before b ON a.merge_key = b.merge_key AND a.target_key = b.target_key GROUP BY 1"
CTES["chg"] = f"""SELECT *, CASE WHEN change_type <> 'baseline' THEN {AT} END AS change_at FROM (SELECT p.program_id, p.merge_key, coalesce(d.added, 0) AS added, coalesce(d.removed, 0) AS removed, CASE WHEN o.merge_key IS NULL THEN 'new_program' WHEN d.added > 0 THEN 'new_target' WHEN coalesce(p.max_reward, 0) > coalesce(o.max_reward, 0) THEN 'reward_up'
 WHEN o.status <> 'open' AND p.status = 'open' THEN 'reactivated' WHEN d.removed > 0 OR (p.name, p.platform, p.url, p.status, p.paid, p.currency, p.min_reward, p.max_reward, p.safe_harbor, p.disclosure_allowed, p.launched_at, p.resolved_reports, p.invite_only, p.kyc_required, p.countries, p.source_ids, p.tags, p.languages)
 IS DISTINCT FROM (o.name, o.platform, o.url, o.status, o.paid, o.currency, o.min_reward, o.max_reward, o.safe_harbor, o.disclosure_allowed, o.launched_at, o.resolved_reports, o.invite_only, o.kyc_required, o.countries, o.source_ids, o.tags, o.languages) THEN 'scope_updated' ELSE 'baseline' END AS change_type
 FROM prog p LEFT JOIN prog_before o ON o.merge_key = p.merge_key LEFT JOIN diff d ON d.merge_key = p.merge_key)"""
CTES["hosted"] = r"""SELECT target_key, lower(CASE WHEN named THEN regexp_extract(raw, '(?i)^git@(github\.com|gitlab\.com):', 1) ELSE regexp_extract(raw, '(?i)^(?:https?://)?(?:[^/@]*@)?(?:www\.)?(github\.com|gitlab\.com)(?::\d*)?/', 1) END) AS host,
 list_filter(string_split(CASE WHEN named THEN regexp_extract(raw, '(?i)^git@[a-z.]*:(.+?)(?:\.git)?$', 1) ELSE url_decode(regexp_extract(raw, '(?i)^(?:https?://)?(?:[^/@]*@)?(?:www\.)?(?:github\.com|gitlab\.com)(?::\d*)?/(.*)$', 1)) END, '/'), lambda x: x <> '') AS parts
 FROM (SELECT *, regexp_matches(raw, '(?i)^git@(github\.com|gitlab\.com):.') AS named FROM (SELECT DISTINCT target_key, regexp_replace(regexp_replace(trim(value), '[?#].*$', ''), '/+$', '') AS raw FROM merged_t))"""
CTES["hosted_p"] = """SELECT target_key, host, CASE WHEN host = 'github.com' THEN kept[1:2] ELSE kept END AS p FROM (SELECT *, parts[1:coalesce(list_position(list_transform(parts, lambda x: x = '-' OR list_contains(['tree', 'blob', 'commit', 'commits', 'issues', 'pull', 'pulls', 'releases', 'tags'], lower(x))), true) - 1, 1000)] AS kept FROM hosted WHERE host <> '') WHERE len(kept) >= 2"""
CTES["resolved"] = r"""SELECT DISTINCT target_key, CASE WHEN host = 'github.com' THEN '' ELSE 'gitlab.com/' END || lower(array_to_string(q, '/')) AS repo_key FROM (SELECT *, list_append(p[1:len(p) - 1], regexp_replace(p[-1], '(?i)\.git$', '')) AS q FROM hosted_p)
 WHERE len(list_filter(q, lambda x: NOT regexp_full_match(x, '(?i)[a-z0-9._-]+') OR NOT regexp_matches(x, '(?i)[a-z0-9]'))) = 0"""
CTES["activity"] = "SELECT coalesce(c.repo_key, p.repo_key) AS repo_key, coalesce(commits_7d, 0) AS commits_7d, coalesce(commits_30d, 0) AS commits_30d, coalesce(commits_90d, 0) AS commits_90d, coalesce(merged, 0) AS merged_prs_90d, coalesce(largest, 0) AS max_additions_90d FROM (SELECT repo_key, " + ", ".join(f"count(*) FILTER (WHERE committed_at >= {AT} - INTERVAL {n} DAYS AND committed_at <= {AT}) AS commits_{n}d" for n in (7, 30, 90)) + f""" FROM fx_repo_commits GROUP BY repo_key) c
 FULL JOIN (SELECT repo_key, count(*) FILTER (WHERE merged_at >= {AT} - INTERVAL 90 DAYS) AS merged, max(CAST(additions AS DOUBLE)) FILTER (WHERE merged_at >= {AT} - INTERVAL 90 DAYS) AS largest FROM fx_repo_pulls WHERE merged_at IS NOT NULL GROUP BY repo_key) p ON p.repo_key = c.repo_key"""
CTES["profile"] = f"""SELECT m.repo_key, age_y, coalesce(contributors, 0) AS contributors, coalesce(commits, 0) AS commits, m.stars, m.forks, m.releases, array_to_string(list_transform(list_sort(list_filter(list_transform(string_split(m.languages, ','), lambda x: lower(x)), lambda x: x <> '' AND x <> 'python:7')), lambda x: x), ',') AS languages FROM fx_repo_meta m
 LEFT JOIN (SELECT repo_key, {up(days('min(committed_at)', AT) + ' / ' + D(365.25), 1)} AS age_y, count(DISTINCT author) AS contributors, count(*) AS commits FROM fx_repo_commits GROUP BY repo_key) c ON c.repo_key = m.repo_key"""
_FILE = "regexp_extract(path, '[^/]*$')"
_TEST = f"({hit('path', e.TEST_PATH)} AND {hit(_FILE, e.KNOWN_FILE)})"
CTES["blob_p"] = f"SELECT *, CASE WHEN {_TEST} OR {hit('path', e.WORKFLOW_PATH)} OR {hit('path', e.SECURITY_FILE)} OR {hit('path', e.FUZZ_PATH)} THEN 0 WHEN {hit('path', e.HIGH_VALUE)} THEN 1 WHEN {hit('path', e.TEST_PATH)} THEN 2 ELSE 4 END AS priority FROM fx_blobs WHERE size <= 500000 AND {hit('path', e.TEXT_FILE)}"
CTES["picked"] = """SELECT o.repo_key, o.path, o.size FROM (SELECT repo_key, list_reduce(list_prepend({'n': CAST(0 AS BIGINT), 'b': CAST(0 AS BIGINT), 'paths': CAST([] AS VARCHAR[]), 'path': '', 'size': CAST(0 AS BIGINT)},
 list({'n': CAST(0 AS BIGINT), 'b': CAST(0 AS BIGINT), 'paths': CAST([] AS VARCHAR[]), 'path': path, 'size': size} ORDER BY priority, size, path)),
 lambda a, x: CASE WHEN a.n < 400 AND a.b + x.size <= 8000000 THEN {'n': a.n + 1, 'b': a.b + x.size, 'paths': list_append(a.paths, x.path), 'path': '', 'size': CAST(0 AS BIGINT)} ELSE a END) AS r FROM blob_p GROUP BY repo_key) g
 JOIN blob_p o ON o.repo_key = g.repo_key AND list_contains(g.r.paths, o.path)"""
def first_hit(pattern: str) -> tuple[str, str]:
    """Line and text of a pattern's first match in t."""
    before, match = (f"regexp_extract(t, {q('(?s)^(.*?)((?-s)' + pattern + ')')}, {n})" for n in (1, 2))
    return f"CAST(length({before}) - length(replace({before}, chr(10), '')) + 1 AS INTEGER)", f"left(trim(regexp_replace({match}, '\\s+', ' ', 'g')), 180)"


# What a scan looks for in a text.
COMMENT = r"(?i)(?://|#|/\*|\*|<!--|--)\s*.{0,160}?(documents? the vulnerability|known issue|do not use in production|not.{0,10}secure)"
DISABLED = r"(?i)(if\s*\(?\s*false\b|math\.MaxInt64|max_int64|feature.{0,40}(?:disabled|false)|fork.{0,40}(?:never|disabled|max))"
ABOUT_SECURITY = r"(?i)(security|secure|replay|exploit|vuln|attack|signature|auth)"
CTES["scan_t"] = "SELECT repo_key, path, left(text, 500000) AS t FROM fx_blobs"
_ROW = "SELECT repo_key, path, '{}' AS kind, {} AS line, {} AS match FROM {} WHERE {}".format
CTES["traps"] = " UNION ".join((_ROW("test-filename", "CAST(NULL AS INTEGER)", _FILE, "fx_blobs", _TEST), _ROW("test-filename", "CAST(NULL AS INTEGER)", _FILE, "fx_tree", _TEST),
                                _ROW("known-comment", *first_hit(COMMENT), "scan_t", hit("t", COMMENT)), _ROW("disabled-security-flag", *first_hit(DISABLED), "scan_t", hit("t", DISABLED) + " AND " + hit("t", ABOUT_SECURITY))))
CTES["trap_r"] = """SELECT repo_key, least(count(*), 20) AS traps, true AS dev_known, bool_or(kind = 'disabled-security-flag') AS security_fix_gated,
 array_to_string((list(concat_ws(':', kind, path, CAST(line AS VARCHAR), match) ORDER BY kind, path))[1:20], ';') AS trap_hits, array_to_string((list(concat_ws(':', kind, path, CAST(line AS VARCHAR), match) ORDER BY kind, path))[1:10], ';') AS ten_hits FROM traps GROUP BY repo_key"""
_strip = "html"
for _t in ("script", "style", "noscript"):
    _strip = f"regexp_replace({_strip}, '(?is)<{_t}\\b[^>]*>.*?</{_t}>', ' ', 'g')"
_strip = f"regexp_replace({_strip}, '<[^>]+>', ' ', 'g')"
_strip = f"array_to_string(list_transform(string_split(regexp_replace({_strip}, '&#(\\d+);', chr(1) || '\\1' || chr(2), 'g'), chr(1)), lambda p: CASE WHEN contains(p, chr(2)) THEN chr(CAST(string_split(p, chr(2))[1] AS INTEGER)) || string_split(p, chr(2))[2] ELSE p END), '')"
_strip = f"array_to_string(list_transform(string_split(regexp_replace({_strip}, '(?i)&#x([0-9a-f]+);', chr(1) || '\\1' || chr(2), 'g'), chr(1)), lambda p: CASE WHEN contains(p, chr(2)) THEN chr(CAST('0x' || string_split(p, chr(2))[1] AS INTEGER)) || string_split(p, chr(2))[2] ELSE p END), '')"
for _n, _c in (("lt", "'<'"), ("gt", "'>'"), ("quot", "'\"'"), ("apos", "chr(39)"), ("nbsp", "' '"), ("amp", "'&'")):
    _strip = f"regexp_replace({_strip}, '(?i)&{_n};', {_c}, 'g')"
CTES["ptext"] = f"SELECT page_id, url, trim(regexp_replace({_strip}, '\\s+', ' ', 'g')) AS text FROM fx_policy"
CTES["pparts"] = r"SELECT url, page_id, i, parts[i] AS part, parts FROM (SELECT url, page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT url, page_id, string_split(regexp_replace(text, '(?i)\b(low|medium|high|critical)\b', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS parts FROM ptext))"
CTES["rewards"] = f"""SELECT url, severity, max(CAST(regexp_extract(c, '^(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) * CASE WHEN c LIKE '%k' THEN {D(1000)} WHEN c LIKE '%m' THEN {D(1000000)} ELSE {D(1)} END) AS amount FROM
 (SELECT url, upper(string_split(part, chr(2))[1]) AS severity, lower(regexp_replace(CASE WHEN regexp_extract(left(string_split(part, chr(2))[2], 140), {q(e._MONEY)}, 1) <> '' THEN regexp_extract(left(string_split(part, chr(2))[2], 140), {q(e._MONEY)}, 1)
  ELSE regexp_extract_all(right(replace(array_to_string(parts[1:i-1], ''), chr(2), ''), 80), {q(e._MONEY)}, 1)[-1] END, '[,\\s]', '', 'g')) AS c FROM pparts WHERE contains(part, chr(2))) WHERE c IS NOT NULL AND c <> '' GROUP BY url, severity"""
CTES["pfloor"] = f"""SELECT x.url, coalesce(r.f, 'MEDIUM') AS policy_floor, CASE WHEN r.f IS NOT NULL THEN 'scraped-reward-table' ELSE 'scraped-low-exclusion' END AS policy_floor_source FROM ptext x
 LEFT JOIN (SELECT url, arg_min(severity, CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END) AS f FROM rewards WHERE amount >= 1000 GROUP BY url) r ON r.url = x.url WHERE r.f IS NOT NULL OR {hit('x.text', e.LOW_EXCLUDED)}"""
CTES["restrict"] = r"""SELECT url, regexp_matches(text, '(?i)\binvite[- ]only\b|\bprivate program\b|participation is by invitation') AS policy_invite_only,
 regexp_matches(text, '(?i)(?:kyc|know your customer|identity verification).{0,80}(?:required|mandatory|must)|(?:required|mandatory|must).{0,80}(?:kyc|identity verification)') AS policy_kyc,
 regexp_matches(text, '(?i)(?:india|indian).{0,100}(?:not eligible|ineligible|excluded|prohibited|cannot participate|not available)|(?:not eligible|ineligible|excluded|prohibited|cannot participate|not available).{0,100}(?:india|indian)') AS excludes_in,
 regexp_matches(text, '(?i)\bno safe harbou?r\b|safe harbou?r does not apply') AS no_safe_harbor,
 CASE WHEN regexp_matches(text, '(?i)([0-9][0-9,]*)\s+(?:resolved|triaged|valid)\s+reports?') THEN CAST(replace(regexp_extract(text, '(?i)([0-9][0-9,]*)\s+(?:resolved|triaged|valid)\s+reports?', 1), ',', '') AS BIGINT)
  ELSE TRY_CAST(replace(regexp_extract(text, '(?i)(?:resolved|triaged|valid)\s+reports?\D{0,12}([0-9][0-9,]*)', 1), ',', '') AS BIGINT) END AS policy_reports FROM ptext"""
CTES["live"] = f"SELECT address, count(*) FILTER (WHERE ts >= {LIVE_AT} - INTERVAL 30 DAYS) AS tx_30d, max(ts) AS last_activity FROM fx_live_tx GROUP BY address"
CTES["over"] = "SELECT * FROM (VALUES {}) AS o(key, floor, eligible, eligibility_reason, invite_only, kyc_required, countries, no_safe_harbor, safe_harbor_required)".format(", ".join("(" + ", ".join(literal(x) for x in o) + ")" for o in OVERRIDES))
CTES["ovr"] = "SELECT program_id, o.* EXCLUDE (key) FROM (SELECT program_id, arg_min(o, r) AS o FROM (SELECT p.program_id, o, CASE o.key WHEN p.program_id THEN 0 WHEN p.name THEN 1 ELSE 2 END AS r FROM prog p JOIN over o ON o.key IN (p.program_id, p.name, lower(p.name))) GROUP BY 1)"
CTES["fallback"] = "SELECT merge_key, program_id || ':policy' AS target_key, CASE WHEN list_contains(tags, 'api') THEN 'api' ELSE 'web' END AS type, url AS value FROM prog WHERE target_count = 0"
CTES["seen"] = f"SELECT t.merge_key, t.target_key, coalesce(CASE WHEN o.target_key IS NOT NULL THEN TIMESTAMP '{BEFORE}' END, t.added_at, {AT}) AS first_seen_at FROM merged_t t LEFT JOIN merged_t_before o ON o.merge_key = t.merge_key AND o.target_key = t.target_key"
CTES["all_t"] = "SELECT merge_key, target_key, type, value, added_at, description, impact, first_seen_at FROM merged_t JOIN seen USING (merge_key, target_key) UNION ALL SELECT merge_key, target_key, type, value, NULL, NULL, NULL, NULL FROM fallback"
CTES["churn"] = "SELECT repo_key, count(DISTINCT path) FILTER (WHERE status = 'added') AS files_added_90d, list_sort(list(DISTINCT path) FILTER (WHERE status = 'added'))[1:300] AS added_list FROM fx_compare GROUP BY 1"
CTES["top2"] = "SELECT repo_key, list_sort(list(path))[1:2000] AS top_paths FROM fx_tree WHERE len(string_split(path, '/')) <= 2 GROUP BY 1"
CTES["toolset"] = r"""SELECT repo_key, CASE WHEN bool_or(regexp_matches(path, '(?i)(^|/)security\.md$') OR regexp_matches(path, '(?i)(^|/)(oss-fuzz[^/]*|fuzz(?:ing|ers?)?)(/|$)|(^|/)[^/]*(?:_fuzz\.|fuzz[^/]*\.)')
  OR (NOT failed AND regexp_matches(text, '\b(?:func\s+Fuzz[A-Za-z0-9_]*|Fuzz[A-Za-z0-9_]*\s*\(|LLVMFuzzerTestOneInput\s*\()')) OR (NOT failed AND regexp_matches(text, '(?i)(codeql|semgrep|snyk|trivy)'))
  OR (regexp_matches(path, '(?i)^\.github/workflows/.*\.ya?ml$') AND regexp_matches(path, '(?i)(codeql|semgrep|snyk|trivy)'))) THEN true WHEN bool_or(failed) THEN NULL ELSE false END AS sec_tooling FROM fx_tree GROUP BY 1"""
CTES["advised"] = f"""SELECT a.repo_key, count(*) FILTER (WHERE lower(state) IN ('published', 'closed')) AS resolved, coalesce(bool_or(lower(state) IN ('open', 'draft', 'triage') AND updated_at >= {AT} - INTERVAL 365 DAYS AND length(package) > 2
  AND EXISTS (SELECT 1 FROM fx_tree t WHERE t.repo_key = a.repo_key AND contains(lower(t.path), lower(a.package)))), false) AS path_match FROM fx_advisories a GROUP BY 1"""
CTES["signal"] = """SELECT m.repo_key, true AS known, m.status, CASE WHEN ok THEN m.stars END AS stars, CASE WHEN ok THEN m.default_branch END AS default_branch, CASE WHEN ok THEN m.spoken ELSE [] END AS languages, CASE WHEN ok THEN c.files_added_90d END AS files_added_90d,
  CASE WHEN ok THEN coalesce(c.added_list, []) ELSE [] END AS added_list, CASE WHEN ok THEN coalesce(p.top_paths, []) ELSE [] END AS top_paths, ok AND coalesce(s.sec_tooling, false) AS sec_tooling, CASE WHEN ok THEN coalesce(d.resolved, 0) ELSE 0 END AS advisories_resolved,
  ok AND coalesce(d.path_match, false) AS advisory_match, CASE WHEN ok THEN a.commits_90d END AS commits_90d, CASE WHEN ok THEN a.max_additions_90d END AS max_additions_90d, CASE WHEN ok THEN f.age_y END AS age_y, CASE WHEN ok THEN f.contributors END AS contributors,
  ok AND coalesce(k.dev_known, false) AS dev_known, ok AND coalesce(k.security_fix_gated, false) AS security_fix_gated
  FROM (SELECT *, status = 'ok' AS ok, list_distinct(list_transform(list_filter(string_split(languages, ','), lambda x: x <> ''), lambda x: lower(string_split(x, ':')[1]))) AS spoken FROM fx_repo_meta) m LEFT JOIN churn c ON c.repo_key = m.repo_key LEFT JOIN top2 p ON p.repo_key = m.repo_key LEFT JOIN toolset s ON s.repo_key = m.repo_key LEFT JOIN advised d ON d.repo_key = m.repo_key
  LEFT JOIN activity a ON a.repo_key = m.repo_key LEFT JOIN profile f ON f.repo_key = m.repo_key LEFT JOIN trap_r k ON k.repo_key = m.repo_key"""
CTES["j"] = """SELECT t.target_key, t.type, t.value, t.added_at, t.first_seen_at, p.* EXCLUDE (languages), p.languages AS spoken, c.change_type, c.change_at, x.repo_key, s.* EXCLUDE (repo_key, known, status, languages, sec_tooling, advisory_match, dev_known, security_fix_gated, advisories_resolved), coalesce(s.languages, []) AS languages,
 coalesce(s.sec_tooling, false) AS sec_tooling, coalesce(s.advisory_match, false) AS advisory_match, coalesce(s.advisories_resolved, 0) AS advisories_resolved, coalesce(s.dev_known, false) AS dev_known, coalesce(s.security_fix_gated, false) AS security_fix_gated,
 ov.* RENAME (program_id AS o_program, floor AS o_floor, eligible AS o_eligible, eligibility_reason AS o_reason, invite_only AS o_invite, kyc_required AS o_kyc, countries AS o_countries, no_safe_harbor AS o_no_harbor, safe_harbor_required AS o_harbor),
 o.policy_floor_source, l.tx_30d, l.tx_30d IS NOT NULL AS deployed, coalesce(s.status, CASE WHEN x.repo_key IS NOT NULL THEN 'pending' END) AS repo_status,
 coalesce(r.policy_invite_only, false) AS policy_invite_only, coalesce(r.policy_kyc, false) AS policy_kyc, coalesce(r.excludes_in, false) AS excludes_in, coalesce(r.no_safe_harbor, false) AS no_safe_harbor, r.policy_reports, o.policy_floor,
 lower(array_to_string(list_filter(list_concat([x.repo_key, s.default_branch], coalesce(s.languages, []), coalesce(s.top_paths, []), coalesce(s.added_list, [])), lambda y: y <> ''), ' ')) AS repo_text,
 lower(array_to_string(list_filter(list_concat([p.name, t.type, t.value, t.description, t.impact], p.tags, p.languages), lambda y: y <> ''), ' ')) AS own_text
 FROM all_t t JOIN prog p USING (merge_key) LEFT JOIN ovr ov ON ov.program_id = p.program_id JOIN chg c ON c.merge_key = t.merge_key LEFT JOIN restrict r ON r.url = p.url LEFT JOIN pfloor o ON o.url = p.url LEFT JOIN resolved x ON x.target_key = t.target_key AND t.type = 'source-code'
 LEFT JOIN signal s ON s.repo_key = x.repo_key LEFT JOIN live l ON l.address = t.value AND t.type = 'smart-contract'"""
# Patterns over a target's search text.
WORDS = {
    "mature_core": r"crypto|signing|mpc|consensus|kernel|tls|wallet[-_ ]?core",
    "parser": r"parser|serializer|codec|deseriali[sz]e|rlp|protobuf",
    "crypto": r"crypto|signing|signature|mpc|nonce|keystore|hsm|consensus|wallet[-_ ]?core",
    "auth": r"oauth|oidc|saml|session|jwt|login|account[-_ ]?link|sso|authentication",
    "authz": r"idor|bola|multi[-_ ]?tenant|rbac|k8s[-_ ]?operator|operator|iam|authorization",
    "ai": r"(^|[^a-z])(ai|ml|llm|rag|mcp)([^a-z]|$)|agent|prompt[-_ ]?inject",
    "contract": r"solidity|defi|smart[-_ ]?contract|\bevm\b|vault",
    "payments": r"payments?|checkout|billing|store|entitlement|subscription|invoice|cart",
    "untrusted": r"network|packet|socket|upload|file|wire|request|remote|untrusted|p2p",
}
twice = "concat_ws(' ', text, nullif(repo_text, ''))"
CTES["marked"] = "SELECT *, " + ", ".join(f"{hit('text', p)} AS x_{n}" for n, p in WORDS.items()) + f", {hit(twice, WORDS['mature_core'])} AS x_mature, list_transform(list_concat(languages, spoken), lambda x: lower(x)) AS every FROM (SELECT *, concat_ws(' ', own_text, nullif(repo_text, '')) AS text FROM j)"
CTES["e1"] = f"""SELECT *, CASE WHEN repo_status = 'ok' THEN {up(clamp(f"least({D(30)}, CAST(stars AS DOUBLE) / {D(300)}) + CASE WHEN sec_tooling THEN 20 ELSE 0 END + CASE WHEN age_y > 4 THEN 15 ELSE 0 END + CASE WHEN contributors > 100 THEN 15 ELSE 0 END + CASE WHEN advisories_resolved >= 3 THEN 10 ELSE 0 END + CASE WHEN x_mature THEN 10 ELSE 0 END", 0, 100), 1)} END AS hardening_index,
 CASE change_type WHEN 'baseline' THEN false WHEN 'new_program' THEN true ELSE coalesce((change_type = 'new_target' AND first_seen_at = change_at) OR {days('coalesce(added_at, first_seen_at)', AT)} < 45, false) END AS recent_scope,
 CASE WHEN dev_known THEN 40 ELSE 0 END + CASE WHEN advisory_match THEN 30 ELSE 0 END + CASE WHEN security_fix_gated THEN 30 ELSE 0 END AS known_issue_risk, repo_status IS NOT NULL OR regexp_matches(value, '(?i)github[.]com|gitlab[.]com') AS repo FROM marked"""
CTES["e2"] = f"""SELECT *, {up(clamp(f"CASE WHEN repo_status = 'ok' THEN least({D(35)}, CAST(coalesce(commits_90d, 0) AS DOUBLE) / {D(2)}) + least({D(25)}, CAST(coalesce(files_added_90d, 0) AS DOUBLE) * {D(3)}) + CASE WHEN max_additions_90d > 800 THEN 20 ELSE 0 END ELSE 0 END + CASE WHEN recent_scope THEN 20 ELSE 0 END", 0, 100), 1)} AS fresh_code_index,
 CASE WHEN type = 'smart-contract' OR (x_contract AND deployed) THEN 'live-contract' WHEN NOT repo AND x_ai THEN 'ai-agent' WHEN NOT repo AND (type = 'api' OR {hit('value', '(?i)(^|[./_-])api([./_-]|$)')}) THEN 'live-api'
  WHEN NOT repo AND type IN ('web', 'domain', 'url', 'mobile') THEN 'live-web' WHEN repo OR type IN ('source-code', 'firmware', 'hardware', 'executable', 'binary') THEN 'static-source' WHEN {hit('value', '(?i)^https?://')} THEN 'live-web' WHEN {hit('value', '(?i)^(?:[*][.])?[a-z0-9-]+(?:[.][a-z0-9-]+)+(?::[0-9]+)?(?:/|$)')} THEN 'live-web'
  WHEN x_contract THEN 'live-contract' ELSE 'static-source' END AS base_workflow FROM e1"""
_LIVE = "(base_workflow LIKE 'live-%' OR base_workflow = 'ai-agent')"
CTES["e3"] = f"""SELECT *, CASE WHEN {_LIVE} AND x_auth THEN 'account-takeover' WHEN {_LIVE} AND x_authz THEN 'cross-tenant-authz' WHEN base_workflow = 'ai-agent' OR ({_LIVE} AND x_ai) THEN 'agent-sink-chain'
 WHEN base_workflow = 'live-contract' OR (x_contract AND deployed) THEN 'contract-loss' WHEN {_LIVE} AND x_payments THEN 'business-logic' WHEN x_parser AND list_has_any(every, ['c', 'c++', 'cpp']) AND x_untrusted THEN 'native-parser-memory' WHEN x_parser AND list_has_any(every, ['go', 'rust']) THEN 'managed-parser-dos' WHEN x_parser THEN 'parser-dos' WHEN x_crypto THEN 'mature-crypto-core'
 WHEN base_workflow = 'live-api' THEN 'api-authz' WHEN base_workflow = 'live-web' THEN 'web-business-logic' ELSE 'source-review' END AS findable_class FROM e2"""
CTES["classes"] = """SELECT findable_class, ceiling, CAST(fit AS DOUBLE) AS fit, label FROM (VALUES ('account-takeover', 'CRITICAL', 0.95, 'ATO'), ('cross-tenant-authz', 'CRITICAL', 0.90, 'cross-tenant'), ('agent-sink-chain', 'HIGH', 0.65, 'exfil/SSRF'),
 ('contract-loss', 'CRITICAL', 0.55, 'contract loss'), ('business-logic', 'CRITICAL', 0.85, 'price/authz'), ('native-parser-memory', 'HIGH', 0.62, 'memory corruption'), ('managed-parser-dos', 'LOW', 0.90, 'DoS'), ('parser-dos', 'MEDIUM', 0.72, 'parser DoS'),
 ('mature-crypto-core', 'CRITICAL', 0.08, 'crypto break'), ('api-authz', 'HIGH', 0.82, 'API authz'), ('web-business-logic', 'HIGH', 0.80, 'web authz'), ('source-review', 'MEDIUM', 0.38, 'source flaw')) AS t(findable_class, ceiling, fit, label)"""
CTES["e4"] = f"""SELECT e3.*, ceiling, fit, label, CASE WHEN w = 'static-source' AND coalesce(hardening_index >= 55, false) AND fresh_code_index < 40 THEN 'static-source-hardened' ELSE w END AS workflow, coalesce(o_floor, policy_floor, 'MEDIUM') AS floor_,
 CASE WHEN o_floor IS NOT NULL THEN 'override' WHEN policy_floor IS NOT NULL THEN policy_floor_source ELSE 'conservative-default' END AS floor_source, greatest(0, coalesce(resolved_reports, policy_reports, 25)) AS reports, resolved_reports IS NULL AND policy_reports IS NULL AS reports_estimated,
 {joined_texts(('NOT paid', q('program is not confirmed paid')), ("status <> 'open'", q('program is not open')), ('o_eligible = false', "coalesce(o_reason, 'program override marks researcher ineligible')"), ('invite_only OR policy_invite_only OR coalesce(o_invite, false) OR invite_words', q('invite-only program')),
  ('kyc_required OR policy_kyc OR coalesce(o_kyc, false)', q('KYC required')), ("excludes_in OR coalesce(list_contains(list_transform(o_countries, lambda x: upper(x)), 'IN'), false)", q('IN researchers excluded')),
  ("coalesce(o_harbor, false) AND (coalesce(o_no_harbor, false) OR no_safe_harbor) AND NOT (w = 'static-source' AND NOT (coalesce(hardening_index >= 55, false) AND fresh_code_index < 40))", q('required safe harbor is absent')))} AS reasons
 FROM (SELECT e3.*, c.ceiling, c.fit, c.label, CASE e3.findable_class WHEN 'agent-sink-chain' THEN 'ai-agent' WHEN 'contract-loss' THEN 'live-contract' ELSE base_workflow END AS w FROM e3 JOIN classes c USING (findable_class)) e3""".replace("e3.*, ceiling, fit, label, CASE WHEN w", "e3.*, CASE WHEN w")
CTES["e5"] = f"""SELECT *, {up(clamp(f"{D(0.2)} + {D(0.5)} * CASE WHEN {days('launched_at', AT)} < 90 THEN 1 ELSE 0 END + {D(0.3)} * CASE WHEN reports = 0 THEN {D(1)} ELSE least({D(1)}, {D(1)} / ln(CAST(1 + reports AS DOUBLE))) END"), 3)} AS p_first,
 {up(clamp(clamp(f"{D(0.15)} + {D(0.45)} * (fresh_code_index / {D(100)}) + coalesce({D(0.30)} * (({D(100)} - hardening_index) / {D(100)}), {D(0)}) + {D(0.10)} * fit") + f" * CASE WHEN findable_class = 'mature-crypto-core' THEN {D(0.2)} ELSE {D(1)} END * CASE WHEN workflow = 'static-source-hardened' THEN {D(0.45)} ELSE {D(1)} END * CASE WHEN workflow = 'static-source' AND fresh_code_index < 50 THEN CASE WHEN repo_status = 'ok' THEN {D(0.7)} ELSE {D(0.3)} END ELSE {D(1)} END"), 3)} AS p_findable,
 {up(f"CAST(CASE WHEN {rank_of('ceiling')} >= {rank_of('floor_')} THEN 1 ELSE 0 END AS DOUBLE) * ({D(1)} - CAST(known_issue_risk AS DOUBLE) / {D(100)}) * CASE WHEN reasons = '' THEN 1 ELSE 0 END", 3)} AS p_payable,
 workflow = 'live-contract' AND deployed AND coalesce(tx_30d = 0, false) AS dormant FROM e4"""
def _plain(x: str) -> str:
    return re.sub("[^a-z0-9]+", " ", "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower()).strip()


_SQL_PLAIN = "trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', ' ', 'g'))".format
CTES["aliased"] = "SELECT * FROM (VALUES " + ", ".join(f"({no}, {q(_plain(a))})" for no, key, more, *_ in AUDITED for a in [key, *more]) + ") AS t(no, alias)"
CTES["audits"] = "SELECT * FROM (VALUES " + ", ".join(f"({no}, {q(key)}, {q(verdict)}, {D(at)})" for no, key, _, verdict, at in AUDITED) + ") AS t(no, key, verdict, fresh_at)"
CTES["aud_in"] = f"""SELECT program_id, target_key, {_SQL_PLAIN('substr(program_id, 9)')} AS a, {_SQL_PLAIN('name')} AS b, CASE WHEN repo_key IS NOT NULL OR regexp_matches(value, '(?i)github[.]com|gitlab[.]com') THEN {_SQL_PLAIN('value')} ELSE '' END AS c,
 {_SQL_PLAIN("coalesce(repo_key, '')")} AS d FROM j"""
CTES["aud"] = "SELECT program_id, target_key, min(no) AS no FROM aud_in LEFT JOIN aliased ON a = alias OR starts_with(a, alias || ' ') OR b = alias OR starts_with(b, alias || ' ') OR contains(c, alias) OR contains(d, alias) GROUP BY 1, 2"
CTES["e6"] = f"""SELECT *, nullif({joined_texts(
    (f"findable_class = 'managed-parser-dos' AND {rank_of('floor_')} > 1", "ceiling || ' DoS ceiling is below the ' || floor_ || ' program floor'"), (f"NOT (findable_class = 'managed-parser-dos' AND {rank_of('floor_')} > 1) AND {rank_of('ceiling')} < {rank_of('floor_')}", "ceiling || ' severity ceiling is below the ' || floor_ || ' program floor'"), ('hardening_index > 70 AND fresh_code_index < 25', q('mature hardened source with little fresh code')),
    ('known_issue_risk >= 60', q('known-issue risk is 60 or higher')), ("reasons <> ''", 'reasons'), ('dormant', q('deployed contract surface has zero recent use or value')), ("aud_key IS NOT NULL AND fresh_code_index - aud_fresh <= 40", "'audited ' || aud_verdict || ' target: ' || aud_key"))}, '') AS exclude_reason,
 {joined_texts(('dev_known', q('DEV_KNOWN')), (f"findable_class = 'managed-parser-dos' AND {rank_of('floor_')} > 1", q('DOS_CEILING')), ('dormant', q('DORMANT')), sep=',')} AS trap_tags, least(greatest({D(0)}, coalesce(max_reward, 0)), {D(50000)}) AS effective_reward FROM (SELECT e5.*, k.key AS aud_key, k.verdict AS aud_verdict, k.fresh_at AS aud_fresh FROM e5 LEFT JOIN aud ON aud.program_id = e5.program_id AND aud.target_key = e5.target_key LEFT JOIN audits k ON k.no = aud.no)"""
CTES["ev"] = f"""SELECT *, floor_ AS floor, CASE WHEN exclude_reason IS NOT NULL THEN {D(0)} ELSE {up('effective_reward * p_findable * p_payable * p_first', 2)} END AS ev_score,
 array_to_string(list_filter([CASE WHEN fresh_code_index >= 50 THEN 'fresh code' WHEN recent_scope THEN 'fresh scope' END, replace(workflow, '-', ' '), label || ' ceiling ' || ceiling, CASE WHEN repo_status = 'ok' AND hardening_index < 35 THEN 'low hardening signal' WHEN repo_status = 'ok' AND hardening_index >= 60 THEN 'mature review surface' END,
  CASE WHEN NOT reports_estimated AND reports < 10 THEN 'low recorded crowd' END, CASE WHEN files_added_90d > 0 THEN CAST(files_added_90d AS VARCHAR) || ' files added/90d' END], lambda x: x IS NOT NULL)[1:5], ' + ') AS reason FROM e6"""
CTES["best"] = "SELECT *, count(*) OVER (PARTITION BY program_id) AS targets FROM ev QUALIFY row_number() OVER (PARTITION BY program_id ORDER BY exclude_reason IS NOT NULL, ev_score DESC, p_findable DESC, target_key) = 1"
CTES["lane"] = "SELECT * FROM best WHERE exclude_reason IS NULL AND ev_score > 0"


def chain(select: str) -> str:
    """select behind the expressions that it needs, found by name."""
    need, todo = set(), [select]
    while todo:
        text = todo.pop()
        for k in CTES:
            if k not in need and re.search(rf"(?:FROM|JOIN) {k}\b", text):
                need.add(k)
                todo.append(CTES[k])
    order: list[str] = []

    def place(k: str) -> None:
        for x in CTES:
            if x != k and x in need and x not in order and re.search(rf"(?:FROM|JOIN) {x}\b", CTES[k]):
                place(x)
        if k not in order:
            order.append(k)

    for k in CTES:
        if k in need:
            place(k)
    return "WITH " + ",\n".join(f"{k} AS MATERIALIZED ({CTES[k]})" for k in order) + "\n" + select


SENTINEL = "brand12/none"
CTES["checks"] = f"SELECT count(*) FILTER (WHERE s) AS sentinels, count(*) FILTER (WHERE m) AS managed, count(*) FILTER (WHERE s) = 0 OR count(*) FILTER (WHERE s AND repo_status = 'ok' AND contains(trap_tags, 'DEV_KNOWN')) > 0 AS sentinel_ok, count(*) FILTER (WHERE m AND NOT contains(trap_tags, 'DOS_CEILING')) = 0 AS ceiling_ok, sentinel_ok AND ceiling_ok AS ready FROM (SELECT *, coalesce(repo_key = {q(SENTINEL)}, false) AS s, findable_class = 'managed-parser-dos' AND floor IN ('MEDIUM', 'HIGH', 'CRITICAL') AS m FROM ev)"

_T = "SELECT program_id, target_key, {} FROM ev"
_S = "SELECT program_id, name, workflow, ev_score, reason FROM lane WHERE {} ORDER BY ev_score DESC, name, program_id LIMIT 25"
ORACLES = {k: chain(s) for k, s in {
    "norm_targets": "SELECT record_no, ordinal, target_key, type, value, description, impact FROM norm_t",
    "dedupe_targets": "SELECT record_no, target_key, ordinal, type, value, description, impact FROM dedupe_t",
    "merge_lead": "SELECT program_id, name, platform, url FROM prog",
    "merge_rewards": "SELECT program_id, min_reward, max_reward, currency FROM prog",
    "merge_flags": "SELECT program_id, status, paid, invite_only, kyc_required, safe_harbor, disclosure_allowed, source_code, local_testing_hint, invite_words FROM prog",
    "merge_sets": "SELECT program_id, array_to_string(source_ids, ',') AS source_ids, array_to_string(tags, ',') AS tags, array_to_string(languages, ',') AS languages, array_to_string(countries, ',') AS countries, repository_count, target_count FROM prog",
    "merge_targets": "SELECT merge_key, target_key, type, value FROM merged_t",
    "merge_dates": "SELECT program_id, launched_at, CAST(resolved_reports AS BIGINT) AS resolved_reports FROM prog",
    "merge_policy_text": "SELECT merge_key, length(policy_text) AS length, sha256(policy_text) AS text_sha256 FROM ptexts",
    "diff_targets": "SELECT merge_key, added, removed FROM diff",
    "classify_change": "SELECT c.program_id, CASE WHEN c.change_type = 'baseline' AND o.target_count % 2 = 0 THEN 'reward_up' ELSE c.change_type END AS change_type, CASE WHEN c.change_type <> 'baseline' THEN c.change_at WHEN o.merge_key IS NOT NULL THEN TIMESTAMP '" + BEFORE + "' END AS change_at, added, removed, c.change_type <> 'baseline' AS is_new FROM chg c LEFT JOIN prog_before o ON o.merge_key = c.merge_key",
    "missing_grace": "SELECT program_id, 'stale' AS status, CAST(1 AS BIGINT) AS missing_count FROM prog_before WHERE merge_key NOT IN (SELECT merge_key FROM prog WHERE CAST(substr(merge_key, 9) AS INTEGER) % 37 <> 0)",
    "change_events": f"SELECT '{NOW}:' || program_id || ':' || change_type AS event_id, program_id, change_type FROM chg WHERE change_type <> 'baseline'",
    "repo_resolve": "SELECT target_key, repo_key FROM resolved",
    "repo_activity": "SELECT * FROM activity",
    "repo_profile": "SELECT * FROM profile",
    "scan_priority_pick": "SELECT * FROM picked",
    "detect_traps": "SELECT * FROM traps",
    "trap_rollup": "SELECT * EXCLUDE (ten_hits) FROM trap_r",
    "policy_text": "SELECT url, sha256(text) AS text_sha256 FROM ptext",
    "policy_rewards": "SELECT url, severity, amount FROM rewards",
    "policy_floor": "SELECT * FROM pfloor",
    "policy_restrictions": "SELECT * FROM restrict",
    "live_activity": "SELECT * FROM live",
    "hardening_index": _T.format("hardening_index"), "fresh_code_index": _T.format("fresh_code_index"), "known_issue_risk": _T.format("known_issue_risk"), "recent_scope": _T.format("recent_scope"),
    "workflow_route": _T.format("base_workflow, workflow"), "findable_class": _T.format("findable_class, ceiling, label"), "policy_floor_resolve": _T.format("floor, floor_source"), "eligibility": _T.format("reasons"),
    "p_first": _T.format("p_first, reports_estimated"), "p_findable": _T.format("p_findable"), "p_payable": _T.format("p_payable"), "dormant": _T.format("dormant"), "hard_exclusions": _T.format("exclude_reason"),
    "trap_tags": _T.format("trap_tags"), "ev_score": _T.format("effective_reward, ev_score"), "reason_text": _T.format("reason"),
    "evaluate_targets": _T.format("workflow, findable_class, ceiling, floor, hardening_index, fresh_code_index, known_issue_risk, p_findable, p_payable, p_first, ev_score, exclude_reason, reason"),
    "best_target": "SELECT program_id, target_key, targets, workflow, ev_score, exclude_reason FROM best",
    "program_traps": "SELECT p.program_id, coalesce(string_agg(DISTINCT x.t, ',' ORDER BY x.t), '') AS traps FROM (SELECT DISTINCT program_id FROM ev) p LEFT JOIN (SELECT program_id, unnest(string_split(trap_tags, ',')) AS t FROM ev WHERE trap_tags <> '') x ON x.program_id = p.program_id GROUP BY 1",
    "rank_programs": "SELECT program_id, name, ev_score, p_findable FROM best",
    "lane_filter": "SELECT program_id, workflow, ev_score FROM lane WHERE workflow <> 'static-source-hardened'",
    "shortlist": _S.format("workflow <> 'static-source-hardened'"),
    "shortlist_live": _S.format("workflow IN ('live-web', 'live-api', 'live-contract', 'ai-agent')"),
    "shortlist_fresh_source": _S.format("fresh_code_index > 50 AND workflow = 'static-source'"),
    "facet_platforms": "SELECT DISTINCT platform FROM prog",
    "summary_metrics": "SELECT a.*, b.* FROM (SELECT count(*) FILTER (WHERE exclude_reason IS NULL AND workflow IN ('live-web', 'live-api', 'live-contract', 'ai-agent')) AS live, count(*) FILTER (WHERE exclude_reason IS NULL AND workflow = 'static-source' AND fresh_code_index > 50) AS fresh_source FROM best) a, (SELECT count(DISTINCT repo_key) FILTER (WHERE repo_status = 'ok') AS enriched_repos FROM ev) b",
    "ev_tier": "SELECT CASE WHEN ev_score >= 5000 THEN 'High' WHEN ev_score >= 1500 THEN 'Strong' WHEN ev_score >= 500 THEN 'Plausible' ELSE 'Thin' END AS tier, count(*) AS programs FROM best GROUP BY 1",
}.items()}

_CORE = "{0}.name, {0}.platform, {0}.url, {0}.status, {0}.paid, {0}.currency, {0}.min_reward, {0}.max_reward, {0}.safe_harbor, {0}.disclosure_allowed, {0}.launched_at, {0}.resolved_reports, {0}.invite_only, {0}.kyc_required, {0}.countries, {0}.source_ids, {0}.tags, {0}.languages".format
WAS = f"TIMESTAMP '{BEFORE}'"
CTES["health"] = "SELECT s.source_id, count(r.source_id) AS records, CASE WHEN count(r.source_id) >= 10 THEN 'ok' ELSE 'failed' END AS status FROM (VALUES {}) AS s(source_id) LEFT JOIN rec r ON r.source_id = s.source_id GROUP BY 1".format(", ".join(f"('{x}')" for x in SOURCES))
CTES["evt"] = f"SELECT '{NOW}:' || program_id || ':' || change_type AS event_id, program_id, change_type, {AT} AS happened_at FROM chg WHERE change_type <> 'baseline'"
CTES["scored"] = "SELECT x.event_id, x.program_id, x.change_type, b.ev_score, b.workflow, b.exclude_reason FROM evt x LEFT JOIN best b ON b.program_id = x.program_id"
CTES["alerts"] = "SELECT * FROM scored WHERE exclude_reason IS NULL AND ev_score > 0"
CTES["cached"] = "SELECT repo_key, CASE WHEN count(*) % 5 = 0 THEN 'failed' ELSE 'ok' END AS status, max(committed_at) AS fetched_at FROM fx_repo_commits GROUP BY 1"
CTES["fetched"] = f"SELECT repo_key, CASE WHEN count(*) % 2 = 0 THEN 'failed' ELSE 'ok' END AS status, {AT} AS fetched_at FROM fx_repo_commits GROUP BY 1 HAVING count(*) % 3 = 0"
CTES["prio"] = "SELECT x.repo_key, max(CASE c.change_type WHEN 'new_target' THEN 3 WHEN 'new_program' THEN 2 ELSE 1 END) AS priority FROM merged_t t JOIN resolved x ON x.target_key = t.target_key JOIN chg c ON c.merge_key = t.merge_key GROUP BY 1"
CTES["staled"] = f"SELECT p.repo_key, p.priority, k.fetched_at, coalesce(k.status <> 'ok', true) OR coalesce(k.fetched_at <= {AT} - INTERVAL 168 HOURS, true) AS stale FROM prio p LEFT JOIN cached k ON k.repo_key = p.repo_key"
CTES["gate"] = "SELECT count(*) AS n, count(hardening_index) AS measured, CAST(least(400, ceil(count(*) * CAST(0.8 AS DOUBLE))) AS BIGINT) AS required, count(hardening_index) >= least(400, ceil(count(*) * CAST(0.8 AS DOUBLE))) AS ready, CASE WHEN count(*) = 0 THEN CAST(1 AS DOUBLE) ELSE count(hardening_index) / CAST(count(*) AS DOUBLE) END AS ratio FROM ev WHERE repo_status IS NOT NULL"
CTES["differ"] = f"SELECT count(*) > 0 AS changed FROM ((SELECT merge_key, {_CORE('prog')} FROM prog EXCEPT ALL SELECT merge_key, {_CORE('prog_before')} FROM prog_before) UNION ALL (SELECT merge_key, {_CORE('prog_before')} FROM prog_before EXCEPT ALL SELECT merge_key, {_CORE('prog')} FROM prog))"
_RULE = " ".join("WHEN " + (f"contains(lower(value), '{r['address']}')" if r.get("address") else hit("concat_ws(' ', program_id, name, target_key, value)", "(?i)" + r["pattern"])) + f" THEN {i}" for i, r in enumerate(LIVE_RULES))
CTES["ruled"] = f"SELECT merge_key, target_key, CAST(CASE {_RULE} END AS INTEGER) AS rule FROM merged_t JOIN (SELECT merge_key, program_id, name FROM prog) p USING (merge_key)"
CTES["stats"] = "SELECT s.*, f.status AS result, CASE WHEN f.status = 'ok' OR c.status = 'ok' THEN 'ok' END AS after FROM staled s LEFT JOIN fetched f ON f.repo_key = s.repo_key LEFT JOIN cached c ON c.repo_key = s.repo_key"
CTES["scanned"] = "SELECT repo_key, count(*) AS eligible, count(k.path) AS selected, CAST(coalesce(sum(k.size), 0) AS BIGINT) AS bytes, CASE WHEN count(k.path) = count(*) THEN 'complete' ELSE 'bounded' END AS status FROM blob_p p LEFT JOIN picked k USING (repo_key, path) GROUP BY 1"
CTES["old_form"] = "SELECT DISTINCT repo_key, CASE WHEN starts_with(repo_key, 'gitlab.com/') THEN 'gitlab' ELSE 'github' END AS provider, CASE WHEN starts_with(repo_key, 'gitlab.com/') THEN substr(repo_key, 12) ELSE repo_key END AS full_name FROM resolved"
CTES["looked"] = "SELECT o.*, coalesce(a.status, b.status, 'pending') AS status, CASE WHEN a.repo_key IS NOT NULL THEN a.stars ELSE b.stars END AS stars FROM old_form o LEFT JOIN fx_signals_old a ON a.repo_key = o.repo_key LEFT JOIN fx_signals_old b ON b.repo_key = o.provider || ':' || o.full_name"
ORACLES |= {k: chain(s) for k, s in {
    "src_health": "SELECT * FROM health",
    "src_snapshot_fallback": "SELECT source_id, record_no, name, raw_status FROM rec WHERE source_id IN (SELECT source_id FROM rec GROUP BY 1 HAVING count(*) >= 290) UNION ALL SELECT source_id, record_no, name, raw_status FROM rec_before WHERE source_id NOT IN (SELECT source_id FROM rec GROUP BY 1 HAVING count(*) >= 290)",
    "norm_programs": "SELECT record_no, merge_key, url, status, paid FROM rec",
    "norm_counts": "SELECT record_no, target_count, repository_count, list_contains(tags, 'source-code') AS source_code, local_testing_hint FROM facts",
    "norm_tags": "SELECT record_no, array_to_string(tags, ',') AS tags, array_to_string(languages, ',') AS languages FROM facts",
    "diff_fingerprint": f"SELECT p.program_id, coalesce(d.added + d.removed, 0) > 0 OR ({_CORE('p')}) IS DISTINCT FROM ({_CORE('o')}) AS changed FROM prog p JOIN prog_before o ON o.merge_key = p.merge_key LEFT JOIN diff d ON d.merge_key = p.merge_key",
    "dataset_changed": "SELECT changed FROM differ",
    "program_lifecycle": f"SELECT c.program_id, CASE WHEN o.merge_key IS NULL THEN {AT} ELSE {WAS} END AS first_seen_at, CASE WHEN o.merge_key IS NULL OR change_type <> 'baseline' THEN {AT} ELSE {WAS} END AS last_seen_at, CASE WHEN change_type <> 'baseline' THEN {AT} ELSE {WAS} END AS last_changed_at, CAST(0 AS BIGINT) AS missing_count FROM chg c LEFT JOIN prog_before o ON o.merge_key = c.merge_key",
    "target_lifecycle": f"SELECT t.merge_key, t.target_key, CASE WHEN b.target_key IS NOT NULL THEN {WAS} ELSE coalesce(t.added_at, {AT}) END AS first_seen_at FROM merged_t t LEFT JOIN merged_t_before b ON b.merge_key = t.merge_key AND b.target_key = t.target_key",
    "event_score_join": "SELECT * FROM scored",
    "event_log_roll": f"SELECT * FROM (SELECT event_id, program_id, change_type, happened_at FROM evt UNION ALL SELECT '{BEFORE}:' || program_id || ':new_program', program_id, 'new_program', {WAS} FROM prog_before) ORDER BY happened_at DESC, event_id LIMIT 700",
    "alert_digest": "SELECT event_id, program_id, change_type, ev_score, greatest(0, (SELECT count(*) FROM alerts) - 8) AS more FROM alerts ORDER BY ev_score DESC, event_id LIMIT 8",
    "refresh_schedule": "SELECT repo_key, priority, fetched_at, stale FROM staled ORDER BY stale DESC, priority DESC, fetched_at NULLS FIRST, repo_key LIMIT 250",
    "enrich_stats": "SELECT count(*) AS discovered, count(*) FILTER (WHERE stale) AS stale, least(250, count(*) FILTER (WHERE stale)) AS scheduled, greatest(0, count(*) FILTER (WHERE stale) - 250) AS deferred, count(result) AS attempted, count(*) FILTER (WHERE result = 'ok') AS updated, count(*) FILTER (WHERE result <> 'ok') AS failed, count(*) FILTER (WHERE after IS NULL) AS pending, count(*) FILTER (WHERE repo_key NOT LIKE 'gitlab.com/%') AS github, count(*) FILTER (WHERE repo_key LIKE 'gitlab.com/%') AS gitlab FROM stats",
    "cache_upsert": "SELECT repo_key, CASE WHEN b.status = 'ok' OR a.status = 'ok' THEN 'ok' ELSE 'pending' END AS status, CASE WHEN b.status = 'ok' THEN b.fetched_at WHEN a.status = 'ok' THEN a.fetched_at END AS fetched_at, CASE WHEN a.status = 'ok' AND b.status <> 'ok' THEN b.status END AS last_error FROM cached a FULL JOIN fetched b USING (repo_key) WHERE repo_key IN (SELECT repo_key FROM prio)",
    "scan_coverage": "SELECT * FROM scanned",
    "signals_lookup": "SELECT t.target_key, r.repo_key, k.provider, k.full_name, k.status, k.stars FROM (SELECT DISTINCT target_key FROM merged_t) t LEFT JOIN resolved r ON r.target_key = t.target_key LEFT JOIN looked k ON k.repo_key = r.repo_key",
    "repo_status": "SELECT program_id, target_key, repo_key, repo_status FROM j",
    "merge_key": "SELECT DISTINCT name, left(trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', '-', 'g'), '-'), 96) AS merge_key FROM fx_names",
    "run_meta": "SELECT count(*) AS programs, CAST(sum(targets) AS BIGINT) AS targets, count(*) FILTER (WHERE exclude_reason IS NULL AND ev_score > 0) AS ranked, count(*) FILTER (WHERE exclude_reason IS NOT NULL) AS excluded, (SELECT count(*) FROM evt) AS events, (SELECT count(*) FROM health) AS sources, (SELECT count(*) FROM health WHERE status = 'ok') AS healthy_sources, (SELECT n FROM gate) AS coverage_n, (SELECT measured FROM gate) AS coverage_measured, (SELECT required FROM gate) AS coverage_required, (SELECT ready FROM gate) AS coverage_ready, (SELECT round(ratio, 3) FROM gate) AS coverage_ratio, (SELECT sentinels FROM checks) AS checks_sentinels, (SELECT managed FROM checks) AS checks_managed, (SELECT sentinel_ok FROM checks) AS checks_sentinel_ok, (SELECT ceiling_ok FROM checks) AS checks_ceiling_ok, (SELECT ready FROM checks) AS checks_ready FROM best",
    "coverage_gate": "SELECT * FROM gate",
    "publish_gate": "SELECT ready AND h AS publish, ready AND h AND changed AS changed FROM (SELECT ready AND (SELECT ready FROM checks) AS ready, (SELECT count(*) > 0 FROM health WHERE status = 'ok') AS h, (SELECT changed FROM differ) AS changed FROM gate)",
    "policy_lookup": "SELECT p.program_id, coalesce(r.policy_invite_only, false) AS policy_invite_only, coalesce(r.policy_kyc, false) AS policy_kyc, coalesce(r.excludes_in, false) AS excludes_in, CAST(coalesce(p.resolved_reports, r.policy_reports) AS BIGINT) AS resolved_reports FROM prog p LEFT JOIN restrict r ON r.url = p.url",
    "policy_fallback_target": "SELECT merge_key, 'program:' || merge_key || ':policy' AS target_key, type, value FROM fallback",
    "live_match": "SELECT * FROM ruled WHERE rule IS NOT NULL",
    "override_join": "SELECT program_id, floor AS override_floor, eligible AS override_eligible, eligibility_reason AS override_eligibility_reason, invite_only AS override_invite_only, kyc_required AS override_kyc_required, array_to_string(countries, ',') AS override_countries, no_safe_harbor AS override_no_safe_harbor, safe_harbor_required AS override_safe_harbor_required FROM ovr",
    "browse": "SELECT program_id, name, workflow, ev_score FROM lane WHERE workflow <> 'static-source-hardened' AND ev_score >= 1 AND platform = 'BUILDING' AND (contains(lower(concat_ws(' ', name, platform, workflow, findable_class, reason, array_to_string(tags, ' '))), 'oauth') OR program_id IN (SELECT program_id FROM ev WHERE contains(lower(value), 'oauth'))) AND program_id <> 'program:program-1' AND regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') <> 'program2'",
    "browse_sort": "SELECT program_id, name, max_reward, ev_score FROM best ORDER BY coalesce(max_reward, 0) DESC, name, program_id LIMIT 25",
}.items()}
