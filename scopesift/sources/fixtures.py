"""Adapters from the driver's tables to the input tables of the operators, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NOW, NOW_LIVE, BEFORE = "2001-11-05 00:00:00", "2024-02-20 00:00:00", "2001-01-01 00:00:00"

#: Small tables of configuration.
SOURCES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "UNUSED"]
OVERRIDES = [("program:program-7", "HIGH", None, None, False, False, ["us"], False, False), ("Program 7", "LOW", None, None, None, None, None, None, None), ("program 12", "CRITICAL", None, None, None, None, ["in", "FR"], None, None),
             ("Program 20", "MEDIUM", False, "not open to us", None, None, None, None, None), ("Program 23", None, False, None, None, None, None, None, None), ("Program 26", None, True, None, True, None, None, None, None),
             ("Program 27", None, None, None, None, True, None, None, None), ("Program 31", "LOW", None, None, None, None, None, True, True), ("Program 18", None, None, None, None, None, None, None, True), ("Program 32", None, None, None, None, None, None, None, True)]
OVERRIDE_FIELDS = "key string, floor string, eligible boolean, eligibility_reason string, invite_only boolean, kyc_required boolean, countries array<string>, no_safe_harbor boolean, safe_harbor_required boolean"
#: source_id, homepage, url_template, paid_only, priority.
FEEDS = [("AUTOMOBILE", "https://auto.example.org", "https://auto.example.org/{id}/policy", True, 10), ("BUILDING", "https://build.example.org", None, None, 20), ("FURNITURE", "https://f.example.org", "https://f.example.org?p={id}", False, None),
         ("HOUSEHOLD", "https://h.example.org", "https://h.example.org/{id}", False, 40), ("MACHINERY", "https://m.example.org", "https://m.example.org/{id}", True, 50)]
#: no, key, aliases, verdict, fresh code index at the audit.
AUDITED = [(1, "Program 7", ["Nobody"], "clean", 0.0), (2, "Brand#12", ["Brand-12"], "paid", 10.0), (3, "none such", ["Prográm 3"], "duplicate", 70.0), (4, "brand12", [], "late", 0.0)]
LIVE_RULES = [{"address": "0x" + "7".rjust(40, "0")}, {"pattern": r"login1[0-9]\."}, {"pattern": r"program-3 .*api\."}]

_RECORDS = """
SELECT c_mktsegment AS source_id, c_custkey AS record_no, 'Program ' || CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS VARCHAR(20)) AS name,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 10 WHEN 'BUILDING' THEN 20 WHEN 'FURNITURE' THEN 30 WHEN 'HOUSEHOLD' THEN 40 ELSE 50 END AS source_priority,
  'https://program' || CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS VARCHAR(20)) || '.example.org/policy' AS url,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_acctbal < 0 THEN CAST(0 AS DOUBLE) ELSE c_acctbal * 10 END AS max_reward,
  CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_acctbal < 0 THEN CAST(0 AS DOUBLE) ELSE CAST(floor(c_acctbal / 10) AS DOUBLE) END AS min_reward,
  CASE coalesce(o.s, 'O') WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'live' END AS raw_status, o.launched_at,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE coalesce(o.n, 0) END AS resolved_reports,
  c_custkey % 41 = 0 AS invite_only, c_custkey % 53 = 0 AS kyc_required, CASE c_custkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN NULL ELSE 'GBP' END AS currency,
  CASE c_custkey % 6 WHEN 0 THEN 'program-defined' WHEN 1 THEN 'full' ELSE NULL END AS safe_harbor, CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS disclosure_allowed,
  CASE c_custkey % 31 WHEN 0 THEN 'IN,US' WHEN 1 THEN 'FR' ELSE '' END AS countries,
  CASE c_custkey % 29 WHEN 0 THEN 'Solidity on a web3 testnet, see the Open' WHEN 1 THEN 'Written in Rust: lib.rs and main.go' WHEN 2 THEN 'An API in TypeScript and app.tsx, runs in Docker' WHEN 3 THEN 'Python service.py for machine learning' WHEN 4 THEN 'C language core.c and parts.cpp'
   WHEN 5 THEN 'Kotlin, Swift and Java apps with firmware' WHEN 6 THEN 'A dependency scanner in PHP and Ruby' WHEN 7 THEN 'Open source JavaScript, your own account' WHEN 8 THEN '' WHEN 9 THEN ' Golang, AI and an LLM ' WHEN 10 THEN 'Invite-only for now' WHEN 11 THEN 'only by mail; our smart'
   WHEN 12 THEN 'the repo is on a GraphQL host; use go' WHEN 13 THEN 'said aid apis capital scanned javas' ELSE NULL END AS policy_text
FROM customer LEFT JOIN (SELECT o_custkey, right(max(CAST(o_orderdate AS VARCHAR(30)) || o_orderstatus), 1) AS s, min(o_orderdate) AS launched_at,
  sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n FROM orders {where} GROUP BY o_custkey) o ON o.o_custkey = c_custkey
UNION ALL SELECT 'MACHINERY', -s_suppkey, 'Program ' || CAST(900000 + s_suppkey AS VARCHAR(20)), 50, 'https://program' || CAST(s_suppkey AS VARCHAR(20)) || '.example.org/policy', s_acctbal * 10, NULL, 'open', NULL, CAST(s_suppkey % 7 AS BIGINT), false, false, NULL, NULL, NULL, '', NULL FROM supplier WHERE s_suppkey % 10 = 3
"""

# what a target's text says
_SAYS = """  CASE p_type WHEN 'ECONOMY' THEN 'source_code' WHEN 'SMALL' THEN 'api' WHEN 'MEDIUM' THEN 'web_application' WHEN 'LARGE' THEN 'smart_contract' WHEN 'PROMO' THEN 'android' ELSE 'executable' END AS raw_type,
  CASE p_type WHEN 'ECONOMY' THEN CASE p_partkey % 19 WHEN 2 THEN 'git@github.com:' WHEN 5 THEN 'git@GitLab.com:group/' WHEN 6 THEN 'https://gitlab.com/group/' WHEN 7 THEN 'https://me@www.github.com:443/' WHEN 9 THEN 'https://github.com/%zz/' ELSE 'https://github.com/' END
     || replace(p_brand, '#', '') || '/' || replace(p_name, ' ', CASE p_partkey % 19 WHEN 8 THEN '%2D' ELSE '-' END) || '-' || CAST(p_partkey AS VARCHAR(20)) || CASE p_partkey % 19 WHEN 2 THEN '.git' WHEN 5 THEN '' WHEN 6 THEN '/-/issues/1?x=1' ELSE '/tree/main' || CASE WHEN p_partkey % 5 = 0 THEN '/parser/network' ELSE '' END END
    WHEN 'SMALL' THEN 'api.' || CAST(p_partkey AS VARCHAR(20)) || '.example.org' WHEN 'LARGE' THEN '0x' || lpad(CAST(p_partkey % 150 AS VARCHAR(20)), 40, '0')
    ELSE ' https://login' || CAST(p_partkey AS VARCHAR(20)) || '.example.org/  oauth ' END AS value,
  CASE p_partkey % 17 WHEN 0 THEN 'Multi-tenant console with RBAC' WHEN 1 THEN 'Agent that reads mail' WHEN 2 THEN 'Checkout and billing' WHEN 3 THEN 'the wallet' WHEN 4 THEN 'Signing service' WHEN 5 THEN 'a multi' WHEN 6 THEN 'contract for upgrades' WHEN 7 THEN 'code by hand' WHEN 8 THEN 'language models' WHEN 9 THEN 'protobuf codec over the network' ELSE NULL END AS description,
  CASE p_partkey % 17 WHEN 3 THEN 'core keys' WHEN 5 THEN 'tenant data' WHEN 9 THEN 'Critical' WHEN 12 THEN '' ELSE NULL END AS impact"""
_TARGETS = f"""
SELECT o_custkey AS record_no, l_orderkey * 10 + l_linenumber AS ordinal, o_orderdate AS added_at, l_returnflag <> 'R' AS eligible,
{_SAYS}
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey {{where}}
"""

_REPO = "lower(replace(p_brand, '#', '') || '/' || replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS VARCHAR(20)))"
_N, _P = "CAST(c_custkey AS VARCHAR(20))", "CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS VARCHAR(20))"
# what a target may say beside its value
_ALSO = f"""CASE c_custkey % 8 WHEN 0 THEN '' WHEN 1 THEN ',"eligible_for_bounty":false' WHEN 2 THEN ',"eligible":null,"instructions":"do","tier":2' WHEN 3 THEN ',"bounty_eligible":0' WHEN 4 THEN ',"description":"","notes":"n","severity":"high"'
 WHEN 5 THEN ',"description":"dd","impact":["a",1],"created_at":"2001-01-02T00:00:00Z"' WHEN 6 THEN ',"first_seen_at":981173106000,"notes":"nn"' ELSE ',"addedAt":"bad","eligible":"no"' END"""
_KEY = "CASE c_custkey % 5 WHEN 0 THEN 'endpoint' WHEN 1 THEN 'asset_identifier' WHEN 2 THEN 'identifier' WHEN 3 THEN 'uri' ELSE 'url' END"
_ONE, _TWO = f"""'{{"type":"url","target":" https://a' || {_N} || '.example.org"' || {_ALSO} || '}}'""", f"""'{{"asset_type":"API","' || {_KEY} || '":"api' || {_N} || '.example.org","added_at":"2001-03-04"}}'"""
# what a record may say beside its name, reward and targets
_TOO = f"""CASE c_custkey % 19 WHEN 0 THEN ',"disabled":true,"state":"open"' WHEN 1 THEN ',"closed":true' WHEN 2 THEN ',"submission_state":"paused"' WHEN 3 THEN ',"status":" Accepting "' WHEN 4 THEN ',"state":"Triage","handle":"a b/c!~*(x)é"'
 WHEN 5 THEN ',"program_status":"","slug":"s-' || {_N} || '"' WHEN 6 THEN ',"url":"https://direct.example.org/' || {_N} || '"' WHEN 7 THEN ',"program_url":"HTTP://P.example.org","url":null' WHEN 8 THEN ',"policy_url":"ftp://no","handle":0' WHEN 9 THEN ',"link":"https://l.example.org"'
 WHEN 10 THEN ',"safe_harbor":true,"allows_disclosure":false' WHEN 11 THEN ',"safeHarbor":" Full ","disclosure_allowed":true' WHEN 12 THEN ',"safe_harbor":1,"disclosureAllowed":"yes"' WHEN 13 THEN ',"offers_bounties":true,"launched_at":"2001-02-03T04:05:06Z"' WHEN 14 THEN ',"offers_awards":false,"started_at":981173106000'
 WHEN 15 THEN ',"bounty":"yes","created_at":"2001-02-03"' WHEN 16 THEN ',"paid":1,"createdAt":"no date"' WHEN 17 THEN ',"rewarded":true,"resolved_reports":"1,204","invite_only":1,"kyc_required":"","excluded_countries":["IN",7]' ELSE ',"reports_resolved":12,"inviteOnly":true,"kycRequired":true,"excluded_countries":"IN"' END
 || CASE c_custkey % 4 WHEN 0 THEN ',"description":"d ' || {_N} || '","policy":"p","eligibility":"e"' WHEN 1 THEN ',"rules":"r","notes":""' WHEN 2 THEN ',"valid_reports":3,"private":0,"policy":5' ELSE ',"resolvedReports":null' END"""
#: Landed feed pages in the shapes that feeds have; each page of a shape with an array holds one value that is no record.
_FEEDS = f"""
SELECT source_id, adapter, page_no, CASE page_no % 4 WHEN 0 THEN '{{"programs":[' || r || ']}}' WHEN 1 THEN '[' || r || ',7]' WHEN 2 THEN '{{"data":[' || r || ',"x",null]}}' ELSE '{{"items":{{"a":1}},"results":[' || r || ']}}' END AS payload FROM (
SELECT c_mktsegment AS source_id, CASE WHEN c_custkey % 6 = 5 THEN 'projectdiscovery' ELSE 'generic' END AS adapter, c_custkey AS page_no,
 '{{"id":' || {_N} || CASE WHEN c_custkey % 17 = 0 THEN ',"public":false' ELSE '' END || CASE c_custkey % 11 WHEN 0 THEN ',"name":" "' WHEN 1 THEN ',"program_name":"Program ' || {_P} || '"' WHEN 2 THEN ',"name":null,"title":"Program ' || {_P} || '"' ELSE ',"name":"Program ' || {_P} || '"' END
 || CASE c_custkey % 7 WHEN 0 THEN ',"min_bounty":50,"max_bounty":1000.5' WHEN 1 THEN ',"max_bounty":{{"value":"$1,234.50","currency":"us$"}}' WHEN 2 THEN ',"maxPayout":"€ 2,000","currency":"€"' WHEN 3 THEN ',"rewards":{{"minimum":10,"maximum":{{"amount":900,"code":"gbp"}}}}'
  WHEN 4 THEN ',"min_bounty":null,"max_payout":"none","currency_code":"DOLLARS"' WHEN 5 THEN ',"maxBounty":true,"currency":5' ELSE '' END
 || CASE c_custkey % 6 WHEN 0 THEN ',"targets":{{"in_scope":[' || {_ONE} || ',' || {_TWO} || ']}}' WHEN 1 THEN ',"scope":{{"in_scope":[' || {_ONE} || ',"plain.example.org"]}}' WHEN 2 THEN ',"targets":{{"in_scope":null}},"in_scope":[' || {_TWO} || ',{{"type":"x"}}]'
  WHEN 3 THEN ',"targets":[' || {_ONE} || ']' WHEN 4 THEN ',"targets":{{"web":[' || {_ONE} || '],"api":[' || {_TWO} || '],"note":"x"}}' ELSE ',"domains":["d' || {_N} || '.example.org","e.example.org"]' END || {_TOO} || '}}' AS r FROM customer) x
"""

VIEWS = {
    "fx_feeds": _FEEDS,
    "fx_tree": f"""
SELECT {_REPO} AS repo_key, CASE WHEN doc_id % 31 = 7 THEN 'spec/cve/poc_' || CAST(doc_id AS VARCHAR(20)) || '_test.rb' ELSE CASE doc_id % 7 WHEN 0 THEN 'SECURITY.md' WHEN 1 THEN '.github/workflows/' || lang || '-CodeQL.yml' WHEN 2 THEN 'fuzz/' || CAST(doc_id AS VARCHAR(20)) WHEN 3 THEN 'src/' || lang || CAST(doc_id AS VARCHAR(20)) || '.go'
 ELSE 'lib/pkg' || CAST(doc_id % 50 AS VARCHAR(20)) || '/deep/' || CAST(doc_id AS VARCHAR(20)) || '.rs' END END AS path,
 text || CASE WHEN doc_id % 19 = 0 THEN ' Semgrep and TRIVY' ELSE '' END || CASE WHEN doc_id % 23 = 0 THEN ' func FuzzParse(f)' ELSE '' END AS text, doc_id % 9 = 0 AS failed FROM documents JOIN part ON p_partkey = floor(doc_id / 4)""",
    "fx_compare": f"""
SELECT {_REPO} AS repo_key, 'src/' || CAST(l_suppkey AS VARCHAR(20)) || '.go' AS path, CASE l_linenumber % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' ELSE 'removed' END AS status FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type = 'ECONOMY'""",
    "fx_repo_meta": f"""
SELECT {_REPO} AS repo_key, CASE WHEN p_partkey % 11 = 0 THEN 'pending' ELSE 'ok' END AS status, p_partkey % 97 * 100 AS stars, CASE p_partkey % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'master' ELSE 'consensus' END AS default_branch,
 CASE p_partkey % 4 WHEN 0 THEN 'Go:1200' WHEN 1 THEN 'C:300,Python:20' WHEN 2 THEN 'Python:7,Rust:90,PYTHON:8' ELSE '' END AS languages,
 p_partkey % 13 AS forks, p_size % 5 AS releases FROM part WHERE p_type = 'ECONOMY'""",
    "fx_advisories": f"""
SELECT {_REPO} AS repo_key, CASE l_linenumber % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'published' WHEN 2 THEN 'closed' WHEN 3 THEN 'triage' ELSE 'Draft' END AS state, l_shipdate AS updated_at, 'Pkg' || CAST(l_suppkey % 50 AS VARCHAR(20)) AS package FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "fx_records": _RECORDS.format(where=""),
    "fx_records_before": _RECORDS.format(where=f"WHERE o_orderdate < TIMESTAMP '{BEFORE}'"),
    "fx_targets": _TARGETS.format(where=""),
    # the same targets in parts: texts once each, what names them, and which record that belongs to (before: whether the snapshot before has it too)
    "fx_target_texts": f"SELECT p_partkey AS text_no,\n{_SAYS}\nFROM part",
    "fx_target_items": "SELECT l_orderkey AS submission_no, l_orderkey * 10 + l_linenumber AS ordinal, l_returnflag <> 'R' AS eligible, l_partkey AS text_no FROM lineitem",
    "fx_submissions": f"SELECT o_orderkey AS submission_no, o_custkey AS record_no, o_orderdate AS added_at, coalesce(o_orderdate < TIMESTAMP '{BEFORE}', false) AS before FROM orders",
    "fx_targets_before": _TARGETS.format(where=f"WHERE o_orderdate < TIMESTAMP '{BEFORE}'"),
    "fx_repo_commits": f"""
SELECT {_REPO} AS repo_key, l_orderkey AS sha, l_suppkey AS author, CASE WHEN p_partkey % 23 = 0 THEN CAST('2001-10-20 00:00:00' AS TIMESTAMP_NTZ) ELSE l_shipdate END AS committed_at FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type = 'ECONOMY'""",
    # what the other views of repositories read of lineitem, for those that are known
    "fx_repo_lines": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipdate FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type = 'ECONOMY'",
    "fx_repo_pulls": f"""
SELECT {_REPO} AS repo_key, CASE WHEN l_linenumber % 5 = 0 THEN NULL WHEN p_partkey % 23 = 0 THEN CAST('2001-10-20 00:00:00' AS TIMESTAMP_NTZ) ELSE l_shipdate END AS merged_at, l_quantity * 40 AS additions FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type = 'ECONOMY'""",
    "fx_names": """
SELECT 'Program ' || CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS VARCHAR(20)) AS name FROM customer
UNION ALL SELECT CASE p_partkey % 7 WHEN 0 THEN ' Ünïted ' WHEN 1 THEN 'Đại_' WHEN 2 THEN 'Ệcole — ' WHEN 3 THEN 'Ξένος ' WHEN 4 THEN 'O''Neil & ' WHEN 5 THEN '++' ELSE 'Åse/ǺB ' END || p_name || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' ' || CAST(p_partkey AS VARCHAR(20)) END FROM part""",
    # signals as an older run left them: some under the older form of the key, some under both
    "fx_signals_old": f"""
SELECT CASE WHEN p_partkey % 7 = 3 THEN 'github:' ELSE '' END || {_REPO} AS repo_key, 'ok' AS status, CAST(p_partkey % 97 AS BIGINT) AS stars FROM part WHERE p_type = 'ECONOMY' AND p_partkey % 7 <> 5
UNION ALL SELECT 'github:' || {_REPO}, 'failed', CAST(-1 AS BIGINT) FROM part WHERE p_type = 'ECONOMY' AND p_partkey % 7 = 4
UNION ALL SELECT 'gitlab:group/' || {_REPO}, 'ok', CAST(5 AS BIGINT) FROM part WHERE p_type = 'ECONOMY' AND p_partkey % 19 = 6""",
    "fx_blobs": """
SELECT lower(replace(p_brand, '#', '') || '/' || replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS VARCHAR(20))) AS repo_key,
  CASE WHEN doc_id % 2 = 0 THEN 'test/' ELSE 'src/' END || lang || '/' || CAST(doc_id AS VARCHAR(20)) || CASE WHEN doc_id % 13 = 0 THEN '_exploit' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN '_test' ELSE '' END || '.go' AS path,
  'blob' AS type, CAST(doc_id AS VARCHAR(20)) AS sha, CAST(n_chars AS BIGINT) AS size,
  text || CASE WHEN doc_id % 11 = 0 THEN chr(10) || '//   known issue: see  tracker' || chr(10) || '# Do not use in production' ELSE '' END || CASE WHEN doc_id % 17 = 0 THEN chr(10) || 'if (false) { verify_signature() }' ELSE '' END AS text
FROM documents JOIN part ON p_partkey = floor(doc_id / 4) WHERE p_type = 'ECONOMY'""",
    "fx_policy": """
SELECT page_id, 'https://program' || CAST(page_id AS VARCHAR(20)) || '.example.org/policy' AS url,
  html || CASE WHEN page_id % 16 = 5 THEN ' Low severity reports are out of scope. &amp;lt;&#x24;5&gt;' ELSE ' <p>Low $' || CAST(page_id % 1500 AS VARCHAR(20)) || '. Medium &#36;' || CAST(page_id * 3 AS VARCHAR(20)) || '. High USD ' || CAST(page_id % 90 AS VARCHAR(20)) || 'k. Critical $25,000.</p>' END
  || CASE WHEN page_id % 6 = 0 THEN ' KYC is required.' ELSE '' END || CASE WHEN page_id % 10 = 0 THEN ' Residents of India are not eligible.' ELSE '' END || CASE WHEN page_id % 9 = 0 THEN ' No safe harbor. Valid reports so far: ' || CAST(page_id AS VARCHAR(20)) ELSE ' ' || CAST(page_id AS VARCHAR(20)) || ' resolved reports' END AS html
FROM pages""",
    "fx_live_tx": "SELECT '0x' || lpad(CAST(user_id AS VARCHAR(20)), 40, '0') AS address, ts FROM events WHERE event_type = 'purchase' AND value > 100",
}


def present(programs: DataFrame) -> DataFrame:
    """The current snapshot without every 37th program, for what is asked about programs that went."""
    return programs.where("CAST(substring(merge_key, 9) AS INT) % 37 <> 0")


def spread(spark: SparkSession, rows: DataFrame, least: int = 1 << 20) -> DataFrame:
    """A table of one or few splits dealt out over the cores, so that one task doesn't do all that follows. Tables whose splits keep all cores at work, and
    those of less than ``least`` bytes, stay as they are: nothing of a large table is shuffled."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return rows.repartition(cores) if least <= size < cores * split else rows


def view(spark: SparkSession, sf_dir: str, name: str, lines: DataFrame | None = None) -> DataFrame:
    """One adapter's rows. Tables are read by path; nothing is registered in the session. lines: rows of lineitem that are read in its place."""
    sql, used = VIEWS[name].replace("{", "{{").replace("}", "}}"), {}
    for t in ("customer", "supplier", "orders", "lineitem", "part", "documents", "pages", "events"):
        if re.search(rf"(FROM|JOIN) {t}\b", sql):
            used[t] = lines if t == "lineitem" and lines is not None else spark.read.parquet(f"{sf_dir}/{t}.parquet")
            if t in ("lineitem", "documents", "pages"):  # the rows of a view come from these, all others are joined to them
                used[t] = spread(spark, used[t])
            elif name in ("fx_feeds", "fx_target_texts"):  # a row of a few bytes becomes a page of JSON that is parsed, or a text that is looked through
                used[t] = spread(spark, used[t], 1 << 16)
            sql = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}} AS {t}", sql)
    return spark.sql(sql, **used)
