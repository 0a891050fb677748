"""Known values and small cases of the ranking operators."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from scopesift.functions.exprs import fold_words, half_up
from scopesift.operators import cache, diff, evidence, feeds, merge, rank, state, value
from scopesift.sources import sinks
from scopesift.streaming import reconcile

NOW = "2026-01-31 00:00:00"
SCHEMA = """program_id string, name string, target_key string, type string, value string, tags array<string>, repo_key string, repo_status string, stars long, sec_tooling boolean,
 age_y double, contributors long, advisories_resolved long, commits_90d long, files_added_90d long, max_additions_90d double, change_type string, added_at timestamp, first_seen_at timestamp,
 dev_known boolean, traps long, advisory_match boolean, security_fix_gated boolean, deployed boolean, tx_30d long, languages array<string>, override_floor string, policy_floor string,
 paid boolean, status string, invite_only boolean, policy_invite_only boolean, kyc_required boolean, policy_kyc boolean, excludes_in boolean, resolved_reports long, policy_reports long, launched_at timestamp, max_reward double, platform string, url string"""
BASE = dict(program_id="program:x", name="Example", target_key="k", type="source-code", value="https://github.com/o/r", tags=[], status="open", paid=True, resolved_reports=4, max_reward=20000.0, change_type="baseline")


def evaluate(spark, cap=50_000.0, **kw):
    names = [f.name for f in spark.createDataFrame([], SCHEMA).schema]
    row = BASE | kw
    return value.evaluate_targets(spark.createDataFrame([tuple(row.get(n) for n in names)], SCHEMA), NOW, cap).first()


def test_rounding_goes_up_on_halves(spark):
    r = spark.range(1).select(half_up(F.lit(-2.5), 0).alias("a"), half_up(F.lit(2.5), 0).alias("b"), half_up(F.lit(0.0564), 3).alias("c")).first()
    assert (r.a, r.b, r.c) == (-2.0, 3.0, 0.056)


def test_hardening_and_fresh_reach_100(spark):
    r = evaluate(spark, name="crypto wallet", repo_status="ok", stars=9000, sec_tooling=True, age_y=6.0, contributors=150, advisories_resolved=4,
                 commits_90d=90, files_added_90d=12, max_additions_90d=900.0, change_type="new_program")
    assert (r.hardening_index, r.fresh_code_index) == (100.0, 100.0)


def test_unresolved_source_target(spark):
    r = evaluate(spark, repo_status="pending")
    assert r.hardening_index is None and r.p_findable == 0.056


def test_young_program_without_reports_is_first(spark):
    import datetime

    r = evaluate(spark, type="web", value="https://login.example.org", resolved_reports=0, launched_at=datetime.datetime(2026, 1, 1))
    assert r.p_first == 1.0 and r.findable_class == "account-takeover"


def test_managed_parser_is_excluded(spark):
    r = evaluate(spark, value="https://github.com/o/rlp-parser", repo_status="ok", languages=["go"], stars=1)
    assert r.trap_tags == ["DOS_CEILING"] and r.ev_score == 0 and r.exclude_reason.startswith("LOW DoS ceiling is below the MEDIUM")


def test_known_issue_risk_of_the_trap_fixture(spark):
    assert evaluate(spark, repo_status="ok", dev_known=True, security_fix_gated=True).known_issue_risk == 70


def test_dormant_contract(spark):
    r = evaluate(spark, type="smart-contract", value="0xabc", deployed=True, tx_30d=0)
    assert r.dormant and "DORMANT" in r.trap_tags and r.ev_score == 0
    assert not evaluate(spark, type="smart-contract", value="0xabc").dormant


def test_reward_cap_and_exclusion(spark):
    assert evaluate(spark, max_reward=1e6, type="web", value="https://a.example.org").effective_reward == 50_000.0
    r = evaluate(spark, paid=False, kyc_required=True)
    assert r.exclude_reason == "program is not confirmed paid; KYC required" and r.ev_score == 0


@pytest.mark.parametrize("url, key", [("https://github.com/Own/Repo.git", "own/repo"), ("https://www.github.com/a/b/tree/main", "a/b"), ("github.com/a/b?x=1", "a/b"), ("https://github.com/a", None),
                                      ("https://gitlab.com/g/s/p/-/issues", "gitlab.com/g/s/p"), ("https://example.org/a/b", None)])
def test_repository_keys(spark, url, key):
    got = evidence.repo_resolve(spark.createDataFrame([("k", url)], "target_key string, value string")).collect()
    assert [r.repo_key for r in got] == ([key] if key else [])


def test_policy_reads_amounts_and_limits(spark):
    html = "<p>Low &#36;200. Medium $1,500. High USD 5k. Critical $25,000.</p> KYC is required. Residents of India are not eligible. 12 resolved reports. $100 minimum"
    text = evidence.policy_text(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))
    amounts = {r.severity: r.amount for r in evidence.policy_rewards(text).collect()}
    assert amounts == {"LOW": 200.0, "MEDIUM": 1500.0, "HIGH": 5000.0, "CRITICAL": 25000.0}
    assert evidence.policy_floor(evidence.policy_rewards(text), text).first().policy_floor == "MEDIUM"
    r = evidence.policy_restrictions(text).first()
    assert (r.policy_kyc, r.excludes_in, r.policy_reports, r.policy_invite_only) == (True, True, 12, False)


def test_scan_skips_what_does_not_fit(spark):
    rows = [("r", "src/security.go", "blob", "1", 50), ("r", "src/auth.go", "blob", "2", 70), ("r", "src/a.go", "blob", "3", 40), ("r", "src/b.go", "blob", None, 1)]
    got = evidence.scan_priority_pick(spark.createDataFrame(rows, "repo_key string, path string, type string, sha string, size long"), 3, 100)
    assert {r.path for r in got.collect()} == {"src/security.go", "src/a.go"}


def test_changes_and_grace(spark):
    cols = "program_id string, merge_key string, name string, platform string, url string, status string, paid boolean, min_reward double, max_reward double, launched_at timestamp, resolved_reports long, invite_only boolean, kyc_required boolean, source_ids array<string>, tags array<string>, currency string, safe_harbor string, disclosure_allowed boolean, countries array<string>, languages array<string>"
    mk = lambda k, **kw: tuple((dict(program_id="program:" + k, merge_key=k, name=k, platform="p", url="u", status="open", paid=True, source_ids=["s"], tags=[]) | kw).get(c.split()[0]) for c in cols.split(", "))
    now = spark.createDataFrame([mk("same"), mk("new"), mk("up", max_reward=9.0), mk("back"), mk("other", url="v"), mk("target")], cols)
    old = spark.createDataFrame([mk("same"), mk("up", max_reward=1.0), mk("back", status="closed"), mk("other"), mk("target"), mk("gone")], cols)
    t = spark.createDataFrame([("target", "a"), ("same", "b")], "merge_key string, target_key string")
    s = spark.createDataFrame([("same", "b")], "merge_key string, target_key string")
    got = diff.classify_change(now, old, diff.diff_targets(t, s))
    assert {r.merge_key: r.change_type for r in got.collect()} == {"same": "baseline", "new": "new_program", "up": "reward_up", "back": "reactivated", "other": "scope_updated", "target": "new_target"}
    assert diff.change_events(got, NOW).count() == 5
    first = diff.missing_grace(old.withColumn("missing_count", F.lit(0)), now)
    assert [(r.program_id, r.status, r.missing_count) for r in first.collect()] == [("program:gone", "stale", 1)]
    assert diff.missing_grace(old.withColumn("missing_count", F.lit(1)), now).count() == 0


def test_targets_are_typed_and_deduped(spark):
    rows = [(1, 1, "smart_contract", " 0xA ", True, None), (1, 2, "smart_contract", "0xa", True, None), (1, 3, "web", "  ", True, None), (1, 4, "api", "x", False, None), (1, 5, None, "y", None, None)]
    t = merge.norm_targets(spark.createDataFrame(rows, "record_no long, ordinal long, raw_type string, value string, eligible boolean, added_at timestamp"))
    assert sorted((r.ordinal, r.type) for r in t.collect()) == [(1, "smart-contract"), (2, "smart-contract"), (5, "other")]
    assert [r.ordinal for r in merge.dedupe_targets(t).orderBy("ordinal").collect()] == [2, 5]


def test_lanes(spark):
    rows = [Row(program_id=str(i), name=n, workflow=w, fresh_code_index=f, ev_score=e, exclude_reason=x) for i, (n, w, f, e, x) in enumerate([
        ("a", "live-web", 0.0, 10.0, None), ("b", "static-source", 60.0, 20.0, None), ("c", "static-source-hardened", 0.0, 30.0, None), ("d", "live-api", 0.0, 40.0, "no"), ("e", "live-api", 0.0, 0.0, None)])]
    df = spark.createDataFrame(rows, "program_id string, name string, workflow string, fresh_code_index double, ev_score double, exclude_reason string")
    names = lambda lane: [r.name for r in rank.shortlist(df, lane).collect()]
    assert (names("default"), names("live"), names("fresh-source")) == (["b", "a"], ["a"], ["b"])


def test_entities_are_decoded_once(spark):
    html = "<b>a</b> &amp;lt; &#x24;5 &#36;6 &LT;x&gt; &amp;#36; &unknown;"
    text = evidence.policy_text(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).first().text
    assert text == "a &lt; $5 $6 <x> &#36; &unknown;"


def test_low_exclusion_gives_a_floor(spark):
    text = evidence.policy_text(spark.createDataFrame([(1, "u", "Low is not rewarded."), (2, "v", "Nothing here")], "page_id long, url string, html string"))
    assert [tuple(r) for r in evidence.policy_floor(evidence.policy_rewards(text), text).collect()] == [("u", "MEDIUM", "scraped-low-exclusion")]


def test_changes_are_carried_over_and_a_first_import_is_no_news(spark):
    cols = "program_id string, merge_key string, name string, platform string, url string, status string, paid boolean, min_reward double, max_reward double, launched_at timestamp, resolved_reports long, invite_only boolean, kyc_required boolean, source_ids array<string>, tags array<string>, currency string, safe_harbor string, disclosure_allowed boolean, countries array<string>, languages array<string>"
    one = spark.createDataFrame([("p", "m", "n", "x", "u", "open", True, None, 5.0, None, None, False, False, ["s"], [], None, None, None, [], [])], cols)
    none = spark.createDataFrame([], "merge_key string, target_key string")
    same = diff.diff_targets(none, none)
    kept = diff.classify_change(one, one.withColumn("change_type", F.lit("reward_up")), same)
    assert [(r.change_type, r.is_new) for r in kept.collect()] == [("reward_up", False)] and diff.change_events(kept, NOW).count() == 0
    assert [(r.change_type, r.is_new) for r in diff.classify_change(one, one.limit(0), same, baseline=True).collect()] == [("baseline", False)]


def test_audits(spark):
    targets = spark.createDataFrame([("program:alpha-beta", "Álpha Beta", "k1", "x", None, 10.0), ("program:alphabet", "Alphabet", "k2", "https://github.com/own/repo", "own/repo", 80.0), ("program:c", "C", "k3", "own repo", None, 0.0)],
                                    "program_id string, name string, target_key string, value string, repo_key string, fresh_code_index double")
    audited = spark.createDataFrame([(1, "alpha", ["other"], "clean", 0.0), (2, "Own/Repo", [], "paid", 20.0)], "no int, key string, aliases array<string>, verdict string, fresh_at_audit double")
    got = {r.target_key: (r.audit_no, r.audit_reason) for r in cache.audit_excluded(cache.audit_match(targets, audited)).collect()}
    assert got == {"k1": (1, "audited clean target: alpha"), "k2": (2, None), "k3": (None, None)}  # fresh again, and a value that is no repository


def test_audited_names_anywhere_in_a_repository(spark):
    """Short names, names inside words and of several words, against a look at every pair."""
    names = ["ab", "x", "wn re", "github", "own-repo", "zebra", "Réпo", "repo two"]
    values = [("https://github.com/own/repo-two", "own/repo-two"), ("https://github.com/ab", None), ("https://gitlab.com/g/x.y", "gitlab.com/g/x.y"), ("https://github.com/q/REPO", "q/repo"), ("ab own repo", None)]
    targets = spark.createDataFrame([(f"program:p{i}", f"P{i}", f"k{i}", v, r, 0.0) for i, (v, r) in enumerate(values)], "program_id string, name string, target_key string, value string, repo_key string, fresh_code_index double")
    audited = spark.createDataFrame([(i, n, [], "clean", 0.0) for i, n in enumerate(names)], "no int, key string, aliases array<string>, verdict string, fresh_at_audit double")
    folded = {r.n: r.f for r in spark.createDataFrame([(x,) for x in {*names, *(y for v in values for y in v if y)}], "n string").select("n", fold_words(F.col("n")).alias("f")).collect()}
    want = {f"k{i}": min((k for k, n in enumerate(names) if (r or "git" in v) and any(folded[n] in folded[y] for y in (v, r) if y)), default=None) for i, (v, r) in enumerate(values)}
    assert {r.target_key: r.audit_no for r in cache.audit_match(targets, audited).collect()} == want and set(want.values()) > {None, 0}
    assert cache.audit_match(targets, audited.limit(0)).where("audit_no IS NOT NULL").count() == 0


def test_upsert_keeps_a_good_row(spark):
    schema = "repo_key string, status string, fetched_at timestamp_ntz, last_error string, stars long"
    import datetime

    at = datetime.datetime(2026, 1, 1)
    old = spark.createDataFrame([("good", "ok", at, None, 3), ("bad", "pending", None, "x", None), ("still", "ok", at, None, 1)], schema)
    new = spark.createDataFrame([("good", "failed", "timeout", None), ("bad", "ok", None, 9), ("new", "failed", None, None)], "repo_key string, status string, error string, stars long")
    got = {r.repo_key: (r.status, r.stars, r.last_error) for r in cache.upsert(old, new, "repo_key", NOW).collect()}
    assert got == {"good": ("ok", 3, "timeout"), "bad": ("ok", 9, None), "still": ("ok", 1, None), "new": ("pending", None, "failed")}
    assert tuple(cache.upsert_stats(cache.upsert(old, new, "repo_key", NOW), new).first()) == (3, 1, 2, 1)


def test_feeds_in_all_shapes(spark):
    rows = [('{"programs":[{"name":" A ","min_bounty":"free","targets":{"in_scope":["a.example.org",{"asset_type":"URL","uri":" u "}]}},{"name":""},3]}',), ('[{"title":"B","public":false}]',), ("broken",), (None,), ('{"data":{},"results":[{"company":"C","max_bounty":{"max":"1.5k"},"targets":{"x":[{"name":"n"}],"y":4}}]}',)]
    df = spark.createDataFrame([("s", "generic", i, r[0]) for i, r in enumerate(rows)], "source_id string, adapter string, page_no int, payload string")
    records = feeds.src_feeds(df)
    assert sorted((r.page_no, r.ordinal, r.name) for r in records.collect()) == [(0, 0, "A"), (4, 0, "C")]
    assert {(r.page_no, r.raw_type, r.value) for r in feeds.src_nested_targets(records).collect()} == {(0, None, "a.example.org"), (0, "URL", "u"), (4, None, "n")}
    assert {r.page_no: (r.min_reward, r.max_reward) for r in feeds.norm_rewards(records).collect()} == {0: (0.0, None), 4: (None, 1.5)}


PROGRAM = "program_id string, merge_key string, name string, platform string, url string, status string, paid boolean, currency string, min_reward double, max_reward double, safe_harbor string, disclosure_allowed boolean, launched_at timestamp_ntz, resolved_reports long, invite_only boolean, kyc_required boolean, countries array<string>, source_ids array<string>, tags array<string>, languages array<string>"
TARGET = "merge_key string, target_key string, added_at timestamp_ntz"


def programs_of(spark, rows):
    own = {"platform": "p", "url": "u", "paid": True, "countries": [], "source_ids": ["s"], "tags": [], "languages": []}
    names = [c.split()[0] for c in PROGRAM.split(", ")]
    return spark.createDataFrame([tuple(({"program_id": f"program:{k}", "merge_key": k, "name": k, "status": status, "max_reward": reward} | own).get(n) for n in names) for k, status, reward in rows], PROGRAM)


def test_stream_takes_polls_in_order_and_again(spark):
    landed, to, at = (sinks.folder(spark, x) for x in ("landed", "state", "stream"))

    def poll(run, rows, targets):
        spark.createDataFrame([(*t, None) for t in targets], TARGET).write.parquet(f"{landed}/targets/run_ts={run}")
        programs_of(spark, rows).write.parquet(f"{landed}/programs/run_ts={run}")
        reconcile.incremental_reconcile(spark, landed, to, at, programs_of(spark, []).schema, spark.createDataFrame([], TARGET).schema)
        return {r.merge_key: (r.status, r.change_type, str(r.change_at)[:10], str(r.first_seen_at)[:10], str(r.last_seen_at)[:10], str(r.last_changed_at)[:10], r.missing_count) for r in sinks.read_state(spark, to, "programs").collect()}

    one, two, three, four = (f"2026-01-0{i}" for i in range(1, 5))
    got = poll(one, [("a", "open", 1.0), ("b", "open", 1.0), ("c", "closed", None), ("t", "open", 1.0)], [("a", "k1"), ("b", "k2"), ("t", "k3")])
    assert set(got.values()) == {("open", "baseline", one, one, one, one, 0), ("closed", "baseline", one, one, one, one, 0)} and sinks.read_state(spark, to, "events").count() == 0
    got = poll(two, [("a", "open", 2.0), ("c", "open", None), ("d", "open", None), ("t", "open", 1.0)], [("a", "k1"), ("t", "k3"), ("t", "k4")])
    assert got == {"a": ("open", "reward_up", two, one, two, two, 0), "b": ("stale", "baseline", one, one, one, one, 1), "c": ("open", "reactivated", two, one, two, two, 0),
                   "d": ("open", "new_program", two, two, two, two, 0), "t": ("open", "new_target", two, one, two, two, 0)}
    assert {(r.merge_key, r.target_key, str(r.first_seen_at)[:10]) for r in sinks.read_state(spark, to, "targets").collect()} == {("a", "k1", two), ("b", "k2", "None"), ("t", "k3", two), ("t", "k4", two)}
    assert sinks.read_state(spark, to, "events").count() == 4
    got = poll(three, [("a", "open", 2.0), ("t", "open", 1.0)], [("a", "k1"), ("t", "k4")])
    assert got == {"a": ("open", "reward_up", two, one, two, two, 0), "t": ("open", "scope_updated", three, one, three, three, 0), "c": ("stale", "reactivated", two, one, two, two, 1), "d": ("stale", "new_program", two, two, two, two, 1)}
    # an unchanged poll carries everything over, without news; a program's second miss drops it
    got = poll(four, [("a", "open", 2.0), ("t", "open", 1.0), ("b", "open", 1.0)], [("a", "k1"), ("t", "k4")])
    assert got == {"a": ("open", "reward_up", two, one, two, two, 0), "t": ("open", "scope_updated", three, one, three, three, 0), "b": ("open", "new_program", four, four, four, four, 0)}
    assert [r.program_id for r in sinks.read_state(spark, to, "events").collect()] == ["program:b"] and sinks.versions(spark, to) == [one, two, three, four]


def test_stream_joins_by_shuffles(spark):
    """Where tables are too large to be broadcast the stream gives what it gives with broadcasts."""
    rows = [(str(i), "open", float(i)) for i in range(40)]
    polls = [("2026-01-01", rows[:30], [(str(i % 40), f"k{i}") for i in range(200) if i % 10]), ("2026-01-02", rows[3:], [(str(i % 40), f"k{i}") for i in range(200) if i % 10 != 7])]

    def taken(least):
        landed, to, at = (sinks.folder(spark, x) for x in ("landed", "state", "stream"))
        for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.set(c, least)
        try:
            for run, programs, targets in polls:
                spark.createDataFrame([(*t, None) for t in targets], TARGET).write.parquet(f"{landed}/targets/run_ts={run}")
                programs_of(spark, programs).write.parquet(f"{landed}/programs/run_ts={run}")
            reconcile.incremental_reconcile(spark, landed, to, at, programs_of(spark, []).schema, spark.createDataFrame([], TARGET).schema)
            return [sorted(map(str, sinks.read_state(spark, to, t).collect())) for t in ("programs", "targets", "events")]
        finally:
            for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
                spark.conf.unset(c)

    assert taken("-1") == taken("10MB")


def test_state_is_published_whole(spark, monkeypatch):
    to = sinks.folder(spark, "state")
    table = lambda n: spark.range(n)
    seen = lambda: tuple(sinks.read_state(spark, to, t).count() for t in ("a", "b"))
    sinks.write_state({"a": table(1), "b": table(2)}, to, "1")
    broken = table(3).selectExpr("raise_error('lost') AS id")
    with pytest.raises(Exception, match="lost"):  # between the two tables
        sinks.write_state({"a": table(5), "b": broken}, to, "2")
    assert seen() == (1, 2) and sinks.versions(spark, to) == ["1"]
    sinks.write_state({"a": table(5), "b": table(6)}, to, "2")
    reader = sinks.read_state(spark, to, "a", "2")
    sinks.write_state({"a": table(7), "b": table(8)}, to, "2")  # repeated: who reads the attempt before goes on
    assert seen() == (7, 8) and reader.count() == 5 and sinks.read_state(spark, to, "b", "1").count() == 2
    sinks.expire_state(spark, to, keep=1)
    assert seen() == (7, 8) and sinks.versions(spark, to) == ["2"]


def test_lifecycles_do_not_move_on_carried_changes(spark):
    changes = spark.createDataFrame([("p", "m", "reward_up", False), ("q", "n", "reward_up", True), ("r", "o", "baseline", False)], "program_id string, merge_key string, change_type string, is_new boolean")
    old = spark.createDataFrame([("m",), ("n",)], "merge_key string").selectExpr("merge_key", *(f"TIMESTAMP_NTZ '2026-01-01 00:00:00' AS {c}" for c in reconcile.SEEN))
    got = {r.program_id: (r.first_seen_at.day, r.last_seen_at.day, r.last_changed_at.day) for r in state.program_lifecycle(changes, old, NOW).collect()}
    assert got == {"p": (1, 1, 1), "q": (1, 31, 31), "r": (31, 31, 31)}


def test_flags_across_seams(spark):
    """Flags of parts, joined, are those of the whole text, for every pattern and phrase."""
    import itertools
    import re

    from scopesift.operators import value

    words = ["wallet", "core", "Account", "LINK", "multi", "tenant", "k8s", "operator", "prompt", "inject", "smart", "contract", "ai", "mosaic", "rag", "evm", "éevm", "x" * 30, "", "aid", "wallet-core"]
    rows = [(a, b, c, d) for (a, b), (c, d) in zip(itertools.product(words, words), itertools.cycle(itertools.product(words[::-1], words[3:])))]
    df = spark.createDataFrame([(i, a, b, "", [c] if c else [], [d] if d else []) for i, (a, b, c, d) in enumerate(rows)], "i int, name string, type string, value string, tags array<string>, spoken array<string>")
    df = df.selectExpr("*", "cast(null AS string) AS repo_key", "cast(null AS array<string>) AS languages")
    for r in value.search_flags(df).collect():
        text = " ".join(x for x in rows[r.i] if x)
        want = [bool(re.search(p, text, re.I | re.A)) for p, _ in value.ROUTING.values()]
        assert [bool(r.marks >> k & 1) for k in range(len(want))] == want, text


def test_needles_stand_in_every_match():
    """Each pattern's texts: no match is without one of them."""
    import random
    import re

    from scopesift.operators import facts, value

    rng = random.Random(7)
    for p, needles in [*value.ROUTING.values(), *facts.TAG_WORDS.values(), *facts.LANGUAGE_WORDS.values(), facts.LOCAL_WORDS, value.INVITE_WORDS]:
        bits = [w for w in re.split(r"[^a-z0-9+.]+", p.replace("\\b", " ").replace("\\", "")) if w] + needles + [" ", "-", "_", "x", "."]
        for _ in range(3_000):
            text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 5)))
            assert not re.search(p, text) or any(n in text for n in needles), (p, text)


def test_record_facts_of_whole_texts(spark):
    """Tags, languages and hints of a record's joined text, with phrases across its texts."""
    import re

    from scopesift.operators import facts

    rng_texts = ["smart", "contract", "machine", "learning now", "go", "code", "C", "language", "open", "Source", "own", "account", "security", "tools", "app.tsx", "Go code", "éapi", "api", "", "main.go,", "javascript"]
    own = [(i, rng_texts[i % len(rng_texts)]) for i in range(60)]
    targets = [(i, f"k{j}", "web", rng_texts[(i * 7 + j * 3 + 1) % len(rng_texts)] or "v", rng_texts[(i + j * 5) % len(rng_texts)], rng_texts[(i * 3 + j) % len(rng_texts)]) for i in range(60) for j in range(i % 4)]
    got = facts.record_tags(facts.record_facts(spark.createDataFrame(own, "record_no long, policy_text string"), spark.createDataFrame(targets, "record_no long, target_key string, type string, value string, description string, impact string"))).collect()
    assert len(got) == 60
    for r in got:
        text = " ".join(x for x in [own[r.record_no][1], *(x for t in sorted(t for t in targets if t[0] == r.record_no) for x in t[3:])] if x)
        fit = lambda words: {n for n, (p, _) in words.items() if re.search(p, text, re.I | re.A)}
        assert set(r.tags) - {"web"} == fit(facts.TAG_WORDS), text
        assert set(r.languages) == fit(facts.LANGUAGE_WORDS) and r.local_testing_hint == bool(re.search(facts.LOCAL_WORDS[0], text, re.I))


def test_policy_texts_in_lead_order(spark):
    rows = [("m", 2, "second " * 30_000), ("m", 1, " first "), ("m", 3, "never"), ("n", 1, None), ("n", 2, " x"), ("o", 1, "")]
    got = {r.merge_key: r.policy_text for r in merge.merge_policy_text(spark.createDataFrame(rows, "merge_key string, lead_rank int, policy_text string")).collect()}
    assert got == {"m": ("first " + "second " * 30_000)[:150_000], "n": "x"}


def test_export_quotes(spark):
    row = {c: None for c in sinks.EXPORT} | {"name": 'say "hi", a', "max_reward": 60000.0, "ev_score": 1.0}
    row.pop("reward_capped")
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} {'double' if c in ('ev_score', 'max_reward') else 'string'}" for c in row))
    to = sinks.folder(spark, "csv")
    sinks.export_csv(df.coalesce(1), to)
    head, line = (r.value for r in spark.read.text(to).collect())
    assert head == ",".join(f'"{c}"' for c in sinks.EXPORT) and line.startswith('"1.0","say ""hi"", a",') and '"true"' in line


def test_variants_are_read_as_javascript_reads_them(spark):
    from scopesift.functions import variants as v

    rows = [("true", True, "true"), ("false", False, "false"), ("0", False, "0"), ("1.5", True, "1.5"), ('""', False, ""), ('"x"', True, "x"), ("[]", True, ""), ('["a",1]', True, "a,1"), ("{}", True, "[object Object]"), ("null", False, None)]
    df = spark.createDataFrame([(i, f'{{"a":{r[0]}}}') for i, r in enumerate(rows)], "i int, j string").withColumn("x", F.try_parse_json("j"))
    got = df.select("i", v.truth(v.first(F.col("x"), "none", "a")).alias("t"), v.text(v.first(F.col("x"), "none", "a")).alias("s")).collect()
    assert [(r.t, r.s) for r in sorted(got)] == [r[1:] for r in rows]
    when = [('"2001-02-03"', "2001-02-03 00:00:00"), ('"2001-02-03T04:05:06Z"', "2001-02-03 04:05:06"), ('"2001-02-03T04:05:06+02:00"', "2001-02-03 02:05:06"), ("981173106000", "2001-02-03 04:05:06"), ('"soon"', "None"), ("0", "None"), ("true", "None")]
    df = spark.createDataFrame([(i, f'{{"a":{r[0]}}}') for i, r in enumerate(when)], "i int, j string")
    assert [str(r.m) for r in df.orderBy("i").select(v.moment(v.first(F.try_parse_json("j"), "a")).alias("m")).collect()] == [r[1] for r in when]
    assert spark.range(1).select(v.uri_component(F.lit("a b/c!~*'(x)é+")).alias("u")).first().u == "a%20b%2Fc!~*'(x)%C3%A9%2B"


def test_overrides_and_audits_decide(spark):
    more = "override_eligible boolean, override_eligibility_reason string, override_countries array<string>, override_safe_harbor_required boolean, no_safe_harbor boolean, invite_words boolean, audit_no int, audit_key string, verdict string, fresh_at_audit double"
    audit = dict(audit_no=1, audit_key="k", verdict="clean")
    cases = [({}, None), (dict(override_eligible=False), "program override marks researcher ineligible"), (dict(override_eligible=False, override_eligibility_reason="no"), "no"),
             (dict(override_countries=["in"]), "IN researchers excluded"), (dict(override_countries=["FR"]), None), (dict(override_safe_harbor_required=True, no_safe_harbor=True), "required safe harbor is absent"),
             (dict(override_safe_harbor_required=True, no_safe_harbor=False), None), (dict(invite_words=True), "invite-only program"), (audit | dict(fresh_at_audit=0.0), "audited clean target: k"), (audit | dict(fresh_at_audit=-41.0), None)]
    names = [f.name for f in spark.createDataFrame([], f"{SCHEMA}, {more}").schema]
    rows = [tuple((BASE | dict(type="web", value="https://a.example.org", target_key=str(i)) | c).get(n) for n in names) for i, (c, _) in enumerate(cases)]
    got = value.evaluate_targets(spark.createDataFrame(rows, f"{SCHEMA}, {more}"), NOW).collect()
    assert [r.exclude_reason for r in sorted(got, key=lambda r: int(r.target_key))] == [x for _, x in cases]


def test_repository_addresses(spark):
    cases = {"git@github.com:Own/Re.po.git": "own/re.po", "git@GitLab.com:a/b/c": "gitlab.com/a/b/c", "https://me@www.github.com:443/O/R/tree/x": "o/r", "github.com/o/r%2Eb/": "o/r.b", "https://gitlab.com/g/s/p/-/issues/1?x": "gitlab.com/g/s/p",
             "http://github.com/o%2Fr": "o/r", "https://github.com/o/a+b": None, "https://github.com/%zz/r": None, "https://github.com/o": None, "https://github.com/o/...": None, "git@example.org:o/r": None, "https://evil.org/github.com/o/r": None, "": None, None: None, " https://github.com/o/r.GIT#x ": "o/r"}
    rows = [(str(i), v) for i, v in enumerate(cases)]
    got = {r.target_key: r.repo_key for r in evidence.repo_resolve(spark.createDataFrame(rows, "target_key string, value string")).collect()}
    assert got == {str(i): k for i, k in enumerate(cases.values()) if k}


def test_merge_keys_decompose_with_compatibility(spark):
    names = {"ﬁnance ①": "finance-1", "Ｆｕｌｌ　Ｗｉｄｔｈ": "full-width", "Ệcole": "ecole", "İzmir": "izmir", "Ĳssel": "ijssel", "  --Plain_ Name! ": "plain-name", "½": "1-2", "Ξένος": "", "": "", "x" * 200: "x" * 96}
    df = spark.createDataFrame([(n,) for n in [*names, *names]] + [(None,)], "name string")
    assert {r.name: r.merge_key for r in merge.merge_keys(df).collect()} == names
    assert merge.merge_keys(df.limit(0)).count() == 0 and merge.merge_keys(df).count() == len(names)


def test_traps_tell_line_and_text_of_the_first_match(spark):
    wide = "\U0001f600" * 50
    blobs = [("r", "src/a.go", f"{wide}\nx\n//  this   documents the vulnerability\n# do not use in production"), ("r", "src/b.go", "a\r\nb\nif (FALSE) {\n attack }"), ("r", "src/c.go", "if (false)"), ("r", "test/x_exploit.go", None),
             ("r", "test/x_exploit.go", "again"), ("s", "src/late.go", "y" * 500_001 + "\n# known issue"), ("s", "src/wide.go", "z" * 400_000 + "\n" * 7 + "# known issue " + "w" * 300)]
    tree = [("r", "test/x_exploit.go"), ("t", "spec/poc_test.rb"), ("t", "src/poc.rb"), ("t", None)]
    got = evidence.detect_traps(spark.createDataFrame(blobs, "repo_key string, path string, text string"), spark.createDataFrame(tree, "repo_key string, path string"))
    assert {tuple(r) for r in got.select("repo_key", "path", "kind", "line", "match").collect()} == {
        ("r", "src/a.go", "known-comment", 3, "// this documents the vulnerability"), ("r", "src/b.go", "disabled-security-flag", 3, "if (FALSE"), ("r", "test/x_exploit.go", "test-filename", None, "x_exploit.go"),
        ("s", "src/wide.go", "known-comment", 8, "# known issue"), ("t", "spec/poc_test.rb", "test-filename", None, "poc_test.rb")}
    assert got.count() == 5
    roll = {r.repo_key: r for r in evidence.trap_rollup(got).collect()}
    assert (roll["r"].traps, roll["r"].security_fix_gated, [h.kind for h in roll["r"].trap_hits]) == (3, True, ["disabled-security-flag", "known-comment", "test-filename"]) and not roll["t"].security_fix_gated


def test_a_long_list_of_traps_is_cut_but_its_flag_is_not(spark):
    rows = [("r", f"p{i:03}", "a-kind" if i < 50 else "disabled-security-flag", i, "m") for i in range(51)]
    r = evidence.trap_rollup(spark.createDataFrame(rows, "repo_key string, path string, kind string, line int, match string")).first()
    assert (r.traps, len(r.trap_hits), r.security_fix_gated) == (20, 20, True)


def test_pull_requests_and_profile(spark):
    from datetime import datetime as d

    commits = spark.createDataFrame([("a", d(2026, 1, 30), 1), ("a", d(2026, 1, 10), 2), ("a", d(2025, 12, 1), 1), ("a", d(2026, 3, 1), 1), ("a", d(2020, 1, 31), 1)], "repo_key string, committed_at timestamp, author long")
    pulls = spark.createDataFrame([("a", d(2026, 1, 1), 900), ("a", d(2020, 1, 1), 5000), ("a", None, 7000), ("b", d(2020, 1, 1), 3)], "repo_key string, merged_at timestamp, additions long")
    got = {r.repo_key: tuple(r)[1:] for r in evidence.repo_activity(commits, pulls, NOW).collect()}
    assert got == {"a": (1, 2, 3, 1, 900.0), "b": (0, 0, 0, 0, 0.0)}
    meta = spark.createDataFrame([("a", 5, 2, 1, ["Go:7", "PY:1", "py:3"]), ("n", None, None, None, None)], "repo_key string, stars long, forks long, releases long, languages array<string>")
    got = {r.repo_key: r for r in evidence.repo_profile(meta, commits, NOW).collect()}
    assert (got["a"].age_y, got["a"].contributors, got["a"].commits, got["a"].languages) == (6.0, 2, 5, {"go": 7, "py": 3})
    assert (got["n"].age_y, got["n"].contributors, got["n"].languages) == (None, 0, None)


def test_a_text_that_yields_nothing_still_takes_budget(spark):
    from datetime import datetime as d

    now = d(2026, 1, 31)
    programs = [("useful", "baseline", "Critical: $5,000"), ("low", "baseline", "Low ones are out of scope"), ("reports", "baseline", "12 valid reports"), ("idle", "baseline", "no word of money"), ("same", "new_target", " text "), ("none", "new_program", None), ("kept", "baseline", ""), ("was_fresh", "new_target", "new words")]
    import hashlib

    h = hashlib.sha256(b"text").hexdigest()
    cache_rows = [("same", "partial", now, h), ("kept", "ok", now, None), ("was_fresh", "ok", now, "x"), ("gone", "ok", now, None)]
    p = spark.createDataFrame(programs, "program_id string, change_type string, policy_text string")
    c = spark.createDataFrame(cache_rows, "program_id string, status string, fetched_at timestamp_ntz, inline_hash string")
    got = {r.program_id: (r.action, r.reread) for r in cache.policy_refresh(p, c, NOW, budget=3).collect()}
    assert got == {"useful": ("inline", True), "low": ("inline", True), "reports": ("inline", True), "same": ("fetch", False), "none": ("fetch", False), "idle": ("fetch", True), "kept": ("keep", False), "was_fresh": ("wait", True)}
    assert {r.action for r in cache.policy_refresh(p, c, NOW, budget=0).collect()} == {"inline", "keep", "wait"}


def test_signals_are_found_under_both_forms_of_a_key(spark):
    targets = spark.createDataFrame([("1", "https://github.com/o/a"), ("2", "git@github.com:o/b.git"), ("3", "https://gitlab.com/g/s/c"), ("4", "https://github.com/o/d"), ("5", "plain"), ("1", "https://github.com/o/a")], "target_key string, value string")
    signals = spark.createDataFrame([("o/a", "ok", 1), ("github:o/a", "ok", 2), ("github:o/b", "failed", 3), ("gitlab:g/s/c", "ok", 4)], "repo_key string, status string, stars long")
    got = {r.target_key: (r.repo_key, r.provider, r.full_name, r.status, r.stars) for r in state.signals_lookup(targets, signals).collect()}
    assert got == {"1": ("o/a", "github", "o/a", "ok", 1), "2": ("o/b", "github", "o/b", "failed", 3), "3": ("gitlab.com/g/s/c", "gitlab", "g/s/c", "ok", 4), "4": ("o/d", "github", "o/d", "pending", None), "5": (None,) * 5}


def _targets(spark, rows):
    named = ["program_id", "target_key", "type", "value", "repo_key", "ev_score", "p_findable", "exclude_reason"]
    df = spark.createDataFrame(rows, "program_id string, target_key string, type string, value string, repo_key string, ev_score double, p_findable double, exclude_reason string")
    more = {c: F.lit(None).cast("string") for c in (*rank.FIELDS, "name", "platform", "url", "max_reward", "resolved_reports") if c not in named}
    return df.withColumns(more)


def test_best_target_and_what_is_published(spark):
    rows = [("p", f"k{i:02}", "web", "v", None, float(i % 5), 0.5, None) for i in range(40)] + [("p", "best", "web", "v", "o/r", 4.0, 0.9, None), ("p", "out", "web", "v", "o/pending", 0.0, 1.0, "no"), ("q", "b", "web", "v", "o/pending", 0.0, 0.1, "x"), ("q", "a", "web", "v", "o/r", 0.0, 0.1, "x")]
    df = _targets(spark, rows)
    best = rank.best_target(df)
    assert {(r.program_id, r.target_key, r.targets) for r in best.collect()} == {("p", "best", 42), ("q", "a", 2)}
    assert rank.best_target(df.limit(0)).count() == 0
    signals = spark.createDataFrame([("o/r", "ok", 7, ["a"] * 50, {"go": 1}), ("o/pending", "pending", 9, None, None)], "repo_key string, status string, stars long, files_added_90d_list array<string>, languages map<string,long>")
    got = {r.program_id: r.targets for r in state.public_projection(df, best, state.compact_signals(signals)).collect()}
    assert [t.target_key for t in got["p"]] == ["best", *(f"k{i:02}" for i in (4, 9, 14, 19, 24, 29, 34, 39, 3, 8, 13, 18, 23, 28, 33))] and [t.position for t in got["p"]] == list(range(1, 17))
    assert got["p"][0].repo_signals.stars == 7 and len(got["p"][0].repo_signals.files_added_90d_list) == 40 and got["p"][1].repo_signals is None
    assert [(t.target_key, t.is_best, t.repo_signals.status, t.repo_signals.stars) for t in got["q"]] == [("a", True, "ok", 7), ("b", False, "pending", None)] and got["q"][1].repo_signals.files_added_90d_list == []


def test_best_target_cuts_groups_before_the_shuffle(spark):
    plan = rank.best_target(_targets(spark, [("p", "k", "web", "v", None, 1.0, 1.0, None)]))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "SortAggregate" not in plan


def test_counts_of_a_refresh(spark):
    stale = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("gitlab.com/d/e", True)], "repo_key string, stale boolean")
    results = spark.createDataFrame([("a", "ok"), ("b", "failed"), ("other", "ok")], "repo_key string, status string")
    after = spark.createDataFrame([("a", "ok"), ("b", "pending"), ("c", "ok")], "repo_key string, status string")
    assert state.enrich_stats(stale, results, after, 2).first().asDict() == {"discovered": 4, "stale": 3, "scheduled": 2, "deferred": 1, "attempted": 2, "updated": 1, "failed": 1, "pending": 2, "github": 3, "gitlab": 1}


def test_evaluation_joins_programs_and_repositories_once_and_keeps_what_is_read(spark):
    from scopesift.plans import flow

    rows = spark.createDataFrame([("a", "https://GitHub.com/o/r", 1), ("b", "x.example.org", 2), ("c", "gitlab.com/none", 3), ("d", None, 4)], "target_key string, value string, n int")
    homes = spark.createDataFrame([("a", "https://GitHub.com/o/r", "o/r")], "target_key string, value string, repo_key string")
    got = flow.located(rows, homes)
    assert sorted((r.n, r.repo_key) for r in got.collect()) == [(1, "o/r"), (2, None), (3, None), (4, None)]
    assert flow.evaluated(spark, "/root/testdata/sf0.001").columns == flow.EVALUATED
    assert "target_flags" not in flow.merged(spark, "/root/testdata/sf0.001")[1].columns


def test_repo_status_needs_no_earlier_snapshot(spark):
    from scopesift.plans import flow, registry

    flow.forget()
    sf = "/root/testdata/sf0.001"
    assert registry.QUERIES["repo_status"](spark, sf).where("repo_status = 'pending' AND repo_key IS NULL").count() == 0
    assert not {"targets_before", "changes", "signals"} & {k[2] for k in flow._STATE}


def test_equal_targets_of_a_record_leave_no_choice(spark):
    import itertools

    one = ("r", "k", 1, "smart-contract", "0x1", None, None)
    for order in itertools.permutations([(*one, ""), (*one, None), (*one[:4], "0X1", None, None, "")]):
        df = spark.createDataFrame(list(order), "record_no string, target_key string, ordinal int, type string, value string, added_at timestamp_ntz, description string, impact string").coalesce(1)
        assert merge.dedupe_targets(df).select("value", "impact").collect() == [Row(value="0x1", impact="")]


def test_targets_are_trimmed_and_typed_as_their_patterns_say(spark):
    import re

    kinds = ["Source_Code", "smart contract", "smartcontract", "smart__contract", "Blockchain_Contract", "GraphQL", "ip_address", "other thing", "", None, "web-application", "IoT"]
    values = [" a ", " b  c　", "  ", "", None, "d  e", "\tf"]
    raw = spark.createDataFrame([(k, v) for k in kinds for v in values], "raw_type string, value string").selectExpr("'r' AS record_no", "1 AS ordinal", "raw_type", "value", "CAST(NULL AS timestamp_ntz) AS added_at", "CAST(NULL AS boolean) AS eligible")
    kind = lambda k: next((n for n, p in merge.TYPE_PATTERNS if re.search(p, (k or "other").lower().replace("_", "-"))), None) or ("other" if k in (None, "") else k.lower().replace("_", "-"))
    want = sorted((kind(k), v.strip()) for k in kinds for v in values if v and v.strip())
    assert sorted((r.type, r.value) for r in merge.norm_targets(raw).collect()) == want


def _joins(df):
    return str(df._jdf.queryExecution().optimizedPlan().toString()).count("Join ")


def test_feed_pages_are_dealt_out_and_parsed_once(spark, tmp_path):
    from scopesift.operators import normal
    from scopesift.sources.fixtures import FEEDS, view

    # a narrow table of many rows in one file, of less than a MB
    spark.sql("SELECT id AS c_custkey, 'BUILDING' AS c_mktsegment, CAST(1 AS DOUBLE) AS c_acctbal FROM range(60000)").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    records = feeds.src_feeds(view(spark, str(tmp_path), "fx_feeds"))
    assert records.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    sources = spark.createDataFrame(FEEDS, "source_id string, homepage string, url_template string, paid_only boolean, priority int")
    plan = normal.norm_programs(records, sources)
    assert _joins(plan) == 1  # the sources; no join of the records with what was read from them
    assert "hashpartitioning(source_id" not in plan._jdf.queryExecution().executedPlan().toString()  # nor one task for each source


def test_overrides_do_not_shuffle_programs(spark):
    programs = spark.createDataFrame([("program:a", "A"), ("program:b", "B")], "program_id string, name string")
    plan = state.override_join(programs, spark.createDataFrame([("A", "LOW")], "key string, floor string"))
    assert "hashpartitioning(key" not in plan._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in plan.collect()] == [("program:a", "LOW")]


def test_targets_are_dealt_out_by_record_and_counted_once_in_a_diff(spark):
    rows = [(r, i, f"k{i % 3}", "web", f"v{i}", None, None, None) for r in range(6) for i in range(5)]
    t = merge.dedupe_targets(spark.createDataFrame(rows, "record_no long, ordinal long, target_key string, type string, value string, added_at timestamp, description string, impact string"))
    assert str(t._jdf.queryExecution().executedPlan().toString()).count("Exchange hashpartitioning(record_no") == 1
    where = t.withColumn("p", F.spark_partition_id()).groupBy("record_no").agg(F.count_distinct("p").alias("n"), F.count("*").alias("rows")).collect()
    assert {(r.n, r.rows) for r in where} == {(1, 3)}
    keyed = merge.keyed_targets(spark.createDataFrame([(0, "m", 1), (1, "m", 2), (2, "o", 1)], "record_no long, merge_key string, lead_rank int"), t)
    assert sorted(tuple(r) for r in merge.merged_keys(keyed).collect()) == [(m, f"k{i}", "web") for m in "mo" for i in range(3)]
    assert sorted((r.merge_key, r.target_key, r.value) for r in merge.merge_keyed(keyed).collect()) == [(m, f"k{i}", v) for m in "mo" for i, v in enumerate(("v3", "v4", "v2"))]
    # only keys that stand in several records are dealt out: the same rows, also where a hash is not one of a merged key
    keyed = keyed.unionByName(keyed.where("record_no = 0").withColumns({"target_key": F.lit("alone"), "value": F.concat("target_key", F.lit("!"))}).limit(1)).unionByName(keyed.withColumns({"merge_key": F.lit(None).cast("string"), "target_key": F.lit("k0")}))
    several = merge.shared_keys(keyed)
    assert several.count() == 4  # three of m, one without a program
    for found in (several, several.unionByName(spark.sql("SELECT xxhash64('m', 'alone') AS h")), keyed.select(F.xxhash64("merge_key", "target_key").alias("h")).distinct()):
        assert sorted(map(str, merge.merge_keyed(keyed, found).collect())) == sorted(map(str, merge.merge_keyed(keyed).collect()))
        assert sorted(map(str, merge.merged_keys(keyed, found).collect())) == sorted(map(str, merge.merged_keys(keyed).collect()))
    # rows of several records are one target, a missing key is like no other
    many = spark.createDataFrame([("m", "a"), ("m", "a"), ("m", "b"), (None, "a")], "merge_key string, target_key string")
    old = spark.createDataFrame([("m", "c"), ("m", "b"), ("m", "b"), (None, "a")], "merge_key string, target_key string")
    assert {tuple(r) for r in diff.diff_targets(many, old).collect()} == {("m", 1, 1), (None, 1, 1)}


def test_programs_merge_no_whole_targets(spark):
    from scopesift.plans import flow

    flow.forget()
    flow.programs(spark, "/root/testdata/sf0.001").count()
    names = {k[2] for k in flow._STATE}
    assert "programs" in names and "targets" not in names


def test_scope_holds_own_and_merged_targets_of_both_snapshots(spark):
    """One pass over items and texts gives what norm, dedupe, merge and diff give of each snapshot."""
    import random

    rng = random.Random(3)
    texts = [(n, rng.choice(["api", "smart_contract", "source_code", "x"]), rng.choice([" V 1", "v  1", "v2 ", "https://github.com/o/r", "0x1", "0X1", " "]), rng.choice(["", None, "the wallet", "smart"]), rng.choice(["", None, "core"])) for n in range(40)]
    submissions = [(n, rng.randrange(8), f"2001-01-{1 + n % 28:02d} 00:00:00", n % 3 > 0) for n in range(60)]
    items = [(rng.randrange(60), rng.randrange(12), rng.choice([True, True, None, False]), rng.randrange(44)) for _ in range(900)]
    t = spark.createDataFrame(texts, "text_no long, raw_type string, value string, description string, impact string")
    s = spark.createDataFrame(submissions, "submission_no long, record_no long, added_at string, before boolean").withColumn("added_at", F.col("added_at").cast("timestamp_ntz"))
    i = spark.createDataFrame(items, "submission_no long, ordinal long, eligible boolean, text_no long")
    # record 2 changes its program, 6 is new, 7 went
    now = spark.createDataFrame([(r, "mno"[r % 3] if r != 2 else "p", 1 + r // 3) for r in range(7)], "record_no long, merge_key string, lead_rank int")
    old = spark.createDataFrame([(r, "mno"[r % 3], 4 - r // 3) for r in range(8) if r != 6], "record_no long, merge_key string, lead_rank int")
    got = merge.scope(s, i, merge.norm_texts(t), now, old)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(merge_key") == 1
    got = got.cache()
    raw = i.join(s, "submission_no").join(t, "text_no")
    merged = {}
    for records, rows, own, top, lead in ((now, raw, "own", "top", "lead_rank"), (old, raw.where("before"), "own_before", "top_before", "lead_before")):
        keyed = merge.keyed_targets(records, merge.dedupe_targets(merge.norm_targets(rows))).where("listed").withColumn("rank", F.col("lead_rank"))
        fields = ["merge_key", "record_no", "target_key", "ordinal", "type", "value", "added_at"]
        assert sorted(map(str, got.where(own).select(*fields, F.col(lead).alias("lead")).collect())) == sorted(map(str, keyed.select(*fields, F.col("rank").alias("lead")).collect()))
        merged[top] = merge.merge_keyed(keyed).select("merge_key", "target_key", "type", "value", "added_at")
        assert sorted(map(str, got.where(top).select(merged[top].columns).collect())) == sorted(map(str, merged[top].collect())) != []
    want = diff.diff_targets(merged["top"], merged["top_before"])
    assert {tuple(r) for r in diff.count_changes(got).collect()} == {tuple(r) for r in want.collect()}


def test_what_hangs_on_a_program_or_repository_is_evaluated_once(spark):
    """Rows that come with of_repo, of_program and shape give what whole rows give; and no chain of projections is one method."""
    names = [f.name for f in spark.createDataFrame([], SCHEMA).schema]
    kinds = [dict(), dict(value="https://github.com/o/rlp-parser", repo_status="ok", languages=["Go"], stars=900, dev_known=True, files_added_90d=3), dict(type="web", value="api.x.org", repo_status=None, kyc_required=True, resolved_reports=None),
             dict(type="smart-contract", value="0x1", deployed=True, tx_30d=0, policy_floor="none"), dict(type="odd", value="*.x.org/a", override_floor=" high ", change_type="new_program"), dict(repo_status="pending", status=None)]
    rows = spark.createDataFrame([tuple((BASE | k).get(n) for n in names) for k in kinds], SCHEMA)
    made = value.of_program(value.of_repo(rows), NOW).withColumn("shape", value.shape(F.col("value"))).drop("stars", "dev_known", "kyc_required", "paid", "status", "override_floor", "policy_floor", "launched_at")
    keep = ["name", "value", "reason", "exclude_reason", "ev_score", "floor", "p_first", "hardening_index", "fresh_code_index", "known_issue_risk", "workflow", "findable_class", "ceiling", "label", "trap_tags"]
    whole = value.evaluate_targets(rows, NOW)
    assert sorted(map(str, value.evaluate_targets(made, NOW).select(keep).collect())) == sorted(map(str, whole.select(keep).collect()))
    assert whole._jdf.queryExecution().executedPlan().toString().count("Coalesce") == 3
