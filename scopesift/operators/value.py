"""Expected value of each target: routing, class, probabilities, exclusions, score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import flags
from ..functions.exprs import SEVERITIES, clamp, days, half_up, severity_rank, yes

# Patterns over a target's search text in lower case; behind each, texts of which every match holds one.
ROUTING = {
    "mature_core": (r"crypto|signing|mpc|consensus|kernel|tls|wallet[-_ ]?core", ["crypto", "signing", "mpc", "consensus", "kernel", "tls", "wallet"]),
    "parser": (r"parser|serializer|codec|deseriali[sz]e|rlp|protobuf", ["parser", "serializer", "codec", "deseriali", "rlp", "protobuf"]),
    "crypto": (r"crypto|signing|signature|mpc|nonce|keystore|hsm|consensus|wallet[-_ ]?core", ["crypto", "signing", "signature", "mpc", "nonce", "keystore", "hsm", "consensus", "wallet"]),
    "auth": (r"oauth|oidc|saml|session|jwt|login|account[-_ ]?link|sso|authentication", ["oauth", "oidc", "saml", "session", "jwt", "login", "account", "sso", "authentication"]),
    "authz": (r"idor|bola|multi[-_ ]?tenant|rbac|k8s[-_ ]?operator|operator|iam|authorization", ["idor", "bola", "tenant", "rbac", "operator", "iam", "authorization"]),
    "ai": (r"(^|[^a-z])(ai|ml|llm|rag|mcp)([^a-z]|$)|agent|prompt[-_ ]?inject", ["ai", "ml", "llm", "rag", "mcp", "agent", "prompt"]),
    "contract": (r"solidity|defi|smart[-_ ]?contract|\bevm\b|vault", ["solidity", "defi", "contract", "evm", "vault"]),
    "payments": (r"payments?|checkout|billing|store|entitlement|subscription|invoice|cart", ["payment", "checkout", "billing", "store", "entitlement", "subscription", "invoice", "cart"]),
    "untrusted_input": (r"network|packet|socket|upload|file|wire|request|remote|untrusted|p2p", ["network", "packet", "socket", "upload", "file", "wire", "request", "remote", "untrusted", "p2p"]),
}
#: Phrases of two words that these patterns may find across a space.
PHRASES = {"mature_core": ["wallet core"], "crypto": ["wallet core"], "auth": ["account link"], "authz": ["multi tenant", "k8s operator"], "ai": ["prompt inject"], "contract": ["smart contract"]}
INVITE_WORDS = (r"\b(?:invite[- ]only|invitational)\b", ["invite", "invitational"])

_NAMES, _PATTERNS = list(ROUTING), list(ROUTING.values())
_SPANNING = list(dict.fromkeys(tuple(p.split(" ")) for v in PHRASES.values() for p in v))
_SPANNED = [sum(1 << _NAMES.index(k) for k, v in PHRASES.items() if " ".join(p) in v) for p in _SPANNING]

LIVE = ["live-web", "live-api", "live-contract", "ai-agent"]
HOSTED = r"(?i)github\.com|gitlab\.com"

# Class -> ceiling, fit, label.
CLASSES = {
    "account-takeover": ("CRITICAL", 0.95, "ATO"), "cross-tenant-authz": ("CRITICAL", 0.90, "cross-tenant"), "agent-sink-chain": ("HIGH", 0.65, "exfil/SSRF"),
    "contract-loss": ("CRITICAL", 0.55, "contract loss"), "business-logic": ("CRITICAL", 0.85, "price/authz"), "native-parser-memory": ("HIGH", 0.62, "memory corruption"),
    "managed-parser-dos": ("LOW", 0.90, "DoS"), "parser-dos": ("MEDIUM", 0.72, "parser DoS"), "mature-crypto-core": ("CRITICAL", 0.08, "crypto break"),
    "api-authz": ("HIGH", 0.82, "API authz"), "web-business-logic": ("HIGH", 0.80, "web authz"), "source-review": ("MEDIUM", 0.38, "source flaw"),
}


def add_told(df: DataFrame, name: str, text: Column) -> DataFrame:
    """Adds the routing flags of one part of a search text."""
    return flags.add_told(df, name, text, _PATTERNS).withColumn(name, flags.sides(F.col(name), _SPANNING))


def target_text() -> Column:
    """A target's own part of the search text: type, value, description and impact."""
    return F.concat_ws(" ", *(F.when(F.col(c) != "", F.col(c)) for c in ("type", "value", "description", "impact")))


def repo_text() -> Column:
    """A repository's part: name, branch, languages, top paths and added files. What is missing leaves no gap."""
    some = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x != "")
    one = lambda c: some(F.array(F.col(c)))
    return F.array_join(F.concat(one("repo_key"), one("default_branch"), some("languages"), some("top_paths"), some("added_list")), " ")


def invites(text: Column) -> Column:
    return flags.fits(flags.plain(text), INVITE_WORDS)


def search_flags(df: DataFrame) -> DataFrame:
    """Adds marks, a bit for each pattern of ROUTING over name, type, value, description, impact, tags, languages and what is known of the repository, and
    mature, the first one also with the repository's part twice in a row.

    The parts' flags (name_flags, target_flags, rest_flags, repo_flags) come with their records; where a column is missing it is made here.
    """
    for c, kind in (("description", "string"), ("impact", "string"), ("default_branch", "string"), ("top_paths", "array<string>"), ("added_list", "array<string>"), ("spoken", "array<string>")):
        if c not in df.columns and not {"name_flags", "target_flags", "rest_flags", "repo_flags"} <= set(df.columns):
            df = df.withColumn(c, F.lit(None).cast(kind))
    none = F.array().cast("array<string>")
    made = {"name_flags": lambda: F.col("name"), "target_flags": target_text, "rest_flags": lambda: F.array_join(F.concat(F.coalesce("tags", none), F.coalesce("spoken", none)), " "), "repo_flags": repo_text}
    for c, text in made.items():
        if c not in df.columns:
            df = add_told(df, c, text())
    parts = [F.col(c) for c in ("name_flags", "target_flags", "rest_flags", "repo_flags")]
    core = _NAMES.index("mature_core")
    df = df.withColumn("marks", flags.joint(parts, _SPANNED))
    repo = F.col("repo_flags")
    return df.withColumn("mature", flags.has(F.col("marks"), core) | flags.has(flags.joint([repo, repo], _SPANNED), core))


def marked(name: str) -> Column:
    return flags.has(F.col("marks"), _NAMES.index(name))


#: Languages that a class asks for, by bit.
TONGUES = [("c", "c++", "cpp"), ("go", "rust")]


def tongues(languages: Column) -> Column:
    """Bit i: one of the i-th group of languages is among them, in either case."""
    every = F.transform(F.coalesce(languages, F.array().cast("array<string>")), F.lower)
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.coalesce(F.arrays_overlap(every, F.lit(list(names))), F.lit(False)), 1 << i).otherwise(0) for i, names in enumerate(TONGUES)))


def shape(value: Column) -> Column:
    """What a value looks like, by bit: a host of repositories, an api, an address with a scheme, a domain."""
    v = flags.lowered(F.coalesce(value, F.lit("")))
    some = [HOSTED, "(^|[./_-])api([./_-]|$)", "^https?://", r"^(?:\*\.)?[a-z0-9-]+(?:\.[a-z0-9-]+)+(?::\d+)?(?:/|$)"]
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(v.rlike(p), 1 << i).otherwise(0) for i, p in enumerate(some)))


def of_repo(df: DataFrame) -> DataFrame:
    """What the evaluation makes of a repository alone, so that it is made once for each and not for each target: hard_base and fresh_base (scores without what the target and its program add), known_issue_risk,
    marked (a trap is known) and repo_tongues."""
    hard = (F.least(F.lit(30.0), F.greatest(F.lit(0.0), F.coalesce("stars", F.lit(0)) / 300.0)) + F.when(yes(F.col("sec_tooling")), 20).otherwise(0)
            + F.when(yes(F.col("age_y") > 4), 15).otherwise(0) + F.when(yes(F.col("contributors") > 100), 15).otherwise(0)
            + F.when(yes(F.col("advisories_resolved") >= 3), 10).otherwise(0))
    fresh = (F.least(F.lit(35.0), F.greatest(F.lit(0.0), F.coalesce("commits_90d", F.lit(0)) / 2.0)) + F.least(F.lit(25.0), F.greatest(F.lit(0.0), F.coalesce("files_added_90d", F.lit(0)) * 3.0))
             + F.when(yes(F.col("max_additions_90d") > 800), 20).otherwise(0))
    marked = yes(F.col("dev_known")) | yes(F.col("traps") > 0)
    risk = F.when(marked, 40).otherwise(0) + F.when(yes(F.col("advisory_match")), 30).otherwise(0) + F.when(yes(F.col("security_fix_gated")), 30).otherwise(0)
    return df.withColumns({"hard_base": hard, "fresh_base": F.when(yes(F.col("repo_status") != "pending"), fresh).otherwise(0.0), "known_issue_risk": risk, "marked": marked, "repo_tongues": tongues(F.col("languages"))})


def of_program(df: DataFrame, now: str) -> DataFrame:
    """What the evaluation makes of a program alone, once for each: its floor, p_first, program_tongues, and reasons for targets in source and for all others."""
    df = p_first(floor_resolve(df), now)
    df = eligibility(df.withColumn("workflow", F.lit("static-source"))).withColumnRenamed("reasons", "reasons_source")
    df = eligibility(df.withColumn("workflow", F.lit(""))).withColumnRenamed("reasons", "reasons_rest").drop("workflow")
    spoken = F.col("spoken") if "spoken" in df.columns else F.lit(None).cast("array<string>")
    return df.withColumns({"floor_rank": severity_rank(F.col("floor")), "program_tongues": tongues(spoken)})


#: What evaluate_targets reads of these two.
OF_REPO = ["repo_status", "hard_base", "fresh_base", "known_issue_risk", "marked", "repo_tongues", "files_added_90d", "repo_flags"]
OF_PROGRAM = ["name", "platform", "url", "max_reward", "resolved_reports", "change_type", "change_at", "name_flags", "rest_flags", "floor", "floor_source", "floor_rank", "reports", "reports_estimated", "p_first", "reasons_source", "reasons_rest", "program_tongues"]


def hardening_index(df: DataFrame) -> DataFrame:
    """0..100 to one decimal; null unless repository signals are ok."""
    return df.withColumn("hardening_index", F.when(yes(F.col("repo_status") == "ok"), half_up(clamp(F.col("hard_base") + F.when(F.col("mature"), 10).otherwise(0), 0.0, 100.0), 1)))


def recent_scope(df: DataFrame, now: str) -> DataFrame:
    """A new program's scope, a target that was first seen at the program's last change, or one of less than 45 days. A baseline has none."""
    at = F.lit(now).cast("timestamp")
    age = days(F.coalesce("added_at", "first_seen_at"), at)
    changed = F.col("change_at") if "change_at" in df.columns else F.lit(None)
    fresh = (F.when(F.col("change_type") == "baseline", False).when(F.col("change_type") == "new_program", True)
             .when((F.col("change_type") == "new_target") & yes(F.col("first_seen_at").cast("timestamp") == changed.cast("timestamp")), True).otherwise(yes(age < 45)))
    return df.withColumn("recent_scope", fresh)


def fresh_code_index(df: DataFrame) -> DataFrame:
    return df.withColumn("fresh_code_index", half_up(clamp(F.coalesce("fresh_base", F.lit(0.0)) + F.when(F.col("recent_scope"), 20).otherwise(0), 0.0, 100.0), 1))


def known_issue_risk(df: DataFrame) -> DataFrame:
    return df.withColumn("known_issue_risk", F.coalesce("known_issue_risk", F.lit(0)))


def route(df: DataFrame) -> DataFrame:
    """base_workflow: the first of nine tests that holds."""
    t, looks = F.col("type"), lambda i: flags.has(F.col("shape"), i)
    df = df.withColumns({"repo": F.col("repo_status").isNotNull() | looks(0), "contract": marked("contract")})
    repo, contract = F.col("repo"), F.col("contract")
    return df.withColumn("base_workflow", F.when((t == "smart-contract") | (contract & F.col("deployed").isNotNull()), "live-contract")
                         .when(~repo & marked("ai"), "ai-agent").when(~repo & ((t == "api") | looks(1)), "live-api")
                         .when(~repo & t.isin("web", "domain", "url", "mobile"), "live-web")
                         .when(repo | t.isin("source-code", "firmware", "hardware", "executable", "binary"), "static-source")
                         .when(looks(2) | looks(3), "live-web").when(contract, "live-contract").otherwise("static-source"))


def findable_class(df: DataFrame) -> DataFrame:
    """findable_class with its ceiling, fit and label, and the workflow that the class may rewrite. The class is a number first, and what hangs on it is looked up."""
    w = F.col("base_workflow")
    live = w.startswith("live-") | (w == "ai-agent")
    spoken = F.coalesce("repo_tongues", F.lit(0)).bitwiseOR(F.coalesce("program_tongues", F.lit(0)))
    names = list(CLASSES)
    no = lambda name: F.lit(names.index(name))
    kind = (F.when(live & marked("auth"), no("account-takeover")).when(live & marked("authz"), no("cross-tenant-authz")).when((w == "ai-agent") | (marked("ai") & live), no("agent-sink-chain"))
            .when((w == "live-contract") | (F.col("contract") & yes(F.col("deployed"))), no("contract-loss")).when(live & marked("payments"), no("business-logic"))
            .when(marked("parser"), F.when(marked("untrusted_input") & flags.has(spoken, 0), no("native-parser-memory")).when(flags.has(spoken, 1), no("managed-parser-dos")).otherwise(no("parser-dos")))
            .when(marked("crypto"), no("mature-crypto-core")).when(w == "live-api", no("api-authz")).when(w == "live-web", no("web-business-logic")).otherwise(no("source-review")))
    df = df.withColumn("class_no", kind)
    k = F.col("class_no")
    pick = lambda values: F.get(F.lit(list(values)), k)
    hard = yes(F.col("hardening_index") >= 55) & (F.col("fresh_code_index") < 40)
    workflow = F.when(k == no("agent-sink-chain"), "ai-agent").when(k == no("contract-loss"), "live-contract").when((w == "static-source") & hard, "static-source-hardened").otherwise(w)
    return df.withColumns({"findable_class": pick(names), "ceiling": pick(v[0] for v in CLASSES.values()), "ceiling_rank": pick(SEVERITIES.index(v[0]) for v in CLASSES.values()), "fit": pick(v[1] for v in CLASSES.values()),
                           "label": pick(v[2] for v in CLASSES.values()), "workflow": workflow}).drop("repo", "contract")


def floor_resolve(df: DataFrame) -> DataFrame:
    """The program's floor: override, then policy, then MEDIUM, and where it came from."""
    if "policy_floor_source" not in df.columns:
        df = df.withColumn("policy_floor_source", F.lit(None).cast("string"))
    return df.withColumns({"floor": F.coalesce("override_floor", "policy_floor", F.lit("MEDIUM")),
                           "floor_source": F.when(F.col("override_floor").isNotNull(), "override").when(F.col("policy_floor").isNotNull(), F.coalesce("policy_floor_source", F.lit("scraped-reward-table"))).otherwise("conservative-default")})


def _texts(*pairs: tuple[Column, Column], sep: str = "; ") -> Column:
    """Texts whose condition holds, in order, as one text; empty where none does."""
    return F.concat_ws(sep, *(F.when(yes(c), t) for c, t in pairs))


def eligibility(df: DataFrame, country: str = "IN") -> DataFrame:
    """reasons: why the researcher could not be paid, in order, as one text; empty where eligible. Columns of overrides and of a record that are missing count as null."""
    of = lambda c: yes(F.col(c)) if c in df.columns else F.lit(False)
    banned = F.lit(False)
    if "override_countries" in df.columns:
        banned = yes(F.array_contains(F.transform("override_countries", F.upper), country.upper()))
    barred = ~F.coalesce("override_eligible", F.lit(True)) if "override_eligible" in df.columns else F.lit(False)
    why = F.coalesce("override_eligibility_reason", F.lit("program override marks researcher ineligible")) if "override_eligibility_reason" in df.columns else F.lit("program override marks researcher ineligible")
    invites_ = of("invite_words") if "invite_words" in df.columns else invites(F.col("name"))
    return df.withColumn("reasons", _texts(
        (~yes(F.col("paid")), F.lit("program is not confirmed paid")), (F.coalesce("status", F.lit("")) != "open", F.lit("program is not open")),
        (~F.coalesce("eligible", F.lit(True)) if "eligible" in df.columns else F.lit(False), F.lit("target is not bounty eligible")), (barred, why),
        (of("invite_only") | of("policy_invite_only") | of("override_invite_only") | invites_, F.lit("invite-only program")), (of("kyc_required") | of("policy_kyc") | of("override_kyc_required"), F.lit("KYC required")),
        ((of("excludes_in") & F.lit(country.upper() == "IN")) | banned, F.lit(f"{country.upper()} researchers excluded")),
        (of("override_safe_harbor_required") & (of("override_no_safe_harbor") | of("no_safe_harbor")) & (F.col("workflow") != "static-source"), F.lit("required safe harbor is absent"))))


def p_first(df: DataFrame, now: str) -> DataFrame:
    r = F.greatest(F.lit(0), F.coalesce("resolved_reports", "policy_reports", F.lit(25)))
    young = F.when(yes(days(F.col("launched_at"), F.lit(now).cast("timestamp")) < 90), 1).otherwise(0)
    crowd = F.when(r == 0, 1.0).otherwise(F.least(F.lit(1.0), 1 / F.ln(1 + r)))
    return df.withColumns({"reports": r, "reports_estimated": F.col("resolved_reports").isNull() & F.col("policy_reports").isNull(), "p_first": half_up(clamp(0.2 + 0.5 * young + 0.3 * crowd), 3)})


def p_findable(df: DataFrame) -> DataFrame:
    h, f, w = F.col("hardening_index"), F.col("fresh_code_index"), F.col("workflow")
    p = clamp(0.15 + 0.45 * (f / 100) + F.coalesce(0.30 * ((100 - h) / 100), F.lit(0.0)) + 0.10 * F.col("fit"))
    p = p * F.when(F.col("findable_class") == "mature-crypto-core", 0.2).otherwise(1.0) * F.when(w == "static-source-hardened", 0.45).otherwise(1.0)
    p = p * F.when((w == "static-source") & (f < 50), F.when(yes(F.col("repo_status") == "ok"), 0.7).otherwise(0.3)).otherwise(1.0)
    return df.withColumn("p_findable", half_up(clamp(p), 3))


def p_payable(df: DataFrame) -> DataFrame:
    reaches = F.when(F.col("ceiling_rank") >= F.col("floor_rank"), 1).otherwise(0)
    return df.withColumn("p_payable", half_up(reaches * (1 - F.col("known_issue_risk") / 100) * F.when(F.col("reasons") == "", 1).otherwise(0), 3))


def exclusions(df: DataFrame, jump: float = 40.0) -> DataFrame:
    """dormant, exclude_reason and trap tags. An audited target (columns of cache.audit_match) stays out unless its code has become fresher by more than ``jump``."""
    dormant = (F.col("workflow") == "live-contract") & yes(F.col("deployed")) & (yes(F.col("tx_30d") == 0) | (yes(F.col("tvl") == 0) if "tvl" in df.columns else F.lit(False)))
    dos = (F.col("class_no") == list(CLASSES).index("managed-parser-dos")) & (F.col("floor_rank") > 1)
    df = df.withColumns({"dormant": dormant, "dos": dos, "under": F.col("ceiling_rank") < F.col("floor_rank")})
    dos = F.col("dos")
    parts = [(dos, F.concat("ceiling", F.lit(" DoS ceiling is below the "), "floor", F.lit(" program floor"))), (~dos & F.col("under"), F.concat("ceiling", F.lit(" severity ceiling is below the "), "floor", F.lit(" program floor"))),
             ((F.col("hardening_index") > 70) & (F.col("fresh_code_index") < 25), F.lit("mature hardened source with little fresh code")), (F.col("known_issue_risk") >= 60, F.lit("known-issue risk is 60 or higher")),
             (F.col("reasons") != "", F.col("reasons")), (F.col("dormant"), F.lit("deployed contract surface has zero recent use or value"))]
    if "audit_no" in df.columns:
        still = F.col("audit_no").isNotNull() & (F.col("fresh_code_index") - F.coalesce("fresh_at_audit", F.lit(0.0)) <= jump)
        parts.append((still, F.concat(F.lit("audited "), "verdict", F.lit(" target: "), "audit_key")))
    every = _texts(*parts)
    tags = _texts((F.col("marked"), F.lit("DEV_KNOWN")), (dos, F.lit("DOS_CEILING")), (F.col("dormant"), F.lit("DORMANT")), sep=",")
    return df.withColumns({"exclude_reason": F.when(every != "", every), "trap_tags": F.when(tags != "", F.split(tags, ",")).otherwise(F.array().cast("array<string>"))}).drop("dos", "under")


def ev_score(df: DataFrame, cap: float = 50_000.0) -> DataFrame:
    reward = F.least(F.greatest(F.lit(0.0), F.coalesce("max_reward", F.lit(0.0))), F.lit(max(1.0, cap)))
    return df.withColumns({"effective_reward": reward, "ev_score": F.when(F.col("exclude_reason").isNotNull(), 0.0).otherwise(half_up(reward * F.col("p_findable") * F.col("p_payable") * F.col("p_first"), 2))})


def reason_text(df: DataFrame) -> DataFrame:
    """At most five of six parts; the last is left out where all others hold."""
    ok = yes(F.col("repo_status") == "ok")
    fresh = F.when(F.col("fresh_code_index") >= 50, "fresh code").when(F.col("recent_scope"), "fresh scope")
    hard = F.when(ok & (F.col("hardening_index") < 35), "low hardening signal").when(ok & (F.col("hardening_index") >= 60), "mature review surface")
    crowd = F.when(~F.col("reports_estimated") & (F.col("reports") < 10), "low recorded crowd")
    files = F.when((F.col("files_added_90d") > 0) & (fresh.isNull() | hard.isNull() | crowd.isNull()), F.concat(F.col("files_added_90d").cast("string"), F.lit(" files added/90d")))
    return df.withColumn("reason", F.concat_ws(" + ", fresh, F.replace("workflow", F.lit("-"), F.lit(" ")), F.concat("label", F.lit(" ceiling "), "ceiling"), hard, crowd, files))


def apart(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions: what follows is compiled apart from what comes before. One chain of this length becomes one method of more than 8,000 bytes, which the JVM never compiles but
    interprets, at about four times the cost."""
    return df.coalesce(1 << 16)


def evaluate_targets(joined: DataFrame, now: str, cap: float = 50_000.0) -> DataFrame:
    """All of the above: one row per target in, one out; one projection chain, no shuffle. What of_repo, of_program and shape add may come with the rows of a repository, a program and a text;
    where it does not, it is made here."""
    df = search_flags(joined)
    df = df if "hard_base" in df.columns else of_repo(df)
    df = df if "floor_rank" in df.columns else of_program(df, now)
    df = df if "shape" in df.columns else df.withColumn("shape", shape(F.col("value")))
    df = fresh_code_index(recent_scope(hardening_index(df), now))
    df = apart(findable_class(route(known_issue_risk(apart(df)))))
    df = df.withColumn("reasons", F.when(F.col("workflow") == "static-source", F.col("reasons_source")).otherwise(F.col("reasons_rest")))
    df = apart(p_payable(p_findable(df)))
    return reason_text(ev_score(exclusions(df), cap))
