"""Normalised programs and targets of landed feed records, read from VARIANT values under all their aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import variants as v
from . import facts, feeds, merge
from .merge import CLOSED_WORDS, OPEN_WORDS, merge_slug, target_type

# The names under which feeds give a record's and a target's fields; the first that is given counts.
STATUS = ["submission_state", "status", "state", "program_status"]
HARBOR = ["safe_harbor", "safeHarbor"]
DISCLOSURE = ["allows_disclosure", "disclosure_allowed", "disclosureAllowed"]
ADDRESS, HANDLE = ["url", "program_url", "policy_url", "link"], ["handle", "slug", "id"]
PAID = ["offers_bounties", "offers_awards", "bounty", "paid", "rewarded"]
LAUNCHED = ["launched_at", "started_at", "created_at", "createdAt"]
REPORTS = ["resolved_reports", "reports_resolved", "resolvedReports", "valid_reports"]
INVITE, KYC = ["invite_only", "inviteOnly", "private"], ["kyc_required", "kycRequired"]
POLICY = ["description", "policy", "rules", "notes", "eligibility"]
ELIGIBLE = ["eligible_for_bounty", "eligible", "bounty_eligible"]
DESCRIPTION, IMPACT = ["description", "instructions", "notes"], ["impact", "tier", "severity"]
ADDED = ["added_at", "created_at", "first_seen_at", "addedAt"]


def norm_programs(records: DataFrame, sources: DataFrame) -> DataFrame:
    """records: of feeds.src_feeds; sources: source_id, homepage, url_template (with {id}), paid_only, priority. One row per record that is paid, or whose source takes unpaid ones too.

    Each step is a projection of its own, so that a value that is read often is taken from the record once.
    """
    raw = F.col("raw")
    # sources are a list of settings: the records stay where they are, and not in one task for each source
    df = feeds.with_rewards(records).join(F.broadcast(sources), "source_id")
    lists = {"status_in": STATUS, "harbor": HARBOR, "disclosure": DISCLOSURE, "address": ADDRESS, "handle": HANDLE, "paid_in": PAID, "launched": LAUNCHED, "reports": REPORTS, "invite": INVITE, "kyc": KYC}
    df = df.withColumns({k: v.first(raw, *keys) for k, keys in lists.items()} | {"shut": F.coalesce(v.boolean(v.at(raw, "disabled")), F.lit(False)) | F.coalesce(v.boolean(v.at(raw, "closed")), F.lit(False)), "banned": v.at(raw, "excluded_countries"), "bounty": v.at(raw, "bounty")}
                        | {f"text_{k}": v.at(raw, k) for k in POLICY})
    df = df.withColumns({"status_text": F.trim(F.coalesce(v.text(F.col("status_in")), F.lit("open"))), "direct": v.string(F.col("address")), "id": F.when(v.truth(F.col("handle")), v.text(F.col("handle"))), "said": v.boolean(F.col("paid_in")), "harbor_text": F.lower(F.trim(v.string(F.col("harbor")))),
                         **{f"text_{k}": F.when(v.truth(F.col(f"text_{k}")), v.text(F.col(f"text_{k}"))) for k in POLICY}})
    zero = F.lit(0.0)
    rewarded = (F.coalesce("max_reward", zero) > 0) | (F.coalesce("min_reward", zero) > 0)
    paid = F.coalesce("said", F.when(rewarded, True), F.when(F.col("adapter") == "projectdiscovery", v.truth(F.col("bounty"))), F.lit(False))
    status = F.when(F.col("shut") | F.col("status_text").rlike(CLOSED_WORDS), "closed").when(F.col("status_text").rlike(OPEN_WORDS) | (F.col("status_text") == ""), "open").otherwise(F.lower("status_text"))
    url = (F.when(F.col("direct").rlike("(?i)^https?://"), F.col("direct")).when(F.col("url_template").isNotNull() & F.col("id").isNotNull(), F.replace("url_template", F.lit("{id}"), v.uri_component(F.col("id"))))
           .otherwise(F.col("homepage")))
    countries = F.when(v.kind(F.col("banned")) == "ARRAY", F.transform(v.at(F.col("banned"), "", "array<variant>"), lambda x: v.at(x, "", "string"))).otherwise(F.array().cast("array<string>"))
    df = df.select("source_id", "page_no", "ordinal", merge_slug(F.col("name")).alias("merge_key"), "name", url.alias("url"), status.alias("status"), paid.alias("paid"), "currency", "min_reward", "max_reward",
                   F.when(v.boolean(F.col("harbor")), "program-defined").when(F.col("harbor_text") != "", F.col("harbor_text")).alias("safe_harbor"), v.boolean(F.col("disclosure")).alias("disclosure_allowed"),
                   v.moment(F.col("launched")).alias("launched_at"), v.number(F.col("reports")).alias("resolved_reports"), v.truth(F.col("invite")).alias("invite_only"), v.truth(F.col("kyc")).alias("kyc_required"),
                   countries.alias("countries"), F.substring(F.concat_ws(" ", *(f"text_{k}" for k in POLICY)), 1, 100_000).alias("policy_text"), F.concat_ws(" ", *(f"text_{k}" for k in POLICY[:-1])).alias("own_text"), F.coalesce("priority", F.lit(100)).alias("source_priority"), "paid_only")
    return df.where("paid OR paid_only = false").drop("paid_only")


def norm_targets(records: DataFrame) -> DataFrame:
    """One row per target of a record of feeds.src_feeds and key: eligible targets with a value, the last of equal keys. Unknown counts as eligible."""
    t = F.col("t")
    df = feeds.target_values(records)
    plain = v.string(t)
    df = df.withColumns({"value": F.trim(F.coalesce(plain, v.text(v.first(t, *feeds.TARGET_VALUES)))), "raw_type": F.when(F.col("plain"), "domain").otherwise(v.text(v.first(t, *feeds.TARGET_TYPES))),
                         "may": v.first(t, *ELIGIBLE), "said": v.first(t, *DESCRIPTION), "hurt": v.first(t, *IMPACT), "added": v.first(t, *ADDED)})
    df = df.where("value <> ''").where(F.col("may").isNull() | v.truth(F.col("may")))
    df = df.select("source_id", "page_no", "ordinal", "target_no", target_type(F.col("raw_type")).alias("type"), "value", *(F.when(v.truth(F.col(c)), F.substring(v.text(F.col(c)), 1, n)).alias(name) for c, n, name in (("said", 600, "description"), ("hurt", 120, "impact"))),
                   v.moment(F.col("added")).alias("added_at"))
    key = F.substring(F.sha2(F.concat("type", F.lit(":"), F.lower(F.regexp_replace("value", r"(?U)\s+", " "))), 256), 1, 16)
    fields = ["type", "value", "description", "impact", "added_at"]
    return df.withColumn("target_key", key).groupBy("source_id", "page_no", "ordinal", "target_key").agg(F.max_by(F.struct(*fields), "target_no").alias("t")).select("source_id", "page_no", "ordinal", "target_key", "t.*")


def feed_rows(records: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalised programs in lead order and their targets, by record_no. Both are read several times by a merge: write them first."""
    own = F.concat_ws(":", "source_id", F.col("page_no").cast("string"), F.col("ordinal").cast("string")).alias("record_no")
    rows = merge.lead_rank(norm_programs(records, sources).select(own, "*"))
    return rows, norm_targets(records).select(own, "target_key", F.lit(0).alias("ordinal"), "type", "value", "added_at", "description", "impact")


def feed_merge(rows: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged programs and targets of feed_rows: tagged by their whole texts, merged by entity in the order of their sources' priority. Targets of records that went do too."""
    targets = targets.join(rows.select("record_no"), "record_no", "left_semi")
    merged = merge.merge_targets(rows, targets)
    said = facts.record_facts(rows.select("record_no", F.col("own_text").alias("policy_text")), targets)
    return merge.merge_programs(rows, merged, said), merged
