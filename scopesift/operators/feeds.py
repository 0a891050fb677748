"""Reading feeds: record arrays in landed payloads, nested targets and rewards, all from VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where a payload holds its records, a record its name and its targets, and codes of money signs.
RECORD_PATHS = ["programs", "data", "items", "results"]
NAME_KEYS = ["name", "program_name", "title", "company"]
TARGET_PATHS = ["targets.in_scope", "scope.in_scope", "scopes.in_scope", "in_scope", "targets"]
TARGET_TYPES = ["asset_type", "type", "target_type", "category"]
TARGET_VALUES = ["asset_identifier", "identifier", "target", "endpoint", "uri", "url", "name"]
CURRENCY_SIGNS = {"$": "USD", "US$": "USD", "€": "EUR", "£": "GBP"}


def _at(x: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(x, f"$.{path}" if path else "$", kind)


def _first_text(x: Column, keys: list[str]) -> Column:
    return F.coalesce(*(_at(x, k, "string") for k in keys))


def _told(x: Column, path: str) -> Column:
    """The value at a path unless it is missing or JSON's null."""
    v = _at(x, path, "variant")
    return F.when(v.isNotNull() & ~F.is_variant_null(v), v)


def src_feeds(feeds: DataFrame) -> DataFrame:
    """feeds: source_id, adapter, page_no, payload (JSON text). One row per record: the first array among the payload itself and
    RECORD_PATHS; values that are no objects, records that are not public, and nameless ones go. Broken payloads hold no records."""
    v = F.try_parse_json("payload")
    records = F.coalesce(_at(v, "", "array<variant>"), *(_at(v, k, "array<variant>") for k in RECORD_PATHS))
    df = feeds.select("source_id", "adapter", "page_no", F.posexplode(records).alias("ordinal", "raw")).where(F.schema_of_variant("raw").startswith("OBJECT"))
    df = df.where(F.coalesce(_at(F.col("raw"), "public", "boolean"), F.lit(True))).withColumn("name", F.trim(_first_text(F.col("raw"), NAME_KEYS)))
    return df.where("name <> ''").select("source_id", "adapter", "page_no", "ordinal", "name", "raw")


def target_values(records: DataFrame) -> DataFrame:
    """One row per target of a record of src_feeds as t, a VARIANT: the first array or object among TARGET_PATHS; an object's arrays follow one
    another by key. The domain adapter has plain domains."""
    raw = F.col("raw")

    def items(v: Column) -> Column:
        inside = F.flatten(F.transform(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array().cast("array<variant>"))))
        return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), inside)

    chosen = F.coalesce(*(F.when(F.schema_of_variant(v).rlike("^(ARRAY|OBJECT)"), v) for v in (_told(raw, p) for p in TARGET_PATHS)))
    domains = F.col("adapter") == "projectdiscovery"
    return records.select("source_id", "page_no", "ordinal", domains.alias("plain"), F.posexplode(F.when(domains, items(_told(raw, "domains"))).otherwise(items(chosen))).alias("target_no", "t"))


def src_nested_targets(records: DataFrame) -> DataFrame:
    """The targets' types and values as they stand."""
    t = F.col("t")
    value = F.trim(F.coalesce(F.when(F.schema_of_variant(t) == "STRING", F.try_variant_get(t, "$", "string")), _first_text(t, TARGET_VALUES)))
    kind = F.when(F.col("plain"), F.lit("domain")).otherwise(_first_text(t, TARGET_TYPES))
    return target_values(records).select("source_id", "page_no", "ordinal", "target_no", kind.alias("raw_type"), value.alias("value")).where("value <> ''")


def _number(v: Column) -> Column:
    """A number, or a text without all but digits, points and signs; text without any is 0."""
    kind, text = F.schema_of_variant(v), F.regexp_replace(F.try_variant_get(v, "$", "string"), "[^0-9.-]+", "")
    return F.when(kind == "STRING", F.when(text == "", 0.0).otherwise(text.try_cast("double"))).when(~kind.rlike("^(BOOLEAN|ARRAY|OBJECT|VOID)"), F.try_variant_get(v, "$", "double"))


def with_rewards(records: DataFrame) -> DataFrame:
    """Records of src_feeds with the least and greatest reward and currency of each.

    A reward is a number, a text, or an object of a value and a currency. Each step is a projection of its own: what is read
    several times is computed once, and generated code stays small. Nothing is joined, so a payload is parsed once.
    """
    raw, sub = F.col("raw"), F.col("sub")
    first = lambda x, *keys: F.coalesce(*(_told(x, k) for k in keys))
    df = records.withColumn("sub", _told(raw, "rewards"))
    df = df.withColumns({"low": first(raw, "min_bounty", "minBounty"), "high": first(raw, "max_bounty", "maxBounty"), "payout": first(raw, "max_payout", "maxPayout"),
                         "sub_low": first(sub, "min_bounty", "minimum"), "sub_high": first(sub, "max_bounty", "maximum"), "named": first(raw, "currency", "currency_code")})
    kinds = ["low", "high", "payout", "sub_low", "sub_high"]
    df = df.withColumns({f"{k}_in": F.schema_of_variant(k).startswith("OBJECT") for k in kinds})
    df = df.withColumns({f"{k}_v": F.when(F.col(f"{k}_in"), first(F.col(k), "value", "amount", "max")).otherwise(F.col(k)) for k in kinds} | {f"{k}_c": F.when(F.col(f"{k}_in"), first(F.col(k), "currency", "currency_code", "code")) for k in kinds})
    df = df.select(*records.columns, *(_number(F.col(f"{k}_v")).alias(k) for k in kinds), F.coalesce(*(f"{k}_c" for k in kinds), "named").alias("named"))
    df = df.withColumn("code", F.upper(F.trim(F.when(F.schema_of_variant("named") == "STRING", F.try_variant_get("named", "$", "string")))))
    known = F.coalesce(*(F.when(F.col("code") == k, F.lit(v)) for k, v in CURRENCY_SIGNS.items()), F.when(F.length("code") == 3, F.col("code")))
    return df.select(*records.columns, F.coalesce("low", "sub_low").alias("min_reward"), F.coalesce("high", "payout", "sub_high").alias("max_reward"), known.alias("currency"))


def norm_rewards(records: DataFrame) -> DataFrame:
    """Least and greatest reward and currency of each record of src_feeds."""
    return with_rewards(records).select("source_id", "page_no", "ordinal", "min_reward", "max_reward", "currency")


def src_union(snapshots: list[DataFrame], manual: DataFrame | None = None, priority: int = 5) -> DataFrame:
    """All snapshots' rows and the manual ones, which go first; columns that a snapshot lacks are null. Each row's source_priority stays, manual rows get ``priority``."""
    rows = [*snapshots, *([] if manual is None else [manual.withColumns({"source_id": F.lit("manual"), "source_priority": F.lit(priority)})])]
    out = rows[0]
    for df in rows[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
