"""Typed reading of VARIANT values, with JavaScript's notion of what is missing, true and a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(x: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(x, f"$.{path}" if path else "$", kind)


def first(x: Column, *keys: str) -> Column:
    """The first of the object's values that is neither missing nor null."""
    values = (at(x, k) for k in keys)
    return F.coalesce(*(F.when(v.isNotNull() & ~F.is_variant_null(v), v) for v in values))


def kind(v: Column) -> Column:
    """STRING, BOOLEAN, ARRAY, OBJECT or NUMBER; null for a missing value or null."""
    name = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    return F.when(name.isin("STRING", "BOOLEAN", "ARRAY", "OBJECT"), name).when((name != "VOID") & (name != ""), "NUMBER")


def truth(v: Column) -> Column:
    """No for missing values, null, no, zero and the empty text; yes for all else."""
    k = kind(v)
    said = F.when(k == "BOOLEAN", at(v, "", "boolean")).when(k == "STRING", at(v, "", "string") != "").when(k == "NUMBER", at(v, "", "double") != 0).otherwise(k.isNotNull())
    return F.coalesce(said, F.lit(False))


def text(v: Column) -> Column:
    """As text: an array's elements are joined by commas, an object has a fixed name. Null for a missing value."""
    k = kind(v)
    inside = F.array_join(F.transform(at(v, "", "array<variant>"), lambda x: F.coalesce(at(x, "", "string"), F.lit(""))), ",")
    return F.when(k == "OBJECT", "[object Object]").when(k == "ARRAY", inside).when(k.isNotNull(), at(v, "", "string"))


def string(v: Column) -> Column:
    """A value that is a text, else null."""
    return F.when(kind(v) == "STRING", at(v, "", "string"))


def boolean(v: Column) -> Column:
    """A value that is yes or no, else null."""
    return F.when(kind(v) == "BOOLEAN", at(v, "", "boolean"))


def number(v: Column) -> Column:
    """A number, or a text without all but digits, points and signs; text without any is 0."""
    bare = F.regexp_replace(string(v), "[^0-9.-]+", "")
    return F.when(kind(v) == "STRING", F.when(bare == "", 0.0).otherwise(bare.try_cast("double"))).when(kind(v) == "NUMBER", at(v, "", "double"))


def moment(v: Column) -> Column:
    """UTC wall-clock time of an ISO text (without a zone: UTC) or of milliseconds since 1970; null for all else, and for what is not true."""
    s = F.trim(string(v))
    iso = s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    zoned = F.when(F.length(s) == 10, F.concat(s, F.lit("T00:00:00Z"))).when(s.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), s).otherwise(F.concat(s, F.lit("Z")))
    when = F.when(iso, zoned.try_cast("timestamp")).when((kind(v) == "NUMBER") & truth(v), F.timestamp_millis(at(v, "", "long")))
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), when.cast("timestamp_ntz"))


def uri_component(x: Column) -> Column:
    """Percent-encoded but for letters, digits and - _ . ! ~ * ' ( )."""
    out = F.url_encode(x)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
