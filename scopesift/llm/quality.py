"""Quality rules: one table of thresholds compiled into one Spark projection, without user functions.

Every rule is a ratio or a length with a least and a most allowed value. A
rule whose denominator is 0 does not apply. Null texts count as empty: no
words, base_failed true, kept false. Other columns pass untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import table

# Frequent function words of the languages that the rules know.
STOP_WORDS = {
    "en": "the of and to in a is that for it on was with be as are by this at from or an not have",
    "fr": "le la les de des du et en que qui un une pour dans par sur est au aux il elle ne pas",
    "de": "der die das und den dem von zu mit ist ein eine des im auf nicht es auch sich für",
    "es": "el la los las de del y en que un una por con para su se es al lo como más",
}

#: name -> (numerator, denominator or None, least, most); None: no bound.
RULES: dict[str, tuple[str, str | None, float | None, float | None]] = {
    "mean_word_length": ("word_chars", "n_words", 2.0, 20.0),
    "symbol_ratio": ("n_symbols", "n_words", None, 0.5),
    "stop_word_ratio": ("n_stop_words", "n_words", 0.05, None),
    "dup_line_ratio": ("n_dup_lines", "n_lines", None, 0.5),
    "upper_ratio": ("n_upper", "word_chars", None, 0.5),
}

_SPLIT = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"
_REPEATS = """
transform(array(__w), w -> if(size(w) < 3, 0L,
  transform(array(sort_array(transform(sequence(1, greatest(size(w) - 2, 1)), i -> struct(xxhash64(w[i - 1], w[i], w[i + 1]) AS g, i AS i)))), s ->
    aggregate(sort_array(transform(filter(s, (x, j) -> (j > 0 AND get(s, j - 1).g = x.g) OR get(s, j + 1).g <=> x.g), x -> x.i)),
      struct(0L AS n, -3 AS last), (a, p) -> struct(a.n + least(3, p - a.last) AS n, p AS last), a -> a.n))[0]))[0]"""


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns that the rules read. The words are held in one temporary column.

    Repeated three-word windows are told by a 64-bit hash within one text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    stop = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)
    df = docs.withColumns({"__w": F.filter(F.split(text, _SPLIT), lambda x: x != ""), "__l": lines, "__t": F.translate(text, _SPACES, "")})
    return df.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length("__t").cast("long"),
        "n_symbols": (F.length("__t") - F.length(F.translate("__t", "#*$%&|<>", ""))).cast("long"),
        "n_lines": F.size("__l").cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": F.expr(_REPEATS).cast("long"),
        "n_stop_words": F.size(F.filter("__w", lambda x: F.lower(x).isin(stop))).cast("long"),
        "n_upper": (F.length("__t") - F.length(F.translate("__t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
    }).drop("__w", "__l", "__t")


def verdict(rules=None) -> Column:
    """True where every rule of the table holds."""
    ok = F.lit(True)
    for top, under, least, most in (RULES if rules is None else rules).values():
        value = F.col(top).cast("double") if under is None else F.try_divide(F.col(top).cast("double"), F.col(under))
        if least is not None:
            ok = ok & F.coalesce(value >= least, F.lit(True))
        if most is not None:
            ok = ok & F.coalesce(value <= most, F.lit(True))
    return ok


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(docs: DataFrame, text_col: str = "text", rules=None) -> DataFrame:
    """docs with the measures, base_failed and kept. Columns of docs with the same names are replaced."""
    return measures(docs, text_col).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
