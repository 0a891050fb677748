"""What a record's texts say: tags, languages and hints, as bits of each text aggregated per record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flags
from .value import HOSTED

# Words of a record's descriptive text and the tag or language that they stand for; behind each pattern, texts of which every match holds one.
TAG_WORDS = {
    "blockchain": (r"smart.?contract|blockchain|web3|testnet", ["contract", "blockchain", "web3", "testnet"]),
    "ai/ml": (r"\bai\b|machine learning|llm", ["ai", "machine learning", "llm"]),
    "firmware": (r"firmware", ["firmware"]),
    "security-tooling": (r"security tool|scanner|sast|dependency", ["security tool", "scanner", "sast", "dependency"]),
    "api": (r"\bapi\b|graphql", ["api", "graphql"]),
    "source-code": (r"source[ -]?code|repository|\brepo\b|github\.com|gitlab\.com|open[ -]?source", ["source", "repo", "github.com", "gitlab.com"]),
}
LANGUAGE_WORDS = {
    "solidity": (r"\bsolidity\b", ["solidity"]),
    "rust": (r"\brust\b|\.rs\b", ["rust", ".rs"]),
    "go": (r"\bgolang\b|\bgo code\b|\.go\b", ["golang", "go code", ".go"]),
    "typescript": (r"\btypescript\b|\.tsx?\b", ["typescript", ".ts"]),
    "javascript": (r"\bjavascript\b|\.jsx?\b", ["javascript", ".js"]),
    "python": (r"\bpython\b|\.py\b", ["python", ".py"]),
    "java": (r"\bjava\b", ["java"]),
    "kotlin": (r"\bkotlin\b", ["kotlin"]),
    "swift": (r"\bswift\b", ["swift"]),
    "c++": (r"\bc\+\+\b|\.cpp\b", ["c++", ".cpp"]),
    "c": (r"\bc language\b|\.c\b", ["c language", ".c"]),
    "php": (r"\bphp\b", ["php"]),
    "ruby": (r"\bruby\b", ["ruby"]),
}
LOCAL_WORDS = (r"local(?:ly)?|testnet|sandbox|docker|self-host|researcher-owned|own account", ["local", "testnet", "sandbox", "docker", "self-host", "researcher-owned", "own account"])

NAMES = [*TAG_WORDS, *LANGUAGE_WORDS, "local"]
PATTERNS = [*TAG_WORDS.values(), *LANGUAGE_WORDS.values(), LOCAL_WORDS]
# phrases of two words that a pattern may find across a space: name, first word, second word, pattern
_PHRASES = [("blockchain", "smart", "contract", "smart contract"), ("ai/ml", "machine", "learning", "machine learning"), ("security-tooling", "security", "tool", "security tool"), ("source-code", "source", "code", "source code"),
            ("source-code", "open", "source", "open source"), ("go", "go", "code", r"\bgo code\b"), ("c", "c", "language", r"\bc language\b"), ("local", "own", "account", "own account")]


def _named(bits: Column, names) -> Column:
    return F.filter(F.array(*(F.when(flags.has(bits, NAMES.index(n)), F.lit(n)) for n in names)), lambda x: x.isNotNull())


def tag_names(bits: Column) -> Column:
    return _named(bits, TAG_WORDS)


def language_names(bits: Column) -> Column:
    return _named(bits, LANGUAGE_WORDS)


def local_hint(bits: Column) -> Column:
    return flags.has(bits, NAMES.index("local"))


def target_text() -> Column:
    """A target's part of the text: value, description and impact."""
    nothing = lambda c: F.when(F.col(c) != "", F.col(c))
    return F.concat_ws(" ", nothing("value"), nothing("description"), nothing("impact"))


def look(df: DataFrame, text: Column) -> DataFrame:
    """Adds what a text says for itself (bits), and with which words of phrases it ends (first) and begins (second). Each step is a projection of its own: ends that are read in a struct would be made anew for each phrase."""
    df = df.withColumn("low", flags.plain(text)).withColumns({"bits": flags.bits(F.col("low"), PATTERNS), "ends": flags.ends(F.col("low"))})
    return df.withColumns({"first": flags.bits(F.col("ends"), [(f"{a}$", [a]) for _, a, _, _ in _PHRASES]), "second": flags.bits(F.col("ends"), [(f"^{b}", [b]) for _, _, b, _ in _PHRASES])})


def text_facts(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Per record: what its own text and each of its targets' texts say for themselves, types and counts, and whether one text's end and another's begin could make a phrase. Read twice by record_facts: write it first where targets are many.
    targets: with bits, first and second of ``look`` and at_host, or with the texts that these are made of."""
    if "bits" not in targets.columns:
        targets = look(targets.select("record_no", "type", "value", target_text().alias("text")), F.col("text")).withColumn("at_host", F.col("value").rlike(HOSTED))
    own = look(records.select("record_no", "policy_text"), F.col("policy_text"))
    zero = F.lit(0)
    got = targets.groupBy("record_no").agg(
        F.count("*").alias("target_count"), F.count_if((F.col("type") == "source-code") | F.col("at_host")).alias("repository_count"),
        F.array_sort(F.collect_set("type")).alias("types"), F.bit_or("bits").alias("bits"), F.bit_or("first").alias("first"), F.bit_or("second").alias("second"))
    df = own.select("record_no", F.col("first").alias("own_first"), F.col("bits").alias("own_bits")).join(got, "record_no", "left")
    seam = F.coalesce("first", zero).bitwiseOR(F.col("own_first")).bitwiseAND(F.coalesce("second", zero)) != 0
    return df.withColumn("seam", seam).drop("first", "second", "own_first")


def record_facts(records: DataFrame, targets: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """Per record: bits of its whole descriptive text (its own, then each target's value, description and impact by target key), types of its targets and their counts.

    records: record_no, policy_text; targets: record_no, target_key, type, value, description, impact, each key once. Texts are
    read where they are scanned; only bits and ends go on. Records in which one text's end and another's begin could make a
    phrase are few: only their texts are put in order. read: of text_facts, if it is written.
    """
    zero = F.lit(0)
    df = text_facts(records, targets) if read is None else read
    near = df.where("seam").select("record_no")
    # texts of all other records are not read again
    own = flags.add_told(records.select("record_no", "policy_text").join(near, "record_no", "left_semi"), "t", F.col("policy_text"), PATTERNS).select("record_no", F.lit("").alias("target_key"), "t")
    rows = own.unionByName(flags.add_told(targets.join(near, "record_no", "left_semi").select("record_no", "target_key", target_text().alias("text")), "t", F.col("text"), PATTERNS).drop("text")).where("t.ends IS NOT NULL")
    pair = F.concat_ws(" ", "t.ends", F.lead("t.ends").over(Window.partitionBy("record_no").orderBy("target_key")))
    found = reduce(Column.bitwiseOR, (F.when(pair.rlike(p), 1 << NAMES.index(n)).otherwise(0) for n, _, _, p in _PHRASES))
    across = rows.select("record_no", found.alias("b")).groupBy("record_no").agg(F.bit_or("b").alias("across"))
    df = df.join(across, "record_no", "left")
    every = F.col("own_bits").bitwiseOR(F.coalesce("bits", zero)).bitwiseOR(F.coalesce("across", zero))
    none = F.array().cast("array<string>")
    return df.select("record_no", every.alias("bits"), F.coalesce("types", none).alias("types"), F.coalesce("target_count", zero).cast("long").alias("target_count"), F.coalesce("repository_count", zero).cast("long").alias("repository_count"))


def record_tags(facts: DataFrame) -> DataFrame:
    """Per record: its targets' types and what its text says, sorted; languages; whether source code is in scope and a local test is hinted at."""
    tags = F.array_sort(F.array_distinct(F.concat("types", tag_names(F.col("bits")))))
    return facts.select("record_no", "target_count", "repository_count", F.array_contains(tags, "source-code").alias("source_code"), tags.alias("tags"),
                        language_names(F.col("bits")).alias("languages"), local_hint(F.col("bits")).alias("local_testing_hint"))
