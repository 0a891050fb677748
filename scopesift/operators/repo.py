"""Signals of a repository: changed files, tree, tooling and advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Paths and functions of fuzzing, security workflows and tools.
FUZZ_PATH = r"(?i)(^|/)(oss-fuzz[^/]*|fuzz(?:ing|ers?)?)(/|$)|(^|/)[^/]*(?:_fuzz\.|fuzz[^/]*\.)"
FUZZ_FUNCTION = r"\b(?:func\s+Fuzz[A-Za-z0-9_]*|Fuzz[A-Za-z0-9_]*\s*\(|LLVMFuzzerTestOneInput\s*\()"
SECURITY_FILE = r"(?i)(^|/)security\.md$"
WORKFLOW_PATH = r"(?i)^\.github/workflows/.*\.ya?ml$"
TOOLS = "(?i)(codeql|semgrep|snyk|trivy)"
OPEN_STATES, RESOLVED_STATES = ["open", "draft", "triage"], ["published", "closed"]


def _first(df: DataFrame, key: str, column: str, most: int) -> DataFrame:
    """The first ``most`` values of a column per key as a sorted array; Spark cuts groups before the shuffle too."""
    w = Window.partitionBy(key).orderBy(column)
    return df.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).groupBy(key).agg(F.array_sort(F.collect_list(column)).alias("list"))


def repo_file_churn(files: DataFrame, most: int = 300) -> DataFrame:
    """files: repo_key, path, status of a comparison. Touched and added files, the first added ones by name, whether the list was cut."""
    per = files.groupBy("repo_key").agg(F.count_distinct("path").alias("files_touched"), F.count_distinct(F.when(F.col("status") == "added", F.col("path"))).alias("files_added"))
    some = _first(files.where("status = 'added'").select("repo_key", "path").distinct(), "repo_key", "path", most)
    return per.join(some, "repo_key", "left").select("repo_key", "files_touched", "files_added", F.coalesce("list", F.array().cast("array<string>")).alias("added_list"), (F.col("files_touched") >= most).alias("truncated"))


def repo_tree_top2(tree: DataFrame, most: int = 2000) -> DataFrame:
    """Paths of at most two parts per repository, sorted, and whether there are more."""
    top = tree.where("path <> ''").where(F.size(F.split("path", "/")) <= 2).select("repo_key", "path")
    return top.groupBy("repo_key").agg(F.count("*").alias("all")).join(_first(top, "repo_key", "path", most), "repo_key").select("repo_key", F.col("list").alias("paths"), (F.col("all") > most).alias("truncated"))


def detect_tooling(tree: DataFrame, scanned: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """tree: repo_key, path; scanned: repo_key, path, text. Security file, fuzzing, tools named in workflow paths and texts; sec_tooling is null where files
    failed to be read (failed: repo_key) and nothing was found."""
    rows = tree.select("repo_key", "path", F.lit(None).cast("string").alias("text")).unionByName(scanned.select("repo_key", F.lit(None).cast("string").alias("path"), F.substring("text", 1, 500_000).alias("text")))
    path, text = F.col("path"), F.col("text")
    named = F.when(path.rlike(WORKFLOW_PATH), path).otherwise(text)
    got = rows.groupBy("repo_key").agg(
        F.coalesce(F.bool_or(path.rlike(SECURITY_FILE)), F.lit(False)).alias("security_md"), F.coalesce(F.bool_or(path.rlike(FUZZ_PATH)), F.lit(False)).alias("fuzz_path"),
        F.coalesce(F.bool_or(text.rlike(FUZZ_FUNCTION)), F.lit(False)).alias("fuzz_function"), F.count_if(path.rlike(WORKFLOW_PATH)).alias("workflows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_distinct(F.transform(F.regexp_extract_all(named, F.lit(TOOLS), 1), F.lower)))))).alias("tools"))
    found = F.col("security_md") | F.col("fuzz_path") | F.col("fuzz_function") | (F.size("tools") > 0)
    if failed is None:
        return got.withColumn("sec_tooling", found)
    return got.join(failed.select("repo_key", F.lit(True).alias("bad")).distinct(), "repo_key", "left").withColumn("sec_tooling", F.when(found, True).when(F.col("bad"), None).otherwise(False)).drop("bad")


def advisory_signals(advisories: DataFrame, tree: DataFrame, now: str) -> DataFrame:
    """advisories: repo_key, state, updated_at, packages (array). Counts by state and whether a package of a recent open one (over two letters) is named in a path.

    Paths meet packages of their own repository only, and only recent open ones.
    """
    state = F.lower("state")
    recent = state.isin(OPEN_STATES) & (F.col("updated_at") >= F.lit(now).cast("timestamp") - F.expr("INTERVAL 365 DAYS"))
    per = advisories.groupBy("repo_key").agg(F.count_if(state.isin(OPEN_STATES)).alias("open"), F.count_if(state.isin(RESOLVED_STATES)).alias("resolved"), F.count("*").alias("total"), F.count_if(recent).alias("recent"))
    names = advisories.where(recent).select("repo_key", F.explode("packages").alias("p")).select("repo_key", F.lower("p").alias("p")).where(F.length("p") > 2).distinct()
    hit = tree.select("repo_key", F.lower("path").alias("path")).join(names, "repo_key").where(F.contains("path", F.col("p"))).select("repo_key", F.lit(True).alias("hit")).distinct()
    return per.join(hit, "repo_key", "left").withColumn("path_match", F.coalesce("hit", F.lit(False))).drop("hit")
