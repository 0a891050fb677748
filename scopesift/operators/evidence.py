"""Evidence from repository, policy and transaction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .repo import FUZZ_PATH, SECURITY_FILE, WORKFLOW_PATH

# Patterns of the repository scan.
TEST_PATH = r"(?i)(^|/)(?:test|tests|spec|specs)(?:/|_|\.)|(?:^|/)[^/]+(?:_test\.[^/]+|\.(?:test|spec)\.[^/]+)$"
KNOWN_FILE = r"(?i)(replay|exploit|poc|vuln|security[_-]?test)"
KNOWN_COMMENT = r"(?i)(?://|#|/\*|\*|<!--|--)\s*.{0,160}?(documents? the vulnerability|known issue|do not use in production|not.{0,10}secure)"
DISABLED_FLAG = r"(?i)(if\s*\(?\s*false\b|math\.MaxInt64|max_int64|feature.{0,40}(?:disabled|false)|fork.{0,40}(?:never|disabled|max))"
SECURITY_CONTEXT = r"(?i)(security|secure|replay|exploit|vuln|attack|signature|auth)"
HIGH_VALUE = r"(?i)(priority|signature|signer|security|auth|replay|exploit|vuln|attack|fork|feature|config|transactor|nonce)"
TEXT_FILE = (r"(?i)(?:^|/)(?:[^/.]+|[^/]+\.(?:md|txt|rst|adoc|go|rs|c|cc|cpp|cxx|h|hh|hpp|hxx|js|jsx|mjs|cjs|ts|tsx|py|rb|php|java|kt|kts|scala|swift|sol|move|vy|sh|bash|zsh|fish|ps1|json|jsonc|toml|ya?ml|xml|ini|cfg|conf|"
             r"properties|gradle|proto|graphql|gql|sql|dockerfile|mk|cmake))$")
STOP_PARTS = ["tree", "blob", "commit", "commits", "issues", "pull", "pulls", "releases", "tags"]


def _once(df: DataFrame, name: str, x: Column) -> DataFrame:
    """Adds x as the one element of an array that is taken apart: filters and columns that come later read it and do not have its expression written out in each of them."""
    return df.select(*(c for c in df.columns if c != name), F.explode(F.array(x)).alias(name))


def repo_resolve(targets: DataFrame) -> DataFrame:
    """target_key, repo_key: owner and name of a hosted repository in the target's value; other targets go.

    The two hosts, as ``git@host:path`` or as an address with or without a scheme, user, port or www; query, fragment and trailing
    slashes cut; ``%xx`` decoded in addresses (a value that can't be gives none); a ``-`` part and all from the first stop word on
    are left out; ``.git`` goes; parts of other characters give none.
    """
    low = F.lower("value")
    df = targets.select("target_key", "value").where(F.contains(low, F.lit("github.com")) | F.contains(low, F.lit("gitlab.com")))
    df = _once(df, "raw", F.regexp_replace(F.regexp_replace(F.regexp_replace("value", r"(?U)^\s+|\s+$", ""), r"[?#].*$", ""), r"/+$", ""))
    raw = F.col("raw")
    by_name, by_url = r"(?i)^git@(github\.com|gitlab\.com):(.+?)(?:\.git)?$", r"(?i)^(?:https?://)?(?:[^/@]*@)?(?:www\.)?(github\.com|gitlab\.com)(?::\d*)?/(.*)$"
    named = raw.rlike(by_name)
    host = F.lower(F.when(named, F.regexp_extract(raw, by_name, 1)).otherwise(F.regexp_extract(raw, by_url, 1)))
    decoded = F.try_url_decode(F.replace(F.regexp_extract(raw, by_url, 2), F.lit("+"), F.lit("%2B")))
    path = F.when(named, F.regexp_extract(raw, by_name, 2)).otherwise(decoded)
    df = _once(df, "s", F.struct(host.alias("host"), F.filter(F.split(path, "/"), lambda x: x != "").alias("p"))).select("target_key", "s.*").where("host <> '' AND p IS NOT NULL")
    stops = F.transform("p", lambda x: (x == "-") | F.lower(x).isin(STOP_PARTS))
    end = F.coalesce(F.array_position(stops, True), F.lit(0)).cast("int")
    df = _once(df, "p", F.when(end > 0, F.slice("p", 1, F.greatest(end - 1, F.lit(0)))).otherwise(F.col("p"))).where("size(p) >= 2")
    df = _once(df, "p", F.when(F.col("host") == "github.com", F.slice("p", 1, 2)).otherwise(F.col("p")))
    df = _once(df, "p", F.concat(F.slice("p", 1, F.size("p") - 1), F.array(F.regexp_replace(F.element_at("p", -1), r"(?i)\.git$", ""))))
    fine = F.forall("p", lambda x: x.rlike(r"(?i)^[a-z0-9._-]+$") & x.rlike("(?i)[a-z0-9]"))
    name = F.lower(F.array_join("p", "/"))
    return df.where(fine).select("target_key", F.when(F.col("host") == "github.com", name).otherwise(F.concat(F.lit("gitlab.com/"), name)).alias("repo_key")).distinct()


def repo_activity(commits: DataFrame, pulls: DataFrame, now: str) -> DataFrame:
    """Commits in 7, 30 and 90 days, pull requests merged in 90 and the largest additions of one (0 without any), per repository.

    commits: repo_key, committed_at; pulls: repo_key, merged_at (null: not merged), additions. Both are counted in one aggregation.
    """
    age = F.lit(now).cast("timestamp")
    none = F.lit(None).cast("double")
    rows = commits.select("repo_key", F.col("committed_at").alias("at"), none.alias("additions"), F.lit(False).alias("pull"))
    rows = rows.unionByName(pulls.where("merged_at IS NOT NULL").select("repo_key", F.col("merged_at").alias("at"), F.col("additions").cast("double").alias("additions"), F.lit(True).alias("pull")))
    since = lambda n: F.col("at") >= age - F.expr(f"INTERVAL {n} DAYS")
    merged = F.col("pull") & since(90)
    return rows.groupBy("repo_key").agg(*(F.count_if(~F.col("pull") & since(n) & (F.col("at") <= age)).alias(f"commits_{n}d") for n in (7, 30, 90)),
                                        F.count_if(merged).alias("merged_prs_90d"), F.coalesce(F.max(F.when(merged, F.col("additions"))), F.lit(0.0)).alias("max_additions_90d"))


def repo_profile(meta: DataFrame, commits: DataFrame, now: str) -> DataFrame:
    """Age in years (one decimal), contributors, commits, stars, forks, releases and a map of language sizes under lower-case names; of names that are then the same the last one stays.

    meta: repo_key, stars, forks, releases, languages (``name:size`` texts); commits: repo_key, committed_at, author.
    """
    from ..functions.exprs import days, half_up

    got = commits.groupBy("repo_key").agg(F.min("committed_at").alias("first"), F.count_distinct("author").alias("contributors"), F.count("*").alias("commits"))
    pairs = F.transform("languages", lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("k"), F.substring_index(x, ":", -1).try_cast("long").alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda x: x["k"]))
    sizes = F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(pairs, lambda x: x["k"] == k), -1)["v"]))
    return meta.join(got, "repo_key", "left").select(
        "repo_key", half_up(days(F.col("first"), F.lit(now).cast("timestamp")) / 365.25, 1).alias("age_y"), F.coalesce("contributors", F.lit(0)).cast("long").alias("contributors"),
        F.coalesce("commits", F.lit(0)).cast("long").alias("commits"), *(F.col(c).cast("long").alias(c) for c in ("stars", "forks", "releases")), sizes.alias("languages"))


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def scan_priority(path: Column) -> Column:
    trap = path.rlike(TEST_PATH) & _name(path).rlike(KNOWN_FILE)
    return F.when(trap | path.rlike(WORKFLOW_PATH) | path.rlike(SECURITY_FILE) | path.rlike(FUZZ_PATH), 0).when(path.rlike(HIGH_VALUE), 1).when(path.rlike(TEST_PATH), 2).otherwise(4)


def scannable(blobs: DataFrame, max_size: int = 500_000) -> DataFrame:
    """Files that a scan may read: texts of known kinds up to a size."""
    return blobs.where("type = 'blob' AND sha IS NOT NULL").where(F.col("size") <= max_size).where(F.col("path").rlike(TEXT_FILE))


def scan_priority_pick(blobs: DataFrame, max_files: int = 400, max_bytes: int = 8_000_000) -> DataFrame:
    """The files that a bounded scan reads, most telling first: repo_key, path, size.

    A file that does not fit is skipped and smaller ones go on. Inside one priority sizes ascend, so what is picked is among its
    first ``max_files`` files; Spark cuts groups to these before the shuffle, and a repository's rest is gone through in one array.
    """
    rows = scannable(blobs).select("repo_key", "path", "size", scan_priority(F.col("path")).alias("priority"))
    w = Window.partitionBy("repo_key", "priority").orderBy("size", "path")
    some = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max_files)
    files = some.groupBy("repo_key").agg(F.array_sort(F.collect_list(F.struct("priority", "size", "path"))).alias("files"))
    fits = F.expr(f"""aggregate(files, named_struct('n', 0, 'b', 0L, 'got', cast(array() AS array<struct<path:string,size:bigint>>)),
        (a, x) -> if(a.n < {max_files} AND a.b + x.size <= {max_bytes}, named_struct('n', a.n + 1, 'b', a.b + x.size, 'got', array_append(a.got, named_struct('path', x.path, 'size', x.size))), a), a -> a.got)""")
    return files.select("repo_key", F.explode(fits).alias("f")).select("repo_key", "f.path", "f.size")


def _first_hit(text: Column, pattern: str) -> Column:
    """Line and text (180 characters, white space collapsed) of a pattern's first match; null without one. Read only where the pattern occurs."""
    whole = r"(?s)\A(.*?)((?-s)" + pattern + ")"
    before, match = F.regexp_extract(text, whole, 1), F.regexp_extract(text, whole, 2)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return F.when(text.rlike(pattern), F.struct(line.cast("int").alias("line"), F.substring(F.trim(F.regexp_replace(match, r"(?U)\s+", " ")), 1, 180).alias("match")))


def detect_traps(blobs: DataFrame, tree: DataFrame | None = None, most: int = 500_000) -> DataFrame:
    """Signs that a weakness is known already: repo_key, path, kind, line, match; one row per path and kind. Texts are read in the scan and go no further.

    blobs: repo_key, path, text of scanned files, of which the first 500,000 characters are read (a rule of the scan); tree: repo_key, path of all
    files, whose names alone can tell a test of a weakness. Names have no line.
    """
    test = lambda: F.when(F.col("path").rlike(TEST_PATH) & _name(F.col("path")).rlike(KNOWN_FILE), F.struct(F.lit(None).cast("int").alias("line"), _name(F.col("path")).alias("match")))
    text = F.substring("text", 1, most)
    hits = F.array(*(F.struct(F.lit(k).alias("kind"), h.alias("hit")) for k, h in (
        ("test-filename", test()), ("known-comment", _first_hit(text, KNOWN_COMMENT)), ("disabled-security-flag", F.when(text.rlike(SECURITY_CONTEXT), _first_hit(text, DISABLED_FLAG))))))
    found = blobs.select("repo_key", "path", F.explode(F.filter(hits, lambda x: x["hit"].isNotNull())).alias("h")).select("repo_key", "path", "h.kind", "h.hit.line", "h.hit.match")
    if tree is not None:
        named = tree.select("repo_key", "path", F.lit("test-filename").alias("kind"), test().alias("hit")).where("hit IS NOT NULL")
        found = found.unionByName(named.select("repo_key", "path", "kind", "hit.line", "hit.match"))
    # the same file scanned twice: its first match
    return found.groupBy("repo_key", "path", "kind").agg(F.min(F.struct("line", "match")).alias("h")).select("repo_key", "path", "kind", "h.line", "h.match")


def trap_rollup(traps: DataFrame, most: int = 20) -> DataFrame:
    """Per repository: traps and trap_hits (20 at most, by kind and path), dev_known and security_fix_gated. Spark cuts groups before the shuffle; the flag is of all traps."""
    w = Window.partitionBy("repo_key").orderBy("kind", "path")
    some = traps.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    hits = some.groupBy("repo_key").agg(F.count("*").alias("traps"), F.array_sort(F.collect_list(F.struct("kind", "path", "line", "match"))).alias("trap_hits"))
    gated = traps.groupBy("repo_key").agg(F.bool_or(F.col("kind") == "disabled-security-flag").alias("security_fix_gated"))
    return hits.join(gated, "repo_key").select("repo_key", "traps", F.lit(True).alias("dev_known"), "security_fix_gated", "trap_hits")


def live_activity(tx: DataFrame, now: str) -> DataFrame:
    """Transactions in 30 days and the last one, per address."""
    at = F.lit(now).cast("timestamp")
    return tx.groupBy("address").agg(F.count_if(F.col("ts") >= at - F.expr("INTERVAL 30 DAYS")).alias("tx_30d"), F.max("ts").alias("last_activity"))


def _code_points(x: Column, pattern: str, hexed) -> Column:
    """x with every number that the pattern finds replaced by its character; hexed: the number's hexadecimal digits."""
    def one(p: Column) -> Column:
        char = F.decode(F.unhex(F.lpad(hexed(F.substring_index(p, "\u0002", 1)), 8, "0")), "UTF-32")
        return F.when(p.contains("\u0002"), F.concat(char, F.substring_index(p, "\u0002", -1))).otherwise(p)

    return F.array_join(F.transform(F.split(F.regexp_replace(x, pattern, "\u0001$1\u0002"), "\u0001"), one), "")


def policy_text(pages: DataFrame) -> DataFrame:
    """html to plain text: scripts, styles and tags out, entities decoded, white space collapsed."""
    x = F.col("html")
    for tag in ("script", "style", "noscript"):
        x = F.regexp_replace(x, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    x = F.regexp_replace(x, "<[^>]+>", " ")
    # decimal, then hexadecimal codes, then names; & last, so that what it uncovers is not decoded again
    x = _code_points(x, r"&#(\d+);", lambda p: F.hex(p.cast("long")))
    x = _code_points(x, r"(?i)&#x([0-9a-f]+);", lambda p: p)
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&")):
        x = F.regexp_replace(x, f"(?i)&{name};", char)
    return pages.select("page_id", "url", F.substring(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), 1, 1_500_000).alias("text"))


_MONEY = r"(?i)(?:US\$|USD|EUR|GBP|\$|€|£)\s*([0-9][0-9,]*(?:\.\d+)?\s*(?:[km]\b)?)"


def _amount(raw: Column) -> Column:
    clean = F.lower(F.regexp_replace(raw, r"[,\s]", ""))
    return F.regexp_extract(clean, r"^(\d+(?:\.\d+)?)", 1).try_cast("double") * F.when(clean.endswith("k"), 1e3).when(clean.endswith("m"), 1e6).otherwise(1.0)


def policy_rewards(texts: DataFrame) -> DataFrame:
    """Per page the highest amount named with each severity: url, severity, amount.

    Severity words cut the text; a word's amount is the first within 140 characters before the next word, else the
    last within 80 characters before it.
    """
    parts = F.split(F.regexp_replace("text", r"(?i)\b(low|medium|high|critical)\b", "\u0001$1\u0002"), "\u0001")
    df = texts.select("page_id", "url", F.posexplode(parts).alias("i", "part"))
    word = F.when(F.col("part").contains("\u0002"), F.upper(F.substring_index("part", "\u0002", 1)))
    rest = F.substring_index("part", "\u0002", -1)
    df = df.select("page_id", "url", "i", word.alias("severity"), rest.alias("rest"), F.concat(F.coalesce(F.lower(word), F.lit("")), rest).alias("flat"))
    df = df.withColumn("before", F.array_join(F.collect_list("flat").over(Window.partitionBy("page_id").orderBy("i").rowsBetween(-40, -1)), ""))
    after = F.regexp_extract(F.substring("rest", 1, 140), _MONEY, 1)
    raw = F.when(after != "", after).otherwise(F.get(F.slice(F.regexp_extract_all(F.expr("right(before, 80)"), F.lit(_MONEY), 1), -1, 1), F.lit(0)))
    return df.where("severity IS NOT NULL").select("url", "severity", _amount(raw).alias("amount")).where("amount IS NOT NULL").groupBy("url", "severity").agg(F.max("amount").alias("amount"))


def policy_restrictions(texts: DataFrame) -> DataFrame:
    """Flags and the number of resolved reports that a policy names."""
    t = F.col("text")
    before, after = F.regexp_extract(t, r"(?i)([0-9][0-9,]*)\s+(?:resolved|triaged|valid)\s+reports?", 1), F.regexp_extract(t, r"(?i)(?:resolved|triaged|valid)\s+reports?\D{0,12}([0-9][0-9,]*)", 1)
    n = F.when(before != "", before).otherwise(after)
    bad = "(?:not eligible|ineligible|excluded|prohibited|cannot participate|not available)"
    return texts.select("url", t.rlike(r"(?i)\binvite[- ]only\b|\bprivate program\b|participation is by invitation").alias("policy_invite_only"),
                        t.rlike(r"(?i)(?:kyc|know your customer|identity verification).{0,80}(?:required|mandatory|must)|(?:required|mandatory|must).{0,80}(?:kyc|identity verification)").alias("policy_kyc"),
                        t.rlike(rf"(?i)(?:india|indian).{{0,100}}{bad}|{bad}.{{0,100}}(?:india|indian)").alias("excludes_in"),
                        t.rlike(r"(?i)\bno safe harbou?r\b|safe harbou?r does not apply").alias("no_safe_harbor"),
                        F.when(n != "", F.replace(n, F.lit(","), F.lit("")).cast("long")).alias("policy_reports"))


LOW_EXCLUDED = r"(?i)\blow\b.{0,100}(?:not eligible|no bounty|not rewarded|out of scope)|(?:not eligible|no bounty|not rewarded|out of scope).{0,100}\blow\b"


def policy_floor(rewards: DataFrame, texts: DataFrame, minimum: float = 1000.0) -> DataFrame:
    """The least severity whose amount reaches the minimum, else MEDIUM where low ones are excluded, and where that is from; per page that has a floor."""
    rank = F.when(F.col("severity") == "LOW", 1).when(F.col("severity") == "MEDIUM", 2).when(F.col("severity") == "HIGH", 3).otherwise(4)
    paid = rewards.where(F.col("amount") >= minimum).groupBy("url").agg(F.min_by("severity", rank).alias("floor"))
    df = texts.select("url", F.col("text").rlike(LOW_EXCLUDED).alias("low")).join(paid, "url", "left").where("floor IS NOT NULL OR low")
    return df.select("url", F.coalesce("floor", F.lit("MEDIUM")).alias("policy_floor"), F.when(F.col("floor").isNotNull(), "scraped-reward-table").otherwise("scraped-low-exclusion").alias("policy_floor_source"))


def policy_useful(texts: DataFrame) -> DataFrame:
    """url, useful: whether the text of a policy names an amount for a severity, excludes low ones or tells how many reports there were. texts: page_id, url, text."""
    paid = policy_rewards(texts).select("url").distinct().withColumn("paid", F.lit(True))
    told = policy_restrictions(texts.withColumn("url", F.struct("url", F.col("text").rlike(LOW_EXCLUDED).alias("low")))).select("url.url", (F.col("policy_reports").isNotNull() | F.col("url.low")).alias("told"))
    return told.join(paid, "url", "left").select("url", (F.coalesce("paid", F.lit(False)) | F.coalesce("told", F.lit(False))).alias("useful"))
