"""State and exports as files."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The export's columns, in order.
EXPORT = ["ev_score", "name", "platform", "workflow", "ceiling", "floor", "p_findable", "p_payable", "p_first", "hardening_index", "fresh_code_index", "known_issue_risk", "effective_reward", "max_reward", "reward_capped", "reason", "url"]


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; a local one serves a local master only (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        base = _LOCAL[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_LOCAL: dict[str, str] = {}


def _files(spark: SparkSession, path: str):
    """The path's file system and the path, for the driver's small reads and writes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def _manifests(spark: SparkSession, path: str) -> dict[str, str]:
    """The newest manifest of each run."""
    fs, p = _files(spark, f"{path}/_manifests")
    names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
    return {n.rpartition("~")[0]: n for n in names if n.endswith(".json") and not n.startswith(".")}


def write_state(tables: dict[str, DataFrame], path: str, run_ts: str) -> None:
    """One version of several tables, published together.

    Every attempt writes folders of its own; a small manifest that names them is written last, under another name, and renamed. So a
    reader sees all tables of a run or none, and the version before stays whole while a run is repeated.
    """
    spark = next(iter(tables.values())).sparkSession
    attempt = uuid.uuid4().hex
    at = {name: f"{name}/run_ts={run_ts}/{attempt}" for name in tables}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{at[name]}")
    before = _manifests(spark, path).get(run_ts, "~0.json")
    number = int(before.rpartition("~")[2].partition(".")[0]) + 1
    fs, draft = _files(spark, f"{path}/_manifests/.{attempt}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps({name: {"path": at[name], "schema": df.schema.jsonValue()} for name, df in tables.items()}).encode()))
    out.close()
    if not fs.rename(draft, _files(spark, f"{path}/_manifests/{run_ts}~{number:09d}.json")[1]):
        raise OSError(f"state of {run_ts} was not published: another writer was faster")


def versions(spark: SparkSession, path: str) -> list[str]:
    """Published runs in order."""
    return sorted(_manifests(spark, path))


def read_state(spark: SparkSession, path: str, table: str, run_ts: str | None = None) -> DataFrame:
    """A table of a run's version, or of the latest."""
    found = _manifests(spark, path)
    told = json.loads(spark.read.text(f"{path}/_manifests/{found[run_ts or max(found)]}").first().value)[table]
    return spark.read.schema(StructType.fromJson(told["schema"])).parquet(f"{path}/{told['path']}")


def expire_state(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes all but the last ``keep`` runs and what attempts left that were never published. Not while a run writes."""
    found = _manifests(spark, path)
    last = [found[v] for v in sorted(found)[-keep:]]
    tables = [json.loads(spark.read.text(f"{path}/_manifests/{n}").first().value) for n in last]
    used = {t["path"] for m in tables for t in m.values()}
    fs, top = _files(spark, path)
    for table in (s.getPath() for s in fs.listStatus(top) if s.getPath().getName() != "_manifests"):
        for run in fs.listStatus(table):
            for attempt in fs.listStatus(run.getPath()):
                if "/".join(attempt.getPath().toString().rsplit("/", 3)[1:]) not in used:
                    fs.delete(attempt.getPath(), True)
    for s in fs.listStatus(_files(spark, f"{path}/_manifests")[1]):
        if s.getPath().getName() not in last and not s.getPath().getName().startswith("."):
            fs.delete(s.getPath(), False)


def export_csv(programs: DataFrame, path: str, cap: float = 50_000.0) -> None:
    """All columns quoted, quotes doubled."""
    programs.withColumn("reward_capped", F.coalesce(F.col("max_reward") > cap, F.lit(False))).select(*EXPORT).write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)


def export_json(programs: DataFrame, path: str) -> None:
    """One object a line."""
    programs.write.json(path)
