"""Versions of an event table: several sources are replaced at once, and readers stay with the version that they opened.

A version is a manifest, a small table of (source_id, part): which written folder holds each source's rows. A commit
writes the new rows into a folder of its own, then a manifest beside the earlier ones, whose marker file Spark's writer
adds last; only a manifest with its marker counts. So a commit that is killed halfway leaves the old version whole, and
what it wrote is never read. Data of earlier versions stays until ``vacuum``. Paths go through Spark's own file systems.

One writer at a time: a commit fails if another one has taken its version number meanwhile.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "source_id string, part string"


def _folder(spark: SparkSession, path: str):
    """The file system of a path and the path in it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _begun(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all commits, those that died included."""
    fs, at = _folder(spark, f"{path}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n) for n in names if n.isdigit())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions that were committed in full."""
    fs, at = _folder(spark, path)
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return [n for n in _begun(spark, path) if fs.exists(marker(f"{path}/manifests/{n}/_SUCCESS"))]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(source_id, part) of a version, by default the latest; empty where nothing was committed."""
    known = versions(spark, path)
    if version is not None and version not in known:
        raise ValueError(f"no version {version}")
    if not known:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifests/{known[-1] if version is None else version}")


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The events of a version. Later commits do not change what was opened."""
    own = manifest(spark, path, version)
    parts = [r["part"] for r in own.select("part").distinct().collect()]  # a folder a commit that is still in use
    if not parts:
        raise ValueError("nothing was committed")
    rows = spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/part={p}" for p in sorted(parts)])
    # A source's rows count only in the part that the version names: an equi-join, broadcast if the manifest is small.
    return rows.join(own, ["source_id", "part"], "left_semi").drop("part")


def commit(events: DataFrame, path: str, removed: list[str] | None = None) -> int:
    """Puts the sources of ``events`` in place of their earlier rows and drops those of ``removed``, all at once."""
    spark, part = events.sparkSession, uuid.uuid4().hex
    number = max(_begun(spark, path), default=0) + 1
    events.where(F.col("source_id").isNotNull()).write.partitionBy("source_id").parquet(f"{path}/data/part={part}")
    written = spark.read.parquet(f"{path}/data/part={part}").select(F.col("source_id").cast("string").alias("source_id")).distinct().withColumn("part", F.lit(part)) if _has_rows(spark, f"{path}/data/part={part}") else spark.createDataFrame([], MANIFEST)
    kept = manifest(spark, path).join(written.select("source_id"), "source_id", "left_anti")
    if removed:
        kept = kept.where(~F.col("source_id").isin(removed))
    kept.unionByName(written).write.mode("errorifexists").parquet(f"{path}/manifests/{number}")
    return number


def _has_rows(spark: SparkSession, path: str) -> bool:
    fs, at = _folder(spark, path)
    return any(s.isDirectory() for s in fs.listStatus(at))


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Deletes manifests before the last ``keep`` versions and the data that no kept version names; returns the parts deleted.

    No commit may be under way, as what it has written has no manifest yet.
    """
    known = versions(spark, path)
    kept = known[-keep:]
    used = {r["part"] for v in kept for r in manifest(spark, path, v).select("part").distinct().collect()}
    fs, at = _folder(spark, f"{path}/data")
    jvm, gone = spark.sparkContext._jvm, []
    for status in fs.listStatus(at) if fs.exists(at) else []:
        part = status.getPath().getName().removeprefix("part=")
        if part not in used:
            fs.delete(status.getPath(), True)
            gone.append(part)
    for v in known[:-keep]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{v}"), True)
    return gone
