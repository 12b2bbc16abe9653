"""Tables published by partition: new files are staged beside the old ones, and a manifest that readers follow names the files that count.

Layout: path/data/<column>=<value>/.../_run=<run>/files and path/manifests/<version>, a text file with a partition folder a
line. A run writes folders of its own, which no reader sees, and then its manifest: the touched partitions point to the
new folders, all others to what they had. A run that is killed leaves the old version whole; two runs cannot both make
the next version. Old folders stay until expire() removes what recent versions don't name.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, oldest first."""
    fs, hadoop = _fs(spark, path)
    found = fs.globStatus(hadoop.Path(f"{path}/manifests/*"))
    names = [f.getPath().getName() for f in found] if found else []
    return sorted(int(n) for n in names if n.isdigit())


def manifest(spark: SparkSession, path: str, version: int) -> list[str]:
    """The partition folders, below path/data, of a version: a line for each partition, so as many as the table has."""
    return [r.value for r in spark.read.text(f"{path}/manifests/{version}").collect() if r.value]


def _partition(folder: str) -> str:
    return folder.rsplit("/_run=", 1)[0]


def stage(df: DataFrame, path: str, by: list[str], run: str) -> list[str]:
    """Writes df into folders of its own and returns them; no reader sees them yet. A run's name must be new."""
    spark = df.sparkSession
    if not re.fullmatch(r"[A-Za-z0-9-]+", run):
        raise ValueError("a run is named by letters, digits and hyphens")
    fs, hadoop = _fs(spark, path)
    glob = hadoop.Path(f"{path}/data/{'/'.join('*' for _ in by)}/_run={run}")
    if fs.globStatus(glob):
        raise ValueError(f"run {run} has been staged already")
    df.withColumn("_run", F.lit(run)).write.mode("append").partitionBy(*by, "_run").parquet(f"{path}/data")
    root = fs.makeQualified(hadoop.Path(f"{path}/data")).toUri().getPath().rstrip("/")
    found = fs.globStatus(glob) or []
    return sorted(f.getPath().toUri().getPath()[len(root) + 1:] for f in found)


def commit(spark: SparkSession, path: str, folders: list[str], based_on: int) -> int:
    """Makes folders what counts for their partitions and returns the new version, based_on + 1; an error if another run has made it."""
    fs, hadoop = _fs(spark, path)
    kept = {_partition(f): f for f in (manifest(spark, path, based_on) if based_on else [])} | {_partition(f): f for f in folders}
    draft = hadoop.Path(f"{path}/manifests/_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write("\n".join(sorted(kept.values())).encode())
    out.close()
    final = hadoop.Path(f"{path}/manifests/{based_on + 1}")
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"version {based_on + 1} of {path} is there already: read it and run again")
    return based_on + 1


def publish(df: DataFrame, path: str, by: list[str], run: str | None = None) -> int:
    """Replaces the partitions (columns by, which df has) that df has rows of, and no others; returns the new version."""
    spark = df.sparkSession
    based_on = max(versions(spark, path), default=0)
    return commit(spark, path, stage(df, path, by, run or uuid.uuid4().hex), based_on)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as its last version (or an older one) names it. Partition columns prune folders as usual."""
    version = max(versions(spark, path), default=0) if version is None else version
    folders = manifest(spark, path, version) if version else []
    if not folders:
        raise FileNotFoundError(f"nothing is published under {path}")
    return spark.read.option("basePath", f"{path}/data").parquet(*(f"{path}/data/{f}" for f in folders)).drop("_run")


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes manifests but the last `keep` and the folders that only they name; returns how many folders. Staged folders of runs that go on are left alone."""
    fs, hadoop = _fs(spark, path)
    every = versions(spark, path)
    old, new = every[:-keep], every[-keep:]
    live = {f for v in new for f in manifest(spark, path, v)}
    dead = {f for v in old for f in manifest(spark, path, v)} - live
    for v in old:
        fs.delete(hadoop.Path(f"{path}/manifests/{v}"), False)
    for f in dead:
        fs.delete(hadoop.Path(f"{path}/data/{f}"), True)
    return len(dead)
