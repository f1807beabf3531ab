"""What the corpus operators share: tables, the shared folder, CRC columns."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What operators stored, by application and owner: paths in the shared folder, and names of bucketed tables.
_paths: dict[tuple[str, str], list[str]] = {}
_tables: dict[tuple[str, str], list[str]] = {}
_owner = [""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own on one machine; on a cluster, an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="florilege-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _keep(spark: SparkSession, kept: dict, name: str) -> None:
    if not _paths and not _tables:
        atexit.register(_release_all)
    kept.setdefault((spark.sparkContext.applicationId, _owner[0]), []).append(name)


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df once as Parquet in the shared folder and read it back, with its path: cuts lineage, survives lost executors.

    The tables stay until forget(), release() or the end of the process, as the result may still be read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _keep(spark, _paths, path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """The table of stored()."""
    return stored(df, label)[0]


def keep_table(spark: SparkSession, name: str) -> DataFrame:
    _keep(spark, _tables, name)
    return spark.table(name)


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """Store df once as a table with buckets by key: later joins and aggregations on the key need no shuffle of it."""
    spark = df.sparkSession
    n, name = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2), f"florilege_{label}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.format("parquet").option("compression", "zstd").bucketBy(n, key).saveAsTable(name)
    return keep_table(spark, name)


@contextlib.contextmanager
def owned(owner: str):
    """What is stored within belongs to an owner, so that release() can tell it from the rest."""
    before, _owner[0] = _owner[0], owner
    try:
        yield
    finally:
        _owner[0] = before


def forget(spark: SparkSession, path: str) -> None:
    """Delete one stored table, which nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    for paths in _paths.values():
        if path in paths:
            paths.remove(path)


def release(spark: SparkSession, owner: str | None = None) -> None:
    """Delete the tables that an owner (or all) stored in this application; results built on them can't be read any more."""
    app = spark.sparkContext.applicationId
    for key in [k for k in _tables if k[0] == app and owner in (None, k[1])]:
        for name in _tables.pop(key):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    for key in [k for k in _paths if k[0] == app and owner in (None, k[1])]:
        for path in list(_paths[key]):
            forget(spark, path)
        del _paths[key]


def _release_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        try:
            release(spark)
        except Exception:  # the JVM is going down; the shared folder's owner cleans up
            pass


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of the value as text, modulo m."""
    return F.crc32(col.cast("string").cast("binary")) % m
