"""Helpers that every operator shares: reading tables, shared storage, cutting lineage, partition counts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Only where the session names none and runs in local mode (tests) a temporary folder is made and registered as checkpoint folder; on a cluster that is an error."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        named = tempfile.mkdtemp(prefix="strata-")
        atexit.register(shutil.rmtree, named, True)
    if not known.isDefined():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder; the files survive the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def parallelism(spark: SparkSession) -> int:
    """Reduce-side partitions of the session, at least one per core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least one partition per core, for costly per-row work on few or small files; larger inputs stay as they were read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def is_blank(c: Column) -> Column:
    """Null, empty or white space only, Unicode spaces and the byte order mark included."""
    return c.isNull() | ~c.rlike(r"[^\s\p{Z}\x{FEFF}]")


def slash_path(c: Column) -> Column:
    """One spelling of a repo-relative path: forward slashes, no doubled ones, no './' steps, no leading slash."""
    p = F.regexp_replace(F.trim(c), r"[\\/]+", "/")
    p = F.regexp_replace(p, r"(^|/)(?:\./)+", "$1")
    return F.regexp_replace(p, r"^/+", "")
