"""Processing only new or changed records (problem 2).

Method: every partition has a fingerprint, the number of its rows and the sum of their hashes; both add up in any
order, so they combine before the shuffle. Only partitions whose fingerprint differs from that of the last
successful run are computed again, and all of them are replaced by one dynamic partition overwrite. The new
fingerprints become visible only after the data, by a rename: a run that dies in between is simply done again.
Fingerprints are kept in the shared folder beside the data.

Defined results: rows with a null partition value form a partition of their own; empty tables give no partitions;
repeated rows count each time; other columns only enter the hash.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from strata.common import scratch_path
from strata.functions.timeparse import parse_instant
from strata.operators.versions import stored_rows


def row_hash(columns: Sequence[str]) -> Column:
    """Hash of a row that can be summed without overflow; nulls and their places count."""
    return F.xxhash64(*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns]).cast("decimal(20,0)")


def fingerprints(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """``keys``, n_rows, hash_sum of each partition."""
    columns = list(columns or df.columns)
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum(row_hash(columns)).cast("decimal(38,0)").alias("hash_sum"))


def last_runs(repositories: DataFrame, jobs: DataFrame) -> DataFrame:
    """(repo_path, since) of every repository that ran successfully: the latest start of a completed job; with no jobs recorded at all, last_indexed_at. Others never ran and have no row."""
    repositories = repositories.select("id", "root_path", "last_indexed_at")
    logged = jobs.where("repo_id is not null").groupBy("repo_id").agg(F.max(F.when(F.col("status") == "completed", F.col("started_at"))).alias("started"), F.lit(True).alias("logged"))
    joined = repositories.join(logged, repositories["id"] == logged["repo_id"], "left")
    since = F.when(F.col("logged"), F.col("started")).otherwise(parse_instant(repositories["last_indexed_at"]))
    return joined.select(repositories["root_path"].alias("repo_path"), since.alias("since")).where("since is not null and repo_path is not null").groupBy("repo_path").agg(F.max("since").alias("since"))


#: What of a symbol enters the comparison; other columns, whatever their names, are left aside.
COMPARED = ("id", "repo_path", "file_path", "signature", "doc_comment", "line_start", "line_end", "created_at", "updated_at")
FINGERPRINTED = ("id", "modified", "file", "signature", "doc_comment", "line_start", "line_end")
BUCKETS = 1  #: default: partitions of a repository, by the id's hash; more for larger repositories
PARTITION_ROWS = 1_000_000  #: rows of a partition that one task writes, about


def partitioned_symbols(symbols: DataFrame, runs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Deliveries of symbols with since (start of their repository's last successful run, null if it never ran), part (repository and bucket of the id) and then: whether that run saw the row."""
    rows = stored_rows(symbols.select(*COMPARED)).drop("file_path", "created_at", "updated_at").join(runs, "repo_path", "left")
    then = F.coalesce(F.col("stored") <= F.col("since"), F.col("since").isNotNull() & F.col("stored").isNull())
    part = F.concat_ws("#", F.coalesce("repo_path", F.lit("")), F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("string"))
    return rows.withColumn("part", part).withColumn("then", then)


def partition_changes(symbols: DataFrame, runs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(repo_path, part, rows_now, rows_then, changed): fingerprints of each partition over all its rows against those over the rows that the last run saw."""
    h = row_hash(FINGERPRINTED)
    return (
        partitioned_symbols(symbols, runs, buckets)
        .groupBy("repo_path", "part")
        .agg(
            F.count("*").alias("rows_now"),
            F.sum(h).alias("hash_now"),
            F.count(F.when(F.col("then"), 1)).alias("rows_then"),
            F.coalesce(F.sum(F.when(F.col("then"), h)), F.lit(0).cast("decimal(30,0)")).alias("hash_then"),
        )
        .withColumn("changed", (F.col("rows_now") != F.col("rows_then")) | (F.col("hash_now") != F.col("hash_then")))
        .drop("hash_now", "hash_then")
    )


def symbol_changes(rows: DataFrame) -> DataFrame:
    """(part, symbol_id, repo_path, change) of the symbols of ``partitioned_symbols`` whose current version the last run did not see. Rows of a part are needed as a whole, other parts not at all."""
    version = rows.groupBy("part", "id", "modified", "file").agg(F.min("stored").alias("stored"), F.max("repo_path").alias("repo_path"), F.max("since").alias("since"), F.max(F.when(F.col("then"), F.struct("stored"))).alias("seen"))
    order = F.struct("modified", "stored", "file")
    seen = F.struct(F.col("modified"), F.col("seen.stored").alias("stored"), F.col("file"))
    one = version.groupBy("part", "id").agg(F.max_by(F.struct("modified", "file", "stored", "repo_path", "since"), order).alias("v"), F.max(F.when(F.col("seen").isNotNull(), seen)).alias("old"))
    new = one.where("v.since is null or v.stored > v.since")
    change = (
        F.when(F.col("v.since").isNull(), "never indexed")
        .when(F.col("old").isNull(), "added")
        .when(F.col("old.modified").eqNullSafe(F.col("v.modified")) & (F.col("old.file") != F.col("v.file")), "moved")
        .otherwise("changed")
    )
    return new.select("part", F.col("id").alias("symbol_id"), "v.repo_path", change.alias("change"))


def changed_symbols(symbols: DataFrame, repositories: DataFrame, jobs: DataFrame, buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """(symbol_id, repo_path, change) of the symbols added, changed or moved since their repository's last successful run, each once.

    The fingerprints that the last runs left are those of the rows they saw; they are stored under ``path`` (by default
    a new folder in the shared one), and a refresh over all rows computes the changes of the partitions that differ.
    change is 'never indexed' for repositories that never ran, else 'added' (no version was stored before the run),
    'moved' (same modification instant as the newest earlier version, other file) or 'changed'. An id belongs to one
    repository, as its package path is part of it. A symbol without any instant counts as stored before every run.
    """
    spark = symbols.sparkSession
    path = (path or scratch_path(spark, "changes")).rstrip("/")
    rows = partitioned_symbols(symbols, last_runs(repositories, jobs), buckets).withColumn("h", F.xxhash64(*FINGERPRINTED))
    # One snapshot of the source for the whole run, without texts: those are in the hash.
    snapshot = f"{path}/_snapshot-{uuid.uuid4().hex}"
    rows.select("part", "id", "repo_path", "modified", "file", "stored", "since", "then", "h").write.parquet(snapshot)
    rows = spark.read.parquet(snapshot)
    table = IncrementalTable(spark, path, "part", symbol_changes, ["h"])
    if table.state() is None:
        table.adopt(rows.where("then"))
    table.refresh(rows, fixed=True)
    return table.read(rows).select("symbol_id", "repo_path", "change")


class IncrementalTable:
    """A derived table under ``path``, one directory per value of ``key``, kept current by recomputing changed partitions only.

    ``refresh(source)`` compares the source's fingerprints (over ``compared`` columns, by default all) with those of the
    last successful run, computes ``transform`` over the rows of the partitions that differ and replaces these.
    ``transform`` keeps the key and treats partitions apart. ``path`` must be on storage that all executors share. One
    writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, transform: Callable[[DataFrame], DataFrame], compared: Sequence[str] | None = None):
        self.spark, self.path, self.key, self.transform, self.compared = spark, path.rstrip("/"), key, transform, compared

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _states(self) -> list[str]:
        fs, hadoop_path = self._fs()
        states = hadoop_path(f"{self.path}/_state")
        return sorted(s.getPath().getName() for s in fs.listStatus(states)) if fs.exists(states) else []

    def state(self) -> DataFrame | None:
        """Fingerprints of the last successful run."""
        done = self._states()
        return self.spark.read.parquet(f"{self.path}/_state/{done[-1]}") if done else None

    def _prints(self, source: DataFrame) -> DataFrame:
        return fingerprints(source, [self.key], self.compared)

    def _differing(self, now: DataFrame) -> DataFrame:
        """(key, n_rows, hash_sum) of ``now`` of the partitions that differ from the last run's, n_rows 0 for those that are gone."""
        old = self.state()
        if old is None:
            return now
        n, o = now.alias("n"), old.alias("o")
        both = n.join(o, F.col(f"n.{self.key}").eqNullSafe(F.col(f"o.{self.key}")), "full_outer")
        differs = ~(F.col("n.n_rows").eqNullSafe(F.col("o.n_rows")) & F.col("n.hash_sum").eqNullSafe(F.col("o.hash_sum")))
        # Counted rows are at least 1, so a side without row count has no such partition; its key may be null all the same.
        own = F.when(F.col("n.n_rows").isNotNull(), F.col(f"n.{self.key}")).otherwise(F.col(f"o.{self.key}"))
        return both.where(differs).select(own.alias(self.key), F.coalesce("n.n_rows", F.lit(0)).alias("n_rows"), F.col("n.hash_sum").alias("hash_sum"))

    def pending(self, source: DataFrame) -> DataFrame:
        """(key, gone) of the partitions that a refresh would recompute or, if gone from the source, empty."""
        return self._differing(self._prints(source)).select(self.key, (F.col("n_rows") == 0).alias("gone"))

    def adopt(self, source: DataFrame) -> None:
        """Takes ``source`` as what the last successful run saw, without computing anything: for results of runs that kept no fingerprints."""
        self._commit(self._prints(source))

    def refresh(self, source: DataFrame, fixed: bool = False) -> int:
        """Brings the table up to date; returns the number of partitions replaced or emptied. ``fixed`` says that the source's files cannot change during the run, which spares the look at what moved."""
        fs, hadoop_path = self._fs()
        plan = f"{self.path}/_plan-{uuid.uuid4().hex}"
        self._differing(self._prints(source)).write.parquet(plan)  # fixed before any data are touched
        todo = self.spark.read.parquet(plan)
        total = todo.count()
        if total:
            wanted = todo.select(F.col(self.key).alias("_k"), F.ceil(F.col("n_rows") / PARTITION_ROWS).cast("int").alias("_files"))
            mine = F.col(self.key).eqNullSafe(F.col("_k"))
            rows = source.join(wanted.where("_files > 0").select("_k"), mine, "left_semi")
            out = self.transform(rows)
            # Every partition gets an empty mark, so that one without results is replaced as well, by the same overwrite.
            marks = todo.select(F.col(self.key), F.lit(True).alias("_mark"))
            data = out.withColumn("_mark", F.lit(None).cast("boolean")).unionByName(marks, allowMissingColumns=True)
            # Large partitions are written by several tasks.
            sized = data.join(wanted, mine).withColumn("_file", F.pmod(F.xxhash64(*[c for c in out.columns if c != self.key]), F.greatest("_files", F.lit(1))))
            sized.repartition(self.key, "_file").drop("_k", "_files", "_file").write.partitionBy(self.key).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)
            # A partition that moved while it was read keeps no fingerprint and is done again by the next run.
            kept = todo.where("n_rows > 0")
            if not fixed:
                again = self._prints(source.join(wanted.select("_k"), mine, "left_semi"))
                t, a = kept.alias("t"), again.alias("a")
                same = F.col(f"t.{self.key}").eqNullSafe(F.col(f"a.{self.key}")) & (F.col("t.n_rows") == F.col("a.n_rows")) & (F.col("t.hash_sum") == F.col("a.hash_sum"))
                kept = t.join(a, same, "left_semi").select(self.key, "n_rows", "hash_sum")
            old = self.state()
            if old is not None:
                kept = old.join(wanted, mine, "left_anti").unionByName(kept)
            self._commit(kept)
        fs.delete(hadoop_path(plan), True)
        return total

    def _commit(self, prints: DataFrame) -> None:
        """Makes fingerprints those of the last successful run: written aside, then renamed."""
        fs, hadoop_path = self._fs()
        run = uuid.uuid4().hex
        prints.write.parquet(f"{self.path}/_next-{run}")
        states = hadoop_path(f"{self.path}/_state")
        done = self._states()
        number = int(done[-1].split("-")[0]) + 1 if done else 0
        fs.mkdirs(states)
        if not fs.rename(hadoop_path(f"{self.path}/_next-{run}"), hadoop_path(f"{self.path}/_state/{number:08d}-{run}")):
            raise OSError("the fingerprints could not be committed")
        for earlier in self._states()[:-2]:
            fs.delete(hadoop_path(f"{self.path}/_state/{earlier}"), True)

    def read(self, like: DataFrame | None = None) -> DataFrame:
        """The table's rows; while it has no partition, those of the transform of no rows of ``like``."""
        fs, hadoop_path = self._fs()
        found = [s.getPath().getName() for s in fs.listStatus(hadoop_path(self.path))] if fs.exists(hadoop_path(self.path)) else []
        if not any(name.startswith(f"{self.key}=") for name in found):
            if like is None:
                raise FileNotFoundError(f"{self.path} has no partition yet")
            return self.transform(like.where("false"))
        # The key's type is that of the fingerprints, not guessed from the directories' names.
        key_type = self.state().schema[self.key].dataType
        fields = [StructField(f.name, key_type if f.name == self.key else f.dataType) for f in self.spark.read.parquet(self.path).schema]
        return self.spark.read.schema(StructType(fields)).parquet(self.path).where("_mark is null").drop("_mark")
