"""Incremental refresh and skewed keys."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strata.operators import incremental, skew
from strata.streaming import changes

T = dt.datetime
SYMBOL = "id string, repo_path string, file_path string, signature string, doc_comment string, line_start int, line_end int, created_at timestamp, updated_at string, since string, p string, b int, stored string, bucket string"


def symbol(i, repo, file, created, updated, sig="s"):
    return (i, repo, file, sig, None, 1, 2, created, updated, "clash", "clash", 1, "clash", "clash")


@pytest.fixture(scope="module")
def runs(spark):
    repos = spark.createDataFrame([("h1", "/a", "2030-01-01T00:00:00Z", "x"), ("h2", "/b", "2024-02-01T00:00:00Z", "x"), ("h3", "/c", " ", "x"), ("h4", "/d", "2024-02-01T00:00:00Z", "x")], "id string, root_path string, last_indexed_at string, started string")
    jobs = spark.createDataFrame(
        [(1, "h1", "completed", T(2024, 2, 1)), (2, "h1", "failed", T(2024, 5, 1)), (3, "h1", "completed", T(2024, 1, 1)), (4, "h4", "failed", T(2024, 1, 1)), (5, None, "completed", T(2025, 1, 1))],
        "id long, repo_id string, status string, started_at timestamp",
    )
    return repos, jobs


def test_changed_symbols(spark, runs):
    jan, mar, apr = T(2024, 1, 5), T(2024, 3, 5), T(2024, 4, 5)
    rows = [
        symbol("old", "/a", "x.go", jan, "2024-01-04T00:00:00Z"),
        symbol("old", "/a", ".\\x.go", apr, "2024-01-04 00:00:00 +0000 UTC"),  # repeated delivery of the same version
        symbol("new", "/a", "x.go", mar, "2024-03-04T00:00:00Z"),
        symbol("changed", "/a", "x.go", jan, "2024-01-04T00:00:00Z"),
        symbol("changed", "/a", "x.go", mar, "2024-03-04T00:00:00Z"),
        symbol("moved", "/a", "x.go", jan, "2024-01-04T00:00:00Z"),
        symbol("moved", "/a", "y.go", mar, "2024-01-04T00:00:00Z"),
        symbol("late", "/a", "x.go", jan, "2024-01-04T00:00:00Z"),
        symbol("late", "/a", "x.go", mar, "2023-12-04T00:00:00Z"),  # an older version arrived late
        symbol("nodate", "/a", "x.go", None, "2024-03-04T00:00:00Z"),
        symbol("nothing", "/a", "x.go", None, None),
        symbol("kept", "/b", "x.go", jan, None),
        symbol("never", "/c", "x.go", jan, "2020-01-01T00:00:00Z"),
        symbol("failed", "/d", "x.go", jan, "2020-01-01T00:00:00Z"),
        symbol("unknown", None, None, jan, "2020-01-01T00:00:00Z"),
        symbol(None, "/a", "x.go", mar, "2024-03-04T00:00:00Z"),
    ]
    got = {r["symbol_id"]: r["change"] for r in incremental.changed_symbols(spark.createDataFrame(rows, SYMBOL), *runs).collect()}
    assert got == {"new": "added", "changed": "changed", "moved": "moved", "nodate": "added", "never": "never indexed", "failed": "never indexed", "unknown": "never indexed"}


def test_empty_tables(spark, runs):
    s = spark.createDataFrame([], SYMBOL)
    assert incremental.changed_symbols(s, *[x.limit(0) for x in runs]).count() == 0
    assert incremental.partition_changes(s, incremental.last_runs(*runs)).count() == 0


def test_refresh_recomputes_only_changed_partitions(spark, tmp_path):
    seen = []

    def transform(df):
        seen.append({r["k"] for r in df.select("k").distinct().collect()})
        return df.groupBy("k").agg(F.sum("v").alias("total"))

    rows = [("a", 1), ("a", 2), ("b", 3), (None, 4)]
    table = incremental.IncrementalTable(spark, str(tmp_path / "t"), "k", transform)
    make = lambda r: spark.createDataFrame(r, "k string, v long")
    result = lambda: {(r["k"], r["total"]) for r in table.read().collect()}
    assert table.refresh(make(rows)) == 3
    assert result() == {("a", 3), ("b", 3), (None, 4)}
    seen.clear()
    assert table.refresh(make(rows[::-1])) == 0 and not seen  # order does not matter, nothing is computed
    assert table.refresh(make([*rows, ("b", 3), ("c/d", 9)])) == 2
    assert all(x == {"b", "c/d"} for x in seen)
    assert result() == {("a", 3), ("b", 6), ("c/d", 9), (None, 4)}
    assert table.refresh(make(rows[2:])) == 3  # a and c/d are gone, b changed
    assert result() == {("b", 3), (None, 4)}


@pytest.mark.parametrize("step", ["_differing", "_write", "_prints", "_commit", "_rename"])
def test_failed_refresh_is_done_again(spark, tmp_path, monkeypatch, step):
    """A run dies before or after each of its steps; the next one skips and repeats nothing."""
    make = lambda r: spark.createDataFrame(r, "k string, v long")
    table = incremental.IncrementalTable(spark, str(tmp_path / "t"), "k", lambda df: df)
    table.refresh(make([("a", 1), ("b", 2), ("01", 3)]))
    changed = make([("a", 5), ("b", 2), ("01", 3)])
    with monkeypatch.context() as m:
        if step == "_write":  # during the computation of the data
            m.setattr(table, "transform", lambda df: df.withColumn("v", F.raise_error(F.lit("lost")).cast("long")))
        elif step == "_rename":  # after the new fingerprints were written, before they are visible
            m.setattr(table, "_states", lambda: 1 / 0)
        elif step == "_prints":  # after the data, while looking at what moved
            calls, whole = [], table._prints
            m.setattr(table, "_prints", lambda source: whole(source) if not calls.append(1) and len(calls) == 1 else 1 / 0)
        else:
            m.setattr(table, step, lambda *a: 1 / 0)
        with pytest.raises(Exception):
            table.refresh(changed)
    assert [r["k"] for r in table.pending(changed).collect()] == ["a"]
    assert table.refresh(changed) == 1 and table.refresh(changed) == 0
    assert {tuple(r) for r in table.read().select("k", "v").collect()} == {("a", 5), ("b", 2), ("01", 3)}


def test_partition_that_moves_during_a_run_is_done_again(spark, tmp_path):
    files = str(tmp_path / "src")
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long").write.parquet(files)

    def transform(df):
        out = spark.createDataFrame(df.collect(), df.schema)
        if not moved:
            moved.append(1)
            spark.createDataFrame([("b", 7)], "k string, v long").write.mode("append").parquet(files)
            spark.catalog.refreshByPath(files)
        return out

    moved = []
    table = incremental.IncrementalTable(spark, str(tmp_path / "t"), "k", transform)
    table.refresh(spark.read.parquet(files))
    assert [r["k"] for r in table.pending(spark.read.parquet(files)).collect()] == ["b"]
    assert table.refresh(spark.read.parquet(files)) == 1
    assert sorted(r["v"] for r in table.read().collect()) == [1, 2, 7]


def test_second_run_over_symbols_recomputes_changed_partitions_only(spark, runs, tmp_path, monkeypatch):
    jan, mar = T(2024, 1, 5), T(2024, 3, 5)
    rows = [symbol(f"s{i}", r, "x.go", jan, "2024-01-04T00:00:00Z") for r in ("/a", "/b") for i in range(40)]
    asked, whole = [], incremental.symbol_changes

    def counted(df):
        asked.extend([n] if (n := df.select("part").distinct().count()) else [])
        return whole(df)

    monkeypatch.setattr(incremental, "symbol_changes", counted)
    go = lambda r: incremental.changed_symbols(spark.createDataFrame(r, SYMBOL), *runs, path=str(tmp_path / "c"))
    # Everything was seen by the runs of /a (2024-02-01) and /b (2024-02-01): nothing is computed.
    assert go(rows).count() == 0 and asked == []
    later = [*rows, symbol("s3", "/a", "x.go", mar, "2024-03-04T00:00:00Z"), symbol("new", "/b", "x.go", mar, "2024-03-04T00:00:00Z")]
    assert {(r["symbol_id"], r["change"]) for r in go(later).collect()} == {("s3", "changed"), ("new", "added")}
    assert asked == [2]  # of two repositories
    assert go(later).count() == 2 and asked == [2]


def edges(spark):
    rows = [(f"f{i}", "hot", "calls", i % 3) for i in range(400)] + [(f"f{i}", "hot", "calls", 9) for i in range(50)] + [(f"f{i}", f"t{i}", "calls", None) for i in range(300)] + [("x", None, "calls", 1), ("x", "gone", None, 0)]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "from_id string, to_id string, edge_type string, weight int, to_kind string, h1 string")


def test_heavy_targets_are_exact(spark):
    e = edges(spark)
    assert [tuple(r) for r in skew.heavy_targets(e, 0.3).collect()] == [("hot", "calls", 400)]
    assert skew.heavy_targets(e, 0.6).count() == 0
    assert skew.heavy_targets(e.limit(0)).count() == 0
    narrow = skew.heavy_keys(skew.distinct_edges(e), ["to_id"], 0.001, width=4)  # buckets full of collisions
    assert narrow.count() == 302


def test_callers_are_complete(spark):
    e = edges(spark)
    s = spark.createDataFrame([("hot", "func", "p"), ("hot", "method", "q"), ("t1", "func", "r"), (None, "func", "n")], "id string, kind string, package_path string")
    got = {(r["to_id"], r["edge_type"], r["from_id"]): (r["weight"], r["to_kind"], r["to_package"]) for r in skew.callers(e, s, s.limit(0), 0.3).collect()}
    assert len(got) == 701
    assert got["hot", "calls", "f3"] == (9, "method", "q") and got["t1", "calls", "f1"] == (0, "func", "r") and got["gone", None, "x"] == (0, None, None)
    totals = {(r["to_id"], r["edge_type"]): r["n_callers"] for r in skew.target_totals(e).collect()}
    assert totals["hot", "calls"] == 400 and len(totals) == 302


def test_change_stream(spark, tmp_path):
    rows = [("a", T(2024, 1, 1, 0)), ("a", T(2024, 1, 1, 0)), ("b", T(2024, 1, 1, 1))]
    spark.createDataFrame(rows, "file string, mtime timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("file string, mtime timestamp").parquet(str(tmp_path / "in"))
    seen = []
    q = changes.refresh_on_change(stream, lambda df, n: seen.extend(r["file"] for r in df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted(seen) == ["a", "b"]
    batch = changes.touches_per_window(spark.read.parquet(str(tmp_path / "in")))
    assert {(r["file"], r["n"]) for r in batch.collect()} == {("a", 2), ("b", 1)}
