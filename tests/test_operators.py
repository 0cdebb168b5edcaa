"""Search, graph, store, evidence and parser operators on small fixtures."""

import random
import sqlite3

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata.operators import evidence, fts, graph, lookup, patches, search, status, store, synonyms
from strata.sources import gosource

WORDS = ["cache", "ledger", "shard", "token", "run_it", "Café", "路由表", "queue"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    return [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 14)))) for i in range(60)] + [(60, ""), (61, None)]


EXPRESSIONS = ["cache", "cache ledger", "cache OR queue", "(cache OR queue) AND token NOT ledger", '"cache ledger"', "led*", "run_it", "cafe", "路由表", "路由", "body:token", "^cache", "NEAR(cache token, 2)", "NEAR(cache token)", "tok* sha*", '"cache led" *', "cache + ledger"]


@pytest.mark.parametrize("expression", EXPRESSIONS)
def test_match_agrees_with_fts5(spark, corpus, expression):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(body)")
    db.executemany("INSERT INTO t(rowid, body) VALUES (?, ?)", corpus)
    want = dict(db.execute("SELECT rowid, -bm25(t) FROM t WHERE t MATCH ?", (expression,)).fetchall())
    docs = spark.createDataFrame(corpus, "id long, body string")
    got = {r["doc"]: r["score"] for r in fts.match(docs, "id", ["body"], [(1, expression)]).collect()}
    assert got.keys() == want.keys()
    if "NEAR" not in expression and "^" not in expression:
        for k in got:
            assert got[k] == pytest.approx(want[k], abs=1e-6)


@pytest.mark.parametrize("text", ["how to?", "a-b", "http://x", "foo.bar", "trailing AND", '"open', "x:y", "(("])
def test_malformed_expressions_become_words(text):
    tree = fts.parse_or_clean(text, ["body"])
    assert tree is None or fts._leaves(tree)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text_parses_or_is_cleaned(text):
    fts.parse_or_clean(text, ["body"])


def test_fusion_with_a_missing_arm(spark):
    v = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.5)], "query_id long, symbol_id string, score double")
    k = spark.createDataFrame([(1, "b", 1.0), (1, "c", 0.5)], "query_id long, symbol_id string, keyword double")
    got = {r["symbol_id"]: (r["vector"], r["keyword"]) for r in search.fuse(v, k).collect()}
    assert got == {"a": (0.9, 0.0), "b": (0.5, 1.0), "c": (0.0, 0.5)}
    assert search.Options(vector_weight=0, keyword_weight=0).normalised().vector_weight == 1.0
    with pytest.raises(ValueError):
        search.Options(vector_weight=1.5)


def test_vector_search_skips_other_lengths(spark):
    e = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0, 0.0]), ("c", [0.0, 1.0]), ("d", [1.0, 0.0])], "symbol_id string, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    rows = search.vector_search(e, q, 2).orderBy("place").collect()
    assert [(r["symbol_id"], r["score"]) for r in rows] == [("a", 1.0), ("d", 1.0)]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_vector_search_takes_batches_of_any_size(spark, metric):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((60, 3))
    x[20:45] = x[20]  # more ties than hits are asked for
    q = np.vstack([x, rng.standard_normal((search.MAX_BATCH - 50, 3))])
    e = spark.createDataFrame([(f"s{i * 7 % 60:02}", v.tolist()) for i, v in enumerate(x)] + [("short", [1.0, 0.0])], "symbol_id string, vector array<double>")
    batch = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vector array<double>")
    got = {}
    for r in search.vector_search(e, batch, 10, metric).collect():
        got.setdefault(r["query_id"], {})[r["place"]] = (r["symbol_id"], round(r["score"], 9))
    assert len(got) == len(q)
    names = [f"s{i * 7 % 60:02}" for i in range(60)]
    for i, v in enumerate(q):
        score = x @ v / np.sqrt((x * x).sum(1) * (v @ v)) if metric == "cosine" else 1 / (1 + np.sqrt(((x - v) ** 2).sum(1)))
        want = sorted(zip(names, score.round(9)), key=lambda r: (-r[1], r[0]))[:10]
        assert [got[i][p][0] for p in range(1, 11)] == [n for n, _ in want]
    few = batch.where(f"query_id < {search.SMALL_BATCH}")
    rows = {(r["query_id"], r["symbol_id"], r["place"]) for r in search.vector_search(e, few, 10, metric).collect()}
    assert rows == {(i, got[i][p][0], p) for i in range(search.SMALL_BATCH) for p in range(1, 11)}


def brute_pagerank(nodes, edges):
    out = {n: sum(a == n for a, _ in edges) for n in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(20):
        rank = {n: 0.15 / len(nodes) + 0.85 * sum(rank[a] / out[a] for a, b in edges if b == n) for n in nodes}
    return rank


def test_pagerank_dangling_and_cycle(spark):
    nodes, edges = ["a", "b", "c", "d", "e"], [("a", "b"), ("b", "a"), ("a", "c"), ("d", "c")]
    n = spark.createDataFrame([(x,) for x in nodes], "id string")
    e = spark.createDataFrame([(*x, "calls", 1) for x in edges] + [("a", "zz", "calls", 1)], "from_id string, to_id string, edge_type string, weight int")
    got = {r["id"]: r["pagerank"] for r in graph.pagerank(n, e).collect()}
    want = brute_pagerank(nodes, edges)
    assert got == pytest.approx(want)
    assert sum(got.values()) <= 1
    c = n.select(F.lit(7).cast("long").alias("query_id"), F.col("id").alias("symbol_id"))
    assert {r["symbol_id"]: r["pagerank"] for r in graph.candidate_pagerank(c, e).collect()} == pytest.approx(want)


def test_k_hop_and_enclosing(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d"), ("d", "e")], "from_id string, to_id string")
    got = {r["id"]: r["hop"] for r in graph.k_hop(spark.createDataFrame([("a",)], "id string"), e, 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}
    spans = spark.createDataFrame([("f", 1, 300, "outer"), ("f", 70, 90, "inner"), ("g", 1, 9, "other")], "file string, line_start int, line_end int, id string")
    points = spark.createDataFrame([("f", 75), ("f", 200), ("g", 10), ("h", 1)], "file string, line int")
    assert {(r["file"], r["line"], r["id"]) for r in graph.enclosing(points, spans).collect()} == {("f", 75, "inner"), ("f", 200, "outer")}


def test_neighbours_rejects_unknown_arguments(spark):
    e = spark.createDataFrame([("a", "b", "calls", 1)], "from_id string, to_id string, edge_type string, weight int")
    s = spark.createDataFrame([("a", "A", "func"), ("b", "B", "func")], "id string, name string, kind string")
    with pytest.raises(ValueError):
        graph.neighbours(s, e, s, "sideways")
    with pytest.raises(ValueError):
        graph.neighbours(s, e, s, "both", "likes")
    assert graph.neighbours(s, e, s, "both").count() == 1


def test_upserts(spark):
    schema = "from_id string, to_id string, edge_type string, weight int, import_path string, created_at timestamp"
    t = __import__("datetime").datetime
    old = spark.createDataFrame([("a", "b", "calls", 5, None, t(2024, 1, 2))], schema)
    new = spark.createDataFrame([("a", "b", "calls", 3, "p", t(2024, 1, 3)), ("a", "b", "calls", 7, "q", t(2024, 1, 4)), ("x", "y", "calls", 1, None, t(2024, 1, 1))], schema)
    got = {(r["from_id"], r["weight"], r["import_path"]) for r in store.upsert_edges(old, new).collect()}
    assert got == {("a", 7, "p"), ("x", 1, None)}
    p = "path string, name string, repo_path string, created_at int, imported_by array<string>"
    a, b = spark.createDataFrame([("x", "old", "r", 1, ["i"])], p), spark.createDataFrame([("x", "new", "s", 2, None), ("y", "n", "s", 2, [])], p)
    assert {tuple(r)[:4] + (tuple(r["imported_by"]),) for r in store.upsert_packages(a, b).collect()} == {("x", "new", "r", 1, ("i",)), ("y", "n", "s", 2, ())}
    with pytest.raises(Exception, match="root_path is required"):
        r = spark.createDataFrame([(None, "", 1)], "id string, root_path string, created_at int")
        store.upsert_repositories(r.limit(0), r).collect()


def test_table_store_replaces_tables_from_themselves(spark, tmp_path):
    ts = store.TableStore(spark, str(tmp_path / "s"))
    assert not ts.exists("t")
    ts.write("t", spark.range(3))
    for _ in range(3):
        ts.write("t", ts.read("t").unionByName(spark.range(1)))
    assert ts.read("t").count() == 6
    assert len(ts.versions("t")) == 2 and ts.size() > 0
    ts.clear()
    assert not ts.exists("t")


def greedy(rows, max_snippets, max_lines):
    out, used = [], 0
    for sid, n in rows:
        if len(out) >= max_snippets:
            break
        if used + n > max_lines:
            if max_lines - used > 5:
                out.append((sid, max_lines - used))
            break
        out.append((sid, n))
        used += n
    return out


@pytest.mark.parametrize("lengths", [[50, 50, 100], [50, 50, 101, 3], [100, 97, 4], [100, 95, 9], [1] * 9, [201], [200], [], [120, 80, 6]])
def test_snippets_equal_the_loop(spark, lengths):
    rows = [(1, f"s{i:02}", 1.0 - i / 100, False, False, n) for i, n in enumerate(lengths)] + [(1, "none", 2.0, True, True, None)]
    df = spark.createDataFrame(rows, "query_id long, symbol_id string, combined double, exported boolean, is_entry boolean, n_lines int")
    got = [(r["symbol_id"], r["kept_lines"]) for r in evidence.snippets(df).orderBy("rank").collect()]
    assert got == greedy([(r[1], r[5]) for r in rows[:-1]], 5, 200)


def test_evidence_cards(spark):
    cols = "query_id long, place int, symbol_id string, name string, kind string, package_path string, exported boolean, combined double, graph double, layer string, is_entry boolean, semantic_text string"
    rows = [(1, 1, "a", "Handle", "func", "h/api/handler", True, 0.9, 0.0, "handler", True, "text"), (1, 2, "b", "Svc", "struct", "h/service/x", True, 0.8, 0.0, "service", False, ""), (1, 3, "c", "Do", "method", "h/service/x", True, 0.7, 0.0, "service", False, None)]
    cards = evidence.package_cards(spark.createDataFrame(rows, cols)).orderBy("card").collect()
    assert [c["path"] for c in cards] == ["h/service/x", "h/api/handler"]
    assert cards[0]["score"] == pytest.approx(1.5) and cards[1]["score"] == pytest.approx(1.0)
    assert cards[0]["role"] == "application/business" and cards[1]["role"] == "interface/http"
    assert "2 symbols" in cards[0]["summary"] and "1 method" in cards[0]["summary"]
    assert cards[0]["why"] == ["High relevance: Svc", "Core service layer", "Core service layer"]


def test_synonyms(spark):
    g = synonyms.groups(spark, {"b": ["beta", "B "], "a": ["alpha one", ""]})
    q = spark.createDataFrame([(1, "use ALPHA-ONE with beta"), (2, "nothing")], "query_id long, text string")
    rows = {r["query_id"]: r for r in synonyms.expand(q, synonyms.groups(spark, {"zed": ["beta"], "aaa": ["alpha one"]})).collect()}
    assert rows[1]["keyword_text"] == '(aaa OR "alpha one") AND (zed OR beta)'
    assert rows[1]["vector_text"] == "use ALPHA-ONE with beta aaa alpha one zed beta"
    assert rows[2]["keyword_text"] == "nothing"
    assert {(r["canonical"], r["term"]) for r in g.collect()} == {("b", "b"), ("b", "beta"), ("a", "a"), ("a", "alpha one")}


@pytest.mark.parametrize("minutes, stale, told", [(59, False, ""), (61, False, "Recent changes"), (23 * 60, False, "Recent changes"), (25 * 60, True, "Consider re-indexing")])
def test_staleness(spark, minutes, stale, told):
    r = spark.createDataFrame([("/r", "2026-01-01T00:00:00Z", True)], "root_path string, last_indexed_at string, has_embeddings boolean")
    row = status.index_status(r, F.lit("2026-01-01 00:00:00").cast("timestamp") + F.expr(f"INTERVAL {minutes} MINUTES")).first()
    assert row["is_stale"] is stale and told in row["stale_reason"] and bool(told) == bool(row["stale_reason"])


def test_changed_packages(spark):
    t = __import__("datetime").datetime
    files = spark.createDataFrame([("p", "p/a"), ("q", "q/a"), ("r", "r/a")], "package_path string, file_path string")
    seen = spark.createDataFrame([("p", "p/a", t(2024, 1, 1)), ("q", "q/a", t(2024, 3, 1)), ("s", "s/new", t(2024, 1, 1))], "package_path string, file_path string, modified timestamp")
    got = {(r["package_path"], r["reason"]) for r in status.changed_packages(files, seen, F.lit("2024-02-01").cast("timestamp")).collect()}
    assert got == {("q", "modified"), ("r", "missing"), ("s", "new")}


STORE_SRC = '''// Package store keeps items.
package store

import (
\t"fmt"
\tm "example.com/app/model"
)

const Limit, floor = 3, 1

var cache = map[string]int{"}": 1}

// Reader reads.
type Reader interface {
\tRead(id string) (m.Item, error)
}

type (
\tBase struct{}
\t// DB stores.
\tDB struct {
\t\tBase
\t\tName, Path string
\t\titem *m.Item `json:"x"`
\t}
)

// Read returns "{" quoted.
func (d *DB) Read(id string) (m.Item, error) {
\tif id == "" { return m.New("func x() {"), nil }
\treturn helper(id), nil
}

func helper(id string) m.Item { fmt.Println(id); return m.New(id) }
'''
MODEL_SRC = "package model\n\ntype Item struct{ ID string }\n\nfunc New(id string) Item { return Item{ID: id} }\n"


def test_source_parser_and_edges(spark):
    files = spark.createDataFrame([("store/store.go", "example.com/app/store", STORE_SRC), ("model/model.go", "example.com/app/model", MODEL_SRC), ("x.txt", "x", None), ("bad.go", "bad", "package bad\nfunc (")], "file_path string, package_path string, text string")
    s = gosource.symbols_of(files)
    got = {(r["kind"], r["name"], r["exported"]) for r in s.where("package_path like '%store'").collect()}
    assert {("interface", "Reader", True), ("struct", "DB", True), ("method", "Read", True), ("func", "helper", False), ("const", "Limit", True), ("const", "floor", False), ("var", "cache", False), ("field", "Name", True), ("field", "Path", True), ("field", "item", False), ("package", "store", True)} <= got
    ids = {r["id"] for r in s.collect()}
    assert "example.com/app/store:interface-method:Reader.Read" in ids and "example.com/app/store:method:DB.Read" in ids and "example.com/app/store:field:DB.embedded-0" in ids
    edges = {(r["from_id"].split("/")[-1], r["to_id"].split("/")[-1], r["edge_type"], r["weight"]) for r in gosource.resolved_edges(s, gosource.references_of(files)).collect()}
    assert {("store:method:DB.Read", "store:func:helper", "calls", 5), ("store:method:DB.Read", "model:func:New", "calls", 5), ("store:func:helper", "model:func:New", "calls", 5), ("store:struct:DB", "store:struct:Base", "embeds", 7), ("store:struct:DB", "model:struct:Item", "references", 2)} <= edges
    assert ("store", "model", "imports", 1) in {(a.removeprefix("pkg:"), b.removeprefix("pkg:"), c, d) for a, b, c, d in edges}


def test_read_repository_skips_vendored(spark, tmp_path):
    for p, t in {"store/s.go": STORE_SRC, "vendor/v/v.go": MODEL_SRC, "store/s_test.go": "package store\n", "main.go": "package main\n", "notes.md": "x"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    rows = {(r["file_path"], r["package_path"]) for r in gosource.read_repository(spark, str(tmp_path), "example.com/app").collect()}
    assert rows == {("store/s.go", "example.com/app/store"), ("store/s_test.go", "example.com/app/store"), ("main.go", "example.com/app")}
    assert gosource.read_repository(spark, str(tmp_path), "m", tests=False).count() == 2


def test_stored_postings_give_the_same_hits(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Retry the session cache", "x"), (2, "serialised cache of retries", "y"), (3, None, "cache"), (4, "", None), (5, "the cache the retry", "retry")], "id long, text string, note string")
    queries = [(1, "retry cache"), (2, "serial*"), (3, '"session cache"'), (4, "note:cache"), (5, "(retry OR session) NOT serialised"), (6, "NEAR(cache retry, 2)"), (7, "^the"), (8, "ret* + "), (9, " ")]
    fts.write_index(docs, "id", ["text", "note"], str(tmp_path / "i"))
    rows = lambda index: sorted((r["query_id"], r["doc"], round(r["score"], 9)) for r in fts.match(docs, "id", ["text", "note"], queries, index).collect())
    stored = fts.read_index(spark, str(tmp_path / "i"))
    assert rows(stored) == rows(None) and len(rows(None)) > 8
    plan = fts.match(docs, "id", ["text", "note"], queries, stored)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "BroadcastNestedLoopJoin BuildRight, Inner" not in plan


def test_patches_and_lookups(spark):
    s = spark.createDataFrame([("a", "r", "p", "f", "func", "x.go", 3), ("b", "r", "p", "g", "func", "x.go", 9), ("c", "r", "q", "f", "method", None, 1), ("d", "t", "p", "x.go", "file", "x.go", 1)], "id string, repo_path string, package_path string, name string, kind string, file_path string, line_start int")
    c = spark.createDataFrame([("a", "First line.\n\n  second \n"), ("b", "Other."), ("c", "No file."), ("d", " "), (None, "x")], "id string, comment string")
    p = patches.comment_patches(s, c)
    assert [(r["id"], r["place"], r["comment"]) for r in p.orderBy("place").collect()] == [("b", 1, "// Other."), ("a", 2, "// First line.\n//\n// second")]
    files = spark.createDataFrame([("x.go", "\n".join(f"l{i}" for i in range(1, 12)))], "file_path string, text string")
    diff = {r["id"]: r["diff"] for r in patches.patch_diffs(p, files).collect()}
    assert diff["b"] == "--- <original>\n+++ <modified>\n@@ -6,5 +6,6 @@\n l6\n l7\n l8\n+// Other.\n l9\n l10\n"
    assert [r["id"] for r in lookup.symbols_by_name(s, "f", limit=0).collect()] == ["a", "c"] and lookup.symbols_by_name(s, "f", "t").count() == 0
    assert [r["id"] for r in lookup.symbols_by_repo(s, "r").collect()] == ["a", "b", "c"] and [r["id"] for r in lookup.symbols_by_package(s, "p").collect()] == ["d", "a", "b"]
    assert [r["id"] for r in lookup.files_of(s, "t").collect()] == ["d"] and lookup.positive_or(-1, 5) == lookup.positive_or(None, 5) == 5
    with pytest.raises(ValueError):
        lookup.symbols_by_name(s, "  ")


def test_hot_target_meets_its_details_without_a_shuffle(spark):
    e = spark.createDataFrame([(f"f{i}", "hot", "calls", 5) for i in range(300)] + [("f1", "cold", "calls", 5), ("gone", "hot", "calls", 5)], "from_id string, to_id string, edge_type string, weight int")
    s = spark.createDataFrame([(f"f{i}", f"n{i}", "func") for i in range(300)] + [("hot", "Hot", None), ("cold", "Cold", "func")], "id string, name string, kind string")
    assert graph.neighbours(spark.createDataFrame([("hot",), ("cold",), ("none",)], "id string"), e, s).count() == 301
    assert graph.neighbours(spark.createDataFrame([("hot",)], "id string").limit(0), e, s).count() == 0
    assert {r["id"]: r["targets"] for r in graph.adjacency(spark.createDataFrame([("cold",)], "id string"), e, 2).collect()} == {"cold": [], "f1": ["cold", "hot"]}


def test_read_one_package_and_one_file(spark, tmp_path):
    for p, t in {"a/x.go": "package a\n", "a/b/y.go": "package b\n", "z.go": "package main\n"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    rows = lambda df: [(r["file_path"], r["package_path"]) for r in df.collect()]
    assert rows(gosource.read_package(spark, str(tmp_path), "m/a", "m")) == [("a/x.go", "m/a")]
    assert rows(gosource.read_package(spark, str(tmp_path), "m", "m")) == [("z.go", "m")]
    assert rows(gosource.read_file(spark, str(tmp_path), "a/b/y.go", "m")) == [("a/b/y.go", "m/a/b")]


def test_updates_and_first_indexed(spark):
    old = spark.createDataFrame([("a", "t", ["x"]), ("b", "u", None)], "id string, semantic_text string, tokens array<string>")
    new = spark.createDataFrame([("a", None, ["y"]), ("b", "w", None), ("c", "z", None)], "id string, semantic_text string, tokens array<string>")
    assert {(r["id"], r["semantic_text"], tuple(r["tokens"] or ())) for r in store.update_symbols(old, new).collect()} == {("a", "t", ("y",)), ("b", "w", ())}
    c = spark.createDataFrame([(1, 1, "/x"), (1, 2, "/y"), (2, 1, "/none")], "request_id int, ordinal int, root_path string")
    r = spark.createDataFrame([("/x", 0), ("/y", 3)], "root_path string, symbol_count int")
    assert [tuple(x) for x in status.first_indexed(c, r).collect()] == [(1, "/y")]
