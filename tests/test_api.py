"""The engine end to end on a small source tree."""

import json

import pytest

from strata.api import Config, Engine
from strata.operators.search import Options
from strata.sources import settings
from strata.sources.embedder import HashEmbedder, HttpEmbedder
from tests.test_operators import MODEL_SRC, STORE_SRC


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for p, t in {"store/store.go": STORE_SRC, "model/model.go": MODEL_SRC}.items():
        (root / p).parent.mkdir()
        (root / p).write_text(t)
    e = Engine(spark, str(tmp_path_factory.mktemp("index")), Config(search=Options(k=5), synonyms={"reader": ["getter"]}))
    counts = {r["table_name"]: r["n"] for r in e.index(str(root), "example.com/app").collect()}
    assert counts["packages"] == 2 and counts["symbols"] > 15 and counts["edges"] >= 6
    return e, root


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id long, text string")


def test_locate(spark, engine):
    e, _ = engine
    rows = e.locate(queries(spark, "Reader", "a getter of items", "")).collect()
    assert "Reader" in {r["name"] for r in rows if r["query_id"] == 1}
    assert all(r["place"] <= 5 for r in rows)
    assert e.locate(queries(spark, "DB"), keyword_only=True, kinds=("struct",)).first()["name"] == "DB"
    with pytest.raises(ValueError):
        e.locate(queries(spark, "x"), vector_only=True, keyword_only=True)


def test_context(spark, engine):
    e, _ = engine
    pack = e.context(queries(spark, "Read quoted items"), intent="design").first()
    assert pack["symbols"] and pack["packages"] and pack["metadata"]["total_symbols"] == len(pack["symbols"])
    assert sum(s["kept_lines"] for s in pack["snippets"]) == pack["metadata"]["total_lines"] > 0


def test_refs_read_status(spark, engine):
    e, _ = engine
    rows = e.refs(name="helper").collect()
    assert [r["from_name"] for r in rows] == ["Read"]
    assert e.refs(symbol_id="unknown").count() == 0
    lines = e.read(symbol_id="example.com/app/store:method:DB.Read").collect()
    assert lines[0]["text"].endswith("func (d *DB) Read(id string) (m.Item, error) {") and lines[-1]["text"].endswith("}")
    assert e.read("model/model.go", start=3, end=3).first()["text"] == "   3\ttype Item struct{ ID string }"
    with pytest.raises(KeyError):
        e.read(symbol_id="unknown")
    row = e.status().first()
    assert row["indexed"] and not row["is_stale"] and row["size_bytes"] > 0 and e.repos().count() == 1


def test_index_again_after_a_change(spark, engine):
    e, root = engine
    (root / "model/model.go").write_text(MODEL_SRC + "\nfunc Extra() {}\n")
    (root / "store/store.go").rename(root / "store/moved.go")
    e.index(str(root), "example.com/app")
    s = {(r["name"], r["file_path"]) for r in e.store.read("symbols").collect()}
    assert ("Extra", "model/model.go") in s and ("DB", "store/moved.go") in s and not any(f == "store/store.go" for _, f in s)
    assert [r["from_name"] for r in e.refs(name="New").collect()] == ["helper", "Read"]


def test_implements_edges_of_an_index(spark, engine):
    e, _ = engine
    rows = e.refs(name="Reader", edge_type="implements").collect()
    assert [(r["from_name"], r["to_name"], r["weight"]) for r in rows] == [("DB", "Reader", 10)]
    with pytest.raises(ValueError):
        e.refs(name="Reader", edge_type="calls")


def test_package_rows(engine):
    e, _ = engine
    rows = {r["path"]: r for r in e.packages().collect()}
    model, store = rows["example.com/app/model"], rows["example.com/app/store"]
    assert model["imported_by"] == ["example.com/app/store"] and "example.com/app/model" in store["imports"]
    assert model["role"] == "domain model" and e.packages(role="domain model").count() == 1
    assert set(store["entry_points"]) == {"Read"} and set(store["key_types"]) == {"Base", "DB", "Reader"}
    with pytest.raises(ValueError):
        e.find(" ")
    assert {r["kind"] for r in e.find("Read").collect()} == {"method"} and e.find("Read", package="nowhere").count() == 0


def test_two_repositories_in_one_index(spark, tmp_path):
    class Counting(HashEmbedder):
        pass

    for name, body in (("one", "package one\n\n// A does the first thing.\nfunc A() { B() }\n\nfunc B() {}\n"), ("two", "package two\n\nfunc C() {}\n")):
        (tmp_path / name / name).mkdir(parents=True)
        (tmp_path / name / name / "x.go").write_text(body)
    (tmp_path / "two" / "two" / "broken.go").write_text("no source at all")
    e = Engine(spark, str(tmp_path / "index"), embed=Counting())
    e.index(str(tmp_path / "one"), "m1")
    e.index(str(tmp_path / "two"), "m2")
    repos = {r["root_path"]: r for r in e.repos().collect()}
    assert set(repos) == {str(tmp_path / "one"), str(tmp_path / "two")}
    one = repos[str(tmp_path / "one")]
    assert one["edge_count"] == 1 and one["has_embeddings"] and one["last_indexed_at"].endswith("Z")
    assert [(r["from_name"], r["to_name"]) for r in e.refs(name="B").collect()] == [("A", "B")]
    assert [(r["file_path"], r["error"]) for r in e.errors().collect()] == [("two/broken.go", "no package clause")]
    before = {r["symbol_id"]: r["vector"] for r in e.store.read("vectors").collect()}
    # Only the changed symbol is embedded again.
    asked = []
    e.embed = lambda texts: asked.extend(texts) or HashEmbedder()(texts)
    e.embed.model = "Counting"
    from strata.sources import embedder as module

    seen = []
    whole = module.embed_texts
    module.embed_texts = lambda texts, *a: seen.append({r["text"] for r in texts.collect()}) or whole(texts, HashEmbedder(), *a[1:])
    try:
        (tmp_path / "one" / "one" / "x.go").write_text("package one\n\n// A does the first thing.\nfunc A() { B() }\n\n// B is new.\nfunc B() {}\n")
        e.index(str(tmp_path / "one"), "m1")
    finally:
        module.embed_texts = whole
    assert seen == [{"func B()\nB is new."}]
    after = {r["symbol_id"]: r["vector"] for r in e.store.read("vectors").collect()}
    assert set(after) == set(before) and after["m1/one:func:A"] == before["m1/one:func:A"] and after["m1/one:func:B"] != before["m1/one:func:B"]


def test_http_embedder():
    calls = []

    def post(url, headers, body, timeout):
        calls.append((headers, body))
        given = body["input"]
        items = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(given)]
        return {"data": items[::-1] if len(items) > 1 else items[0]}

    together = HttpEmbedder("http://x", "m", "secret", 2, post=post)
    assert together(["a", "bbb"]) == [[1.0, 1.0], [3.0, 1.0]] and calls[0][0]["Authorization"] == "Bearer secret" and len(calls) == 1
    assert HttpEmbedder("http://x", "m", together=False, post=post)(["a", "bb"]) == [[1.0, 1.0], [2.0, 1.0]] and len(calls) == 3
    for reply in ({"data": []}, {"error": {"message": "no"}}, {"data": [{"index": 7, "embedding": [1.0]}]}, {"data": [{"index": 0, "embedding": [1.0]}]}):
        with pytest.raises(ValueError):
            HttpEmbedder("http://x", "m", dim=2, post=lambda *a: reply)(["a", "b"])  # noqa: B023

    def down(*a):
        raise OSError("down")

    with pytest.raises(OSError):
        HttpEmbedder("http://x", "m", tries=1, post=down)(["a"])


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("SOME_DIR", "/data")
    text = """
# settings
search:
  k: 7            # results
  kinds: [func, 'method']
  exported_only: false
max_lines: 120
synonyms:
  store: [repo, "data # store"]
  token:
    - session token
    - 令牌
"""
    (tmp_path / "c.yaml").write_text(text, encoding="utf-8")
    c = Config.load(str(tmp_path / "c.yaml"))
    assert c.search.k == 7 and c.search.kinds == ("func", "method") and not c.search.exported_only and c.max_lines == 120
    assert c.synonyms == {"store": ["repo", "data # store"], "token": ["session token", "令牌"]}
    assert settings.expand({"a": ["$SOME_DIR/x", "plain"]}) == {"a": ["/data/x", "plain"]}
    assert settings.parse_yaml("") == {} and settings.parse_yaml("a:\nb: 1.5\nc: null") == {"a": None, "b": 1.5, "c": None}
    for bad in ("a: |\n  text", "a: {b: 1}", "a:\n\tb: 1", "just words", "a: 1\n   b: 2"):
        with pytest.raises(ValueError):
            settings.parse_yaml(bad)
    with pytest.raises(FileNotFoundError):
        Config.load(str(tmp_path / "none.yaml"))


def test_command_line(spark, engine, tmp_path, capsys):
    from strata.__main__ import main

    e, _ = engine
    index = ["--index", e.store.root]
    assert main([*index, "search", "Reader", "--all", "--verbose"]) == 0 and "Found" in capsys.readouterr().out
    assert main([*index, "search", "Reader", "--json", "--output", str(tmp_path / "o.json")]) == 0
    assert json.loads((tmp_path / "o.json").read_text())["query"] == "Reader"
    assert main([*index, "evidence", "Read quoted items"]) == 0 and "snippets" in json.loads(capsys.readouterr().out)
    assert main([*index, "refs", "--name", "Reader", "--edge-type", "calls"]) == 1 and "error" in capsys.readouterr().err
    for command in (["status"], ["stats", "--json"], ["repos"], ["errors"], ["find", "Read"], ["read", "--file", "model/model.go"]):
        assert main([*index, *command]) == 0


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"search": {"k": 3, "kinds": ["func"]}, "max_lines": 50}')
    c = Config.load(str(tmp_path / "c.json"))
    assert c.search.k == 3 and c.search.kinds == ("func",) and c.max_lines == 50 and c.max_symbols == 10
    with pytest.raises(ValueError):
        Config(max_lines=0)
    with pytest.raises(TypeError):
        (tmp_path / "d.json").write_text('{"colour": 1}')
        Config.load(str(tmp_path / "d.json"))
