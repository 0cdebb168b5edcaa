"""Scalar functions and rule tables on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from strata.common import is_blank, slash_path
from strata.functions import rules, text, vector
from strata.functions.timeparse import parse_instant


def one(spark, column, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("a, b, want", [([1, 2, 3], [1, 2, 3], 1.0), ([1, 0, 0], [0, 1, 0], 0.0), ([1, 1, 1], [-1, -1, -1], -1.0), ([1, 2, 3], [1.1, 2.1, 3.1], 0.999), ([0, 0], [1, 2], 0.0)])
def test_cosine(spark, a, b, want):
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    assert math.isclose(one(spark, vector.cosine_similarity(lit(a), lit(b))), want, abs_tol=1e-3)


@pytest.mark.parametrize("a, b, want", [([0, 0, 0], [0, 0, 0], 0), ([0, 0, 0], [3, 4, 0], 5), ([0, 0], [1, 0], 1)])
def test_l2(spark, a, b, want):
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, vector.l2_distance(lit(a), lit(b))) == want


def test_lengths_must_agree(spark):
    with pytest.raises(Exception, match="different lengths"):
        one(spark, vector.cosine_similarity(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))))


def test_vector_bytes_round_trip(spark):
    df = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>")
    back = df.select(vector.from_bytes(vector.to_bytes(F.col("v"))).alias("v")).collect()
    assert [r["v"] for r in back] == [[1.5, -2.0], None]
    assert spark.createDataFrame([(bytearray(b"abc"),)], "b binary").select(vector.from_bytes(F.col("b")).alias("v")).first()["v"] is None


@pytest.mark.parametrize(
    "value, want",
    [
        ("2024-06-01T12:00:00Z", "2024-06-01 12:00:00"), ("2024-06-01T12:00:00.5+02:00", "2024-06-01 10:00:00.5"), ("2024-06-01 12:00:00.25 +0530 IST", "2024-06-01 06:30:00.25"), ("2024-06-01T12:00:00", "2024-06-01 12:00:00"),
        ("Sat Jun  1 11:39:12 2024", "2024-06-01 11:39:12"), ("Sat Jun  1 11:39:12 UTC 2024", "2024-06-01 11:39:12"), ("Sat Jun 01 13:39:12 +0200 2024", "2024-06-01 11:39:12"), ("", None), ("soon", None), (None, None), ("2024-13-45T00:00:00Z", None),
    ],
)
def test_instants(spark, value, want):
    got = one(spark, parse_instant(F.lit(value).cast("string")).cast("string"))
    assert got == want


@pytest.mark.parametrize("value, want", [("./a//b.go", "a/b.go"), ("a\\b.go", "a/b.go"), (".\\a\\\\b.go", "a/b.go"), ("a/./b.go", "a/b.go"), ("a.b/c", "a.b/c")])
def test_paths(spark, value, want):
    assert one(spark, slash_path(F.lit(value))) == want


def test_blank(spark):
    df = spark.createDataFrame([("",), (" \n\t",), (" ﻿　",), (None,), ("x",)], "t string")
    assert [r[0] for r in df.select(is_blank(F.col("t"))).collect()] == [True, True, True, True, False]


@pytest.mark.parametrize("path, want", [("h/test/api/handler/order", "handler"), ("h/test/service/order", "service"), ("h/test/repository/order", "repository"), ("h/test/domain/order", "domain"), ("h/test/middleware/auth", "middleware"), ("h/test/util/string", "util"), ("h/test/random/pkg", "unknown"), ("h/test/handler", "unknown")])
def test_layers(spark, path, want):
    assert one(spark, rules.layer(F.lit(path))) == want


@pytest.mark.parametrize("layer, least", [("handler", 0.7), ("service", 0.8), ("repository", 0.3), ("domain", 0.5), ("unknown", 0.4)])
def test_layer_scores(spark, layer, least):
    assert one(spark, rules.layer_score(F.lit(layer))) >= least


@pytest.mark.parametrize(
    "name, kind, exported, path, signature, want",
    [("main", "func", False, "h/app", "func main()", True), ("Order", "func", True, "h/api/handler/o", "func Order(w http.ResponseWriter)", True), ("helper", "func", False, "h/x", "func helper()", False), ("Add", "func", True, "h/x", "func Add(a, b int) int", False)],
)
def test_entry_points(spark, name, kind, exported, path, signature, want):
    assert one(spark, rules.entry_point(F.lit(name), F.lit(kind), F.lit(exported), F.lit(path), F.lit(signature))) is want


@pytest.mark.parametrize("query, want", [("system design", "design"), ("设计模式", "design"), ("fix this bug", "implementation"), ("调试", "implementation"), ("extend plugin", "extension"), ("接口", "extension"), ("hello", "")])
def test_intents(spark, query, want):
    assert one(spark, rules.intent(F.lit(query))) == want


def test_explicit_intent_is_honoured(spark):
    assert one(spark, rules.intent(F.lit("hello"), F.lit("implementation"))) == "implementation"


@pytest.mark.parametrize("path, want", [("m/internal/repo/x", "data access"), ("m/domain/model", "domain model"), ("m/service/order", "application service"), ("m/api/handler", "api transport"), ("m/infra/config", "infrastructure"), ("m/util/helper", "utility")])
def test_card_roles(spark, path, want):
    none = F.array().cast("array<string>")
    assert one(spark, rules.card_role(F.lit(path), none, F.lit(False), F.lit(False), F.lit(False))) == want


def test_text_functions(spark):
    assert one(spark, text.first_lines(F.lit("a\nb\nc\nd\ne"), 3)) == "a\nb\nc"
    assert one(spark, text.first_lines(F.lit("a\nb"), 10)) == "a\nb"
    assert one(spark, text.truncate(F.lit("x" * 5), 3)) == "xxx..."
    assert one(spark, text.human_bytes(F.lit(1536))) == "1.5 KB"
    assert one(spark, text.human_age(F.lit(59))) == "59 seconds"
    assert one(spark, text.human_age(F.lit(25 * 3600))) == "1.0 days"
    assert one(spark, text.tokens(F.lit("Café run_it 中文词"))) == ["cafe", "run", "it", "中文词"]
