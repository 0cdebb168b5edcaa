"""Rule classifiers as data: layers, entry points, intents, roles, reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------------------
#: Layer by path segment (with both slashes, lower case); the first match wins.
LAYERS = (
    ("handler", ("handler", "controller", "api", "http")),
    ("service", ("service", "usecase", "business")),
    ("repository", ("repository", "repo", "dao", "storage")),
    ("domain", ("domain", "entity", "model")),
    ("middleware", ("middleware", "filter")),
    ("util", ("util", "helper", "common")),
)
LAYER_SCORES = {"handler": 0.8, "service": 0.9, "middleware": 0.7, "domain": 0.6, "repository": 0.4, "util": 0.3}
OTHER_LAYER_SCORE = 0.5
ENTRY_NAMES = ("main.", "serve", "start", "run", "handle")
ENTRY_SIGNATURES = ("http.responsewriter", "context.context", "gin.context", "fiber.ctx")
ENTRY_PATHS = ("/handler/", "/controller/", "/cmd/", "/api/")
CARD_ENTRY_PREFIXES = ("Create", "New", "Get", "List", "Update", "Delete", "Handle", "Process", "Run", "Start", "Stop", "Init")
INTENTS = (
    ("design", ("design", "architecture", "structure", "方案", "设计", "模式")),
    ("implementation", ("bug", "error", "fix", "实现", "问题", "调试")),
    ("extension", ("interface", "extend", "extension", "插件", "接口", "扩展")),
)
ROLE_OF_LAYER = {"handler": "interface/http", "service": "application/business", "repository": "infrastructure/persistence", "domain": "domain/model", "middleware": "infrastructure/middleware"}
ROLE_OF_PATH = (
    (("handler", "controller"), "interface/http"),
    (("service", "usecase"), "application/business"),
    (("repository", "dao"), "infrastructure/persistence"),
    (("domain", "entity"), "domain/model"),
)
#: Card roles: (path patterns, import patterns, role); the first rule of which any part or import contains a pattern.
CARD_ROLES = (
    (("repo", "repository"), ("database", "sql", "gorm"), "data access"),
    (("data", "db"), ("database", "sql", "gorm"), "data access"),
    (("domain", "model"), (), "domain model"),
    (("service", "svc"), (), "application service"),
    (("api", "http", "handler", "controller", "grpc", "rest"), ("http", "gin", "echo", "grpc"), "api transport"),
    (("infra", "config", "setting"), ("config", "viper"), "infrastructure"),
    (("util", "helper", "common", "base"), (), "utility"),
    (("client", "rpc"), ("rpc", "grpc"), "client"),
)
#: Responsibilities appended per path part, in this order.
RESPONSIBILITIES = (
    (("user", "auth"), "user authentication and authorization"),
    (("order",), "order lifecycle management"),
    (("product",), "product catalog management"),
    (("payment",), "payment processing"),
    (("repo",), "data persistence and retrieval"),
    (("data", "db"), "data persistence and retrieval"),
    (("api", "http"), "HTTP request handling"),
    (("service", "svc"), "business logic coordination"),
    (("util", "helper"), "utility functions"),
)
EDGE_WEIGHTS = {"imports": 1, "implements": 10, "calls": 5, "embeds": 7, "references": 2}
EMBEDDABLE_KINDS = ("func", "method", "struct", "interface")
SKIPPED_DIRS = ("vendor", "third_party", ".git")


def any_of(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def layer(package_path: Column) -> Column:
    p, out = F.lower(package_path), None
    for name, words in LAYERS:
        hit = any_of([p.contains(f"/{w}/") for w in words])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def layer_score(layer_name: Column) -> Column:
    out = None
    for name, score in LAYER_SCORES.items():
        out = F.when(layer_name == name, score) if out is None else out.when(layer_name == name, score)
    return out.otherwise(OTHER_LAYER_SCORE)


def entry_point(name: Column, kind: Column, exported: Column, package_path: Column, signature: Column) -> Column:
    n, s, p = F.lower(name), F.lower(F.coalesce(signature, F.lit(""))), F.lower(package_path)
    named = (n == "main") | any_of([n.startswith(x) for x in ENTRY_NAMES])
    signed = exported & kind.isin("func", "method") & any_of([s.contains(x) for x in ENTRY_SIGNATURES])
    return named | signed | (exported & any_of([p.contains(x) for x in ENTRY_PATHS]))


def card_entry_point(name: Column) -> Column:
    return any_of([name.startswith(x) for x in CARD_ENTRY_PREFIXES])


def intent(text: Column, label: Column | None = None) -> Column:
    """Intent of a query text, '' for none; an explicit label is honoured as it is."""
    t, out = F.lower(text), None
    for name, words in INTENTS:
        hit = any_of([t.contains(w) for w in words])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    out = out.otherwise("")
    return out if label is None else F.coalesce(F.when(label.isin(*[i[0] for i in INTENTS]), label), out)


def intent_score(intent_name: Column, layer_name: Column, kind: Column) -> Column:
    points = lambda test, x: F.when(test, x).otherwise(0.0)
    design = points(layer_name == "service", 1.0) + points(kind == "interface", 0.8) + points(layer_name == "handler", 0.6)
    build = points(layer_name == "repository", 1.0) + points(layer_name == "domain", 0.8) + points(kind != "interface", 0.5)
    extend = points(kind == "interface", 1.0) + points(layer_name == "middleware", 0.8)
    return F.when(intent_name == "design", design).when(intent_name == "implementation", build).when(intent_name == "extension", extend).otherwise(0.0)


def graph_score(pagerank: Column, in_degree: Column, is_entry: Column, is_interface: Column, layer_name: Column) -> Column:
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    total = 0.4 * pagerank + 0.2 * F.least(in_degree / F.lit(100.0), F.lit(1.0)) + 0.2 * flag(is_entry) + 0.1 * flag(is_interface) + 0.1 * layer_score(layer_name)
    return F.least(F.lit(1.0), total)


def _reasons(tests: list[tuple[Column, str]], default: str) -> Column:
    found = F.array_compact(F.array(*[F.when(t, F.lit(x)) for t, x in tests]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def hybrid_reasons(vector: Column, keyword: Column, exported: Column, kind: Column) -> Column:
    tests = [
        (vector > 0.7, "Strong semantic similarity"),
        ((vector > 0.5) & (vector <= 0.7), "Moderate semantic similarity"),
        (keyword > 0.7, "Exact keyword match"),
        ((keyword > 0.5) & (keyword <= 0.7), "Partial keyword match"),
        (exported, "Exported API"),
        (kind.isin("func", "method"), "Executable code"),
    ]
    return _reasons(tests, "Match found")


# ---- fixed values: the texts of reasons, above and below --------------------------------------------------
def graph_reasons(pagerank: Column, in_degree: Column, is_entry: Column, is_interface: Column, layer_name: Column) -> Column:
    tests = [
        (pagerank > 0.01, "Highly connected in call graph"),
        (in_degree > 10, "Frequently called by other code"),
        (is_entry, "System entry point"),
        (is_interface, "Interface definition"),
        (layer_name == "service", "service layer"),
        (layer_name == "handler", "handler layer"),
    ]
    return _reasons(tests, "Graph feature match")


def merge_reasons(first: Column, second: Column) -> Column:
    return F.array_distinct(F.concat(first, second))


def evidence_role(package_path: Column, hit_layer: Column) -> Column:
    """Role of a package in an evidence pack: from the layer of its first hit, else from its own path, else application."""
    out = None
    for name, role in ROLE_OF_LAYER.items():
        out = F.when(hit_layer == name, role) if out is None else out.when(hit_layer == name, role)
    path = F.lower(package_path)
    for words, role in ROLE_OF_PATH:
        out = out.when(any_of([path.contains(f"/{w}/") for w in words]), role)
    return out.otherwise("application")


def card_role(package_path: Column, imports: Column, has_interface: Column, has_struct: Column, has_method: Column) -> Column:
    parts, out = F.split(F.lower(package_path), "/"), None
    contains = lambda arr, words: F.exists(arr, lambda x: any_of([x.contains(w) for w in words]))
    for path_words, import_words, role in CARD_ROLES:
        hit = contains(parts, path_words) | F.coalesce(contains(imports, import_words), F.lit(False))
        out = F.when(hit, role) if out is None else out.when(hit, role)
    return out.when(has_interface & has_struct, "domain logic").when(has_method & ~has_interface, "business logic").otherwise("general")


def responsibilities(package_path: Column, has_interface: Column, has_struct: Column, has_method: Column) -> Column:
    """Responsibilities in the order of the path's parts, repeats kept; without any, by the package's content."""
    parts = F.split(F.lower(package_path), "/")
    each = F.transform(parts, lambda p: F.array_compact(F.array(*[F.when(any_of([p.contains(w) for w in words]), F.lit(text)) for words, text in RESPONSIBILITIES])))
    by_path = F.flatten(each)
    by_content = F.array_compact(F.array(F.when(has_interface, F.lit("interface definitions")), F.when(has_struct, F.lit("data structures")), F.when(has_method, F.lit("business operations"))))
    return F.when(F.size(by_path) > 0, by_path).when(F.size(by_content) > 0, by_content).otherwise(F.array(F.lit("general functionality")))


def skipped(path: Column) -> Column:
    return any_of([path.contains(d) for d in SKIPPED_DIRS])


def standard_import(path: Column) -> Column:
    """Imports without a dot are the standard library's; vendored ones are dropped with them."""
    return ~path.contains(".") | path.contains("/vendor/")
