"""The fixed values of the queries' SQL, written out apart from the engine's, so that neither side checks itself."""

# ---- fixed values: rule tables as the SQL states them ----------------------------------------------------------
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
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīłńňōőřśşšťūůűźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeegilnnoorssstuuuzzz"
