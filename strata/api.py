"""The engine as one object: index, locate, context, refs, read, status, repos, stats. Everything returns DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.common import cut
from strata.functions import rules
from strata.operators import cards, evidence, fts, graph, incremental, lookup, search, status, store, synonyms
from strata.sources import embedder, gosource, settings

SEARCHED = ("id", "name", "semantic_text")


@dataclass(frozen=True)
class Config:
    """Settings with their defaults; checked on creation."""

    search: search.Options = field(default_factory=search.Options)
    max_packages: int = evidence.MAX_PACKAGES
    max_symbols: int = evidence.MAX_SYMBOLS
    max_snippets: int = evidence.MAX_SNIPPETS
    max_lines: int = evidence.MAX_LINES
    synonyms: Mapping[str, Sequence[str]] = field(default_factory=dict)
    embedding_batch: int = 10

    def __post_init__(self):
        if min(self.max_packages, self.max_symbols, self.max_snippets, self.max_lines, self.embedding_batch, self.search.k) < 1:
            raise ValueError("limits and batch sizes are at least 1")

    @classmethod
    def load(cls, path: str) -> Config:
        """From a JSON file, or a YAML file of mappings, lists and plain values; what it leaves out keeps its default, unknown names are errors. A missing file raises FileNotFoundError."""
        given = settings.load(path)
        options = {k: tuple(v) if isinstance(v, list) else v for k, v in given.pop("search", {}).items()}
        if isinstance(given.get("synonyms"), str):
            given["synonyms"] = synonyms.load_yaml(given["synonyms"])
        return cls(search=search.Options(**options), **given)


class Engine:
    """An index under ``path`` (storage that all executors share)."""

    def __init__(self, spark: SparkSession, path: str, config: Config = Config(), embed: embedder.Embed | None = None):
        self.spark, self.config, self.embed = spark, config, embed or embedder.HashEmbedder()
        self.store = store.TableStore(spark, path)

    # ---- index --------------------------------------------------------------------------------------------
    def _replace(self, name: str, root: str, rows: DataFrame) -> None:
        """Makes ``rows`` those of the repository in a table that holds all of them."""
        rows = rows.withColumn("repo_path", F.lit(root))
        others = self.store.read(name).where(F.col("repo_path") != root).unionByName(rows) if self.store.exists(name) else rows
        self.store.write(name, others)

    def _mine(self, name: str, root: str) -> DataFrame | None:
        rows = self.store.read(name).where(F.col("repo_path") == root).drop("repo_path") if self.store.exists(name) else None
        return rows

    def index(self, root: str, module: str = "", force: bool = False) -> DataFrame:
        """Parses the sources under ``root`` and brings its rows of all tables up to date; returns the table counts. Rows of other repositories stay.

        Files are partitions with fingerprints: only those added, changed or gone since the last run are parsed again
        (all with ``force``), and only symbols whose text changed are embedded again. References are kept unresolved
        and resolved anew over the whole repository, so edges into changed packages are not lost.
        """
        root, began = root.rstrip("/"), datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        files = cut(gosource.read_repository(self.spark, root, module).select("file_path", "package_path", "text"))  # one snapshot for the run
        now = incremental.fingerprints(files, ["file_path"])
        old = None if force else self._mine("files", root)
        if old is None:
            symbols, refs = gosource.symbols_of(files), gosource.references_of(files)
        else:
            same = now.join(old, ["file_path", "n_rows", "hash_sum"], "left_semi").select("file_path")
            fresh = files.join(same, "file_path", "left_anti")
            kept = lambda name: self._mine(name, root).join(same, "file_path", "left_semi")
            symbols = kept("raw_symbols").unionByName(gosource.symbols_of(fresh))
            refs = kept("refs").unionByName(gosource.references_of(fresh))
        symbols, refs = cut(symbols), cut(refs)
        self._replace("raw_symbols", root, symbols)
        self._replace("refs", root, refs)
        self._replace("errors", root, gosource.errors_of(files))
        heads = gosource.package_symbols(symbols, refs)
        first = symbols.groupBy("id").agg(F.min_by(F.struct(*symbols.columns), F.struct("file_path", "line_start")).alias("s")).select("s.*")
        docs = heads.select(F.concat(F.lit("pkg:"), "package_path").alias("id"), F.col("doc_comment").alias("_doc"))
        first = first.join(docs, "id", "left").withColumn("doc_comment", F.coalesce("_doc", "doc_comment")).drop("_doc")
        info = cards.package_info(first)
        card = cards.package_cards(info, heads.select("package_path", "imports"))
        text = cards.symbol_cards(first, card).withColumnRenamed("card", "semantic_text")
        self._replace("symbols", root, first.join(text, "id"))
        self._replace("edges", root, gosource.resolved_edges(symbols, refs))
        table = self._mine("symbols", root)
        counted = table.groupBy(F.col("package_path").alias("path")).agg(F.max("package_name").alias("name"), F.count("*").cast("int").alias("symbol_count"), F.countDistinct("file_path").cast("int").alias("file_count"))
        facts = card.select(F.col("package_path").alias("path"), "role", "responsibilities", F.col("card").alias("summary"))
        keys = info.select(F.col("package_path").alias("path"), "key_types", F.when(F.size("key_funcs") > 0, F.col("key_funcs")).otherwise(F.slice("exported_funcs", 1, 5)).alias("entry_points"))
        none = F.array().cast("array<string>")
        packages = counted.join(heads.select(F.col("package_path").alias("path"), "imports"), "path", "left").join(facts, "path", "left").join(keys, "path", "left").withColumn("imports", F.coalesce("imports", none)).withColumn("imported_by", none)
        imported = heads.select(F.explode("imports").alias("path"), F.col("package_path").alias("importer"))
        self._replace("packages", root, store.add_importer(packages, imported))
        self._replace("vectors", root, self._vectors(root, table))
        self._replace("lines", root, files.select("file_path", F.posexplode(F.split(F.regexp_replace("text", "\r\n", "\n"), "\n")).alias("p", "text")).select("file_path", (F.col("p") + 1).alias("line_no"), "text"))
        counts = table.agg(F.count("*").cast("int").alias("symbol_count"), F.countDistinct("package_path").cast("int").alias("package_count"))
        edges = self._mine("edges", root).agg(F.count("*").cast("int").alias("edge_count"))
        embedded = self._mine("vectors", root).agg((F.count("*") > 0).alias("has_embeddings"))
        row = counts.crossJoin(edges).crossJoin(embedded)  # one row each
        self._replace("repositories", root, row.select(F.sha1(F.lit(root).cast("binary")).alias("id"), F.lit(root).alias("root_path"), F.lit(began).alias("last_indexed_at"), "symbol_count", "package_count", "edge_count", "has_embeddings"))
        for name, rows in zip(("postings", "corpus"), fts.index_tables(self.store.read("symbols"), "id", SEARCHED)):
            self.store.write(name, rows)
        self._replace("files", root, now)  # last: a run that died before is done again
        return self.stats()

    def _vectors(self, root: str, symbols: DataFrame) -> DataFrame:
        """(symbol_id, vector, dimension, model, text_hash) of the embeddable symbols; vectors whose text and model are unchanged are kept."""
        model = getattr(self.embed, "model", type(self.embed).__name__)
        wanted = embedder.input_text(symbols, rules.EMBEDDABLE_KINDS).withColumn("text_hash", F.xxhash64("text"))
        old = self._mine("vectors", root)
        if old is None:
            kept, missing = None, wanted
        else:
            kept = old.where(F.col("model") == model).join(wanted.select("symbol_id", "text_hash"), ["symbol_id", "text_hash"], "left_semi")
            missing = wanted.join(kept.select("symbol_id"), "symbol_id", "left_anti")
        made = embedder.embed_texts(missing, self.embed, model, self.config.embedding_batch).where("vector is not null").join(missing.select("symbol_id", "text_hash"), "symbol_id")
        return made if kept is None else kept.select(*made.columns).unionByName(made)

    # ---- search -------------------------------------------------------------------------------------------
    def _batch(self, queries: DataFrame) -> tuple[DataFrame, list[tuple[int, str]]]:
        q = queries.select(F.col("query_id").cast("long").alias("query_id"), "text")
        expanded = synonyms.expand(q, synonyms.groups(self.spark, self.config.synonyms)) if self.config.synonyms else q.withColumn("keyword_text", F.col("text")).withColumn("vector_text", F.col("text"))
        search.checked_batch(q)
        rows = expanded.select("query_id", "text", "keyword_text", "vector_text").collect()  # the stated queries, of checked number
        vectors = self.embed([r["vector_text"] or " " for r in rows]) if rows else []
        with_vectors = self.spark.createDataFrame([(r["query_id"], r["text"], [float(x) for x in v]) for r, v in zip(rows, vectors)], "query_id long, text string, vector array<float>")
        return with_vectors, [(r["query_id"], r["keyword_text"]) for r in rows]

    def _hits(self, queries: DataFrame, options: search.Options, intent: str | None = None) -> DataFrame:
        batch, texts = self._batch(queries)
        o, symbols = options.normalised(), self.store.read("symbols")
        v = search.vector_search(self.store.read("vectors"), batch, 2 * o.k) if o.vector_weight else search.vector_search(self.store.read("vectors").limit(0), batch, 1)
        index = fts.index_from(self.store.read("postings"), self.store.read("corpus"))
        found = fts.match(symbols, "id", SEARCHED, texts if o.keyword_weight else [], index).select(F.col("query_id").cast("long").alias("query_id"), F.col("doc").alias("symbol_id"), "score")
        hits = cut(search.hybrid(v, fts.rank_scores(search.top(found, 2 * o.k)), symbols, options))
        features = graph.features(hits, self.store.read("edges"), symbols) if options.rank_by_graph else None
        intents = batch.select("query_id", rules.intent(F.col("text"), F.lit(intent).cast("string")).alias("intent"))
        return search.blend(hits, features, options, intents)

    def locate(self, queries: DataFrame, vector_only: bool = False, keyword_only: bool = False, **options) -> DataFrame:
        """Ranked symbols of each of ``queries`` (query_id, text)."""
        if vector_only and keyword_only:
            raise ValueError("vector_only and keyword_only exclude each other")
        o = replace(self.config.search, **options)
        o = replace(o, keyword_weight=0.0) if vector_only else replace(o, vector_weight=0.0) if keyword_only else o
        out = self._hits(queries, o)
        return out.select("query_id", "place", "symbol_id", "name", "kind", "package_path", "file_path", "line_start", "line_end", "signature", "vector", "keyword", "combined", "reasons")

    def context(self, queries: DataFrame, intent: str | None = None, **options) -> DataFrame:
        """One evidence pack per query, as nested columns: packages, symbols, hints, snippets, metadata."""
        c = self.config
        hits = cut(self._hits(queries, replace(c.search, rank_by_graph=True, **options), intent))
        content = evidence.extract_lines(hits, self.store.read("lines")).withColumn("n_lines", F.size(F.split("content", "\n")))
        lined = hits.join(content, ["query_id", "symbol_id"], "left")
        picked = evidence.snippets(lined, c.max_snippets, c.max_lines)
        snippets = picked.join(content.select("query_id", "symbol_id", "content"), ["query_id", "symbol_id"]).withColumn("content", F.array_join(F.slice(F.split("content", "\n"), 1, F.col("kept_lines")), "\n"))
        callers = graph.common_callers(hits, self.store.read("edges"))

        def nested(df: DataFrame, order: str, name: str) -> DataFrame:
            cols = [order] + [x for x in df.columns if x not in ("query_id", order)]
            return df.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))

        parts = [
            nested(evidence.package_cards(hits, self.store.read("packages"), c.max_packages), "card", "packages"),
            nested(evidence.symbol_cards(hits, c.max_symbols), "place", "symbols"),
            nested(evidence.hints(hits, callers, self.store.read("symbols")), "n", "hints"),
            nested(snippets, "rank", "snippets"),
            evidence.metadata(hits, picked).select("query_id", F.struct("total_symbols", "has_vector_search", "total_lines").alias("metadata")),
        ]
        out = queries.select(F.col("query_id").cast("long").alias("query_id"), "text")
        for p in parts:
            out = out.join(p, "query_id", "left")
        empty = lambda n: F.coalesce(n, F.array().cast(dict(out.dtypes)[n])).alias(n)
        return out.select("query_id", "text", *[empty(n) for n in ("packages", "symbols", "hints", "snippets")], "metadata")

    # ---- lookups ------------------------------------------------------------------------------------------
    def refs(self, symbol_id: str | None = None, name: str | None = None, direction: str = "incoming", edge_type: str | None = None, top_k: int = 20) -> DataFrame:
        """Neighbours of a symbol, or of all symbols of a name; an unknown one has none."""
        if not symbol_id and not name:
            raise ValueError("a symbol_id or a name is required")
        if edge_type == "calls":
            raise ValueError("calls are listed without an edge type; name one of imports, implements, embeds, references")
        s = self.store.read("symbols")
        ids = s.where(F.col("id") == symbol_id if symbol_id else F.col("name") == name).select("id")
        return graph.neighbours(ids, self.store.read("edges"), s, direction, edge_type).orderBy("edge_type", "from_id", "to_id").limit(top_k)

    def read(self, file_path: str | None = None, symbol_id: str | None = None, start: int = 1, end: int | None = None, context_lines: int = 0, max_lines: int = 500) -> DataFrame:
        """Numbered lines of a file's range or around a symbol."""
        if symbol_id:
            row = self.store.read("symbols").where(F.col("id") == symbol_id).select("file_path", "line_start", "line_end").first()
            if row is None:
                raise KeyError(symbol_id)
            file_path, start, end = row["file_path"], max(1, row["line_start"] - context_lines), row["line_end"] + context_lines
        if not file_path:
            raise ValueError("a file_path or a symbol_id is required")
        lines = self.store.read("lines").where(F.col("file_path") == file_path).select(F.col("file_path").alias("doc_id"), "line_no", "text")
        return evidence.read_range(lines, start, end, max_lines).orderBy("line_no")

    def status(self) -> DataFrame:
        return status.index_status(self.store.read("repositories"), F.current_timestamp()).withColumn("size_bytes", F.lit(self.store.size()))

    def repos(self) -> DataFrame:
        return self.store.read("repositories").orderBy(F.desc_nulls_last("last_indexed_at"), "root_path")

    def stats(self) -> DataFrame:
        return status.table_counts(*[self.store.read(n) for n in ("symbols", "packages", "edges", "vectors")])

    def find(self, name: str, repo: str | None = None, package: str | None = None, limit: int = 20) -> DataFrame:
        """Symbols of one name, of all repositories or one, of all packages or one."""
        return lookup.symbols_by_name(self.store.read("symbols"), name, repo, package, limit)

    def packages(self, repo: str | None = None, role: str | None = None) -> DataFrame:
        return lookup.packages(self.store.read("packages"), repo, role)

    def errors(self) -> DataFrame:
        """(file_path, error, repo_path) of source files that gave no symbols."""
        return self.store.read("errors")
