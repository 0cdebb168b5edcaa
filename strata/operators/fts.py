"""Full-text search: postings, boolean match expressions, BM25 order. Postings are stored (``write_index``) or made of the texts at hand."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions.text import ACCENTED, PLAIN, tokens

# ---- fixed values: BM25 parameters ---------------------------------------------------------------------
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def postings(docs: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """(doc, col, pos, term) of every token of ``columns``, in one scan."""
    per_col = F.array(*[F.struct(F.lit(c).alias("col"), tokens(F.col(c)).alias("terms")) for c in columns])
    each = docs.select(F.col(id_col).alias("doc"), F.explode(per_col).alias("x"))
    return each.select("doc", F.col("x.col").alias("col"), F.posexplode("x.terms").alias("pos", "term"))


def doc_lengths(docs: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """(doc, len): tokens of all columns together; computed per row, no shuffle."""
    return docs.select(F.col(id_col).alias("doc"), sum((F.size(tokens(F.col(c))) for c in columns), F.lit(0)).cast("long").alias("len"))


@dataclass(frozen=True)
class Index:
    """What a search needs: ``posted`` (doc, len, col, pos, term), a row per token, and ``corpus`` (n_docs, avg_len), one row."""

    posted: DataFrame
    corpus: DataFrame


def _tokenised(docs: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """(doc, len, x): the terms of each column, and how many there are in all."""
    per_col = F.array(*[F.struct(F.lit(c).alias("col"), tokens(F.col(c)).alias("terms")) for c in columns])
    rows = docs.select(F.col(id_col).alias("doc"), per_col.alias("x"))
    return rows.select("doc", F.aggregate("x", F.lit(0), lambda n, c: n + F.size(c["terms"])).cast("long").alias("len"), "x")


def index_of(docs: DataFrame, id_col: str, columns: Sequence[str], leaves: Sequence[Leaf] = ()) -> Index:
    """The index of texts as they are, for a search of ``leaves``: texts without any of their terms leave no row."""
    rows = _tokenised(docs, id_col, columns)
    stats = rows.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    if leaves:
        exact, starts = _wanted_terms(leaves)
        holds = lambda c: F.arrays_overlap(c["terms"], F.array(*map(F.lit, exact))) if exact else F.lit(False)
        begins = lambda c: F.exists(c["terms"], lambda t: _begins(t, starts)) if starts else F.lit(False)
        rows = rows.where(F.exists("x", lambda c: holds(c) | begins(c)))
    each = rows.select("doc", "len", F.explode("x").alias("x"))
    return Index(each.select("doc", "len", F.col("x.col").alias("col"), F.posexplode("x.terms").alias("pos", "term")), stats)


def index_tables(docs: DataFrame, id_col: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The index as tables to store: postings (term, doc, col, len, places) in order of term and document, and the corpus' figures.

    Files hold ranges of terms, so a search reads the pages of its terms only; a very common term spans several files.
    """
    index = index_of(docs, id_col, columns)
    grouped = index.posted.groupBy("term", "doc", "col", "len").agg(F.array_sort(F.collect_list("pos")).alias("places"))
    return grouped.repartitionByRange("term", "doc").sortWithinPartitions("term", "doc"), index.corpus


def index_from(postings: DataFrame, corpus: DataFrame) -> Index:
    return Index(postings.select("doc", "len", "col", "term", F.explode("places").alias("pos")), corpus)


def write_index(docs: DataFrame, id_col: str, columns: Sequence[str], path: str) -> None:
    postings, corpus = index_tables(docs, id_col, columns)
    postings.write.option("parquet.page.size", 64 * 1024).parquet(f"{path}/postings")
    corpus.write.parquet(f"{path}/corpus")


def read_index(spark: SparkSession, path: str) -> Index:
    return index_from(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/corpus"))


def term_frequencies(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term", "doc").agg(F.count("*").alias("tf"))


def document_frequencies(posted: DataFrame) -> DataFrame:
    return posted.select("term", "doc").distinct().groupBy("term").agg(F.count("*").alias("n"))


# ---- match expressions ------------------------------------------------------------------------------------
class MatchError(ValueError):
    """The text is no match expression."""


@dataclass(frozen=True)
class Leaf:
    """Consecutive terms, the last possibly a prefix, in all columns or one; ``first`` anchors it to the column's start."""

    terms: tuple[str, ...]
    prefix: bool = False
    column: str | None = None
    first: bool = False


@dataclass(frozen=True)
class Near:
    """Leaves within a distance of each other in one column."""

    leaves: tuple[Leaf, ...]
    distance: int = 10


@dataclass(frozen=True)
class Node:
    op: str
    left: object
    right: object


_TOKEN = re.compile(r'\s*(?:(?P<str>"(?:[^"]|"")*")|(?P<par>[()])|(?P<punct>[:*^+,])|(?P<word>[\w\u0080-\U0010ffff]+))')
_FOLD = str.maketrans(ACCENTED, PLAIN)


def split_terms(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[^\W_]+", text.lower().translate(_FOLD)))


@dataclass
class Parser:
    """Recursive descent over OR < AND, juxtaposition < NOT < primary. Operators are upper case, as column filters and NEAR."""

    text: str
    columns: Sequence[str]
    at: int = 0
    items: list = field(default_factory=list)

    def parse(self):
        pos = 0
        while self.text[pos:].strip():
            m = _TOKEN.match(self.text, pos)
            if not m:
                raise MatchError(f"syntax error near {self.text[pos:].strip()[:10]!r}")
            self.items.append((m.lastgroup, m.group(m.lastgroup)))
            pos = m.end()
        if not self.items:
            raise MatchError("empty expression")
        tree = self._or()
        if self.at < len(self.items):
            raise MatchError(f"syntax error near {self.items[self.at][1]!r}")
        return tree

    def _peek(self):
        return self.items[self.at] if self.at < len(self.items) else (None, None)

    def _take(self, value: str) -> bool:
        if self._peek()[1] == value and self._peek()[0] != "str":
            self.at += 1
            return True
        return False

    def _or(self):
        left = self._and()
        while self._take("OR"):
            left = Node("or", left, self._and())
        return left

    def _and(self):
        left = self._not()
        while True:
            if self._take("AND") or (self._peek()[0] in ("str", "word") and self._peek()[1] not in ("OR", "NOT", "AND")) or self._peek()[1] in ("(", "^"):
                left = Node("and", left, self._not())
            else:
                return left

    def _not(self):
        left = self._primary()
        while self._take("NOT"):
            left = Node("not", left, self._primary())
        return left

    def _primary(self):
        kind, value = self._peek()
        if value == "(" and kind == "par":
            self.at += 1
            inner = self._or()
            if not self._take(")"):
                raise MatchError("unclosed parenthesis")
            return inner
        after = self.items[self.at + 1] if self.at + 1 < len(self.items) else (None, None)
        if kind == "word" and after == ("punct", ":"):
            if value not in self.columns:
                raise MatchError(f"no such column: {value}")
            self.at += 2
            return self._in_column(self._primary(), value)
        if kind == "word" and value == "NEAR" and after == ("par", "("):
            self.at += 2
            leaves, distance = [], 10
            while not self._take(")"):
                if self._take(","):
                    distance = int(self._peek()[1]) if (self._peek()[1] or "").isdigit() else 10
                    self.at += 1
                else:
                    leaves.append(self._phrase())
            return Near(tuple(leaves), distance)
        return self._phrase()

    def _in_column(self, tree, column: str):
        if isinstance(tree, Node):
            return Node(tree.op, self._in_column(tree.left, column), self._in_column(tree.right, column))
        if isinstance(tree, Near):
            return Near(tuple(self._in_column(x, column) for x in tree.leaves), tree.distance)
        return Leaf(tree.terms, tree.prefix, column, tree.first)

    def _phrase(self):
        first = self._take("^")
        terms: tuple[str, ...] = ()
        while True:
            kind, value = self._peek()
            if kind not in ("str", "word") or (kind == "word" and value in ("AND", "OR", "NOT")):
                raise MatchError(f"syntax error near {value!r}")
            self.at += 1
            terms += split_terms(value[1:-1].replace('""', '"') if kind == "str" else value)
            if not self._take("+"):
                break
        prefix = self._take("*")
        return Leaf(terms, prefix, None, first)


def parse(text: str, columns: Sequence[str]):
    return Parser(text, columns).parse()


def parse_or_clean(text: str, columns: Sequence[str]):
    """The expression, or if it is none, its words as implicit AND; None for a text without words."""
    if not text or not text.strip():
        return None
    try:
        return parse(text, columns)
    except MatchError:
        words = re.sub(r"[\W_]+", " ", text).strip()
        if not words:
            return None
        return parse(" ".join(f'"{w}"' for w in words.split()), columns)


def _leaves(tree) -> list[Leaf]:
    if isinstance(tree, Leaf):
        return [tree]
    if isinstance(tree, Near):
        return list(tree.leaves)
    return _leaves(tree.left) + _leaves(tree.right)


def _holds(tree, numbers: dict[Leaf, int]) -> Column:
    """The tree as a condition over ``near`` (array of near groups met) and ``met`` (array of leaf numbers met)."""
    if isinstance(tree, Leaf):
        return F.array_contains("met", numbers[tree])
    if isinstance(tree, Near):
        # Every leaf occurs in one column with all starts within the distance of a start of the first.
        out = F.lit(True)
        for leaf in tree.leaves:
            out = out & F.array_contains("met", numbers[leaf])
        a = tree.leaves[0]
        for b in tree.leaves[1:]:
            span = tree.distance + max(len(a.terms), len(b.terms))
            out = out & F.exists("spots", lambda x: (x["leaf"] == numbers[a]) & F.exists("spots", lambda y: (y["leaf"] == numbers[b]) & (y["col"] == x["col"]) & (F.abs(y["pos"] - x["pos"]) <= span)))  # noqa: B023
        return out
    left, right = _holds(tree.left, numbers), _holds(tree.right, numbers)
    return left & right if tree.op == "and" else left | right if tree.op == "or" else left & ~right


def _wanted_terms(leaves: Sequence[Leaf]) -> tuple[list[str], list[str]]:
    """The terms of the leaves: whole ones, and the beginnings of terms."""
    exact, starts = set(), set()
    for leaf in leaves:
        for n, t in enumerate(leaf.terms):
            (starts if leaf.prefix and n == len(leaf.terms) - 1 else exact).add(t)
    return sorted(exact), sorted(starts)


def _begins(term: Column, starts: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in starts:
        out = out | term.startswith(t)
    return out


def occurrences(posted: DataFrame, leaves: Sequence[Leaf]) -> DataFrame:
    """(leaf, doc, len, col, pos) of every occurrence of every leaf. Only postings of the leaves' terms are read; a phrase is the terms at consecutive places."""
    exact, starts = _wanted_terms(leaves)
    term = F.col("term")
    rows = posted.where((term.isin(exact) if exact else F.lit(False)) | _begins(term, starts))
    # The leaves that a term serves stand beside it: words of the stated queries, no join.
    want = [(n, s, t, leaf.prefix and s == len(leaf.terms) - 1, leaf.column) for n, leaf in enumerate(leaves) for s, t in enumerate(leaf.terms)]
    uses = F.array(*[F.struct(F.lit(n).alias("leaf"), F.lit(s).alias("seq"), F.lit(t).alias("want"), F.lit(p).alias("prefix"), F.lit(c).cast("string").alias("only")) for n, s, t, p, c in want])
    serves = F.filter(uses, lambda u: F.when(u["prefix"], term.startswith(u["want"])).otherwise(term == u["want"]) & (u["only"].isNull() | (u["only"] == F.col("col"))))
    hit = rows.select("doc", "len", "col", "pos", F.explode(serves).alias("u")).select(F.col("u.leaf").alias("leaf"), F.col("u.seq").alias("seq"), "doc", "len", "col", (F.col("pos") - F.col("u.seq")).alias("pos"))
    sizes = F.create_map(*[x for n, leaf in enumerate(leaves) for x in (F.lit(n), F.lit(len(leaf.terms)))])
    anchored = F.array(*[F.lit(n) for n, leaf in enumerate(leaves) if leaf.first]).cast("array<int>")
    whole = hit.groupBy("leaf", "doc", "len", "col", "pos").agg(F.countDistinct("seq").alias("found")).where(F.col("found") == sizes[F.col("leaf")])
    return whole.where(~F.array_contains(anchored, F.col("leaf")) | (F.col("pos") == 0)).select("leaf", "doc", "len", "col", "pos")


def match(docs: DataFrame, id_col: str, columns: Sequence[str], queries: Sequence[tuple[int, str]], index: Index | None = None) -> DataFrame:
    """(query_id, doc, score) of every document that a query's expression matches; score is BM25, higher is better.

    ``queries`` is the stated batch; a text that is no match expression is cleaned and tried as words, a blank one
    finds nothing. With a stored ``index`` of the same documents these are not read.
    """
    spark = docs.sparkSession
    trees = [(q, t) for q, text in queries if (t := parse_or_clean(text, columns)) is not None]
    leaves = list(dict.fromkeys(x for _, t in trees for x in _leaves(t) if x.terms))
    if not leaves:
        return spark.createDataFrame([], "query_id int, doc string, score double").select("query_id", F.col("doc").cast(docs.schema[id_col].dataType).alias("doc"), "score")
    numbers = {leaf: n for n, leaf in enumerate(leaves)}
    index = index or index_of(docs, id_col, columns, leaves)
    found = occurrences(index.posted, leaves)
    corpus = index.corpus  # one row
    tf = found.groupBy("leaf", "doc", "len").agg(F.count("*").alias("tf"))
    df = tf.groupBy("leaf").agg(F.count("*").alias("n"))  # one row per leaf of the batch
    idf = F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(IDF_FLOOR)
    weighed = tf.join(F.broadcast(df), "leaf").crossJoin(F.broadcast(corpus))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    by_doc = weighed.groupBy("doc").agg(F.collect_list(F.struct("leaf", part.alias("part"))).alias("parts"))  # at most one entry per leaf of the batch
    by_doc = by_doc.withColumn("met", F.col("parts.leaf"))
    if any(isinstance(x, Near) for _, t in trees for x in _walk(t)):
        spots = found.groupBy("doc").agg(F.collect_list(F.struct("leaf", "col", "pos")).alias("spots"))
        by_doc = by_doc.join(spots, "doc")
    def total(tree) -> Column:
        own = [numbers[x] for x in _leaves(tree) if x.terms]
        return F.aggregate(F.filter("parts", lambda p: p["leaf"].isin(own)), F.lit(0.0), lambda acc, p: acc + p["part"])

    verdicts = F.array(*[F.when(_resolved(t, numbers), F.struct(F.lit(q).alias("query_id"), total(t).alias("score"))) for q, t in trees])
    return by_doc.select("doc", F.explode(F.array_compact(verdicts)).alias("v")).select("v.query_id", "doc", "v.score")


def _walk(tree) -> list:
    return [tree] + (_walk(tree.left) + _walk(tree.right) if isinstance(tree, Node) else [])


def _resolved(tree, numbers: dict[Leaf, int]) -> Column:
    """A leaf without terms (punctuation only) matches nothing and is skipped beside others."""
    if isinstance(tree, Leaf) and not tree.terms:
        return F.lit(False)
    if isinstance(tree, Node):
        for this, other in ((tree.left, tree.right), (tree.right, tree.left)):
            if isinstance(this, Leaf) and not this.terms:
                return _resolved(other, numbers) if tree.op != "not" or this is tree.right else F.lit(False)
        left, right = _resolved(tree.left, numbers), _resolved(tree.right, numbers)
        return left & right if tree.op == "and" else left | right if tree.op == "or" else left & ~right
    return _holds(tree, numbers)


def keyword_search(docs: DataFrame, id_col: str, columns: Sequence[str], queries: Sequence[tuple[int, str]], k: int = 10, index: Index | None = None) -> DataFrame:
    """(query_id, doc, score, place): the k best matches of each query, ties by id."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc"))
    return match(docs, id_col, columns, queries, index).withColumn("place", place).where(F.col("place") <= k)


def rank_scores(hits: DataFrame) -> DataFrame:
    """Keyword scores by place: 1 - (place - 1) / hits of the query."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    return hits.withColumn("keyword", 1 - (F.col("place") - 1) / n)
