"""Vector and full-text search as exact distributed top-k."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import GraphError
from ..functions.vectors import closeness, scored
from ..plans.expressions import Expressions
from ..plans.values import DOUBLE, Element, Rows, Value, fresh
from ..sources.graph import Graph

K1, B = 1.2, 0.75


def index_of(graph: Graph, name: str, kind: str) -> dict:
    found = graph.indexes.get(name)
    if found is None or found["type"] != kind:
        raise GraphError("NOT_FOUND", f"no {kind} index {name}")
    return found


def vector_search(compiler, s, rows: Rows, before: Rows) -> Rows:
    """SEARCH: filter, score, keep the k best; for each input row where there are any.

    Without input rows a top-k (partial in each task) is taken; with them a window ranks
    the candidates of each row.
    """
    index = index_of(compiler.graph, s.index, "VECTOR")
    el = rows.scope[s.var]
    if not isinstance(el, Element):
        raise GraphError("SEMANTIC_ERROR", f"{s.var} is no node or relationship")
    prop = index["properties"][0]
    k = compiler.count_of(s.limit, "LIMIT")
    rows = with_property(compiler, rows, s.var, prop)
    el = rows.scope[s.var]
    for label in index["labels"]:
        test = F.array_contains(F.col(el.meta["labels"]), label) if el.kind == "node" else F.col(el.meta["type"]) == label
        rows = rows.with_(df=rows.df.where(test))
    x = Expressions(rows, compiler.params)
    if s.where is not None:
        rows = rows.with_(df=rows.df.where(x.predicate(s.where)))
    q = x(s.query)
    score, near, kind = fresh("score"), fresh("near"), index.get("similarity", "cosine")
    vector = F.col(el.props[prop][0]).cast("array<double>")
    query = q.col.cast("array<double>")
    sound = vector.isNotNull() & query.isNotNull() & (F.size(vector) == F.size(query))
    df = rows.df.where(sound).withColumn(near, closeness(kind, vector, query))
    best = [F.col(near).desc(), F.col(el.id).asc()]
    keys = list(dict.fromkeys(b.id if isinstance(b, Element) else b.name for v, b in before.scope.items() if v in rows.scope))
    if keys:
        n = fresh("rank")
        df = df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col(n) <= k).drop(n)
    else:
        df = df.orderBy(*best).limit(k)
    df = df.withColumn(score, scored(kind, F.col(near))).drop(near)
    scope = dict(rows.scope)
    if s.score:
        scope[s.score] = Value(score, DOUBLE)
    return rows.with_(df=df, scope=scope)


def with_property(compiler, rows: Rows, var: str, prop: str) -> Rows:
    """Bring in a property that the query itself does not read."""
    el = rows.scope[var]
    if prop in el.props and "labels" in el.meta:
        return rows
    df = compiler.graph.scan_nodes(None, {prop} | set(el.props)) if el.kind == "node" else compiler.graph.scan_rels(None, {prop} | set(el.props))
    df, full = compiler.matcher().renamed(df, el.kind)
    joined = rows.df.join(df, F.col(el.id) == F.col(full.id))
    return rows.with_(df=joined, scope={**rows.scope, var: Element(el.kind, el.id, full.meta, full.props, el.known)})


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def terms_of(column: F.Column) -> F.Column:
    """Runs of letters and digits, lower-cased, accents of Latin letters folded."""
    accents = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
    plain = "".join(fold(c) for c in accents)
    return F.regexp_extract_all(F.translate(F.lower(column), accents, plain), F.lit(r"([\p{L}\p{N}]+)"), 1)


def normalised(raw: F.Column) -> F.Column:
    """A score that is better the higher from a raw rank that is better the lower; a positive rank, which only
    a term in most of the texts can have, comes after all others."""
    return F.when(raw <= 0, -raw).otherwise(1 / (1 + raw))


def fulltext(graph: Graph, name: str, query: str, options: dict | None = None) -> DataFrame:
    """node (or relationship) id and BM25 score, best first.

    Terms are alternatives; ``+term`` must and ``-term`` must not occur, ``"a phrase"``
    must occur as it is.  Document frequencies and the mean length come from all indexed
    elements; a term's postings are found by one scan, as the token table is not stored.
    """
    options = options or {}
    index = index_of(graph, name, "FULLTEXT")
    node = index.get("entity", "NODE") == "NODE"
    props = index["properties"]
    frames = [graph.scan_nodes({x}, set(props)) for x in index["labels"]] if node else [graph.scan_rels(set(index["labels"]), set(props))]
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f, allowMissingColumns=True)
    text = F.concat_ws("\n", *[F.col(p).cast("string") for p in props if p in df.columns])
    df = df.dropDuplicates(["_id"]) if len(frames) > 1 else df
    base = df.select("_id", text.alias("_text")).withColumn("_terms", terms_of(F.col("_text"))).withColumn("_n", F.size("_terms"))
    must, never, may, phrases = [], [], [], re.findall(r'"([^"]+)"', query)
    for word in re.sub(r'"[^"]*"', " ", query).split():
        if word.upper() in ("AND", "OR", "NOT"):
            continue
        t = re.findall(r"\w+", fold(word.lstrip("+-")))
        (must if word[0] == "+" else never if word[0] == "-" else may).extend(t)
    for p in phrases:
        must += re.findall(r"\w+", fold(p))
    terms = list(dict.fromkeys(must + may))
    if not terms:
        return base.select("_id", F.lit(0.0).alias("score")).where(F.lit(False))

    def occurrences(t: str) -> F.Column:
        return F.size(F.filter("_terms", lambda x: x == t))

    counts = [occurrences(t).alias(f"_c{i}") for i, t in enumerate(terms)]
    scored = base.select("_id", "_text", "_terms", "_n", *counts)
    stats = scored.agg(F.count(F.lit(1)).alias("N"), F.avg("_n").alias("L"), *[F.sum((F.col(f"_c{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(terms))])
    scored = scored.crossJoin(F.broadcast(stats))  # one row
    total = F.lit(0.0)
    for i in range(len(terms)):
        c, d = F.col(f"_c{i}"), F.col(f"d{i}")
        idf = F.greatest(F.log((F.col("N") - d + 0.5) / (d + 0.5)), F.lit(1e-6))
        total = total + idf * c * (K1 + 1) / (c + K1 * (1 - B + B * F.col("_n") / F.col("L")))
    hit = F.lit(False)
    for i in range(len(terms)):
        hit = hit | (F.col(f"_c{i}") > 0)
    for t in must:
        hit = hit & F.array_contains("_terms", t)
    for t in never:
        hit = hit & ~F.array_contains("_terms", t)
    for p in phrases:
        words = " ".join(re.findall(r"\w+", fold(p)))
        hit = hit & F.contains(F.concat(F.lit(" "), F.array_join("_terms", " "), F.lit(" ")), F.lit(f" {words} "))
    out = scored.where(hit).select("_id", normalised(-total).alias("score")).orderBy(F.desc("score"), "_id")
    if options.get("skip"):
        out = out.offset(int(options["skip"]))
    if options.get("limit") is not None:
        out = out.limit(int(options["limit"]))
    return out
