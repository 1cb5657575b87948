"""Running Cypher over a graph: compile, collect, stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cypher import parse
from .errors import GraphError
from .plans.query import Compiler
from .sources.graph import Graph

WRITES = {"create", "set", "remove", "delete", "merge", "foreach"}
SCHEMA = {"create_index", "create_constraint", "drop", "graph_type"}


@dataclass
class Result:
    columns: list[str]
    df: DataFrame | None
    summary: dict = field(default_factory=dict)

    def rows(self) -> list[tuple]:
        return [tuple(r) for r in self.df.collect()] if self.df is not None else []

    def values(self, column: str | None = None) -> list:
        i = 0 if column is None else self.columns.index(column)
        return [r[i] for r in self.rows()]

    def envelope(self) -> str:
        """Columns, rows and summary as one typed JSON text."""
        from .typed_json import envelope

        return envelope(self)

    def events(self) -> Iterator[tuple[int, str, object]]:
        """(ordinal, event, data): columns, then each row as it arrives, then the summary."""
        yield 0, "columns", self.columns
        n = 0
        if self.df is not None:
            for r in self.df.toLocalIterator():
                n += 1
                yield n, "row", tuple(r)
        yield n + 1, "summary", {**self.summary, "rows": n}


def kind_of(tree) -> str:
    kinds = {t.kind for t in tree.walk()}
    calls = {t.name.lower() for t in tree.walk() if t.kind == "call_proc"}
    version = any(c.startswith("graph.") and c not in READ_PROCEDURES for c in calls)
    write, schema = bool(kinds & WRITES), bool(kinds & SCHEMA)
    found = [n for n, x in (("write", write), ("schema", schema), ("version", version)) if x]
    return "read" if not found else found[0] if len(found) == 1 else "mixed"


READ_PROCEDURES = {"graph.branch.list", "graph.commit.get", "graph.tag.list", "graph.log", "graph.diff", "graph.merge.get", "graph.merge.list", "graph.merge.conflicts"}


def graph_procedures(graph: Graph) -> dict[str, Callable]:
    """Procedures that any graph has."""
    from .operators.search import fulltext

    spark = graph.spark

    def labels() -> DataFrame:
        return spark.createDataFrame([(x,) for x in graph.labels()], "label string")

    def keys() -> DataFrame:
        return spark.createDataFrame([(x,) for x in sorted(graph.property_types_safe())], "propertyKey string")

    def types() -> DataFrame:
        return spark.createDataFrame([(x,) for x in sorted({t.type for t in graph.rels})], "relationshipType string")

    def query_nodes(name: str, query: str, options: dict | None = None) -> DataFrame:
        from .plans.patterns import Matcher

        found = fulltext(graph, name, query, _plain(options))
        nodes, el = Matcher(graph, {}, {}).renamed(graph.scan_nodes(None), "node")
        joined = found.join(nodes, F.col("_id") == F.col(el.id))
        return joined.select(el.struct().col.alias("node"), "score").orderBy(F.desc("score"), F.col("node._id"))

    def query_rels(name: str, query: str, options: dict | None = None) -> DataFrame:
        from .plans.patterns import Matcher

        found = fulltext(graph, name, query, _plain(options))
        rels, el = Matcher(graph, {}, {}).renamed(graph.scan_rels(None), "rel")
        joined = found.join(rels, F.col("_id") == F.col(el.id))
        return joined.select(el.struct().col.alias("relationship"), "score").orderBy(F.desc("score"), F.col("relationship._id"))

    return {"db.labels": labels, "db.propertykeys": keys, "db.relationshiptypes": types, "db.index.fulltext.querynodes": query_nodes, "db.index.fulltext.queryrelationships": query_rels}


def _plain(options) -> dict:
    return options.asDict() if hasattr(options, "asDict") else dict(options or {})


def cypher(graph: Graph, text: str, params: dict | None = None, **options) -> Result:
    """A reading query over a graph; the result's DataFrame has not run yet.

    Options: ``graph_view`` (require_all, require_any, exclude_any), ``read_access``
    (hide, hide_prefixes, hide_pattern), ``read_only_no_external_io``.
    """
    tree = parse(text)
    kind = kind_of(tree)
    if kind != "read":
        raise GraphError("READ_ONLY", "this graph is a snapshot; writes need a graph store")
    if options.get("read_only_no_external_io") and any(t.kind == "load_csv" for t in tree.walk()):
        raise GraphError("EXTERNAL_IO_DENIED", "LOAD CSV reads outside the graph")
    if view := options.get("graph_view"):
        graph = graph.view(**view)
    if access := options.get("read_access"):
        graph = graph.hide(set(access.get("hide", ())), tuple(access.get("hide_prefixes", ())), access.get("hide_pattern"))
    compiler = Compiler(graph, params, {**graph_procedures(graph), **options.get("procedures", {})})
    rows = compiler.run(tree)
    names = list(rows.scope)
    df = compiler.result(rows, names)
    if tree.mode == "PROFILE":
        return Result(names, df, {"type": kind, "profile": profiled(df)})
    if tree.mode == "EXPLAIN":
        return Result(["plan"], graph.spark.createDataFrame([(df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")),)], "plan string"), {"type": kind})
    return Result(names, df, {"type": kind})


def profiled(df: DataFrame) -> list[dict]:
    """Run a query where its data is, and return the operators of the plan that ran, leaves last, with the
    rows that each put out (None: it does not count them)."""
    run = df._jdf.queryExecution()
    run.toRdd().count()
    out: list[dict] = []

    def visit(plan, depth: int) -> None:
        name = plan.nodeName()
        inner = {"AdaptiveSparkPlan": "executedPlan", "ShuffleQueryStage": "plan", "BroadcastQueryStage": "plan", "ResultQueryStage": "plan", "TableCacheQueryStage": "plan"}.get(name)
        if inner:
            visit(getattr(plan, inner)(), depth)
            return
        if not name.startswith(("WholeStageCodegen", "InputAdapter")):
            rows = plan.metrics().get("numOutputRows")
            out.append({"id": len(out), "operator": name, "depth": depth, "rows": rows.get().value() if rows.isDefined() else None})
            depth += 1
        children = plan.children()
        for i in range(children.size()):
            visit(children.apply(i), depth)

    visit(run.executedPlan(), 0)
    return out


def validate(text: str) -> dict:
    """Whether a text is a query, without running it."""
    try:
        return {"valid": True, "type": kind_of(parse(text)), "error": None}
    except GraphError as e:
        return {"valid": False, "type": None, "error": str(e)}
