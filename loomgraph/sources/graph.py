"""A graph snapshot: typed node and relationship tables, and how tables become one.

Each node table holds one label set, each relationship table one type, with properties
as plain columns, so that Catalyst prunes columns and pushes filters to the files.
Reserved columns: ``_id`` and ``_labels`` of nodes; ``_id``, ``_type``, ``_src`` and
``_dst`` of relationships.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..errors import invalid

#: Node ids of a table: its ordinal times this, plus its key.
STRIDE = 1 << 40
NODE = ("_id", "_labels")
REL = ("_id", "_type", "_src", "_dst")


#: A table, or how to open it; what no pattern reads is never opened.
Frame = DataFrame | Callable[[], DataFrame]


def opened(frame: Frame) -> DataFrame:
    return frame() if callable(frame) else frame


class _Table:
    @property
    def df(self) -> DataFrame:
        self.frame = opened(self.frame)
        return self.frame


@dataclass
class NodeTable(_Table):
    labels: tuple[str, ...] | None  # None: labels differ from row to row
    frame: Frame

    def properties(self) -> dict[str, S.DataType]:
        return {f.name: f.dataType for f in self.df.schema if f.name not in NODE}


@dataclass
class RelTable(_Table):
    type: str
    frame: Frame
    source: tuple[str, ...] | None = None  # labels that every source node has
    target: tuple[str, ...] | None = None
    sound: bool = True  # every end exists
    single: frozenset[str] = frozenset()  # ends, of _src and _dst, at which a node has one such relationship at most

    def properties(self) -> dict[str, S.DataType]:
        return {f.name: f.dataType for f in self.df.schema if f.name not in REL}


@dataclass
class Graph:
    spark: SparkSession
    nodes: list[NodeTable] = field(default_factory=list)
    rels: list[RelTable] = field(default_factory=list)
    indexes: dict[str, dict] = field(default_factory=dict)
    constraints: dict[str, dict] = field(default_factory=dict)
    graph_type: dict = field(default_factory=dict)
    version: str | None = None

    def labels(self) -> list[str]:
        fixed = {x for t in self.nodes if t.labels for x in t.labels}
        for t in self.nodes:
            if t.labels is None:
                fixed |= {r[0] for r in t.df.select(F.explode("_labels")).distinct().collect()}  # names of labels: a catalog's size
        return sorted(fixed)

    def property_types(self) -> dict[str, S.DataType]:
        out: dict[str, S.DataType] = {}
        for t in [*self.nodes, *self.rels]:
            for k, v in t.properties().items():
                out[k] = wider(out.get(k), v)
        return out

    def property_types_safe(self) -> set[str]:
        return {k for t in [*self.nodes, *self.rels] for k in t.properties()}

    def scan_nodes(self, wanted: set[str] | None = None, keep: set[str] | None = None) -> DataFrame:
        """Nodes of the tables that can hold all of ``wanted`` labels; ``keep`` names the properties needed (None: all)."""
        tables = [t for t in self.nodes if t.labels is None or not wanted or wanted <= set(t.labels)]
        if not tables:
            return self.spark.createDataFrame([], "_id long, _labels array<string>")
        frames = []
        for t in tables:
            df = t.df if t.labels is None else t.df.withColumn("_labels", F.array(*[F.lit(x) for x in t.labels]))
            if t.labels is None and wanted:
                for w in sorted(wanted):
                    df = df.where(F.array_contains("_labels", w))
            frames.append(df.select("_id", "_labels", *[c for c in df.columns if c not in NODE and (keep is None or c in keep)]))
        return union(frames)

    def scan_rels(self, types: set[str] | None = None, keep: set[str] | None = None) -> DataFrame:
        tables = [t for t in self.rels if types is None or t.type in types]
        if not tables:
            return self.spark.createDataFrame([], "_id long, _type string, _src long, _dst long")
        return union([t.df.withColumn("_type", F.lit(t.type)).select(*REL, *[c for c in t.df.columns if c not in REL and (keep is None or c in keep)]) for t in tables])

    def view(self, require_all=(), require_any=(), exclude_any=()) -> "Graph":
        """The part of the graph whose nodes pass a label selector, and the relationships among them."""
        nodes, kept = [], []
        for t in self.nodes:
            df = t.df if t.labels is None else t.df.withColumn("_labels", F.array(*[F.lit(x) for x in t.labels]))
            test = F.lit(True)
            for x in require_all:
                test &= F.array_contains("_labels", x)
            if require_any:
                test &= F.arrays_overlap("_labels", F.array(*[F.lit(x) for x in require_any]))
            if exclude_any:
                test &= ~F.arrays_overlap("_labels", F.array(*[F.lit(x) for x in exclude_any]))
            if t.labels is not None:
                have = set(t.labels)
                if not set(require_all) <= have or require_any and not have & set(require_any) or have & set(exclude_any):
                    continue
                nodes.append(t)
                kept.append(t)
            else:
                nodes.append(NodeTable(None, df.where(test)))
        ids = union([t.df.select("_id") for t in nodes]) if nodes else self.spark.createDataFrame([], "_id long")
        all_labels = {x for t in kept for x in t.labels}
        rels = []
        for r in self.rels:
            df = r.df
            for end, labels in (("_src", r.source), ("_dst", r.target)):
                if not (labels and set(labels) <= all_labels and all(set(t.labels or ()) != set(labels) or t in kept for t in self.nodes)):
                    df = df.join(ids.withColumnRenamed("_id", end), end, "left_semi")
            rels.append(replace(r, frame=df))
        return replace(self, nodes=nodes, rels=rels)

    def hide(self, names: set[str] = frozenset(), prefixes: tuple[str, ...] = (), pattern: str | None = None) -> "Graph":
        """Without the properties that an access policy hides."""
        import re

        def shown(df: DataFrame) -> DataFrame:
            return df.drop(*[c for c in df.columns if c not in (*NODE, *REL) and (c in names or c.startswith(prefixes or ("\0",)) or pattern and re.search(pattern, c))])

        def later(t: NodeTable | RelTable) -> Frame:
            return lambda: shown(t.df)

        return replace(self, nodes=[replace(t, frame=later(t)) for t in self.nodes], rels=[replace(t, frame=later(t)) for t in self.rels])


def wider(a: S.DataType | None, b: S.DataType) -> S.DataType:
    if a is None or a == b:
        return b
    if isinstance(a, S.NumericType) and isinstance(b, S.NumericType):
        return S.DoubleType() if isinstance(a, (S.DoubleType, S.FloatType)) or isinstance(b, (S.DoubleType, S.FloatType)) else S.LongType()
    raise invalid(f"a property has values of types {a.simpleString()} and {b.simpleString()} in one scan")


def union(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a frame lacks are null, integers and floats meet as floats."""
    if len(frames) == 1:
        return frames[0]
    kinds: dict[str, S.DataType] = {}
    for df in frames:
        for f in df.schema:
            kinds[f.name] = wider(kinds.get(f.name), f.dataType)
    out = None
    for df in frames:
        have = {f.name: f.dataType for f in df.schema}
        df = df.select(*[(F.col(f"`{c}`").cast(k) if have.get(c) != k else F.col(f"`{c}`")).alias(c) if c in have else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
        out = df if out is None else out.unionByName(df)
    return out


def normal(df: DataFrame) -> DataFrame:
    """Columns in the engine's types: INTEGER is long, FLOAT double, timestamps without a zone stay as they are."""
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (S.ByteType, S.ShortType, S.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (S.FloatType, S.DecimalType)):
            c = c.cast("double")
        elif isinstance(f.dataType, S.ArrayType) and isinstance(f.dataType.elementType, (S.FloatType, S.DecimalType)):
            c = c.cast("array<double>")
        elif isinstance(f.dataType, S.ArrayType) and isinstance(f.dataType.elementType, (S.ByteType, S.ShortType, S.IntegerType)):
            c = c.cast("array<long>")
        cols.append(c.alias(f.name))
    return df.select(*cols)


class GraphBuilder:
    """Nodes and relationships from any tables.

    ``df`` may be a function that opens the table.  ``node(label, df, key)`` gives each label set an ordinal; ids are ``ordinal * STRIDE +
    key`` and so unique.  ``rel(type, df, (label, column), (label, column))`` names the
    ends by label and key column; relationship ids come from ``key`` where there is one,
    else from a hash of all columns (parallel equal rows need a key).  An end whose column
    is the key has one relationship of the type for each node, which orders joins.
    """

    def __init__(self, spark: SparkSession):
        self.graph = Graph(spark)
        self.ordinals: dict[str, int] = {}

    def node(self, label: str | tuple[str, ...], df: Frame, key: str, props: list[str] | None = None) -> "GraphBuilder":
        labels = (label,) if isinstance(label, str) else tuple(label)
        self.ordinals[labels[0]] = n = len(self.ordinals) + 1

        def frame() -> DataFrame:
            rows = normal(opened(df))
            cols = [F.col(f"`{c}`") for c in (props if props is not None else rows.columns)]
            return rows.select((F.lit(n * STRIDE) + F.col(f"`{key}`").cast("long")).alias("_id"), *cols)

        self.graph.nodes.append(NodeTable(labels, frame))
        return self

    def end(self, label: str, column: str | Column) -> Column:
        return F.lit(self.ordinals[label] * STRIDE) + (F.col(column) if isinstance(column, str) else column).cast("long")

    def rel(self, type_: str, df: Frame, source: tuple[str, str | Column], target: tuple[str, str | Column], key: str | Column | None = None, props: list[str] | None = None, sound: bool = True) -> "GraphBuilder":
        ordinal = len(self.graph.rels) + 1
        src, dst = self.end(*source), self.end(*target)

        def frame() -> DataFrame:
            rows = opened(df)
            key_col = F.lit(ordinal * STRIDE) + (F.col(key) if isinstance(key, str) else key).cast("long") if key is not None else F.xxhash64(F.lit(ordinal), *[F.col(f"`{c}`") for c in rows.columns])
            rows = normal(rows.withColumn("__id", key_col).withColumn("__src", src).withColumn("__dst", dst)).where("__src is not null and __dst is not null")
            return rows.select(F.col("__id").alias("_id"), F.col("__src").alias("_src"), F.col("__dst").alias("_dst"), *[F.col(f"`{c}`") for c in props or []])

        single = frozenset(end for end, (_, column) in (("_src", source), ("_dst", target)) if isinstance(key, str) and isinstance(column, str) and key == column)
        self.graph.rels.append(RelTable(type_, frame, (source[0],), (target[0],), sound, single))
        return self

    def build(self) -> Graph:
        return self.graph
