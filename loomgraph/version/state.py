"""A graph's state as two tables of whole records, its slots, and three-way merges of them.

nodes(id, labels, props), rels(id, type, src, dst, props), props: map of tagged texts.  A
layer holds the records that a commit changed, with ``deleted``; a snapshot is the latest
record for each id along the first parents.  For diff and merge a record falls apart into
slots: existence, labels and properties.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import GraphError
from ..plans.scratch import written
from ..sources.graph import Graph, NodeTable, RelTable
from .codec import decode, widest

NODES = "id long, labels array<string>, props map<string,string>"
RELS = "id long, type string, src long, dst long, props map<string,string>"


class Kinds:
    """Which keys have values of which tags: of all nodes, and of each relationship type.

    A commit carries it, so that opening a version reads no data.  It only grows along a
    branch; keys and tags that no record holds any more do no harm, and where they clash
    the records are asked.
    """

    def __init__(self, data: dict | None = None):
        data = data or {}
        self.node: dict[str, set[str]] = {k: set(t) for k, t in data.get("node", {}).items()}
        self.rel: dict[str, dict[str, set[str]]] = {r: {k: set(t) for k, t in keys.items()} for r, keys in data.get("rel", {}).items()}

    def plain(self) -> dict:
        return {"node": {k: sorted(t) for k, t in sorted(self.node.items())}, "rel": {r: {k: sorted(t) for k, t in sorted(keys.items())} for r, keys in sorted(self.rel.items())}}

    def copy(self) -> "Kinds":
        return Kinds(self.plain())

    def add(self, type_: str | None, tags: dict[str, str]) -> None:
        """Tags of the keys of nodes (type None) or of relationships of a type."""
        keys = self.node if type_ is None else self.rel.setdefault(type_, {})
        for k, tag in tags.items():
            keys.setdefault(k, set()).add(tag)

    def add_to_all_types(self, tags: dict[str, str]) -> None:
        for r in list(self.rel):
            self.add(r, tags)


@dataclass
class State:
    nodes: DataFrame
    rels: DataFrame
    kinds: Kinds | None = None

    @classmethod
    def empty(cls, spark: SparkSession) -> "State":
        return cls(spark.createDataFrame([], NODES), spark.createDataFrame([], RELS), Kinds())

    def apply(self, nodes: DataFrame | None, rels: DataFrame | None) -> "State":
        """With changed records (and ``deleted`` ones) in place of those of the same ids."""

        def one(base: DataFrame, delta: DataFrame | None) -> DataFrame:
            if delta is None:
                return base
            return base.join(delta.select("id"), "id", "left_anti").unionByName(delta.where("not deleted").select(*base.columns))

        return State(one(self.nodes, nodes), one(self.rels, rels), self.kinds)

    def kept(self, name: str) -> "State":
        return State(written(self.nodes, f"{name}-nodes"), written(self.rels, f"{name}-rels"), self.kinds)

    def scan_kinds(self) -> Kinds:
        """The kinds as the records have them: a row for each key and tag, and for each type."""
        tag = F.regexp_extract("v", "^([^:]*):", 1)
        out = Kinds()
        for k, t in self.nodes.select(F.explode("props").alias("k", "v")).select("k", tag).distinct().collect():
            out.add(None, {k: t})
        for r, k, t in self.rels.select("type", F.explode_outer("props").alias("k", "v")).select("type", "k", tag).distinct().collect():
            out.add(r, {k: t} if k is not None else {})
        return out

    def graph(self, spark: SparkSession, schema: dict, version: str | None = None) -> Graph:
        """The state as typed tables: one node table, one table for each relationship type."""

        def columns(df: DataFrame, keep: dict[str, str], tags: dict[str, set[str]]) -> DataFrame:
            cols = [typed(F.try_element_at("props", F.lit(k)), k, t).alias(k) for k, t in sorted(tags.items())]
            return df.select(*[F.col(c).alias(n) for c, n in keep.items()], *cols)

        def typed(value: F.Column, key: str, tags: set[str]) -> F.Column:
            try:
                return decode(value, widest(tags))[0]
            except GraphError:
                if not exact:
                    raise
                # values of several kinds under one key: an error to those who read it, and to nobody else
                return F.when(value.isNotNull(), F.raise_error(F.lit(f"TYPE_ERROR: values of the kinds {sorted(tags)} under {key}")).cast("string"))

        exact = False

        def of(kinds: Kinds) -> Graph:
            nodes = columns(self.nodes, {"id": "_id", "labels": "_labels"}, kinds.node)
            g = Graph(spark, [NodeTable(None, nodes)], [], dict(schema.get("indexes", {})), dict(schema.get("constraints", {})), dict(schema.get("graph_type", {})), version)
            for t, tags in sorted(kinds.rel.items()):
                g.rels.append(RelTable(t, columns(self.rels.where(F.col("type") == t), {"id": "_id", "src": "_src", "dst": "_dst"}, tags)))
            return g

        if self.kinds is not None:
            try:
                return of(self.kinds)
            except GraphError:  # tags that the records may not hold any more
                pass
        exact = True
        return of(self.scan_kinds())

    def slots(self) -> DataFrame:
        """slot (text), value: what diff and merge compare."""
        n = F.concat(F.lit("node/"), F.col("id").cast("string"))
        r = F.concat(F.lit("relationship/"), F.col("id").cast("string"))
        rel = F.concat_ws("|", "type", F.col("src").cast("string"), F.col("dst").cast("string"))
        parts = [
            self.nodes.select(n.alias("slot"), F.lit("").alias("value")),
            self.nodes.select(n.alias("n"), F.explode("labels").alias("l")).select(F.concat("n", F.lit("/label/"), "l").alias("slot"), F.lit("").alias("value")),
            self.nodes.select(n.alias("n"), F.explode("props").alias("k", "v")).select(F.concat("n", F.lit("/property/"), "k").alias("slot"), F.col("v").alias("value")),
            self.rels.select(r.alias("slot"), rel.alias("value")),
            self.rels.select(r.alias("n"), F.explode("props").alias("k", "v")).select(F.concat("n", F.lit("/property/"), "k").alias("slot"), F.col("v").alias("value")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    @classmethod
    def of_slots(cls, slots: DataFrame) -> "State":
        s = slots.select("value", F.split("slot", "/", 4).alias("p"))
        s = s.select(F.col("p")[0].alias("kind"), F.col("p")[1].cast("long").alias("id"), F.get("p", F.lit(2)).alias("part"), F.get("p", F.lit(3)).alias("key"), "value")
        props = F.map_from_entries(F.collect_list(F.when(F.col("part") == "property", F.struct("key", "value")))).alias("props")
        nodes = s.where("kind = 'node'").groupBy("id").agg(F.max(F.col("part").isNull()).alias("there"), F.array_sort(F.collect_list(F.when(F.col("part") == "label", F.col("key")))).alias("labels"), props)
        rels = s.where("kind = 'relationship'").groupBy("id").agg(F.max(F.when(F.col("part").isNull(), F.col("value"))).alias("def"), props)
        d = F.split("def", r"\|")
        rels = rels.where("def is not null").select("id", d[0].alias("type"), d[1].cast("long").alias("src"), d[2].cast("long").alias("dst"), "props")
        return cls(nodes.where("there").select("id", "labels", "props"), rels)


def _differing(kind: str, frames: list[DataFrame]) -> DataFrame:
    """Ids of the records that are not the same in all of some tables, compared as digests by id."""
    both = None
    for i, df in enumerate(frames):
        cols = [F.array_sort(F.map_entries("props")).alias("props") if c == "props" else F.col(c) for c in df.columns if c != "id"]
        one = df.select("id", F.md5(F.to_json(F.struct(*cols))).alias(f"d{i}"))
        both = one if both is None else both.join(one, "id", "full")
    same = F.lit(True)
    for i in range(1, len(frames)):
        same = same & F.col("d0").eqNullSafe(F.col(f"d{i}"))
    return written(both.where(~same).select("id"), f"differing-{kind}")


def _parted(states: list[State]) -> tuple[list[State], State]:
    """The records that differ, of each state; and those that are the same in all."""
    n, r = _differing("nodes", [s.nodes for s in states]), _differing("rels", [s.rels for s in states])
    last = states[-1]
    return [State(s.nodes.join(n, "id", "left_semi"), s.rels.join(r, "id", "left_semi")) for s in states], State(last.nodes.join(n, "id", "left_anti"), last.rels.join(r, "id", "left_anti"))


def changes(before: State, after: State) -> DataFrame:
    """slot, op, before, after for each slot in which two states differ."""
    (before, after), _ = _parted([before, after])
    a = before.slots().withColumnRenamed("value", "before")
    b = after.slots().withColumnRenamed("value", "after")
    both = a.join(b, "slot", "full").where("not before <=> after")
    kind = (
        F.when(F.contains("slot", F.lit("/property/")), F.when(F.col("after").isNull(), "RemoveProperty").otherwise("SetProperty"))
        .when(F.contains("slot", F.lit("/label/")), F.when(F.col("after").isNull(), "RemoveLabel").otherwise("AddLabel"))
        .when(F.startswith("slot", F.lit("node/")), F.when(F.col("after").isNull(), "DeleteNode").otherwise("AddNode"))
        .otherwise(F.when(F.col("after").isNull(), "DeleteRelationship").otherwise("AddRelationship"))
    )
    return both.select("slot", kind.alias("op"), "before", "after")


def three_way(base: State, ours: State, theirs: State) -> DataFrame:
    """slot, base, ours, theirs, merged, conflict, by the rule of one changed side.

    Records are compared whole first; only those that differ fall apart into slots that are
    joined, the slots of all others are the same on every side.
    """
    (base, ours, theirs), same = _parted([base, ours, theirs])
    v = F.col("value")
    rest = same.slots().select("slot", v.alias("base"), v.alias("ours"), v.alias("theirs"), v.alias("merged"), F.lit(False).alias("conflict"))
    return _by_slot(base, ours, theirs).union(rest)


def _by_slot(base: State, ours: State, theirs: State) -> DataFrame:
    x = base.slots().withColumnRenamed("value", "base")
    y = ours.slots().withColumnRenamed("value", "ours")
    z = theirs.slots().withColumnRenamed("value", "theirs")
    all_ = x.join(y, "slot", "full").join(z, "slot", "full")
    mine, other = ~F.col("ours").eqNullSafe(F.col("base")), ~F.col("theirs").eqNullSafe(F.col("base"))
    same = F.col("ours").eqNullSafe(F.col("theirs"))
    merged = F.when(mine, F.col("ours")).when(other, F.col("theirs")).otherwise(F.col("base"))
    rows = all_.select("slot", "base", "ours", "theirs", merged.alias("merged"), (mine & other & ~same).alias("conflict"))
    # a side that deletes an element against one that changes a part of it
    part = F.regexp_extract("slot", "^([^/]+/[^/]+)", 1)
    parent = rows.where(~F.contains("slot", F.lit("/label/")) & ~F.contains("slot", F.lit("/property/"))).where("base is not null and (ours is null) <> (theirs is null)").select(F.col("slot").alias("_parent"), F.col("ours").isNull().alias("_ours_gone"))
    touched = rows.withColumn("_parent", part).join(parent, "_parent")
    keeper = F.when(F.col("_ours_gone"), ~F.col("theirs").eqNullSafe(F.col("base")) & F.col("theirs").isNotNull()).otherwise(~F.col("ours").eqNullSafe(F.col("base")) & F.col("ours").isNotNull())
    clash = touched.where(keeper & F.col("slot").contains("/property/")).select(F.col("_parent").alias("slot")).distinct().withColumn("_clash", F.lit(True))
    # or deletes a node that a new relationship of the other side needs
    new = rows.where("slot like 'relationship/%' and slot not like '%/property/%' and base is null and merged is not null").select(F.split("merged", r"\|").alias("d"), F.col("ours").isNull().alias("_theirs"))
    ends = new.select(F.explode(F.array(F.concat(F.lit("node/"), F.col("d")[1]), F.concat(F.lit("node/"), F.col("d")[2]))).alias("slot")).distinct()
    gone = rows.where("slot like 'node/%' and slot not like '%/label/%' and slot not like '%/property/%' and base is not null and merged is null").select("slot")
    clash = clash.union(ends.join(gone, "slot").withColumn("_clash", F.lit(True))).distinct()
    return rows.join(clash, "slot", "left").select("slot", "base", "ours", "theirs", "merged", (F.col("conflict") | F.coalesce("_clash", F.lit(False))).alias("conflict"))
