"""Variable-length expansion by levels of joins.

Each level joins the frontier with the step table on the frontier's end.  A bounded
expansion is one plan, a union of its levels; an unbounded one, and one with a selector
that can stop early, writes each level and stops when a level is empty.  For the
shortest-path selectors each level drops pairs of ends that an earlier level reached, so
that work follows the number of pairs, not of paths.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..errors import GraphError
from ..plans.scratch import written

#: Levels that a bounded expansion may have and still be one plan.
UNROLL = 6
#: Levels after which the pairs that all levels reached become one table.
UNITE = 16


@dataclass
class Step:
    """near, far, rels (ids), nodes (ids after the near end) and ``g_<var>`` for each carried variable."""

    df: DataFrame
    carried: dict[str, S.DataType] = field(default_factory=dict)
    single: bool = True


def expand(starts: DataFrame, step: Step, low: int, high: int | None, mode: str = "TRAIL", selector: str | None = None, count: int | None = None, ends: DataFrame | None = None) -> DataFrame:
    """start, end, hops, rels, nodes and the carried lists, for paths of ``low`` to ``high`` repetitions."""
    lists = [f"g_{v}" for v in step.carried]
    empty = [F.array().cast(S.ArrayType(step.df.schema[c].dataType)).alias(c) for c in lists]
    frontier = starts.select("start", F.col("start").alias("end"), F.lit(0).alias("hops"), F.array().cast("array<bigint>").alias("rels"), F.array().cast("array<bigint>").alias("nodes"), *empty)
    early = selector in ("any_shortest", "all_shortest") and low <= 1
    stepwise = high is None or early or high > UNROLL
    found: list[DataFrame] = [frontier] if low == 0 else []
    reached = frontier.select("start", "end") if low == 0 else None
    level = 0
    hop = step.df.select(F.col("near").alias("_near"), F.col("far").alias("_far"), F.col("rels").alias("_rels"), F.col("nodes").alias("_nodes"), *[F.col(c).alias(f"_{c}") for c in lists])
    while high is None or level < high:
        level += 1
        nxt = frontier.join(hop, F.col("end") == F.col("_near"))
        if mode == "TRAIL":
            nxt = nxt.where(~F.array_contains("rels", F.col("_rels")[0]) if step.single else ~F.arrays_overlap("rels", "_rels"))
        elif mode == "ACYCLIC":
            clash = F.array_contains("nodes", F.col("_far")) if step.single else F.arrays_overlap("nodes", "_nodes")
            nxt = nxt.where(~clash & ~F.array_contains("_nodes", F.col("start")))
        nxt = nxt.select("start", F.col("_far").alias("end"), (F.col("hops") + 1).alias("hops"), F.concat("rels", "_rels").alias("rels"), F.concat("nodes", "_nodes").alias("nodes"), *[F.array_append(F.col(c), F.col(f"_{c}")).alias(c) for c in lists])
        if early:
            if reached is not None:
                nxt = nxt.join(reached, ["start", "end"], "left_anti")
            if selector == "any_shortest":
                nxt = _best(nxt, 1)
        if stepwise:
            nxt = written(nxt, "level")
            if nxt.isEmpty():
                break
            if early:
                # the levels' own tables say what was reached; they are put together only now and then
                new = nxt.select("start", "end") if selector == "any_shortest" else nxt.select("start", "end").distinct()
                reached = new if reached is None else reached.union(new)
                if level % UNITE == 0:
                    reached = written(reached, "reached")
        if level >= low:
            found.append(nxt)
        frontier = nxt
        if level > 10_000:
            raise GraphError("RESOURCE_LIMIT", "a path search did not end")
        if mode == "WALK" and high is None and not early:
            if selector is None:
                raise GraphError("SEMANTIC_ERROR", "an unbounded walk does not end")
            if _settled(found, selector, count or 1):
                break
    if not found:
        return frontier.where(F.lit(False))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    if ends is not None:
        out = out.join(ends, "end", "left_semi")
    if selector in ("any_shortest", "any", "shortest"):
        out = _best(out, 1 if selector == "any_shortest" else count or 1)
    elif selector in ("all_shortest", "groups"):
        w = Window.partitionBy("start", "end").orderBy("hops")
        rank = F.rank() if selector == "all_shortest" else F.dense_rank()
        out = out.withColumn("_n", rank.over(w)).where(F.col("_n") <= (1 if selector == "all_shortest" else count or 1)).drop("_n")
    return out


def _best(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` shortest paths between each pair of ends; ties by the sequence of relationships."""
    w = Window.partitionBy("start", "end").orderBy("hops", "rels")
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def _settled(found: list[DataFrame], selector: str, n: int) -> bool:
    """Whether the last level's pairs all have enough paths already (unbounded walks with a selector)."""
    if len(found) <= n:
        return False
    before = found[0].select("start", "end")
    for f in found[1:-1]:
        before = before.union(f.select("start", "end"))
    full = before.groupBy("start", "end").count().where(F.col("count") >= n)
    return found[-1].join(full, ["start", "end"], "left_anti").isEmpty()
