"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, written

#: Link tables of up to this many rows are joined up in one task (about 60 MB); larger ones in rounds.
ONE_TASK = 1_000_000


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for links x[i] - y[i]."""
    names, at = np.unique(np.concatenate((x, y)), return_inverse=True)
    if not len(names):
        return names, names
    a, b = at[: len(x)], at[len(x) :]
    ends, other = np.concatenate((a, b)), np.concatenate((b, a))
    order = np.argsort(ends, kind="stable")
    other, starts = other[order], np.searchsorted(ends[order], np.arange(len(names)))
    root = np.arange(len(names))
    while True:
        new = np.minimum(root, np.minimum.reduceat(root[other], starts))
        while True:  # follow roots to their own
            far = new[new]
            if (far == new).all():
                break
            new = far
        # a root that moved takes its whole tree along
        np.minimum.at(new, root, new.copy())
        new = new[new]
        if (new == root).all():
            return names, names[root]
        root = new


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    x = np.concatenate([b.column(0).to_numpy() for b in held]) if held else np.zeros(0, np.int64)
    y = np.concatenate([b.column(1).to_numpy() for b in held]) if held else np.zeros(0, np.int64)
    names, roots = forest(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(roots.astype(np.int64))], ["node", "component"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: each linked node with the smallest node that it reaches.

    Links may repeat and run either way; null ends and self-links are dropped.  A node of
    large degree is grouped by map-side minima, and its least neighbour is broadcast to its
    links: they are never gathered.  Rounds stop when the
    table of (node, parent) no longer changes; every round is a written table.
    """
    x, y = F.least(a, b), F.greatest(a, b)
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    pairs = written(pairs.select(y.cast("long").alias("u"), x.cast("long").alias("v")).distinct(), "links")
    if pairs.count() <= ONE_TASK:
        return pairs.coalesce(1).mapInArrow(_in_one_task, "node long, component long")
    seen = None
    while True:
        # large star: every larger neighbour of u (and u's own) hangs on u's least neighbour
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree")), "least")
        large = looked_up(both, least, ["u"], "degree", inner=True).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour of u, and u, hang on the least of them
        large = written(large, "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")), "least")
        small = looked_up(large, least, ["u"], "degree", inner=True)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        pairs = written(small.where("u <> v").distinct(), "links")
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
