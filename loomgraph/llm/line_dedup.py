"""Removal of lines that many sites share, by distinct-site spread.

A HyperLogLog sketch of sites per line hash is merged by aggregation (partial sketches
on the map side, so a line that a third of all rows hold costs each task one sketch).
Lines whose estimate is clearly above the threshold are boilerplate, those clearly
below stay, and those near it get an exact distinct count.  The sketches come with the line's
count, so that lines that many rows hold are looked up by a bounded broadcast and no task
gathers one line's rows.  Only DataFrame functions.

Defined results: lines are what stands between line feeds, compared after trimming
spaces, tabs and carriage returns; blank lines always stay; a null site counts as no
site; null text stays null with no lines; an empty text has one blank line; rows may
repeat, and each is cleaned; the order of lines stays, and a line that repeats within a text
goes or stays each time; very long texts and lines are taken whole; an empty table gives no
rows.  All columns stay; ``line_dedup`` (struct of n_lines and n_removed) is added, in place
of a column of that name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, tuned, written

MIN_SITES = 10
LG_K = 8
MARGIN = 0.25


def _key(line):
    return F.xxhash64(F.btrim(line, F.lit(" \t\r")))


def _blank(line):
    return F.btrim(line, F.lit(" \t\r")) == ""


def _lines(docs: DataFrame, *columns) -> DataFrame:
    """The hashes of the lines that are not blank, with some columns of their rows."""
    line = docs.select(*columns, F.explode(F.split("text", "\n", -1)).alias("__loom_line")).where(~_blank(F.col("__loom_line")))
    return line.withColumn("h", _key(F.col("__loom_line"))).drop("__loom_line")


def shared_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``h`` and ``n``: the hash of each line found on ``min_sites`` sites or more, and how many rows' lines it is."""
    line = _lines(docs.where(F.col("source").isNotNull()), F.col("source").cast("string").alias("site"))
    sketched = line.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("spread"), F.count("*").alias("n"))
    sketched = written(sketched.where(F.col("spread") >= min_sites * (1 - MARGIN)), "spread")
    sure = sketched.where(F.col("spread") > min_sites * (1 + MARGIN)).select("h", "n")
    near = sketched.where(F.col("spread") <= min_sites * (1 + MARGIN)).select("h", "n")
    exact = looked_up(line, near, ["h"], "n", inner=True).groupBy("h", "site").agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("sites"), F.sum("n").alias("n"))
    return sure.union(exact.where(F.col("sites") >= min_sites).select("h", "n"))


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    tuned(docs.sparkSession)
    bad = written(shared_lines(docs, min_sites), "boilerplate")
    names = [c for c in docs.columns if c != "line_dedup"]
    # a row is known by a hash; where two share one, each loses its own boilerplate lines all the same
    row = F.xxhash64("doc_id", "text")
    held = looked_up(_lines(docs, row.alias("__loom_row")), bad, ["h"], "n", inner=True)
    held = held.groupBy("__loom_row").agg(F.collect_set("h").alias("__loom_bad"))
    rows = docs.select(*names).withColumn("__loom_key", row).join(held, F.col("__loom_key") == F.col("__loom_row"), "left").drop("__loom_row")
    lines = F.split("text", "\n", -1)
    kept = F.when(F.col("__loom_bad").isNull(), lines).otherwise(F.filter(lines, lambda x: _blank(x) | ~F.array_contains(F.col("__loom_bad"), _key(x))))
    rows = rows.withColumn("__loom_lines", lines).withColumn("__loom_kept", kept)
    n = F.coalesce(F.size("__loom_lines"), F.lit(0))
    stats = F.struct(F.greatest(n, F.lit(0)).cast("long").alias("n_lines"), F.greatest(n - F.coalesce(F.size("__loom_kept"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"))
    rows = rows.withColumn("line_dedup", F.when(F.col("text").isNull(), F.struct(F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))).otherwise(stats))
    rows = rows.withColumn("text", F.when(F.col("__loom_bad").isNull(), F.col("text")).otherwise(F.array_join("__loom_kept", "\n")))
    return rows.select(*names, "line_dedup")
