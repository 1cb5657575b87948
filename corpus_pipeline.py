"""The corpus pipeline: documents in, packed training sequences out.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which ``run`` writes as Parquet in the shared folder and reads again as the
next stage's documents.  All stages but the last return the columns of documents.

Defined results: a row is judged on its own text, whatever its doc_id; a null text is an
empty one to every stage and packs as the end id alone; empty texts are no near copies of
each other; of rows that have doc_id and text in common
one stays, the same in every run; rows without a doc_id are judged and kept like others and
come last where the smallest doc_id stays; of tied rows the smaller row key stays; very long
texts are taken whole by every stage; empty tables give no rows, and without labels no row
is toxic; other columns, whatever their names, stay until the last stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import scratch
from loomgraph.llm.line_dedup import line_dedup
from loomgraph.llm.packing import pack
from loomgraph.llm.queries import tokenizer
from loomgraph.llm.set_join import near_sets
from loomgraph.llm.suffix_dedup import suffix_dedup
from loomgraph.llm.toxicity import fit, score

#: SQL can express neither the learned scores nor the packing.
ORACLE_SQL = None


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text, where there is such a column."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def _row() -> Column:
    """Key of a row: its doc_id, which may be null, and its text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is predicted toxic go, with a doc_id or without."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels)
    scored = score(docs.select(_row().alias("doc_id"), "text"), model).where("predicted = 1").select(F.col("doc_id").alias("__loom_row")).distinct()
    return docs.join(scored, _row() == scored["__loom_row"], "left_anti")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; all documents stay."""
    return _sized(line_dedup(docs).select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays (rows without one come
    last); of rows with one doc_id and text, the one whose columns hash least."""
    keys = docs.select(F.col("doc_id").cast("long").alias("__loom_id"), _row().alias("__loom_row")).distinct()
    groups = near_sets(docs.select(_row().alias("doc_id"), "text")).select(F.col("doc_id").alias("__loom_row"), "component_id").distinct()
    first = F.min(F.struct(F.col("__loom_id").isNull(), "__loom_id", "__loom_row")).alias("first")
    stay = keys.join(groups, "__loom_row").groupBy("component_id").agg(first).select("first.__loom_row")
    kept = docs.join(stay, _row() == stay["__loom_row"], "left_semi")
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = kept.groupBy(_row().alias("__loom_row")).agg(F.min_by(every, F.xxhash64(every)).alias("__loom_first"))
    return first.select(*[F.col("__loom_first")[c].alias(c) for c in docs.columns])


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; all documents stay."""
    return _sized(suffix_dedup(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer("byte_bpe_50k.json"), sequence=1024, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("near_copies", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
