"""The driver's star-schema tables as one property graph.

Tables are opened when a pattern reads them, and a file's schema is inferred once for
each of its states, so that a query pays for the tables that it names and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .graph import Frame, Graph, GraphBuilder

_schemas: dict[str, tuple[int, S.StructType]] = {}


def table(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet table at ``path``; the known schema serves until the path changes."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stamp = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).getModificationTime()
    known = _schemas.get(path)
    if known is None or known[0] != stamp:
        known = _schemas[path] = (stamp, spark.read.parquet(path).schema)
    return spark.read.schema(known[1]).parquet(path)


def warehouse_graph(spark: SparkSession, sf_dir: str) -> Graph:
    def t(name: str, *changes) -> Frame:
        def frame() -> DataFrame:
            df = table(spark, f"{sf_dir}/{name}.parquet")
            for change in changes:
                df = change(df)
            return df

        return frame

    def local(column: str):
        return lambda df: df.withColumn(column, F.col(column).cast("timestamp_ntz"))

    def turned(df: DataFrame) -> DataFrame:
        return df.withColumn("turn_id", F.col("conv_id") * 1000 + F.col("turn"))

    def followed(df: DataFrame) -> DataFrame:
        after = Window.partitionBy("conv_id").orderBy("turn")
        return df.withColumn("next_id", F.lead("turn_id").over(after)).where("next_id is not null")

    def row_id(df: DataFrame) -> DataFrame:
        # (l_orderkey, l_linenumber) repeats, whole rows do not: a row's id is a hash of all its columns
        return df.withColumn("row_id", F.pmod(F.xxhash64(*df.columns), F.lit(1 << 62)))

    b = GraphBuilder(spark)
    b.node("Region", t("region"), "r_regionkey").node("Nation", t("nation"), "n_nationkey").node("Customer", t("customer"), "c_custkey")
    b.node("Supplier", t("supplier"), "s_suppkey").node("Part", t("part"), "p_partkey")
    b.node("Order", t("orders", local("o_orderdate")), "o_orderkey")
    b.node("Event", t("events", local("ts")), "event_id")
    b.node("Doc", t("documents"), "doc_id").node("Item", t("embeddings"), "vec_id")
    b.node("Turn", t("conversations", turned), "turn_id")
    b.rel("IN_REGION", t("nation"), ("Nation", "n_nationkey"), ("Region", "n_regionkey"), key="n_nationkey")
    b.rel("IN_NATION", t("customer"), ("Customer", "c_custkey"), ("Nation", "c_nationkey"), key="c_custkey")
    b.rel("SUPPLIES_FROM", t("supplier"), ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), key="s_suppkey")
    b.rel("PLACED", t("orders"), ("Customer", "o_custkey"), ("Order", "o_orderkey"), key="o_orderkey")
    line = t("lineitem", row_id, local("l_shipdate"))
    props = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    b.rel("CONTAINS", line, ("Order", "l_orderkey"), ("Part", "l_partkey"), key="row_id", props=props)
    b.rel("SUPPLIED_BY", line, ("Order", "l_orderkey"), ("Supplier", "l_suppkey"), key="row_id", props=["l_quantity"])
    b.rel("NEXT", t("conversations", turned, followed), ("Turn", "turn_id"), ("Turn", "next_id"), key="turn_id")
    g = b.build()
    g.indexes["item_vectors"] = {"name": "item_vectors", "type": "VECTOR", "labels": ["Item"], "properties": ["embedding"], "similarity": "cosine", "entity": "NODE"}
    g.indexes["item_euclid"] = {"name": "item_euclid", "type": "VECTOR", "labels": ["Item"], "properties": ["embedding"], "similarity": "euclidean", "entity": "NODE"}
    g.indexes["doc_text"] = {"name": "doc_text", "type": "FULLTEXT", "labels": ["Doc"], "properties": ["text"], "entity": "NODE"}
    return g
