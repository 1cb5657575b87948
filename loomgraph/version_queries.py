"""Registered version queries: two states derived from the orders table, compared slot by slot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.values import Val
from .version.codec import encode
from .version.state import RELS, State, changes, three_way


def _orders(spark: SparkSession, sf_dir: str, price: F.Column, keep: F.Column) -> State:
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").where(keep)
    status = encode(Val(F.col("o_orderstatus"), t.schema["o_orderstatus"].dataType))
    from .plans.values import LONG

    cents = encode(Val(F.round(price * 100).cast("long"), LONG))
    nodes = t.select(F.col("o_orderkey").alias("id"), F.array(F.lit("Order")).alias("labels"), F.create_map(F.lit("status"), status, F.lit("cents"), cents).alias("props"))
    return State(nodes, spark.createDataFrame([], RELS))


def base(spark, d):
    return _orders(spark, d, F.col("o_totalprice"), F.lit(True))


def ours(spark, d):
    return _orders(spark, d, F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")), F.col("o_orderkey") % 100 != 7)


def theirs(spark, d):
    return _orders(spark, d, F.when(F.col("o_orderkey") % 15 == 0, F.col("o_totalprice") + 2).otherwise(F.col("o_totalprice")), F.lit(True))


def diff_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(base(spark, sf_dir), ours(spark, sf_dir)).groupBy("op").agg(F.count("*").alias("n"))


def merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = three_way(base(spark, sf_dir), ours(spark, sf_dir), theirs(spark, sf_dir))
    return rows.where("conflict and slot like '%/property/cents'").select("slot", "base", "ours", "theirs")


def merged_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = three_way(base(spark, sf_dir), ours(spark, sf_dir), theirs(spark, sf_dir))
    return rows.where("not conflict and merged is not null and slot like '%/property/cents'").agg(F.count("*").alias("n"), F.sum(F.substring("merged", 3, 30).cast("long")).alias("cents"))


def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A changed record over a base, read at both versions."""
    old, new = base(spark, sf_dir), ours(spark, sf_dir)
    delta = new.nodes.where("id % 10 = 0").withColumn("deleted", F.lit(False))
    gone = old.nodes.where("id % 100 = 7").withColumn("deleted", F.lit(True))
    after = old.apply(delta.unionByName(gone), None)
    total = F.sum(F.substring(F.col("props")["cents"], 3, 30).cast("long"))
    return old.nodes.agg(F.lit("before").alias("version"), F.count("*").alias("n"), total.alias("cents")).union(after.nodes.agg(F.lit("after"), F.count("*"), total))


QUERIES = {"diff_ops": diff_ops, "merge_conflicts": merge_conflicts, "merged_prices": merged_prices, "time_travel": time_travel}
_C = "round(o_totalprice * 100)::BIGINT"
ORACLE_SQL = {
    "diff_ops": """SELECT 'DeleteNode' AS op, count(*)::BIGINT AS n FROM orders WHERE o_orderkey % 100 = 7 UNION ALL
SELECT 'RemoveLabel', count(*)::BIGINT FROM orders WHERE o_orderkey % 100 = 7 UNION ALL SELECT 'RemoveProperty', 2 * count(*)::BIGINT FROM orders WHERE o_orderkey % 100 = 7 UNION ALL
SELECT 'SetProperty', count(*)::BIGINT FROM orders WHERE o_orderkey % 10 = 0""",
    "merge_conflicts": f"""SELECT 'node/' || o_orderkey || '/property/cents' AS slot, 'i:' || {_C} AS base, 'i:' || round((o_totalprice + 1) * 100)::BIGINT AS ours, 'i:' || round((o_totalprice + 2) * 100)::BIGINT AS theirs FROM orders WHERE o_orderkey % 30 = 0
UNION ALL SELECT 'node/' || o_orderkey || '/property/cents', 'i:' || {_C}, NULL, 'i:' || round((o_totalprice + 2) * 100)::BIGINT FROM orders WHERE o_orderkey % 100 = 7 AND o_orderkey % 15 = 0""",
    "merged_prices": f"""SELECT count(*)::BIGINT AS n, sum(CASE WHEN o_orderkey % 10 = 0 THEN round((o_totalprice + 1) * 100) WHEN o_orderkey % 15 = 0 THEN round((o_totalprice + 2) * 100) ELSE {_C} END)::BIGINT AS cents
FROM orders WHERE o_orderkey % 30 <> 0 AND o_orderkey % 100 <> 7""",
    "time_travel": f"""SELECT 'before' AS version, count(*)::BIGINT AS n, sum({_C})::BIGINT AS cents FROM orders UNION ALL
SELECT 'after', count(*)::BIGINT, sum(CASE WHEN o_orderkey % 10 = 0 THEN round((o_totalprice + 1) * 100)::BIGINT ELSE {_C} END)::BIGINT FROM orders WHERE o_orderkey % 100 <> 7""",
}
