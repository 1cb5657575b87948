"""LOAD CSV: all fields are strings, an empty field is the empty string, a missing one null.

Files are read by Spark's reader.  A record with fewer or more fields than the first one is
parsed again by itself, so that what is missing is told from what is empty, and a record
without headers is a list of just its fields.  ``file()`` is the file of a record, and
``linenumber()`` the line that it ends in; the latter is counted only where a query asks.
"""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..errors import GraphError
from ..plans.expressions import Expressions
from ..plans.values import LONG, STRING, Rows, Value, fresh

RAW = "_loom_raw"


def fields_of(sep: str):
    """The fields of single records."""

    @F.pandas_udf("array<string>")
    def run(raw: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else next(filter(None, csv.reader(io.StringIO(x, newline=""), delimiter=sep)), []) for x in raw])

    return run


def records(spark, path: str, sep: str, headers: bool, name: str, kind: S.DataType | None, numbered: bool) -> tuple[DataFrame, S.DataType]:
    """A record for each row, as ``name``, with ``name_file`` and, if asked for, ``name_line``."""
    reader = spark.read.option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).option("emptyValue", "").option("nullValue", "\0").option("mode", "PERMISSIVE")
    columns = reader.option("header", headers).csv(path).columns
    schema = S.StructType([*[S.StructField(c, STRING) for c in columns], S.StructField(RAW, STRING)])
    df = reader.schema(schema).option("header", headers).option("columnNameOfCorruptRecord", RAW).csv(path)
    ragged, whole = F.col("_ragged"), F.col(RAW).isNull()
    df = df.withColumn("_ragged", F.when(~whole, fields_of(sep)(F.col(RAW))))
    parts = [F.when(whole, F.coalesce(F.col(f"`{c}`"), F.lit(""))).otherwise(F.get(ragged, F.lit(i))) for i, c in enumerate(columns)]
    if not headers:
        value, kind = F.when(whole, F.array(*parts)).otherwise(ragged), S.ArrayType(STRING)
    elif isinstance(kind, S.MapType):
        value = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*parts))
    else:
        value, kind = F.struct(*[p.alias(c) for p, c in zip(parts, columns, strict=True)]), S.StructType([S.StructField(c, STRING) for c in columns])
    out = df.select(value.alias(name), F.input_file_name().alias(f"{name}_file"), F.monotonically_increasing_id().alias("_at"))
    if numbered:
        text = F.array_join(F.col(name) if isinstance(kind, S.ArrayType) else F.map_values(name) if isinstance(kind, S.MapType) else F.array(*[F.col(name)[c] for c in columns]), "")
        lines = (1 + F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")
        before = Window.partitionBy(f"{name}_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"{name}_line", F.sum(lines).over(before) + int(headers))
    return out.drop("_at"), kind


def load_csv(compiler, c, rows: Rows) -> Rows:
    from ..plans.query import constant

    if c.var in rows.scope:
        raise GraphError("SEMANTIC_ERROR", f"{c.var} is there already")
    name, spark = fresh("csv"), compiler.graph.spark
    numbered = compiler.numbered
    uri = constant(c.uri, compiler.params)
    if uri is not None:
        out, kind = records(spark, local(uri), c.sep, bool(c.headers), name, None, numbered)
        df = out if rows.unit else rows.df.crossJoin(out)
    else:
        # the files that the rows name, each read once and joined to its rows
        key, same = fresh("uri"), fresh("uri")
        given = rows.df.withColumn(key, Expressions(rows, compiler.params)(c.uri).col)
        found, kind = None, S.MapType(STRING, STRING) if c.headers else S.ArrayType(STRING)
        for (u,) in given.select(key).where(F.col(key).isNotNull()).distinct().collect():  # names of files
            one, _ = records(spark, local(u), c.sep, bool(c.headers), name, kind, numbered)
            one = one.withColumn(same, F.lit(u))
            found = one if found is None else found.unionByName(one)
        if found is None:
            found = spark.createDataFrame([], S.StructType([S.StructField(name, kind), S.StructField(f"{name}_file", STRING), S.StructField(f"{name}_line", LONG), S.StructField(same, STRING)]))
        df = given.join(found, F.col(key) == F.col(same)).drop(key, same)
    hidden = {"file()": Value(f"{name}_file", STRING)} | ({"linenumber()": Value(f"{name}_line", LONG)} if numbered else {})
    return rows.with_(df=df, scope={**rows.scope, c.var: Value(name, kind), **hidden}, unit=False)


def local(uri: str) -> str:
    return uri.removeprefix("file://") if uri.startswith("file:///") else uri
