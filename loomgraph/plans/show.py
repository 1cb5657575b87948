"""SHOW commands: catalog rows as rows of a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cypher.tree import Tree as T
from ..functions import load
from .expressions import AGGREGATES
from .values import Rows, Value, fresh


def show(compiler, c: T, rows: Rows) -> Rows:
    spark, g = compiler.graph.spark, compiler.graph
    words = set(c.words)
    if words & {"INDEX", "INDEXES"}:
        kinds = words & {"LOOKUP", "RANGE", "TEXT", "POINT", "FULLTEXT", "VECTOR"}
        data = [(x["name"], x["type"], x.get("entity", "NODE"), list(x["labels"]), list(x["properties"])) for x in g.indexes.values() if not kinds or x["type"] in kinds]
        df = spark.createDataFrame(sorted(data), "name string, type string, entityType string, labelsOrTypes array<string>, properties array<string>")
    elif words & {"CONSTRAINT", "CONSTRAINTS"}:
        data = [(x["name"], x["type"], x.get("entity", "NODE"), list(x["labels"]), list(x["properties"]), x.get("type_text")) for x in g.constraints.values()]
        want = {"UNIQUE": "UNIQUE", "UNIQUENESS": "UNIQUE", "KEY": "KEY", "EXIST": "NOT NULL", "EXISTENCE": "NOT NULL"}
        kinds = {want[w] for w in words if w in want} | ({"TYPE"} if "TYPE" in words else set())
        data = [d for d in data if not kinds or d[1] in kinds]
        df = spark.createDataFrame(sorted(data, key=lambda d: d[0]), "name string, type string, entityType string, labelsOrTypes array<string>, properties array<string>, propertyType string")
    elif words & {"FUNCTION", "FUNCTIONS"}:
        data = [(n, n in AGGREGATES) for n in sorted({*load(), *AGGREGATES, "all", "any", "none", "single", "reduce", "allreduce", "exists"})]
        df = spark.createDataFrame(data, "name string, aggregating boolean")
    elif words & {"PROCEDURE", "PROCEDURES"}:
        df = spark.createDataFrame([(n,) for n in sorted(compiler.procedures)] or [], "name string")
    else:
        import json

        df = spark.createDataFrame([(json.dumps(g.graph_type, sort_keys=True),)], "specification string")
    scope = {}
    cols = []
    for f in df.schema:
        name = fresh("show")
        scope[f.name] = Value(name, f.dataType)
        cols.append(F.col(f.name).alias(name))
    out = Rows(df.select(*cols), scope)
    if c.items is not None:
        out = compiler.do_with(c.items, out)
    if c.where is not None:
        out = compiler.where(out, c.where)
    return out


