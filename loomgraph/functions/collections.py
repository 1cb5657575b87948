"""List, map and structural functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..errors import type_error
from ..plans.values import BOOL, LONG, STRING, VOID, Val, common, family, is_list, is_map, is_node, is_path, is_rel, need, to
from . import function

LARGEST_RANGE = 2_000_000


def _list(v: Val, what: str) -> Val:
    if isinstance(v.type, S.NullType):
        return Val(F.lit(None).cast("array<void>"), S.ArrayType(VOID))
    need(v, what, S.ArrayType)
    return v


def _at(v: Val, i) -> Val:
    return Val(F.get(v.col, i), v.type.elementType)


@function("head")
def _head(v: Val) -> Val:
    return _at(_list(v, "head"), F.lit(0))


@function("last")
def _last(v: Val) -> Val:
    v = _list(v, "last")
    return Val(F.try_element_at(v.col, F.lit(-1)), v.type.elementType)


@function("tail")
def _tail(v: Val) -> Val:
    v = _list(v, "tail")
    return Val(F.slice(v.col, 2, F.greatest(F.size(v.col) - 1, F.lit(0))), v.type)


@function("size", "cardinality")
def _size(v: Val) -> Val:
    if isinstance(v.type, S.StringType):
        return Val(F.char_length(v.col).cast("long"), LONG)
    if is_path(v.type):
        return Val(F.when(v.col.isNotNull(), F.size(v.col["_rels"]).cast("long")), LONG)
    if isinstance(v.type, S.NullType):
        return Val(F.lit(None).cast("long"), LONG)
    if is_map(v.type) and isinstance(v.type, S.StructType):
        return Val(F.size(_keys(v).col).cast("long"), LONG)
    need(v, "size", S.ArrayType, S.MapType)
    return Val(F.when(v.col.isNotNull(), F.size(v.col).cast("long")), LONG)


@function("isempty")
def _is_empty(v: Val) -> Val:
    return Val(_size(v).col == 0, BOOL)


@function("length", "path_length")
def _length(v: Val) -> Val:
    if not is_path(v.type) and not isinstance(v.type, S.NullType):
        raise type_error(f"length does not take {family(v.type)}")
    return _size(v)


@function("reverse")
def _reverse(v: Val) -> Val:
    need(v, "reverse", S.ArrayType, S.StringType)
    return Val(F.reverse(v.col), v.type)


@function("range")
def _range(a: Val, b: Val, step: Val | None = None) -> Val:
    s = step.col.cast("long") if step is not None else F.lit(1).cast("long")
    lo, hi = a.col.cast("long"), b.col.cast("long")
    none = F.array().cast("array<bigint>")
    bad = F.raise_error(F.lit("INVALID_ARGUMENT: a range needs a step that is not 0")).cast("array<bigint>")
    many = F.raise_error(F.lit("RESOURCE_LIMIT: a range is too long")).cast("array<bigint>")
    backward = ((s > 0) & (lo > hi)) | ((s < 0) & (lo < hi))
    end = F.when(backward, lo).otherwise(hi)
    return Val(F.when(s == 0, bad).when(backward, none).when(F.abs((hi - lo) / s) > LARGEST_RANGE, many).otherwise(F.sequence(lo, end, F.when((s == 0) | backward, F.lit(1).cast("long")).otherwise(s))), S.ArrayType(LONG))


@function("coll.distinct")
def _distinct(v: Val) -> Val:
    return Val(F.array_distinct(_list(v, "coll.distinct").col), v.type)


@function("coll.flatten")
def _flatten(v: Val, depth: Val | None = None) -> Val:
    v = _list(v, "coll.flatten")
    # the depth is a constant in practice; one level for each that the type has
    n = 1 if depth is None else 99
    while n and is_list(v.type.elementType):
        v = Val(F.flatten(v.col), v.type.elementType)
        n -= 1
    return v


@function("coll.indexof")
def _index_of(v: Val, x: Val) -> Val:
    v = _list(v, "coll.indexOf")
    return Val((F.array_position(v.col, to(x, v.type.elementType)) - 1).cast("long"), LONG)


@function("coll.insert")
def _insert(v: Val, i: Val, x: Val) -> Val:
    v = _list(v, "coll.insert")
    kind = common([v.type.elementType, x.type])
    bad = F.raise_error(F.lit("INVALID_ARGUMENT: an index is out of range")).cast("int")
    at = F.when((i.col < 0) | (i.col > F.size(v.col)), bad).otherwise((i.col + 1).cast("int"))
    return Val(F.array_insert(to(v, S.ArrayType(kind)), at, to(x, kind)), S.ArrayType(kind))


@function("coll.remove")
def _remove(v: Val, i: Val) -> Val:
    v = _list(v, "coll.remove")
    bad = F.raise_error(F.lit("INVALID_ARGUMENT: an index is out of range")).cast("int")
    at = F.when((i.col < 0) | (i.col >= F.size(v.col)), bad).otherwise(i.col.cast("int"))
    return Val(F.concat(F.slice(v.col, F.lit(1), at), F.slice(v.col, at + 2, F.greatest(F.size(v.col) - at - 1, F.lit(0)))), v.type)


@function("coll.max")
def _max(v: Val) -> Val:
    v = _list(v, "coll.max")
    return Val(F.array_max(v.col), v.type.elementType)


@function("coll.min")
def _min(v: Val) -> Val:
    v = _list(v, "coll.min")
    return Val(F.array_min(v.col), v.type.elementType)


@function("coll.sort")
def _sort(v: Val) -> Val:
    v = _list(v, "coll.sort")
    return Val(F.array_sort(v.col), v.type)


HIDDEN = ("_id", "_labels", "_type", "_src", "_dst")


@function("keys")
def _keys(v: Val) -> Val:
    if isinstance(v.type, S.MapType):
        return Val(F.map_keys(v.col), S.ArrayType(STRING))
    need(v, "keys", S.StructType)
    element = is_node(v.type) or is_rel(v.type)
    names = [F.when(v.col[f.name].isNotNull(), F.lit(f.name)) if element else F.lit(f.name) for f in v.type if not (element and f.name in HIDDEN)]
    return Val(F.when(v.col.isNotNull(), F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")), S.ArrayType(STRING))


@function("properties")
def _properties(v: Val) -> Val:
    if isinstance(v.type, S.MapType) or isinstance(v.type, S.NullType):
        return v
    fields = [f for f in v.type if f.name not in HIDDEN] if is_node(v.type) or is_rel(v.type) else list(v.type)
    return Val(F.when(v.col.isNotNull(), F.struct(*[v.col[f.name].alias(f.name) for f in fields])), S.StructType(fields))


@function("labels")
def _labels(v: Val) -> Val:
    if not is_node(v.type):
        raise type_error("labels takes a node")
    return Val(v.col["_labels"], S.ArrayType(STRING))


@function("type")
def _type(v: Val) -> Val:
    if not is_rel(v.type):
        raise type_error("type takes a relationship")
    return Val(v.col["_type"], STRING)


@function("id")
def _id(v: Val) -> Val:
    if not (is_node(v.type) or is_rel(v.type)):
        raise type_error("id takes a node or relationship")
    return Val(v.col["_id"], LONG)


@function("elementid")
def _element_id(v: Val) -> Val:
    return Val(F.concat(F.lit("n:" if is_node(v.type) else "r:"), _id(v).col.cast("string")), STRING)


@function("startnode")
def _start(v: Val) -> Val:
    return Val(F.when(v.col.isNotNull(), F.struct(v.col["_src"].alias("_id"), F.lit(None).cast("array<string>").alias("_labels"))), S.StructType([S.StructField("_id", LONG), S.StructField("_labels", S.ArrayType(STRING))]))


@function("endnode")
def _end(v: Val) -> Val:
    return Val(F.when(v.col.isNotNull(), F.struct(v.col["_dst"].alias("_id"), F.lit(None).cast("array<string>").alias("_labels"))), S.StructType([S.StructField("_id", LONG), S.StructField("_labels", S.ArrayType(STRING))]))


@function("db.namefromelementid")
def _name_from(v: Val) -> Val:
    return Val(F.when(v.col.rlike("^[nr]:-?[0-9]+$"), F.lit("graph")).otherwise(F.raise_error(F.lit("INVALID_ARGUMENT: not an element id")).cast("string")), STRING)


@function("nodes")
def _nodes(v: Val) -> Val:
    if not is_path(v.type):
        raise type_error("nodes takes a path")
    return Val(v.col["_nodes"], v.type["_nodes"].dataType)


@function("relationships")
def _relationships(v: Val) -> Val:
    if not is_path(v.type):
        raise type_error("relationships takes a path")
    return Val(v.col["_rels"], v.type["_rels"].dataType)


@function("coalesce")
def _coalesce(*vs: Val) -> Val:
    kind = common([v.type for v in vs])
    return Val(F.coalesce(*[to(v, kind) for v in vs]), kind)


@function("nullif")
def _nullif(a: Val, b: Val) -> Val:
    kind = common([a.type, b.type])
    return Val(F.nullif(to(a, kind), to(b, kind)), kind)


@function("property_exists")
def _exists(v: Val, key: Val) -> Val:
    raise type_error("property_exists takes a variable")
