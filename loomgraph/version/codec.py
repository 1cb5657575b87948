"""Property values as tagged text, and typed columns back from it.

Fixed values (tags): i integer, f float, s string, b boolean, d date, t local datetime,
z zoned datetime, L list (JSON), p any other value (JSON).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..errors import type_error
from ..functions.texts import as_text
from ..plans.values import DATE, DOUBLE, DURATION, LONG, NTZ, POINT, STRING, ZONED, BOOL, Val, is_float, is_list, is_map, is_node, is_number, is_path, is_rel

SIMPLE = {"i": LONG, "f": DOUBLE, "s": STRING, "b": BOOL, "d": DATE, "t": NTZ, "z": ZONED}
STRUCTS = {"duration": DURATION, "point": POINT}


def tag_of(t: S.DataType) -> str:
    if is_number(t):
        return "f" if is_float(t) else "i"
    for kind, tag in ((S.StringType, "s"), (S.BooleanType, "b"), (S.DateType, "d"), (S.TimestampNTZType, "t"), (S.TimestampType, "z")):
        if isinstance(t, kind):
            return tag
    if is_list(t):
        return f"L{tag_of(t.elementType)}" if not isinstance(t.elementType, S.NullType) else "Ls"
    for name, kind in STRUCTS.items():
        if t == kind:
            return f"p{name}"
    if isinstance(t, S.StructType) and t.names == ["time_nanos"]:
        return "plocaltime"
    raise type_error("maps, nodes, relationships and paths are no property values")


def encode(v: Val) -> Column:
    if isinstance(v.type, S.NullType):
        return F.lit(None).cast("string")
    if is_node(v.type) or is_rel(v.type) or is_path(v.type) or is_map(v.type):
        raise type_error("maps, nodes, relationships and paths are no property values")
    tag = tag_of(v.type)
    if tag[0] in "Lp":
        text = F.to_json(v.col)
    else:
        text = as_text(v)
    return F.when(v.col.isNotNull(), F.concat(F.lit(f"{tag}:"), text))


def decode(c: Column, tag: str) -> tuple[Column, S.DataType]:
    text = F.regexp_replace(c, "^[^:]*:", "")
    if tag in SIMPLE:
        if tag == "f":
            return text.try_cast("double"), DOUBLE
        kind = SIMPLE[tag]
        return (F.regexp_replace(text, "Z$", "").cast("timestamp") if tag == "z" else text.cast(kind) if tag != "s" else text), kind
    if tag[0] == "L":
        kind = S.ArrayType(SIMPLE.get(tag[1:], STRING))
        return F.from_json(text, kind), kind
    kind = STRUCTS.get(tag[1:], S.StructType([S.StructField("time_nanos", LONG)]))
    return F.from_json(text, kind), kind


def widest(tags: set[str]) -> str:
    if len(tags) == 1:
        return next(iter(tags))
    if tags <= {"i", "f"}:
        return "f"
    raise type_error(f"a property has values of the kinds {sorted(tags)}")
