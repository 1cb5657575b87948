"""Typed columns and what variables are bound to."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..errors import GraphError, type_error

LONG, DOUBLE, STRING, BOOL, VOID, DATE, NTZ, ZONED = S.LongType(), S.DoubleType(), S.StringType(), S.BooleanType(), S.NullType(), S.DateType(), S.TimestampNTZType(), S.TimestampType()
DURATION = S.StructType([S.StructField(c, LONG) for c in ("months", "days", "seconds", "nanos")])
LOCAL_TIME = S.StructType([S.StructField("time_nanos", LONG)])
ZONED_TIME = S.StructType([S.StructField("time_nanos", LONG), S.StructField("offset_seconds", LONG)])
POINT = S.StructType([S.StructField("srid", LONG), S.StructField("coords", S.ArrayType(DOUBLE))])
_fresh = itertools.count()


def fresh(hint: str = "c") -> str:
    return f"_{hint}{next(_fresh)}"


@dataclass
class Val:
    col: Column
    type: S.DataType

    def cast(self, kind: S.DataType) -> "Val":
        return self if self.type == kind else Val(self.col.cast(kind), kind)


@dataclass
class Element:
    """A node or relationship whose parts are columns of the rows."""

    kind: str  # node, rel
    id: str
    meta: dict[str, str]  # labels, or type, src and dst -> column
    props: dict[str, tuple[str, S.DataType]] = field(default_factory=dict)
    known: frozenset[str] = frozenset()  # labels that a node surely has

    def columns(self) -> list[str]:
        return [self.id, *self.meta.values(), *[c for c, _ in self.props.values()]]

    def struct(self) -> Val:
        fields = [S.StructField("_id", LONG)]
        cols = [F.col(self.id).alias("_id")]
        if self.kind == "node":
            fields.append(S.StructField("_labels", S.ArrayType(STRING)))
            cols.append((F.col(self.meta["labels"]) if "labels" in self.meta else F.lit(None).cast("array<string>")).alias("_labels"))
        else:
            for name, kind in (("type", STRING), ("src", LONG), ("dst", LONG)):
                fields.append(S.StructField(f"_{name}", kind))
                cols.append(F.col(self.meta[name]).alias(f"_{name}"))
        for p, (c, t) in sorted(self.props.items()):
            fields.append(S.StructField(p, t))
            cols.append(F.col(c).alias(p))
        return Val(F.when(F.col(self.id).isNotNull(), F.struct(*cols)), S.StructType(fields))


@dataclass
class Value:
    """A variable that is one column."""

    name: str
    type: S.DataType

    def columns(self) -> list[str]:
        return [self.name]


Binding = Element | Value


@dataclass
class Rows:
    df: DataFrame
    scope: dict[str, Binding] = field(default_factory=dict)
    unit: bool = False
    order: list[tuple[str, bool]] = field(default_factory=list)

    def with_(self, **changes) -> "Rows":
        return Rows(**({"df": self.df, "scope": dict(self.scope), "unit": self.unit, "order": list(self.order)} | changes))


def is_node(t: S.DataType) -> bool:
    return isinstance(t, S.StructType) and "_labels" in t.names


def is_rel(t: S.DataType) -> bool:
    return isinstance(t, S.StructType) and "_type" in t.names


def is_path(t: S.DataType) -> bool:
    return isinstance(t, S.StructType) and t.names[:2] == ["_nodes", "_rels"]


def is_number(t: S.DataType) -> bool:
    return isinstance(t, S.NumericType)


def is_float(t: S.DataType) -> bool:
    return isinstance(t, (S.DoubleType, S.FloatType))


def is_list(t: S.DataType) -> bool:
    return isinstance(t, S.ArrayType)


def is_map(t: S.DataType) -> bool:
    return isinstance(t, S.StructType) and not is_node(t) and not is_rel(t) and not is_path(t) and t not in (DURATION, LOCAL_TIME, ZONED_TIME, POINT) or isinstance(t, S.MapType)


def family(t: S.DataType) -> str:
    """The value family that decides which values compare."""
    if isinstance(t, S.NullType):
        return "NULL"
    if is_number(t):
        return "NUMBER"
    for kind, name in ((S.StringType, "STRING"), (S.BooleanType, "BOOLEAN"), (S.DateType, "DATE"), (S.TimestampNTZType, "LOCAL DATETIME"), (S.TimestampType, "ZONED DATETIME"), (S.ArrayType, "LIST")):
        if isinstance(t, kind):
            return name
    if is_node(t):
        return "NODE"
    if is_rel(t):
        return "RELATIONSHIP"
    if is_path(t):
        return "PATH"
    return {id(DURATION): "DURATION"}.get(id(t)) or ("DURATION" if t == DURATION else "LOCAL TIME" if t == LOCAL_TIME else "ZONED TIME" if t == ZONED_TIME else "POINT" if t == POINT else "MAP")


def common(types: list[S.DataType]) -> S.DataType:
    """The type that holds all of these values."""
    out: S.DataType = VOID
    for t in types:
        if isinstance(out, S.NullType) or out == t:
            out = t
        elif isinstance(t, S.NullType):
            pass
        elif is_number(out) and is_number(t):
            out = DOUBLE if is_float(out) or is_float(t) else LONG
        elif is_list(out) and is_list(t):
            out = S.ArrayType(common([out.elementType, t.elementType]))
        elif isinstance(out, S.StructType) and isinstance(t, S.StructType) and is_map(out) == is_map(t):
            kinds: dict[str, S.DataType] = {}
            for f in [*out.fields, *t.fields]:
                kinds[f.name] = common([kinds[f.name], f.dataType]) if f.name in kinds else f.dataType
            out = S.StructType([S.StructField(k, v) for k, v in kinds.items()])
        else:
            raise GraphError("UNSUPPORTED", f"values of {family(out)} and {family(t)} in one column")
    return out


def to(v: Val, kind: S.DataType) -> Column:
    """``v`` as a column of ``kind``; structs are matched by field name."""
    if v.type == kind:
        return v.col
    if isinstance(v.type, S.StructType) and isinstance(kind, S.StructType):
        have = {f.name: f.dataType for f in v.type}
        fields = [to(Val(v.col.getField(f.name), have[f.name]), f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in kind]
        return F.when(v.col.isNotNull(), F.struct(*fields))
    if is_list(v.type) and is_list(kind) and isinstance(v.type.elementType, S.StructType):
        return F.transform(v.col, lambda x: to(Val(x, v.type.elementType), kind.elementType))
    return v.col.cast(kind)


def need(v: Val, what: str, *kinds) -> None:
    if not isinstance(v.type, (S.NullType, *kinds)):
        raise type_error(f"{what} does not take {family(v.type)}")


def literal(x) -> Val:
    """A Python value as a typed column."""
    import datetime
    from uuid import UUID

    if isinstance(x, Val):
        return x
    if x is None:
        return Val(F.lit(None), VOID)
    if isinstance(x, bool):
        return Val(F.lit(x), BOOL)
    if isinstance(x, int):
        return Val(F.lit(x).cast("long"), LONG)
    if isinstance(x, float):
        return Val(F.lit(x), DOUBLE)
    if isinstance(x, (str, UUID)):
        return Val(F.lit(str(x)), STRING)
    if isinstance(x, datetime.datetime):
        return Val(F.lit(x), ZONED) if x.tzinfo else Val(F.lit(x.isoformat()).cast("timestamp_ntz"), NTZ)
    if isinstance(x, datetime.date):
        return Val(F.lit(x), DATE)
    if isinstance(x, dict):
        items = {k: literal(v) for k, v in x.items()}
        return Val(F.struct(*[v.col.alias(k) for k, v in items.items()]), S.StructType([S.StructField(k, v.type) for k, v in items.items()]))
    if isinstance(x, (list, tuple)):
        return make_list([literal(v) for v in x])
    raise GraphError("INVALID_ARGUMENT", f"no Cypher value for {type(x).__name__}")


def make_list(items: list[Val]) -> Val:
    kind = common([v.type for v in items]) if items else VOID
    if not items:
        return Val(F.array(), S.ArrayType(VOID))
    return Val(F.array(*[to(v, kind) for v in items]), S.ArrayType(kind))
