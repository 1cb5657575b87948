"""Vectors are lists of numbers; similarity and distance stay in generated code."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..errors import invalid
from ..plans.values import DOUBLE, LONG, Val, is_number, need
from . import function


def _v(v: Val):
    need(v, "a vector function", S.ArrayType)
    return v.col.cast("array<double>")


def _sum(a):
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a, b):
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a, b):
    """Within -1 and 1; one root of the product rounds as in the SQL engines, so that scaled copies rank alike."""

    def of(t):
        squares = t["a"] * t["b"]
        one = (squares > 1e-280) & (squares < 1e300)  # else the product has too few bits, or none
        c = t["d"] / F.when(one, F.sqrt(squares)).otherwise(F.sqrt(t["a"]) * F.sqrt(t["b"]))
        return F.when((c > 1) & (c < 2), F.lit(1.0)).when(c < -1, F.lit(-1.0)).otherwise(c)  # NaN is above all

    # an array of one, so that each sum is taken once
    return F.transform(F.array(F.struct(dot(a, b).alias("d"), dot(a, a).alias("a"), dot(b, b).alias("b"))), of)[0]


def squared(a, b):
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def closeness(kind: str, a, b):
    """What ranks like the score of a similarity: the cosine, of which the score loses the last bits."""
    return cosine(a, b) if kind == "cosine" else F.lit(1.0) / (squared(a, b) + 1)


def scored(kind: str, near):
    return (near + 1) / 2 if kind == "cosine" else near


def similarity(kind: str, a, b):
    return scored(kind, closeness(kind, a, b))


@function("vector.similarity.cosine")
def _cosine(a: Val, b: Val) -> Val:
    return Val(similarity("cosine", _v(a), _v(b)), DOUBLE)


@function("vector.similarity.euclidean")
def _euclidean(a: Val, b: Val) -> Val:
    return Val(similarity("euclidean", _v(a), _v(b)), DOUBLE)


@function("vector_dimension_count")
def _count(v: Val) -> Val:
    return Val(F.size(_v(v)).cast("long"), LONG)


def distance(a: Val, b: Val, metric: str) -> Val:
    x, y = _v(a), _v(b)
    zero = F.raise_error(F.lit("INVALID_ARGUMENT: a vector of norm 0 has no cosine")).cast("double")
    out = {
        "EUCLIDEAN": lambda: F.sqrt(squared(x, y)),
        "EUCLIDEAN_SQUARED": lambda: squared(x, y),
        "MANHATTAN": lambda: _sum(F.zip_with(x, y, lambda p, q: F.abs(p - q))),
        "COSINE": lambda: F.when((dot(x, x) == 0) | (dot(y, y) == 0), zero).otherwise(F.lit(1.0) - cosine(x, y)),
        "DOT": lambda: -dot(x, y),
        "HAMMING": lambda: _sum(F.zip_with(x, y, lambda p, q: (p != q).cast("double"))),
    }.get(metric)
    if out is None:
        raise invalid(f"no vector distance {metric}")
    return Val(out(), DOUBLE)


def norm(a: Val, metric: str) -> Val:
    x = _v(a)
    if metric == "EUCLIDEAN":
        return Val(F.sqrt(dot(x, x)), DOUBLE)
    if metric == "MANHATTAN":
        return Val(_sum(F.transform(x, F.abs)), DOUBLE)
    raise invalid(f"no vector norm {metric}")


#: Coordinate types and the column types that hold them.
COORDINATES = {"INTEGER8": "tinyint", "INTEGER16": "smallint", "INTEGER32": "int", "INTEGER64": "bigint", "INTEGER": "bigint", "SIGNED INTEGER": "bigint", "FLOAT32": "float", "FLOAT64": "double", "FLOAT": "double"}


def make(v: Val, dimension: Val, coordinate: str = "FLOAT64") -> Val:
    coordinate = coordinate.removesuffix(" NOT NULL")
    if coordinate not in COORDINATES:
        raise invalid(f"no coordinate type {coordinate}")
    col = v.col
    if isinstance(v.type, S.StringType):
        col = F.from_json(v.col, "array<double>")
    elif not (isinstance(v.type, S.ArrayType) and (is_number(v.type.elementType) or isinstance(v.type.elementType, S.NullType))):
        need(v, "vector", S.ArrayType)
    narrow = F.transform(col, lambda x: x.cast(COORDINATES[coordinate]))
    wide = "array<double>" if coordinate.startswith("FLOAT") else "array<bigint>"
    sound = F.size(col) == dimension.col
    bad = F.raise_error(F.lit("INVALID_ARGUMENT: the vector has another dimension")).cast(wide)
    return Val(F.when(v.col.isNull() | dimension.col.isNull(), F.lit(None)).when(sound, narrow.cast(wide)).otherwise(bad), S.ArrayType(DOUBLE if coordinate.startswith("FLOAT") else LONG))
