"""Mathematical functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..errors import type_error
from ..plans.values import BOOL, DOUBLE, LONG, Val, is_float, need
from . import function


def _double(v: Val) -> F.Column:
    need(v, "a mathematical function", S.NumericType)
    return v.col.cast("double")


def _unary(name, f):
    @function(name)
    def run(v: Val) -> Val:
        return Val(f(_double(v)), DOUBLE)


for _name, _f in {
    "acos": F.acos, "asin": F.asin, "atan": F.atan, "cos": F.cos, "cosh": F.cosh, "sin": F.sin, "sinh": F.sinh, "tan": F.tan, "tanh": F.tanh, "cot": F.cot,
    "degrees": F.degrees, "radians": F.radians, "exp": F.exp, "sqrt": F.sqrt,
    "coth": lambda x: F.lit(1.0) / F.tanh(x),
    "haversin": lambda x: (F.lit(1.0) - F.cos(x)) / 2,
    "ceil": lambda x: F.ceil(x).cast("double"), "ceiling": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"),
}.items():
    _unary(_name, _f)


def _log(f):
    # the built-in gives null outside its domain; floating point gives -infinity and NaN
    return lambda x: F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(f(x))


for _name, _f in {"ln": F.log, "log": F.log, "log10": F.log10}.items():
    _unary(_name, _log(_f))


@function("abs")
def _abs(v: Val) -> Val:
    need(v, "abs", S.NumericType)
    return Val(F.abs(v.col), v.type)


@function("sign")
def _sign(v: Val) -> Val:
    return Val(F.signum(_double(v)).cast("long"), LONG)


@function("atan2")
def _atan2(y: Val, x: Val) -> Val:
    return Val(F.atan2(_double(y), _double(x)), DOUBLE)


@function("e")
def _e() -> Val:
    return Val(F.lit(math.e), DOUBLE)


@function("pi")
def _pi() -> Val:
    return Val(F.lit(math.pi), DOUBLE)


@function("rand")
def _rand() -> Val:
    return Val(F.rand(), DOUBLE)


@function("isnan")
def _isnan(v: Val) -> Val:
    need(v, "isNaN", S.NumericType)
    return Val(F.when(v.col.isNotNull(), F.isnan(v.col.cast("double"))), BOOL)


@function("round")
def _round(v: Val, places: Val | None = None, mode: Val | None = None) -> Val:
    x = _double(v)
    if places is None:
        return Val(F.floor(x + 0.5).cast("double"), DOUBLE)  # ties go up
    if mode is None:
        return Val(F.when(places.col == 0, F.floor(x + 0.5).cast("double")).otherwise(_half(x, places.col, "HALF_UP")), DOUBLE)
    which = F.upper(mode.col)
    out = F.lit(None).cast("double")
    for name in ("UP", "DOWN", "CEILING", "FLOOR", "HALF_UP", "HALF_DOWN", "HALF_EVEN"):
        out = F.when(which == name, _half(x, places.col, name)).otherwise(out)
    return Val(out, DOUBLE)


def _half(x, places, mode: str):
    unit = F.pow(F.lit(10.0), places.cast("double"))
    y = x * unit
    low = F.floor(y).cast("double")
    part = y - low
    away = F.signum(y) * F.ceil(F.abs(y))
    toward = F.signum(y) * F.floor(F.abs(y))
    near = F.when(F.abs(part - 0.5) > 1e-9, F.floor(y + 0.5))
    tie = {"HALF_UP": away, "HALF_DOWN": toward, "HALF_EVEN": F.when(low % 2 == 0, low).otherwise(low + 1)}
    return {"UP": away, "DOWN": toward, "CEILING": F.ceil(y).cast("double"), "FLOOR": low}.get(mode, F.coalesce(near.cast("double"), tie.get(mode, away))) / unit


def arithmetic(op: str, a: Val, b: Val) -> Val:
    """``+ - * / % ^`` of numbers: integers stay integers, division truncates, ``^`` is a float."""
    need(a, f"operator {op}", S.NumericType)
    need(b, f"operator {op}", S.NumericType)
    whole = not is_float(a.type) and not is_float(b.type)
    if op == "^":
        return Val(F.pow(a.col.cast("double"), b.col.cast("double")), DOUBLE)
    x, y = (a.col, b.col) if whole else (a.col.cast("double"), b.col.cast("double"))
    if whole:
        x, y = x.cast("long"), y.cast("long")
    if op == "/":
        if whole:
            return Val(_div(x, y), LONG)
        return Val(F.when(y == 0, F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).otherwise(F.signum(x) * F.lit(float("inf")))).otherwise(x / F.when(y != 0, y)), DOUBLE)
    if op == "%":
        return Val(x % y if whole else F.when(y == 0, F.lit(float("nan"))).otherwise(x % F.when(y != 0, y)), LONG if whole else DOUBLE)
    out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y}.get(op)
    if out is None:
        raise type_error(f"no operator {op}")
    return Val(out(), LONG if whole else DOUBLE)


def _div(x, y):
    return F.when(y == 0, F.raise_error(F.lit("TYPE_ERROR: division by zero")).cast("long")).otherwise(_truncated(x, y))


def _truncated(x, y):
    # (x - x % y) is a multiple of y, so the quotient is whole; decimals keep it exact beyond 2**53
    return ((x - x % F.when(y != 0, y)).cast("decimal(20,0)") / F.when(y != 0, y).cast("decimal(20,0)")).cast("long")
