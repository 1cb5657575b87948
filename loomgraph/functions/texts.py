"""String, conversion and UUID functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..errors import invalid, type_error
from ..plans.values import BOOL, DOUBLE, DURATION, LONG, POINT, STRING, Val, family, is_float, is_list, is_node, is_number, is_path, is_rel, need
from . import function

SPACES = "^[\\s\\u00a0\\u0085\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def _text(v: Val, what: str):
    need(v, what, S.StringType)
    return v.col.cast("string")


def quoted(s):
    """A column as a literal in a regular expression."""
    return F.concat(F.lit("\\Q"), F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _trim(v: Val, chars: Val | None, left: bool, right: bool) -> Val:
    s = _text(v, "trim")
    if chars is not None:
        c = _text(chars, "trim")
        return Val(F.btrim(s, c) if left and right else F.ltrim(s, c) if left else F.rtrim(s, c), STRING)
    if left:
        s = F.regexp_replace(s, SPACES, "")
    if right:
        s = F.regexp_replace(s, SPACES[1:] + "$", "")
    return Val(s, STRING)


@function("btrim", "trim")
def _btrim(v: Val, chars: Val | None = None) -> Val:
    return _trim(v, chars, True, True)


@function("ltrim")
def _ltrim(v: Val, chars: Val | None = None) -> Val:
    return _trim(v, chars, True, False)


@function("rtrim")
def _rtrim(v: Val, chars: Val | None = None) -> Val:
    return _trim(v, chars, False, True)


def _whole(n: Val, what: str):
    need(n, what, S.NumericType)
    return F.when(n.col < 0, F.raise_error(F.lit(f"INVALID_ARGUMENT: {what} needs a length of 0 or more")).cast("long")).otherwise(n.col)


@function("left")
def _left(v: Val, n: Val) -> Val:
    return Val(F.substring(_text(v, "left"), F.lit(1), _whole(n, "left").cast("int")), STRING)


@function("right")
def _right(v: Val, n: Val) -> Val:
    s, k = _text(v, "right"), _whole(n, "right")
    return Val(F.when(k >= F.char_length(s), s).otherwise(F.substring(s, (F.char_length(s) - k + 1).cast("int"), k.cast("int"))), STRING)


@function("lower", "tolower")
def _lower(v: Val) -> Val:
    return Val(F.lower(_text(v, "toLower")), STRING)


@function("upper", "toupper")
def _upper(v: Val) -> Val:
    return Val(F.upper(_text(v, "toUpper")), STRING)


def normalized(text: F.Column, form: F.Column) -> F.Column:
    """Unicode normalisation has no built-in; Arrow batches."""

    def run(s: pd.Series, form: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else unicodedata.normalize(f, x) for x, f in zip(s, form, strict=True)])

    return F.pandas_udf(run, "string")(text, form)


@function("normalize")
def _normalize(v: Val, form: Val | None = None) -> Val:
    return Val(normalized(_text(v, "normalize"), form.col if form is not None else F.lit("NFC")), STRING)


@function("replace")
def _replace(v: Val, find: Val, new: Val, limit: Val | None = None) -> Val:
    s, a, b = _text(v, "replace"), _text(find, "replace"), _text(new, "replace")
    between = F.concat(b, F.call_function("array_join", F.split(s, ""), b), F.when(F.char_length(s) > 0, b).otherwise(F.lit("")))
    if limit is None:
        return Val(F.when(a == "", between).otherwise(F.replace(s, a, b)), STRING)
    parts = F.split(s, quoted(a), (limit.col + 1).cast("int"))
    return Val(F.when((limit.col <= 0) | (a == ""), s).otherwise(F.call_function("array_join", parts, b)), STRING)


@function("split")
def _split(v: Val, by: Val) -> Val:
    s = _text(v, "split")
    if is_list(by.type):
        pattern = F.array_join(F.transform(by.col, quoted), "|")
        return Val(F.split(s, pattern, -1), S.ArrayType(STRING))
    d = _text(by, "split")
    return Val(F.when(d == "", F.split(s, "")).otherwise(F.split(s, quoted(d), -1)), S.ArrayType(STRING))


@function("string.indexof")
def _index_of(v: Val, x: Val) -> Val:
    return Val((F.instr(_text(v, "indexOf"), _text(x, "indexOf")) - 1).cast("long"), LONG)


@function("string.join")
def _join(v: Val, by: Val) -> Val:
    return Val(F.when(by.col.isNotNull(), F.call_function("array_join", v.col, F.coalesce(by.col, F.lit("")))), STRING)


@function("string.regexreplace")
def _regex_replace(v: Val, pattern: Val, new: Val) -> Val:
    # ${1} and $$ of the replacement are $1 and \$ here
    to_java = F.regexp_replace(F.regexp_replace(_text(new, "regexReplace"), r"\$\$", r"\\\\\$"), r"\$\{(\w+)\}", r"\$$1")
    return Val(F.regexp_replace(_text(v, "regexReplace"), _text(pattern, "regexReplace"), to_java), STRING)


@function("substring")
def _substring(v: Val, start: Val, n: Val | None = None) -> Val:
    s = _text(v, "substring")
    at = (_whole(start, "substring") + 1).cast("int")
    return Val(F.substring(s, at, F.char_length(s) if n is None else _whole(n, "substring").cast("int")), STRING)


@function("char_length", "character_length")
def _length(v: Val) -> Val:
    return Val(F.char_length(_text(v, "char_length")).cast("long"), LONG)


# conversion


def _bool(v: Val, strict: bool) -> F.Column:
    if isinstance(v.type, (S.NullType, S.BooleanType)):
        return v.col.cast("boolean")
    if isinstance(v.type, S.StringType):
        return F.when(F.lower(v.col) == "true", True).when(F.lower(v.col) == "false", False)
    if is_number(v.type) and not is_float(v.type):
        return v.col != 0
    if strict:
        raise type_error(f"toBoolean does not take {family(v.type)}")
    return F.lit(None).cast("boolean")


def _int(v: Val, strict: bool) -> F.Column:
    if isinstance(v.type, (S.NullType, S.BooleanType)):
        return v.col.cast("boolean").cast("long")
    if isinstance(v.type, S.StringType):
        s = F.trim(v.col)
        return F.coalesce(s.try_cast("long"), _trunc(s.try_cast("double")))
    if is_float(v.type):
        return _trunc(v.col)
    if is_number(v.type):
        return v.col.cast("long")
    if strict:
        raise type_error(f"toInteger does not take {family(v.type)}")
    return F.lit(None).cast("long")


def _trunc(x):
    ok = ~F.isnan(x) & (F.abs(x) < F.lit(9.2e18))
    return F.when(ok, F.when(ok, x).cast("long"))


def _float(v: Val, strict: bool) -> F.Column:
    if isinstance(v.type, (S.NullType, S.NumericType)):
        return v.col.cast("double")
    if isinstance(v.type, S.StringType):
        return F.trim(v.col).try_cast("double")
    if strict:
        raise type_error(f"toFloat does not take {family(v.type)}")
    return F.lit(None).cast("double")


def as_text(v: Val) -> F.Column:
    """A value as Cypher writes it."""
    from .temporal import duration_text, time_text

    if is_float(v.type):
        return v.col.cast("double").cast("string")
    if v.type == DURATION:
        return duration_text(v.col)
    if family(v.type) in ("LOCAL TIME", "ZONED TIME"):
        return time_text(v)
    if isinstance(v.type, (S.TimestampNTZType, S.TimestampType)):
        pattern = "yyyy-MM-dd'T'HH:mm:ss"
        frac = F.rtrim(F.date_format(v.col, "SSSSSS"), F.lit("0"))
        return F.concat(F.date_format(v.col, pattern), F.when(frac != "", F.concat(F.lit("."), frac)).otherwise(F.lit("")), F.lit("Z" if isinstance(v.type, S.TimestampType) else ""))
    if v.type == POINT:
        c = v.col["coords"]
        names = ["x", "y", "z"]
        parts = [F.concat(F.lit(f"{n}: "), F.get(c, F.lit(i)).cast("string")) for i, n in enumerate(names)]
        return F.concat(F.lit("point({srid:"), v.col["srid"].cast("string"), F.lit(", "), F.concat_ws(", ", *parts), F.lit("})"))
    if is_list(v.type):
        inner = F.transform(v.col, lambda x: F.coalesce(as_text(Val(x, v.type.elementType)), F.lit("null")))
        return F.when(v.col.isNotNull(), F.concat(F.lit("["), F.array_join(inner, ", "), F.lit("]")))
    if isinstance(v.type, S.StructType):
        return F.to_json(v.col)
    return v.col.cast("string")


_CONVERT = {"toboolean": (_bool, BOOL), "tointeger": (_int, LONG), "tofloat": (_float, DOUBLE), "tostring": (lambda v, strict: as_text(v), STRING)}


def _register(name: str, f, kind: S.DataType) -> None:
    @function(name)
    def strict(v: Val) -> Val:
        return Val(f(v, True), kind)

    @function(f"{name}ornull")
    def lax(v: Val) -> Val:
        if name == "tostring" and (is_node(v.type) or is_rel(v.type) or is_path(v.type) or is_list(v.type)):
            return Val(F.lit(None).cast("string"), STRING)
        return Val(f(v, False), kind)

    @function(f"{name}list")
    def each(v: Val) -> Val:
        if isinstance(v.type, S.NullType):
            return Val(F.lit(None).cast(S.ArrayType(kind)), S.ArrayType(kind))
        need(v, f"{name}List", S.ArrayType)
        return Val(F.transform(v.col, lambda x: f(Val(x, v.type.elementType), False)), S.ArrayType(kind))


for _name, (_f, _kind) in _CONVERT.items():
    _register(_name, _f, _kind)


def type_name(t: S.DataType) -> str:
    names = {"NUMBER": "FLOAT" if is_float(t) else "INTEGER"}
    f = family(t)
    if f == "LIST":
        return f"LIST<{type_name(t.elementType)}>"
    return names.get(f, f)


@function("valuetype")
def _value_type(v: Val) -> Val:
    name = type_name(v.type)
    return Val(F.when(v.col.isNull(), F.lit("NULL")).otherwise(F.lit(name if name == "NULL" else f"{name} NOT NULL")), STRING)


def has_type(v: Val, text: str) -> F.Column:
    """``v IS :: type``."""
    alternatives = [x.strip() for x in text.split("|")]
    out = F.lit(False)
    for x in alternatives:
        required = x.endswith("NOT NULL") or x.endswith("!")
        x = x.removesuffix("NOT NULL").removesuffix("!").strip()
        if x in ("NOTHING",):
            test = F.lit(False)
        elif x in ("NULL",):
            test = v.col.isNull()
            required = False
        elif _matches(v.type, x):
            test = v.col.isNotNull() if required else F.lit(True)
        else:
            test = F.lit(False) if required else v.col.isNull()
        out = out | test
    return out


#: Other spellings of type names.
SPELLINGS = {
    "BOOL": "BOOLEAN", "INT": "INTEGER", "SIGNED INTEGER": "INTEGER", "INTEGER64": "INTEGER", "FLOAT64": "FLOAT", "VARCHAR": "STRING", "TIMESTAMP WITHOUT TIMEZONE": "LOCAL DATETIME",
    "TIMESTAMP WITH TIMEZONE": "ZONED DATETIME", "TIME WITHOUT TIMEZONE": "LOCAL TIME", "TIME WITH TIMEZONE": "ZONED TIME", "VERTEX": "NODE", "EDGE": "RELATIONSHIP",
}


def _matches(t: S.DataType, name: str) -> bool:
    name = SPELLINGS.get(name, name)
    if isinstance(t, S.NullType):
        return True
    if name in ("ANY", "ANY VALUE", "VALUE"):
        return True
    if name in ("PROPERTY VALUE", "ANY PROPERTY VALUE"):
        return family(t) not in ("NODE", "RELATIONSHIP", "PATH", "MAP")
    if name in ("LIST", "ARRAY"):
        return is_list(t)
    if name.startswith(("LIST<", "ARRAY<")):
        inner = name[name.index("<") + 1 : -1].strip().removesuffix("NOT NULL").strip()
        return is_list(t) and _matches(t.elementType, inner)
    return type_name(t) == name


# uuid


@function("randomuuid")
def _random_uuid() -> Val:
    return Val(F.uuid(), STRING)


@function("uuid")
def _uuid(a: Val | None = None, b: Val | None = None) -> Val:
    if a is None:
        return Val(F.uuid(), STRING)
    if b is not None:
        h = F.lower(F.concat(F.lpad(F.hex(a.col), 16, "0"), F.lpad(F.hex(b.col), 16, "0")))
    else:
        h = F.lower(F.replace(_text(a, "uuid"), F.lit("-"), F.lit("")))
        h = F.when(h.rlike("^[0-9a-f]{32}$"), h).otherwise(F.raise_error(F.lit("INVALID_ARGUMENT: not a UUID")).cast("string"))
    return Val(F.concat_ws("-", *[F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), STRING)


def _bits(v: Val, start: int) -> Val:
    h = F.substring(F.replace(v.col, F.lit("-"), F.lit("")), start, 16)
    return Val(F.conv(h, 16, -10).cast("long"), LONG)


@function("uuid.mostsignificantbits")
def _most(v: Val) -> Val:
    return _bits(v, 1)


@function("uuid.leastsignificantbits")
def _least(v: Val) -> Val:
    return _bits(v, 17)


def interpolate(parts: list[Val]) -> Val:
    return Val(F.concat(*[as_text(p) for p in parts]) if parts else F.lit(""), STRING)


def string_operator(op: str, a: Val, b: Val) -> Val:
    if not isinstance(a.type, S.StringType) or not isinstance(b.type, S.StringType):
        return Val(F.lit(None).cast("boolean"), BOOL)  # other families give null, no error
    if op == "=~":
        return Val(F.rlike(a.col, F.concat(F.lit("^(?:"), b.col, F.lit(")$"))), BOOL)
    f = {"STARTS": F.startswith, "ENDS": F.endswith, "CONTAINS": F.contains}.get(op)
    if f is None:
        raise invalid(f"no operator {op}")
    return Val(f(a.col, b.col), BOOL)


