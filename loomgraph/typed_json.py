"""Typed JSON: values, parameters and whole results as JSON that keeps their types.

What JSON has no kind for is an object with the reserved key ``$type``: integers beyond
the safe range, floats that are not finite, temporal values, points, nodes, relationships
and paths.  A map that has this key itself is wrapped.
"""

from __future__ import annotations

import datetime
import json
import math
import time

from pyspark.sql import types as S

from .errors import invalid
from .functions import load
from .plans.values import DURATION, LOCAL_TIME, POINT, ZONED_TIME, Val, is_node, is_path, is_rel, literal

#: Integers that a JSON number keeps.
SAFE = (1 << 53) - 1
#: Coordinate systems by their number, and what counters a summary has.
CRS = {7203: "cartesian", 9157: "cartesian-3d", 4326: "wgs-84", 4979: "wgs-84-3d"}
COUNTERS = ("nodesCreated", "nodesDeleted", "relationshipsCreated", "relationshipsDeleted", "propertiesSet", "propertiesRemoved", "labelsAdded", "labelsRemoved", "constraintsAdded", "constraintsRemoved", "indexesAdded", "indexesRemoved")


def _tagged(kind: str, **fields) -> dict:
    return {"$type": kind, **fields}


def _clock(nanos: int) -> str:
    seconds, rest = divmod(nanos, 1_000_000_000)
    text = f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"
    return text + (f".{rest:09d}".rstrip("0") if rest else "")


def _offset(seconds: int) -> str:
    return "Z" if not seconds else f"{'-' if seconds < 0 else '+'}{abs(seconds) // 3600:02d}:{abs(seconds) // 60 % 60:02d}"


def _duration(months: int, days: int, seconds: int, nanos: int) -> str:
    def parts(n: int, *units: tuple[str, int]) -> str:
        sign, n, out = (-1 if n < 0 else 1), abs(n), ""
        for name, size in units:
            out += f"{sign * (n // size)}{name}" if n // size else ""
            n %= size
        return out

    total = seconds * 1_000_000_000 + nanos
    date = parts(months, ("Y", 12), ("M", 1)) + parts(days, ("D", 1))
    clock = parts(total - int(math.fmod(total, 60_000_000_000)), ("H", 3_600_000_000_000), ("M", 60_000_000_000))
    if rest := int(math.fmod(total, 60_000_000_000)):
        whole, part = divmod(abs(rest), 1_000_000_000)
        clock += f"{'-' if rest < 0 else ''}{whole}" + (f".{part:09d}".rstrip("0") if part else "") + "S"
    return f"P{date}" + (f"T{clock}" if clock or not date else "") if date or clock else "PT0S"


def _is(kind: S.DataType, shape: S.StructType) -> bool:
    return isinstance(kind, S.StructType) and kind.names == shape.names


def encode(x, kind: S.DataType):
    """A collected value of a column's type as what ``json`` writes."""
    if x is None:
        return None
    if isinstance(kind, S.BooleanType) or isinstance(kind, S.StringType):
        return x
    if isinstance(kind, S.IntegralType):
        return x if -SAFE <= x <= SAFE else _tagged("Integer", value=str(x))
    if isinstance(kind, S.NumericType):
        x = float(x)
        return x if math.isfinite(x) else _tagged("Float", value="NaN" if math.isnan(x) else "Infinity" if x > 0 else "-Infinity")
    if isinstance(kind, S.DateType):
        return _tagged("Date", value=x.isoformat())
    if isinstance(kind, S.TimestampNTZType):
        return _tagged("LocalDateTime", value=x.isoformat())
    if isinstance(kind, S.TimestampType):
        moment = x.astimezone(datetime.UTC) if x.tzinfo else datetime.datetime.fromtimestamp(x.timestamp(), datetime.UTC)
        return _tagged("ZonedDateTime", value=moment.replace(tzinfo=None).isoformat() + "Z", zone="Z")
    if _is(kind, DURATION):
        return _tagged("Duration", value=_duration(*x))
    if _is(kind, LOCAL_TIME):
        return _tagged("LocalTime", value=_clock(x[0]))
    if _is(kind, ZONED_TIME):
        return _tagged("Time", value=_clock(x[0]) + _offset(x[1]))
    if _is(kind, POINT):
        return _tagged("Point", crs=CRS.get(x[0], str(x[0])), coordinates=list(x[1]))
    if isinstance(kind, S.ArrayType):
        return [encode(v, kind.elementType) for v in x]
    if is_path(kind):
        return _tagged("Path", nodes=encode(x[0], kind["_nodes"].dataType), relationships=encode(x[1], kind["_rels"].dataType))
    if isinstance(kind, S.StructType) and (is_node(kind) or is_rel(kind)):
        properties = {f.name: encode(x[f.name], f.dataType) for f in kind if not f.name.startswith("_") and x[f.name] is not None}
        if is_node(kind):
            return _tagged("Node", elementId=f"n:{x['_id']}", labels=list(x["_labels"] or []), properties=properties)
        return _tagged("Relationship", elementId=f"r:{x['_id']}", type=x["_type"], start=f"n:{x['_src']}", end=f"n:{x['_dst']}", properties=properties)
    if isinstance(kind, S.StructType):
        made = {f.name: encode(v, f.dataType) for f, v in zip(kind, x, strict=True)}
    elif isinstance(kind, S.MapType):
        made = {k: encode(v, kind.valueType) for k, v in x.items()}
    else:
        raise invalid(f"no typed JSON for {kind.simpleString()}")
    return _tagged("Map", entries=made) if "$type" in made else made


#: The fields that a tagged value has, all of them and no others.
FIELDS = {
    "Integer": {"value"}, "Float": {"value"}, "Map": {"entries"}, "Date": {"value"}, "LocalTime": {"value"}, "Time": {"value"}, "LocalDateTime": {"value"},
    "ZonedDateTime": {"value", "zone"}, "Duration": {"value"}, "Point": {"crs", "coordinates"}, "UUID": {"value"}, "Vector": {"coordinateType", "dimension", "values"},
}
CONSTRUCTORS = {"Date": "date", "LocalTime": "localtime", "Time": "time", "LocalDateTime": "localdatetime", "ZonedDateTime": "datetime", "Duration": "duration", "UUID": "uuid"}


def decode(x):
    """A parameter's value from parsed JSON: a Python value, or a typed column."""
    if isinstance(x, list):
        return [decode(v) for v in x]
    if not isinstance(x, dict):
        return x
    if "$type" not in x:
        return {k: decode(v) for k, v in x.items()}
    kind, fields = x["$type"], {k: v for k, v in x.items() if k != "$type"}
    if not isinstance(kind, str) or FIELDS.get(kind) != set(fields):
        raise invalid(f"no parameter is of the kind {kind} with the fields {sorted(fields)}")
    if kind == "Integer":
        value = int(fields["value"])
        if not -(1 << 63) <= value < 1 << 63:
            raise invalid("an integer has 64 bits")
        return value
    if kind == "Float":
        return float(fields["value"].replace("Infinity", "inf"))
    if kind == "Map":
        return {k: decode(v) for k, v in fields["entries"].items()}
    if kind == "Vector":
        values = [decode(v) for v in fields["values"]]
        if len(values) != fields["dimension"]:
            raise invalid("a vector has as many values as dimensions")
        return [float(v) for v in values] if fields["coordinateType"].startswith("F") else values
    functions = load()
    if kind == "Point":
        names = ("longitude", "latitude", "height") if fields["crs"].startswith("wgs") else ("x", "y", "z")
        return functions["point"](literal(dict(zip(names, map(float, fields["coordinates"]), strict=False))))
    value: Val = functions[CONSTRUCTORS[kind]](literal(fields["value"]))
    return value


def parameters(text: str) -> dict:
    """The parameters of a query from their JSON text, an object."""
    made = json.loads(text)
    if not isinstance(made, dict):
        raise invalid("parameters are an object")
    return {k: decode(v) for k, v in made.items()}


def envelope(result, started: float | None = None) -> str:
    """A whole result as one JSON text: columns, rows and summary."""
    started = started or time.time()
    rows = []
    if result.df is not None:
        kinds = [f.dataType for f in result.df.schema]
        rows = [[encode(v, k) for v, k in zip(r, kinds, strict=True)] for r in result.df.collect()]
    said = result.summary
    counters = said.get("counters", {})
    summary = {
        "queryType": said.get("type", "read"), "commit": f"commit/{said['commit']}" if said.get("commit") else None, "mergeSession": said.get("mergeSession"),
        "counters": {c: counters.get(c, 0) for c in COUNTERS}, "metrics": {"rows": len(rows), "elapsedMicros": int((time.time() - started) * 1e6)},
    }
    if "profile" in said:
        summary["profile"] = {"operators": said["profile"]}
    return json.dumps({"columns": result.columns, "rows": rows, "summary": summary}, ensure_ascii=False)
