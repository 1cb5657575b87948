"""Points: struct(srid, coords); srid 7203 and 9157 are Cartesian, 4326 and 4979 are longitude and latitude."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..errors import invalid, type_error
from ..plans.values import BOOL, DOUBLE, POINT, Val
from . import function

#: Coordinate reference systems and the mean radius of the earth in metres.
CRS = {"cartesian": 7203, "cartesian-3d": 9157, "wgs-84": 4326, "wgs-84-3d": 4979}
RADIUS = 6378140.0


def _point(v: Val, what: str) -> None:
    if v.type != POINT and not isinstance(v.type, S.NullType):
        raise type_error(f"{what} takes points")


@function("point")
def _make(v: Val) -> Val:
    if isinstance(v.type, S.NullType):
        return Val(F.lit(None).cast(POINT), POINT)
    names = set(v.type.names)
    world = {"longitude", "latitude"} <= names
    parts = ["longitude", "latitude"] if world else ["x", "y"]
    if not set(parts) <= names:
        raise invalid("a point needs x and y, or longitude and latitude")
    third = next((n for n in ("z", "height") if n in names), None)
    parts += [third] if third else []
    srid = {(False, False): 7203, (False, True): 9157, (True, False): 4326, (True, True): 4979}[world, bool(third)]
    code = F.lit(srid).cast("long")
    if "srid" in names:
        code = v.col["srid"].cast("long")
    elif "crs" in names:
        code = F.lit(None).cast("long")
        for n, c in CRS.items():
            code = F.when(F.lower(v.col["crs"]) == n, F.lit(c).cast("long")).otherwise(code)
        code = F.coalesce(code, F.raise_error(F.lit("INVALID_ARGUMENT: unknown crs")).cast("long"))
    coords = F.array(*[v.col[p].cast("double") for p in parts])
    any_null = F.exists(coords, lambda x: x.isNull())
    return Val(F.when(any_null, F.lit(None)).otherwise(F.struct(code.alias("srid"), coords.alias("coords"))), POINT)


@function("point.distance")
def _distance(a: Val, b: Val) -> Val:
    _point(a, "point.distance")
    _point(b, "point.distance")
    x, y = a.col["coords"], b.col["coords"]
    plain = F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, t: s + t))

    def at(c, i):
        return F.get(c, F.lit(i))

    lat1, lat2 = F.radians(at(x, 1)), F.radians(at(y, 1))
    dlat, dlon = lat2 - lat1, F.radians(at(y, 0)) - F.radians(at(x, 0))
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin(dlon / 2), 2)
    z1, z2 = F.coalesce(at(x, 2), F.lit(0.0)), F.coalesce(at(y, 2), F.lit(0.0))
    ground = F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * 2 * (F.lit(RADIUS) + (z1 + z2) / 2)
    world = F.hypot(ground, z1 - z2)
    same = a.col["srid"] == b.col["srid"]
    return Val(F.when(same, F.when(a.col["srid"].isin(4326, 4979), world).otherwise(plain)), DOUBLE)


@function("point.withinbbox")
def _within(p: Val, low: Val, high: Val) -> Val:
    def at(v, i):
        return F.get(v.col["coords"], F.lit(i))

    inside = F.lit(True)
    for i in range(3):
        test = (at(p, i) >= at(low, i)) & (at(p, i) <= at(high, i))
        if i == 0:  # a box over the date line has its lower corner east of its upper one
            over = p.col["srid"].isin(4326, 4979) & (at(low, 0) > at(high, 0))
            test = F.when(over, (at(p, 0) >= at(low, 0)) | (at(p, 0) <= at(high, 0))).otherwise(test)
        inside = inside & (F.coalesce(test, F.lit(True)) if i == 2 else test)
    same = (p.col["srid"] == low.col["srid"]) & (p.col["srid"] == high.col["srid"])
    return Val(F.when(same, inside), BOOL)


def component(v: Val, key: str) -> Val | None:
    at = {"x": 0, "y": 1, "z": 2, "longitude": 0, "latitude": 1, "height": 2}.get(key.lower())
    if at is not None:
        return Val(F.get(v.col["coords"], F.lit(at)), DOUBLE)
    if key.lower() == "srid":
        return Val(v.col["srid"], POINT["srid"].dataType)
    if key.lower() == "crs":
        out = F.lit(None).cast("string")
        for n, c in CRS.items():
            out = F.when(v.col["srid"] == c, F.lit(n)).otherwise(out)
        return Val(out, S.StringType())
    return None
