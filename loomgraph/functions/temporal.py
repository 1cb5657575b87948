"""Dates, times, datetimes and durations.

DATE is a date column, LOCAL DATETIME a timestamp without zone, ZONED DATETIME a
timestamp (an instant; written in UTC), times are nanoseconds of the day, DURATION is
struct(months, days, seconds, nanos).  Instants have microseconds.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..errors import invalid, type_error
from ..plans.values import DATE, DURATION, LOCAL_TIME, LONG, NTZ, STRING, ZONED, ZONED_TIME, Val, family
from . import function

DAY = 86_400_000_000_000
#: Mean Gregorian month in seconds.
MONTH_SECONDS = 2629746


def let(col: F.Column, f) -> F.Column:
    """``f`` of a column that is evaluated once: bound as a lambda variable, so that plans stay small."""
    return F.get(F.transform(F.array(col), f), F.lit(0))


def _field(v: Val, name: str, default):
    return F.coalesce(v.col[name].cast("long"), F.lit(default).cast("long")) if name in v.type.names else F.lit(default).cast("long")


def _date_of(v: Val) -> F.Column:
    """A date from any temporal value or a map."""
    if isinstance(v.type, (S.DateType, S.TimestampNTZType, S.TimestampType, S.NullType)):
        return v.col.cast("date")
    if isinstance(v.type, S.StringType):
        s = v.col
        week = F.regexp_extract(s, r"^(\d{4})-?W(\d{2})(?:-?(\d))?$", 1)
        ordinal = F.regexp_extract(s, r"^(\d{4})-?(\d{3})$", 1)
        compact = F.regexp_extract(s, r"^(\d{4})(\d{2})(\d{2})$", 1)

        def part(p, i):
            return F.regexp_extract(s, p, i).try_cast("int")

        wp, op, cp = r"^(\d{4})-?W(\d{2})(?:-?(\d))?$", r"^(\d{4})-?(\d{3})$", r"^(\d{4})(\d{2})(\d{2})$"
        return (
            F.when(week != "", _week(part(wp, 1), part(wp, 2), F.coalesce(part(wp, 3), F.lit(1))))
            .when(ordinal != "", F.date_add(F.make_date(part(op, 1), F.lit(1), F.lit(1)), part(op, 2) - 1))
            .when(compact != "", F.make_date(part(cp, 1), part(cp, 2), part(cp, 3)))
            .otherwise(s.cast("date"))
        )
    if isinstance(v.type, S.StructType) and v.type not in (DURATION, LOCAL_TIME, ZONED_TIME):
        names = v.type.names
        base = _date_of(Val(v.col[next(n for n in ("date", "datetime") if n in names)], v.type[next(n for n in ("date", "datetime") if n in names)].dataType)) if "date" in names or "datetime" in names else None
        year = _field(v, "year", 1970) if base is None else (v.col["year"].cast("long") if "year" in names else F.year(base).cast("long"))
        y = year.cast("int")
        if "week" in names:
            return _week(y, _field(v, "week", 1).cast("int"), _field(v, "dayOfWeek", 1).cast("int"))
        if "ordinalDay" in names:
            return F.date_add(F.make_date(y, F.lit(1), F.lit(1)), (_field(v, "ordinalDay", 1) - 1).cast("int"))
        if "quarter" in names:
            return F.date_add(F.make_date(y, ((_field(v, "quarter", 1) - 1) * 3 + 1).cast("int"), F.lit(1)), (_field(v, "dayOfQuarter", 1) - 1).cast("int"))
        month = v.col["month"].cast("int") if "month" in names else F.lit(1) if base is None else F.month(base)
        day = v.col["day"].cast("int") if "day" in names else F.lit(1) if base is None else F.dayofmonth(base)
        return F.make_date(y, month, day)
    raise type_error(f"date does not take {family(v.type)}")


def _week(y, w, d):
    fourth = F.make_date(y, F.lit(1), F.lit(4))  # is always in week 1
    monday = F.date_sub(fourth, F.weekday(fourth))
    return F.date_add(monday, ((w - 1) * 7 + d - 1).cast("int"))


def _nanos_of(v: Val) -> F.Column:
    """Nanoseconds of the day from any temporal value or a map."""
    if isinstance(v.type, S.NullType):
        return F.lit(None).cast("long")
    if v.type in (LOCAL_TIME, ZONED_TIME):
        return v.col["time_nanos"]
    if isinstance(v.type, (S.TimestampNTZType, S.TimestampType)):
        t = v.col.cast("timestamp")
        return F.pmod(F.unix_micros(t), F.lit(DAY // 1000)) * 1000
    if isinstance(v.type, S.DateType):
        return F.lit(0).cast("long")
    if isinstance(v.type, S.StringType):
        p = r"^(?:[^T]*T)?(\d{2}):?(\d{2})?(?::?(\d{2})(?:\.(\d{1,9}))?)?"
        h, m, s = (F.coalesce(F.regexp_extract(v.col, p, i).try_cast("long"), F.lit(0)) for i in (1, 2, 3))
        n = F.rpad(F.regexp_extract(v.col, p, 4), 9, "0").cast("long")
        return ((h * 60 + m) * 60 + s) * 1_000_000_000 + n
    if isinstance(v.type, S.StructType):
        sub = _field(v, "millisecond", 0) * 1_000_000 + _field(v, "microsecond", 0) * 1000 + _field(v, "nanosecond", 0)
        return ((_field(v, "hour", 0) * 60 + _field(v, "minute", 0)) * 60 + _field(v, "second", 0)) * 1_000_000_000 + sub
    raise type_error(f"a time is not made of {family(v.type)}")


def _offset_of(v: Val) -> F.Column:
    if v.type == ZONED_TIME:
        return v.col["offset_seconds"]
    text = v.col if isinstance(v.type, S.StringType) else v.col["timezone"].cast("string") if isinstance(v.type, S.StructType) and "timezone" in v.type.names else None
    if text is None:
        return F.lit(0).cast("long")
    p = r"([+-])(\d{2}):?(\d{2})?$"
    sign = F.when(F.regexp_extract(text, p, 1) == "-", -1).otherwise(1)
    size = F.coalesce(F.regexp_extract(text, p, 2).try_cast("long"), F.lit(0)) * 3600 + F.coalesce(F.regexp_extract(text, p, 3).try_cast("long"), F.lit(0)) * 60
    return (sign * size).cast("long")


def _zone_of(v: Val) -> F.Column | None:
    """A named zone in a map or in brackets after a text."""
    if isinstance(v.type, S.StructType) and "timezone" in v.type.names:
        return v.col["timezone"].cast("string")
    if isinstance(v.type, S.StringType):
        return F.nullif(F.regexp_extract(v.col, r"\[([^\]]+)\]$", 1), F.lit(""))
    return None


def _local(v: Val) -> F.Column:
    """A timestamp without zone."""
    if isinstance(v.type, S.TimestampNTZType):
        return v.col
    if isinstance(v.type, S.TimestampType):
        return v.col.cast("timestamp_ntz")
    if isinstance(v.type, S.StructType) and {"epochMillis"} & set(v.type.names):
        return F.timestamp_millis(v.col["epochMillis"].cast("long")).cast("timestamp_ntz")
    date = _date_of(Val(F.regexp_extract(v.col, "^([^T]+)", 1), STRING)) if isinstance(v.type, S.StringType) else _date_of(v)
    micros = F.unix_date(date).cast("long") * (DAY // 1000) + (_nanos_of(v) / 1000).cast("long")
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def _zoned(v: Val) -> F.Column:
    if isinstance(v.type, S.TimestampType):
        return v.col
    if isinstance(v.type, S.StructType) and "epochSeconds" in v.type.names:
        return F.timestamp_seconds(v.col["epochSeconds"].cast("long"))
    if isinstance(v.type, S.StructType) and "epochMillis" in v.type.names:
        return F.timestamp_millis(v.col["epochMillis"].cast("long"))
    text = Val(F.regexp_replace(v.col, r"(Z|[+-]\d{2}:?\d{0,2})?(\[[^\]]+\])?$", ""), STRING) if isinstance(v.type, S.StringType) else v
    local = _local(text)
    plain = F.timestamp_micros(F.unix_micros(local.cast("timestamp")) - _offset_of(Val(F.regexp_replace(v.col, r"\[[^\]]+\]$", ""), STRING) if isinstance(v.type, S.StringType) else v) * 1_000_000)
    zone = _zone_of(v)
    if zone is None:
        return plain
    named = zone.rlike("^[A-Za-z]") & (zone != "Z")
    return F.when(named, F.to_utc_timestamp(local.cast("timestamp"), zone)).otherwise(plain)


def _now(kind: str, zone: Val | None = None) -> Val:
    utc = F.current_timestamp()
    here = F.from_utc_timestamp(utc, zone.col) if zone is not None else utc
    nanos = F.pmod(F.unix_micros(here), F.lit(DAY // 1000)) * 1000
    return {
        "date": lambda: Val(here.cast("date"), DATE),
        "datetime": lambda: Val(utc, ZONED),
        "localdatetime": lambda: Val(here.cast("timestamp_ntz"), NTZ),
        "localtime": lambda: Val(F.struct(nanos.alias("time_nanos")), LOCAL_TIME),
        "time": lambda: Val(F.struct(nanos.alias("time_nanos"), F.lit(0).cast("long").alias("offset_seconds")), ZONED_TIME),
    }[kind]()


def _build(kind: str, v: Val) -> Val:
    missing = v.col.isNull()
    if kind == "date":
        return Val(F.when(~missing, _date_of(v)), DATE)
    if kind == "localdatetime":
        return Val(F.when(~missing, _local(v)), NTZ)
    if kind == "datetime":
        return Val(F.when(~missing, _zoned(v)), ZONED)
    if kind == "localtime":
        return Val(F.when(~missing, F.struct(_nanos_of(v).alias("time_nanos"))), LOCAL_TIME)
    return Val(F.when(~missing, F.struct(_nanos_of(v).alias("time_nanos"), _offset_of(v).alias("offset_seconds"))), ZONED_TIME)


for _kind, _names in {"date": ["date"], "datetime": ["datetime", "zoned_datetime"], "localdatetime": ["localdatetime", "local_datetime"], "localtime": ["localtime", "local_time"], "time": ["time", "zoned_time"]}.items():

    def _make(kind):
        def run(v: Val | None = None, pattern: Val | None = None) -> Val:
            if v is None:
                return _now(kind)
            if pattern is not None:
                t = F.to_timestamp(v.col, pattern.col)
                return _build(kind, Val(t.cast("timestamp_ntz"), NTZ))
            return _build(kind, v)

        return run

    function(*_names)(_make(_kind))
    for _clock in ("realtime", "statement", "transaction"):
        function(f"{_kind}.{_clock}")((lambda kind: lambda zone=None: _now(kind, zone))(_kind))


@function("timestamp")
def _timestamp() -> Val:
    return Val(F.unix_millis(F.current_timestamp()), LONG)


@function("datetime.fromepoch")
def _from_epoch(s: Val, n: Val | None = None) -> Val:
    micros = s.col.cast("long") * 1_000_000 + ((n.col / 1000).cast("long") if n is not None else 0)
    return Val(F.timestamp_micros(micros), ZONED)


@function("datetime.fromepochmillis")
def _from_millis(v: Val) -> Val:
    return Val(F.timestamp_millis(v.col.cast("long")), ZONED)


# durations


def duration(months=0, days=0, seconds=0, nanos=0) -> F.Column:
    def whole(x):
        return (F.lit(x) if isinstance(x, int) else x).cast("long")

    n = whole(nanos)
    low = F.pmod(n, F.lit(1_000_000_000)).cast("long")
    carry = ((n - low) / 1_000_000_000).cast("long")
    return F.struct(whole(months).alias("months"), whole(days).alias("days"), (whole(seconds) + carry).alias("seconds"), low.alias("nanos"))


@function("duration")
def _duration(v: Val, pattern: Val | None = None) -> Val:
    if isinstance(v.type, S.NullType):
        return Val(F.lit(None).cast(DURATION), DURATION)
    if v.type == DURATION:
        return v
    if isinstance(v.type, S.StringType):
        p = r"^(-?)P(?:(-?[\d.]+)Y)?(?:(-?[\d.]+)M)?(?:(-?[\d.]+)W)?(?:(-?[\d.]+)D)?(?:T(?:(-?[\d.]+)H)?(?:(-?[\d.]+)M)?(?:(-?[\d.]+)S)?)?$"
        sound = v.col.rlike(p) & (F.length(v.col) > 1)
        sign = F.when(F.regexp_extract(v.col, p, 1) == "-", -1.0).otherwise(1.0)
        y, mo, w, d, h, mi, s = (F.coalesce(F.regexp_extract(v.col, p, i).try_cast("double"), F.lit(0.0)) * sign for i in range(2, 9))
        made = _fractional(y * 12 + mo, w * 7 + d, (h * 60 + mi) * 60 + s, F.lit(0.0))
        return Val(F.when(v.col.isNull(), F.lit(None)).when(sound, made).otherwise(F.raise_error(F.lit("INVALID_ARGUMENT: not a duration")).cast(DURATION)), DURATION)
    if not isinstance(v.type, S.StructType):
        raise type_error(f"duration does not take {family(v.type)}")

    def f(*pairs):
        out = F.lit(0.0)
        for name, scale in pairs:
            if name in v.type.names:
                out = out + F.coalesce(v.col[name].cast("double"), F.lit(0.0)) * scale
        return out

    months = f(("years", 12), ("quarters", 3), ("months", 1))
    days = f(("weeks", 7), ("days", 1))
    seconds = f(("hours", 3600), ("minutes", 60), ("seconds", 1))
    nanos = f(("milliseconds", 1e6), ("microseconds", 1e3), ("nanoseconds", 1))
    return Val(_fractional(months, days, seconds, nanos), DURATION)


def _fractional(months, days, seconds, nanos):
    """Fractions of months go to seconds of the mean month, of days to seconds."""

    def whole(x):
        return F.signum(x) * F.floor(F.abs(x))

    def parts(c):
        m = whole(c["m"])
        return F.struct(m.alias("m"), ((c["m"] - m) * MONTH_SECONDS).alias("more"), c["d"].alias("d"), c["s"].alias("s"), c["n"].alias("n"))

    def days_of(c):
        return F.struct(c["m"].alias("m"), (c["d"] + whole(c["more"] / 86400)).alias("d"), (c["s"] + c["more"] - whole(c["more"] / 86400) * 86400).alias("s"), c["n"].alias("n"))

    def seconds_of(c):
        return F.struct(c["m"].alias("m"), whole(c["d"]).alias("d"), (c["s"] + (c["d"] - whole(c["d"])) * 86400).alias("s"), c["n"].alias("n"))

    def done(c):
        s = whole(c["s"])
        return duration(c["m"], c["d"], s, F.round((c["s"] - s) * 1e9).cast("long") + c["n"].cast("long"))

    start = F.struct(months.cast("double").alias("m"), days.cast("double").alias("d"), seconds.cast("double").alias("s"), nanos.cast("double").alias("n"))
    return let(let(let(let(start, parts), days_of), seconds_of), done)


def duration_text(col) -> F.Column:
    return let(col, _duration_text)


def _duration_text(c) -> F.Column:
    y, mo = (c["months"] / 12).cast("long"), c["months"] % 12
    h, mi = (c["seconds"] / 3600).cast("long"), ((c["seconds"] % 3600) / 60).cast("long")
    s = c["seconds"] % 60
    frac = F.rtrim(F.lpad(c["nanos"].cast("string"), 9, "0"), F.lit("0"))

    def part(x, unit):
        return F.when(x != 0, F.concat(x.cast("string"), F.lit(unit))).otherwise(F.lit(""))

    sec = F.when((s != 0) | (c["nanos"] != 0), F.concat(s.cast("string"), F.when(c["nanos"] != 0, F.concat(F.lit("."), frac)).otherwise(F.lit("")), F.lit("S"))).otherwise(F.lit(""))
    date = F.concat(part(y, "Y"), part(mo, "M"), part(c["days"], "D"))
    time = F.concat(part(h, "H"), part(mi, "M"), sec)
    out = F.concat(F.lit("P"), date, F.when(time != "", F.concat(F.lit("T"), time)).otherwise(F.lit("")))
    return F.when(c.isNotNull(), F.when(out == "P", F.lit("PT0S")).otherwise(out))


def time_text(v: Val) -> F.Column:
    return let(v.col, lambda c: _time_text(Val(c, v.type)))


def _time_text(v: Val) -> F.Column:
    n = v.col["time_nanos"]
    s = (n / 1_000_000_000).cast("long")
    frac = F.rtrim(F.lpad((n % 1_000_000_000).cast("string"), 9, "0"), F.lit("0"))

    def two(x):
        return F.lpad(x.cast("string"), 2, "0")

    out = F.concat(two((s / 3600).cast("long")), F.lit(":"), two(((s % 3600) / 60).cast("long")), F.lit(":"), two(s % 60), F.when(frac != "", F.concat(F.lit("."), frac)).otherwise(F.lit("")))
    if v.type == LOCAL_TIME:
        return out
    o = v.col["offset_seconds"]
    zone = F.when(o == 0, F.lit("Z")).otherwise(F.concat(F.when(o < 0, F.lit("-")).otherwise(F.lit("+")), two((F.abs(o) / 3600).cast("long")), F.lit(":"), two(((F.abs(o) % 3600) / 60).cast("long"))))
    return F.concat(out, zone)


def _micros(v: Val) -> F.Column:
    if isinstance(v.type, (S.DateType, S.TimestampNTZType, S.TimestampType)):
        return F.unix_micros(v.col.cast("timestamp"))
    if v.type in (LOCAL_TIME, ZONED_TIME):
        return (v.col["time_nanos"] / 1000).cast("long")
    if isinstance(v.type, S.NullType):
        return F.lit(None).cast("long")
    raise type_error(f"a duration is not between {family(v.type)} values")


def _span(a: Val, b: Val):
    """Whole months, and the microseconds that are left: struct(months, rest)."""
    both = F.struct(_micros(a).alias("x"), _micros(b).alias("y"))
    out = let(both, lambda c: F.struct(*[x.alias(n) for x, n in zip(_span_of(a, b, c["x"], c["y"]), ("months", "rest"), strict=True)]))
    return out["months"], out["rest"]


def _span_of(a: Val, b: Val, x, y):
    if a.type in (LOCAL_TIME, ZONED_TIME) or b.type in (LOCAL_TIME, ZONED_TIME):
        day = F.lit(DAY // 1000)
        x, y = F.pmod(x, day), F.pmod(y, day)
        return F.lit(0).cast("long"), y - x
    one, two = F.timestamp_micros(x), F.timestamp_micros(y)
    guess = ((F.year(two) - F.year(one)) * 12 + F.month(two) - F.month(one)).cast("int")

    def plus(m):
        moved = F.add_months(one.cast("date"), m)
        return F.unix_date(moved).cast("long") * (DAY // 1000) + F.pmod(x, F.lit(DAY // 1000))

    months = F.when((guess > 0) & (plus(guess) > y), guess - 1).when((guess < 0) & (plus(guess) < y), guess + 1).otherwise(guess)
    return months.cast("long"), y - plus(months)


@function("duration.between", "duration_between")
def _between(a: Val, b: Val) -> Val:
    months, rest = _span(a, b)
    day = DAY // 1000

    def made(c):
        days = (F.signum(c["rest"].cast("double")) * F.floor(F.abs(c["rest"]) / day)).cast("long")
        return duration(c["months"], days, 0, (c["rest"] - days * day) * 1000)

    return Val(F.when(a.col.isNotNull() & b.col.isNotNull(), let(F.struct(months.alias("months"), rest.alias("rest")), made)), DURATION)


@function("duration.inmonths")
def _in_months(a: Val, b: Val) -> Val:
    return Val(F.when(a.col.isNotNull() & b.col.isNotNull(), duration(_span(a, b)[0])), DURATION)


@function("duration.indays")
def _in_days(a: Val, b: Val) -> Val:
    x = _micros(b) - _micros(a)
    return Val(F.when(a.col.isNotNull() & b.col.isNotNull(), duration(0, (F.signum(x.cast("double")) * F.floor(F.abs(x) / (DAY // 1000))).cast("long"))), DURATION)


@function("duration.inseconds")
def _in_seconds(a: Val, b: Val) -> Val:
    return Val(F.when(a.col.isNotNull() & b.col.isNotNull(), duration(0, 0, 0, (_micros(b) - _micros(a)) * 1000)), DURATION)


def add(v: Val, d: F.Column, sign: int = 1) -> Val:
    """A temporal value plus (or minus) a duration: months, then days, then time."""
    out = let(F.struct(v.col.alias("v"), d.alias("d")), lambda c: _add(Val(c["v"], v.type), c["d"], sign).col)
    return Val(out, v.type)


def _add(v: Val, d: F.Column, sign: int) -> Val:
    months, days = (d["months"] * sign).cast("int"), (d["days"] * sign).cast("int")
    nanos = (d["seconds"] * 1_000_000_000 + d["nanos"]) * sign
    if v.type == DURATION:
        return Val(F.when(v.col.isNotNull() & d.isNotNull(), duration(v.col["months"] + d["months"] * sign, v.col["days"] + d["days"] * sign, 0, (v.col["seconds"] * 1_000_000_000 + v.col["nanos"]) + nanos)), DURATION)
    if v.type in (LOCAL_TIME, ZONED_TIME):
        t = F.pmod(v.col["time_nanos"] + nanos, F.lit(DAY)).alias("time_nanos")
        return Val(F.when(v.col.isNotNull() & d.isNotNull(), F.struct(t) if v.type == LOCAL_TIME else F.struct(t, v.col["offset_seconds"].alias("offset_seconds"))), v.type)
    moved = F.date_add(F.add_months(v.col.cast("date"), months), days)
    if isinstance(v.type, S.DateType):
        return Val(F.date_add(moved, (F.floor(nanos / DAY)).cast("int")), DATE)
    micros = F.unix_date(moved).cast("long") * (DAY // 1000) + F.pmod(F.unix_micros(v.col.cast("timestamp")), F.lit(DAY // 1000)) + (nanos / 1000).cast("long")
    return Val(F.timestamp_micros(micros).cast(v.type), v.type)


def scale(d: Val, by: F.Column, divide: bool = False) -> Val:
    x = by.cast("double")
    x = F.lit(1.0) / x if divide else x
    made = let(F.struct(d.col.alias("d"), x.alias("x")), lambda c: _fractional(c["d"]["months"] * c["x"], c["d"]["days"] * c["x"], c["d"]["seconds"] * c["x"], c["d"]["nanos"] * c["x"]))
    return Val(F.when(d.col.isNotNull() & by.isNotNull(), made), DURATION)


def average_seconds(c) -> F.Column:
    """What durations sort by."""
    return c["months"].cast("double") * MONTH_SECONDS + c["days"] * 86400 + c["seconds"] + c["nanos"] / 1e9


# truncation, components, format


def _truncate(kind: str):
    def run(unit: Val, v: Val | None = None, fields: Val | None = None) -> Val:
        v = v if v is not None else _now(kind)
        u = F.lower(unit.col)
        if kind in ("localtime", "time"):
            n = _nanos_of(v)
            out = F.lit(None).cast("long")
            for name, size in {"day": DAY, "hour": 3600 * 10**9, "minute": 60 * 10**9, "second": 10**9, "millisecond": 10**6, "microsecond": 10**3}.items():
                out = F.when(u == name, n - n % size).otherwise(out)
            if fields is not None:
                out = out + _nanos_of(fields)
            return Val(F.struct(out.alias("time_nanos")) if kind == "localtime" else F.struct(out.alias("time_nanos"), _offset_of(v).alias("offset_seconds")), LOCAL_TIME if kind == "localtime" else ZONED_TIME)
        made = let(_local(v), lambda c: cut(u, c, fields, v))
        return Val(F.when(v.col.isNotNull(), made), {"date": DATE, "localdatetime": NTZ}.get(kind, ZONED))

    def cut(u, local, fields, v):
        d = local.cast("date")
        y = F.year(d)
        day = F.lit(None).cast("date")
        starts = {
            "millennium": F.make_date((y - y % 1000).cast("int"), F.lit(1), F.lit(1)),
            "century": F.make_date((y - y % 100).cast("int"), F.lit(1), F.lit(1)),
            "decade": F.make_date((y - y % 10).cast("int"), F.lit(1), F.lit(1)),
            "year": F.trunc(d, "year"),
            "weekyear": _week(F.extract(F.lit("YEAROFWEEK"), d).cast("int"), F.lit(1), F.lit(1)),
            "quarter": F.trunc(d, "quarter"),
            "month": F.trunc(d, "month"),
            "week": F.trunc(d, "week"),
        }
        for name, x in starts.items():
            day = F.when(u == name, x).otherwise(day)
        day = F.coalesce(day, d)
        n = F.pmod(F.unix_micros(local.cast("timestamp")), F.lit(DAY // 1000))
        time = F.lit(0).cast("long")
        for name, size in {"hour": 3600 * 10**6, "minute": 60 * 10**6, "second": 10**6, "millisecond": 10**3, "microsecond": 1}.items():
            time = F.when(u == name, n - n % size).otherwise(time)
        if fields is not None and isinstance(fields.type, S.StructType):
            names = fields.type.names
            if {"month", "day"} & set(names):
                month = fields.col["month"].cast("int") if "month" in names else F.month(day)
                dom = fields.col["day"].cast("int") if "day" in names else F.dayofmonth(day)
                day = F.make_date(F.year(day), month, dom)
            if "dayOfWeek" in names:
                day = F.date_add(F.trunc(day, "week"), (fields.col["dayOfWeek"] - 1).cast("int"))
            time = time + (_nanos_of(fields) / 1000).cast("long")
        if kind == "date":
            return day
        whole = F.timestamp_micros(F.unix_date(day).cast("long") * (DAY // 1000) + time)
        return whole.cast("timestamp_ntz") if kind == "localdatetime" else whole

    return run


for _kind in ("date", "datetime", "localdatetime", "localtime", "time"):
    function(f"{_kind}.truncate")(_truncate(_kind))


def component(v: Val, key: str) -> Val | None:
    """``value.year`` and its like."""
    k = key.lower()
    if v.type == DURATION:
        c = v.col
        total = c["seconds"] * 1_000_000_000 + c["nanos"]
        out = {
            "years": lambda: (c["months"] / 12).cast("long"), "months": lambda: c["months"], "quarters": lambda: (c["months"] / 3).cast("long"), "monthsofyear": lambda: c["months"] % 12,
            "weeks": lambda: (c["days"] / 7).cast("long"), "days": lambda: c["days"], "daysofweek": lambda: c["days"] % 7,
            "hours": lambda: (c["seconds"] / 3600).cast("long"), "minutes": lambda: (c["seconds"] / 60).cast("long"), "minutesofhour": lambda: ((c["seconds"] / 60).cast("long")) % 60,
            "seconds": lambda: c["seconds"], "secondsofminute": lambda: c["seconds"] % 60, "milliseconds": lambda: (total / 10**6).cast("long"), "microseconds": lambda: (total / 10**3).cast("long"),
            "nanoseconds": lambda: total, "nanosecondsofsecond": lambda: c["nanos"], "millisecondsofsecond": lambda: (c["nanos"] / 10**6).cast("long"), "microsecondsofsecond": lambda: (c["nanos"] / 10**3).cast("long"),
        }.get(k)
        return Val(out(), LONG) if out else None
    if v.type in (LOCAL_TIME, ZONED_TIME):
        n = v.col["time_nanos"]
    elif isinstance(v.type, (S.TimestampNTZType, S.TimestampType)):
        n = F.pmod(F.unix_micros(v.col.cast("timestamp")), F.lit(DAY // 1000)) * 1000
    else:
        n = None
    if n is not None:
        out = {"hour": lambda: (n / (3600 * 10**9)).cast("long"), "minute": lambda: (n / (60 * 10**9)).cast("long") % 60, "second": lambda: (n / 10**9).cast("long") % 60, "millisecond": lambda: (n % 10**9 / 10**6).cast("long"), "microsecond": lambda: (n % 10**9 / 10**3).cast("long"), "nanosecond": lambda: n % 10**9}.get(k)
        if out:
            return Val(out(), LONG)
        if k == "offsetseconds" and v.type == ZONED_TIME:
            return Val(v.col["offset_seconds"], LONG)
    if v.type in (LOCAL_TIME, ZONED_TIME):
        return None
    d = v.col.cast("date")
    out = {
        "year": lambda: F.year(d), "quarter": lambda: F.quarter(d), "month": lambda: F.month(d), "day": lambda: F.dayofmonth(d), "week": lambda: F.weekofyear(d), "weekyear": lambda: F.extract(F.lit("YEAROFWEEK"), d),
        "ordinalday": lambda: F.dayofyear(d), "dayofweek": lambda: F.weekday(d) + 1, "weekday": lambda: F.weekday(d) + 1, "dayofquarter": lambda: F.datediff(d, F.trunc(d, "quarter")) + 1,
        "epochseconds": lambda: F.floor(F.unix_micros(v.col.cast("timestamp")) / 1_000_000), "epochmillis": lambda: F.floor(F.unix_micros(v.col.cast("timestamp")) / 1000),
    }.get(k)
    if k == "timezone" and isinstance(v.type, S.TimestampType):
        return Val(F.lit("Z"), STRING)
    return Val(out().cast("long"), LONG) if out else None


@function("format")
def _format(v: Val, pattern: Val | None = None) -> Val:
    from .texts import as_text

    if pattern is None or v.type == DURATION:
        return Val(as_text(v), STRING)
    if v.type in (LOCAL_TIME, ZONED_TIME):
        return Val(F.call_function("date_format", F.timestamp_micros((v.col["time_nanos"] / 1000).cast("long")), pattern.col), STRING)
    if isinstance(v.type, (S.DateType, S.TimestampNTZType, S.TimestampType)):
        return Val(F.call_function("date_format", v.col, pattern.col), STRING)
    raise invalid(f"format does not take {family(v.type)}")
