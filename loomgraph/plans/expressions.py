"""Expressions to typed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql import types as S

from .. import functions
from ..cypher.tree import Tree as T
from ..errors import GraphError, semantic, type_error
from ..functions import collections as lists
from ..functions import maths, space, temporal, texts, vectors
from .values import BOOL, DOUBLE, DURATION, LOCAL_TIME, LONG, POINT, STRING, VOID, ZONED_TIME, Element, Rows, Val, common, family, fresh, is_float, is_list, is_map, is_node, is_number, is_path, is_rel, literal, make_list, need, to

AGGREGATES = {
    "count", "collect", "collect_list", "sum", "avg", "min", "max", "percentilecont", "percentile_cont", "percentiledisc", "percentile_disc", "stdev", "stdev_samp", "stdevp", "stdev_pop",
}
EXACT = 1 << 53


def has_aggregate(e: T) -> bool:
    if e.kind == "fn" and e.name in AGGREGATES:
        return True
    return e.kind not in ("exists", "count_sub", "collect_sub") and any(has_aggregate(c) for c in e.children())


class Expressions:
    """Compiles expressions over one set of rows."""

    def __init__(self, rows: Rows, params: dict, locals_: dict[str, Val] | None = None, replaced: Callable[[T], Val | None] | None = None):
        self.rows, self.params, self.locals = rows, params, locals_ or {}
        self.replaced = replaced
        self.registry = functions.load()
        self.held: dict[str, F.Column] = {}  # arguments that need a column of their own before aggregation

    def inside(self, **more: Val) -> "Expressions":
        return Expressions(self.rows, self.params, {**self.locals, **more}, self.replaced)

    def __call__(self, e: T) -> Val:
        if self.replaced is not None and (v := self.replaced(e)) is not None:
            return v
        f = getattr(self, f"on_{e.kind}", None)
        if f is None:
            raise GraphError("UNSUPPORTED", f"{e.kind} is not possible here")
        return f(e)

    def predicate(self, e: T) -> F.Column:
        v = self(e)
        if not isinstance(v.type, (S.BooleanType, S.NullType)):
            raise type_error(f"a condition is no {family(v.type)}")
        return v.col.cast("boolean")

    # leaves
    def on_lit(self, e: T) -> Val:
        return literal(e.value)

    def on_param(self, e: T) -> Val:
        if e.name not in self.params:
            raise GraphError("INVALID_ARGUMENT", f"no parameter ${e.name}")
        return literal(self.params[e.name])

    def on_col(self, e: T) -> Val:
        return Val(F.col(e.name), e.type)

    def on_paren(self, e: T) -> Val:
        return self(e.a)

    def binding(self, name: str):
        if name not in self.rows.scope:
            raise semantic(f"no variable {name}")
        return self.rows.scope[name]

    def on_var(self, e: T) -> Val:
        if e.name in self.locals:
            return self.locals[e.name]
        b = self.binding(e.name)
        return b.struct() if isinstance(b, Element) else Val(F.col(b.name), b.type)

    def element(self, e: T) -> Element | None:
        if e.kind == "var" and e.name not in self.locals and isinstance(self.rows.scope.get(e.name), Element):
            return self.rows.scope[e.name]
        return None

    def on_prop(self, e: T) -> Val:
        if el := self.element(e.base):
            if e.key in el.props:
                c, t = el.props[e.key]
                return Val(F.col(c), t)
            return Val(F.lit(None), VOID)
        return self.property(self(e.base), e.key)

    def property(self, v: Val, key: str) -> Val:
        t = v.type
        if isinstance(t, S.NullType):
            return v
        if t == POINT:
            out = space.component(v, key)
        elif t in (DURATION, LOCAL_TIME, ZONED_TIME) or isinstance(t, (S.DateType, S.TimestampNTZType, S.TimestampType)):
            out = temporal.component(v, key)
        elif isinstance(t, S.StructType):
            return Val(v.col.getField(key), t[key].dataType) if key in t.names and not (key in lists.HIDDEN and not is_map(t)) else Val(F.lit(None), VOID)
        elif isinstance(t, S.MapType):
            return Val(F.try_element_at(v.col, F.lit(key)), t.valueType)
        else:
            raise type_error(f"{family(t)} has no properties")
        if out is None:
            raise type_error(f"{family(t)} has no component {key}")
        return out

    # operators
    def on_and(self, e: T) -> Val:
        return Val(self.predicate(e.a) & self.predicate(e.b), BOOL)

    def on_or(self, e: T) -> Val:
        return Val(self.predicate(e.a) | self.predicate(e.b), BOOL)

    def on_xor(self, e: T) -> Val:
        return Val(self.predicate(e.a) != self.predicate(e.b), BOOL)

    def on_not(self, e: T) -> Val:
        return Val(~self.predicate(e.a), BOOL)

    def on_is_null(self, e: T) -> Val:
        if el := self.element(e.a):
            return Val(F.col(el.id).isNull(), BOOL)
        return Val(self(e.a).col.isNull(), BOOL)

    def on_is_norm(self, e: T) -> Val:
        v = self(e.a)
        return Val(texts.normalized(v.col, F.lit(e.form)) == v.col, BOOL)

    def on_is_type(self, e: T) -> Val:
        return Val(texts.has_type(self(e.a), e.type), BOOL)

    def on_str_op(self, e: T) -> Val:
        return texts.string_operator(e.op, self(e.a), self(e.b))

    def on_neg(self, e: T) -> Val:
        v = self(e.a)
        if v.type == DURATION:
            return temporal.scale(v, F.lit(-1.0))
        need(v, "unary -", S.NumericType)
        return Val(-v.col, v.type)

    def on_cmp(self, e: T) -> Val:
        if e.op == "=~":
            return texts.string_operator("=~", self(e.a), self(e.b))
        x, y = self.element(e.a), self.element(e.b)
        if x and y and e.op in ("=", "<>"):
            c = F.col(x.id) == F.col(y.id)
            return Val(c if e.op == "=" else ~c, BOOL)
        return self.compare(e.op, self(e.a), self(e.b))

    def compare(self, op: str, a: Val, b: Val) -> Val:
        fa, fb = family(a.type), family(b.type)
        if "NULL" in (fa, fb):
            return Val(F.lit(None).cast("boolean"), BOOL)
        if op in ("=", "<>"):
            c = self.equal(a, b)
            return Val(c if op == "=" else ~c, BOOL)
        if fa in ("POINT", "DURATION") or fb in ("POINT", "DURATION"):
            return Val(F.lit(None).cast("boolean"), BOOL)
        if fa != fb:  # values of different families compare by a fixed order of families
            order = ["MAP", "NODE", "RELATIONSHIP", "LIST", "PATH", "ZONED DATETIME", "LOCAL DATETIME", "DATE", "ZONED TIME", "LOCAL TIME", "STRING", "BOOLEAN", "NUMBER"]
            less = order.index(fa) < order.index(fb)
            out = less if op in ("<", "<=") else not less
            return Val(F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(out)), BOOL)
        x, y = a.col, b.col
        if fa == "NUMBER":
            x, y, guard = self.numbers(a, b)
        elif fa in ("ZONED TIME",):
            x, y, guard = (v.col["time_nanos"] - v.col["offset_seconds"] * 1_000_000_000 for v in (a, b)), None, None
            x, y = tuple(x)
        else:
            guard = None
        c = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        return Val(c if guard is None else F.when(guard, F.lit(False)).otherwise(c), BOOL)

    def numbers(self, a: Val, b: Val):
        """Two numbers to compare; mixed ones without rounding the integer; and where a NaN makes it false."""
        guard = None
        for v in (a, b):
            if is_float(v.type):
                g = F.isnan(v.col)
                guard = g if guard is None else guard | g
        if is_float(a.type) == is_float(b.type):
            return a.col, b.col, guard

        # integers past 2**53 are compared as decimals, where a float is exact too
        whole, part = (b, a) if is_float(a.type) else (a, b)
        large = (F.abs(whole.col.cast("decimal(20,0)")) > EXACT) & (F.abs(part.col) < 1e19)
        # the sign of the exact difference stands for the pair
        exact = whole.col.cast("decimal(38,6)") - F.when(large, part.col).cast("decimal(38,6)")
        diff = F.when(large, F.signum(exact.cast("double"))).otherwise(F.when(whole.col.cast("double") < part.col, -1.0).when(whole.col.cast("double") > part.col, 1.0).when(whole.col.isNotNull() & part.col.isNotNull(), 0.0))
        zero = F.lit(0.0)
        return (zero, diff, guard) if is_float(a.type) else (diff, zero, guard)

    def equal(self, a: Val, b: Val) -> F.Column:
        fa, fb = family(a.type), family(b.type)
        if "NULL" in (fa, fb):
            return F.lit(None).cast("boolean")
        if fa != fb:
            raise type_error(f"= between {fa} and {fb}")
        if fa == "NUMBER":
            x, y, guard = self.numbers(a, b)
            return x == y if guard is None else F.when(guard, F.when(x.isNotNull() & y.isNotNull(), F.lit(False))).otherwise(x == y)
        if fa in ("NODE", "RELATIONSHIP"):
            return a.col["_id"] == b.col["_id"]
        if fa == "LIST":
            kind = common([a.type, b.type])
            x, y = to(a, kind), to(b, kind)
            null = F.exists(x, lambda p: p.isNull()) | F.exists(y, lambda p: p.isNull()) if not isinstance(kind.elementType, (S.ArrayType, S.StructType)) else None
            same = x == y
            if null is None:
                return same
            # a null inside leaves the answer open, unless other elements differ
            pairs = F.zip_with(x, y, lambda p, q: p == q)
            return F.when(F.size(x) != F.size(y), F.lit(False)).when(~null, same).when(F.exists(pairs, lambda p: F.coalesce(~p, F.lit(False))), F.lit(False))
        if fa == "MAP" and isinstance(a.type, S.StructType) and isinstance(b.type, S.StructType):
            if set(a.type.names) != set(b.type.names):
                return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
            out = F.lit(True)
            for f in a.type:
                out = out & self.equal(Val(a.col.getField(f.name), f.dataType), Val(b.col.getField(f.name), b.type[f.name].dataType))
            return F.when(a.col.isNotNull() & b.col.isNotNull(), out)
        return a.col == b.col

    def on_in(self, e: T) -> Val:
        x, items = self(e.a), self(e.b)
        if isinstance(items.type, S.NullType):
            return Val(F.lit(None).cast("boolean"), BOOL)
        need(items, "IN", S.ArrayType)
        inner = items.type.elementType
        if isinstance(inner, S.NullType) and e.b.kind == "list" and not e.b.items:
            return Val(F.when(items.col.isNotNull(), F.lit(False)), BOOL)
        if isinstance(x.type, S.NullType):
            return Val(F.when(F.size(items.col) == 0, F.lit(False)), BOOL)
        if isinstance(inner, S.NullType) or family(inner) != family(x.type):
            known = F.exists(items.col, lambda p: p.isNull())
            return Val(F.when(items.col.isNull() | (x.col.isNull() & (F.size(items.col) > 0)) | known, F.lit(None)).otherwise(F.lit(False)).cast("boolean"), BOOL)
        if is_node(inner) or is_rel(inner):
            return Val(F.exists(items.col, lambda p: p["_id"] == x.col["_id"]), BOOL)
        kind = common([inner, x.type])
        plain = F.array_contains(to(items, S.ArrayType(kind)), to(x, kind))
        return Val(F.when(F.size(items.col) == 0, F.lit(False)).otherwise(plain), BOOL)

    def on_bin(self, e: T) -> Val:
        return self.binary(e.op, self(e.a), self(e.b))

    def binary(self, op: str, a: Val, b: Val) -> Val:
        if op in ("+", "||") and (is_list(a.type) or is_list(b.type)):
            if is_list(a.type) and is_list(b.type):
                kind = common([a.type, b.type])
                return Val(F.concat(to(a, kind), to(b, kind)), kind)
            if op == "||":
                raise type_error("|| joins two lists or two strings")
            items, x = (a, b) if is_list(a.type) else (b, a)
            inner = common([items.type.elementType, x.type])
            kind = S.ArrayType(inner)
            return Val(F.concat(to(a, kind), F.array(to(x, inner))) if items is a else F.concat(F.array(to(x, inner)), to(b, kind)), kind)
        if isinstance(a.type, S.NullType) or isinstance(b.type, S.NullType):
            t = b.type if isinstance(a.type, S.NullType) else a.type
            return Val(F.lit(None).cast(t if not isinstance(t, S.NullType) else "bigint"), t if not isinstance(t, S.NullType) else LONG)
        if op in ("+", "||") and (isinstance(a.type, S.StringType) or isinstance(b.type, S.StringType)):
            if op == "||" and not (isinstance(a.type, S.StringType) and isinstance(b.type, S.StringType)):
                raise type_error("|| joins two lists or two strings")
            return Val(F.concat(texts.as_text(a), texts.as_text(b)), STRING)
        if DURATION in (a.type, b.type):
            if op in ("+", "-") and b.type == DURATION:
                return temporal.add(a, b.col, 1 if op == "+" else -1)
            if op == "+" and a.type == DURATION:
                return temporal.add(b, a.col)
            if op == "*" and is_number(b.type):
                return temporal.scale(a, b.col)
            if op == "*" and is_number(a.type):
                return temporal.scale(b, a.col)
            if op == "/" and is_number(b.type):
                return temporal.scale(a, b.col, True)
        return maths.arithmetic(op, a, b)

    # collections
    def on_list(self, e: T) -> Val:
        return make_list([self(x) for x in e.items])

    def on_map(self, e: T) -> Val:
        items = {k: self(v) for k, v in e.items}
        if not items:
            return Val(F.create_map().cast("map<string,string>"), S.MapType(STRING, STRING))
        return Val(F.struct(*[v.col.alias(k) for k, v in items.items()]), S.StructType([S.StructField(k, v.type) for k, v in items.items()]))

    def on_map_proj(self, e: T) -> Val:
        base = self(T("var", name=e.var))
        out: dict[str, Val] = {}
        for k, v in e.items:
            if k == "*" and v is None:
                props = lists._properties(base)
                out |= {f.name: Val(props.col.getField(f.name), f.dataType) for f in props.type}
            else:
                out[k] = self(v)
        col = F.struct(*[v.col.alias(k) for k, v in out.items()])
        return Val(F.when(base.col.isNotNull(), col), S.StructType([S.StructField(k, v.type) for k, v in out.items()]))

    def on_index(self, e: T) -> Val:
        if (el := self.element(e.a)) and e.i.kind == "lit" and isinstance(e.i.value, str):
            return self.on_prop(T("prop", base=e.a, key=e.i.value))
        v = self(e.a)
        i = self(e.i)
        if is_list(v.type):
            need(i, "a list index", S.NumericType)
            at = F.when(i.col < 0, F.size(v.col) + i.col).otherwise(i.col)
            return Val(F.when(at >= 0, F.get(v.col, F.when(at >= 0, at).cast("int"))), v.type.elementType)
        if isinstance(v.type, S.MapType):
            return Val(F.try_element_at(v.col, i.col), v.type.valueType)
        if isinstance(v.type, S.StructType):
            key = e.i.value if e.i.kind == "lit" else self.params.get(e.i.name) if e.i.kind == "param" else None
            if isinstance(key, str):
                return self.property(v, key)
            fields = [f for f in v.type if f.name not in lists.HIDDEN]
            kind = common([f.dataType for f in fields]) if fields else VOID
            out = F.lit(None).cast(kind)
            for f in fields:
                out = F.when(i.col == f.name, to(Val(v.col.getField(f.name), f.dataType), kind)).otherwise(out)
            return Val(out, kind)
        if isinstance(v.type, S.NullType):
            return v
        raise type_error(f"{family(v.type)} has no elements")

    def on_slice(self, e: T) -> Val:
        v = lists._list(self(e.a), "a slice")
        n = F.size(v.col)

        def bound(x, default):
            if x is None:
                return default
            c = self(x).col
            return F.least(F.greatest(F.when(c < 0, n + c).otherwise(c), F.lit(0)), n)

        lo, hi = bound(e.low, F.lit(0)), bound(e.high, n)
        return Val(F.when(lo.isNotNull() & hi.isNotNull(), F.slice(v.col, (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))), v.type)

    def on_list_comp(self, e: T) -> Val:
        v = lists._list(self(e.list), "a list comprehension")
        inner = v.type.elementType
        col = v.col
        if e.where is not None:
            col = F.filter(col, lambda x: self.inside(**{e.var: Val(x, inner)}).predicate(e.where))
        if e.out is None:
            return Val(col, v.type)
        kind: list[S.DataType] = []

        def each(x):
            out = self.inside(**{e.var: Val(x, inner)})(e.out)
            kind.append(out.type)
            return out.col

        out = F.transform(col, each)
        return Val(out, S.ArrayType(kind[-1]))

    def on_list_pred(self, e: T) -> Val:
        v = lists._list(self(e.list), e.which)
        inner = v.type.elementType

        def test(x):
            return self.inside(**{e.var: Val(x, inner)}).predicate(e.where)

        if e.which == "ALL":
            out = F.forall(v.col, test)
        elif e.which == "ANY":
            out = F.exists(v.col, test)
        elif e.which == "NONE":
            out = ~F.exists(v.col, test)
        else:
            sure = F.size(F.filter(v.col, test))
            open_ = F.exists(v.col, lambda x: test(x).isNull())
            out = F.when(v.col.isNotNull(), F.when(sure > 1, F.lit(False)).when(open_, F.lit(None)).otherwise(sure == 1))
        return Val(out, BOOL)

    def on_reduce(self, e: T) -> Val:
        v = lists._list(self(e.list), "reduce")
        init = self(e.init)
        inner = v.type.elementType
        step_type = init.type
        if e.test is None:
            # the accumulator has the type that its steps settle on; the first steps are tried on nulls
            for _ in range(2):
                trial = self.inside(**{e.acc: Val(F.lit(None).cast(step_type), step_type), e.var: Val(F.lit(None).cast(inner), inner)})(e.step)
                step_type = common([step_type, trial.type])
            return Val(F.aggregate(v.col, to(init, step_type), lambda a, x: to(self.inside(**{e.acc: Val(a, step_type), e.var: Val(x, inner)})(e.step), step_type)), step_type)

        def both(s, x):
            acc = self.inside(**{e.acc: Val(s["acc"], init.type), e.var: Val(x, inner)})(e.step)
            ok = self.inside(**{e.acc: Val(acc.col, acc.type), e.var: Val(x, inner)}).predicate(e.test)
            return F.struct(to(acc, init.type).alias("acc"), (s["ok"] & ok).alias("ok"))

        return Val(F.aggregate(v.col, F.struct(init.col.alias("acc"), F.lit(True).alias("ok")), both, lambda s: s["ok"]), BOOL)

    def on_case(self, e: T) -> Val:
        base = self(e.base) if e.base is not None else None
        results = [self(r) for _, r in e.branches] + ([self(e.other)] if e.other is not None else [])
        kind = common([r.type for r in results])
        out = None
        for (w, _), r in zip(e.branches, results, strict=False):
            test = self.predicate(w) if base is None else self.compare("=", base, self(w)).col
            out = F.when(test, to(r, kind)) if out is None else out.when(test, to(r, kind))
        if e.other is not None:
            out = out.otherwise(to(results[-1], kind))
        return Val(out, kind)

    def on_interp(self, e: T) -> Val:
        return texts.interpolate([self(p) for p in e.parts["parts"]])

    def on_has_label(self, e: T) -> Val:
        el = self.element(e.base)
        if el and el.kind == "node":
            return Val(F.when(F.col(el.id).isNotNull(), self.label_test(e.expr, F.col(el.meta["labels"]))), BOOL)
        if el:
            return Val(F.when(F.col(el.id).isNotNull(), self.type_test(e.expr, F.col(el.meta["type"]))), BOOL)
        v = self(e.base)
        return Val(self.label_test(e.expr, v.col["_labels"]) if is_node(v.type) else self.type_test(e.expr, v.col["_type"]), BOOL)

    def label_test(self, e: T, labels) -> F.Column:
        if e.kind == "l_name":
            return F.array_contains(labels, e.name)
        if e.kind == "l_any":
            return F.size(labels) > 0
        if e.kind == "l_not":
            return ~self.label_test(e.part, labels)
        if e.kind == "l_dyn":
            v = self(e.expr)
            return F.forall(v.col, lambda x: F.array_contains(labels, x)) if is_list(v.type) else F.array_contains(labels, v.col)
        out = None
        for p in e.parts["parts"]:
            t = self.label_test(p, labels)
            out = t if out is None else out & t if e.kind == "l_and" else out | t
        return out

    def type_test(self, e: T, kind) -> F.Column:
        if e.kind == "l_name":
            return kind == e.name
        if e.kind == "l_any":
            return kind.isNotNull()
        if e.kind == "l_not":
            return ~self.type_test(e.part, kind)
        if e.kind == "l_dyn":
            v = self(e.expr)
            return F.forall(v.col, lambda x: x == kind) if is_list(v.type) else v.col == kind
        out = None
        for p in e.parts["parts"]:
            t = self.type_test(p, kind)
            out = t if out is None else out & t if e.kind == "l_and" else out | t
        return out

    # functions
    def on_fn(self, e: T) -> Val:
        name = e.name
        if name in AGGREGATES:
            raise semantic(f"{name} is not possible here")
        if len(e.args) == 1 and (el := self.element(e.args[0])):
            direct = self.element_function(name, el)
            if direct is not None:
                return direct
        if name == "property_exists":
            el = self.element(e.args[0])
            v = self.on_prop(T("prop", base=e.args[0], key=e.args[1].value)) if el else self.property(self(e.args[0]), e.args[1].value)
            return Val(v.col.isNotNull(), BOOL)
        if name in ("vector_distance", "vector_norm", "vector") and e.args[-1].kind == "lit" and isinstance(e.args[-1].value, str) and len(e.args) > 1:
            args = [self(x) for x in e.args[:-1]]
            f = {"vector_distance": vectors.distance, "vector_norm": vectors.norm, "vector": vectors.make}[name]
            return f(*args, e.args[-1].value)
        if name in ("file", "linenumber") and not e.args:
            b = self.rows.scope.get(f"{name}()")  # of the LOAD CSV whose records these rows are
            return Val(F.col(b.name), b.type) if b is not None else Val(F.lit(None).cast(STRING if name == "file" else LONG), STRING if name == "file" else LONG)
        if name == "vector":
            return vectors.make(*[self(x) for x in e.args])
        if name in ("all", "any", "none", "single", "exists"):
            raise semantic(f"{name} needs a variable and a list")
        f = self.registry.get(name)
        if f is None:
            raise semantic(f"no function {name}")
        try:
            return f(*[self(x) for x in e.args])
        except TypeError as err:
            if "argument" in str(err):
                raise semantic(f"{name} does not take {len(e.args)} arguments") from None
            raise

    def element_function(self, name: str, el: Element) -> Val | None:
        there = F.col(el.id).isNotNull()
        if name == "id":
            return Val(F.col(el.id), LONG)
        if name == "elementid":
            return Val(F.concat(F.lit("n:" if el.kind == "node" else "r:"), F.col(el.id).cast("string")), STRING)
        if name == "labels" and el.kind == "node":
            return Val(F.when(there, F.col(el.meta["labels"])), S.ArrayType(STRING))
        if name == "type" and el.kind == "rel":
            return Val(F.col(el.meta["type"]), STRING)
        if name in ("startnode", "endnode") and el.kind == "rel":
            end = el.meta["src" if name == "startnode" else "dst"]
            for b in self.rows.scope.values():  # an end that is bound already has its properties
                if isinstance(b, Element) and b.kind == "node" and b.id in (end, el.meta.get(f"{'src' if name == 'startnode' else 'dst'}_var")):
                    return b.struct()
        return None

    # aggregates
    def aggregate(self, e: T) -> tuple[F.Column, S.DataType, Callable[[F.Column], F.Column]]:
        """An aggregate column, its type, and what makes the result of it."""
        name = e.name

        def same(c):
            return c

        if name == "count" and e.star:
            return F.count(F.lit(1)), LONG, same
        if not e.args:
            raise semantic(f"{name} needs an argument")
        if name == "count" and (el := self.element(e.args[0])):
            return (F.count_distinct(F.col(el.id)) if e.distinct else F.count(F.col(el.id))), LONG, same
        v = self(e.args[0])
        if name == "count":
            key = v.col["_id"] if is_node(v.type) or is_rel(v.type) else v.col
            return (F.count_distinct(key) if e.distinct else F.count(key)), LONG, same
        if name in ("collect", "collect_list"):
            kind = S.ArrayType(v.type)
            if e.distinct:
                return F.collect_set(v.col), kind, F.array_sort if not isinstance(v.type, (S.StructType, S.MapType)) else same
            if self.rows.order:
                keys = [F.col(c).alias(f"k{i}") for i, (c, _) in enumerate(self.rows.order)]
                down = [d for _, d in self.rows.order]
                held = F.collect_list(F.when(v.col.isNotNull(), F.struct(*keys, v.col.alias("v"))))
                if all(down):
                    return held, kind, lambda c: F.transform(F.sort_array(c, asc=False), lambda x: x["v"])
                if not any(down):
                    return held, kind, lambda c: F.transform(F.array_sort(c), lambda x: x["v"])

                def order(a, b):
                    out = F.lit(0)
                    for i in reversed(range(len(down))):
                        x, y = a[f"k{i}"], b[f"k{i}"]
                        out = F.when(x < y, F.lit(1 if down[i] else -1)).when(x > y, F.lit(-1 if down[i] else 1)).otherwise(out)
                    return out

                return held, kind, lambda c: F.transform(F.array_sort(c, order), lambda x: x["v"])
            return F.collect_list(v.col), kind, same
        if name in ("min", "max"):
            if v.type == DURATION:
                f = F.min_by if name == "min" else F.max_by
                return f(v.col, temporal.average_seconds(v.col)), v.type, same
            return (F.min if name == "min" else F.max)(v.col), v.type, same
        if name in ("sum", "avg") and v.type == DURATION:
            total = F.struct(F.sum(v.col["months"]).alias("months"), F.sum(v.col["days"]).alias("days"), F.sum(v.col["seconds"]).alias("seconds"), F.sum(v.col["nanos"]).alias("nanos"), F.count(v.col).alias("n"))

            def done(c):
                whole = temporal.duration(F.coalesce(c["months"], F.lit(0)), F.coalesce(c["days"], F.lit(0)), F.coalesce(c["seconds"], F.lit(0)), F.coalesce(c["nanos"], F.lit(0)))
                return whole if name == "sum" else F.when(c["n"] > 0, temporal.scale(Val(whole, DURATION), F.greatest(c["n"], F.lit(1)), True).col)

            return total, DURATION, done
        need(v, name, S.NumericType)
        x = v.col
        if name == "sum":
            kind = DOUBLE if is_float(v.type) else LONG
            c = F.sum_distinct(x) if e.distinct else F.sum(x)
            return c, kind, lambda c: F.coalesce(c, F.lit(0.0 if kind == DOUBLE else 0)).cast(kind)
        if name == "avg":
            return (F.sum_distinct(x) / F.count_distinct(x) if e.distinct else F.avg(x)), DOUBLE, same
        if name.startswith("stdev"):
            if name in ("stdevp", "stdev_pop"):
                return F.stddev_pop(x), DOUBLE, lambda c: F.coalesce(c, F.lit(0.0))
            # of one value it is 0, where the built-in has null
            return F.struct(F.count(x).alias("n"), F.stddev_samp(x).alias("s")), DOUBLE, lambda c: F.when(c["n"] <= 1, F.lit(0.0)).otherwise(c["s"])
        p = e.args[1]
        share = p.value if p.kind == "lit" else self.params.get(p.name) if p.kind == "param" else None
        if not isinstance(share, (int, float)) or not 0 <= share <= 1:
            raise GraphError("INVALID_ARGUMENT", "a percentile lies between 0 and 1")
        if name in ("percentilecont", "percentile_cont"):
            return F.percentile(x, F.lit(float(share))), DOUBLE, same
        held = fresh("arg")  # the built-in is only written in SQL, which needs a name
        self.held[held] = x
        return F.expr(f"percentile_disc({float(share)!r}D) WITHIN GROUP (ORDER BY {held})"), v.type, lambda c: c.cast(v.type)

    def sort_key(self, v: Val) -> F.Column:
        if v.type == DURATION:
            return temporal.average_seconds(v.col)
        if is_node(v.type) or is_rel(v.type):
            return v.col["_id"]
        if is_path(v.type):
            return F.size(v.col["_rels"])
        if isinstance(v.type, S.MapType):
            return F.to_json(v.col)
        return v.col
