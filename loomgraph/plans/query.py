"""Query bodies to DataFrames: one set of rows for each clause boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..cypher.tree import Tree as T
from ..cypher.tree import names_in
from ..errors import GraphError, semantic
from ..sources.graph import Graph
from .expressions import Expressions, has_aggregate
from .patterns import ELEMENTS, Matcher
from .values import BOOL, LONG, STRING, Element, Rows, Val, Value, common, fresh, is_node, is_rel, to

#: Functions of an element that do not read its properties.
LIGHT = {"id", "elementid", "labels", "type", "count", "startnode", "endnode"}
SUBS = ("exists", "count_sub", "collect_sub", "pattern_comp", "pattern_pred")


def needs(tree: T) -> dict[str, set[str] | None]:
    """For each variable name the properties that a query can read (None: all)."""
    out: dict[str, set[str] | None] = {}
    walks: set[tuple[str, str]] = set()  # a path, and a variable that goes over its elements

    def add(name: str, key: str | None) -> None:
        have = out.setdefault(name, set())
        if key is None:
            out[name] = None
        elif have is not None:
            have.add(key)

    def visit(e: T) -> None:
        if e.kind == "prop" and e.base.kind == "var":
            add(e.base.name, e.key)
            return
        if e.kind == "index" and e.a.kind == "var" and e.i.kind == "lit" and isinstance(e.i.value, str):
            add(e.a.name, e.i.value)
            return
        if e.kind == "fn" and e.name in LIGHT and len(e.args) == 1 and e.args[0].kind == "var":
            out.setdefault(e.args[0].name, set())
            if e.name == "labels":
                add(e.args[0].name, "_labels")
            return
        if e.kind == "fn" and e.name in ("length", "path_length") and e.args and e.args[0].kind == "var":
            out.setdefault(e.args[0].name, set())
            return
        if e.kind in ("list_comp", "list_pred", "reduce") and e.list.kind == "fn" and e.list.name in ("nodes", "relationships", "rels") and len(e.list.args) == 1 and e.list.args[0].kind == "var" and e.parts.get("out", e) is not None:
            walks.add((e.list.args[0].name, e.var))
            for c in e.children():
                if c is not e.list:
                    visit(c)
            return
        if e.kind == "map_proj" and ("*", None) in e.items:
            add(e.var, None)
        if e.kind == "fn" and e.name == "property_exists" and e.args[0].kind == "var":
            add(e.args[0].name, e.args[1].value)
            return
        if e.kind == "cmp" and e.op in ("=", "<>") and e.a.kind == "var" and e.b.kind == "var":
            for v in (e.a.name, e.b.name):
                out.setdefault(v, set())
            return
        if e.kind == "is_null" and e.a.kind == "var":
            out.setdefault(e.a.name, set())
            return
        if e.kind == "has_label" and e.base.kind == "var":
            add(e.base.name, "_labels")
            for c in e.expr.children():
                visit(c)
            return
        if e.kind == "var":
            add(e.name, None)
            return
        if e.kind == "delete":  # of a plain variable only the id is asked
            for i in e.items:
                if i.kind == "var":
                    out.setdefault(i.name, set())
                else:
                    visit(i)
            return
        if e.kind in ("return", "with") and e.star:
            add("*", None)
        if e.kind in ("node_pat", "rel_pat") and e.var:
            out.setdefault(e.var, set())
            if e.kind == "node_pat" and e.labels is not None:
                pass
        if e.kind == "search":
            out.setdefault(e.var, set())
        if e.kind == "item" and e.expr.kind == "var" and not e.parts.get("final", False):
            # a plain projection carries a variable on; what is read of it shows elsewhere
            out.setdefault(e.expr.name, set())
            if e.alias != e.expr.name:
                add(e.expr.name, None)
            return
        if e.kind in ("call_sub",) and isinstance(e.scope, list):
            for v in e.scope:
                out.setdefault(v, set())
        for c in e.children():
            visit(c)

    visit(tree)
    for e in tree.walk():  # what a query returns is read whole
        if e.kind == "return":
            for i in e.items:
                if i.expr.kind == "var":
                    add(i.expr.name, None)
        if e.kind in ("set", "remove", "merge", "create", "foreach"):
            for t in e.walk():
                if t.kind == "var":
                    add(t.name, None)
        if e.kind in ("set_prop", "set_label", "remove_label") and "var" in e.parts:
            add(e.var, None)
    for path, var in walks:  # of a path's elements what its variables read
        have, of = out.setdefault(path, set()), out.get(var, set())
        out[path] = None if have is None or of is None else have | of | {ELEMENTS}
    if "*" in out:
        return {k: None for k in out} | {"*": None}
    return out


class Everything(dict):
    """Needs where a star or an unknown use asks for all properties of all variables."""

    def get(self, key, default=None):
        return None


class Compiler:
    def __init__(self, graph: Graph, params: dict | None = None, procedures=None, index=None):
        self.graph, self.params = graph, params or {}
        self.procedures, self.index = procedures or {}, index
        self.needed: dict[str, set[str] | None] = {}
        self.imported: set[str] = set()
        self.writer = None
        self.numbered = False  # whether a query asks for the lines of CSV records

    # entry
    def unit(self) -> Rows:
        return Rows(self.graph.spark.range(1).select(), {}, True)

    def run(self, query: T) -> Rows:
        found = needs(query.body)
        self.numbered = any(t.kind == "fn" and t.name == "linenumber" for t in query.body.walk())
        self.needed = Everything() if "*" in found else found
        return self.body(query.body, self.unit())

    def result(self, rows: Rows, names: list[str]) -> DataFrame:
        cols = []
        for n in names:
            b = rows.scope[n]
            v = b.struct() if isinstance(b, Element) else Val(F.col(b.name), b.type)
            cols.append(v.col.alias(n))
        return rows.df.select(*cols)

    def matcher(self) -> Matcher:
        return Matcher(self.graph, self.params, self.needed)

    # composition
    def body(self, body: T, rows: Rows) -> Rows:
        if body.kind == "single":
            return self.single(body, rows)
        if body.kind == "when":
            return self.when(body, rows)
        parts, joins = body.parts["parts"], body.joins
        flavours = {j for j in joins if j != "next"}
        i, current = 0, rows
        while i < len(parts):
            group = [parts[i]]
            kinds = set()
            while i < len(joins) and joins[i] != "next":
                kinds.add(joins[i])
                i += 1
                group.append(parts[i])
            if len(kinds) > 1:
                raise semantic("UNION and UNION ALL do not mix")
            outs = [self.body(p, current) for p in group]
            current = outs[0] if len(outs) == 1 else self.union(outs, kinds == {"union"}, rows)
            if i < len(joins) and not current.scope:
                current = self.unit()  # after FINISH or a write the next part starts from one row
            i += 1
        _ = flavours
        return current

    def union(self, outs: list[Rows], distinct: bool, outer: Rows) -> Rows:
        imported = [v for v in outer.scope if v in self.imported]
        names = [v for v in outs[0].scope if v not in imported]
        for o in outs[1:]:
            if {v for v in o.scope if v not in imported} != set(names):
                raise semantic("the parts of a UNION need the same columns")
        scope: dict = {}
        frames = [[] for _ in outs]
        for v in imported:
            b = outs[0].scope[v]
            scope[v] = b
            for k, o in enumerate(outs):
                frames[k] += [F.col(c).alias(c2) for c, c2 in zip(o.scope[v].columns(), b.columns(), strict=True)]
        for v in names:
            vals = [o.scope[v].struct() if isinstance(o.scope[v], Element) else Val(F.col(o.scope[v].name), o.scope[v].type) for o in outs]
            kind = common([x.type for x in vals])
            c = fresh("u")
            scope[v] = Value(c, kind)
            for k, x in enumerate(vals):
                frames[k].append(to(x, kind).alias(c))
        df = outs[0].df.select(*frames[0])
        for o, cols in zip(outs[1:], frames[1:], strict=True):
            df = df.union(o.df.select(*cols))
        return Rows(df.distinct() if distinct else df, scope)

    def when(self, body: T, rows: Rows) -> Rows:
        outs, rest = [], None
        for condition, branch in [*body.branches, *([(None, body.other)] if body.other is not None else [])]:
            lifted, (e,) = self.lift(rows, [condition]) if condition is not None else (rows, (None,))
            test = Expressions(lifted, self.params).predicate(e) if e is not None else F.lit(True)
            test = F.coalesce(test, F.lit(False))
            take = test if rest is None else rest & test
            outs.append(self.body(branch, lifted.with_(df=lifted.df.where(take), unit=False) if not rows.unit else lifted.with_(df=lifted.df.where(take), unit=False)))
            rest = ~test if rest is None else rest & ~test
        return outs[0] if len(outs) == 1 else self.union(outs, False, rows)

    def single(self, body: T, rows: Rows) -> Rows:
        clauses = body.clauses
        for i, c in enumerate(clauses):
            f = getattr(self, f"do_{c.kind}", None)
            if f is None:
                raise GraphError("UNSUPPORTED", f"clause {c.kind}")
            if c.kind == "return" and i != len(clauses) - 1:
                raise semantic("RETURN ends a query")
            rows = f(c, rows)
        if clauses[-1].kind in ("create", "set", "remove", "delete", "merge", "foreach"):
            return rows.with_(scope={v: b for v, b in rows.scope.items() if v in self.imported})
        return rows

    # reading
    def do_match(self, c: T, rows: Rows) -> Rows:
        if c.optional:
            return self.optional(c, rows)
        return self.matched(c, rows)

    def matched(self, c: T, rows: Rows) -> Rows:
        if self.star_counts(c):
            pass
        where, before = c.where, []
        simple = c.searches == []
        if where is not None and simple:
            parts = conjuncts(where)
            before = [p for p in parts if not any(t.kind in SUBS for t in p.walk())]
            after = [p for p in parts if p not in before]
        else:
            after = conjuncts(where) if where is not None else []
        pattern = c.pattern
        if before:
            pattern, before = pushed(pattern, before, rows)
        out = self.matcher().match(rows, pattern, c.repeatable)
        for s in c.searches:
            out = self.search(s, out, rows)
        return self.filtered(out, [*before, *after])

    def star_counts(self, c: T) -> bool:
        return False

    def optional(self, c: T, rows: Rows) -> Rows:
        """Keep rows without a match: match the distinct bound values, then join back."""
        if rows.unit:
            inner = self.matched(c, self.unit())
            one = self.graph.spark.range(1).select(F.lit(1).alias("_one"))
            new = {v: b for v, b in inner.scope.items()}
            df = one.join(inner.df.withColumn("_two", F.lit(1)), F.col("_one") == F.col("_two"), "left").drop("_one", "_two")
            return Rows(df, new)
        domain, keys, outer = self.domain(rows, [c])
        inner = self.matched(c, domain)
        new = {v: b for v, b in inner.scope.items() if v not in rows.scope}
        cols = [x for b in new.values() for x in b.columns()]
        renamed = {k: fresh("k") for k in keys}
        sub = inner.df.select(*[F.col(domain_col(domain, k)).alias(renamed[k]) for k in keys], *dict.fromkeys(cols), F.lit(True).alias("_hit"))
        on = [F.col(k).eqNullSafe(F.col(renamed[k])) for k in keys]
        df = rows.df.join(sub, on, "left") if on else rows.df.join(sub, F.lit(True), "left")
        return rows.with_(df=df.drop(*renamed.values(), "_hit"), scope={**rows.scope, **new})

    def domain(self, rows: Rows, trees: list, whole: bool = False) -> tuple[Rows, list[str], set[str]]:
        """The distinct outer values that some clauses use: rows, key columns, variables."""
        used = names_in([t for t in trees if t is not None]) | {p.var for t in trees if t is not None for p in t.walk() if p.kind in ("node_pat", "rel_pat", "search") and p.var}
        if whole:
            used = set(rows.scope)
        mine = {v: b for v, b in rows.scope.items() if v in used}
        keys: list[str] = []
        cols: list[str] = []
        for v, b in mine.items():
            if isinstance(b, Element):
                keys.append(b.id)
                want = needs_of(trees, v) if not whole else None
                props = {p: x for p, x in b.props.items() if want is None or p in want}
                mine[v] = Element(b.kind, b.id, b.meta, props, b.known)
                cols += mine[v].columns()
            else:
                keys.append(b.name)
                cols.append(b.name)
        cols, keys = list(dict.fromkeys(cols)), list(dict.fromkeys(keys))
        if not cols:
            return self.unit(), [], set()
        df = rows.df.select(*cols).dropDuplicates(keys) if not any(isinstance(rows.df.schema[k].dataType, S.MapType) for k in keys) else rows.df.select(*cols)
        return Rows(df, mine), keys, set(mine)

    def filtered(self, rows: Rows, conditions: list[T]) -> Rows:
        for p in conditions:
            rows = self.where(rows, p)
        return rows

    def where(self, rows: Rows, p: T) -> Rows:
        """One conjunct; (NOT) EXISTS is a semi or anti join."""
        negative = p.kind == "not"
        sub = p.a if negative else p
        if sub.kind in ("exists", "pattern_pred") and not rows.unit:
            domain, keys, _ = self.domain(rows, [sub])
            inner = self.sub_rows(sub, domain)
            renamed = {k: fresh("k") for k in keys}
            hit = inner.df.select(*[F.col(domain_col(domain, k)).alias(renamed[k]) for k in keys])
            on = [F.col(k).eqNullSafe(F.col(renamed[k])) for k in keys] or [F.lit(True)]
            return rows.with_(df=rows.df.join(hit, on, "left_anti" if negative else "left_semi"))
        rows, (e,) = self.lift(rows, [p])
        return rows.with_(df=rows.df.where(Expressions(rows, self.params).predicate(e)), unit=False)

    def sub_rows(self, e: T, domain: Rows) -> Rows:
        saved = self.imported
        self.imported = saved | set(domain.scope)
        try:
            if e.kind in ("pattern_pred", "pattern_comp"):
                return self.matched(T("match", optional=False, repeatable=False, pattern=[e.part], searches=[], where=e.parts.get("where")), domain)
            return self.body(e.body, domain)
        finally:
            self.imported = saved

    def lift(self, rows: Rows, exprs: list[T]) -> tuple[Rows, list[T]]:
        """Subquery expressions become columns of the rows; the expressions then name those."""
        found: dict[T, T] = {}

        def visit(e: T) -> None:
            nonlocal rows
            if e.kind in SUBS:
                if e not in found:
                    rows, col = self.attach(rows, e)
                    found[e] = col
                return
            if e.kind == "prop" and e.base.kind == "fn" and e.base.name in ("startnode", "endnode") and e.base.args[0].kind == "var":
                el = rows.scope.get(e.base.args[0].name)
                if isinstance(el, Element) and el.kind == "rel":
                    if e not in found:
                        rows, found[e] = self.end_property(rows, F.col(el.meta["src" if e.base.name == "startnode" else "dst"]), e.key)
                    return
            for ch in e.children():
                visit(ch)

        for e in exprs:
            if e is not None:
                visit(e)
        if not found:
            return rows, exprs
        return rows, [replace(e, found) if e is not None else None for e in exprs]

    def end_property(self, rows: Rows, end: F.Column, key: str) -> tuple[Rows, T]:
        """A property of the node at an end of a relationship, joined in by the node's id."""
        nodes = self.graph.scan_nodes(None, {key})
        if key not in nodes.columns:
            return rows, T("lit", value=None)
        node, out = fresh("end"), fresh("p")
        nodes = nodes.select(F.col("_id").alias(node), F.col(f"`{key}`").alias(out))
        return rows.with_(df=rows.df.join(nodes, end == F.col(node), "left").drop(node), unit=False), T("col", name=out, type=nodes.schema[out].dataType)

    def attach(self, rows: Rows, e: T) -> tuple[Rows, T]:
        domain, keys, _ = self.domain(rows, [e])
        inner = self.sub_rows(e, domain)
        renamed = {k: fresh("k") for k in keys}
        key_cols = [F.col(domain_col(domain, k)).alias(renamed[k]) for k in keys]
        out = fresh("sub")
        if e.kind in ("exists", "pattern_pred"):
            sub = inner.df.select(*key_cols).distinct().withColumn(out, F.lit(True)) if keys else inner.df.limit(1).select(F.lit(True).alias(out))
            kind, default = BOOL, F.lit(False)
        elif e.kind == "count_sub":
            sub = inner.df.select(*key_cols).groupBy(*renamed.values()).agg(F.count(F.lit(1)).alias(out)) if keys else inner.df.agg(F.count(F.lit(1)).alias(out))
            kind, default = LONG, F.lit(0).cast("long")
        else:
            if e.kind == "collect_sub":
                names = [v for v in inner.scope if v not in domain.scope]
                if len(names) != 1:
                    raise semantic("COLLECT needs one column")
                b = inner.scope[names[0]]
                v = b.struct() if isinstance(b, Element) else Val(F.col(b.name), b.type)
            else:
                inner, (x,) = self.lift(inner, [e.out])
                v = Expressions(inner, self.params)(x)
            item = F.struct(*[F.col(c).alias(f"o{i}") for i, (c, _) in enumerate(inner.order)], v.col.alias("v"))
            held = F.collect_list(item)
            # nulls survive in the struct; ORDER BY inside decides the order
            if inner.order:
                down = [d for _, d in inner.order]
                held = F.sort_array(held, asc=not down[0]) if len(set(down)) == 1 else held
            held = F.transform(held, lambda x: x["v"])
            kind = S.ArrayType(v.type)
            sub = inner.df.groupBy(*key_cols).agg(held.alias(out)) if keys else inner.df.agg(held.alias(out))
            default = F.array().cast(kind)
        on = [F.col(k).eqNullSafe(F.col(renamed[k])) for k in keys]
        df = rows.df.join(sub, on, "left") if on else (rows.df.crossJoin(sub) if e.kind not in ("exists", "pattern_pred") else rows.df.join(sub, F.lit(True), "left"))
        df = df.withColumn(out, F.coalesce(F.col(out), default)).drop(*renamed.values())
        return rows.with_(df=df, unit=False), T("col", name=out, type=kind)

    def do_filter(self, c: T, rows: Rows) -> Rows:
        return self.filtered(rows, conjuncts(c.where))

    def do_let(self, c: T, rows: Rows) -> Rows:
        for name, e in c.items:
            if name in rows.scope:
                raise semantic(f"{name} is there already")
            rows, (e,) = self.lift(rows, [e])
            v = Expressions(rows, self.params)(e)
            col = fresh("let")
            rows = rows.with_(df=rows.df.withColumn(col, v.col), scope={**rows.scope, name: Value(col, v.type)}, unit=False)
        return rows

    def do_unwind(self, c: T, rows: Rows) -> Rows:
        if c.var in rows.scope:
            raise semantic(f"{c.var} is there already")
        rows, (e,) = self.lift(rows, [c.list])
        v = Expressions(rows, self.params)(e)
        col = fresh("unwind")
        kind = v.type.elementType if isinstance(v.type, S.ArrayType) else v.type
        if not isinstance(v.type, S.ArrayType):
            v = Val(F.when(v.col.isNotNull(), F.array(v.col)) if not isinstance(v.type, S.NullType) else F.array().cast("array<string>"), S.ArrayType(v.type))
        if isinstance(kind, S.NullType):
            kind = STRING
            v = Val(v.col.cast("array<string>"), S.ArrayType(STRING))
        return rows.with_(df=rows.df.withColumn(col, F.explode(v.col)), scope={**rows.scope, c.var: Value(col, kind)}, unit=False, order=[])

    def do_finish(self, c: T, rows: Rows) -> Rows:
        return rows.with_(df=rows.df.where(F.lit(False)), scope={v: b for v, b in rows.scope.items() if v in self.imported})

    def do_load_csv(self, c: T, rows: Rows) -> Rows:
        from ..sources.csvfile import load_csv

        return load_csv(self, c, rows)

    # projection
    def do_with(self, c: T, rows: Rows) -> Rows:
        out = self.projected(c, rows)
        return self.filtered(out, conjuncts(c.where)) if c.where is not None else out

    def do_return(self, c: T, rows: Rows) -> Rows:
        return self.projected(c, rows)

    def projected(self, c: T, rows: Rows) -> Rows:
        items = list(c.items)
        if c.star:
            items = [T("item", expr=T("var", name=v), alias=v, explicit=True) for v in sorted(rows.scope) if not v.endswith("()") and (v not in self.imported or not self.imported)] + items
        names = [i.alias for i in items]
        if len(set(names)) != len(names):
            raise semantic("two columns of one name")
        aggregate = any(has_aggregate(i.expr) for i in items) or c.group is not None or any(has_aggregate(e) for e, _ in c.order)
        carried = {v: b for v, b in rows.scope.items() if v in self.imported and v not in names}
        exprs = [i.expr for i in items] + [e for e, _ in c.order]
        rows, exprs = self.lift(rows, exprs)
        exprs, orders = exprs[: len(items)], exprs[len(items) :]
        if aggregate:
            out, sort = self.aggregated(c, rows, items, exprs, orders, carried)
        else:
            out, sort = self.plain(c, rows, items, exprs, orders, carried)
        return self.paged(c, out, sort)

    def plain(self, c: T, rows: Rows, items: list[T], exprs: list[T], orders: list[T], carried: dict) -> tuple[Rows, list]:
        x = Expressions(rows, self.params)
        scope: dict = dict(carried)
        cols = [F.col(k) for b in carried.values() for k in b.columns()]
        for i, e in zip(items, exprs, strict=True):
            el = x.element(e)
            if el is not None:
                scope[i.alias] = el
                cols += [F.col(k) for k in el.columns()]
                continue
            if e.kind == "var" and isinstance(rows.scope.get(e.name), Value):
                scope[i.alias] = rows.scope[e.name]
                cols.append(F.col(rows.scope[e.name].name))
                continue
            v = x(e)
            name = fresh("v")
            scope[i.alias] = Value(name, v.type)
            cols.append(v.col.alias(name))
        sort = []
        aliases = {i.alias: e for i, e in zip(items, exprs, strict=True)}
        for (_, down), e in zip(c.order, orders, strict=True):
            e = aliased(e, aliases)
            if c.distinct:
                same = next((scope[i.alias] for i, y in zip(items, exprs, strict=True) if y == e), None)
                if isinstance(same, Value):
                    sort.append((same.name, down))
                    continue
                if not (names_in(e) <= set(aliases) | {n for y in exprs for n in names_in(y)}):
                    raise semantic("after DISTINCT only its columns can order")
            name = fresh("sort")
            cols.append(x.sort_key(x(e)).alias(name))
            sort.append((name, down))
        for k, _ in rows.order:
            cols.append(F.col(k))
        seen: dict[str, F.Column] = {}
        for col in cols:
            seen.setdefault(col._jc.toString() if " AS " not in col._jc.toString() else str(id(col)), col)
        df = rows.df.select(*seen.values())
        out = Rows(df, scope, False, [] if c.distinct else list(rows.order))
        if c.distinct:
            keys = [b.id if isinstance(b, Element) else b.name for b in scope.values()]
            out = out.with_(df=out.df.dropDuplicates(list(dict.fromkeys(keys))))
        return out, sort

    def aggregated(self, c: T, rows: Rows, items: list[T], exprs: list[T], orders: list[T], carried: dict) -> tuple[Rows, list]:
        x = Expressions(rows, self.params)
        aliases = {i.alias: e for i, e in zip(items, exprs, strict=True)}
        if c.group is None or c.group == "all":
            keys = [e for e in exprs if not has_aggregate(e)]
        else:
            _, keys = self.lift(rows, [aliased(k, {a: e for a, e in aliases.items() if not has_aggregate(e)}) for k in c.group])
        orders = [aliased(e, aliases) for e in orders]
        key_cols: list[F.Column] = []
        firsts: list[F.Column] = []
        by: dict[T, Val | Element] = {}
        pre: list[F.Column] = []
        for v, b in carried.items():
            key_cols.append(F.col(b.id if isinstance(b, Element) else b.name))
            if isinstance(b, Element):
                firsts += [F.first(F.col(k)).alias(k) for k in b.columns() if k != b.id]
        for k in keys:
            if k in by:
                continue
            if el := x.element(k):
                key_cols.append(F.col(el.id))
                firsts += [F.first(F.col(p)).alias(p) for p in el.columns() if p != el.id]
                by[k] = el
                continue
            v = x(k)
            name = fresh("key")
            if is_node(v.type) or is_rel(v.type) or isinstance(v.type, S.MapType):
                # elements group by identity, maps by their text
                idn = fresh("key")
                pre.append((v.col["_id"] if not isinstance(v.type, S.MapType) else F.to_json(v.col)).alias(idn))
                pre.append(v.col.alias(name))
                key_cols.append(F.col(idn))
                firsts.append(F.first(F.col(name)).alias(name))
            else:
                pre.append(v.col.alias(name))
                key_cols.append(F.col(name))
            by[k] = Val(F.col(name), v.type)
        aggs: dict[T, tuple[str, S.DataType, object]] = {}
        made: list[F.Column] = []

        def collect(e: T) -> None:
            if e.kind == "fn" and e.name in _AGGS:
                if e not in aggs:
                    col, kind, done = x.aggregate(e)
                    name = fresh("agg")
                    aggs[e] = (name, kind, done)
                    made.append(col.alias(name))
                return
            for ch in e.children():
                collect(ch)

        for e in [*exprs, *orders]:
            collect(e)
        pre += [v.alias(k) for k, v in x.held.items()]
        df = rows.df.select("*", *pre) if pre else rows.df
        unique: dict[str, F.Column] = {}
        for k in key_cols:
            unique.setdefault(k._jc.toString(), k)
        present: set[str] = set(unique)
        firsts2 = []
        for f in firsts:
            s = f._jc.toString()
            if s not in present:
                present.add(s)
                firsts2.append(f)
        if unique:
            df = df.groupBy(*unique.values()).agg(*made, *firsts2) if made or firsts2 else df.select(*unique.values()).distinct()
        else:
            df = df.agg(*(made or [F.count(F.lit(1)).alias(fresh("n"))]))
        scope2 = dict(carried)
        for k, v in by.items():
            if k.kind == "var" and isinstance(v, Element):
                scope2[k.name] = v
            elif k.kind == "var":
                scope2[k.name] = Value(v.col._jc.toString().strip("`"), v.type)
        grouped = Rows(df, scope2)

        def known(e: T) -> Val | None:
            if e in aggs:
                name, kind, done = aggs[e]
                return Val(done(F.col(name)), kind)
            v = by.get(e)
            return v.struct() if isinstance(v, Element) else v

        y = Expressions(grouped, self.params, replaced=known)
        scope: dict = dict(carried)
        cols = [F.col(k) for b in carried.values() for k in b.columns()]
        for i, e in zip(items, exprs, strict=True):
            if isinstance(by.get(e), Element):
                scope[i.alias] = by[e]
                cols += [F.col(k) for k in by[e].columns()]
                continue
            v = y(e)
            name = fresh("v")
            scope[i.alias] = Value(name, v.type)
            cols.append(v.col.alias(name))
        sort = []
        for (_, down), e in zip(c.order, orders, strict=True):
            name = fresh("sort")
            cols.append(y.sort_key(y(e)).alias(name))
            sort.append((name, down))
        seen: dict[str, F.Column] = {}
        for col in cols:
            s = col._jc.toString()
            seen.setdefault(s if " AS " not in s else s + str(id(col)), col)
        out = Rows(df.select(*seen.values()), scope)
        if c.distinct:
            out = out.with_(df=out.df.dropDuplicates([b.id if isinstance(b, Element) else b.name for b in scope.values()]))
        return out, sort

    def paged(self, c: T, rows: Rows, sort: list[tuple[str, bool]]) -> Rows:
        """ORDER BY, SKIP and LIMIT; in a subquery for each imported row of its own."""
        cols = [F.col(n).desc_nulls_first() if down else F.col(n).asc_nulls_last() for n, down in sort]
        skip, limit = self.count_of(c.skip, "SKIP"), self.count_of(c.limit, "LIMIT")
        keys = [b.id if isinstance(b, Element) else b.name for v, b in rows.scope.items() if v in self.imported]
        if keys and (skip is not None or limit is not None):
            w = Window.partitionBy(*keys).orderBy(*(cols or [F.lit(0)]))
            n = fresh("rn")
            test = F.col(n) > (skip or 0)
            if limit is not None:
                test = test & (F.col(n) <= (skip or 0) + limit)
            return rows.with_(df=rows.df.withColumn(n, F.row_number().over(w)).where(test).drop(n), order=sort)
        df = rows.df
        if cols and not keys:
            df = df.orderBy(*cols)
        if skip is not None:
            df = df.offset(skip)
        if limit is not None:
            df = df.limit(limit)
        return rows.with_(df=df, order=sort or rows.order)

    def count_of(self, e: T | None, what: str) -> int | None:
        if e is None:
            return None
        v = constant(e, self.params)
        if v is None:  # an expression of constants: one row on the driver
            v = self.graph.spark.range(1).select(Expressions(self.unit(), self.params)(e).col).first()[0]
        if isinstance(v, bool) or not isinstance(v, int) or v < 0:
            raise GraphError("INVALID_ARGUMENT", f"{what} needs an integer of 0 or more")
        return v

    # subqueries and procedures
    def do_call_sub(self, c: T, rows: Rows) -> Rows:
        if c.tx is not None and self.writer is not None:
            return self.writer.in_transactions(self, c, rows)
        body = c.body
        if c.scope == "all":
            names = list(rows.scope)
        elif c.scope is not None:
            names = c.scope
            if missing := [n for n in names if n not in rows.scope]:
                raise semantic(f"no variable {missing[0]}")
        else:
            names, body = self.importing(body, rows)
        outer = {v: rows.scope[v] for v in names}
        keys = list(dict.fromkeys(b.id if isinstance(b, Element) else b.name for b in outer.values()))
        if outer:
            cols = list(dict.fromkeys(k for b in outer.values() for k in b.columns()))
            domain = Rows(rows.df.select(*cols).dropDuplicates(keys), dict(outer))
        else:
            domain = self.unit()
        saved, self.imported = self.imported, set(names)
        try:
            inner = self.body(body, domain)
            if outer and self.global_aggregate(body):
                inner = self.defaults(inner, domain, body, keys)
        finally:
            self.imported = saved
        new = {v: b for v, b in inner.scope.items() if v not in outer}
        if clash := [v for v in new if v in rows.scope]:
            raise semantic(f"{clash[0]} is there already")
        if not new:
            return rows
        renamed = {k: fresh("k") for k in keys}
        cols = list(dict.fromkeys(x for b in new.values() for x in b.columns()))
        sub = inner.df.select(*[F.col(k).alias(renamed[k]) for k in keys], *cols)
        how = "left" if c.optional else "inner"
        if keys:
            df = rows.df.join(sub, [F.col(k).eqNullSafe(F.col(renamed[k])) for k in keys], how).drop(*renamed.values())
        elif rows.unit:
            df = sub
        else:
            df = rows.df.crossJoin(sub) if how == "inner" else rows.df.join(sub, F.lit(True), "left")
        return rows.with_(df=df, scope={**rows.scope, **new}, unit=False)

    def importing(self, body: T, rows: Rows) -> tuple[list[str], T]:
        """A leading WITH of bare variables imports them."""
        if body.kind == "single" and body.clauses[0].kind == "with":
            w = body.clauses[0]
            if all(i.expr.kind == "var" and i.alias == i.expr.name for i in w.items) and not w.order and w.where is None and w.limit is None:
                names = [v for v in rows.scope if not v.endswith("()")] if w.star else [i.alias for i in w.items]
                if all(n in rows.scope for n in names):
                    return names, T("single", clauses=body.clauses[1:])
        return [], body

    def global_aggregate(self, body: T) -> bool:
        last = body.clauses[-1] if body.kind == "single" else None
        return last is not None and last.kind == "return" and any(has_aggregate(i.expr) for i in last.items) and all(has_aggregate(i.expr) or not names_in(i.expr) for i in last.items)

    def defaults(self, inner: Rows, domain: Rows, body: T, keys: list[str]) -> Rows:
        """An aggregate without grouping has a row for inputs without rows too: its value over nothing."""
        empty = Rows(domain.df.limit(0).select(*domain.df.columns), dict(domain.scope))
        saved, self.imported = self.imported, set()
        try:
            zero = self.body(T("single", clauses=[body.clauses[-1]]), _nothing(self, body, empty))
        except GraphError:
            return inner
        finally:
            self.imported = saved
        new = [v for v in inner.scope if v not in domain.scope]
        renamed = {k: fresh("k") for k in keys}
        values = {v: fresh("d") for v in new}
        zero_df = zero.df.select(*[F.col(zero.scope[v].name).alias(values[v]) for v in new])
        sub = inner.df.select(*[F.col(k).alias(renamed[k]) for k in keys], *[inner.scope[v].name for v in new], F.lit(True).alias("_hit"))
        df = domain.df.join(sub, [F.col(k).eqNullSafe(F.col(renamed[k])) for k in keys], "left").crossJoin(F.broadcast(zero_df))  # one row
        cols = [F.col(k) for k in domain.df.columns]
        for v in new:
            cols.append(F.when(F.col("_hit"), F.col(inner.scope[v].name)).otherwise(F.col(values[v]).cast(inner.scope[v].type)).alias(inner.scope[v].name))
        return inner.with_(df=df.select(*cols))

    def do_call_proc(self, c: T, rows: Rows) -> Rows:
        f = self.procedures.get(c.name.lower())
        if f is None:
            raise GraphError("NOT_FOUND", f"no procedure {c.name}")
        args = []
        x = Expressions(self.unit(), self.params)
        for a in c.args or []:
            v = constant(a, self.params, missing=_MISSING)
            args.append(self.graph.spark.range(1).select(x(a).col).first()[0] if v is _MISSING else v)
        df = f(*args)
        items = [(n, n) for n in df.columns] if c.items in (None, "all") else c.items
        scope: dict = {}
        cols = []
        for n, alias in items:
            if n not in df.columns:
                raise semantic(f"{c.name} has no column {n}")
            name = fresh("y")
            cols.append(F.col(n).alias(name))
            scope[alias] = Value(name, df.schema[n].dataType)
        out = df.select(*cols)
        if not rows.unit:
            out = rows.df.crossJoin(out)
        rows = rows.with_(df=out, scope={**rows.scope, **scope}, unit=False)
        return self.filtered(rows, conjuncts(c.where)) if c.where is not None else rows

    def search(self, s: T, out: Rows, before: Rows) -> Rows:
        from ..operators.search import vector_search

        return vector_search(self, s, out, before)

    # writing and schema
    def write(self, c: T, rows: Rows) -> Rows:
        if self.writer is None:
            raise GraphError("READ_ONLY", f"{c.kind.upper()} needs a graph store")
        return self.writer.clause(self, c, rows)

    do_create = do_set = do_remove = do_delete = do_merge = do_foreach = write
    do_create_index = do_create_constraint = do_drop = do_graph_type = write

    def do_show(self, c: T, rows: Rows) -> Rows:
        from .show import show

        return show(self, c, rows)


_AGGS = {"count", "collect", "collect_list", "sum", "avg", "min", "max", "percentilecont", "percentile_cont", "percentiledisc", "percentile_disc", "stdev", "stdev_samp", "stdevp", "stdev_pop"}
_MISSING = object()


def _nothing(compiler: Compiler, body: T, empty: Rows) -> Rows:
    """No rows, with the variables that the last clause of a body sees."""
    saved, compiler.imported = compiler.imported, set(empty.scope)
    try:
        out = compiler.single(T("single", clauses=body.clauses[:-1]), empty) if len(body.clauses) > 1 else empty
    finally:
        compiler.imported = saved
    return out


def constant(e: T, params: dict, missing=None):
    if e.kind == "lit":
        return e.value
    if e.kind == "param" and e.name in params:
        return params[e.name]
    if e.kind == "list":
        out = [constant(x, params, _MISSING) for x in e.items]
        return missing if any(x is _MISSING for x in out) else out
    if e.kind == "map":
        out = {k: constant(x, params, _MISSING) for k, x in e.items}
        return missing if any(x is _MISSING for x in out.values()) else out
    return missing


def conjuncts(e: T) -> list[T]:
    return [*conjuncts(e.a), *conjuncts(e.b)] if e.kind == "and" else [e]


def replace(e: T, found: dict[T, T]) -> T:
    if e in found:
        return found[e]

    def sub(x):
        if isinstance(x, T):
            return replace(x, found)
        if isinstance(x, list):
            return [sub(y) for y in x]
        if isinstance(x, tuple):
            return tuple(sub(y) for y in x)
        return x

    return T(e.kind, **{k: sub(v) for k, v in e.parts.items()})


def aliased(e: T, aliases: dict[str, T]) -> T:
    """ORDER BY may name columns by their alias."""
    return replace(e, {T("var", name=a): x for a, x in aliases.items() if x != T("var", name=a)})


def pushed(pattern: list[T], conditions: list[T], rows: Rows) -> tuple[list[T], list[T]]:
    """Conditions on one node or relationship move into its pattern, where the scan or join sees them first."""
    rest = []
    for c in conditions:
        names = names_in(c)
        target = next(iter(names)) if len(names) == 1 else None
        placed = False
        if target and target not in rows.scope and not has_aggregate(c) and not any(t.kind == "fn" and t.name in ("rand", "randomuuid", "uuid") for t in c.walk()):
            new = []
            for p in pattern:
                elements = []
                for e in p.elements:
                    if not placed and e.kind in ("node_pat", "rel_pat") and e.var == target and not (e.kind == "rel_pat" and (e.legacy or e.quantified)):
                        e = T(e.kind, **{**e.parts, "where": c if e.where is None else T("and", a=e.where, b=c)})
                        placed = True
                    elements.append(e)
                new.append(T("part", **{**p.parts, "elements": elements}))
            # a selector looks at its end nodes only after it has chosen
            if placed and not any(p.selector for p in pattern):
                pattern = new
            else:
                placed = False
        if not placed:
            rest.append(c)
    return pattern, rest


def needs_of(trees: list, var: str) -> set[str] | None:
    out: set[str] = set()
    for t in trees:
        if t is None:
            continue
        n = needs(t)
        if "*" in n:
            return None
        if var in n:
            if n[var] is None:
                return None
            out |= n[var]
    return out


def domain_col(domain: Rows, key: str) -> str:
    return key


