"""MATCH patterns to joins.

A pattern part is walked from a node that is already bound, else from its first node.  A
step joins the rows with the relationship table on the bound end and, only where labels
or properties of the other end are asked for, with its node table.  Relationship
uniqueness is a filter between relationships whose types can coincide.

The steps of a clause go in the order in which they are written, unless rows would be
multiplied on the way that a later step drops: then those steps come first that add no
freedom (see ``ordered``).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..cypher.tree import Tree as T
from ..errors import GraphError, semantic
from ..operators.paths import Step, expand
from ..sources.graph import Graph
from .expressions import Expressions
from .values import LONG, STRING, Element, Rows, Val, Value, fresh, to

ALL = None  # every property
#: Among what is needed of a path: its elements, with the properties named beside it.
ELEMENTS = "_elements"


def required_labels(e: T | None) -> set[str]:
    """Labels that a node must have for an expression to hold."""
    if e is None:
        return set()
    if e.kind == "l_name":
        return {e.name}
    if e.kind == "l_and":
        return set().union(*map(required_labels, e.parts["parts"]))
    return set()


def possible_types(e: T | None) -> set[str] | None:
    """Types that a relationship can have (None: any)."""
    if e is None:
        return None
    if e.kind == "l_name":
        return {e.name}
    if e.kind == "l_or":
        parts = [possible_types(p) for p in e.parts["parts"]]
        return None if None in parts else set().union(*parts)
    if e.kind == "l_and":
        parts = [p for p in map(possible_types, e.parts["parts"]) if p is not None]
        return set.intersection(*parts) if parts else None
    return None


class Matcher:
    def __init__(self, graph: Graph, params: dict, needed: dict[str, set[str] | None]):
        self.graph, self.params, self.needed = graph, params, needed
        self.also: set[str] | None = set()  # while a part is compiled, what is read of all its path's elements

    def keep(self, var: str | None) -> set[str] | None:
        own = self.needed.get(var, set()) if var else set()
        return ALL if own is ALL or self.also is ALL else own | self.also

    def elementwise(self, part: T) -> bool:
        """Whether more is read of a part's path than ids."""
        wanted = self.needed.get(part.path, set()) if part.path is not None else set()
        return wanted is ALL or ELEMENTS in wanted

    def match(self, rows: Rows, parts: list[T], repeatable: bool = False) -> Rows:
        used: list[tuple[str, str, set[str] | None]] = []  # (one or many, column, types) of the clause's relationships
        pending = self.ordered(rows, parts)
        while pending:  # parts that touch bound variables come first; others would be products
            i = next((k for k, p in enumerate(pending) if self.anchors(rows, p)), 0)
            rows = self.part(rows, pending.pop(i), used, repeatable)
        return rows

    def ordered(self, rows: Rows, parts: list[T]) -> list[T]:
        """The parts, cut into steps in another order where that keeps the rows fewer.

        What a row holds follows from some of its elements: a relationship gives both its ends, and a node the
        relationship of which it has one at most.  The least number of elements from which the others follow is the
        power of the tables' size that bounds the rows.  Customers and suppliers that only a nation joins take two,
        which is a product; customers, their orders and the lines of those take one.  Each time the step is taken
        after which that number is least; where the greatest is no less than in the written order, that one stays.
        """
        elements = [e for p in parts for e in p.elements]
        plain = all(e.kind == "node_pat" or e.kind == "rel_pat" and not (e.legacy or e.quantified) for e in elements) and all(p.parts.get(k) is None for p in parts for k in ("path", "selector", "mode"))
        if not plain or any(self.refers_outside(e) for e in elements):
            return list(parts)
        if any(isinstance(rows.scope.get(e.var), Value if e.kind == "node_pat" else Element) for e in elements):
            return list(parts)
        named = [T("part", elements=[T(e.kind, **{**e.parts, "var": e.var or fresh("anon")}) for e in self.normalised(p.elements)]) for p in parts]
        bound = {v for v, b in rows.scope.items() if isinstance(b, Element)}
        steps = self.steps(named, set(bound))
        asked = [e for p in named for e in p.elements if e.kind == "node_pat" and any(e.parts[k] is not None for k in ("labels", "props", "where"))]
        if len({r.var for _, r, _ in steps}) < len(steps) or len({e.var for e in asked}) < len(asked) or self.peak(steps, bound) <= self.freedom(steps, bound):
            return list(parts)
        left, order, have = list(steps), [], set(bound)
        while left:
            near = [s for s in left if have & {s[0].var, s[2].var}] or left[:1]
            best = min(near, key=lambda s: (self.freedom([*order, s], bound), not {s[0].var, s[2].var} <= have))
            left = [s for s in left if s is not best]
            order.append(best)
            have |= {best[0].var, best[2].var}
        if self.peak(order, bound) >= self.peak(steps, bound):
            return list(parts)
        asks, out = {e.var: e for e in asked}, []

        def node(name: str) -> T:  # what the clause asks of a node is asked where it first comes
            return asks.pop(name, None) or T("node_pat", var=name, labels=None, props=None, where=None)

        for a, rel, b in order:
            out.append(T("part", path=None, selector=None, count=None, mode=None, elements=[node(a.var), rel, node(b.var)], text=""))
        return out + [p for p, n in zip(parts, named, strict=True) if len(n.elements) == 1 and n.elements[0].var not in have]

    def steps(self, parts: list[T], have: set[str]) -> list[tuple[T, T, T]]:
        """(left node, relationship, right node) in the order in which the parts are walked."""
        out, pending = [], list(parts)
        while pending:
            p = pending.pop(next((k for k, p in enumerate(pending) if any(e.kind == "node_pat" and e.var in have for e in p.elements)), 0))
            nodes = [i for i, e in enumerate(p.elements) if e.kind == "node_pat"]
            start = next((i for i in nodes if p.elements[i].var in have), self.best_start(p.elements, nodes))
            out += [tuple(p.elements[i : i + 3]) for i in nodes if start <= i < nodes[-1]]
            out += [tuple(p.elements[i - 2 : i + 1]) for i in reversed(nodes) if 0 < i <= start]
            have |= {e.var for e in p.elements if e.kind == "node_pat"}
        return out

    def freedom(self, steps: list[tuple[T, T, T]], bound: set[str]) -> int:
        """The least number of elements of the steps from which, with what is bound, all others follow."""
        follow: dict[str, set[str]] = {}
        for left, rel, right in steps:
            types = possible_types(rel.types)
            tables = [t for t in self.graph.rels if types is None or t.type in types]
            follow.setdefault(rel.var, set()).update((left.var, right.var))
            for end, node in zip(("_src", "_dst") if rel.direction == "out" else ("_dst", "_src"), (left, right), strict=True):
                follow.setdefault(node.var, set())
                if rel.direction != "any" and tables and all(end in t.single for t in tables):
                    follow[node.var].add(rel.var)

        def reach(starts: set[str]) -> set[str]:
            out, todo = set(starts), list(starts)
            while todo:
                new = follow.get(todo.pop(), set()) - out
                out |= new
                todo += new
            return out

        known, count = reach(bound), 0
        rest = {e: reach({e}) for e in follow if e not in known}
        while rest:  # an element that follows from none but those that follow from it
            e = max(rest, key=lambda e: len(rest[e]))
            known |= rest[e]
            rest = {k: v for k, v in rest.items() if k not in known}
            count += 1
        return count

    def peak(self, steps: list[tuple[T, T, T]], bound: set[str]) -> int:
        return max((self.freedom(steps[: i + 1], bound) for i in range(len(steps))), default=0)

    def anchors(self, rows: Rows, part: T) -> bool:
        return any(e.kind == "node_pat" and e.var in rows.scope for e in part.elements)

    # single parts
    def part(self, rows: Rows, part: T, used: list, repeatable: bool) -> Rows:
        before, wanted = self.also, self.needed.get(part.path, set()) if self.elementwise(part) else set()
        self.also = ALL if before is ALL or wanted is ALL else before | wanted
        try:
            return self.walked(rows, part, used, repeatable)
        finally:
            self.also = before

    def walked(self, rows: Rows, part: T, used: list, repeatable: bool) -> Rows:
        elements = self.normalised(part.elements)
        quantified = any(e.kind == "group" or e.kind == "rel_pat" and (e.legacy or e.quantified) for e in elements)
        nodes = [i for i, e in enumerate(elements) if e.kind == "node_pat"]
        bound = [i for i in nodes if isinstance(rows.scope.get(elements[i].var), Element)]
        for i in nodes:
            b = rows.scope.get(elements[i].var)
            if isinstance(b, Value):
                rows = self.unpacked(rows, elements[i].var, b)
                bound.append(i)
        start = bound[0] if bound else self.best_start(elements, nodes)
        names: dict[int, str] = {i: elements[i].var or fresh("anon") for i in nodes}
        mine: list[tuple[str, str, set[str] | None]] = []
        path_steps: dict[int, tuple[str, str]] = {}
        rows = self.node(rows, elements, start, names[start])
        for direction in (1, -1):
            i = start
            while 0 <= i + 2 * direction < len(elements):
                rel, other = elements[i + direction], i + 2 * direction
                if rel.kind == "group" or rel.legacy or rel.quantified:
                    rows = self.walk(rows, part, elements, i, direction, names, used + mine, mine, path_steps, repeatable)
                else:
                    rows = self.step(rows, elements, i, direction, names, used + mine, mine, path_steps, repeatable)
                i = other
        used.extend(mine)
        if part.path:
            rows = self.path(rows, part, elements, names, path_steps)
        if part.selector and not quantified:
            rows = self.select(rows, part, names[0], names[len(elements) - 1], F.lit(len(elements) // 2), rows)
        return rows

    def normalised(self, elements: list[T]) -> list[T]:
        """Node, relationship or group, node, ...: groups that stand side by side share a node without conditions."""
        empty = T("node_pat", var=None, labels=None, props=None, where=None)
        out: list[T] = []
        for e in elements:
            if out and e.kind == "node_pat" and out[-1].kind == "node_pat":
                a = out.pop()  # (a)((x)-->(y))(b) has its ends given; (a)(b) side by side are one node
                if a.var and e.var:
                    raise semantic("two nodes side by side")
                e = a if a.var or a.labels else e
            if e.kind in ("group", "rel_pat") and (not out or out[-1].kind != "node_pat"):
                out.append(empty)
            out.append(e)
        if out[-1].kind != "node_pat":
            out.append(empty)
        return out

    def best_start(self, elements: list[T], nodes: list[int]) -> int:
        def cost(i):
            e = elements[i]
            return (e.props is None and e.where is None, e.labels is None, i)

        return min(nodes, key=cost) if len(nodes) > 1 else 0

    def unpacked(self, rows: Rows, name: str, b: Value) -> Rows:
        """A node that is a value (an element of a list, say) becomes a bound node."""
        names = b.type.names if isinstance(b.type, S.StructType) else []
        if "_id" not in names:
            raise GraphError("TYPE_ERROR", f"{name} is no node")
        el = Element("node" if "_labels" in names else "rel", fresh("id"), {})
        cols = {el.id: F.col(b.name)["_id"]}
        for f in b.type:
            if f.name == "_id":
                continue
            c = fresh("p")
            cols[c] = F.col(b.name)[f.name]
            if f.name.startswith("_"):
                el.meta[f.name[1:]] = c
            else:
                el.props[f.name] = (c, f.dataType)
        return rows.with_(df=rows.df.withColumns(cols), scope={**rows.scope, name: el})

    # nodes
    def scan(self, pattern: T, var: str | None) -> tuple[DataFrame, Element]:
        wanted = required_labels(pattern.labels)
        keep = self.keep(var)
        conditions = self.mentioned(pattern)
        df = self.graph.scan_nodes(wanted, None if keep is ALL or conditions is ALL else keep | conditions)
        return self.renamed(df, "node", frozenset(wanted))

    def mentioned(self, pattern: T) -> set[str] | None:
        out: set[str] = set()
        if pattern.props is not None:
            out |= {k for k, _ in pattern.props.items} if pattern.props.kind == "map" else set(self.params.get(pattern.props.name, {}))
        if pattern.where is not None:
            for t in pattern.where.walk():
                if t.kind == "prop" and t.base.kind == "var" and t.base.name == pattern.var:
                    out.add(t.key)
        return out

    def renamed(self, df: DataFrame, kind: str, known: frozenset[str] = frozenset()) -> tuple[DataFrame, Element]:
        el = Element(kind, fresh("id"), {}, {}, known)
        cols = []
        for f in df.schema:
            c = el.id if f.name == "_id" else fresh("p")
            cols.append(F.col(f"`{f.name}`").alias(c))
            if f.name == "_id":
                continue
            if f.name in ("_labels", "_type", "_src", "_dst"):
                el.meta[f.name[1:]] = c
            else:
                el.props[f.name] = (c, f.dataType)
        return df.select(*cols), el

    def conditions(self, rows: Rows, pattern: T, name: str, el: Element) -> F.Column | None:
        """Labels, inline properties and inline WHERE of a pattern."""
        scope = {**rows.scope, name: el}
        x = Expressions(rows.with_(scope=scope), self.params)
        out = None

        def also(c):
            nonlocal out
            out = c if out is None else out & c

        labels = pattern.parts.get("labels") if pattern.kind == "node_pat" else pattern.parts.get("types")
        if labels is not None:
            if el.kind == "node":
                if not required_labels(labels) <= el.known or labels.kind not in ("l_name", "l_and") or any(p.kind != "l_name" for p in labels.parts.get("parts", ())):
                    also(x.label_test(labels, F.col(el.meta["labels"])))
            elif possible_types(labels) is None or labels.kind not in ("l_name", "l_or"):
                also(x.type_test(labels, F.col(el.meta["type"])))
        if pattern.props is not None:
            items = pattern.props.items if pattern.props.kind == "map" else [(k, T("lit", value=v)) for k, v in self.params.get(pattern.props.name, {}).items()]
            for k, v in items:
                also(x(T("cmp", op="=", a=T("prop", base=T("var", name=name), key=k), b=v)).col.cast("boolean"))
        if pattern.where is not None:
            also(x.predicate(pattern.where))
        return out

    def node(self, rows: Rows, elements: list[T], i: int, name: str) -> Rows:
        """Bind the node at ``i``, or filter it where it is bound."""
        pattern = elements[i]
        bound = rows.scope.get(name)
        if isinstance(bound, Element):
            rows, bound = self.with_parts(rows, name, bound, pattern)
            c = self.conditions(rows, pattern, name, bound)
            return rows if c is None else rows.with_(df=rows.df.where(c))
        df, el = self.scan(pattern, pattern.var)
        if not rows.unit:
            df = rows.df.crossJoin(df)
        out = rows.with_(df=df, scope={**rows.scope, name: el}, unit=False)
        c = self.conditions(out, pattern, name, el)
        return out if c is None else out.with_(df=out.df.where(c))

    def with_parts(self, rows: Rows, name: str, el: Element, pattern: T) -> tuple[Rows, Element]:
        """Fetch labels and properties of a bound node of which only the id is there."""
        keep = self.keep(name)
        wanted = self.mentioned(pattern)
        lacks = pattern.labels is not None and "labels" not in el.meta or wanted is not ALL and wanted - set(el.props) or (keep is ALL or keep) and "labels" not in el.meta
        if not lacks:
            return rows, el
        df, full = self.scan(T("node_pat", var=pattern.var or name, labels=None, props=pattern.props, where=pattern.where), pattern.var or name)
        joined = rows.df.join(df, F.col(el.id) == F.col(full.id), "left")
        new = Element("node", el.id, full.meta, full.props)
        return rows.with_(df=joined, scope={**rows.scope, name: new}), new

    # one relationship
    def rels(self, pattern: T, leftward: bool) -> tuple[DataFrame, Element, str, str, set[str] | None, list]:
        """The relationships of a step with the columns of its near and far end."""
        types = possible_types(pattern.types)
        keep, mentioned = self.keep(pattern.var), self.mentioned(pattern)
        df = self.graph.scan_rels(types, None if keep is ALL or mentioned is ALL else keep | mentioned)
        df, el = self.renamed(df, "rel")
        direction = pattern.direction
        if leftward:
            direction = {"out": "in", "in": "out"}.get(direction, "any")
        src, dst = el.meta["src"], el.meta["dst"]
        near, far = fresh("near"), fresh("far")
        if direction == "any":
            # both ways; a loop once
            both = df.select("*", F.explode(F.when(F.col(src) == F.col(dst), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))).alias("_fwd"))
            df = both.withColumn(near, F.when(F.col("_fwd"), F.col(src)).otherwise(F.col(dst))).withColumn(far, F.when(F.col("_fwd"), F.col(dst)).otherwise(F.col(src))).drop("_fwd")
        else:
            a, b = (src, dst) if direction == "out" else (dst, src)
            df = df.withColumn(near, F.col(a)).withColumn(far, F.col(b))
        tables = [t for t in self.graph.rels if types is None or t.type in types]
        ends = [(t.target if direction == "out" else t.source if direction == "in" else None, t.sound) for t in tables]
        return df, el, near, far, types, ends

    def unused(self, pattern: T, labels_known: set[str] | None, ends: list) -> bool:
        """Whether a node's table need not be read: nothing of it is asked for that its relationships do not say."""
        if pattern.props is not None or pattern.where is not None or not ends:
            return False
        keep = self.keep(pattern.var)
        if keep is ALL or keep:
            return False
        wanted = required_labels(pattern.labels)
        if pattern.labels is not None and pattern.labels.kind not in ("l_name", "l_and"):
            return False
        return all(sound and labels is not None and wanted <= set(labels) for labels, sound in ends) if pattern.labels is not None else all(sound for _, sound in ends)

    def step(self, rows: Rows, elements: list[T], i: int, direction: int, names: dict, used: list, mine: list, path_steps: dict, repeatable: bool) -> Rows:
        rel, other = elements[i + direction], i + 2 * direction
        if isinstance(rows.scope.get(rel.var), Element):
            return self.bound_rel(rows, elements, i, direction, names)
        df, el, near, far, types, ends = self.rels(rel, direction < 0)
        name = rel.var or fresh("anon")
        here = rows.scope[names[i]]
        c = self.conditions(Rows(df, {name: el}), rel, name, el) if not self.refers_outside(rel) else None
        if c is not None:
            df = df.where(c)
        on = F.col(here.id) == F.col(near)
        target = elements[other]
        there = rows.scope.get(names[other])
        if isinstance(there, Element):  # both ends bound
            on = on & (F.col(there.id) == F.col(far))
        out = rows.df.join(df, on)
        scope = {**rows.scope, name: el}
        if not isinstance(there, Element):
            if self.unused(target, None, ends):
                node = Element("node", fresh("id"), {})
                out = out.withColumn(node.id, F.col(far))
            else:
                nodes, node = self.scan(target, target.var)
                condition = self.conditions(Rows(nodes, {names[other]: node}), target, names[other], node) if not self.refers_outside(target) else None
                if condition is not None:
                    nodes = nodes.where(condition)
                out = out.join(nodes, F.col(far) == F.col(node.id))
            scope[names[other]] = node
        elif any(target.parts[k] is not None for k in ("labels", "props", "where")):
            rows2, there = self.with_parts(Rows(out, scope), names[other], there, target)
            out, scope = rows2.df, rows2.scope
            condition = self.conditions(Rows(out, scope), target, names[other], there)
            out = out if condition is None else out.where(condition)
        if not repeatable:
            for kind, column, others in used:
                if types is None or others is None or types & others:
                    out = out.where(F.col(el.id) != F.col(column) if kind == "one" else ~F.array_contains(F.col(column), F.col(el.id)))
        mine.append(("one", el.id, types))
        path_steps[i + direction] = ("one", name)
        result = rows.with_(df=out.drop(near, far), scope=scope, unit=False)
        for pattern, label in ((rel, name), (target, names[other])):
            if self.refers_outside(pattern):
                c = self.conditions(result, pattern, label, result.scope[label])
                if c is not None:
                    result = result.with_(df=result.df.where(c))
        return result

    def bound_rel(self, rows: Rows, elements: list[T], i: int, direction: int, names: dict) -> Rows:
        rel, other = elements[i + direction], i + 2 * direction
        el, here = rows.scope[rel.var], rows.scope[names[i]]
        way = {"out": "in", "in": "out"}.get(rel.direction, "any") if direction < 0 else rel.direction
        src, dst = F.col(el.meta["src"]), F.col(el.meta["dst"])
        me = F.col(here.id)
        test, far = {"out": (me == src, dst), "in": (me == dst, src), "any": ((me == src) | (me == dst), F.when(me == src, dst).otherwise(src))}[way]
        df = rows.df.where(test)
        there = rows.scope.get(names[other])
        if isinstance(there, Element):
            return rows.with_(df=df.where(far == F.col(there.id)))
        column = fresh("far")
        df = df.withColumn(column, far)
        nodes, node = self.scan(elements[other], elements[other].var)
        c = self.conditions(Rows(nodes, {names[other]: node}), elements[other], names[other], node)
        nodes = nodes if c is None else nodes.where(c)
        return rows.with_(df=df.join(nodes, F.col(column) == F.col(node.id)), scope={**rows.scope, names[other]: node})

    def refers_outside(self, pattern: T) -> bool:
        mine = {pattern.parts.get("var")}
        trees = [x for x in (pattern.parts.get("props"), pattern.parts.get("where")) if isinstance(x, T)]
        return any(t.kind == "var" and t.name not in mine for x in trees for t in x.walk())

    # quantified relationships and groups
    def walk(self, rows: Rows, part: T, elements: list[T], i: int, direction: int, names: dict, used: list, mine: list, path_steps: dict, repeatable: bool) -> Rows:
        rel, other = elements[i + direction], i + 2 * direction
        low, high = rel.low, rel.high
        if high is None and (repeatable or part.mode == "WALK") and part.selector is None:
            raise semantic("an unbounded quantifier needs a path mode that ends")
        if rel.kind == "rel_pat" and rel.legacy and high is not None and low > high:
            return rows.with_(df=rows.df.where(F.lit(False)), scope={**rows.scope, **({rel.var: Value(fresh("none"), S.ArrayType(LONG))} if rel.var else {})})
        step, types = self.hop(part, rel, direction < 0)
        here = rows.scope[names[i]]
        there = rows.scope.get(names[other])
        starts = rows.df.select(F.col(here.id).alias("start")).distinct()
        reached = expand(
            starts, step, low, high,
            mode=part.mode or ("WALK" if repeatable else "TRAIL"),
            selector=part.selector if len(elements) == 3 else None,
            count=part.count if not isinstance(part.count, T) else self.params[part.count.name],
            ends=rows.df.select(F.col(there.id).alias("end")).distinct() if isinstance(there, Element) else self.targets(elements[other], part),
        )
        fixed = {c: fresh(c.strip("_")) for c in reached.columns}
        reached = reached.select(*[F.col(c).alias(n) for c, n in fixed.items()])
        on = F.col(here.id) == F.col(fixed["start"])
        if isinstance(there, Element):
            on = on & (F.col(there.id) == F.col(fixed["end"]))
        df = rows.df.join(reached, on)
        if direction < 0:  # lists go from left to right, whichever end the walk began at
            df = df.withColumns({fixed[f"g_{v}"]: F.reverse(F.col(fixed[f"g_{v}"])) for v in step.carried})
        scope = dict(rows.scope)
        for v, t in step.carried.items():
            scope[v] = Value(fixed[f"g_{v}"], S.ArrayType(t))
        out = rows.with_(df=df, scope=scope, unit=False)
        if isinstance(there, Element):
            c = self.conditions(out, elements[other], names[other], there)
            out = out if c is None else out.with_(df=out.df.where(c))
        else:
            nodes, node = self.scan(elements[other], elements[other].var)
            c = self.conditions(Rows(nodes, {names[other]: node}), elements[other], names[other], node) if not self.refers_outside(elements[other]) else None
            nodes = nodes if c is None else nodes.where(c)
            out = out.with_(df=out.df.join(nodes, F.col(fixed["end"]) == F.col(node.id)), scope={**out.scope, names[other]: node})
        if not repeatable:
            for kind, column, others in used:
                if types is None or others is None or types & others:
                    out = out.with_(df=out.df.where(~F.array_contains(F.col(fixed["rels"]), F.col(column)) if kind == "one" else ~F.arrays_overlap(F.col(fixed["rels"]), F.col(column))))
        mine.append(("many", fixed["rels"], types))
        path_steps[i + direction] = ("many" if direction > 0 else "back", (fixed["rels"], fixed["nodes"], fixed.get("g__pn"), fixed.get("g__pr")))
        return out

    def targets(self, pattern: T, part: T) -> DataFrame | None:
        """Ids of the nodes a path may end at, where a selector must know them while it searches."""
        if part.selector is None or self.refers_outside(pattern) or pattern.labels is None and pattern.props is None and pattern.where is None:
            return None
        df, el = self.scan(pattern, pattern.var or "_")
        c = self.conditions(Rows(df, {pattern.var or "_": el}), pattern, pattern.var or "_", el)
        return (df if c is None else df.where(c)).select(F.col(el.id).alias("end"))

    def hop(self, part: T, rel: T, leftward: bool) -> tuple[Step, set[str] | None]:
        """One repetition: near and far end, its relationships and nodes, and what its variables hold."""
        full = self.elementwise(part)
        if rel.kind == "rel_pat":
            df, el, near, far, types, _ = self.rels(rel, leftward)
            name = rel.var or "_r"
            c = self.conditions(Rows(df, {name: el}), rel, name, el)
            if c is not None:
                df = df.where(c)
            cols = [F.col(near).alias("near"), F.col(far).alias("far"), F.array(F.col(el.id)).alias("rels"), F.array(F.col(far)).alias("nodes")]
            carried: dict[str, S.DataType] = {}
            if rel.var:
                v = el.struct()
                cols.append(v.col.alias(f"g_{rel.var}"))
                carried[rel.var] = v.type
            if full:
                r = el.struct()
                nodes, node = self.renamed(self.ends_of(types).scan_nodes(None, self.also), "node")
                nodes = nodes.select(F.col(node.id).alias("_far_id"), node.struct().col.alias("g__pn"))
                df = df.join(nodes, F.col(far) == F.col("_far_id"))
                cols += [F.col("g__pn"), r.col.alias("g__pr")]
                carried |= {"_pn": node.struct().type, "_pr": r.type}
            return Step(df.select(*cols), carried, single=True), types
        inner = T("part", path=None, selector=None, count=None, mode=None, elements=rel.elements, text="")
        rows = self.match(Rows(self.graph.spark.range(1).select(), {}, True), [self.named(inner)])
        elements = self.normalised(self.named_elements)
        if rel.where is not None:
            rows = rows.with_(df=rows.df.where(Expressions(rows, self.params).predicate(rel.where)))
        nodes = [rows.scope[e.var] for e in elements if e.kind == "node_pat"]
        rels = [rows.scope[e.var] for e in elements if e.kind == "rel_pat"]
        if any(not isinstance(r, Element) for r in rels):
            raise GraphError("UNSUPPORTED", "a quantifier inside a quantified group")
        first, last = (nodes[-1], nodes[0]) if leftward else (nodes[0], nodes[-1])
        if leftward:
            nodes, rels = nodes[::-1], rels[::-1]
        cols = [F.col(first.id).alias("near"), F.col(last.id).alias("far"), F.array(*[F.col(r.id) for r in rels]).alias("rels"), F.array(*[F.col(n.id) for n in nodes[1:]]).alias("nodes")]
        carried = {}
        for v, b in rows.scope.items():
            if not v.startswith("_g"):
                x = b.struct() if isinstance(b, Element) else Val(F.col(b.name), b.type)
                cols.append(x.col.alias(f"g_{v}"))
                carried[v] = x.type
        return Step(rows.df.select(*cols), carried, single=len(rels) == 1), None

    def ends_of(self, types: set[str] | None) -> Graph:
        """The graph with the node tables only that relationships of the types can end in."""
        ends = [labels for t in self.graph.rels if types is None or t.type in types for labels in (t.source, t.target)]
        if not ends or None in ends:
            return self.graph
        return replace(self.graph, nodes=[t for t in self.graph.nodes if t.labels is None or any(set(labels) <= set(t.labels) for labels in ends)])

    def named(self, part: T) -> T:
        self.named_elements = [T(e.kind, **{**e.parts, "var": e.parts.get("var") or fresh("g")}) if e.kind != "group" else e for e in part.elements]
        return T("part", **{**part.parts, "elements": self.named_elements})

    # paths
    def path(self, rows: Rows, part: T, elements: list[T], names: dict, steps: dict) -> Rows:
        """The path as struct(_nodes, _rels): whole elements where the query asks for them, ids else."""
        full = self.elementwise(part)
        bare_n = S.StructType([S.StructField("_id", LONG), S.StructField("_labels", S.ArrayType(STRING))])
        bare_r = S.StructType([S.StructField("_id", LONG), S.StructField("_type", STRING), S.StructField("_src", LONG), S.StructField("_dst", LONG)])
        ns: list[Val] = []
        rs: list[Val] = []

        def one(el: Element) -> Val:
            return el.struct()

        for i, e in enumerate(elements):
            if e.kind == "node_pat":
                if i == 0 or elements[i - 1].kind == "rel_pat" and not (elements[i - 1].legacy or elements[i - 1].quantified):
                    v = one(rows.scope[names[i]])
                    ns.append(Val(F.array(v.col), S.ArrayType(v.type)))
                continue
            kind, what = steps[i]
            if kind == "one":
                v = one(rows.scope[what])
                rs.append(Val(F.array(v.col), S.ArrayType(v.type)))
                continue
            rels, nodes, gn, gr = what
            if kind == "back":
                # the walk began at the node on the right: of the nodes that it came by, the last is the one on
                # the left, which is there already, and the first is where it began
                here = one(rows.scope[names[i + 1]]) if full and gn else Val(F.struct(F.col(rows.scope[names[i + 1]].id).alias("_id"), F.lit(None).cast("array<string>").alias("_labels")), bare_n)
                moved = F.size(F.col(nodes)) > 0
                begin = Val(F.filter(F.array(here.col), lambda _: moved), S.ArrayType(here.type))  # noqa: B023  (called at once)
                inner = F.greatest(F.size(F.col(nodes)) - 1, F.lit(0))
                if full and gn:
                    ns += [Val(F.slice(F.col(gn), F.lit(2), inner), rows.df.schema[gn].dataType), begin]
                    rs.append(Val(F.col(gr), rows.df.schema[gr].dataType))
                else:
                    between = F.reverse(F.slice(F.col(nodes), F.lit(1), inner))
                    ns += [Val(F.transform(between, lambda x: F.struct(x.alias("_id"), F.lit(None).cast("array<string>").alias("_labels"))), S.ArrayType(bare_n)), begin]
                    rs.append(Val(F.transform(F.reverse(F.col(rels)), lambda x: F.struct(x.alias("_id"), F.lit(None).cast("string").alias("_type"), F.lit(None).cast("long").alias("_src"), F.lit(None).cast("long").alias("_dst"))), S.ArrayType(bare_r)))
                continue
            if full and gn:
                ns.append(Val(F.col(gn), rows.df.schema[gn].dataType))
                rs.append(Val(F.col(gr), rows.df.schema[gr].dataType))
            else:
                ns.append(Val(F.transform(F.col(nodes), lambda x: F.struct(x.alias("_id"), F.lit(None).cast("array<string>").alias("_labels"))), S.ArrayType(bare_n)))
                rs.append(Val(F.transform(F.col(rels), lambda x: F.struct(x.alias("_id"), F.lit(None).cast("string").alias("_type"), F.lit(None).cast("long").alias("_src"), F.lit(None).cast("long").alias("_dst"))), S.ArrayType(bare_r)))
        from .values import common

        nt = common([v.type for v in ns])
        rt = common([v.type for v in rs]) if rs else S.ArrayType(bare_r)
        nodes = F.concat(*[to(v, nt) for v in ns])
        rels = F.concat(*[to(v, rt) for v in rs]) if rs else F.array().cast(rt)
        column = fresh("path")
        kind = S.StructType([S.StructField("_nodes", nt), S.StructField("_rels", rt)])
        return rows.with_(df=rows.df.withColumn(column, F.struct(nodes.alias("_nodes"), rels.alias("_rels"))), scope={**rows.scope, part.path: Value(column, kind)})

    def select(self, rows: Rows, part: T, first: str, last: str, hops, before: Rows) -> Rows:
        """ANY and SHORTEST on a part of fixed length: all its paths are equally long."""
        from pyspark.sql import Window

        count = part.count if not isinstance(part.count, T) else self.params[part.count.name]
        if part.selector in ("all_shortest", "groups"):
            return rows
        n = 1 if part.selector == "any_shortest" else count
        w = Window.partitionBy(F.col(rows.scope[first].id), F.col(rows.scope[last].id)).orderBy(*[F.col(b.id) for b in rows.scope.values() if isinstance(b, Element) and b.kind == "rel"] or [F.lit(0)])
        c = fresh("rn")
        return rows.with_(df=rows.df.withColumn(c, F.row_number().over(w)).where(F.col(c) <= n).drop(c))
