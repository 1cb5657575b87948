"""Write clauses as changed records.

Each clause materialises its input rows (with a dense row number, which orders writes),
derives the changed records from them, and stages these; later clauses see the staged
state.  Where several rows write one slot, the row of the greatest number wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..cypher.tree import Tree as T
from ..cypher.tree import names_in
from ..errors import GraphError, semantic
from ..plans.expressions import Expressions
from ..plans.patterns import required_labels
from ..plans.query import Compiler
from ..plans.scratch import written
from ..plans.values import STRING, Element, Rows, Val, Value, fresh, is_map, is_node, is_path, is_rel
from .codec import encode, tag_of
from .state import State

ROW = "_row"
#: Staged changes that a plan applies one upon another before the state is written.
DEPTH = 8


class Writer:
    def __init__(self, store, state: State, schema: dict):
        self.store, self.schema = store, schema
        self.state = State(state.nodes, state.rels, (state.kinds or state.scan_kinds()).copy())
        self.node_deltas: list[DataFrame] = []
        self.rel_deltas: list[DataFrame] = []
        self.counters: dict[str, int] = {}
        self.schema_changed = False

    # plumbing
    def stage(self, compiler: Compiler, nodes: DataFrame | None, rels: DataFrame | None) -> None:
        if nodes is not None:
            nodes = written(nodes, "delta-nodes")
            self.node_deltas.append(nodes)
        if rels is not None:
            rels = written(rels, "delta-rels")
            self.rel_deltas.append(rels)
        self.state = self.state.apply(nodes, rels)
        if (len(self.node_deltas) + len(self.rel_deltas)) % DEPTH == 0:  # the plan would grow with every clause
            self.state = self.state.kept("staged")
        compiler.graph = self.state.graph(compiler.graph.spark, self.schema)

    def count(self, name: str, n: int) -> None:
        if n:
            self.counters[name] = self.counters.get(name, 0) + n

    def numbered(self, rows: Rows) -> Rows:
        """Rows as a table with a dense number in ``ROW``."""
        if rows.unit:
            return rows.with_(df=rows.df.withColumn(ROW, F.lit(0).cast("long")), unit=False)
        df = rows.df.drop(ROW) if ROW in rows.df.columns else rows.df
        df = df.withColumn("_pid", F.spark_partition_id())
        df = df.withColumn("_i", F.row_number().over(Window.partitionBy("_pid").orderBy(F.monotonically_increasing_id())))
        df = written(df, "rows")
        sizes = df.groupBy("_pid").count().orderBy("_pid").collect()  # a row for each partition
        base, at = [], 0
        for pid, n in sizes:
            base.append((pid, at))
            at += n
        offsets = df.sparkSession.createDataFrame(base or [(0, 0)], "_pid int, _base long")
        return rows.with_(df=df.join(F.broadcast(offsets), "_pid").withColumn(ROW, F.col("_base") + F.col("_i") - 1).drop("_pid", "_i", "_base"), unit=False)

    def clause(self, compiler: Compiler, c: T, rows: Rows) -> Rows:
        f = getattr(self, f"do_{c.kind}", None)
        if f is None:
            raise GraphError("UNSUPPORTED", c.kind)
        return f(compiler, c, rows)

    # create
    def do_create(self, compiler: Compiler, c: T, rows: Rows) -> Rows:
        total = 1 if rows.unit else None
        rows = self.numbered(rows)
        total = total or rows.df.count()
        for part in c.pattern:
            rows = self.create_part(compiler, part, rows, total)
        return rows

    def create_part(self, compiler: Compiler, part: T, rows: Rows, total: int) -> Rows:
        spark = compiler.graph.spark
        nodes: list[DataFrame] = []
        rels: list[DataFrame] = []
        names: list[str] = []
        for e in part.elements:
            if e.kind == "node_pat":
                name = e.var or fresh("anon")
                if isinstance(rows.scope.get(name), Element):
                    if e.labels is not None or e.props is not None:
                        raise semantic(f"{name} is there already")
                    names.append(name)
                    continue
                x = Expressions(rows, compiler.params)
                labels = self.label_array(x, e.labels)
                props, types = self.prop_map(x, e.props)
                self.state.kinds.add(None, {k: tag_of(v.type) for k, v in types.items()})
                base = self.store.take_ids("node", total)
                el = Element("node", fresh("id"), {"labels": fresh("labels")}, {})
                df = rows.df.withColumn(el.id, F.lit(base) + F.col(ROW)).withColumn(el.meta["labels"], labels)
                column = fresh("props")
                df = df.withColumn(column, props)
                for k, v in types.items():
                    col = fresh("p")
                    el.props[k] = (col, v.type)
                    df = df.withColumn(col, v.col)
                nodes.append(df.select(F.col(el.id).alias("id"), F.col(el.meta["labels"]).alias("labels"), F.col(column).alias("props"), F.lit(False).alias("deleted")))
                rows = rows.with_(df=df, scope={**rows.scope, name: el})
                names.append(name)
                self.count("nodesCreated", total)
            elif e.kind != "rel_pat" or e.legacy or e.quantified:
                raise semantic("only plain nodes and relationships are created")
            else:
                names.append(e.var or fresh("anon"))
        for i, e in enumerate(part.elements):
            if e.kind != "rel_pat":
                continue
            if e.direction == "any":
                raise semantic("a created relationship has a direction")
            if e.types is None or e.types.kind != "l_name":
                raise semantic("a created relationship has one type")
            a, b = (names[i - 1], names[i + 1]) if e.direction == "out" else (names[i + 1], names[i - 1])
            x = Expressions(rows, compiler.params)
            props, types = self.prop_map(x, e.props)
            self.state.kinds.add(e.types.name, {k: tag_of(v.type) for k, v in types.items()})
            base = self.store.take_ids("rel", total)
            el = Element("rel", fresh("id"), {"type": fresh("type"), "src": fresh("src"), "dst": fresh("dst")}, {})
            df = rows.df.withColumns({el.id: F.lit(base) + F.col(ROW), el.meta["type"]: F.lit(e.types.name), el.meta["src"]: F.col(rows.scope[a].id), el.meta["dst"]: F.col(rows.scope[b].id)})
            column = fresh("props")
            df = df.withColumn(column, props)
            for k, v in types.items():
                col = fresh("p")
                el.props[k] = (col, v.type)
                df = df.withColumn(col, v.col)
            rels.append(df.select(F.col(el.id).alias("id"), F.col(el.meta["type"]).alias("type"), F.col(el.meta["src"]).alias("src"), F.col(el.meta["dst"]).alias("dst"), F.col(column).alias("props"), F.lit(False).alias("deleted")))
            rows = rows.with_(df=df, scope={**rows.scope, names[i]: el})
            self.count("relationshipsCreated", total)
        if part.path:
            raise GraphError("UNSUPPORTED", "a named path in CREATE")

        def together(frames):
            out = None
            for f in frames:
                out = f if out is None else out.unionByName(f)
            return out

        _ = spark
        self.stage(compiler, together(nodes), together(rels))
        return rows

    def label_array(self, x: Expressions, e: T | None) -> F.Column:
        if e is None:
            return F.array().cast("array<string>")
        if e.kind == "l_name":
            return F.array(F.lit(e.name))
        if e.kind == "l_dyn":
            v = x(e.expr)
            return F.array_sort(F.array_distinct(v.col if isinstance(v.type, S.ArrayType) else F.array(v.col)))
        if e.kind == "l_and":
            return F.array_sort(F.array_distinct(F.concat(*[self.label_array(x, p) for p in e.parts["parts"]])))
        raise semantic("a created node has plain labels")

    def prop_map(self, x: Expressions, e: T | None) -> tuple[F.Column, dict[str, Val]]:
        """Tagged texts of the properties (nulls left out), and their typed values."""
        if e is None:
            return F.create_map().cast("map<string,string>"), {}
        v = x(e)
        if isinstance(v.type, S.MapType):
            return F.create_map().cast("map<string,string>"), {}
        items = {f.name: Val(v.col.getField(f.name), f.dataType) for f in v.type}
        pairs = F.array(*[F.struct(F.lit(k).alias("k"), encode(i).alias("v")) for k, i in items.items()])
        return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())), {k: i for k, i in items.items() if not isinstance(i.type, S.NullType)}

    # set and remove
    def do_set(self, compiler: Compiler, c: T, rows: Rows) -> Rows:
        for item in c.items:
            rows = self.set_item(compiler, item, self.numbered(rows))
        return rows

    def set_item(self, compiler: Compiler, item: T, rows: Rows) -> Rows:
        if item.kind == "set_label":
            el = self.bound(rows, item.var)
            labels = self.label_array(Expressions(rows, compiler.params), item.labels)
            new = rows.df.where(F.col(el.id).isNotNull()).groupBy(F.col(el.id).alias("id")).agg(F.flatten(F.collect_set(labels)).alias("more"))
            df = self.state.nodes.join(new, "id").select("id", F.array_sort(F.array_union("labels", "more")).alias("labels"), "props", F.lit(False).alias("deleted"))
            self.stage(compiler, df, None)
            return self.refreshed(compiler, rows)
        target = item.target
        x = Expressions(rows, compiler.params)
        if target.kind == "var":  # a whole map
            el = self.bound(rows, target.name)
            v = x(item.value)
            if is_node(v.type) or is_rel(v.type):
                from ..functions.collections import _properties

                v = _properties(v)
            if isinstance(v.type, S.MapType):
                entries: dict[str, F.Column] = {}
            elif is_map(v.type):
                values = {f.name: Val(v.col.getField(f.name), f.dataType) for f in v.type}
                entries = {k: encode(i) for k, i in values.items()}
                self.tagged(el, values)
            else:
                raise GraphError("TYPE_ERROR", "SET needs a map")
            replace = not item.add
        else:
            if target.kind == "index":
                key = target.i.value if target.i.kind == "lit" else compiler.params.get(target.i.name) if target.i.kind == "param" else None
                base = target.a
            else:
                key, base = target.key, target.base
            if base.kind != "var" or not isinstance(key, str):
                raise semantic("SET needs a property of a variable")
            el = self.bound(rows, base.name)
            value = x(item.value)
            entries, replace = {key: encode(value)}, False
            self.tagged(el, {key: value})
        pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in entries.items()]) if entries else F.array().cast("array<struct<k:string,v:string>>")
        latest = rows.df.where(F.col(el.id).isNotNull()).groupBy(F.col(el.id).alias("id")).agg(F.max_by(pairs, F.col(ROW)).alias("new"))
        self.write_props(compiler, el.kind, latest, replace)
        self.count("propertiesSet", len(entries))
        return self.refreshed(compiler, rows)

    def tagged(self, el: Element, values: dict[str, Val]) -> None:
        """The kinds of values that elements are about to get."""
        tags = {k: tag_of(v.type) for k, v in values.items() if not isinstance(v.type, S.NullType)}
        if el.kind == "node":
            self.state.kinds.add(None, tags)
        else:
            self.state.kinds.add_to_all_types(tags)

    def write_props(self, compiler: Compiler, kind: str, latest: DataFrame, replace: bool) -> None:
        """Put new values (null: remove) into the records of some ids."""
        keys = F.transform("new", lambda p: p["k"])
        old = F.create_map().cast("map<string,string>") if replace else F.map_filter("props", lambda k, _: ~F.array_contains(keys, k))
        new = F.map_from_entries(F.filter("new", lambda p: p["v"].isNotNull()))
        base = self.state.nodes if kind == "node" else self.state.rels
        df = base.join(latest, "id").withColumn("props", F.map_concat(old, new)).drop("new").withColumn("deleted", F.lit(False))
        self.stage(compiler, df if kind == "node" else None, None if kind == "node" else df)

    def bound(self, rows: Rows, name: str) -> Element:
        b = rows.scope.get(name)
        if not isinstance(b, Element):
            raise semantic(f"{name} is no node or relationship")
        return b

    def refreshed(self, compiler: Compiler, rows: Rows) -> Rows:
        """Bound elements with their present labels and properties."""
        df, scope = rows.df, dict(rows.scope)
        done: dict[str, Element] = {}
        for name, b in rows.scope.items():
            if not isinstance(b, Element):
                continue
            if b.id not in done:
                fresh_df, full = compiler.matcher().renamed(compiler.graph.scan_nodes(None) if b.kind == "node" else compiler.graph.scan_rels(None), b.kind)
                key = fresh("key")
                fresh_df = fresh_df.withColumnRenamed(full.id, key)
                df = df.join(fresh_df, F.col(b.id) == F.col(key), "left").drop(key)
                done[b.id] = Element(b.kind, b.id, full.meta, full.props)
            scope[name] = done[b.id]
        return rows.with_(df=written(df, "rows"), scope=scope)

    def do_remove(self, compiler: Compiler, c: T, rows: Rows) -> Rows:
        rows = self.numbered(rows)
        for item in c.items:
            if item.kind == "remove_label":
                el = self.bound(rows, item.var)
                gone = sorted(required_labels(item.labels))
                ids = rows.df.select(F.col(el.id).alias("id")).distinct()
                df = self.state.nodes.join(ids, "id").withColumn("labels", F.array_except("labels", F.array(*[F.lit(x) for x in gone]))).withColumn("deleted", F.lit(False))
                self.stage(compiler, df, None)
            else:
                base = item.target.base if item.target.kind == "prop" else item.target.a
                key = item.target.key if item.target.kind == "prop" else item.target.i.value
                el = self.bound(rows, base.name)
                latest = rows.df.where(F.col(el.id).isNotNull()).select(F.col(el.id).alias("id")).distinct().withColumn("new", F.array(F.struct(F.lit(key).alias("k"), F.lit(None).cast("string").alias("v"))))
                self.write_props(compiler, el.kind, latest, False)
        return self.refreshed(compiler, rows)

    # delete
    def do_delete(self, compiler: Compiler, c: T, rows: Rows) -> Rows:
        rows = self.numbered(rows)
        nodes, rels = [], []
        for e in c.items:
            if e.kind == "var" and isinstance(rows.scope.get(e.name), Element):
                el = rows.scope[e.name]
                (nodes if el.kind == "node" else rels).append(rows.df.select(F.col(el.id).alias("id")))
                continue
            v = Expressions(rows, compiler.params)(e)
            if is_path(v.type):
                nodes.append(rows.df.select(F.explode(v.col["_nodes"]).alias("x")).select(F.col("x._id").alias("id")))
                rels.append(rows.df.select(F.explode(v.col["_rels"]).alias("x")).select(F.col("x._id").alias("id")))
            elif is_node(v.type) or is_rel(v.type):
                (nodes if is_node(v.type) else rels).append(rows.df.select(v.col["_id"].alias("id")))
            else:
                raise GraphError("TYPE_ERROR", "DELETE needs nodes, relationships or paths")

        def ids(frames):
            out = None
            for f in frames:
                out = f if out is None else out.union(f)
            return out.where("id is not null").distinct() if out is not None else None

        gone_nodes, gone_rels = ids(nodes), ids(rels)
        if gone_nodes is not None:
            gone_nodes = written(gone_nodes, "gone")
            touching = self.state.rels.join(gone_nodes.select(F.col("id").alias("src")), "src", "left_semi").select("id").union(self.state.rels.join(gone_nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("id")).distinct()
            if c.detach:
                gone_rels = touching if gone_rels is None else gone_rels.union(touching).distinct()
            else:
                rest = touching if gone_rels is None else touching.join(gone_rels, "id", "left_anti")
                if not rest.isEmpty():
                    raise GraphError("CONSTRAINT_VIOLATION", "a node still has relationships; use DETACH DELETE")
        node_delta = self.state.nodes.join(gone_nodes, "id", "left_semi").withColumn("deleted", F.lit(True)) if gone_nodes is not None else None
        rel_delta = self.state.rels.join(gone_rels, "id", "left_semi").withColumn("deleted", F.lit(True)) if gone_rels is not None else None
        if node_delta is not None:
            self.count("nodesDeleted", node_delta.count())
        if rel_delta is not None:
            self.count("relationshipsDeleted", rel_delta.count())
        self.stage(compiler, node_delta, rel_delta)
        return rows.with_(scope={v: b for v, b in rows.scope.items() if not (isinstance(b, Element) and any(e.kind == "var" and e.name == v for e in c.items))})

    # merge
    def do_merge(self, compiler: Compiler, c: T, rows: Rows) -> Rows:
        rows = self.numbered(rows)
        part = c.part
        new = [e.var for e in part.elements if e.var and e.var not in rows.scope]
        outer = [v for v in rows.scope if v in names_in(list(part.elements))]
        matched = compiler.matched(T("match", optional=False, repeatable=False, pattern=[part], searches=[], where=None), rows)
        matched = matched.with_(df=written(matched.df, "matched"))
        missing = rows.with_(df=written(rows.df.join(matched.df.select(ROW), ROW, "left_anti"), "missing"))
        outs = [(matched, "MATCH")]
        if missing.df.count():
            # one creation for each distinct pattern; the first row of it is ON CREATE
            x = Expressions(missing, compiler.params)
            keys = [F.col(rows.scope[v].id if isinstance(rows.scope[v], Element) else rows.scope[v].name) for v in outer]
            for e in part.elements:
                if e.props is not None:
                    v = x(e.props)
                    if not isinstance(v.type, S.MapType):
                        keys += [v.col.getField(f.name) for f in v.type]
            key_names = [fresh("mk") for _ in keys]
            df = missing.df.withColumns(dict(zip(key_names, keys, strict=True))) if keys else missing.df
            for k in key_names[len(outer) :]:
                if not df.where(F.col(k).isNull()).isEmpty():
                    raise semantic("MERGE on a null property")
            rank = fresh("rank")
            w = Window.partitionBy(*(key_names or [F.lit(0)])).orderBy(ROW)
            df = written(df.withColumn(rank, F.row_number().over(w)), "merge")
            first = Rows(df.where(F.col(rank) == 1).drop(rank), dict(rows.scope))
            made = self.do_create(compiler, T("create", pattern=[part], insert=False), first)
            outs.append((made, "CREATE"))
            if not df.where(F.col(rank) > 1).isEmpty():
                cols = [k for v in new for k in made.scope[v].columns()]
                ids = made.df.select(*[F.col(k).alias(f"_{k}") for k in key_names], *dict.fromkeys(cols))
                rest = df.where(F.col(rank) > 1)
                rest = rest.join(ids, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key_names] or F.lit(True)).drop(*[f"_{k}" for k in key_names])
                outs.append((Rows(rest, dict(made.scope)), "MATCH-LATER"))
        done: list[Rows] = []
        for out, how in outs:
            for which, items in c.actions:
                if which != how.split("-")[0]:
                    continue
                out = self.by_turns(compiler, items, out, new)
            done.append(out)
        done = [self.refreshed(compiler, o) for o in done if new or o.scope]
        names = [v for v in dict.fromkeys(v for o in done for v in o.scope) if all(v in o.scope for o in done)]
        frames, scope = [], {}
        for o in done:
            structs = {v: (b.struct() if isinstance(b, Element) else Val(F.col(b.name), b.type)) for v, b in o.scope.items()}
            frames.append((o, structs))
        from ..plans.values import common, to

        cols = {}
        for v in names:
            kind = common([s[v].type for _, s in frames])
            cols[v] = (fresh("m"), kind)
            scope[v] = Value(*cols[v])
        df = None
        for o, s in frames:
            f = o.df.select(*[to(s[v], kind).alias(name) for v, (name, kind) in cols.items()])
            df = f if df is None else df.union(f)
        rows = Rows(df, scope)
        for v in names:
            if is_node(scope[v].type) or is_rel(scope[v].type):
                rows = compiler.matcher().unpacked(rows, v, rows.scope[v])
        return rows

    def by_turns(self, compiler: Compiler, items: list[T], rows: Rows, new: list[str]) -> Rows:
        """SET row after row where several rows meet one element, so that each sees the last one's writes."""
        el = next((rows.scope[v] for v in new if isinstance(rows.scope.get(v), Element)), None)
        if el is None:
            return self.do_set(compiler, T("set", items=items), rows)
        turn = fresh("turn")
        df = written(rows.df.withColumn(turn, F.row_number().over(Window.partitionBy(el.id).orderBy(ROW))), "turns")
        most = df.agg(F.max(turn)).first()[0] or 0
        for k in range(1, most + 1):
            part = self.refreshed(compiler, rows.with_(df=df.where(F.col(turn) == k).drop(turn)))
            self.do_set(compiler, T("set", items=items), part)
        return rows.with_(df=df.drop(turn))

    def do_foreach(self, compiler: Compiler, c: T, rows: Rows) -> Rows:
        rows = self.numbered(rows)
        inner = compiler.do_unwind(T("unwind", var=c.var, list=c.list), rows)
        for clause in c.clauses:
            inner = self.clause(compiler, clause, inner)
        return self.refreshed(compiler, rows)

    def in_transactions(self, compiler: Compiler, c: T, rows: Rows) -> Rows:
        """Batches of rows, each its own commit."""
        rows = self.numbered(rows)
        size = compiler.count_of(c.tx.size, "OF") if c.tx.size is not None else 1000
        total = rows.df.count()
        body = T("call_sub", **{**c.parts, "tx": None})
        outs: list[Rows] = []
        statuses = []
        failed = False
        for start in range(0, total, size):
            batch = rows.with_(df=rows.df.where((F.col(ROW) >= start) & (F.col(ROW) < start + size)))
            if failed and c.tx.error == "BREAK":
                statuses.append((start, False, False, None, None))
                continue
            before = (self.state, len(self.node_deltas), len(self.rel_deltas), compiler.graph)
            try:
                outs.append(compiler.do_call_sub(body, batch))
                commit = self.store.commit_writer(self)
                statuses.append((start, True, True, commit, None))
            except Exception as e:
                if c.tx.error == "FAIL":
                    raise
                failed = True
                self.state, compiler.graph = before[0], before[3]
                del self.node_deltas[before[1] :], self.rel_deltas[before[2] :]
                statuses.append((start, True, False, None, str(e)[:500]))
        if c.tx.status:
            spark = compiler.graph.spark
            table = spark.createDataFrame(statuses or [], "_start long, started boolean, committed boolean, transactionId string, errorMessage string")
            col = fresh("status")
            df = rows.df.join(table, (F.col(ROW) >= F.col("_start")) & (F.col(ROW) < F.col("_start") + size)).withColumn(col, F.struct("started", "committed", "transactionId", "errorMessage"))
            kind = S.StructType([S.StructField("started", S.BooleanType()), S.StructField("committed", S.BooleanType()), S.StructField("transactionId", STRING), S.StructField("errorMessage", STRING)])
            return rows.with_(df=df, scope={**rows.scope, c.tx.status: Value(col, kind)})
        if outs and any(set(o.scope) != set(rows.scope) for o in outs):
            df = outs[0].df
            for o in outs[1:]:
                df = df.union(o.df.select(*df.columns) if set(o.df.columns) == set(df.columns) else o.df)
            return outs[0].with_(df=df)
        return rows

    # schema
    def do_create_index(self, compiler: Compiler, c: T, rows: Rows) -> Rows:
        entity, labels = _subject(c.pattern)
        props = [_key(t) for t in c.targets if t.kind == "prop"]
        name = c.name or f"index_{c.type.lower()}_{'_'.join(labels + props)}"
        found = self.schema.setdefault("indexes", {})
        if name in found:
            if c.missing:
                return rows
            raise GraphError("ALREADY_EXISTS", f"index {name}")
        from ..plans.query import constant

        options = constant(c.options, compiler.params) if c.options is not None else {}
        config = (options or {}).get("indexConfig", {})
        found[name] = {"name": name, "type": c.type, "entity": entity, "labels": labels, "properties": props, "options": options or {}, "similarity": str(config.get("vector.similarity_function", "cosine")).lower()}
        self.schema_changed = True
        compiler.graph.indexes = dict(found)
        return rows

    def do_create_constraint(self, compiler: Compiler, c: T, rows: Rows) -> Rows:
        entity, labels = _subject(c.pattern)
        props = [_key(t) for t in c.targets]
        name = c.name or f"constraint_{c.type.lower().replace(' ', '_')}_{'_'.join(labels + props)}"
        found = self.schema.setdefault("constraints", {})
        if name in found:
            if c.missing:
                return rows
            raise GraphError("ALREADY_EXISTS", f"constraint {name}")
        found[name] = {"name": name, "type": c.type, "entity": entity, "labels": labels, "properties": props, "type_text": c.type_text}
        self.schema_changed = True
        validate(self.state, found[name], None)
        return rows

    def do_drop(self, compiler: Compiler, c: T, rows: Rows) -> Rows:
        found = self.schema.setdefault("indexes" if c.what == "INDEX" else "constraints", {})
        if c.name not in found:
            if c.missing:
                return rows
            raise GraphError("NOT_FOUND", f"no {c.what.lower()} {c.name}")
        del found[c.name]
        self.schema_changed = True
        return rows

    def do_graph_type(self, compiler: Compiler, c: T, rows: Rows) -> Rows:
        spec = {} if c.how == "SET" else dict(self.schema.get("graph_type", {}))
        constraints = self.schema.setdefault("constraints", {})
        for e in c.entries:
            if e.kind == "graph_constraint":
                continue
            node = e.kind == "graph_node"
            name = e.label if node else e.type
            key = f"{'node' if node else 'rel'}:{name}"
            if c.how == "DROP":
                spec.pop(key, None)
                for n in [n for n, x in constraints.items() if x.get("from") == key]:
                    del constraints[n]
                continue
            spec[key] = {"implied": e.implied, "props": {k: t for k, t, _ in e.props}} if node else {"source": e.source, "target": e.target, "props": {k: t for k, t, _ in e.props}}
            for k, t, extra in e.props:
                for kind in ["TYPE", *(["NOT NULL"] if t.endswith("NOT NULL") else []), *([extra] if extra else [])]:
                    n = f"type_{key.replace(':', '_')}_{k}_{kind.lower().replace(' ', '_')}"
                    constraints[n] = {"name": n, "type": kind, "entity": "NODE" if node else "RELATIONSHIP", "labels": [name], "properties": [k], "type_text": t.removesuffix(" NOT NULL"), "from": key}
                    validate(self.state, constraints[n], None)
        self.schema["graph_type"] = spec
        self.schema_changed = True
        return rows


def _subject(pattern: list[T]) -> tuple[str, list[str]]:
    if len(pattern) == 1:
        return "NODE", sorted(_names(pattern[0].labels))
    return "RELATIONSHIP", sorted(_names(pattern[1].types))


def _names(e: T | None) -> set[str]:
    return {t.name for t in e.walk() if t.kind == "l_name"} if e is not None else set()


def _key(t: T) -> str:
    if t.kind != "prop":
        raise semantic("an index or constraint is on properties")
    return t.key


#: The tags of property kinds by type name.
TAGS = {"INTEGER": "i", "INT": "i", "FLOAT": "f", "STRING": "s", "BOOLEAN": "b", "BOOL": "b", "DATE": "d", "LOCAL DATETIME": "t", "ZONED DATETIME": "z", "DURATION": "pduration", "POINT": "ppoint", "LOCAL TIME": "plocaltime"}


def validate(state: State, constraint: dict, ids: DataFrame | None) -> None:
    """Check a constraint on a label's records, or on those of some ids against them."""
    if constraint["entity"] == "NODE":
        df = state.nodes
        for label in constraint["labels"]:
            df = df.where(F.array_contains("labels", label))
    else:
        df = state.rels.where(F.col("type").isin(constraint["labels"]))
    values = [F.try_element_at("props", F.lit(p)).alias(f"_{i}") for i, p in enumerate(constraint["properties"])]
    names = [f"_{i}" for i in range(len(values))]
    every = df.select("id", *values)
    df = every if ids is None else every.join(ids, "id", "left_semi")
    kind = constraint["type"]
    bad = None
    some_null = F.lit(False)
    for n in names:
        some_null = some_null | F.col(n).isNull()
    if kind in ("NOT NULL", "KEY"):
        bad = df.where(some_null)
    if kind in ("KEY", "UNIQUE") and (bad is None or bad.isEmpty()):
        if ids is not None:  # the values of the given records, wherever they stand
            every = every.join(df.select(*names).distinct(), names, "left_semi")
        bad = every.where(~some_null).groupBy(*names).count().where("count > 1")
    if kind == "TYPE":
        allowed = [TAGS.get(t.strip().removesuffix(" NOT NULL"), "L" + TAGS.get(t.strip()[5:-1].removesuffix(" NOT NULL"), "s") if t.strip().startswith("LIST<") else t.strip()) for t in constraint["type_text"].split("|")]
        bad = df.where(F.col("_0").isNotNull() & ~F.regexp_extract("_0", "^([^:]*):", 1).isin(allowed))
    if bad is not None and not bad.isEmpty():
        raise GraphError("CONSTRAINT_VIOLATION", f"{constraint['name']} does not hold")


