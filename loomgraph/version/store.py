"""A versioned graph: an immutable commit DAG over Parquet layers, with branches and tags.

The catalog (small: commits, refs, sessions) is a text for each change, ``catalog/<n>.json``;
a change creates the next one, which only one writer can, so that a crash loses nothing and
of two writers one is told.  Layers are folders of changed records.  Data work is Spark's; the driver only walks the
DAG.
"""

from __future__ import annotations

import copy
import hashlib
import json
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cypher import parse
from ..errors import GraphError, invalid
from ..plans.query import Compiler
from ..plans.scratch import written
from ..session import Result, graph_procedures, kind_of
from ..sources.graph import Graph
from . import files
from .state import NODES, RELS, Kinds, State, changes, three_way
from .writer import Writer, validate

#: Layers along the first parents after which a snapshot is written.
CHECKPOINT = 32
#: Catalog texts that are kept.
EDITIONS = 16


class GraphStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._load()
        self.staged: Writer | None = None
        self.providers: dict[str, object] = {}

    def _load(self) -> None:
        """The latest catalog."""
        self.edition = max((int(x.removesuffix(".json")) for x in files.names(self.spark, f"{self.path}/catalog") if x.endswith(".json")), default=None)
        if self.edition is None:
            raise GraphError("NOT_FOUND", f"no graph store at {self.path}")
        self.catalog = json.loads(files.read_text(self.spark, self._catalog(self.edition)))
        self._merges: dict[tuple[str, str], DataFrame] = {}

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> "GraphStore":
        """A store with a root commit and the branch main."""
        path = path.rstrip("/")
        catalog = {"database": str(uuid.uuid4()), "commits": {}, "branches": {}, "tags": {}, "active": "main", "data": {}, "sessions": {}, "next": {"node": 1, "rel": 1}}
        if not files.create_text(spark, f"{path}/catalog/{0:012d}.json", json.dumps(catalog)):
            raise GraphError("ALREADY_EXISTS", path)
        store = cls(spark, path)
        root = store._commit([], None, {}, {}, "", "root")
        store.catalog["branches"]["main"] = root
        store._save()
        return store

    def _catalog(self, edition: int) -> str:
        return f"{self.path}/catalog/{edition:012d}.json"

    def _save(self) -> None:
        if not files.create_text(self.spark, self._catalog(self.edition + 1), json.dumps(self.catalog)):
            self._load()
            raise GraphError("VERSION_CONFLICT", "another writer has changed the store")
        self.edition += 1
        if self.edition >= EDITIONS:
            files.delete(self.spark, self._catalog(self.edition - EDITIONS))

    # the DAG
    def resolve(self, version: str | None) -> str:
        c = self.catalog
        if version is None:
            return c["branches"][c["active"]]
        kind, _, name = version.partition("/")
        table = {"branch": c["branches"], "tag": c["tags"]}.get(kind)
        found = table.get(name) if table is not None else name if kind == "commit" else c["branches"].get(version) or c["tags"].get(version) or version
        if found not in c["commits"]:
            raise GraphError("VERSION_NOT_FOUND", str(version))
        return found

    def ancestors(self, commit: str) -> set[str]:
        seen, todo = set(), [commit]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += self.catalog["commits"][x]["parents"]
        return seen

    def merge_bases(self, a: str, b: str) -> list[str]:
        """Best common ancestors: those that no other common ancestor descends from."""
        common = self.ancestors(a) & self.ancestors(b)
        # with a common ancestor all its ancestors are common: the best ones are no parents of others
        return sorted(common - {p for x in common for p in self.catalog["commits"][x]["parents"]})

    def first_parents(self, commit: str) -> list[str]:
        out = [commit]
        while parents := self.catalog["commits"][out[-1]]["parents"]:
            out.append(parents[0])
        return out

    def _commit(self, parents: list[str], layer: dict | None, schema: dict, kinds: dict, author: str, message: str) -> str:
        meta = {"parents": parents, "layer": layer, "schema": schema, "kinds": kinds, "author": author, "message": message, "time": time.time()}
        name = hashlib.sha256(json.dumps({"format": 1, **meta}, sort_keys=True).encode()).hexdigest()
        self.catalog["commits"][name] = meta
        return name

    def take_ids(self, kind: str, n: int) -> int:
        base = self.catalog["next"][kind]
        self.catalog["next"][kind] = base + n
        return base

    # states
    def state(self, commit: str) -> State:
        """The latest record for each id along the first parents, from the nearest snapshot on."""
        chain, base = [], None
        for c in self.first_parents(commit):
            if files.exists(self.spark, f"{self.path}/snapshots/{c}/nodes/_SUCCESS"):
                base = c
                break
            chain.append(c)
        start = State(self.spark.read.schema(NODES).parquet(f"{self.path}/snapshots/{base}/nodes"), self.spark.read.schema(RELS).parquet(f"{self.path}/snapshots/{base}/rels")) if base else State.empty(self.spark)
        layers = [self.catalog["commits"][c]["layer"] for c in reversed(chain) if self.catalog["commits"][c]["layer"]]
        start.kinds = self.kinds_of(commit)

        def latest(base_df: DataFrame, kind: str, schema: str) -> DataFrame:
            mine = [x["name"] for x in layers if kind in x["parts"]]
            if not mine:
                return base_df
            if not base and len(mine) == 1:
                return self.spark.read.schema(f"{schema}, deleted boolean").parquet(f"{self.path}/layers/{mine[0]}/{kind}").where("not deleted").drop("deleted")
            df = base_df.withColumn("deleted", F.lit(False)).withColumn("seq", F.lit(-1))
            for i, layer in enumerate(mine):
                df = df.unionByName(self.spark.read.schema(f"{schema}, deleted boolean").parquet(f"{self.path}/layers/{layer}/{kind}").withColumn("seq", F.lit(i)))
            cols = [c for c in base_df.columns if c != "id"]
            top = df.groupBy("id").agg(F.max_by(F.struct(*cols, "deleted"), "seq").alias("x"))
            return top.where("not x.deleted").select("id", *[F.col(f"x.{c}").alias(c) for c in cols])

        return State(latest(start.nodes, "nodes", NODES), latest(start.rels, "rels", RELS), start.kinds)

    def kinds_of(self, commit: str) -> Kinds:
        return Kinds(self.catalog["commits"][commit]["kinds"])

    def schema_of(self, commit: str) -> dict:
        return copy.deepcopy(self.catalog["commits"][commit]["schema"])

    def graph(self, version: str | None = None) -> Graph:
        commit = self.resolve(version)
        return self.state(commit).graph(self.spark, self.schema_of(commit), commit)

    def _write_layer(self, nodes: DataFrame | None, rels: DataFrame | None) -> dict:
        layer = {"name": uuid.uuid4().hex, "parts": []}
        for part, df, columns in (("nodes", nodes, ("id", "labels", "props", "deleted")), ("rels", rels, ("id", "type", "src", "dst", "props", "deleted"))):
            if df is not None:
                df.select(*columns).write.parquet(f"{self.path}/layers/{layer['name']}/{part}")
                layer["parts"].append(part)
        return layer

    def commit_state(self, parents: list[str], before: State, after: State, schema: dict, author: str, message: str) -> str:
        """A commit whose layer turns one state into another."""

        def delta(a: DataFrame, b: DataFrame) -> DataFrame:
            cols = [c for c in a.columns if c != "id"]
            x = a.select("id", F.struct(*cols).alias("x"), F.to_json(F.struct(*[F.array_sort(F.map_entries("props")).alias("props") if c == "props" else F.col(c) for c in cols])).alias("tx"))
            y = b.select("id", F.struct(*cols).alias("y"), F.to_json(F.struct(*[F.array_sort(F.map_entries("props")).alias("props") if c == "props" else F.col(c) for c in cols])).alias("ty"))
            both = x.join(y, "id", "full").where("not tx <=> ty")
            value = F.coalesce("y", "x")
            return both.select("id", *[value[c].alias(c) for c in cols], F.col("y").isNull().alias("deleted"))

        layer = self._write_layer(delta(before.nodes, after.nodes), delta(before.rels, after.rels))
        return self._finish(parents, layer, schema, after.scan_kinds(), author, message)

    def _finish(self, parents: list[str], layer: dict | None, schema: dict, kinds: Kinds, author: str, message: str) -> str:
        commit = self._commit(parents, layer, schema, kinds.plain(), author, message)
        depth = 0
        for c in self.first_parents(commit):
            if files.exists(self.spark, f"{self.path}/snapshots/{c}/nodes/_SUCCESS"):
                break
            depth += 1
        if depth >= CHECKPOINT:
            s = self.state(commit)
            s.nodes.write.parquet(f"{self.path}/snapshots/{commit}/nodes")
            s.rels.write.parquet(f"{self.path}/snapshots/{commit}/rels")
        return commit

    def commit_writer(self, w: Writer, author: str = "", message: str = "") -> str:
        """Commit what a writer has staged onto the active branch."""

        def last(frames: list[DataFrame]) -> DataFrame | None:
            out = None
            for i, f in enumerate(frames):
                f = f.withColumn("_seq", F.lit(i))
                out = f if out is None else out.unionByName(f)
            if out is None or len(frames) == 1:
                return out
            cols = [c for c in out.columns if c not in ("id", "_seq")]
            return out.groupBy("id").agg(F.max_by(F.struct(*cols), "_seq").alias("x")).select("id", *[F.col(f"x.{c}").alias(c) for c in cols])

        nodes, rels = last(w.node_deltas), last(w.rel_deltas)
        for c in w.schema.get("constraints", {}).values():
            touched = nodes if c["entity"] == "NODE" else rels
            if touched is not None:
                validate(w.state, c, touched.select("id"))
        head = self.catalog["branches"][self.catalog["active"]]
        layer = self._write_layer(nodes, rels) if w.node_deltas or w.rel_deltas else None
        commit = self._finish([head], layer, copy.deepcopy(w.schema), w.state.kinds or w.state.scan_kinds(), author, message)
        self.catalog["branches"][self.catalog["active"]] = commit
        self._save()
        w.node_deltas.clear()
        w.rel_deltas.clear()
        return commit

    # queries
    def execute(self, text: str, params: dict | None = None, **options) -> Result:
        """Run a query; a writing one becomes one commit on the active branch (or ``branch``).

        Options: branch, at, author, message, read_only_no_external_io, memory_limit_bytes
        (accepted, has no effect), read_access, write_access, graph_view, merge_session.
        """
        tree = parse(text)
        kind = kind_of(tree)
        if options.get("read_only_no_external_io") and (kind != "read" or any(t.kind == "load_csv" for t in tree.walk())):
            raise GraphError("READ_ONLY", "only reads without external input are allowed")
        if (access := options.get("write_access")) and kind != "read":
            banned = set(access.get("deny", ())) & ({kind} | {t.kind for t in tree.walk()})
            if banned or access.get("none"):
                raise GraphError("ACCESS_DENIED", ", ".join(sorted(banned)) or kind)
        if (b := options.get("branch")) and b != self.catalog["active"]:
            before = self.catalog["active"]
            if b not in self.catalog["branches"]:
                raise GraphError("VERSION_NOT_FOUND", b)
            self.catalog["active"] = b
            try:
                return self.execute(text, params, **{k: v for k, v in options.items() if k != "branch"})
            finally:
                self.catalog["active"] = before
                self._save()
        session = options.get("merge_session")
        if (options.get("at") or session) and kind != "read":
            raise GraphError("READ_ONLY", "a past version cannot be written")
        if session:
            state, schema, commit = self.candidate(session), self.schema_of(self.catalog["sessions"][session]["ours"]), None
        elif self.staged is not None and not options.get("at"):
            state, schema, commit = self.staged.state, self.staged.schema, None
        else:
            commit = self.resolve(options.get("at"))
            state, schema = self.state(commit), self.schema_of(commit)
        graph = state.graph(self.spark, schema, commit)
        if view := options.get("graph_view"):
            graph = graph.view(**view)
        if access := options.get("read_access"):
            graph = graph.hide(set(access.get("hide", ())), tuple(access.get("hide_prefixes", ())), access.get("hide_pattern"))
        from .procedures import version_procedures

        compiler = Compiler(graph, params, {**graph_procedures(graph), **version_procedures(self, graph, options)})
        writer = None
        if kind in ("write", "schema", "mixed"):
            writer = compiler.writer = self.staged or Writer(self, state, schema)
        rows = compiler.run(tree)
        names = list(rows.scope)
        summary = {"type": kind, "commit": commit} if kind == "read" else {"type": kind}
        df = compiler.result(rows, names) if names else None
        if writer is not None:
            if df is not None:
                df = written(df, "result")
            if view:
                self._guard(writer, view)
            if self.staged is None and (writer.node_deltas or writer.rel_deltas or writer.schema_changed):
                summary["commit"] = self.commit_writer(writer, options.get("author", ""), options.get("message", ""))
            summary["counters"] = dict(writer.counters)
        return Result(names, df, summary)

    def _guard(self, w: Writer, view: dict) -> None:
        """A write must not leave the view."""
        for nodes in w.node_deltas:
            live = nodes.where("not deleted")
            test = F.lit(True)
            for x in view.get("require_all", ()):
                test &= F.array_contains("labels", x)
            if view.get("require_any"):
                test &= F.arrays_overlap("labels", F.array(*[F.lit(x) for x in view["require_any"]]))
            if view.get("exclude_any"):
                test &= ~F.arrays_overlap("labels", F.array(*[F.lit(x) for x in view["exclude_any"]]))
            if not live.where(~test).isEmpty():
                raise GraphError("GRAPH_VIEW_VIOLATION", "a written node is outside the view")

    @contextmanager
    def transaction(self, branch: str | None = None, expected_head: str | None = None, author: str = "", message: str = ""):
        """Many executions, one commit; an error stages nothing."""
        if self.staged is not None:
            raise GraphError("TRANSACTION_ERROR", "a transaction is open")
        before = self.catalog["active"]
        if branch:
            self.catalog["active"] = branch
        head = self.resolve(None)
        if expected_head and head != expected_head:
            self.catalog["active"] = before
            raise GraphError("VERSION_CONFLICT", "the branch has moved")
        self.staged = Writer(self, self.state(head), self.schema_of(head))
        try:
            yield self
            w = self.staged
            if w.node_deltas or w.rel_deltas or w.schema_changed:
                self.commit_writer(w, author, message)
        finally:
            self.staged = None
            self.catalog["active"] = before
            self._save()

    # version operations
    def branch_create(self, name: str, source: str | None = None) -> str:
        if name in self.catalog["branches"]:
            raise GraphError("ALREADY_EXISTS", name)
        self.catalog["branches"][name] = self.resolve(source)
        self._save()
        return self.catalog["branches"][name]

    def checkout(self, name: str) -> str:
        if name not in self.catalog["branches"]:
            raise GraphError("VERSION_NOT_FOUND", name)
        self.catalog["active"] = name
        self._save()
        return self.catalog["branches"][name]

    def branch_delete(self, name: str) -> str:
        if name == self.catalog["active"] or name == "main":
            raise invalid("main and the active branch stay")
        if name not in self.catalog["branches"]:
            raise GraphError("VERSION_NOT_FOUND", name)
        old = self.catalog["branches"].pop(name)
        self._save()
        return old

    def diff(self, before: str, after: str) -> DataFrame:
        return changes(self.state(self.resolve(before)), self.state(self.resolve(after)))

    def log(self, version: str | None = None) -> list[str]:
        """Commits from a version back: children before parents, newer first, then by id."""
        start = self.resolve(version)
        reach = self.ancestors(start)
        children = {c: 0 for c in reach}
        for c in reach:
            for p in self.catalog["commits"][c]["parents"]:
                children[p] += 1
        level, out = [c for c in reach if not children[c]], []
        while level:
            level.sort(key=lambda c: (-self.catalog["commits"][c]["time"], c))
            out += level
            nxt = []
            for c in level:
                for p in self.catalog["commits"][c]["parents"]:
                    children[p] -= 1
                    if not children[p]:
                        nxt.append(p)
            level = nxt
        return out

    def base_state(self, a: str, b: str) -> State:
        """The merge base; several best ones merge into a virtual base, where conflicts are left open."""
        bases = self.merge_bases(a, b)
        state = self.state(bases[0])
        for other in bases[1:]:
            rows = three_way(self.base_state(bases[0], other), state, self.state(other))
            state = State.of_slots(rows.where("not conflict and merged is not null").select("slot", F.col("merged").alias("value")))
        return state

    def merge_start(self, source: str, expected_head: str | None = None) -> str:
        ours, theirs = self.resolve(None), self.resolve(source)
        if expected_head and ours != expected_head:
            raise GraphError("VERSION_CONFLICT", "the branch has moved")
        name = uuid.uuid4().hex
        self.catalog["sessions"][name] = {"branch": self.catalog["active"], "ours": ours, "theirs": theirs, "revision": 0, "resolutions": {}, "created": time.time()}
        self._save()
        return name

    def session(self, name: str) -> dict:
        if name not in self.catalog["sessions"]:
            raise GraphError("NOT_FOUND", f"no merge session {name}")
        return self.catalog["sessions"][name]

    def merge_rows(self, name: str) -> DataFrame:
        s = self.session(name)
        key = s["ours"], s["theirs"]
        if key not in self._merges:  # two commits never change: their comparison is made once
            self._merges[key] = written(three_way(self.base_state(*key), self.state(key[0]), self.state(key[1])), "merge")
        return self._merges[key]

    def conflicts(self, name: str) -> DataFrame:
        s = self.session(name)
        ident = F.sha2(F.concat_ws("\0", F.lit(s["ours"]), F.lit(s["theirs"]), "slot"), 256).alias("conflictId")
        found = self.merge_rows(name).where("conflict").select(ident, "slot", "base", "ours", "theirs")
        made = [(k, v["choice"], v.get("value")) for k, v in s["resolutions"].items()]
        table = self.spark.createDataFrame(made, "conflictId string, choice string, value string") if made else self.spark.createDataFrame([], "conflictId string, choice string, value string")
        return found.join(table, "conflictId", "left").select("conflictId", "slot", "base", "ours", "theirs", F.col("choice").alias("resolution"), "value").orderBy("slot", "conflictId")

    def merge_status(self, name: str) -> tuple[str, int]:
        s = self.session(name)
        if s["theirs"] in self.ancestors(s["ours"]):
            return "up_to_date", 0
        if s["ours"] in self.ancestors(s["theirs"]):
            return "fast_forward", 0
        open_ = self.conflicts(name).where("resolution is null").count()
        return ("conflicted" if open_ else "ready"), open_

    def merge_resolve(self, name: str, revision: int, resolutions: list[dict]) -> None:
        s = self.session(name)
        if s["revision"] != revision:
            raise GraphError("VERSION_CONFLICT", "the session has moved")
        ids = [r["conflictId"] for r in resolutions]
        if len(set(ids)) != len(ids) or any(r["choice"] not in ("ours", "theirs", "value") for r in resolutions):
            raise invalid("a resolution names a conflict once, with ours, theirs or value")
        known = self.conflicts(name).where(F.col("conflictId").isin(ids)).count()
        if known != len(ids):
            raise invalid("unknown conflict")
        from ..plans.values import literal
        from .codec import encode

        for r in resolutions:
            value = None
            if r["choice"] == "value":
                value = self.spark.range(1).select(encode(literal(r.get("value")))).first()[0]
            s["resolutions"][r["conflictId"]] = {"choice": r["choice"], "value": value}
        s["revision"] += 1
        self._save()

    def candidate(self, name: str) -> State:
        s = self.session(name)
        status, _ = self.merge_status(name)
        if status == "up_to_date":
            return self.state(s["ours"])
        if status == "fast_forward":
            return self.state(s["theirs"])
        if status == "conflicted":
            raise GraphError("MERGE_CONFLICT", "the session has unresolved conflicts")
        chosen = self.conflicts(name).select("slot", "resolution", "value")
        rows = self.merge_rows(name).join(chosen, "slot", "left")
        value = F.when(F.col("resolution") == "ours", F.col("ours")).when(F.col("resolution") == "theirs", F.col("theirs")).when(F.col("resolution") == "value", F.col("value")).otherwise(F.col("merged"))
        return State.of_slots(rows.select("slot", value.alias("value")).where("value is not null"))

    def merge_finalize(self, name: str, revision: int) -> tuple[str, str]:
        s = self.session(name)
        if s["revision"] != revision:
            raise GraphError("VERSION_CONFLICT", "the session has moved")
        if self.catalog["branches"].get(s["branch"]) != s["ours"]:
            raise GraphError("VERSION_CONFLICT", "the branch has moved")
        status, _ = self.merge_status(name)
        if status == "conflicted":
            raise GraphError("MERGE_CONFLICT", "the session has unresolved conflicts")
        commit = s["ours"]
        if status == "fast_forward":
            commit = s["theirs"]
        elif status == "ready":
            after = self.candidate(name).kept("merged")
            schema = {**self.schema_of(s["theirs"]), **self.schema_of(s["ours"])}
            for c in schema.get("constraints", {}).values():
                validate(after, c, None)
            commit = self.commit_state([s["ours"], s["theirs"]], self.state(s["ours"]), after, schema, "", f"merge {s['theirs'][:12]}")
            status = "merged"
        self.catalog["branches"][s["branch"]] = commit
        del self.catalog["sessions"][name]
        self._save()
        return ("merged" if status == "ready" else status), commit

    def merge_abort(self, name: str, revision: int) -> None:
        if self.session(name)["revision"] != revision:
            raise GraphError("VERSION_CONFLICT", "the session has moved")
        del self.catalog["sessions"][name]
        self._save()

    def _replay(self, onto: State, before: State, after: State) -> tuple[State, DataFrame]:
        rows = three_way(before, onto, after)
        conflicts = rows.where("conflict")
        return State.of_slots(rows.select("slot", F.col("merged").alias("value")).where("value is not null")).kept("replayed"), conflicts

    def rebase(self, onto: str) -> tuple[str, str | None, int, list]:
        """Replay the active branch's own commits onto a version."""
        head, target = self.resolve(None), self.resolve(onto)
        base = self.merge_bases(head, target)[0]
        mine = [c for c in self.first_parents(head) if c not in self.ancestors(base)]
        if not mine or base == target:
            return "up_to_date", head, 0, []
        at, state = target, self.state(target)
        for c in reversed(mine):
            meta = self.catalog["commits"][c]
            state2, conflicts = self._replay(state, self.state(meta["parents"][0]), self.state(c))
            if not conflicts.isEmpty():  # as many as there are; nothing else of the replay is collected
                return "conflicted", None, 0, [r[0] for r in conflicts.select("slot").orderBy("slot").toLocalIterator()]
            at = self.commit_state([at], state, state2, meta["schema"], meta["author"], meta["message"])
            state = state2
        self.catalog["branches"][self.catalog["active"]] = at
        self._save()
        return "rebased", at, len(mine), []

    def squash(self, since: str) -> tuple[str, str, str]:
        head, start = self.resolve(None), self.resolve(since)
        if start not in self.first_parents(head):
            raise invalid("squash needs an ancestor of the branch")
        commit = self.commit_state([start], self.state(start), self.state(head), self.schema_of(head), "", f"squash since {start[:12]}")
        self.catalog["branches"][self.catalog["active"]] = commit
        self._save()
        return start, head, commit

    def reset(self, target: str) -> tuple[str, str]:
        head, to = self.resolve(None), self.resolve(target)
        self.catalog["branches"][self.catalog["active"]] = to
        self._save()
        return head, to

    def revert(self, commit: str, mainline: int = 0) -> str:
        head, c = self.resolve(None), self.resolve(commit)
        parents = self.catalog["commits"][c]["parents"]
        if not parents:
            raise invalid("the root commit stays")
        after, conflicts = self._replay(self.state(head), self.state(c), self.state(parents[mainline]))
        if not conflicts.isEmpty():
            raise GraphError("MERGE_CONFLICT", "later commits changed what would be reverted")
        new = self.commit_state([head], self.state(head), after, self.schema_of(head), "", f"revert {c[:12]}")
        self.catalog["branches"][self.catalog["active"]] = new
        self._save()
        return new

    def patch_apply(self, operations: list[dict]) -> str:
        """Apply patch operations to the active branch; every ``before`` must hold."""
        slots = [o["slot"] for o in operations]
        if len(set(slots)) != len(slots):
            raise invalid("a patch has one operation for a slot")
        head = self.resolve(None)
        state = self.state(head)
        table = self.spark.createDataFrame([(o["slot"], o.get("before"), o.get("after")) for o in operations], "slot string, before string, after string")
        now = state.slots()
        bad = table.join(now, "slot", "left").where("not before <=> value")
        if not bad.isEmpty():
            raise GraphError("VERSION_CONFLICT", "a patch's condition does not hold")
        new = now.join(table, "slot", "left_anti").union(table.where("after is not null").select("slot", "after"))
        commit = self.commit_state([head], state, State.of_slots(new), self.schema_of(head), "", "patch")
        self.catalog["branches"][self.catalog["active"]] = commit
        self._save()
        return commit

    def gc(self) -> dict[str, int]:
        """Delete commits that no branch, tag or session reaches, with their layers and snapshots."""
        live: set[str] = set()
        roots = [*self.catalog["branches"].values(), *self.catalog["tags"].values()]
        for s in self.catalog["sessions"].values():
            roots += [s["ours"], s["theirs"]]
        for r in roots:
            live |= self.ancestors(r)
        dead = [c for c in self.catalog["commits"] if c not in live]
        kept_layers = {x["name"] for c in live if (x := self.catalog["commits"][c]["layer"])}
        out = {"commits": len(dead), "layers": 0, "schemas": 0, "checkpoints": 0, "commitData": 0}
        for c in dead:
            layer = self.catalog["commits"].pop(c)["layer"]
            out["commitData"] += self.catalog["data"].pop(c, None) is not None
            if layer and layer["name"] not in kept_layers:
                files.delete(self.spark, f"{self.path}/layers/{layer['name']}")
                out["layers"] += 1
            if files.exists(self.spark, f"{self.path}/snapshots/{c}"):
                files.delete(self.spark, f"{self.path}/snapshots/{c}")
                out["checkpoints"] += 1
        self._save()
        return out

    def check_integrity(self, version: str | None = None) -> DataFrame:
        """Relationships whose ends do not exist; none in a sound store."""
        s = self.state(self.resolve(version))
        ids = s.nodes.select("id")
        return s.rels.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").select("id", F.lit("source").alias("end")).union(s.rels.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select("id", F.lit("target").alias("end")))
