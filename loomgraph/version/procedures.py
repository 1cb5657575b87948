"""Version and semantic-index procedures, under ``graph.``."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import GraphError
from ..functions.vectors import similarity
from ..session import _plain
from ..sources.graph import Graph


def version_procedures(store, graph: Graph, options: dict) -> dict[str, Callable]:
    spark, c = store.spark, store.catalog  # of this call: a store that loses a race loads another

    def rows(data: list, schema: str) -> DataFrame:
        return spark.createDataFrame(data, schema)

    def branch_create(name, source=None):
        return rows([(name, store.branch_create(name, source))], "name string, commit string")

    def checkout(name):
        return rows([(name, store.checkout(name))], "name string, commit string")

    def branch_list():
        return rows([(n, k, n == c["active"]) for n, k in sorted(c["branches"].items())], "name string, commit string, active boolean")

    def branch_delete(name):
        return rows([(name, store.branch_delete(name))], "name string, previousCommit string")

    META = "commit string, parents array<string>, author string, message string, committedAt double"

    def meta(k):
        m = c["commits"][k]
        return (k, m["parents"], m["author"], m["message"], float(m["time"]))

    def commit_get(version=None):
        k = store.resolve(version)
        return rows([(*meta(k), k in c["data"], c["data"].get(k))], f"{META}, hasData boolean, data string")

    def commit_create(data=None):
        head = store.resolve(None)
        k = store._finish([head], None, store.schema_of(head), store.kinds_of(head), options.get("author", ""), options.get("message", ""))
        c["branches"][c["active"]] = k
        if data is not None:
            c["data"][k] = json.dumps(_plain(data) if hasattr(data, "asDict") else data)
        store._save()
        return rows([(k,)], "commit string")

    def data_set(version, data):
        k = store.resolve(version)
        c["data"][k] = json.dumps(_plain(data) if hasattr(data, "asDict") else data)
        store._save()
        return rows([(k, c["data"][k])], "commit string, data string")

    def data_clear(version):
        k = store.resolve(version)
        c["data"].pop(k, None)
        store._save()
        return rows([(k,)], "commit string")

    def tag_create(name, target):
        if name in c["tags"]:
            raise GraphError("ALREADY_EXISTS", name)
        c["tags"][name] = store.resolve(target)
        store._save()
        return rows([(name, c["tags"][name])], "name string, commit string")

    def tag_list():
        return rows(sorted(c["tags"].items()), "name string, commit string")

    def tag_move(name, target):
        if name not in c["tags"]:
            raise GraphError("VERSION_NOT_FOUND", name)
        old, c["tags"][name] = c["tags"][name], store.resolve(target)
        store._save()
        return rows([(name, old, c["tags"][name])], "name string, previousCommit string, commit string")

    def tag_delete(name):
        if name not in c["tags"]:
            raise GraphError("VERSION_NOT_FOUND", name)
        old = c["tags"].pop(name)
        store._save()
        return rows([(name, old)], "name string, previousCommit string")

    def log(version=None, limit=None, cursor=None):
        found = store.log(version)
        if cursor:
            found = found[found.index(cursor) + 1 :] if cursor in found else []
        page = found if limit is None else found[:limit]
        more = len(page) < len(found)
        return rows([(*meta(k), k if more or k != page[-1] else None) for k in page], f"{META}, cursor string")

    def diff(before, after):
        ops = store.diff(before, after).select("op", "slot", "before", "after")
        return ops.orderBy("slot")

    def patch_apply(operations):
        return rows([(store.patch_apply([_plain(o) for o in operations]),)], "commit string")

    SESSION = "session string, targetBranch string, ours string, theirs string, revision long, status string, unresolved long"

    def merge_row(name):
        s = store.session(name)
        status, open_ = store.merge_status(name)
        return rows([(name, s["branch"], s["ours"], s["theirs"], s["revision"], status, open_)], SESSION)

    def merge_start(source, expected=None):
        return merge_row(store.merge_start(source, expected))

    def merge_list(limit=None, cursor=None):
        names = [n for n in sorted(c["sessions"]) if cursor is None or n > cursor][:limit]
        return rows([(n, s["branch"], s["ours"], s["theirs"], s["revision"], float(s["created"]), n) for n in names for s in [c["sessions"][n]]], "session string, targetBranch string, ours string, theirs string, revision long, createdAt double, cursor string")

    def merge_conflicts(name, limit=None, cursor=None):
        df = store.conflicts(name)
        if cursor is not None:
            df = df.where(F.col("slot") > cursor)
        df = df.limit(limit) if limit is not None else df
        return df.select(F.lit(name).alias("session"), F.lit(store.session(name)["revision"]).cast("long").alias("revision"), "conflictId", "slot", "base", "ours", "theirs", "resolution", F.col("slot").alias("cursor"))

    def merge_resolve(name, revision, resolutions):
        store.merge_resolve(name, revision, [_plain(r) for r in resolutions])
        return merge_row(name).select("session", "revision", "status", "unresolved")

    def merge_finalize(name, revision):
        return rows([store.merge_finalize(name, revision)], "status string, commit string")

    def merge_abort(name, revision):
        store.merge_abort(name, revision)
        return rows([(name,)], "session string")

    def rebase(onto, options_=None):
        return rows([store.rebase(onto)], "status string, commit string, rewritten long, conflicts array<string>")

    def squash(since):
        return rows([store.squash(since)], "from string, previousHead string, commit string")

    def reset(target):
        return rows([store.reset(target)], "from string, to string")

    def revert(commit, options_=None):
        return rows([(store.revert(commit, int(_plain(options_).get("mainline", 0)) if options_ else 0),)], "commit string")

    def gc():
        return rows([tuple(store.gc().values())], "commits long, layers long, schemas long, checkpoints long, commitData long")

    def index_rebuild(name, version=None):
        k = store.resolve(version)
        found = store.schema_of(k).get("indexes", {}).get(name)
        if found is None:
            raise GraphError("NOT_FOUND", f"no index {name}")
        g = store.graph(k)
        df = g.scan_nodes(set(found["labels"][:1])) if found["entity"] == "NODE" else g.scan_rels(set(found["labels"]))
        return rows([(name, k, df.count())], "name string, commit string, indexedEntities long")

    # semantic indexes: a registered provider turns texts into vectors
    def semantic_create(entity):
        def run(name, labels, prop, opts=None):
            head = store.resolve(None)
            schema = store.schema_of(head)
            schema.setdefault("indexes", {})[name] = {"name": name, "type": "SEMANTIC", "entity": entity, "labels": list(labels), "properties": [prop], "options": _plain(opts)}
            k = store._finish([head], None, schema, store.kinds_of(head), "", f"semantic index {name}")
            c["branches"][c["active"]] = k
            store._save()
            return rows([(name,)], "name string")

        return run

    def embedded(index: dict, g: Graph) -> DataFrame:
        """Ids with vectors; each distinct text is embedded once, in batches on the executors."""
        provider = store.providers.get(index["options"].get("provider", "default"))
        if provider is None:
            raise GraphError("NOT_FOUND", "no embedding provider is registered")
        prop = index["properties"][0]
        df = g.scan_nodes({index["labels"][0]}, {prop}) if index["entity"] == "NODE" else g.scan_rels(set(index["labels"]), {prop})
        texts = df.where(F.col(prop).isNotNull()).select(F.col("_id"), F.col(prop).cast("string").alias("text"))

        def run(batches):
            for pdf in batches:
                yield pdf.assign(vector=[[float(x) for x in v] for v in provider(list(pdf["text"]))])

        return texts.join(texts.select("text").distinct().mapInPandas(run, "text string, vector array<double>"), "text")

    def semantic_query(entity):
        def run(name, query, opts=None):
            index = graph.indexes.get(name)
            if index is None or index["type"] != "SEMANTIC":
                raise GraphError("NOT_FOUND", f"no semantic index {name}")
            provider = store.providers.get(index["options"].get("provider", "default"))
            k = int(_plain(opts).get("limit", 10))
            found = embedded(index, graph)
            q = F.array(*[F.lit(float(x)) for x in provider([query])[0]])
            best = found.select("_id", similarity("cosine", F.col("vector"), q).alias("score")).orderBy(F.desc("score"), "_id").limit(k)
            from ..plans.patterns import Matcher

            df, el = Matcher(graph, {}, {}).renamed(graph.scan_nodes(None) if entity == "NODE" else graph.scan_rels(None), "node" if entity == "NODE" else "rel")
            return best.join(df, F.col("_id") == F.col(el.id)).select(el.struct().col.alias("node" if entity == "NODE" else "relationship"), "score").orderBy(F.desc("score"))

        return run

    def semantic_rebuild(name, version=None):
        k = store.resolve(version)
        g = store.graph(k)
        found = embedded(g.indexes[name], g)
        return rows([(name, k, *found.agg(F.count("*"), F.count_distinct("text")).first())], "name string, commit string, indexedEntities long, embeddedTexts long")

    return {
        "graph.branch.create": branch_create, "graph.branch.checkout": checkout, "graph.branch.list": branch_list, "graph.branch.delete": branch_delete,
        "graph.commit.get": commit_get, "graph.commit.create": commit_create, "graph.commit.data.set": data_set, "graph.commit.data.clear": data_clear,
        "graph.tag.create": tag_create, "graph.tag.list": tag_list, "graph.tag.move": tag_move, "graph.tag.delete": tag_delete,
        "graph.log": log, "graph.diff": diff, "graph.patch.apply": patch_apply,
        "graph.merge.start": merge_start, "graph.merge.get": merge_row, "graph.merge.list": merge_list, "graph.merge.conflicts": merge_conflicts, "graph.merge.resolve": merge_resolve,
        "graph.merge.finalize": merge_finalize, "graph.merge.abort": merge_abort, "graph.rebase": rebase, "graph.squash": squash, "graph.reset": reset, "graph.revert": revert,
        "graph.gc": gc, "graph.index.rebuild": index_rebuild,
        "db.index.semantic.createnodeindex": semantic_create("NODE"), "db.index.semantic.createrelationshipindex": semantic_create("RELATIONSHIP"),
        "db.index.semantic.querynodes": semantic_query("NODE"), "db.index.semantic.queryrelationships": semantic_query("RELATIONSHIP"), "db.index.semantic.rebuild": semantic_rebuild,
    }
