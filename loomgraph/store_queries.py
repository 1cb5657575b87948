"""Registered queries through the versioned store: writes, schema, versions, merges.

Each query makes a store of its own in the shared folder, writes nations and regions into
it by Cypher, changes them, and returns what a reading query then sees; the SQL computes
the same from the tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import GraphError
from .plans.scratch import shared_dir
from .sources.tables import table
from .version.store import GraphStore

NATIONS = "MATCH (n:Nation) RETURN n.key AS k, n.name AS name ORDER BY k"


def nations(spark: SparkSession, sf_dir: str, rels: bool = False) -> GraphStore:
    """A store with the nations, and with ``rels`` the regions that they are in."""
    store = GraphStore.create(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    rows = [{"key": r[0], "name": r[1], "region": r[2]} for r in table(spark, f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()]
    if not rels:
        store.execute("UNWIND $rows AS r CREATE (:Nation {key: r.key, name: r.name, region: r.region})", {"rows": rows})
        return store
    regions = [{"key": r[0], "name": r[1]} for r in table(spark, f"{sf_dir}/region.parquet").select("r_regionkey", "r_name").orderBy("r_regionkey").collect()]
    store.execute("UNWIND $rows AS r CREATE (:Region {key: r.key, name: r.name})", {"rows": regions})
    store.execute("UNWIND $rows AS r MATCH (g:Region {key: r.region}) CREATE (:Nation {key: r.key, name: r.name})-[:IN {since: 2000 + r.key}]->(g)", {"rows": rows})
    return store


def refused(store: GraphStore, text: str, **options) -> str:
    """The kind of error that a statement ends with, or none."""
    try:
        store.execute(text, **options)
        return "none"
    except GraphError as e:
        return e.category


def _after(*statements: str, read: str, rels: bool = False, params: dict | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = nations(spark, sf_dir, rels)
        for s in statements:
            store.execute(s, params)
        return store.execute(read).df

    return run


def constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = nations(spark, sf_dir)
    store.execute("CREATE CONSTRAINT nation_key FOR (n:Nation) REQUIRE n.key IS UNIQUE")
    store.execute("CREATE CONSTRAINT nation_name FOR (n:Nation) REQUIRE n.name IS NOT NULL")
    store.execute("CREATE CONSTRAINT nation_type FOR (n:Nation) REQUIRE n.region IS :: INTEGER")
    tries = ["CREATE (:Nation {key: 3, name: 'twice'})", "CREATE (:Nation {key: 1000})", "MATCH (n:Nation {key: 4}) SET n.name = null", "CREATE (:Nation {key: 1001, name: 'x', region: 'none'})", "CREATE (:Nation {key: 1002, name: 'sound'})"]
    rows = [(i, refused(store, t)) for i, t in enumerate(tries)]
    counted = store.execute("MATCH (n:Nation) RETURN count(*) AS n").rows()[0][0]
    return spark.createDataFrame([*rows, (99, str(counted))], "step long, result string")


def show_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = nations(spark, sf_dir)
    store.execute("CREATE INDEX by_key FOR (n:Nation) ON (n.key)")
    store.execute("CREATE TEXT INDEX by_name FOR (n:Nation) ON (n.name)")
    store.execute("CREATE CONSTRAINT named FOR (n:Nation) REQUIRE n.name IS NOT NULL")
    store.execute("CREATE INDEX gone FOR (n:Nation) ON (n.region)")
    store.execute("DROP INDEX gone")
    a = store.execute("SHOW INDEXES YIELD name, type RETURN name, type").df
    return a.union(store.execute("SHOW CONSTRAINTS YIELD name, type RETURN name, type").df)


def graph_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = nations(spark, sf_dir)
    store.execute("ALTER CURRENT GRAPH TYPE SET { (n:Nation => {key :: INTEGER NOT NULL, name :: STRING}) }")
    tries = ["CREATE (:Nation {key: 'text'})", "CREATE (:Nation {name: 'keyless'})", "CREATE (:Nation {key: 500})"]
    return spark.createDataFrame([(i, refused(store, t)) for i, t in enumerate(tries)], "step long, result string")


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views, policies and read-only options, and what each refuses."""
    store = nations(spark, sf_dir)
    rows = [
        ("read only", refused(store, "CREATE (:X)", read_only_no_external_io=True)),
        ("denied", refused(store, "CREATE (:X)", write_access={"none": True})),
        ("outside the view", refused(store, "CREATE (:X)", graph_view={"require_any": ["Nation"]})),
        ("past version", refused(store, "CREATE (:X)", at="branch/main")),
        ("no such version", refused(store, "MATCH (n) RETURN n", at="tag/none")),
        ("hidden", str(store.execute("MATCH (n:Nation {key: 1}) RETURN n.name AS n", read_access={"hide": ["name"]}).rows()[0][0])),
        ("seen", str(store.execute("MATCH (n) RETURN count(*) AS n", graph_view={"require_any": ["None"]}).rows()[0][0])),
    ]
    return spark.createDataFrame(rows, "what string, result string")


def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = nations(spark, sf_dir)
    store.execute("CALL graph.tag.create('first', 'branch/main') YIELD name RETURN name")
    store.execute("MATCH (n:Nation) WHERE n.key % 2 = 0 SET n.name = 'even'")
    store.execute("MATCH (n:Nation) WHERE n.key > 20 DETACH DELETE n")
    text = "MATCH (n:Nation) RETURN n.name AS name, count(*) AS n"
    old = store.execute(text, at="tag/first").df.select(F.lit("first").alias("version"), "name", "n")
    return old.union(store.execute(text).df.select(F.lit("last"), "name", "n"))


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = nations(spark, sf_dir)
    store.execute("CALL graph.branch.create('side') YIELD name RETURN name")
    store.execute("CALL graph.branch.create('gone') YIELD name RETURN name")
    store.execute("CALL graph.branch.checkout('side') YIELD name RETURN name")
    store.execute("MATCH (n:Nation) WHERE n.key < 5 SET n.side = true")
    store.execute("CALL graph.branch.delete('gone') YIELD name RETURN name")
    listed = store.execute("CALL graph.branch.list() YIELD name, active RETURN name, active").df
    here = store.execute("MATCH (n:Nation {side: true}) RETURN count(*) AS n").rows()[0][0]
    there = store.execute("MATCH (n:Nation) RETURN count(n.side) AS n", branch="main").rows()[0][0]
    return listed.select("name", "active", F.when(F.col("name") == "side", F.lit(here)).otherwise(F.lit(there)).cast("long").alias("n"))


def tags_and_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = nations(spark, sf_dir)
    for text in (
        "CALL graph.tag.create('a', 'branch/main') YIELD name RETURN name", "CALL graph.tag.create('b', 'branch/main') YIELD name RETURN name",
        "CALL graph.commit.create({note: 'empty'}) YIELD commit RETURN commit", "CALL graph.tag.move('a', 'branch/main') YIELD name RETURN name", "CALL graph.tag.delete('b') YIELD name RETURN name",
    ):
        store.execute(text)
    head = store.resolve(None)
    store.execute("CALL graph.commit.data.set($c, {note: 'more'}) YIELD data RETURN data", {"c": head})
    got = store.execute("CALL graph.commit.get($c) YIELD hasData, data RETURN hasData, data", {"c": head}).rows()[0]
    store.execute("CALL graph.commit.data.clear($c) YIELD commit RETURN commit", {"c": head})
    rows = [
        ("tags", ",".join(r[0] for r in store.execute("CALL graph.tag.list() YIELD name RETURN name").rows())),
        ("moved", str(store.resolve("tag/a") == head)),
        ("data", str(got[1])),
        ("cleared", str(store.execute("CALL graph.commit.get($c) YIELD hasData RETURN hasData", {"c": head}).rows()[0][0])),
        ("log", str(len(store.execute("CALL graph.log() YIELD commit RETURN commit").rows()))),
    ]
    return spark.createDataFrame(rows, "what string, result string")


def diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = nations(spark, sf_dir, True)
    before = store.resolve(None)
    store.execute("MATCH (n:Nation) WHERE n.key < 3 SET n.name = 'new', n:Low")
    store.execute("MATCH (n:Nation) WHERE n.key > 20 DETACH DELETE n")
    store.execute("MATCH (n:Nation {key: 5}) CREATE (:Town {name: 'T'})-[:IN]->(n)")
    return store.execute("CALL graph.diff($a, $b) YIELD op RETURN op, count(*) AS n", {"a": before, "b": store.resolve(None)}).df


def patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = nations(spark, sf_dir)
    node = store.execute("MATCH (n:Nation {key: 7}) RETURN id(n) AS i, n.name AS name").rows()[0]
    ops = [{"slot": f"node/{node[0]}/property/name", "before": f"s:{node[1]}", "after": "s:patched"}]
    store.execute("CALL graph.patch.apply($ops) YIELD commit RETURN commit", {"ops": ops})
    again = refused(store, "CALL graph.patch.apply($ops) YIELD commit RETURN commit", params={"ops": ops})
    return store.execute(NATIONS).df.withColumn("again", F.lit(again))


def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = nations(spark, sf_dir)
    store.branch_create("side")
    store.execute("MATCH (n:Nation) WHERE n.key < 4 SET n.name = 'ours'")
    store.execute("MATCH (n:Nation) WHERE 2 <= n.key < 8 SET n.name = 'theirs'", branch="side")
    store.execute("MATCH (n:Nation) WHERE n.key > 20 DETACH DELETE n", branch="side")
    name, status, n = store.execute("CALL graph.merge.start('branch/side') YIELD session, status, unresolved RETURN session, status, unresolved").rows()[0]
    listed = store.execute("CALL graph.merge.list() YIELD session RETURN session").values()
    found = store.execute("CALL graph.merge.conflicts($s) YIELD conflictId, slot RETURN conflictId, slot ORDER BY slot", {"s": name}).rows()
    choose = [{"conflictId": c, "choice": "ours" if i == 0 else "theirs"} for i, (c, _) in enumerate(found)]
    left = store.execute("CALL graph.merge.resolve($s, 0, $r) YIELD unresolved RETURN unresolved", {"s": name, "r": choose}).values()[0]
    ready = store.execute("CALL graph.merge.get($s) YIELD status RETURN status", {"s": name}).values()[0]
    done = store.execute("CALL graph.merge.finalize($s, 1) YIELD status RETURN status", {"s": name}).values()[0]
    said = f"{status},{n},{listed == [name]},{left},{ready},{done}"
    return store.execute(NATIONS).df.withColumn("said", F.lit(said))


def merge_abort(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = nations(spark, sf_dir)
    store.branch_create("side")
    store.execute("MATCH (n:Nation {key: 1}) SET n.name = 'side'", branch="side")
    name = store.execute("CALL graph.merge.start('branch/side') YIELD session RETURN session").values()[0]
    store.execute("CALL graph.merge.abort($s, 0) YIELD session RETURN session", {"s": name})
    rest = store.execute("CALL graph.merge.list() YIELD session RETURN session").rows()
    return store.execute(NATIONS).df.withColumn("sessions", F.lit(len(rest)).cast("long"))


def rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = nations(spark, sf_dir)
    store.branch_create("side")
    store.execute("MATCH (n:Nation) WHERE n.key < 4 SET n.name = 'main'")
    store.checkout("side")
    store.execute("MATCH (n:Nation) WHERE n.key > 20 SET n.name = 'side'")
    store.execute("CREATE (:Nation {key: 900, name: 'made'})")
    status, n = store.execute("CALL graph.rebase('branch/main') YIELD status, rewritten RETURN status, rewritten").rows()[0]
    return store.execute(NATIONS).df.withColumn("said", F.lit(f"{status},{n}"))


def squash_reset_revert(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = nations(spark, sf_dir)
    start = store.resolve(None)
    store.execute("MATCH (n:Nation {key: 1}) SET n.name = 'one'")
    store.execute("MATCH (n:Nation {key: 2}) SET n.name = 'two'")
    store.execute("CALL graph.squash($c) YIELD commit RETURN commit", {"c": start})
    length = len(store.log())
    store.execute("MATCH (n:Nation {key: 3}) SET n.name = 'three'")
    store.execute("CALL graph.revert($c) YIELD commit RETURN commit", {"c": store.resolve(None)})
    kept = store.resolve(None)
    store.execute("MATCH (n:Nation) DETACH DELETE n")
    store.execute("CALL graph.reset($c) YIELD from RETURN from", {"c": kept})
    gone = store.execute("CALL graph.gc() YIELD commits RETURN commits").values()[0]
    return store.execute(NATIONS).df.withColumn("said", F.lit(f"{length},{gone}"))


def semantic_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = nations(spark, sf_dir)

    def letters(texts: list[str]) -> list[list[float]]:
        return [[float(t.count(c)) for c in "0123456789"] + [0.5] for t in texts]

    store.providers["letters"] = letters
    store.execute("CALL db.index.semantic.createNodeIndex('names', ['Nation'], 'name', {provider: 'letters'}) YIELD name RETURN name")
    built = store.execute("CALL db.index.semantic.rebuild('names') YIELD indexedEntities RETURN indexedEntities").values()[0]
    found = store.execute("CALL db.index.semantic.queryNodes('names', 'NATION_7', {limit: 1}) YIELD node RETURN node.name AS name").df
    return found.withColumn("n", F.lit(built).cast("long"))


def index_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = nations(spark, sf_dir)
    store.execute("CREATE INDEX by_key FOR (n:Nation) ON (n.key)")
    return store.execute("CALL graph.index.rebuild('by_key') YIELD name, indexedEntities RETURN name, indexedEntities AS n").df


def transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several statements in one commit, one that fails and stages nothing, and a lost race."""
    store = nations(spark, sf_dir)
    commits = len(store.log())
    with store.transaction():
        store.execute("MATCH (n:Nation {key: 1}) SET n.name = 'one'")
        store.execute("CREATE (:Nation {key: 700, name: 'made'})")
    try:
        with store.transaction():
            store.execute("MATCH (n:Nation) SET n.name = 'lost'")
            raise ValueError
    except ValueError:
        pass
    other = GraphStore(spark, store.path)
    other.execute("MATCH (n:Nation {key: 2}) SET n.name = 'first'")
    raced = refused(store, "MATCH (n:Nation {key: 2}) SET n.name = 'second'")
    return other.execute(NATIONS).df.withColumn("said", F.lit(f"{len(store.log()) - commits},{raced}"))


def load_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as CSV and loaded again; a quoted empty field is the empty string."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    rows = table(spark, f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", F.lit("").alias("note"))
    rows.coalesce(1).write.option("header", True).option("emptyValue", '""').csv(path)
    store = GraphStore.create(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    store.execute(f"LOAD CSV WITH HEADERS FROM '{path}' AS row CREATE (:Line {{key: toInteger(row.n_nationkey), name: row.n_name, note: row.note}})")
    return store.execute("MATCH (l:Line) RETURN l.key AS k, l.name AS name, l.note AS note").df


def load_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and files of records, some of which lack their last field."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    t = table(spark, f"{sf_dir}/nation.parquet")
    line = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.col("n_name"), F.lit(","), F.col("n_regionkey"))).otherwise(F.col("n_name"))
    lines = spark.createDataFrame([(-1, "name,region")], "k int, value string").union(t.select("n_nationkey", line))
    lines.repartition(1).sortWithinPartitions("k").select("value").write.text(path)
    store = GraphStore.create(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    return store.execute(f"LOAD CSV WITH HEADERS FROM '{path}' AS row RETURN row.name AS name, row.region AS r, linenumber() AS l, file() CONTAINS 'part' AS f").df


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "store_create": _after(read="MATCH (n:Nation)-[i:IN]->(r:Region) RETURN n.name AS n, i.since AS s, r.name AS r", rels=True),
    "store_insert": _after("UNWIND range(1, 3) AS v INSERT (:Mark {v: v})-[:NEXT]->(:Mark {v: v * 10})", read="MATCH (a:Mark)-[:NEXT]->(b) RETURN a.v AS a, b.v AS b"),
    "store_set": _after(
        "MATCH (n:Nation) WHERE n.key < 5 SET n.twice = n.key * 2, n:Low", "MATCH (n:Low) SET n += {name: 'low', extra: true}", "MATCH (n:Nation {key: 20}) SET n = {key: 20, name: 'only'}",
        read="MATCH (n:Nation) RETURN n.key AS k, n.name AS name, n.twice AS t, n.extra AS e, n.region AS r, n:Low AS l",
    ),
    "store_remove": _after("MATCH (n:Nation) WHERE n.key < 5 SET n:Low", "MATCH (n:Nation) WHERE n.key % 2 = 0 REMOVE n.name, n:Low", read="MATCH (n:Nation) RETURN n.key AS k, n.name AS name, labels(n) AS l"),
    "store_delete": _after("MATCH ()-[i:IN]->() WHERE i.since > 2010 DELETE i", "MATCH (n:Nation) WHERE n.key > 20 DELETE n", "MATCH (r:Region {key: 0}) DETACH DELETE r", read="MATCH (n:Nation) RETURN n.key AS k, COUNT { (n)-[:IN]->() } AS c", rels=True),
    "store_merge": _after(
        "UNWIND [1, 2, 2, 100, 100, 100] AS k MERGE (n:Nation {key: k}) ON CREATE SET n.seen = 1 ON MATCH SET n.seen = coalesce(n.seen, 0) + 10", "MATCH (a:Nation {key: 1}), (b:Nation {key: 2}) MERGE (a)-[:NEAR]->(b)", "MATCH (a:Nation {key: 1}), (b:Nation {key: 2}) MERGE (a)-[:NEAR]->(b)",
        read="MATCH (n:Nation) RETURN n.key AS k, n.seen AS s, COUNT { (n)-[:NEAR]->() } AS c",
    ),
    "store_foreach": _after("MATCH (n:Nation) WHERE n.key < 3 FOREACH (x IN [1, 2] | CREATE (:Copy {of: n.key, no: x}))", read="MATCH (c:Copy) RETURN c.of AS k, c.no AS n"),
    "store_finish": _after("CREATE (:Mark {v: 1}) FINISH", read="MATCH (m:Mark) RETURN m.v AS v"),
    "store_batches": _after("UNWIND range(0, 24) AS k CALL (k) { MATCH (n:Nation {key: k}) SET n.batch = k / 10 } IN TRANSACTIONS OF 10 ROWS", read="MATCH (n:Nation) RETURN n.batch AS b, count(*) AS n"),
    "store_parameters": lambda spark, d: nations(spark, d).execute("MATCH (n:Nation $p) WHERE n.name STARTS WITH $s RETURN n.key AS k, $x AS x", {"p": {"key": 3}, "s": "N", "x": [1, 2]}).df,
    "store_constraint": constraint,
    "store_show_schema": show_schema,
    "store_graph_type": graph_type,
    "store_access": access,
    "store_time_travel": time_travel,
    "store_branches": branches,
    "store_tags_and_log": tags_and_log,
    "store_diff": diff,
    "store_patch": patch,
    "store_merge_session": merge,
    "store_merge_abort": merge_abort,
    "store_rebase": rebase,
    "store_squash_reset_revert": squash_reset_revert,
    "store_semantic_index": semantic_index,
    "store_index_rebuild": index_rebuild,
    "store_transaction": transaction,
    "load_csv": load_csv,
    "load_csv_lines": load_csv_lines,
}
_K = "n_nationkey::BIGINT"
ORACLE_SQL: dict[str, str] = {
    "store_create": f"SELECT n_name AS n, 2000 + {_K} AS s, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey",
    "store_insert": "SELECT v::BIGINT AS a, (v * 10)::BIGINT AS b FROM range(1, 4) t(v)",
    "store_set": f"SELECT {_K} AS k, CASE WHEN n_nationkey < 5 THEN 'low' WHEN n_nationkey = 20 THEN 'only' ELSE n_name END AS name, CASE WHEN n_nationkey < 5 THEN {_K} * 2 END AS t, CASE WHEN n_nationkey < 5 THEN true END AS e, CASE WHEN n_nationkey <> 20 THEN n_regionkey::BIGINT END AS r, n_nationkey < 5 AS l FROM nation",
    "store_remove": f"SELECT {_K} AS k, CASE WHEN n_nationkey % 2 = 1 THEN n_name END AS name, CASE WHEN n_nationkey < 5 AND n_nationkey % 2 = 1 THEN ['Low', 'Nation'] ELSE ['Nation'] END AS l FROM nation",
    "store_delete": f"SELECT {_K} AS k, CASE WHEN n_nationkey <= 10 AND n_regionkey <> 0 THEN 1 ELSE 0 END::BIGINT AS c FROM nation WHERE n_nationkey <= 20",
    "store_merge": f"SELECT {_K} AS k, CASE n_nationkey WHEN 1 THEN 10 WHEN 2 THEN 20 END::BIGINT AS s, (n_nationkey = 1)::BIGINT AS c FROM nation UNION ALL SELECT 100, 21, 0",
    "store_foreach": "SELECT k::BIGINT AS k, n::BIGINT AS n FROM range(0, 3) a(k), range(1, 3) b(n)",
    "store_finish": "SELECT 1::BIGINT AS v",
    "store_batches": f"SELECT {_K} // 10 AS b, count(*)::BIGINT AS n FROM nation GROUP BY 1",
    "store_parameters": "SELECT 3::BIGINT AS k, [1, 2]::BIGINT[] AS x",
    "store_constraint": "SELECT unnest([0, 1, 2, 3, 4, 99])::BIGINT AS step, unnest(['CONSTRAINT_VIOLATION', 'CONSTRAINT_VIOLATION', 'CONSTRAINT_VIOLATION', 'CONSTRAINT_VIOLATION', 'none', (SELECT (count(*) + 1)::VARCHAR FROM nation)]) AS result",
    "store_show_schema": "SELECT unnest(['by_key', 'by_name', 'named']) AS name, unnest(['RANGE', 'TEXT', 'NOT NULL']) AS type",
    "store_graph_type": "SELECT unnest([0, 1, 2])::BIGINT AS step, unnest(['CONSTRAINT_VIOLATION', 'CONSTRAINT_VIOLATION', 'none']) AS result",
    "store_access": "SELECT unnest(['read only', 'denied', 'outside the view', 'past version', 'no such version', 'hidden', 'seen']) AS what, unnest(['READ_ONLY', 'ACCESS_DENIED', 'GRAPH_VIEW_VIOLATION', 'READ_ONLY', 'VERSION_NOT_FOUND', 'None', '0']) AS result",
    "store_time_travel": "SELECT 'first' AS version, n_name AS name, count(*)::BIGINT AS n FROM nation GROUP BY 2 UNION ALL SELECT 'last', CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE n_name END, count(*)::BIGINT FROM nation WHERE n_nationkey <= 20 GROUP BY 2",
    "store_branches": "SELECT unnest(['main', 'side']) AS name, unnest([false, true]) AS active, unnest([0, 5])::BIGINT AS n",
    "store_tags_and_log": "SELECT unnest(['tags', 'moved', 'data', 'cleared', 'log']) AS what, unnest(['a', 'True', '{\"note\": \"more\"}', 'False', '3']) AS result",
    "store_diff": """SELECT unnest(['SetProperty', 'AddLabel', 'DeleteNode', 'RemoveLabel', 'RemoveProperty', 'DeleteRelationship', 'AddNode', 'AddRelationship']) AS op, unnest([3 + 1, 3 + 1, g, g, 3 * g, g, 1, 1])::BIGINT AS n
FROM (SELECT count(*) AS g FROM nation WHERE n_nationkey > 20)""",
    "store_patch": f"SELECT {_K} AS k, CASE WHEN n_nationkey = 7 THEN 'patched' ELSE n_name END AS name, 'VERSION_CONFLICT' AS again FROM nation",
    "store_merge_session": f"SELECT {_K} AS k, CASE WHEN n_nationkey < 3 THEN 'ours' WHEN n_nationkey < 8 THEN 'theirs' ELSE n_name END AS name, 'conflicted,2,True,0,ready,merged' AS said FROM nation WHERE n_nationkey <= 20",
    "store_merge_abort": f"SELECT {_K} AS k, n_name AS name, 0::BIGINT AS sessions FROM nation",
    "store_rebase": f"SELECT {_K} AS k, CASE WHEN n_nationkey < 4 THEN 'main' WHEN n_nationkey > 20 THEN 'side' ELSE n_name END AS name, 'rebased,2' AS said FROM nation UNION ALL SELECT 900, 'made', 'rebased,2'",
    "store_squash_reset_revert": f"SELECT {_K} AS k, CASE n_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE n_name END AS name, '3,3' AS said FROM nation",
    "store_semantic_index": "SELECT 'NATION_7' AS name, count(*)::BIGINT AS n FROM nation",
    "store_index_rebuild": "SELECT 'by_key' AS name, count(*)::BIGINT AS n FROM nation",
    "store_transaction": f"SELECT {_K} AS k, CASE n_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'first' ELSE n_name END AS name, '2,VERSION_CONFLICT' AS said FROM nation UNION ALL SELECT 700, 'made', '2,VERSION_CONFLICT'",
    "load_csv": f"SELECT {_K} AS k, n_name AS name, '' AS note FROM nation",
    "load_csv_lines": "SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey::VARCHAR END AS r, (n_nationkey + 2)::BIGINT AS l, true AS f FROM nation",
}
