"""The versioned store: writes, branches, merges."""

import pytest

from loomgraph.errors import GraphError
from loomgraph.version.store import GraphStore


@pytest.fixture()
def store(spark, tmp_path):
    return GraphStore.create(spark, str(tmp_path / "g"))


def test_write_branch_merge(store):
    store.execute("CREATE (a:Person {name:'Ann', age:30})-[:KNOWS {since:2020}]->(b:Person {name:'Bob', age:40})")
    assert store.execute("MATCH (a)-[r]->(b) RETURN a.name AS a, r.since AS s, b.name AS b").rows() == [("Ann", 2020, "Bob")]
    store.branch_create("dev")
    store.execute("MATCH (p:Person {name:'Bob'}) SET p.age = 50")
    store.execute("MATCH (p:Person {name:'Bob'}) SET p.age = 60, p.city = 'X'", branch="dev")
    session = store.merge_start("branch/dev")
    assert store.merge_status(session) == ("conflicted", 1)
    conflict = store.conflicts(session).collect()[0]
    assert (conflict.slot, conflict.ours, conflict.theirs) == ("node/2/property/age", "i:50", "i:60")
    store.merge_resolve(session, 0, [{"conflictId": conflict.conflictId, "choice": "theirs"}])
    assert store.merge_finalize(session, 1)[0] == "merged"
    assert store.execute("MATCH (p:Person) RETURN p.name AS n, p.age AS a, p.city AS c ORDER BY n").rows() == [("Ann", 30, None), ("Bob", 60, "X")]
    assert store.check_integrity().count() == 0


def test_merge_clause_sees_earlier_rows(store):
    store.execute("UNWIND ['oak', 'elm', 'oak', 'oak'] AS kind MERGE (t:Tree {kind: kind}) ON CREATE SET t.rings = 100 ON MATCH SET t.rings = t.rings + 5")
    assert store.execute("MATCH (t:Tree) RETURN t.kind AS k, t.rings AS r ORDER BY k").rows() == [("elm", 100), ("oak", 110)]


def test_delete_and_constraint(store):
    store.execute("CREATE (:A {k:1})-[:R]->(:B)")
    with pytest.raises(GraphError, match="CONSTRAINT_VIOLATION"):
        store.execute("MATCH (a:A) DELETE a")
    store.execute("CREATE CONSTRAINT u FOR (a:A) REQUIRE a.k IS UNIQUE")
    with pytest.raises(GraphError, match="CONSTRAINT_VIOLATION"):
        store.execute("CREATE (:A {k:1})")
    store.execute("MATCH (a:A) DETACH DELETE a")
    assert store.execute("MATCH (n) RETURN labels(n) AS l").rows() == [(["B"],)]


def test_time_travel_and_revert(store):
    store.execute("CREATE (:A {v:1})")
    old = store.resolve(None)
    store.execute("MATCH (a:A) SET a.v = 2")
    assert store.execute("MATCH (a:A) RETURN a.v AS v", at=f"commit/{old}").rows() == [(1,)]
    store.revert(store.resolve(None))
    assert store.execute("MATCH (a:A) RETURN a.v AS v").rows() == [(1,)]


def test_values_of_two_kinds_harm_only_their_readers(store):
    store.execute("CREATE (:A {v: 1, w: 'x'}), (:A {v: 'one', w: 'y'})")
    assert store.execute("MATCH (a:A) RETURN a.w AS w ORDER BY w").rows() == [("x",), ("y",)]
    with pytest.raises(Exception, match="TYPE_ERROR"):
        store.execute("MATCH (a:A) RETURN a.v AS v").rows()
    store.execute("MATCH (a:A {w: 'y'}) DETACH DELETE a")
    assert store.execute("MATCH (a:A) RETURN a.v AS v").rows() == [(1,)]


def test_two_writers(spark, store):
    store.execute("CREATE (:A {v: 1})")
    other = GraphStore(spark, store.path)
    other.execute("MATCH (a:A) SET a.v = 2")
    with pytest.raises(GraphError, match="VERSION_CONFLICT"):
        store.execute("MATCH (a:A) SET a.v = 3")
    assert store.execute("MATCH (a:A) RETURN a.v AS v").rows() == [(2,)]
    store.execute("MATCH (a:A) SET a.v = 4")
    assert GraphStore(spark, store.path).execute("MATCH (a:A) RETURN a.v AS v").rows() == [(4,)]


def test_best_common_ancestors(store):
    root = store.resolve(None)
    store.execute("CREATE (:A)")
    store.branch_create("side")
    fork = store.resolve(None)
    store.execute("CREATE (:B)")
    store.execute("CREATE (:C)", branch="side")
    assert store.merge_bases(store.resolve("branch/main"), store.resolve("branch/side")) == [fork]
    assert store.merge_bases(root, store.resolve(None)) == [root]
