"""Queries over small graphs, with results worked out by hand."""

import pytest

from loomgraph.cypher import parse
from loomgraph.errors import GraphError
from loomgraph.session import cypher, validate
from loomgraph.sources.graph import GraphBuilder


@pytest.fixture(scope="module")
def works(spark):
    """Pumps of a water works, with the flow of the pipes between them."""
    b = GraphBuilder(spark)
    b.node("Pump", spark.createDataFrame([(1, "N"), (2, "E"), (3, "S"), (4, "M"), (5, "W")], "k long, name string"), "k", ["name"])
    pipes = [(1, 1, 2, 4), (2, 1, 3, 3), (3, 2, 4, 5), (4, 3, 4, 6), (5, 3, 2, 7), (6, 4, 5, 2)]
    b.rel("PIPE", spark.createDataFrame(pipes, "k long, a long, b long, flow long"), ("Pump", "a"), ("Pump", "b"), key="k", props=["flow"])
    return b.build()


CASES = [
    ("MATCH (a:Pump {name: 'S'})-[r:PIPE]->(b) RETURN b.name AS n, r.flow AS f ORDER BY f", [("M", 6), ("E", 7)]),
    ("MATCH (a:Pump) OPTIONAL MATCH (a)-[r:PIPE]->(b) WHERE r.flow > 6 RETURN a.name AS a, b.name AS b ORDER BY a", [("E", None), ("M", None), ("N", None), ("S", "E"), ("W", None)]),
    ("MATCH (a:Pump) WHERE NOT (a)<-[:PIPE]-() RETURN a.name AS n", [("N",)]),
    ("MATCH (a:Pump) RETURN a.name AS n, COUNT { (a)<-[:PIPE]-() } AS k, COLLECT { MATCH (a)<-[:PIPE]-(b) RETURN b.name ORDER BY b.name } AS l ORDER BY n", [("E", 2, ["N", "S"]), ("M", 2, ["E", "S"]), ("N", 0, []), ("S", 1, ["N"]), ("W", 1, ["M"])]),
    ("MATCH (a:Pump) CALL (a) { MATCH (a)-[r:PIPE]->() RETURN sum(r.flow) AS f } RETURN a.name AS n, f ORDER BY n", [("E", 5), ("M", 2), ("N", 7), ("S", 13), ("W", 0)]),
    ("MATCH p = (a:Pump {name: 'S'})-[:PIPE*2..3]->(b {name: 'W'}) RETURN length(p) AS l ORDER BY l", [(2,), (3,)]),
    ("MATCH p = SHORTEST 3 (a:Pump {name: 'N'})-[:PIPE]->+(b:Pump {name: 'W'}) RETURN length(p) AS l ORDER BY l", [(3,), (3,), (4,)]),
    ("MATCH p = ALL SHORTEST (a:Pump {name: 'N'})-[:PIPE]->+(b:Pump {name: 'M'}) RETURN [x IN nodes(p) | x.name][1] AS n ORDER BY n", [("E",), ("S",)]),
    ("MATCH (a:Pump {name: 'N'})((x)-[r:PIPE]->(y) WHERE r.flow < 6){1,3}(b) RETURN b.name AS n, [q IN x | q.name] AS xs, reduce(s = 0, q IN r | s + q.flow) AS f ORDER BY n", [("E", ["N"], 4), ("M", ["N", "E"], 9), ("S", ["N"], 3), ("W", ["N", "E", "M"], 11)]),
    ("MATCH (a:Pump {name: 'S'})-[r:PIPE]->(b), (a)-[q:PIPE]->(c) RETURN count(*) AS k", [(2,)]),
    ("MATCH REPEATABLE ELEMENTS (a:Pump {name: 'S'})-[r:PIPE]->(b), (a)-[q:PIPE]->(c) RETURN count(*) AS k", [(4,)]),
    ("MATCH (a:Pump {name: 'S'})-[:PIPE]->{0,2}(b) RETURN b.name AS n, count(*) AS k ORDER BY n", [("E", 1), ("M", 2), ("S", 1), ("W", 1)]),
    ("MATCH p = (b)<-[r:PIPE*0..2]-(a:Pump {name: 'N'}) RETURN [x IN nodes(p) | x.name] AS n, [x IN r | x.flow] AS f, length(p) AS l ORDER BY l, n[0], n[1]", [(["N"], [], 0), (["E", "N"], [4], 1), (["S", "N"], [3], 1), (["E", "S", "N"], [7, 3], 2), (["M", "E", "N"], [5, 4], 2), (["M", "S", "N"], [6, 3], 2)]),
    ("MATCH p = (b)<-[:PIPE*2..2]-(a:Pump {name: 'N'}) RETURN length(p) AS l, size(nodes(p)) AS k", [(2, 3)] * 3),
    ("MATCH (a)-[r:PIPE]->(b) WHERE r.flow = 7 RETURN startNode(r).name AS s, endNode(r).name AS e", [("S", "E")]),
    ("UNWIND [5, 8, 6] AS x WITH x ORDER BY x DESC RETURN collect(x) AS l", [([8, 6, 5],)]),
    ("UNWIND [4, 7] AS x CALL (x) { UNWIND [x, 100] AS m RETURN x + m AS p } RETURN x, p ORDER BY x, p", [(4, 8), (4, 104), (7, 14), (7, 107)]),
    ("RETURN 9 / 4 AS a, -9 / 4 AS b, 3 ^ 2 AS c, 2 < 5 < 9 AS d, null IN [] AS e, 4 IN [3, null] AS f", [(2, -2, 9.0, True, False, None)]),
    ("RETURN round(-2.5) AS a, toInteger('8.7') AS b, range(5, 2) AS c, substring('granite', 2, 4) AS d", [(-2.0, 8, [], "anit")]),
    ("RETURN toString(duration('P2Y1M4DT6H7M8.25S')) AS a, duration.inMonths(date('2019-03-10'), date('2021-01-09')).months AS b", [("P2Y1M4DT6H7M8.25S", 21)]),
    ("WITH 6 AS n CALL (n) { RETURN n * 2 AS v UNION ALL RETURN n * 3 AS v } RETURN n, v ORDER BY v", [(6, 12), (6, 18)]),
    ("RETURN 'a' AS a UNION RETURN 'a' AS a", [("a",)]),
    ("WHEN 2 > 3 THEN RETURN 'yes' AS x ELSE RETURN 'no' AS x", [("no",)]),
    ("UNWIND [null, 9, 1] AS x RETURN sum(x) AS s, count(x) AS c, count(*) AS n", [(10, 2, 3)]),
    ("UNWIND [1, 2, 3] AS x FILTER x > 1 FINISH", []),
]


@pytest.mark.parametrize("text,want", CASES, ids=range(len(CASES)))
def test_query(works, text, want):
    assert cypher(works, text).rows() == want


def test_errors(works):
    with pytest.raises(GraphError, match="TYPE_ERROR"):
        cypher(works, "RETURN 1 = 'a' AS x")
    with pytest.raises(GraphError, match="SEMANTIC_ERROR"):
        cypher(works, "RETURN y AS x")
    with pytest.raises(GraphError, match="SYNTAX_ERROR"):
        parse("MATCH (a RETURN a")
    assert validate("CREATE (:A)")["type"] == "write"
    assert not validate("MATCH (a")["valid"]


def test_pushdown_reads_only_needed_columns(spark, works, tmp_path):
    spark.createDataFrame([(1, "A", "x" * 10)], "k long, name string, unused string").write.parquet(str(tmp_path / "c"))
    g = GraphBuilder(spark).node("Pump", spark.read.parquet(str(tmp_path / "c")), "k").build()
    plan = cypher(g, "MATCH (c:Pump) WHERE c.name = 'A' RETURN c.k AS k").df._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in plan.split("ReadSchema")[1] and "EqualTo(name,A)" in plan


def test_events(works):
    kinds = [k for _, k, _ in cypher(works, "MATCH (c:Pump) RETURN c.name AS n").events()]
    assert kinds == ["columns", *["row"] * 5, "summary"]


def test_steps_that_multiply_rows_come_last(spark):
    """Buyers meet the sellers of their town by the lines of their bills; pairs of a town's people are not made."""
    b = GraphBuilder(spark)
    b.node("Town", spark.range(2), "id").node("Buyer", spark.range(40).selectExpr("id", "id % 2 as town"), "id", ["town"])
    b.node("Seller", spark.range(30).selectExpr("id", "id % 2 as town"), "id", []).node("Bill", spark.range(60).selectExpr("id", "id % 40 as buyer"), "id", [])
    b.rel("LIVES", spark.range(40).selectExpr("id", "id % 2 as town"), ("Buyer", "id"), ("Town", "town"), key="id")
    b.rel("SITS", spark.range(30).selectExpr("id", "id % 2 as town"), ("Seller", "id"), ("Town", "town"), key="id")
    b.rel("GOT", spark.range(60).selectExpr("id", "id % 40 as buyer"), ("Buyer", "buyer"), ("Bill", "id"), key="id")
    lines = spark.range(120).selectExpr("id as line", "id % 60 as bill", "(id * 7) % 30 as seller")
    b.rel("FROM", lines, ("Bill", "bill"), ("Seller", "seller"), key="line")
    g = b.build()
    text = "MATCH (b:Buyer)-[:LIVES]->(t:Town)<-[:SITS]-(s:Seller), (b)-[:GOT]->(l:Bill)-[:FROM]->(s) WHERE b.town = 1 RETURN t AS t, count(DISTINCT l) AS n"
    profile = cypher(g, "PROFILE " + text).summary["profile"]
    assert max(p["rows"] or 0 for p in profile) <= 120  # 20 buyers and 15 sellers of a town are 300 pairs
    assert [r[-1] for r in cypher(g, text).rows()] == [30]
    # on rows that are there, with a node that no step reaches
    assert cypher(g, "MATCH (s:Seller) WITH s MATCH (b:Buyer)-[:LIVES]->(t)<-[:SITS]-(s), (b)-[:GOT]->()-[:FROM]->(s), (x:Town) RETURN count(*) AS n").rows() == [(240,)]


def test_paths_read_only_what_is_asked_of_their_elements(spark, tmp_path):
    """Of a path's nodes the properties that a query names, from the tables that its relationships can end in."""
    spark.createDataFrame([(1, "N", "x"), (2, "E", "y"), (3, "S", "z")], "k long, name string, story string").coalesce(1).write.parquet(str(tmp_path / "c"))
    spark.createDataFrame([(1, 1, 2, 4, "u"), (2, 2, 3, 6, "v")], "k long, a long, b long, flow long, log string").coalesce(1).write.parquet(str(tmp_path / "r"))

    def never():
        raise AssertionError("a table that no pipe ends in is read")

    b = GraphBuilder(spark).node("Pump", spark.read.parquet(str(tmp_path / "c")), "k").node("Book", never, "k")
    g = b.rel("PIPE", spark.read.parquet(str(tmp_path / "r")), ("Pump", "a"), ("Pump", "b"), key="k", props=["flow", "log"]).build()
    for text, want in [
        ("MATCH p = (a:Pump {k: 1})-[:PIPE*1..2]->(b:Pump) RETURN [x IN nodes(p) | x.name] AS n, reduce(s = 0, r IN relationships(p) | s + r.flow) AS f ORDER BY f", [(["N", "E"], 4), (["N", "E", "S"], 10)]),
        ("MATCH p = (b:Pump)<-[:PIPE*2..2]-(a:Pump {k: 1}) RETURN [x IN nodes(p) WHERE x.name <> 'E' | x.name] AS n, all(x IN nodes(p) WHERE x.k > 0) AS f", [(["S", "N"], True)]),
        ("MATCH p = (a:Pump)-[:PIPE]->(:Pump)-[:PIPE]->(b:Pump) RETURN [x IN nodes(p) | x.name] AS n, [r IN relationships(p) | r.flow] AS f", [(["N", "E", "S"], [4, 6])]),
    ]:
        result = cypher(g, text)
        assert result.rows() == want
        plan = result.df._jdf.queryExecution().executedPlan().toString()
        read = [x.split(">")[0] for x in plan.split("ReadSchema")[1:]]
        assert read and not any("story" in x or "log" in x for x in read)
    # elements that are read whole have all
    assert cypher(g, "MATCH p = (a:Pump {k: 1})-[:PIPE*1..1]->(b:Pump) RETURN [x IN nodes(p) | x{.*}.story] AS n").rows() == [(["x", "y"],)]
