"""Typed JSON and profiles."""

import json

import pytest

from loomgraph.errors import GraphError
from loomgraph.session import cypher
from loomgraph.sources.graph import GraphBuilder
from loomgraph.typed_json import parameters


@pytest.fixture(scope="module")
def graph(spark):
    b = GraphBuilder(spark).node("Shop", spark.createDataFrame([(1, "a", 2.5), (2, "b", None)], "k long, name string, size double"), "k")
    return b.rel("NEAR", spark.createDataFrame([(1, 2)], "a long, b long"), ("Shop", "a"), ("Shop", "b"), key="a").build()


def rows(graph, text, params="{}"):
    return json.loads(cypher(graph, text, parameters(params)).envelope())["rows"]


def test_values(graph):
    got = rows(graph, "RETURN 9007199254740993 AS a, 7 AS b, 1.5 AS c, 0.0 / 0.0 AS d, date('2024-02-03') AS e, localdatetime('2024-02-03T04:05:06') AS f, duration('P14M3DT-1.5S') AS g, point({x: 1.0, y: 2.0}) AS h, localtime('07:08:09.5') AS i, {a: [1, null]} AS j, datetime('2024-02-03T04:05:06Z') AS k")
    assert got == [[
        {"$type": "Integer", "value": "9007199254740993"}, 7, 1.5, {"$type": "Float", "value": "NaN"}, {"$type": "Date", "value": "2024-02-03"}, {"$type": "LocalDateTime", "value": "2024-02-03T04:05:06"},
        {"$type": "Duration", "value": "P1Y2M3DT-1.5S"}, {"$type": "Point", "crs": "cartesian", "coordinates": [1.0, 2.0]}, {"$type": "LocalTime", "value": "07:08:09.5"}, {"a": [1, None]},
        {"$type": "ZonedDateTime", "value": "2024-02-03T04:05:06Z", "zone": "Z"},
    ]]


def test_elements(graph):
    ((n, r, p),) = rows(graph, "MATCH p = (n:Shop)-[r:NEAR]->(m) RETURN n, r, p")
    assert n["$type"] == "Node" and n["labels"] == ["Shop"] and n["properties"] == {"k": 1, "name": "a", "size": 2.5}
    assert r["type"] == "NEAR" and r["start"] == n["elementId"] and r["properties"] == {}
    assert p["$type"] == "Path" and len(p["nodes"]) == 2 and p["nodes"][1]["properties"] == {"k": 2, "name": "b"} and p["relationships"][0]["elementId"] == r["elementId"]


def test_parameters(graph):
    params = {
        "i": {"$type": "Integer", "value": "9223372036854775807"}, "d": {"$type": "Date", "value": "2026-10-15"}, "m": {"$type": "Map", "entries": {"$type": "mine", "x": 1}},
        "t": {"$type": "Duration", "value": "P1D"}, "p": {"$type": "Point", "crs": "cartesian", "coordinates": [3.0, 4.0]}, "v": {"$type": "Vector", "coordinateType": "F64", "dimension": 2, "values": [1, 0.5]},
    }
    got = rows(graph, "RETURN $i AS i, $d AS d, $m AS m, toString($d + $t) AS t, point.distance($p, point({x: 0, y: 0})) AS p, $v[1] AS v", json.dumps(params))
    assert got == [[params["i"], params["d"], params["m"], "2026-10-16", 5.0, 0.5]]
    for bad in ('[1]', '{"x": {"$type": "Node", "elementId": "n:1"}}', '{"x": {"$type": "Date"}}', '{"x": {"$type": "date", "value": "2026-10-15"}}'):
        with pytest.raises(GraphError, match="INVALID_ARGUMENT"):
            parameters(bad)


def test_profile_runs(graph):
    said = json.loads(cypher(graph, "PROFILE MATCH (n:Shop) WHERE n.k > 1 RETURN n.name AS n").envelope())
    assert said["rows"] == [["b"]] and said["summary"]["queryType"] == "read"
    operators = said["summary"]["profile"]["operators"]
    assert [o["id"] for o in operators] == list(range(len(operators))) and any(o["rows"] == 1 for o in operators)
