"""A few registered queries against their SQL at the smallest scale."""

import glob
import math
import os
import random

import duckdb
import pytest

from loomgraph import queries as graph
from loomgraph import version_queries as versions

DATA = "/root/testdata/sf0.001"
NAMES = ["group_implicit", "expand_into", "optional_where_inside", "collect_sub", "varlen_1_3", "vector_topk_cosine", "string_functions", "graph_view_filter", "diff_ops"]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    q, sql = {**graph.QUERIES, **versions.QUERIES}[name], {**graph.ORACLE_SQL, **versions.ORACLE_SQL}[name]
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = q(spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    rel = con.sql(sql)
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["vector_topk_cosine", "vector_topk_euclidean", "vector_filter_before"])
@pytest.mark.parametrize("copies", ["near", "scaled"])
def test_vectors_of_nearly_equal_scores(spark, tmp_path, name, copies):
    """Scores that round to one number rank by key, as in the SQL; scaled copies rank by the last bits of the cosine."""
    for f in glob.glob(f"{DATA}/*.parquet"):
        if os.path.basename(f) != "embeddings.parquet":
            os.symlink(f, tmp_path / os.path.basename(f))
    draw = random.Random(5)
    base = [draw.gauss(0, 1) for _ in range(8)]
    rows = [(0, base, 3)] + [(i, [x + draw.gauss(0, 1) for x in base], 3) for i in range(1, 20)]
    for i in range(20, 60):  # the nearer, the greater the key
        rows.append((i, [x * (1 + 0.37 * (i - 19)) if copies == "scaled" else x + (60 - i) * 1e-5 * (-1) ** j for j, x in enumerate(base)], 3))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted(tuple(r) for r in graph.QUERIES[name](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(graph.ORACLE_SQL[name]).fetchall())


def test_cosine_has_bounds(spark):
    """Copies have 1 and no more, products beyond the doubles do not turn to 0, and what is no number stays so."""
    from loomgraph.functions.vectors import cosine

    pairs = [([0.3, 0.7, 0.1], [x * 1.7 for x in (0.3, 0.7, 0.1)]), ([3e100, 1.0], [1e100, 2e100]), ([3e-150, 1e-150], [1.0, 2.0]), ([1.0, 0.0], [-2.0, 0.0]), ([math.nan, 1.0], [1.0, 2.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>")
    got = [r[0] for r in df.select(cosine(df.a, df.b)).collect()]
    assert got[:4] == pytest.approx([1.0, 0.2**0.5, 0.5**0.5, -1.0]) and max(got[:4]) <= 1
    assert math.isnan(got[4]) and got[5] is None
