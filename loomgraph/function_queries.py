"""Registered queries that call every function of the library, with their DuckDB SQL.

Functions of table values are computed by both engines; functions whose results a
definition fixes (temporal values, conversions of constants) are compared with these
values written out in the SQL.
"""

from __future__ import annotations

#: name: (Cypher, SQL); the SQL has the same columns.
CYPHER: dict[str, tuple[str, str]] = {
    "trigonometry": (
        "MATCH (p:Part) WITH p.p_partkey AS k, p.p_size / 100.0 AS x RETURN k, round(acos(x), 9) AS a, round(asin(x), 9) AS b, round(atan(x), 9) AS c, round(atan2(x, 2.0), 9) AS d, round(cos(x), 9) AS e, round(sin(x), 9) AS f, round(tan(x), 9) AS g, round(cot(x), 6) AS h, round(haversin(x), 9) AS i",
        "SELECT p_partkey AS k, round(acos(x), 9) AS a, round(asin(x), 9) AS b, round(atan(x), 9) AS c, round(atan2(x, 2.0), 9) AS d, round(cos(x), 9) AS e, round(sin(x), 9) AS f, round(tan(x), 9) AS g, round(1 / tan(x), 6) AS h, round((1 - cos(x)) / 2, 9) AS i FROM (SELECT p_partkey, p_size / 100.0::DOUBLE AS x FROM part)",
    ),
    "hyperbolic": (
        "MATCH (p:Part) WITH p.p_partkey AS k, p.p_size / 10.0 AS x RETURN k, round(cosh(x), 4) AS a, round(sinh(x), 4) AS b, round(tanh(x), 9) AS c, round(coth(x), 6) AS d, round(degrees(x), 6) AS e, round(radians(x), 9) AS f, round(exp(x), 4) AS g, round(log(x), 9) AS h, round(log10(x), 9) AS i, ceiling(x) AS j",
        "SELECT p_partkey AS k, round((exp(x) + exp(-x)) / 2, 4) AS a, round((exp(x) - exp(-x)) / 2, 4) AS b, round((exp(x) - exp(-x)) / (exp(x) + exp(-x)), 9) AS c, round((exp(x) + exp(-x)) / (exp(x) - exp(-x)), 6) AS d, round(degrees(x), 6) AS e, round(radians(x), 9) AS f, round(exp(x), 4) AS g, round(ln(x), 9) AS h, round(log10(x), 9) AS i, ceil(x) AS j FROM (SELECT p_partkey, p_size / 10.0::DOUBLE AS x FROM part)",
    ),
    "number_constants": (
        "RETURN round(e(), 12) AS a, round(pi(), 12) AS b, isNaN(0.0 / 0.0) AS c, isNaN(1.5) AS d, 0.0 <= rand() < 1.0 AS f, isNaN(null) IS NULL AS g",
        "SELECT 2.718281828459::DOUBLE AS a, 3.14159265359::DOUBLE AS b, true AS c, false AS d, true AS f, true AS g",
    ),
    "string_trims": (
        "MATCH (n:Nation) WITH n.n_name AS n, 'xx ' + n.n_name + '  x' AS s RETURN n, trim('  ' + n + ' ') AS a, btrim(s, 'x') AS b, ltrim('  ' + n) AS c, rtrim(n + '  ') AS d, ltrim(s, 'x') AS e, rtrim(s, 'x') AS f",
        "SELECT n_name AS n, n_name AS a, ' ' || n_name || '  ' AS b, n_name AS c, n_name AS d, ' ' || n_name || '  x' AS e, 'xx ' || n_name || '  ' AS f FROM nation",
    ),
    "string_case": (
        "MATCH (n:Nation) RETURN n.n_name AS n, lower(n.n_name) AS a, upper(toLower(n.n_name)) AS b, toUpper('é' + n.n_name) AS c, char_length(n.n_name) AS d, character_length(n.n_name + 'é') AS e, n.n_name + '-' + n.n_name AS f, n.n_name || '!' AS g",
        "SELECT n_name AS n, lower(n_name) AS a, upper(n_name) AS b, 'É' || upper(n_name) AS c, length(n_name)::BIGINT AS d, (length(n_name) + 1)::BIGINT AS e, n_name || '-' || n_name AS f, n_name || '!' AS g FROM nation",
    ),
    "string_search": (
        "MATCH (n:Nation) WITH n.n_name AS n RETURN n, string.indexOf(n, 'A') AS a, string.join([n, 'x', n], '-') AS b, string.regexReplace(n, '[AEIOU]+', '_') AS c, normalize(n) AS d, n IS NORMALIZED AS e, n IS NFC NORMALIZED AS f",
        "SELECT n_name AS n, (instr(n_name, 'A') - 1)::BIGINT AS a, n_name || '-x-' || n_name AS b, regexp_replace(n_name, '[AEIOU]+', '_', 'g') AS c, n_name AS d, true AS e, true AS f FROM nation",
    ),
    "list_edits": (
        "MATCH (n:Nation) WITH n.n_nationkey AS k, [n.n_nationkey, n.n_regionkey, 3, n.n_regionkey] AS l RETURN k, coll.distinct([1, 1, k]) AS a, coll.flatten([[k], [2, 3]]) AS b, coll.indexOf([5, 6, k + 100], k + 100) AS c, coll.insert([1, 2], 1, k) AS d, coll.min(l) AS e, coll.remove([k, 8, 9], 0) AS f, size(l) AS g, cardinality(l) AS h, isEmpty([]) AS i, isEmpty(l) AS j",
        "SELECT n_nationkey::BIGINT AS k, CASE WHEN n_nationkey = 1 THEN [1] ELSE [1, n_nationkey] END::BIGINT[] AS a, [n_nationkey, 2, 3]::BIGINT[] AS b, 2::BIGINT AS c, [1, n_nationkey, 2]::BIGINT[] AS d, least(n_nationkey, n_regionkey, 3)::BIGINT AS e, [8, 9]::BIGINT[] AS f, 4::BIGINT AS g, 4::BIGINT AS h, true AS i, false AS j FROM nation",
    ),
    "list_conversions": (
        "RETURN toBooleanList(['true', 'no', 'FALSE']) AS a, toFloatList(['1.5', 'x']) AS b, toIntegerList(['7', 'x', '-2']) AS c, toStringList([1, 2]) AS d, [1, 2] + [3] AS e, [1] + 2 AS f",
        "SELECT [true, NULL, false] AS a, [1.5::DOUBLE, NULL] AS b, [7, NULL, -2]::BIGINT[] AS c, ['1', '2'] AS d, [1, 2, 3]::BIGINT[] AS e, [1, 2]::BIGINT[] AS f",
    ),
    "conversions_or_null": (
        "MATCH (c:Customer) RETURN c.c_custkey AS k, toBooleanOrNull(CASE WHEN c.c_custkey % 2 = 0 THEN 'true' ELSE 'x' END) AS a, toFloatOrNull(toString(c.c_custkey) + '.5') AS b, toFloatOrNull('x') AS d, toStringOrNull(c.c_nationkey) AS e, nullIf(c.c_nationkey, 3) AS f",
        "SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN true END AS a, c_custkey + 0.5::DOUBLE AS b, NULL::DOUBLE AS d, c_nationkey::VARCHAR AS e, nullif(c_nationkey, 3)::BIGINT AS f FROM customer",
    ),
    "type_predicates": (
        "RETURN 1 IS :: INTEGER AS a, 'x' IS :: STRING AS b, 1.5 IS :: INTEGER AS c, true IS TYPED BOOLEAN AS d, [1] IS :: LIST<INTEGER> AS e, 1 IS NOT :: FLOAT AS f, valueType(1) AS g, valueType('x') AS h, valueType(1.5) AS i",
        "SELECT true AS a, true AS b, false AS c, true AS d, true AS e, true AS f, 'INTEGER NOT NULL' AS g, 'STRING NOT NULL' AS h, 'FLOAT NOT NULL' AS i",
    ),
    "element_functions": (
        "MATCH (n:Nation)-[r:IN_REGION]->(g:Region) RETURN n.n_name AS n, startNode(r).n_name AS a, endNode(r).r_name AS b, id(startNode(r)) = id(n) AS c, size(keys(g)) AS d, 'r_name' IN keys(g) AS e, properties(g).r_name AS f, type(r) AS h, elementId(r) STARTS WITH 'r:' AS i, property_exists(n, n_name) AS j, exists((g)--()) AS l",
        "SELECT n_name AS n, n_name AS a, r_name AS b, true AS c, 2::BIGINT AS d, true AS e, r_name AS f, 'IN_REGION' AS h, true AS i, true AS j, true AS l FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "path_functions": (
        "MATCH p = (n:Nation)-[:IN_REGION]->(g:Region) RETURN n.n_name AS n, length(p) AS a, path_length(p) AS b, size(nodes(p)) AS c, size(relationships(p)) AS d, [r IN relationships(p) | type(r)] AS e",
        "SELECT n_name AS n, 1::BIGINT AS a, 1::BIGINT AS b, 2::BIGINT AS c, 1::BIGINT AS d, ['IN_REGION'] AS e FROM nation",
    ),
    "list_tests": (
        "MATCH (n:Nation) WITH n.n_nationkey AS k RETURN k, single(x IN [1, 2, k] WHERE x = 2) AS a, allReduce(s = 0, x IN [1, 2, k] | s + x, s < 10) AS b, reduce(s = '', x IN ['a', 'b'] | s + x) AS c",
        "SELECT n_nationkey::BIGINT AS k, n_nationkey <> 2 AS a, 3 + n_nationkey < 10 AS b, 'ab' AS c FROM nation",
    ),
    "maps": (
        "MATCH (n:Nation) WITH n, {key: n.n_nationkey, inner: {name: n.n_name}} AS m RETURN m.key AS a, m['key'] AS b, m.inner.name AS c, size(keys(m)) AS d, m.none IS NULL AS e, n['n_name'] AS f",
        "SELECT n_nationkey::BIGINT AS a, n_nationkey::BIGINT AS b, n_name AS c, 2::BIGINT AS d, true AS e, n_name AS f FROM nation",
    ),
    "aggregate_names": (
        "MATCH (p:Part) RETURN p.p_brand AS b, percentile_cont(p.p_size, 0.25) AS c, percentile_disc(p.p_size, 0.25) AS d, round(stdev_samp(p.p_size), 6) AS e, round(stdev_pop(p.p_size), 6) AS f, size(collect_list(p.p_size)) AS g",
        "SELECT p_brand AS b, quantile_cont(p_size, 0.25)::DOUBLE AS c, quantile_disc(p_size, 0.25)::BIGINT AS d, round(stddev_samp(p_size), 6) AS e, round(stddev_pop(p_size), 6) AS f, count(p_size)::BIGINT AS g FROM part GROUP BY 1",
    ),
    "date_values": (
        "RETURN toString(date('2024-02-29')) AS a, toString(date({year: 2024, month: 3, day: 5})) AS b, toString(date('2024-W10-2')) AS c, toString(date('2024-060')) AS d, toString(date({year: 2024, quarter: 2, dayOfQuarter: 3})) AS e, date('2024-02-29').week AS f, date('2024-02-29').ordinalDay AS g, date('2024-02-29').dayOfWeek AS h, toString(date('2024-01-31') + duration('P1M')) AS i, toString(date('2024-03-31') - duration({months: 1, days: 1})) AS j",
        "SELECT '2024-02-29' AS a, '2024-03-05' AS b, '2024-03-05' AS c, '2024-02-29' AS d, '2024-04-03' AS e, 9::BIGINT AS f, 60::BIGINT AS g, 4::BIGINT AS h, '2024-02-29' AS i, '2024-02-28' AS j",
    ),
    "datetime_values": (
        "RETURN datetime('2024-05-06T07:08:09Z').year AS a, datetime('2024-05-06T07:08:09Z').hour AS b, zoned_datetime('2024-05-06T07:08:09Z').epochSeconds AS c, datetime.fromEpoch(1714979289, 0).minute AS d, datetime.fromEpochMillis(1714979289000).second AS e, toString(localdatetime('2024-05-06T07:08:09')) AS f, local_datetime('2024-05-06T07:08:09').day AS g, datetime('2024-05-06T07:08:09Z') < datetime('2024-05-06T07:08:10Z') AS h, datetime('2024-05-06T09:08:09+02:00') = datetime('2024-05-06T07:08:09Z') AS i",
        "SELECT 2024::BIGINT AS a, 7::BIGINT AS b, 1714979289::BIGINT AS c, 8::BIGINT AS d, 9::BIGINT AS e, '2024-05-06T07:08:09' AS f, 6::BIGINT AS g, true AS h, true AS i",
    ),
    "time_values": (
        "RETURN toString(localtime('07:08:09')) AS a, local_time('07:08:09').minute AS b, time('07:08:09Z').hour AS c, zoned_time('07:08:09+01:00').second AS d, localtime('07:08:09') < localtime('07:08:10') AS e, toString(localtime('23:30:00') + duration('PT1H')) AS f",
        "SELECT '07:08:09' AS a, 8::BIGINT AS b, 7::BIGINT AS c, 9::BIGINT AS d, true AS e, '00:30:00' AS f",
    ),
    "clocks": (
        "RETURN date.realtime() >= date('2020-01-01') AS a, date.statement() = date.transaction() AS b, datetime.realtime() > datetime('2020-01-01T00:00:00Z') AS c, datetime.statement() = datetime.transaction() AS d, localdatetime.realtime() > localdatetime('2020-01-01T00:00:00') AS e, localdatetime.statement() = localdatetime.transaction() AS f, localtime.realtime() >= localtime('00:00:00') AS g, localtime.statement() = localtime.transaction() AS h, time.realtime() IS NOT NULL AS i, time.statement() = time.transaction() AS j, timestamp() > 1577836800000 AS k",
        "SELECT true AS a, true AS b, true AS c, true AS d, true AS e, true AS f, true AS g, true AS h, true AS i, true AS j, true AS k",
    ),
    "truncations": (
        "MATCH (o:Order) RETURN o.o_orderkey AS k, date.truncate('year', o.o_orderdate) AS a, date.truncate('quarter', o.o_orderdate) AS b, toString(localdatetime.truncate('hour', o.o_orderdate)) AS c, localtime.truncate('minute', localtime('07:08:09')) = localtime('07:08:00') AS d, time.truncate('hour', time('07:08:09Z')) = time('07:00:00Z') AS e, datetime.truncate('day', datetime('2024-05-06T07:08:09Z')) = datetime('2024-05-06T00:00:00Z') AS f",
        "SELECT o_orderkey AS k, date_trunc('year', o_orderdate)::DATE AS a, date_trunc('quarter', o_orderdate)::DATE AS b, strftime(date_trunc('hour', o_orderdate), '%Y-%m-%dT%H:%M:%S') AS c, true AS d, true AS e, true AS f FROM orders",
    ),
    "durations": (
        "MATCH (o:Order) WITH o.o_orderkey AS k, date(o.o_orderdate) AS d RETURN k, duration.inDays(date('1990-01-01'), d).days AS a, duration.inMonths(date('1990-01-01'), d).months AS b, duration.inSeconds(date('1990-01-01'), d).seconds AS c, duration.between(date('1990-01-01'), d).years AS e, duration_between(d, d).days AS f, toString(duration('P1Y2M3DT4H')) AS g, toString(duration({days: 1, hours: 2})) AS h, format(d, 'yyyy/MM/dd') AS i",
        "SELECT o_orderkey AS k, datediff('day', DATE '1990-01-01', o_orderdate::DATE)::BIGINT AS a, datesub('month', DATE '1990-01-01', o_orderdate::DATE)::BIGINT AS b, datediff('day', DATE '1990-01-01', o_orderdate::DATE)::BIGINT * 86400 AS c, (datesub('month', DATE '1990-01-01', o_orderdate::DATE) // 12)::BIGINT AS e, 0::BIGINT AS f, 'P1Y2M3DT4H' AS g, 'P1DT2H' AS h, strftime(o_orderdate, '%Y/%m/%d') AS i FROM orders",
    ),
    "uuids": (
        "WITH '123e4567-e89b-42d3-a456-426614174000' AS u RETURN size(randomUUID()) AS a, toString(uuid(u)) AS b, uuid.mostSignificantBits(uuid(u)) AS c, uuid.leastSignificantBits(uuid(u)) AS d",
        "SELECT 36::BIGINT AS a, '123e4567-e89b-42d3-a456-426614174000' AS b, 1314564453825200851::BIGINT AS c, -6605018797301088256::BIGINT AS d",
    ),
    "vector_functions": (
        "MATCH (q:Item {vec_id: 0}), (i:Item) WHERE i.vec_id < 20 RETURN i.vec_id AS k, round(vector.similarity.cosine(q.embedding, i.embedding), 5) AS a, round(vector.similarity.euclidean(q.embedding, i.embedding), 5) AS b, vector_dimension_count(vector(i.embedding, 64, FLOAT)) AS c, round(vector_norm(i.embedding, EUCLIDEAN), 5) AS d",
        "SELECT b.vec_id AS k, round((1 + list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / 2, 5) AS a, round(1 / (1 + list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2), 5) AS b, 64::BIGINT AS c, round(sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN b.embedding])), 5) AS d FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id < 20",
    ),
    # clauses
    "return_all": ("MATCH (n:Nation) RETURN ALL n.n_regionkey AS r", "SELECT n_regionkey::BIGINT AS r FROM nation"),
    "any_k_paths": ("MATCH p = ANY 2 (a:Turn {turn: 0})-[:NEXT]->{1,3}(b:Turn) RETURN b.turn AS t, count(*) AS n", "SELECT turn AS t, count(*)::BIGINT AS n FROM conversations WHERE turn BETWEEN 1 AND 3 GROUP BY 1"),
    "walk": (
        "MATCH WALK (a:Nation)-[:IN_REGION]-{2,2}(b) RETURN count(*) AS n",
        "SELECT count(*)::BIGINT AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey",
    ),
    "rel_id_seek": (f"MATCH (n)-[r:IN_REGION]->(g) WHERE id(r) = {(1 << 40) + 3} RETURN n.n_name AS n, g.r_name AS g", "SELECT n_name AS n, r_name AS g FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 3"),
    "when_correlated": (
        "MATCH (n:Nation) CALL (n) { WHEN n.n_regionkey = 0 THEN RETURN 'zero' AS w WHEN n.n_regionkey = 1 THEN RETURN 'one' AS w ELSE RETURN 'more' AS w } RETURN n.n_name AS n, w",
        "SELECT n_name AS n, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'more' END AS w FROM nation",
    ),
    "query_preamble": ("CYPHER 25 MATCH (r:Region) RETURN r.r_name AS n", "SELECT r_name AS n FROM region"),
    "schema_procedures": (
        "CALL db.relationshipTypes() YIELD relationshipType AS t RETURN 'type' AS kind, t UNION ALL CALL db.propertyKeys() YIELD propertyKey AS t WITH t WHERE t STARTS WITH 'r_' RETURN 'key' AS kind, t",
        "SELECT 'type' AS kind, unnest(['IN_REGION', 'IN_NATION', 'SUPPLIES_FROM', 'PLACED', 'CONTAINS', 'SUPPLIED_BY', 'NEXT']) AS t UNION ALL SELECT 'key', unnest(['r_name', 'r_regionkey'])",
    ),
    "show_functions": ("SHOW FUNCTIONS YIELD name WHERE name IN ['abs', 'count', 'tolower'] RETURN name", "SELECT unnest(['abs', 'count', 'tolower']) AS name"),
    "show_indexes": ("SHOW VECTOR INDEXES YIELD name, type RETURN name, type", "SELECT unnest(['item_vectors', 'item_euclid']) AS name, 'VECTOR' AS type"),
}
