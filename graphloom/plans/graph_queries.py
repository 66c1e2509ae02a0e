"""Graph queries: lineage, impact, traces, subgraphs, centrality, communities, resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import analytics as A
from ..operators import resolution as R
from ..operators import search as S
from ..operators import traversal as T
from ..operators.graph_tables import edge_parts, edges, symbols, table
from ..storage import materialise
from .oracle_parts import DEGREES, EDGES, GRAPH, SYMBOLS

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = (run, sql)
        return run

    return add


def _distances(root: str, depth: int, near: str, far: str) -> str:
    """CTEs d0..dn: nodes first reached at each depth."""
    out = [f"d0 AS (SELECT '{root}' AS node, 0 AS depth)"]
    for i in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT node FROM d{j}" for j in range(i))
        out.append(f"d{i} AS MATERIALIZED (SELECT DISTINCT {far} AS node, {i} AS depth FROM edges WHERE {near} IN (SELECT node FROM d{i - 1}) AND {far} NOT IN ({seen}))")
    return ", ".join(out) + ", dist AS (" + " UNION ALL ".join(f"SELECT * FROM d{i}" for i in range(depth + 1)) + ")"


MATERIALIZED = GRAPH.replace("edges AS (", "edges AS MATERIALIZED (").replace("symbols AS (", "symbols AS MATERIALIZED (")


@query("references_1hop", f"WITH {EDGES} SELECT src, tgt, edge_type, CASE WHEN src = 'N:18' THEN 'outgoing' ELSE 'incoming' END AS direction FROM edges WHERE src = 'N:18' OR tgt = 'N:18'")
def _(spark, d):
    e = edges(spark, d).where("src = 'N:18' or tgt = 'N:18'")
    return e.select("src", "tgt", "edge_type", F.when(F.col("src") == "N:18", "outgoing").otherwise("incoming").alias("direction"))


_UP, _DOWN = _distances("S:7", 2, "tgt", "src"), _distances("C:10", 2, "src", "tgt")


@query("lineage_up", f"WITH {MATERIALIZED}, {_UP} SELECT DISTINCT src, tgt, edge_type FROM edges WHERE tgt IN (SELECT node FROM dist)")
def _(spark, d):
    return T.lineage_edges(edges(spark, d), "S:7", "upstream", 3).select("src", "tgt", "edge_type")


@query("lineage_down", f"WITH {MATERIALIZED}, {_DOWN} SELECT DISTINCT src, tgt, edge_type FROM edges WHERE src IN (SELECT node FROM dist)")
def _(spark, d):
    return T.lineage_edges(edges(spark, d), "C:10", "downstream", 3).select("src", "tgt", "edge_type")


_P_UP, _P_DOWN = _distances("P:5", 1, "tgt", "src"), _distances("P:5", 1, "src", "tgt").replace("d0", "e0").replace("d1", "e1").replace("dist", "dist2")


@query("lineage_both", f"WITH {MATERIALIZED}, {_P_UP}, {_P_DOWN} SELECT DISTINCT src, tgt, edge_type FROM edges WHERE tgt IN (SELECT node FROM dist) OR src IN (SELECT node FROM dist2)")
def _(spark, d):
    return T.lineage_edges(edges(spark, d), "P:5", "both", 2).select("src", "tgt", "edge_type")


@query("lineage_nodes", f"WITH {MATERIALIZED}, {_P_UP}, {_P_DOWN}, l AS (SELECT src, tgt FROM edges WHERE tgt IN (SELECT node FROM dist) OR src IN (SELECT node FROM dist2)) SELECT id, name, kind FROM symbols WHERE id IN (SELECT src FROM l UNION SELECT tgt FROM l)")
def _(spark, d):
    return T.lineage_nodes(symbols(spark, d), T.lineage_edges(edges(spark, d), "P:5", "both", 2)).select("id", "name", "kind")


def _column_graph(spark, d):
    """Customers' parts as direct copies, parts' suppliers as transformations."""
    kind = F.when(F.col("edge_type") == "uses_table", "direct_copy").when(F.col("edge_type") == "depends_on", "transforms_to").otherwise(F.col("edge_type"))
    return edges(spark, d).withColumn("edge_type", kind)


@query("column_lineage", f"""WITH {MATERIALIZED.replace("'uses_table'", "'direct_copy'").replace("'depends_on'", "'transforms_to'")}, ce AS MATERIALIZED (SELECT * FROM edges WHERE edge_type IN ('direct_copy', 'transforms_to')),
{_distances("P:9", 1, "tgt", "src").replace("FROM edges", "FROM ce")}, {_distances("P:9", 1, "src", "tgt").replace("FROM edges", "FROM ce").replace("d0", "e0").replace("d1", "e1").replace("dist", "dist2")},
l AS (SELECT src, tgt FROM ce WHERE tgt IN (SELECT node FROM dist) OR src IN (SELECT node FROM dist2)) SELECT id, qualified_name, regexp_replace(qualified_name, '\\.[^.]*$', '') AS table_name, kind FROM symbols WHERE id IN (SELECT src FROM l UNION SELECT tgt FROM l)""")
def _(spark, d):
    nodes, _found = T.column_lineage(symbols(spark, d), _column_graph(spark, d), "P:9", "both", 2)
    return nodes.select("id", "qualified_name", "table_name", "kind")


_IMPACT = _distances("S:3", 3, "tgt", "src")


@query("impact", f"""WITH {MATERIALIZED}, {_IMPACT}, via AS (SELECT d.node, d.depth, min(e.tgt || '|' || e.edge_type) AS first FROM dist d JOIN edges e ON e.src = d.node JOIN dist p ON p.node = e.tgt AND p.depth = d.depth - 1 GROUP BY 1, 2)
SELECT node AS id, depth, CASE depth WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, depth = 1 AS is_direct FROM dist WHERE depth > 0""")
def _(spark, d):
    return T.impact(symbols(spark, d), edges(spark, d), "S:3", "delete", 3).select("id", "depth", "severity", "is_direct")


@query("impact_tool", f"""WITH {MATERIALIZED}, {_distances("P:11", 3, "src", "tgt")} SELECT node AS id, 'dependency' AS role, depth FROM dist WHERE depth > 0
UNION ALL SELECT DISTINCT src, 'caller', 1 FROM edges WHERE tgt = 'P:11' AND src NOT IN (SELECT node FROM dist)""")
def _(spark, d):
    return T.impact_outgoing(symbols(spark, d), edges(spark, d), "P:11", "delete", 3).select("id", "role", "depth")


_TRACE = _distances("P:11", 2, "tgt", "src") + ", " + _distances("P:11", 2, "src", "tgt").replace("d0", "e0").replace("d1", "e1").replace("d2", "e2").replace("dist", "dist2")
_WALKED = f"""WITH {MATERIALIZED}, {_TRACE}, up AS (SELECT d.node, d.depth, min(e.tgt) AS via FROM dist d JOIN edges e ON e.src = d.node JOIN dist p ON p.node = e.tgt AND p.depth = d.depth - 1 GROUP BY 1, 2),
down AS (SELECT d.node, d.depth, min(e.src) AS via FROM dist2 d JOIN edges e ON e.tgt = d.node JOIN dist2 p ON p.node = e.src AND p.depth = d.depth - 1 GROUP BY 1, 2),
walked AS (SELECT *, 'upstream' AS side FROM up UNION ALL SELECT *, 'downstream' FROM down),
traced AS (SELECT w.node AS id, side, depth, via, v.language AS from_language, n.language, v.language <> n.language AS transition FROM walked w JOIN symbols n ON n.id = w.node JOIN symbols v ON v.id = w.via)"""


@query("trace_cross_language", f"{_WALKED} SELECT * FROM traced")
def _(spark, d):
    return T.trace(symbols(spark, d), edges(spark, d), "P:11", "full", 2).select("id", "side", "depth", "via", "from_language", "language", "transition")


@query("trace_transitions", f"{_WALKED} SELECT count(*) FILTER (WHERE transition) AS transitions FROM traced")
def _(spark, d):
    return T.trace_summary(T.trace(symbols(spark, d), edges(spark, d), "P:11", "full", 2)).select("transitions")


@query("trace_groups", f"{_WALKED} SELECT language, count(*) AS nodes, min(depth) AS first_depth FROM traced GROUP BY language")
def _(spark, d):
    return T.trace_groups(T.trace(symbols(spark, d), edges(spark, d), "P:11", "full", 2)).groupBy("language").agg(F.sum("nodes").alias("nodes"), F.min("first_depth").alias("first_depth"))


@query("subgraph_edges", f"WITH {GRAPH}, n AS (SELECT id FROM symbols WHERE (kind = 'table' AND qualified_name LIKE 'Brand#1%') OR kind = 'interface') SELECT src, tgt, edge_type, max(confidence) AS confidence FROM edges WHERE src IN (SELECT id FROM n) AND tgt IN (SELECT id FROM n) GROUP BY 1, 2, 3")
def _(spark, d):
    s = symbols(spark, d)
    return T.induced_edges(edges(spark, d), s.where("(kind = 'table' and qualified_name like 'Brand#1%') or kind = 'interface'"))


@query("subgraph_budget", f"""WITH {GRAPH}, {DEGREES}, t AS (SELECT id, in_degree, 60 + floor(octet_length(encode(name)) / 4)::BIGINT AS cost FROM degrees JOIN symbols USING (id) WHERE kind = 'module'),
r AS (SELECT *, sum(cost) OVER (ORDER BY in_degree DESC, id)::BIGINT AS running FROM t) SELECT id, cost, running FROM r WHERE running <= 1000""")
def _(spark, d):
    s = symbols(spark, d)
    n = s.where("kind = 'module'").join(A.degrees(s, edges(spark, d)), "id")
    n = n.withColumn("cost", X.symbol_cost(F.lit("standard"), F.col("name")).cast("long"))
    return T.within_budget(n, 1000, order=("in_degree",)).select("id", "cost", F.col("running").cast("long").alias("running"))


@query("subgraph_nodes")
def _(spark, d):
    return T.subgraph(symbols(spark, d), edges(spark, d), symbols(spark, d).where("id = 'P:11'"), 2, 50)


def _pagerank_sql(rounds: int = A.ITERATIONS) -> str:
    out = f"""WITH {EDGES.replace("edges AS (", "edges AS MATERIALIZED (")}, nodes AS MATERIALIZED (SELECT src AS id FROM edges UNION SELECT tgt FROM edges), n AS (SELECT count(*)::DOUBLE AS n FROM nodes),
outs AS MATERIALIZED (SELECT src, count(*)::DOUBLE AS w FROM edges GROUP BY src), r0 AS MATERIALIZED (SELECT id, 1 / n AS rank FROM nodes, n)"""
    for i in range(1, rounds + 1):
        p = f"r{i - 1}"
        out += f""", r{i} AS MATERIALIZED (SELECT nodes.id, 0.15 / n + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM {p} WHERE id NOT IN (SELECT src FROM outs)) / n) AS rank FROM nodes CROSS JOIN n
 LEFT JOIN (SELECT tgt, sum({p}.rank / outs.w) AS got FROM edges JOIN {p} ON {p}.id = edges.src JOIN outs ON outs.src = edges.src GROUP BY tgt) g ON g.tgt = nodes.id)"""
    return out + f" SELECT id, round(rank, 6) AS pagerank FROM r{rounds}"


@query("pagerank", _pagerank_sql())
def _(spark, d):
    return A.pagerank(materialise(edges(spark, d), "edges"))


@query("top_pagerank", f"SELECT * FROM ({_pagerank_sql()}) ORDER BY pagerank DESC, id LIMIT 10")
def _(spark, d):
    return A.pagerank(materialise(edges(spark, d), "edges")).orderBy(F.desc("pagerank"), "id").limit(10)


def _lpa_sql(rounds: int = 6) -> str:
    out = f"""WITH {MATERIALIZED}, votes AS MATERIALIZED (SELECT a, b, sum(w) AS w FROM (SELECT src AS a, tgt AS b, 1 AS w FROM edges UNION ALL SELECT tgt, src, 1 FROM edges UNION ALL SELECT id, id, 1 FROM symbols) GROUP BY a, b),
l0 AS MATERIALIZED (SELECT id, id AS label FROM symbols)"""
    for i in range(1, rounds + 1):
        out += f""", l{i} AS MATERIALIZED (SELECT a AS id, label FROM (SELECT a, label, row_number() OVER (PARTITION BY a ORDER BY sum(w) DESC, label) AS r FROM votes JOIN l{i - 1} ON l{i - 1}.id = b GROUP BY a, label) WHERE r = 1)"""
    return out + f" SELECT id, label FROM l{rounds}"


@query("lpa", _lpa_sql())
def _(spark, d):
    return A.label_propagation(symbols(spark, d), edge_parts(spark, d), 6)


@query("clusters", _lpa_sql(A.ROUNDS).replace(f" SELECT id, label FROM l{A.ROUNDS}", f", g AS (SELECT label, row_number() OVER (ORDER BY min(id)) AS cluster_id FROM l{A.ROUNDS} GROUP BY label HAVING count(*) >= 3) SELECT id, coalesce(cluster_id, 0)::INTEGER AS cluster_id FROM l{A.ROUNDS} LEFT JOIN g USING (label)"))
def _(spark, d):
    return A.clusters(symbols(spark, d), edge_parts(spark, d))


@query("suffix_resolve", f"""WITH {SYMBOLS}, refs AS (SELECT DISTINCT n_name || '.' || c_name AS ref FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT c_name FROM customer UNION SELECT n_name FROM nation UNION SELECT 'no.such'),
c AS (SELECT ref, id, row_number() OVER (PARTITION BY ref ORDER BY qualified_name, id) AS n FROM refs JOIN (SELECT id, qualified_name, unnest(list_transform(range(1, len(string_split(qualified_name, '.')) + 1), lambda i: array_to_string(string_split(lower(qualified_name), '.')[i:], '.'))) AS suffix FROM symbols) s ON s.suffix = lower(ref))
SELECT ref, id FROM c WHERE n = 1""")
def _(spark, d):
    customer, nation = table(spark, d, "customer"), table(spark, d, "nation")
    refs = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws(".", "n_name", "c_name").alias("ref"))
    refs = refs.union(customer.select("c_name")).union(nation.select("n_name")).union(spark.createDataFrame([("no.such",)], "ref string"))
    return R.suffix_resolve(refs, symbols(spark, d))


@query("tiered_resolve", f"""WITH {SYMBOLS}, s AS (SELECT id, qualified_name AS qn, string_split(qualified_name, '.')[-1] AS short FROM symbols),
refs AS (SELECT c_custkey AS ref_id, CASE c_custkey % 4 WHEN 0 THEN upper(n_name) WHEN 1 THEN r_name || '.' || n_name WHEN 2 THEN lower(n_name) ELSE 'missing' || c_custkey END AS want, 'C:' || c_custkey AS src FROM customer JOIN place ON c_nationkey = n_nationkey),
c AS (SELECT ref_id, src, 0 AS tier, qn, id FROM refs JOIN s ON want = qn
 UNION ALL SELECT ref_id, src, 3, qn, id FROM refs JOIN (SELECT short, min(qn) AS qn, min(id) AS id FROM s GROUP BY short HAVING count(DISTINCT id) = 1) u ON want = short
 UNION ALL SELECT ref_id, src, 4, qn, id FROM refs JOIN s ON lower(want) = lower(short))
SELECT ref_id, src, id AS tgt, tier::INTEGER AS tier FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY tier, qn, id) AS n FROM c) WHERE n = 1 AND src <> id""")
def _(spark, d):
    s = symbols(spark, d).withColumn("path", F.col("file_id")).withColumn("start_line", F.lit(1))
    place = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 4
    want = F.when(k == 0, F.upper("n_name")).when(k == 1, F.concat_ws(".", "r_name", "n_name")).when(k == 2, F.lower("n_name")).otherwise(F.concat(F.lit("missing"), F.col("c_custkey").cast("string")))
    refs = c.select(F.col("c_custkey").alias("ref_id"), F.lit("?").alias("path"), F.lit("none").alias("language"), F.concat_ws(".", "r_name", "n_name", "c_name").alias("from_symbol"), want.alias("to_name"), F.lit("").alias("to_qualified"), F.lit("references").alias("reference_type"), F.lit(0.0).alias("confidence"))
    return R.resolve_references(refs, s).select("ref_id", "src", "tgt", "tier")


@query("column_edges", f"""WITH {SYMBOLS}, s AS (SELECT id, lower(qualified_name) AS qn FROM symbols), refs AS (SELECT p_partkey AS ref_id, p_name || '_' || p_partkey AS src_col, 'nation_' || (p_partkey % 30) AS tgt_col, CASE p_partkey % 3 WHEN 0 THEN 'direct_copy' WHEN 1 THEN 'aggregate' ELSE 'filter' END AS kind FROM part),
x AS (SELECT ref_id, min(id) AS src FROM refs JOIN s ON s.qn = lower(src_col) OR s.qn LIKE '%.' || replace(lower(src_col), '_', '\\_') ESCAPE '\\' GROUP BY ref_id), y AS (SELECT ref_id, min(id) AS tgt FROM refs JOIN s ON ends_with(s.qn, '.' || tgt_col) GROUP BY ref_id)
SELECT ref_id, src, tgt, CASE kind WHEN 'direct_copy' THEN 'direct_copy' WHEN 'aggregate' THEN 'transforms_to' ELSE 'uses_column' END AS edge_type, CASE kind WHEN 'direct_copy' THEN 0.9 WHEN 'aggregate' THEN 1.0 ELSE 0.85 END::DOUBLE AS confidence
FROM refs JOIN x USING (ref_id) JOIN y USING (ref_id) WHERE src <> tgt""")
def _(spark, d):
    p = table(spark, d, "part")
    kind = F.when(F.col("p_partkey") % 3 == 0, "direct_copy").when(F.col("p_partkey") % 3 == 1, "aggregate").otherwise("filter")
    target = F.concat(F.lit("Nation_"), (F.col("p_partkey") % 30).cast("string"))
    refs = p.select(F.col("p_partkey").alias("ref_id"), F.concat(F.col("p_name"), F.lit("_"), F.col("p_partkey").cast("string")).alias("source_column"), target.alias("target_column"), kind.alias("derivation_type"), F.lit(None).cast("string").alias("expression"), F.lit("").alias("context"))
    return R.column_edges(refs, symbols(spark, d)).select("ref_id", "src", "tgt", "edge_type", "confidence")


@query("enclosing_range", """WITH r AS (SELECT l_partkey % 20 AS file_id, l_linenumber * 10 + l_orderkey % 7 AS start_line, l_linenumber * 10 + l_orderkey % 7 + l_quantity::INTEGER AS end_line, l_orderkey * 10 + l_linenumber AS id FROM lineitem),
p AS (SELECT p_partkey AS point_id, p_partkey % 20 AS file_id, p_size + 5 AS line FROM part) SELECT point_id, id FROM (SELECT point_id, id, row_number() OVER (PARTITION BY point_id ORDER BY end_line - start_line, id) AS n FROM p JOIN r USING (file_id) WHERE start_line <= line AND line <= end_line) WHERE n = 1""")
def _(spark, d):
    begin = F.col("l_linenumber") * 10 + F.col("l_orderkey") % 7
    ranges = table(spark, d, "lineitem").select((F.col("l_partkey") % 20).alias("file_id"), begin.alias("start_line"), (begin + F.col("l_quantity").cast("int")).alias("end_line"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    points = table(spark, d, "part").select(F.col("p_partkey").alias("point_id"), (F.col("p_partkey") % 20).alias("file_id"), (F.col("p_size") + 5).alias("line"))
    return R.innermost(points, ranges)


@query("positional_zip", "WITH a AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS x, list_reverse_sort(list(DISTINCT l_suppkey)) AS y FROM lineitem GROUP BY l_orderkey), z AS (SELECT l_orderkey, unnest(range(0, least(len(x), len(y)))) AS pos, x, y FROM a) SELECT l_orderkey, pos::INTEGER AS pos, x[pos + 1] AS \"left\", y[pos + 1] AS \"right\" FROM z")
def _(spark, d):
    by = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"), F.reverse(F.array_sort(F.collect_set("l_suppkey"))).alias("y"))
    by = by.select("l_orderkey", F.transform("x", lambda v: v["l_partkey"]).alias("x"), "y")
    return R.positional_pairs(by, "l_orderkey", "x", "y")


@query("edge_histogram", f"""WITH {EDGES}, r AS (SELECT edge_type, src || '->' || tgt AS s, row_number() OVER (PARTITION BY edge_type ORDER BY src, tgt) AS n FROM edges)
SELECT edge_type, count(*) AS cnt, list_sort(list(s) FILTER (n <= 10)) AS samples FROM r GROUP BY edge_type""")
def _(spark, d):
    return T.edge_histogram(edges(spark, d))


@query("analytics_table")
def _(spark, d):
    return A.analytics_table(materialise(symbols(spark, d), "symbols"), materialise(edges(spark, d), "edges"))


@query("enriched_symbols")
def _(spark, d):
    return A.compute_all(symbols(spark, d), edges(spark, d))[0].select("id", "layer", "in_degree", "out_degree", "pagerank")


@query("embed_missing")
def _(spark, d):
    given = table(spark, d, "embeddings").select(F.concat(F.lit("P:"), F.col("vec_id").cast("string")).alias("symbol_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return S.embed_missing(symbols(spark, d), given)
