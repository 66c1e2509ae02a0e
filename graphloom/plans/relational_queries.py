"""Relational and analytic queries over the symbol graph."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import analytics as A
from ..operators import search as S
from ..operators.graph_tables import edges, symbols, table
from ..storage import insert_missing, latest, merge_maps, upsert
from .oracle_parts import DEGREES, EDGES, GRAPH, SYMBOLS, layer_case, relevance_case

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = (run, sql)
        return run

    return add


@query("degrees", f"WITH {GRAPH}, {DEGREES} SELECT * FROM degrees")
def _(spark, d):
    return A.degrees(symbols(spark, d), edges(spark, d))


@query("top_in_degree", f"WITH {GRAPH}, {DEGREES} SELECT id, name, kind, language, in_degree FROM degrees JOIN symbols USING (id) WHERE in_degree > 0 ORDER BY in_degree DESC, id LIMIT 10")
def _(spark, d):
    return A.top_by_degree(symbols(spark, d), edges(spark, d), 10)


@query("top_by_kind", f"WITH {GRAPH}, {DEGREES} SELECT id, name, kind, language, in_degree FROM degrees JOIN symbols USING (id) WHERE kind IN ('table', 'class') ORDER BY in_degree DESC, id LIMIT 25")
def _(spark, d):
    own = symbols(spark, d).where(S.is_in("kind", ["table", "class"]) & S.is_in("language", None))
    return own.join(A.degrees(own, edges(spark, d)), "id").orderBy(F.desc("in_degree"), "id").limit(25).select("id", "name", "kind", "language", "in_degree")


@query("project_stats", f"WITH {SYMBOLS} SELECT count(*) AS total_symbols, count(DISTINCT language) AS language_count, count(DISTINCT kind) AS kind_count, count(DISTINCT file_id) AS file_count FROM symbols")
def _(spark, d):
    return A.project_stats(symbols(spark, d))


for _column in ("language", "kind"):
    QUERIES[f"counts_by_{_column}"] = (
        lambda spark, d, c=_column: A.counts_by(symbols(spark, d), c),
        f"WITH {SYMBOLS} SELECT {_column}, count(*) AS cnt FROM symbols GROUP BY {_column}",
    )


@query("layer_counts", f"WITH {SYMBOLS} SELECT l.layer, count(s.id) AS cnt FROM (VALUES ('data'), ('business'), ('api'), ('infrastructure'), ('cross-cutting'), ('unknown')) l(layer) LEFT JOIN (SELECT id, {layer_case()} AS layer FROM symbols) s USING (layer) GROUP BY l.layer")
def _(spark, d):
    return A.layer_counts(symbols(spark, d))


@query("page_layers", f"WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages) SELECT page_id, {layer_case(chr(39) + 'module' + chr(39), 'path', 'path')} AS layer, len(list_filter(string_split_regex(lower(path), '[./\\\\]'), lambda x: x <> ''))::INTEGER AS parts FROM p")
def _(spark, d):
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, d, "pages").select("page_id", X.layer(F.lit("module"), path, path).alias("layer"), F.size(X.segments(F.lower(path))).alias("parts"))


_CROSSING = "FROM edges e JOIN symbols s ON s.id = e.src JOIN symbols t ON t.id = e.tgt WHERE s.language <> t.language"


@query("bridges", f"WITH {GRAPH} SELECT s.language AS source_language, t.language AS target_language, edge_type, count(*) AS edge_count, list_sort(list(DISTINCT src)) AS source_symbol_ids, list_sort(list(DISTINCT tgt)) AS target_symbol_ids {_CROSSING} GROUP BY 1, 2, 3")
def _(spark, d):
    return A.bridges(symbols(spark, d), edges(spark, d))


@query("bridge_coverage", f"WITH {GRAPH} SELECT count(*) AS total_edges, count(confidence) AS with_confidence, round(coalesce(avg(confidence), 0), 6) AS avg_confidence, count(*) FILTER (WHERE confidence < 0.8) AS low_confidence {_CROSSING}")
def _(spark, d):
    return A.bridge_coverage(symbols(spark, d), edges(spark, d))


@query("source_stats", f"WITH {SYMBOLS} SELECT source_id, count(*) AS symbol_count, count(DISTINCT file_id) AS file_count, count(DISTINCT language) AS language_count, list_sort(list(DISTINCT language)) AS languages, list_sort(list(DISTINCT kind)) AS kinds FROM symbols GROUP BY source_id")
def _(spark, d):
    return A.source_stats(symbols(spark, d))


@query("parser_coverage", "SELECT source AS source_id, count(DISTINCT d.doc_id) AS total_files, count(DISTINCT l.doc_id) AS parsed_files, round(100.0 * count(DISTINCT l.doc_id) / count(DISTINCT d.doc_id))::BIGINT AS coverage FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source")
def _(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"))
    return A.file_coverage(files, table(spark, d, "labels").select(F.col("doc_id").alias("file_id")))


@query("namespace_stats", f"WITH {SYMBOLS} SELECT CASE WHEN contains(qualified_name, '.') THEN left(qualified_name, length(qualified_name) - length(name) - 1) ELSE '(root)' END AS namespace, count(*) AS symbol_count, list_sort(list(DISTINCT kind)) AS kinds, list_sort(list(DISTINCT language)) AS languages FROM symbols GROUP BY 1 HAVING count(*) >= 2 ORDER BY symbol_count DESC, namespace LIMIT 50")
def _(spark, d):
    return A.namespace_stats(symbols(spark, d))


@query("summary_text", f"""WITH {GRAPH}, l AS (SELECT language, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, language) AS r FROM symbols GROUP BY language),
k AS (SELECT kind, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, kind) AS r FROM symbols GROUP BY kind)
SELECT 'This project contains ' || (SELECT count(*) FROM symbols) || ' symbols across ' || (SELECT count(DISTINCT file_id) FROM symbols) || ' files with ' || (SELECT count(*) FROM edges) || ' edges. Languages: '
 || (SELECT string_agg(language || ' (' || cnt || ')', ', ' ORDER BY r) FILTER (r <= 5) || CASE WHEN count(*) > 5 THEN ', and ' || (count(*) - 5) || ' more' ELSE '' END FROM l) || '. Primary symbol kinds: '
 || (SELECT string_agg(kind || ' (' || cnt || ')', ', ' ORDER BY r) FILTER (r <= 5) || CASE WHEN count(*) > 5 THEN ', and ' || (count(*) - 5) || ' more' ELSE '' END FROM k) || '.' AS summary""")
def _(spark, d):
    return A.summary_text(symbols(spark, d), edges(spark, d))


@query("hotspots_json", f"WITH {GRAPH}, {DEGREES}, t AS (SELECT id, name, in_degree FROM degrees JOIN symbols USING (id) WHERE in_degree > 0 ORDER BY in_degree DESC, id LIMIT 10) SELECT '[' || string_agg('{{\"id\":\"' || id || '\",\"name\":\"' || name || '\",\"in_degree\":' || in_degree || '}}', ',' ORDER BY in_degree DESC, id) || ']' AS hotspots FROM t")
def _(spark, d):
    top = A.top_by_degree(symbols(spark, d), edges(spark, d), 10)
    packed = F.array_sort(F.collect_list(F.struct((-F.col("in_degree")).alias("o"), "id", "name", "in_degree")))  # ten rows
    return top.agg(F.to_json(F.transform(packed, lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), x["in_degree"].alias("in_degree")))).alias("hotspots"))


@query("edge_ends", f"WITH {GRAPH} SELECT src, tgt, edge_type, s.name AS s_name, t.name AS t_name, s.kind AS s_kind, t.kind AS t_kind FROM edges e JOIN symbols s ON s.id = e.src JOIN symbols t ON t.id = e.tgt")
def _(spark, d):
    return A.with_ends(symbols(spark, d), edges(spark, d), "name", "kind").select("src", "tgt", "edge_type", "s_name", "t_name", "s_kind", "t_kind")


@query("edge_type_filter", f"WITH {EDGES} SELECT edge_type, count(*) AS cnt, count(DISTINCT src) AS sources FROM edges WHERE edge_type IN ('contains', 'depends_on') GROUP BY edge_type")
def _(spark, d):
    return edges(spark, d).where(S.is_in("edge_type", ["contains", "depends_on"])).groupBy("edge_type").agg(F.count("*").alias("cnt"), F.countDistinct("src").alias("sources"))


@query("symbol_by_name", f"WITH {SYMBOLS} SELECT id, qualified_name, kind FROM symbols WHERE qualified_name IN ('ASIA', 'ASIA.NATION_2', 'EUROPE.NATION_3') OR qualified_name LIKE '%.Customer#00000000_'")
def _(spark, d):
    s = symbols(spark, d)
    return s.where(F.col("qualified_name").isin("ASIA", "ASIA.NATION_2", "EUROPE.NATION_3") | F.col("qualified_name").like("%.Customer#00000000_")).select("id", "qualified_name", "kind")


@query("missing_embeddings", f"WITH {SYMBOLS} SELECT id, kind FROM symbols WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE 'P:' || vec_id = symbols.id)")
def _(spark, d):
    return S.without_embeddings(symbols(spark, d), table(spark, d, "embeddings").select(F.concat(F.lit("P:"), F.col("vec_id").cast("string")).alias("symbol_id"))).select("id", "kind")


@query("search_text", f"WITH {SYMBOLS} SELECT id, name, qualified_name, kind FROM symbols WHERE (name ILIKE '%0000_1%' OR qualified_name ILIKE '%0000_1%') AND kind IN ('class', 'interface') ORDER BY name, id LIMIT 20")
def _(spark, d):
    return S.search(symbols(spark, d), "0000_1", kinds=["class", "interface"]).select("id", "name", "qualified_name", "kind")


@query("search_global", f"WITH {SYMBOLS} SELECT id, name, source_id FROM symbols WHERE name ILIKE '%AN%' OR qualified_name ILIKE '%AN%' ORDER BY name, id LIMIT 50")
def _(spark, d):
    return S.search(symbols(spark, d), "AN", limit=50).select("id", "name", "source_id")


_TIER = "CASE WHEN lower(name) = 'nation_1' THEN 0 WHEN lower(qualified_name) = 'nation_1' THEN 1 WHEN starts_with(lower(name), 'nation_1') THEN 2 ELSE 3 END"


@query("search_ranked", f"WITH {GRAPH}, {DEGREES} SELECT id, name, {_TIER}::INTEGER AS tier, in_degree FROM symbols JOIN degrees USING (id) WHERE name ILIKE '%nation_1%' OR qualified_name ILIKE '%nation_1%' ORDER BY tier, in_degree DESC, id LIMIT 20")
def _(spark, d):
    s = symbols(spark, d)
    return S.ranked_search(s.join(A.degrees(s, edges(spark, d)), "id"), "nation_1").select("id", "name", "tier", "in_degree")


@query("rank_composite", f"""WITH {GRAPH}, {DEGREES} SELECT id, round(0.30 * {relevance_case('nation_1')}
 + 0.20 * CASE WHEN in_degree > 0 THEN least(1.0, ln(1 + in_degree) / ln(51)) ELSE 0.0 END + 0.20 * CASE WHEN id IN ('N:18') THEN 1.0 ELSE 0.3 END
 + 0.15 * CASE kind WHEN 'table' THEN 1.0 WHEN 'class' THEN 0.95 WHEN 'interface' THEN 0.85 WHEN 'module' THEN 0.8 WHEN 'package' THEN 0.8 ELSE 0.3 END
 + 0.15 * CASE WHEN id IN ('R:2') THEN 0.1 ELSE 1.0 END, 6) AS score FROM symbols JOIN degrees USING (id)""")
def _(spark, d):
    s = symbols(spark, d)
    s = s.join(A.degrees(s, edges(spark, d)), "id").withColumn("pagerank", F.lit(None).cast("double"))
    return S.rank(s, "nation_1", seen=["R:2"], focused=["N:18"]).select("id", F.round("score", 6).alias("score"))


@query("semantic_topk", """WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 6) AS distance FROM embeddings, q WHERE label IN (1, 2, 3) ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), vec_id LIMIT 20""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    first = e.orderBy("vec_id").select("embedding").first()
    return S.semantic_search(e, first[0] if first else [], 20, [1, 2, 3]).select("vec_id", F.round("distance", 6).alias("distance"))


@query("semantic_symbols", f"""WITH {SYMBOLS}, q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT id, name, kind, language, round(1 - list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 6) AS distance FROM embeddings CROSS JOIN q JOIN symbols ON id = 'P:' || vec_id WHERE kind IN ('table', 'class') ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), id LIMIT 20""")
def _(spark, d):
    """The symbols nearest to a vector, of some kinds."""
    e = table(spark, d, "embeddings")
    first = e.orderBy("vec_id").select("embedding").first()
    given = e.select(F.concat(F.lit("P:"), F.col("vec_id").cast("string")).alias("symbol_id"), "embedding")
    return S.semantic_symbols(symbols(spark, d), given, first[0] if first else [], 20, ["table", "class"]).select("id", "name", "kind", "language", F.round("distance", 6).alias("distance"))


@query("dedup_latest", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def _(spark, d):
    return latest(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("upsert_latest", """WITH o AS (SELECT user_id, event_type, min(event_id) AS first_id, max_by(value, event_id) AS value FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2),
n AS (SELECT user_id, event_type, event_id AS first_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events WHERE event_id % 3 = 0) WHERE r = 1)
SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.event_type, o.event_type) AS event_type, coalesce(o.first_id, n.first_id) AS first_id, CASE WHEN n.user_id IS NULL THEN o.value ELSE n.value END AS value
FROM o FULL JOIN n ON o.user_id = n.user_id AND o.event_type = n.event_type""")
def _(spark, d):
    e, keys = table(spark, d, "events"), ["user_id", "event_type"]
    old = e.where("event_id % 3 <> 0").groupBy(*keys).agg(F.min("event_id").alias("first_id"), F.max_by("value", "event_id").alias("value"))
    new = e.where("event_id % 3 = 0").withColumnRenamed("event_id", "first_id")
    return upsert(old, new, keys, keep=("first_id",), order=[F.desc("first_id")])


@query("insert_missing", f"WITH {EDGES} SELECT src, tgt, edge_type FROM edges")
def _(spark, d):
    e = edges(spark, d).select("src", "tgt", "edge_type")
    return insert_missing(e.where("edge_type <> 'references'"), e.union(e.where("edge_type = 'references'")), ["src", "tgt", "edge_type"])


@query("delta_files", """WITH a AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS hash FROM documents WHERE doc_id % 10 <> 0), b AS (SELECT doc_id::VARCHAR AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS hash FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'ADDED' WHEN b.path IS NULL THEN 'DELETED' ELSE 'MODIFIED' END AS status FROM a FULL JOIN b ON a.path = b.path WHERE a.hash IS DISTINCT FROM b.hash""")
def _(spark, d):
    from ..sources.files import file_delta

    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), "text")
    old = docs.where("doc_id % 10 <> 0").select("path", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    new = docs.where("doc_id % 11 <> 0").select("path", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).cast("binary"), 256).alias("hash"))
    return file_delta(old, new)


@query("json_extract", "SELECT event_id, (props->>'k')::INTEGER AS k, round(value * (props->>'k')::INTEGER, 4) AS weighted FROM events WHERE json_exists(props, '$.k') AND (props->>'k')::INTEGER > 50")
def _(spark, d):
    k = F.expr("try_variant_get(parse_json(props), '$.k', 'int')")
    return table(spark, d, "events").select("event_id", "value", k.alias("k")).where("k > 50").select("event_id", "k", F.round(F.col("value") * F.col("k"), 4).alias("weighted"))


@query("metadata_merge", """WITH m AS (SELECT user_id, event_id % 4 AS slot, max(event_id) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), n AS (SELECT user_id, event_id % 4 AS slot, max(event_id) AS v FROM events WHERE event_id % 8 = 2 GROUP BY 1, 2),
u AS (SELECT coalesce(n.user_id, m.user_id) AS user_id, coalesce(n.slot, m.slot) AS slot, coalesce(n.v, m.v) AS v FROM m FULL JOIN n ON m.user_id = n.user_id AND m.slot = n.slot)
SELECT user_id, string_agg('s' || slot || '=' || v, ',' ORDER BY slot) AS metadata FROM u GROUP BY user_id""")
def _(spark, d):
    e = table(spark, d, "events").withColumn("slot", F.concat(F.lit("s"), (F.col("event_id") % 4).cast("string")))
    maps = lambda x, n: x.groupBy("user_id", "slot").agg(F.max("event_id").alias("v")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.col("v").cast("string")))).alias(n))
    joined = maps(e.where("event_id % 2 = 0"), "old").join(maps(e.where("event_id % 8 = 2"), "new"), "user_id", "full")
    entries = F.array_sort(F.map_entries(merge_maps("old", "new")))
    return joined.select("user_id", F.array_join(F.transform(entries, lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("metadata"))


@query("run_state", """SELECT user_id AS run_id, CASE max_by(event_type, (ts, event_id)) WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, min(ts) AS started_at,
 CASE WHEN max_by(event_type, (ts, event_id)) IN ('purchase', 'error') THEN max(ts) END AS completed_at FROM events GROUP BY user_id""")
def _(spark, d):
    from ..streaming.ingest import run_states

    kind = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    return run_states(table(spark, d, "events").select(F.col("user_id").alias("run_id"), kind.alias("status"), "ts", F.col("event_id").alias("seq"))).select("run_id", "status", "started_at", "completed_at")


@query("paging", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20)


@query("tenant_filter", f"WITH {SYMBOLS} SELECT id, kind FROM symbols WHERE source_id = 'ASIA'")
def _(spark, d):
    from ..operators.access import Principal, visible

    return visible(symbols(spark, d), Principal(tenant="ASIA", scopes=("read",)), "source_id").select("id", "kind")


@query("membership_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def _(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(urgent, "c_custkey", "left_semi")


@query("union_distinct", f"WITH {EDGES} SELECT src AS id FROM edges WHERE edge_type = 'depends_on' UNION SELECT tgt FROM edges WHERE edge_type IN ('depends_on', 'references')")
def _(spark, d):
    e = edges(spark, d)
    return e.where("edge_type = 'depends_on'").select(F.col("src").alias("id")).union(e.where("edge_type in ('depends_on', 'references')").select("tgt")).distinct()


@query("coverage_pct", f"WITH {SYMBOLS} SELECT language, count(*) AS cnt, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM symbols GROUP BY language")
def _(spark, d):
    by = A.counts_by(symbols(spark, d), "language")
    return by.withColumn("pct", F.round(100.0 * F.col("cnt") / F.sum("cnt").over(W.partitionBy()), 4))  # over one row for each language


@query("history_last", "SELECT user_id, list(event_id ORDER BY ts DESC, event_id DESC) AS last_events FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20 GROUP BY user_id")
def _(spark, d):
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    top = table(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n <= 20")
    return top.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("n", "event_id"))).alias("l")).select("user_id", F.transform("l", lambda x: x["event_id"]).alias("last_events"))


@query("rollup_counts", "SELECT l_returnflag, l_linestatus, count(*) AS cnt, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("cnt"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS cnt, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    w = F.window("ts", "1 hour")
    return table(spark, d, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("cnt"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "cnt", "total")
