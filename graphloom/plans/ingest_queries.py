"""Ingestion queries: parsing of scripts made from the driver's tables, sessions, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import resolution as R
from ..operators.graph_tables import table
from ..sources import parsers as P
from ..storage import materialise, shared_dir, work_path
from ..streaming.ingest import enqueue, messages, run_ingest, sessions

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = (run, sql)
        return run

    return add


@query("sessions_30m", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS started_at, max(ts) + INTERVAL 30 MINUTE AS ended_at, count(*) AS n FROM s GROUP BY user_id, k""")
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(e).select("user_id", F.col("started_at").cast("timestamp_ntz").alias("started_at"), F.col("ended_at").cast("timestamp_ntz").alias("ended_at"), "n")


def _scripts(spark, d):
    """A T-SQL script for each nation: a table, a view and a procedure over it and its region's table."""
    n = table(spark, d, "nation")
    k, r = F.col("n_nationkey").cast("string"), (F.col("n_regionkey") + 100).cast("string")
    text = F.concat(
        F.lit("CREATE TABLE dbo.T"), k, F.lit(" (id INT NOT NULL, [name] NVARCHAR(50), region_id INT, CONSTRAINT pk PRIMARY KEY (id))\nGO\nCREATE VIEW dbo.V"), k,
        F.lit(" AS SELECT t.id, t.name AS label, COUNT(r.id) AS regions FROM dbo.T"), k, F.lit(" t JOIN dbo.T"), r, F.lit(" r ON r.id = t.region_id GROUP BY t.id, t.name\nGO\nCREATE PROCEDURE dbo.P"), k,
        F.lit(" @id INT AS\nBEGIN\n  INSERT INTO dbo.Log (a, b) SELECT x.id, x.name FROM dbo.T"), k, F.lit(" x;\n  DELETE FROM dbo.T"), k, F.lit(" WHERE id = @id;\n  EXEC dbo.P"), r, F.lit(" @id\nEND\nGO\n"),
    )
    return n.select(F.concat(F.lit("n"), k, F.lit(".sql")).alias("path"), F.lit("tsql").alias("language"), text.alias("content"))


_K, _R = "n_nationkey", "(n_regionkey + 100)"


@query("parse_tsql_symbols", f"""SELECT 'table' AS kind, 'dbo.T' || {_K} AS qualified_name, 1 AS start_line FROM nation UNION ALL SELECT 'column', 'dbo.T' || {_K} || '.' || c, 1 FROM nation, (VALUES ('id'), ('name'), ('region_id')) v(c)
UNION ALL SELECT 'view', 'dbo.V' || {_K}, 3 FROM nation UNION ALL SELECT 'column', 'dbo.V' || {_K} || '.' || c, 3 FROM nation, (VALUES ('id'), ('label'), ('regions')) v(c) UNION ALL SELECT 'procedure', 'dbo.P' || {_K}, 5 FROM nation""")
def _(spark, d):
    return P.symbols_of(P.parse_files(_scripts(spark, d))).select("kind", "qualified_name", "start_line")


@query("parse_tsql_references", f"""SELECT 'dbo.V' || {_K} AS from_symbol, 'dbo.T' || {_K} AS to_qualified, 'reads_from' AS reference_type FROM nation UNION ALL SELECT 'dbo.V' || {_K}, 'dbo.T' || {_R}, 'joins' FROM nation
UNION ALL SELECT 'dbo.P' || {_K}, 'dbo.Log', 'writes_to' FROM nation UNION ALL SELECT 'dbo.P' || {_K}, 'dbo.T' || {_K}, 'reads_from' FROM nation UNION ALL SELECT 'dbo.P' || {_K}, 'dbo.T' || {_K}, 'writes_to' FROM nation
UNION ALL SELECT 'dbo.P' || {_K}, 'dbo.P' || {_R}, 'calls' FROM nation""")
def _(spark, d):
    return P.references_of(P.parse_files(_scripts(spark, d))).select("from_symbol", "to_qualified", "reference_type")


@query("parse_tsql_columns", f"""SELECT 'dbo.T' || {_K} || '.id' AS source_column, 'dbo.V' || {_K} || '.id' AS target_column, 'direct_copy' AS derivation_type FROM nation UNION ALL SELECT 'dbo.T' || {_K} || '.name', 'dbo.V' || {_K} || '.label', 'direct_copy' FROM nation
UNION ALL SELECT 'dbo.T' || {_R} || '.id', 'dbo.V' || {_K} || '.regions', 'aggregate' FROM nation UNION ALL SELECT 'dbo.T' || {_K} || '.id', 'dbo.Log.a', 'direct_copy' FROM nation UNION ALL SELECT 'dbo.T' || {_K} || '.name', 'dbo.Log.b', 'direct_copy' FROM nation""")
def _(spark, d):
    return P.columns_of(P.parse_files(_scripts(spark, d))).select("source_column", "target_column", "derivation_type")


@query("resolve_scripts", f"""SELECT 'dbo.V' || {_K} AS source, 'dbo.T' || {_K} AS target, 'reads_from' AS edge_type FROM nation UNION ALL SELECT 'dbo.P' || {_K}, 'dbo.T' || {_K}, 'reads_from' FROM nation UNION ALL SELECT 'dbo.P' || {_K}, 'dbo.T' || {_K}, 'writes_to' FROM nation""")
def _(spark, d):
    parsed = materialise(P.parse_files(_scripts(spark, d)), "parsed")
    symbols = P.symbols_of(parsed)
    found = R.resolve_references(P.references_of(parsed), symbols)
    name = lambda key, out: symbols.select(F.col("id").alias(key), F.col("qualified_name").alias(out))
    return found.join(name("src", "source"), "src").join(name("tgt", "target"), "tgt").select("source", "target", "edge_type")


@query("script_column_lineage", f"""SELECT 'dbo.T' || {_K} || '.id' AS source, 'dbo.V' || {_K} || '.id' AS target, 'direct_copy' AS edge_type, 0.9::DOUBLE AS confidence FROM nation UNION ALL SELECT 'dbo.T' || {_K} || '.name', 'dbo.V' || {_K} || '.label', 'direct_copy', 0.9 FROM nation
UNION ALL SELECT 'dbo.V' || {_K}, 'dbo.V' || {_K} || '.regions', 'transforms_to', 1.0 FROM nation""")
def _(spark, d):
    """The joined table of a region has no script, so its column falls back to the view itself."""
    parsed = materialise(P.parse_files(_scripts(spark, d)), "parsed")
    symbols = P.symbols_of(parsed)
    columns = P.columns_of(parsed).withColumn("source_column", F.when(F.col("source_column").rlike(r"dbo\.T1\d\d\."), "none.none").otherwise(F.col("source_column")))
    name = lambda key, out: symbols.select(F.col("id").alias(key), F.col("qualified_name").alias(out))
    return R.column_edges(columns, symbols).join(name("src", "source"), "src").join(name("tgt", "target"), "tgt").select("source", "target", "edge_type", "confidence")


@query("ingest_stream", "SELECT (user_id % 10)::VARCHAR AS project_id, count(*) AS runs, max(event_id) AS last_run FROM events WHERE event_id % 7 <> 0 GROUP BY 1")
def _(spark, d):
    """Messages made of events land in a folder, some of them broken; a stream takes them in and counts runs by project."""
    landing, out = work_path(spark, "landing"), work_path(spark, "runs")
    e = table(spark, d, "events")
    whole = e.where("event_id % 7 <> 0").select(F.col("event_id").cast("string").alias("index_run_id"), (F.col("user_id") % 10).cast("string").alias("project_id"), F.lit("s").alias("source_id"), F.lit("git").alias("source_type"), F.lit("webhook").alias("trigger"))
    enqueue(whole, landing)
    e.where("event_id % 7 = 0").select(F.lit('{"broken": ').alias("value")).write.mode("append").text(landing)
    run = run_ingest(messages(spark, landing), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), f"{shared_dir(spark)}/work/stream-{uuid.uuid4().hex}")
    run.awaitTermination()
    runs = spark.read.parquet(out)
    return runs.groupBy(F.col("project_id").cast("string").alias("project_id")).agg(F.countDistinct("index_run_id").alias("runs"), F.max(F.col("index_run_id").cast("long")).alias("last_run"))
