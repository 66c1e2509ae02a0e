"""Scalar-function queries over names and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import vocabulary as V
from ..operators import search as S
from ..operators.graph_tables import symbols, table
from .oracle_parts import SYMBOLS, common_substring, relevance_case, words

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = (run, sql)
        return run

    return add


@query("orm_variants", """WITH n AS (SELECT p_partkey AS id, p_name || CASE p_partkey % 6 WHEN 0 THEN 'y' WHEN 1 THEN 'ies' WHEN 2 THEN 'es' WHEN 3 THEN 'ss' WHEN 4 THEN 'ey' ELSE 's' END AS name FROM part)
SELECT id, list_filter([name, CASE WHEN name LIKE '%y' AND NOT (name LIKE '%ey' OR name LIKE '%ay' OR name LIKE '%oy') THEN left(name, length(name) - 1) || 'ies' WHEN name LIKE '%s' OR name LIKE '%x' OR name LIKE '%ch' OR name LIKE '%sh' THEN name || 'es' ELSE name || 's' END,
 CASE WHEN name LIKE '%ies' THEN left(name, length(name) - 3) || 'y' WHEN name LIKE '%es' THEN left(name, length(name) - 2) WHEN name LIKE '%s' AND name NOT LIKE '%ss' THEN left(name, length(name) - 1) END], lambda x: x IS NOT NULL) AS variants FROM n""")
def _(spark, d):
    k = F.col("p_partkey") % 6
    end = F.when(k == 0, "y").when(k == 1, "ies").when(k == 2, "es").when(k == 3, "ss").when(k == 4, "ey").otherwise("s")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.orm_variants(F.concat("p_name", end)).alias("variants"))


def _points(marks) -> str:
    return " + ".join(f"CASE WHEN contains(up, '{m}') THEN 2 ELSE 0 END" for m in marks)


@query("dialect_score", f"WITH t AS (SELECT doc_id, upper(text) AS up FROM documents), p AS (SELECT doc_id, {_points(V.TSQL_MARKS)} + CASE WHEN contains(up, chr(10) || 'GO' || chr(10)) OR contains(up, chr(10) || 'GO' || chr(13) || chr(10)) OR ends_with(up, chr(10) || 'GO') THEN 10 ELSE 0 END AS tsql, {_points(V.PGSQL_MARKS)} AS pgsql FROM t) SELECT doc_id, tsql::INTEGER AS tsql, pgsql::INTEGER AS pgsql, CASE WHEN tsql > pgsql THEN 'tsql' ELSE 'pgsql' END AS dialect FROM p")
def _(spark, d):
    tsql, pgsql = X.dialect_scores(F.col("text"))
    return table(spark, d, "documents").select("doc_id", tsql.alias("tsql"), pgsql.alias("pgsql"), X.dialect(F.col("text")).alias("dialect"))


_MARK = "|".join(V.SQL_MARKS)


@query("looks_like_sql", f"SELECT doc_id, regexp_matches(upper(text), '(^|[^A-Z0-9_])({_MARK})($|[^A-Z0-9_])') AS is_sql FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.looks_like_sql(F.col("text")).alias("is_sql"))


@query("table_refs", f"""WITH t AS (SELECT conv_id, turn, 'select * from ' || replace(text, '.', ' ') || ' join Orders into Log, x exec run_it; delete From set' AS sql FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn, unnest(regexp_extract_all(sql, '(?i)(?:FROM|JOIN) \\s*([^\\s,;)(]+)', 1)) AS name, 'uses_table' AS reference_type FROM t
 UNION ALL SELECT conv_id, turn, unnest(regexp_extract_all(sql, '(?i)(?:INTO|UPDATE|DELETE|MERGE) \\s*([^\\s,;)(]+)', 1)), 'writes_to' FROM t
 UNION ALL SELECT conv_id, turn, 'run_it', 'calls' FROM t)
SELECT conv_id, turn, 'dbo.' || name AS qualified, reference_type, count(*) AS cnt FROM r WHERE upper(name) NOT IN ({words(V.SQL_WORDS)}) GROUP BY ALL""")
def _(spark, d):
    t = table(spark, d, "conversations").where("role = 'user'")
    sql = F.concat(F.lit("select * from "), F.replace(F.col("text"), F.lit("."), F.lit(" ")), F.lit(" join Orders into Log, x exec run_it; delete From set"))
    return t.select("conv_id", "turn", F.explode(X.table_references(sql)).alias("r")).groupBy("conv_id", "turn", "r.qualified", "r.reference_type").agg(F.count("*").alias("cnt"))


def _phrases(table_, column: str, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({column}, {chr(39)}{p}{chr(39)})' for p in phrases)} THEN '{name}'" for name, phrases in table_) + f" ELSE '{other}' END"


_QUESTION = "('What ' || CASE conv_id % 13 WHEN 0 THEN 'breaks if I change' WHEN 1 THEN 'tables does this endpoint use' WHEN 2 THEN 'is the data flow of' WHEN 3 THEN 'are the most used' WHEN 4 THEN 'foreign key links' WHEN 5 THEN 'depends on' WHEN 6 THEN 'is this overview' WHEN 7 THEN 'statistics exist for' WHEN 8 THEN 'polyglot parts touch' WHEN 9 THEN 'workflow has' WHEN 10 THEN 'columns and methods does it find: rename' WHEN 11 THEN 'upstream data come from' ELSE 'of' END || ' ' || text || '?')"


def _questions(spark, d):
    ends = ["breaks if I change", "tables does this endpoint use", "is the data flow of", "are the most used", "foreign key links", "depends on", "is this overview", "statistics exist for", "polyglot parts touch", "workflow has",
            "columns and methods does it find: rename", "upstream data come from", "of"]
    c = table(spark, d, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", F.concat(F.lit("What "), F.element_at(F.lit(ends), (F.col("conv_id") % 13 + 1).cast("int")), F.lit(" "), F.col("text"), F.lit("?")).alias("q"))


@query("intent_class", f"WITH q AS (SELECT conv_id, turn, lower({_QUESTION}) AS q FROM conversations WHERE role = 'user') SELECT conv_id, turn, {_phrases(V.INTENTS, 'q', 'search')} AS intent, {_phrases(V.TOOL_FALLBACK, 'q', 'search')} AS tool FROM q")
def _(spark, d):
    return _questions(spark, d).select("conv_id", "turn", X.intent(F.col("q")).alias("intent"), X.tool(F.col("q")).alias("tool"))


@query("question_parameters", f"""WITH q AS (SELECT conv_id, turn, lower({_QUESTION}) AS q FROM conversations WHERE role = 'user') SELECT conv_id, turn,
 CASE WHEN contains(q, 'delete') OR contains(q, 'remove') OR contains(q, 'drop') THEN 'delete' WHEN contains(q, 'rename') THEN 'rename' ELSE 'modify' END AS change_type,
 CASE WHEN contains(q, 'come from') OR contains(q, 'upstream') OR contains(q, 'data source') THEN 'upstream' WHEN contains(q, 'written to') OR contains(q, 'downstream') OR contains(q, 'populates') THEN 'downstream' ELSE 'both' END AS direction,
 CASE WHEN contains(q, 'layer') THEN 'layers' WHEN contains(q, 'language') THEN 'languages' WHEN contains(q, 'kind') OR contains(q, 'type') THEN 'kinds' ELSE 'summary' END AS scope,
 list_sort(list_distinct(list_filter([{", ".join(f"CASE WHEN contains(q, '{w}') THEN '{k}' END" for w, k in V.KIND_WORDS.items())}], lambda x: x IS NOT NULL))) AS kinds FROM q""")
def _(spark, d):
    q = F.col("q")
    return _questions(spark, d).select("conv_id", "turn", X.change_type(q).alias("change_type"), X.direction(q).alias("direction"), X.analytics_scope(q).alias("scope"), X.kinds_in(q).alias("kinds"))


@query("search_terms", f"""WITH q AS (SELECT conv_id, turn, {_QUESTION} AS q FROM conversations WHERE role = 'user'),
t AS (SELECT *, list_filter(list_transform(string_split_regex(lower(q), '\\s+'), lambda w: regexp_replace(regexp_replace(w, '^[?.,!"'']+', ''), '[?.,!"'']+$', '')), lambda w: octet_length(encode(w)) > 1 AND NOT list_contains([{words(V.STOP_WORDS)}], w)) AS k FROM q)
SELECT conv_id, turn, CASE WHEN len(k) = 0 THEN q ELSE array_to_string(k, ' ') END AS terms FROM t""")
def _(spark, d):
    return _questions(spark, d).select("conv_id", "turn", X.search_terms(F.col("q")).alias("terms"))


@query("name_parts", f"WITH {SYMBOLS} SELECT id, string_split(qualified_name, '.')[-1] AS short, regexp_replace(qualified_name, '\\.[^.]*$', '') AS parent, len(string_split(qualified_name, '.'))::INTEGER AS depth FROM symbols")
def _(spark, d):
    q = F.col("qualified_name")
    return symbols(spark, d).select("id", X.short_name(q).alias("short"), X.parent_name(q).alias("parent"), F.size(F.split(q, r"\.")).alias("depth"))


@query("schema_paths", f"SELECT page_id, {' OR '.join(f'contains(lower(url), {chr(39)}{p}{chr(39)})' for p in V.SCHEMA_PATHS)} OR ends_with(lower(url), '.install.sql') OR ends_with(lower(url), '.upgrade.sql') OR regexp_matches(lower(url), '^[^/]*//[^/]*/[^/]*$') AS excluded FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", X.is_schema_file(F.col("url"), ("*//*/*",)).alias("excluded"))


@query("token_estimate", "SELECT doc_id, floor(octet_length(encode(text)) / 4)::BIGINT AS tokens FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


@query("embedding_text", f"WITH {SYMBOLS} SELECT id, CASE kind WHEN 'table' THEN 'Table ' || qualified_name WHEN 'class' THEN 'Class ' || qualified_name || ' — ' || name ELSE kind || ' ' || qualified_name || ': ' || language END AS text FROM symbols")
def _(spark, d):
    return symbols(spark, d).select("id", X.embedding_text(F.col("kind"), F.col("qualified_name"), F.col("language"), F.col("name")).alias("text"))


@query("lcs_rank", f"WITH {SYMBOLS} SELECT id, {common_substring('lower(name)', 'united nations')} AS common, round({relevance_case('united nations')}, 6) AS relevance FROM symbols")
def _(spark, d):
    return symbols(spark, d).select("id", X.longest_common_substring(F.lower("name"), F.lit("united nations")).alias("common"), F.round(X.relevance(F.col("name"), F.col("qualified_name"), "united nations"), 6).alias("relevance"))


@query("embed_hash")
def _(spark, d):
    return symbols(spark, d).select("id", S.hash_embedding(F.col("qualified_name")).alias("embedding"))
