"""Vocabularies, word lists and weights that results depend on."""

# Layer patterns, matched against whole lower-case name segments.
DATA_KINDS = ("table", "view", "column", "procedure", "trigger")
CROSS_CUTTING_KINDS = ("interface", "enum", "constant")
LAYER_SEGMENTS = {
    "api": "controller controllers handler handlers api endpoint endpoints rest graphql route routes web servlet".split(),
    "data": "repository repositories dal data dao persistence storage database db store dbo schema entities models dto".split(),
    "business": "service services domain core business usecase usecases logic engine manager providers components modules".split(),
    "infrastructure": "config configuration startup infrastructure infra bootstrap setup middleware filter interceptor logging monitoring security authentication authorization".split(),
}
# Layer suffixes of class and type names.
LAYER_SUFFIXES = {
    "api": ["controller", "handler", "endpoint", "servlet"],
    "data": ["repository", "dao", "entity", "model"],
    "business": ["service", "manager", "provider", "helper", "factory"],
    "infrastructure": ["config", "middleware", "startup", "configuration"],
}
LAYERS = ("data", "business", "api", "infrastructure", "cross-cutting", "unknown")

# Rank weights and kind priorities.
RANK_WEIGHTS = {"relevance": 0.30, "centrality": 0.20, "focus": 0.20, "kind": 0.15, "novelty": 0.15}
KIND_PRIORITY = {
    "table": 1.0, "class": 0.95, "view": 0.9, "interface": 0.85, "procedure": 0.85, "module": 0.8, "package": 0.8, "method": 0.7, "function": 0.7, "type": 0.65,
    "enum": 0.6, "trigger": 0.6, "property": 0.5, "field": 0.45, "variable": 0.4, "constant": 0.4, "column": 0.35,
}
OTHER_KIND_PRIORITY = 0.3

# Edge type and confidence by derivation.
DERIVATION_EDGES = {
    "direct_copy": ("direct_copy", 0.9), "transform": ("transforms_to", 1.0), "aggregate": ("transforms_to", 1.0), "conditional": ("transforms_to", 1.0),
    "filter": ("uses_column", 0.85), "join": ("uses_column", 0.85),
}
OTHER_DERIVATION = ("uses_column", 0.7)
COLUMN_EDGES = ("transforms_to", "direct_copy", "uses_column")

# Bridge rules in order, and the strategies' confidences.
BRIDGE_RULES = (
    ("delphi", "tsql", "schema_qualified"), ("asp", "tsql", "case_insensitive"), ("java", "pgsql", "case_insensitive"), ("java", "tsql", "case_insensitive"),
    ("csharp", "tsql", "schema_qualified"), ("csharp", "tsql", "case_insensitive"), ("javascript", "tsql", "case_insensitive"), ("typescript", "tsql", "case_insensitive"),
    ("javascript", "pgsql", "case_insensitive"), ("typescript", "pgsql", "case_insensitive"), ("csharp", "pgsql", "schema_qualified"), ("csharp", "tsql", "orm_convention"),
    ("java", "pgsql", "orm_convention"), ("java", "tsql", "orm_convention"), ("delphi", "tsql", "strip_prefix"),
)
STRATEGY_CONFIDENCE = {"exact": 1.0, "schema_qualified": 0.95, "case_insensitive": 0.85, "strip_prefix": 0.75, "orm_convention": 0.7}

# Dialect keywords, upper case; each counts 2, a GO line counts 10 for T-SQL.
TSQL_MARKS = (
    "DECLARE @", "SET @", "NVARCHAR", "VARCHAR(MAX)", "BIT", "IDENTITY(", "EXEC ", "EXECUTE ", "SP_", "NOCOUNT", "BEGIN TRY", "BEGIN CATCH", "@@ROWCOUNT", "@@ERROR",
    "@@IDENTITY", "GETDATE()", "ISNULL(", "CHARINDEX(", "TOP ", "WITH (NOLOCK)", "CROSS APPLY", "OUTER APPLY",
)
PGSQL_MARKS = (
    "$$", "LANGUAGE PLPGSQL", "LANGUAGE SQL", "RETURNS SETOF", "RETURNS TABLE", "CREATE EXTENSION", "CREATE SCHEMA", "SERIAL", "BIGSERIAL", "BOOLEAN", "TEXT NOT NULL",
    "TIMESTAMPTZ", "UUID", "JSONB", "::TEXT", "::INTEGER", "::UUID", "ILIKE", "SIMILAR TO", "CREATE OR REPLACE FUNCTION", "RAISE NOTICE", "RAISE EXCEPTION", "PERFORM ",
    "IMMUTABLE", "STABLE", "VOLATILE",
)

# Words that mark SQL, and words that are no table names.
SQL_MARKS = ("SELECT", "INSERT", "UPDATE", "DELETE", "FROM", "EXEC", "EXECUTE", "CREATE", "ALTER", "DROP", "MERGE")
SQL_WORDS = tuple(
    "SELECT FROM WHERE AND OR SET VALUES AS ON IN NOT NULL INTO JOIN LEFT RIGHT INNER OUTER CROSS FULL GROUP ORDER BY HAVING UNION ALL EXISTS BETWEEN LIKE IS CASE WHEN "
    "THEN ELSE END BEGIN DECLARE TABLE WITH TOP DISTINCT INSERT UPDATE DELETE".split()
)
WRITING_WORDS, READING_WORDS = ("INTO", "UPDATE", "DELETE", "MERGE"), ("FROM", "JOIN")

# Intents in order of evaluation with the phrases that mark them.
INTENTS = (
    ("ranking", ("most used", "most important", "most referenced", "most connected", "top ", "busiest", "highest", "largest", "most common", "most frequent", "most popular", "heavily used")),
    ("impact", ("what breaks", "what happens if", "impact", "blast radius", "change", "rename", "delete", "remove", "modify", "affected")),
    ("lineage", ("data flow", "lineage", "where does", "data come from", "written to", "read from", "transforms", "populates")),
    ("cross_language", ("what tables does", "tables does this endpoint", "full stack", "stack trace", "stack slice", "end to end", "calls this stored proc", "calls this procedure", "from app code",
                        "from the frontend", "from the api", "what touches", "who calls", "cross-language trace", "cross language trace")),
    ("bridges", ("cross-language", "bridge", "bridges", "between languages", "polyglot", "multi-language")),
    ("analytics", ("statistics", "stats", "distribution", "breakdown", "how many", "count", "metrics", "layer", "layers")),
    ("overview", ("overview", "what is this", "describe", "summary", "architecture", "structure", "languages", "how big")),
    ("relationships", ("foreign key", "foreign keys", "relationship", "relationships", "related to", "joins", "references between", "missing fk", "data access pattern")),
    ("dependencies", ("depends on", "dependency", "dependencies", "uses", "calls", "imports", "references")),
    ("subgraph", ("everything about", "all related", "module", "system", "pipeline", "workflow", "process")),
)
TOOL_FALLBACK = (
    ("ranking", ("most used", "most important", "most referenced", "most connected", "top ", "busiest", "highest", "largest")),
    ("impact", ("what breaks", "what happens if", "impact", "blast radius", "affected")),
    ("lineage", ("data flow", "lineage", "where does", "data come from", "upstream", "downstream", "populates")),
    ("overview", ("overview", "what is this", "describe the project", "summary", "architecture", "how big")),
    ("relationships", ("foreign key", "relationship", "joins", "references between")),
    ("search", ("accessing", "access", "uses", "calls", "references", "depends")),
    ("subgraph", ("everything about", "all related", "module", "pipeline")),
)
STOP_WORDS = tuple("what where how does is the a an are can do if i to of in for it this that about show me find get tell breaks happens everything".split())
MORE_STOP_WORDS = (*STOP_WORDS, *"most used important top then so many much".split())
# Words of a question that name symbol kinds.
KIND_WORDS = {
    "table": "table", "tables": "table", "procedure": "procedure", "proc": "procedure", "procs": "procedure", "class": "class", "classes": "class", "method": "method", "methods": "method",
    "function": "function", "functions": "function", "column": "column", "columns": "column", "interface": "interface", "field": "field", "property": "property", "enum": "enum",
}
# Path parts of migration and schema files.
SCHEMA_PATHS = ("database/", "migrations/", "scripts/", "dnn platform/", "dnn.adminexperience/", "providers/")
SCHEMA_ENDINGS = (".install.sql", ".upgrade.sql")
# languages' layers where no layer is known.
LANGUAGE_LAYERS = {"sql": "database", "tsql": "database", "pgsql": "database", "csharp": "api", "java": "api", "asp": "api", "aspx": "api", "delphi": "api", "pascal": "api", "javascript": "ui", "typescript": "ui"}
