"""Common table expressions of the symbol graph for the DuckDB side."""

PLACE = "place AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"

SYMBOLS = (
    PLACE
    + """, symbols AS (
  SELECT 'R:' || r_regionkey AS id, r_name AS name, r_name AS qualified_name, 'package' AS kind, 'geo' AS language, 'F:' || r_regionkey AS file_id, r_name AS source_id FROM region
  UNION ALL SELECT 'N:' || n_nationkey, n_name, r_name || '.' || n_name, 'module', 'geo', 'N:' || n_nationkey, r_name FROM place
  UNION ALL SELECT 'C:' || c_custkey, c_name, r_name || '.' || n_name || '.' || c_name, 'class', lower(c_mktsegment), 'N:' || n_nationkey, r_name FROM customer JOIN place ON c_nationkey = n_nationkey
  UNION ALL SELECT 'S:' || s_suppkey, s_name, r_name || '.' || n_name || '.' || s_name, 'interface', 'supply', 'N:' || n_nationkey, r_name FROM supplier JOIN place ON s_nationkey = n_nationkey
  UNION ALL SELECT 'P:' || p_partkey, p_name || '_' || p_partkey, p_brand || '.' || p_type || '.' || p_name || '_' || p_partkey, 'table', lower(p_type), p_brand, 'parts' FROM part
)"""
)

EDGES = """edges AS (
  SELECT 'N:' || n_nationkey AS src, 'R:' || n_regionkey AS tgt, 'contains' AS edge_type, NULL::DOUBLE AS confidence FROM nation
  UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey, 'references', NULL FROM customer
  UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey, 'references', NULL FROM supplier
  UNION ALL SELECT 'C:' || o_custkey, 'P:' || l_partkey, 'uses_table', round(avg(l_quantity) / 50, 4) FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey
  UNION ALL SELECT DISTINCT 'P:' || l_partkey, 'S:' || l_suppkey, 'depends_on', NULL::DOUBLE FROM lineitem
)"""

DEGREES = """degrees AS (
  SELECT s.id, coalesce(i.n, 0)::INTEGER AS in_degree, coalesce(o.n, 0)::INTEGER AS out_degree FROM symbols s
  LEFT JOIN (SELECT tgt, count(*) AS n FROM edges GROUP BY tgt) i ON i.tgt = s.id
  LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY src) o ON o.src = s.id
)"""

GRAPH = SYMBOLS + ", " + EDGES


def words(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def layer_case(kind: str = "kind", qualified: str = "qualified_name", name: str = "name") -> str:
    from ..functions import vocabulary as V

    parts = f"list_filter(string_split_regex(lower({qualified}), '[./\\\\]'), lambda x: x <> '')"
    out = f"CASE WHEN {kind} IN ({words(V.DATA_KINDS)}) THEN 'data'"
    for key in ("api", "data", "business", "infrastructure"):
        out += f" WHEN list_has_any({parts}, [{words(V.LAYER_SEGMENTS[key])}]) THEN '{key}'"
    for key in ("api", "data", "business", "infrastructure"):
        out += f" WHEN {kind} IN ('class', 'type') AND (" + " OR ".join(f"ends_with(lower({name}), '{s}')" for s in V.LAYER_SUFFIXES[key]) + f") THEN '{key}'"
    return out + f" WHEN {kind} IN ({words(V.CROSS_CUTTING_KINDS)}) THEN 'cross-cutting' ELSE 'unknown' END"


def common_substring(column: str, text: str) -> str:
    """Length of the longest substring of a short ASCII text that is in a column."""
    parts = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    sizes = ", ".join(f"CASE WHEN contains({column}, '{x}') THEN {len(x)} ELSE 0 END" for x in sorted(parts))
    return f"greatest({sizes})::INTEGER"


def relevance_case(text: str) -> str:
    """The relevance of a symbol to a short ASCII query in lower case."""
    common = common_substring("lower(name)", text)
    return (
        f"CASE WHEN lower(name) = '{text}' THEN 1.0 WHEN lower(qualified_name) = '{text}' THEN 0.95 WHEN contains(lower(name), '{text}') THEN 0.8 WHEN contains(lower(qualified_name), '{text}') THEN 0.6"
        f" WHEN contains('{text}', lower(name)) THEN 0.5 WHEN {common} > 2 THEN {common}::DOUBLE / greatest(octet_length(encode(lower(name))), {len(text)}) * 0.4 ELSE 0.0 END::DOUBLE"
    )
