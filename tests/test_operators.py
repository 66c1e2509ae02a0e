"""Graph operators against small graphs with known answers and plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import exprs as X
from graphloom.operators import analytics as A
from graphloom.operators import search as S
from graphloom.operators import traversal as T
from graphloom.operators.access import Principal, clamp, csv_values, visible
from graphloom.storage import delete_cascade, insert_missing, upsert

SYMBOLS = "id string, name string, qualified_name string, kind string, language string, file_id string"
EDGES = "src string, tgt string, edge_type string, confidence double"


@pytest.fixture(scope="module")
def seeded(spark):
    symbols = [("T", "Customers", "dbo.Customers", "table", "tsql", "f1"), ("P", "GetCustomer", "dbo.GetCustomer", "procedure", "tsql", "f1"),
               ("C", "CustomerRepository", "app.repository.CustomerRepository", "class", "go", "f2"), ("M", "GetByID", "app.repository.CustomerRepository.GetByID", "method", "go", "f2")]
    edges = [("P", "T", "reads_from", None), ("C", "P", "calls", None), ("M", "T", "reads_from", None)]
    return spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(edges, EDGES)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_seeded_graph(seeded):
    s, e = seeded
    assert rows(A.degrees(s, e)) == [("C", 0, 1), ("M", 0, 1), ("P", 1, 1), ("T", 2, 0)]
    assert rows(A.pagerank(e)) == [("C", 0.137504), ("M", 0.137504), ("P", 0.254383), ("T", 0.470608)]
    assert {r.layer for r in A.layers(s).collect()} == {"data"}
    assert {(r.source_language, r.target_language, r.edge_type, r.edge_count) for r in A.bridges(s, e).collect()} == {("go", "tsql", "calls", 1), ("go", "tsql", "reads_from", 1)}
    assert tuple(A.bridge_coverage(s, e).first()) == (2, 0, 0.0, 0)
    assert A.project_stats(s).first().total_symbols == 4
    up1, up2 = T.lineage_edges(e, "T", "upstream", 1), T.lineage_edges(e, "T", "upstream", 2)
    assert {(r.src, r.tgt) for r in up1.collect()} == {("P", "T"), ("M", "T")} and {(r.src, r.tgt) for r in up2.collect()} == {("P", "T"), ("M", "T"), ("C", "P")}
    assert {r.id for r in T.lineage_nodes(s, up1).collect()} == {"T", "P", "M"}
    assert T.lineage_edges(e, "C", "upstream", 3).collect() == []
    deleted = {r.id: (r.depth, r.severity, r.path) for r in T.impact(s, e, "T", "delete").collect()}
    assert deleted == {"P": (1, "critical", ["T", "P"]), "M": (1, "critical", ["T", "M"]), "C": (2, "medium", ["T", "P", "C"])}
    assert {r.severity for r in T.impact(s, e, "T", "modify").collect()} == {"medium"}
    assert {(r.id, r.role, r.severity) for r in T.impact_outgoing(s, e, "P", "delete").collect()} == {("T", "dependency", "HIGH"), ("C", "caller", None)}
    walked = T.trace(s, e, "C", "downstream")
    assert {(r.id, r.via, r.transition) for r in walked.collect()} == {("P", "C", True), ("T", "P", False)}
    assert T.trace_summary(walked).first().transitions == 1


def graph(spark, n=30, m=80, seed=1):
    r = random.Random(seed)
    edges = sorted({(f"n{r.randrange(n)}", f"n{r.randrange(n)}", r.choice(["calls", "uses_table"])) for _ in range(m)})
    symbols = [(f"n{i}", f"n{i}", f"a.n{i}", "class", "go", "f") for i in range(n)]
    return symbols, edges, spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame([(*e, 0.5) for e in edges], EDGES)


def test_pagerank_and_labels_against_python(spark):
    symbols, edges, s, e = graph(spark)
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    out = {x: sum(a == x for a, _, _ in edges) for x in nodes}
    for _ in range(20):
        lost = sum(rank[x] for x in nodes if not out[x])
        new = {x: 0.15 / len(nodes) + 0.85 * lost / len(nodes) for x in nodes}
        for a, b, _ in edges:
            new[b] += 0.85 * rank[a] / out[a]
        rank = new
    got = {r.id: r.pagerank for r in A.pagerank(e, digits=None).collect()}
    assert got.keys() == rank.keys() and all(math.isclose(got[x], rank[x], rel_tol=1e-9) for x in rank)
    label = {x[0]: x[0] for x in symbols}
    for _ in range(20):
        new = {}
        for x in label:
            votes = {label[x]: 1}
            for a, b, _ in edges:
                for p, q in ((a, b), (b, a)):
                    if p == x:
                        votes[label[q]] = votes.get(label[q], 0) + 1
            new[x] = min(votes, key=lambda k: (-votes[k], k))
        if new == label:
            break
        label = new
    assert {r.id: r.label for r in A.label_propagation(s, e).collect()} == label


def test_lineage_against_trails(spark):
    """Every edge on a trail (no edge twice) of at most three hops into the root, and no other."""
    _, edges, _, e = graph(spark, 12, 26, 3)

    def trails(node, used, left):
        for i, (a, b, _) in enumerate(edges):
            if b == node and i not in used and left:
                yield i
                yield from trails(a, used | {i}, left - 1)

    want = {edges[i] for i in trails("n1", frozenset(), 3)}
    assert {(r.src, r.tgt, r.edge_type) for r in T.lineage_edges(e, "n1", "upstream", 3).collect()} == want


def test_subgraph_cap_and_budget(spark):
    _, edges, s, e = graph(spark)
    found = T.subgraph(s, e, s.where("id = 'n1'"), 2, 7).orderBy("rank").collect()
    assert [r["rank"] for r in found] == list(range(1, len(found) + 1)) and len(found) <= 7 and found[0].id == "n1"
    first = {b for a, b, _ in edges if a == "n1"} | {a for a, b, _ in edges if b == "n1"}
    assert {r.id for r in found if r.depth == 1} <= first
    costs = spark.createDataFrame([("a", 5, 3.0), ("b", 5, 2.0), ("c", 1, 1.0)], "id string, cost long, pagerank double")
    assert [r.id for r in T.within_budget(costs, 9).collect()] == ["a"]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "id1", "x"), (2, "id2", "y")], "k int, id string, v string")
    new = spark.createDataFrame([(2, "new2", "z", 1), (2, "newer", "w", 2), (3, "id3", "q", 1)], "k int, id string, v string, seq int")
    assert rows(upsert(old, new, ["k"], keep=("id",), order=[F.desc("seq")])) == [(1, "id1", "x"), (2, "id2", "w"), (3, "id3", "q")]
    assert rows(insert_missing(old, old.union(spark.createDataFrame([(4, "a", "b"), (4, "a", "b")], old.schema)), ["k"])) == [(1, "id1", "x"), (2, "id2", "y"), (4, "a", "b")]
    files = spark.createDataFrame([("f1",), ("f2",)], "id string")
    symbols = spark.createDataFrame([("s1", "f1"), ("s2", "f2")], "id string, file_id string")
    edges = spark.createDataFrame([("s1", "s2"), ("s2", "s2")], "src string, tgt string")
    vectors = spark.createDataFrame([("s1",), ("s2",)], "symbol_id string")
    left = delete_cascade(files, symbols, edges, vectors, spark.createDataFrame([("f1",)], "file_id string"))
    assert [rows(x) for x in left] == [[("f2",)], [("s2", "f2")], [("s2", "s2")], [("s2",)]]


def test_scalar_functions(spark):
    def value(column):
        return spark.range(1).select(column.alias("v")).first().v

    lit = F.lit
    layer = lambda kind, q, n: value(X.layer(lit(kind), lit(q), lit(n)))
    assert [layer("table", "app.service.Customers", "Customers"), layer("class", "api.data.DataController", "DataController"), layer("class", "domain.Customer", "Customer"), layer("class", "app.middleware.AuthMiddleware", "AuthMiddleware"),
            layer("enum", "app.something.X", "X"), layer("class", "com.example.Foo", "Foo")] == ["data", "api", "business", "infrastructure", "cross-cutting", "unknown"]
    assert [len(value(X.segments(lit(x)))) for x in ("app/handlers/auth", "App\\Controllers\\UserController", "dbo.Customers/columns", "")] == [3, 3, 3, 0]
    relevance = lambda n, q, t: round(value(X.relevance(lit(n), lit(q), t)), 6)
    assert [relevance("Customers", "dbo.Customers", "customers"), relevance("X", "dbo.Customers", "dbo.customers"), relevance("CustomerRepository", "a.b", "customer"), relevance("X", "a.customer.b", "customer"), relevance("Zed", "q", "customer")] == [1.0, 0.95, 0.8, 0.6, 0.0]
    assert relevance("CustomerAddress", "x", "customerphone") == round(8 / 15 * 0.4, 6)
    assert value(X.search_terms(lit("What is the CustomerRepository?"))) == "customerrepository" and value(X.search_terms(lit("what is it?"))) == "what is it?"
    assert value(X.is_low_value(lit("column"), lit(None).cast("double"))) and not value(X.is_low_value(lit("table"), lit(0.0)))
    assert [value(X.looks_like_sql(lit(t))) for t in ("SELECT 1", "exec x", "CreateUser", "DeleteUser", "hello world", "")] == [True, True, False, False, False, False]
    assert value(X.dialect(lit("DECLARE @x INT\nSELECT TOP 1 * FROM t WITH (NOLOCK)\nGO\n"))) == "tsql" and value(X.dialect(lit("select 1"))) == "pgsql"
    assert [value(X.symbol_cost(lit(v), lit(None).cast("string"))) for v in ("summary", "standard", "full")] == [30, 60, 120]
    assert [value(X.intent(lit(q))) for q in ("What breaks if I change X?", "lineage of X", "show top tables", "who calls this", "zzz")] == ["impact", "lineage", "ranking", "cross_language", "search"]
    assert value(X.orm_variants(lit("Category"))) == ["Category", "Categories"] and value(X.orm_variants(lit("Users"))) == ["Users", "Userses", "User"]
    assert [value(X.valid_slug(lit(x))) for x in ("my-app", "a", "-bad-")] == [True, False, False]
    assert value(X.cosine_distance(F.lit([1.0, 0.0]), F.lit([0.0, 2.0]))) == 1.0 and value(X.cosine_distance(F.lit([0.0]), F.lit([1.0]))) is None
    assert len(value(S.hash_embedding(lit("a b c"), 16))) == 16


def test_access(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "tenant_id string, x int")
    assert visible(df, Principal("a")).count() == 1 and visible(df, Principal(None)).count() == 0 and visible(df, Principal(role="admin")).count() == 2
    assert Principal(scopes=("read",)).has_any_scope("write", "read") and not Principal().has_scope("read")
    assert (clamp(None, 20, 100), clamp(500, 20, 100), clamp(0, 20, 100)) == (20, 100, 20) and csv_values(" A, ,b") == ["a", "b"]


def test_whole_project(seeded, spark):
    s, e = seeded
    s = s.withColumn("source_id", F.lit("git"))
    enriched, table = A.compute_all(s, e)
    assert {r.id: (r.in_degree, r.layer) for r in enriched.collect()} == {"T": (2, "data"), "P": (1, "data"), "C": (0, "data"), "M": (0, "data")}
    keys = [(r["scope"], r.scope_id) for r in table.collect()]
    assert len(keys) == len(set(keys)) and ("bridge", "go->tsql->calls") in keys and ("project", "overview") in keys
    best, counts = S.filter_and_rank(enriched, "customers", ["table", "class"], ["T"], 1)
    assert best.first().id == "T" and tuple(counts.first()) == (2, 1)
    have = spark.createDataFrame([("T", [1.0])], "symbol_id string, embedding array<float>")
    assert {r.symbol_id: len(r.embedding) for r in S.embed_missing(s, have).collect()} == {"T": 1, "P": 64, "C": 64, "M": 64}
    assert {r.edge_type: (r.cnt, r.samples) for r in T.edge_histogram(e, 1).collect()} == {"calls": (1, ["C->P"]), "reads_from": (2, ["M->T"])}
    assert T.shortest_path(e, "C", "T") == ["C", "P", "T"] and T.shortest_path(e, "T", "C") is None
