from graphloom.operators.access import Principal
from graphloom.operators.search import embed_missing
from graphloom.plans.api import Project, Session, first_json_object, to_markdown, tokens

SYMBOLS = "id string, name string, qualified_name string, kind string, language string, file_id string, tenant_id string"


def project(spark, who=None):
    s = spark.createDataFrame([("T", "Customers", "dbo.Customers", "table", "tsql", "f1", "a"), ("P", "GetCustomer", "dbo.GetCustomer", "procedure", "tsql", "f1", "a"), ("C", "CustomerRepository", "app.CustomerRepository", "class", "go", "f2", "b")], SYMBOLS)
    e = spark.createDataFrame([("P", "T", "reads_from", None), ("C", "P", "calls", 0.9)], "src string, tgt string, edge_type string, confidence double")
    return Project(spark, s, e, who=who, tenant_column="tenant_id")


def test_questions(spark):
    p = project(spark)
    assert p.resolve("customers") == "T"
    intent, rows = p.ask("What breaks if I delete GetCustomer?")
    assert intent in ("impact", "search") and rows.columns
    assert p.ask("show me the most used table")[1].first().id == "T"
    assert p.ask("describe the architecture")[1].first()[0].startswith("This project contains 3 symbols")
    assert [r.id for r in p.impact("T").collect()] == ["P", "C"]
    nodes, edges = p.subgraph(seeds=["P"], depth=1)
    assert {r.id for r in nodes.collect()} == {"T", "P", "C"} and edges.count() == 2
    assert {r.id for r in p.subgraph(seeds=["P"], depth=1, budget=170)[0].collect()} == {"P"}
    assert len(p.hints("overview")) == 3
    assert project(spark, Principal("a")).symbols.count() == 2


def test_subgraph_seeds(spark):
    p = project(spark)
    core = lambda topic, kinds=None: {r.id for r in p.subgraph(topic, kinds=kinds, depth=1)[0].collect() if r.core}
    assert core("customers table list") == set() and core("customers table list", ["table"]) == {"T"}
    p.embeddings = embed_missing(p.symbols, spark.createDataFrame([], "symbol_id string, embedding array<float>"))
    assert core("GetCustomer") == {"P"}
    assert core("customers table list", ["procedure", "class"]) == {"P", "C"} and core("customers table list", ["table"]) == {"T"}
    p.embeddings = p.embeddings.where("symbol_id = 'T'")
    assert core("customers table list") == {"T"} and core("...") == set()


def test_answers(spark):
    df = spark.range(50)
    text = to_markdown(df, "rows", budget=40)
    assert "left out" in text and tokens(text) < 60
    assert first_json_object('so {bad {"a": "}", "b": {"c": 1}} end') == {"a": "}", "b": {"c": 1}} and first_json_object("none {") is None
    s = Session()
    for i in range(30):
        s.asked(str(i)), s.focus(str(i)), s.showed(["x"])
    assert len(s.queries) == 20 and len(s.focused) == 10 and s.seen == ["x"]
