"""Registered queries over whole tables against their SQL, with the part of the SQL that cuts the data taken out of a copy."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.operators.graph_tables import symbols

DATA = "/root/testdata/sf0.001"

CUTS = {
    "enclosing_range": " WHERE l_orderkey < 400",
    "ingest_stream": " AND event_id < 700",
    "table_refs": ("left(text, 60)", "text"),
    "intent_class": ("left(text, 80)", "text"),
    "question_parameters": ("left(text, 80)", "text"),
    "search_terms": ("left(text, 80)", "text"),
}


def whole_sql(name):
    cut = CUTS[name]
    old, new = (cut, "") if isinstance(cut, str) else cut
    return entry.oracle_sql()[name].replace(old, new)


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def same_rows(spark, name, data):
    con = duckdb.connect()
    for t in ("lineitem", "part", "events", "conversations"):
        if os.path.exists(f"{data}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.execute(whole_sql(name))
    columns = [c[0] for c in want.description]
    got = entry.queries()[name](spark, data).select(*columns).collect()
    assert sorted_rows(got) == sorted_rows(want.fetchall())


@pytest.mark.parametrize("name", list(CUTS))
def test_whole_table(spark, name):
    same_rows(spark, name, DATA)


@pytest.mark.parametrize("name", ["table_refs", "intent_class", "question_parameters", "search_terms"])
def test_words_behind_the_prefix(spark, name, tmp_path):
    """conv_id 12 asks with 'of' alone, so that what decides stands in the text, far behind its first 80 characters."""
    texts = ["x " * 100 + t for t in ("rename the procedure", "what breaks upstream", "delete a layer from Tables", "join Orders of all", "update Log set a")]
    rows = ", ".join(f"(12, {n}, 'user', '{t}')" for n, t in enumerate(texts))
    duckdb.sql(f"COPY (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM (VALUES {rows}) v(conv_id, turn, role, text)) TO '{tmp_path}/conversations.parquet' (FORMAT parquet)")
    same_rows(spark, name, str(tmp_path))


def common(a, b):
    a, b = a.encode(), b.encode()
    return max((n for i in range(len(a)) for n in range(1, len(a) - i + 1) if a[i : i + n] in b), default=0)


def relevance(name, qualified, query):
    n, q = name.lower(), qualified.lower()
    for hit, value in ((n == query, 1.0), (q == query, 0.95), (query in n, 0.8), (query in q, 0.6), (n in query, 0.5)):
        if hit:
            return value
    c = common(n, query)
    return 0.4 * c / max(len(n.encode()), len(query)) if c > 2 else 0.0


def test_symbols_of_all_kinds(spark):
    every = {r.id: r for r in symbols(spark, DATA).collect()}
    run = {q: {r[0]: r for r in entry.queries()[q](spark, DATA).collect()} for q in ("lcs_rank", "embed_hash", "embed_missing", "rank_composite")}
    for q in ("lcs_rank", "embed_hash", "rank_composite"):
        assert run[q].keys() == every.keys()
    assert every.keys() <= run["embed_missing"].keys()
    con = duckdb.connect()
    for v, e in con.execute(f"SELECT vec_id, embedding FROM '{DATA}/embeddings.parquet'").fetchall():
        assert run["embed_missing"][f"P:{v}"].embedding == pytest.approx(e)
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    whole = dict(con.execute(entry.oracle_sql()["rank_composite"]).fetchall())
    tier = 0
    for i, s in every.items():
        assert run["lcs_rank"][i].common == common(s.name.lower(), "united nations")
        assert run["lcs_rank"][i].relevance == pytest.approx(relevance(s.name, s.qualified_name, "united nations"), abs=1e-6)
        more = relevance(s.name, s.qualified_name, "nation_1")
        tier += 0 < more < 0.5
        assert run["rank_composite"][i].score == pytest.approx(whole[i], abs=3e-6)
        assert whole[i] >= 0.30 * more
    assert tier
