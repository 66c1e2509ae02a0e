"""Label propagation: what it leaves on disk, and many blocks against plain Python."""

import os
import random
import time

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from graphloom.operators import analytics as A
from graphloom.operators import propagation as P
from graphloom.storage import discard, files, materialise, shared_dir


def shuffled(spark):
    """Shuffle files of this session that hold something."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for top in folders for d, _, names in os.walk(top.getPath()) for f in names if f.startswith("shuffle_") and f.endswith(".data") and os.path.getsize(f"{d}/{f}")}


def random_graph(n, m, seed):
    r = random.Random(seed)
    ids = [f"{r.choice('ABc')}:{i}" for i in range(n)]
    ends = [*ids, "no such", None]
    edges = [(r.choice(ends), r.choice(ids[:9] + ends)) for _ in range(m)]
    return ids, edges + edges[:20] + [(ids[3], ids[3]), (ids[5], ids[4]), (ids[5], ids[4])]


def frames(spark, ids, edges):
    return spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(edges, "src string, tgt string")


def by_hand(ids, edges, rounds):
    label, heard = {i: i for i in ids}, {i: [i] for i in ids}
    for a, b in edges:
        if a in heard and b in heard:
            heard[a].append(b)
            heard[b].append(a)
    for _ in range(rounds):
        new = {}
        for i in ids:
            votes = {}
            for x in heard[i]:
                votes[label[x]] = votes.get(label[x], 0) + 1
            new[i] = min(votes, key=lambda k: (-votes[k], k))
        label = new
    return label


@pytest.mark.parametrize("run", [A.clusters, A.label_propagation])
def test_rounds_leave_no_exchange_and_no_links_on_disk(spark, run):
    ids, edges = random_graph(200, 600, 1)
    before, work = shuffled(spark), os.path.join(shared_dir(spark).removeprefix("file://"), "work")
    tables = set(os.listdir(work)) if os.path.isdir(work) else set()
    got = run(*frames(spark, ids, edges), 4)
    assert not shuffled(spark) - before
    assert {t.split("-")[0] for t in set(os.listdir(work)) - tables} == {"nodes", "labels"}
    assert got.count() == 200


def test_many_blocks_against_python(spark, monkeypatch):
    """Parallel edges, loops and unknown or null ends, with links of a few hundred nodes in many blocks; one hub."""
    monkeypatch.setattr(P, "BLOCK_NODES", 50)
    monkeypatch.setattr(P, "BLOCK_LINKS", 150)
    ids, edges = random_graph(230, 700, 2)
    edges += [(ids[0], x) for x in ids]
    for rounds in (1, 3):
        got = A.label_propagation(*frames(spark, ids, edges), rounds)
        assert {r.id: r.label for r in got.collect()} == by_hand(ids, edges, rounds)


def test_parts_and_slices_leave_room_for_the_next(spark, monkeypatch):
    """A part's exchanges are gone before the next part is read; no exchange takes all pairs at once, and what a slice came from goes."""
    monkeypatch.setattr(P, "BLOCK_NODES", 50)
    monkeypatch.setattr(P, "SLICED", 100, raising=False)
    ids, edges = random_graph(230, 700, 3)
    symbols, every = frames(spark, ids, edges)
    apart = every.repartition(8, "src", "tgt")
    before, seen = shuffled(spark), []
    work = os.path.join(shared_dir(spark).removeprefix("file://"), "work")
    os.makedirs(work, exist_ok=True)
    old = set(os.listdir(work))

    def parts(tag):
        return sum(f.startswith("part-") for t in set(os.listdir(work)) - old if t.startswith(tag) for f in os.listdir(f"{work}/{t}"))

    def watched(df, tag, release=False):
        ends = time.time() + 10
        while tag == "pairs" and shuffled(spark) - before and time.time() < ends:  # deleted in the background
            time.sleep(0.1)
        seen.append((tag, len(shuffled(spark) - before), parts("pairs"), parts("half")))
        if tag == "table":
            before.update(shuffled(spark))
        return materialise(df, tag, release)

    monkeypatch.setattr(P, "materialise", watched)
    got = A.label_propagation(symbols, [apart.where("src < 'b'"), apart.where("src >= 'b' or src is null")], 3)
    assert {r.id: r.label for r in got.collect()} == by_hand(ids, edges, 3)
    assert [s[1] for s in seen if s[0] == "pairs"] == [0, 0]
    halves = [s[2] for s in seen if s[0] == "half"]
    assert len(halves) > 1 and sorted(halves, reverse=True) == halves and halves[-1] < halves[0] / 2
    assert all(s[2] < halves[0] for s in seen if s[0] == "links") and not any(s[3] for s in seen if s[0] in ("half", "labels"))
    assert not parts("pairs")


def test_discard_of_some_files(spark):
    table = materialise(spark.range(0, 40, 1, 4), "some files")
    paths = files(table)
    kept = spark.read.parquet(*paths[1:])
    discard(spark.read.parquet(paths[0]))
    assert len(paths) == 4 and kept.count() == 30
    folder = paths[0].rsplit("/", 1)[0].removeprefix("file:")
    discard(kept)
    assert not os.path.exists(folder)


def test_without_nodes_or_edges(spark):
    symbols, edges = frames(spark, ["a", "b"], [("x", "y")])
    assert A.label_propagation(symbols.limit(0), edges, 3).collect() == []
    assert sorted(map(tuple, A.label_propagation(symbols, edges.limit(0), 3).collect())) == [("a", "a"), ("b", "b")]
    assert sorted(map(tuple, A.clusters(symbols, edges, 3).collect())) == [("a", 0), ("b", 0)]


def test_packed_numbers():
    for x in ([], [0], [255, 256], [3, 2**32 - 1], [2**64 - 1, 0]):
        x = np.array(x, np.uint64)
        assert P.unpack(P.pack(x)).tolist() == x.tolist() and P.unpack_sorted(P.pack_sorted(np.sort(x))).tolist() == sorted(x.tolist())


def test_dealt_numbers_small_and_large():
    """Numbers that fit into one of 64 bits together, just fit, and do not."""
    r = np.random.default_rng(4)
    for bits, wide, blocks in ((10, 8, 3), (58, 6, 1), (40, 24, 7), (40, 25, 7), (64, 64, 5), (1, 1, 2), (64, 1, 1)):
        key, value = (r.integers(0, 2**b - 1, 500, np.uint64, endpoint=True) for b in (bits, wide))
        got = []
        for batch in P._deal(key, value, blocks, 1):
            ((p, kind, n, x, y, _),) = P._rows([batch])
            x, y = P.unpack_sorted(x), P.unpack(y)
            assert kind == 1 and n == len(x) == len(y) and (np.diff(x.astype(object)) >= 0).all()
            got += [(int(a) * blocks + p, int(b)) for a, b in zip(x, y)]
        assert sorted(got) == sorted(zip(key.tolist(), value.tolist()))


def test_votes_beyond_16_bits(spark):
    """So many parallel edges that they outvote what more different neighbours say."""
    symbols, _ = frames(spark, ["a", "b", "c", "d"], [("a", "b")])
    ends = "src string, tgt string"
    edges = spark.range(70_000).selectExpr("'c' as src", "'d' as tgt").union(spark.createDataFrame([("a", "c"), ("b", "c"), ("b", "d")], ends))
    got = A.label_propagation(symbols, edges, 1)
    assert {r.id: r.label for r in got.collect()} == {"a": "a", "b": "b", "c": "d", "d": "c"}


def test_registered_clusters_take_all_rounds(spark, tmp_path):
    """Sparse tables, whose labels still move after six rounds, and after twelve."""
    n, r = 100, random.Random(0)
    lines = [(i, r.randrange(n), r.randrange(n)) for i in range(n) for _ in range(4)]
    tables = {
        "region": "SELECT 0 AS r_regionkey, 'R' AS r_name",
        "nation": f"SELECT i AS n_nationkey, 'N' || i AS n_name, 0 AS n_regionkey FROM range({n}) t(i)",
        "customer": f"SELECT i AS c_custkey, 'C' || i AS c_name, i AS c_nationkey, 'M' AS c_mktsegment FROM range({n}) t(i)",
        "supplier": f"SELECT i AS s_suppkey, 'S' || i AS s_name, i AS s_nationkey FROM range({n}) t(i)",
        "part": f"SELECT i AS p_partkey, 'P' AS p_name, 'B' AS p_brand, 'T' AS p_type FROM range({n}) t(i)",
        "orders": f"SELECT i AS o_orderkey, i AS o_custkey FROM range({n}) t(i)",
        "lineitem": f"SELECT *, 1.0::DOUBLE AS l_quantity FROM (VALUES {', '.join(map(str, lines))}) t(l_orderkey, l_partkey, l_suppkey)",
    }
    con = duckdb.connect()
    for name, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    got = {r.id: r.cluster_id for r in entry.queries()["clusters"](spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(entry.oracle_sql()["clusters"]).fetchall())
    ids = ["R:0", *(f"{k}:{i}" for k in "NCSP" for i in range(n))]
    edges = {(f"N:{i}", "R:0") for i in range(n)} | {(f"{k}:{i}", f"N:{i}") for k in "CS" for i in range(n)}
    edges |= {e for c, p, s in lines for e in ((f"C:{c}", f"P:{p}"), (f"P:{p}", f"S:{s}"))}

    def numbered(label):
        members = {}
        for i in ids:
            members.setdefault(label[i], []).append(i)
        first = sorted(min(m) for m in members.values() if len(m) >= 3)
        return {i: first.index(min(m)) + 1 if len(m) >= 3 else 0 for m in members.values() for i in m}

    assert got == numbered(by_hand(ids, edges, 20))
    assert all(got != numbered(by_hand(ids, edges, few)) for few in (6, 12))


@pytest.mark.parametrize("rounds", [19, 20])
def test_labels_that_come_back_are_not_computed_again(spark, monkeypatch, rounds):
    """Two ends of parallel edges swap labels for ever; a chain beside them settles first."""
    ids = ["a", "b", *(f"c{i}" for i in range(8))]
    edges = [("a", "b")] * 2 + [(f"c{i}", f"c{i + 1}") for i in range(7)]
    runs = []
    monkeypatch.setattr(P, "materialise", lambda df, tag, release=False: runs.append(tag) or materialise(df, tag, release))
    got = {r.id: r.label for r in A.label_propagation(*frames(spark, ids, edges), rounds).collect()}
    assert got == by_hand(ids, edges, rounds) and got["a"] == "ab"[rounds % 2]
    assert runs.count("labels") < 12
