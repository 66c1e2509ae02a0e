import random
import re

import pytest

from graphloom.llm.minhash import bands_for, connected_components, keep_one, near_duplicates

SCHEMA = "doc_id long, text string"


def sets_of(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    k = min(k, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, k, percent):
    sets = [(i, sets_of(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}É" for i in range(300)]
    rows, base = [], [[r.choice(vocabulary) for _ in range(r.choice([3, 9, 40, 120]))] for _ in range(12)]
    for i in range(160):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3, 6])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        rows.append((i * 7 % 1009, r.choice([" ", "\n", "  \t"]).join(words).upper() if r.random() < 0.2 else " ".join(words)))
    return rows + [(5000, None), (5001, ""), (5002, " \n "), (5003, "one"), (5004, "One"), (5005, "one two"), (5006, "x " * 20000)]


@pytest.mark.parametrize("k,percent,seed", [(3, 85, 1), (5, 80, 2)])
def test_against_brute_force(spark, k, percent, seed):
    rows = corpus(seed)
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), k, percent).collect()
    assert sorted(map(tuple, got)) == brute(rows, k, percent)


def test_repeated_and_null_ids(spark):
    text = " ".join(f"a{i}" for i in range(30))
    other = " ".join(f"b{i}" for i in range(30))
    rows = [(3, text), (3, text), (4, text), (7, other), (8, other), (4, other), (None, text)]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert [(x[0], x[2], x[3]) for x in got] == [(3, 3, True), (3, 3, True), (4, 3, False), (4, 3, False), (7, 3, False), (8, 3, False), (None, None, True)]


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, component_id string, s0 int")
    assert near_duplicates(empty).collect() == []
    docs = spark.createDataFrame([(1, "a b", "x", 1), (2, "a b", "y", 2)], empty.schema)
    assert [r.doc_id for r in near_duplicates(docs).where("kept").collect()] == [1]
    assert [tuple(r) for r in keep_one(docs).collect()] == [(1, "a b", "x", 1)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 100), (95, 95)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_bands():
    assert bands_for(0.85) == (5, 25) and bands_for(0.8) == (4, 32)


def test_buckets_with_many_components(spark):
    """Families that share most of a long template but not enough to be linked: their buckets stay in several components."""
    r = random.Random(12)
    template, rows = [f"t{i}" for i in range(150)], []
    for family in range(30):
        own = [w if r.random() > 0.05 else f"f{family}_{i}" for i, w in enumerate(template)]
        for _ in range(4):
            words = list(own)
            words[r.randrange(len(words))] = f"x{r.random()}"
            rows.append((len(rows) * 17 % 1009, " ".join(words)))
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), 3, 85).collect()
    want = brute(rows, 3, 85)
    assert sorted(map(tuple, got)) == want and 5 < len({x[2] for x in want}) < 120


def test_large_sets(spark):
    """Sets above the sketch's sample size, on both sides of the threshold."""
    r = random.Random(9)
    rows = []
    for base in range(4):
        words = [f"v{base}_{i}" for i in range(3000)]
        for copy in range(4):
            changed = list(words)
            for _ in range([0, 40, 70, 160][copy]):
                changed[r.randrange(len(changed))] = f"n{r.random()}"
            rows.append((base * 10 + copy, " ".join(changed)))
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(2), 3, 85).collect()
    assert sorted(map(tuple, got)) == brute(rows, 3, 85)
