import hashlib
import random
import re

import pytest

from graphloom.llm import decontaminate
from graphloom.llm.decontaminate import clean, contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for i, text in docs:
        words, hit, found = words_of(text), set(), set()
        for item, t in items:
            own = words_of(t)
            n = min(13, len(own))
            windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
            for k in range(len(words) - n + 1 if n else 0):
                if tuple(words[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found.add(str(item))
        ids = sorted(found)
        out.append((i, len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words), ids))
    return out


def data():
    r = random.Random(5)
    vocabulary = [f"Wé{i}x" for i in range(40)] + ["a", "B", "9", "日本"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 2, 5, 13, 14, 30])))) for i in range(30)]
    items += [(100, None), (101, " !? "), (3, items[4][1]), (102, items[5][1])]
    docs = [(900, None), (901, ""), (902, "?!"), (903, "a")]
    for i in range(120):
        words = [r.choice(vocabulary) for _ in range(r.choice([3, 30, 400]))]
        for _ in range(r.choice([0, 1, 2])):
            own = (r.choice(items)[1] or "").split()
            at = r.randrange(len(words))
            words[at:at] = own[: r.choice([5, 12, 13, 40])]
        docs.append((i, r.choice([" ", "--", "\n\t"]).join(words)))
    return docs, items


@pytest.mark.parametrize("block", [1 << 24, 1000])
def test_against_brute_force(spark, monkeypatch, block):
    """With one automaton, and with a benchmark beyond its size bound."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs, items = data()
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = contamination(d, b).collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted(brute(docs, items))
    texts = dict(docs)
    for r in got:
        inside = [w for s in r.spans for w in words_of(texts[r.doc_id][s.start : s.end])]
        assert len(inside) == r.n_hit
    assert {r.doc_id for r in clean(d, b).collect()} == {r.doc_id for r in got if not r.contaminated}


def test_parts_hold_every_item_once(spark, monkeypatch):
    items = [(i % 40, "word " * (i % 7)) for i in range(100)] + [(None, "x"), (50, None)]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    parts = [sent.value for _, sent in decontaminate._parts(spark.createDataFrame(items, "item_id long, text string"))]
    assert len(parts) > 3 and sorted(x for p in parts for x in p) == sorted((str(i), t.encode()) for i, t in items if i is not None and t is not None)
    assert all(not {i for i, _ in p} & {i for i, _ in q} for p in parts for q in parts if p is not q)


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "x")], "doc_id long, text string, items string")
    none = spark.createDataFrame([], "item_id long, text string, doc_id long")
    assert [tuple(r)[:4] for r in contamination(docs, none).collect()] == [(1, 3, 0, 0)]
    assert contamination(docs.limit(0), none).collect() == []
    assert [tuple(r) for r in clean(docs, none).collect()] == [(1, "a b c", "x")]


def test_clashing_columns_over_several_parts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1)
    docs = spark.createDataFrame([(1, "a b c", "x", 1), (2, "q", "y", 2)], "doc_id long, text string, hits string, _hits int")
    items = spark.createDataFrame([(1, "a b"), (2, "c")], "item_id long, text string")
    assert [tuple(r)[:5] for r in contamination(docs, items).orderBy("doc_id").collect()][0][:4] == (1, 3, 3, 2)
    assert [tuple(r) for r in clean(docs, items).collect()] == [(2, "q", "y", 2)]
