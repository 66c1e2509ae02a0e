import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.llm import quality_rules
from graphloom.llm.quality_rules import RULES, binomial_tail, judge, measures, thresholds

SCHEMA = "doc_id long, text string, lang string, kept int"
SPACE = r"[\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = [w for w in re.split(SPACE, text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def texts():
    r = random.Random(6)
    words = ["a", "b", "é😀", "x#", "C|", "日本", "d d", "$"]
    out = [None, "", " \n\t", "a " * 19, "a " * 20, "w1 w2 w3 w4 w5 w6 w7 w8 " * 2, "a\n\n \nb\na\na \n", "p " * 30_000, " ".join(f"q{i % 5000}" for i in range(12_000))]
    for _ in range(300):
        out.append("".join(r.choice(words) + r.choice([" ", " ", "\n", "\x0b", "  "]) for _ in range(r.randrange(1, 120))))
    return out


def test_counts_against_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "en", 0) for i, t in rows], SCHEMA).repartition(4)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: r for r in judge(docs, none).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
        assert r.kept == (not r.base_failed)  # nothing is certified without labels
    assert len(got) == len(rows)


def test_binomial_tail(spark):
    cases = [(0, 10, 0.3), (3, 10, 0.3), (10, 10, 0.3), (0, 100_000, 0.01), (900, 100_000, 0.01), (1, 1, 0.5), (40, 2000, 0.01)]
    for k, n, p in cases:
        got = spark.range(1).select(binomial_tail(F.lit(k), F.lit(float(n)), p)).first()[0]
        logs = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in range(k + 1)]
        assert got == pytest.approx(min(1.0, math.fsum(map(math.exp, logs))), rel=1e-6, abs=1e-300)


def labelled(n=6000):
    r = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(25)]
        good = r.random() < 0.8
        if not good and r.random() < 0.9:
            words = [w + "##" for w in words]
        elif r.random() < 0.001:
            words = [w.upper() for w in words]
        docs.append((i, " ".join(words), "en" if i % 40 else "xx" if i % 80 else None, 0))
        labels.append((i, int(good)))
    return docs, labels


def test_certified_cutoffs(spark):
    docs, labels = labelled()
    d, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id long, quality int")
    found = {r.stratum: r for r in thresholds(measures(d), lab).collect()}
    assert set(found) == {"en"}  # the small strata certify nothing
    assert RULES["symbols_per_word"][found["en"].step] == RULES["symbols_per_word"][-1]
    for r in found.values():
        assert r.level == quality_rules.ERROR / 3 and r.p_value <= r.level and r.rejected <= quality_rules.RISK * r.good
    truth = dict(labels)
    rows = judge(d, lab).collect()
    big = [r for r in rows if r.doc_id % 40]
    assert sum(not r.kept for r in big if truth[r.doc_id]) <= quality_rules.RISK * sum(truth[r.doc_id] for r in big)
    assert sum(r.kept for r in big if not truth[r.doc_id]) <= 0.15 * sum(not truth[r.doc_id] for r in big)
    assert all(r.kept for r in rows if r.doc_id % 40 == 0)


def brute_step(rows, risk, level):
    """The strictest certified step over the measures of good documents, by the definition."""
    for step in range(quality_rules.STEPS):
        k = sum(any(r[rule] > RULES[rule][step] for rule in RULES) for r in rows)
        n = len(rows)
        tail = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(risk) + (n - j) * math.log1p(-risk)) for j in range(k + 1))
        if tail > level:
            return step - 1
    return quality_rules.STEPS - 1


def test_steps_against_brute_force_and_their_coverage(spark):
    """Over many strata whose true rejection grows with the step, the chosen steps are the definition's, and hardly any exceeds the risk."""
    r = random.Random(4)
    names = list(RULES)
    rows, truth = [], {}
    for s in range(40):
        scale = r.uniform(0.02, 0.3)
        for i in range(400):
            which = r.choice(names)
            rows.append({"doc_id": len(rows), "stratum": f"s{s:02d}", "n_words": 50, "n_repeat_words": 0} | {n: (r.expovariate(1 / (scale * RULES[n][0])) if n == which else 0.0) for n in names})
        truth[f"s{s:02d}"] = [sum(math.exp(-c[step] / (scale * c[0])) for c in RULES.values()) / len(names) for step in range(quality_rules.STEPS)]
    measured = spark.createDataFrame([tuple(x.values()) for x in rows], list(rows[0]))
    labels = spark.createDataFrame([(x["doc_id"], 1) for x in rows], "doc_id long, quality int")
    found = {x.stratum: x.step for x in thresholds(measured, labels, risk=0.05).collect()}
    for name in truth:
        assert found.get(name, -1) == brute_step([x for x in rows if x["stratum"] == name], 0.05, quality_rules.ERROR / 40)
    assert len(found) >= 10
    assert sum(truth[name][step] > 0.05 for name, step in found.items()) <= 1


def test_given_labels_certify_every_language(spark):
    import os

    path = "/root/testdata/sf0.1"
    if not os.path.exists(path):
        return
    found = thresholds(measures(spark.read.parquet(f"{path}/documents.parquet")), spark.read.parquet(f"{path}/labels.parquet")).collect()
    assert {r.stratum for r in found} == {"en", "de", "fr", "es"}
    assert all(r.rejected <= quality_rules.RISK * r.good for r in found)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b " * 20, "en", 5, 6, 7)], "doc_id long, text string, lang string, stratum int, step int, n_words int")
    none = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert [(r.doc_id, r.n_words, r.kept) for r in judge(docs, none).collect()] == [(1, 40, False)]


def test_edge_cases(spark):
    docs = spark.createDataFrame([], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert judge(docs, none).collect() == []
    twice = spark.createDataFrame([(1, "a " * 30, None, 0), (1, "a " * 30, None, 0), (None, "b c", "en", 0)], SCHEMA)
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in judge(twice, none).collect()) == [(0, 2, False), (1, 30, False), (1, 30, False)]
