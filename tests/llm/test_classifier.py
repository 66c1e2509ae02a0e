import random
import zlib

import numpy as np

from graphloom.llm.classifier import CUT, classify, features, fit, keep_good, train

SCHEMA = "doc_id long, text string, score string"


def corpus(n=600):
    r = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("aeionrst") for _ in range(r.randrange(2, 8))) for _ in range(r.choice([5, 30, 200]))]
        good = r.random() < 0.8
        if not good:
            kind = r.randrange(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + r.choice(["***", "%%%", "$$$"]) for w in words] if kind == 1 else [w for w in words[:10] for _ in range(12)]
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_order(spark):
    docs, labels = corpus()
    d, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = classify(d, lab).collect()
    truth = {i: q for i, q, _ in labels}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(rows) == 600 and len(held) > 60
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= CUT) for r in rows)
    flipped = lab.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    assert sorted(classify(d, flipped).collect()) == sorted(rows)  # held-out labels are never read
    assert {r.doc_id for r in keep_good(d, lab).collect()} == {r.doc_id for r in rows if r.predicted}


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "x" * 200_000, "s"), (3, "x", "s"), (None, "y", "s")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, score int")
    got = classify(docs, none).collect()
    assert len(got) == 5 and all(r.predicted == 1 for r in got)
    one_sided = spark.createDataFrame([(i, 0) for i in range(10)] + [(None, 1), (3, None)], "doc_id long, quality int")
    assert all(0 <= r.score < CUT for r in classify(docs, one_sided).collect())
    assert classify(docs.limit(0), none).collect() == []


def test_pairwise_weights_follow_the_features():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(features(b""))))
    label = (x[:, 2] + 0.1 * rng.normal(size=400) > -1).astype(int)
    ranker = fit(x, label)
    assert np.argmax(np.abs(ranker.weights)) == 2 and ranker.weights[2] > 0
    assert abs(int((ranker.score(x) < CUT).sum()) - int((label == 0).sum())) <= 1


def test_weights_are_those_of_all_pairs():
    """The gradient of the loss over every pair of a good and a bad row, made one by one, is 0 at the weights."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, len(features(b""))))
    label = (x[:, 2] - x[:, 4] + rng.normal(size=500) > -1).astype(int)
    r = fit(x, label)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    d = (z[label == 1][:, None] - z[label == 0][None]).reshape(-1, x.shape[1])
    assert np.abs(d.T @ (-1 / (1 + np.exp(d @ r.weights))) / len(d) + 1e-3 * r.weights).max() < 1e-5
    order = np.sort(r.latent(x))
    bad = int((label == 0).sum())
    assert r.cutoff == (order[bad - 1] + order[bad]) / 2


def test_every_labelled_document_is_learned_from(spark):
    """More labelled documents than come to the driver: the same model as from all of them there."""
    docs, labels = corpus()
    d, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    there, here = train(d, lab, rows=100), train(d, lab)
    for name in ("centre", "scale", "weights", "cutoff", "slope"):
        assert np.allclose(getattr(there, name), getattr(here, name), rtol=1e-6, atol=1e-6), name


def test_ties_at_the_cutoff():
    x = np.zeros((10, len(features(b""))))
    x[:3, 0] = -1
    r = fit(x, np.array([0, 0, 0, 0, 1, 1, 1, 1, 1, 1]))
    assert np.sort(r.latent(x))[3] == r.cutoff == np.sort(r.latent(x))[4]
