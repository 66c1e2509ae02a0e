import re

import corpus_pipeline
from graphloom.llm import classifier
from graphloom.llm.common import materialise

from .test_decontaminate import words_of
from .test_minhash import brute as components


def test_stages_against_brute_force(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    columns = docs.columns
    items = {r.item_id: words_of(r.text) for r in spark.read.parquet(f"{source}/benchmark.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = materialise(stage(spark, docs, source), name)
        after = {r.doc_id: r for r in out.collect()}
        if name == "encoding":
            assert after.keys() == before.keys() and all(r.round_trip == ("▁" not in before[i].text) for i, r in after.items())
            assert corpus_pipeline.run(spark, source).count() == len(after)
            return
        assert out.columns == columns and out.dtypes == docs.dtypes
        if name == "quality":
            ranker = classifier.train(docs, spark.read.parquet(f"{source}/labels.parquet"))
            good = {i for i, r in before.items() if ranker.score(classifier.np.array([classifier.features(r.text.encode())]))[0] >= classifier.CUT}
            assert after.keys() == good and 0 < len(good) < len(before)
        elif name == "near_duplicates":
            assert after.keys() == {x[0] for x in components([(i, r.text) for i, r in before.items()], 5, 80) if x[3]}
        elif name == "decontamination":
            for i, r in before.items():
                words, hit = words_of(r.text), set()
                for own in items.values():
                    n = min(13, len(own))
                    windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}
                    for k in range(len(words) - n + 1):
                        if tuple(words[k : k + n]) in windows:
                            hit.update(range(k, k + n))
                assert (i in after) == (not (hit and 20 * len(hit) >= len(words)))
        else:
            assert after.keys() == before.keys()
            for i, r in after.items():
                assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", r.text)
                assert r.n_chars == len(r.text) if r.text != before[i].text else r == before[i]
        docs = out


def test_empty_documents(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{source}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


