import random
import re

import pytest

P = pytest.importorskip("public_tokenizers")
spm = pytest.importorskip("sentencepiece")

from graphloom.llm.sentencepiece_stream import Model, encode_documents  # noqa: E402

PATH = P.path("piece_bpe_32k.model")


def texts():
    r = random.Random(0)
    mixed = ["".join(r.choice("aabcdeth   \n日é😀▁.,0123") for _ in range(r.randrange(1, 200))) for _ in range(400)]
    runs = [" " * n + "a" for n in range(0, 50, 3)] + ["a" * n for n in range(1, 60, 7)]
    return ["", " ", "a  b", "▁x y\n\tz", "<s> </s>", "\x00", "the" * 500, "0" * 3000, *mixed, *runs]


@pytest.fixture(scope="module")
def data():
    with open(PATH, "rb") as f:
        return f.read()


@pytest.mark.parametrize("cuts", [True, False])
def test_equals_the_library(data, cuts):
    model, library = Model(data), spm.SentencePieceProcessor(model_proto=data)
    if not cuts:
        model._split, model.cut_at_marks = re.compile("(?s).+").findall, False
    for text in texts():
        assert model.encode(text) == library.encode(text)
        assert model.decode(model.encode(text)) == library.decode(library.encode(text))


def test_window_does_not_change_ids_and_stays_bounded(data):
    model = Model(data)
    text = "▁the▁quick" * 300
    whole = [i for part in model.search(text, 10**9) for i in part]
    for window in (16, 33, 100):
        parts = list(model.search(text, window))
        assert [i for p in parts for i in p] == whole
        assert len(parts) > 5 and max(map(len, parts)) <= 2 * window


def test_every_chunk_goes_through_the_search(data, monkeypatch):
    model, searched = Model(data), []
    search = model.search
    monkeypatch.setattr(model, "search", lambda text, *a: searched.append(text) or search(text, *a))
    model.encode("one two  three\nfour " + "long" * 50)
    assert "".join(searched) == "▁one▁two▁▁three\nfour▁" + "long" * 50


def test_unigram_scores(data):
    """The sum of piece scores is the library's best one (its ids but for ties)."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto, r = pb.ModelProto(), random.Random(2)
    proto.ParseFromString(data)
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        p.score = -r.randrange(1, 4000) / 8  # sums are exact in single precision
    model, library = Model(proto.SerializeToString()), spm.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for text in texts():
        ours, theirs = model.encode(text), library.encode(text)
        assert ours == theirs or sum(model.scores[i] for i in ours if model.types[i] == 1) == sum(model.scores[i] for i in theirs if model.types[i] == 1)


def test_documents(spark):
    rows = [(1, None), (2, ""), (3, "Hello world\n" * 3), (3, "Hello world\n" * 3), (None, "x"), (4, "mark ▁ inside"), (5, "y" * 100_000)]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, ids int, n_tokens string")  # clashing names
    got = encode_documents(docs, PATH).collect()
    library = spm.SentencePieceProcessor(model_file=PATH)
    assert sorted((r.doc_id or 0, r.ids) for r in got) == sorted((i or 0, library.encode(t or "")) for i, t in rows)
    assert {r.doc_id for r in got if not r.round_trip} == {4}
    assert encode_documents(docs.limit(0), PATH).collect() == []
