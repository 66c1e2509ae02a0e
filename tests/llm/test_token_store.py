import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from graphloom.llm.common import work_path  # noqa: E402
from graphloom.llm.token_store import PerfectHash, ShardIndex, Store, WordEncoder, _Head, lookup, read_store, word_encoder, write_store  # noqa: E402

PATH = P.path("word_bpe_49k.json")


def library_ids(texts):
    t = tokenizers.Tokenizer.from_file(PATH)
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def texts():
    r = random.Random(3)
    odd = "ab é́é ́x   \u0085\x1c'S'll 9٣日本😀ΣΑΣ İ<|endoftext|>|> \r\x0b\x0c 가"
    return ["", None, odd, "word " * 500, "z" * 5000, *("".join(r.choice(odd) for _ in range(r.randrange(1, 80))) for _ in range(300))]


def test_word_encoder_equals_the_library():
    encode = WordEncoder(PATH)
    for _ in range(2):  # the second time from the cache
        got = encode([(t or "").encode() for t in texts()])
        assert [np.frombuffer(x, encode.dtype).tolist() for x in got] == library_ids(texts())


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 20_000))
    hashed = PerfectHash.build(keys)
    assert sorted(hashed.slots(keys)) == list(range(len(keys)))
    assert PerfectHash.build(np.empty(0, np.int64)).size == 0


def test_index_round_trip():
    keys, sizes = np.array([0, 0, 3, 3, 3, 9], np.int64), np.array([4, 1, 0, 7, 2, 5], np.int64)
    index = ShardIndex.load(ShardIndex.build(keys, sizes, 2, 2).dump())
    offsets, own = index.rows()
    assert offsets.tolist() == [0, 4, 5, 5, 12, 14] and own.tolist() == sizes.tolist()
    found = index.find(np.array([3, 9, 4, 0]))
    assert found[2] == found[3] == -1 and index.entries["offset"][found[:2]].tolist() == [5, 14]
    empty = ShardIndex.load(ShardIndex.build(keys[:0], sizes[:0], 0, 4).dump())
    assert empty.find(np.array([1])).tolist() == [-1] and empty.rows()[0].tolist() == []


def test_a_lookup_reads_little_whatever_the_size():
    for n in (1, 100, 50_000):
        keys = np.sort(np.random.default_rng(n).choice(10**9, n, replace=False)).astype(np.int64)
        data = ShardIndex.build(keys, np.full(n, 3, np.int64), 0, 2).dump()
        head = _Head(data[:4096])
        for i in range(0, n, max(1, n // 50)):
            lengths = []
            assert head.find(int(keys[i]), lambda at, size, lengths=lengths: lengths.append(size) or data[at : at + size]) == (3 * i, 3)
            assert len(lengths) <= len(head.levels) + 1 and sum(lengths) <= 24 + 16 * len(head.levels)
        assert all(head.find(k, lambda at, size: data[at : at + size]) is None for k in range(10**9, 10**9 + 100))


def test_shards_by_bytes(spark):
    docs = spark.createDataFrame([(i, "word " * 200) for i in range(100)], "doc_id long, text string")
    path = work_path(spark, "tokens")
    shards = write_store(docs, path, lambda: word_encoder(PATH), shard_bytes=10_000)
    assert len(shards) == 10 and max(s["n_docs"] for s in shards) < 30
    assert [r.doc_id for r in sorted(read_store(spark, path).collect(), key=lambda r: r.start)] == list(range(100))
    store = Store(path)
    assert all(store.get(i) == store.get(0) and len(store.get(i)) == 201 for i in range(100)) and store.get(100) is None and store.get(-1) is None


def test_store(spark):
    rows = [(i * 13 % 1000, t) for i, t in enumerate(texts())] + [(5, "again"), (5, "again"), (None, "no key")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string").repartition(5)
    path = work_path(spark, "tokens")
    write_store(docs, path, lambda: word_encoder(PATH))
    got = sorted(read_store(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda k: -1 if k is None else k)
    assert sorted((r.doc_id or -1, r.ids) for r in got) == sorted((i or -1, ids) for (i, _), ids in zip(rows, library_ids([t for _, t in rows]), strict=True))
    start = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        start += r.n_tokens
    some = {r.doc_id: r.ids for r in got if r.doc_id not in (None, 5)}
    assert lookup(path, [*some, 10**6]) == some


def test_empty_table(spark):
    path = work_path(spark, "tokens")
    write_store(spark.createDataFrame([], "doc_id long, text string"), path, lambda: word_encoder(PATH))
    assert read_store(spark, path).collect() == []
