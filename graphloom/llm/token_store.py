"""Token-id files with a minimal perfect hash index from document keys to shard offsets.

A store is a folder of shards in ascending key order and a manifest:

``shard-NNNNN.ids``  the ids of all documents of the shard, one after the other, little-endian unsigned 16-bit integers if
                     every id fits, else 32-bit ones, no header;
``shard-NNNNN.idx``  a header of 4096 bytes: "GLOOMIX2", the counts of documents, keys, rows without a key and further rows, the
                     bytes of an id, and the place and length of each bit level of the hash; then, at places that follow from
                     the header, the levels (64-bit words, each with the number of bits set before it), an entry for each
                     hash slot (64-bit fingerprint, offset and number of ids), the documents' keys in their order, and the
                     further rows (ordinal, offset, number of ids): those without a key, and repeats of a key;
``manifest.json``    the shards' key ranges, document and token counts, and first token positions.

The hash is built level by level: keys that fall alone on a bit of a level own it, the others go to the next level. A key's
slot is the rank of its bit, so looking a key up reads the header, a word for each of a few levels, one entry and the
document's ids, whatever the shard's size; the fingerprint tells absent keys.
"""

from __future__ import annotations

import bisect
import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, map_batches, write_atomically

END = 1
_MAGIC, _HEADER, _COUNTS = b"GLOOMIX2", 4096, struct.Struct("<8s4qii")
_WORD = np.dtype([("bits", "<u8"), ("before", "<i8")])
_ENTRY = np.dtype([("mark", "<u8"), ("offset", "<i8"), ("size", "<i8")])
_FURTHER = np.dtype([("ordinal", "<i8"), ("offset", "<i8"), ("size", "<i8")])
#: UTF-8 bytes of text that a shard holds, about, and the least for which a shard of its own is made to keep all cores busy.
SHARD_BYTES, LEAST_SHARD_BYTES = 128 << 20, 4 << 20
#: Bytes of ids that a reader holds at once, unless one document has more.
READ_BYTES = 8 << 20
#: Entries that a worker's cache of encoded words holds before it is emptied, and the longest word kept.
CACHE_WORDS, CACHE_LENGTH = 400_000, 64


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: each key of the set has its own slot below the set's size."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # of 64-bit words
        self.ranks, total = [], 0
        for words in levels:
            counts = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(total + np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(words) else np.empty(0, np.int64))
            total += int(counts.sum())
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        levels, rest = [], np.asarray(keys, np.int64)
        while len(rest):
            n_words = max(1, -(-int(gamma * len(rest)) // 64))
            at = _hash(rest, len(levels)) % np.uint64(64 * n_words)
            _, first, counts = np.unique(at, return_inverse=True, return_counts=True)
            alone = counts[first] == 1
            words = np.zeros(n_words, np.uint64)
            own = at[alone]
            np.bitwise_or.at(words, (own >> np.uint64(6)).astype(np.int64), np.uint64(1) << (own & np.uint64(63)))
            levels.append(words)
            rest = rest[~alone]
            if len(levels) > 240:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 for keys that no level owns (an absent key may also get some slot)."""
        keys = np.asarray(keys, np.int64)
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(rest):
                break
            at = _hash(keys[rest], level) % np.uint64(64 * len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = words[word]
            there = (held >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[rest[there]] = (ranks[word] + below)[there]
            rest = rest[~there]
        return out


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return _hash(keys, 1_000_003)


class ShardIndex:
    """Keys to offsets and sizes of one shard. Rows without a key come first; of a repeated key, the hash gives the first row."""

    def __init__(self, keys: np.ndarray, n_null: int, width: int, hashed: PerfectHash, entries: np.ndarray, further: np.ndarray):
        self.keys, self.n_null, self.width, self.hashed, self.entries, self.further = keys, n_null, width, hashed, entries, further

    @classmethod
    def build(cls, keys: np.ndarray, sizes: np.ndarray, n_null: int, width: int) -> ShardIndex:
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[:-1]
        distinct, first = np.unique(keys[n_null:], return_index=True)
        first = first + n_null
        hashed = PerfectHash.build(distinct)
        entries = np.zeros(len(distinct), _ENTRY)
        slots = hashed.slots(distinct)
        entries["mark"][slots], entries["offset"][slots], entries["size"][slots] = _fingerprints(distinct), offsets[first], sizes[first]
        rest = np.setdiff1d(np.arange(len(keys)), first)
        further = np.zeros(len(rest), _FURTHER)
        further["ordinal"], further["offset"], further["size"] = rest, offsets[rest], sizes[rest]
        return cls(keys, n_null, width, hashed, entries, further)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, sizes) of all documents in their order: those of keys by the hash, the others from the further rows."""
        keyed = np.ones(len(self.keys), bool)
        keyed[self.further["ordinal"]] = False
        found = self.find(self.keys[keyed])
        if (found < 0).any():
            raise ValueError("the index does not give its documents")
        offsets, sizes = np.empty(len(self.keys), np.int64), np.empty(len(self.keys), np.int64)
        for column, name in ((offsets, "offset"), (sizes, "size")):
            column[keyed], column[self.further["ordinal"]] = self.entries[name][found], self.further[name]
        return offsets, sizes

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slots of keys, -1 where absent (an absent key is taken for another with probability 2**-64)."""
        keys = np.asarray(keys, np.int64)
        if not self.hashed.size:
            return np.full(len(keys), -1, np.int64)
        slots = self.hashed.slots(keys)
        return np.where((slots >= 0) & (self.entries["mark"][slots] == _fingerprints(keys)), slots, -1)

    def dump(self) -> bytes:
        place, table, levels = _HEADER, [], []
        for bits, before in zip(self.hashed.levels, self.hashed.ranks, strict=True):
            words = np.zeros(len(bits), _WORD)
            words["bits"], words["before"] = bits, before
            table.append((place, len(bits)))
            levels.append(words.tobytes())
            place += words.nbytes
        head = _COUNTS.pack(_MAGIC, len(self.keys), len(self.entries), self.n_null, len(self.further), self.width, len(table)) + b"".join(struct.pack("<2q", *x) for x in table)
        return b"".join([head.ljust(_HEADER, b"\0"), *levels, self.entries.tobytes(), self.keys.astype("<i8").tobytes(), self.further.tobytes()])

    @classmethod
    def load(cls, data: bytes) -> ShardIndex:
        head = _Head(data)
        words = [np.frombuffer(data, _WORD, n, at) for at, n in head.levels]
        further = np.frombuffer(data, _FURTHER, head.n_further, head.keys_at + 8 * head.n_docs)
        return cls(np.frombuffer(data, "<i8", head.n_docs, head.keys_at), head.n_null, head.width, PerfectHash([w["bits"] for w in words]), np.frombuffer(data, _ENTRY, head.n_keys, head.entries_at), further)


class _Head:
    """The counts and places in an index's header."""

    def __init__(self, data: bytes):
        magic, self.n_docs, self.n_keys, self.n_null, self.n_further, self.width, n = _COUNTS.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a shard index")
        self.levels = [struct.unpack_from("<2q", data, _COUNTS.size + 16 * i) for i in range(n)]
        self.entries_at = self.levels[-1][0] + 16 * self.levels[-1][1] if self.levels else _HEADER
        self.keys_at = self.entries_at + _ENTRY.itemsize * self.n_keys

    def find(self, key: int, read) -> tuple[int, int] | None:
        """(offset, size) of a key, by ``read(place, bytes)`` of a word for each level and one entry."""
        wanted = np.array([key], np.int64)
        for level, (at, n) in enumerate(self.levels):
            bit = int(_hash(wanted, level)[0] % np.uint64(64 * n))
            bits, before = struct.unpack("<Qq", read(at + 16 * (bit >> 6), 16))
            if bits >> (bit & 63) & 1:
                slot = before + (bits & ((1 << (bit & 63)) - 1)).bit_count()
                mark, offset, size = struct.unpack("<Qqq", read(self.entries_at + _ENTRY.itemsize * slot, _ENTRY.itemsize))
                return (offset, size) if mark == int(_fingerprints(wanted)[0]) else None
        return None


class WordEncoder:
    """Encodes UTF-8 texts with a lower-casing tokenizers file that drops white space, word by word with a cache.

    Such a tokenizer splits at white space before anything else reaches across it, so a text's ids are those of its
    ASCII-white-space separated words, one after the other, and a mark of punctuation behind a letter is a token sequence of
    its own. The library encodes every word that is not in the cache; words of letters only go to it many at a time and are
    told apart by their last ids, which carry the end-of-word suffix.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 65536 else "<u4")
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.marks = {mark: self._alone([chr(mark)])[0] for mark in b".,;:!?"}

    def _alone(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        letters, others = [], []
        for w in words:
            (letters if w.decode().isalpha() else others).append(w)
        out = dict(zip(others, self._alone([w.decode() for w in others]), strict=True))
        groups = [letters[i : i + 256] for i in range(0, len(letters), 256)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int64)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(group) or len(stops) and stops[-1] != len(ids):  # a word that is more than one token sequence
                out.update(zip(group, self._alone([w.decode() for w in group]), strict=True))
                continue
            data, size = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
            starts = [0, *(stops * size).tolist()]
            out.update((w, data[a:b]) for w, a, b in zip(group, starts, starts[1:], strict=False))
        return out

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of words that are not in the cache."""
        cache, older, marks = self.cache, self.older, self.marks
        stems, new, known = {}, set(), {}
        for w in words:
            if w in older:
                known[w] = older[w]
            elif len(w) > 1 and w[-1] in marks and 97 <= w[-2] <= 122:
                stem = w[:-1]
                stems[w] = stem
                if stem not in cache and stem not in older:
                    new.add(stem)
            else:
                new.add(w)
        fresh = self._encode(sorted(new))
        known.update(fresh)
        for w, stem in stems.items():
            known[w] = (known.get(stem) or cache.get(stem) or older[stem]) + marks[w[-1]]
        return known

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as bytes of ``dtype``, with the end id."""
        # Lower-casing ASCII letters first changes no id, unless it made a special token's name.
        parts = [(t if b"<|" in t else t.lower()).split() for t in texts]
        words = list(chain.from_iterable(parts))
        ids = list(map(self.cache.get, words))
        if None in ids:
            at = [i for i, x in enumerate(ids) if x is None]
            known = self._learn({words[i] for i in at})
            for i in at:
                ids[i] = known[words[i]]
            if len(self.cache) + len(known) > CACHE_WORDS:  # the words seen since the last time stay within reach
                self.older, self.cache = self.cache, {}
            self.cache.update((w, x) for w, x in known.items() if len(w) <= CACHE_LENGTH)
        end, out, start = np.array([END], self.dtype).tobytes(), [], 0
        for own in parts:
            stop = start + len(own)
            out.append(b"".join(ids[start:stop]) + end)
            start = stop
        return out


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The encoder of a tokenizers file, kept in a worker from one task to the next."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _shards(docs: DataFrame, shard_bytes: int) -> int:
    """How many shards the texts make: enough that each holds about ``shard_bytes``, and while they are small, that all cores have one."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(1, -(-total // shard_bytes), min(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-total // LEAST_SHARD_BYTES)))


def write_store(docs: DataFrame, path: str, encoder: Callable[[], Callable[[list[bytes]], list[bytes]]], shard_bytes: int = SHARD_BYTES) -> list[dict]:
    """Write the ids of every row of ``docs`` (doc_id, text) in ascending doc_id order below ``path``; returns the shards.

    ``encoder()`` gives, once in a task, the function from UTF-8 texts to id bytes; it has a ``dtype``. Null texts are
    empty; rows without doc_id come first; rows that repeat one follow each other in the order of their texts' hashes. An empty
    table makes a store without documents; other columns are not looked at, whatever their names. A shard holds about
    ``shard_bytes`` of text, so its index fits a task's memory at every size, or one document that is longer. One short row for
    each shard comes to the driver. A task that runs again writes the same files again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        shard = TaskContext.get().partitionId()
        keys, sizes, n_null = [], [], 0

        def ids(stream) -> None:
            nonlocal n_null
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    own = batch.column(0).slice(at, 256)
                    n_null += own.null_count
                    keys.append(own.fill_null(0).to_numpy(zero_copy_only=False))
                    coded = encode([t.as_py() or b"" for t in batch.column(1).slice(at, 256).cast(pa.binary())])
                    sizes.extend(len(x) // encode.dtype.itemsize for x in coded)
                    stream.write(b"".join(coded))

        write_atomically(f"{path}/shard-{shard:05d}.ids", ids)
        all_keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
        index = ShardIndex.build(all_keys, np.array(sizes, np.int64), n_null, encode.dtype.itemsize)
        write_atomically(f"{path}/shard-{shard:05d}.idx", lambda stream: stream.write(index.dump()))
        known = all_keys[n_null:]
        row = {"shard": [shard], "n_docs": [len(all_keys)], "n_tokens": [int(sum(sizes))], "low": [int(known[0]) if len(known) else None], "high": [int(known[-1]) if len(known) else None]}
        yield pa.RecordBatch.from_pydict(row, schema=pa.schema([(k, pa.int64()) for k in row]))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("h", F.xxhash64("text"))
    placed = rows.repartitionByRange(_shards(docs, shard_bytes), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    shards = sorted((r.asDict() for r in map_batches(placed, run, "shard long, n_docs long, n_tokens long, low long, high long").collect()), key=lambda r: r["shard"])
    start = 0
    for row in shards:
        row["start"] = start
        start += row["n_tokens"]
    write_atomically(f"{path}/manifest.json", lambda stream: stream.write(json.dumps(shards).encode()))
    return shards


def _read(path: str) -> bytes:
    system, at = filesystem(path)
    with system.open_input_stream(at) as stream:
        return stream.read()


def read_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, read from the files through their index.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is of the ids as little-endian unsigned 32-bit integers. Each
    document's place comes from its key's entry in the hash.
    """
    shards = json.loads(_read(f"{path}/manifest.json"))
    firsts = [s["start"] for s in shards]
    numbers = [s["shard"] for s in shards]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from _shard_rows(path, numbers[k], firsts[k], with_ids)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    n = len(shards)
    return map_batches(spark.range(0, n, 1, max(1, n)), run, schema)


def _shard_rows(path: str, shard: int, first: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    index = ShardIndex.load(_read(f"{path}/shard-{shard:05d}.idx"))
    n, keys, width = len(index.keys), index.keys, index.width
    offsets, sizes = index.rows()
    ends = offsets + sizes
    system, at = filesystem(f"{path}/shard-{shard:05d}.ids")
    with system.open_input_file(at) as file:
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(ends, offsets[i] + READ_BYTES // width, "right")))
            data = np.frombuffer(file.read_at(int(ends[j - 1] - offsets[i]) * width, int(offsets[i]) * width), f"<u{width}")
            parts = [data[a:b] for a, b in zip(offsets[i:j] - offsets[i], ends[i:j] - offsets[i], strict=True)]
            columns = [
                pa.array(keys[i:j], pa.int64(), mask=np.arange(i, j) < index.n_null), pa.array(first + offsets[i:j], pa.int64()),
                pa.array(sizes[i:j], pa.int64()), pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
            i = j


class Store:
    """Keyed access to a written store: the manifest is read once, a key's shard found by bisection, its ids with a few short reads."""

    def __init__(self, path: str):
        self.path = path
        self.shards = [s for s in json.loads(_read(f"{path}/manifest.json")) if s["low"] is not None]
        self.highs = [s["high"] for s in self.shards]

    def get(self, key: int) -> list[int] | None:
        """The ids of the document with this key (the first, if it is repeated), None if there is none."""
        at = bisect.bisect_left(self.highs, key)
        if at == len(self.shards) or key < self.shards[at]["low"]:
            return None
        name = f"{self.path}/shard-{self.shards[at]['shard']:05d}"
        system, index = filesystem(f"{name}.idx")
        with system.open_input_file(index) as file:
            read = lambda place, n: file.read_at(n, place)
            head = _Head(read(0, _HEADER))
            found = head.find(key, read)
        if found is None:
            return None
        offset, size = found
        with system.open_input_file(filesystem(f"{name}.ids")[1]) as file:
            return np.frombuffer(file.read_at(size * head.width, offset * head.width), f"<u{head.width}").tolist()


def lookup(path: str, keys: list[int]) -> dict[int, list[int]]:
    """The ids of the documents with these keys; absent keys are left out."""
    store = Store(path)
    return {key: ids for key in keys if (ids := store.get(key)) is not None}
