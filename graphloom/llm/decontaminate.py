"""Benchmark decontamination with one Aho-Corasick automaton over the normalised benchmark texts.

Texts are normalised to words: A-Z lower-cased, runs of characters other than 0x00-0x2F, 0x3A-0x60 and 0x7B-0x7F. Every
window of 13 consecutive item words is a pattern (an item with fewer words, but some, is one), and the automaton runs
over word numbers, so a document is scanned once whatever the number of patterns. Hits are mapped back to character
offsets of the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, map_batches, materialise

WINDOW = 13
#: UTF-8 bytes of benchmark text in one automaton, about. Of a larger benchmark the documents are scanned once for each such part.
BLOCK_BYTES = 16 << 20

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def normalised_words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text."""
    # In UTF-8 every byte of a character above 0x7F is above 0x7F, so the classes hold for bytes. Of the white space that
    # split() cuts at, the table leaves only the space.
    return text.translate(_TABLE).split()


class Matcher:
    """An automaton over the windows of some (item_id, UTF-8 text) items."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = {}
        for item, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in normalised_words(text)]
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if words else 0):
                owners.setdefault(tuple(words[i : i + size]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, item_ids in owners.items():
            self.automaton.add_word(pattern, (len(pattern), frozenset(item_ids)))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> Iterator[tuple[int, int, frozenset]]:
        """(first word, last word, items) of every occurrence of a window, by last word."""
        if self.empty or not words:
            return
        number = self.numbers.get
        for last, (size, items) in self.automaton.iter(tuple([number(w, 0) for w in words])):
            yield last - size + 1, last, items


def _parts(benchmark: DataFrame) -> list:
    """The benchmark's items, broadcast in parts of about ``BLOCK_BYTES``; rows that share an id are in one part."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").cast("binary").alias("text")).where("text is not null and id is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    sc = benchmark.sparkSession.sparkContext
    for part in range(n):
        own = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) == part)
        yield part == n - 1, sc.broadcast([(r[0], bytes(r[1])) for r in own.toLocalIterator()])


_HITS = "struct<items: array<string>, ranges: array<struct<first: long, last: long>>>"


def _scan(docs: DataFrame, at: int, hits: int | None, sent, window: int, finish, schema) -> DataFrame:
    """``finish(batch, n_words, found)`` over batches of ``docs``, whose texts are column ``at`` and whose earlier hits are column ``hits``.

    The automaton is made once in a task; found holds a dict with items and ranges for each text, empty without hits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value, window)
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(at).cast(pa.binary())]
            found: list[dict] = [{} for _ in texts]
            if hits is not None:
                for own, old in zip(found, batch.column(hits).to_pylist(), strict=True):
                    if old and old["items"]:
                        own["items"], own["ranges"] = set(old["items"]), [(r["first"], r["last"]) for r in old["ranges"]]
            n_words = []
            for text, own in zip(texts, found, strict=True):
                words = normalised_words(text)
                n_words.append(len(words))
                for first, last, item_ids in matcher.scan(words):
                    own.setdefault("items", set()).update(item_ids)
                    own.setdefault("ranges", []).append((first, last))
            yield finish(batch, texts, n_words, found)

    return map_batches(docs, run, schema)


def _over_parts(docs: DataFrame, benchmark: DataFrame, window: int, finish, schema) -> DataFrame:
    """``finish`` over the documents with the hits of all parts of the benchmark; with one part, in one scan without a table between."""
    at, hits, names = docs.columns.index("text"), None, docs.columns

    def keep(batch: pa.RecordBatch, texts: list, n_words: list, found: list) -> pa.RecordBatch:
        kept = [{"items": sorted(f.get("items", ())), "ranges": [{"first": a, "last": b} for a, b in _merged(f.get("ranges", ()))]} for f in found]
        kind = pa.struct([("items", pa.list_(pa.string())), ("ranges", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])
        return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(kept, kind)], [*names, hit])

    hit = fresh_name(docs, "hits")
    for last, sent in _parts(benchmark):
        if last:
            return _scan(docs, at, hits, sent, window, finish, schema)
        docs = materialise(_scan(docs, at, hits, sent, window, keep, docs.select(*names, F.lit(None).cast(_HITS).alias(hit)).schema), "hits")
        hits = len(names)
    raise AssertionError("a benchmark has one part at least")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans.

    n_hit counts the document words inside any occurrence of a window. ``items`` are the item_ids with occurring windows,
    sorted as strings; ``spans`` the (start, end) character ranges of the hit words in the original text, neighbours
    joined. contaminated: n_hit > 0 and 20 * n_hit >= n_words. Null and empty texts have no words and no hits, a text of any
    length is scanned whole; null item texts are ignored; items that share an id are one item; repeated documents keep a row
    each. Without documents the result is empty, without items nothing is hit, and other columns are not looked at, whatever
    their names.

    The benchmark is the stated query set: it does not grow with the documents, and one automaton over it is sent to the tasks.
    Its size is looked at first: beyond ``BLOCK_BYTES`` the documents are scanned once for each part of that size, and the hits
    of one scan are written with them for the next.
    """

    def finish(batch: pa.RecordBatch, texts: list, n_words: list, found: list) -> pa.RecordBatch:
        rows = [_summary(text, hit) for text, hit in zip(texts, found, strict=True)]
        n_hit, item_ids, spans = map(list, zip(*rows, strict=True)) if rows else ([], [], [])
        columns = [
            batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(list(map(len, item_ids)), pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in item_ids], pa.string()),
            pa.array([is_contaminated(h, w) for h, w in zip(n_hit, n_words, strict=True)], pa.bool_()),
            pa.array(item_ids, pa.list_(pa.string())),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"])

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start: long, end: long>>"
    return _over_parts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), benchmark, window, finish, schema)


def is_contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns kept; nothing is shuffled."""
    n_columns, names = len(docs.columns), docs.columns

    def finish(batch: pa.RecordBatch, texts: list, n_words: list, found: list) -> pa.RecordBatch:
        keep = [not (hit and is_contaminated(sum(b - a + 1 for a, b in _merged(hit["ranges"])), n)) for hit, n in zip(found, n_words, strict=True)]
        return pa.RecordBatch.from_arrays(batch.columns[:n_columns], names).filter(pa.array(keep, pa.bool_()))

    return _over_parts(docs, benchmark, window, finish, docs.schema)


def _merged(ranges) -> list[tuple[int, int]]:
    """Ranges of words in their order, those that touch or overlap joined."""
    merged: list[list[int]] = []
    for first, last in sorted(ranges):
        if merged and first <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], last)
        else:
            merged.append([first, last])
    return [(a, b) for a, b in merged]


def _summary(text: bytes, hit: dict) -> tuple[int, list[str], list[dict]]:
    """(hit words, sorted items, character spans)."""
    if not hit:
        return 0, [], []
    merged = _merged(hit["ranges"])
    at = [m.span() for m in _WORD.finditer(text)]
    spans, done, chars = [], 0, 0
    for first, last in merged:
        start, end = at[first][0], at[last][1]
        chars += len(text[done:start].decode())
        length = len(text[start:end].decode())
        spans.append({"start": chars, "end": chars + length})
        chars += length
        done = end
    return sum(last - first + 1 for first, last in merged), sorted(hit["items"]), spans
