"""MinHash near-duplicate detection with odd sketches.

A document's set is its distinct word shingles, as 64-bit hashes. 128 MinHash samples of the set give band keys, and its
bottom-1024 MinHash sample, folded by parity into a 1024-bit map (an odd sketch), tests candidate pairs: each element in
which two samples differ flips one bit of the XOR of their maps, so the population count never exceeds the samples'
symmetric difference. For sets of up to 1024 shingles the sample is the set, and a count above the largest difference that
the threshold allows rules a pair out for certain; pairs with a larger set are ruled out by their sizes only. Pairs that pass
are compared on their full sets.

Work stays linear in skewed groups:

* equal sets are collapsed first; one representative (smallest doc_id) stands for all copies;
* in each band bucket the smallest member is the hub, and each member is first compared with one hub only, so a group of
  n near copies costs n comparisons;
* only buckets whose members are still in different components are looked at again; there the members outside the
  bucket's main component are compared with the members of other components whose sets are of a size that may reach the
  threshold. Nothing is capped, so the result is the components of all links among banded candidates. With the default bands
  a pair at the threshold shares no band with probability below 1e-6;
* rows of a group (copies of a text, a bucket, the neighbours of a hub) are joined with what the group shares by the group's
  key and a salt, for as many salts as the group has rows with, so a group of a third of all rows spreads over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import every_salt, map_batches, materialise, salt, with_group

SAMPLES = 128
#: Elements of the bottom MinHash sample that is folded into the odd sketch, and the sketch's bits.
BOTTOM = 1024
SKETCH_BITS = 1024
WORDS = SKETCH_BITS // 64
#: Entries that a worker's word cache holds before it is emptied.
CACHE_WORDS = 250_000

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = _SEEDS | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes | None, shingle: int, cache: dict | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text, A-Z lower-cased.

    Words are runs of bytes other than space and 0x09-0x0D. Fewer words than ``shingle`` give one element for the whole
    sequence, no words none.
    """
    cache = _WordHashes() if cache is None else cache
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    size = min(shingle, len(h))
    n = len(h) - size + 1
    acc = np.full(n, size, np.uint64)
    for i in range(size):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(acc)


def minhashes(elements: np.ndarray) -> np.ndarray:
    """The 128 MinHash samples of a non-empty set."""
    best = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(elements), 2048):
        block = elements[i : i + 2048, None] * _ODD[None, :] + _SEEDS[None, :]
        np.minimum(best, (block ^ (block >> np.uint64(32))).min(axis=0), out=best)
    return best


def odd_sketch(elements: np.ndarray) -> np.ndarray:
    """Parity bitmap of the BOTTOM smallest of the sorted elements, as signed 64-bit words."""
    at = (elements[:BOTTOM] & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
    bits = (np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def bands_for(threshold: float) -> tuple[int, int]:
    """(rows, bands): the longest rows for which a pair at the threshold is missed with probability below 1e-6."""
    for rows in range(8, 0, -1):
        bands = SAMPLES // rows
        if (1 - threshold**rows) ** bands < 1e-6:
            return rows, bands
    return 1, SAMPLES


_SIGNATURE = (
    "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>, " + ", ".join(f"s{i} long" for i in range(WORDS))
)

_SKETCH = [f"s{i}" for i in range(WORDS)]


def signatures(docs: DataFrame, shingle: int, rows: int, bands: int) -> DataFrame:
    """One row per document with its set's size, a 128-bit digest of the set, band keys and odd sketch (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHashes()
        salt = _mix(np.arange(bands, dtype=np.uint64) + np.uint64(77))
        for batch in batches:
            ids = batch.column(0)
            for start in range(0, batch.num_rows, 512):
                part = batch.column(1).slice(start, 512).cast(pa.binary())
                n, d1, d2, keys, sketches = [], [], [], [], []
                for text in part:
                    s = shingle_set(text.as_py(), shingle, cache)
                    n.append(len(s))
                    if not len(s):
                        d1.append(None), d2.append(None), keys.append(None), sketches.append([None] * WORDS)
                        continue
                    digest = xxhash.xxh3_128_intdigest(s.tobytes())
                    d1.append((digest >> 64) - (1 << 63))
                    d2.append((digest & ((1 << 64) - 1)) - (1 << 63))
                    m = minhashes(s)
                    acc = salt.copy()
                    block = m[: rows * bands].reshape(bands, rows)
                    for r in range(rows):
                        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + block[:, r])
                    keys.append(acc.view(np.int64).tolist())
                    sketches.append(odd_sketch(s).tolist())
                columns = [ids.slice(start, 512), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                columns += [pa.array([x[i] for x in sketches], pa.int64()) for i in range(WORDS)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "d1", "d2", "keys", *(f"s{i}" for i in range(WORDS))])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, _SIGNATURE)


def _full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                sets = [shingle_set(t.as_py(), shingle, cache).view(np.int64) for t in batch.column(1).slice(start, 128).cast(pa.binary())]
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = np.concatenate(sets) if sets else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, 128), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "elements"])

    return map_batches(docs, run, "doc_id long, elements array<long>")


def _distance(a: str, b: str) -> Column:
    """Population count of the XOR of two odd sketches."""
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(WORDS)))


def _allowed(a: str, b: str, percent: int) -> Column:
    """The largest distance of the sketches of two sets (sizes in column n) that may reach the threshold; -1 if sizes rule it out."""
    p, q = F.col(f"{a}.n"), F.col(f"{b}.n")
    common = F.ceil(percent * (p + q) / (100 + percent))
    return F.when(common > F.least(p, q), -1).when(F.greatest(p, q) <= BOTTOM, p + q - 2 * common).otherwise(SKETCH_BITS)


def _attach(pairs: DataFrame, key: str, member: str, values: DataFrame) -> DataFrame:
    """``pairs`` with the columns that ``values`` (key, ...) has for their key; a key's values go once to each salt of its pairs."""
    salted = pairs.select("*", salt(member))
    return salted.join(salted.select(key, "salt").distinct().join(values, key), [key, "salt"]).drop("salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the (a, b) edges; the component is its smallest node.

    Alternates large-star and small-star steps, which keep connectivity and turn each component into a star around its
    smallest node; every round is a table in the shared folder, so no lineage grows and no node set reaches the driver.
    """
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_group(both, ["a"], ["b"], m=(F.min, "b")).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        large = large.where("a <> b").distinct()
        small = with_group(large, ["a"], ["b"], m=(F.min, "b"))
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        e = materialise(small.where("a <> b").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum("a"), F.sum("b"), F.expr("count(distinct a)"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state or now[0] == now[3] and e.select(F.col("b").alias("a")).distinct().join(e, "a", "left_semi").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
        state = now


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose full sets reach the threshold; b's set goes to where the sets of its a's are."""
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("ea")), "a")
    both = F.size(F.array_intersect("ea", "eb"))
    return (
        _attach(left, "b", "a", sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("eb")))
        .select("a", "b", F.size("ea").alias("na"), F.size("eb").alias("nb"), both.alias("both"))
        .where(f"100 * both >= {percent} * (na + nb - both)").select("a", "b")
    )


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked if ``100 * |A & B| >= percent * |A | B|`` for their sets of ``shingle``-word shingles. Null,
    empty and wordless texts have an empty set and are linked with nothing. Rows that repeat a doc_id are one document in
    the components (each version's links count) and keep a row each. A null doc_id has a null component and is kept. Texts of any
    length are compared whole, an empty table gives an empty one, and other columns are not looked at, whatever their names.
    """
    threshold = percent / 100
    rows, bands = bands_for(threshold)
    sig = materialise(signatures(docs, shingle, rows, bands), "signatures")
    usable = sig.where("n_shingles > 0 and doc_id is not null")

    # Equal sets become one class, named by its smallest document.
    copies = with_group(usable.select("doc_id", "d1", "d2"), ["d1", "d2"], ["doc_id"], rep=(F.min, "doc_id"))
    member = materialise(copies.select("doc_id", "rep", "d1", "d2").distinct(), "classes")
    own = usable.join(member.where("doc_id = rep").select("doc_id", "d1", "d2"), ["doc_id", "d1", "d2"], "left_semi").dropDuplicates(["doc_id", "d1", "d2"])
    sketch_columns = [F.col("n_shingles").alias("n"), *_SKETCH]

    # Buckets with two members or more; the smallest member is the hub.
    entries = own.select(F.explode("keys").alias("key"), F.col("doc_id").alias("rep"))
    buckets = materialise(with_group(entries, ["key"], ["rep"], "hub < other", hub=(F.min, "rep"), other=(F.max, "rep")).select("key", "rep", "hub").distinct(), "buckets")
    involved = buckets.select(F.col("rep").alias("doc_id")).distinct()
    sketches = materialise(own.join(involved, "doc_id", "left_semi").select("doc_id", *sketch_columns), "sketches")
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sets = materialise(_full_sets(text.join(involved, "doc_id", "left_semi"), shingle), "sets")

    # First each member against the hub that its sketch is nearest to.
    compared = buckets.where("rep <> hub").select("rep", "hub").distinct().join(sketches.select(F.col("doc_id").alias("rep"), F.struct("n", *_SKETCH).alias("x")), "rep")
    compared = _attach(compared, "hub", "rep", sketches.select(F.col("doc_id").alias("hub"), F.struct("n", *_SKETCH).alias("y")))
    near = (
        compared.select("rep", "hub", _distance("x", "y").alias("distance"), _allowed("x", "y", percent).alias("allowed")).where("distance <= allowed")
        .groupBy("rep").agg(F.min(F.struct("distance", "hub")).alias("best"))
        .select(F.col("rep").alias("a"), F.col("best.hub").alias("b"))
    )
    versions = member.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    first = connected_components(_verified(near, sets, percent))

    # Then whatever shares a bucket and is still apart.
    named = buckets.select("key", "rep").join(first, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))
    main = (
        named.groupBy("key", "c").agg(F.count("*").alias("n"))
        .groupBy("key").agg(F.max(F.struct("n", "c")).alias("m"), F.count("*").alias("parts")).where("parts > 1")
        .select("key", F.col("m.c").alias("main"))
    )
    salted_main = main.select("key", "main", F.explode(every_salt()).alias("salt"))
    known_main = named.select("*", salt("rep")).join(salted_main, ["key", "salt"])
    # Sets that reach the threshold differ in size by less than a factor 1 / threshold, so by one class of sizes at most.
    sizes = sketches.withColumnRenamed("doc_id", "rep").withColumn("class", F.floor(F.log("n") / (1.0001 * math.log(1 / threshold))) if threshold < 1 else F.col("n"))
    apart = materialise(known_main.join(sizes, "rep"), "apart")
    outside = apart.where("c <> main").drop("salt").withColumn("class", F.explode(F.array(*(F.col("class") + i for i in (-1, 0, 1)))))
    outside = outside.withColumn("salt", F.explode(every_salt()))
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.class") == F.col("y.class")) & (F.col("x.salt") == F.col("y.salt"))
    pairs = (
        outside.alias("x").join(apart.alias("y"), same & F.expr("x.c <> y.c and (y.c = y.main or x.rep < y.rep)") & (_distance("x", "y") <= _allowed("x", "y", percent)))
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    )
    late = _verified(pairs, sets, percent)
    # A doc_id with several versions stands in several classes, so classes only join there.
    several = member.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("a"))
    late = materialise(late.union(versions.join(several, "a", "left_semi").select("a", "b")), "late")
    known = first.select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = first if late.isEmpty() else connected_components(known.union(late))
    of = (
        member.groupBy("doc_id").agg(F.min("rep").alias("rep"))
        .join(final, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    )
    return (
        sig.select("doc_id", "n_shingles").join(of, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.expr("doc_id = component_id"), F.lit(True)))
    )


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document stands for its group; rows that repeat a doc_id are kept together."""
    gone = near_duplicates(docs, shingle, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
