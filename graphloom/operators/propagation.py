"""Label propagation over numbered nodes, in blocks of packed arrays.

Nodes are numbered in the order of their ids, so that the smaller of two labels is the smaller number; node n is place n // blocks of
block n % blocks. The links of a block, those by which its nodes are heard, are arrays in a few rows. A round sends each block's
labels along its links, equal ones of a listener as one with a count, and the listener's block takes the commonest. Beside the
links, only what one round sends lies on disk: each round's exchanges go when its labels are written. Large sets of links are made
slice by slice: each goes through its exchanges, which are deleted with what they came from, before the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, files, materialise, released

#: Nodes and links of a block, about.
BLOCK_NODES, BLOCK_LINKS = 65_536, 2_000_000
#: From so many edges on, links are made in so many slices.
SLICED, SLICES = 8_000_000, 4
#: Values that a task holds before it deals them out.
HELD = 4_000_000
#: Packed arrays of n values each, for block p; kind 0 comes before kind 1.
PACKED = "p int, kind int, n long, x binary, y binary, z binary"

_NAMES = ["p", "kind", "n", "x", "y", "z"]
_SHIFT, _LOW, _VOTES = np.uint64(32), np.uint64(0xFFFFFFFF), np.uint64(16)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs, all first bytes first, which a block compressor likes."""
    x = np.ascontiguousarray(x).astype(np.min_scalar_type(int(x.max()) if len(x) else 0))
    return bytes([x.itemsize]) + x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8, offset=1).reshape(b[0], -1)
    return np.ascontiguousarray(planes.T).view(f"u{b[0]}").ravel().astype(np.uint64)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batch(p: int, kind: int, n: int, x: bytes, y: bytes | None = None, z: bytes | None = None) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((p, kind, n, x, y, z), types)], _NAMES)


def _deal(key: np.ndarray, value: np.ndarray, blocks: int, kind: int) -> Iterator[pa.RecordBatch]:
    """Rows of (key // blocks, value) for block key % blocks, ascending."""
    rest = key // np.uint64(blocks)
    block = (key - rest * np.uint64(blocks)).astype(np.min_scalar_type(blocks))  # a stable sort of 16 bits takes linear time
    low, middle = (int(x.max()).bit_length() for x in (value, rest))
    if low + middle + blocks.bit_length() <= 64:  # one number of all three, which sorts faster than an order of them
        low, middle = np.uint64(low), np.uint64(low + middle)
        packed = np.sort(block.astype(np.uint64) << middle | rest << low | value)
        value, rest = packed & ((np.uint64(1) << low) - np.uint64(1)), (packed & ((np.uint64(1) << middle) - np.uint64(1))) >> low
        bounds = np.searchsorted(packed, np.arange(blocks, dtype=np.uint64) << middle)
        bounds = np.append(bounds, len(packed))
    else:
        order = np.argsort(key)
        by_block = np.argsort(block[order], kind="stable")
        order = order[by_block]
        block, rest, value = block[order], rest[order], value[order]
        bounds = np.searchsorted(block, np.arange(blocks + 1, dtype=block.dtype))
    for p in np.flatnonzero(np.diff(bounds)):
        at = slice(bounds[p], bounds[p + 1])
        yield _batch(int(p), kind, int(bounds[p + 1] - bounds[p]), pack_sorted(rest[at]), pack(value[at]))


def _held(parts: Iterator[tuple[np.ndarray, ...]], run: Callable[..., Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``run`` over the parts put together, at most about ``HELD`` values at once."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= HELD:
            yield from run(*map(np.concatenate, zip(*held)))
            held, size = [], 0
    if size:
        yield from run(*map(np.concatenate, zip(*held)))


def _dealt(pairs: DataFrame, blocks: int, kind: int) -> DataFrame:
    """Two long columns, the key first, as packed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (tuple(c.to_numpy(zero_copy_only=False).view(np.uint64) for c in b.columns) for b in batches if b.num_rows)
        return _held(parts, lambda key, value: _deal(key, value, blocks, kind))

    return pairs.mapInArrow(run, PACKED)


def _by_block(df: DataFrame, blocks: int) -> DataFrame:
    return df.repartitionById(blocks, F.col("p")).sortWithinPartitions("p", "kind")


def _looked_up(table: DataFrame, pairs: DataFrame, blocks: int, deal: Callable[[np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``deal`` of (number of the key in ``table``, value) of all ``pairs`` whose key is there."""

    def found(batches):
        keys, numbers, at = np.empty(0, np.uint64), np.empty(0, np.uint64), None
        for p, kind, _, x, y, _ in _rows(batches):
            if p != at:
                keys, numbers, at = np.empty(0, np.uint64), np.empty(0, np.uint64), p
            x, y = unpack_sorted(x), unpack(y)
            if kind == 0:
                keys, numbers = np.concatenate([keys, x]), np.concatenate([numbers, y])
                order = np.argsort(keys, kind="stable")
                keys, numbers = keys[order], numbers[order]
            elif len(keys):
                place = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
                there = keys[place] == x
                yield numbers[place[there]], y[there]

    return _by_block(table.union(pairs), blocks).mapInArrow(lambda batches: _held(found(batches), deal), PACKED)


def _numbered(symbols: DataFrame) -> tuple[DataFrame, int]:
    """id, n of every different id, n counting from 0 in their order; and how many there are."""
    ids = symbols.select("id").where("id is not null").distinct().orderBy("id")
    placed = materialise(ids.select("id", F.monotonically_increasing_id().alias("m")), "nodes", release=True)
    part, row = F.shiftrightunsigned("m", 33), F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    first, total = [], 0
    with released(symbols.sparkSession):
        counts = placed.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row for each partition of the sort
    for r in counts:
        first.append((r["part"], total))
        total += r["count"]
    offsets = symbols.sparkSession.createDataFrame(first, "part long, first long")
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part").select("id", (F.col("first") + row).alias("n")), total


def _slices(table: DataFrame, count: int) -> list[DataFrame]:
    """The rows of a materialised table of ``count`` edges, by its files."""
    paths = files(table) if count >= SLICED else []
    return [table.sparkSession.read.schema(table.schema).parquet(*paths[i::SLICES]) for i in range(min(SLICES, len(paths)))] or [table]


def _links(nodes: DataFrame, total: int, parts: list[DataFrame]) -> tuple[DataFrame, int, int]:
    """The links as packed rows, in how many blocks, of how many nodes at most. Edges with an end that is no node are left out."""
    hash_blocks, seed = -(-total // BLOCK_NODES), 0
    hashed = lambda c: F.xxhash64(F.col(c), F.lit(seed))
    with released(nodes.sparkSession):
        while nodes.select(hashed("id").alias("h")).distinct().count() < total:  # two ids with one hash
            seed += 1
    table = materialise(_dealt(nodes.select(hashed("id"), "n"), hash_blocks, 0), "table", release=True)
    ends = [p.where("src is not null and tgt is not null").select(hashed("src"), hashed("tgt")) for p in parts]
    pairs = reduce(DataFrame.union, [materialise(_dealt(e, hash_blocks, 1), "pairs", release=True) for e in ends])
    with released(nodes.sparkSession):
        count = pairs.agg(F.sum("n")).first()[0] or 0
    blocks = max(hash_blocks, -(-2 * count // BLOCK_LINKS))
    places = -(-total // blocks)

    def both(t: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
        return _deal(np.concatenate([s, t]), np.concatenate([t, s]), blocks, 1)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of listeners in ascending order, x being block * places + place, and of the speakers' places in this block."""

        def parts():
            for p, kind, _, x, y, _ in _rows(batches):
                if kind == 0:
                    own = np.arange(p, total, blocks, dtype=np.uint64)
                    yield np.full(len(own), p, np.uint64), own // np.uint64(blocks), own  # everyone hears itself
                else:
                    x = unpack_sorted(x)
                    yield np.full(len(x), p, np.uint64), x, unpack(y)

        def run(block, speaker, listener):
            target = listener % np.uint64(blocks) * np.uint64(places) + listener // np.uint64(blocks)
            for p in np.unique(block):
                own = block == p
                order = np.argsort(target[own])
                yield _batch(int(p), 1, len(order), pack_sorted(target[own][order]), pack(speaker[own][order]))

        return _held(parts(), run)

    links, every = [], _empty(nodes, blocks)  # which the first slice takes along
    for some in _slices(pairs, count):
        half = materialise(_looked_up(table, some, hash_blocks, lambda s, t: _deal(t, s, hash_blocks, 1)), "half", release=True)
        discard(some)
        numbered = _looked_up(table, half, hash_blocks, both)
        linked = numbered if links else every.union(numbered)
        links.append(materialise(_by_block(linked, blocks).mapInArrow(join, PACKED), "links", release=True))
        discard(half)
    discard(table)
    return reduce(DataFrame.union, links), blocks, places


def _empty(df: DataFrame, blocks: int) -> DataFrame:
    """A row without values for each block."""
    nothing = F.lit(pack(np.empty(0, np.uint64)))
    return df.sparkSession.range(blocks).select(F.col("id").cast("int").alias("p"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"), nothing.alias("x"), nothing.alias("y"), F.lit(None).cast("binary").alias("z"))


def _first(links: DataFrame, blocks: int, total: int) -> DataFrame:
    """Every node's own number as its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, *_ in _rows(batches):
            own = np.arange(p, total, blocks, dtype=np.uint64)
            yield _batch(p, 0, len(own), pack(own))

    return _empty(links, blocks).mapInArrow(run, PACKED)


def _round(links: DataFrame, labels: DataFrame, blocks: int, places: int) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            label = None
            for _, kind, _, x, y, _ in _rows(batches):
                if kind == 0:
                    label = unpack(x)
                else:
                    yield ((unpack_sorted(x) << _SHIFT) | label[unpack(y)],)

        def run(key):
            key.sort()
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            votes = np.diff(starts, append=len(key)).astype(np.uint64)
            target, label = key[starts] >> _SHIFT, key[starts] & _LOW
            bounds = np.searchsorted(target, np.arange(blocks + 1, dtype=np.uint64) * np.uint64(places))
            for p in np.flatnonzero(np.diff(bounds)):
                at = slice(bounds[p], bounds[p + 1])
                yield _batch(int(p), 0, int(bounds[p + 1] - bounds[p]), pack_sorted(target[at] - np.uint64(p * places)), pack(label[at]), pack(votes[at]))

        return _held(parts(), run)

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(held):
            key, votes = map(np.concatenate, zip(*held))
            if max(int(key.max()) >> 48, int(votes.max()) >> 16) == 0:  # together in one number, which sorts faster than an order of them
                both = np.sort(key << _VOTES | votes)
                key, votes = both >> _VOTES, both & np.uint64(0xFFFF)
            else:
                order = np.argsort(key)
                key, votes = key[order], votes[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            return key[starts], np.add.reduceat(votes, starts)

        def best(p, held):
            key, votes = summed(held)
            place = key >> _SHIFT
            starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            most = np.repeat(np.maximum.reduceat(votes, starts), np.diff(starts, append=len(key)))
            top = np.flatnonzero(votes == most)  # of each place the first has the smallest label
            own = place[top]
            top = top[np.concatenate([[True], own[1:] != own[:-1]])]
            return _batch(p, 0, len(top), pack(key[top] & _LOW))

        held, size, at = [], 0, None
        for p, _, n, x, y, z in _rows(batches):
            if held and p != at:
                yield best(at, held)
                held, size = [], 0
            at = p
            held.append(((unpack_sorted(x) << _SHIFT) | unpack(y), unpack(z)))
            size += n
            if size >= HELD and len(held) > 1:
                held = [summed(held)]
                size = len(held[0][0]) // 2
        if held:
            yield best(at, held)

    sent = _by_block(labels.union(links), blocks).mapInArrow(send, PACKED)
    return _by_block(sent, blocks).mapInArrow(receive, PACKED)


def _differ(new: DataFrame, *earlier: DataFrame) -> list[bool]:
    """Whether a node's label is another one than in each of the earlier rounds."""
    held = reduce(DataFrame.union, [e.select("p", F.lit(i).alias("i"), F.col("x").alias("old")) for i, e in enumerate(earlier)])
    with released(new.sparkSession):
        found = {r["i"] for r in new.join(held, "p").where("x <> old").select("i").distinct().collect()}
    return [i in found for i in range(len(earlier))]


def propagate(symbols: DataFrame, edges: DataFrame | list[DataFrame], rounds: int) -> DataFrame:
    """id, label after ``rounds`` rounds.

    Once a round gives the labels of the last one or of the one before it, all later rounds repeat these, so none of them is run.
    Edges given in parts are read one part after another; what a part's exchanges leave on disk goes before the next.
    A block's links go through memory in parts, but all different labels that its nodes hear in a round are held at once. At most
    2^32 - 1 nodes. Ids are told apart by 64-bit hashes, which are checked to differ among symbols; an edge end that is no symbol
    is taken for one with probability 2^-64 a pair.
    """
    nodes, total = _numbered(symbols)
    if not total or rounds < 1:
        return nodes.select("id", F.col("id").alias("label"))
    links, blocks, places = _links(nodes, total, edges if isinstance(edges, list) else [edges])
    if blocks * places >= 1 << 32:
        raise ValueError("more nodes than labels of 32 bits can tell apart")
    past = [_first(links, blocks, total)]
    for left in reversed(range(rounds)):
        new = materialise(_round(links, past[-1], blocks, places), "labels", release=True)
        differ = _differ(new, *past)
        past.append(new)
        if not all(differ):
            break
        for old in past[:-2]:
            discard(old)
        past = past[-2:]
    labels = past[-2] if differ[-1] and left % 2 else past[-1]  # the last two take turns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, _, n, x, *_ in _rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) * blocks + p, pa.int64()), pa.array(unpack(x).astype(np.int64))], ["n", "m"])

    found = labels.mapInArrow(run, "n long, m long").join(nodes, "n")
    named = found.join(nodes.select(F.col("id").alias("label"), F.col("n").alias("m")), "m").select("id", "label")
    out = materialise(named, "labels", release=True)
    for done in (links, *past):
        discard(done)
    return out
