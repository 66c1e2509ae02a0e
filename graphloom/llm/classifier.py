"""Quality classifier: Bradley-Terry pairwise ranking.

A document's latent quality is linear in features of its text. The model is learned from preference pairs: a document
labelled good is preferred to one labelled bad, with probability sigmoid(w . (x_good - x_bad)), so w comes from logistic
loss on feature differences, of all pairs of a good and a bad training document. The cutoff is a quantile of all training
documents' latent scores, the share labelled bad, and scores are scaled so that the cutoff is ``CUT``.

All of it comes from sums over the documents, so that the pairs need not be made: what a pair adds depends on its two latent
scores, which are put into bins, and within a bin a second-order expansion about its middle stands for the score.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard
from .common import map_batches, materialise

#: Labelled documents up to which their features come to the driver; sums over more are made by Spark.
DRIVER_ROWS = 20_000
#: Tasks of such a sum at most; each sends one array to the driver.
TASKS = 64
#: Bins of latent scores for the gradient, and coarser ones for the curvature, which only steers the steps.
BINS, COARSE = 512, 128
#: Score from which a document is predicted good.
CUT = 0.3

_NAMES = (
    "symbols", "exclamations", "bars", "upper case", "distinct words", "adjacent repeats", "word length",
    "punctuated words", "digits", "line length", "distinct lines", "symbol words", "commonest word", "other signs",
)
_SYMBOLS = b"#*$%&<>"
_OTHER = b"()[]{}=/\\@~^_+\"'`"


def features(text: bytes | None) -> list[float]:
    """Fourteen features of a UTF-8 text; all 0 without words."""
    words = (text or b"").split()
    n = len(words)
    if not n:
        return [0.0] * len(_NAMES)
    size = len(text)
    count = lambda signs: size - len(text.translate(None, signs))
    distinct = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    ends = sum(1 for w in words if w[-1] in b".,;:?!")
    signed = sum(1 for w in words if w[-1] in b"#*$%&")
    return [
        np.sqrt(min(1.0, count(_SYMBOLS) / n)), np.sqrt(min(1.0, text.count(b"!") / n)), np.sqrt(min(1.0, text.count(b"|") / n)),
        np.sqrt(upper / n), len(distinct) / n, np.sqrt(repeats / n), min(size / n / 10, 3.0), ends / n,
        np.sqrt(count(b"0123456789") / size), np.log1p(n / len(lines)) / 5, len(set(lines)) / len(lines),
        np.sqrt(signed / n), (max(distinct.values()) - 1) / n, np.sqrt(count(_OTHER) / size),
    ]


@dataclass(frozen=True)
class Ranker:
    """Latent score ``(x - centre) / scale . weights``; the published score is ``CUT`` at ``cutoff`` and grows with it."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cutoff: float
    slope: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        return _latent((x - self.centre) / self.scale, self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.latent(x) - self.cutoff) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _latent(z: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """z @ weights, to the last bit the same for a row among any others."""
    out = np.zeros(len(z))
    for k, w in enumerate(weights):
        out += z[:, k] * w
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


#: Sum (or what the second argument makes of two) of a function's arrays over all training rows, given as (features, labels).
Total = Callable[..., np.ndarray]


def _with_extremes(k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Adds arrays, but takes the smaller of their last ``k`` entries."""
    return lambda a, b: np.concatenate([a[:-k] + b[:-k], np.minimum(a[-k:], b[-k:])])


def _pair_sums(z: np.ndarray, label: np.ndarray, s: np.ndarray, low: float, width: float) -> np.ndarray:
    """For each label and bin of the latent scores s: sums of 1 and z by powers of the distance d from its middle (1, d, d^2/2), for
    each label and coarse bin the sums of z z'; then the least s and -s."""
    at = np.clip((s - low) // width, 0, BINS - 1).astype(int)
    d = s - (low + (at + 0.5) * width)
    fine, coarse = label * BINS + at, label * COARSE + at // (BINS // COARSE)
    columns = [np.ones(len(z)), *z.T]
    out = [np.bincount(fine, c * f, 2 * BINS) for f in (np.ones(len(z)), d, d * d / 2) for c in columns]
    out += [np.bincount(coarse, z[:, i] * z[:, j], 2 * COARSE) for i in range(z.shape[1]) for j in range(i + 1)]
    return np.concatenate([*out, [s.min(), -s.max()]])


def _slopes(sums: np.ndarray, width: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the mean loss of all pairs, from ``_pair_sums`` of k features."""
    moments = sums[: 3 * (k + 1) * 2 * BINS].reshape(3, k + 1, 2, BINS)
    (b, g), (n, m) = ([moments[:, 1:, y] for y in (0, 1)], [moments[:, 0, y] for y in (0, 1)])  # bad, good; their counts
    pairs = n[0].sum() * m[0].sum()
    p = _sigmoid((np.arange(BINS)[None, :] - np.arange(BINS)[:, None]) * width)  # good in rows, bad in columns
    p1 = p * (1 - p)
    p2 = p1 * (1 - 2 * p)
    good = g[0] @ (p @ n[0] + p1 @ n[1] + p2 @ n[2]) - g[1] @ (p1 @ n[0] + p2 @ n[1]) + g[2] @ (p2 @ n[0])
    bad = b[0] @ (p.T @ m[0] - p1.T @ m[1] + p2.T @ m[2]) + b[1] @ (p1.T @ m[0] - p2.T @ m[1]) + b[2] @ (p2.T @ m[0])
    squares = np.zeros((2, COARSE, k, k))
    i, j = np.tril_indices(k)
    squares[:, :, i, j] = np.moveaxis(sums[moments.size : -2].reshape(len(i), 2, COARSE), 0, 2)
    squares[:, :, j, i] = squares[:, :, i, j]
    step = width * (BINS // COARSE)
    c = _sigmoid((np.arange(COARSE)[None, :] - np.arange(COARSE)[:, None]) * step)
    c = c * (1 - c)
    gathered = lambda x: x.reshape(*x.shape[:-1], COARSE, -1).sum(axis=-1)
    x, y = gathered(g[0]), gathered(b[0])
    crossed = x @ c @ y.T
    curvature = np.tensordot(c @ gathered(n[0]), squares[1], 1) + np.tensordot(c.T @ gathered(m[0]), squares[0], 1) - crossed - crossed.T
    return (bad - good) / pairs, curvature / pairs


def _pair_weights(total: Total, standard: Callable[[np.ndarray], np.ndarray], least: np.ndarray, most: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Minimise the mean over all pairs of log(1 + exp(-w . (good - bad))) + ridge |w|^2 / 2; least and most bound the standard features."""
    w, low, high = np.zeros(len(least)), 0.0, 0.0
    for _ in range(rounds):
        edge = 1e-9 + 1e-9 * max(abs(low), abs(high))
        start, width = low - edge, (high - low + 2 * edge) / BINS

        def run(x, y, w=w, start=start, width=width):
            z = standard(x)
            return _pair_sums(z, y, _latent(z, w), start, width)

        sums = total(run, _with_extremes(2))
        gradient, curvature = _slopes(sums, width, len(w))
        step = np.linalg.solve(curvature + (ridge + 1e-9) * np.eye(len(w)), gradient + ridge * w)
        step /= max(1.0, np.abs(step).max() / 5)
        w = w - step
        low = sums[-2] + np.minimum(-step * least, -step * most).sum()
        high = -sums[-1] + np.maximum(-step * least, -step * most).sum()
        if np.abs(step).max() < 1e-8:
            break
    return w


def _ordered(s: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the numbers."""
    bits = (s + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _between(total: Total, latent: Callable[[np.ndarray], np.ndarray], at: int) -> float:
    """Midway between the scores in places at - 1 and at, in ascending order from 0: sixteen bits of the former in each pass."""
    prefix, below = 0, 0
    for shift in (48, 32, 16, 0):

        def run(x, y, shift=shift, prefix=prefix):
            key = _ordered(latent(x)) >> np.uint64(shift)
            key = key[(key >> np.uint64(16)) == np.uint64(prefix)]
            return np.bincount((key & np.uint64(0xFFFF)).astype(int), minlength=1 << 16).astype(float)

        counts = np.cumsum(total(run))
        digit = int(np.searchsorted(counts, at - 1 - below, side="right"))
        below += int(counts[digit - 1]) if digit else 0
        prefix = prefix << 16 | digit
    key = np.array([prefix], np.uint64)
    value = np.where(key >> np.uint64(63), key ^ np.uint64(1 << 63), ~key).view(float)[0]

    def after(x, y):
        s = latent(x)
        return np.array([(s <= value).sum(), s[s > value].min(initial=np.inf)])

    upto, following = total(after, _with_extremes(1))
    return float(value if upto > at else (value + following) / 2)


def _slope(total: Total, distance: Callable[[np.ndarray], np.ndarray], n: float, ridge: float = 1e-4, rounds: int = 60) -> float:
    """Logistic regression of the label on the distance from the cutoff, without intercept."""
    w = 0.0
    for _ in range(rounds):

        def run(x, y, w=w):
            t = distance(x)
            p = _sigmoid(w * t)
            return np.array([((p - y) * t).sum(), (p * (1 - p) * t * t).sum()])

        first, second = total(run) / n
        step = (first + ridge * w) / (second + ridge + 1e-9)
        w -= step / max(1.0, abs(step) / 5)
        if abs(step) < 1e-8:
            break
    return max(1e-3, round(w, 7))


def fit_sums(total: Total) -> Ranker:
    """Fit on all rows that ``total`` goes over. Without both labels every document scores alike, above the cutoff.

    Weights and slope are rounded to seven places, so that they do not depend on the order of sums.
    """
    width = len(_NAMES)
    sums = total(lambda x, y: np.concatenate([[(y == 1).sum(), (y == 0).sum()], x.sum(axis=0), x.min(axis=0), -x.max(axis=0)]), _with_extremes(2 * width))
    n_good, n_bad = sums[0], sums[1]
    if not n_good or not n_bad:
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), -1.0 if not n_bad else 1.0, 1.0)
    n = n_good + n_bad
    centre = np.round(sums[2 : 2 + width] / n, 12)
    scale = np.round(np.sqrt(total(lambda x, y: ((x - centre) ** 2).sum(axis=0)) / n), 12)
    scale[scale < 1e-9] = 1.0
    standard = lambda x: (x - centre) / scale
    least, most = (sums[2 + width : 2 + 2 * width] - centre) / scale, (-sums[2 + 2 * width :] - centre) / scale
    weights = np.round(_pair_weights(total, standard, least, most), 7)
    latent = lambda x: _latent(standard(x), weights)
    # The quantile that leaves the share labelled bad below it, taken midway between neighbouring scores.
    cutoff = _between(total, latent, int(n_bad))
    return Ranker(centre, scale, weights, cutoff, _slope(total, lambda x: latent(x) - cutoff, n))


def fit(x: np.ndarray, label: np.ndarray) -> Ranker:
    """Fit on feature rows with labels 0/1."""
    if not len(x):
        return fit_sums(lambda *_: np.zeros(2 + 3 * len(_NAMES)))
    return fit_sums(lambda run, combine=np.add: run(x, label))


def held_out(doc_id) -> F.Column:
    """Whether a document is kept for testing: crc32 of its id as text is divisible by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _features_of(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, x array<double>")


def _totals(rows: DataFrame) -> Total:
    """Sums over the columns x and quality, by tasks of Spark; their arrays are added in the order of the tasks."""

    def total(run: Callable[[np.ndarray, np.ndarray], np.ndarray], combine: Callable = np.add) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(_NAMES))
                    own = run(x, batch.column(1).to_numpy(zero_copy_only=False).astype(int))
                    out = own if out is None else combine(out, own)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["part", "sums"])

        spark = rows.sparkSession
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
        found = rows.select("x", "quality").coalesce(TASKS).mapInArrow(part, "part int, sums binary").collect()  # one row for each task
        return functools.reduce(combine, [np.frombuffer(r.sums) for r in sorted(found, key=lambda r: r.part)])

    return total


def train(docs: DataFrame, labels: DataFrame, rows: int = DRIVER_ROWS) -> Ranker:
    """Fit on all labelled documents outside the held-out fold; the features of up to ``rows`` of them come to the driver.

    Only doc_id, text and quality are read. Conflicting labels of a document count as bad; null labels, ids and texts are left out.
    """
    usable = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    known = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    few = {r.doc_id: r.quality for r in known.limit(rows + 1).collect()}
    if not few:
        return fit(np.empty((0, len(_NAMES))), np.empty(0, int))
    if len(few) > rows:
        # Features are joined, not texts, which would be shuffled whole.
        found = materialise(_features_of(texts).join(known, "doc_id").select("doc_id", "x", "quality").sortWithinPartitions("doc_id", "x"), "features")
        ranker = fit(np.empty((0, len(_NAMES))), np.empty(0, int)) if found.isEmpty() else fit_sums(_totals(found))
        discard(found)
        return ranker
    ids = docs.sparkSession.createDataFrame([(i,) for i in few], "doc_id long")
    found = _features_of(texts.join(F.broadcast(ids), "doc_id", "left_semi")).collect()  # bounded by rows
    found.sort(key=lambda r: (r.doc_id, r.x))
    return fit(np.array([r.x for r in found]).reshape(-1, len(_NAMES)), np.array([few[r.doc_id] for r in found], int))


def with_score(docs: DataFrame, ranker: Ranker, keep: bool | None = None) -> DataFrame:
    """``docs`` with a last column ``quality_score``, in place of one that is there; with ``keep``, only rows at or above the cutoff, unchanged."""
    if not keep:
        docs = docs.drop("quality_score")
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(at).cast(pa.binary())]
            score = ranker.score(np.array([features(t) for t in texts]).reshape(-1, len(_NAMES)))
            if keep:
                yield batch.filter(pa.array(score >= CUT, pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*names, "quality_score"])

    schema = docs.schema if keep else docs.select("*", F.lit(0.0).alias("quality_score")).schema
    return map_batches(docs, run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Null and empty texts are scored as texts without words, and a text of any length is read whole. Repeated rows keep a row each; a
    null doc_id is not held out. An empty table gives an empty one, and other columns are not looked at, whatever their names.
    """
    scored = with_score(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), train(docs, labels))
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= CUT).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted good."""
    return with_score(docs, train(docs, labels), keep=True)
