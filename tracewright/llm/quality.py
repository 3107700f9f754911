"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Every document's statistics are computed from its whole text in one pass and stored as narrow rows. The
Gaussian kernel over standardised statistics is approximated by ``FEATURES`` cosines; each partition adds up
its normal equations, partial sums are merged in groups, and the driver solves one fixed-size system. Scores
are calibrated by isotonic regression over counts in fixed bins. All rows with a usable label are used.

Null texts are empty; an empty text has all-zero statistics and a score like any other. Null labels are left
out; without labels of both kinds every score is 0.5. Repeated rows count as often as they occur, null ids are
scored as any; an empty table gives no rows. A very long text is read whole. Other columns are kept by
``accepted`` and else ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.calibration import calibrated, isotonic
from tracewright.llm.common import alone, remainder, texts, tuned
from tracewright.storage import BROADCAST_ROWS, small, stored

FEATURES = 256
RIDGE = 1e-3
BINS = 2000
_GROUPS = 16
_BYTES = np.arange(256)
_CLASS = np.zeros((256, 7))
_CLASS[(_BYTES >= 65) & (_BYTES <= 90), 0] = 1
_CLASS[(_BYTES >= 97) & (_BYTES <= 122), 1] = 1
_CLASS[(_BYTES >= 48) & (_BYTES <= 57), 2] = 1
_CLASS[[32, 9, 10, 13], 3] = 1
_CLASS[_BYTES >= 128, 4] = 1
_CLASS[[ord(c) for c in ".,;:'-\"()"], 5] = 1
_CLASS[:, 6] = 1 - _CLASS[:, :6].sum(1)


def statistics(text: str) -> list[float]:
    """Numbers that describe a whole text without naming any word."""
    if not text:
        return [0.0] * 20
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    classes = (np.bincount(raw, minlength=256) @ _CLASS) / len(raw)
    words = text.split()
    n = max(len(words), 1)
    counts = Counter(words)
    top = counts.most_common(5)
    lines = text.split("\n")
    pairs = len(set(zip(words, words[1:])))  # noqa: B905
    ends = sum(w[-1] in ".!?" for w in words) / n
    odd = sum(not w[-1].isalnum() and w[-1] not in ".,;:!?\"')" for w in words) / n
    return [
        *classes.tolist(), np.log1p(len(raw)), np.log1p(n), len(raw) / n / 10, len(counts) / n, top[0][1] / n if top else 0.0, sum(c for _, c in top) / n, pairs / n, ends, odd,
        len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(len(w) <= 3 for w in counts) / max(len(counts), 1), sum(w.isupper() for w in counts) / max(len(counts), 1),
    ]


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, stats)`` of every document, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(statistics.__module__)
        for batch in batches:
            stats = [statistics(x) for x in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64()))], names=["doc_id", "stats"])

    tuned(docs.sparkSession)
    return stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, [f for f in docs.schema if f.name == doc_id][0].dataType.simpleString().join(["doc_id ", ", stats array<double>"])), "stats")


class Model:
    """Standardising, the random cosines, ridge weights and calibration points."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.omega = rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), FEATURES)) * np.sqrt(2)
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights: np.ndarray | None = None
        self.points: tuple | None = None

    def map(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.omega + self.phase) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.map(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.full(len(stats), 0.5) if self.weights is None else calibrated(self.points, self.raw(stats))


def _stats(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def partition_sums(rows: DataFrame, partial: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of ``partial(batch)`` over a table: one array a partition, then one for each of a few groups."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += partial(batch)
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId() % _GROUPS], pa.int64()), "total": [total.tobytes()]})

    def second(found: pa.Table) -> pa.Table:
        total = np.zeros(shape)
        for raw in found.column("total").to_pylist():
            total += np.frombuffer(raw).reshape(shape)
        return pa.table({"total": [total.tobytes()]})

    merged = rows.mapInArrow(first, "part long, total binary").groupBy("part").applyInArrow(second, "total binary")
    return sum((np.frombuffer(r[0]).reshape(shape) for r in merged.collect()), np.zeros(shape))


def marks(labels: DataFrame, label: str = "quality", modulus: int = 4, held_out: int = 2) -> DataFrame:
    """``doc_id, y`` of the labels that may be learned from."""
    return labels.where(remainder("doc_id", modulus) != held_out).select("doc_id", F.col(label).cast("double").alias("y")).where("y is not null and doc_id is not null")


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held_out: int = 2, seed: int = 5) -> Model:
    """Learn from the labelled rows whose crc32(doc_id) mod ``modulus`` isn't ``held_out``."""
    marked = marks(labels, label, modulus, held_out)
    train = stored(stats.join(small(marked), "doc_id").select("stats", "y"), "train")
    width = len(statistics(""))

    def moments(batch):
        x = _stats(batch)
        return np.vstack([x.sum(0), (x * x).sum(0), np.full(width, len(x))])

    sums = partition_sums(train, moments, (3, width))
    n = max(sums[2, 0], 1)
    mean = sums[0] / n
    model = Model(mean, np.sqrt(np.maximum(sums[1] / n - mean**2, 1e-8)), seed)

    def normal(batch):
        x, y = model.map(_stats(batch)), batch.column("y").to_numpy(zero_copy_only=False)
        return np.vstack([x.T @ x, x.T @ y])

    side = FEATURES + 1
    equations = partition_sums(train, normal, (side + 1, side))
    ones = equations[-1, -1]
    if not 0 < ones < sums[2, 0]:
        return model
    model.weights = np.linalg.solve(equations[:-1] + RIDGE * n * np.eye(side) / FEATURES, equations[-1])
    edges = np.linspace(-0.5, 1.5, BINS + 1)

    def binned(batch):
        p, y = model.raw(_stats(batch)), batch.column("y").to_numpy(zero_copy_only=False)
        k = np.clip(np.searchsorted(edges, p) - 1, 0, BINS - 1)
        return np.vstack([np.bincount(k, minlength=BINS), np.bincount(k, y, BINS)])

    counts = partition_sums(train, binned, (2, BINS))
    used = counts[0] > 0
    model.points = isotonic(((edges[1:] + edges[:-1]) / 2)[used], (counts[1] / np.maximum(counts[0], 1))[used], counts[0][used])
    return model


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    stats = features(docs)
    model = fit(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_stats(batch)))], names=["doc_id", "score"])

    out = stats.mapInArrow(run, [f for f in stats.schema if f.name == "doc_id"][0].dataType.simpleString().join(["doc_id ", ", score double"]))
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", F.expr(f"int(score >= {threshold})").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows whose score reaches the threshold, with the columns they had.

    Statistics to learn from are taken of labelled rows only, unless there are too many labels to broadcast.
    """
    named = marks(labels).select("doc_id").distinct()
    few = named.count() <= BROADCAST_ROWS
    model = fit(features(docs.join(F.broadcast(named), "doc_id", "left_semi") if few else docs), labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(statistics.__module__)
        for batch in batches:
            if batch.num_rows:
                scores = model.score(np.array([statistics(x or "") for x in batch.column(at).to_pylist()]))
                yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)
