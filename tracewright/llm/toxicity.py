"""Toxicity by the nearest labelled examples under class-weighted TF-IDF cosine over all words, with a block-max inverted index.

A bounded sample of labelled rows (``EXAMPLES``, the least hashes of their ids) gives the examples. Terms are
whole words in lower case, all of them. A term's weight is its TF-IDF times sqrt(1 + chi-square of its presence in
toxic and other examples), 1 for terms in no example: telling terms weigh more, none is left out. (Plain TF-IDF
neighbours tell the classes apart far less where few examples share little but those terms.) Document frequencies
are counted over all documents, and a text's norm is over all of its terms, those in no example too. An example's
terms are counted each by itself; the others, which aren't bounded, by a hash into ``PLACES`` counters, so that
rare ones that share a counter weigh a little less in the norm; products aren't touched by that.

The index has posting lists for the examples' terms, cut into blocks of examples with the largest weight in each.
Terms that very many examples share are dense rows, multiplied for many texts at once; their sum in a block plus
the block's maxima of the other terms bounds its best product, and blocks whose bound falls below the k-th best
found aren't scored. The result is the exact list of nearest examples. Votes are weighted by distance and
calibrated by isotonic regression on leave-one-out votes of the examples.

Null texts are empty. A text that shares no term with an example, empty ones too, gets the share of toxic rows
among such examples. Ties, up to 1e-6, go to the example that comes first. If there are no examples, every score
is 0. Repeated rows are scored alike, null ids as any; an empty table gives no rows. A very long text is read word
by word, in one piece. Other columns of either table are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.calibration import calibrated, isotonic
from tracewright.llm.common import remainder, texts, tuned
from tracewright.storage import stored

#: Labelled rows at most: the bound of the model that is sent to executors.
EXAMPLES = 4096
NEIGHBOURS = 25
BLOCK = 64
#: Terms in more than one of so many examples are dense rows.
DENSE = 32
#: Counters of the terms that no example has; eight bytes each on the driver.
PLACES = 1 << 21
#: Texts scored at once, and words that a task knows.
TEXTS = 128
WORDS = 400_000
_EDGE = "\"'.,;:!?()[]{}*#$%&-_|<>"
#: This worker's words, index and ids of the last query; a worker runs many tasks of it.
_HERE: dict[str, tuple] = {}


def forms(word: str) -> tuple[str, ...]:
    """A word's terms: itself without case and the signs about it, or nothing."""
    w = word.lower().strip(_EDGE)
    return (w,) if w else ()


def key_of(term: str) -> int:
    """A term's name in the index: 64 bits of hash."""
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass")) - (1 << 63)


class Terms(dict):
    """Word to the number of its term, as learned: the examples' terms from 0, then ``places`` shared by hash, then none.

    Words that don't fit any more are looked up each time.
    """

    def __init__(self, keys: np.ndarray, places: int = PLACES):
        self.own = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.places, self.none = places, len(keys) + places

    def __missing__(self, word: str) -> int:
        found = self.none
        for t in forms(word):
            k = key_of(t)
            found = self.own.get(k, -1)
            if found < 0:
                found = len(self.own) + k % self.places
        if len(self) < WORDS:
            self[word] = found
        return found

    def count(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of a text's terms, rising, and their counts."""
        words = text.split()
        number, n = np.unique(np.fromiter(map(self.__getitem__, words), np.int64, len(words)), return_counts=True)
        return (number[:-1], n[:-1]) if len(number) and number[-1] == self.none else (number, n)


def class_weight(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, terms: int) -> np.ndarray:
    """Of each term sqrt(1 + chi-square of its presence against the label), so at least 1: no term is left out."""
    seen, bad = np.zeros(terms), np.zeros(terms)
    for v, y in zip(vectors, labels.tolist(), strict=True):
        seen[v[0]] += 1
        bad[v[0]] += y > 0
    n, n1 = len(labels), float((labels > 0).sum())
    chance = seen * (n - seen) * n1 * (n - n1)
    return np.sqrt(1 + n * (bad * n - seen * n1) ** 2 / np.maximum(chance, 1))


def _ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of ``size`` from each ``lo`` on."""
    return np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)


def _pair(vector: dict[int, int] | tuple[np.ndarray, np.ndarray]) -> tuple:
    """Terms and counts."""
    return (list(vector), list(vector.values())) if isinstance(vector, dict) else vector


class _Rows:
    """``rows[terms]``: their weights over all positions."""

    def __init__(self, index: BlockMaxIndex):
        self.index = index

    def __getitem__(self, terms: np.ndarray) -> np.ndarray:
        x, out = self.index, np.zeros((len(terms), len(self.index.order)))
        for i, t in enumerate(terms):
            at = slice(x.start[t], x.start[t + 1])
            out[i, x.position[at]] = x.weight[at]
        return out


class BlockMaxIndex:
    """Examples as unit TF-IDF vectors in posting lists. A list is in order of position; its run in a block has its largest weight."""

    def __init__(self, idf: np.ndarray, vectors: list, labels: np.ndarray, terms: int | None = None):
        """``idf``: weights of all numbers; only the first ``terms`` have lists, as the examples have no others."""
        self.idf, self.terms = idf, len(idf) if terms is None else terms
        places = -(-max(len(vectors), 1) // BLOCK) * BLOCK
        # examples alike in their heaviest term share blocks, so that bounds are tight
        heavy = np.full(places, len(idf) + 1)
        weighed = [self.weigh(*_pair(v)) for v in vectors]
        for i, (t, w) in enumerate(weighed):
            heavy[i] = t[w.argmax()] if len(t) else len(idf)
        self.order = np.argsort(heavy, kind="stable")
        place = np.argsort(self.order)
        self.labels = np.concatenate([labels, np.zeros(places - len(vectors))])[self.order]
        self.real = self.order < len(vectors)
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in weighed)])
        position = np.repeat(place[: len(vectors)], [len(t) for t, _ in weighed])
        by = np.lexsort((position, term))
        term, self.position = term[by], position[by].astype(np.int32)
        self.weight = np.concatenate([np.zeros(0), *(w for _, w in weighed)])[by].astype(np.float32)
        self.start = np.searchsorted(term, np.arange(self.terms + 1))
        self._build()

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("idf", "terms", "order", "labels", "real", "position", "weight", "start")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._build()

    def _build(self) -> None:
        """What follows from the posting lists: dense rows and runs, which aren't sent."""
        size = np.diff(self.start)
        term = np.repeat(np.arange(self.terms), size)
        often = size * DENSE > self.real.sum()
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.dense = np.zeros((int(often.sum()), len(self.order)), np.float32)
        in_row = self.row[term]
        self.dense[in_row[in_row >= 0], self.position[in_row >= 0]] = self.weight[in_row >= 0]
        # runs: a term's postings in one block
        block = self.position // BLOCK
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        self.run_at = np.flatnonzero(new)
        self.run_size = np.diff(np.append(self.run_at, len(term)))
        self.run_block = block[self.run_at]
        self.run_max = np.maximum.reduceat(self.weight, self.run_at) if len(term) else np.zeros(0, np.float32)
        self.runs = np.searchsorted(self.run_at, self.start)
        self.weights = _Rows(self)

    def weigh(self, terms: list[int] | np.ndarray, counts: list[int] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and their weights in a vector of length one."""
        t = np.array(terms, np.int64)
        w = (1 + np.log(np.array(counts, float))) * self.idf[t]
        return t, w / (np.sqrt(w @ w) or 1.0)

    def nearest(self, terms: list[int], counts: list[int], k: int = NEIGHBOURS, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples with any term in common."""
        (found,) = self.search([self.weigh(terms, counts)], k, [skip])
        return found

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, skips: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query of terms and weights: positions and products of the k best examples."""
        queries = [(t[t < self.terms], q[t < self.terms]) for t, q in queries]
        asked = np.zeros((len(queries), len(self.dense)), np.float32)
        for i, (t, q) in enumerate(queries):
            row = self.row[t]
            asked[i, row[row >= 0]] = q[row >= 0]
        known = asked @ self.dense
        return [self._best(t, q, known[i], k, skips[i] if skips else -1) for i, (t, q) in enumerate(queries)]

    def _best(self, t: np.ndarray, q: np.ndarray, known: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        rare = self.row[t] < 0
        t, q = t[rare], q[rare]
        size = self.runs[t + 1] - self.runs[t]
        run, q = _ranges(self.runs[t], size), np.repeat(q, size)
        block = self.run_block[run]
        blocks = len(known) // BLOCK
        bound = np.bincount(block, q * self.run_max[run], blocks) + known.reshape(blocks, BLOCK).max(1) + 1e-5
        score, done = known.astype(float), np.zeros(blocks, bool)
        if 0 <= skip:
            score[skip] = 0

        def add(wanted: np.ndarray) -> None:
            some = wanted[block]
            size = self.run_size[run[some]]
            at = _ranges(self.run_at[run[some]], size)
            found = np.bincount(self.position[at], np.repeat(q[some], size) * self.weight[at], len(known))
            score[:] += found
            done[wanted] = True
            if 0 <= skip:
                score[skip] = 0

        first = np.zeros(blocks, bool)
        first[np.argpartition(-bound, 7)[:8] if blocks > 8 else slice(None)] = True
        add(first)
        if not done.all():
            seen = score[np.repeat(done, BLOCK)]
            least = np.partition(seen, len(seen) - k)[len(seen) - k] if len(seen) >= k else 0.0
            if (rest := ~done & (bound >= least)).any():
                add(rest)
        score[np.repeat(~done, BLOCK)] = 0
        score = np.round(score, 6)
        score[score <= 0] = 0
        cut = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else 0.0
        at = np.flatnonzero((score >= cut) & (score > 0))
        at = at[np.lexsort((at, -score[at]))][:k]
        return at, score[at]

    def vote(self, at: np.ndarray, cos: np.ndarray) -> float:
        w = 1 / (1.05 - np.minimum(cos, 1))
        return float(w @ self.labels[at] / w.sum())


class Model:
    def __init__(self, index: BlockMaxIndex, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray):
        self.index = index
        place = np.argsort(index.order)
        bare, votes, truth = np.ones(len(vectors), bool), [], []
        for lo in range(0, len(vectors), TEXTS):
            some = range(lo, min(lo + TEXTS, len(vectors)))
            found = index.search([index.weigh(*vectors[i]) for i in some], NEIGHBOURS, [int(place[i]) for i in some])
            for i, (at, cos) in zip(some, found, strict=True):
                if len(at):
                    bare[i] = False
                    votes.append(index.vote(at, cos))
                    truth.append(labels[i])
        self.base = float((labels[bare].sum() + 0.5 * labels.mean()) / (bare.sum() + 0.5)) if len(labels) else 0.0
        self.points = isotonic(np.array(votes), np.array(truth)) if votes else (np.array([0.0]), np.array([0.0]))

    def scores(self, found: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
        """Calibrated scores from the nearest examples of each text."""
        votes = np.array([self.index.vote(at, cos) if len(at) else 0.0 for at, cos in found])
        return np.where([len(at) > 0 for at, _ in found], calibrated(self.points, votes), self.base).tolist()


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys and counts of the terms of ``(doc_id, y, text)``."""
    for batch in batches:
        keys, counts = [], []
        for x in texts(batch, "text"):
            n: dict[int, int] = {}
            for w in x.split():
                for t in forms(w):
                    k = key_of(t)
                    n[k] = n.get(k, 0) + 1
            keys.append(sorted(n))
            counts.append([n[k] for k in keys[-1]])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "y", "keys", "counts"])


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held_out: int = 0, examples: int = EXAMPLES) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` of every document; evidence: example ids and cosines."""
    spark = tuned(docs.sparkSession)
    thin = docs.selectExpr("doc_id", "cast(text as string) as text")
    kind = thin.schema["doc_id"].dataType.simpleString()
    marked = labels.where(remainder("doc_id", modulus) != held_out).select("doc_id", F.col(label).cast("double").alias("y")).where("y is not null and doc_id is not null")
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(examples)
    # repeated ids join more often than once: the first rows in order are taken before anything is collected
    found = thin.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").mapInArrow(_vectors, f"doc_id {kind}, y double, keys array<long>, counts array<int>")
    sample = found.orderBy("doc_id", "y", "keys", "counts").limit(examples).toArrow()
    truth = np.array(sample["y"].to_pylist(), float)
    rows = [(np.array(k, np.int64), np.array(c)) for k, c in zip(sample["keys"].to_pylist(), sample["counts"].to_pylist(), strict=True)]
    keys = np.unique(np.concatenate([np.zeros(0, np.int64), *(k for k, _ in rows)]))
    vectors = [(np.searchsorted(keys, k), c) for k, c in rows]
    numbers = spark.sparkContext.broadcast(keys)
    name = uuid.uuid4().hex

    def known() -> Terms:
        if name not in _HERE:
            _HERE.clear()
            _HERE[name] = (Terms(numbers.value),)
        return _HERE[name][0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with each numbered term, and all documents as number -1."""
        terms, total = known(), 0
        seen = np.zeros(terms.none + 1, np.int32)
        for batch in batches:
            total += batch.num_rows
            for x in texts(batch, "text"):
                words = {*x.split()}
                seen[np.unique(np.fromiter(map(terms.__getitem__, words), np.int64, len(words)))] += 1
        at = np.append(np.flatnonzero(seen[:-1]), -1)
        n = np.append(seen[at[:-1]], total).astype(np.int64)
        for lo in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[lo : lo + (1 << 16)]), pa.array(n[lo : lo + (1 << 16)])], names=["number", "n"])

    # at most a row for each term of the examples and each counter
    counted = thin.select("text").mapInArrow(count, "number long, n long").groupBy("number").agg(F.sum("n").cast("int").alias("n")).select(F.col("number").cast("int"), "n").toArrow()
    number, n = (counted[c].to_numpy() for c in ("number", "n"))
    frequency = np.zeros(len(keys) + PLACES + 1, np.int64)
    frequency[number] = n
    total = frequency[-1]
    idf = (np.log((total + 1) / (frequency[:-1] + 1)) + 1).astype(np.float32)
    idf[: len(keys)] *= class_weight(vectors, truth, len(keys))
    model = Model(BlockMaxIndex(idf, vectors, truth, len(keys)), vectors, truth)
    ids = np.array([str(x) for x in sample["doc_id"].to_pylist()])
    shared = spark.sparkContext.broadcast((model, ids))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = known()
        if len(_HERE[name]) == 1:
            _HERE[name] = (terms, *shared.value)
        _, model, ids = _HERE[name]
        index = model.index
        for whole in batches:
            for lo in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(lo, TEXTS)
                near = index.search([index.weigh(*terms.count(x)) for x in texts(batch, "text")])
                evidence = [", ".join(f"{ids[index.order[a]]}:{c:.4f}" for a, c in zip(at[:3].tolist(), cos[:3].tolist(), strict=True)) for at, cos in near]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(near), pa.float64()), pa.array(evidence, pa.string())], names=["doc_id", "score", "evidence"])

    out = thin.mapInArrow(score, f"doc_id {kind}, score double, evidence string")
    return out.select("doc_id", (remainder("doc_id", modulus) == held_out).alias("held_out"), "score", F.expr("int(score >= 0.5)").alias("predicted"), "evidence")
