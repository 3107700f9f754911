"""Near-duplicate documents by BagMinHash signatures, banding and exact verification of multiset overlap.

A document is the multiset of its shingles: runs of ``WORDS`` words, split at white space and in lower case
(a shorter text is one shingle; a text without words links with nothing). Similarity is the weighted Jaccard
index: the sum of the smaller counts over the sum of the larger ones.

BagMinHash: over the axis of weights, cut at 1, 2, 4 and so on into intervals, every shingle has a Poisson
process per interval, with the interval's width as its rate; each point falls on one of the signature's
components, which keeps its earliest point. An interval that a count ends within is split in halves again and
again, and points are handed down to a half by further hash bits, so that only points below the count
remain. A process stops once its time passes the latest minimum of the document. The share of
components on which two documents agree is an unbiased estimate of their similarity.

Equal word sequences are merged first. Documents that agree in a band are candidates; in a bucket only
documents whose signatures agree enough for a similarity of ``SIMILARITY`` are kept, at a margin of several
standard deviations, as a spanning tree of the best estimates. Trees are verified on whole texts. Where that
leaves a tree's documents in several components, those outside the largest meet all others in blocks of texts
and links across components are found by an inverted index, so that no pairs are listed. A bucket with very
many documents is cut into parts that share its first document.

Null texts are empty. Each row gets ``class_id``, the smallest doc_id reachable by links, and ``kept`` (it is
the class id). Rows that repeat a doc_id belong to one document; a null id has class null and is kept. An empty
table gives no rows. A very long text is one bag, never cut. Other columns are kept by ``distinct_rows`` and else
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import alone, by_group, cached, renamed, texts, tuned
from tracewright.operators.graph import connected_components
from tracewright.storage import small, stored

WORDS = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 4
SIZE = BANDS * ROWS
#: Signatures that agree in fewer components belong to texts below the threshold, but for one pair in millions.
AGREE = 0.60
#: Documents in a part of a crowded bucket.
PART = 1000
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 600_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


_WORDS = cached(__name__, Words())


def shingles(text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Distinct shingle hashes, their counts, and a digest of the word sequence."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), b""
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = max(len(w) - WORDS + 1, 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(w))):
        h = mixed(h + w[k : k + n] + _MIX[2])
    found, counts = np.unique(h, return_counts=True)
    return found, counts, hashlib.blake2b(w.tobytes(), digest_size=16).digest()


def _intervals(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The axis cut at powers of two, up to each count: row, lower end, upper end of the intervals that reach below it."""
    rows, low, high = [np.flatnonzero(counts > 0)], [np.zeros((counts > 0).sum(), np.int64)], [np.ones((counts > 0).sum(), np.int64)]
    edge = 1
    while len(at := np.flatnonzero(counts > edge)):
        rows.append(at)
        low.append(np.full(len(at), edge))
        high.append(np.full(len(at), 2 * edge))
        edge *= 2
    return np.concatenate(rows), np.concatenate(low), np.concatenate(high)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int = SIZE) -> np.ndarray:
    """BagMinHash of many bags at once: one 64-bit value a component, equal where the earliest points are the same."""
    lengths = [len(h) for h, _ in bags]
    out = np.zeros((len(bags), size), np.uint64)
    if not sum(lengths):
        return out
    doc = np.repeat(np.arange(len(bags)), lengths)
    hashes, counts = np.concatenate([h for h, _ in bags]), np.concatenate([c for _, c in bags])
    row, low, high = _intervals(counts)
    count, doc = counts[row], doc[row]
    state = mixed(hashes[row] ^ mixed(low.astype(np.uint64) + _MIX[2]))
    rate, time = (high - low).astype(float), np.zeros(len(row))
    best = np.full(len(bags) * size, np.inf)
    name = np.zeros(len(bags) * size, np.uint64)
    while len(state):
        # the next point of every process that is still going
        state = mixed(state + _MIX[2])
        time = time - np.log((state >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54) / rate
        point = mixed(state ^ _MIX[0])
        inside = np.ones(len(state), bool)
        cut = np.flatnonzero(high > count)  # a point must fall below the count: halve its interval by the hash's bits
        if len(cut):
            lo, hi, bits, limit = low[cut].copy(), high[cut].copy(), mixed(point[cut]), count[cut]
            while len(go := np.flatnonzero((hi - lo > 1) & (lo < limit) & (hi > limit))):
                middle = (lo[go] + hi[go]) // 2
                up = (bits[go] & np.uint64(1)).astype(bool)
                bits[go] >>= np.uint64(1)
                lo[go], hi[go] = np.where(up, middle, lo[go]), np.where(up, hi[go], middle)
            inside[cut] = hi <= limit
        slot = doc * size + ((point >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        better = np.flatnonzero(inside & (time < best[slot]))
        if len(better):
            order = better[np.argsort(-time[better], kind="stable")]  # the earliest is written last
            best[slot[order]], name[slot[order]] = time[order], point[order]
        going = time < best.reshape(len(bags), size).max(1)[doc]
        state, time, rate, doc, low, high, count = (x[going] for x in (state, time, rate, doc, low, high, count))
    return mixed(name.reshape(len(bags), size))


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard index of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - both
    return both / total if total else 0.0


def _signed(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, brief`` (a byte a component) and ``keys`` (one a band) of texts with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(shingles.__module__)
        for batch in batches:
            bags = [shingles(x) for x in texts(batch, "text")]
            at = [i for i, b in enumerate(bags) if len(b[0])]
            if not at:
                continue
            signed = signatures([bags[i][:2] for i in at])
            keys = np.zeros((len(at), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for r in range(ROWS):
                keys = mixed(keys + _MIX[2] + signed[:, r::ROWS])
            brief = (signed & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array([bags[i][2] for i in at], pa.binary()), pa.array([r.tobytes() for r in brief], pa.binary()), pa.array(list(keys.view(np.int64)), pa.list_(pa.int64()))],
                names=["doc_id", "digest", "brief", "keys"],
            )

    return docs.where("doc_id is not null").selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, "doc_id long, digest binary, brief binary, keys array<long>")


def _briefs(found: dict[str, np.ndarray]) -> np.ndarray:
    return np.frombuffer(b"".join(found["brief"]), np.uint8).reshape(-1, SIZE)


def _tree(found: dict[str, np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the bucket's best estimates (Prim), as ``(a, b)`` with a < b."""
    order = np.argsort(found["doc_id"])
    ids, sig = found["doc_id"][order], _briefs(found)[order]
    out: list[tuple[int, int]] = []
    best, via = np.full(len(ids), -1.0), np.zeros(len(ids), np.int64)
    rest, at = np.arange(1, len(ids)), 0
    while len(rest):
        near = (sig[rest] == sig[at]).mean(1)
        closer = near > best[rest]
        best[rest[closer]], via[rest[closer]] = near[closer], at
        k = int(np.argmax(best[rest]))
        at = int(rest[k])
        if best[at] >= AGREE:
            a, b = int(ids[via[at]]), int(ids[at])
            out.append((min(a, b), max(a, b)))
        rest = np.delete(rest, k)
    return out


def _across(found: dict[str, np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Verified links of ``outer`` documents to members of other components: one for each component reached.

    Overlaps come from an inverted index of the members' shingles, so no pair is written anywhere.
    """
    bags = [shingles(x or "")[:2] for x in found["text"]]
    ids, comp = found["doc_id"], found["component"]
    members = np.flatnonzero(~found["outer"])
    if not len(members):
        return []
    sizes = [len(bags[m][0]) for m in members]
    keys, counts = np.concatenate([bags[m][0] for m in members]), np.concatenate([bags[m][1] for m in members])
    owner = np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(keys, kind="stable")
    keys, counts, owner = keys[order], counts[order], owner[order]
    total = np.array([int(bags[m][1].sum()) for m in members])
    out = []
    for i in np.flatnonzero(found["outer"]):
        mine, times = bags[i]
        low, high = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
        n = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if n.sum() else np.zeros(0, np.int64)
        both = np.bincount(owner[at], np.minimum(counts[at], np.repeat(times, n)), len(members))
        near = members[both >= similarity * (total + times.sum() - both)]
        near = near[comp[near] != comp[i]]
        for k in np.unique(comp[near], return_index=True)[1]:
            a, b = int(ids[i]), int(ids[near[k]])
            out.append((min(a, b), max(a, b)))
    return out


def _texts_of(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")


def _verified(pairs: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose texts overlap enough. A document that many pairs share is sent once for each part of them."""
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(64)))
    left = pairs.select("a", "part").distinct().selectExpr("a as doc_id", "a", "part", "a as b", "true as lead")
    right = pairs.selectExpr("b as doc_id", "a", "part", "b", "false as lead")
    sides = small(stored(left.unionByName(right), "sides"))
    sent = _texts_of(docs).join(sides, "doc_id")

    def check(found: dict[str, np.ndarray]) -> list[tuple[int, int]]:
        lead = found["lead"]
        mine = shingles(found["text"][lead][0] or "")[:2]
        return [(int(a), int(b)) for a, b, x, l in zip(found["a"], found["b"], found["text"], lead, strict=True) if not l and overlap(mine, shingles(x or "")[:2]) >= similarity]

    return stored(by_group(sent, ["a", "part"], check, "a long, b long"), "verified").distinct()


def classes(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, class_id, kept`` of every row."""
    tuned(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = stored(_signed(docs), "signed")
    reps = signed.groupBy("digest").agg(F.min(F.struct("doc_id", "brief", "keys")).alias("r")).select("digest", "r.*")
    reps = stored(reps, "reps")
    members = signed.select("doc_id", "digest").join(reps.select("digest", F.col("doc_id").alias("rep")), "digest").select("doc_id", "rep")
    bands = reps.select("doc_id", F.posexplode("keys").alias("band", "key")).select("doc_id", F.xxhash64("band", "key").alias("bucket"))
    counts = bands.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")
    in_bucket = stored(bands.join(counts, "bucket").select("bucket", "doc_id", "n", "first"), "buckets")
    briefs = reps.select("doc_id", "brief")
    parts = F.expr(f"n div {PART} + 1").alias("parts")
    own = in_bucket.select("bucket", "doc_id", F.pmod(F.xxhash64("doc_id"), parts).alias("part")).unionByName(
        # the first document is in every part of a crowded bucket
        in_bucket.where(f"n >= {PART} and doc_id = first").select("bucket", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    )
    trees = by_group(own.distinct().join(briefs, "doc_id"), ["bucket", "part"], _tree, "a long, b long")
    tested = stored(trees.distinct(), "pairs")
    good = _verified(tested, docs, similarity)
    component = connected_components(good, "a", "b").withColumnsRenamed({"node": "doc_id"})
    # clusters of candidates that verification left in several components: whoever isn't in a cluster's most common
    # component meets all its other members, in a grid of parts of both sides
    clusters = connected_components(tested, "a", "b").withColumnsRenamed({"node": "doc_id", "component": "cluster"})
    state = stored(clusters.join(component, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "state")
    sizes = state.groupBy("cluster", "component").agg(F.count("*").alias("m")).groupBy("cluster").agg(F.max(F.struct("m", "component")).alias("main"), F.sum("m").alias("n"), F.count("*").alias("components"))
    open_ = stored(sizes.where("components > 1 and n > 2").selectExpr("cluster", "main.component as main", f"n div {PART} + 1 as columns", f"(n - main.m) div {PART} + 1 as rows"), "open")
    inside = state.join(small(open_), "cluster").withColumn("apart", F.col("component") != F.col("main"))
    row, column = (F.pmod(F.xxhash64("doc_id"), F.col(c)) for c in ("rows", "columns"))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    names = ["cluster", "row", "column", "doc_id", "component", "outer"]
    as_member = inside.withColumns({"column": column, "row": each("rows"), "outer": F.lit(False)}).select(names)
    as_outer = inside.where("apart").withColumns({"row": row, "column": each("columns"), "outer": F.lit(True)}).select(names)
    meeting = stored(as_member.unionByName(as_outer), "meeting")
    if not meeting.isEmpty():
        sent = _texts_of(docs).join(small(meeting), "doc_id")
        more = stored(by_group(sent, ["cluster", "row", "column"], lambda part: _across(part, similarity), "a long, b long"), "links")
        component = connected_components(good.unionByName(more), "a", "b").withColumnsRenamed({"node": "doc_id"})
    found = members.distinct().join(component.withColumnsRenamed({"doc_id": "rep"}), "rep", "left")
    out = docs.select("doc_id").join(found, "doc_id", "left")
    class_id = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), F.col("doc_id").eqNullSafe(class_id).alias("kept"))


def distinct_rows(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, with the columns it had; rows that repeat the kept id all stay."""
    dropped = stored(classes(docs, similarity, doc_id, text).where("not kept").select(F.col("doc_id").alias("_dropped")).distinct(), "dropped")
    inner, i = renamed(docs, doc_id)
    return inner.join(small(dropped), F.col(i).cast("long") == F.col("_dropped"), "left_anti").toDF(*docs.columns)
