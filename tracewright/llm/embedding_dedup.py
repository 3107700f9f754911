"""Near-duplicate vectors of equal label: a subspace pigeonhole join with exact verification.

Unit vectors u, v with cosine at least c have squared distance at most 2 - 2c. After a fixed rotation, the
dimensions are dealt by falling variance to ``BLOCKS`` blocks; in some block the squared distance is at most that
block's share of the budget. Each block is range-joined over cells: its dimensions are cut one after the other
at their means, as many as the largest label's vectors ask for (``CELL`` a cell). A vector is at home in the cell
it lies in and visits the later ones that a ball of the block's radius about it reaches: all cuts it crosses together
must fit the block's budget. A close pair so meets at the home of the later one, and nowhere else. Within a cell
the home vectors are halved on, and whole subsets are passed over whose bounding box is out of reach. A pair
counts only in the first block whose budget it meets, hence exactly once, and is verified by the cosine in double
precision. Tasks return links counted per vector and a spanning forest, never pairs.

Equal vectors are merged first and weigh as many as they stand for. A cell with very many vectors is split
into a grid of parts of both sides. Vectors that are null, zero or hold null or non-finite components, and
those with a null label, link with nothing. Vectors of different lengths don't link. Rows that repeat a vec_id
are vectors of their own with the same id; a null id keeps its row and takes no part in links. An empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import by_group, tuned
from tracewright.operators.graph import connected_components
from tracewright.storage import small, stored

COSINE = 0.98
BLOCKS = 4
#: Vectors in a cell that more cuts are made for, and cuts at most: each one nearly doubles the cells a vector visits.
CELL = 2000
CUTS = 16
#: Vectors of one side in a part of a crowded cell.
PART = 1500
#: Home vectors that are compared at once.
LEAF = 8
#: Slack for rounding in the rotated coordinates; verification is exact.
SLACK = 1e-5


@lru_cache
def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(11).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


class Blocks:
    """The dimensions of each block, heaviest first, where each is cut, and how many are."""

    def __init__(self, centre: np.ndarray, spread: np.ndarray, cosine: float, most: int):
        size = len(centre)
        order = np.argsort(-spread, kind="stable")
        n = min(BLOCKS, size)
        self.dims, self.centre, self.cosine = [order[b::n] for b in range(n)], centre, cosine
        self.budget = [(2 - 2 * cosine) * len(d) / size for d in self.dims]
        self.cuts = int(np.clip(np.ceil(np.log2(max(most, 1) / CELL)), 2, CUTS))

    def cells(self, turned: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
        """Of rotated unit vectors: rows, block, cells and whether the row is at home there; no cell is before its home."""
        for b, dims in enumerate(self.dims):
            x = (turned - self.centre)[:, dims[: self.cuts]]
            limit = (np.sqrt(self.budget[b]) + SLACK) ** 2
            rows, home, spent = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
            for d in range(x.shape[1]):
                home |= (x[:, d] > 0).astype(np.int64) << d
            cell = home.copy()
            for d in range(x.shape[1]):
                more = spent + x[rows, d] ** 2
                cross = more <= limit
                rows, cell, spent = (np.concatenate(y) for y in ((rows, rows[cross]), (cell, cell[cross] ^ 1 << d), (spent, more[cross])))
            ahead = cell >= home[rows]
            yield rows[ahead], b, cell[ahead], cell[ahead] == home[rows[ahead]]

    def first(self, d: np.ndarray) -> np.ndarray:
        """For differences of rotated unit vectors, the first block within its share of the budget."""
        out = np.full(len(d), -1, np.int8)
        for b, dims in enumerate(self.dims):
            out[(out < 0) & ((d[:, dims] ** 2).sum(1) <= self.budget[b] + SLACK**2)] = b
        return out


def in_reach(home: np.ndarray, other: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Subsets of rows of both sides, such that each pair within a squared distance is in one of them.

    The home side is halved at the median of its widest dimension; others go on only where its box is in reach.
    """
    todo = [(np.arange(len(home)), np.arange(len(other)))]
    while todo:
        h, o = todo.pop()
        x, y = home[h], other[o]
        low, high = x.min(0), x.max(0)
        o = o[(np.maximum(np.maximum(low - y, y - high), 0) ** 2).sum(1) <= limit]
        if not len(o):
            continue
        if len(h) <= LEAF or not (high > low).any() or ((high - low) ** 2).sum() <= limit:
            yield h, o
            continue
        by = np.argsort(x[:, (high - low).argmax()], kind="stable")
        todo += [(h[by[: len(h) // 2]], o), (h[by[len(h) // 2 :]], o)]


def _joined(found: dict[str, np.ndarray], blocks: dict[int, Blocks]) -> list[tuple[int, int, int]]:
    """Links of one part of a cell: per vector the weight it links, and a spanning forest.

    ``role``: 0 a vector at home that is also a partner, 1 one at home, 2 a visitor as a partner, 3 one at home as a
    partner. Two that are both at home meet in either order, and count where the lesser id comes first.
    """
    home, other = found["role"] < 2, found["role"] != 1
    resident = found["role"][other] != 2
    if not home.any() or not other.any():
        return []
    plan, block, ids, ids_b, own_weight, weight = blocks[int(found["size"][0])], int(found["block"][0]), found["rep"][home], found["rep"][other], found["weight"][home], found["weight"][other]
    ua, ub = (unit(np.array(found["vector"][side].tolist(), float)) for side in (home, other))
    turn = rotation(ua.shape[1])
    xa, xb = (u @ turn[:, plan.dims[block]] for u in (ua, ub))
    limit = plan.budget[block] + SLACK
    # which block comes first must be the same in every cell: one product a vector, whatever its company
    exact: dict[tuple[int, int], np.ndarray] = {}

    def turned(side: int, units: np.ndarray, rows: np.ndarray) -> np.ndarray:
        for k in set(rows.tolist()):
            if (side, k) not in exact:
                exact[side, k] = units[k] @ turn
        return np.array([exact[side, k] for k in rows.tolist()]).reshape(-1, ua.shape[1])

    group = {x: x for x in {*ids.tolist(), *ids_b.tolist()}}

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    of_a, of_b = np.zeros(len(ids), np.int64), np.zeros(len(ids_b), np.int64)
    rows: list[tuple[int, int, int]] = []
    for h, o in in_reach(xa, xb, limit):
        for at in range(0, len(h), 256):
            some = h[at : at + 256]
            x, y = xa[some], xb[o]
            i, j = np.nonzero(((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T <= limit) & np.where(resident[o], ids[some][:, None] < ids_b[o], ids[some][:, None] != ids_b[o]))
            for k in range(0, len(i), 50_000):
                p, q = some[i[k : k + 50_000]], o[j[k : k + 50_000]]
                good = (ua[p] * ub[q]).sum(1) >= plan.cosine
                p, q = p[good], q[good]
                good = plan.first(turned(0, ua, p) - turned(1, ub, q)) == block
                p, q = p[good], q[good]
                of_a += np.bincount(p, weight[q], len(of_a)).astype(np.int64)
                of_b += np.bincount(q, own_weight[p], len(of_b)).astype(np.int64)
                for u, v in zip(ids[p].tolist(), ids_b[q].tolist(), strict=True):
                    a, b = root(u), root(v)
                    if a != b:
                        group[a] = b
                        rows.append((u, v, 0))
    for side, n in ((ids, of_a), (ids_b, of_b)):
        rows += [(i, i, k) for i, k in zip(side.tolist(), n.tolist(), strict=True) if k]
    return rows


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that huge and tiny numbers do no harm."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """A batch's rows of each vector length, and their unit vectors."""
    sizes = np.array([len(v) for v in batch.column("vector")], int)
    for size in np.unique(sizes).tolist():
        part = batch.take(pa.array(np.flatnonzero(sizes == size)))
        yield size, part, unit(np.array(part.column("vector").flatten().to_numpy(zero_copy_only=False), float).reshape(-1, size))


def planned(reps: DataFrame, cosine: float) -> dict[int, Blocks]:
    """For each vector length its blocks, from sums over all vectors: a row for each task, length and dimension."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, units in _by_size(batch):
                x = units @ rotation(size)
                total[size] = total.get(size, 0) + np.stack([np.ones(size) * len(x), x.sum(0), (x * x).sum(0)])
        for size, (n, one, two) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, size)), pa.array(np.arange(size)), pa.array(n), pa.array(one), pa.array(two)], names=["size", "dim", "n", "one", "two"])

    found = reps.select("vector").mapInArrow(sums, "size long, dim long, n double, one double, two double").groupBy("size", "dim").agg(*(F.sum(c).alias(c) for c in ("n", "one", "two"))).orderBy("size", "dim").toPandas()
    most = {r[0]: r[1] for r in reps.groupBy("label", F.size("vector").alias("size")).count().groupBy("size").agg(F.max("count")).collect()}
    return {int(size): Blocks((part.one / part.n).to_numpy().round(3), (part.two / part.n - (part.one / part.n) ** 2).to_numpy().round(6), cosine, most[size]) for size, part in found.groupby("size")}


def linked(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    tuned(vectors.sparkSession)
    narrow = dict(vectors.dtypes)[embedding] == "array<float>"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"), F.col(label).cast("string").alias("label"))
    sound = F.expr("vec_id is not null and label is not null and vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)")
    usable = rows.where(F.coalesce(sound, F.lit(False)))
    keyed = usable
    # numbers of their own, as ids may repeat
    merged = keyed.groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    reps = stored(merged.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    members = stored(keyed.join(reps.select("label", "vector", "rep", "weight"), ["label", "vector"]).select("vec_id", "rep", "weight"), "members")

    blocks = planned(reps, cosine)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part, units in _by_size(batch):
                for rows, b, cell, home in blocks[size].cells(units @ rotation(size)):
                    some = part.take(pa.array(rows))
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([some.column("label"), pa.array(np.full(n, size)), pa.array(np.full(n, b)), pa.array(cell), pa.array(home), some.column("rep"), some.column("weight"), some.column("vector")], names=[*key, "home", "rep", "weight", "vector"])

    key = ["label", "size", "block", "cell"]
    kind = f"array<{'float' if narrow else 'double'}>"
    placed = reps.select("label", F.col("vector").cast(kind), "rep", "weight").mapInArrow(spread, "label string, " + ", ".join(f"{k} long" for k in key[1:]) + f", home boolean, rep long, weight long, vector {kind}")
    crowded = stored(placed.groupBy(*key).agg(F.count("*").alias("n")).where(f"n > {2 * PART}").select(*key, F.expr(f"n div {PART} + 1").alias("parts")), "crowded")
    split = placed.join(small(crowded), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    # homes of part i meet the rows of part j in (i, j); in an undivided cell one row serves both sides
    own, row = F.pmod(F.xxhash64("rep"), F.col("parts")).alias("own"), "struct(cast(%s as long) as i, cast(%s as long) as j, %s as role)"
    grid = f"concat(if(home, transform(sequence(0, parts - 1), k -> {row % ('own', 'k', '1')}), array()), transform(sequence(0, parts - 1), k -> {row % ('k', 'own', 'if(home, 3, 2)')}))"
    roles = F.expr(f"if(parts = 1, array({row % ('0', '0', 'if(home, 0, 2)')}), {grid})")
    both = split.withColumn("own", own).withColumn("at", F.explode(roles)).select(*key, "at.*", "rep", "weight", "vector")

    links = stored(by_group(both, [*key, "i", "j"], lambda found: _joined(found, blocks), "a long, b long, links long"), "links")
    sums = links.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("others"))
    components = connected_components(links.where("a <> b"), "a", "b").select(F.col("node").alias("rep"), "component")
    whole = reps.select("rep", "least").join(components, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    per_rep = whole.join(named, "component").join(sums, "rep", "left")
    per_member = members.join(per_rep, "rep").select("vec_id", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    alone = rows.where(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return per_member.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
