"""Mixing sources to target weights by subset-sum budget fitting over exact document lengths.

Sources in code point order, null last, weigh 3, 1, 2, repeating, and share ``share`` times all words. A
target stops at twice its source's words; the excess is shared among the others by weight until none is
above. A source is taken whole as often as its target allows. The remaining budget is fitted over its count
of documents of each exact length: first the same fraction of every length, then long ones greedily until
the rest is below ``DP_WORDS``, then a bounded-knapsack dynamic program that reaches the largest possible
sum for the rest. Where words are still missing, the program runs over the whole budget, in units of the lengths'
common step, if it fits ``DP_BITS``; a source of more and longer lengths keeps the first fit. Documents of a length are
taken in the order of a seeded hash of id and text.

Only counts by source and length are gathered, never documents; a length that very many documents share is
ranked within one of its hash ranges of about ``RANGE_ROWS`` documents. The driver sees one total a source.
Null texts are empty: size 0, nothing taken. Null ids are hashed like any id. Repeated rows are documents of
their own: where a quota ends among equal ones, as many of them are taken as it leaves, so that a source's
sum is the fitted one however many rows are equal; these are counted within the parts they are read in. A very
long text is one document. Empty tables give no rows. Other columns are kept or ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import renamed, tuned
from tracewright.storage import small, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
DP_WORDS = 1 << 16
#: Bits of a program over a source's whole budget, 128 MB.
DP_BITS = 1 << 30
RANGE_ROWS = 2048


def targets(totals: dict[str | None, int], share: float = SHARE, weights: tuple = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Words to take of each source."""
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, rest = share * sum(totals.values()), order
    while rest:
        unit = left / sum(weight[s] for s in rest)
        above = [s for s in rest if unit * weight[s] > most * totals[s]]
        if not above:
            return out | {s: unit * weight[s] for s in rest}
        out |= {s: float(most * totals[s]) for s in above}
        left -= sum(most * totals[s] for s in above)
        rest = [s for s in rest if s not in out]
    return out


def subset_sum(budget: int, lengths: list[int], counts: list[int]) -> dict[int, int]:
    """How many of each length to take, for the largest sum up to ``budget``; bitsets of reachable sums."""
    items = [(length * p, length, p) for length, n in zip(lengths, counts, strict=True) if 0 < length <= budget for p in _powers(min(n, budget // length))]
    step = gcd(*(length for _, length, _ in items)) if items else 1
    goal, mask = budget - budget % step, (1 << budget + 1) - 1
    reach = [1]
    for weight, _, _ in items:
        if reach[-1] >> goal & 1:
            break
        reach.append((reach[-1] | reach[-1] << weight) & mask)
    at, taken = reach[-1].bit_length() - 1, {}
    for k in range(len(reach) - 1, 0, -1):
        if not reach[k - 1] >> at & 1:
            weight, length, p = items[k - 1]
            taken[length] = taken.get(length, 0) + p
            at -= weight
    return taken


def _powers(n: int) -> Iterator[int]:
    p = 1
    while n > 0:
        yield min(p, n)
        n, p = n - p, 2 * p


def fit(target: float, lengths: list[int], counts: list[int]) -> tuple[int, dict[int, int]]:
    """Whole rounds of a source, then how many documents of each length to take once more."""
    total = sum(length * n for length, n in zip(lengths, counts, strict=True))
    if not total:
        return 0, {}
    rounds = int(target // total)
    budget = round(target) - rounds * total
    extra = {length: n * budget // total for length, n in zip(lengths, counts, strict=True) if length}
    left = budget - sum(length * k for length, k in extra.items())
    have = dict(zip(lengths, counts, strict=True))
    for length in sorted(extra, reverse=True):
        if left <= DP_WORDS:
            break
        more = min(have[length] - extra[length], left // length)
        extra[length] += more
        left -= more * length
    if left <= DP_WORDS:
        order = sorted(extra)
        for length, k in subset_sum(left, order, [have[x] - extra[x] for x in order]).items():
            extra[length] += k
    if sum(length * k for length, k in extra.items()) < budget:
        step = gcd(*extra)
        steps = budget // step
        if steps * sum(1 for n in have.values() for _ in _powers(n)) <= DP_BITS:
            order = sorted(extra)
            whole = {length * step: k for length, k in subset_sum(steps, [x // step for x in order], [have[x] for x in order]).items()}
            if sum(length * k for length, k in whole.items()) > sum(length * k for length, k in extra.items()):
                extra = whole
    return rounds, {length: k for length, k in extra.items() if k}


def with_size(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("_size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))


def _hash(doc_id: str, text: str, seed: int):
    return F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.col(text).cast("string"))


def plan(sizes: DataFrame, seed: int) -> tuple[DataFrame, dict, dict]:
    """Per source and length ``_rounds, _extra, _of, _limit`` for ``sizes(_source, _size, _hash)``, totals, targets.

    A document is taken ``_rounds`` times, and once more if ``_extra = _of`` or its hash is below ``_limit``; so are
    ``_some`` of the ``_alike`` documents whose hash is the limit.
    """
    totals = {r[0]: int(r[1] or 0) for r in sizes.groupBy("_source").agg(F.sum("_size")).collect()}
    goals = targets(totals)
    key = F.coalesce(F.concat(F.lit("s"), "_source"), F.lit("n")).alias("_key")
    goal_of = {("n" if s is None else "s" + s): t for s, t in goals.items()}
    histogram = sizes.groupBy(key, "_size").agg(F.count("*").alias("_of"))

    def fitted(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("_size")
        rounds, extra = fit(goal_of[found._key.iloc[0]], found._size.tolist(), found._of.tolist())
        return found.assign(_rounds=rounds, _extra=[extra.get(x, 0) for x in found._size])

    counts = stored(histogram.groupBy("_key").applyInPandas(fitted, "_key string, _size long, _of long, _rounds long, _extra long"), "quota")
    # the k-th least hash of a length: first its hash range, then its place in that
    part = small(counts.where("_extra > 0 and _extra < _of").withColumn("_ranges", F.expr(f"_of div {RANGE_ROWS} + 1")))
    ranged = sizes.select(key, "_size", "_hash").join(part, ["_key", "_size"]).withColumn("_range", F.expr("shiftright(((shiftright(_hash, 32) + 2147483648) * _ranges), 32)"))
    below = F.sum("_n").over(Window.partitionBy("_key", "_size").orderBy("_range"))
    edge = ranged.groupBy("_key", "_size", "_extra", "_range").agg(F.count("*").alias("_n")).withColumn("_to", below).where("_to >= _extra and _to - _n < _extra").selectExpr("_key", "_size", "_range", "_extra - _to + _n as _nth")
    upto = F.sum("_alike").over(Window.partitionBy("_key", "_size").orderBy("_hash"))
    near = ranged.join(small(edge), ["_key", "_size", "_range"]).groupBy("_key", "_size", "_nth", "_hash").agg(F.count("*").alias("_alike")).withColumn("_upto", upto)
    limit = near.where("_upto >= _nth and _upto - _alike < _nth").selectExpr("_key", "_size", "_hash as _limit", "_nth - _upto + _alike as _some", "_alike")
    return stored(counts.join(limit, ["_key", "_size"], "left"), "mix"), totals, goals


def _copies(sized: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows with ``_copies``, how often each is taken."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("_source")), F.lit("n"))
    joined = sized.withColumn("_key", key).join(small(chosen), ["_key", "_size"])
    more = joined.withColumn("_more", F.expr("_extra > 0 and (_extra = _of or _hash < _limit or _hash = _limit and _some = _alike)"))
    if not chosen.where("_some < _alike").isEmpty():  # a quota ends among equal documents: these are numbered, part by part
        cut = F.coalesce(F.expr("_hash = _limit and _some < _alike"), F.lit(False))
        equal = stored(more.where(cut).withColumn("_part", F.spark_partition_id()), "equal")
        before = equal.groupBy("_key", "_size", "_part").agg(F.count("*").alias("_n"))
        before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy("_key", "_size").orderBy("_part")) - F.col("_n")).drop("_n")
        place = F.row_number().over(Window.partitionBy("_key", "_size", "_part").orderBy("_hash"))
        numbered = equal.join(small(before), ["_key", "_size", "_part"]).withColumn("_more", F.col("_before") + place <= F.col("_some"))
        more = more.where(~cut).unionByName(numbered.select(more.columns))
    return more.withColumn("_copies", F.col("_rounds") + F.coalesce(F.col("_more").cast("int"), F.lit(0)))


def mix(docs: DataFrame, seed: int = 17, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    spark = tuned(docs.sparkSession)
    sizes = stored(with_size(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("_source"), F.col(text).alias("text"))).select("doc_id", "_source", "_size", _hash("doc_id", "text", seed).alias("_hash")), "sizes")
    chosen, totals, goals = plan(sizes, seed)
    of_source = spark.createDataFrame([("n" if s is None else "s" + s, totals[s], float(goals[s])) for s in totals], "_key string, source_size long, target double")
    out = _copies(sizes, chosen).join(small(of_source, len(totals)), "_key")
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_copies")).alias("taken"))


def mixed_rows(docs: DataFrame, seed: int = 17, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken. Rows without words stay once."""
    tuned(docs.sparkSession)
    inner, i, s, t = renamed(docs, doc_id, source, text)
    sized = with_size(inner, t).withColumns({"_source": F.col(s), "_hash": _hash(i, t, seed)})
    chosen, _, _ = plan(stored(sized.select("_source", "_size", "_hash"), "sizes"), seed)
    times = F.when(F.col("_size") == 0, F.lit(1)).otherwise(F.col("_copies"))
    return _copies(sized, chosen).withColumn("_copy", F.explode(F.expr("sequence(1, 2)"))).where(F.col("_copy") <= times).select(*inner.columns).toDF(*docs.columns)
