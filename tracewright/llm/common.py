"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch; long texts make even this many megabytes.
BATCH_ROWS = 512
#: What this worker keeps from task to task, by the module that keeps it.
_CACHES: dict[str, dict] = {}
_LAST: list[str] = []


def cached(module: str, cache: dict) -> dict:
    """A cache that outlives tasks, until one of another operator begins in this worker."""
    return _CACHES.setdefault(module, cache)


def alone(module: str) -> None:
    """To be called as a task begins: frees what other operators have left in this worker, which Spark uses for all of them."""
    left = [cache for name, cache in _CACHES.items() if name != module and cache]
    for cache in left:
        cache.clear()
    if left or _LAST != [module]:
        _LAST[:] = [module]
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass


def tuned(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches of whole texts small, so that a Python worker's memory stays bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one smaller than a single split, which one task might read, is dealt out by the megabyte."""
    found = tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes():
        return found
    return found.repartition(max(1, min(spark.sparkContext.defaultParallelism, size >> 20)))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A batch's texts, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def remainder(doc_id: str, modulus: int):
    """crc32 of the id as text, by modulus; a null id counts as 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus)), F.lit(0))


def by_group(rows: DataFrame, keys: list[str], run: Callable[[dict[str, np.ndarray]], list[tuple]], ddl: str) -> DataFrame:
    """``run`` on each group's columns as arrays, for very many small groups.

    Rows are shuffled and sorted by the keys; a task walks along its groups, which costs far less a group than
    a call from the JVM for each. ``run`` returns rows of whole numbers.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        names: list[str] = []
        out: list[tuple] = []

        def groups(batch: pa.Table, to_end: bool) -> int:
            """Runs every group but the last one, which may go on; returns its first row."""
            cols = {n: batch.column(n).to_numpy() for n in batch.column_names}
            change = np.zeros(batch.num_rows, bool)
            for k in keys:
                change[1:] |= cols[k][1:] != cols[k][:-1]
            starts = [0, *np.flatnonzero(change).tolist()]
            ends = [*starts[1:], batch.num_rows]
            for lo, hi in list(zip(starts, ends, strict=True))[: None if to_end else -1]:
                out.extend(run({n: c[lo:hi] for n, c in cols.items()}))
            return starts[-1]

        for batch in batches:
            if not batch.num_rows:
                continue
            names = names or batch.schema.names
            last = [batch.column(k)[0].as_py() for k in keys] if rest else None
            goes_on = rest and last == [rest[0].column(k)[0].as_py() for k in keys] and all(batch.column(k)[batch.num_rows - 1].as_py() == v for k, v in zip(keys, last, strict=True))
            rest.append(batch)
            if goes_on:
                continue
            whole = pa.Table.from_batches(rest)
            at = groups(whole, False)
            rest = whole.slice(at).combine_chunks().to_batches()
            if len(out) > 10_000:
                yield _numbers(out, ddl)
                out.clear()
        if rest:
            groups(pa.Table.from_batches(rest), True)
        if out:
            yield _numbers(out, ddl)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(walk, ddl)


def _numbers(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in ddl.split(",")])


def renamed(docs: DataFrame, *names: str) -> tuple:
    """``docs`` with columns named by their place, so that no name clashes with an operator's own, and the new names."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), *(f"c{docs.columns.index(n)}" for n in names)
