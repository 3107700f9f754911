"""What the training-data operators hold in a Python worker."""

import tempfile
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from tests.llm.test_operators import docs
from tracewright.llm import exact_dedup, minhash, packing, tokens
from tracewright.llm.queries import vocabulary



def _batches(rows):
    return iter(rows.toArrow().to_batches())


def test_a_worker_keeps_one_operators_caches(spark, monkeypatch):
    """The pipeline's tasks run in the same Python processes; each began with all that the stages before it had left."""
    frame, tasks = type(spark.range(0)), []
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, old=frame.mapInArrow, **b: tasks.append(f) or old(self, f, *a, **b))
    monkeypatch.setattr(TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    monkeypatch.setattr(tokens, "_LOADED", tokens._LOADED)
    rows = docs(spark, ["a text of some words", "a b"]).select("doc_id", "text")
    minhash._signed(rows)
    packing.pack_documents(rows, vocabulary("word_bpe_49k.json"))
    exact_dedup.deduplicate(rows)
    signing, packs, merging = tasks[:3]
    # the columns go by their places
    left = []
    for task in (signing, packs, signing, merging):
        named = rows.toDF("c0", "c1") if task is merging else rows
        assert list(task(_batches(named)))
        left.append((len(minhash._WORDS) > 0, len(tokens._LOADED) > 0))
    assert left == [(True, False), (False, True), (True, False), (False, False)]


def test_exact_dedup_holds_texts_once(spark, monkeypatch):
    """Contents were held besides their texts; other columns didn't count, so that a table of wide rows never spilled."""
    frame, tasks, folders = type(spark.range(0)), [], []
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, old=frame.mapInArrow, **b: tasks.append(f) or old(self, f, *a, **b))
    monkeypatch.setattr(exact_dedup.tempfile, "TemporaryDirectory", lambda *a, old=tempfile.TemporaryDirectory, **b: folders.append(1) or old(*a, **b))
    texts = [f"{i} " + "word " * 4000 for i in range(1000)]
    few = docs(spark, ["a"]).select("doc_id", "text")
    exact_dedup.survivors(few)
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array([i], pa.int64()), "text": [t]}) for i, t in enumerate(texts)]
    list(tasks[0](iter(batches[:1])))
    tracemalloc.start()
    found = tasks[0](iter(batches))
    first = next(found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert first.num_rows + sum(b.num_rows for b in found) == 1000 and not folders
    assert peak < 1.4 * sum(map(len, texts))
    exact_dedup.survivors(few.withColumn("wide", F.lit("x")), budget=1 << 20)
    wide = [pa.RecordBatch.from_pydict({"doc_id": pa.array([i], pa.int64()), "text": [str(i % 150)], "wide": ["x" * 20_000]}) for i in range(300)]
    kept = pa.Table.from_batches(tasks[-2](iter(wide)))
    assert sorted(kept["doc_id"].to_pylist()) == list(range(150)) and set(kept["_size"].to_pylist()) == {2} and folders


def test_exact_dedup_keeps_a_longer_copy(spark):
    """A copy that takes a row's place takes its content's place too, through spill files as well."""
    texts = ["a b " * 500, "ab" * 500, " a b\n" * 500, None, " "] * 40
    for budget in (1 << 12, 48 << 20):
        got = sorted((x.doc_id, x._size) for x in exact_dedup.survivors(docs(spark, texts).drop("_sha256"), budget=budget).select("doc_id", "_size").collect())
        assert got == [(2, 120), (4, 80)]
