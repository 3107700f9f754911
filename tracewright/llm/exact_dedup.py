"""Exact deduplication by Grace hashing with an open-addressing table over complete content.

Texts are equal when identical after deleting blanks and the characters 9 to 13. Each task first merges its
own records (so a text with very many copies is shuffled once a task), the survivors are shuffled by a hash
of the content, and each task merges what it gets. Merging reads records into an open-addressing table that
compares complete contents, made anew of the texts where hashes are equal, as it holds no second copy of a
text; when the table outgrows its budget, other columns counted, records go to spill files by further hash bits and each file is merged in the same way, until it fits. Spill files are a task's own, in the folders that Spark
gives its workers for spilling, and go with it; a lost task starts again from its input.

Of equal texts the row with the most code points in its text stays, then the smallest doc_id (nulls last).
Null texts count as empty, all empty and blank texts are equal. Repeated rows are copies like any others. An empty
table gives no rows. A very long text is compared whole. Other columns are kept by ``deduplicate`` and else ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import sys
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import alone, renamed, tuned

#: Bytes of rows that a table may hold before it spills.
BUDGET = 48 << 20
FANOUT_BITS = 4
_BLANKS = bytes([0x20, *range(0x09, 0x0E)])


def content_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, _BLANKS)


def rank_of(text: str | None, doc_id: int | None) -> tuple:
    """The least of equal texts stays."""
    return -len(text or ""), doc_id is None, doc_id or 0


class Content:
    """A text that equals others by content, and is held as it is."""

    __slots__ = ("text",)

    def __init__(self, text: str | None):
        self.text = text

    def __eq__(self, other: Content) -> bool:
        return self.text == other.text or content_of(self.text) == content_of(other.text)

    __hash__ = None


def bytes_of(value) -> int:
    """About what a value takes in memory, if it is more than a number does."""
    if isinstance(value, (str, bytes)):
        return sys.getsizeof(value)
    if isinstance(value, dict):
        value = [*value, *value.values()]
    return 60 * len(value) + sum(map(bytes_of, value)) if isinstance(value, (list, tuple)) else 0


class OpenTable:
    """Open addressing with linear probing. An entry is ``[hash, content, size, rank, row, digest]``.

    The content is bytes, or a ``Content`` of the row's text, which takes no memory besides.
    """

    def __init__(self):
        self.slots: list[int] = [-1] * 64
        self.entries: list[list] = []
        self.bytes = 0

    def add(self, entry: list) -> None:
        mask = len(self.slots) - 1
        at = entry[0] & mask
        while (k := self.slots[at]) >= 0:
            mine = self.entries[k]
            if mine[0] == entry[0] and mine[1] == entry[1]:
                mine[2] += entry[2]
                if entry[3] < mine[3]:
                    self.bytes += bytes_of(entry[4]) - bytes_of(mine[4])
                    mine[1], mine[3:] = entry[1], entry[3:]
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.entries)
        self.entries.append(entry)
        self.bytes += bytes_of(entry[1]) + bytes_of(entry[4]) + 400
        if 2 * len(self.entries) > len(self.slots):
            self.slots = [-1] * (4 * len(self.slots))
            mask = len(self.slots) - 1
            for k, e in enumerate(self.entries):
                at = e[0] & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = k


def scratch() -> str | None:
    """Where a task's own spill files go: the folders that Spark gives its workers for spilling, one by process."""
    found = [x for x in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(x)]
    return found[os.getpid() % len(found)] if found else None


def grace(entries: Iterator[list], budget: int = BUDGET, level: int = 0) -> Iterator[list]:
    """Entries merged by content. Past the budget, they spill by ``FANOUT_BITS`` of the hash for each level."""
    table = OpenTable()
    for entry in entries:
        table.add(entry)
        # hash bits run out only where contents share a hash; such a table simply grows
        if table.bytes > budget and FANOUT_BITS * (level + 1) <= 48:
            break
    else:
        yield from table.entries
        return
    with tempfile.TemporaryDirectory(prefix="grace-", dir=scratch()) as folder:
        files = [open(f"{folder}/{k}", "w+b") for k in range(1 << FANOUT_BITS)]  # noqa: SIM115
        shift = 60 - FANOUT_BITS * level

        def spill(entry: list) -> None:
            pickle.dump(entry, files[entry[0] >> shift & (1 << FANOUT_BITS) - 1], pickle.HIGHEST_PROTOCOL)

        for entry in table.entries:
            spill(entry)
        del table
        for entry in entries:
            spill(entry)
        for f in files:
            f.seek(0)
            yield from grace(_read(f), budget, level + 1)
            f.close()


def _read(f) -> Iterator[list]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """The rows that stay, with all their columns and then ``_sha256`` (binary, of the content) and ``_size`` (rows it stands for)."""
    names = docs.columns
    out = docs.withColumns({"_sha256": F.lit(None).cast("binary"), "_size": F.lit(None).cast("long")}).schema
    i, j = names.index(doc_id), names.index(text)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(grace.__module__)
        kind: list[pa.Schema] = []

        def entries():
            for batch in batches:
                if not kind:
                    kind.append(pa.schema([batch.schema.field(n) for n in names] + [pa.field("_sha256", pa.binary()), pa.field("_size", pa.int64())]))
                columns = [c.to_pylist() for c in batch.columns]
                sizes = columns[len(names) + 1] if len(columns) > len(names) else None
                for k, row in enumerate(zip(*columns[: len(names)], strict=True)):
                    sha = hashlib.sha256(content_of(row[j])).digest()
                    yield [int.from_bytes(sha[:8], "big"), Content(row[j]), sizes[k] if sizes else 1, rank_of(row[j], row[i]), row, sha]

        rows: list[tuple] = []
        held = 0
        for entry in grace(entries(), budget):
            rows.append((*entry[4], entry[5], entry[2]))
            held += bytes_of(entry[4])
            if held > 8 << 20 or len(rows) == 4096:
                yield _rows(rows, kind[0])
                rows, held = [], 0
        if rows:
            yield _rows(rows, kind[0])

    tuned(docs.sparkSession)
    local = docs.mapInArrow(merged, out)
    return local.repartition(F.col("_sha256")).mapInArrow(merged, out)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns they had."""
    inner, i, t = renamed(docs, doc_id, text)
    return survivors(inner, i, t).select(*inner.columns).toDF(*docs.columns)


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Where rows repeat a doc_id, each is kept or dropped with it. Members find their group by the content's
    digest in a sort-merge join of narrow rows, whose hot keys adaptive execution splits.
    """
    thin = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(content_of.__module__)
        for batch in batches:
            sha = [hashlib.sha256(content_of(x)).digest() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sha, pa.binary())], names=["doc_id", "_sha256"])

    stay = survivors(thin).select("_sha256", F.col("doc_id").alias("keep_id"), F.col("_size").alias("group_size"))
    members = thin.mapInArrow(digests, "doc_id long, _sha256 binary")
    return members.join(stay, "_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("_sha256")).alias("text_sha256"))
