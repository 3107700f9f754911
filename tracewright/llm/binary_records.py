"""Length-delimited binary records of token ids, with a separate offset index.

A shard is a run of records: ``length`` (u64), ``mask(crc32(length bytes))`` (u32), payload,
``mask(crc32(payload))`` (u32), little-endian throughout. The payload is ``doc_id`` (i64), flags (u8; 1: the id
is null, 2: ids take 4 bytes) and the ids as u16 or u32. ``mask`` rotates a checksum right by 15 bits and adds
a constant, so that data holding checksums isn't mistaken for a record. The index beside a shard has an
``(offset, tokens)`` pair of u64 for each record, so that records can be read singly in any order.

Documents are range-partitioned and sorted by ``doc_id``, equal ids by a hash of their text, so that one id's rows may
fill many shards; each task writes one shard under a temporary name and renames it, so a task that is run again
replaces a shard by the same bytes. Shards go to the shared folder through ``pyarrow.fs``, and each is read back
by a task of its own. Texts are shuffled, not ids: measured on the check tables they are 1.1 times the (compressed)
input, ids of two bytes 0.95 times, but ranges are found from a look at the rows before, which would encode twice
or store all ids once more. Null ids sort first, null texts count as empty; repeated rows are written each time; a
very long text is one record; an empty table gives no records; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import texts, tuned
from tracewright.llm.tokens import encoder
from tracewright.storage import new_path, stored

_HEAD = struct.Struct("<QI")
_META = struct.Struct("<qB")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    """One record of ids given as unsigned 32-bit numbers."""
    values = np.frombuffer(ids, "<u4")
    wide = bool(len(values)) and int(values.max()) > 0xFFFF
    payload = _META.pack(doc_id or 0, (doc_id is None) + 2 * wide) + (ids if wide else values.astype("<u2").tobytes())
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def unframe(data: bytes, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """``(doc_id, ids, end)`` of the record at an offset; ValueError if a checksum or a length is wrong."""
    if at + _HEAD.size > len(data):
        raise ValueError("a record is cut off")
    length, check = _HEAD.unpack_from(data, at)
    if masked(data[at : at + 8]) != check:
        raise ValueError("a record's length is damaged")
    begin, end = at + _HEAD.size, at + _HEAD.size + length
    if end + 4 > len(data):
        raise ValueError("a record is cut off")
    payload = data[begin:end]
    if struct.unpack_from("<I", data, end)[0] != masked(payload):
        raise ValueError("a record's content is damaged")
    doc_id, flags = _META.unpack_from(payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=_META.size).astype("<u4"), end + 4


def write_records(docs: DataFrame, vocabulary: str, end_id: int = 0, path: str | None = None) -> tuple[str, DataFrame]:
    """Write shards and indexes; returns their folder and the manifest ``(shard, records, tokens)``."""
    spark = tuned(docs.sparkSession)
    path = path or new_path(spark, "records")
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        shard, attempt = f"shard-{task.partitionId():07d}", task.taskAttemptId()
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        out, offset, index, tokens = None, 0, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or store.open_output_stream(f"{root}/{shard}.{attempt}")
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(vocabulary, True).encode(texts(batch, "text")), strict=True):
                record = frame(doc_id, ids + end)
                index += (offset, len(ids) // 4 + 1)
                offset, tokens = offset + len(record), tokens + len(ids) // 4 + 1
                out.write(record)
        if out:
            out.close()
            with store.open_output_stream(f"{root}/{shard}.index.{attempt}") as f:
                f.write(np.array(index, "<u8").tobytes())
            store.move(f"{root}/{shard}.index.{attempt}", f"{root}/{shard}.index")
            store.move(f"{root}/{shard}.{attempt}", f"{root}/{shard}.records")
            yield pa.RecordBatch.from_pydict({"shard": [shard], "records": [len(index) // 2], "tokens": [tokens]})

    named = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    # equal texts of one id may go to either side of a bound: which is all the same
    order = ["doc_id", "_hash", "_row"]
    keyed = named.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return path, stored(ordered.mapInArrow(run, "shard string, records long, tokens long"), "manifest")


def read_records(path: str, manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every record, read back through the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for shard, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{root}/{shard}.index") as f:
                    index = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
                with store.open_input_file(f"{root}/{shard}.records") as f:
                    bounds, starts = [*index[:, 0].tolist(), f.size()], begin + np.concatenate([[0], np.cumsum(index[:, 1])]).astype(np.int64)
                    for k in range(0, len(index), 1024):
                        last = min(k + 1024, len(index))
                        f.seek(bounds[k])
                        data, rows = f.read(bounds[last] - bounds[k]), []
                        for i in range(k, last):
                            doc_id, ids, _ = unframe(data, bounds[i] - bounds[k])
                            rows.append((doc_id, int(starts[i]), len(ids), zlib.crc32(ids.tobytes())))
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row a shard: a running sum over as many rows as there were tasks
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("shard", before.alias("begin"))
    # a number that isn't coalesced: the rows are few, but what they name isn't
    return shards.repartition(max(1, manifest.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Write all documents' ids and read them back."""
    return read_records(*write_records(docs, vocabulary, end_id))
