"""Sensor frames: a binary batch of records, decoded to rows and normalised to events.

Fixed layout, little-endian: frame = total u32, version u16 (2), count u16 (top bit: a reply is expected);
record = size u32, type u8, 3 bytes, time i64 (100 ns ticks), pid u32, request u32, pid start i64, then the body; a record
is a multiple of 8 bytes, strings are a u16 byte length and UTF-16LE.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME, RECORD = struct.Struct("<IHH"), struct.Struct("<IB3xqIIq")
VERSION, REPLY = 2, 0x8000
#: Bytes of a capture file that a task decodes at once.
CHUNK = 8 << 20
#: Record types and their bodies: numbers, then strings.
TYPES = {
    1: ("open", "", ("file_name",)), 2: ("write", "", ("file_name",)), 100: ("create", "Iq", ("image", "cmdline")), 101: ("exit", "", ()),
    102: ("process_open", "IqI", ("target_image",)), 103: ("exist", "", ("image",)), 104: ("remote_thread", "IqI", ()),
}
_NUMBERS = {100: ("child_pid", "child_start"), 102: ("target_pid", "target_start", "desired_access"), 104: ("target_pid", "target_start", "thread_id")}
FIELDS = ("child_pid", "child_start", "target_pid", "target_start", "desired_access", "thread_id")
TEXTS = ("file_name", "image", "cmdline", "target_image")
DDL = "type string, ts long, pid long, req_id long, pid_start long, reply boolean, " + ", ".join(f"{n} long" for n in FIELDS) + ", " + ", ".join(f"{n} string" for n in TEXTS)


class FrameError(ValueError):
    """A frame whose sizes or version don't hold."""


def encode_record(type_: int, ts: int, pid: int, pid_start: int, req_id: int = 0, **values) -> bytes:
    _, numbers, texts = TYPES.get(type_, ("", "", ()))
    body = struct.pack("<" + numbers, *(values.get(n, 0) for n in _NUMBERS.get(type_, ())))
    for name in texts:
        raw = values.get(name, "").encode("utf-16-le")
        body += struct.pack("<H", len(raw)) + raw
    size = -(-(RECORD.size + len(body)) // 8) * 8
    return RECORD.pack(size, type_, ts, pid, req_id, pid_start) + body.ljust(size - RECORD.size, b"\0")


def encode_frame(records: list[bytes], reply: bool = False) -> bytes:
    return FRAME.pack(FRAME.size + sum(map(len, records)), VERSION, len(records) | REPLY * reply) + b"".join(records)


def decode_frame(data: bytes) -> list[dict]:
    """Records of one frame; unknown types are skipped by their size."""
    if len(data) < FRAME.size:
        raise FrameError("a frame is cut off")
    total, version, count = FRAME.unpack_from(data)
    if total != len(data) or version != VERSION:
        raise FrameError("a frame's size or version is wrong")
    out, at = [], FRAME.size
    for _ in range(count & ~REPLY):
        if at + RECORD.size > total:
            raise FrameError("a record is cut off")
        size, type_, ts, pid, req_id, start = RECORD.unpack_from(data, at)
        if size < RECORD.size or size % 8 or at + size > total:
            raise FrameError("a record's size is wrong")
        if type_ in TYPES:
            name, numbers, texts = TYPES[type_]
            row = {"type": name, "ts": ts, "pid": pid, "req_id": req_id, "pid_start": start, "reply": bool(count & REPLY)}
            body, end = at + RECORD.size, at + size
            try:
                row |= zip(_NUMBERS.get(type_, ()), struct.unpack_from("<" + numbers, data[:end], body), strict=True)
                body += struct.calcsize("<" + numbers)
                for field in texts:
                    (n,) = struct.unpack_from("<H", data[:end], body)
                    if n % 2 or body + 2 + n > end:
                        raise FrameError("a string's length is wrong")
                    row[field] = data[body + 2 : body + 2 + n].decode("utf-16-le", "replace")
                    body += 2 + n
            except struct.error:
                raise FrameError("a record's body is cut off") from None
            out.append(row)
        at += size
    return out


def split_stream(data: bytes) -> Iterator[bytes]:
    """Frames that follow each other; an end within a frame is an error."""
    at = 0
    while at < len(data):
        total = _total(data[at : at + 4], len(data) - at)
        yield data[at : at + total]
        at += total


def decode(frames: DataFrame, content: str = "content") -> DataFrame:
    """Records of a binary column that holds frames in a row."""
    names = [x.split()[0] for x in DDL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"type": pa.string(), "reply": pa.bool_()} | dict.fromkeys(TEXTS, pa.string())
        for batch in batches:
            rows = [r for data in batch.column(0).to_pylist() for f in split_stream(data or b"") for r in decode_frame(f)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.int64())) for n in names], names=names)

    return frames.select(content).mapInArrow(run, DDL)


def _total(head: bytes, left: int) -> int:
    """A frame's size by its first bytes."""
    total = struct.unpack("<I", head)[0] if len(head) == 4 else 0
    if not FRAME.size <= total <= left:
        raise FrameError("the stream ends within a frame")
    return total


def read_frames(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """Records of capture files of any size, as ``decode``: a first pass hops from frame to frame by their sizes and
    cuts files into runs of whole frames of about ``chunk`` bytes, which tasks then read and decode on their own.

    Paths are opened by executors through ``pyarrow.fs``. An end within a frame is an error.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for uri, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(uri)
                begins, at = [0], 0
                with store.open_input_file(name) as f:
                    while at < length:
                        f.seek(at)
                        at += _total(f.read(4), length - at)
                        if at - begins[-1] >= chunk and at < length:
                            begins.append(at)
                ends = [*begins[1:], length]
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(begins)), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], names=["uri", "begin", "end"])

    def content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for uri, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = fs.FileSystem.from_uri(uri)
                with store.open_input_file(name) as f:
                    f.seek(begin)
                    yield pa.RecordBatch.from_arrays([pa.array([f.read(end - begin)], pa.binary())], names=["content"])

    # only names and sizes are read of the listing; a "file:/x" of Spark's is "file:///x" elsewhere
    files = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/(?=[^/])", "file:///").alias("uri"), "length")
    runs = files.repartition("uri").mapInArrow(cut, "uri string, begin long, end long")
    parts = max(1, int(files.agg(F.sum("length")).first()[0] or 0) // chunk)
    # by range, so that rows keep the order of the files
    return decode(runs.repartitionByRange(parts, "uri", "begin").sortWithinPartitions("uri", "begin").mapInArrow(content, "content binary"))


def normalise(records: DataFrame) -> DataFrame:
    """Events of sensor records: ``ts, op, actor, object, attrs, req_id, reply``; records that only tell state are dropped."""
    ms = lambda ticks: F.expr(f"greatest({ticks}, 0) div 10000")
    proc = lambda pid, start: F.concat(F.lit("proc:"), F.col(pid).cast("string"), F.lit("."), ms(start).cast("string"))
    file = F.concat(F.lit("file:"), "file_name")
    op = F.expr("case type when 'create' then 'exec' when 'open' then 'open' when 'write' then 'write' when 'process_open' then 'read' when 'remote_thread' then 'inject' end")
    object_ = F.when(F.col("type") == "create", proc("child_pid", "child_start")).when(F.col("type").isin("process_open", "remote_thread"), proc("target_pid", "target_start")).otherwise(file)
    reads = F.when(F.col("type").isin("process_open") & ((F.col("desired_access").bitwiseAND(0x10)) != 0), F.lit("1"))
    made = F.create_map(F.lit("image"), F.when(F.col("type") == "create", F.col("image")), F.lit("cmd"), F.col("cmdline"), F.lit("target_image"), F.when(F.col("target_image") != "", F.col("target_image")), F.lit("vm_read"), reads)
    out = records.withColumn("op", op).where("op is not null")
    return out.select(ms("ts").alias("ts"), "op", proc("pid", "pid_start").alias("actor"), object_.alias("object"), F.map_filter(made, lambda _, v: v.isNotNull()).alias("attrs"), "req_id", "reply")
