"""Images of the shared ring between a sensor and its service, as saved to a file: the frames not yet read.

A running ring is memory of one machine and no source for a cluster; its saved images are. Cursors count bytes and
never wrap; a frame's size is written last, so a size of 0 is a frame still being written, and what comes after it
waits for a later image. A frame that wouldn't fit before the end of the data starts at its beginning; the rest
is skipped as padding.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracewright.sources.frames import FRAME, FrameError

# Fixed values of the layout.
MAGIC, LAYOUT = b"SRNG", 1
HEAD_AT, TAIL_AT, DATA_AT = 64, 128, 4096
PADDING = 0
#: Telemetry may use this share of the ring; frames that wait for a reply may use all of it.
TELEMETRY = 7 / 8

_CONTROL, _HEAD, _TAIL = struct.Struct("<4sHxxI"), struct.Struct("<QQ"), struct.Struct("<Q")
DDL = "path string, frame int, content binary, dropped long, complete boolean"


def unread(image: bytes) -> tuple[list[bytes], int, bool]:
    """The committed frames in order, how many the producer dropped, and whether nothing is still being written."""
    if len(image) <= DATA_AT:
        raise FrameError("a ring image is cut off")
    magic, layout, size = _CONTROL.unpack_from(image)
    if magic != MAGIC or layout != LAYOUT or size & (size - 1) or not 0 < size <= len(image) - DATA_AT:
        raise FrameError("a ring image's magic, layout or size is wrong")
    (head, dropped), (tail,) = _HEAD.unpack_from(image, HEAD_AT), _TAIL.unpack_from(image, TAIL_AT)
    length = (head - tail) % (1 << 64)
    if length > size:
        raise FrameError("a ring image's cursors are further apart than its data is long")
    first = tail % size
    data = (image[DATA_AT + first : DATA_AT + size] + image[DATA_AT : DATA_AT + first])[:length]
    out, at = [], 0
    while at < length:
        if length - at < FRAME.size:
            raise FrameError("a ring image's frame is cut off")
        total, version, _ = FRAME.unpack_from(data, at)
        if not total:
            return out, dropped, False
        if total < FRAME.size or total % 8 or at + total > length:
            raise FrameError("a ring image's frame has a wrong size")
        if version != PADDING:
            out.append(data[at : at + total])
        at += total
    return out, dropped, True


def ring_image(frames: list[tuple[bytes, bool]], size: int, tail: int = 0) -> bytes:
    """An image with ``(frame, waits for a reply)`` published in order by a sensor whose reader stands still."""
    data, at, dropped = bytearray(size), tail, 0
    for frame, waits in frames:
        room = (size if waits else int(size * TELEMETRY)) - (at - tail)
        gap = size - at % size
        gap = gap if gap < len(frame) else 0
        if gap + len(frame) > room:
            dropped += 1
            continue
        if gap:
            data[at % size : at % size + FRAME.size] = FRAME.pack(gap, PADDING, 0)
            at += gap
        data[at % size : at % size + len(frame)] = frame
        at += len(frame)
    control = bytearray(DATA_AT)
    _CONTROL.pack_into(control, 0, MAGIC, LAYOUT, size)
    _HEAD.pack_into(control, HEAD_AT, at, dropped)
    _TAIL.pack_into(control, TAIL_AT, tail)
    return bytes(control + data)


def read_rings(spark: SparkSession, path: str) -> DataFrame:
    """``path, frame, content, dropped, complete`` of all images under a path; an image without frames gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found, dropped, complete = unread(image.as_py())
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(found, pa.binary()), pa.array([dropped] * n, pa.int64()), pa.array([complete] * n, pa.bool_())], names=[x.split()[0] for x in DDL.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, DDL)
