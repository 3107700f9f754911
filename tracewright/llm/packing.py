"""Sum-of-squares online packing of tokenised documents into fixed windows.

A document longer than a window first fills whole windows; what is left goes into the fill level that makes
the sum of squared counts of partially filled windows least, over an array that counts the open windows at
every level. Each task packs its own part of the table, so nothing is shuffled and a lost task is run again
with the same result. When a task's input ends, its open windows are closed, the fullest first: its gap takes whole
pieces of the emptiest windows, the largest that fits each time, and part of a piece that is cut up for this where
none fits. So the fuller windows keep what the levels gave them, and little is cut; what no window
takes, less than one, goes into sequences of sizes that are powers of two, which need no padding. ``closing`` counts
what was moved and cut: a few hundred windows a task, however large the task.

Null or empty texts hold just the end id. Null ids are packed as any. Repeated rows are packed as often as they
occur. A very long text fills windows of its own. An empty table gives an empty result. Any other columns are
ignored, whatever their names. Windows of different tasks have different numbers, the task's number in the high
bits; a table of very few rows makes short windows rather than padded ones.
"""

from __future__ import annotations

import zlib
from bisect import bisect, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewright.llm.common import alone, texts, tuned
from tracewright.llm.tokens import encoder

WINDOW = 4096
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Places sizes below ``window`` into open windows. ``counts[h]``: open windows filled to level h."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[int]] = {}

    def place(self, size: int) -> int:
        """The level to put a piece of this size on; 0 is a new window.

        Of levels that change the sum of squares alike, the fullest is taken.
        """
        w, n = self.window, self.counts
        from_ = n[: w - size + 1]
        to = n[size : w + 1]
        change = 2 * (to - from_) + 2
        change[-1] = 1 - 2 * from_[-1]  # a window that gets full leaves the count
        change[0] = 2 * to[0] + 1  # a new window leaves no level
        change[1:][from_[1:] == 0] = np.iinfo(np.int64).max
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def add(self, size: int, new: Callable[[], int]) -> tuple[int, int]:
        """Window and offset for a piece; ``new()`` numbers a new window."""
        level = self.place(size)
        if level:
            window = self.open[level].pop()
            self.counts[level] -= 1
        else:
            window = new()
        if level + size < self.window:
            self.open.setdefault(level + size, []).append(window)
            self.counts[level + size] += 1
        return window, level


def closing_sizes(total: int, window: int = WINDOW) -> list[int]:
    """Window sizes that hold ``total`` ids without padding: full ones, then falling powers of two."""
    rest = total % window
    return [window] * (total // window) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(documents: Iterator[tuple[int | None, bytes]], first: int, window: int = WINDOW) -> Iterator[tuple]:
    """Pieces ``(doc_id, start, length, crc32, doc_tokens, sequence_id, offset)`` of documents given as packed ids.

    Only the ids of pieces in open windows are held, at most a few hundred windows at a time.
    """
    levels, serial = SumOfSquares(window), iter(range(first, first + (1 << 40)))
    held: dict[int, list[tuple]] = {}

    def piece(doc_id, ids: bytes, start: int, length: int, total: int, sequence: int, offset: int) -> tuple:
        return doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, sequence, offset

    for doc_id, ids in documents:
        total = len(ids) // 4
        whole = total // window * window
        for start in range(0, whole, window):
            yield piece(doc_id, ids, start, window, total, next(serial), 0)
        if total == whole:
            continue
        sequence, offset = levels.add(total - whole, lambda: next(serial))
        held.setdefault(sequence, []).append((doc_id, ids[4 * whole :], whole, total, offset))
        if offset + total - whole == window:
            for one_id, rest, start, all_, at in held.pop(sequence):
                yield one_id, start, len(rest) // 4, zlib.crc32(rest), all_, sequence, at
    yield from close(list(held.values()), lambda: next(serial), window)


def close(windows: list[list[tuple]], new: Callable[[], int], window: int, closing: dict[str, int] | None = None) -> Iterator[tuple]:
    """Rows of the pieces ``(doc_id, ids, start, doc_tokens, offset)`` of open windows, closed without padding.

    ``closing`` gets the ids that were ``moved`` to another window, and those of pieces that were ``cut`` up.
    """
    size = lambda piece: len(piece[1]) // 4
    level = lambda pieces: pieces[-1][4] + size(pieces[-1])
    windows.sort(key=level, reverse=True)
    pool: list[tuple[int, int, tuple]] = []  # pieces to be moved, by size; the second number keeps ties apart
    loose = serial = 0
    rest: tuple | None = None
    closing = {} if closing is None else closing
    closing |= {"moved": 0, "cut": 0}

    def free(piece: tuple) -> None:
        nonlocal loose, serial
        serial += 1
        loose += size(piece)
        insort(pool, (size(piece), serial, piece))

    def row(piece: tuple, sequence: int, offset: int) -> tuple:
        return piece[0], piece[2], size(piece), zlib.crc32(piece[1]), piece[3], sequence, offset

    def filled(sequence: int, at: int, most: int) -> Iterator[tuple]:
        """Pieces of the pool from an offset on up to a size; where none fits, a part of the one that is being cut."""
        nonlocal loose, rest
        while at < most and loose:
            k = bisect(pool, (most - at, serial + 1)) - 1
            if k >= 0:
                piece = pool.pop(k)[2]
            else:
                if rest is None:
                    rest = pool.pop()[2]
                    closing["cut"] += size(rest)
                n = min(size(rest), most - at)
                piece = (rest[0], rest[1][: 4 * n], rest[2], rest[3])
                rest = (rest[0], rest[1][4 * n :], rest[2] + n, rest[3]) if n < size(rest) else None
            loose -= size(piece)
            closing["moved"] += size(piece)
            yield row(piece, sequence, at)
            at += size(piece)

    # as many of the fullest stay as the others can fill
    gaps, there, stay = 0, sum(map(level, windows)), 0
    for pieces in windows:
        gaps, there = gaps + window - level(pieces), there - level(pieces)
        if gaps > there:
            break
        stay += 1
    for pieces in windows[stay:]:
        for piece in pieces:
            free(piece)
    for pieces in windows[:stay]:
        sequence = new()
        for piece in pieces:
            yield row(piece, sequence, piece[4])
        yield from filled(sequence, level(pieces), window)
    for most in closing_sizes(loose, window):
        yield from filled(new(), 0, most)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``; see the module's text for the order of windows."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        alone(encoder.__module__)

        def documents():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), (ids + end for ids in encoder(vocabulary, False).encode(texts(batch, "text"))), strict=True)

        rows: list[tuple] = []
        for row in pack(documents(), TaskContext.get().partitionId() << 40, window):
            rows.append(row)
            if len(rows) == 20_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    tuned(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, DDL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=SCHEMA)
