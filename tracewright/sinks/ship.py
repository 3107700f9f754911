"""Shipping: rows as framed messages in a binary column, back again, and out over TCP from a stream."""

from __future__ import annotations

import socket
import time
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tracewright.sources import wire

_EVENT = "seq long, ts long, op string, actor string, object string, storyline long, ttps array<string>, attrs map<string,string>"
READ = _EVENT + ", pattern string, score double, reason string, error string"
_ARROW = {
    "seq": pa.int64(), "ts": pa.int64(), "op": pa.string(), "actor": pa.string(), "object": pa.string(), "storyline": pa.int64(), "ttps": pa.list_(pa.string()),
    "attrs": pa.map_(pa.string(), pa.string()), "pattern": pa.string(), "score": pa.float64(), "reason": pa.string(), "error": pa.string(),
}


def to_messages(events: DataFrame) -> DataFrame:
    """``seq, message``: each event framed; with ``pattern, score, reason`` columns, rows that name a pattern are block reports."""
    report = "pattern" in events.columns
    columns = ["seq", "ts", "op", "actor", "object", "attrs", *[c for c in ("storyline", "ttps") if c in events.columns], *(["pattern", "score", "reason"] if report else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                event = {"ts": row["ts"], "op": row["op"], "actor": row["actor"], "object": row["object"], "attrs": dict(row["attrs"] or {})}
                if row.get("pattern"):
                    message = {"seq": row["seq"], "pattern": row["pattern"], "score": row["score"] or 0.0, "reason": row["reason"] or "", "event": event}
                else:
                    message = {"seq": row["seq"], "storyline": row.get("storyline") or 0, "ttps": row.get("ttps") or (), "event": event}
                made.append(wire.encode(message))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["seq", "message"])

    return events.select(*columns).mapInArrow(run, "seq long, message binary")


def _rows(data: bytes, strict: bool) -> Iterator[dict]:
    at = 0
    while at < len(data):
        try:
            found = wire.decode(data, at)
            if found is None:
                raise wire.WireError("a message is cut off")
        except (wire.WireError, UnicodeDecodeError) as e:
            if strict:
                raise
            yield {"error": str(e)}
            return
        m, at = found
        event = m.pop("event")
        yield {k: v for k, v in (m | event).items() if k != "attrs"} | {"attrs": list(event["attrs"].items())}


def from_messages(frames: DataFrame, content: str = "content", strict: bool = True) -> DataFrame:
    """Messages of a binary column that holds any number in a row.

    A bad message fails the query; unless ``strict``, it becomes a row with ``error`` and ends its cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = list(_rows(data or b"", strict))
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in _ARROW.items()], names=list(_ARROW))

    return frames.select(content).mapInArrow(run, READ)


def _send(host: str, port: int, pause: float, tries: int) -> Callable:
    def run(rows: Iterator) -> None:
        link = None
        for row in rows:
            for attempt in range(tries):
                try:
                    link = link or socket.create_connection((host, port), timeout=10)
                    link.sendall(bytes(row.message))
                    break
                except OSError:
                    link = None
                    if attempt + 1 == tries:
                        raise
                    time.sleep(pause)
        if link:
            link.close()

    return run


def _send_bounded(host: str, port: int, pause: float, tries: int, queue: int, dropped) -> Callable:
    """As ``_send``, but what a queue of so many messages can't hold while the backend is away is dropped and counted."""

    def run(rows: Iterator) -> None:
        waiting: deque = deque()
        link, next_try = None, 0.0

        def flush() -> None:
            nonlocal link, next_try
            try:
                if link is None and time.monotonic() >= next_try:
                    next_try = time.monotonic() + pause
                    link = socket.create_connection((host, port), timeout=10)
                while link and waiting:
                    link.sendall(waiting[0])
                    waiting.popleft()
            except OSError:
                link = None

        for row in rows:
            if len(waiting) < queue:
                waiting.append(bytes(row.message))
            else:
                dropped.add(1)
            flush()
        for _ in range(tries):
            if not waiting:
                break
            time.sleep(pause)
            flush()
        if waiting:
            dropped.add(len(waiting))
        if link:
            link.close()

    return run


def ship_tcp(events: DataFrame, host: str, port: int, pause: float = 0.5, tries: int = 20, queue: int = 0, dropped=None):
    """A stream's events over TCP, a connection a task; reconnects after ``pause`` seconds.

    Where the backend stays away, the batch fails and is sent anew: nothing is dropped, a message may come twice,
    so the backend keeps the first of each ``(host, seq)``. With a ``queue`` of so many messages a task instead drops
    what doesn't fit while the backend is away; ``dropped``, an accumulator, counts them.
    """
    if queue:
        bounded = _send_bounded(host, port, pause, tries, queue, dropped or events.sparkSession.sparkContext.accumulator(0))
        return events.writeStream.foreachBatch(lambda batch, _: to_messages(batch).foreachPartition(bounded))
    run = _send(host, port, pause, tries)
    return events.writeStream.foreachBatch(lambda batch, _: to_messages(batch).foreachPartition(run))
