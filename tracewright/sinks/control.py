"""Control records: 16 bytes that arm or release a process, name our own one, set up a ring, or answer a request.

Layout, little-endian: kind u8, code u8, two zero bytes, u32, u64. A rule set is longer: kind u8, three zero
bytes, u32 length, then the rules' bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.model import OPS

RECORD, HEAD = struct.Struct("<BBxxIQ"), struct.Struct("<B3xI")
# Kinds of control records.
KINDS = {"arm": 1, "disarm": 2, "set_self": 3, "register_ring": 4, "verdict": 5, "set_rules": 6}
_CODE_OF = {op: codes[2] for op, codes in OPS.items()}
_OP_OF = {code: op for op, code in _CODE_OF.items()}
_NAME_OF = {v: k for k, v in KINDS.items()}


class ControlError(ValueError):
    """A control record that is cut off or of an unknown kind."""


@dataclass(frozen=True)
class Control:
    """One command. ``number`` is a pid, a request or a size; ``wide`` a start time or a handle."""

    kind: str
    number: int = 0
    wide: int = 0
    op: str = ""
    deny: bool = False
    rules: bytes = b""


def encode(c: Control) -> bytes:
    if c.kind == "set_rules":
        return HEAD.pack(KINDS[c.kind], len(c.rules)) + c.rules
    code = _CODE_OF[c.op] if c.kind == "arm" else int(c.deny) if c.kind == "verdict" else 0
    return RECORD.pack(KINDS[c.kind], code, c.number, c.wide)


def decode(data: bytes) -> list[Control]:
    """All commands of a frame."""
    out, at = [], 0
    while at < len(data):
        kind = _NAME_OF.get(data[at])
        if kind is None:
            raise ControlError(f"unknown kind {data[at]}")
        if kind == "set_rules":
            end = at + HEAD.size
            size = HEAD.unpack_from(data, at)[1] if end <= len(data) else len(data)
            if end + size > len(data):
                raise ControlError("a rule set is cut off")
            out.append(Control(kind, rules=data[end : end + size]))
            at = end + size
            continue
        if at + RECORD.size > len(data):
            raise ControlError("a record is cut off")
        _, code, number, wide = RECORD.unpack_from(data, at)
        if kind == "arm" and code not in _OP_OF:
            raise ControlError(f"unknown operation {code}")
        out.append(Control(kind, number, wide, _OP_OF[code] if kind == "arm" else "", kind == "verdict" and bool(code)))
        at += RECORD.size
    return out


def control_records(commands: DataFrame) -> DataFrame:
    """``(actor, op)`` commands with ``record``; no ``op`` releases. Only processes can be armed: other actors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for actor, op in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pid, _, start = actor.removeprefix("proc:").partition(".")
                made.append(encode(Control("arm" if op else "disarm", int(pid), int(start or 0), op or "")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["actor", "op", "record"])

    rows = commands.where(F.col("actor").rlike(r"^proc:[0-9]+(\.[0-9]+)?$")).select(F.col("actor").cast("string"), F.col("op").cast("string"))
    return rows.mapInArrow(run, "actor string, op string, record binary")


def armed_only(events: DataFrame, arms: DataFrame) -> DataFrame:
    """Events whose actor is armed for their operation: ``arms(actor, op)``."""
    return events.join(arms.select("actor", "op").distinct(), ["actor", "op"], "left_semi")


def replies(outcomes: DataFrame) -> DataFrame:
    """``req_id, deny`` of the requests that wait for one: denied if any event of the request is."""
    return outcomes.where("reply").groupBy("req_id").agg(F.bool_or(F.col("decision") == "Deny").alias("deny"))
