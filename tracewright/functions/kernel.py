"""The kernel profile: how the host driver reads sensor records, as columns.

It maps operations otherwise than the service does (a process open stays ``open``, a listed folder is ``read``),
tags by substrings instead of whole names, and filters what would be noise before anything is recorded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, BooleanType

# Record type -> operation, in the kernel's reading; other types have none.
OPERATIONS = {"create": "exec", "process_open": "open", "remote_thread": "inject", "write": "write", "dir_read": "read"}
# Script hosts whose start is tagged, the right to read memory, and all rights that matter on a handle.
SCRIPT_HOSTS = ("powershell", "cmd.exe", "wscript", "cscript", "mshta")
VM_READ = 0x0010
SENSITIVE_ACCESS = 0x0001 | 0x0002 | 0x0008 | 0x0010 | 0x0020 | 0x0040 | 0x0080 | 0x0100 | 0x0200 | 0x0800 | 0x1000
WATCHED_SUFFIX = "\\lsass.exe"
MOST_TAGS = 16
#: Bytes of a written buffer that are judged, and the fewest that can be.
ENTROPY_SPAN, ENTROPY_LEAST = 4096, 256


def holds(column: str, *needles: str) -> Column:
    """Whether the text holds any of the needles, whatever their case; false for null."""
    text, out = F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(False)
    for n in needles:
        out = out | text.contains(n.lower())
    return out


def _catalogue() -> dict[int, tuple[str, Column]]:
    """Each tag with the operation it belongs to and its condition."""
    reads = F.coalesce(F.col("desired_access").bitwiseAND(VM_READ) != 0, F.lit(False))
    return {
        1059: ("exec", holds("image", *SCRIPT_HOSTS)),
        1490: ("exec", holds("image", "vssadmin") & holds("cmdline", "delete") & holds("cmdline", "shadow")),
        1003: ("open", reads & holds("target_image", "lsass")),
        1486: ("write", F.coalesce(F.col("high_entropy"), F.lit(False))),
        1083: ("read", F.coalesce(F.col("dir_enum"), F.lit(False))),
        1055: ("inject", F.lit(True)),
    }


def kernel_events(records: DataFrame, wanted: set[int] | None = None) -> DataFrame:
    """``ts, op, actor, object, ttps`` of sensor records, read as the kernel does; ``wanted`` keeps those tags only.

    ``high_entropy`` and ``dir_enum`` are flags of the record; absent columns count as false.
    """
    for flag in ("high_entropy", "dir_enum"):
        if flag not in records.columns:
            records = records.withColumn(flag, F.lit(False))
    process = lambda pid, start: F.concat_ws("", F.lit("proc:"), F.col(pid).cast("string"), F.lit("."), F.col(start).cast("string"))
    op = F.create_map(*[F.lit(x) for pair in OPERATIONS.items() for x in pair])[F.col("type")]
    target = F.when(F.col("type") == "create", process("child_pid", "child_start")).when(F.col("type").isin("process_open", "remote_thread"), process("target_pid", "target_start")).otherwise(F.concat(F.lit("file:"), "file_name"))
    rows = records.withColumn("op", op).where("op is not null")
    tags = [F.when((F.col("op") == on) & test, F.lit(tag)) for tag, (on, test) in _catalogue().items() if wanted is None or tag in wanted]
    found = F.slice(F.array_compact(F.array(*tags)), 1, MOST_TAGS) if tags else F.array().cast("array<int>")
    return rows.select("ts", "op", process("pid", "pid_start").alias("actor"), target.alias("object"), found.alias("ttps"))


def worth_recording(records: DataFrame, own_pid: int | None = None) -> DataFrame:
    """Handle openings only where a foreign process asks the watched image for a right that matters; no records of our own service."""
    opened = F.col("type") == "process_open"
    matters = (F.col("pid") != F.col("target_pid")) & (F.col("desired_access").bitwiseAND(SENSITIVE_ACCESS) != 0) & F.lower("target_image").endswith(WATCHED_SUFFIX)
    kept = records.where(~opened | F.coalesce(matters, F.lit(False)))
    return kept if own_pid is None else kept.where(F.col("pid") != own_pid)


@pandas_udf(BooleanType())
def high_entropy(buffers: pd.Series) -> pd.Series:
    """Whether a written buffer looks encrypted: two of its first bytes agree in under one of 64 cases; short or null ones don't."""
    out = []
    for data in buffers:
        data = (data or b"")[:ENTROPY_SPAN]
        counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.int64)
        out.append(len(data) >= ENTROPY_LEAST and int(counts @ counts) * 64 < len(data) ** 2)
    return pd.Series(out, dtype=bool)


# Start and factor of the two halves of a file's key, swapped in the second.
_HALF_A, _HALF_B = 1469598103934665603, 1099511628211


def file_key(name: str) -> int:
    """The 128-bit key of a file name: two 64-bit hashes of its UTF-16 bytes, the second one in the high half."""
    low, high = _HALF_A, _HALF_B
    for byte in name.encode("utf-16-le", "surrogatepass"):
        low = (low ^ byte) * _HALF_B % 2**64
        high = (high ^ byte) * _HALF_A % 2**64
    return high << 64 | low


def process_key(pid: int, start: int) -> int:
    return (start % 2**64) << 64 | pid


@pandas_udf(BinaryType())
def file_keys(names: pd.Series) -> pd.Series:
    """``file_key`` of a column, 16 bytes with the high half first: all names of a length are hashed side by side."""
    out = np.full(len(names), None, object)
    raw = [None if x is None else x.encode("utf-16-le", "surrogatepass") for x in names]
    by_size: dict[int, list[int]] = {}
    for i, x in enumerate(raw):
        if x is not None:
            by_size.setdefault(len(x), []).append(i)
    for size, rows in by_size.items():
        data = np.frombuffer(b"".join(raw[i] for i in rows), np.uint8).reshape(len(rows), size).astype(np.uint64)
        low, high = np.full(len(rows), _HALF_A, np.uint64), np.full(len(rows), _HALF_B, np.uint64)
        for k in range(size):
            low, high = (low ^ data[:, k]) * np.uint64(_HALF_B), (high ^ data[:, k]) * np.uint64(_HALF_A)
        for i, a, b in zip(rows, high.tolist(), low.tolist(), strict=True):
            out[i] = (a << 64 | b).to_bytes(16, "big")
    return pd.Series(out)


def key_of(high: Column, low: Column) -> Column:
    """16 bytes of two 64-bit halves, as ``process_key(pid, start)`` is of start and pid."""
    half = lambda x: F.lpad(F.hex(x.cast("long")), 16, "0")
    return F.unhex(F.concat(half(high), half(low)))
