"""One way in for every kind of source, and the built-in ones: a demonstration, the golden replays, a stress stream."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.sinks.ship import from_messages
from tracewright.sources import frames
from tracewright.sources.evt import read_evt
from tracewright.sources.ring import read_rings

CORE = "seq long, ts long, op string, actor string, object string, ttps array<int>, verdict string"
# The golden replays with the verdict expected of each event.
GOLDEN = {
    "linear": (
        (1000, "exec", "P1", "P200", [1059], "inspect"), (1500, "read", "P200", "F1", [1083], "inspect"), (1650, "exec", "P50", "P80", [], "ignore"), (2000, "exec", "P200", "P300", [1490], "inspect"),
        (2200, "read", "P80", "F2", [], "ignore"), (2500, "write", "P200", "F3", [1486], "disarm"), (2600, "write", "P200", "F4", [1486], "block"), (2750, "exec", "P50", "P90", [], "ignore"),
    ),
    "dag": (
        (1000, "exec", "P1", "P200", [1059], "inspect"), (1500, "exec", "P50", "P80", [], "ignore"), (2000, "exec", "P200", "P300", [1490], "inspect"), (2200, "read", "P80", "F2", [], "ignore"),
        (2500, "read", "P200", "F1", [1083], "inspect"), (2800, "write", "P200", "F3", [1486], "disarm"), (2900, "write", "P200", "F4", [1486], "block"), (3000, "exec", "P50", "P90", [], "ignore"),
    ),
}


def golden(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(GOLDEN[name])], CORE)


def demo_frames(spark: SparkSession) -> DataFrame:
    """``seq, content``: one process dumps another's credentials; the last frame waits for a reply."""
    # The demonstration's times, processes and names.
    lsass, tool = r"C:\Windows\System32\lsass.exe", r"C:\Tools\mimikatz.exe"
    made = (
        frames.encode_frame([frames.encode_record(103, 10_000_000, 50, 9_000_000, image=lsass)]),
        frames.encode_frame([frames.encode_record(100, 20_000_000, 100, 5_000_000, child_pid=800, child_start=20_000_000, image=tool, cmdline="sekurlsa::logonpasswords")]),
        frames.encode_frame([frames.encode_record(102, 21_000_000, 800, 20_000_000, 1, target_pid=50, target_start=9_000_000, desired_access=0x10, target_image=lsass)], reply=True),
    )
    return spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(made)], "seq long, content binary")


def stress(spark: SparkSession, n: int) -> DataFrame:
    """``n`` writes of one process to ever new files, made where they are read."""
    made = spark.range(n)
    name = F.concat(F.lit("file:C:\\stress\\f"), F.col("id").cast("string"), F.lit(".tmp"))
    return made.select(F.col("id").alias("seq"), F.expr("(1000000 + id) div 10000").alias("ts"), F.lit("write").alias("op"), F.lit("proc:4321.500").alias("actor"), name.alias("object"), F.expr("cast(map() as map<string,string>)").alias("attrs"))


def _numbered(events: DataFrame) -> DataFrame:
    return events.withColumn("seq", F.monotonically_increasing_id())


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


KINDS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "evt": read_evt,
    "frames": lambda spark, path: _numbered(frames.normalise(frames.read_frames(spark, path))),
    "rings": lambda spark, path: _numbered(frames.normalise(frames.decode(read_rings(spark, path).orderBy("path", "frame").select("content")))),
    "messages": lambda spark, path: from_messages(_binary(spark, path)),
    "parquet": lambda spark, path: spark.read.parquet(path),
    "demo": lambda spark, _: _numbered(frames.normalise(frames.decode(demo_frames(spark).orderBy("seq").coalesce(1)))),
    "stress": lambda spark, n: stress(spark, int(n)),
    "golden": golden,
}


def read_events(spark: SparkSession, kind: str, path: str = "") -> DataFrame:
    """Events of a source: a path for ``evt, frames, rings, messages, parquet``, a count for ``stress``, a name for ``golden``."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of source {kind!r}; known are {', '.join(KINDS)}")
    return KINDS[kind](spark, path)


def stream_frames(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Events of sensor frame files as they are dropped into a folder; the checkpoint keeps what was read."""
    os.makedirs(folder, exist_ok=True) if "://" not in folder else None
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return frames.normalise(frames.decode(files))
