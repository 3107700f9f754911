"""What stands around the engines in a stream: once-per-handle records, repeated deliveries, requests that wait for a verdict, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How long a request waits for its verdict; then it is allowed.
ANSWER_WITHIN = "1 second"


def once(records: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """The first record of each key (an open handle, or a host and sequence number) in a stream; state lives as long as ``late``.

    In a batch: one record a key, the earliest.
    """
    if records.isStreaming:
        return records.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(time))
    return records.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def answered(requests: DataFrame, verdicts: DataFrame, late: str = "1 second", within: str = ANSWER_WITHIN) -> DataFrame:
    """``req_id, asked_at, deny`` of ``requests(req_id, asked_at)`` and ``verdicts(req_id, answered_at, deny)``.

    A request whose verdict is missing, or comes after ``within``, is allowed; one is denied if any verdict in time
    denies. Requests of equal id and time are one, in a table as in a stream, where each leaves once the watermark
    has passed its time.
    """
    v = verdicts.select(F.col("req_id").alias("_id"), "answered_at", F.col("deny").alias("_deny"))
    if requests.isStreaming:
        requests, v = requests.withWatermark("asked_at", late), v.withWatermark("answered_at", late)
    near = F.expr(f"req_id = _id and answered_at >= asked_at and answered_at <= asked_at + interval {within}")
    joined = requests.join(v, near, "left")
    return joined.groupBy("req_id", "asked_at").agg(F.coalesce(F.max("_deny"), F.lit(False)).alias("deny"))


def missing(events: DataFrame, host: str = "host") -> DataFrame:
    """``host, after_seq, n``: the gaps in a host's sequence numbers, which repeated deliveries don't widen."""
    was = F.lag("seq").over(Window.partitionBy(host).orderBy("seq"))
    return events.select(host, "seq").withColumn("after_seq", was).where("seq - after_seq > 1").select(host, "after_seq", (F.col("seq") - F.col("after_seq") - 1).alias("n"))
