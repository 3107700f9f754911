"""The event model: operations and their encodings, verdicts, and the projection of telemetry to events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# An operation's bit, call index, control code and wire number; delete and load have no bit or index.
OPS = {
    "exec": (1, 0, 1, 1), "create": (2, 1, 7, 7), "write": (4, 2, 3, 4), "read": (8, 3, 2, 3), "open": (16, 4, 5, 2),
    "connect": (32, 5, 6, 5), "inject": (64, 6, 4, 6), "dup": (128, 7, 10, 10), "delete": (None, None, 8, 8), "load": (None, None, 9, 9),
}
CAUSAL = ("exec", "inject", "create", "dup", "write")
OP_BITS = {op: codes[0] for op, codes in OPS.items() if codes[0]}
#: Verdicts of the linear and partial-order dialects, by rank; from ``block`` on the operation is denied.
VERDICTS = ("ignore", "inspect", "block", "disarm")
#: Verdicts of the scored dialect, by rank.
KINDS = ("None", "Suspect", "Alert", "Block")


def op_dimension(spark: SparkSession) -> DataFrame:
    rows = [(op, *codes, op in CAUSAL) for op, codes in OPS.items()]
    return spark.createDataFrame(rows, "op string, op_bit int, call_index int, control_code int, wire_code int, causal boolean")


def op_bit(op):
    """The bit of an operation's column; 0 for one without."""
    out = F.lit(0)
    for name, bit in OP_BITS.items():
        out = F.when(op == name, bit).otherwise(out)
    return out


def from_telemetry(rows: DataFrame) -> DataFrame:
    """``seq, ts_ms, actor, k, op, object, value`` of the test events, one operation an event type."""
    kinds = {"signup": "exec", "view": "read", "click": "open", "purchase": "write", "error": "inject"}
    op = F.expr("case event_type " + " ".join(f"when '{a}' then '{b}'" for a, b in kinds.items()) + " end")
    return rows.select(
        F.col("event_id").alias("seq"), F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("ts_ms"),
        F.col("user_id").alias("actor"), F.get_json_object("props", "$.k").cast("long").alias("k"), op.alias("op"), "value",
    ).withColumn("object", F.col("actor") * 1000 + F.col("k"))


def tagged(events: DataFrame) -> DataFrame:
    """Events with one flag for each technique of the demonstration rules."""
    return events.withColumns({
        "t1059": F.expr("op = 'exec' and k % 3 = 0"), "t1083": F.expr("op = 'read' and k % 2 = 0"),
        "t1490": F.expr("op = 'exec' and k % 5 = 0"), "t1486": F.expr("op = 'write' and value > 60"),
    })


def op_of_index(index):
    """The operation of a call index; null for one that has none, whose event is dropped."""
    out = F.lit(None).cast("string")
    for name, (_, at, _, _) in OPS.items():
        if at is not None:
            out = F.when(index == at, name).otherwise(out)
    return out
