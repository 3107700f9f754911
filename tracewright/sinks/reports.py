"""Reports over replayed events: printed lines and their level, engine logs, rebuilt chains, expected against actual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def short(identity: str) -> Column:
    """An identity as reports show it: a process bare, a file by its last part, others whole."""
    key = F.col(identity)
    last = F.regexp_extract(key, r"[^\\/]*$", 0)
    file = F.when(key.rlike(r"[\\/]"), F.concat(F.lit("file:"), last)).otherwise(key)
    return F.when(key.startswith("proc:"), F.substring(key, 6, 1 << 30)).when(key.startswith("file:"), file).otherwise(key)


def hint() -> Column:
    """The tag a record hints at before any rule has seen it."""
    return F.expr("case when type = 'process_open' and desired_access & 16 <> 0 then '[lsass? T1003]' when type = 'create' then '[exec]' when type = 'remote_thread' then '[inject]' else '' end")


def flags() -> tuple[Column, Column]:
    """Whether an event moved a pattern on, and whether it completed one, from its verdict."""
    return F.col("kind") != "None", F.col("reason").startswith("accepting") | F.col("reason").startswith("chokepoint")


def log_level() -> Column:
    moved, completed = flags()
    return F.when(completed | (F.col("decision") == "Deny"), "warn").when(moved, "info").otherwise("debug")


def outcome_lines(events: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``seq, level, line`` of ``events`` joined with their ``replay_scored`` verdicts."""
    rows = events.join(verdicts, "seq")
    said = F.when(F.col("kind") != "None", F.format_string("  [%s %s %.1f]", "kind", "pattern", "score")).otherwise("")
    line = F.concat(F.format_string("ts=%-10d %-7s %-20s -> %-20s ", "ts", "op", short("actor"), short("object")), F.upper("decision"), said)
    return rows.select("seq", log_level().alias("level"), line.alias("line"))


def chains(events: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The path that led to each denied event: ``component, block_seq, step, seq, ts, op, actor, object, kind``.

    ``events`` has ``component``, ``verdicts`` is ``replay_scored``'s. A chain holds the component's events up to the
    denied one that committed a step of its pattern (of any, where an armed storyline denies without one), and itself.
    A pattern has few steps, so a chain is short however many events a component has.
    """
    said = events.select("component", "seq", "ts", "op", "actor", "object").join(verdicts.where("commits <> '' or decision = 'Deny'").select("seq", "kind", "pattern", "decision", "commits"), "seq")
    at = F.struct("ts", "seq")
    denied = said.where("decision = 'Deny'").select("component", F.col("seq").alias("block_seq"), at.alias("_end"), F.col("pattern").alias("_pattern"))
    did = said.where("commits <> ''").withColumn("_of", F.explode(F.array_distinct(F.transform(F.split("commits", ","), lambda c: F.substring_index(c, ":", 1)))))
    near = did.join(denied, "component").where(at <= F.col("_end")).where("_pattern = '' or _of = _pattern").select("component", "block_seq", "seq", "ts", "op", "actor", "object", "kind")
    own = said.where("decision = 'Deny'").select("component", F.col("seq").alias("block_seq"), "seq", "ts", "op", "actor", "object", "kind")
    step = F.row_number().over(Window.partitionBy("component", "block_seq").orderBy("ts", "seq")) - 1
    return near.unionByName(own).distinct().withColumn("step", step).select("component", "block_seq", "step", "seq", "ts", "op", "actor", "object", "kind")


def against(expected: DataFrame, actual: DataFrame, column: str = "verdict") -> DataFrame:
    """``seq, expected, actual, ok``; rows that only one side has are not ok."""
    e, a = expected.select("seq", F.col(column).alias("expected")), actual.select("seq", F.col(column).alias("actual"))
    return e.join(a, "seq", "full").select("seq", "expected", "actual", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)).alias("ok"))
