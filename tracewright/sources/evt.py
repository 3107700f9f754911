"""The line format of events: ``key=value`` words with double quotes, one event a line, ``#`` comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PAIR = r'([^\s=]+)=("[^"]*"|[^\s"]*)'
_RESERVED = ("ts", "op", "actor", "object")


def identity(text):
    """Canonical identity of a column: ``pid.start`` is a process, ``kind:key`` anything else."""
    return F.when(text.contains(":"), text).otherwise(F.concat(F.lit("proc:"), text))


def parse(lines: DataFrame) -> DataFrame:
    """``seq, ts, op, actor, object, attrs`` of a ``value`` column; a line that lacks a key fails the query.

    The lines are checked by a filter, which stays whatever columns are asked for. With a ``line`` column (as of
    ``numbered``) the failure names the line. ``seq`` follows the order of lines within a file. The last of repeated keys counts.
    """
    rows = lines.withColumn("seq", F.monotonically_increasing_id()).withColumn("value", F.trim("value")).where("value <> '' and not startswith(value, '#')")
    keys = F.regexp_extract_all("value", F.lit(_PAIR), F.lit(1))
    values = F.transform(F.regexp_extract_all("value", F.lit(_PAIR), F.lit(2)), lambda v: F.regexp_replace(v, '^"|"$', ""))
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p.k))
    last = F.transform(names, lambda n: F.element_at(F.transform(F.filter("_pairs", lambda p: p.k == n), lambda p: p.v), -1))
    rows = rows.withColumn("_pairs", pairs).withColumn("_all", F.map_from_arrays(names, last))
    where = F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": ")) if "line" in lines.columns else F.lit("")
    lacks = F.filter(F.array(*map(F.lit, _RESERVED)), lambda k: ~F.map_contains_key("_all", k))
    fails = F.raise_error(F.concat(where, F.lit("no "), F.array_join(lacks, ", "), F.lit(" in: "), F.col("value"))).cast("boolean")
    rows = rows.where(F.when(F.size(lacks) == 0, F.lit(True)).otherwise(fails))
    for key in _RESERVED:
        rows = rows.withColumn(f"_{key}", F.col("_all")[key])
    attrs = F.map_filter("_all", lambda k, _: ~k.isin(*_RESERVED))
    return rows.select("seq", F.col("_ts").cast("long").alias("ts"), F.col("_op").alias("op"), identity(F.col("_actor")).alias("actor"), identity(F.col("_object")).alias("object"), attrs.alias("attrs"))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """``line, value`` of small files, whole in a cell each: scenarios and rule tests, whose errors should name lines."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return whole.withColumn("line", F.col("line") + 1)


def read_evt(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Events of ``.evt`` files; with ``lines`` errors name the line, at the price of whole files in memory."""
    return parse(numbered(spark, path) if lines else spark.read.text(path))
