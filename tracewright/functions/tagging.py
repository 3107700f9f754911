"""Tag conditions as columns, and the trailing rate of an actor's writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.plans.rules import USER_CONDITIONS, Tagger


def recovery_inhibit(cmd: str) -> bool:
    """A command that stops recovery: deleting shadow copies or a catalog, or shrinking their storage."""
    c = cmd.lower()
    return "delete" in c and ("shadow" in c or "catalog" in c) or "recoveryenabled no" in c or "resize" in c and "shadowstorage" in c


def base_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^\\/]*$", 0))


def rate_state(events: DataFrame, window_ms: int = 1000) -> DataFrame:
    """Events with ``write_rate`` and ``dir_spread``: of the actor's writes in the window that ends with its last write.

    The window includes both ends and only writes that came before in ``(ts, seq)`` order; on other operations
    both read as of the actor's last write. Both are running sums: a write counts from its event until it leaves
    the window, a folder from the first write of a run whose gaps fit the window until the run's last write
    leaves it. So the work grows with the sort alone, however many writes a window holds, and one shuffle by
    actor serves every step.
    """
    folder = Window.partitionBy("actor", "_dir").orderBy("ts", "seq")
    running = Window.partitionBy("actor").orderBy("_at", "_late", "seq").rowsBetween(Window.unboundedPreceding, 0)
    is_write = F.coalesce(F.col("op") == "write", F.lit(False))
    rows = events.repartition("actor").withColumn("_write", is_write.cast("int")).withColumn("_dir", F.when(is_write, F.coalesce("dir", F.lit("/"))))
    edge = lambda gap: F.when(F.coalesce(gap > window_ms, F.lit(True)), F.col("_write")).otherwise(0)
    rows = rows.withColumns({"_opens": edge(F.col("ts") - F.lag("ts").over(folder)), "_closes": edge(F.lead("ts").over(folder) - F.col("ts"))})
    mark = lambda at, late, rate, spread: F.struct(at.alias("_at"), F.lit(late).alias("_late"), rate.alias("_rate"), spread.alias("_spread"))
    comes = mark(F.col("ts"), 0, F.col("_write"), F.col("_opens"))
    goes = mark(F.col("ts") + window_ms, 1, -F.col("_write"), -F.col("_closes"))
    rows = rows.withColumn("_mark", F.explode(F.when(F.col("_write") == 1, F.array(comes, goes)).otherwise(F.array(comes)))).select("*", "_mark.*")
    now = F.struct(F.sum("_rate").over(running).alias("rate"), F.sum("_spread").over(running).alias("spread"))
    rows = rows.withColumn("_now", now)
    rows = rows.withColumn("_last", F.last(F.when((F.col("_write") == 1) & (F.col("_late") == 0), F.col("_now")), ignorenulls=True).over(running)).where("_late = 0")
    return rows.select(*events.columns, F.coalesce("_last.rate", F.lit(0)).alias("write_rate"), F.coalesce("_last.spread", F.lit(0)).alias("dir_spread"))


def condition(kind: str, arg: str) -> Column:
    """One tagger condition over ``op, attrs, write_rate, dir_spread``."""
    attr = lambda k: F.coalesce(F.col("attrs")[k], F.lit(""))
    cmd = F.lower(attr("cmd"))
    made = {
        "op": lambda: F.col("op").isin(*arg.split("|")), "image_base_in": lambda: base_name(attr("image")).isin(*[x.lower() for x in arg.split(",") if x]),
        "target_image_base": lambda: base_name(attr("target_image")) == arg.lower(), "attr_true": lambda: attr(arg).isin("1", "true"),
        "entropy_gt": lambda: F.coalesce(F.expr("try_cast(attrs['entropy'] as double)") > float(arg), F.lit(False)),
        "write_rate_ge": lambda: F.col("write_rate") >= int(arg), "dir_spread_ge": lambda: F.col("dir_spread") >= int(arg),
        "cmd_recovery_inhibit": lambda: (cmd.contains("delete") & (cmd.contains("shadow") | cmd.contains("catalog"))) | cmd.contains("recoveryenabled no") | (cmd.contains("resize") & cmd.contains("shadowstorage")),
    }
    return made[kind]() if kind in made else USER_CONDITIONS[kind][1](arg)


def tag_columns(events: DataFrame, taggers: list[Tagger], wanted: set[str] | None = None) -> DataFrame:
    """Events with ``tags`` in rule order; taggers whose tag no rule refers to are left out."""
    events = rate_state(events.withColumn("dir", F.col("attrs")["dir"])).drop("dir")
    made = []
    for t in taggers:
        if wanted is None or t.tag in wanted:
            test = F.lit(True)
            for kind, arg in t.conditions:
                test = test & condition(kind, arg)
            made.append(F.when(test, F.lit(t.tag)))
    return events.withColumn("tags", F.array_compact(F.array(*made)) if made else F.array().cast("array<string>"))
