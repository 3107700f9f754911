"""Queries of what stands around the engine: golden replays, sources, control, reports, streams' batch forms; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.engine import BUILT_IN, Engine
from tracewright.functions.kernel import kernel_events, worth_recording
from tracewright.model import op_bit
from tracewright.plans.rules import compile_rules
from tracewright.queries import _DENY, _E, DAG, LINEAR, SEGMENT_MS, _chain, _commits, _steps, _ttps, arm_commands, events, tagged
from tracewright.sinks import control, reports
from tracewright.sources.reader import GOLDEN, read_events
from tracewright.streaming.flow import answered, missing, once

LSASS = BUILT_IN["credentials"][1]
#: How long a request of the demonstration waits: telemetry is spread over a month.
ANSWER = "12 hours"


def _golden(spark: SparkSession, name: str, rules: str) -> DataFrame:
    rows = read_events(spark, "golden", name)
    return reports.against(rows, Engine.of(rules, name).run(rows))


def golden_linear(spark, sf_dir):
    return _golden(spark, "linear", LINEAR)


def golden_dag(spark, sf_dir):
    return _golden(spark, "dag", DAG)


def demo_outcomes(spark, sf_dir):
    rows = read_events(spark, "demo")
    verdicts = Engine.of(LSASS, "scored").run(rows)
    return rows.join(verdicts, "seq").select("op", "actor", "object", "decision", "kind", F.round("score", 4).alias("score"), reports.log_level().alias("level"))


def demo_replies(spark, sf_dir):
    rows = read_events(spark, "demo")
    return control.replies(rows.select("seq", "req_id", "reply").join(Engine.of(LSASS, "scored").run(rows), "seq"))


def stress_edges(spark, sf_dir):
    return read_events(spark, "stress", "100000").groupBy("actor", "op").agg(F.count("*").alias("n"), F.count_distinct("object").alias("objects"))


def _records(spark, sf_dir) -> DataFrame:
    """The telemetry as sensor records: names and rights follow from ``k``."""
    e = events(spark, sf_dir)
    kinds = "case op when 'exec' then 'create' when 'open' then 'process_open' when 'write' then 'write' when 'read' then 'dir_read' else 'remote_thread' end"
    return e.select(
        "seq", F.expr(kinds).alias("type"), F.col("ts_ms").alias("ts"), F.col("actor").alias("pid"), F.lit(0).cast("long").alias("pid_start"), F.col("k").alias("child_pid"), F.lit(0).alias("child_start"),
        F.col("k").alias("target_pid"), F.lit(0).alias("target_start"), F.col("k").alias("desired_access"), F.concat(F.lit("F"), "k").alias("file_name"),
        F.expr("case k % 4 when 0 then 'C:\\\\Windows\\\\CMD.exe' when 1 then 'C:\\\\vssadmin.EXE' else 'C:\\\\other.exe' end").alias("image"),
        F.expr("if(k % 3 = 0, 'x DELETE Shadows', 'list')").alias("cmdline"), F.expr("if(k % 2 = 0, 'C:\\\\LSASS.exe', 'C:\\\\svc.exe')").alias("target_image"),
        F.expr("value > 60").alias("high_entropy"), F.expr("k % 2 = 0").alias("dir_enum"),
    )


def kernel_tags(spark, sf_dir):
    return kernel_events(_records(spark, sf_dir)).select("op", F.explode("ttps").alias("ttp")).groupBy("op", "ttp").agg(F.count("*").alias("n"))


def recorded_handles(spark, sf_dir):
    return worth_recording(_records(spark, sf_dir), own_pid=1).where("type = 'process_open'").select("seq", "pid", "target_pid", "desired_access")


def armed_events(spark, sf_dir):
    return control.armed_only(events(spark, sf_dir).select("seq", "actor", "op"), arm_commands(spark, sf_dir))


def trigger_index(spark, sf_dir):
    """Events joined to the steps their tags can trigger, by an equi-join on the tag; the index is as small as the rules."""
    steps = [(p.name, s.bit, s.ops, t) for p in compile_rules(DAG, True) for s in p.steps for t in s.tags]
    index = spark.createDataFrame(steps, "pattern string, bit int, ops int, ttp int")
    e = tagged(events(spark, sf_dir)).select("op", F.explode(_ttps()).alias("ttp"))
    hit = e.join(F.broadcast(index), "ttp").where(op_bit(F.col("op")).bitwiseAND(F.col("ops")) != 0)
    return hit.groupBy("pattern", "bit").agg(F.count("*").alias("n"))


def storyline_chains(spark, sf_dir):
    """The commits that led an actor to its last step, in order."""
    steps = _steps(spark, sf_dir)
    w = Window.partitionBy("actor")
    done = steps.withColumn("_last", F.max(F.when(F.col("bit") == 3, F.col("seq"))).over(w)).where("_last is not null")
    return done.select("actor", F.col("_last").alias("end_seq"), F.row_number().over(w.orderBy("ts_ms", "seq", "bit")).alias("step"), "seq", "bit")


def answered_requests(spark, sf_dir):
    """Writes as requests, an actor's later errors as verdicts with a limit: unanswered ones are allowed."""
    e = events(spark, sf_dir).withColumn("at", F.timestamp_millis("ts_ms"))
    asked = e.where("op = 'write'").select(F.col("actor").alias("req_id"), F.col("at").alias("asked_at"))
    given = e.where("op = 'inject'").select(F.col("actor").alias("req_id"), F.col("at").alias("answered_at"), F.expr("k % 2 = 0").alias("deny"))
    out = answered(asked, given, within=ANSWER)
    return out.groupBy("req_id").agg(F.count("*").alias("asked"), F.sum(F.col("deny").cast("int")).alias("denied"))


def first_per_handle(spark, sf_dir):
    e = events(spark, sf_dir).where("op = 'write'").select("object", "seq", "ts_ms")
    return once(e, ["object"], "seq")


def delivered_once(spark, sf_dir):
    e = events(spark, sf_dir).select("actor", "seq", "ts_ms", "op")
    return once(e.union(e.where("seq % 3 = 0")), ["actor", "seq"], "ts_ms")


def missing_numbers(spark, sf_dir):
    e = events(spark, sf_dir).where("op <> 'open'").select(F.lit("h").alias("_h"), "seq", F.expr("seq div 1000").alias("host"))
    return missing(e.union(e)).select("host", "after_seq", "n")


def counters(spark, sf_dir):
    e = _commits(spark, sf_dir, False)
    deny = F.coalesce(F.expr("seq > c3 and op in ('write','exec','create','inject','connect')"), F.lit(False))
    return e.agg(F.count("*").alias("events"), F.count_if(deny).alias("denies"), F.count_if(F.col("op") == "open").alias("state_only"))


def actor_objects_sketch(spark, sf_dir):
    """Whether a sketch's count of an operation's distinct objects is within 5 % of the exact one."""
    e = events(spark, sf_dir).groupBy("op").agg(F.approx_count_distinct("object", 0.01).alias("a"), F.count_distinct("object").alias("n"))
    return e.select("op", (F.abs(F.col("a") - F.col("n")) <= 0.05 * F.col("n")).alias("close"))


def short_names(spark, sf_dir):
    p = events(spark, sf_dir).select(F.expr("case k % 3 when 0 then concat('proc:', k, '.1') when 1 then concat('file:C:\\\\d\\\\f', k) else concat('sock:', k) end").alias("id"))
    return p.withColumn("short", reports.short("id")).groupBy("short").agg(F.count("*").alias("n"))


def gap_sessions(spark, sf_dir):
    """An actor's events cut where nothing happened for the segment window."""
    w = Window.partitionBy("actor").orderBy("ts_ms", "seq")
    e = events(spark, sf_dir).withColumn("_new", F.coalesce((F.col("ts_ms") - F.lag("ts_ms").over(w) > SEGMENT_MS).cast("int"), F.lit(1)))
    return e.withColumn("session", F.sum("_new").over(w)).groupBy("actor", "session").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


ALL = (
    golden_linear, golden_dag, demo_outcomes, demo_replies, stress_edges, kernel_tags, recorded_handles, armed_events, trigger_index, storyline_chains, answered_requests, first_per_handle,
    delivered_once, missing_numbers, counters, actor_objects_sketch, short_names, gap_sessions,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def _expected(name: str) -> str:
    rows = ", ".join(f"({i}, '{r[-1]}')" for i, r in enumerate(GOLDEN[name]))
    return f"SELECT CAST(seq AS BIGINT) AS seq, expected, expected AS actual, true AS ok FROM (VALUES {rows}) AS v(seq, expected)"


def oracle_sql() -> dict[str, str]:
    w, x = _E + " SELECT ", _chain(False) + " SELECT "
    hosts = "SELECT seq // 1000 AS host, seq, lag(seq) OVER (PARTITION BY seq // 1000 ORDER BY seq) AS after_seq FROM e WHERE op <> 'open'"
    return {
        "golden_linear": _expected("linear"),
        "golden_dag": _expected("dag"),
        "demo_outcomes": """SELECT * FROM (VALUES ('exec', 'proc:100.500', 'proc:800.2000', 'Allow', 'None', 0.0::DOUBLE, 'debug'),
  ('read', 'proc:800.2000', 'proc:50.900', 'Deny', 'Block', 7.4::DOUBLE, 'warn')) AS v(op, actor, object, decision, kind, score, level)""",
        "demo_replies": "SELECT CAST(1 AS BIGINT) AS req_id, true AS deny",
        "stress_edges": "SELECT 'proc:4321.500' AS actor, 'write' AS op, CAST(100000 AS BIGINT) AS n, CAST(100000 AS BIGINT) AS objects",
        "kernel_tags": w + """op, CAST(t AS INT) AS ttp, count(*) AS n FROM (
  SELECT op, unnest([CASE WHEN op = 'exec' AND k % 4 = 0 THEN 1059 END, CASE WHEN op = 'exec' AND k % 4 = 1 AND k % 3 = 0 THEN 1490 END, CASE WHEN op = 'open' AND k & 16 <> 0 AND k % 2 = 0 THEN 1003 END,
    CASE WHEN op = 'write' AND value > 60 THEN 1486 END, CASE WHEN op = 'read' AND k % 2 = 0 THEN 1083 END, CASE WHEN op = 'inject' THEN 1055 END]) AS t FROM e) WHERE t IS NOT NULL GROUP BY op, t""",
        "recorded_handles": w + "seq, actor AS pid, k AS target_pid, k AS desired_access FROM e WHERE op = 'open' AND actor <> k AND k & 8187 <> 0 AND k % 2 = 0 AND actor <> 1",
        "armed_events": x + "seq, actor, op FROM e JOIN m USING (actor) WHERE op = 'write' AND c1 IS NOT NULL AND c2 IS NOT NULL",
        "trigger_index": w + """'encrypt_any_order' AS pattern, CAST(bit AS INT) AS bit, count(*) AS n FROM (
  SELECT unnest([CASE WHEN t1059 THEN 0 END, CASE WHEN t1083 THEN 1 END, CASE WHEN t1490 THEN 2 END, CASE WHEN t1486 THEN 3 END]) AS bit FROM g) WHERE bit IS NOT NULL GROUP BY bit""",
        "storyline_chains": x + "actor, c3 AS end_seq, CAST(row_number() OVER (PARTITION BY actor ORDER BY ts_ms, seq, bit) AS INT) AS step, seq, CAST(bit AS INT) AS bit FROM s JOIN m USING (actor) WHERE c3 IS NOT NULL",
        "answered_requests": w + """req_id, count(*) AS asked, CAST(sum(deny) AS BIGINT) AS denied FROM (
  SELECT a.actor AS req_id, a.seq, max(CASE WHEN b.k % 2 = 0 THEN 1 ELSE 0 END) AS deny FROM e a LEFT JOIN e b ON a.actor = b.actor AND b.op = 'inject' AND b.ts_ms >= a.ts_ms AND b.ts_ms <= a.ts_ms + 43200000
  WHERE a.op = 'write' GROUP BY a.actor, a.seq) GROUP BY req_id""",
        "first_per_handle": w + "object, min(seq) AS seq, arg_min(ts_ms, seq) AS ts_ms FROM e WHERE op = 'write' GROUP BY object",
        "delivered_once": w + "actor, seq, ts_ms, op FROM e",
        "missing_numbers": w + f"host, after_seq, seq - after_seq - 1 AS n FROM ({hosts}) WHERE seq - after_seq > 1",
        "counters": x + f"count(*) AS events, count(*) FILTER ({_DENY}) AS denies, count(*) FILTER (op = 'open') AS state_only FROM e LEFT JOIN m USING (actor)",
        "actor_objects_sketch": w + "DISTINCT op, true AS close FROM e",
        "short_names": w + "CASE k % 3 WHEN 0 THEN k || '.1' WHEN 1 THEN 'file:f' || k ELSE 'sock:' || k END AS short, count(*) AS n FROM e GROUP BY short",
        "gap_sessions": w + f"""actor, session, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM (
  SELECT actor, ts_ms, CAST(sum(new) OVER (PARTITION BY actor ORDER BY ts_ms, seq) AS BIGINT) AS session FROM (
    SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY actor ORDER BY ts_ms, seq) <= {SEGMENT_MS} THEN 0 ELSE 1 END AS new FROM e)) GROUP BY actor, session""",
    }
