"""Queries of the event engine over the test telemetry, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions.tagging import rate_state
from tracewright.model import CAUSAL, from_telemetry, op_dimension, tagged
from tracewright.operators.graph import connected_components
from tracewright.operators.replay import edge_log, replay_bounded, replay_core, replay_scored
from tracewright.plans.rules import Meta, compile_rules, compile_scored, referenced_tags
from tracewright.storage import small

# The rules of the golden replays, with the techniques' metadata.
LINEAR = """
pattern encrypt_in_order
    step ops=exec ttps=T1059
    step ops=read ttps=T1083
    step ops=exec ttps=T1490
    step ops=write ttps=T1486 action=disarm(write,exec,create,inject,connect)
end
"""
DAG = """
pattern encrypt_any_order
    step bit=0 ops=exec ttps=T1059
    step bit=1 ops=read ttps=T1083 prereq=0
    step bit=2 ops=exec ttps=T1490 prereq=0
    step bit=3 ops=write ttps=T1486 prereq=1,2 action=disarm(write,exec,create,inject,connect)
end
"""
SCORED = """
ttp T1059 tactic=execution severity=3 rarity=0.10
ttp T1083 tactic=discovery severity=2 rarity=0.10
ttp T1490 tactic=defense_evasion severity=7 rarity=0.80
ttp T1486 tactic=impact severity=9 rarity=0.90
pattern encrypt scope=same_storyline theta_alert=6 theta_block=12
step start bit=0 match=ttp:T1059
step spoil bit=1 match=ttp:T1490 prereq=0 seg_window=864000000 enforceable
step look bit=2 match=ttp:T1083 prereq=0 seg_window=864000000
step encrypt bit=3 match=ttp:T1486 prereq=1,2 seg_window=864000000 enforceable block
"""
TAGS = (1059, 1083, 1490, 1486)
META = ((1059, "execution", 3.0, 0.10), (1083, "discovery", 2.0, 0.10), (1490, "defense_evasion", 7.0, 0.80), (1486, "impact", 9.0, 0.90))
#: The rate window that suits telemetry spread over a month: six hours.
WINDOW_MS = 6 * 3_600_000
SEGMENT_MS = 2 * 86_400_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_telemetry(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _ttps() -> F.Column:
    return F.array_compact(F.array(*[F.when(F.col(f"t{t}"), F.lit(t)) for t in TAGS]))


def _core_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tagged(events(spark, sf_dir)).withColumn("ttps", _ttps())
    return e.select("seq", F.col("ts_ms").alias("ts"), "op", F.concat(F.lit("proc:"), "actor").alias("actor"), F.concat(F.lit("file:"), "object").alias("object"), "ttps")


def normalize_events(spark, sf_dir):
    return events(spark, sf_dir).select("seq", "ts_ms", "actor", "k", "op", "object")


def op_dimension_join(spark, sf_dir):
    ops = op_dimension(spark).select("op", "op_bit", "wire_code", "causal")
    return events(spark, sf_dir).join(F.broadcast(ops), "op").groupBy("op", "op_bit", "wire_code", "causal").agg(F.count("*").alias("n"))


def tag_events(spark, sf_dir):
    return tagged(events(spark, sf_dir)).where("t1059 or t1083 or t1490 or t1486").select("seq", F.concat_ws(",", *[F.when(F.col(f"t{t}"), f"T{t}") for t in TAGS]).alias("tags"))


def rate_and_spread(spark, sf_dir):
    e = events(spark, sf_dir).select("seq", F.col("ts_ms").alias("ts"), F.col("actor").cast("string").alias("actor"), "op", F.pmod("k", F.lit(7)).cast("string").alias("dir"))
    return rate_state(e, WINDOW_MS).select("seq", F.col("write_rate").cast("long").alias("write_rate"), F.col("dir_spread").cast("long").alias("dir_spread"))


def _commits(spark, sf_dir, linear: bool) -> DataFrame:
    """Events of each actor with the first commit of every step: one shuffle, chained windows over it."""
    w = Window.partitionBy("actor")
    e = tagged(events(spark, sf_dir))
    first = lambda flag, after=None: F.min(F.when(F.expr(flag) & (after if after is not None else F.lit(True)), F.col("seq"))).over(w)
    e = e.withColumn("c0", first("t1059")).withColumn("c1", first("t1083", F.col("seq") > F.col("c0")))
    e = e.withColumn("c2", first("t1490", F.col("seq") > F.col("c1") if linear else F.col("seq") >= F.col("c0")))
    return e.withColumn("c3", first("t1486", F.col("seq") > (F.col("c2") if linear else F.when(F.col("c1").isNotNull() & F.col("c2").isNotNull(), F.greatest("c1", "c2")))))


def _per_actor(e: DataFrame) -> DataFrame:
    return e.groupBy("actor").agg(*[F.max(c).alias(c) for c in ("c0", "c1", "c2", "c3")]).where("c0 is not null")


def linear_first_match(spark, sf_dir):
    return _per_actor(_commits(spark, sf_dir, True))


def dag_first_match(spark, sf_dir):
    return _per_actor(_commits(spark, sf_dir, False))


def seg_window_match(spark, sf_dir):
    """Each start with the next look of its actor, if that lies within the segment window: one ordered pass, no pairs."""
    after = Window.partitionBy("actor").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    e = tagged(events(spark, sf_dir)).where("t1059 or t1083").select("actor", "seq", "ts_ms", "t1059", F.when(F.col("t1083"), F.struct("seq", "ts_ms")).alias("look"))
    # input is in order of time, so a look after the next one can't be nearer
    near = e.withColumn("next", F.first("look", ignorenulls=True).over(after)).where(f"t1059 and next.ts_ms - ts_ms <= {SEGMENT_MS}")
    return near.select("actor", F.col("seq").alias("first_seq"), F.col("next.seq").alias("next_seq"))


def binding_match(spark, sf_dir):
    """Each start of an object with the last write to it before: an as-of join as one ordered pass."""
    before = Window.partitionBy("object").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    e = events(spark, sf_dir).where("op in ('write', 'exec')").select("object", "seq", "op", F.when(F.col("op") == "write", F.col("seq")).alias("write_seq"))
    last = e.withColumn("write_seq", F.last("write_seq", ignorenulls=True).over(before))
    return last.where("op = 'exec' and write_seq is not null").select("object", F.col("seq").alias("exec_seq"), "write_seq")


GATED = "('write','exec','create','inject','connect')"


def disarm_gate(spark, sf_dir):
    return _commits(spark, sf_dir, False).where(f"seq > c3 and op in {GATED}").select("seq", "actor", "op", F.col("c3").alias("disarm_seq"))


def event_verdict(spark, sf_dir):
    rank = F.expr(f"case when seq > c3 and op in {GATED} then 2 when seq = c3 then 3 when seq in (c0, c1, c2) then 1 else 0 end")
    return _commits(spark, sf_dir, False).withColumn("rank", F.coalesce(rank, F.lit(0))).groupBy("actor").agg(F.max("rank").alias("verdict_rank"), F.sum(F.expr("int(rank = 2)")).alias("blocked"), F.sum(F.expr("int(rank = 1)")).alias("inspected"))


def _steps(spark, sf_dir) -> DataFrame:
    e = _commits(spark, sf_dir, False).where("seq in (c0, c1, c2, c3)")
    bits = F.explode(F.expr("filter(array(if(seq = c0, 0, null), if(seq = c1, 1, null), if(seq = c2, 2, null), if(seq = c3, 3, null)), x -> x is not null)"))
    return e.select("actor", "ts_ms", "seq", bits.alias("bit"))


def order_bonus(spark, sf_dir):
    steps = F.array_sort(F.collect_list(F.struct("ts_ms", "bit")))
    e = _steps(spark, sf_dir).groupBy("actor").agg(steps.alias("s"))
    rising = F.expr("aggregate(sequence(0, size(s) - 1), 0, (n, i) -> n + if(i > 0 and s[i].bit > s[if(i > 0, i - 1, 0)].bit, 1, 0))")
    return e.select("actor", F.when(F.size("s") > 1, F.round(rising / (F.size("s") - 1), 6)).otherwise(F.lit(1.0)).alias("order_bonus"))


def kill_chain_score(spark, sf_dir):
    meta = spark.createDataFrame([(i, m[1], m[2], m[3]) for i, m in enumerate(META)], "bit int, tactic string, severity double, rarity double")
    default = Meta()  # of a step whose tag has no metadata
    known = _steps(spark, sf_dir).join(F.broadcast(meta), "bit", "left").fillna({"tactic": default.tactic, "severity": default.severity, "rarity": default.rarity})
    parts = known.groupBy("actor").agg(F.count_distinct("tactic").alias("stages"), F.sum("severity").alias("severity"), F.sum("rarity").alias("rarity"))
    score = F.round(2 * F.col("stages") + 0.3 * F.col("severity") + F.col("order_bonus") + 2 * F.col("rarity"), 6)
    return parts.join(order_bonus(spark, sf_dir), "actor").select("actor", "stages", score.alias("score"))


def provenance_edges(spark, sf_dir):
    return events(spark, sf_dir).groupBy("actor", "object", "op").agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count("*").alias("n"))


def causal_links(spark, sf_dir, target: str = "object") -> DataFrame:
    """An edge for every causal event, from its actor to what it touched: its object, or ``k``, which actors share."""
    e = events(spark, sf_dir).where(F.col("op").isin(*CAUSAL))
    return e.select(F.concat(F.lit("proc:"), "actor").alias("src"), F.concat(F.lit("file:"), target).alias("dst"))


def storyline_components(spark, sf_dir):
    """Storylines over all causal events and their own objects."""
    return connected_components(causal_links(spark, sf_dir))


def storyline_size_topk(spark, sf_dir):
    return _largest(storyline_components(spark, sf_dir))


def _largest(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("members")).orderBy(F.desc("members"), "component").limit(10)


def shared_components(spark, sf_dir):
    """Storylines over all causal events where actors meet in a target: these may be as large as the input."""
    return connected_components(causal_links(spark, sf_dir, "k"))


def shared_size_topk(spark, sf_dir):
    return _largest(shared_components(spark, sf_dir))


def referenced_ttps(spark, sf_dir):
    return spark.createDataFrame([(t,) for t in referenced_tags(compile_rules(DAG, True))], "ttp int")


def tagger_prune(spark, sf_dir):
    wanted = referenced_ttps(spark, sf_dir)
    e = tagged(events(spark, sf_dir)).select(F.explode(_ttps()).alias("ttp"))
    return e.join(small(wanted), "ttp", "left_semi").groupBy("ttp").agg(F.count("*").alias("n"))


def arm_commands(spark, sf_dir):
    c = _per_actor(_commits(spark, sf_dir, False))
    return c.where("c1 is not null and c2 is not null").select("actor", F.greatest("c1", "c2").alias("armed_at"), F.lit("write").alias("op"))


def batch_deny(spark, sf_dir):
    e = _commits(spark, sf_dir, False).withColumn("deny", F.coalesce(F.expr(f"seq > c3 and op in {GATED}"), F.lit(False)))
    return e.groupBy(F.expr("seq div 100").alias("batch")).agg(F.bool_or("deny").alias("deny"), F.sum(F.expr("int(deny)")).alias("denies"))


def rarity_baseline(spark, sf_dir):
    e = tagged(events(spark, sf_dir)).select("actor", F.explode(_ttps()).alias("ttp")).distinct()
    return e.groupBy("ttp").agg(F.count("*").alias("actors")).withColumn("rarity", F.round(1 / F.col("actors"), 6))


def sequence_gaps(spark, sf_dir):
    w = Window.partitionBy("actor").orderBy("ts_ms", "seq")
    e = events(spark, sf_dir).select("actor", "seq", "ts_ms", (F.col("ts_ms") - F.lag("ts_ms").over(w)).alias("gap_ms"))
    return e.where(f"gap_ms > {SEGMENT_MS}").select("actor", "seq", "gap_ms")


def linear_replay(spark, sf_dir):
    return replay_core(_core_events(spark, sf_dir), compile_rules(LINEAR, False), False).select("seq", "verdict")


def dag_replay(spark, sf_dir):
    return replay_core(_core_events(spark, sf_dir), compile_rules(DAG, True), True).select("seq", "verdict")


def dag_edges(spark, sf_dir):
    """The edge log of the partial-order replay: every event that wasn't stopped."""
    rows = _core_events(spark, sf_dir)
    return edge_log(rows, replay_core(rows, compile_rules(DAG, True), True))


def shared_replay(spark, sf_dir):
    """The partial-order replay where actors meet in what they touch, so that storylines merge all the time."""
    rows = _core_events(spark, sf_dir).drop("object").join(events(spark, sf_dir).select("seq", F.concat(F.lit("file:"), "k").alias("object")), "seq")
    return replay_core(rows, compile_rules(DAG, True), True).select("seq", "verdict")


def bounded_replay(spark, sf_dir):
    e = _core_events(spark, sf_dir).withColumn("host", F.pmod(F.xxhash64("actor"), F.lit(16)).cast("string"))
    return replay_bounded(e, compile_rules(DAG, True))


def scored_replay(spark, sf_dir):
    e = _core_events(spark, sf_dir).withColumn("tags", F.transform("ttps", lambda t: F.concat(F.lit("T"), t))).withColumn("attrs", F.lit(None).cast("map<string,string>"))
    return replay_scored(e.drop("ttps"), compile_scored(SCORED))


def replay_verdicts(spark, sf_dir):
    return dag_replay(spark, sf_dir).join(events(spark, sf_dir).select("seq", "actor"), "seq").groupBy("actor").agg(F.sum(F.expr("int(verdict = 'block')")).alias("blocked"), F.sum(F.expr("int(verdict = 'disarm')")).alias("disarmed"))


ALL = (
    normalize_events, op_dimension_join, tag_events, rate_and_spread, linear_first_match, dag_first_match, seg_window_match, binding_match, disarm_gate, event_verdict, order_bonus,
    kill_chain_score, provenance_edges, storyline_components, storyline_size_topk, shared_components, shared_size_topk, referenced_ttps, tagger_prune, arm_commands, batch_deny, rarity_baseline, sequence_gaps,
    linear_replay, dag_replay, dag_edges, shared_replay, bounded_replay, scored_replay, replay_verdicts,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


_E = """WITH RECURSIVE e AS (
  SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, user_id AS actor, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value,
    CASE event_type WHEN 'signup' THEN 'exec' WHEN 'view' THEN 'read' WHEN 'click' THEN 'open' WHEN 'purchase' THEN 'write' WHEN 'error' THEN 'inject' END AS op,
    user_id * 1000 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS object FROM events),
g AS (SELECT *, op = 'exec' AND k % 3 = 0 AS t1059, op = 'read' AND k % 2 = 0 AS t1083, op = 'exec' AND k % 5 = 0 AS t1490, op = 'write' AND value > 60 AS t1486 FROM e)"""


def _chain(linear: bool) -> str:
    after2, after3 = ("g.seq > c1", "g.seq > c2") if linear else ("g.seq >= c0", "g.seq > greatest(c1, c2) AND c1 IS NOT NULL AND c2 IS NOT NULL")
    return _E + f""",
p0 AS (SELECT actor, min(seq) AS c0 FROM g WHERE t1059 GROUP BY actor),
p1 AS (SELECT p0.actor, c0, min(g.seq) FILTER (t1083 AND g.seq > c0) AS c1 FROM p0 JOIN g USING (actor) GROUP BY ALL),
p2 AS (SELECT p1.actor, c0, c1, min(g.seq) FILTER (t1490 AND {after2}) AS c2 FROM p1 JOIN g USING (actor) GROUP BY ALL),
m AS (SELECT p2.actor, c0, c1, c2, min(g.seq) FILTER (t1486 AND {after3}) AS c3 FROM p2 JOIN g USING (actor) GROUP BY ALL),
s AS (SELECT actor, u.bit, u.seq, e.ts_ms FROM (
  SELECT actor, 0 AS bit, c0 AS seq FROM m UNION ALL SELECT actor, 1, c1 FROM m UNION ALL SELECT actor, 2, c2 FROM m UNION ALL SELECT actor, 3, c3 FROM m) u JOIN e USING (actor, seq)),
o AS (SELECT actor, CASE WHEN count(*) > 1 THEN round(sum(CASE WHEN bit > was THEN 1 ELSE 0 END) / (count(*) - 1), 6) ELSE 1.0 END::DOUBLE AS order_bonus FROM (
  SELECT actor, bit, lag(bit) OVER (PARTITION BY actor ORDER BY ts_ms, bit) AS was FROM s) GROUP BY actor)"""


def components_sql(links: str) -> str:
    """``cc(node, component)`` over ``links``, a query of ``a, b``: least labels spread along edges until none falls."""
    return _E + f""",
l AS ({links}),
z AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
cc(node, component) USING KEY (node) AS (
  SELECT a, least(a, min(b)) FROM z GROUP BY a
  UNION
  SELECT z.a, min(cc.component) FROM cc JOIN z ON z.b = cc.node JOIN recurring.cc AS old ON old.node = z.a GROUP BY z.a, old.component HAVING min(cc.component) < old.component)"""


def causal_sql(target: str) -> str:
    return f"SELECT DISTINCT 'proc:' || actor AS a, 'file:' || {target} AS b FROM e WHERE op IN ('exec','inject','create','dup','write') AND actor IS NOT NULL AND {target} IS NOT NULL"


_DENY = f"coalesce(seq > c3 AND op IN {GATED}, false)"


def _verdicts(linear: bool) -> str:
    """Every event's verdict in closed form, where an actor's storyline is its own.

    A start always counts; any other step counts if something has come to the step before it since the last event
    of its own kind, which took all there was along. Once the last step has disarmed, gated events are stopped.
    """
    last = lambda test, rows: f"max(CASE WHEN {test} THEN seq END) OVER (PARTITION BY actor ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND {rows})"
    spoils = f"t1490 AND coalesce({'look_done' if linear else 'start_now'} > coalesce(spoil_was, -1), false)"
    return _chain(linear) + f""",
v0 AS (SELECT g.seq, g.actor, g.op, c3, {_DENY} AS stopped, t1059 AND NOT {_DENY} AS t1059, t1083, t1490 AND NOT {_DENY} AS t1490 FROM g LEFT JOIN m USING (actor)),
v1 AS (SELECT *, {last('t1059', 'CURRENT ROW')} AS start_now, {last('t1083', '1 PRECEDING')} AS look_was, {last('t1490', '1 PRECEDING')} AS spoil_was FROM v0),
v2 AS (SELECT *, t1083 AND coalesce(start_now > coalesce(look_was, -1), false) AS looks FROM v1),
v3 AS (SELECT *, {last('looks', '1 PRECEDING')} AS look_done FROM v2),
v AS (SELECT seq, actor, CASE WHEN stopped THEN 'block' WHEN seq = c3 THEN 'disarm' WHEN t1059 OR looks OR {spoils} THEN 'inspect' ELSE 'ignore' END AS verdict, NOT stopped AS edge FROM v3)"""


def oracle_sql() -> dict[str, str]:
    w, x = _E + " SELECT ", _chain(False) + " SELECT "
    return {
        "normalize_events": w + "seq, ts_ms, actor, k, op, object FROM e",
        "op_dimension_join": w + """op, CAST(v[1] AS INT) AS op_bit, CAST(v[2] AS INT) AS wire_code, op IN ('exec','inject','create','dup','write') AS causal, n FROM (
  SELECT op, CASE op WHEN 'exec' THEN [1,1] WHEN 'read' THEN [8,3] WHEN 'open' THEN [16,2] WHEN 'write' THEN [4,4] ELSE [64,6] END AS v, count(*) AS n FROM e GROUP BY op)""",
        "tag_events": w + "seq, concat_ws(',', CASE WHEN t1059 THEN 'T1059' END, CASE WHEN t1083 THEN 'T1083' END, CASE WHEN t1490 THEN 'T1490' END, CASE WHEN t1486 THEN 'T1486' END) AS tags FROM g WHERE t1059 OR t1083 OR t1490 OR t1486",
        "rate_and_spread": _E + f""",
wr AS (SELECT a.seq, a.actor, count(*) AS rate, count(DISTINCT b.k % 7) AS spread FROM e a JOIN e b ON a.actor = b.actor AND a.op = 'write' AND b.op = 'write'
  AND b.ts_ms >= a.ts_ms - {WINDOW_MS} AND (b.ts_ms < a.ts_ms OR b.ts_ms = a.ts_ms AND b.seq <= a.seq) GROUP BY a.seq, a.actor)
SELECT e.seq, coalesce(last_value(wr.rate IGNORE NULLS) OVER h, 0)::BIGINT AS write_rate, coalesce(last_value(wr.spread IGNORE NULLS) OVER h, 0)::BIGINT AS dir_spread
FROM e LEFT JOIN wr USING (seq) WINDOW h AS (PARTITION BY e.actor ORDER BY e.ts_ms, e.seq ROWS UNBOUNDED PRECEDING)""",
        "linear_first_match": _chain(True) + " SELECT actor, c0, c1, c2, c3 FROM m",
        "dag_first_match": x + "actor, c0, c1, c2, c3 FROM m",
        "seg_window_match": w + f"a.actor, a.seq AS first_seq, min(b.seq) AS next_seq FROM g a JOIN g b ON a.actor = b.actor AND a.t1059 AND b.t1083 AND b.seq > a.seq AND b.ts_ms - a.ts_ms <= {SEGMENT_MS} GROUP BY ALL",
        "binding_match": w + "x.object, x.seq AS exec_seq, max(y.seq) AS write_seq FROM e x JOIN e y ON x.object = y.object AND x.op = 'exec' AND y.op = 'write' AND y.seq < x.seq GROUP BY ALL",
        "disarm_gate": x + f"seq, actor, op, c3 AS disarm_seq FROM e JOIN m USING (actor) WHERE seq > c3 AND op IN {GATED}",
        "event_verdict": x + f"""actor, CAST(max(r) AS INT) AS verdict_rank, CAST(sum(CASE WHEN r = 2 THEN 1 ELSE 0 END) AS BIGINT) AS blocked, CAST(sum(CASE WHEN r = 1 THEN 1 ELSE 0 END) AS BIGINT) AS inspected FROM (
  SELECT actor, CASE WHEN {_DENY} THEN 2 WHEN seq = c3 THEN 3 WHEN seq = c0 OR seq = c1 OR seq = c2 THEN 1 ELSE 0 END AS r FROM e LEFT JOIN m USING (actor)) GROUP BY actor""",
        "order_bonus": x + "actor, order_bonus FROM o",
        "kill_chain_score": x + """actor, count(*) AS stages, round(2 * count(*) + 0.3 * sum(sev) + max(order_bonus) + 2 * sum(rar), 6)::DOUBLE AS score FROM (
  SELECT actor, CASE bit WHEN 0 THEN 3.0 WHEN 1 THEN 2.0 WHEN 2 THEN 7.0 ELSE 9.0 END AS sev, CASE bit WHEN 0 THEN 0.1 WHEN 1 THEN 0.1 WHEN 2 THEN 0.8 ELSE 0.9 END AS rar FROM s) JOIN o USING (actor) GROUP BY actor""",
        "provenance_edges": w + "actor, object, op, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS n FROM e GROUP BY ALL",
        "storyline_components": components_sql(causal_sql("object")) + " SELECT node, component FROM cc",
        "storyline_size_topk": components_sql(causal_sql("object")) + " SELECT component, count(*) AS members FROM cc GROUP BY component ORDER BY members DESC, component LIMIT 10",
        "shared_components": components_sql(causal_sql("k")) + " SELECT node, component FROM cc",
        "shared_size_topk": components_sql(causal_sql("k")) + " SELECT component, count(*) AS members FROM cc GROUP BY component ORDER BY members DESC, component LIMIT 10",
        "referenced_ttps": "SELECT CAST(t AS INT) AS ttp FROM (VALUES (1059), (1083), (1486), (1490)) AS v(t)",
        "tagger_prune": w + "CAST(1059 AS INT) AS ttp, count(*) AS n FROM g WHERE t1059 UNION ALL SELECT 1083, count(*) FROM g WHERE t1083 UNION ALL SELECT 1490, count(*) FROM g WHERE t1490 UNION ALL SELECT 1486, count(*) FROM g WHERE t1486",
        "arm_commands": x + "actor, greatest(c1, c2) AS armed_at, 'write' AS op FROM m WHERE c1 IS NOT NULL AND c2 IS NOT NULL",
        "batch_deny": x + f"seq // 100 AS batch, bool_or({_DENY}) AS deny, CAST(sum(CASE WHEN {_DENY} THEN 1 ELSE 0 END) AS BIGINT) AS denies FROM e LEFT JOIN m USING (actor) GROUP BY batch",
        "rarity_baseline": w + """CAST(ttp AS INT) AS ttp, count(DISTINCT actor) AS actors, round(1 / count(DISTINCT actor), 6)::DOUBLE AS rarity FROM (
  SELECT actor, 1059 AS ttp FROM g WHERE t1059 UNION ALL SELECT actor, 1083 FROM g WHERE t1083 UNION ALL SELECT actor, 1490 FROM g WHERE t1490 UNION ALL SELECT actor, 1486 FROM g WHERE t1486) GROUP BY ttp""",
        "linear_replay": _verdicts(True) + " SELECT seq, verdict FROM v",
        "dag_replay": _verdicts(False) + " SELECT seq, verdict FROM v",
        "dag_edges": _verdicts(False) + " SELECT seq, ts_ms AS ts, op, 'proc:' || actor AS actor, 'file:' || object AS object FROM v JOIN e USING (seq, actor) WHERE edge",
        "replay_verdicts": _verdicts(False) + " SELECT actor, CAST(count(*) FILTER (verdict = 'block') AS BIGINT) AS blocked, CAST(count(*) FILTER (verdict = 'disarm') AS BIGINT) AS disarmed FROM v GROUP BY actor",
        "sequence_gaps": w + f"actor, seq, gap_ms FROM (SELECT actor, seq, ts_ms - lag(ts_ms) OVER (PARTITION BY actor ORDER BY ts_ms, seq) AS gap_ms FROM e) WHERE gap_ms > {SEGMENT_MS}",
    }
