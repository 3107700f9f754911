"""Queries of labelled rules and of what an endpoint keeps, ships and enforces; and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.engine import Engine
from tracewright.operators import retention
from tracewright.queries import _E, GATED, META, _chain, _commits, _core_events, _per_actor, _steps, arm_commands, causal_links, causal_sql, components_sql, events, kill_chain_score

LABELLED = """
pattern encrypt_any_order
    step start = exec & ttp T1059
    step look = read & ttp T1083 after start
    step spoil = exec & ttp T1490 after start
    step encrypt = write & ttp T1486 after look & spoil -> disarm write,exec,create,inject,connect
end
"""
DROPPER = """
pattern run_what_was_written
    step drop = write & ttp T1486
    step seen = read & ttp T1083 & object=drop:object
    step run = exec & object=drop:object after drop unless seen -> block
end
"""
HOUR = 3_600_000
ALERT = 12.0
#: Targets that more actors than this touch, and actors that touch more targets, are hubs.
HUB = 38


def labelled_denies(spark, sf_dir):
    return Engine.of(LABELLED, "labelled").run(_core_events(spark, sf_dir)).where("verdict in ('block', 'disarm')")


def labelled_bindings(spark, sf_dir):
    return Engine.of(DROPPER, "labelled").run(_core_events(spark, sf_dir)).where("verdict = 'block'").select("seq")


def storyline_tiers(spark, sf_dir):
    rarity = spark.createDataFrame([(i, m[3]) for i, m in enumerate(META)], "bit int, rarity double")
    steps = _steps(spark, sf_dir).join(F.broadcast(rarity), "bit").groupBy("actor").agg(F.count("*").alias("steps"), F.max("rarity").alias("rarity"))
    armed = arm_commands(spark, sf_dir).select("actor", F.lit(True).alias("armed"))
    rows = steps.join(kill_chain_score(spark, sf_dir).select("actor", "score"), "actor").join(armed, "actor", "left").withColumn("bound", F.lit(False))
    return rows.select("actor", retention.tier(alert=ALERT).alias("tier"))


def step_sketches(spark, sf_dir):
    """Sketches taken of two halves of a storyline's steps, put together again."""
    s = _steps(spark, sf_dir).select("actor", "bit", F.col("ts_ms").alias("ts"))
    halves = retention.sketches(s.where("bit % 2 = 0"), ["actor"]).unionByName(retention.sketches(s.where("bit % 2 = 1"), ["actor"]))
    return retention.rehydrated(halves, ["actor"]).select("actor", "done", F.size("step_ts").alias("steps"), "last_ts")


def working_set(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("ts_ms").alias("ts"), F.concat(F.lit("p"), "actor").alias("actor"), F.concat(F.lit("f"), "object").alias("object"))
    pins = _per_actor(_commits(spark, sf_dir, False)).where("c3 is null").select(F.concat(F.lit("p"), "actor").alias("identity"))
    return retention.working_set(e, pins, 24 * HOUR)


def node_budget(spark, sf_dir):
    nodes = events(spark, sf_dir).groupBy(F.expr("actor % 10").alias("root"), F.col("object").alias("identity")).agg(F.max("ts_ms").alias("last_ms"))
    return retention.within_budget(nodes, "root", "last_ms", 50).select("identity", "evicted")


def hub_components(spark, sf_dir):
    """The hub split of all causal events, over targets that actors share."""
    return retention.hub_split(causal_links(spark, sf_dir, "k"), HUB)[0]


def hub_links(spark, sf_dir):
    return retention.hub_split(causal_links(spark, sf_dir, "k"), HUB)[1]


def ship_order(spark, sf_dir):
    e = events(spark, sf_dir).select("seq", F.expr("actor % 8").alias("host"), F.expr("int(k % 4)").alias("tier"), F.expr("seq div 1000").alias("batch"))
    return retention.shipped(e, 700, "batch").select("seq", F.col("number").cast("long").alias("number"), F.col("place").cast("long").alias("place"), "dropped")


def _directives(spark, sf_dir) -> DataFrame:
    """Opened objects as leases on reading them; a low value ends one."""
    e = events(spark, sf_dir).where("op = 'open'")
    return e.select(F.col("seq").alias("number"), F.col("ts_ms").alias("ts"), F.col("object").alias("identity"), F.lit("read").alias("op"), F.expr(f"if(value < 20, 0, {200 * HOUR})").alias("ttl"), F.expr("actor % 8").alias("host"))


def leased_reads(spark, sf_dir):
    reads = events(spark, sf_dir).where("op = 'read'").select("seq", F.col("ts_ms").alias("ts"), "op", "object")
    return retention.leased(reads, _directives(spark, sf_dir).drop("host"))


def live_leases(spark, sf_dir):
    d = _directives(spark, sf_dir)
    now = d.agg(F.max("ts")).first()[0] or 0
    return retention.live_leases(d, now, 5).select("host", "identity", "until", "refused")


ALL = (labelled_denies, labelled_bindings, storyline_tiers, step_sketches, working_set, node_budget, hub_components, hub_links, ship_order, leased_reads, live_leases)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    w, x = _E + " SELECT ", _chain(False)
    split = causal_sql("k").replace("SELECT DISTINCT", "SELECT", 1)
    hubs = f"p AS (SELECT DISTINCT a AS src, b AS dst FROM ({split})), n AS (SELECT src AS x, dst AS y FROM p UNION SELECT dst, src FROM p), h AS (SELECT x FROM n GROUP BY x HAVING count(*) > {HUB})"
    calm = components_sql("SELECT src AS a, dst AS b FROM p WHERE src NOT IN (FROM h) AND dst NOT IN (FROM h) UNION ALL SELECT x, x FROM n").replace(",\nl AS", f",\n{hubs},\nl AS", 1)
    leases = f"d AS (SELECT seq, ts_ms, object, actor % 8 AS host, CASE WHEN value < 20 THEN 0 ELSE {200 * HOUR} END AS ttl FROM e WHERE op = 'open')"
    return {
        "labelled_denies": x + f" SELECT seq, CASE WHEN seq = c3 THEN 'disarm' ELSE 'block' END AS verdict FROM e JOIN m USING (actor) WHERE seq = c3 OR seq > c3 AND op IN {GATED}",
        "labelled_bindings": w + "seq FROM (SELECT seq, op, lag(op) OVER (PARTITION BY object ORDER BY ts_ms, seq) AS was FROM g WHERE op = 'exec' OR t1486 OR t1083) WHERE op = 'exec' AND was = 'write'",
        "storyline_tiers": x + f""",
t AS (SELECT actor, count(*) AS n, 2 * count(*) + 0.3 * sum(CASE bit WHEN 0 THEN 3.0 WHEN 1 THEN 2.0 WHEN 2 THEN 7.0 ELSE 9.0 END) + 2 * sum(CASE bit WHEN 0 THEN 0.1 WHEN 1 THEN 0.1 WHEN 2 THEN 0.8 ELSE 0.9 END) + max(order_bonus) AS score,
  max(bit) AS top FROM s JOIN o USING (actor) GROUP BY actor)
SELECT actor, CAST(CASE WHEN c1 IS NOT NULL AND c2 IS NOT NULL OR round(score, 6) >= {ALERT} THEN 3 WHEN n >= 2 OR top >= 2 THEN 2 ELSE 1 END AS INT) AS tier FROM t JOIN m USING (actor)""",
        "step_sketches": x + " SELECT actor, CAST(sum(1 << bit) AS BIGINT) AS done, CAST(count(*) AS INT) AS steps, max(ts_ms) AS last_ts FROM s GROUP BY actor",
        "working_set": x + f""",
v AS (SELECT identity, max(ts_ms) AS last_touch FROM (SELECT 'p' || actor AS identity, ts_ms FROM e UNION ALL SELECT 'f' || object, ts_ms FROM e) GROUP BY identity),
q AS (SELECT 'p' || actor AS identity, CAST(1 AS BIGINT) AS refcount FROM m WHERE c3 IS NULL)
SELECT identity, last_touch, coalesce(refcount, 0) AS refcount FROM v LEFT JOIN q USING (identity) WHERE refcount > 0 OR last_touch >= (SELECT max(ts_ms) FROM e) - {24 * HOUR}""",
        "node_budget": w + "identity, row_number() OVER (PARTITION BY root ORDER BY last_ms DESC, identity DESC) > 50 AS evicted FROM (SELECT actor % 10 AS root, object AS identity, max(ts_ms) AS last_ms FROM e GROUP BY ALL)",
        "hub_components": calm + " SELECT node, component FROM cc",
        "hub_links": _E + f", {hubs} SELECT src, dst FROM p WHERE src IN (FROM h) OR dst IN (FROM h)",
        "ship_order": w + """seq, row_number() OVER (PARTITION BY actor % 8 ORDER BY seq) AS number, place, place > 700 AND tier < 2 AS dropped FROM (
  SELECT seq, actor, k % 4 AS tier, row_number() OVER (PARTITION BY seq // 1000 ORDER BY k % 4 DESC, seq) AS place FROM e)""",
        "leased_reads": _E + f", {leases}" + """ SELECT e.seq, coalesce(arg_max(d.ts_ms + d.ttl, d.seq) > any_value(e.ts_ms), false) AS denied
FROM e LEFT JOIN d ON e.object = d.object AND d.ts_ms <= e.ts_ms WHERE e.op = 'read' GROUP BY e.seq""",
        "live_leases": _E + f", {leases}" + """ SELECT host, identity, until, row_number() OVER (PARTITION BY host ORDER BY first, identity) > 5 AS refused FROM (
  SELECT host, object AS identity, arg_max(ts_ms + ttl, seq) AS until, min(seq) AS first FROM d GROUP BY ALL) WHERE until > (SELECT max(ts_ms) FROM d)""",
    }
