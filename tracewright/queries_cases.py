"""Queries that hold single operators of the event engine against SQL: sources and formats, taggers, scored rules, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions.kernel import ENTROPY_LEAST, file_keys, high_entropy, key_of
from tracewright.functions.tagging import tag_columns
from tracewright.model import KINDS, op_of_index
from tracewright.operators.replay import replay_bounded, replay_scored, routed
from tracewright.plans import rules as R
from tracewright.queries import _E, DAG, LINEAR, TAGS, _core_events, _ttps, _verdicts, events, tagged
from tracewright.sinks import reports
from tracewright.sinks.ship import from_messages, to_messages
from tracewright.sources.evt import parse

TAGGERS = """
ttp T1 tactic=impact severity=1 rarity=0.1
tagger T1 op=exec|write image_base_in=CMD.exe,tool.EXE
tagger T2 target_image_base=lsass.EXE
tagger T3 op=read attr_true=enum
tagger T4 entropy_gt=0.5
tagger T5 op=write write_rate_ge=1 dir_spread_ge=1
tagger T6 cmd_recovery_inhibit
tagger T6 op=open
"""
ARMING = """
ttp T1059 tactic=execution severity=3 rarity=0.10
ttp T1486 tactic=impact severity=9 rarity=0.90
pattern start_then_encrypt scope=same_storyline theta_alert=4 theta_block=4
step start bit=0 match=ttp:T1059
step encrypt bit=1 match=ttp:T1486 prereq=0 seg_window=100000000000000 enforceable block
"""
DROPPER = """
pattern dropper scope=same_storyline theta_alert=3 theta_block=100 root_gate=pe_write
step drop bit=0 match=op:write bind=dropped:object
step run bit=1 match=op:exec prereq=0 seg_window=100000000000000 bind=dropped:image
"""


def line_events(spark, sf_dir):
    """Events written as lines and read back."""
    e = events(spark, sf_dir)
    text = F.format_string('  ts=%d op=%s actor=%d.7 object=file:f%d image="a b%d" n=%d n=%d', "ts_ms", "op", "actor", "k", "k", "seq", "k")
    lines = e.select(F.explode(F.array(text, F.lit("# a comment"), F.lit(""))).alias("value"))
    return parse(lines).groupBy("op", "actor", "object", F.col("attrs")["image"].alias("image"), F.col("attrs")["n"].alias("n"), F.size("attrs").alias("attrs")).agg(F.sum("ts").alias("ts"), F.count("*").alias("rows"))


def _attributed(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    attrs = F.create_map(
        F.lit("image"), F.expr("case k % 3 when 0 then 'C:\\\\x\\\\cmd.EXE' when 1 then '/usr/Tool.exe' else 'cmd.exe.bak' end"), F.lit("target_image"), F.expr("if(k % 4 = 0, 'C:/lsass.exe', 'mylsass.exe')"),
        F.lit("enum"), F.expr("case k % 5 when 0 then '1' when 1 then 'true' else '0' end"), F.lit("entropy"), F.expr("if(k % 7 = 0, 'x', string(k / 100.0))"), F.lit("dir"), F.expr("string(k % 7)"),
        F.lit("cmd"), F.expr("case k % 6 when 0 then 'Delete SHADOWS' when 1 then 'delete x' when 2 then 'RecoveryEnabled NO' when 3 then 'resize shadowstorage' when 4 then 'wbadmin delete catalog' else 'list' end"),
    )
    return e.select("seq", F.col("ts_ms").alias("ts"), "op", F.concat(F.lit("proc:"), "actor").alias("actor"), F.concat(F.lit("file:"), "object").alias("object"), attrs.alias("attrs"))


def tagger_conditions(spark, sf_dir):
    """Every kind of condition; tags in the order of their rules."""
    return tag_columns(_attributed(spark, sf_dir), R.compile_scored(TAGGERS).taggers).select("seq", F.array_join("tags", ",").alias("tags"))


def message_round_trip(spark, sf_dir):
    """Events as framed messages, many in a row, and back."""
    e = _attributed(spark, sf_dir).withColumns({"storyline": F.col("seq") + 1, "ttps": F.array(F.lit("T1"), F.concat(F.lit("T"), "seq"))})
    e = e.withColumns({"actor": F.concat("actor", F.lit(".9"))})
    frames = to_messages(e).groupBy(F.expr("seq div 50").alias("part")).agg(F.array_join(F.array_sort(F.collect_list(F.hex("message"))), "").alias("content"))
    back = from_messages(frames.select(F.unhex("content").alias("content")))
    return back.select("seq", "ts", "op", "actor", "object", "storyline", F.array_join("ttps", ",").alias("ttps"), F.col("attrs")["cmd"].alias("cmd"), F.size("attrs").alias("attrs"))


def rule_bytes(spark, sf_dir):
    """Rules compiled to bytes and read again, with a second set after the first one."""
    both = R.decode(R.encode(R.compile_rules(LINEAR, False), False), False) + R.decode(R.encode(R.compile_rules("pattern more\nstep ops=open|read ttps=T7,9 action=block\nend", False), False), False)
    rows = [(i, p.name, k, s.ops, ",".join(map(str, s.tags)), s.action, s.disarm) for i, p in enumerate(both) for k, s in enumerate(p.steps)]
    return spark.createDataFrame(rows, "place int, pattern string, step int, ops int, tags string, action string, disarm int")


def indexed_ops(spark, sf_dir):
    """Operations by their call index; unknown ones have no event."""
    e = events(spark, sf_dir).select(op_of_index(F.expr("k % 11 - 1")).alias("op"))
    return e.groupBy(F.coalesce("op", F.lit("ignored")).alias("op")).agg(F.count("*").alias("n"))


def file_key_columns(spark, sf_dir):
    names = events(spark, sf_dir).select("k").distinct()
    return names.select("k", F.hex(file_keys(F.concat(F.lit("F"), "k"))).alias("file"), F.hex(key_of(F.col("k") + 5, F.col("k"))).alias("process"))


def entropy_buffers(spark, sf_dir):
    """Buffers of ``k`` different bytes, each as often: entropic ones are long and even enough."""
    e = events(spark, sf_dir).select("k").distinct()
    data = F.unhex(F.expr("array_join(transform(sequence(0, 10 * k - 1 + int(k = 0)), i -> right(concat('0', hex(i % greatest(k, 1) * 2)), 2)), '')"))
    return e.select("k", high_entropy(data).alias("entropic"))


def bounded_wide(spark, sf_dir):
    """The bounded engine under ceilings that nothing reaches: as the partial-order engine."""
    e = _core_events(spark, sf_dir).withColumn("host", F.substring("actor", -1, 1))
    return replay_bounded(e, R.compile_rules(DAG, True), identities=10**9, storylines=10**6, members=10**9, automata=10**9, disarms=10**9)


def _scored(spark, sf_dir, rules: str) -> DataFrame:
    e = _core_events(spark, sf_dir).withColumn("tags", F.transform("ttps", lambda t: F.concat(F.lit("T"), t)))
    attrs = events(spark, sf_dir).select("seq", F.create_map(F.lit("pe"), F.expr("if(k % 4 = 1, '1', '0')"), F.lit("image"), F.col("object").cast("string")).alias("attrs"))
    return replay_scored(e.drop("ttps").join(attrs, "seq"), R.compile_scored(rules))


def armed_storylines(spark, sf_dir):
    """A start arms its storyline: writes are denied until the one that completes the pattern, which is a block."""
    found = _scored(spark, sf_dir, ARMING).where("decision = 'Deny' or kind <> 'None'")
    return found.select("seq", "decision", "kind", F.round("score", 4).alias("score"), "reason", "log", "commits")


def outcome_levels(spark, sf_dir):
    """How many outcomes are of each level."""
    return _scored(spark, sf_dir, ARMING).groupBy(reports.log_level().alias("level"), "decision").agg(F.count("*").alias("n"))


def dropped_programs(spark, sf_dir):
    """A written program that is started: a gate at the root, and identities bound across steps."""
    found = _scored(spark, sf_dir, DROPPER).where("commits <> ''")
    return found.select("seq", "decision", "kind", F.round("score", 4).alias("score"), "reason", "commits")


def outcome_text(spark, sf_dir):
    """The printed line and level of each outcome."""
    e = events(spark, sf_dir)
    rows = e.select("seq", F.col("ts_ms").alias("ts"), "op", F.concat(F.lit("proc:"), "actor", F.lit(".1")).alias("actor"), F.concat(F.lit("file:C:\\d\\f"), "k").alias("object"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("k") % 4 + 1).cast("int"))
    said = e.select("seq", F.expr("if(k % 5 = 0, 'Deny', 'Allow')").alias("decision"), kind.alias("kind"), F.lit("pat").alias("pattern"), (F.col("k") / 4).alias("score"), F.expr("if(k % 6 = 0, 'accepting', '')").alias("reason"))
    return reports.outcome_lines(rows, said)


def tag_history(spark, sf_dir):
    """A storyline's tags in the order they came; nothing reads them but people."""
    e = tagged(events(spark, sf_dir)).select("seq", "ts_ms", F.concat(F.lit("proc:"), "actor").alias("actor"), F.concat(F.lit("file:"), "object").alias("object"), "op", _ttps().alias("ttps"))
    rows = routed(e, False).select("component", "seq", "ts_ms", F.posexplode("ttps").alias("nth", "ttp"))
    place = F.row_number().over(Window.partitionBy("component").orderBy("ts_ms", "seq", "nth"))
    return rows.select("component", place.cast("long").alias("place"), "seq", F.col("ttp").cast("long").alias("ttp"))


ALL = (tag_history, line_events, tagger_conditions, message_round_trip, rule_bytes, indexed_ops, file_key_columns, entropy_buffers, bounded_wide, armed_storylines, outcome_levels, dropped_programs, outcome_text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    w = _E + " SELECT "
    cmd = "CASE k % 6 WHEN 0 THEN 'Delete SHADOWS' WHEN 1 THEN 'delete x' WHEN 2 THEN 'RecoveryEnabled NO' WHEN 3 THEN 'resize shadowstorage' WHEN 4 THEN 'wbadmin delete catalog' ELSE 'list' END"
    half = lambda start, by: f"list_reduce(list_prepend({start}::UHUGEINT, flatten(list_transform(string_split('F' || k, ''), lambda c: [ascii(c)::UHUGEINT, 0::UHUGEINT]))), lambda a, b: (xor(a, b) * {by}::UHUGEINT) % 18446744073709551616::UHUGEINT)"
    digits = lambda x: f"lpad(hex(({x})::UBIGINT), 16, '0')"
    first = """,
p AS (SELECT actor, min(seq) FILTER (t1059) AS c0 FROM g GROUP BY actor),
q AS (SELECT g.actor, c0, min(seq) FILTER (t1486 AND seq > c0) AS c1 FROM g JOIN p USING (actor) GROUP BY g.actor, c0)"""
    return {
        "tag_history": _E + f""",
h AS (SELECT seq, ts_ms, actor, least('proc:' || actor, min('file:' || object) OVER (PARTITION BY actor)) AS component, list_filter([{", ".join(f"CASE WHEN t{t} THEN {t} END" for t in TAGS)}], lambda x: x IS NOT NULL) AS ttps FROM g)
SELECT component, row_number() OVER (PARTITION BY component ORDER BY ts_ms, seq, nth) AS place, seq, ttp::BIGINT AS ttp FROM (SELECT component, seq, ts_ms, unnest(ttps) AS ttp, generate_subscripts(ttps, 1) AS nth FROM h)""",
        "line_events": w + "op, 'proc:' || actor || '.7' AS actor, 'file:f' || k AS object, 'a b' || k AS image, k::VARCHAR AS n, 2::INT AS attrs, sum(ts_ms)::BIGINT AS ts, count(*) AS rows FROM e GROUP BY op, actor, k",
        "tagger_conditions": w + f"""seq, concat_ws(',', CASE WHEN op IN ('exec','write') AND k % 3 < 2 THEN 'T1' END, CASE WHEN k % 4 = 0 THEN 'T2' END, CASE WHEN op = 'read' AND k % 5 < 2 THEN 'T3' END,
  CASE WHEN k % 7 <> 0 AND k > 50 THEN 'T4' END, CASE WHEN op = 'write' THEN 'T5' END, CASE WHEN {cmd} NOT IN ('delete x', 'list') THEN 'T6' END, CASE WHEN op = 'open' THEN 'T6' END) AS tags FROM e""",
        "message_round_trip": w + f"seq, ts_ms AS ts, op, 'proc:' || actor || '.9' AS actor, 'file:' || object AS object, seq + 1 AS storyline, 'T1,T' || seq AS ttps, {cmd} AS cmd, 6::INT AS attrs FROM e",
        "rule_bytes": """SELECT place::INT AS place, pattern, step::INT AS step, ops::INT AS ops, tags, action, disarm::INT AS disarm FROM (VALUES
  (0, 'encrypt_in_order', 0, 1, '1059', 'inspect', 0), (0, 'encrypt_in_order', 1, 8, '1083', 'inspect', 0), (0, 'encrypt_in_order', 2, 1, '1490', 'inspect', 0),
  (0, 'encrypt_in_order', 3, 4, '1486', 'disarm', 103), (1, 'more', 0, 24, '7,9', 'block', 0)) AS v(place, pattern, step, ops, tags, action, disarm)""",
        "indexed_ops": w + "coalesce(CASE k % 11 - 1 WHEN 0 THEN 'exec' WHEN 1 THEN 'create' WHEN 2 THEN 'write' WHEN 3 THEN 'read' WHEN 4 THEN 'open' WHEN 5 THEN 'connect' WHEN 6 THEN 'inject' WHEN 7 THEN 'dup' END, 'ignored') AS op, count(*) AS n FROM e GROUP BY 1",
        "file_key_columns": w + f"DISTINCT k, {digits(half(1099511628211, 1469598103934665603))} || {digits(half(1469598103934665603, 1099511628211))} AS file, {digits('k + 5')} || {digits('k')} AS process FROM e",
        "entropy_buffers": w + f"DISTINCT k, k * 10 >= {ENTROPY_LEAST} AND k > 64 AS entropic FROM e",
        "bounded_wide": _verdicts(False) + " SELECT seq, verdict FROM v",
        "armed_storylines": _E + first + """
SELECT seq, CASE WHEN seq = c0 THEN 'Allow' ELSE 'Deny' END AS decision, CASE WHEN seq = c0 THEN 'Alert' WHEN seq = c1 THEN 'Block' ELSE 'None' END AS kind,
  CASE WHEN seq = c0 THEN 4.1 WHEN seq = c1 THEN 10.6 ELSE 0.0 END::DOUBLE AS score, CASE WHEN seq = c0 THEN 'partial-high-score' WHEN seq = c1 THEN 'chokepoint encrypt' ELSE '' END AS reason,
  CASE WHEN seq = c0 THEN 'ts=' || ts_ms || ' ARM pattern=start_then_encrypt score=4.1 op=write' WHEN seq = c1 THEN 'ts=' || ts_ms || ' BLOCK pattern=start_then_encrypt score=10.6' ELSE '' END AS log,
  CASE WHEN seq = c0 THEN 'start_then_encrypt:start' WHEN seq = c1 THEN 'start_then_encrypt:encrypt' ELSE '' END AS commits
FROM e JOIN q USING (actor) WHERE seq = c0 OR op = 'write' AND seq > c0 AND (c1 IS NULL OR seq <= c1)""",
        "outcome_levels": _E + first + """
SELECT level, CASE level WHEN 'warn' THEN 'Deny' ELSE 'Allow' END AS decision, count(*) AS n FROM (
  SELECT CASE WHEN op = 'write' AND seq > c0 AND (c1 IS NULL OR seq <= c1) THEN 'warn' WHEN seq = c0 THEN 'info' ELSE 'debug' END AS level FROM e LEFT JOIN q USING (actor)) GROUP BY level""",
        "dropped_programs": _E + """,
d AS (SELECT actor, min(seq) AS c0, arg_min(object, seq) AS dropped FROM e WHERE op = 'write' AND k % 4 = 1 GROUP BY actor),
x AS (SELECT d.actor, c0, min(seq) FILTER (seq > c0) AS c1 FROM d LEFT JOIN e ON e.actor = d.actor AND e.op = 'exec' AND e.object = dropped GROUP BY d.actor, c0)
SELECT seq, 'Allow' AS decision, 'Alert' AS kind, CASE WHEN seq = c0 THEN 3.6 ELSE 4.2 END::DOUBLE AS score,
  CASE WHEN seq = c0 THEN 'partial-high-score' ELSE 'accepting' END AS reason, CASE WHEN seq = c0 THEN 'dropper:drop' ELSE 'dropper:run' END AS commits
FROM e JOIN x USING (actor) WHERE seq = c0 OR seq = c1""",
        "outcome_text": w + r"""seq, CASE WHEN k % 6 = 0 OR k % 5 = 0 THEN 'warn' WHEN k % 4 > 0 THEN 'info' ELSE 'debug' END AS level,
  'ts=' || rpad(ts_ms::VARCHAR, greatest(10, length(ts_ms::VARCHAR))::INT, ' ') || ' ' || rpad(op, 7, ' ') || ' ' || rpad(actor || '.1', 20, ' ') || ' -> ' || rpad('file:f' || k, 20, ' ') || ' '
  || CASE WHEN k % 5 = 0 THEN 'DENY' ELSE 'ALLOW' END || CASE WHEN k % 4 > 0 THEN printf('  [%s pat %.1f]', ['None','Suspect','Alert','Block'][k % 4 + 1], k / 4.0 + CASE WHEN k % 4 = 1 THEN 0.001 ELSE 0 END) ELSE '' END AS line FROM e""",
    }
