import os
import random
import socket
import threading

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_queries import SF, plain
from tests.test_replay import RULES, stream, writes
from tracewright import queries_flow
from tracewright.engine import Engine
from tracewright.functions.kernel import file_key, high_entropy, process_key
from tracewright.functions.tagging import rate_state
from tracewright.operators.replay import CoreEngine, ScoredEngine
from tracewright.plans.rules import compile_rules, compile_scored, encode
from tracewright.queries import DAG, LINEAR
from tracewright.sinks import reports
from tracewright.sinks.control import Control, ControlError, control_records, decode
from tracewright.sinks.control import encode as encode_control
from tracewright.sinks.ship import from_messages, ship_tcp, to_messages
from tracewright.sources import frames, wire
from tracewright.sources.reader import read_events, stream_frames
from tracewright.streaming.flow import answered, once
from tracewright.streaming.replay import replay_scored_stream


@pytest.mark.parametrize("name", sorted(queries_flow.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    cur = con.execute(queries_flow.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    assert plain(r.asDict() for r in queries_flow.queries()[name](spark, SF).collect()) == plain(want)


def test_control(spark):
    made = [Control("arm", 7, 123, "write"), Control("disarm", 7, 123), Control("set_self", 9), Control("register_ring", 1 << 20, 5), Control("verdict", 77, deny=True), Control("set_rules", rules=b"ERD1\0\0")]
    blob = b"".join(map(encode_control, made))
    assert decode(blob) == made and len(encode_control(made[0])) == 16
    for bad in (blob[:-1], blob[:10], b"\x09" * 16, b"\x01\x63" + bytes(14), b"\x06\0"):
        with pytest.raises(ControlError):
            decode(bad)
    rows = spark.createDataFrame([("proc:7.123", "write"), ("proc:8", None), ("file:x", "write"), (None, "read")], "actor string, op string")
    got = {r.actor: decode(bytes(r.record)) for r in control_records(rows).collect()}
    assert got == {"proc:7.123": [Control("arm", 7, 123, "write")], "proc:8": [Control("disarm", 8)]}


def test_entropy(spark):
    r = random.Random(1)
    noise, text = bytes(r.randrange(256) for _ in range(5000)), b"plain words " * 500
    rows = spark.createDataFrame([(0, bytearray(noise)), (1, bytearray(text)), (2, bytearray(noise[:255])), (3, bytearray(noise[:256])), (4, None), (5, bytearray(text + noise))], "i int, b binary")
    assert [x.h for x in rows.select("i", high_entropy("b").alias("h")).orderBy("i").collect()] == [True, False, False, True, False, False]


def test_keys():
    assert process_key(5, 7) == 7 << 64 | 5
    assert file_key("") == 1099511628211 << 64 | 1469598103934665603
    assert len({file_key(x) for x in ("a", "b", "ab", "ba", "A")}) == 5


def test_engine():
    dag = Engine.of(DAG, "dag")
    assert dag.referenced_tags(2) == ([1059, 1083], 4)
    assert Engine.of(encode(dag.rules, True), "dag") == dag
    assert [p.name for p in dag.with_rules(dag).rules] == ["encrypt_any_order"] * 2
    both = Engine.of(RULES, "scored").with_rules(Engine.of(queries_flow.LSASS, "scored"))
    assert [p.name for p in both.rules.patterns] == ["dropper", "ransomware", "credential_dump"] and both.referenced_tags()[1] == 5
    with pytest.raises(ValueError, match="fit"):
        dag.with_rules(Engine.of(LINEAR, "linear"))
    with pytest.raises(ValueError, match="dialect"):
        Engine.of(DAG, "other")


def test_stronger_verdict_wins():
    text = "pattern a\nstep bit=0 ops=write action=block\nend\npattern b\nstep bit=0 ops=write action=disarm(read)\nend"
    assert CoreEngine(compile_rules(text, True), True).on_event("write", 1, 2, []) == "disarm"


def test_messages(spark):
    rows = spark.createDataFrame([(1, 5, "write", "proc:1.2", "file:a", {"dir": "d"}, 3, ["T1"], None, None, None), (2, 6, "read", "proc:1.2", "reg:k", None, None, None, "p", 7.4, "r")], "seq long, ts long, op string, actor string, object string, attrs map<string,string>, storyline long, ttps array<string>, pattern string, score double, reason string")
    sent = to_messages(rows)
    got = from_messages(sent, "message").orderBy("seq").collect()
    assert [(r.seq, r.ts, r.op, r.object, r.attrs, r.storyline, r.ttps, r.pattern, r.score) for r in got] == [(1, 5, "write", "file:a", {"dir": "d"}, 3, ["T1"], None, None), (2, 6, "read", "reg:k", {}, None, None, "p", 7.4)]
    cut = spark.createDataFrame([(bytearray(bytes(sent.first().message) + b"\x05\0"),)], "content binary")
    assert [r.error for r in from_messages(cut, strict=False).collect()] == [None, "a message is cut off"]
    with pytest.raises(Exception, match="cut off"):
        from_messages(cut).collect()


def test_reader(spark, tmp_path):
    frame = frames.encode_frame([frames.encode_record(2, 30_000, 1, 0, file_name=f"f{i}") for i in range(3)])
    (tmp_path / "a.bin").write_bytes(frame * 2)
    assert read_events(spark, "frames", str(tmp_path)).count() == 6
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x").write_bytes(wire.encode({"seq": 1, "event": {"ts": 1, "op": "read", "actor": "proc:1.0", "object": "file:f"}}) * 3)
    assert read_events(spark, "messages", f"{tmp_path}/m").count() == 3
    assert read_events(spark, "stress", "1000").select(F.count_distinct("object")).first()[0] == 1000
    with pytest.raises(ValueError, match="unknown kind"):
        read_events(spark, "port")


def run_stream(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("parquet").outputMode(mode).option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df.sparkSession.read.schema(df.schema).parquet(f"{tmp_path}/{name}")


def test_frame_stream(spark, tmp_path):
    found = stream_frames(spark, f"{tmp_path}/in")
    for i in range(3):
        (tmp_path / "in" / f"{i}.bin").write_bytes(frames.encode_frame([frames.encode_record(2, 30_000, i, 0, file_name="f")]))
    assert sorted(r.actor for r in run_stream(found, tmp_path, "out").collect()) == ["proc:0.0", "proc:1.0", "proc:2.0"]


SCORED = "host string, seq long, ts long, op string, actor string, object string, attrs map<string,string>"


def test_scored_stream_keeps_state(spark, tmp_path):
    rows = [(1000, "exec", "proc:100.1", "proc:200.5", {"image": "powershell.exe"}), (1500, "open", "proc:200.5", "file:D1", {"enum": "1"}), (2000, "exec", "proc:200.5", "proc:300.10", {"image": "vssadmin.exe", "cmd": "delete shadows"})]
    rows += writes((2500, "0.96", "a"), (2600, "0.95", "b"), (2700, "0.97", "c"))
    engine = ScoredEngine(compile_scored(RULES))
    want = [engine.on_event(*r) for r in rows]
    found = replay_scored_stream(spark.readStream.schema(SCORED).json(f"{tmp_path}/in/*"), compile_scored(RULES))
    for part in (rows[:4], rows[4:]):
        first = rows.index(part[0])
        spark.createDataFrame([("h", first + i, *r) for i, r in enumerate(part)], SCORED).coalesce(1).write.json(f"{tmp_path}/in/{first}")
        out = run_stream(found, tmp_path, "out")
    got = out.orderBy("seq").collect()
    assert [(r.decision, r.kind, r.pattern, r.score, r.reason) for r in got] == want
    assert [r.log.split(" ")[1] for r in got if r.log] == ["ARM", "BLOCK"]


def test_bounded_engine_streams(spark, tmp_path):
    rows = [("h", i, i, o, str(a), str(b), t) for i, (o, a, b, t) in enumerate(stream(80, 5))]
    schema = "host string, seq long, ts long, op string, actor string, object string, ttps array<int>"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/in")
    engine = Engine.of(DAG, "bounded")
    got = run_stream(engine.run(spark.readStream.schema(schema).json(f"{tmp_path}/in"), members=6), tmp_path, "out")
    assert plain(r.asDict() for r in got.select("seq", "verdict").collect()) == plain(r.asDict() for r in engine.run(spark.createDataFrame(rows, schema), members=6).collect())


def test_once_in_a_stream(spark, tmp_path):
    schema = "handle long, at timestamp"
    rows = spark.range(30).selectExpr("id % 5 as handle", "timestamp_seconds(id) as at")
    rows.coalesce(1).write.json(f"{tmp_path}/in")
    assert run_stream(once(spark.readStream.schema(schema).json(f"{tmp_path}/in"), ["handle"], "at"), tmp_path, "out").count() == 5


def test_answers(spark):
    asked = spark.sql("select id as req_id, timestamp_seconds(10 * id) as asked_at from range(4)")
    given = spark.sql("select * from values (0L, timestamp_seconds(0.5), true), (1L, timestamp_seconds(12), true), (2L, timestamp_seconds(21), false) as v(req_id, answered_at, deny)")
    assert dict(answered(asked, given).select("req_id", "deny").collect()) == {0: True, 1: False, 2: False, 3: False}


def test_chains(spark):
    rows = read_events(spark, "demo")
    made = reports.chains(rows.withColumn("component", F.lit("x")), Engine.of(queries_flow.LSASS, "scored").run(rows)).collect()
    assert [(r.step, r.op, r.kind) for r in made] == [(0, "read", "Block")]
    lines = reports.outcome_lines(rows, Engine.of(queries_flow.LSASS, "scored").run(rows)).orderBy("seq").collect()
    assert [r.level for r in lines] == ["debug", "warn"] and "DENY  [Block credential_dump 7.4]" in lines[1].line


def test_tcp(spark, tmp_path):
    spark.sql("select id as seq, id as ts, 'write' as op, 'proc:1.0' as actor, concat('file:', id) as object, cast(map() as map<string,string>) as attrs from range(20)").coalesce(2).write.parquet(f"{tmp_path}/in")
    server, got = socket.create_server(("127.0.0.1", 0)), []
    server.settimeout(60)

    def serve():
        while sum(map(len, got)) < size:
            link, _ = server.accept()
            with link:
                while data := link.recv(65536):
                    got.append(data)

    source = spark.read.parquet(f"{tmp_path}/in")
    size = sum(len(r.message) for r in to_messages(source).collect())
    thread = threading.Thread(target=serve, daemon=True)
    thread.start()
    q = ship_tcp(spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in"), *server.getsockname()).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    thread.join(30)
    assert len(b"".join(got)) == size and os.path.isdir(tmp_path / "state")
    assert from_messages(spark.createDataFrame([(bytearray(b"".join(got)),)], "content binary")).select("seq").distinct().count() == 20


def test_rate_state_equals_the_engine(spark):
    r = random.Random(4)
    rows, ts = [], 0
    for i in range(400):
        ts += r.choice([0, 0, 100, 400, 500, 1000, 1001])
        rows.append((i, ts, r.choice(["write", "write", "write", "exec"]), f"p{r.randrange(3)}", r.choice(["a", "b", "c", None])))
    got = rate_state(spark.createDataFrame(rows, "seq long, ts long, op string, actor string, dir string")).orderBy("seq").collect()
    engine = ScoredEngine(compile_scored(""))
    for g, (_, ts, op, actor, folder) in zip(got, rows, strict=True):
        engine.tags(ts, op, actor, {"dir": folder} if folder else {})
        assert (g.write_rate, g.dir_spread) == (len(engine.rates[actor]), len({d for _, d in engine.rates[actor]})), g
