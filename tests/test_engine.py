"""Engines against brute force where storylines merge, edge logs, chains, own conditions, rule files, strict lines."""

import random
import socket
import threading

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright import queries, storage
from tracewright.engine import Engine
from tracewright.functions.kernel import file_key, file_keys, key_of, process_key
from tracewright.functions.tagging import tag_columns
from tracewright.model import OP_BITS
from tracewright.operators.replay import CoreEngine, ScoredEngine, edge_log, replay_core, replay_scored, routed
from tracewright.plans import rules as R
from tracewright.plans.rules import RuleError, compile_rules, compile_scored
from tracewright.queries import DAG, LINEAR, SCORED
from tracewright.sinks import reports, ship
from tracewright.sources import frames
from tracewright.sources.evt import read_evt
from tracewright.streaming.flow import answered

RANK = ("ignore", "inspect", "block", "disarm")
SCHEMA = "seq long, ts long, op string, actor string, object string, ttps array<int>"


def brute(patterns, dag, rows):
    """Verdicts and edges by searching the graph of all edges so far anew at every event; an automaton belongs to the identity that began it."""
    edges, autos, disarmed, out = [], [], {}, []
    for op, actor, object_, tags in rows:
        bit = OP_BITS.get(op, 0)
        if not bit or disarmed.get(actor, 0) & bit:
            out.append(("block" if bit else "ignore", False))
            continue
        edges.append((actor, object_))
        near, grown = {actor}, True
        while grown:
            more = {x for e in edges if near & {*e} for x in e} - near
            near, grown = near | more, bool(more)
        hit = lambda s: (not s.ops or s.ops & bit) and {*s.tags} <= {*tags}  # noqa: E731, B023
        verdict = "ignore"
        fired = []
        for i, p in enumerate(patterns):
            if dag and any(hit(s) and not s.prereq for s in p.steps):
                autos.append([actor, i, set()])
            if not dag and hit(p.steps[0]):
                autos.append([actor, i, 1])
                fired.append(p.steps[0])
        for auto in autos:
            if auto[0] not in near:
                continue
            steps = patterns[auto[1]].steps
            if dag:
                for s in steps:
                    if hit(s) and s.bit not in auto[2] and all(b in auto[2] for b in range(64) if s.prereq >> b & 1):
                        auto[2].add(s.bit)
                        fired.append(s)
            elif auto[2] < len(steps) and hit(steps[auto[2]]):
                fired.append(steps[auto[2]])
                auto[2] += 1
        for s in fired:
            verdict = max(verdict, s.action, key=RANK.index)
            if s.disarm:
                disarmed[actor] = disarmed.get(actor, 0) | s.disarm
        out.append((verdict, True))
    return out


def stream(n, seed, actors, objects):
    r = random.Random(seed)
    return [(r.choice(["exec", "read", "write", "open", "fly"]), f"p{r.randrange(actors)}", f"f{r.randrange(objects)}", r.sample([1059, 1083, 1490, 1486], r.randrange(4))) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame(pd.DataFrame([(i, i, *r) for i, r in enumerate(rows)], columns=["seq", "ts", "op", "actor", "object", "ttps"]), SCHEMA)


@pytest.mark.parametrize("dag", [False, True])
def test_merging_storylines_against_brute_force(spark, dag):
    rules = compile_rules(DAG if dag else LINEAR, dag)
    for seed in range(12):
        rows = stream(90, seed, 14, 40)
        engine = CoreEngine(rules, dag)
        assert [(engine.on_event(*r), engine.edge) for r in rows] == brute(rules, dag, rows)
    rows = stream(250, 99, 30, 90) + [("exec", "quiet", "alone", [])]
    want = brute(rules, dag, rows)
    events = table(spark, rows).repartition(5)
    got = replay_core(events, rules, dag).orderBy("seq").collect()
    assert [(r.verdict, r.edge) for r in got] == want
    assert {"disarm", "block", "inspect"} <= {v for v, _ in want}
    kept = edge_log(events, replay_core(events, rules, dag)).orderBy("seq").collect()
    assert [(r.seq, r.op, r.actor, r.object) for r in kept] == [(i, *rows[i][:3]) for i, (_, edge) in enumerate(want) if edge]


def test_replay_of_no_rows_and_no_rules(spark):
    rows = table(spark, stream(30, 1, 3, 3))
    assert replay_core(rows.limit(0), compile_rules(DAG, True), True).count() == 0
    assert {r.verdict for r in replay_core(rows, [], True).collect()} == {"ignore"}


def scored_rows(seed, n=160):
    r = random.Random(seed)
    return [(1000 * i, r.choice(["exec", "read", "write"]), f"p{r.randrange(8)}", f"p{r.randrange(8)}" if r.random() < 0.3 else f"f{r.randrange(30)}", {}, [f"T{t}" for t in r.sample([1059, 1083, 1490, 1486], r.randrange(3))]) for i in range(n)]


def test_scored_replay_of_merging_storylines(spark):
    """A batch by component gives what one engine gives that sees every event."""
    rules, rows = compile_scored(SCORED), scored_rows(5)
    engine, want = ScoredEngine(rules), []
    for r in rows:
        engine.log.clear()
        want.append((*engine.on_event(*r), "\n".join(engine.log), ",".join(engine.commits)))
    events = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, ts long, op string, actor string, object string, attrs map<string,string>, tags array<string>")
    verdicts = replay_scored(events, rules)
    got = verdicts.orderBy("seq").collect()
    assert [tuple(r)[1:] for r in got] == want
    assert any("ARM" in w[5] for w in want) and any("BLOCK" in w[5] for w in want)
    # the chain of every denied event, by a plain look back
    component = {r.seq: r.component for r in routed(events, True).collect()}
    chains = {}
    for r in reports.chains(routed(events, True), verdicts).orderBy("block_seq", "step").collect():
        chains.setdefault(r.block_seq, []).append(r.seq)
    denied = [i for i, w in enumerate(want) if w[0] == "Deny"]
    assert sorted(chains) == denied and len(denied) >= 2
    for i in denied:
        of = lambda j, i=i: {c.split(":")[0] for c in want[j][6].split(",") if c} & ({want[i][2]} if want[i][2] else {p.name for p in rules.patterns})
        assert chains[i] == [j for j in range(i + 1) if component[j] == component[i] and (j == i or of(j))]


def test_own_conditions(spark):
    R.add_condition("path_has", lambda op, attrs, v: v in attrs.get("path", ""), lambda v: F.coalesce(F.col("attrs")["path"].contains(v), F.lit(False)))
    try:
        rules = compile_scored("ttp T1 tactic=impact severity=9 rarity=0.9\ntagger T1 op=write path_has=secret\npattern p scope=same_storyline theta_alert=1 theta_block=50\nstep s bit=0 match=ttp:T1")
        rows = spark.createDataFrame([(0, 0, "write", "a", "b", {"path": "/secret/x"}), (1, 1, "write", "c", "d", {"path": "/x"}), (2, 2, "write", "e", "f", None)], "seq long, ts long, op string, actor string, object string, attrs map<string,string>")
        assert [r.tags for r in tag_columns(rows, rules.taggers).orderBy("seq").collect()] == [["T1"], [], []]
        assert [r.kind for r in replay_scored(rows, rules).orderBy("seq").collect()] == ["Alert", "None", "None"]
        with pytest.raises(ValueError, match="taken"):
            R.add_condition("op", None, None)
    finally:
        R.USER_CONDITIONS.clear()
    with pytest.raises(RuleError, match="path_has"):
        compile_scored("tagger T1 path_has=secret")


def test_rule_files(spark, tmp_path):
    (tmp_path / "a.rules").write_text(LINEAR)
    (tmp_path / "b.rules").write_text("pattern other\nstep ops=read ttps=T7\nend\n")
    engine = Engine.of_files(spark, str(tmp_path), "linear")
    assert [p.name for p in engine.rules] == ["encrypt_in_order", "other"]
    assert Engine.of_files(spark, "credentials", "scored").rules.patterns[0].name == "credential_dump"
    with pytest.raises(ValueError, match="scored"):
        Engine.of_files(spark, "credentials", "dag")


def test_rule_texts():
    with pytest.raises(RuleError, match="line 2"):
        compile_rules("pattern p\nstep bit=²\nend", True)
    text = "pattern p scope=free theta_alert=1 theta_block=2\nstep a bit=0 match=op:write\nstep b bit=0 match=op:read prereq=7"
    with pytest.raises(RuleError):
        compile_scored(text)
    assert len(compile_scored(text, strict=False).patterns[0].steps) == 2


def test_lines_are_checked_whatever_is_read(spark, tmp_path):
    (tmp_path / "x.evt").write_text('# c\nts=1 op=exec actor=1.2 object=file:x image="a b"\n\nts=2 op=exec actor=1.2\n')
    for lines in (False, True):
        for read in (lambda t: t.count(), lambda t: t.select("ts").collect()):
            with pytest.raises(Exception, match="line 4: no object" if lines else "no object"):
                read(read_evt(spark, str(tmp_path / "x.evt"), lines))
    (tmp_path / "x.evt").write_text("ts=1 op=exec actor=1.2 object=file:x\nts=2 op=read actor=file:y object=1.2 k=v\n")
    assert [(r.ts, r.actor) for r in read_evt(spark, str(tmp_path / "x.evt"), True).orderBy("seq").collect()] == [(1, "proc:1.2"), (2, "file:y")]


def test_keys_as_columns(spark):
    names = ["C:\\a.txt", "", None, "é€😀", "b.txt", "x" * 300]
    rows = spark.createDataFrame([(i, n, 10 + i, -5 + i) for i, n in enumerate(names)], "i long, name string, pid long, start long")
    for r in rows.select("*", file_keys("name").alias("f"), key_of(F.col("start"), F.col("pid")).alias("p")).collect():
        assert (r.f is None) == (r.name is None) and (r.f is None or int.from_bytes(r.f, "big") == file_key(r.name))
        assert int.from_bytes(r.p, "big") == process_key(r.pid, r.start)


def test_answers_are_alike_in_table_and_stream(spark, tmp_path):
    asked = spark.sql("select * from values (1L, timestamp_seconds(10)), (2L, timestamp_seconds(10)), (3L, timestamp_seconds(11)), (9L, timestamp_seconds(500)) as v(req_id, asked_at)").coalesce(1)
    given = spark.sql("select * from values (1L, timestamp_seconds(10.1), false), (1L, timestamp_seconds(10.2), true), (2L, timestamp_seconds(10.4), false), (2L, timestamp_seconds(10.5), false), (3L, timestamp_seconds(13), true), (9L, timestamp_seconds(500), false) as v(req_id, answered_at, deny)").coalesce(1)
    want = {(r.req_id, r.deny) for r in answered(asked, given).collect()}
    assert want == {(1, True), (2, False), (3, False), (9, False)}
    asked.write.parquet(f"{tmp_path}/a")
    given.write.parquet(f"{tmp_path}/g")
    read = lambda t, p: spark.readStream.schema(t.schema).parquet(f"{tmp_path}/{p}")
    out = answered(read(asked, "a"), read(given, "g")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    assert out.awaitTermination(180)
    got = [(r.req_id, r.deny) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(got) == len({*got}) and {*got} <= want and {(1, True), (2, False)} <= {*got}


def test_intermediates_go_with_their_scope(spark):
    with storage.scope():
        made = storage.stored(spark.range(5), "x")
        path = made.inputFiles()[0].rsplit("/", 1)[0]
        assert made.count() == 5
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    assert not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def test_only_small_tables_are_broadcast(spark, monkeypatch):
    hinted = lambda df: "ResolvedHint (strategy=broadcast)" in storage.small(df)._jdf.queryExecution().analyzed().toString()
    rows = spark.range(100).selectExpr("id", "repeat('x', 1000) as text", "cast(null as binary) as raw")
    assert hinted(rows) and hinted(rows.limit(0))
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 50_000)
    assert not hinted(rows) and hinted(rows.select("id"))
    assert storage.small(spark.range(5), 10**6).schema == spark.range(5).schema


def test_no_folder_of_one_machine_on_a_cluster(monkeypatch):
    class Session:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:
            @staticmethod
            def get(_, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session)


def test_shared_replay_against_brute_force(spark):
    rows = queries._core_events(spark, queries_dir()).drop("object").join(queries.events(spark, queries_dir()).selectExpr("seq", "concat('file:', k) as object"), "seq").orderBy("ts", "seq").limit(10_000).collect()
    engine = CoreEngine(compile_rules(DAG, True), True)
    want = {r.seq: engine.on_event(r.op, r.actor, r.object, r.ttps) for r in rows}
    assert {r.seq: r.verdict for r in queries.shared_replay(spark, queries_dir()).collect()} == want
    few = [(r.op, r.actor, r.object, r.ttps) for r in rows[:250]]
    engine = CoreEngine(compile_rules(DAG, True), True)
    assert [(engine.on_event(*r), engine.edge) for r in few] == brute(compile_rules(DAG, True), True, few)


def test_expiry_bounds_the_state():
    """Within the time kept nothing changes; what is older is forgotten."""
    rules, r = compile_rules(DAG, True), random.Random(3)
    full, short = CoreEngine(rules, True), CoreEngine(rules, True)
    sizes = []
    for i in range(4000):
        row = (r.choice(["exec", "read", "write"]), f"p{i // 40}", f"f{i // 20}", r.sample([1059, 1083, 1490, 1486], r.randrange(3)))
        assert full.on_event(*row, ts=i) == short.on_event(*row, ts=i), i
        if i % 50 == 49:
            short.expire(i - 200)
            sizes.append(len(short.lines.up))
    assert max(sizes) < 60 < len(full.lines.up) and len(short.lines.value) < 20
    # a start that is too old no longer counts
    engine = CoreEngine(compile_rules("pattern a\nstep ops=exec ttps=1\nstep ops=write ttps=2 action=disarm(write)\nend", False), False)
    engine.on_event("exec", 1, 2, [1], ts=0)
    assert engine.expire(100) == 2 and engine.on_event("write", 1, 3, [2], ts=101) == "ignore"
    engine.on_event("exec", 1, 2, [1], ts=102)
    assert engine.expire(102) == 0 and engine.on_event("write", 1, 3, [2], ts=103) == "disarm"
    engine.expire(10**6)
    assert engine.on_event("write", 1, 9, [], ts=10**6) == "block"


def test_stream_with_expiry(spark, tmp_path):
    from tracewright.streaming.replay import replay_stream

    rules = compile_rules("pattern a\nstep ops=exec ttps=1\nstep ops=write ttps=2 action=disarm(write)\nend", False)
    schema = "host string, seq long, ts long, op string, actor string, object string, ttps array<int>"
    parts = [[("h", 0, 0, "exec", "a", "b", [1]), ("h", 1, 10, "exec", "c", "d", [1])], [("h", 2, 5000, "read", "c", "d", [])], [("h", 3, 5001, "write", "a", "e", [2])]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    q = replay_stream(source, rules, False, keep=1000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    assert [r.verdict for r in spark.read.parquet(f"{tmp_path}/out").orderBy("seq").collect()] == ["inspect", "inspect", "ignore", "ignore"]


def test_captures_are_read_in_runs(spark, tmp_path):
    for k in range(2):
        made = [frames.encode_frame([frames.encode_record(1, 10_000 * (k * 1000 + i), i, 0, file_name=f"f{i}")] * (i % 3 + 1)) for i in range(300)]
        (tmp_path / f"c{k}.bin").write_bytes(b"".join(made))
    whole = frames.decode(spark.read.format("binaryFile").load(f"{tmp_path}/*.bin").orderBy("path").select("content")).collect()
    cut = frames.read_frames(spark, f"{tmp_path}/*.bin", chunk=2000)
    assert cut.rdd.getNumPartitions() > 3 and cut.collect() == whole
    (tmp_path / "c1.bin").write_bytes(b"".join(made)[:-1])
    with pytest.raises(Exception, match="within a frame"):
        frames.read_frames(spark, f"{tmp_path}/*.bin").count()


def test_a_bounded_queue_drops_and_counts(spark):
    total = spark.sparkContext.accumulator(0)
    with socket.create_server(("127.0.0.1", 0)) as free:
        port = free.getsockname()[1]
    rows = spark.range(50).selectExpr("cast('x' as binary) as message").coalesce(1)
    rows.foreachPartition(ship._send_bounded("127.0.0.1", port, 0.01, 2, 8, total))
    assert total.value == 50
    server, got = socket.create_server(("127.0.0.1", 0)), []

    def serve():
        link, _ = server.accept()
        with link:
            while data := link.recv(100):
                got.append(data)

    thread = threading.Thread(target=serve, daemon=True)
    thread.start()
    total = spark.sparkContext.accumulator(0)
    rows.foreachPartition(ship._send_bounded("127.0.0.1", server.getsockname()[1], 0.01, 5, 8, total))
    thread.join(20)
    assert total.value == 0 and b"".join(got) == b"x" * 50


def queries_dir():
    return "/root/testdata/sf0.001"
