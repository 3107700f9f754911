import random

import pandas as pd
import pytest

from tracewright.model import VERDICTS
from tracewright.operators.replay import BoundedEngine, CoreEngine, ScoredEngine, replay_core
from tracewright.plans.rules import compile_rules, compile_scored
from tracewright.queries import DAG, LINEAR

# Rules whose scores and verdicts are known, and the events they are known for, here and in the tests below.
RULES = """
ttp T1059 tactic=execution severity=3 rarity=0.10
ttp T1083 tactic=discovery severity=2 rarity=0.10
ttp T1490 tactic=defense_evasion severity=7 rarity=0.80
ttp T1486 tactic=impact severity=9 rarity=0.90
tagger T1059 op=exec image_base_in=powershell.exe,cmd.exe
tagger T1083 op=open|read attr_true=enum
tagger T1490 op=exec image_base_in=vssadmin.exe cmd_recovery_inhibit
tagger T1486 op=write entropy_gt=0.85 write_rate_ge=3 dir_spread_ge=2
pattern dropper scope=same_storyline theta_alert=6 theta_block=12 root_gate=pe_write
step write bit=0 match=op:write seg_window=300000 bind=dropped:object
step run bit=1 match=op:exec prereq=0 seg_window=300000 enforceable block bind=dropped:image
pattern ransomware scope=same_storyline theta_alert=6 theta_block=12
step start bit=0 match=ttp:T1059 seg_window=120000
step spoil bit=1 match=ttp:T1490 prereq=0 seg_window=120000 enforceable
step look bit=2 match=ttp:T1083 prereq=0 seg_window=120000
step encrypt bit=3 match=ttp:T1486 prereq=1,2 seg_window=120000 enforceable block
"""
POWERSHELL, VSSADMIN = {"image": "C:\\x\\powershell.exe"}, {"image": "vssadmin.exe", "cmd": "vssadmin delete shadows"}


def scored(rows):
    engine = ScoredEngine(compile_scored(RULES))
    return [(d, k, round(s, 4)) for d, k, _, s, _ in (engine.on_event(*r) for r in rows)], engine.log


def writes(*times):
    return [(t, "write", "proc:200.5", f"file:DOC{i}", {"entropy": e, "dir": d}) for i, (t, e, d) in enumerate(times)]


def test_scored_ransomware():
    rows = [(1000, "exec", "proc:100.1", "proc:200.5", POWERSHELL), (1500, "open", "proc:200.5", "file:D1", {"enum": "1"}), (1600, "open", "proc:200.5", "file:D2", {"enum": "1"}), (2000, "exec", "proc:200.5", "proc:300.10", VSSADMIN)]
    got, log = scored(rows + writes((2500, "0.96", "Documents"), (2600, "0.95", "Pictures"), (2700, "0.97", "Desktop")))
    assert got == [("Allow", "None", 0), ("Allow", "Alert", 6.9), ("Allow", "None", 0), ("Allow", "Alert", 12.1), ("Deny", "None", 0), ("Deny", "None", 0), ("Deny", "Block", 18.7667)]
    assert any("ARM" in x for x in log)


def test_scored_reordered():
    rows = [(1000, "exec", "proc:100.1", "proc:200.5", POWERSHELL), (1500, "exec", "proc:200.5", "proc:300.10", VSSADMIN), (2000, "open", "proc:200.5", "file:D1", {"enum": "1"}), (2100, "open", "proc:200.5", "file:D2", {"enum": "1"})]
    got, _ = scored(rows + writes((2500, "0.96", "a"), (2600, "0.95", "b")))
    assert got == [("Allow", "None", 0), ("Allow", "Alert", 9.8), ("Allow", "Alert", 12.6), ("Allow", "None", 0), ("Deny", "None", 0), ("Deny", "None", 0)]


@pytest.mark.parametrize(("image", "last"), [("F_up", ("Allow", "Suspect", 4.2)), ("F_other", ("Allow", "None", 0))])
def test_scored_dropper(image, last):
    got, _ = scored([(1000, "write", "proc:500.1", "file:F_up", {"pe": "1", "entropy": "0.42"}), (1200, "exec", "proc:500.1", "proc:600.2", {"image": image})])
    assert got == [("Allow", "None", 0), last]


# The events of the golden replays.
F1 = [("exec", "P1", "P200", [1059]), ("read", "P200", "F1", [1083]), ("exec", "P50", "P80", []), ("exec", "P200", "P300", [1490]), ("read", "P80", "F2", []), ("write", "P200", "F3", [1486]), ("write", "P200", "F4", [1486]), ("exec", "P50", "P90", [])]
F2 = [F1[0], F1[2], F1[3], F1[4], F1[1], F1[5], F1[6], F1[7]]


def run(engine, rows):
    return [engine.on_event(*r) for r in rows]


def test_golden():
    assert run(CoreEngine(compile_rules(LINEAR, False), False), F1) == ["inspect", "inspect", "ignore", "inspect", "ignore", "disarm", "block", "ignore"]
    assert run(CoreEngine(compile_rules(DAG, True), True), F2) == ["inspect", "ignore", "inspect", "ignore", "inspect", "disarm", "block", "ignore"]
    assert not {"disarm", "block"} & {*run(CoreEngine(compile_rules(LINEAR, False), False), F2)}


def test_micro():
    two = compile_rules("pattern a\nstep ops=exec ttps=1\nstep ops=write ttps=2 action=disarm(write)\nend", False)
    engine = CoreEngine(two, False)
    assert run(engine, [("exec", 10, 11, [1]), ("read", 10, 12, []), ("write", 10, 13, [2]), ("write", 10, 14, []), ("read", 10, 14, [])]) == ["inspect", "ignore", "disarm", "block", "ignore"]
    assert engine.edges == 4
    assert run(CoreEngine(two, False), [("write", 10, 11, [2]), ("exec", 10, 12, [1])]) == ["ignore", "inspect"]
    engine = CoreEngine(two, False)
    assert run(engine, [("exec", 10, 11, [1]), ("read", 20, 21, []), ("read", 10, 21, []), ("write", 20, 22, [2])]) == ["inspect", "ignore", "ignore", "disarm"]
    assert engine.storyline_of(10) == {10, 11, 20, 21, 22}
    assert run(CoreEngine([], True), [("exec", 10, 11, [1059])]) == ["ignore"]
    assert run(CoreEngine(compile_rules(DAG, True), True), [("fly", 1, 2, [])]) == ["ignore"]


def stream(n, seed, ids=12):
    r = random.Random(seed)
    return [(r.choice(["exec", "read", "write", "open"]), r.randrange(ids), 100 + r.randrange(ids), r.sample([1059, 1083, 1490, 1486], r.randrange(3))) for _ in range(n)]


def test_bounded_never_exceeds():
    rank = VERDICTS.index
    rules = compile_rules(DAG, True)
    rows = stream(3000, 7)
    full, bound = run(CoreEngine(rules, True), rows), run(BoundedEngine(rules, members=6, automata=3), rows)
    assert sum(map(rank, bound)) <= sum(map(rank, full))
    few = rows[:6]
    assert run(BoundedEngine(rules), few) == run(CoreEngine(rules, True), few)


@pytest.mark.parametrize("dag", [False, True])
def test_routed_equals_global(spark, dag):
    rules = compile_rules(DAG if dag else LINEAR, dag)
    rows = [r for s in range(6) for r in [(o, f"p{s}-{a}", f"f{s}-{b}", t) for o, a, b, t in stream(60, s, 8)]]
    random.Random(1).shuffle(rows)
    events = spark.createDataFrame(pd.DataFrame([(i, i, *r) for i, r in enumerate(rows)], columns=["seq", "ts", "op", "actor", "object", "ttps"]), "seq long, ts long, op string, actor string, object string, ttps array<int>")
    got = [r.verdict for r in replay_core(events, rules, dag).orderBy("seq").collect()]
    assert got == run(CoreEngine(rules, dag), rows)


def test_stream_equals_batch(spark, tmp_path):
    from tracewright.streaming.replay import replay_stream

    rules, rows = compile_rules(DAG, True), stream(200, 3)
    schema = "host string, seq long, ts long, op string, actor string, object string, ttps array<int>"
    for part in range(4):
        data = [("h", i, i, o, str(a), str(b), t) for i, (o, a, b, t) in enumerate(rows) if i // 50 == part]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in{part}")
        query = replay_stream(spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(f"{tmp_path}/all"), rules, True) if part == 0 and (tmp_path / "all").mkdir() is None else None
        if query is not None:
            out = query
        for k, f in enumerate(sorted((tmp_path / f"in{part}").glob("part-*.json"))):
            (tmp_path / "all" / f"{part}-{k}.json").write_bytes(f.read_bytes())
        run_ = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        run_.awaitTermination(120)
    got = [r.verdict for r in spark.read.parquet(f"{tmp_path}/out").orderBy("seq").collect()]
    assert got == run(CoreEngine(rules, True), [(o, str(a), str(b), t) for o, a, b, t in rows])
