import random

import pytest

from tests.test_replay import F2
from tracewright.engine import Engine
from tracewright.operators.labelled import LabelledEngine, replay_labelled
from tracewright.operators.replay import CoreEngine
from tracewright.plans.labelled import Bind, compile_labelled, labelled_tags
from tracewright.plans.rules import RuleError, compile_rules
from tracewright.queries import DAG

ENCRYPT = """
pattern encrypt   # order of the branches is free
    scope same_storyline
    step start  = exec  & ttp T1059
    step look   = read  & ttp T1083   after start
    step spoil  = exec  & ttp T1490   after start
    step lock   = write & ttp T1486   after look & spoil
                  -> disarm write,exec,create,inject,connect
end
"""
DROPPER = """
pattern dropper
    step drop = write & ttp T1105
    step trusted = write & ttp T_SIGNED & object=drop:object
    step run = exec & ttp any(T1059, T1106) & object=drop:object after drop unless trusted -> block
end
"""


def verdicts(text, rows):
    engine = LabelledEngine(compile_labelled(text))
    return [engine.on_event(*r) for r in rows]


def test_compiled():
    (p,) = compile_labelled(ENCRYPT)
    assert [(s.bit, s.needs, s.needs_any) for s in p.steps] == [(0, 0, 0), (1, 1, 0), (2, 1, 0), (3, 6, 0)]
    assert p.steps[3].action == "disarm" and labelled_tags([p]) == [1059, 1083, 1486, 1490]
    (d,) = compile_labelled(DROPPER)
    run = d.steps[2]
    assert (run.needs, run.unless, run.binds, run.any_tags) == (1, 2, (Bind("object", 0, "object"),), {1059, 1106}) and d.slots == ((0, "object"),)
    assert d.steps[1].all_tags == {"T_SIGNED"} and Engine.of(DROPPER, "labelled").referenced_tags(1) == ([1059], 4)


@pytest.mark.parametrize("body", [
    "", "step a = fly", "step a = ttp T1", "step a = exec after b", "step a = exec after a", "step a = exec\nstep a = read", "step a = exec\nstep b = read\nstep c = open\nstep d = write after a & b | c",
    "step a = exec after b\nstep b = read after a", "step a = exec & ttp 1059", "step a = exec & ttp any()", "step a = exec & object=a:object", "step a = exec & obj pipe", "step a = exec & obj file & obj file",
    "step a = exec & ttp T1 & ttp T2", "step a = exec -> allow", "step a = exec -> disarm", "step a = exec unless b", "scope all step a = exec", "step after = exec", "step a = exec ?", "\n".join(f"step s{i} = exec" for i in range(65)),
])
def test_errors(body):
    with pytest.raises(RuleError):
        compile_labelled(f"pattern p\n{body}\nend")


def test_text_errors():
    for text in ("", "step a = exec", "pattern p step a = exec", ENCRYPT + ENCRYPT, "pattern p step a = exec end end"):
        with pytest.raises(RuleError):
            compile_labelled(text)


def test_like_partial_order():
    assert verdicts(ENCRYPT, F2) == ["inspect", "ignore", "inspect", "ignore", "inspect", "disarm", "block", "ignore"]
    r = random.Random(5)
    rows = [(r.choice(["exec", "read", "write", "open", "load"]), f"proc:{r.randrange(12)}", f"{r.choice(['proc', 'file'])}:{r.randrange(12)}", r.sample([1059, 1083, 1490, 1486], r.randrange(3))) for _ in range(800)]
    core = CoreEngine(compile_rules(DAG, True), True)
    assert verdicts(ENCRYPT, rows) == [core.on_event(*x) for x in rows]


def test_binding_and_unless():
    drop, run, other = ("write", "proc:1", "file:X", ["T1105"]), ("exec", "proc:1", "file:X", [1059]), ("exec", "proc:1", "file:Y", [1059])
    assert verdicts(DROPPER, [drop, other, run, run]) == ["inspect", "ignore", "block", "ignore"]
    assert verdicts(DROPPER, [run, drop]) == ["ignore", "inspect"]
    assert verdicts(DROPPER, [drop, ("write", "proc:1", "file:X", ["T_SIGNED"]), run]) == ["inspect", "inspect", "ignore"]
    assert verdicts(DROPPER, [drop, ("write", "proc:1", "file:Y", ["T_SIGNED"]), run]) == ["inspect", "ignore", "block"]
    # one event opens the way and is trusted; a later trust doesn't undo
    assert verdicts(DROPPER, [("write", "proc:1", "file:X", ["T1105", "T_SIGNED"]), run]) == ["inspect", "ignore"]
    cross = "pattern p\nstep run = exec\nstep act = open & actor=run:object -> block\nend"
    assert verdicts(cross, [("exec", "proc:1", "proc:2", []), ("open", "proc:1", "file:a", []), ("open", "proc:2", "file:a", [])]) == ["inspect", "ignore", "block"]


def test_alternatives_kinds_scopes():
    either = "pattern p\nstep a = connect & ttp T1071\nstep b = connect & ttp all(T1048, T2)\nstep out = write & ttp T1041 after a | b -> block\nend"
    out = ("write", "proc:1", "file:x", [1041])
    assert verdicts(either, [out, ("connect", "proc:1", "sock:1", [1048]), out]) == ["ignore", "ignore", "ignore"]
    assert verdicts(either, [("connect", "proc:1", "sock:1", [1048, 2]), out]) == ["inspect", "block"]
    dump = "pattern p\nscope {}\nstep open = open & ttp T1003 & obj process -> disarm dup,inject\nstep dump = write after open -> block\nend"
    opened, near, far = ("open", "proc:1", "proc:2", [1003]), ("write", "proc:2", "file:d", []), ("write", "proc:8", "file:e", [])
    assert verdicts(dump.format("same_actor"), [("open", "proc:1", "file:2", [1003]), opened, near, ("inject", "proc:1", "proc:3", []), ("write", "proc:1", "file:d", [])]) == ["ignore", "disarm", "ignore", "block", "block"]
    assert verdicts(dump.format("same_storyline"), [opened, far, near]) == ["disarm", "ignore", "block"]
    assert verdicts(dump.format("free"), [opened, far]) == ["disarm", "block"]


def test_batch_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([("h", i, i, *f) for i, f in enumerate(F2)], "host string, seq long, ts long, op string, actor string, object string, ttps array<int>")
    want = ["inspect", "ignore", "inspect", "ignore", "inspect", "disarm", "block", "ignore"]
    assert [r.verdict for r in Engine.of(ENCRYPT, "labelled").run(rows).orderBy("seq").collect()] == want
    free = compile_labelled(ENCRYPT.replace("same_storyline", "free"))
    assert [r.verdict for r in replay_labelled(rows, free).orderBy("seq").collect()] == want
    assert replay_labelled(rows.limit(0), free).count() == 0
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    live = Engine.of(ENCRYPT, "labelled").run(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    live.writeStream.format("memory").queryName("labelled").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert [r.verdict for r in spark.table("labelled").orderBy("seq").collect()] == want
