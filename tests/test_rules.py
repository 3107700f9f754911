import pytest

from tracewright.plans.rules import RuleError, compile_rules, compile_scored, decode, encode, referenced_tags
from tracewright.queries import DAG, LINEAR, SCORED


@pytest.mark.parametrize(("text", "dag"), [(LINEAR, False), (DAG, True)])
def test_round_trip(text, dag):
    rules = compile_rules(text, dag)
    assert decode(encode(rules, dag), dag) == rules
    assert referenced_tags(rules) == [1059, 1083, 1486, 1490]
    with pytest.raises(RuleError):
        decode(encode(rules, dag), not dag)
    for blob in (b"", encode(rules, dag)[:-1], encode(rules, dag) + b"x"):
        with pytest.raises(RuleError):
            decode(blob, dag)


@pytest.mark.parametrize("text", ["step ops=exec", "pattern a\nend", "pattern a\nstep ops=exec", "pattern a\nstep ops=fly\nend", "pattern a\nstep ops=exec action=disarm()\nend", "pattern a\nstep ops=exec action=block action=block\nend", "what"])
def test_linear_errors(text):
    with pytest.raises(RuleError):
        compile_rules(text, False)


@pytest.mark.parametrize("steps", ["step ops=exec", "step bit=64", "step bit=0\nstep bit=0", "step bit=0 prereq=1\nstep bit=1 prereq=0", "step bit=1 prereq=5", "step bit=0 action=disarm(write, exec)"])
def test_dag_errors(steps):
    with pytest.raises(RuleError):
        compile_rules(f"pattern a\n{steps}\nend", True)


def test_scored():
    rules = compile_scored(SCORED)
    assert [s.bit for s in rules.patterns[0].steps] == [0, 1, 2, 3] and rules.patterns[0].required == 15 and rules.patterns[0].block_bit == 3
    for bad in ("step x bit=0 match=op:exec", "pattern p scope=free theta_alert=1", "tagger T1 colour=red", "pattern p scope=free theta_alert=1 theta_block=2\nstep s bit=0 match=op:fly"):
        with pytest.raises(RuleError):
            compile_scored(bad)
