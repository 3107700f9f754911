import pytest

from tracewright.functions.tagging import tag_columns
from tracewright.operators.graph import connected_components
from tracewright.plans.rules import compile_scored
from tracewright.sources import frames, wire
from tracewright.sources.evt import read_evt


def test_evt(spark, tmp_path):
    f = tmp_path / "a.evt"
    f.write_text('# comment\n\nts=1 op=exec actor=1.2 object=proc:3.4 image="C:\\a b\\cmd.exe" x=1 x=2\nts=2 op=write actor=3.4 object=file:D\n')
    rows = read_evt(spark, str(f)).orderBy("seq").collect()
    assert [(r.ts, r.op, r.actor, r.object) for r in rows] == [(1, "exec", "proc:1.2", "proc:3.4"), (2, "write", "proc:3.4", "file:D")]
    assert rows[0].attrs == {"image": "C:\\a b\\cmd.exe", "x": "2"} and rows[1].attrs == {}
    f.write_text("ts=1 op=exec actor=1.2\n")
    with pytest.raises(Exception, match="no object"):
        read_evt(spark, str(f)).collect()


def test_tagging(spark):
    rules = compile_scored("tagger T1 op=write write_rate_ge=2 dir_spread_ge=2\ntagger T2 entropy_gt=0.5\ntagger T3 op=exec image_base_in=cmd.exe")
    rows = [(0, 0, "write", "a", {"dir": "x"}), (1, 900, "write", "a", {"dir": "y", "entropy": "0.5"}), (2, 900, "write", "a", {"dir": "y", "entropy": "0.6"}), (3, 2500, "write", "a", {}), (4, 2600, "exec", "a", {"image": "C:\\CMD.exe"})]
    e = spark.createDataFrame(rows, "seq long, ts long, op string, actor string, attrs map<string,string>")
    assert [r.tags for r in tag_columns(e, rules.taggers).orderBy("seq").collect()] == [[], ["T1"], ["T1", "T2"], [], ["T3"]]


def test_frames(spark):
    records = [frames.encode_record(103, 20_000_000, 50, 1, image="lsass.exe"), frames.encode_record(100, 20_000_000, 100, 10_000, child_pid=800, child_start=20_000, image="m.exe", cmdline="x"), frames.encode_record(102, 30_000_000, 800, 20_000, 7, target_pid=50, target_start=10_000, desired_access=0x10, target_image="lsass.exe")]
    frame = frames.encode_frame(records, reply=True)
    assert [r["type"] for r in frames.decode_frame(frame)] == ["exist", "create", "process_open"]
    assert len(list(frames.split_stream(frame * 3))) == 3
    for bad in (frame[:-1], frame + b"\0", b"\1"):
        with pytest.raises(frames.FrameError):
            list(frames.split_stream(bad)) and frames.decode_frame(bad)
    unknown = frames.encode_frame([frames.encode_record(200, 0, 1, 1), frames.encode_record(1, 0, 1, 1, file_name="f")])
    assert [r["type"] for r in frames.decode_frame(unknown)] == ["open"]
    rows = frames.normalise(frames.decode(spark.createDataFrame([(frame,)], "content binary"))).collect()
    assert [(r.ts, r.op, r.actor, r.object, r.req_id, r.reply) for r in rows] == [(2000, "exec", "proc:100.1", "proc:800.2", 0, True), (3000, "read", "proc:800.2", "proc:50.1", 7, True)]
    assert rows[1].attrs == {"target_image": "lsass.exe", "vm_read": "1"}


def test_wire():
    event = {"ts": 5, "op": "dup", "actor": "proc:1.2", "object": "sock:k", "attrs": {"b": "1", "a": "é"}}
    one = {"seq": 8, "storyline": 3, "ttps": ["T1"], "event": event}
    two = {"seq": 8, "pattern": "p", "score": 7.4, "reason": "r", "event": event | {"object": "reg:x", "attrs": {}}}
    data = wire.encode(one) + wire.encode(two)
    first, end = wire.decode(data)
    assert first == one and wire.decode(data, end) == (two, len(data))
    assert all(wire.decode(wire.encode(one)[:k]) is None for k in range(len(wire.encode(one))))
    for bad in (b"\0\0\0\0", b"\2\0\0\0\x0a\0"):
        with pytest.raises(wire.WireError):
            wire.decode(bad)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, None)]
    got = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == dict.fromkeys(range(41), 0) | {100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
