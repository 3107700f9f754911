import random

import pytest

from tracewright.sources.frames import FRAME, FrameError, encode_frame, encode_record
from tracewright.sources.reader import read_events
from tracewright.sources.ring import DATA_AT, ring_image, unread


def frame(n, reply=False):
    return encode_frame([encode_record(2, 10_000 * n, 7, 50_000, file_name=f"C:\\f{n}" + "x" * (n % 13))], reply)


@pytest.mark.parametrize("tail", [0, 8, 1000, 1 << 40, 4088, 4000])
def test_round_trip(tail):
    r = random.Random(tail)
    made = [(frame(n), r.random() < 0.2) for n in range(80)]
    found, dropped, complete = unread(ring_image(made, 4096, tail))
    assert complete and len(found) + dropped == 80 and dropped
    rest = iter([f for f, _ in made])
    assert all(f in rest for f in found)  # in order
    plain, _, _ = unread(ring_image([(f, False) for f, _ in made], 4096, tail))
    assert sum(map(len, plain)) <= 4096 * 7 / 8 < sum(len(f) for f, _ in made)


def test_priority_and_uncommitted():
    few = [(frame(1), False), (frame(2), True), (frame(3), False)]
    size = 256
    assert [f in unread(ring_image(few, size))[0] for f, _ in few] == [True, True, sum(len(f) for f, _ in few) <= size * 7 / 8]
    image = bytearray(ring_image(few, 1024))
    at = DATA_AT + len(few[0][0])
    image[at : at + 4] = bytes(4)
    assert unread(bytes(image)) == ([few[0][0]], 0, False)
    assert unread(ring_image([], 64)) == ([], 0, True)


def test_damage():
    good = ring_image([(frame(1), False)], 1024)
    size = FRAME.unpack_from(good, DATA_AT)[0]
    for at, value in ((0, b"XXXX"), (4, b"\2\0"), (8, b"\3\0\0\0"), (8, b"\0\x10\0\0"), (64, b"\xff" * 8), (64, b"\4"), (DATA_AT, (size + 8).to_bytes(4, "little")), (DATA_AT, b"\7\0\0\0")):
        bad = bytearray(good)
        bad[at : at + len(value)] = value
        with pytest.raises(FrameError):
            unread(bytes(bad))
    with pytest.raises(FrameError):
        unread(good[:DATA_AT])


def test_read(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.ring").write_bytes(ring_image([(frame(10 * i + k), False) for k in range(4)], 1024, 1000))
    got = read_events(spark, "rings", str(tmp_path)).orderBy("ts").collect()
    assert [(r.op, r.actor, r.ts) for r in got] == [("write", "proc:7.5", 10 * i + k) for i in range(3) for k in range(4)]
