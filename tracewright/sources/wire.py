"""The shipping format: u32 length, then a protobuf message of an event or a block report.

Only the wire types this schema uses are written and read by hand, so no generated code is needed.
"""

from __future__ import annotations

import struct

from tracewright.model import OPS

_CODE = {op: codes[3] for op, codes in OPS.items()}
_NAME = {v: k for k, v in _CODE.items()}
_KEYS = {"proc": 1, "file": 2, "sock": 3}


class WireError(ValueError):
    """A message that lacks a part or holds an unknown operation."""


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bytes(field: int, raw: bytes | str) -> bytes:
    raw = raw.encode() if isinstance(raw, str) else raw
    return _varint(field << 3 | 2) + _varint(len(raw)) + raw


def _int(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n) if n else b""


def _text(field: int, s: str) -> bytes:
    return _bytes(field, s) if s else b""


def _key(identity: str) -> bytes:
    kind, _, rest = identity.partition(":")
    if kind == "proc":
        pid, _, start = rest.partition(".")
        return _bytes(1, _int(1, int(pid)) + _int(2, int(start or 0)))
    return _bytes(_KEYS[kind], _text(1, rest)) if kind in _KEYS else _bytes(4, _text(1, kind) + _text(2, rest))


def _event(e: dict) -> bytes:
    attrs = b"".join(_bytes(5, _text(1, k) + _text(2, v)) for k, v in sorted((e.get("attrs") or {}).items()))
    return _int(1, e["ts"]) + _int(2, _CODE[e["op"]]) + _bytes(3, _key(e["actor"])) + _bytes(4, _key(e["object"])) + attrs


def encode(message: dict) -> bytes:
    """A framed message; one with ``pattern`` is a block report. Attributes are sorted."""
    m = message
    if "pattern" in m:
        score = _varint(3 << 3 | 1) + struct.pack("<d", m["score"]) if m["score"] else b""
        body = _bytes(2, _int(1, m["seq"]) + _text(2, m["pattern"]) + score + _text(4, m["reason"]) + _bytes(5, _event(m["event"])))
    else:
        body = _bytes(1, _int(1, m["seq"]) + _int(2, m.get("storyline", 0)) + b"".join(_bytes(3, t) for t in m.get("ttps", ())) + _bytes(4, _event(m["event"])))
    return struct.pack("<I", len(body)) + body


def _fields(data: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            if at >= len(data) or shift > 63:
                raise WireError("a number is cut off")
            b = data[at]
            at += 1
            n |= (b & 0x7F) << shift
            if b < 0x80:
                return n
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        size = {0: 0, 1: 8, 5: 4}.get(kind) if kind != 2 else varint()
        if size is None or at + size > len(data):
            raise WireError("a field is cut off or of an unknown kind")
        value = varint() if kind == 0 else data[at : at + size]
        at += size
        out.setdefault(tag >> 3, []).append(value)
    return out


def _one(fields: dict, field: int, default=b""):
    return fields.get(field, [default])[-1]


def _identity(data: bytes | None) -> str:
    for field, values in _fields(data or b"").items():
        inner = _fields(values[-1])
        if field == 1:
            return f"proc:{_one(inner, 1, 0)}.{_one(inner, 2, 0)}"
        if field in (2, 3):
            return f"{'file' if field == 2 else 'sock'}:{_one(inner, 1).decode()}"
        if field == 4:
            return f"{_one(inner, 1).decode()}:{_one(inner, 2).decode()}"
    raise WireError("an event lacks its actor or object")


def _read_event(data: bytes | None) -> dict:
    f = _fields(data or b"")
    if _one(f, 2, 0) not in _NAME:
        raise WireError("an unknown operation")
    attrs = {_one(a, 1).decode(): _one(a, 2).decode() for a in map(_fields, f.get(5, ()))}
    return {"ts": _one(f, 1, 0), "op": _NAME[_one(f, 2, 0)], "actor": _identity(_one(f, 3, None)), "object": _identity(_one(f, 4, None)), "attrs": attrs}


def decode(data: bytes, at: int = 0) -> tuple[dict, int] | None:
    """The message at an offset and where it ends; None if it isn't complete yet."""
    if at + 4 > len(data):
        return None
    (size,) = struct.unpack_from("<I", data, at)
    if at + 4 + size > len(data):
        return None
    f = _fields(data[at + 4 : at + 4 + size])
    end = at + 4 + size
    if 1 in f:
        m = _fields(f[1][-1])
        return {"seq": _one(m, 1, 0), "storyline": _one(m, 2, 0), "ttps": [t.decode() for t in m.get(3, ())], "event": _read_event(_one(m, 4, None))}, end
    if 2 in f:
        m = _fields(f[2][-1])
        return {"seq": _one(m, 1, 0), "pattern": _one(m, 2).decode(), "score": struct.unpack("<d", _one(m, 3, b"\0" * 8))[0], "reason": _one(m, 4).decode(), "event": _read_event(_one(m, 5, None))}, end
    raise WireError("a message is empty")
