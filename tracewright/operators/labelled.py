"""Replaying events through rules of labelled steps.

A root step's event starts an instance: the steps it has done, the identities it has bound and the actor it
began with. Equal instances of a storyline are one. Instances of scope ``free`` see every event of a host, so
such rules are routed by host; all others by connected component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tracewright.model import OP_BITS, VERDICTS
from tracewright.operators.replay import Forest, routed, walked
from tracewright.plans.labelled import LabelledPattern, tag_key

_RANK = {v: i for i, v in enumerate(VERDICTS)}
_KIND = {"proc": "process", "file": "file", "sock": "socket"}


class LabelledEngine:
    """A verdict for each event. An instance is ``(pattern, done, bound, first actor)``."""

    def __init__(self, patterns: list[LabelledPattern]):
        self.patterns = patterns
        self.lines = Forest(set, lambda a, b: a | b)
        self.anywhere: set = set()
        self.disarmed: dict = {}

    def on_event(self, op: str, actor, object_, tags) -> str:
        bit = OP_BITS.get(op, 0)
        if not bit:
            return "ignore"
        if self.disarmed.get(actor, 0) & bit:
            return "block"
        line = self.lines.unite(actor, object_)
        tags, kind = frozenset(map(tag_key, tags)), _KIND.get(str(object_).split(":", 1)[0], "other")
        hits = {i: found for i, p in enumerate(self.patterns) if (found := [s for s in p.steps if s.matches(bit, tags, kind)])}
        if not hits:
            return "ignore"
        verdict, now = "ignore", {"actor": actor, "object": object_}
        near = self.lines.value[line]
        for i, steps in hits.items():
            p = self.patterns[i]
            held = self.anywhere if p.scope == "free" else near
            started = {(i, 0, (None,) * len(p.slots), actor)} if any(s.root for s in steps) else set()
            for one in [x for x in held if x[0] == i and (p.scope != "same_actor" or x[3] == actor)] + list(started):
                after, fired = self._advance(one, p, steps, now)
                if fired:
                    held.discard(one)
                    held.add(after)
                for s in fired:
                    verdict = max(verdict, s.action, key=_RANK.__getitem__)
                    if s.disarm:
                        self.disarmed[actor] = self.disarmed.get(actor, 0) | s.disarm
        return verdict

    @staticmethod
    def _advance(one: tuple, p: LabelledPattern, steps: list, now: dict) -> tuple[tuple, list]:
        """The instance after the event, and the steps it did, in the order they are written."""
        i, done, bound, owner = one
        fired, values = [], dict(zip(p.slots, bound, strict=True))
        for s in steps:
            if s.ready(done) and all(values[b.bit, b.source] == now[b.field] for b in s.binds):
                done |= 1 << s.bit
                fired.append(s)
                values |= {slot: now[slot[1]] for slot in p.slots if slot[0] == s.bit}
        return (i, done, tuple(values[slot] for slot in p.slots), owner), fired


def replay_labelled(events: DataFrame, patterns: list[LabelledPattern], host: str = "host") -> DataFrame:
    """``seq, verdict`` of ``events(seq, ts, op, actor, object, ttps)``; ``host`` is needed if a pattern's scope is free."""

    step = lambda engine, ts, op, actor, object_, ttps: (engine.on_event(op, actor, object_, ttps or ()),)
    rows, key = (events, host) if any(p.scope == "free" for p in patterns) else (routed(events, False), "component")
    return walked(rows, key, ["op", "actor", "object", "ttps"], lambda: LabelledEngine(patterns), step, "seq long, verdict string")
