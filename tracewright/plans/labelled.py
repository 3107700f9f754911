"""Rules of labelled steps: tags by any or all, object kinds, identity bindings, alternatives, exclusions, scopes.

    pattern dropper
        scope same_storyline
        step drop = write & ttp T1105
        step run  = exec & ttp any(T1059, T1106) & object=drop:object  after drop  unless trusted  -> block
        step trusted = write & ttp T_SIGNED & object=drop:object
    end

A step starts with an operation (``any`` for all of them). A binding ``object=drop:object`` asks for the same
identity and implies that the named step is done. ``after`` joins steps either by ``&`` (all) or by ``|`` (any).
``unless`` leaves the step out once a listed one is done. Steps get their bits in the order they are written.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from tracewright.model import OP_BITS
from tracewright.plans.rules import RuleError

SCOPES = ("same_storyline", "same_actor", "free")
KINDS = ("process", "file", "socket")
FIELDS = ("actor", "object")
_RESERVED = frozenset("pattern scope step end after unless ttp obj".split())
_TOKEN = re.compile(r"\s*(->|[A-Za-z_]\w*|[&|,()=:])")


@dataclass(frozen=True)
class Bind:
    """``field`` must be what ``source`` was when the step of ``bit`` was done."""

    field: str
    bit: int
    source: str


@dataclass(frozen=True)
class LabelledStep:
    name: str
    bit: int
    ops: int = 0
    all_tags: frozenset = frozenset()
    any_tags: frozenset = frozenset()
    kind: str = ""
    binds: tuple[Bind, ...] = ()
    needs: int = 0
    needs_any: int = 0
    unless: int = 0
    action: str = "inspect"
    disarm: int = 0

    def matches(self, op: int, tags: frozenset, kind: str) -> bool:
        return (not self.ops or bool(self.ops & op)) and tags >= self.all_tags and (not self.any_tags or not tags.isdisjoint(self.any_tags)) and self.kind in ("", kind)

    def ready(self, done: int) -> bool:
        return not done >> self.bit & 1 and self.needs & done == self.needs and (not self.needs_any or bool(self.needs_any & done)) and not self.unless & done

    @property
    def root(self) -> bool:
        return not self.needs and not self.needs_any


@dataclass(frozen=True)
class LabelledPattern:
    name: str
    scope: str
    steps: tuple[LabelledStep, ...]

    @property
    def slots(self) -> tuple[tuple[int, str], ...]:
        """What an instance remembers: the fields of steps that bindings name."""
        return tuple(sorted({(b.bit, b.source) for s in self.steps for b in s.binds}))


def tag_key(tag) -> int | str:
    """A tag as a number where it is one, with or without its ``T``; else as written."""
    text = str(tag).removeprefix("T")
    return int(text) if text.isdigit() else str(tag)


def _tokens(text: str) -> list[tuple[str, int]]:
    out = []
    for line, raw in enumerate(text.splitlines(), 1):
        code, at = raw.split("#", 1)[0].rstrip(), 0
        while at < len(code):
            m = _TOKEN.match(code, at)
            if not m:
                raise RuleError(f"can't read {code[at:].strip()!r}", line)
            out.append((m[1], line))
            at = m.end()
    return out


class _Reader:
    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    @property
    def line(self) -> int:
        return self.tokens[min(self.at, len(self.tokens) - 1)][1] if self.tokens else 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][0] if self.at + ahead < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        found = self.peek()
        if not found or wanted and found not in wanted:
            raise RuleError(f"expected {' or '.join(wanted) or 'more'}, found {found or 'the end'!r}", self.line)
        self.at += 1
        return found

    def name(self) -> str:
        found = self.take()
        if not found.isidentifier() or found in _RESERVED:
            raise RuleError(f"bad name {found!r}", self.line)
        return found

    def listed(self, sep: str, item) -> list:
        out = [item()]
        while self.peek() == sep:
            self.take()
            out.append(item())
        return out

    def tag(self) -> int | str:
        found = self.name()
        if not found.startswith("T"):
            raise RuleError(f"bad tag {found!r}", self.line)
        return tag_key(found)

    def op(self) -> int:
        return OP_BITS[self.take(*OP_BITS)]


def _step(r: _Reader) -> tuple[dict, list, list[str], str, list[str]]:
    """One step's own values, its bindings, prerequisites with their joint, and exclusions, all by name."""
    values, binds, after, joint, unless = {"name": r.name()}, [], [], "&", []
    r.take("=")
    values["ops"] = 0 if r.peek() == "any" and r.take() else r.op()
    while r.peek() == "&":
        r.take()
        line, word = r.line, r.take("ttp", "obj", *FIELDS)
        if word in FIELDS:
            r.take("=")
            source = r.name()
            r.take(":")
            binds.append((word, source, r.take(*FIELDS)))
        elif word == "obj" and "kind" not in values:
            values["kind"] = r.take(*KINDS)
        elif word == "ttp" and not {"all_tags", "any_tags"} & values.keys():
            if r.peek() in ("any", "all") and r.peek(1) == "(":
                how = r.take()
                r.take("(")
                values[f"{how}_tags"] = frozenset(r.listed(",", r.tag))
                r.take(")")
            else:
                values["all_tags"] = frozenset([r.tag()])
        else:
            raise RuleError(f"{word} is given twice", line)
    if r.peek() == "after":
        r.take()
        after.append(r.name())
        joint = r.peek() if r.peek() in ("&", "|") else "&"
        while r.peek() in ("&", "|"):
            if r.take() != joint:
                raise RuleError("one 'after' can't join steps by both & and |", r.line)
            after.append(r.name())
    if r.peek() == "unless":
        r.take()
        unless = r.listed(",", r.name)
    if r.peek() == "->":
        r.take()
        values["action"] = r.take("block", "disarm")
        if values["action"] == "disarm":
            values["disarm"] = 0
            for bit in r.listed(",", r.op):
                values["disarm"] |= bit
    return values, binds, after, joint, unless


def _pattern(r: _Reader) -> LabelledPattern:
    name, scope, line = r.name(), SCOPES[0], r.line
    if r.peek() == "scope":
        r.take()
        scope = r.take(*SCOPES)
    parts = []
    while r.peek() == "step":
        r.take()
        parts.append((r.line, *_step(r)))
    r.take("step", "end")
    bits = {values["name"]: bit for bit, (_, values, *_) in enumerate(parts)}
    if not parts or len(parts) > 64 or len(bits) < len(parts):
        raise RuleError(f"pattern {name!r} needs 1 to 64 steps of different names", line)
    steps = []
    for bit, (at, values, binds, after, joint, unless) in enumerate(parts):
        for other in [*after, *unless, *(b[1] for b in binds)]:
            if other not in bits or bits[other] == bit:
                raise RuleError(f"step {values['name']!r} names {other!r}", at)
        mask = lambda names: sum({1 << bits[n] for n in names})
        step = LabelledStep(bit=bit, binds=tuple(Bind(f, bits[s], g) for f, s, g in binds), needs=mask(b[1] for b in binds), unless=mask(unless), **values)
        steps.append(replace(step, needs_any=mask(after)) if joint == "|" else replace(step, needs=step.needs | mask(after)))
    reached, left = 0, steps
    while found := [s for s in left if s.needs & reached == s.needs and (not s.needs_any or s.needs_any & reached)]:
        reached |= sum(1 << s.bit for s in found)
        left = [s for s in left if s not in found]
    if left:
        raise RuleError(f"pattern {name!r}: step {left[0].name!r} can't be reached", line)
    return LabelledPattern(name, scope, tuple(steps))


def compile_labelled(text: str) -> list[LabelledPattern]:
    """Patterns of a rule text; a text without any is an error."""
    r, out = _Reader(text), []
    while r.peek():
        r.take("pattern")
        out.append(_pattern(r))
        if any(p.name == out[-1].name for p in out[:-1]):
            raise RuleError(f"pattern {out[-1].name!r} is defined twice", r.line)
    if not out:
        raise RuleError("there are no patterns")
    return out


def labelled_tags(patterns: list[LabelledPattern]) -> list:
    return sorted({t for p in patterns for s in p.steps for t in s.all_tags | s.any_tags}, key=lambda t: (isinstance(t, str), t))
