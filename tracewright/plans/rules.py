"""Rule languages: the linear and partial-order grammars, the scored grammar, and the binary rule format."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass, field

from tracewright.model import OP_BITS, OPS


class RuleError(ValueError):
    """A rule text or blob that can't be used; ``line`` is 0 where none applies."""

    def __init__(self, message: str, line: int = 0):
        super().__init__(f"line {line}: {message}" if line else message)
        self.line = line


@dataclass(frozen=True)
class Step:
    """One step of a linear or partial-order pattern; no operations means any."""

    ops: int = 0
    tags: tuple[int, ...] = ()
    action: str = "inspect"
    disarm: int = 0
    bit: int = -1
    prereq: int = 0

    def matches(self, op: int, tags: frozenset[int]) -> bool:
        return (not self.ops or bool(self.ops & op)) and tags.issuperset(self.tags)


@dataclass(frozen=True)
class Pattern:
    name: str
    steps: tuple[Step, ...]


def _tag(text: str, line: int) -> int:
    try:
        return int(text.removeprefix("T"))
    except ValueError:
        raise RuleError(f"bad tag {text!r}", line) from None


def _mask(names: str, sep: str, line: int) -> int:
    out = 0
    for name in names.split(sep):
        if name.strip() not in OP_BITS:
            raise RuleError(f"unknown op {name!r}", line)
        out |= OP_BITS[name.strip()]
    return out


def _step(words: list[str], dag: bool, line: int) -> Step:
    values: dict = {}
    for word in words:
        key, eq, value = word.partition("=")
        if not eq or key in values or key not in ("ops", "ttps", "action", *(("bit", "prereq") if dag else ())):
            raise RuleError(f"bad or repeated key {word!r}", line)
        values[key] = value
    action, disarm = "inspect", 0
    if "action" in values:
        a = values["action"]
        if a == "block":
            action = "block"
        elif a.startswith("disarm(") and a.endswith(")") and a[7:-1]:
            action, disarm = "disarm", _mask(a[7:-1], ",", line)
        else:
            raise RuleError(f"unknown action {a!r}", line)
    bits = lambda text: [int(x) if x.isascii() and x.isdigit() and int(x) < 64 else _fail(f"bad bit {x!r}", line) for x in text.split(",")]
    if dag and "bit" not in values:
        raise RuleError("a step needs a bit", line)
    return Step(
        _mask(values["ops"], "|", line) if "ops" in values else 0, tuple(_tag(t, line) for t in values["ttps"].split(",")) if "ttps" in values else (),
        action, disarm, bits(values["bit"])[0] if dag else -1, sum(1 << b for b in set(bits(values["prereq"]))) if "prereq" in values else 0,
    )


def _fail(message: str, line: int = 0):
    raise RuleError(message, line)


def compile_rules(text: str, dag: bool) -> list[Pattern]:
    """Patterns of a ``pattern NAME / step ... / end`` text; whole-line comments by ``#``."""
    out: list[Pattern] = []
    name, steps = "", []
    for line, raw in enumerate(text.splitlines(), 1):
        words = raw.split()
        if not words or words[0].startswith("#"):
            continue
        if words[0] == "pattern":
            if name or len(words) != 2:
                raise RuleError("a pattern needs one name, outside of other patterns", line)
            name, steps = words[1], []
            if any(p.name == name for p in out):
                raise RuleError(f"pattern {name!r} is defined twice", line)
        elif words[0] == "step":
            if not name:
                raise RuleError("a step stands outside of a pattern", line)
            steps.append(_step(words[1:], dag, line))
            if dag and any(s.bit == steps[-1].bit for s in steps[:-1]):
                raise RuleError(f"bit {steps[-1].bit} is used twice", line)
        elif words == ["end"]:
            if not name or not steps:
                raise RuleError("an end without a pattern or its steps", line)
            out.append(Pattern(name, tuple(steps)))
            if dag:
                validate(out[-1], line)
            name = ""
        else:
            raise RuleError(f"unknown directive {words[0]!r}", line)
    if name:
        raise RuleError(f"pattern {name!r} isn't ended")
    return out


def validate(pattern: Pattern, line: int = 0) -> None:
    """Every step must be reachable from a root, so that no prerequisite is missing or part of a cycle."""
    reached, left = 0, list(pattern.steps)
    while ready := [s for s in left if s.prereq & reached == s.prereq]:
        reached |= sum(1 << s.bit for s in ready)
        left = [s for s in left if s not in ready]
    if left or not pattern.steps:
        raise RuleError(f"pattern {pattern.name!r} has steps that can't be reached", line)


def referenced_tags(patterns: list[Pattern]) -> list[int]:
    return sorted({t for p in patterns for s in p.steps for t in s.tags})


# Fixed values of the binary rule format.
MAGIC = {False: b"ERL1", True: b"ERD1"}
_ACTIONS = ("inspect", "block", "disarm")


def encode(patterns: list[Pattern], dag: bool) -> bytes:
    out = [MAGIC[dag], struct.pack("<H", len(patterns))]
    for p in patterns:
        name = p.name.encode()
        out += [struct.pack("<H", len(name)), name, struct.pack("<H", len(p.steps))]
        for s in p.steps:
            out.append((struct.pack("<BQ", s.bit, s.prereq) if dag else b"") + struct.pack(f"<IB{len(s.tags)}IB", s.ops, len(s.tags), *s.tags, _ACTIONS.index(s.action)))
            if s.action == "disarm":
                out.append(struct.pack("<I", s.disarm))
    return b"".join(out)


def decode(blob: bytes, dag: bool) -> list[Pattern]:
    at = 4

    def take(kind: str) -> tuple:
        nonlocal at
        try:
            found = struct.unpack_from("<" + kind, blob, at)
        except struct.error:
            raise RuleError("the blob is cut off") from None
        at += struct.calcsize("<" + kind)
        return found

    if len(blob) < 4:
        raise RuleError("the blob is cut off")
    if blob[:4] != MAGIC[dag]:
        raise RuleError("wrong magic")
    out = []
    for _ in range(take("H")[0]):
        (size,) = take("H")
        try:
            name = take(f"{size}s")[0].decode()
        except UnicodeDecodeError:
            raise RuleError("a name isn't UTF-8") from None
        steps = []
        for _ in range(take("H")[0]):
            bit, prereq = take("BQ") if dag else (-1, 0)
            ops, n = take("IB")
            tags = take(f"{n}I")
            (code,) = take("B")
            if code >= len(_ACTIONS):
                raise RuleError("unknown action code")
            steps.append(Step(ops, tags, _ACTIONS[code], take("I")[0] if code == 2 else 0, bit, prereq))
        out.append(Pattern(name, tuple(steps)))
    if at != len(blob):
        raise RuleError("bytes follow the last pattern")
    return out


# The scored grammar.

TACTICS = ("execution", "discovery", "defense_evasion", "impact", "credential_access", "staging")


@dataclass(frozen=True)
class Meta:
    tactic: str = "staging"
    severity: float = 1.0
    rarity: float = 0.15


@dataclass(frozen=True)
class Tagger:
    tag: str
    conditions: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class ScoredStep:
    name: str
    bit: int
    tags: tuple[str, ...] = ()
    op: str = ""
    prereq: int = 0
    window: int = 0
    enforceable: bool = False
    optional: bool = False
    binds: tuple[tuple[str, str], ...] = ()

    def matches(self, op: str, tags: list[str]) -> bool:
        return self.op == op if self.op else any(t in tags for t in self.tags)

    def enforced_op(self) -> str:
        """The operation to deny: by the step's first tag where it names none."""
        return self.op or {"T1490": "exec", "T1003": "read"}.get(self.tags[0] if self.tags else "", "write")


@dataclass
class ScoredPattern:
    name: str
    scope: str
    alert: float
    block: float
    gate: str = "always"
    steps: list[ScoredStep] = field(default_factory=list)
    block_bit: int = -1

    @property
    def required(self) -> int:
        return sum(1 << s.bit for s in self.steps if not s.optional)


@dataclass
class ScoredRules:
    meta: dict[str, Meta] = field(default_factory=dict)
    taggers: list[Tagger] = field(default_factory=list)
    patterns: list[ScoredPattern] = field(default_factory=list)


CONDITIONS = ("op", "image_base_in", "target_image_base", "attr_true", "entropy_gt", "write_rate_ge", "dir_spread_ge", "cmd_recovery_inhibit")
#: Conditions added by ``add_condition``: of an event's operation and attributes in Python, and as a column.
USER_CONDITIONS: dict[str, tuple[Callable[[str, dict, str], bool], Callable]] = {}


def add_condition(name: str, test: Callable[[str, dict, str], bool], column: Callable) -> None:
    """A tagger condition of one's own, ``name=argument`` in a rule.

    ``test(op, attrs, argument)`` serves the engines, ``column(argument)`` tables: a Column over ``op, attrs, write_rate,
    dir_spread``, of built-in functions or a pandas UDF.
    """
    if name in CONDITIONS or not name.isidentifier():
        raise ValueError(f"{name!r} is taken or no name")
    USER_CONDITIONS[name] = test, column


_FLAGS = {"enforceable", "optional", "block"}


def compile_scored(text: str, strict: bool = True) -> ScoredRules:
    """Rules of one directive a line: ttp, tagger, pattern, step; ``#`` starts a comment anywhere.

    A repeated bit or a prerequisite that can't be reached is an error, unless ``strict`` is off: such steps are
    then kept as they are written, and simply never fire.
    """
    out = ScoredRules()
    for line, raw in enumerate(text.splitlines(), 1):
        words = raw.split("#", 1)[0].split()
        if not words:
            continue
        kind, *rest = words
        if not rest or kind not in ("ttp", "tagger", "pattern", "step"):
            raise RuleError(f"unknown or empty directive {kind!r}", line)
        pairs = [(k, v) for k, _, v in (w.partition("=") for w in rest[1:])]
        values = dict(pairs)
        try:
            if kind == "ttp":
                if values["tactic"] not in TACTICS:
                    raise RuleError(f"unknown tactic {values['tactic']!r}", line)
                out.meta[rest[0]] = Meta(values["tactic"], float(values["severity"]), float(values["rarity"]))
            elif kind == "tagger":
                if bad := [k for k, _ in pairs if k not in CONDITIONS and k not in USER_CONDITIONS]:
                    raise RuleError(f"unknown condition {bad[0]!r}", line)
                out.taggers.append(Tagger(rest[0], tuple(pairs)))
            elif kind == "pattern":
                if values["scope"] not in ("same_storyline", "same_actor", "free") or values.get("root_gate", "always") not in ("always", "pe_write"):
                    raise RuleError("unknown scope or gate", line)
                out.patterns.append(ScoredPattern(rest[0], values["scope"], float(values["theta_alert"]), float(values["theta_block"]), values.get("root_gate", "always")))
            else:
                if not out.patterns:
                    raise RuleError("a step stands before any pattern", line)
                _add_step(out.patterns[-1], rest[0], pairs, values, line, strict)
        except KeyError as e:
            raise RuleError(f"{kind} needs {e.args[0]}", line) from None
        except ValueError as e:
            raise e if isinstance(e, RuleError) else RuleError(str(e), line) from None
    for p in out.patterns if strict else ():
        validate(Pattern(p.name, tuple(Step(bit=s.bit, prereq=s.prereq) for s in p.steps)))
    return out


def _add_step(pattern: ScoredPattern, name: str, pairs: list, values: dict, line: int, strict: bool) -> None:
    how, _, what = values["match"].partition(":")
    if how not in ("ttp", "ttp_any", "op") or not what or how == "op" and what not in OPS:
        raise RuleError(f"bad match {values['match']!r}", line)
    bit = int(values["bit"])
    if not 0 <= bit < 64 or strict and any(s.bit == bit for s in pattern.steps):
        raise RuleError(f"bit {bit} is out of range or used twice", line)
    binds = tuple(tuple(v.split(":", 1)) for k, v in pairs if k == "bind")
    if any(len(b) != 2 or b[1] not in ("object", "actor", "image") for b in binds):
        raise RuleError("bad bind", line)
    flags = {k for k, v in pairs if k in _FLAGS}
    prereq = sum(1 << int(x) for x in values.get("prereq", "").split(",") if x)
    tags = () if how == "op" else tuple(what.replace("|", ",").split(",")) if how == "ttp_any" else (what,)
    pattern.steps.append(ScoredStep(name, bit, tags, what if how == "op" else "", prereq, int(values.get("seg_window", 0)), "enforceable" in flags, "optional" in flags, binds))
    if "block" in flags:
        pattern.block_bit = bit
