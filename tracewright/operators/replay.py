"""Replaying ordered events through rules: linear, partial-order (also bounded) and scored dialects.

Events of different connected components never influence each other, so a batch is routed by component,
sorted by ``(ts, seq)`` within it (a sort that spills) and streamed through one live engine at a time: a task holds
what its engine has learnt of the component it is at, never the component's events. Components without an event
that begins a pattern never reach Python. The scored dialect connects by causal operations only and routes by the
actor's component; the bounded dialect's ceilings count over a host, so it is routed by host.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.tagging import recovery_inhibit
from tracewright.model import CAUSAL, KINDS, OP_BITS, VERDICTS, op_bit
from tracewright.operators.graph import connected_components
from tracewright.plans.rules import USER_CONDITIONS, Pattern, ScoredPattern, ScoredRules, Step
from tracewright.storage import small

_RANK = {v: i for i, v in enumerate(VERDICTS)}


class Forest:
    """Disjoint sets that carry a value; the larger set takes the smaller one's."""

    def __init__(self, make, join):
        self.up: dict = {}
        self.value: dict = {}
        self.size: dict = {}
        self.make, self.join = make, join

    def root(self, key):
        if key not in self.up:
            self.up[key], self.size[key], self.value[key] = key, 1, self.make()
        while self.up[key] != key:
            self.up[key] = self.up[self.up[key]]
            key = self.up[key]
        return key

    def unite(self, a, b):
        a, b = self.root(a), self.root(b)
        if a == b:
            return a
        if self.size[a] < self.size[b]:
            a, b = b, a
        self.up[b] = a
        self.size[a] += self.size.pop(b)
        self.value[a] = self.join(self.value[a], self.value.pop(b))
        return a

    def forget(self, lines: set) -> int:
        """Leave out whole sets by their roots; how many keys went."""
        gone = {k for k in list(self.up) if self.root(k) in lines}
        self.up = {k: r for k, r in self.up.items() if k not in gone}
        for r in lines:
            self.size.pop(r, None)
            self.value.pop(r, None)
        return len(gone)


class CoreEngine:
    """Linear or partial-order rules over storylines; a verdict for each event.

    A storyline keeps distinct ``(pattern, progress)`` pairs with the time each last moved: equal automata behave
    alike, so their number stays below the number of states whatever the stream's length. ``expire`` forgets what
    has been still for long, which an endless stream needs.
    """

    def __init__(self, patterns: list[Pattern], dag: bool):
        self.patterns, self.dag = patterns, dag
        self.lines = Forest(dict, lambda a, b: {k: max(x[k] for x in (a, b) if k in x) for k in a | b})
        self.touched: dict = {}
        self.disarmed: dict = {}
        self.edges = 0
        #: Whether the last event became an edge: it had a known operation and wasn't stopped.
        self.edge = False

    def storyline_of(self, key) -> set:
        root = self.lines.root(key)
        return {k for k in list(self.lines.up) if self.lines.root(k) == root}

    def expire(self, before: int) -> int:
        """Drop automata that haven't moved since a time, then storylines without any that no event has touched since.

        Returns how many identities are forgotten; what they are disarmed for stays.
        """
        for line, autos in self.lines.value.items():
            self.lines.value[line] = {k: t for k, t in autos.items() if t >= before}
        latest: dict = {}
        for key, t in self.touched.items():
            root = self.lines.root(key)
            latest[root] = max(latest.get(root, t), t)
        still = {r for r, t in latest.items() if t < before and not self.lines.value[r]}
        gone = self.lines.forget(still)
        self.touched = {r: t for r, t in latest.items() if r not in still}
        return gone

    def on_event(self, op: str, actor, object_, tags, ts: int = 0) -> str:
        bit, tags = OP_BITS.get(op, 0), frozenset(tags)
        self.edge = False
        if not bit:
            return "ignore"
        if self.disarmed.get(actor, 0) & bit:
            return "block"
        self.edges += 1
        self.edge = True
        line = self.lines.unite(actor, object_)
        self.touched[line] = max(self.touched.get(line, ts), ts)
        fired = self._dag(line, bit, tags, ts) if self.dag else self._linear(line, bit, tags, ts)
        verdict = "ignore"
        for step in fired:
            verdict = max(verdict, step.action, key=_RANK.__getitem__)
            if step.disarm:
                self.disarmed[actor] = self.disarmed.get(actor, 0) | step.disarm
        return verdict

    def _linear(self, line, bit, tags, ts):
        fired, after = [], {}
        seeds = {(i, 1): ts for i, p in enumerate(self.patterns) if p.steps[0].matches(bit, tags)}
        fired += [self.patterns[i].steps[0] for i, _ in seeds]
        for (i, stage), moved in (self.lines.value[line] | seeds).items():
            steps = self.patterns[i].steps
            if stage < len(steps) and steps[stage].matches(bit, tags):
                fired.append(steps[stage])
                stage, moved = stage + 1, ts
            after[i, stage] = max(after.get((i, stage), moved), moved)
        self.lines.value[line] = after
        return fired

    def _dag(self, line, bit, tags, ts):
        fired, after = [], {}
        hits = {i: found for i, p in enumerate(self.patterns) if (found := [s for s in p.steps if s.matches(bit, tags)])}
        seeds = {(i, 0): ts for i, found in hits.items() if any(not s.prereq for s in found)}
        for (i, done), moved in (self.lines.value[line] | seeds).items():
            for s in hits.get(i, ()):
                if not done >> s.bit & 1 and s.prereq & done == s.prereq:
                    done, moved = done | 1 << s.bit, ts
                    fired.append(s)
            after[i, done] = max(after.get((i, done), moved), moved)
        self.lines.value[line] = after
        return fired


class BoundedEngine:
    """Partial-order rules under fixed ceilings; where one is reached the engine fails open."""

    def __init__(self, patterns: list[Pattern], identities: int = 4096, storylines: int = 256, members: int = 24, automata: int = 24, disarms: int = 1024):
        self.patterns = patterns
        self.identities, self.storylines, self.members, self.automata, self.disarms = identities, storylines, members, automata, disarms
        self.line_of: dict = {}
        self.lines: dict[int, tuple[set, list]] = {}
        self.free: list[int] = list(range(storylines))[::-1]
        self.disarmed: dict = {}

    def _resolve(self, key) -> int | None:
        if key not in self.line_of:
            if len(self.line_of) >= self.identities or not self.free:
                return None
            self.line_of[key] = self.free.pop()
            self.lines[self.line_of[key]] = ({key}, [])
        return self.line_of[key]

    def _unite(self, a: int, b: int) -> int:
        if a == b:
            return a
        if len(self.lines[a][0]) < len(self.lines[b][0]):
            a, b = b, a
        (mine, autos), (other, more) = self.lines[a], self.lines[b]
        if len(mine) + len(other) > self.members or len(autos) + len(more) > self.automata:
            return -1
        mine |= other
        autos += more
        for key in other:
            self.line_of[key] = a
        del self.lines[b]
        self.free.append(b)
        return a

    def on_event(self, op: str, actor, object_, tags) -> str:
        bit, tags = OP_BITS.get(op, 0), frozenset(tags)
        if not bit:
            return "ignore"
        if self.disarmed.get(actor, 0) & bit:
            return "block"
        a = self._resolve(actor)
        b = self._resolve(object_) if a is not None else None
        if a is None or b is None:
            return "ignore"
        line = self._unite(a, b)
        line = a if line < 0 else line
        autos = self.lines[line][1]
        verdict = "ignore"
        for i, p in enumerate(self.patterns):
            for s in p.steps:
                if not s.prereq and s.matches(bit, tags) and len(autos) < self.automata:
                    autos.append([i, 0])
        for auto in autos:
            for s in self.patterns[auto[0]].steps:
                if s.matches(bit, tags) and not auto[1] >> s.bit & 1 and s.prereq & auto[1] == s.prereq:
                    auto[1] |= 1 << s.bit
                    verdict = max(verdict, s.action, key=_RANK.__getitem__)
                    if s.disarm and (actor in self.disarmed or len(self.disarmed) < self.disarms):
                        self.disarmed[actor] = self.disarmed.get(actor, 0) | s.disarm
        return verdict


@dataclass
class Automaton:
    done: int = 0
    at: dict[int, int] = field(default_factory=dict)
    bound: dict[str, str] = field(default_factory=dict)
    armed: bool = False


# Weights of the kill-chain score, and the rate window in milliseconds.
W_STAGES, W_SEVERITY, W_ORDER, W_RARITY = 2.0, 0.3, 1.0, 2.0
RATE_WINDOW = 1000


def order_bonus(at: dict[int, int]) -> float:
    """The share of neighbouring commits, by time, whose bits rise."""
    bits = [b for _, b in sorted((t, b) for b, t in at.items())]
    return sum(a < b for a, b in zip(bits, bits[1:])) / (len(bits) - 1) if len(bits) > 1 else 1.0  # noqa: B905


class ScoredEngine:
    """The scored dialect: tags in band, windows, bindings, thresholds, and arming of a storyline."""

    def __init__(self, rules: ScoredRules, conditions: dict | None = None):
        from tracewright.plans.rules import Meta

        self.rules, self.default = rules, Meta()
        self.conditions = USER_CONDITIONS if conditions is None else conditions
        self.lines = Forest(dict, self._merge)
        self.armed: dict = {}
        self.rates: dict[str, deque] = {}
        self.log: list[str] = []
        #: ``pattern:step`` of what the last event committed.
        self.commits: list[str] = []

    def _merge(self, a: dict[int, Automaton], b: dict[int, Automaton]) -> dict[int, Automaton]:
        for i, other in b.items():
            if i not in a:
                a[i] = other
                continue
            mine = a[i]
            mine.done |= other.done
            mine.at = {k: min(x[k] for x in (mine.at, other.at) if k in x) for k in mine.at | other.at}
            mine.bound = other.bound | mine.bound
        return a

    def _unite(self, actor, object_):
        """The line with more automata keeps its identity; on a tie the actor's. Arms stay with the line they were given to."""
        a, b = self.lines.root(actor), self.lines.root(object_)
        if a == b:
            return a
        keep = b if len(self.lines.value[b]) > len(self.lines.value[a]) else a
        self.lines.size[keep] = max(self.lines.size[a], self.lines.size[b]) + 1
        return self.lines.unite(keep, b if keep == a else a)

    def tags(self, ts: int, op: str, actor: str, attrs: dict) -> list[str]:
        seen = self.rates.setdefault(actor, deque())
        if op == "write":
            seen.append((ts, attrs.get("dir", "/")))
            while seen and max(ts - seen[0][0], 0) > RATE_WINDOW:
                seen.popleft()
        rate, spread = len(seen), len({d for _, d in seen})
        base = lambda key: attrs.get(key, "").replace("\\", "/").rsplit("/", 1)[-1].lower()
        test = {
            "op": lambda v: op in v.split("|"), "image_base_in": lambda v: base("image") in {x.lower() for x in v.split(",") if x},
            "target_image_base": lambda v: base("target_image") == v.lower(), "attr_true": lambda v: attrs.get(v) in ("1", "true"),
            "entropy_gt": lambda v: _number(attrs.get("entropy")) > float(v), "write_rate_ge": lambda v: rate >= int(v),
            "dir_spread_ge": lambda v: spread >= int(v), "cmd_recovery_inhibit": lambda v: recovery_inhibit(attrs.get("cmd", "")),
        }
        holds = lambda k, v: test[k](v) if k in test else self.conditions[k][0](op, attrs, v)
        return [t.tag for t in self.rules.taggers if all(holds(k, v) for k, v in t.conditions)]

    def on_event(self, ts: int, op: str, actor: str, object_: str, attrs: dict, tags: list[str] | None = None) -> tuple[str, str, str, float, str]:
        """``(decision, kind, pattern, score, reason)``."""
        self.commits.clear()
        self.lines.root(actor)
        self.lines.root(object_)
        line = self._unite(actor, object_) if op in CAUSAL else self.lines.root(actor)
        found = self.tags(ts, op, actor, attrs)
        tags = found if tags is None else tags
        autos = self.lines.value[line]
        denied = self.armed.get(line) == op and any(
            p.block_bit >= 0 and not autos[i].done >> p.block_bit & 1 and (s := _step(p, p.block_bit)).enforceable and s.enforced_op() == op
            for i, p in enumerate(self.rules.patterns) if i in autos
        )
        best = (0, "", 0.0, "")
        for i, p in enumerate(self.rules.patterns):
            if i not in autos and any(not s.prereq and s.matches(op, tags) for s in p.steps) and (p.gate == "always" or op == "write" and attrs.get("pe") in ("1", "true")):
                autos[i] = Automaton()
        for i, p in enumerate(self.rules.patterns):
            if i in autos:
                for s in p.steps:
                    if s.matches(op, tags) and self._commit(autos[i], p, s, ts, actor, object_, attrs):
                        verdict = self._emit(line, autos[i], p, s, ts)
                        if verdict[0] > best[0]:
                            best = verdict
        return "Deny" if best[0] == 3 or denied else "Allow", KINDS[best[0]], best[1], best[2], best[3]

    def _commit(self, auto: Automaton, p: ScoredPattern, s, ts, actor, object_, attrs) -> bool:
        if auto.done >> s.bit & 1 or s.prereq & auto.done != s.prereq:
            return False
        if s.prereq and max(ts - max(t for b, t in auto.at.items() if s.prereq >> b & 1), 0) > s.window:
            return False
        if p.scope == "same_actor" and actor not in auto.bound.values():
            return False
        image = "file:" + attrs["image"] if attrs.get("image") else None
        wanted = [(role, {"object": object_, "actor": actor, "image": image}[source]) for role, source in s.binds]
        if any(v is None or auto.bound.get(role, v) != v for role, v in wanted):
            return False
        auto.bound |= dict(wanted)
        auto.done |= 1 << s.bit
        auto.at[s.bit] = ts
        self.commits.append(f"{p.name}:{s.name}")
        return True

    def score(self, auto: Automaton, p: ScoredPattern) -> float:
        metas = [self.rules.meta.get(s.tags[0], self.default) if s.tags else self.default for s in sorted(p.steps, key=lambda s: s.bit) if auto.done >> s.bit & 1]
        return W_STAGES * len({m.tactic for m in metas}) + W_SEVERITY * sum(m.severity for m in metas) + W_ORDER * order_bonus(auto.at) + W_RARITY * sum(m.rarity for m in metas)

    def _emit(self, line, auto: Automaton, p: ScoredPattern, s, ts) -> tuple[int, str, float, str]:
        score = self.score(auto, p)
        if auto.done & p.required == p.required:
            if score >= p.block and s.bit == p.block_bit and s.enforceable:
                self.log.append(f"ts={ts} BLOCK pattern={p.name} score={score:.1f}")
                return 3, p.name, score, f"chokepoint {s.name}"
            return (2, p.name, score, "accepting") if score >= p.alert else (1, p.name, score, "accepting-low-score")
        if score >= p.block and not auto.armed:
            pending = next((x for x in p.steps if x.enforceable and not auto.done >> x.bit & 1), None)
            if pending:
                auto.armed = True
                self.armed[line] = pending.enforced_op()
                self.log.append(f"ts={ts} ARM pattern={p.name} score={score:.1f} op={pending.enforced_op()}")
        return (2, p.name, score, "partial-high-score") if score >= p.alert else (0, "", 0.0, "")


def _step(p: ScoredPattern, bit: int):
    return next(s for s in p.steps if s.bit == bit)


def _number(text: str | None) -> float:
    try:
        return float(text or "nan")
    except ValueError:
        return float("nan")


def routed(events: DataFrame, causal_only: bool) -> DataFrame:
    """Events with ``component``: the least identity that their actor is connected to."""
    edges = events.where(F.col("op").isin(*CAUSAL)) if causal_only else events
    found = connected_components(edges.select("actor", "object"), "actor", "object")
    return events.join(found.withColumnsRenamed({"node": "actor"}), "actor", "left").withColumn("component", F.coalesce("component", "actor"))


_ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def walked(rows: DataFrame, key: str, columns: list[str], make: Callable, step: Callable, ddl: str) -> DataFrame:
    """``seq`` and what ``step(engine, ts, *columns)`` says of each row, through one engine a key, in ``(ts, seq)`` order.

    ``ddl`` names the columns, ``seq`` first. One key's rows are one task's, but only a batch of them is held.
    """
    names, kinds = zip(*(c.split() for c in ddl.split(", ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine, now = None, object()
        for batch in batches:
            out = []
            for this, seq, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if this != now:
                    engine, now = make(), this
                out.append((seq, *step(engine, *row)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=list(names))

    return rows.select(key, "seq", "ts", *columns).repartition(key).sortWithinPartitions(key, "ts", "seq").mapInArrow(run, ddl)


def step_match(steps: list[Step]) -> Column:
    """Whether an event's operation and tags match any of the steps."""
    found = F.lit(False)
    for s in steps:
        test = op_bit(F.col("op")) != 0
        if s.ops:
            test = test & (op_bit(F.col("op")).bitwiseAND(s.ops) != 0)
        for t in s.tags:
            test = test & F.array_contains("ttps", t)
        found = found | test
    return F.coalesce(found, F.lit(False))


def replay_core(events: DataFrame, patterns: list[Pattern], dag: bool) -> DataFrame:
    """``seq, verdict, edge`` of ``events(seq, ts, op, actor, object, ttps)``; edge: whether the event became an edge of the graph."""
    rows = routed(events, False)
    begins = [s for p in patterns for s in (p.steps if dag else p.steps[:1]) if not s.prereq]
    live = small(rows.where(step_match(begins)).select("component").distinct())
    step = lambda engine, ts, op, actor, object_, ttps: (engine.on_event(op, actor, object_, ttps or (), ts), engine.edge)
    told = walked(rows.join(live, "component", "left_semi"), "component", ["op", "actor", "object", "ttps"], lambda: CoreEngine(patterns, dag), step, "seq long, verdict string, edge boolean")
    quiet = rows.join(live, "component", "left_anti").select("seq", F.lit("ignore").alias("verdict"), F.coalesce(op_bit(F.col("op")) != 0, F.lit(False)).alias("edge"))
    return told.unionByName(quiet)


def edge_log(events: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``seq, ts, op, actor, object`` of the events that became edges: those of a known operation that weren't stopped."""
    return events.join(verdicts.where("edge").select("seq"), "seq").select("seq", "ts", "op", "actor", "object")


def replay_bounded(events: DataFrame, patterns: list[Pattern], host: str = "host", **ceilings: int) -> DataFrame:
    """As ``replay_core`` under ceilings that hold for each host."""
    step = lambda engine, ts, op, actor, object_, ttps: (engine.on_event(op, actor, object_, ttps or ()),)
    return walked(events, host, ["op", "actor", "object", "ttps"], lambda: BoundedEngine(patterns, **ceilings), step, "seq long, verdict string")


def replay_scored(events: DataFrame, rules: ScoredRules) -> DataFrame:
    """``seq, decision, kind, pattern, score, reason, log, commits`` of ``events(seq, ts, op, actor, object, attrs)``.

    With a ``tags`` column the events' own tags are used in place of the rules' taggers. ``log`` holds what the event
    made the engine report: arming and blocking; ``commits`` the steps it did, as ``pattern:step``, joined by commas.
    """
    given, own = "tags" in events.columns, dict(USER_CONDITIONS)  # the workers have no registry of their own

    def step(engine: ScoredEngine, ts, op, actor, object_, attrs, tags=None) -> tuple:
        engine.log.clear()
        found = engine.on_event(int(ts), op, actor, object_, dict(attrs or {}), None if tags is None else list(tags))
        return (*found, "\n".join(engine.log), ",".join(engine.commits))

    columns = ["op", "actor", "object", "attrs", *(["tags"] if given else [])]
    return walked(routed(events, True), "component", columns, lambda: ScoredEngine(rules, own), step, "seq long, decision string, kind string, pattern string, score double, reason string, log string, commits string")
