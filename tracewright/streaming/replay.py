"""Rules over a stream: each key's engine is state, and an event's verdict leaves with its micro-batch.

Keys are hosts, since storylines merge as events arrive. Within a batch a key's events are sorted by
``(ts, seq)``; the stream's source must not deliver an event after later ones of another batch. A host without
events for ``idle`` seconds loses its state, unless ``idle`` is 0. The core engines also forget, after each batch,
automata that haven't moved for ``keep`` milliseconds of event time and storylines that none is left in and nothing has
touched since, unless ``keep`` is 0: a host's state is then bounded by what happens within that time.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewright.operators.labelled import LabelledEngine
from tracewright.operators.replay import BoundedEngine, CoreEngine, ScoredEngine
from tracewright.plans.labelled import LabelledPattern
from tracewright.plans.rules import USER_CONDITIONS, Pattern, ScoredRules

_FOREST = ("up", "size", "value")


def _save(engine) -> bytes:
    """What an engine has learnt; its rules are not part of it."""
    kept = {k: v for k, v in vars(engine).items() if k not in ("patterns", "rules", "default", "lines", "log", "conditions", "commits")}
    lines = engine.lines if isinstance(engine, BoundedEngine) else {k: getattr(engine.lines, k) for k in _FOREST}
    return pickle.dumps((kept, lines))


def _load(engine, blob: bytes) -> None:
    kept, lines = pickle.loads(blob)
    vars(engine).update(kept)
    if isinstance(engine, BoundedEngine):
        engine.lines = lines
    else:
        vars(engine.lines).update(lines)


def _stateful(events: DataFrame, make: Callable, step: Callable, out: str, key: str, idle: int, keep: int = 0) -> DataFrame:
    names = [c.split()[0] for c in out.split(", ")]

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        engine = make()
        if state.exists:
            _load(engine, state.get[0])
        rows = pd.concat(list(parts)).sort_values(["ts", "seq"])
        made = pd.DataFrame([step(engine, row) for row in rows.itertuples(index=False)], columns=names)
        if keep:
            engine.expire(int(rows.ts.iloc[-1]) - keep)
        state.update((_save(engine),))
        if idle:
            state.setTimeoutDuration(idle * 1000)
        made.insert(0, "seq", rows.seq.to_numpy())
        made.insert(0, key, group[0])
        yield made

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, seq long, {out}", "engine binary", "append", timeout)


def _verdict(engine, row) -> tuple:
    return (engine.on_event(row.op, row.actor, row.object, row.ttps),)


def _timed(engine: CoreEngine, row) -> tuple:
    return (engine.on_event(row.op, row.actor, row.object, row.ttps, int(row.ts)),)


def replay_stream(events: DataFrame, patterns: list[Pattern], dag: bool, key: str = "host", idle: int = 0, keep: int = 0) -> DataFrame:
    """``host, seq, verdict`` of a streaming ``events(host, seq, ts, op, actor, object, ttps)``."""
    return _stateful(events, lambda: CoreEngine(patterns, dag), _timed, "verdict string", key, idle, keep)


def replay_bounded_stream(events: DataFrame, patterns: list[Pattern], key: str = "host", idle: int = 0, **ceilings: int) -> DataFrame:
    """As ``replay_stream`` for the bounded engine, whose ceilings hold for each host."""
    return _stateful(events, lambda: BoundedEngine(patterns, **ceilings), _verdict, "verdict string", key, idle)


def replay_labelled_stream(events: DataFrame, patterns: list[LabelledPattern], key: str = "host", idle: int = 0) -> DataFrame:
    """As ``replay_stream`` for labelled rules of any scope."""
    return _stateful(events, lambda: LabelledEngine(patterns), _verdict, "verdict string", key, idle)


def replay_scored_stream(events: DataFrame, rules: ScoredRules, key: str = "host", idle: int = 0) -> DataFrame:
    """``host, seq, decision, kind, pattern, score, reason, log`` of ``events(host, seq, ts, op, actor, object, attrs)``.

    ``log`` holds what the event made the engine report: arming and blocking.
    """

    def step(engine: ScoredEngine, row) -> tuple:
        engine.log.clear()
        found = engine.on_event(int(row.ts), row.op, row.actor, row.object, dict(row.attrs or {}))
        return (*found, "\n".join(engine.log))

    own = dict(USER_CONDITIONS)
    return _stateful(events, lambda: ScoredEngine(rules, own), step, "decision string, kind string, pattern string, score double, reason string, log string", key, idle)
