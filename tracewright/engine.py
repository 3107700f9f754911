"""The engine as one object: rules of any dialect, over a table or a stream.

``Engine.of(text, "dag").run(events)``. Engines hold no state between runs; to change rules, make another one and
start the stream with a new checkpoint.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.labelled import replay_labelled
from tracewright.operators.replay import replay_bounded, replay_core, replay_scored
from tracewright.plans import rules as R
from tracewright.plans.labelled import LabelledPattern, compile_labelled, labelled_tags
from tracewright.streaming.replay import replay_bounded_stream, replay_labelled_stream, replay_scored_stream, replay_stream

# A built-in set of scored rules, with the dialect it is written for.
BUILT_IN = {
    "credentials": ("scored", """
ttp T1003 tactic=credential_access severity=9 rarity=0.85
tagger T1003 op=read target_image_base=lsass.exe attr_true=vm_read
pattern credential_dump scope=same_storyline theta_alert=4 theta_block=6
step read_memory bit=0 match=ttp:T1003 seg_window=120000 enforceable block
"""),
}
DIALECTS = ("linear", "dag", "bounded", "scored", "labelled")


@dataclass(frozen=True)
class Engine:
    dialect: str
    rules: list[R.Pattern] | list[LabelledPattern] | R.ScoredRules

    @staticmethod
    def of(rules: str | bytes, dialect: str) -> Engine:
        """An engine of a rule text, or of a binary rule set, which the scored and labelled dialects don't have."""
        if dialect not in DIALECTS:
            raise ValueError(f"unknown dialect {dialect!r}")
        if dialect == "scored":
            return Engine(dialect, R.compile_scored(rules))
        if dialect == "labelled":
            return Engine(dialect, compile_labelled(rules))
        dag = dialect != "linear"
        return Engine(dialect, R.decode(rules, dag) if isinstance(rules, bytes) else R.compile_rules(rules, dag))

    @staticmethod
    def of_files(spark: SparkSession, path: str, dialect: str) -> Engine:
        """An engine of all rule files under a path, in the order of their names, or of a built-in set by its name."""
        if path in BUILT_IN:
            kind, text = BUILT_IN[path]
            if kind != dialect:
                raise ValueError(f"the set {path!r} is written for the {kind} dialect")
            return Engine.of(text, dialect)
        # rules are few and small; each file is compiled by itself, so that errors name its lines
        texts = [r.value for r in spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("_file")).orderBy("_file").collect()]
        if not texts:
            raise ValueError(f"no rules at {path!r}")
        engine, *more = [Engine.of(text, dialect) for text in texts]
        for one in more:
            engine = engine.with_rules(one)
        return engine

    def with_rules(self, more: Engine) -> Engine:
        """Both engines' patterns, this one's first; equal tag definitions of scored rules count once."""
        if more.dialect != self.dialect:
            raise ValueError(f"{more.dialect} rules don't fit a {self.dialect} engine")
        if self.dialect != "scored":
            return replace(self, rules=self.rules + more.rules)
        a, b = self.rules, more.rules
        return replace(self, rules=R.ScoredRules(a.meta | b.meta, a.taggers + [t for t in b.taggers if t not in a.taggers], a.patterns + b.patterns))

    def referenced_tags(self, most: int | None = None) -> tuple[list, int]:
        """The tags that rules ask for, cut to ``most``, and how many there are."""
        if self.dialect == "scored":
            found: list = sorted({t for p in self.rules.patterns for s in p.steps for t in s.tags})
        elif self.dialect == "labelled":
            found = labelled_tags(self.rules)
        else:
            found = R.referenced_tags(self.rules)
        return found[:most], len(found)

    def run(self, events: DataFrame, host: str = "host", **options) -> DataFrame:
        """Verdicts of a table or a stream; a stream and the bounded dialect need a ``host`` column."""
        if self.dialect == "scored":
            return replay_scored_stream(events, self.rules, host, **options) if events.isStreaming else replay_scored(events, self.rules)
        if self.dialect == "bounded":
            return (replay_bounded_stream if events.isStreaming else replay_bounded)(events, self.rules, host, **options)
        if self.dialect == "labelled":
            return replay_labelled_stream(events, self.rules, host, **options) if events.isStreaming else replay_labelled(events, self.rules, host)
        dag = self.dialect == "dag"
        return replay_stream(events, self.rules, dag, host, **options) if events.isStreaming else replay_core(events, self.rules, dag)
