"""What an endpoint keeps, ships and enforces: suspicion tiers, sketches, the working set, budgets, hubs, leases.

All are column expressions, grouped aggregates and ordered windows; the history in tables stays whole, and these
say which part of it an endpoint would hold at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.graph import connected_components
from tracewright.storage import small, stored

#: Tiers by rank; a storyline of the last one is never given up.
TIERS = ("plain", "seeded", "suspect", "sticky")


def tier(steps: str = "steps", score: str = "score", alert: str | float = "theta_alert", armed: str = "armed", rarity: str = "rarity", bound: str = "bound", anchor: float = 0.7) -> Column:
    """A storyline's tier: 3 armed or past its alert score, 2 two steps or a rare tag or a binding, 1 one step, else 0.

    Nulls count as 0 or false.
    """
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    limit = F.col(alert) if isinstance(alert, str) else F.lit(alert)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    seeded = number(steps) >= 1
    sticky = yes(armed) | F.coalesce(seeded & (number(score) >= limit), F.lit(False))
    return F.when(sticky, 3).when((number(steps) >= 2) | seeded & (number(rarity) >= anchor) | yes(bound), 2).when(seeded, 1).otherwise(0)


def sketches(commits: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, done, step_ts(bit, ts), last_ts`` of ``commits(keys, bit, ts)``: all that scoring and windows need of a dropped storyline."""
    first = commits.where("bit is not null and ts is not null").groupBy(*keys, "bit").agg(F.min("ts").alias("ts"), F.max("ts").alias("last"))
    return first.groupBy(*keys).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("done"), F.array_sort(F.collect_list(F.struct("bit", "ts"))).alias("step_ts"), F.max("last").alias("last_ts"))


def rehydrated(kept: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of the same keys as one: steps of both, each at its earliest time, as storylines merge."""
    flat = kept.select(*keys, "last_ts", F.explode_outer("step_ts").alias("s"))
    last = flat.groupBy(*keys).agg(F.max("last_ts").alias("_last"))
    return sketches(flat.select(*keys, "s.bit", "s.ts"), keys).join(last, keys).select(*keys, "done", "step_ts", F.greatest("last_ts", "_last").alias("last_ts"))


def working_set(events: DataFrame, pins: DataFrame, window: int, now: int | None = None) -> DataFrame:
    """``identity, last_touch, refcount`` that an endpoint holds at ``now`` (the last event's time if not given).

    Held are identities touched within ``window`` and those that ``pins(identity)``, a row a binding, names.
    """
    seen = events if now is None else events.where(F.col("ts") <= now)
    end = seen.agg(F.max("ts")).scalar() if now is None else F.lit(now)
    touches = seen.select("ts", F.explode(F.array("actor", "object")).alias("identity")).where("identity is not null").groupBy("identity").agg(F.max("ts").alias("last_touch"))
    pinned = pins.groupBy("identity").agg(F.count("*").alias("refcount"))
    both = touches.join(pinned, "identity", "left").withColumn("refcount", F.coalesce("refcount", F.lit(0).cast("long")))
    return both.where((F.col("refcount") > 0) | (F.col("last_touch") >= end - window)).select("identity", "last_touch", "refcount")


def within_budget(nodes: DataFrame, root: str, order: str, most: int, parts: int = 64) -> DataFrame:
    """Each root's ``most`` latest nodes by ``order`` (later ones, then larger identities, stay), as ``evicted`` on every row.

    A root with very many nodes is first cut to ``most`` rows in each of ``parts`` hashed parts, so that no task
    ranks all of them.
    """
    part = Window.partitionBy(root, F.pmod(F.xxhash64("identity"), F.lit(parts))).orderBy(F.desc(order), F.desc("identity"))
    whole = Window.partitionBy(root).orderBy(F.desc(order), F.desc("identity"))
    ranked = nodes.withColumn("_part", F.row_number().over(part))
    out = ranked.where(f"_part > {most}").withColumn("evicted", F.lit(True))
    rest = ranked.where(f"_part <= {most}").withColumn("evicted", F.row_number().over(whole) > most)
    return rest.unionByName(out).drop("_part")


def hub_split(edges: DataFrame, most: int, src: str = "src", dst: str = "dst") -> tuple[DataFrame, DataFrame]:
    """Components that don't grow through hubs, and the weak links to hubs that were left out.

    A hub is an identity with more than ``most`` distinct neighbours; links to it stay as references.
    """
    plain = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct()
    degree = plain.select("src", "dst").unionByName(plain.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct().groupBy("src").agg(F.count("*").alias("n"))
    hubs = degree.where(f"n > {most}").select(F.col("src").alias("hub"))
    hubs = small(stored(hubs, "hubs"))
    marked = plain.join(hubs.select(F.col("hub").alias("src"), F.lit(True).alias("_a")), "src", "left").join(hubs.select(F.col("hub").alias("dst"), F.lit(True).alias("_b")), "dst", "left")
    marked = marked.select("src", "dst", F.coalesce("_a", "_b", F.lit(False)).alias("weak"))
    # a loop at each end keeps those that only weak links touch
    ends = plain.select(F.explode(F.array("src", "dst")).alias("src")).select("src", F.col("src").alias("dst"))
    return connected_components(marked.where("not weak").select("src", "dst").unionByName(ends), "src", "dst"), marked.where("weak").select("src", "dst")


def shipped(events: DataFrame, capacity: int, batch: str, host: str = "host", tier: str = "tier") -> DataFrame:
    """A batch's events in shipping order, with ``number`` (gapless for each host) and ``dropped``.

    Higher tiers go first, then earlier events; a host's events are numbered in one task, in a sort that spills. Past ``capacity`` plain events are dropped, then seeded ones; those
    of the two upper tiers never are.
    """
    w = Window.partitionBy(batch).orderBy(F.desc(tier), "seq")
    number = F.row_number().over(Window.partitionBy(host).orderBy("seq"))
    ranked = events.withColumn("number", number).withColumn("place", F.row_number().over(w))
    return ranked.withColumn("dropped", (F.col("place") > capacity) & (F.col(tier) < 2))


def leased(events: DataFrame, directives: DataFrame) -> DataFrame:
    """Events with ``denied``: a lease on their object and operation lives at their time.

    ``directives(number, ts, identity, op, ttl)``: the latest before an event counts, a renewal replaces the lease,
    ttl 0 ends it, and a number at or below an earlier one is a replay and ignored. One ordered pass, no pairs.
    """
    rising = Window.partitionBy("identity", "op").orderBy("ts", "number").rowsBetween(Window.unboundedPreceding, -1)
    sound = directives.withColumn("_seen", F.max("number").over(rising)).where("_seen is null or number > _seen")
    lease = sound.select("identity", "op", "ts", F.lit(0).alias("_kind"), F.col("number").alias("_order"), (F.col("ts") + F.col("ttl")).alias("_until"), F.lit(None).cast("long").alias("seq"))
    event = events.select(F.col("object").alias("identity"), "op", "ts", F.lit(1).alias("_kind"), F.col("seq").alias("_order"), F.lit(None).cast("long").alias("_until"), "seq")
    before = Window.partitionBy("identity", "op").orderBy("ts", "_kind", "_order").rowsBetween(Window.unboundedPreceding, 0)
    found = lease.unionByName(event).withColumn("until", F.last("_until", ignorenulls=True).over(before)).where("_kind = 1")
    return found.select("seq", F.coalesce(F.col("until") > F.col("ts"), F.lit(False)).alias("denied"))


def live_leases(directives: DataFrame, now: int, most: int, host: str = "host") -> DataFrame:
    """Each host's leases that live at ``now``, the earliest ``most`` of them accepted and the others ``refused``."""
    rising = Window.partitionBy(host, "identity", "op").orderBy("ts", "number").rowsBetween(Window.unboundedPreceding, -1)
    sound = directives.where(F.col("ts") <= now).withColumn("_seen", F.max("number").over(rising)).where("_seen is null or number > _seen")
    latest = sound.groupBy(host, "identity", "op").agg(F.max_by(F.struct("ts", "ttl"), "number").alias("d"), F.min("number").alias("number"))
    alive = latest.select(host, "identity", "op", "number", (F.col("d.ts") + F.col("d.ttl")).alias("until")).where(F.col("until") > now)
    return alive.withColumn("refused", F.row_number().over(Window.partitionBy(host).orderBy("number", "identity", "op")) > most)
