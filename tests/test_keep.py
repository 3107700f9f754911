import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_queries import SF, plain
from tracewright import queries_keep
from tracewright.operators import retention


@pytest.mark.parametrize("name", sorted(queries_keep.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    cur = con.execute(queries_keep.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    assert want and plain(r.asDict() for r in queries_keep.queries()[name](spark, SF).collect()) == plain(want)


def test_tiers(spark):
    rows = [(0, None, None, None, None, 0), (1, 3.0, False, 0.1, False, 1), (1, 3.0, False, 0.9, None, 2), (1, 3.0, False, 0.1, True, 2), (2, 5.0, None, 0.1, False, 2), (1, 6.0, False, 0.1, False, 3), (1, 0.0, True, 0.1, False, 3), (None, None, None, None, None, 0)]
    got = spark.createDataFrame(rows, "steps int, score double, armed boolean, rarity double, bound boolean, want int").withColumn("got", retention.tier(alert=6.0))
    assert [r.got for r in got.collect()] == [r[-1] for r in rows]


def test_budget_and_empty(spark):
    nodes = [("r" if i % 3 else "q", f"n{i:04}", i // 7) for i in range(900)]
    want = {root: {i for _, i, _ in sorted((n for n in nodes if n[0] == root), key=lambda n: (n[2], n[1]))[-10:]} for root in "qr"}
    rows = spark.createDataFrame(nodes, "root string, identity string, at long")
    got = retention.within_budget(rows, "root", "at", 10, parts=5).where("not evicted").groupBy("root").agg(F.collect_set("identity").alias("kept"))
    assert {r.root: set(r.kept) for r in got.collect()} == want
    assert retention.within_budget(rows.limit(0), "root", "at", 10).count() == 0
    e = spark.createDataFrame([], "ts long, actor string, object string")
    assert retention.working_set(e, spark.createDataFrame([], "identity string"), 5).count() == 0


def test_working_set_and_leases(spark):
    e = spark.createDataFrame([(1, "a", "x"), (50, "a", "y"), (100, "b", None)], "ts long, actor string, object string")
    pins = spark.createDataFrame([("x",), ("x",), ("nobody",)], "identity string")
    got = {(r.identity, r.last_touch, r.refcount) for r in retention.working_set(e, pins, 40).collect()}
    assert got == {("x", 1, 2), ("b", 100, 0)}
    assert {r.identity for r in retention.working_set(e, pins, 40, now=60).collect()} == {"a", "x", "y"}
    lease = spark.createDataFrame([(1, 10, "f", "write", 20), (2, 25, "f", "write", 20), (1, 40, "f", "write", 900), (3, 60, "f", "write", 50), (4, 70, "f", "write", 0)], "number long, ts long, identity string, op string, ttl long")
    times = {5: False, 10: True, 29: True, 31: True, 44: True, 45: False, 50: False, 65: True, 70: False, 80: False}
    found = spark.createDataFrame([(t, t, "write", "f") for t in times] + [(1000, 12, "read", "f"), (1001, 12, "write", None)], "seq long, ts long, op string, object string")
    assert {r.seq: r.denied for r in retention.leased(found, lease).collect()} == times | {1000: False, 1001: False}
    many = spark.createDataFrame([("h", i, 0, f"f{i}", "write", 100) for i in range(4)] + [("g", 9, 0, "f", "write", 5)], "host string, number long, ts long, identity string, op string, ttl long")
    assert {(r.host, r.identity, r.refused) for r in retention.live_leases(many, 50, 2).collect()} == {("h", "f0", False), ("h", "f1", False), ("h", "f2", True), ("h", "f3", True)}
