import collections
import json

import duckdb
import pytest

from tracewright import queries, queries_cases, queries_keep

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted((tuple(sorted((k, str(round(v, 6) if isinstance(v, float) else v)) for k, v in r.items())) for r in rows))


QUERIES, ORACLES = queries.queries() | queries_cases.queries(), queries.oracle_sql() | queries_cases.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    assert plain(r.asDict() for r in QUERIES[name](spark, SF).collect()) == plain(want)


def test_replays_agree(spark):
    first = {r.actor: r for r in queries.dag_first_match(spark, SF).collect()}
    for r in queries.replay_verdicts(spark, SF).collect():
        assert bool(r.disarmed) == (first.get(r.actor) is not None and first[r.actor].c3 is not None)
    assert queries.scored_replay(spark, SF).count() == queries.bounded_replay(spark, SF).count() == 1000


def union_find(edges):
    """Smallest node reachable of each endpoint, by brute force."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in list(root)}


def test_whole_storylines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries_keep, "HUB", 48)
    kinds = ("signup", "view", "click", "purchase", "error")
    rows = [(i, f"2024-01-01 00:00:{i % 60:02}", 1 + i * 7 % 40, kinds[i * 11 % 13 % 5], float(i), f'{{"k": {i * i % 97}}}') for i in range(150)]
    rows += [(900 + i, "2024-01-02 00:00:00", 500 + i, "error", 1.0, '{"k": 77}') for i in range(60)]  # one hot target
    rows += [(990, "2024-01-02 00:00:00", 700, "view", 1.0, '{"k": 77}'), (991, "2024-01-02 00:00:00", None, "error", 1.0, '{"k": 5}')]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    k = [json.loads(r[5])["k"] for r in rows]
    causal = [(a, b) for (_, _, a, kind, _, _), b in zip(rows, k, strict=True) if kind in ("signup", "purchase", "error") and a is not None]
    own = union_find((f"proc:{a}", f"file:{a * 1000 + b}") for a, b in causal)
    assert {r.node: r.component for r in queries.storyline_components(spark, str(tmp_path)).collect()} == own
    shared = union_find((f"proc:{a}", f"file:{b}") for a, b in causal)
    assert {r.node: r.component for r in queries.shared_components(spark, str(tmp_path)).collect()} == shared
    sizes = collections.Counter(shared.values())
    top = sorted(((n, c) for c, n in sizes.items()), key=lambda x: (-x[0], x[1]))[:10]
    assert [(r.members, r.component) for r in queries.shared_size_topk(spark, str(tmp_path)).collect()] == top and top[0][0] > 60
    edges = {(f"proc:{a}", f"file:{b}") for a, b in causal}
    degree = collections.Counter(x for e in edges for x in e)
    weak = {e for e in edges if max(degree[x] for x in e) > queries_keep.HUB}
    split = union_find([e for e in edges if e not in weak] + [(x, x) for e in edges for x in e])
    assert weak and {tuple(r) for r in queries_keep.hub_links(spark, str(tmp_path)).collect()} == weak
    assert {r.node: r.component for r in queries_keep.hub_components(spark, str(tmp_path)).collect()} == split
