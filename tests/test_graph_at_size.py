"""Traversal that neither stores edges nor walks twice for starts with the same neighbours."""

import random

import pytest

from tesserae.operators import graph as J


@pytest.mark.parametrize("most", [1_000_000, 2])
def test_walks_from_many_starts(spark, monkeypatch, most):
    monkeypatch.setattr(J, "FRONTIER", most)
    rng = random.Random(3)
    pairs = [(rng.randrange(25), rng.randrange(25)) for _ in range(40)] + [(30, 31), (32, 31), (31, 30), (31, 33), (34, 34), (35, 31), (35, 32), (36, 30)]
    edges = spark.createDataFrame([(a, b, "Calls") for a, b in pairs + pairs[:9]], "source bigint, target bigint, kind string")
    starts = spark.createDataFrame([(i,) for i in [*range(0, 37), 99, 30]], "node bigint")
    for direction in ("out", "in", "both"):
        near = {}
        for a, b in pairs:
            if direction != "in":
                near.setdefault(a, set()).add(b)
            if direction != "out":
                near.setdefault(b, set()).add(a)
        want = set()
        for root in {x for p in pairs for x in p}:
            seen, level = {root: 0}, {root}
            for depth in range(1, 4):
                level = {b for a in level for b in near.get(a, ())} - set(seen)
                seen |= dict.fromkeys(level, depth)
            want |= {(root, n, d) for n, d in seen.items()}
        got = [tuple(r) for r in J.bfs(edges, starts, 3, direction).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_edges_are_not_stored(spark, monkeypatch):
    stored = []
    cut = J.cut
    monkeypatch.setattr(J, "cut", lambda df: stored.append(cut(df)) or stored[-1])
    many = spark.range(5000).selectExpr("id AS source", "id + 10000 AS target", "'Calls' AS kind")
    shared = spark.range(50).selectExpr("id + 50000 AS source", "60000 AS target", "'Calls' AS kind").union(spark.range(40).selectExpr("60000 AS source", "id + 70000 AS target", "'Calls' AS kind"))
    starts = spark.range(50).selectExpr("id + 50000 AS node")
    assert J.reachable(many.union(shared), starts, 3).count() == 50 * 41
    assert max(df.count() for df in stored) <= 50  # neither the edges nor a row for each start and node
