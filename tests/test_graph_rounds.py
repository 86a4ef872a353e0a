"""Graph rounds read their edges once, whatever the number of rounds, and give the same results by broadcasts and shuffles."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import graph


def _counted(spark, rows):
    """Edges whose src is read through a function that counts its calls."""
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    return edges.withColumn("src", F.udf(count, "long").asNondeterministic()("src")), seen


def _distances(rows, start):
    near, want, heap = {}, {}, [(0.0, start)]
    for a, b, w in rows:
        near.setdefault(a, []).append((b, w))
    while heap:
        x, n = heapq.heappop(heap)
        if n not in want:
            want[n] = x
            for b, w in near.get(n, []):
                if w is not None:
                    heapq.heappush(heap, (x + w, b))
    return want


def _components(rows):
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in rows:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    return {x: root(x) for x in top}


def _random(n, m, seed):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n), float(r.randrange(9))) for _ in range(m)]


GRAPHS = {"random": _random(60, 90, 1), "path": [(k, k + 1, 1.0) for k in range(40)], "back": [(k + 1, k, 1.0) for k in range(40)], "star": [(k, 99, 2.0) for k in range(30)], "loops": [(1, 1, 1.0), (2, 3, 0.0), (3, 2, 5.0)],
          "shuffled": [(a * 37 % 101, b * 37 % 101, w) for a, b, w in _random(101, 110, 2)]}


@pytest.mark.parametrize("few", [graph.FEW, 0])
def test_components_equal_union_find(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    # one table: the graphs side by side, nodes apart by thousands
    rows = [(1000 * k + a, 1000 * k + b) for k, g in enumerate(GRAPHS.values()) for a, b, _ in g]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert got == _components(rows)


def test_components_of_edges_with_one_end_or_none(spark):
    edges = spark.createDataFrame([(5, None), (None, 7), (None, None), (7, 9)], "src long, dst long")
    assert {r.node: r.component for r in graph.connected_components(edges).collect()} == {5: 5, 7: 7, 9: 7}
    assert graph.connected_components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("few", [graph.FEW, 0])
def test_paths_equal_dijkstra(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    rows = GRAPHS["random"] + [(0, 70, None), (70, 71, 1.0), (1, 0, 3.0)]
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    assert {r.node: r.distance for r in graph.shortest_paths(edges).collect()} == _distances(rows, 0)
    assert {r.node: r.distance for r in graph.shortest_paths(edges, 1).collect()} == _distances(rows, 1)
    with pytest.raises(ValueError, match="negative"):
        graph.shortest_paths(spark.createDataFrame([(1, 2, -1.0)], "src long, dst long, weight double"), 1)


@pytest.mark.parametrize("run", [lambda e: graph.shortest_paths(e, 0), lambda e: graph.bfs(e, [0]), lambda e: graph.connected_components(e.select("src", "dst"))])
def test_edges_are_made_once(spark, run):
    edges, seen = _counted(spark, [(k, k + 1, 1.0) for k in range(8)])
    assert run(edges).count() == 9
    assert seen.value == 8


def test_both_ways_read_edges_once(spark):
    edges, seen = _counted(spark, [(1, 2, 3.0), (4, 4, 5.0)])
    assert sorted(map(tuple, graph.both_ways(edges).collect())) == [(1, 2, 3.0), (2, 1, 3.0), (4, 4, 5.0), (4, 4, 5.0)]
    assert seen.value == 2
