"""Graph fixtures, and closures against plain Python on random graphs."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import graph as G
from corvane.operators import reach
from corvane.queries import QUERIES
from corvane.streaming.maintained import MaintainedGraph


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src long, dst long")


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def plain_closure(pairs):
    tc = set(pairs)
    while True:
        more = {(a, d) for a, b in tc for c, d in tc if b == c} - tc
        if not more:
            return tc
        tc |= more


def test_cycle_of_three(spark):
    tc = G.closure(edges(spark, (1, 2), (2, 3), (3, 1)))
    assert as_dict(G.components_of_cycles(tc)) == {1: 1, 2: 1, 3: 1}


def test_dag_reach(spark):
    tc = G.closure(edges(spark, (1, 2), (2, 3), (1, 3)))
    assert G.cycle_nodes(tc).count() == 0
    assert as_dict(G.reach_count(tc)) == {3: 2, 2: 1}


def test_deep_chain(spark):
    e = edges(spark, *((i, i + 1) for i in range(1, 6)))
    assert as_dict(G.reach_count(G.closure(e))) == {2: 1, 3: 2, 4: 3, 5: 4, 6: 5}
    assert as_dict(G.blast_radius(e))[6] == 3


def test_rollup(spark):
    e = edges(spark, (1, 2), (2, 3))
    assert as_dict(G.fan_in(e)) == {2: 1, 3: 1}
    assert as_dict(G.blast_radius(e)) == {2: 1, 3: 2}


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(12), rng.randrange(12)) for _ in range(18)}
    assert {tuple(r) for r in G.closure(edges(spark, *pairs)).collect()} == plain_closure(pairs)


def test_pagerank_star_and_sum(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    ranks = as_dict(G.pagerank(edges(spark, (1, 3), (2, 3)), nodes))
    assert ranks[3] > ranks[1] > 0
    assert abs(sum(ranks.values()) - 1) < 1e-6
    alone = as_dict(G.pagerank(edges(spark), nodes, rounds=4))
    assert abs(sum(alone.values()) - 1) < 0.01


def test_callers_by_depth(spark):
    e = edges(spark, (1, 2), (2, 3))
    start = spark.createDataFrame([(3,)], "id long")
    assert as_dict(G.levels(e, start, 1, backward=True).select("id", "level")) == {3: 0, 2: 1}
    assert as_dict(G.levels(e, start, 2, backward=True).select("id", "level")) == {3: 0, 2: 1, 1: 2}


def test_maintained_graph_equals_batch(spark):
    g = MaintainedGraph(spark)
    state, rng = set(), random.Random(5)
    for _ in range(3):
        batch = {(rng.randrange(6), rng.randrange(6)): rng.choice([1, 1, -1]) for _ in range(5)}
        g.update(spark.createDataFrame([(*k, d) for k, d in batch.items()], "src long, dst long, diff int"))
        state = (state | {k for k, d in batch.items() if d > 0}) - {k for k, d in batch.items() if d < 0}
        assert {tuple(r) for r in g.edges.collect()} == state
        assert {tuple(r) for r in g.closure.collect()} == plain_closure(state)


DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(20))
def test_orders_of_random_graphs(monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(reach, "BLOCK", rng.choice([3, 64, 8192]))
    monkeypatch.setattr(reach, "SMALL", rng.choice([0, 5, 4096]))
    n = rng.randrange(1, 40)
    pairs = sorted({(7 * rng.randrange(n) - 50, 7 * rng.randrange(n) - 50) for _ in range(rng.randrange(70))})
    if seed % 2:
        pairs = [(a, b) for a, b in pairs if a < b or rng.random() < 0.1]
    o, tc = reach.order(*np.array(pairs, np.int64).reshape(-1, 2).T), plain_closure(pairs)
    found = [x for u in reach.units(o) for src, dst in reach.pairs(o, u, rows=10) for x in zip(src.tolist(), dst.tolist(), strict=True)]
    assert len(found) == len(set(found)) and set(found) == tc
    counts = {}
    for u in reach.units(o):
        for ids, k in reach.counts(o, u):
            counts |= {x: counts.get(x, 0) + y for x, y in zip(ids.tolist(), k.tolist(), strict=True)}
    assert {x: y for x, y in counts.items() if y} == {b: sum(d == b and s != b for s, d in tc) for b in {d for s, d in tc if s != d}}


def test_a_long_chain_with_ways_back(spark):
    """40,000 nodes, 800 million pairs in the closure."""
    n = 40_000
    e = spark.range(1, n).selectExpr("id AS src", "explode(if(id % 10 = 0, array(id + 1, id - 3), array(id + 1))) AS dst")
    scc = as_dict(G.strong_components(e))
    assert len(scc) == 4 * ((n - 1) // 10) and scc[10] == 7 and scc[9] == 7 and 11 not in scc
    got = as_dict(G.reached_by(e))
    assert len(got) == n - 1 and got[n] == n - 1 and got[6] == 5 and got[7] == got[8] == got[10] == 9


def test_nulls_and_loops(spark):
    e = edges(spark, (1, 2), (2, None), (None, 1), (3, 3), (2, 1), (4, None), (None, None))
    assert {tuple(r) for r in G.closure(e).collect()} == {tuple(r) for r in G.closure_by_doubling(e).collect()}
    assert as_dict(G.strong_components(e)) == {1: 1, 2: 1, 3: 3}
    assert as_dict(G.reached_by(e)) == as_dict(G.reach_count(G.closure_by_doubling(e)))
    assert G.closure(edges(spark)).count() == G.strong_components(edges(spark)).count() == 0
    names = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    assert as_dict(G.strong_components(names)) == {"a": "a", "b": "a"}


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", ["G4_reach_count", "G5_cycle_nodes", "G6_strong_components", "R6_cycles", "R25_release_pack", "ST1_edge_deltas", "ST3_maintained_counts", "ST3_maintained_cycles", "ST3_maintained_violations", "ST4_forbidden_updates"])
def test_no_closure_where_none_is_asked_for(spark, monkeypatch, name):
    def refuse(edges):
        raise AssertionError("the closure is built")

    monkeypatch.setattr(G, "closure", refuse)
    monkeypatch.setattr(G, "closure_by_doubling", refuse)
    assert not QUERIES[name](spark, DATA).isEmpty()


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_the_maintained_closure_needs_no_doubling(spark, monkeypatch):
    monkeypatch.setattr(G, "closure_by_doubling", None)
    tc = QUERIES["ST2_maintained_closure"](spark, DATA)
    assert tc.count() == tc.distinct().count() > 0


@pytest.mark.parametrize("width", [7, 60])
def test_nodes_within_steps_as_bits(spark, width):
    rng = random.Random(width)
    pairs = {(rng.randrange(-20, 150), rng.randrange(-20, 150)) for _ in range(250)}
    ids = spark.createDataFrame([(200,), (5,), (2**60 + 1,)], "id long")
    e = edges(spark, *pairs, (5, 2**60 + 1), (2**60 + 1, 2**60))
    got = {(r.root, r.word * width + k) for r in G.within(e, ids, 3, backward=True, width=width).collect() for k in range(width) if r["mask"] >> k & 1}
    roots = e.select("src").union(e.select("dst")).union(ids).distinct().toDF("id")
    assert got == {(r.root, r.id) for r in G.levels(e, roots, 3, backward=True).collect()}


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_impact_makes_no_row_of_each_pair(spark, monkeypatch):
    monkeypatch.setattr(G, "levels", None)
    assert not QUERIES["G12_impact"](spark, DATA).isEmpty()


def test_pairs_of_a_long_path_are_shared_out(spark):
    """The closure of one path has work for all tasks, not for one that writes all pairs."""
    n = 1500
    tc = G.closure(spark.range(n).selectExpr("id AS src", "id + 1 AS dst"))
    held = [r["count"] for r in tc.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(held) == n * (n + 1) // 2
    assert len(held) >= 8 and max(held) <= sum(held) / 4
