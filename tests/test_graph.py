"""Loops over tables against plain Python on small made graphs: chains, bridges, hairs, cycles within cycles."""

import random

import pytest

from graphloom.operators import graph as G


def table(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long").repartition(3)


def plain_depth(edges):
    nodes = {x for e in edges for x in e}
    ways = {n: {a for a, b in edges if b == n} for n in nodes}
    out = {}
    while True:
        more = {n: max((out[a] + 1 for a in ways[n]), default=0) for n in nodes - out.keys() if ways[n] <= out.keys()}
        if not more:
            return {n: out.get(n) for n in nodes}
        out |= more


def plain_components(edges):
    nodes = {x for e in edges for x in e}
    far = {n: {b for a, b in edges if a == n} for n in nodes}
    for k in nodes:
        for n in nodes:
            if k in far[n]:
                far[n] |= far[k]
    return {n: min(m for m in nodes if m in far[n] and n in far[m]) for n in nodes if n in far[n]}


def depths(df):
    rows = df.collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.depth for r in rows}


def mixed(seed):
    r = random.Random(seed)
    n = r.randint(3, 30)
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(2, 40))]
    for c in range(3):  # chains between random nodes, some of them back to where they began
        chain = [r.randrange(n), *range(1000 + 100 * c, 1000 + 100 * c + r.randint(1, 9)), r.randrange(n)]
        edges += list(zip(chain, chain[1:]))
    return edges + [(2000, 2001), (2001, 2002), (2002, 2000), (3000, 3000)] + edges[:2]


@pytest.mark.parametrize("seed", [1, 3])
def test_depths_and_components_of_mixed_graphs(spark, seed):
    edges = mixed(seed)
    assert depths(G.depth(table(spark, edges))) == plain_depth(edges)
    rows = G.components(table(spark, edges)).collect()
    assert len(rows) == len({r.node for r in rows}) and {r.node: r.component for r in rows} == plain_components(edges)


def test_two_cycles_joined_by_a_bridge(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 10), (10, 11), (11, 20), (20, 21), (21, 20), (0, 1), (21, 30)]
    assert {(r.component, r.node) for r in G.components(table(spark, edges)).collect()} == {(1, 1), (1, 2), (1, 3), (20, 20), (20, 21)}
    assert {r.node for r in G.cycle_members(table(spark, edges)).collect()} == {1, 2, 3, 20, 21}


def test_no_cycle_no_edge(spark):
    assert G.components(table(spark, [(1, 2), (1, 3), (3, 2)])).count() == 0
    assert G.components(table(spark, [])).count() == 0 and G.depth(table(spark, [])).count() == 0
    assert depths(G.depth(table(spark, [(1, 2), (1, 2)]))) == {1: 0, 2: 1}


def test_long_chains_take_few_rounds(spark, monkeypatch):
    written = []
    keep = G.write_table
    monkeypatch.setattr(G, "write_table", lambda df, label: written.append(label) or keep(df, label))
    chain = [(k, k + 1) for k in range(2000)]
    hairs = [(k, 10_000 + k) for k in range(0, 2000, 3)]
    assert depths(G.depth(table(spark, chain + hairs))) == {k: k for k in range(2001)} | {b: a + 1 for a, b in hairs}
    assert len(written) < 40
    ring = [(k, (k + 1) % 500) for k in range(500)]
    assert {r.component for r in G.components(table(spark, ring)).collect()} == {0}


def plain_path(parent, node):
    out = [node]
    while parent.get(out[-1]) is not None:
        out.append(parent[out[-1]])
    return out


def forest(seed, n=60):
    r = random.Random(seed)
    return {k: (r.randrange(max(0, k - 4), k) if r.random() < 0.95 else None) for k in range(1, n)} | {0: None}


@pytest.mark.parametrize("seed", [1])
def test_lowest_common_in_forests(spark, seed):
    parent, r = forest(seed), random.Random(seed)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(80)] + [(5, 5), (5, 999)]
    want = {}
    for a, b in set(pairs):
        x, y = plain_path(parent, a), plain_path(parent, b)
        low = next((n for n in x if n in y), None)
        if low is not None and b != 999:
            want[a, b] = (low, x.index(low), y.index(low))
    p = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    edges = table(spark, [(v, k) for k, v in parent.items() if v is not None])
    alone = {k for k in range(60) if parent[k] is None and k not in parent.values()}  # no edge has them
    got = {(x.a, x.b): (x.ancestor, x.da, x.db) for x in G.lowest_common(edges, p).collect()}
    assert got == {k: v for k, v in want.items() if not alone & {*k}}
    near = {(x.a, x.b) for x in G.lowest_common(edges, p, 2).collect()}
    assert near == {k for k, v in got.items() if max(v[1:]) <= 2}
    up = spark.createDataFrame(list(parent.items()), "node long, parent long")
    scores = {(x.a, x.b): (x.ancestor, x.score) for x in G.weighted_common(up, p).collect()}
    assert scores == {k: (v[0], round((v[1] * v[2]) ** 0.5, 6)) for k, v in want.items()}
    held = {(x.a, x.b): x.dist for x in G.ancestor_pairs(up, p).collect()}
    assert held == {k: v[1] for k, v in want.items() if v[0] == k[1]}


def test_a_path_takes_few_jumps(spark):
    jumps = G.Jumps.of(spark.createDataFrame([(k, k - 1 if k else None) for k in range(1000)], "node long, parent long"))
    assert len(jumps.tables) <= 12
    pairs = spark.createDataFrame([(999, 1), (999, 998), (0, 500)], "a long, b long")
    assert {tuple(r) for r in jumps.common(pairs).collect()} == {(999, 1, 1, 998, 0), (999, 998, 998, 1, 0), (0, 500, 0, 0, 500)}


def test_no_forest_goes_by_all_ancestors(spark):
    two = table(spark, [(1, 3), (2, 3), (1, 4), (2, 4), (0, 1), (0, 2)])
    pair = spark.createDataFrame([(3, 4)], "a long, b long")
    assert {r.ancestor for r in G.lowest_common(two, pair).collect()} == {1, 2}
    assert G.Jumps.of(spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "node long, parent long")) is None
    assert {tuple(r) for r in G.ancestor_pairs(spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "node long, parent long"), spark.createDataFrame([(3, 2), (1, 3)], "a long, b long")).collect()} == {(3, 2, 2)}


def test_ancestors_double_in_forests_and_go_by_hops_elsewhere(spark, monkeypatch):
    chain = spark.createDataFrame([(k, k - 1) for k in range(1, 12)] + [(20, None)], "node long, parent long")
    seeds = spark.createDataFrame([(11,), (3,), (20,), (99,)], "seed long")
    hops, reach = [], G.reach
    monkeypatch.setattr(G, "reach", lambda *a, **k: hops.append(1) or reach(*a, **k))
    rows = lambda df: sorted(tuple(r) for r in df.select("seed", "node", "dist").collect())
    want = [(3, 3 - d, d) for d in range(4)] + [(11, 11 - d, d) for d in range(12)] + [(20, 20, 0), (99, 99, 0)]
    assert rows(G.ancestors(chain, seeds)) == sorted(want) and not hops
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node long, parent long")
    assert rows(G.ancestors(ring, spark.createDataFrame([(1,)], "seed long"))) == [(1, 1, 0), (1, 2, 1), (1, 3, 2)] and hops


def broadcasts(monkeypatch, run):
    """Plans with a broadcast among those written on the way, and the result's own."""
    plans, write = [], G.write_table

    def spy(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(G, "write_table", spy)
    plans.append(run()._jdf.queryExecution().executedPlan().toString())
    return [p for p in plans if "Broadcast" in p]


def test_loops_send_no_table_through_the_driver(spark, monkeypatch):
    edges = table(spark, mixed(1))
    assert not broadcasts(monkeypatch, lambda: G.components(edges))
    assert not broadcasts(monkeypatch, lambda: G.depth(edges))


def test_common_scores_send_no_table_through_the_driver(spark, monkeypatch):
    edges = table(spark, [((k - 1) // 2, k) for k in range(1, 40)])
    pairs = spark.createDataFrame([(k, k - 7) for k in range(9, 40)], "a long, b long")
    assert not broadcasts(monkeypatch, lambda: G.common_scores(edges, pairs))
