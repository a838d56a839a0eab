"""Trees that hang on a graph are taken off before what is left is worked on whole; results are those of the whole."""

import random

import pytest

from grafloom.graph import PropertyGraph
from grafloom.kernels import exact
from grafloom.operators.centrality import undirected_sums
from grafloom.operators import structure
from grafloom.plans import loops


def shaggy(spark, seed):
    """A few rings with trees on them, trees alone, two nodes alone together, parallel edges, self-loops and a lone node."""
    r = random.Random(seed)
    edges = [(i, (i + 1) % 5) for i in range(5)] + [(10, 11), (11, 12), (12, 10), (0, 2), (20, 21), (30, 30)]
    nodes = list(range(5)) + [10, 11, 12, 20, 21, 30, 40]
    for n in range(100, 130):
        edges.append((n, r.choice(nodes)) if r.random() < 0.5 else (r.choice(nodes), n))
        nodes.append(n)
    edges += r.sample(edges, 6) + [(101, 101)]
    return PropertyGraph.of(spark, nodes, edges)


@pytest.fixture(params=[1, 2, 3])
def g(spark, request):
    return shaggy(spark, request.param)


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_betweenness_of_trees_and_what_they_hang_on(g):
    whole = {r["node"]: r["score"] for r in undirected_sums(g, few=10**6).collect()}
    peeled = [tuple(r) for r in undirected_sums(g, few=0).collect()]
    assert len(peeled) == len(whole)
    assert dict(peeled) == pytest.approx(whole)


def test_peeling_takes_or_leaves_every_link(g):
    rounds, left = loops.peel(g.E, 0)
    off = [(r["leaf"], r["parent"]) for x in rounds for r in x.collect()]
    gone, kept = [a for a, _ in off], [(r["a"], r["b"]) for r in left.collect()]
    assert off and len(gone) == len(set(gone)) and not set(gone) & {x for pair in kept for x in pair}
    want = {(min(r["src"], r["dst"]), max(r["src"], r["dst"])) for r in g.E.collect() if r["src"] != r["dst"]}
    assert sorted([*kept, *((min(x), max(x)) for x in off)]) == sorted(want)


def whole(monkeypatch, g, call):
    """Rows of a call with everything peeled off, and with nothing."""
    out = []
    for few in (0, 10**6):
        for name in ("peel", "trim"):
            f = getattr(loops, name)
            monkeypatch.setattr(structure, name, lambda e, f=f, few=few: f(e, few))
        out.append(rows(call(g)))
        monkeypatch.undo()
    return out


@pytest.mark.parametrize("name", ["biconnected_components.get", "nxalg.biconnected_components", "bridges.get", "nxalg.check_planarity", "nxalg.strongly_connected_components", "nxalg.flow_hierarchy"])
def test_what_hangs_on_may_be_taken_off(monkeypatch, g, name):
    peeled, plain = whole(monkeypatch, g, lambda g: g.call(name))
    assert peeled == plain and plain


def test_planarity_of_what_is_left(spark, monkeypatch):
    k5 = [(i, j) for i in range(5) for j in range(i)] + [(i, i + 10) for i in range(5)]
    g = PropertyGraph.of(spark, [*range(5), *range(10, 15)], k5)
    assert whole(monkeypatch, g, lambda g: g.call("nxalg.check_planarity")) == [[("False",)]] * 2


@pytest.mark.parametrize(("edges", "ok"), [([(i, (i + 1) % 8) for i in range(8)] + [(8, 9), (8, 9)], True), ([(i, (i + 1) % 7) for i in range(7)] + [(8, 9)], False), ([(0, 1), (9, 9)], False), ([], True)])
def test_two_sides_are_told_from_forests(spark, edges, ok):
    g = PropertyGraph.of(spark, list(range(10)), edges)
    assert two_sided_of(g) == [ok, ok] == [g.call("nxalg.is_bipartite").first()[0]] * 2


def two_sided_of(g):
    return [loops.two_sided(g.E.repartition(n), rows).first()[0] for n, rows in ((3, 1), (1, 2))]


def test_two_sides_of_random_graphs(spark):
    r = random.Random(5)
    for n in range(8):
        pairs = [(r.randrange(20), r.randrange(20, 40)) for _ in range(40)] + [(r.randrange(20), r.randrange(20))] * (n % 2)
        nodes = list(range(40))
        want = next(exact.two_colourable(nodes, [(i, a, b, 1.0) for i, (a, b) in enumerate(pairs)]))[0]
        assert two_sided_of(PropertyGraph.of(spark, nodes, pairs)) == [want, want]
