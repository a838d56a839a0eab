"""What graphs without edges, and searches that have nowhere to start, give."""

import pytest

from grafloom import queries_checked as Q
from grafloom.graph import PropertyGraph

LEFT = ["bfs_predecessors", "bfs_edges", "bfs_successors", "immediate_dominators", "dominance_frontiers", "dfs_predecessors", "dfs_successors", "dfs_preorder_nodes", "dfs_postorder_nodes", "edge_bfs", "edge_dfs"]


@pytest.fixture(scope="module")
def bare(spark):
    g = PropertyGraph.of(spark, [1, 2, 3], [])
    return PropertyGraph(g.V, g.E.selectExpr("*", "1D as weight"))


@pytest.mark.parametrize("name", LEFT)
def test_searches_without_a_start_find_nothing(bare, name):
    assert Q.start(bare) is None
    assert Q.started(bare, f"nxalg.{name}").collect() == []


def test_depth_first_counts_one_less_than_all(bare):
    assert tuple(Q._searched("dfs_predecessors", True)(bare).first()) == (-1, -1, 0)
    assert tuple(Q._depth_first(bare).first()) == (0, 0)


@pytest.mark.parametrize("name", ["community_detection.get", "leiden_community_detection.get", "cugraph.louvain.get", "cugraph.leiden.get"])
def test_communities_of_no_edges(bare, name):
    assert tuple(Q._communities(name)(bare).first()) == (0, True)


def test_a_cycle_is_asked_for_only_where_there_is_one(spark, bare):
    assert tuple(Q._cycle_steps(bare).first()) == (True, 0)
    assert tuple(Q._cycle_steps(PropertyGraph.of(spark, [1, 2, 3], [(1, 2), (2, 3), (3, 1)])).first()) == (True, 0)


@pytest.mark.parametrize("what", ["train", "results", "load", "reset", "predict"])
def test_link_prediction_without_an_example(bare, what):
    rows = Q._link(what)(bare).collect()
    assert len(rows) == (6 if what in ("train", "results") else 1)
    assert all(r[-1] for r in rows)


def test_a_model_without_examples_is_even(bare):
    bare.call("link_prediction.reset_parameters")
    bare.call("link_prediction.train")
    assert bare.call("link_prediction.predict", 1, 2).first()["score"] == pytest.approx(0.5)


def test_euler_without_edges(spark, bare):
    one = PropertyGraph.of(spark, [1], [])
    kinds = ("is_eulerian", "has_eulerian_path", "is_semieulerian")
    assert [bare.call(f"nxalg.{k}").first()[0] for k in kinds] == [False, False, False]
    assert [one.call(f"nxalg.{k}").first()[0] for k in kinds] == [True, True, False]
    assert [PropertyGraph.of(spark, [1, 2], [(1, 2)]).call(f"nxalg.{k}").first()[0] for k in kinds] == [False, True, True]


def test_strongly_regular_is_distance_regular_of_diameter_two(spark, bare):
    ring = lambda n: PropertyGraph.of(spark, list(range(n)), [(i, (i + 1) % n) for i in range(n)])
    assert [g.call("nxalg.is_strongly_regular").first()[0] for g in (bare, ring(3), ring(4), ring(5), ring(6))] == [False, False, True, True, False]
    apart = PropertyGraph.of(spark, list(range(6)), [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3)])
    assert apart.call("nxalg.is_strongly_regular").first()[0] is False
