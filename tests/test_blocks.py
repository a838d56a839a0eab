"""Pairs of vectors by blocks, whatever their number; embeddings are made where the nodes are."""

import numpy as np
import pyarrow as pa
import pytest

from grafloom.graph import PropertyGraph
from grafloom.operators import similarity
from grafloom.plans import lineage


@pytest.fixture(scope="module")
def g(spark):
    r = np.random.default_rng(3)
    m = r.normal(size=(23, 5))
    m[4], m[9], m[11] = m[2], m[2], 0  # ties and a vector without length
    v = spark.createDataFrame([(i * 7 % 23, m[i * 7 % 23].tolist()) for i in range(23)], "id long, embedding array<double>")
    return m, PropertyGraph(v, spark.createDataFrame([], "src long, dst long"))


def cosine(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return 0.0 if n < 1e-9 else a @ b / n


@pytest.mark.parametrize(("block", "strip"), [(3, 2), (8, 256), (2048, 5)])
def test_blocks_give_every_pair_once(monkeypatch, g, block, strip):
    monkeypatch.setattr(similarity, "PAIR_BLOCK", block)
    monkeypatch.setattr(similarity, "STRIP", strip)
    m, g = g
    got = [tuple(r) for r in g.call("node_similarity.cosine", "embedding").collect()]
    assert len(got) == 23 * 22 // 2
    assert {(a, b): s for a, b, s in got} == pytest.approx({(i, j): cosine(m[i], m[j]) for j in range(23) for i in range(j)})


@pytest.mark.parametrize(("block", "strip"), [(3, 2), (4096, 5)])
def test_nearest_keep_the_lesser_of_equals(monkeypatch, g, block, strip):
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity, "STRIP", strip)
    m, g = g
    got = {(r["node"], r["neighbour"]): r["similarity"] for r in g.call("knn.get", {"nodeProperties": ["embedding"], "topK": 2}).collect()}
    near = lambda i, j: 0.0 if min(np.linalg.norm(m[i]), np.linalg.norm(m[j])) < 1e-9 else (cosine(m[i], m[j]) + 1) / 2
    want = {(i, j): near(i, j) for i in range(23) for j in sorted(set(range(23)) - {i}, key=lambda j: (-round(near(i, j), 12), j))[:2]}
    assert got == pytest.approx(want)


def test_vectors_that_differ_in_size_fail(spark):
    v = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, embedding array<double>")
    with pytest.raises(ValueError, match="differ in size"):
        PropertyGraph(v, spark.createDataFrame([], "src long, dst long")).call("node_similarity.cosine", "embedding")


def test_embeddings_need_no_join(spark):
    g = PropertyGraph.of(spark, [(1, ["A"], {"name": "x"}), (2, ["B"], {"name": "y"})], [])
    v = g.call("embeddings.node_sentence").V
    assert "Join" not in v._jdf.queryExecution().optimizedPlan().toString()
    some = dict(g.call("embeddings.node_sentence", [2]).V.select("id", "embedding").collect())
    assert some[1] is None and some[2] == dict(v.select("id", "embedding").collect())[2]


def test_tasks_grow_in_number_with_rows(spark, monkeypatch):
    monkeypatch.setattr(lineage, "ROWS_A_TASK", 10)
    df = spark.range(95)
    assert lineage.dealt(df, 95, "id").rdd.getNumPartitions() == 10
    assert lineage.dealt(df, 9, "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    g = PropertyGraph.of(spark, list(range(30)), [(i, (i * 7 + 1) % 30) for i in range(30)])
    colour = dict(g.call("nxalg.greedy_color").collect())
    assert all(colour[r["src"]] != colour[r["dst"]] for r in g.E.collect() if r["src"] != r["dst"]) and len(colour) == 30


@pytest.mark.parametrize(("pairs", "batch"), [(3, 4), (2_000_000, 10_000)])
def test_pairs_that_share_a_neighbour_are_counted_by_runs(pairs, batch, monkeypatch):
    monkeypatch.setattr(similarity, "PAIRS", pairs)
    links = sorted({(int(d), int(s)) for d, s in np.random.default_rng(1).integers(0, 9, (60, 2))})
    t = pa.table({"src": [s for _, s in links], "dst": [d for d, _ in links]})
    got = {}
    for b in similarity._counted_pairs(iter(t.to_batches(max_chunksize=batch))):
        for a, c, n in zip(*(x.to_pylist() for x in b.columns), strict=True):
            got[a, c] = got.get((a, c), 0) + n
    of = {s: {d for d, x in links if x == s} for _, s in links}
    assert got == {(a, c): len(of[a] & of[c]) for a in of for c in of if a < c and of[a] & of[c]}
