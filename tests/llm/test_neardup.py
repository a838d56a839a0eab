import random

import numpy as np
import pyarrow as pa
import pytest

from grafloom.llm import neardup, queries, store
from grafloom.llm.components import connected_components
from grafloom.llm.textbatch import slices
from tests.llm.thue_morse import thue_morse

DOCS = "doc_id long, text string, class_id string, k1 int"


def grams(text):
    w = (text or "").replace("\x0b", " ").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows, threshold=0.8):
    ids = [r[0] for r in rows]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [grams(r[1]) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = sorted((root(ids[i]), root(ids[j])))
                parent[b] = a
    return {i: root(i) for i in ids}


def made(seed, groups, singles):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    rows = []
    for g in range(groups):
        base = [word() for _ in range(rng.randint(60, 300))]
        for _ in range(rng.choice([2, 3, 12, 40])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 80))):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
    rows += [" ".join(word() for _ in range(rng.randint(1, 100))) for _ in range(singles)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(3)
    ids = rng.integers(1, 2**63, 400).astype(np.uint64)
    x, y = ids[:300], ids[100:]
    wx, wy = 1 + rng.integers(0, 3, 300).astype(float), 1 + rng.integers(0, 3, 300).astype(float)
    sig = neardup.signatures(np.concatenate([x, y]), np.concatenate([wx, wy]), np.array([0, 300, 600]), 4096)
    a, b = dict(zip(x, wx)), dict(zip(y, wy))
    want = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in {*a, *b}) for d in {*a} & {*b})
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03
    assert (neardup.signatures(np.zeros(0, np.uint64), np.zeros(0), np.array([0, 0])) == 0).all()


def test_signatures_do_not_depend_on_the_slice():
    texts = pa.array([t for _, t in made(1, 3, 5)] + ["", "a b", None, "x " * 3000])
    whole = np.concatenate([neardup.signatures(e, np.ones(len(e)), of) for p in slices(texts) for e, _, of, _ in [neardup.shingles(p)]])
    parts = np.concatenate([neardup.signatures(e, np.ones(len(e)), of) for p in slices(texts, 700) for e, _, of, _ in [neardup.shingles(p)]])
    assert (whole == parts).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_against_brute_force(spark, seed):
    rows = made(seed, 8, 60)
    rows += [(2000, rows[0][1]), (2001, "  " + rows[0][1].replace(" ", "\n")), (2002, None), (2003, ""), (2004, "one two"), (2005, "one  two"), (2006, "two one")]
    docs = spark.createDataFrame([(*r, "", 0) for r in rows] + [(None, "a b c d e f", "", 0), (5, rows[5][1], "", 0)], DOCS).repartition(4)
    got = neardup.classes(docs).collect()
    assert len(got) == len(rows) + 2
    want = brute(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    kept = [r.doc_id for r in neardup.keep_first(docs).collect()]
    assert sorted(k for k in set(kept) if k is not None) == sorted(set(want.values())) and None in kept


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 180)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    for few in (0, 1000):
        got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
        assert got == {x: root(x) for x in got} and {x for a, b in edges if a != b for x in (a, b)} == set(got)


def test_nothing(spark):
    assert neardup.classes(spark.createDataFrame([], DOCS)).count() == 0


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert {r.doc_id: r.class_id for r in queries.op3_minhash_near_dedup(spark, sf_dir).collect()} == brute(docs)


def family(seed, n, words, edits, planted):
    """Copies of one text that differ from it in edits words each; then planted further copies of some, one more word off."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    off = lambda own, k, tag: [f"{tag}{i}" if i in k else x for i, x in enumerate(own)]
    spread = lambda: {s * (words // edits) + rng.randrange(8, words // edits - 8) for s in range(edits)}
    docs = [off(base, spread(), f"x{d}y") for d in range(n)]
    docs += [off(docs[d], {rng.randrange(words)}, f"z{d}y") for d in rng.sample(range(n), planted)]
    rng.shuffle(docs)
    return list(enumerate(map(" ".join, docs)))


def test_crowded_groups_are_compared_whole(spark):
    """Mutual similarity mostly just under the threshold: hundreds share their bands and only planted pairs are links."""
    rows = family(7, 300, 330, 5, 40)
    want = brute(rows)
    assert len(set(want.values())) >= 200
    docs = spark.createDataFrame([(*r, "", 0) for r in rows], DOCS).repartition(4)
    assert {r.doc_id: r.class_id for r in neardup.classes(docs).collect()} == want


def test_copies_of_one_member_of_a_large_class(spark):
    """Second-generation copies reach the threshold with the member they were made from only; more members than a block."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(300)]
    off = lambda own, k, tag: [f"{tag}{i}" if i in k else x for i, x in enumerate(own)]
    docs = [off(base, {rng.randrange(5, 295)}, f"x{d}y") for d in range(600)]
    docs += [off(docs[d], {s * 50 + rng.randrange(10, 40) for s in range(6)}, f"z{d}y") for d in rng.sample(range(600), 60)]
    rng.shuffle(docs)
    docs = spark.createDataFrame([(i, " ".join(d), "", 0) for i, d in enumerate(docs)], DOCS).repartition(4)
    assert {r.class_id for r in neardup.classes(docs).collect()} == {0}


def test_copies_that_repeat_passages(spark):
    """A passage that one copy repeats doesn't keep the pair apart."""
    rng = random.Random(13)
    rows = []
    for p in range(40):
        own = [f"p{p}w{rng.randrange(10**6)}" for _ in range(100)]
        rows += [(2 * p, " ".join(own)), (2 * p + 1, " ".join(own + own[60:90] * 1000))]
    docs = spark.createDataFrame([(*r, "", 0) for r in rows], DOCS).repartition(4)
    assert {r.doc_id: r.class_id for r in neardup.classes(docs).collect()} == {i: i - i % 2 for i, _ in rows}


@pytest.mark.parametrize(("few", "max_rounds"), [(0, 50), (200_000, 1)])
def test_classes_do_not_depend_on_size_or_rounds(spark, monkeypatch, few, max_rounds):
    """Many rows elsewhere (few), or rounds that end early, leave no pair uncompared."""
    monkeypatch.setattr(neardup, "FEW", few)
    rows = family(17, 150, 330, 5, 40)
    docs = spark.createDataFrame([(*r, "", 0) for r in rows], DOCS).repartition(4)
    assert {r.doc_id: r.class_id for r in neardup.classes(docs, max_rounds=max_rounds).collect()} == brute(rows)


def test_pairs_on_one_template(spark):
    """A thousand pairs on one template: within a pair the similarity is about 0.82, across pairs 0.71."""
    rng = random.Random(19)
    template = [f"t{i}" for i in range(360)]
    fresh = lambda tag, n: [f"{tag}n{i}" for i in range(n)]
    rows = []
    for p in range(1000):
        shared = fresh(f"p{p}", 30)
        rows += [(2 * p + k, " ".join(template + shared + fresh(f"p{p}k{k}", 43))) for k in (0, 1)]
    a, b, c = (grams(rows[i][1]) for i in (0, 1, 2))
    assert len(a & b) >= 0.8 * len(a | b) and len(a & c) < 0.75 * len(a | c)
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "", 0) for r in rows], DOCS).repartition(4)
    assert {r.doc_id: r.class_id for r in neardup.classes(docs).collect()} == {i: i - i % 2 for i, _ in rows}


def test_different_texts_of_one_hash_are_not_copies(spark):
    x, y = thue_morse(11)
    rows = [(0, x), (1, y), (2, x + "\n"), (3, f"{x} {y}"), (4, f"{y} {x}")]
    docs = spark.createDataFrame([(*r, "", 0) for r in rows], DOCS)
    assert {r.doc_id: r.class_id for r in neardup.classes(docs).collect()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}


def test_rows_that_repeat_and_a_very_long_text(spark):
    rng = random.Random(23)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(150_000))
    rows = [(1, long), (2, long + " more"), (3, "a b c d e f g h"), (3, "a b c d e f g h"), (4, "x y"), (4, "p q"), (None, "n"), (None, "n"), (9, None), (9, None)]
    docs = spark.createDataFrame([(*r, "", 0) for r in rows], DOCS).repartition(3)
    got = sorted((str(r.doc_id), str(r.class_id)) for r in neardup.classes(docs).collect())
    assert got == sorted((str(i), str(1 if i == 2 else i)) for i, _ in rows)
    kept = sorted(str((r.doc_id, (r.text or "")[:3])) for r in neardup.keep_first(docs).collect())
    assert kept == sorted(str((i, (t or "")[:3])) for i, t in [(1, long), (3, "a b"), (4, "x y"), (4, "p q"), (None, "n"), (None, "n"), (9, None)])


def test_nothing_but_the_result_stays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_dir", lambda spark: f"file://{tmp_path}")
    docs = spark.createDataFrame([(*r, "", 0) for r in made(5, 3, 10)], DOCS)
    assert neardup.classes(docs).count() and len(list(tmp_path.iterdir())) == 1
