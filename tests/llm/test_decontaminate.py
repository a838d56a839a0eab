import random

import pytest

from grafloom.llm import decontaminate, queries

DOCS = "doc_id long, text string, item_id long, distance string"
ITEMS = "item_id long, text string, source string"


def table_distance(p, t, anchored=False):
    row = list(range(len(p) + 1))
    best = (row[-1], 0)
    for j, c in enumerate(t, 1):
        new = [j if anchored else 0]
        for i, q in enumerate(p, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (q != c)))
        row = new
        if row[-1] < best[0]:
            best = (row[-1], j)
    return best


@pytest.mark.parametrize("seed", range(3))
def test_myers_against_the_table(seed):
    rng = random.Random(seed)
    for _ in range(300):
        p = "".join(rng.choice("abé ") for _ in range(rng.randint(0, 90)))
        t = "".join(rng.choice("abé ") for _ in range(rng.randint(0, 60)))
        for anchored in (False, True):
            want = table_distance(p, t, anchored) if p else (0, 0)
            assert decontaminate.best_end(p, t, anchored=anchored) == want


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        i = rng.randrange(len(out))
        out[i : i + 1] = rng.choice([[], [out[i], "q"], ["z"]])
    return "".join(out)


def test_matches_against_brute_force(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(n))
    items = [(i, prose(rng.randint(8, 30))) for i in range(6)] + [(6, "tiny"), (7, None), (8, ""), (None, prose(9)), (0, None)]
    rows = [(0, None, 1, ""), (1, "", 1, ""), (2, prose(60), 1, ""), (3, "Tiny", None, None)]
    for i in range(40):
        n, item = items[i % 6][0], items[i % 6][1]
        k = len(item) // 20
        rows.append((10 + i, prose(20) + "  \n" + edited(rng, item, rng.choice([0, 1, k, k + 1, 2 * k + 4])).upper() + "\t" + prose(10), n, ""))
    rows.append(rows[-1])
    got = decontaminate.match(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS))
    want = []
    for doc, text, *_ in rows:
        for i, item in items:
            item, norm = decontaminate.normal(item), decontaminate.normal(text)
            if i is not None and item and norm and (d := table_distance(item, norm)[0]) <= len(item) // 20:
                want.append((doc, i, d))
    assert sorted((r.doc_id, r.item_id, r.distance) for r in got.collect()) == sorted(want)
    for r in got.collect():
        text = next(decontaminate.normal(t) for d, t, *_ in rows if d == r.doc_id)
        item = next(decontaminate.normal(t) for i, t in items if i == r.item_id and t)
        assert table_distance(item, text[r.start : r.end], anchored=True)[0] == r.distance
    left = decontaminate.clean(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS))
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, *_ in rows if d not in {w[0] for w in want})


def test_blocks_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"item number {i} has these words in it and no others", "") for i in range(40)], ITEMS)
    docs = spark.createDataFrame([(i, f"so item number {i} has these words in it and no others, see", 0, "") for i in range(0, 80, 3)], DOCS)
    whole = sorted(map(tuple, decontaminate.match(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1500)
    assert len(list(decontaminate.blocks_of(items))) > 2
    assert sorted(map(tuple, decontaminate.match(docs, items).collect())) == whole


def test_nothing(spark):
    none, docs = spark.createDataFrame([], ITEMS), spark.createDataFrame([(1, "a b", 0, "")], DOCS)
    assert decontaminate.match(docs, none).count() == 0
    assert decontaminate.match(docs.limit(0), none).count() == 0
    assert decontaminate.clean(docs, none).count() == 1


def test_query_finds_exact_copies(spark, sf_dir):
    docs = [(r.doc_id, decontaminate.normal(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, decontaminate.normal(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in queries.op7_benchmark_decontamination(spark, sf_dir).collect()}
    assert got >= {(d, i) for d, text in docs for i, item in items if item in text}
