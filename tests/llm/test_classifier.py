import random

import numpy as np
import pyarrow as pa

from grafloom.llm import classifier, queries
from grafloom.llm.hashed import Spec, rows_of, sigmoid, softmax, totals, units
from grafloom.llm.textbatch import slices

DOCS = "doc_id long, text string, score string, lang string"


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) + ("!!" if i % 3 == 0 else "") for _ in range(rng.randint(5, 40))) for i in range(n)]


def test_folded_scores_equal_the_network(spark):
    spec = Spec(chars=(2, 3), words=(1, 2), bits=12)
    own = [*texts(40, 1), "", "é日本 é日本 x", "one"]
    rows = rows_of(pa.array(own), spec)
    model = classifier.train(rows, (np.arange(len(own)) % 3 > 0).astype(int), spec.bits, epochs=3)
    hidden = np.stack([(model.vectors[rows.bucket[a:b]] * rows.share[a:b, None]).sum(0) for a, b in zip(rows.at, rows.at[1:])])
    want = softmax(hidden @ model.out + model.bias)[:, 1]
    for limit in (50, 1 << 20):
        got = []
        for part in slices(pa.array(own), limit):
            sums, count = totals(units(part, spec), model.logits())
            got.append(sigmoid(sums[:, 0] / np.maximum(count, 1) + model.bias[1] - model.bias[0]))
        assert np.allclose(np.concatenate(got), want, atol=1e-5)


def test_classify_learns_and_keeps_every_row(spark):
    rows = [(i, t, "old", "en") for i, t in enumerate(texts(400, 5))] + [(1000, None, "", ""), (1001, "", "", ""), (None, "abc", "", ""), (7, "again", "", "")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(250)] + [(3, None), (None, 1), (4, 1)], "doc_id long, quality int")
    out = classifier.classify(docs, labels).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.doc_id is not None and 250 <= r.doc_id < 400]
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert len({r.score for r in out if not r.text}) == 1


def test_one_label_or_nothing(spark):
    docs = spark.createDataFrame([(1, "a", "", "")], DOCS)
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert classifier.classify(docs, one).first().score > 0.5
    assert classifier.classify(docs, one.limit(0)).first().score == 0.5
    assert classifier.classify(docs.limit(0), one).count() == 0


def test_query_learns_from_its_folds_alone(spark, sf_dir):
    import zlib

    rows = queries.op4_quality_classifier(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def auc(pairs):
    up, down = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in up for b in down])


def test_query_ranks_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None}
    rows = [r for r in queries.op4_quality_classifier(spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert auc([(r.score, truth[r.doc_id]) for r in rows]) > 0.95
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows]) > 0.9


def test_sample_is_bounded_and_the_same_each_time(spark):
    from grafloom.llm.hashed import sample

    docs = spark.createDataFrame([(7, f"text {i}", "", "") for i in range(500)] + [(i, f"own {i}", "", "") for i in range(20)], DOCS)
    labels = spark.createDataFrame([(7, 1), (7, 0), (7, 1)] + [(i, i % 2) for i in range(20) if i != 7], "doc_id long, quality int")
    one, two = (sample(docs.repartition(n), labels.repartition(n), "quality", 5) for n in (2, 6))
    assert one[0].equals(two[0]) and one[1] == two[1] and len(one[1]) == 5
    texts, y = sample(docs, labels.filter("doc_id = 7"), "quality", 5000)
    assert len(texts) == 501 and set(y) == {0}
    assert len(sample(docs, labels, "quality", 5000, most_bytes=30)[1]) <= 6
    assert sample(docs, spark.createDataFrame([(i, "rare" if i == 3 else "often") for i in range(20)], "doc_id long, lang string"), "lang", 4, per_label=True)[1].count("rare") == 1


def test_very_long_text(spark):
    rows = [(i, t, "", "") for i, t in enumerate(texts(60, 8))] + [(99, "abc def!! " * 300_000, "", "")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in classifier.classify(spark.createDataFrame(rows, DOCS), labels).collect()}
    short = {r.doc_id: r.score for r in classifier.classify(spark.createDataFrame([*rows[:-1], (99, "abc def!! " * 3, "", "")], DOCS), labels).collect()}
    assert abs(got[99] - short[99]) < 1e-4


def test_features_of_all_texts_are_those_of_each():
    given = ["", None, "a few words, a few", "x" * 200_000, "words " * 30_000, "a few words, a few"]
    got = rows_of(pa.array(given, pa.string()), classifier.SPEC)
    each = [rows_of(pa.array([t], pa.string()), classifier.SPEC) for t in given]
    assert got.at.tolist() == np.concatenate([[0], np.cumsum([len(r.bucket) for r in each])]).tolist()
    assert got.bucket.tolist() == np.concatenate([r.bucket for r in each]).tolist()
    assert got.share.tolist() == np.concatenate([r.share for r in each]).tolist()
    assert rows_of(pa.array([], pa.string()), classifier.SPEC).at.tolist() == [0]
