import random
import zlib

import numpy as np

from grafloom.llm import langid, queries

DOCS = "doc_id long, text string, lang string, score double"
ALPHABETS = {"xa": "abcdeéo", "xb": "fghijkuo", "xc": "日本語中文"}


def docs_of(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = sorted(ALPHABETS)[i % 3]
        out.append((i, " ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(4, 40))), lang, 0.5))
    return out


def test_learns_and_marks_what_has_no_letter(spark):
    rows = docs_of(400, 1)
    odd = [(1000, None, "xa", None), (1001, "", None, None), (1002, "12 + 34 !!", "xa", None), (1003, "12 é", None, None), (None, "fgh ijk", "xb", None), (5, "abc abc", "xa", None)]
    docs = spark.createDataFrame(rows + odd, DOCS).repartition(3)
    learn = docs.filter("doc_id < 250").select("doc_id", "lang")
    out = langid.identify(docs, learn).collect()
    assert len(out) == len(rows) + len(odd)
    held = [r for r in out if r.doc_id is not None and 250 <= r.doc_id < 400]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    by_id = {r.doc_id: r for r in out}
    assert all(by_id[k].lang_pred == "und" and by_id[k].score == 0 for k in (1000, 1001, 1002))
    assert by_id[1003].lang_pred in ALPHABETS and by_id[None].lang_pred == "xb"
    assert all(0 <= r.score <= 1 for r in out)


def test_elastic_net_leaves_zeros_and_temperature_calibrates():
    logits, y = np.array([[4.0, 0], [4.0, 0], [0, 4.0], [4.0, 0]]), np.array([0, 0, 1, 1])
    t = langid.temperature_of(logits, y)
    loss = lambda t: -np.log(langid.softmax(logits / t)[np.arange(4), y]).mean()
    assert loss(t) <= min(loss(t * 1.1), loss(t * 0.9)) + 1e-9
    assert langid.temperature_of(logits[:0], y[:0]) == 1.0


def test_nothing_to_learn_or_predict(spark):
    docs = spark.createDataFrame([(1, "abc", "xa", 0.0)], DOCS)
    assert langid.identify(docs, docs.select("doc_id", "lang").limit(0)).first().lang_pred == "und"
    assert langid.identify(docs, docs.select("doc_id", "lang")).first().lang_pred == "xa"
    assert langid.identify(docs.limit(0), docs.select("doc_id", "lang"), learn=docs).count() == 0


def test_query(spark, sf_dir):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op10_language_id(spark, sf_dir).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in rows if r.held_out]) > 0.9


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in queries.op10_language_id(spark, sf).collect() if r.held_out and truth[r.doc_id] is not None]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) > 0.97
    assert {r.lang_pred for r in rows} >= {x for x in truth.values() if x}


def test_rare_language_and_very_long_text(spark):
    rows = [(i, t, "xa" if lang == "xb" else lang, s) for i, t, lang, s in docs_of(900, 3) if lang != "xb"]
    rows += [(5000 + i, "fgh ijk uof " * 9, "xb", 0.0) for i in range(2)] + [(9999, "kif hgo " * 200_000, None, 0.0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    out = {r.doc_id: r.lang_pred for r in langid.identify(docs, docs.select("doc_id", "lang"), max_rows=60).collect()}
    assert out[5000] == out[9999] == "xb"
