import re

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from grafloom.llm import decontaminate, queries
from tests.llm.test_neardup import brute as near_brute


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(spark, stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    scores = {r.doc_id: r.predicted for r in queries.op4_quality_classifier(spark, sf_dir).collect()}
    good = {d for d in texts if scores[d]}
    assert set(kept["quality_classifier"]) == good
    of = near_brute([(d, texts[d]) for d in sorted(good)])
    firsts = {d for d in good if of[d] == d}
    assert set(kept["minhash_near_dedup"]) == firsts
    items = [t for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if (t := decontaminate.normal(r.text))]
    clean = {d for d in firsts if not any(decontaminate.best_end(i, decontaminate.normal(texts[d]))[0] <= len(i) // 20 for i in items)}
    assert set(kept["benchmark_decontamination"]) == clean
    final = kept["secret_scans"]
    assert set(final) == clean
    for d, r in final.items():
        secret = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,})|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}""")
        assert not secret.search(r.text) and r.n_chars == len(r.text)
        if not secret.search(texts[d]):
            assert r.text == texts[d]
    tok = Tokenizer.from_file(queries.tokenizer_path())
    pieces = {}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect():
        pieces.setdefault(r.doc_id, []).append((r.piece, np.frombuffer(r.ids, "<u4").tolist()))
    assert {d: [i for _, ids in sorted(p) for i in ids] for d, p in pieces.items()} == {d: [*tok.encode(r.text, add_special_tokens=False).ids, 0] for d, r in final.items()}


def test_run(spark, sf_dir):
    assert {"doc_id", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, sf_dir).columns)
