import hashlib
import random
import re

import numpy as np

from grafloom.llm import boosting, pii, queries

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = [True, kind == 1 and all(int(x) <= 255 for x in m.group().split(".")), 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0, 8 <= len(d) <= 15][kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_against_brute_force():
    rng = random.Random(2)
    atoms = ["a", "@", ".", "b.c", "@x.yz", "1", "255", "256", "0", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 123-4567", "\n", "é", "日", "%", "01", "a@b@c.d", "1.2.3.4"]
    for _ in range(4000):
        text = "".join(rng.choice(atoms) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == brute(text), text


def test_long_parts_of_an_address():
    zeros = "0" * 5000
    assert pii.base_spans(f"ip {zeros}1.2.3.4") == [(1, 3, 5010)]
    assert pii.base_spans(f"ip 1.{zeros}.3.4 1.2.3.{'9' * 5000}") == [(1, 3, 5009)]


def test_long_runs_take_linear_time():
    for text in ("(555) 123-4567 " * 20_000, "a@b.cd 10.0.0.1 " * 20_000):
        pii.added_spans(text, pii.base_spans(text), pii.fit(lines=300))
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "@a" * 100_000, "+1" * 100_000, "a@" * 100_000):
        pii.base_spans(text)


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (2000, 3)).astype(float)
    y = (x[:, 0] != x[:, 1]).astype(float)
    assert ((boosting.train(x, y, rounds=10).probability(x) > 0.5) == y).all()


def test_model_on_other_lines():
    model = pii.fit()
    hits = wrong = known = 0
    for text, spans in pii.made_lines(800, 99):
        got = set(pii.added_spans(text, pii.base_spans(text), model))
        want = set(spans) - set(pii.base_spans(text))
        hits, wrong, known = hits + len(got & want), wrong + len(got - want), known + len(want)
    assert hits / known > 0.6 and wrong <= 0.05 * hits


def test_find(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "mail a.b@c.de, 10.0.0.1 and 4111-1111-1111-1111 or +44 20 7946 0958.", 1), (4, "no data 2024-01-01 at 10:20:30", 1), (None, "x@y.z", 1), (3, "é x@y.z", 1)]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string, pii int").repartition(2)).collect()
    assert len(got) == len(rows)
    by = {r.text: [(s.kind, r.text[s.start : s.end]) for s in r.pii] for r in got if r.text}
    assert by[rows[2][1]] == [("email", "a.b@c.de"), ("ip", "10.0.0.1"), ("card", "4111-1111-1111-1111"), ("phone", "+44 20 7946 0958")]
    assert by["no data 2024-01-01 at 10:20:30"] == [] and by["é x@y.z"] == [("email", "x@y.z")]
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trees_learn_from_documents(spark):
    """Base spans and look-alikes of the documents teach which further candidates are private: recall and precision on others."""
    rng = random.Random(5)
    digits = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    rows = [(i, f"lot {digits(3)}-{digits(3)}-{digits(4)} of {digits(2)}", None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii int")
    plain, taught = pii.fit(), pii.fit(docs)
    other = [f"lot {digits(3)}-{digits(3)}-{digits(4)} of {digits(2)}" for _ in range(100)]
    count = lambda model, texts: sum(len(pii.added_spans(t, pii.base_spans(t), model)) for t in texts)
    assert count(taught, other) <= 2 and count(taught, other) <= count(plain, other)
    hits = wrong = known = 0
    for text, spans in pii.made_lines(800, 98):
        got, want = set(pii.added_spans(text, pii.base_spans(text), taught)), set(spans) - set(pii.base_spans(text))
        hits, wrong, known = hits + len(got & want), wrong + len(got - want), known + len(want)
    assert hits / known > 0.5 and wrong <= 0.05 * hits


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op9_personal_data(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r.doc_id])
        line = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted(base))
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, *_ in base) for i in range(4)]
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))
