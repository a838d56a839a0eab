import hashlib
import random

import numpy as np
import pytest

from grafloom.llm import queries, repeats
from tests.llm.thue_morse import thue_morse

DOCS = "doc_id long, text string, spans string, f int"


def brute(rows, need, keep):
    """By (doc_id, place) order; rows: (doc_id, text)."""
    data = [(t or "").encode() for _, t in rows]
    where = {}
    order = sorted(range(len(rows)), key=lambda i: (-(2**63) if rows[i][0] is None else rows[i][0]))
    for i in order:
        for s in range(len(data[i]) - need + 1):
            where.setdefault(data[i][s : s + need], []).append((i, s))
    gone = [bytearray(len(d)) for d in data]
    for places in where.values():
        if len(places) > 1:
            for i, s in places[1:] if keep == "first" else places:
                gone[i][s : s + need] = b"\1" * need
    return [(len(d), sum(g), bytes(g).replace(b"\0", b" ").split().__len__(), hashlib.sha256(bytes(c for c, x in zip(d, g) if not x)).hexdigest()) for d, g in zip(data, gone)]


def summary(rows):
    return [(r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows]


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [prose(rng.randint(8, 30)) for _ in range(5)]
    base = prose(60)
    out = ["", None, "a" * 90, "a" * 70 + "b" + "a" * 70, "xy " * 40, base, base]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.4:
            out.append(prose(rng.randint(0, 12)) + rng.choice(shared) + prose(rng.randint(0, 12)))
        elif kind < 0.7:
            own = base.split()
            for _ in range(3):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(" ".join(own))
        else:
            out.append(prose(rng.randint(1, 40)))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("keep", ["first", "none"])
def test_suffix_order_and_factors(keep):
    rng = np.random.default_rng(5)
    for need in (8, 20, 37, 100):
        for letters in (1, 2, 4):
            data = rng.integers(0, letters, 400).astype(np.uint8)
            data[200:330] = data[10:140]
            starts = np.flatnonzero(rng.random(400 - need + 1) < 0.8)
            got = repeats.repeated_starts(data, starts, need, keep)
            strings = [data[s : s + need].tobytes() for s in starts]
            want = [strings[i] in strings[:i] or (keep == "none" and strings.count(strings[i]) > 1) for i in range(len(starts))]
            assert got.tolist() == want


def test_longest_previous_factor_values():
    data = np.frombuffer(b"abaababaabaababaababa" * 2, np.uint8)
    need, n = 8, len(data)
    starts = np.arange(n - need + 1)
    sa, lcp = repeats.suffix_order(data, starts, need)
    got = dict(zip(sa.tolist(), repeats.longest_previous(sa, lcp, need).tolist()))
    for s in starts:
        best = max((next((k for k in range(need) if data[s + k] != data[q + k]), need) for q in range(s)), default=0)
        assert got[s] == (best if best >= need else 0)


@pytest.mark.parametrize(("keep", "crowd"), [("none", 128), ("first", 128), ("none", 3), ("first", 3)])
def test_against_brute_force(spark, monkeypatch, keep, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "BLOCK", 8)
    rows = corpus(crowd, 70)
    docs = spark.createDataFrame([(i, t, "old", 1) for i, t in rows], DOCS).repartition(5)
    got = sorted(repeats.remove_repeats(docs, need=64, gram=16, keep=keep).collect(), key=lambda r: r.doc_id)
    assert summary(got) == brute(rows, 64, keep)


def test_null_ids_repeated_rows_and_nothing(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (3, text), (3, text), (4, "other words that are not in it at all")]
    got = repeats.remove_repeats(spark.createDataFrame([(i, t, "", 0) for i, t in rows], DOCS), need=20, gram=8).collect()
    assert sorted((str(r.doc_id), len(r.kept)) for r in got) == [("3", 0), ("3", 0), ("4", len(rows[3][1])), ("None", len(text))]
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(spark.createDataFrame([], DOCS), keep="last")


def test_query(spark, sf_dir):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = sorted(queries.op2_suffix_array_dedup(spark, sf_dir).collect())
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute(rows, 400, "none")


@pytest.mark.parametrize("keep", ["first", "none"])
@pytest.mark.parametrize("crowd", [128, 1])
def test_different_strings_of_one_hash_are_not_equal(spark, monkeypatch, keep, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "BLOCK", 8)
    x, y = thue_morse(11)
    a, b = thue_morse(6, "a" * 32, "b" * 32)
    rows = list(enumerate([x, y, "q" + x, a, b, a + "q", "z" * 5000 + x, x + y]))
    docs = spark.createDataFrame([(i, t, "", 0) for i, t in rows], DOCS).repartition(3)
    got = sorted(repeats.remove_repeats(docs, need=2048, gram=64, keep=keep).collect(), key=lambda r: r.doc_id)
    assert summary(got) == brute(rows, 2048, keep)


def test_very_long_text(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    rows = [(0, long), (1, long[1000:1300]), (2, "x" * 200 + long[5000:5100])]
    got = sorted(repeats.remove_repeats(spark.createDataFrame([(i, t, "", 0) for i, t in rows], DOCS), need=64, gram=16, keep="none").collect(), key=lambda r: r.doc_id)
    assert summary(got) == brute(rows, 64, "none")


@pytest.mark.parametrize("keep", ["none", "first"])
def test_copies_of_a_frequent_run_are_not_dealt_to_one_task(spark, tmp_path, keep):
    rows = [(7, 7, 7, i, i % 5, i, 0, 9, 0) for i in range(4000)] + [(i // 2, 1, 1, i, i % 5, i, 20, 29, 20) for i in range(400)] + [(i, 2, 2, i, 0, i, 40, 49, 40) for i in range(1000, 1100)]
    spark.createDataFrame(rows, repeats.UNITS).repartition(8).write.parquet(f"{tmp_path}/units")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole, _ = repeats._settle(spark, spark.read.parquet(f"{tmp_path}/units"), keep)
        got = [tuple(x) for x in whole.selectExpr("f", "r", "lo", "hi", "spark_partition_id()").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    frequent = [x for x in got if x[2] == 0]
    tasks = [x[4] for x in frequent]
    assert max(tasks.count(t) for t in set(tasks)) < len(tasks) / 2
    assert len({x[:4] for x in got}) == len(got)
    assert (len(frequent), len(got)) == ((4000, 4400) if keep == "none" else (3999, 4199))


@pytest.mark.parametrize("keep", ["none", "first"])
def test_frequent_runs_against_brute_force(spark, monkeypatch, keep):
    monkeypatch.setattr(repeats, "OFTEN", 3)
    monkeypatch.setattr(repeats, "CROWD", 3)
    monkeypatch.setattr(repeats, "BLOCK", 8)
    rows = corpus(11, 70)
    docs = spark.createDataFrame([(i, t, "old", 1) for i, t in rows], DOCS).repartition(5)
    got = sorted(repeats.remove_repeats(docs, need=64, gram=16, keep=keep).collect(), key=lambda r: r.doc_id)
    assert summary(got) == brute(rows, 64, keep)
