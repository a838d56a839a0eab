import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from grafloom.llm import packing, queries

DOCS = "doc_id long, text string, length int, task string"


def brute_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms[rooms.index(min(fits))] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 50, 200])
    lengths = [rng.randint(1, capacity) if rng.random() < 0.7 else rng.randint(1, max(1, capacity // 8)) for _ in range(rng.randint(0, 600))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    slots = packing.plan(counts, capacity)
    spans, done = {}, dict.fromkeys(counts, 0)
    for length, first, pieces, sequence, per, base in slots:
        assert first == done[length]
        done[length] += pieces
        for i in range(pieces):
            at = base + (i % per) * length
            spans.setdefault(sequence + i // per, []).append((at, at + length))
    assert done == counts
    for own in spans.values():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] <= capacity and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    assert len(spans) == brute_best_fit(lengths, capacity)


def check(rows, texts, capacity, encode):
    pieces, by_sequence = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["offset"] + r["length"]))
    for doc, own in pieces.items():
        own.sort(key=lambda r: r["piece"])
        ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in own]).tolist()
        assert ids == [*encode(texts[doc] or ""), 0]
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own[:-1])]).tolist()
        assert all(r["length"] == capacity for r in own[1:])
    for own in by_sequence.values():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] <= capacity and all(a[1] == b[0] for a, b in zip(own, own[1:]))


def test_pack_whole_texts(spark):
    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    encode = lambda t: tok.encode(t, add_special_tokens=False).ids
    texts = {0: None, 1: "", 2: "It's a  short one.\n\n", 3: "word " * 700, 4: "日本語 é \U0001f600 <|endoftext|> x", 5: "the same", 6: "the same", 7: "q" * 5000, 8: "a b c d e f g"}
    docs = spark.createDataFrame([(k, v, 1, "x") for k, v in texts.items()], DOCS).repartition(3)
    rows = packing.pack(docs, path, capacity=64).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    check(rows, texts, 64, encode)


def test_null_ids_repeats_and_nothing(spark):
    path = queries.tokenizer_path()
    rows = packing.pack(spark.createDataFrame([(None, "a", 1, ""), (1, "a", 1, ""), (1, "a", 1, "")], DOCS), path, capacity=8, carry={}).collect()
    assert len(rows) == 3 and "ids" not in rows[0]
    assert packing.pack(spark.createDataFrame([], DOCS), path).count() == 0


def test_query_on_a_table(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    tok = Tokenizer.from_file(queries.tokenizer_path())
    rows = queries.op1_best_fit_packing(spark, sf_dir).collect()
    for r in rows:
        ids = [*tok.encode(docs[r["doc_id"]], add_special_tokens=False).ids, 0]
        part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    lengths = [r["length"] for r in rows]
    assert len({r["sequence_id"] for r in rows}) == brute_best_fit(lengths, 2048)


def test_fast_ids_are_the_file_s_over_all_code_points():
    encode = packing.encoder(queries.tokenizer_path())
    assert encode.fast is not None
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 1 << 14):
        text = "".join(f"a{c}b {c}{c} 1{c}2 '{c} \n{c}  {c}\t" for c in map(chr, points[i : i + (1 << 14)]))
        if not any(s in text for s in encode.special):
            assert encode(text) == encode._own(text)


def test_other_merges_go_to_the_file_s_own_tokenizer(tmp_path):
    import json

    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    merges = spec["model"]["merges"]
    merges[0], merges[50] = merges[50], merges[0]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    assert packing.Encoder(str(path)).fast is None


def test_very_long_text(spark):
    path = queries.tokenizer_path()
    rows = packing.pack(spark.createDataFrame([(1, "word and " * 200_000, 0, ""), (2, "b", 0, "")], DOCS), path).collect()
    tok = Tokenizer.from_file(path)
    check(rows, {1: "word and " * 200_000, 2: "b"}, 2048, lambda t: tok.encode(t, add_special_tokens=False).ids)
