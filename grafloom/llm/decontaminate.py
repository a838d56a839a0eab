"""Benchmark decontamination by pigeonhole edit matching.

A text that holds a test item with at most k edits holds one of any k + 1
pieces of the item unchanged.  Pieces are found exactly, all in one pass over a
text; where one is hit, Myers' bit-parallel distance of the whole item within
the text around it decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
CHARS_PER_EDIT = 20
HITS = "doc_id long, item_id long, distance int, budget int, start long, end long"


def normal(text: str | None) -> str:
    """Lower case, with each run of white space as one space."""
    return " ".join((text or "").lower().split())


def budget(item: str, chars_per_edit: int = CHARS_PER_EDIT) -> int:
    return len(item) // chars_per_edit


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 consecutive pieces of nearly equal length, with their places."""
    n = edits + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_end(pattern: str, text: str, eq: dict[str, int] | None = None, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of pattern to a substring of text, and the first end of such a one (Myers 1999).

    anchored: the substring begins where text does.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    eq = masks(pattern) if eq is None else eq
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text, 1):
        x = eq.get(c, 0) | vn
        d0 = ((((x & vp) + vp) ^ vp) | x) & full
        hn, hp = vp & d0, (vn | ~(vp | d0)) & full
        score += bool(hp & top) - bool(hn & top)
        hp, hn = (hp << 1 | anchored) & full, hn << 1 & full
        vp, vn = (hn | ~(d0 | hp)) & full, hp & d0
        if score < best:
            best, at = score, j
    return best, at


class Matcher:
    """All pieces of some items in one automaton; items without text are never found."""

    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int = CHARS_PER_EDIT) -> None:
        import ahocorasick

        self.items = [(i, t, budget(t, chars_per_edit)) for i, t in items if t]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, edits) in enumerate(self.items):
            for at, piece in pieces(text, edits):
                where.setdefault(piece, []).append((n, at + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, places)
        if where:
            self.automaton.make_automaton()
        self.some = bool(where)
        self.eq: dict[int, dict[str, int]] = {}

    def find(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item, distance, budget, start, end) of the best place of each item within its budget."""
        spans: dict[int, list[list[int]]] = {}
        if not self.some or not text:
            return []
        for last, places in self.automaton.iter(text):
            for n, tail in places:
                _, item, edits = self.items[n]
                start = last + 1 - tail
                a, b = max(0, start - edits), min(len(text), start + len(item) + edits)
                own = spans.setdefault(n, [])
                if own and a <= own[-1][1] and a >= own[-1][0]:
                    own[-1][1] = max(own[-1][1], b)
                else:
                    own.append([a, b])
        out = []
        for n, own in spans.items():
            name, item, edits = self.items[n]
            eq = self.eq.setdefault(n, masks(item))
            best = min(((*best_end(item, text[a:b], eq), a) for a, b in own), key=lambda x: (x[0], x[2] + x[1]))
            if best[0] <= edits:
                end = best[2] + best[1]
                head = text[max(0, end - len(item) - edits) : end][::-1]
                length = best_end(item[::-1], head, anchored=True)[1]
                out.append((name, best[0], edits, end - length, end))
        return out


def match(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """A row for each row of docs (doc_id, text) and item of benchmark (item_id, text) that it holds within budget.

    One edit is allowed for each chars_per_edit characters of the normalised
    item.  start and end are code points of the normalised document, of the
    closest place (the first of equals).  Items go to the tasks in blocks of
    BLOCK_BYTES or so, each against all documents, so that what is sent is
    bounded.  Null or empty texts and items (and items without an id) match nothing; repeated documents
    each match; repeated items count once; empty tables give an empty result.
    """
    found = [_against(docs, own, chars_per_edit) for own in blocks_of(benchmark)]
    return reduce(DataFrame.union, found)


def blocks_of(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in blocks of about BLOCK_BYTES; at least one block, if an empty one."""
    items = benchmark.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), "text").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    blocks = 1 if total <= BLOCK_BYTES else -(-2 * total // BLOCK_BYTES)
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        yield sorted((r["item_id"], normal(r["text"])) for r in block.collect())


def _against(docs: DataFrame, items: list[tuple[int, str]], chars_per_edit: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, chars_per_edit)
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("budget", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            rows = []
            for name, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                hits = matcher.find(normal(text.as_py()))
                rows += [(name.as_py(), *h) for h in hits]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, HITS)


def clean(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """docs without the rows whose text holds an item.

    Each row is decided where it is read, so that no text is shuffled; rows with
    null or empty text stay.
    """
    for own in blocks_of(benchmark):
        docs = _without(docs, own, chars_per_edit)
    return docs


def _without(docs: DataFrame, items: list[tuple[int, str]], chars_per_edit: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, chars_per_edit)
        for batch in batches:
            yield batch.filter(pa.array([not matcher.find(normal(t.as_py())) for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
