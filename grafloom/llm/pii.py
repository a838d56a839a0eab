"""Personal data: fixed base formats, and further candidates chosen by boosted trees.

High-recall generators propose spans, which may overlap, beside the base ones;
gradient-boosted trees look at each one's format and context, and a threshold
per kind, set on held-out ones for precision, selects what is added.  The trees
learn from lines made from a seed, in which it is known what is private, and
from a bounded sample of the documents' own candidates: one that is a base span
is private, one that touches none isn't.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boosting
from .hashed import least_hashed
from .rules import calibrate

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end


# Base formats.  Fixed values: the patterns; a run that can't begin a match is consumed whole, which keeps them linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"[0-9]++(?:(\.[0-9]++)(\.[0-9]++)(\.[0-9]++))?")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A match begins as far left of its @ as the characters and the match before let it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        elif start < at:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    out: list[Span] = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in _IP.finditer(text):
            if m.group(1) and all(len(own := p.lstrip("0")) <= 3 and int(own or "0") <= 255 for p in m.group().split(".")):
                out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40 and 16 <= len(d := only_digits(m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(only_digits(m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# Generators of further candidates; each is bounded in length.
_WORDED = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\x20?[(\[{<]?\x20?(?:at|AT)\x20?[)\]}>]?\x20?[A-Za-z0-9-]{1,63}(?:\x20?[(\[{<]?\x20?(?:dot|DOT)\x20?[)\]}>]?\x20?[A-Za-z0-9-]{2,24}){1,4}")
_SIX = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,24}(?![0-9A-Za-z])")


def candidates(text: str) -> list[Span]:
    """Spans of any kind that might be private; a number is proposed as card and as phone."""
    out: list[Span] = []
    if "dot" in text or "DOT" in text:
        out += [(0, m.start(), m.end()) for m in _WORDED.finditer(text)]
    if text.count(":") >= 2:
        out += [(1, m.start(), m.end()) for m in _SIX.finditer(text)]
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            n = len(only_digits(m.group()))
            if n <= 15:
                out.append((3, m.start(), m.end()))
            if 13 <= n <= 19:
                out.append((2, m.start(), m.end()))
    return out


# Words that make a reading likelier or less likely.
CUES = (
    ("mail", "email", "e-mail", "contact", "write"),
    ("ip", "address", "host", "server", "ping", "login"),
    ("card", "visa", "mastercard", "amex", "credit", "payment"),
    ("phone", "tel", "call", "mobile", "fax", "cell", "whatsapp", "dial"),
    ("order", "invoice", "isbn", "item", "part", "serial", "ref", "id", "no", "number", "build", "version", "ticket"),
)
_TOKEN = re.compile(r"[A-Za-z-]+")


def features(text: str, span: Span) -> list[float]:
    """Format and context of one candidate."""
    kind, s, e = span
    raw, digits = text[s:e], only_digits(text[s:e])
    before, after = text[max(0, s - 40) : s], text[e : e + 1]
    near = [w.lower() for w in _TOKEN.findall(before)[-3:]]
    groups = re.findall(r"[0-9]+", raw)
    out = [float(kind == k) for k in range(len(KINDS))]
    out += [len(raw), len(digits), len(set(digits)), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), len(groups[-1]) if groups else 0]
    out += [float(bool(digits) and luhn(digits)), float(digits[:1] in ("3", "4", "5", "6")), float(raw[:1] == "+"), float("(" in raw and ")" in raw)]
    out += [raw.count(" "), raw.count("-"), raw.count("."), raw.count(":"), float("::" in raw), sum(c in "abcdefABCDEF" for c in raw) / len(raw)]
    out += [float(bool(re.search(r"[(\[{<]\x20?(?:at|AT)", raw))), float(bool(re.search(r"dot|DOT", raw)))]
    out += [float(any(w in cue for w in near)) for cue in CUES]
    out += [float(before[-1:] in ("", " ", "\n", "\t", ":", "(")), float(after in ("", " ", "\n", ",", ".", ";", ")")), float(before[-1:] in ("$", "€", "#"))]
    return out


class Model(NamedTuple):
    trees: boosting.Booster
    thresholds: tuple[float, ...]


def _digits(rng: random.Random, n: int) -> str:
    return str(rng.randint(1, 9)) + "".join(rng.choice("0123456789") for _ in range(n - 1))


def _with_luhn(rng: random.Random, n: int) -> str:
    head = rng.choice("3456") + _digits(rng, n - 2)
    return next(head + c for c in "0123456789" if luhn(head + c))


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(["ba", "re", "thi", "on", "est", "mo", "li", "cu", "ne"]) for _ in range(rng.randint(1, 3)))


def made_lines(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Lines with what is private in them; half hold look-alikes."""
    rng = random.Random(seed)
    d = lambda k: _digits(rng, k)
    name = lambda: f"{_word(rng)}{rng.choice(['.', '_', ''])}{_word(rng)}"
    grouped = lambda x, sep: sep.join(x[i : i + 4] for i in range(0, len(x), 4))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    private: list[tuple[int, Callable[[], str]]] = [
        (0, lambda: f"{name()} {rng.choice(['(at)', '[at]', '{at}'])} {_word(rng)} {rng.choice(['(dot)', '[dot]', 'dot'])} {rng.choice(['com', 'org', 'net'])}"),
        (1, lambda: ":".join(hexes(4) for _ in range(8))),
        (1, lambda: f"{hexes(4)}:{hexes(4)}::{hexes(rng.randint(2, 4))}"),
        (2, lambda: grouped(_with_luhn(rng, rng.choice([13, 14, 15])), rng.choice(["", " ", "-"]))),
        (3, lambda: f"({d(3)}) {d(3)}-{d(4)}"),
        (3, lambda: f"{d(3)}-{d(3)}-{d(4)}"),
        (3, lambda: f"{d(3)}.{d(3)}.{d(4)}"),
    ]
    alike: list[Callable[[], str]] = [
        lambda: f"{_word(rng)} at {_word(rng)} . {_word(rng)}", lambda: f"{_word(rng)} at {_word(rng)}. {_word(rng).title()}", lambda: f"{rng.randint(0, 23):02}:{rng.randint(0, 59):02}:{rng.randint(0, 59):02}",
        lambda: d(rng.randint(13, 19)), lambda: d(rng.randint(7, 12)), lambda: grouped(d(16), " "), lambda: f"{d(4)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"{d(4)}-{d(4)}-{d(4)}",
        lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"{d(1)}.{d(2)}.{d(4)}.{d(3)}", lambda: f"{d(3)}.{d(6)}", lambda: f"{d(2)} {d(3)} {d(3)}", lambda: f"{d(4)} {d(4)}",
    ]
    out = []
    for _ in range(n):
        text, spans = " ".join(_word(rng) for _ in range(rng.randint(0, 5))), []
        if rng.random() < 0.5:
            kind, make = rng.choice(private)
            text += f" {rng.choice(CUES[kind])}{rng.choice([':', ''])}" if rng.random() < 0.6 else ""
            value = make()
            start = len(text) + 1
            text += f" {value}"
            spans.append((kind, start, start + len(value)))
        else:
            text += f" {rng.choice(CUES[4])}" if rng.random() < 0.5 else ""
            text += f" {rng.choice(alike)()}"
        out.append((text + rng.choice(["", ".", ", ", " "]) + " ".join(_word(rng) for _ in range(rng.randint(0, 4))), spans))
    return out


def learned(lines: int, seed: int, texts: Iterable[str]) -> list[tuple[str, Span, float]]:
    """(text, candidate, whether it is private) of made lines and of texts."""
    out = [(text, c, float(c in spans)) for text, spans in made_lines(lines, seed) for c in candidates(text)]
    for text in texts:
        base = base_spans(text)
        apart = Apart(base)
        out += [(text, c, float(c in base)) for c in candidates(text) if c in base or apart.clear(c)]
    return out


def fit(docs: DataFrame | None = None, lines: int = 3000, seed: int = 13, precision: float = 0.98, floor: float = 0.9, max_rows: int = 2000) -> Model:
    """Trees from made lines and at most max_rows of docs (those with digits whose hash is lowest).

    Each kind's threshold is the least that keeps precision on held-out
    candidates, floor at least.
    """
    texts = [] if docs is None else least_hashed(docs.filter(F.col("text").rlike("[0-9]")), max_rows)
    known = learned(lines, seed, texts)
    x = np.array([features(text, c) for text, c, _ in known])
    y, kinds = np.array([private for *_, private in known]), np.array([c[0] for _, c, _ in known])
    held = np.arange(len(y)) % 4 == 3
    trees = boosting.train(x[~held], y[~held])
    a, b = calibrate(trees.odds(x[held]), y[held])
    trees = trees._replace(slope=a, shift=b)
    p = trees.probability(x[held])
    thresholds = []
    for k in range(len(KINDS)):
        own = kinds[held] == k
        fits = [t for t in np.unique(p[own]) if (y[held][own & (p >= t)]).mean() >= precision]
        thresholds.append(float(max(floor, min(fits, default=1.0))))
    return Model(trees, tuple(thresholds))


class Apart:
    """Spans by place, to tell in logarithmic time whether another one touches any."""

    def __init__(self, spans: list[Span]) -> None:
        self.places = sorted((s, e) for _, s, e in spans)
        self.furthest = list(accumulate((e for _, e in self.places), max))

    def clear(self, span: Span) -> bool:
        before = bisect_left(self.places, (span[2],))
        return not before or self.furthest[before - 1] <= span[1]


def added_spans(text: str, base: list[Span], model: Model) -> list[Span]:
    """Chosen candidates, likeliest first, that touch neither a base span nor one already chosen."""
    apart = Apart(base)
    found = [c for c in candidates(text) if apart.clear(c)]
    if not found:
        return []
    p = model.trees.probability(np.array([features(text, c) for c in found]))
    out: list[Span] = []
    taken: list[tuple[int, int]] = []  # by place, without overlaps
    for i in np.argsort(-p, kind="stable"):
        c = found[i]
        at = bisect_left(taken, (c[2],))
        if p[i] >= model.thresholds[c[0]] and (not at or taken[at - 1][1] <= c[1]):
            out.append(c)
            insort(taken, (c[1], c[2]))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with pii: spans by kind, then start (code points, end exclusive), and whether each is a base one.

    The model is fitted on docs unless given.  Null and empty texts have none; a
    very long text is searched whole, in linear time; every row comes back once; a
    column pii is replaced; an empty table gives an empty result.
    """
    model = model or fit(docs)
    docs = docs.drop("pii")

    def spans_of(text: str | None) -> list[dict]:
        if not text:
            return []
        base = base_spans(text)
        every = [(k, s, e, True) for k, s, e in base] + [(k, s, e, False) for k, s, e in added_spans(text, base, model)]
        return [{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in sorted(every)]

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            values = [spans_of(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, kind)], names=[*batch.schema.names, "pii"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("pii", SPANS)]))
