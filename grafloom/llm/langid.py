"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Term frequencies are shares of a text's n-grams and idf comes from the training
texts.  Weights are learned by follow-the-regularised-leader with an elastic
net, per coordinate, so that most are exactly zero; the softmax's temperature is
then fitted on the part of the sample that training left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .hashed import Rows, Spec, batches_of, rows_of, sample, softmax, totals, units
from .textbatch import slices

SPEC = Spec(chars=(1, 2, 3), bits=16)
UNKNOWN = "und"
SCALE = 32.0  # brings the shares' norm near 1


class Model(NamedTuple):
    langs: list[str]
    weights: np.ndarray  # buckets x languages, with idf and scale in them
    bias: np.ndarray
    temperature: float


def ftrl(rows: Rows, idf: np.ndarray, y: np.ndarray, classes: int, epochs: int = 6, batch: int = 16, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Proximal steps: z and n are sums of (shifted) gradients and of their squares; weights follow from them in closed form."""
    rng = np.random.default_rng(seed)
    z, n = np.zeros((len(idf), classes)), np.zeros((len(idf), classes))
    zb, nb = np.zeros(classes), np.zeros(classes)

    def weights(z: np.ndarray, n: np.ndarray, l1: float, l2: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    target = np.eye(classes)[y]
    for _ in range(epochs):
        for some in batches_of(len(y), batch, rng):
            x = rows.take(some)
            own, value = x.owner(), x.share * idf[x.bucket] * SCALE
            used, where = np.unique(x.bucket, return_inverse=True)
            w, b = weights(z[used], n[used], l1, l2), weights(zb, nb, 0.0, l2)
            logits = np.stack([np.bincount(own, value * w[where, c], len(some)) for c in range(classes)], 1) + b
            error = softmax(logits) - target[some]
            g = np.stack([np.bincount(where, value * error[own, c], len(used)) for c in range(classes)], 1)
            z[used] += g - (np.sqrt(n[used] + g**2) - np.sqrt(n[used])) / alpha * w
            n[used] += g**2
            gb = error.sum(0)
            zb += gb - (np.sqrt(nb + gb**2) - np.sqrt(nb)) / alpha * b
            nb += gb**2
    return weights(z, n, l1, l2), weights(zb, nb, 0.0, l2)


def temperature_of(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    low, high, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, labels: DataFrame, label: str = "lang", max_rows: int = 3000, spec: Spec = SPEC) -> Model:
    """Learn from at most max_rows rows of labels (doc_id, lang), as many of each language, and those documents' whole texts."""
    texts, named = sample(docs, labels, label, max_rows, per_label=True)
    langs = sorted(set(named)) or [UNKNOWN]
    y = np.array([langs.index(x) for x in named], int)
    size = 1 << spec.bits
    if len(langs) < 2:
        return Model(langs, np.zeros((size, len(langs)), np.float32), np.zeros(len(langs)), 1.0)
    rows = rows_of(texts, spec)
    held = np.arange(len(y)) % 5 == 4
    known = rows.take(np.flatnonzero(~held))
    idf = np.log((1 + (~held).sum()) / (1 + np.bincount(known.bucket, minlength=size))) + 1
    w, b = ftrl(known, idf, y[~held], len(langs))
    w = (w * idf[:, None] * SCALE).astype(np.float32)
    x = rows.take(np.flatnonzero(held))
    logits = np.stack([np.bincount(x.owner(), x.share * w[x.bucket, c], int(held.sum())) for c in range(len(langs))], 1) + b
    return Model(langs, w, b, temperature_of(logits, y[held]))


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def predict(docs: DataFrame, model: Model, spec: Spec = SPEC) -> DataFrame:
    """docs with lang_pred and score; UNKNOWN with score 0 where text is null or has no letter.  Columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            texts = batch.column("text")
            for part in slices(texts):
                sums, count = totals(units(part, spec), model.weights)
                p = softmax((sums / np.maximum(count, 1)[:, None] + model.bias) / model.temperature)
                best = p.argmax(1)
                # An ASCII letter settles it for most rows; the rest are looked at one by one.
                lower = part.data | 0x20
                ascii_letters = np.concatenate([[0], np.cumsum((lower >= 0x61) & (lower <= 0x7A))])[part.offs]
                for i in range(part.last - part.first):
                    if ascii_letters[i + 1] > ascii_letters[i] or has_letter(texts[part.first + i].as_py()):
                        names.append(model.langs[best[i]])
                        scores.append(float(p[i, best[i]]))
                    else:
                        names.append(UNKNOWN)
                        scores.append(0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def identify(docs: DataFrame, labels: DataFrame, learn: DataFrame | None = None, max_rows: int = 3000) -> DataFrame:
    """docs with lang_pred and score, learned from labels (doc_id, lang) and the texts of learn (docs unless given).

    Rows with a null id or label teach nothing; of an id's labels that differ
    the least counts; a very long text is looked at whole.  All rows of docs come
    back once each; an empty table gives an empty result.
    """
    return predict(docs, fit(docs if learn is None else learn, labels, max_rows=max_rows))

