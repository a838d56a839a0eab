"""Quality classifier by supervised subword embeddings.

Each text is the average of learned vectors of its hashed words and character
n-grams; a softmax over a linear map of that average gives the score.  Vectors
and map are trained by stochastic gradient descent in numpy on a bounded sample.
As the map is linear, a bucket's vector is folded into its one contribution to
the logit before scoring, which changes no score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashed import Rows, Spec, batches_of, rows_of, sample, sigmoid, softmax, totals, units
from .textbatch import slices

SPEC = Spec(chars=(3, 4), words=(1,), bits=17)


class Model(NamedTuple):
    vectors: np.ndarray  # buckets x dimensions
    out: np.ndarray  # dimensions x 2
    bias: np.ndarray  # 2

    def logits(self) -> np.ndarray:
        """What one whole share of a bucket adds to the log odds of label 1."""
        return (self.vectors @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32)


def train(rows: Rows, labels: np.ndarray, bits: int, dim: int = 8, epochs: int = 12, rate: float = 0.3, batch: int = 32, seed: int = 7) -> Model:
    """Softmax regression on averaged vectors, both learned, with steps scaled by past gradients."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (dim, 2)), np.zeros(2)
    past_v, past_o, past_b = np.full(1 << bits, 1e-8, np.float32), np.full((dim, 2), 1e-3), np.full(2, 1e-3)
    target = np.eye(2)[labels]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for some in batches_of(len(labels), batch, rng):
            x = rows.take(some)
            own = x.owner()
            part = vectors[x.bucket] * x.share[:, None]
            hidden = np.stack([np.bincount(own, part[:, k], len(some)) for k in range(dim)], 1)
            error = softmax(hidden @ out + bias) - target[some]
            back = error @ out.T
            used, where = np.unique(x.bucket, return_inverse=True)
            grad = np.stack([np.bincount(where, x.share * back[own, k], len(used)) for k in range(dim)], 1)
            past_v[used] += (grad**2).mean(1)
            vectors[used] -= (step * grad / np.sqrt(past_v[used])[:, None]).astype(np.float32)
            g_out, g_bias = hidden.T @ error, error.sum(0)
            past_o += g_out**2
            past_b += g_bias**2
            out -= step * g_out / np.sqrt(past_o)
            bias -= step * g_bias / np.sqrt(past_b)
    return Model(vectors, out, bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 5000, spec: Spec = SPEC) -> Model:
    """Learn from at most max_rows rows of labels (doc_id, label of 0 or 1) and those documents' whole texts.

    Without a row of both labels the model knows the share of label 1 alone.
    """
    texts, y = sample(docs, labels.filter(F.col(label).isin(0, 1)), label, max_rows)
    y = np.array(y, int)
    if len(set(y.tolist())) < 2:
        odds = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return Model(np.zeros((1 << spec.bits, 1), np.float32), np.zeros((1, 2)), np.array([0.0, odds]))
    return train(rows_of(texts, spec), y, spec.bits)


def score(docs: DataFrame, model: Model, spec: Spec = SPEC, name: str = "score") -> DataFrame:
    """docs with a column of the probability of label 1; null and empty texts get that of no feature."""
    weights, bias = model.logits(), float(model.bias[1] - model.bias[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.zeros(0)]
            for part in slices(batch.column("text")):
                sums, count = totals(units(part, spec), weights)
                values.append(sigmoid(sums[:, 0] / np.maximum(count, 1) + bias))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(values), pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, learn: DataFrame | None = None, threshold: float = 0.3, max_rows: int = 5000) -> DataFrame:
    """docs with score (of label 1) and predicted (1 from threshold on).

    labels: (doc_id, quality); learn: the documents to learn from, docs unless
    given; of an id's labels that differ the least counts.  All rows of docs come
    back once each, repeated ones too; a very long text is looked at whole;
    columns of these two names are replaced.  An empty table gives an empty
    result.
    """
    model = fit(docs if learn is None else learn, labels, max_rows=max_rows)
    return score(docs.drop("score", "predicted"), model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


