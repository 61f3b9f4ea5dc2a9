"""Language ID: multinomial naive Bayes over hashed character n-grams.

Learning counts, over all labelled training documents, how often each n-gram bucket stands
in each language. Each task adds its counts up in one (language, bucket) matrix of fixed
size and hands over its non-zero cells, so the shuffle is small and no language's documents
meet in one task. The driver gets one packed row of counts per language. The smoothed log-probability matrix (languages x ``buckets``) is
broadcast; a document's score sums matrix rows over its n-grams, done for a slice of
documents at once with numpy gathers and ``add.reduceat``.

Defined results: labels are the distinct non-null values of ``lang`` (at most ``max_labels``,
else ValueError, which bounds the matrix); a text that is null or has no letter is ``und``
with score 0.0; without any training document every text is ``und``; ties go to the smaller
label; the score is the posterior probability of the predicted label. Texts are scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm._text import raw, slices, text_column, with_columns

UND = "und"
_FOLD = np.full(128, 32, dtype=np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    log_prob: np.ndarray  # (labels, buckets), float32
    log_prior: np.ndarray
    orders: tuple[int, ...]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _grams(texts: list[str], orders: tuple[int, ...], buckets: int):
    """Per order: (bucket of every n-gram position, first and last position per document).
    ASCII letters are lower-cased, other ASCII becomes a space, further characters are lower-cased."""
    texts = [f" {t.lower()} " for t in texts]
    ends = np.cumsum([len(t) for t in texts])
    x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    x = np.where(x < 128, _FOLD[np.minimum(x, 127)], x)
    begins = np.concatenate([[0], ends[:-1]])
    code = np.zeros(len(x), dtype=np.uint32)
    for n in range(1, max(orders) + 1):
        m = len(x) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint32(0x01000193) + x[n - 1:]
        if n in orders:
            h = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
            yield (h >> np.uint32(12)) & np.uint32(buckets - 1), begins, np.maximum(ends - n + 1, begins)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", buckets: int = 1 << 16,
          orders: tuple[int, ...] = (1, 2, 3), max_labels: int = 512) -> Model:
    """Fit on every row whose ``lang`` is not null. ``buckets`` must be a power of two."""

    def count(batches):
        cells: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for b in batches:
            col, langs = text_column(b), np.array(b.column(1).to_pylist(), dtype=object)
            _, off = raw(col)
            for i, j in slices(off):
                texts = col.slice(i, j - i).to_pylist()
                for name in sorted(set(langs[i:j])):
                    own = [t for t, k in zip(texts, langs[i:j]) if k == name]
                    rows[name] = rows.get(name, 0) + len(own)
                    acc = cells.setdefault(name, np.zeros(buckets, np.int64))
                    for h, s, e in _grams(own, orders, buckets):
                        # every n-gram within a document: gaps at the borders are masked out
                        inside = np.zeros(len(h) + 1, np.int8)
                        np.add.at(inside, np.minimum(s, len(h)), 1)
                        np.add.at(inside, np.minimum(e, len(h)), -1)
                        acc += np.bincount(h[np.cumsum(inside[:-1]) > 0], minlength=buckets)
        for name, acc in cells.items():
            at = np.flatnonzero(acc)
            at, n = np.concatenate([[-1], at]), np.concatenate([[rows[name]], acc[at]])  # bucket -1: documents
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int64))],
                names=["lang", "bucket", "n"])

    known = docs.filter(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))

    def pack(rows: pa.Table) -> pa.Table:
        """A language's counts as one binary value; a group has at most ``buckets`` + 1 rows."""
        at, n = rows["bucket"].to_numpy(), rows["n"].to_numpy()
        cells = np.zeros(buckets + 1, "<i8")  # bucket -1 comes last
        cells[at] = n
        return pa.table({"lang": rows["lang"][:1], "cells": pa.array([cells.tobytes()], pa.binary())})

    got = counts.groupBy("lang").applyInArrow(pack, "lang string, cells binary").limit(max_labels + 1).toArrow().sort_by("lang")
    labels = tuple(got["lang"].to_pylist())
    if len(labels) > max_labels:
        raise ValueError(f"more than max_labels={max_labels} languages")
    log_prob, seen = np.zeros((len(labels), buckets), np.float32), np.zeros(len(labels))
    for i, x in enumerate(got["cells"]):
        n = np.frombuffer(x.as_buffer(), "<i8").astype(np.float64)
        seen[i] = n[-1]
        log_prob[i] = np.log((n[:-1] + 0.5) / (n[:-1].sum() + 0.5 * buckets))
    return Model(labels, log_prob, np.log(seen / max(seen.sum(), 1)), orders)


def posterior(model: Model, texts: list[str]) -> np.ndarray:
    """(documents, labels) posterior probabilities."""
    total = np.tile(model.log_prior, (len(texts), 1))
    for h, s, e in _grams(texts, model.orders, model.log_prob.shape[1]):
        span = np.stack([s, np.minimum(e, len(h))], axis=1).ravel()
        for k in range(len(model.labels)):
            got = np.append(model.log_prob[k].take(h), np.float32(0))
            total[:, k] += np.where(e > s, np.add.reduceat(got, np.minimum(span, len(h)), dtype=np.float64)[::2], 0)
    total -= total.max(axis=1, keepdims=True)
    p = np.exp(total)
    return p / p.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``lang_pred`` and ``score`` (replaced if they exist)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def score(batches):
        m = shared.value
        for b in batches:
            col = text_column(b, text)
            _, off = raw(col)
            pred, prob = [], []
            for i, j in slices(off):
                texts = col.slice(i, j - i).to_pylist()
                ok = [m.labels != () and has_letter(t) for t in texts]
                p = posterior(m, texts) if any(ok) else None
                for k, good in enumerate(ok):
                    best = int(p[k].argmax()) if good else 0
                    pred.append(m.labels[best] if good else UND)
                    prob.append(float(p[k, best]) if good else 0.0)
            yield with_columns(b, {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(prob, pa.float64())})

    docs = docs.drop("lang_pred", "score")
    schema = T.StructType(docs.schema.fields + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(score, schema)


def identify(docs: DataFrame, held_out: Column | None = None, **kw) -> DataFrame:
    """Learn from the rows where ``held_out`` is false (default: all labelled rows), predict all."""
    model = train(docs if held_out is None else docs.filter(~held_out), **kw)
    return predict(docs, model)
