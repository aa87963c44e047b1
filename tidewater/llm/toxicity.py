"""Toxicity: cumulative-link ordinal regression on sparse word features.

P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector for all ordered thresholds; x is
the presence of each chosen word. Words are runs of letters and digits, ASCII-lower-cased, so case
and attached punctuation do not hide them. The features are the words whose document rates differ
most between toxic and other labelled documents, by a z value of ``min_z`` at least; words of under 3 labelled documents are left out. The result is the expected grade, and a document
is toxic if a grade of one or more is at least as likely as not.

The fit uses about ``max_rows`` labelled documents at most, chosen by the hash of their id; word counts over them are
made by Spark and only the chosen words (at most ``max_terms``) and the rows' indices of those
reach the driver. Scoring reads every whole text once.

Grades are those of the labels, from 0: with two of them there is one threshold and the expected grade is the probability of the
upper one.

Edge cases: null and empty texts have no features and get the grade of the thresholds alone; null
or repeated ids are kept; labels of ids without a document, and null labels, are ignored; without
labels, or with one grade only, everything has severity 0 and is not toxic; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bounded_sample, own_name, prefix_hash, range_hash, slices, stash

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


def term_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each run of letters, digits and bytes over 7F, lower-cased."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ink = _LETTER[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    first = ink.copy()
    first[1:] &= ~ink[:-1] | cut[1:-1]
    last = ink
    last[:-1] &= ~ink[1:] | cut[1:-1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(off, s, "right") - 1, range_hash(prefix_hash(_LOWER[buf]), s, e)


@dataclass
class OrdinalModel:
    """terms: sorted hashes; weights: one for each; thresholds: ascending, one less than the grades."""

    terms: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    lost: list[float] = field(default_factory=list)

    def grades(self, eta: np.ndarray) -> np.ndarray:
        """Probability of each grade, one row for each eta."""
        with np.errstate(over="ignore"):
            below = 1 / (1 + np.exp(-(self.thresholds[None, :] - eta[:, None])))
        edges = np.concatenate([np.zeros((len(eta), 1)), below, np.ones((len(eta), 1))], axis=1)
        return np.diff(edges, axis=1)

    def eta(self, doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
        """w.x of n texts from their words."""
        if not len(self.terms) or not len(h):
            return np.zeros(n)
        k = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        hit = self.terms[k] == h
        pairs = np.unique(doc[hit] * len(self.terms) + k[hit])
        return np.bincount(pairs // len(self.terms), self.weights[pairs % len(self.terms)], minlength=n)


def fit_ordinal(x: np.ndarray, y: np.ndarray, n_grades: int, ridge: float = 0.25, steps: int = 600, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch Adam on the penalised likelihood; thresholds stay ordered."""
    n, d = x.shape
    # the first threshold and the logs of the gaps
    share = np.clip(np.cumsum(np.bincount(y, minlength=n_grades)[:-1]) / n, 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(d), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        w, gaps = p[:d], np.exp(p[d + 1 :])
        theta = p[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        eta = x @ w
        full = np.concatenate([[-np.inf], theta, [np.inf]])
        up, low = full[y + 1] - eta, full[y] - eta
        su, sl = np.where(np.isinf(up), 1.0, sig(up)), np.where(np.isinf(low), 0.0, sig(low))
        q = np.maximum(su - sl, 1e-12)
        du, dl = su * (1 - su) / q, sl * (1 - sl) / q
        g_eta = du - dl  # of the loss
        g_theta = np.zeros(n_grades - 1)
        np.add.at(g_theta, np.minimum(y, n_grades - 2), np.where(y < n_grades - 1, -du, 0))
        np.add.at(g_theta, np.maximum(y - 1, 0), np.where(y > 0, dl, 0))
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([(x.T @ g_eta + ridge * w) / n, [tail[0] / n], tail[1:] * gaps / n])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return p[:d], p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))])


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 10_000, max_terms: int = 512, min_z: float = 4.0) -> OrdinalModel:
    """Learn from labelled documents."""
    none = OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.array([40.0, 41.0]))
    given = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("grade"))
    # bounded by max_rows, so it may be broadcast
    given = bounded_sample(given, "_id", max_rows)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("text")).join(F.broadcast(given), "_id").dropDuplicates(["_id"]).select("_id", "grade", "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, off in slices(batches):
            doc, h = term_hashes(buf, off)
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            keep = np.ones(len(h), bool)
            keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            at = np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=part.num_rows))])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h[keep].view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["_id", "grade", "terms"])

    rows = rows.mapInArrow(words, "_id long, grade int, terms array<long>")
    rows = stash(rows)
    sizes = {r["grade"]: r["n"] for r in rows.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad = sum(n for g, n in sizes.items() if g > 0)
    good = sizes.get(0, 0)
    if not bad or not good:
        return none
    terms = rows.select("grade", F.explode("terms").alias("term")).groupBy("term").agg(F.count_if(F.col("grade") > 0).alias("a"), F.count_if(F.col("grade") <= 0).alias("b")).where("a + b >= 3")
    p = (F.col("a") + F.col("b")) / F.lit(bad + good)
    z = (F.col("a") / F.lit(bad) - F.col("b") / F.lit(good)) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * F.lit(1 / bad + 1 / good))
    chosen = terms.withColumn("z", z).where(F.abs("z") >= min_z).orderBy(F.abs("z").desc(), "term").limit(max_terms).select("term", "z").toPandas()
    if not len(chosen):
        return none
    hashes = chosen["term"].to_numpy(np.int64)
    wanted = F.array(*[F.lit(int(t)) for t in hashes])
    got = rows.select("_id", "grade", F.array_intersect("terms", wanted).alias("hits")).toPandas().sort_values("_id")
    index = {t: k for k, t in enumerate(hashes.tolist())}
    x = np.zeros((len(got), len(hashes)), np.float32)
    for r, hits in enumerate(got["hits"].tolist()):
        x[r, [index[t] for t in hits]] = 1
    y = got["grade"].to_numpy(np.int64)
    w, theta = fit_ordinal(x, y, int(max(y.max(), 1)) + 1)
    order = np.argsort(hashes.view(np.uint64))
    return OrdinalModel(hashes.view(np.uint64)[order], w.astype(float)[order], theta)


def score_toxicity(docs: DataFrame, model: OrdinalModel, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """All columns of ``docs`` and severity, p_toxic, toxic; a column of such a name is replaced."""
    own = ("severity", "p_toxic", "toxic")
    docs = docs.drop(*own)
    names = docs.columns
    text = own_name("text")
    src = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    out = T.StructType([*docs.schema.fields, T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("toxic", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, off in slices(batches, text):
            p = model.grades(model.eta(*term_hashes(buf, off), part.num_rows))
            toxic = 1 - p[:, 0]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), pa.array(p @ np.arange(p.shape[1])), pa.array(toxic), pa.array(toxic >= limit)], names=[*names, *own])

    return src.mapInArrow(run, out)
