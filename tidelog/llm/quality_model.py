"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each text becomes `STATISTICS`, shares and logarithms that do not depend on its language.  Per class the model keeps
the mean, and of the Cholesky factor of a covariance shrunk towards the pooled diagonal the inverse, which is triangular too and
makes a squared Mahalanobis distance one product.  A score is the posterior of
label 1 from the difference of the classes' log densities, each a squared Mahalanobis distance plus a log
determinant, tempered because the densities' tails overstate certainty.

The fit reads at most `SAMPLE` labelled rows, those with the smallest hash of their id: a documented bound.  It sums
sufficient statistics on the executors; only 2 x (d^2 + d + 1) numbers reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import held_out
from tidelog.llm.pieces import slices
from tidelog.llm.quality_rules import repeated_words

SAMPLE = 20_000
#: SHRINK and TEMPER have the least log loss of 42 pairs in a fourfold cross-validation inside the training fold of sf0.1.
SHRINK, FLOOR, TEMPER, CUT = 0.05, 1e-4, 0.15, 0.3
#: Added to what shares are taken of, so that short texts have no extreme ones.
SOFT = 10
STATISTICS = (
    "log_words", "word_length", "upper", "symbols", "exclaims", "digits", "marks", "distinct", "stutter", "again", "same_lines", "line_words",
)

_CLASS = np.zeros(256, np.int8)
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"#*$%&|<>=+~^_\\{}[]@", b"!?", b"0123456789", b".,;:'\"()-"), 1):
    _CLASS[list(_set)] = _i
_CLASS[0x80:] = 7


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text; defined for the empty one too."""
    raw = (text or "").encode()
    size = len(raw)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8)
    words = raw.split()
    n = max(1, len(words))
    lines = [x.strip() for x in raw.split(b"\n") if x.strip()]
    stutter = sum(map(bytes.__eq__, words, words[1:]))
    letters = kinds[1] + kinds[2] + kinds[7]
    root = math.sqrt
    return [
        math.log1p(len(words)),
        math.log1p(len(raw) / n),
        root(kinds[1] / (letters + SOFT)),
        root(kinds[3] / (size + SOFT)),
        root(kinds[4] / (size + SOFT)),
        root(kinds[5] / (size + SOFT)),
        root(kinds[6] / (size + SOFT)),
        len(set(words)) / n ** 0.9,
        root(stutter / (n + SOFT)),
        root(repeated_words(words) / (n + SOFT)),
        root((len(lines) - len(set(lines))) / (len(lines) + SOFT / 2)),
        math.log1p(n / max(1, len(lines))),
    ]


class Model(NamedTuple):
    priors: np.ndarray
    means: np.ndarray
    #: Inverses of the covariances' lower Cholesky factors, one per class.
    whiteners: np.ndarray
    log_dets: np.ndarray
    scale: np.ndarray


def inverse_of_lower(factor: np.ndarray) -> np.ndarray:
    """The inverse of a lower triangular matrix, by forward substitution."""
    out = np.zeros_like(factor)
    for i, row in enumerate(factor):
        out[i] = -row[:i] @ out[:i]
        out[i, i] += 1
        out[i] /= row[i]
    return out


def fit_moments(moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Model:
    """The model from each class's count, sum and sum of outer products; a class without rows takes the other's."""
    d = len(STATISTICS)
    known = {c: m for c, m in moments.items() if m[0] > 0}
    if not known:
        return Model(np.full(2, 0.5), np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), np.ones(d))
    total = sum(m[0] for m in known.values())
    pooled_mean = sum(m[1] for m in known.values()) / total
    pooled = sum(m[2] for m in known.values()) / total - np.outer(pooled_mean, pooled_mean)
    scale = np.sqrt(np.maximum(np.diag(pooled), FLOOR))
    means, whiteners, log_dets, priors = [], [], [], []
    for c in (0, 1):
        n, first, second = known.get(c) or next(iter(known.values()))
        mean = first / n
        cov = (second / n - np.outer(mean, mean)) / np.outer(scale, scale)
        cov = (1 - SHRINK) * cov + SHRINK * np.eye(d)
        factor = np.linalg.cholesky(cov)
        means.append(mean)
        whiteners.append(inverse_of_lower(factor))
        log_dets.append(2 * np.log(np.diag(factor)).sum())
        priors.append((moments.get(c, (0,))[0] + 1) / (total + 2))
    return Model(np.array(priors), np.array(means), np.array(whiteners), np.array(log_dets), scale)


def scores(model: Model, x: np.ndarray) -> np.ndarray:
    """The probability of class 1 for each row of x."""
    log = np.zeros((len(x), 2))
    for c in (0, 1):
        z = (x - model.means[c]) / model.scale @ model.whiteners[c].T
        log[:, c] = -0.5 * ((z**2).sum(axis=1) + model.log_dets[c])
    margin = TEMPER * (log[:, 1] - log[:, 0]) + math.log(model.priors[1] / model.priors[0])
    return 1 / (1 + np.exp(-np.clip(margin, -60, 60)))


def _moment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(STATISTICS)
    sums = {c: [0.0, np.zeros(d), np.zeros((d, d))] for c in (0, 1)}
    for batch in batches:
        for part in slices(batch):
            x, y = np.array([statistics(t) for t in part.column(0).to_pylist()]).reshape(-1, d), np.array(part.column(1).to_pylist())
            for c in (0, 1):
                own = x[y == c]
                sums[c] = [sums[c][0] + len(own), sums[c][1] + own.sum(axis=0), sums[c][2] + own.T @ own]
    yield pa.RecordBatch.from_arrays(
        [pa.array([0, 1], pa.int32()), pa.array([[s[0], *s[1], *s[2].ravel()] for s in sums.values()], pa.list_(pa.float64()))], names=["label", "sums"]
    )


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on rows of (text, 0 or 1); each task sends back one row of sums per class."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    parts = rows.mapInArrow(_moment_batches, "label int, sums array<double>")
    d = len(STATISTICS)
    added = parts.select("label", F.posexplode("sums")).groupBy("label", "pos").agg(F.sum("col").alias("s")).collect()
    moments = {}
    for c in (0, 1):
        flat = np.zeros(1 + d + d * d)
        for r in added:
            if r.label == c:
                flat[r.pos] = r.s
        moments[c] = (flat[0], flat[1 : 1 + d], flat[1 + d :].reshape(d, d))
    return fit_moments(moments)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `id_col`, score, predicted.  Null counts as empty; other columns are not read."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = np.array([statistics(t) for t in part.column(1).to_pylist()]).reshape(-1, len(STATISTICS))
                s = scores(model, x)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=[id_col, "score", "predicted"])

    kind = source.schema["id"].dataType
    return source.mapInArrow(run, T.StructType([T.StructField(id_col, kind), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def training_rows(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE, text_col: str = "text"
) -> DataFrame:
    """text and label of at most `sample` labelled documents outside the held-out fold, as `text_col` and `label_col`.

    Rows are taken by the smallest hash of their id; the chosen ids, at most `sample` of them, are broadcast.
    Ids that repeat or are null, and null labels, are left out of the choice.
    """
    marks = labels.select(F.col(id_col).alias("c_id"), F.col(label_col).alias("label"))
    known = marks.where(F.col("label").isNotNull() & ~held_out(F.col("c_id"))).groupBy("c_id")
    chosen = known.agg(F.min("label").alias("c_label"), F.count(F.lit(1)).alias("n")).where("n = 1").orderBy(F.xxhash64("c_id"), "c_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = rows.join(F.broadcast(chosen), F.col("id") == F.col("c_id"))
    return joined.select(F.col("text").alias(text_col), F.col("c_label").alias(label_col))


def judge_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """`id_col`, held_out, score, predicted of every document; learns from `labels` outside the held-out fold.

    A null id is never held out (held_out is null-safe false).  Null texts count as empty, very long ones are read
    whole, and rows that repeat get equal scores.  Other columns are not read, so their names cannot clash.  Empty tables give
    empty results; without labels every score is one half.
    """
    model = fit(training_rows(docs, labels, id_col, label_col, sample, text_col), text_col, label_col)
    scored = score_documents(docs, model, id_col, text_col)
    return scored.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "score", "predicted")
