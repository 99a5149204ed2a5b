"""Quality scores by regularised quadratic discriminant analysis over document statistics.

The classes' covariances shrink towards the pooled one and a sphere, and their Cholesky factors are kept with the model. The difference of log
densities goes, as sign * log(1 + size), through a line fitted to the labels and a logistic curve, so that scores are like chances. A text's
statistics take time and memory in proportion to its length; it is a step by itself if it is longer than a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import batches_of_text, extended, mix, words_of
from textloom.llm.language_id import fold

#: Labelled documents that the fit takes at most, spread evenly by a hash of the id.
SAMPLE_ROWS = 20_000
#: Shrinkage of each class's covariance towards the pooled one, and of the result towards its mean variance.
TO_POOLED = 0.05
TO_SPHERE = 0.01

FEATURES = ("words", "word_length", "upper", "digits", "stops", "commas", "symbols", "bars", "marks", "other_bytes", "line_words", "word_variety", "line_variety", "pair_variety", "top_word")

_CLASS = np.zeros((9, 256), dtype=np.float64)
for _row, _bytes in enumerate((
    bytes(range(65, 91)), bytes(range(48, 58)), b".?", b",;:", b"*#$%&@^~=+<>{}[]\\/", b"|", b"!", bytes(range(128, 256)), b"\n",
)):
    _CLASS[_row, list(_bytes)] = 1


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Log odds of a share, an eighth of a case added to both sides."""
    return np.log((part + 0.125) / (np.maximum(whole - part, 0) + 0.125))


def _per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, and how often its most common one occurs."""
    if not len(values):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((values, doc))
    d, v = doc[order], values[order]
    new = np.append(True, (d[1:] != d[:-1]) | (v[1:] != v[:-1]))
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(d)))
    most = np.zeros(n)
    np.maximum.at(most, d[at], count)
    return np.bincount(d[at], minlength=n).astype(float), most


def statistics(batch: pa.RecordBatch, text_col: str) -> np.ndarray:
    """One row of FEATURES, transformed, for each text; null counts as empty."""
    out = []
    for _, _, data, starts, ends in batches_of_text(batch, text_col):
        n, size = len(starts), (ends - starts).astype(float)
        doc_of = np.repeat(np.arange(n), ends - starts)
        counts = np.array([np.bincount(doc_of, weights=row[data], minlength=n) for row in _CLASS])
        upper, digits, stops, commas, symbols, bars, marks, other, lines = counts
        first, last, hashes, before = words_of(data, starts, ends)
        n_words = np.diff(before).astype(float)
        doc = np.repeat(np.arange(n), np.diff(before))
        letters = np.bincount(doc, weights=last - first, minlength=n)
        variety, top = _per_doc(hashes, doc, n)
        if len(hashes) > 1:
            inside = doc[1:] == doc[:-1]
            pairs, _ = _per_doc(mix(hashes[1:] * np.uint64(3) + hashes[:-1])[inside], doc[1:][inside], n)
        else:
            pairs = np.zeros(n)
        # A line is told by its words.
        breaks = np.cumsum(data == 10)
        line = breaks[first] if len(first) else np.zeros(0, dtype=np.int64)
        new = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (doc[1:] != doc[:-1]))) if len(first) else np.zeros(0, dtype=np.int64)
        sums = np.add.reduceat(mix(hashes + (np.arange(len(hashes)) - np.repeat(new, np.diff(np.append(new, len(hashes))))).astype(np.uint64)), new) if len(new) else hashes
        line_kinds, _ = _per_doc(sums, doc[new] if len(new) else doc, n)
        n_lines = np.bincount(doc[new], minlength=n).astype(float) if len(new) else np.zeros(n)
        out.append(np.column_stack([
            np.log1p(n_words), np.log1p(letters / np.maximum(n_words, 1)), _share(upper, size), _share(digits, size), _share(stops, size), _share(commas, size),
            _share(symbols, size), _share(bars, size), _share(marks, size), _share(other, size), np.log1p(n_words / np.maximum(lines + 1, 1)),
            np.log((variety + 1) / (n_words + 1)), np.log((line_kinds + 1) / (n_lines + 1)), np.log((pairs + 1) / (np.maximum(n_words, 1))), _share(top, n_words),
        ]))
    return np.vstack(out) if out else np.zeros((0, len(FEATURES)))


@dataclass
class Discriminant:
    """Means, Cholesky factors and log determinants of two classes, and the line that turns density differences into scores."""

    scale: tuple[np.ndarray, np.ndarray]
    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]
    line: tuple[float, float]

    def difference(self, rows: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, by the Mahalanobis distances from the factors."""
        x = (rows - self.scale[0]) / self.scale[1]
        dens = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants, strict=True):
            z = (x - mean).T
            for i, row in enumerate(factor):  # forward substitution, as the factor is a lower triangle
                z[i] = (z[i] - row[:i] @ z[:i]) / row[i]
            dens.append(constant - 0.5 * (z * z).sum(axis=0))
        return dens[1] - dens[0]

    def score(self, rows: np.ndarray) -> np.ndarray:
        a, b = self.line
        return 1 / (1 + np.exp(-np.clip(a * _damped(self.difference(rows)) + b, -30, 30)))


def _damped(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.log1p(np.abs(x))


def fit(rows: np.ndarray, labels: np.ndarray) -> Discriminant | None:
    """None where either class has fewer than two rows."""
    if min((labels == 0).sum(), (labels == 1).sum()) < 2:
        return None
    centre, spread = rows.mean(axis=0), rows.std(axis=0) + 1e-6
    x = (rows - centre) / spread
    d = x.shape[1]
    own = [np.cov(x[labels == k].T, bias=True) for k in (0, 1)]
    pooled = sum(c * (labels == k).mean() for k, c in enumerate(own))
    means, factors, constants = [], [], []
    for k in (0, 1):
        cov = (1 - TO_POOLED) * own[k] + TO_POOLED * pooled
        cov = (1 - TO_SPHERE) * cov + TO_SPHERE * np.trace(cov) / d * np.eye(d)
        factor = np.linalg.cholesky(cov)
        means.append(x[labels == k].mean(axis=0))
        factors.append(factor)
        constants.append(-np.log(np.diag(factor)).sum() + np.log((labels == k).mean()))
    out = Discriminant((centre, spread), means, factors, constants, (1.0, 0.0))
    t = _damped(out.difference(rows))
    w = np.array([1.0, 0.0])
    design = np.column_stack([t, np.ones(len(t))])
    for _ in range(25):  # logistic regression on one variable, lightly held at the start
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - labels) + 1e-2 * (w - [1.0, 0.0])
        w = w - np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2), grad)
    out.line = (max(float(w[0]), 1e-3), float(w[1]))
    return out


def learn(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "quality", id_col: str = "doc_id") -> Discriminant | None:
    """Fits SAMPLE_ROWS labelled documents at most, those least by a hash of the id. Rows with a null label teach nothing."""
    chosen = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "__label").limit(SAMPLE_ROWS)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")  # 20 bytes a row
    table = measured(rows, "__text").select("__label", "__stats").toPandas()
    if table.empty:
        return None
    return fit(np.vstack(table["__stats"].to_numpy()), table["__label"].to_numpy())


def measured(docs: DataFrame, text_col: str) -> DataFrame:
    """Statistics instead of the text, beside the other columns."""
    rest = [c for c in docs.columns if c != text_col]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = statistics(batch, text_col)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], lists], [*rest, "__stats"])

    return docs.mapInArrow(measure, extended(docs.select(rest).schema, __stats="array<double>"))


def score(docs: DataFrame, model: Discriminant | None, text_col: str = "text") -> DataFrame:
    """Adds score (0 to 1) to docs, from the text alone; a column of that name is replaced.

    Null counts as the empty text, which has a score as any other. Without a model every score is 0.5.
    """
    docs = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two matrices of len(FEATURES) squared

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value.score(statistics(batch, text_col)) if sent.value is not None else np.full(len(batch), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(rate, extended(docs.schema, score="double"))


#: Score from which the query predicts label 1.
GOOD = 0.7


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = learn(docs, labels.where(F.coalesce(fold("doc_id", 4) != 2, F.lit(False))))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
