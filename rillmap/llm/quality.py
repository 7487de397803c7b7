"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Substrings, materialize, text_blocks

FEATURES = ("bytes", "words", "word_length", "upper", "digits", "symbols", "marks", "other", "lines", "distinct_words", "repeated_words", "distinct_pairs", "repeated_lines", "common_word", "long_words")
_CLASS = np.full(256, 7, np.int64)  # 0 space, 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 symbol, 6 line end, 7 other
for _k in range(256):
    _c = chr(_k)
    if _k < 128:
        _CLASS[_k] = 6 if _c == "\n" else 0 if SPACE[_k] else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c in ".,;:'?-\"()" else 5


def _per_text(owner: np.ndarray, n: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, rows of the most frequent key) of each text."""
    order = np.lexsort((key, owner))
    o, k = owner[order], key[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    many = np.diff(np.append(at, len(o)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, o[at], many)
    return np.bincount(o[at], minlength=n), most


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """FEATURES of each text of a block: log sizes, and square roots or logs of ratios."""
    n = len(off) - 1
    size = np.diff(off)
    text_of = np.repeat(np.arange(n), size)
    kinds = np.bincount(text_of * 8 + _CLASS[data], minlength=n * 8).reshape(n, 8).astype(float)
    inside = ~SPACE[data]
    begins = inside.copy()
    ends = inside.copy()
    first = np.zeros(len(data), bool)
    first[off[:-1][size > 0]] = True
    begins[1:] &= ~inside[:-1] | first[1:]
    ends[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    owner = text_of[start]
    words = np.bincount(owner, minlength=n).astype(float)
    sub = Substrings(data)
    word = sub.hash(start, end)
    distinct, most = _per_text(owner, n, word)
    next_same = np.flatnonzero(owner[1:] == owner[:-1])
    repeated = np.bincount(owner[next_same][word[next_same] == word[next_same + 1]], minlength=n)
    with np.errstate(over="ignore"):
        pair = word[next_same] * np.uint64(0x9E3779B97F4A7C15) ^ word[next_same + 1]
    pairs, _ = _per_text(owner[next_same], n, pair)
    breaks = data == 10
    line_start = first.copy()
    line_start[1:] |= breaks[:-1]
    at = np.flatnonzero(line_start)
    stop = np.append(at[1:], len(data)) if len(at) else at
    lines = np.bincount(text_of[at], minlength=n).astype(float)
    unlike, _ = _per_text(text_of[at], n, sub.hash(at, stop)) if len(at) else (np.zeros(n), None)
    letters = kinds[:, 1] + kinds[:, 2] + kinds[:, 7]
    long_ = np.bincount(owner[end - start > 24], minlength=n)
    w, b, c = words + 1, size + 1.0, letters + 1
    return np.column_stack([
        np.log(b), np.log(w), np.log((letters + 1) / w), np.sqrt(kinds[:, 2] / c), np.sqrt(kinds[:, 3] / b), np.sqrt(kinds[:, 5] / w), np.sqrt(kinds[:, 4] / w), np.sqrt(kinds[:, 7] / b),
        np.sqrt(kinds[:, 6] / w), np.log((distinct + 1) / w), np.sqrt(repeated / w), np.log((pairs + 1) / np.maximum(words, 1)), np.sqrt(1 - (unlike + 1) / (lines + 1)), np.sqrt(most / w), np.sqrt(long_ / w),
    ])


class Discriminant:
    """Two Gaussian classes with shrunken covariances; scores from Mahalanobis distances by cached Cholesky factors."""

    def __init__(self, count, total, square, shrink: float = 0.1, floor: float = 1e-3):
        count = np.maximum(np.asarray(count, float), 0)
        self.known = count > 0
        pooled = sum(square[k] - np.outer(total[k], total[k]) / max(count[k], 1) for k in (0, 1)) / max(count.sum(), 1)
        self.scale = np.sqrt(np.maximum(np.diag(pooled), floor**2))
        pooled = pooled / np.outer(self.scale, self.scale)
        self.mean, self.lower, self.log_det = [], [], []
        for k in (0, 1):
            n = max(count[k], 1)
            mean = total[k] / n
            own = (square[k] / n - np.outer(mean, mean)) / np.outer(self.scale, self.scale)
            a = (n * (1 - shrink)) / (n + 2 * len(mean))  # small classes lean on the pooled covariance
            cov = a * own + (1 - a) * (0.5 * pooled + 0.5 * np.diag(np.maximum(np.diag(pooled), floor))) + floor * np.eye(len(mean))
            lower = np.linalg.cholesky(cov)
            self.mean.append(mean)
            self.lower.append(np.linalg.inv(lower))
            self.log_det.append(2 * np.log(np.diag(lower)).sum())
        self.prior = np.log((count[1] + 1) / (count[0] + 1))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        side = []
        for k in (0, 1):
            z = ((x - self.mean[k]) / self.scale) @ self.lower[k].T
            side.append(-0.5 * ((z * z).sum(1) + self.log_det[k]))
        return side[1] - side[0] + self.prior

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.known.all():  # one class alone says nothing of the features
            return np.full(len(x), 0.5 if not self.known.any() else float(self.known[1]))
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x) / TEMPER, -30, 30)))


#: Log-odds are divided by this: the statistics depend on each other more than Gaussians admit.
TEMPER = 2.0


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of each whole text, one row for each input row; narrow."""

    def compute(batches):
        for batch in batches:
            x = np.zeros((batch.num_rows, len(FEATURES)))
            for lo, hi, data, off in text_blocks(batch.column(1), 1 << 20):
                x[lo:hi] = statistics(data, off)
            flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32), pa.array(x.ravel()))
            yield pa.record_batch([batch.column(0), flat], ["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(compute, "doc_id long, x array<double>")


def fit(rows: DataFrame, labels: DataFrame) -> Discriminant:
    """Class counts, sums and cross products of all labelled rows, summed in the tasks first."""
    d = len(FEATURES)
    one = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))

    def moments(batches):
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            y = batch.column(0).to_numpy()
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.record_batch([np.repeat(np.arange(2), total.shape[1]), np.tile(np.arange(total.shape[1]), 2), total.ravel()], ["label", "at", "v"])

    sums = rows.join(one, "doc_id").select("label", "x").mapInArrow(moments, "label long, at long, v double").groupBy("label", "at").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros((2, 1 + d + d * d))
    total[sums.label, sums["at"]] = sums.v
    return Discriminant(total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score), one for each input row; score is the probability of label 1.

    `labels` (doc_id, label) may name documents several times: the majority counts, ties as 1; null labels and ids
    are ignored. Null and empty texts have the statistics of an empty text and a score like any other. If labels
    know one class only, every score is 0 or 1 accordingly; without labels 0.5. Extra columns are ignored; repeated
    rows score alike; an empty table gives no rows. Texts are read once: training and scoring share the statistics.
    """
    rows = materialize(features(docs, id_col, text_col))
    model = fit(rows, labels)

    def score(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.record_batch([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return rows.mapInArrow(score, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose quality score is `threshold` or more; fitted as in score_quality."""
    model = docs.sparkSession.sparkContext.broadcast(fit(features(docs, id_col, text_col), labels))
    place = docs.columns.index(text_col)

    def pass_on(batches):
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for lo, hi, data, off in text_blocks(batch.column(place).cast(pa.string()), 1 << 20):
                score[lo:hi] = model.value.score(statistics(data, off))
            yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(pass_on, docs.schema)
