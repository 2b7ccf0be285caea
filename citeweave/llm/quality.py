"""Quality classifier: regularised quadratic discriminant over statistics of the text.

Each document becomes a short vector of transformed statistics (logs of sizes, log-odds of shares). Both classes get a
mean and a covariance from sums of products that Spark adds up over all labelled rows of the training part; nothing is
sampled. Covariances are shrunk twice: towards the pooled one, and that towards its scaled diagonal. The score is the
logistic of the difference of Mahalanobis log densities, tempered by a fixed factor because the statistics are not
independent, plus the prior log-odds. The Cholesky factors are computed once and go to the tasks, where a score
is two triangular products.

Defined results: a null or empty text has the statistics of an empty text and gets a score like any other; labels that
are null or not 0 or 1 are ignored, repeated label rows count each; a document row with a null ``doc_id`` is scored and
never trained on; without both classes among the labels the score is the smoothed share of label 1 for every row.
Only the text enters a score; other columns are carried through by ``keep_good`` and ignored by ``score``."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .arrays import SPACE, Rolling, flat, per_document, slices, words

THRESHOLD = 0.7
#: Shares of the pooled covariance in a class's, and of the diagonal in the pooled one.
POOLING = 0.3
DIAGONAL = 0.1
#: Factor of the difference of log densities.
TEMPER = 0.25
#: Bytes of text worked on at once; the counts take 32 times as much.
SLICE = 256 << 10

_CLASS = np.zeros((8, 256), np.uint8)
_CLASS[0, ord("A") : ord("Z") + 1] = 1
_CLASS[1, ord("a") : ord("z") + 1] = 1
_CLASS[2, ord("0") : ord("9") + 1] = 1
_CLASS[3, [ord(c) for c in ".,;:'\"?-"]] = 1
_CLASS[4, [ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~()"]] = 1
_CLASS[5, SPACE] = 1
_CLASS[6, ord("\n")] = 1
_CLASS[7, 0xC0:] = 1

NAMES = (
    "log_bytes", "log_words", "word_length", "word_spread", "upper", "digit", "mark", "symbol", "space", "lines", "wide", "distinct_words", "top_word",
    "repeated_pairs", "repeated_lines", "capital_words", "symbol_words", "lone_symbols", "sentence_ends", "line_length",
)


def _odds(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Log-odds of a share, smoothed so that short texts stay near the middle of the scale."""
    return np.log((part + 0.5) / (whole - part + 0.5).clip(0.5))


def statistics(column: pa.Array) -> np.ndarray:
    """One row of statistics for each text."""
    data, offsets = flat(column)
    n = len(offsets) - 1
    sums = np.zeros((8, len(data) + 1), np.int32)
    for k in range(8):
        np.cumsum(_CLASS[k][data], dtype=np.int32, out=sums[k, 1:])
    count = sums[:, offsets[1:]] - sums[:, offsets[:-1]]
    size = np.diff(offsets)
    starts, ends, doc = words(data, offsets)
    place = per_document(doc, n)
    n_words = np.diff(place)
    length = ends - starts
    rolling = Rolling(7).load(data)
    prints = rolling.ranges(starts, ends)

    def repeats(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values, and the largest count of one, by document."""
        keys = np.sort((owner.astype(np.uint64) << np.uint64(44)) | (values >> np.uint64(20)))
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(keys)))
        o = (keys[first] >> np.uint64(44)).astype(np.int64)
        top = np.zeros(n, np.int64)
        if len(o):
            begin = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
            top[o[begin]] = np.maximum.reduceat(counts, begin)
        return np.bincount(o, minlength=n), top

    distinct, top = repeats(prints, doc)
    paired = np.flatnonzero(doc[1:] == doc[:-1])
    pairs, _ = repeats(prints[paired] * np.uint64(3) + prints[paired + 1], doc[paired])
    n_pairs = np.maximum(n_words - 1, 0)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    feed = np.zeros(256, bool)
    feed[ord("\n")] = True
    line_starts, line_ends, line_doc = words(data, offsets, feed)
    n_lines = np.bincount(line_doc, minlength=n)
    lines, _ = repeats(rolling.ranges(line_starts, line_ends), line_doc)

    def by_word(flags: np.ndarray) -> np.ndarray:
        return np.bincount(doc[flags], minlength=n)

    inside = sums[:, ends] - sums[:, starts]
    total = np.bincount(doc, length, n)
    mean = total / np.maximum(n_words, 1)
    spread = np.sqrt(np.maximum(np.bincount(doc, length.astype(float) ** 2, n) / np.maximum(n_words, 1) - mean**2, 0))
    closed = np.isin(data[np.maximum(ends - 1, 0)] if len(data) else np.zeros(0, np.uint8), [ord("."), ord("?")])
    return np.column_stack(
        [
            np.log1p(size), np.log1p(n_words), np.log1p(mean), np.log1p(spread), _odds(count[0], count[0] + count[1]), _odds(count[2], size), _odds(count[3], size), _odds(count[4], size),
            _odds(count[5], size), _odds(count[6], size), _odds(count[7], size), _odds(distinct, n_words), _odds(top, n_words), _odds(n_pairs - pairs, n_pairs), _odds(n_lines - lines, n_lines),
            _odds(by_word((inside[0] > 1) & (inside[1] == 0)), n_words), _odds(by_word((inside[4] > 0) & (inside[4] < length)), n_words), _odds(by_word(inside[4] == length), n_words),
            _odds(by_word(closed), n_words), np.log1p(size / np.maximum(n_lines, 1)),
        ]
    )


@dataclass
class Model:
    """Means, Cholesky factors (inverted, so that a score is a product), log determinants and the prior."""

    means: list[np.ndarray] | None
    whiten: list[np.ndarray]
    logdet: list[float]
    prior: float
    temper: float = TEMPER

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        density = [-0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) - 0.5 * d for m, w, d in zip(self.means, self.whiten, self.logdet)]
        return self.temper * (density[1] - density[0]) + self.prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -40, 40)))


def vectors(documents: DataFrame) -> DataFrame:
    """doc_id and its statistics, as columns x0, x1, ..."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(f"x{i}", T.DoubleType()) for i in range(len(NAMES)))])

    def run(batches):
        for batch in slices(batches, limit=SLICE):
            x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(x[:, i]) for i in range(x.shape[1]))], schema.names)

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(statistics_of: DataFrame, labels: DataFrame, pooling: float = POOLING, diagonal: float = DIAGONAL) -> Model:
    """Class moments over every labelled row outside the held-out part; one aggregation, two rows to the driver."""
    d = len(NAMES)
    marks = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("labelled"), "quality").where(~held_out("labelled"))
    rows = marks.join(statistics_of, marks["labelled"] == statistics_of["doc_id"])
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(d)]
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    found = {r["quality"]: r for r in rows.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect()}
    n = [found[c]["n"] if c in found else 0 for c in (0, 1)]
    prior = float(np.log((n[1] + 1) / (n[0] + 1)))
    if min(n) < 2:
        return Model(None, [], [], prior)
    means, scatter = [], []
    for c in (0, 1):
        mean = np.array([found[c][f"s{i}"] for i in range(d)]) / n[c]
        square = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                square[i, j] = square[j, i] = found[c][f"p{i}_{j}"]
        means.append(mean)
        scatter.append(square / n[c] - np.outer(mean, mean))
    pooled = (n[0] * scatter[0] + n[1] * scatter[1]) / sum(n)
    pooled = (1 - diagonal) * pooled + diagonal * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
    whiten, logdet = [], []
    for c in (0, 1):
        weight = (pooling * n[c] + 2 * d) / (n[c] + 2 * d)
        factor = np.linalg.cholesky((1 - weight) * scatter[c] + weight * pooled)
        whiten.append(np.linalg.inv(factor))
        logdet.append(float(2 * np.log(np.diag(factor)).sum()))
    return Model(means, whiten, logdet, prior, TEMPER)


def _scored(documents: DataFrame, model: Model, name: str) -> DataFrame:
    """All columns of the documents and the score, in one pass over the texts."""
    names = documents.columns

    def run(batches):
        for batch in slices(batches, limit=SLICE):
            score = pa.array(np.round(model.score(statistics(batch.column("text"))), 9))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*names, name])

    return documents.mapInArrow(run, T.StructType([*documents.schema, T.StructField(name, T.DoubleType())]))


def train(documents: DataFrame, labels: DataFrame) -> Model:
    return fit(vectors(documents), labels)


def score(statistics_of: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of statistics."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])
    d = len(NAMES)

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(f"x{i}").to_numpy() for i in range(d)]) if batch.num_rows else np.zeros((0, d))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(model.score(x), 9))], schema.names)

    scored = statistics_of.mapInArrow(run, schema)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows at or above the threshold, with their columns as they were."""
    name = "_quality_score"
    while name in documents.columns:
        name += "_"
    return _scored(documents, model, name).where(F.col(name) >= threshold).select(*documents.columns)
