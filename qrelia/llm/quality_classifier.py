"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of quality 1; everything else is unlabelled web text. A
linear model on text statistics minimises the non-negative unbiased risk

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))

with logistic losses, so its score estimates the probability of label 1. The class prior is the share of label 1
among the labelled training rows; labels of 0 are not used for anything else.

Every document counts as unlabelled. Statistics of all texts are written once; Spark deals the rows by a hash of their place into parts of about
``PART_ROWS``, each part finds the weights of least risk beside the same positives, and the weights are averaged by rows (the risk is convex).
Only the trusted positives are a bounded sample: about ``SAMPLE_ROWS`` of their different ids by hash, and of the rows that
have such an id about as many by place, so neither is unbounded where one id holds many rows. Scoring covers every row. Statistics come from the whole text; an empty or null text has all statistics 0 and
gets the score of such a text. Null ids are never labelled and not held out. Without any labelled positive every score is the prior, or 0.5 if
there are no labels at all. Empty tables give empty results; repeated rows get equal scores; extra columns are kept unless they have the name of an output column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qrelia.llm.textarrays import Prefix, U, mix, signed, slices, words
from qrelia.session import durable

SAMPLE_ROWS = 20_000
PART_ROWS = 20_000
THRESHOLD = 0.7
STEPS, RATE, DECAY = 400, 0.1, 1e-4

_CLASSES = ["#*$%&<>", "|", "!", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:?", "\n", "@/\\_=+~^{}[]()`"]
_CLASS_OF = np.zeros(256, np.uint8)
for _k, _chars in enumerate(_CLASSES, 1):
    _CLASS_OF[[ord(c) for c in _chars]] = _k
_WIDTHS = 14  # word lengths in bytes, the last one open
_PRIOR_WORDS = 5  # keeps rates of very short texts from being extreme
N_FEATURES = len(_CLASSES) + 1 + 6 + _WIDTHS


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flags, dtype=np.int64)][at])


def features(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics for each text."""
    n = np.maximum(np.diff(offsets), 1).astype(float)
    kind = _CLASS_OF[body]
    starts, ends, rows = words(body, offsets)
    n_words = np.diff(rows)
    each = (n_words + _PRIOR_WORDS).astype(float)
    per_word = [_sums(kind == k, offsets) / each for k in range(1, len(_CLASSES) + 1)]
    width = np.minimum(ends - starts, _WIDTHS)
    owner = np.repeat(np.arange(len(n)), n_words)
    widths = np.bincount(owner * _WIDTHS + width - 1, minlength=len(n) * _WIDTHS).reshape(len(n), _WIDTHS) / each[:, None]
    capital = _sums((kind[starts] == 4), rows) / each if len(starts) else np.zeros(len(n))
    letters = per_word[3] + per_word[4]
    names = Prefix(body).hashes(starts, ends)
    again, next_but_one = np.zeros(len(names), bool), np.zeros(len(names), bool)
    again[1:] = (names[1:] == names[:-1]) & (owner[1:] == owner[:-1])
    next_but_one[2:] = (names[2:] == names[:-2]) & (owner[2:] == owner[:-2])
    columns = [*(np.log1p(c) for c in per_word), _sums(body >= 0x80, offsets) / n]
    columns += [_sums(again, rows) / each, _sums(next_but_one, rows) / each]
    columns += [np.log1p(n_words), capital, per_word[3] / np.maximum(letters, 1e-9), _sums(width == 1, rows) / each if len(starts) else np.zeros(len(n))]
    out = np.column_stack([*columns, widths])
    out[np.diff(offsets) == 0] = 0
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.column_stack([np.clip((x - mean) / scale, -5, 5), np.ones(len(x))])


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Weights (the constant last) of the model with least non-negative risk."""
    p, u = (_scaled(x, mean, scale) for x in (positives, unlabelled))
    w = np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        # Of the loss log(1 + exp(-z)) the slope is sigma(z) - 1, of log(1 + exp(z)) it is sigma(z).
        as_positive, p_as_negative, u_as_negative = p.T @ (sp - 1) / len(p), p.T @ sp / len(p), u.T @ su / len(u)
        negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        slope = prior * as_positive + (u_as_negative - prior * p_as_negative if negative >= 0 else prior * p_as_negative - u_as_negative)
        slope = slope + DECAY * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def score(x: np.ndarray, model) -> np.ndarray:
    mean, scale, w = model
    return _sigmoid(_scaled(x, mean, scale) @ w)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _some(df: DataFrame, key: str, rows: int, salt: int) -> DataFrame:
    """About ``rows`` rows of ``df``, the same ones every time; all of a smaller table."""
    total = df.count()
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1_000_000)) < F.lit(int(1_000_000 * rows / total)))


def _statistics(rows: DataFrame) -> DataFrame:
    """(x, trusted, place) of rows (text, trusted); ``place`` hashes the task and the number of the row in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, body, at in slices(batch.column(0)):
                x = features(body, at)
                offsets = pa.array(np.arange(len(x) + 1) * N_FEATURES, pa.int32())
                place = mix(np.arange(done, done + len(x)).astype(U)) >> U(1)
                done += len(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())), batch.column(1).slice(first, len(x)), pa.array(signed(place))], names=["x", "trusted", "place"]
                )

    return rows.mapInArrow(run, "x array<double>, trusted boolean, place long")


def _rows_of(x: pa.Array | pa.ChunkedArray) -> np.ndarray:
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return np.asarray(x.flatten()).reshape(-1, N_FEATURES)


def _moments(statistics: DataFrame) -> np.ndarray:
    """Sums over all rows: rows, trusted rows, every statistic, every square; empty without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + 2 * N_FEATURES)
        for batch in batches:
            x = _rows_of(batch.column(0))
            total += np.concatenate([[len(x), np.asarray(batch.column(1).cast(pa.int8())).sum()], x.sum(0), (x**2).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "s"])

    table = statistics.select("x", "trusted").mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").toArrow()
    return np.asarray(table["s"])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS, part_rows: int = PART_ROWS):
    """(model or None, prior); labels come only from rows that are not held out."""
    learning = labels.where(~held_out(F.col(doc_id)) & F.col(doc_id).isNotNull() & F.col(label).isNotNull()).select(doc_id, label)
    prior = learning.agg(F.avg(F.col(label).cast("double")).alias("p")).first()["p"]
    if prior is None:
        return None, 0.5
    trusted = _some(learning.where(F.col(label) == 1).select(doc_id).distinct(), doc_id, sample_rows, 1)
    text_of = F.coalesce(F.col(text), F.lit("")).alias("text")
    # At most about ``sample_rows`` ids are broadcast.
    marked = docs.select(F.col(doc_id).alias("_id"), text_of).join(F.broadcast(trusted.select(F.col(doc_id).alias("_id"), F.lit(True).alias("_t"))), "_id", "left")
    statistics = durable(_statistics(marked.select("text", F.coalesce("_t", F.lit(False)).alias("trusted"))))
    sums = _moments(statistics)
    if not len(sums) or not sums[1]:
        return None, prior
    positives = _rows_of(_some(statistics.where("trusted"), "place", sample_rows, 2).select("x").toArrow()["x"])
    n, total, squares = sums[0], sums[2 : 2 + N_FEATURES], sums[2 + N_FEATURES :]
    n, total, squares = n + len(positives), total + positives.sum(0), squares + (positives**2).sum(0)
    mean = total / n
    scale = np.sqrt(np.maximum(squares / n - mean**2, 0)) + 1e-6
    bounded = min(max(prior, 0.01), 0.99)
    shipped = docs.sparkSession.sparkContext.broadcast(positives)

    def best(part: pa.Table) -> pa.Table:
        x = _rows_of(part["x"])
        w = fit(shipped.value, x, bounded, mean, scale)
        return pa.table({"i": np.arange(len(w)), "w": w * len(x), "n": np.full(len(w), float(len(x)))})

    parts = max(1, round(sums[0] / part_rows))
    dealt = statistics.select("x", (F.col("place") % parts).alias("part"))
    weights = dealt.groupBy("part").applyInArrow(best, "i long, w double, n double").groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w")).orderBy("i").toArrow()
    return (mean, scale, np.asarray(weights["w"])), prior


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``."""
    model, prior = train(docs, labels, doc_id, text, label, sample_rows)
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    rows = docs.select(*kept, held_out(F.col(doc_id)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.full(batch.num_rows, prior, float)
            if model is not None:
                for first, body, at in slices(batch.column(batch.num_columns - 1)):
                    s[first : first + len(at) - 1] = score(features(body, at), model)
            columns = [*batch.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)
