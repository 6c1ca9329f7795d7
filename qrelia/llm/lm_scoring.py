"""Language-model scores of texts by a log-bilinear model trained with noise-contrastive estimation.

Tokens are lower-cased (A-Z) words and an end token per text. The model works on *symbols*: the end, ``BUCKETS``
groups of rarer words by their last bytes, and the most frequent words, about ``2 * cbrt(N)`` of them for N training tokens,
so that the model grows with the corpus and S symbols have at most about 8 N triples. From the two symbols
before, it predicts a vector ``c1 * r[s1] + c2 * r[s2]``; a symbol's score is that vector times its own vector plus a bias. Training
tells observed symbols from noise drawn by frequency, by matrix products of a batch with shared noise. Scoring
divides by the exact sum over all symbols: the sums of all contexts are one matrix product of ``exp(c1 * r . q)`` and ``exp(c2 * r . q + b)``.
Their table has S**2 numbers; beyond ``SUMS_HELD`` the sums are worked out for the contexts of a slice instead, by the same products. A word
inside a group is weighed by its count + 0.5, unknown words together by 0.5, so the probabilities of all tokens sum to 1.

Counts of words and of symbol triples cover the whole training part and are added up by Spark. Parts of the triples table
are trained on in parallel, and the parameters are averaged after every round. In a round a part draws one of ``TOKENS_PER_DRAW``
of its tokens (at least ``STEPS`` batches), so training follows the corpus; it holds at most ``CELLS_HELD`` triples and a batch at a time. The counts
of the ``FREQUENT`` most frequent words are broadcast, a fixed size; tokens beyond these, none of them frequent, are joined with their
counts.

Null texts are empty (one end token). Null ids belong to the training part. An empty table gives an empty result; repeated
rows get equal scores; extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qrelia.llm.textarrays import Prefix, U, mix, signed, slices, words
from qrelia.session import durable

BUCKETS, WIDTH = 64, 16  # symbol 0 is the end, then come the groups, then the words of their own
FREQUENT = 1_000_000
ROUNDS, STEPS, BATCH, NOISE = 5, 150, 4096, 256
TOKENS_PER_DRAW = 16
CELLS_HELD = 2_000_000
ROWS_IN_CACHE = 256  # of a batch, worked on operation by operation
SUMS_HELD = 64_000_000  # numbers in a table of sums
_END = np.int64(-1)  # the end token's hash
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_HELD = 4_000_000  # tokens counted at a time


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def tokens(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and buckets of all tokens, and the first token of every row (one more entry than rows)."""
    low = _LOWER[body]
    starts, ends, rows = words(low, offsets)
    hashes = signed(Prefix(low).hashes(starts, ends))
    last = low[ends - 1].astype(U) + np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0).astype(U) * U(256) if len(ends) else np.empty(0, U)
    bucket = (mix(last) % U(BUCKETS)).astype(np.int64)
    at = np.arange(len(hashes)) + np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    out, kind = np.full(len(hashes) + len(rows) - 1, _END), np.full(len(hashes) + len(rows) - 1, -1, np.int64)
    out[at], kind[at] = hashes, bucket
    return out, kind, rows + np.arange(len(rows))


class Places:
    """Where hashes stand in a sorted array of hashes, looked up by their first bits.

    Hashes are spread evenly, so few share their first bits, however many there are; halving would miss the cache at every step.
    """

    def __init__(self, keys: np.ndarray):
        bits = max(1, len(keys).bit_length())
        self.keys, self.shift, self.half = keys, np.int64(64 - bits), np.int64(1 << (bits - 1))
        self.first = np.searchsorted(keys >> self.shift, np.arange(-self.half, self.half)).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found); a place means nothing where its hash was not found."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        last = len(self.keys) - 1
        at = np.minimum(self.first[(h >> self.shift) + self.half], last)
        key = self.keys[at]
        ahead = np.flatnonzero((key < h) & (at < last))
        while len(ahead):
            at[ahead] += 1
            key[ahead] = self.keys[at[ahead]]
            ahead = ahead[(key[ahead] < h[ahead]) & (at[ahead] < last)]
        return at, key == h


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        h, b, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h)
        h, b, n = h[order], b[order], n[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        return pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(b[first]), pa.array(np.add.reduceat(n, first))], names=["h", "b", "n"])

    for batch in batches:
        for _, body, at in slices(batch.column(0)):
            h, b, _ = tokens(body, at)
            # Only the different words of a slice are held.
            hashes, n = np.unique(h, return_counts=True)
            bucket = np.empty(len(hashes), np.int32)
            bucket[Places(hashes).find(h)[0]] = b
            held.append((hashes, bucket, n))
            size += len(h)
            if size >= _HELD:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def own_words(total: int) -> int:
    """How many words get a symbol of their own."""
    return max(1, round(2 * total ** (1 / 3)))


@dataclass
class Vocabulary:
    top: np.ndarray  # hashes of words with a symbol of their own, sorted
    symbol: np.ndarray
    frequent: np.ndarray  # hashes, sorted
    counts: np.ndarray
    total: int
    distinct: int
    bucket_mass: np.ndarray  # of every bucket: sum of count + 0.5 over its words, and 0.5 for unknown ones

    @property
    def size(self) -> int:
        return 1 + BUCKETS + len(self.top)

    @cached_property
    def top_places(self) -> Places:
        return Places(self.top)

    @cached_property
    def frequent_places(self) -> Places:
        return Places(self.frequent)

    def symbols(self, h: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        out = 1 + bucket  # the end's bucket is -1
        if len(self.top):
            at, own = self.top_places.find(h)
            out = np.where(own, self.symbol[at], out)
        return out


def contexts(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two places before; the end stands before a text."""
    one, two = np.zeros_like(symbols), np.zeros_like(symbols)
    one[1:], two[2:] = symbols[:-1], symbols[:-2]
    starts = first[:-1]
    one[starts], two[starts] = 0, 0
    second = starts[np.diff(first) > 1] + 1
    two[second] = 0
    return one, two


def vocabulary(counts: DataFrame, frequent: int = FREQUENT) -> Vocabulary:
    size = counts.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    words_only = counts.where("b >= 0")
    first = words_only.orderBy(F.desc("n"), "h").select("h", "n").limit(own_words(size["n"])).collect()
    top = np.array([r["h"] for r in first], np.int64)
    order = np.argsort(top)
    # The same words as a condition on count and hash, however many they are.
    own = F.lit(False)
    if first:
        last = first[-1]
        own = (F.col("n") > last["n"]) | ((F.col("n") == last["n"]) & (F.col("h") <= last["h"]))
    # The rank by count that is broadcast is found from how many words have each count, not by sorting words.
    by_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n"))
    least, seen = 1, 0
    for row in by_count.toLocalIterator():
        if seen + row["words"] > frequent:
            break
        seen, least = seen + row["words"], row["n"]
    # Symbols of their own are always in the table, so that only grouped words are looked up elsewhere.
    always = own | (F.col("b") < 0)
    table = counts.where(((F.col("n") >= least) & F.lit(seen > 0)) | always).select("h", "n").toArrow()
    h, n = np.asarray(table["h"]), np.asarray(table["n"])
    by_hash = np.argsort(h)
    mass = np.full(BUCKETS, 0.5)
    for row in words_only.where(~own).groupBy("b").agg(F.sum(F.col("n") + F.lit(0.5)).alias("m")).collect():
        mass[row["b"]] += row["m"]
    return Vocabulary(top[order], order + 1 + BUCKETS, h[by_hash], n[by_hash], size["n"], size["v"], mass)


class Model:
    """Parameters r, q (vectors), c (two diagonal matrices), b (biases)."""

    def __init__(self, flat: np.ndarray, width: int = WIDTH):
        self.symbols = (len(flat) - 2 * width) // (2 * width + 1)
        s = self.symbols * width
        self.flat = flat
        self.r, self.q = flat[:s].reshape(-1, width), flat[s : 2 * s].reshape(-1, width)
        self.c, self.b = flat[2 * s : 2 * s + 2 * width].reshape(2, width), flat[2 * s + 2 * width :]

    @classmethod
    def start(cls, unigram: np.ndarray, width: int = WIDTH, seed: int = 3) -> Model:
        rng = np.random.default_rng(seed)
        vectors = rng.normal(0, 0.1, 2 * len(unigram) * width)
        return cls(np.concatenate([vectors, np.ones(2 * width), np.log(unigram)]).astype(np.float32), width)

    def predicted(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.r[one] * self.c[0] + self.r[two] * self.c[1]

    def _half(self, k: int, at, bias: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
        """exp of one context symbol's part of all scores, less its largest; and that largest part."""
        z = (self.r[at] * self.c[k]) @ self.q.T + bias
        top = z.max(1, keepdims=True)
        return np.exp(z - top), top

    def log_sums(self) -> np.ndarray:
        """Logarithm of the sum over symbols for every context (one, two)."""
        (e1, t1), (e2, t2) = self._half(0, slice(None), 0.0), self._half(1, slice(None), self.b)
        with np.errstate(divide="ignore"):
            out = np.log(e1 @ e2.T) + t1 + t2.T
        self._mend(out, *np.nonzero(~np.isfinite(out)))
        return out

    def _mend(self, out: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        """Contexts whose two parts favour so different symbols that their product vanishes."""
        for i in range(0, len(one), BATCH):
            o, t = one[i : i + BATCH], two[i : i + BATCH]
            out[o, t] = self.log_sums_of(o, t)

    def log_sums_of(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The same for the given contexts, without a table; equal contexts are worked out once."""
        code, which = np.unique(one * self.symbols + two, return_inverse=True)
        out, rows = np.empty(len(code), np.float32), max(1, _HELD // self.symbols)
        for i in range(0, len(code), rows):
            part = code[i : i + rows]
            z = self.predicted(part // self.symbols, part % self.symbols) @ self.q.T + self.b
            top = z.max(1, keepdims=True)
            out[i : i + rows] = (top + np.log(np.exp(z - top).sum(1, keepdims=True)))[:, 0]
        return out[which]


def _chances(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), worked out in place: new arrays would cost more than the arithmetic."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


def nce_slope(model: Model, one, two, target, noise, log_noise: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """Slope of the noise-contrastive loss for a batch; ``noise`` symbols are shared by the batch.

    ``room``, an array of batch x noise, is written over, so that all steps can use the same one.
    """
    log_k, n = float(np.log(len(noise))), len(target)
    guess, pull, of_noise = model.predicted(one, two), model.q[target], model.q[noise]
    up = (_chances((guess * pull).sum(1) + model.b[target] - log_k - log_noise[target]) - 1) / n
    down = np.matmul(guess, of_noise.T, out=room)
    bias, log_of_noise = model.b[noise], log_noise[noise]
    for i in range(0, n, ROWS_IN_CACHE):
        part = down[i : i + ROWS_IN_CACHE]
        part += bias
        part -= log_k
        part -= log_of_noise
        _chances(part)
        part /= n
    slope = Model(np.zeros_like(model.flat), model.r.shape[1])
    pull *= up[:, None]
    pull += down @ of_noise

    def add(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        to[at[order[first]]] += np.add.reduceat(rows[order], first, axis=0)

    add(slope.q, target, up[:, None] * guess)
    add(slope.q, noise, down.T @ guess)
    add(slope.r, one, pull * model.c[0])
    add(slope.r, two, pull * model.c[1])
    slope.c[0], slope.c[1] = (pull * model.r[one]).sum(0), (pull * model.r[two]).sum(0)
    slope.b[:] = np.bincount(target, up, model.symbols) + np.bincount(noise, down.sum(0), model.symbols)
    return slope.flat


def _places(total: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``np.searchsorted(total, x, "right")``; keys in order find the same parts of ``total`` in the cache."""
    order = np.argsort(x)
    out = np.empty(len(x), np.int64)
    out[order] = np.searchsorted(total, x[order], "right")
    return out


def _train_part(flat: np.ndarray, unigram: np.ndarray, round_no: int, steps: int, per_draw: int):
    symbols = len(unigram)

    def cells_held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= CELLS_HELD:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, size = [], 0
        if size:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, log_noise = Model(flat.copy()), np.log(unigram).astype(np.float32)
        m, v = np.zeros_like(flat), np.zeros_like(flat)
        weight, t, noise_sums = 0.0, 0, np.cumsum(unigram)
        room = np.empty((BATCH, NOISE), flat.dtype)
        mean = np.zeros(len(flat))  # of the parameters, weighted by step number: late steps count most
        for code, n in cells_held(batches):
            order = np.argsort(code)
            code, n = code[order], n[order]
            rng = np.random.default_rng([round_no, int(code[0])])
            total = np.cumsum(n.astype(float))
            weight += float(total[-1])
            for _ in range(max(steps, int(total[-1] / per_draw / BATCH))):
                t += 1
                drawn = code[np.minimum(_places(total, rng.random(BATCH) * total[-1]), len(code) - 1)]
                noise = np.minimum(np.searchsorted(noise_sums, rng.random(NOISE), "right"), symbols - 1)
                slope = nce_slope(model, drawn // symbols % symbols, drawn // symbols**2, drawn % symbols, noise, log_noise, room)
                m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
                model.flat -= (0.03 / (1 + round_no)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
                mean += (model.flat - mean) * (2 / (t + 1))
        if weight:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat))), pa.array(mean * weight), pa.array(np.full(len(flat), weight))], names=["i", "x", "w"]
            )

    return run


def train(cells: DataFrame, symbols: int, rounds: int = ROUNDS, steps: int = STEPS, per_draw: int = TOKENS_PER_DRAW) -> Model:
    """``cells``: (code, n), code = (two * symbols + one) * symbols + symbol."""
    seen = {r["s"]: r["n"] for r in cells.groupBy((F.col("code") % symbols).alias("s")).agg(F.sum("n").alias("n")).collect()}
    unigram = np.array([seen.get(i, 0) + 0.5 for i in range(symbols)])
    unigram /= unigram.sum()
    model = Model.start(unigram)
    for k in range(rounds):
        part = cells.select("code", "n").mapInArrow(_train_part(model.flat, unigram, k, steps, per_draw), "i long, x double, w double")
        mean = part.groupBy("i").agg((F.sum("x") / F.sum("w")).alias("x")).toArrow()
        if mean.num_rows:
            flat = np.empty(len(model.flat), np.float32)
            flat[np.asarray(mean["i"])] = np.asarray(mean["x"])
            model = Model(flat)
    return model


def _cells(vocab):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            code = np.concatenate(held)
            held.clear()
            code.sort()
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            return pa.RecordBatch.from_arrays([pa.array(code[first]), pa.array(np.diff(first, append=len(code)))], names=["code", "n"])

        for batch in batches:
            for _, body, at in slices(batch.column(0)):
                h, bucket, first = tokens(body, at)
                s = vocab.value.symbols(h, bucket)
                one, two = contexts(s, first)
                held.append((two * vocab.value.size + one) * vocab.value.size + s)
                size += len(s)
                if size >= _HELD:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _local_scores(vocab, shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        flat, sums = shipped.value
        model = Model(flat)
        spread = np.log10(v.total + 0.5 * (v.distinct + 1))
        left, right = model.r * model.c[0], model.r * model.c[1]
        base_of, in_bucket = np.log10(v.counts + 0.5), np.log10(v.bucket_mass)
        for batch in batches:
            for first_row, body, at in slices(batch.column(3)):
                h, bucket, first = tokens(body, at)
                s = v.symbols(h, bucket)
                one, two = contexts(s, first)
                log_sum = model.log_sums_of(one, two) if sums is None else sums[one, two]
                match = left[one]
                match += right[two]
                match *= model.q[s]
                model_log = (match.sum(1) + model.b[s] - log_sum) / np.log(10)
                place, known = v.frequent_places.find(h)
                own = np.where(known, base_of[place], 0.0) if len(v.frequent) else np.zeros(len(h))
                grouped = (s >= 1) & (s <= BUCKETS)
                group = np.where(grouped, s - 1, 0)
                score = model_log + np.where(grouped, own - in_bucket[group], 0.0)
                n = np.diff(first)
                rest = ~known
                add = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  every row has its end token
                rest_of = add(rest.astype(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(rest_of)], pa.int32()), pa.array(h[rest]))
                # Tokens that are not in the table and not the end always stand for a group; the end may be unseen.
                columns = [c.slice(first_row, len(n)) for c in batch.columns[:3]]
                columns += [pa.array(n), pa.array(n - rest_of), pa.array(add(own) - n * spread), pa.array(add(score)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "_k", "n_tokens", "known", "base", "model", "rest"])

    return run


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT, rounds: int = ROUNDS, steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.xxhash64(body).alias("_k"), body.alias("_text"))
    learning = rows.where("NOT held_out").select("_text")
    counts = durable(learning.mapInArrow(_count_words, "h long, b int, n long").groupBy("h").agg(F.first("b").alias("b"), F.sum("n").alias("n")))
    vocab = vocabulary(counts, frequent)
    shipped = spark.sparkContext.broadcast(vocab)
    cells = durable(learning.mapInArrow(_cells(shipped), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))
    model = train(cells, vocab.size, rounds, steps)
    parameters = spark.sparkContext.broadcast((model.flat, model.log_sums() if model.symbols**2 <= SUMS_HELD else None))
    local = durable(
        rows.mapInArrow(
            _local_scores(shipped, parameters), "doc_id long, held_out boolean, _k long, n_tokens long, known long, base double, model double, rest array<long>"
        )
    )
    # Repeated rows have the same rest; it is joined once for each (id, text).
    rest = local.where(F.size("rest") > 0).groupBy("doc_id", "_k").agg(F.first("rest").alias("rest"))
    found = rest.select("doc_id", "_k", F.explode("rest").alias("h")).join(counts.select("h", "n"), "h", "left")
    sums = found.groupBy("doc_id", "_k").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("_log"), F.count("n").alias("_known")
    )
    joined = local.alias("l").join(sums.alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l._k") == F.col("r._k")), "left")
    more = F.coalesce("_log", F.lit(0.0))
    return joined.select(
        "l.doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
