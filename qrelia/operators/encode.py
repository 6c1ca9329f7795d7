"""Turning texts into vectors with a caller-supplied encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qrelia.functions.text import word_lists
from qrelia.operators.dense import unit_rows
from qrelia.session import small_batches

Encoder = Callable[[Sequence[str]], np.ndarray]

MOST_WORDS = 200_000  # that an encoder remembers; a task meets more different words the more texts it has


def encoder_udf(factory: Callable[[], Encoder], batch_size: int, normalize: bool = True):
    """Arrow-batched text-to-vector function; ``factory`` runs once per task."""

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = factory()
        for texts in batches:
            out: list[np.ndarray] = []
            filled = texts.fillna("").tolist()
            for i in range(0, len(filled), batch_size):
                vectors = np.asarray(encoder(filled[i : i + batch_size]), dtype=np.float64)
                out.extend(unit_rows(vectors) if normalize else vectors)
            yield pd.Series(out, index=texts.index, dtype=object)

    # Encoding is the dear part of a plan: marked like this, Spark neither calls
    # it a second time inside a filter nor moves it below a repartition.
    return encode.asNondeterministic()


def encode_texts(
    df: DataFrame,
    text: Column | str,
    factory: Callable[[], Encoder],
    batch_size: int = 128,
    normalize: bool = True,
) -> DataFrame:
    """Add ``vector``, the encoding of ``text``; Arrow batches of the session are kept small for it."""
    small_batches(df.sparkSession)
    column = F.col(text) if isinstance(text, str) else text
    return df.withColumn("vector", encoder_udf(factory, batch_size, normalize)(column))


def hashing_encoder(dim: int) -> Callable[[], Encoder]:
    """Deterministic encoder for tests: signed counts of lower-cased words by digest."""

    def make() -> Encoder:
        known: dict[str, int] = {}

        def codes(words: list[str]) -> np.ndarray:
            """Twice the slot of a word, and 1 more if it counts as negative."""
            out = np.array([known.get(w, -1) for w in words])
            new = np.flatnonzero(out < 0)
            if len(new):
                unknown = [words[i] for i in new.tolist()]
                digests = np.frombuffer(b"".join([hashlib.md5(w.encode()).digest() for w in unknown]), np.uint8).reshape(-1, 16)
                out[new] = 2 * (digests[:, :4].astype(np.int64) @ [1 << 24, 1 << 16, 1 << 8, 1] % dim) + (digests[:, 4] >> 4) % 2
                if len(known) + len(unknown) > MOST_WORDS:
                    known.clear()
                known.update(zip(unknown[:MOST_WORDS], out[new].tolist()))
            return out

        def encode(texts: Sequence[str]) -> np.ndarray:
            words = word_lists(pa.array([t.lower() for t in texts], pa.string()))
            coded = words.flatten().dictionary_encode()
            if not len(coded):
                return np.zeros((len(texts), dim))
            # Each different word of the texts is looked up once.
            code = codes(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
            cell = pc.list_parent_indices(words).to_numpy().astype(np.int64) * dim + code // 2
            return np.bincount(cell, 1.0 - 2.0 * (code % 2), len(texts) * dim).reshape(len(texts), dim)

        return encode

    return make
