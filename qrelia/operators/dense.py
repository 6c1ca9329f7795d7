"""Ranking by dot product of truncated, normalised vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qrelia.operators.blocks import MATRIX_CELLS, block_topk, piece_rows, single


def to_matrix(lists: pa.Array) -> np.ndarray:
    """A list column whose lists all have the same length, as a float64 matrix."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lists) == 0:
        return np.zeros((0, 0))
    width, rest = divmod(len(values), len(lists))
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    if rest or (lengths != width).any():
        raise ValueError("vectors differ in length")
    return values.reshape(len(lists), width)


def unit_rows(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm > 0, norm, 1.0)


class DenseScorer:
    """Scores document vectors at several truncation dimensions."""

    def __init__(self, queries: pa.Table, dims: Sequence[int]):
        self.query_ids = queries.column("query_id").combine_chunks()
        full = to_matrix(queries.column("vector"))
        self.queries = {d: unit_rows(full[:, :d]) for d in dims}

    def matrices(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        full = to_matrix(batch.column("vector"))
        step = max(1, MATRIX_CELLS // max(len(self.query_ids), 1))
        for dim, block in self.queries.items():
            docs = unit_rows(full[:, :dim])
            for start in range(0, len(docs), step):
                yield dim, start, block @ docs[start : start + step].T


    def pieces(self, batch: pa.RecordBatch) -> Iterator[DensePiece]:
        full = to_matrix(batch.column("vector"))
        for dim, block in self.queries.items():
            docs = unit_rows(full[:, :dim])
            rough = docs.astype(np.float32)
            asked = block, block.astype(np.float32)
            # Both factors, each product and each sum are rounded; the absolute products of unit vectors sum to at most 1.
            # All scores of a zero vector are 0, so that none is above another.
            error = np.where(block.any(axis=1), (dim + 8) * 2.0**-23, -np.inf)
            for start, stop in piece_rows(len(block), len(docs)):
                yield DensePiece(dim, start, asked, (docs[start:stop], rough[start:stop]), error)


class DensePiece:
    """Products of unit vectors, which are pairs of one matrix in double and one in single precision."""

    def __init__(self, dim: int, first_row: int, asked: tuple[np.ndarray, np.ndarray], docs: tuple[np.ndarray, np.ndarray], error: np.ndarray):
        self.dim, self.first_row, self.asked, self.docs, self.error = dim, first_row, asked, docs, error

    def exact(self) -> np.ndarray:
        return self.asked[0] @ self.docs[0].T

    def rough(self) -> np.ndarray:
        return self.asked[1] @ self.docs[1].T

    def lowest(self, floor: np.ndarray) -> np.ndarray:
        return single(floor - self.error)

    def at(self, cells: np.ndarray, marked: np.ndarray) -> np.ndarray:
        q, d = np.divmod(cells, len(self.docs[0]))
        return np.einsum("ij,ij->i", self.asked[0][q], self.docs[0][d])


def vector_length(df: DataFrame) -> int:
    row = df.select(F.size("vector")).first()
    return row[0] if row else 0


def dense_rank(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    dims: Sequence[int] | None = None,
    computed: bool = False,
) -> DataFrame:
    """The best ``k`` documents per (truncate_dim, query).

    ``corpus(doc_id, vector)``, ``queries(query_id, vector)``. All dimensions are
    scored in the same pass over the corpus; none given means the full vector.
    ``computed`` says that the vectors come out of an encoder and not of a table.
    """
    dims = [int(d) for d in dims or ()] or [vector_length(queries)]
    docs = corpus.select("doc_id", "vector").where("vector IS NOT NULL")
    asked = queries.select("query_id", "vector").where("vector IS NOT NULL")
    return block_topk(docs, asked, lambda table: DenseScorer(table, dims), k, computed)
