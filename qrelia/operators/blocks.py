"""Exhaustive scoring of documents against queries, keeping only top-k rows.

Exact evaluation scores every document for every query. Pair scores live in small matrices inside a
task and never become rows; a task keeps the best k rows of each query and emits only these.

Few queries are broadcast in blocks of bounded size and the documents stream past them in Arrow batches, so the
documents are never shuffled. Of a table with many splits, a few are ranked first; the k-th best row of each
query found there is a floor that is broadcast with the queries, and no task emits a row that ranks behind it. The floor
comes from documents of the corpus, so it holds whichever splits were looked at.

Many queries are dealt over the tasks instead: the documents are written to the shared folder in the order of their ids,
and every task reads them past its own block of queries. A query then meets all documents in one task, which emits its k rows
with their ranks, so that nothing is shuffled afterwards. A task scores a few documents at a time, whose scores stay in a core's cache:
sums in single precision, whose error is bounded, tell which few cells may be above the k-th best row so far, and only these are
scored in double precision. In the order of ids an equal score always ranks behind the rows that are held.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qrelia.operators.joins import measured_size
from qrelia.operators.ranking import SCORE_DIGITS, rank_topk
from qrelia.session import durable, open_shared

BLOCK_QUERIES = 16_384
BLOCK_BYTES = 64 << 20
PILOT_SPLITS = 16  # ranked first to find the floors
MANY_SPLITS = 4 * PILOT_SPLITS  # fewer splits are ranked in one go
MERGE_TASKS = 1_000  # from more tasks than this, candidates are merged in two levels
MATRIX_CELLS = 4_000_000  # largest score matrix held by a task
MANY_QUERIES = 4_096  # from more queries than this, documents are read past blocks of queries
STREAM_QUERIES = 8_192  # queries of such a block
STREAM_ROWS = 8_192  # documents read at once
PIECE_CELLS = 1 << 18  # of these as many are scored at once as stay in a core's cache
FEW_ROWS = 1_000_000  # a run of no more rows is ranked by Spark and comes in that order
_DEAR = 32  # scoring a cell alone costs as much as so many cells of a piece
SLICE_BYTES = 8 << 20  # of an Arrow batch, scored at once
_SLACK = 2.0 * 10.0**-SCORE_DIGITS  # scores further apart than this differ when rounded

_LEAST = np.finfo(float).min  # the floor of a query with less than k rows

RUN_SCHEMA = "truncate_dim int, query_id string, doc_id string, score double"
_RANKED_SCHEMA = f"{RUN_SCHEMA}, rank int"
_ARROW_SCHEMA = pa.schema(
    [
        ("truncate_dim", pa.int32()),
        ("query_id", pa.string()),
        ("doc_id", pa.string()),
        ("score", pa.float64()),
    ]
)


class Scorer(Protocol):
    """Scores Arrow batches of documents against one block of queries."""

    query_ids: pa.Array

    def matrices(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        """Yield (truncate_dim, first row, queries x documents) pieces of a batch."""


class Piece(Protocol):
    """Scores of a block's queries for a few documents of a batch, as matrices of queries x documents."""

    dim: int
    first_row: int

    def exact(self) -> np.ndarray:
        """Scores; minus infinity marks a document that is no candidate."""

    def rough(self) -> np.ndarray | None:
        """The same in single precision, or None if that cannot be bounded."""

    def lowest(self, floor: np.ndarray) -> np.ndarray:
        """What every rough score is above if its exact one is above the floor when rounded."""

    def at(self, cells: np.ndarray, marked: np.ndarray) -> np.ndarray:
        """Exact scores of some cells, ascending, which are those marked; asked for after ``rough``."""


class StreamScorer(Protocol):
    """Scores documents that are read past a block of queries."""

    query_ids: pa.Array

    def pieces(self, batch: pa.RecordBatch) -> Iterator[Piece]:
        """The pieces of a batch; of a dimension, in the order of the rows."""


def piece_rows(n_queries: int, n_docs: int) -> Iterator[tuple[int, int]]:
    """First and last row of the pieces of a batch."""
    width = max(1, PIECE_CELLS // max(n_queries, 1))
    return ((start, min(n_docs, start + width)) for start in range(0, n_docs, width))


def single(x: np.ndarray) -> np.ndarray:
    """The next lower number of single precision."""
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def best_per_row(scores: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k best cells per row; equal cells are taken from the left."""
    n = scores.shape[1]
    if n <= k:
        return np.ones(scores.shape, dtype=bool)
    kth = np.partition(scores, n - k, axis=1)[:, n - k, None]
    above = scores > kth
    tied = scores == kth
    room = k - above.sum(axis=1, keepdims=True)
    return above | (tied & (np.cumsum(tied, axis=1) <= room))


class Floors:
    """The k-th best row of each query among some documents, by truncation dimension."""

    def __init__(self, found: pa.Table | None, query_ids: pa.Array):
        self.n = len(query_ids)
        self.scores: dict[int, np.ndarray] = {}
        self.doc_ids: dict[int, np.ndarray] = {}
        if found is None:
            return
        place = {q: i for i, q in enumerate(query_ids.to_pylist())}
        for dim, query, score, doc_id in zip(*(found.column(c).to_pylist() for c in ("truncate_dim", "query_id", "score", "doc_id"))):
            scores, ids = self.of(dim)
            scores[place[query]], ids[place[query]] = score, doc_id.encode()

    def of(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and document ids of a dimension; a query without a floor has the least number."""
        if dim not in self.scores:
            self.scores[dim] = np.full(self.n, np.finfo(float).min)
            self.doc_ids[dim] = np.full(self.n, b"", object)
        return self.scores[dim], self.doc_ids[dim]

    def admits(self, dim: int, q: np.ndarray, scores: np.ndarray, doc_ids: np.ndarray) -> np.ndarray:
        """Whether rows of queries ``q`` do not rank behind the floors."""
        floor, ids = self.of(dim)
        keep = scores > floor[q]
        tied = np.flatnonzero(scores == floor[q])
        keep[tied] = doc_ids[tied] <= ids[q[tied]]
        return keep

    def reached(self, dim: int, scores: np.ndarray, doc_ids: list[bytes]) -> np.ndarray:
        """Mask of cells that do not rank behind the floor; ``doc_ids`` belong to the columns."""
        q, d = np.indices(scores.shape).reshape(2, -1)
        return self.admits(dim, q, scores.reshape(-1), np.array(doc_ids, object)[d]).reshape(scores.shape)


class Best:
    """The k best rows of each query that a task has seen; raises the floors as it goes."""

    def __init__(self, floors: Floors, dim: int, k: int):
        self.floors, self.dim, self.k = floors, dim, k
        self.floor, self.floor_ids = floors.of(dim)
        self.held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.waiting = 0

    def possible(self, scores: np.ndarray, doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells that do not rank behind the floors; ``doc_ids`` belong to the columns and ascend."""
        near = scores >= (self.floor - _SLACK)[:, None]
        q, d = np.divmod(np.flatnonzero(near), max(scores.shape[1], 1))
        crowded = np.flatnonzero(np.bincount(q) > self.k)
        if len(crowded):
            near[crowded] &= best_per_row(np.round(scores[crowded], SCORE_DIGITS), self.k)
            q, d = np.divmod(np.flatnonzero(near), scores.shape[1])
        keep = self.floors.admits(self.dim, q, np.round(scores[q, d], SCORE_DIGITS), doc_ids[d])
        return q[keep], d[keep]

    def add(self, q: np.ndarray, scores: np.ndarray, doc_ids: pa.Array) -> None:
        self.held.append((q, scores, doc_ids))
        self.waiting += len(q)
        if self.waiting >= max(len(self.floor) * self.k // 2, 1_000):
            self.cut()

    def cut(self) -> None:
        """Leave the k best rows of each query."""
        q, scores = (np.concatenate([h[i] for h in self.held]) for i in range(2))
        ids = pa.concat_arrays([h[2] for h in self.held])
        coded = ids.dictionary_encode(null_encoding="encode")
        place = np.empty(len(coded.dictionary), np.int64)
        place[pc.sort_indices(coded.dictionary, null_placement="at_start")] = np.arange(len(place))
        rounded = np.round(scores, SCORE_DIGITS)
        order = np.lexsort((place[coded.indices.to_numpy(zero_copy_only=False)], -rounded, q))
        by_query = q[order]
        first = np.searchsorted(by_query, np.arange(len(self.floor)))
        nth = np.arange(len(order)) - first[by_query]
        last = order[nth == self.k - 1]
        self.floor[q[last]] = rounded[last]
        self.floor_ids[q[last]] = _sortable(ids.take(pa.array(last)))
        kept = order[nth < self.k]
        self.held = [(q[kept], scores[kept], ids.take(pa.array(kept)))]
        self.waiting = 0


def _sortable(doc_ids: pa.Array) -> np.ndarray:
    """Ids as bytes, in whose order Spark sorts strings; a null comes first."""
    out = np.empty(len(doc_ids), object)
    out[:] = doc_ids.cast(pa.binary()).fill_null(b"").to_pylist()
    return out


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to slices of about ``SLICE_BYTES``."""
    for batch in batches:
        rows = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, SLICE_BYTES))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def emit_topk(scorer: Scorer, batches: Iterator[pa.RecordBatch], k: int, floors: Floors | None = None):
    """The rows of the batches that are among the k best of their query and not behind the floors, which are raised."""
    floors = floors or Floors(None, scorer.query_ids)
    best: dict[int, Best] = {}
    for batch in batches:
        batch = batch.take(pc.sort_indices(batch.column("doc_id"), null_placement="at_start"))
        doc_ids = batch.column("doc_id")
        ascending = _sortable(doc_ids)
        for dim, start, scores in scorer.matrices(batch):
            if dim not in best:
                best[dim] = Best(floors, dim, k)
            # A scorer marks cells that are no candidates by minus infinity.
            q, d = best[dim].possible(scores, ascending[start : start + scores.shape[1]])
            if len(q):
                best[dim].add(q, scores[q, d], doc_ids.take(pa.array(d + start)))
    for dim, rows in best.items():
        if rows.held:
            rows.cut()
            q, scores, doc_ids = rows.held[0]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(q), dim, dtype=np.int32)),
                    scorer.query_ids.take(pa.array(q)),
                    doc_ids,
                    pa.array(scores + 0.0),  # -0.0 becomes 0.0
                ],
                schema=_ARROW_SCHEMA,
            )


def block_topk(
    docs: DataFrame,
    queries: DataFrame,
    make_scorer: Callable[[pa.Table], Scorer],
    k: int,
    reuse_docs: bool = False,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    read: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None,
) -> DataFrame:
    """Run of the best ``k`` documents per (truncate_dim, query).

    ``docs`` has a string ``doc_id``, ``queries`` a string ``query_id``; their other
    columns are what the scorer reads. With ``reuse_docs``, documents that were dear
    to compute are written before a second pass would compute them again. ``prepare``
    brings documents that are read many times into a form that is cheaper to read;
    ``read`` makes of others, inside a task, what the scorer reads.
    """
    queries = durable(queries)
    n, size = measured_size(queries)
    if n > MANY_QUERIES:
        return _rank_streamed(prepare(docs) if prepare else docs, queries, n, size, make_scorer, k)
    passes = max(
        1,
        math.ceil(n / BLOCK_QUERIES),
        math.ceil(size / BLOCK_BYTES),
        math.ceil(n * k / MATRIX_CELLS),  # best scores a task remembers
    )
    if passes == 1:
        return _one_pass(docs, queries, make_scorer, k, read)[0]

    if reuse_docs:
        docs = durable(docs)
    block = F.pmod(F.xxhash64("query_id"), F.lit(passes))
    runs = []
    for i in range(passes):
        run, sent = _one_pass(docs, queries.where(block == i), make_scorer, k, read)
        runs.append(durable(run))
        sent.destroy()
    return reduce(DataFrame.unionByName, runs)


def query_blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.Table]:
    """The queries of a task in blocks of bounded rows and bytes."""
    most = max(1, min(STREAM_QUERIES, MATRIX_CELLS // k))
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in (piece.slice(i, most) for piece in pieces(batches) for i in range(0, piece.num_rows, most)):
        if held and (rows + batch.num_rows > most or size + batch.nbytes > BLOCK_BYTES):
            yield pa.Table.from_batches(held)
            held, rows, size = [], 0, 0
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


def read_shared(files: list[str], columns: list[str], rows: int = STREAM_ROWS) -> Iterator[pa.RecordBatch]:
    """Rows of Parquet files in the shared folder, read by a task."""
    for name in files:
        with open_shared(name) as source:
            yield from pq.ParquetFile(source).iter_batches(rows, columns=columns, use_threads=False)


def dealt(queries: DataFrame, n: int, size: int, k: int) -> DataFrame:
    """Queries spread over tasks of about one block each, and over all cores."""
    most = max(1, min(STREAM_QUERIES, MATRIX_CELLS // k))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    blocks = max(math.ceil(n / most), math.ceil(size / BLOCK_BYTES))
    return queries.repartition(max(1, math.ceil(blocks / cores)) * cores)


class Held:
    """The k best rows of each query of a block, of documents that come in the order of their ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, 2 * k), -np.inf)
        self.docs = np.zeros((n, 2 * k), np.int64)
        self.filled = np.zeros(n, np.int64)
        self.floor = np.full(n, _LEAST)

    def look(self, piece: Piece, first_doc: int) -> None:
        """Take in the cells of a piece that rank before the k-th best row; its batch begins with document ``first_doc``."""
        cells, scores, width = self._above(piece)
        keep = np.round(scores, SCORE_DIGITS) > self.floor[cells // width]
        cells, scores = cells[keep], scores[keep]
        if not len(cells):
            return
        new = np.bincount(cells // width, minlength=len(self.floor))
        if new.max() > self.k:
            crowded = np.flatnonzero(new > self.k)
            table = np.full((len(new), width), -np.inf)
            table.reshape(-1)[cells] = np.round(scores, SCORE_DIGITS)
            kept = table > -np.inf
            kept[crowded] &= best_per_row(table[crowded], self.k)
            keep = kept.reshape(-1)[cells]
            cells, scores = cells[keep], scores[keep]
            new = np.minimum(new, self.k)
        self.cut(np.flatnonzero(self.filled + new > 2 * self.k))
        q, d = np.divmod(cells, width)
        at = np.arange(len(q)) - (np.cumsum(new) - new)[q] + self.filled[q]
        self.scores[q, at] = scores
        self.docs[q, at] = d + (first_doc + piece.first_row)
        self.filled += new
        self.cut(np.flatnonzero((self.floor == _LEAST) & (self.filled >= self.k)))

    def _above(self, piece: Piece) -> tuple[np.ndarray, np.ndarray, int]:
        """Cells that may be above the floors, their exact scores, and the documents of the piece."""
        rough = piece.rough() if self.floor.min(initial=0.0) > _LEAST else None
        if rough is not None:
            marked = rough > piece.lowest(self.floor)[:, None]
            cells = np.flatnonzero(marked)
            if len(cells) * _DEAR <= rough.size:
                return cells, piece.at(cells, marked), rough.shape[1]
        exact = piece.exact()
        cells = np.flatnonzero(exact > np.maximum(self.floor - _SLACK, _LEAST)[:, None])
        return cells, exact.reshape(-1)[cells], max(exact.shape[1], 1)

    def cut(self, rows: np.ndarray) -> None:
        """Leave the k best of queries that hold k and more."""
        if not len(rows):
            return
        rounded = np.round(self.scores[rows], SCORE_DIGITS)
        best = np.nonzero(best_per_row(rounded, self.k))[1].reshape(-1, self.k)
        for table, rest in ((self.scores, -np.inf), (self.docs, 0)):
            kept = np.take_along_axis(table[rows], best, axis=1)
            table[rows, self.k :] = rest
            table[rows, : self.k] = kept
        self.filled[rows] = self.k
        self.floor[rows] = np.take_along_axis(rounded, best, axis=1).min(axis=1)

    def ranked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, score, rank) of the rows that are left."""
        self.cut(np.flatnonzero(self.filled > self.k))
        scores, docs = self.scores[:, : self.k], self.docs[:, : self.k]
        order = np.argsort(-np.round(scores, SCORE_DIGITS), axis=1, kind="stable")
        q, nth = np.nonzero(np.arange(self.k) < self.filled[:, None])
        at = order[q, nth]
        return q, docs[q, at], scores[q, at], nth + 1


def stream_topk(
    scorer: StreamScorer, batches: Iterable[pa.RecordBatch], ids: Iterable[pa.Array], k: int
) -> Iterator[pa.RecordBatch]:
    """The k best rows of each query with their ranks; ``ids`` are those of the same documents in the same order."""
    held: dict[int, Held] = {}
    first = 0
    for batch in batches:
        for piece in scorer.pieces(batch):
            if piece.dim not in held:
                held[piece.dim] = Held(len(scorer.query_ids), k)
            held[piece.dim].look(piece, first)
        first += batch.num_rows
    runs = {dim: rows.ranked() for dim, rows in held.items()}
    wanted = np.unique(np.concatenate([docs for _, docs, _, _ in runs.values()])) if runs else np.zeros(0, np.int64)
    names, first = [pa.array([], pa.string())], 0
    for some in ids:
        lo, hi = np.searchsorted(wanted, [first, first + len(some)])
        names.append(some.take(pa.array(wanted[lo:hi] - first)))
        first += len(some)
    found = pa.concat_arrays(names)
    for dim, (q, docs, scores, rank) in runs.items():
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(q), dim, dtype=np.int32)),
                scorer.query_ids.take(pa.array(q)),
                found.take(pa.array(np.searchsorted(wanted, docs))),
                pa.array(scores + 0.0),  # -0.0 becomes 0.0
                pa.array(rank.astype(np.int32)),
            ],
            names=[*_ARROW_SCHEMA.names, "rank"],
        )


def stream_queries(docs: DataFrame, queries: DataFrame, n: int, size: int, make_scorer: Callable, k: int) -> DataFrame:
    """Rows of the best ``k`` documents of each query with their ranks; ``docs`` are files in the shared folder, in the order of ids."""
    files, columns = sorted(docs.inputFiles()), docs.columns

    def score(batches: Iterator[pa.RecordBatch]):
        for table in query_blocks(batches, k):
            ids = (batch.column("doc_id") for batch in read_shared(files, ["doc_id"]))
            yield from stream_topk(make_scorer(table), pieces(read_shared(files, columns)), ids, k)

    return dealt(queries, n, size, k).mapInArrow(score, _RANKED_SCHEMA)


def ordered_by_id(docs: DataFrame) -> DataFrame:
    """Documents in files whose names and rows follow the ids; written before, so that they are computed once."""
    return durable(durable(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id"))


def _rank_streamed(docs: DataFrame, queries: DataFrame, n: int, size: int, make_scorer: Callable, k: int) -> DataFrame:
    run = stream_queries(ordered_by_id(docs), queries, n, size, make_scorer, k)
    # Rows of an id that repeats are one list.
    if n * k <= FEW_ROWS or not queries.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        run = rank_topk(run.drop("rank"), k, by=("truncate_dim", "query_id"))
    return durable(run)


def estimated_splits(df: DataFrame) -> int:
    """How many splits a scan has, from the size that the optimizer knows; 1 if it knows none."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= int(spark.conf.get("spark.sql.defaultSizeInBytes", str(2**63 - 1))):
        return 1
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    return size // spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(split) + 1


def candidates(
    docs: DataFrame, sent, make_scorer: Callable, k: int, floors=None, splits: int | None = None, read: Callable | None = None
) -> DataFrame:
    """Rows of the tasks; ``splits`` leaves all others out, ``floors`` are a broadcast of rows that bound the rest."""

    def score(batches: Iterator[pa.RecordBatch]):
        if splits is not None and TaskContext.get().partitionId() >= splits:
            return
        scorer = make_scorer(sent.value)
        bounds = Floors(floors.value, scorer.query_ids) if floors is not None else None
        yield from emit_topk(scorer, pieces(read(batches) if read else batches), k, bounds)

    return docs.mapInArrow(score, RUN_SCHEMA)


def find_floors(
    docs: DataFrame, sent, make_scorer: Callable, k: int, splits: int = PILOT_SPLITS, read: Callable | None = None
) -> pa.Table:
    """The k-th best row of each query among the first splits; at most one row per query of the block and dimension."""
    some = rank_topk(candidates(docs, sent, make_scorer, k, splits=splits, read=read), k, by=("truncate_dim", "query_id"))
    rounded = F.round("score", SCORE_DIGITS).alias("score")
    return some.where(F.col("rank") == k).select("truncate_dim", "query_id", rounded, "doc_id").toArrow()


def _one_pass(docs, query_block, make_scorer, k, read=None):
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(query_block.toArrow())
    splits = estimated_splits(docs)
    floors = None
    if splits >= MANY_SPLITS:
        floors = context.broadcast(find_floors(docs, sent, make_scorer, k, read=read))
    # From many tasks candidates are merged in two levels.
    many = splits > MERGE_TASKS
    return rank_topk(candidates(docs, sent, make_scorer, k, floors, read=read), k, by=("truncate_dim", "query_id"), two_levels=many), sent
