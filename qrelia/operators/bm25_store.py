"""A stored BM25 index: written once per corpus, ranked with exact pruning.

Documents are kept in blocks of up to ``BLOCK_DOCS``, each one row: its documents by id, and per term
the documents that hold it, their gains (the part of a score that does not depend on the query) and the largest gain.
The sum of weight x largest gain over a query's terms of positive weight bounds every score of the block; a term of
negative weight can only lower it.

Ranking reads the bounds first. The blocks with the best bounds of each query are scored and give its k-th best row so
far, its floor; then only blocks whose bound reaches the floor of some query are read, and in them only those
queries are scored. Nothing is approximate: a skipped block has no row that could be among the best k. Many queries
need nearly every block; they are dealt over the tasks, and each task goes through the blocks with floors of its own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qrelia.functions.text import bm25_tokenize
from qrelia.operators.blocks import (
    BLOCK_BYTES,
    BLOCK_QUERIES,
    MANY_QUERIES,
    MATRIX_CELLS,
    RUN_SCHEMA,
    Floors,
    dealt,
    emit_topk,
    query_blocks,
    read_shared,
)
from qrelia.operators.bm25 import BM25_DIM, K1, B, Bm25Index, Bm25Scorer, bm25_index, query_weights
from qrelia.operators.joins import broadcast_if_small, measured_size
from qrelia.operators.ranking import SCORE_DIGITS, rank_topk
from qrelia.session import durable, files_fingerprint

BLOCK_DOCS = 1_024
BLOCK_TOKENS = 1_000_000  # a block is closed at this many tokens, too
ROW_GROUP_BYTES = 8 << 20  # small, so that unread blocks are skipped in files as well
PILOT_BLOCKS = 2  # scored first for each query
LISTED_BLOCKS = 10_000  # up to so many blocks are asked for by number, which Parquet can prune
_SLACK = 10.0 ** -(SCORE_DIGITS - 1)  # sums of bounds and of scores may round differently

_BLOCK = (
    "block long, first_doc string, doc_ids array<string>, terms array<string>, starts array<int>, "
    "docs array<int>, gains array<double>, tops array<double>"
)
_COLUMNS = [c.split()[0] for c in _BLOCK.split(", ")]


@dataclass
class StoredIndex(Bm25Index):
    """Statistics of a corpus, and where its blocks are."""

    path: str
    spark: SparkSession

    @property
    def bounds(self) -> DataFrame:
        """(block, first_doc, terms, tops): columns of the blocks that are read for every query."""
        return self.blocks.select("block", "first_doc", "terms", "tops")

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema(_BLOCK).parquet(f"{self.path}/blocks")


# --- writing -----------------------------------------------------------------------


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stored_index(corpus: DataFrame, folder: str, fingerprint: str | None = None) -> StoredIndex:
    """The index of ``corpus`` below ``folder``; built if there is none for its fingerprint.

    Without a fingerprint the files that ``corpus`` is read from stand for it. The numbers of the
    index are written last and make it valid, so a build that was broken off is done again.
    """
    spark = corpus.sparkSession
    path = f"{folder.rstrip('/')}/{fingerprint or files_fingerprint([corpus], _plan_text(corpus))}"
    if not _exists(spark, f"{path}/numbers/_SUCCESS"):
        _build(corpus, path)
    n = json.loads(spark.read.text(f"{path}/numbers").first()[0])
    return StoredIndex(n["n_docs"], n["avgdl"], n["mean_idf"], spark.read.parquet(f"{path}/terms"), path, spark)


def _plan_text(df: DataFrame) -> str:
    """The optimized plan without the numbers that Spark gives to columns."""
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().optimizedPlan().toString())


def _build(corpus: DataFrame, path: str) -> None:
    index = bm25_index(corpus)
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    tokens = bm25_tokenize(F.col("text"))
    length = F.size("tokens") / F.lit(index.avgdl or 1.0)
    docs = corpus.select("doc_id", tokens.alias("tokens")).withColumn("norm", F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length))
    blocks = docs.withColumn("task", F.spark_partition_id().cast("long")).mapInArrow(_pack_blocks, _BLOCK)
    blocks.write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{path}/blocks")
    numbers = {"n_docs": index.n_docs, "avgdl": index.avgdl, "mean_idf": index.mean_idf}
    corpus.sparkSession.range(1).select(F.lit(json.dumps(numbers))).coalesce(1).write.mode("overwrite").text(f"{path}/numbers")


def _pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n_docs, n_tokens, number = [], 0, 0, 0

    def close() -> pa.RecordBatch:
        return _block(pa.Table.from_batches(held).combine_chunks(), number)

    for batch in batches:
        at = 0
        lengths = pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy(zero_copy_only=False)
        while at < batch.num_rows:
            room = np.searchsorted(np.cumsum(lengths[at:]), BLOCK_TOKENS - n_tokens) + 1
            take = int(max(1, min(BLOCK_DOCS - n_docs, room, batch.num_rows - at)))
            held.append(batch.slice(at, take))
            n_docs, n_tokens, at = n_docs + take, n_tokens + int(lengths[at : at + take].sum()), at + take
            if n_docs >= BLOCK_DOCS or n_tokens >= BLOCK_TOKENS:
                yield close()
                held, n_docs, n_tokens, number = [], 0, 0, number + 1
    if held:
        yield close()


def _block(docs: pa.Table, number: int) -> pa.RecordBatch:
    docs = docs.take(pc.sort_indices(docs.column("doc_id").combine_chunks()))
    tokens = docs.column("tokens").combine_chunks()
    encoded = tokens.flatten().dictionary_encode()
    doc = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    term = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pair, tf = np.unique(term * len(docs) + doc, return_counts=True)
    term, doc = pair // len(docs), pair % len(docs)
    norm = docs.column("norm").to_numpy()
    gain = tf * (K1 + 1) / (tf + norm[doc])
    starts = np.searchsorted(term, np.arange(len(encoded.dictionary) + 1))
    tops = np.maximum.reduceat(gain, starts[:-1]) if len(gain) else gain
    ids = docs.column("doc_id").combine_chunks()
    row = [
        pa.array([(docs.column("task")[0].as_py() << 32) + number], pa.int64()),
        ids[:1],
        *(pa.ListArray.from_arrays([0, len(x)], x) for x in (ids, encoded.dictionary, pa.array(starts, pa.int32()), pa.array(doc, pa.int32()), pa.array(gain), pa.array(tops))),
    ]
    return pa.RecordBatch.from_arrays(row, names=_COLUMNS)


# --- ranking -----------------------------------------------------------------------


class _BoundScorer(Bm25Scorer):
    """Upper bounds of blocks, as if a block were a document with its terms' largest gains."""

    def __init__(self, queries: pa.Table, only_matches: bool = False):
        super().__init__(queries, only_matches)
        self.weight = np.maximum(self.weight, 0.0)

    def _gains(self, batch: pa.RecordBatch):
        term = pc.index_in(batch.column("terms").flatten(), value_set=self.vocabulary)
        known = term.is_valid().to_numpy(zero_copy_only=False)
        row = pc.list_parent_indices(batch.column("terms")).to_numpy(zero_copy_only=False)[known]
        gain = batch.column("tops").flatten().to_numpy(zero_copy_only=False)[known]
        return row, term.drop_null().to_numpy(zero_copy_only=False).astype(np.int64), gain

    def bounds(self, batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([m for _, _, m in self.matrices(batch)], axis=1)


class _BlockScorer(Bm25Scorer):
    """Scores the documents of the block it was given; queries that cannot reach their floor are left out."""

    def load(self, row: pa.RecordBatch, active: np.ndarray) -> None:
        self.active = active
        term = pc.index_in(row.column("terms").flatten(), value_set=self.vocabulary)
        known = np.flatnonzero(term.is_valid().to_numpy(zero_copy_only=False))
        starts = row.column("starts").flatten().to_numpy()
        size = starts[known + 1] - starts[known]
        place = np.repeat(starts[known], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        doc = row.column("docs").flatten().to_numpy()[place].astype(np.int64)
        by_doc = np.argsort(doc, kind="stable")
        which = np.repeat(term.drop_null().to_numpy(zero_copy_only=False).astype(np.int64), size)
        self.found = doc[by_doc], which[by_doc], row.column("gains").flatten().to_numpy()[place][by_doc]

    def _gains(self, batch: pa.RecordBatch):
        return self.found

    def matrices(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        for dim, start, scores in super().matrices(batch):
            scores[~self.active] = -np.inf
            yield dim, start, scores


def reaching(bounds: np.ndarray, first_docs: list[bytes], floors: Floors | None) -> np.ndarray:
    """Queries x blocks: whether a block may hold a row that does not rank behind the query's floor."""
    possible = bounds > -np.inf
    if floors is None or BM25_DIM not in floors.scores:
        return possible
    floor, ids = floors.scores[BM25_DIM][:, None], floors.doc_ids[BM25_DIM]
    tie = bounds == floor
    q, block = np.nonzero(tie)
    tie[q, block] = np.array(first_docs, dtype=object)[block] <= np.array(ids, dtype=object)[q]
    # A bound within rounding of the floor may stand for a score above it, but no terms give 0 exactly.
    near = (bounds > floor - _SLACK) & ~((bounds == 0) & (floor == 0))
    return possible & (near | tie)


def best_blocks(index: StoredIndex, sent, n: int, only_matches: bool) -> DataFrame:
    """(block) of the ``n`` best bounds of every query."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _BoundScorer(sent.value, only_matches)
        named = (pa.RecordBatch.from_arrays([b.column("block").cast(pa.string()), b.column("terms"), b.column("tops")], names=["doc_id", "terms", "tops"]) for b in batches)
        yield from emit_topk(scorer, named, n)

    found = rank_topk(index.bounds.mapInArrow(score, RUN_SCHEMA), n)
    return found.select(F.col("doc_id").cast("long").alias("block")).distinct()


def reachable_blocks(index: StoredIndex, sent, floors, only_matches: bool) -> DataFrame:
    """(block) of the blocks that have to be read."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _BoundScorer(sent.value, only_matches)
        known = Floors(floors.value, scorer.query_ids)
        for batch in filter(len, batches):
            firsts = batch.column("first_doc").cast(pa.binary()).to_pylist()
            needed = reaching(scorer.bounds(batch), firsts, known).any(axis=0)
            yield pa.RecordBatch.from_arrays([batch.column("block").filter(pa.array(needed))], names=["block"])

    return index.bounds.mapInArrow(look, "block long")


def _read_blocks(index: StoredIndex, wanted: DataFrame) -> DataFrame:
    n = wanted.limit(LISTED_BLOCKS + 1).collect()
    if len(n) <= LISTED_BLOCKS:
        return index.blocks.where(F.col("block").isin([r["block"] for r in n]))
    return index.blocks.join(broadcast_if_small(wanted), "block", "left_semi")


def _score_blocks(blocks: DataFrame, sent, floors, k: int, only_matches: bool) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _BlockScorer(sent.value, only_matches)
        bound = _BoundScorer(sent.value, only_matches)
        known = Floors(floors.value if floors is not None else None, scorer.query_ids)
        yield from emit_topk(scorer, _documents(batches, scorer, bound, known), k, known)

    return blocks.select(*_COLUMNS).mapInArrow(score, RUN_SCHEMA)


def _documents(batches: Iterator[pa.RecordBatch], scorer: _BlockScorer, bound: _BoundScorer, known: Floors) -> Iterator[pa.RecordBatch]:
    """Documents of the blocks that some query needs by the floors of the moment, loaded into the scorer one by one."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            active = reaching(bound.bounds(row), row.column("first_doc").cast(pa.binary()).to_pylist(), known)[:, 0]
            if active.any():
                scorer.load(row, active)
                yield pa.RecordBatch.from_arrays([row.column("doc_ids").flatten()], names=["doc_id"])


def _stream_queries(index: StoredIndex, weights: DataFrame, n: int, size: int, k: int, only_matches: bool) -> DataFrame:
    """Every task reads the blocks past its own queries; the floors it has so far tell which it scores."""
    files = sorted(index.blocks.inputFiles())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in query_blocks(batches, k):
            scorer, bound = _BlockScorer(table, only_matches), _BoundScorer(table, only_matches)
            known = Floors(None, scorer.query_ids)
            yield from emit_topk(scorer, _documents(read_shared(files, _COLUMNS, 1), scorer, bound, known), k, known)

    run = dealt(weights, n, size, k).mapInArrow(score, RUN_SCHEMA)
    return durable(rank_topk(run, k, by=("truncate_dim", "query_id")))


def rank_by_index(index: StoredIndex, queries: DataFrame, k: int, pad_zero_scores: bool = True) -> DataFrame:
    """As ``bm25_rank``: (truncate_dim=-1, query_id, doc_id, score, rank)."""
    weights = durable(query_weights(queries, index))
    n, size = measured_size(weights)
    if n > MANY_QUERIES:
        return _stream_queries(index, weights, n, size, k, not pad_zero_scores)
    passes = max(1, -(-n // BLOCK_QUERIES), -(-size // BLOCK_BYTES), -(-n * k // MATRIX_CELLS))
    part = F.pmod(F.xxhash64("query_id"), F.lit(passes))
    runs = [_rank_part(index, weights.where(part == i), k, not pad_zero_scores) for i in range(passes)]
    return reduce(DataFrame.unionByName, runs)


def _rank_part(index: StoredIndex, weights: DataFrame, k: int, only_matches: bool) -> DataFrame:
    context = index.spark.sparkContext
    sent = context.broadcast(weights.toArrow())  # bounded by the size of a part
    by = ("truncate_dim", "query_id")
    pilot = durable(best_blocks(index, sent, PILOT_BLOCKS, only_matches))
    first = rank_topk(_score_blocks(_read_blocks(index, pilot), sent, None, k, only_matches), k, by=by)
    kth = first.where(F.col("rank") == k)
    floors = context.broadcast(kth.select("truncate_dim", "query_id", F.round("score", SCORE_DIGITS).alias("score"), "doc_id").toArrow())
    wanted = durable(reachable_blocks(index, sent, floors, only_matches))
    return rank_topk(_score_blocks(_read_blocks(index, wanted), sent, floors, k, only_matches), k, by=by)
