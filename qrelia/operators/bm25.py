"""BM25 statistics and ranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qrelia.functions.text import bm25_tokenize, word_lists
from qrelia.operators.blocks import MATRIX_CELLS, block_topk, piece_rows, pieces, single
from qrelia.operators.joins import fits_broadcast, lookup_join
from qrelia.operators.ranking import SCORE_DIGITS
from qrelia.session import durable

# Parameters of the ranking function.
K1 = 1.5
B = 0.75
EPSILON = 0.25  # share of the mean idf given to terms whose own idf is negative

BM25_DIM = -1  # truncate_dim of a BM25 run

_POSTINGS_PER_SLICE = 2_000_000
_HELD_TERMS = 1_000_000  # counts that a task holds before it adds them up
_COMMON = 300  # a single sum costs as much as so many cells of a matrix product
_COMMON_PIECES = 500  # the same in single precision and in the cache


def bm25_tf(corpus: DataFrame) -> DataFrame:
    """Term frequency per document: (doc_id, term, tf)."""
    terms = corpus.select("doc_id", F.explode(bm25_tokenize(F.col("text"))).alias("term"))
    return terms.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25_terms(corpus: DataFrame) -> DataFrame:
    """Document frequency per term, from one pass over the corpus.

    The row with a NULL term stands for all documents, also those without any
    token: its ``df`` is their number and its ``tokens`` their total length.
    Tasks count in Arrow; Spark adds up their counts.
    """
    counts = corpus.select(F.lower("text").alias("text")).mapInArrow(_count_documents, "term string, df long, tokens long")
    return counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens"))


def _count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    n_docs = n_tokens = 0
    for batch in pieces(batches):
        tokens = word_lists(batch.column("text").drop_null())
        terms, _, term, tf = term_counts(tokens)
        held.append(pa.table({"term": terms, "df": np.bincount(term, minlength=len(terms))}))
        rows += len(terms)
        n_docs, n_tokens = n_docs + len(tokens), n_tokens + int(tf.sum())
        if rows > _HELD_TERMS:
            held = [_added(held)]
            rows = len(held[0])
            if rows > _HELD_TERMS // 2:
                yield from _term_rows(held.pop())
                rows = 0
    if held:
        yield from _term_rows(_added(held))
    if n_docs:
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([n_docs]), pa.array([n_tokens])], names=["term", "df", "tokens"])


def _added(held: list[pa.Table]) -> pa.Table:
    added = pa.concat_tables(held).group_by("term", use_threads=False).aggregate([("df", "sum")])
    return pa.table({"term": added["term"], "df": added["df_sum"]})


def _term_rows(counts: pa.Table) -> Iterator[pa.RecordBatch]:
    return iter(counts.append_column("tokens", pa.array(np.zeros(len(counts), np.int64))).to_batches())


def raw_idf(df: Column, n_docs: Column) -> Column:
    return F.log(n_docs - df + 0.5) - F.log(df + 0.5)


@dataclass
class Bm25Index:
    """Corpus statistics: two numbers, the mean idf, and the term table (term, df, idf)."""

    n_docs: int
    avgdl: float
    mean_idf: float
    terms: DataFrame


def bm25_index(corpus: DataFrame) -> Bm25Index:
    """Collect the statistics of a corpus; the term table is written once."""
    table = durable(bm25_terms(corpus))
    total = table.where("term IS NULL").first()
    n_docs, n_tokens = (total["df"], total["tokens"]) if total else (0, 0)
    raw = table.where("term IS NOT NULL").select(
        "term", "df", raw_idf(F.col("df"), F.lit(n_docs)).alias("raw")
    )
    mean_idf = raw.agg(F.avg("raw")).first()[0] or 0.0
    idf = F.when(F.col("raw") < 0, F.lit(EPSILON * mean_idf)).otherwise(F.col("raw"))
    avgdl = n_tokens / n_docs if n_docs else 0.0
    return Bm25Index(n_docs, avgdl, mean_idf, raw.select("term", "df", idf.alias("idf")))


def query_terms(queries: DataFrame) -> DataFrame:
    """How often each query uses each of its terms: (query_id, term, query_tf)."""
    terms = queries.select("query_id", F.explode(bm25_tokenize(F.col("text"))).alias("term"))
    return terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("query_tf"))


def join_postings(used: DataFrame, terms: DataFrame) -> DataFrame:
    """Query terms that occur in the corpus, with the term's statistics.

    The term table grows with the corpus and stays where it is as long as the
    query side is small enough to be broadcast. Otherwise it is cut to the query
    vocabulary before query terms, some of them very common, look it up.
    """
    columns = [*used.columns, *[c for c in terms.columns if c != "term"]]
    if fits_broadcast(used):
        return terms.join(F.broadcast(used), "term").select(*columns)
    wanted = durable(terms.join(used.select("term").distinct(), "term", "left_semi"))
    return lookup_join(used, wanted, "term").select(*columns)


def query_weights(queries: DataFrame, index: Bm25Index) -> DataFrame:
    """One row per query: its known terms and their weights (query_tf * idf)."""
    weighted = join_postings(query_terms(queries), index.terms)
    per_query = weighted.groupBy("query_id").agg(
        F.collect_list(
            F.struct("term", (F.col("query_tf") * F.col("idf")).alias("weight"))
        ).alias("w")
    )
    return (
        queries.select("query_id")
        .join(per_query, "query_id", "left")
        .select(
            "query_id",
            F.coalesce(F.col("w.term"), F.array().cast("array<string>")).alias("terms"),
            F.coalesce(F.col("w.weight"), F.array().cast("array<double>")).alias("weights"),
        )
    )


class Bm25Scorer:
    """Scores documents given as token lists with a length norm."""

    def __init__(self, queries: pa.Table, only_matches: bool = False):
        self.only_matches = only_matches
        self.query_ids = queries.column("query_id").combine_chunks()
        terms = queries.column("terms").combine_chunks()
        encoded = terms.flatten().dictionary_encode()
        self.vocabulary = encoded.dictionary
        term = encoded.indices.to_numpy(zero_copy_only=False)
        # A place of a term's uses, by term: the query and the weight there.
        by_term = np.argsort(term, kind="stable")
        self.query = pc.list_parent_indices(terms).to_numpy(zero_copy_only=False)[by_term]
        weights = queries.column("weights").combine_chunks().flatten()
        self.weight = weights.to_numpy(zero_copy_only=False)[by_term]
        self.begin = np.searchsorted(term[by_term], np.arange(len(self.vocabulary) + 1))
        self.uses = np.diff(self.begin)
        self.rough_weight = self.weight.astype(np.float32)

    def matrices(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        doc, term, gain = self._gains(batch)
        step = max(1, MATRIX_CELLS // max(len(self.query_ids), 1))
        for start in range(0, batch.num_rows, step):
            stop = min(batch.num_rows, start + step)
            lo, hi = np.searchsorted(doc, [start, stop])
            yield BM25_DIM, start, self._scores(doc[lo:hi] - start, term[lo:hi], gain[lo:hi], stop - start)

    def _scores(self, doc: np.ndarray, term: np.ndarray, gain: np.ndarray, width: int) -> np.ndarray:
        """Queries x documents. Terms that many pairs share are summed by a matrix product, the others pair by pair."""
        n_queries = len(self.query_ids)
        pairs = np.bincount(term, minlength=len(self.uses)) * self.uses
        common = np.flatnonzero(pairs > n_queries * width / _COMMON)
        slot = np.full(len(self.uses), -1)
        slot[common] = np.arange(len(common))
        at = ranges(self.begin[common], self.uses[common])
        weights = np.zeros((n_queries, len(common)))
        cells = self.query[at], np.repeat(np.arange(len(common)), self.uses[common])
        weights[cells] = self.weight[at]
        dense = slot[term] >= 0
        gains = np.zeros((len(common), width))
        gains[slot[term[dense]], doc[dense]] = gain[dense]
        scores = weights @ gains
        if self.only_matches:
            weights[cells] = 1.0
            gains[slot[term[dense]], doc[dense]] = 1.0
            matched = weights @ gains > 0
        # Spread each other (document, term) gain over the queries that use the term.
        doc, term, gain = doc[~dense], term[~dense], gain[~dense]
        load = np.r_[0, np.cumsum(self.uses[term])]
        start = 0
        while start < len(term):
            stop = max(start + 1, int(np.searchsorted(load, load[start] + _POSTINGS_PER_SLICE, "right")) - 1)
            n_use = self.uses[term[start:stop]]
            at = ranges(self.begin[term[start:stop]], n_use)
            cell = self.query[at] * width + np.repeat(doc[start:stop], n_use)
            np.add.at(scores.reshape(-1), cell, np.repeat(gain[start:stop], n_use) * self.weight[at])
            if self.only_matches:
                matched.reshape(-1)[cell] = True
            start = stop
        if self.only_matches:
            scores[~matched] = -np.inf
        return scores

    def pieces(self, batch: pa.RecordBatch) -> Iterator[Bm25Piece]:
        terms = self._split_terms(*self._gains(batch), batch.num_rows)
        for start, stop in piece_rows(len(self.query_ids), batch.num_rows):
            yield Bm25Piece(self, terms, start, stop)

    def _split_terms(self, doc: np.ndarray, term: np.ndarray, gain: np.ndarray, n_docs: int) -> _Terms:
        """The terms of a batch: common ones as matrices, the others as they were found."""
        n_queries = len(self.query_ids)
        pairs = np.bincount(term, minlength=len(self.uses)) * self.uses
        common = np.flatnonzero(pairs > n_queries * n_docs / _COMMON_PIECES)
        slot = np.full(len(self.uses), -1)
        slot[common] = np.arange(len(common))
        at = ranges(self.begin[common], self.uses[common])
        used = self.query[at], np.repeat(np.arange(len(common)), self.uses[common])
        weights = np.zeros((n_queries, len(common)))
        weights[used] = self.weight[at]
        gains = np.zeros((n_docs, len(common)))
        place = slot[term]
        dense, rest = place >= 0, place < 0
        gains[doc[dense], place[dense]] = gain[dense]
        return _Terms(used, weights, gains, weights.astype(np.float32), gains.astype(np.float32), doc[rest], term[rest], gain[rest])

    @cached_property
    def rough_error(self) -> np.ndarray | None:
        """The share by which a query's rough scores may be off, or None if weights are negative.

        The factors, the product and every sum are rounded, each by half a unit in the last place at most.
        """
        if (self.weight < 0).any():
            return None
        return (np.bincount(self.query, minlength=len(self.query_ids)) + 4) * 2.0**-23

    def _gains(self, batch: pa.RecordBatch):
        """Sorted (document, term) pairs of the query vocabulary and their tf gain."""
        if "tfs" in batch.schema.names:
            return self._counted_gains(batch)
        tokens = batch.column("tokens")
        term = pc.index_in(tokens.flatten(), value_set=self.vocabulary)
        known = term.is_valid().to_numpy(zero_copy_only=False)
        doc = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False)[known]
        term = term.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        size = max(len(self.vocabulary), 1)
        pair, tf = np.unique(doc.astype(np.int64) * size + term, return_counts=True)
        doc, term = pair // size, pair % size
        norm = batch.column("norm").to_numpy(zero_copy_only=False)
        return doc, term, tf * (K1 + 1) / (tf + norm[doc])

    def _counted_gains(self, batch: pa.RecordBatch):
        """The same from documents whose terms were counted before."""
        terms = batch.column("terms")
        term = pc.index_in(terms.flatten(), value_set=self.vocabulary)
        known = term.is_valid().to_numpy(zero_copy_only=False)
        doc = pc.list_parent_indices(terms).to_numpy(zero_copy_only=False)[known]
        tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False)[known]
        norm = batch.column("norm").to_numpy(zero_copy_only=False)
        return doc, term.drop_null().to_numpy(zero_copy_only=False).astype(np.int64), tf * (K1 + 1) / (tf + norm[doc])


@dataclass
class _Terms:
    """Queries x and documents x common terms, each in double and single precision, and other terms of the documents."""

    used: tuple[np.ndarray, np.ndarray]  # cells of ``weights`` that stand for a term of the query
    weights: np.ndarray
    gains: np.ndarray
    rough_weights: np.ndarray
    rough_gains: np.ndarray
    doc: np.ndarray
    term: np.ndarray
    gain: np.ndarray


class Bm25Piece:
    """Scores of a scorer's queries for a few documents of a batch."""

    dim = BM25_DIM

    def __init__(self, scorer: Bm25Scorer, terms: _Terms, start: int, stop: int):
        self.scorer, self.terms, self.first_row, self.stop = scorer, terms, start, stop
        lo, hi = np.searchsorted(terms.doc, [start, stop])
        self.doc, self.term, self.gain = terms.doc[lo:hi] - start, terms.term[lo:hi], terms.gain[lo:hi]
        self.load = np.r_[0, np.cumsum(scorer.uses[self.term])]
        self.added: list[tuple[int, np.ndarray, np.ndarray]] = []

    def _add_sums(self, scores: np.ndarray, weight: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Add the terms that are not common, a bounded number of sums at a time: (first sum, place of the use, cell)."""
        gain, load = self.gain.astype(weight.dtype), self.load
        start = 0
        while start < len(gain):
            stop = max(start + 1, int(np.searchsorted(load, load[start] + _POSTINGS_PER_SLICE, "right")) - 1)
            n = np.diff(load[start : stop + 1])
            at = np.repeat(self.scorer.begin[self.term[start:stop]] - load[start:stop], n)
            at += np.arange(load[start], load[stop])
            cell = self.scorer.query.take(at)
            cell *= scores.shape[1]
            cell += np.repeat(self.doc[start:stop], n)
            value = weight.take(at)
            value *= np.repeat(gain[start:stop], n)
            np.add.at(scores.reshape(-1), cell, value)
            yield int(load[start]), at, cell
            start = stop

    def exact(self) -> np.ndarray:
        gains = self.terms.gains[self.first_row : self.stop].T
        scores = self.terms.weights @ gains
        if self.scorer.only_matches:
            uses = np.zeros_like(self.terms.weights)
            uses[self.terms.used] = 1.0
            matched = uses @ (gains > 0).astype(float) > 0
        for _, _, cell in self._add_sums(scores, self.scorer.weight):
            if self.scorer.only_matches:
                matched.reshape(-1)[cell] = True
        if self.scorer.only_matches:
            scores[~matched] = -np.inf
        return scores

    def rough(self) -> np.ndarray | None:
        if self.scorer.only_matches or self.scorer.rough_error is None:
            return None
        scores = self.terms.rough_weights @ self.terms.rough_gains[self.first_row : self.stop].T
        self.added = list(self._add_sums(scores, self.scorer.rough_weight))
        return scores

    def lowest(self, floor: np.ndarray) -> np.ndarray:
        """No weight is negative, so that the error is a share of the score and a rough score is 0 only if the exact one is."""
        return np.maximum(single(floor * (1 - self.scorer.rough_error) - 10.0**-SCORE_DIGITS), np.float32(0))

    def at(self, cells: np.ndarray, marked: np.ndarray) -> np.ndarray:
        q, d = np.divmod(cells, marked.shape[1])
        scores = np.einsum("ij,ij->i", self.terms.weights[q], self.terms.gains[self.first_row + d])
        place = np.empty(marked.size, np.int32)
        place[cells] = np.arange(len(cells))
        for first, at, cell in self.added:
            hit = np.flatnonzero(marked.reshape(-1).take(cell))
            gain = self.gain[np.searchsorted(self.load, first + hit, "right") - 1]
            np.add.at(scores, place[cell[hit]], self.scorer.weight[at[hit]] * gain)
        return scores


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, ... of the given lengths."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def term_counts(tokens: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, document, term, tf): each term of a document once, by document, as a place among the terms."""
    coded = tokens.flatten().dictionary_encode()
    bits = max(len(coded.dictionary), 1).bit_length()
    doc = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    pair = np.sort((doc << bits) | coded.indices.to_numpy(zero_copy_only=False))
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    tf = np.diff(first, append=len(pair))
    return coded.dictionary, pair[first] >> bits, pair[first] & ((1 << bits) - 1), tf


def _norms(tokens: pa.ListArray, avgdl: float) -> np.ndarray:
    return K1 * ((1 - B) + B * (tokens.value_lengths().to_numpy(zero_copy_only=False) / (avgdl or 1.0)))


def tokenized(batches: Iterator[pa.RecordBatch], avgdl: float) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, lower-cased text) as (doc_id, tokens, norm)."""
    for batch in pieces(batches):
        tokens = word_lists(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), tokens, pa.array(_norms(tokens, avgdl))], names=["doc_id", "tokens", "norm"])


_COUNTED = "doc_id string, terms array<string>, tfs array<int>, norm double"


def counted_terms(docs: DataFrame, avgdl: float) -> DataFrame:
    """Documents (doc_id, lower-cased text) with each term once and how often it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            tokens = word_lists(batch.column("text"))
            terms, doc, term, tf = term_counts(tokens)
            at = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(at, x) for x in (terms.take(pa.array(term)), pa.array(tf, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists, pa.array(_norms(tokens, avgdl))], names=[c.split()[0] for c in _COUNTED.split(", ")])

    return docs.mapInArrow(count, _COUNTED)


def bm25_rank(
    corpus: DataFrame, queries: DataFrame, k: int, pad_zero_scores: bool = True
) -> DataFrame:
    """The best ``k`` documents per query as (truncate_dim=-1, query_id, doc_id, score, rank).

    All documents are ranked, so a query matching fewer than ``k`` documents is
    filled with score-0 ones by id; ``pad_zero_scores=False`` ranks only documents that
    share a term with the query, whatever its weight.
    """
    index = bm25_index(corpus)
    docs = corpus.select("doc_id", F.lower("text").alias("text"))
    scorer = partial(Bm25Scorer, only_matches=not pad_zero_scores)
    read, prepare = partial(tokenized, avgdl=index.avgdl), partial(counted_terms, avgdl=index.avgdl)
    return block_topk(docs, query_weights(queries, index), scorer, k, reuse_docs=True, read=read, prepare=prepare)
