"""Benchmark decontamination by spaced seeds.

Words are compared without regard to A-Z case. A mask such as ``1101011`` marks which words of a stretch
are hashed and which are ignored, so a replaced word leaves the seeds intact that skip it. Seeds of every position of every benchmark
item are joined with the seeds of every position of every document. Around each hit the item is laid
over the document and words are compared one by one; a document is contaminated by an item if at least
``similarity`` of the item's words agree in place.

Items shorter than every mask are sought as a whole; items without words are never found. Null texts have no
words, null ids are carried along. Repeated rows are judged one by one; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qrelia.llm.tables import fresh_names
from qrelia.llm.textarrays import Prefix, U, mix, ranges, slices, words
from qrelia.session import durable

MASKS = ("11111", "110111", "1101011", "10110101", "1001101001")
#: Also for items of less than SHORT words, where one or two replaced words can leave no stretch for MASKS.
SHORT_MASKS = ("1111", "11011", "10111", "11101")
SHORT = 11
SIMILARITY = 0.8
#: The benchmark is broadcast in blocks of about so many characters, one pass over the documents each.
BLOCK_CHARS = 20_000_000
_BITS = 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Seeds:
    """One mask's seeds of all items, sorted by hash."""

    mask: str
    hashes: np.ndarray
    item: np.ndarray
    at: np.ndarray
    seen: np.ndarray  # which leading bits occur


@dataclass
class Benchmark:
    ids: list
    first: np.ndarray  # first word of each item, one more entry than items
    names: np.ndarray
    seeds: list[Seeds]


def names_of(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words, and the first word of every row."""
    low = _LOWER[body]
    starts, ends, rows = words(low, offsets)
    return Prefix(low).hashes(starts, ends), rows


def _masked(names: np.ndarray, rows: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(position, seed) of every stretch that lies within a row."""
    n = len(names) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, U)
    total = np.zeros(n, U)
    for k, bit in enumerate(mask):
        if bit == "1":
            total = total * U(0x9E3779B97F4A7C15) + names[k : k + n]
    at = ranges(rows[:-1], np.maximum(np.diff(rows) - len(mask) + 1, 0))
    return at, mix(total[at])


def index_benchmark(ids: list, texts: Sequence[str | None], masks: Sequence[str] = MASKS) -> Benchmark:
    parts = list(slices(pa.array([t or "" for t in texts], pa.large_string()), 1 << 62))
    body, at = (parts[0][1], parts[0][2]) if parts else (np.empty(0, np.uint8), np.zeros(1, np.int64))
    names, first = names_of(body, at)
    size = np.diff(first)
    shortest = min(map(len, masks))
    seeds = []
    for mask in [*masks, *SHORT_MASKS, *("1" * n for n in range(1, min(shortest, 4)))]:
        where, hashes = _masked(names, first, mask)
        item = np.searchsorted(first, where, "right") - 1
        if mask in SHORT_MASKS or len(mask) < shortest:
            # Items of four words are sought as a whole by the shortest of these masks.
            short = size[item] < SHORT if mask in SHORT_MASKS else size[item] == len(mask)
            where, hashes, item = where[short], hashes[short], item[short]
        if len(where):
            order = np.argsort(hashes, kind="stable")
            seen = np.zeros(1 << _BITS, bool)
            seen[hashes >> U(64 - _BITS)] = True
            seeds.append(Seeds(mask, hashes[order], item[order], (where - first[item])[order], seen))
    return Benchmark(ids, first, names, seeds)


def overlaps(bench: Benchmark, names: np.ndarray, rows: np.ndarray, similarity: float) -> tuple[np.ndarray, ...]:
    """(row, item, start, agreeing words) of the best overlap of every contaminated row and item."""
    found = []
    for seeds in bench.seeds:
        at, hashes = _masked(names, rows, seeds.mask)
        maybe = seeds.seen[hashes >> U(64 - _BITS)]
        at, hashes = at[maybe], hashes[maybe]
        low = np.searchsorted(seeds.hashes, hashes, "left")
        n = np.searchsorted(seeds.hashes, hashes, "right") - low
        hit = ranges(low, n)
        at = np.repeat(at, n)
        # The row of the hit; the laid-over item may reach into the rows around it.
        row = np.searchsorted(rows, at, "right") - 1
        found.append(np.stack([row, seeds.item[hit], at - seeds.at[hit]], 1))
    lines = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)
    if not len(lines):
        return (np.empty(0, np.int64),) * 4
    row, item, start = lines.T
    size = np.diff(bench.first)[item]
    low, high = np.maximum(start, rows[row]), np.minimum(start + size, rows[row + 1])
    n = high - low
    owner = np.repeat(np.arange(len(item)), n)
    same = names[ranges(low, n)] == bench.names[ranges(bench.first[item] + low - start, n)]
    agree = np.bincount(owner[same], minlength=len(item))
    good = agree >= similarity * size
    row, item, start, agree = row[good], item[good], start[good], agree[good]
    order = np.lexsort((start, -agree, item, row))
    row, item, start, agree = row[order], item[order], start[order], agree[order]
    best = np.ones(len(row), bool)
    best[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    return row[best], item[best], start[best] - rows[row[best]], agree[best]


def _block_by_block(benchmark: DataFrame, item_id: str, text: str, block_chars: int, step: Callable[[Broadcast], DataFrame]) -> Iterator[DataFrame]:
    """``step`` of every block; of several blocks each result is written and its block freed before the next is collected."""
    context = benchmark.sparkSession.sparkContext
    chars = benchmark.agg(F.sum(F.length(text)).alias("n")).first()["n"] or 0
    n = max(1, -(-chars // block_chars))
    for k in range(n):
        block = benchmark.where(F.pmod(F.xxhash64(item_id, text), F.lit(n)) == k).select(item_id, text).collect()
        shipped = context.broadcast(index_benchmark([r[0] for r in block], [r[1] for r in block]))
        if n == 1:
            yield step(shipped)
        else:
            yield durable(step(shipped))
            shipped.destroy()


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id, start word, n_matched, n_item_words, similarity) for every contaminated document and item."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def search(shipped: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = shipped.value
            ids, size = pa.array(bench.ids, pa.int64()), np.diff(bench.first)
            for batch in batches:
                for first, body, at in slices(batch.column(1)):
                    row, item, start, agree = overlaps(bench, *names_of(body, at), similarity)
                    columns = [batch.column(0).take(pa.array(first + row)), ids.take(pa.array(item))]
                    columns += [pa.array(start), pa.array(agree), pa.array(size[item]), pa.array(agree / size[item])]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "start_word", "n_matched", "n_item_words", "similarity"])

        return run

    types = "doc_id long, item_id long, start_word long, n_matched long, n_item_words long, similarity double"
    parts = _block_by_block(benchmark, item_id, item_text, block_chars, lambda shipped: plain.mapInArrow(search(shipped), types))
    return reduce(DataFrame.unionByName, parts)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """``docs`` without the contaminated rows; all columns stay as they are."""
    (body_of,) = fresh_names(docs, "text")
    rows = docs.select("*", F.coalesce(F.col(text), F.lit("")).alias(body_of))
    schema = T.StructType(rows.schema.fields)

    def clean(shipped: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for first, body, at in slices(batch.column(batch.num_columns - 1)):
                    row, *_ = overlaps(shipped.value, *names_of(body, at), similarity)
                    keep[first + row] = False
                yield batch.filter(pa.array(keep))

        return run

    # The step looks ``rows`` up when it is called: each block cleans what the one before has left.
    for cleaned in _block_by_block(benchmark, item_id, item_text, block_chars, lambda shipped: rows.mapInArrow(clean(shipped), schema)):
        rows = cleaned
    return rows.drop(body_of)
