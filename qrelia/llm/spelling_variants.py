"""Words and their likely misspellings: near words found by products of letter-count blocks.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. Then their letter
counts have a squared distance of 1 (one letter more) or 2 (one letter for another), and their lengths are
equal or adjacent. Squared distances of a block of words come from one matrix product of their letter counts; pairs
at most two apart are kept and their edit is verified.

Which words share a block is decided so that no near pair is missed and no block grows with the vocabulary. For a
pair whose shorter word has ``m`` letters, the edit lies in a region ``[lo, hi]`` of the shorter word, and what
lies outside is equal in both: the words meet under (m, lo, hi, prefix, suffix). At first the region is one
half of the word. A key with more than ``BLOCK_WORDS`` words is cut into the two halves of its region, again and
again. A region of one letter holds at most one word per letter and per pair of letters, which is below the
bound for the alphabet used here, so this ends. Every pair is reported by one region only, the one that holds the
last place its edit can be put.

Null texts have no words, a null id counts as an empty one in the damage, repeated rows count again, an empty table gives an
empty result. Extra columns are not used; column names of the input may be anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qrelia.llm.textarrays import ranges, raw
from qrelia.session import durable

SHORTEST = 6  # code points
LEAST_COUNT = 5
FORM_FACTOR = 5
LETTERS = 90  # a-z and U+00C0 to U+00FF
BLOCK_WORDS = LETTERS + LETTERS * LETTERS + 2
TILE_ROWS = 512  # rows of one matrix product
EXACT_FLOAT = 2000  # longest word whose squared letter counts float32 holds exactly

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ("k", "m", "lo", "hi")
_PAIRS = "a string, b string, a_n long, b_n long"


def letter_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, run): maximal runs of Latin letters with A-Z in lower case, one row per occurrence."""
    pattern = F.lit(f"[a-zÀ-ÿ]{{{shortest},}}")  # greedy, so a match is a whole run
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.translate(F.col(text), _UPPER, _LOWER).alias("text"))
    return plain.select("doc_id", F.explode(F.regexp_extract_all("text", pattern, F.lit(0))).alias("run"))


def damaged(run: Column, doc_id: Column, every: int = 199) -> Column:
    """``run`` without one code point where ``every`` divides the crc32 of ``<doc_id>:<run>``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = F.pmod(h, F.char_length(run)).cast("int")
    without = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(F.pmod(h, F.lit(every)) == 0, without).otherwise(run)


def count_words(words: DataFrame, shortest: int = SHORTEST, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough; ``words`` has one row per occurrence."""
    long_enough = words.where(F.char_length("word") >= shortest)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _keyed(rows: DataFrame) -> DataFrame:
    """Add the hash of what lies outside the region."""
    outside = F.col("m") - F.col("hi")
    head = F.substring("word", F.lit(1), F.col("lo"))
    tail = F.substring("word", F.char_length("word") - outside + 1, outside)
    return rows.withColumn("k", F.xxhash64("m", "lo", "hi", head, tail))


def _halves(rows: DataFrame) -> DataFrame:
    middle = ((F.col("lo") + F.col("hi")) / 2).cast("int")
    cut = F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi")))
    return _keyed(rows.select("word", "n", "m", F.explode(cut).alias("r")).select("word", "n", "m", "r.lo", "r.hi"))


def blocks(vocabulary: DataFrame, shortest: int = SHORTEST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n, m, lo, hi, k): every word once or more, at most ``block_words`` words for a key."""
    length = F.char_length("word")
    lengths = F.filter(F.array(length, length - 1), lambda m: m >= shortest)
    whole = vocabulary.select("word", "n", F.explode(lengths).alias("m"))
    rows = _halves(whole.select("word", "n", "m", F.lit(0).alias("lo"), F.col("m").alias("hi")))
    done: list[DataFrame] = []
    while True:
        crowded = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("c")).where((F.col("c") > block_words) & (F.col("hi") - F.col("lo") > 1))
        crowded = durable(crowded.select(*_KEY))
        if crowded.isEmpty():
            break
        done.append(rows.join(crowded, list(_KEY), "left_anti"))
        rows = durable(_halves(rows.join(crowded, list(_KEY), "left_semi")))
    for part in done:
        rows = rows.unionByName(part)
    return rows


def _letter_counts(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row per word, one column per letter; letters are Latin-1 bytes."""
    n, size = len(at) - 1, np.diff(at)
    row = np.repeat(np.arange(n), size)
    counts = np.bincount(row * 256 + body, minlength=n * 256).reshape(n, 256)
    return counts[:, counts.any(axis=0)].astype(np.float32 if len(size) == 0 or size.max() <= EXACT_FLOAT else np.float64)


def _edit_place(body: np.ndarray, at: np.ndarray, short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Where ``long`` differs from ``short`` by its one edit; -1 if it takes more than one.

    Of several places of an inserted letter the last one counts.
    """
    m = at[short + 1] - at[short]
    same = at[long + 1] - at[long] == m
    ones = ranges(np.zeros(len(m), np.int64), m)
    x = body[np.repeat(at[short], m) + ones]
    heads = np.cumsum(m) - m
    first_off = np.minimum.reduceat(np.where(x != body[np.repeat(at[long], m) + ones], ones, np.iinfo(np.int64).max), heads)
    place = np.minimum(first_off, m)
    shift = np.repeat(at[long] + 1, m)
    last_off = np.maximum.reduceat(np.where(x != body[np.minimum(shift + ones, len(body) - 1)], ones, -1), heads)
    differing = np.add.reduceat((x != body[np.repeat(at[long], m) + ones]).astype(np.int64), heads)
    return np.where(np.where(same, differing == 1, last_off < place), place, -1)


def near_in_block(words: pa.Array, k: np.ndarray, m: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of near words; equal keys stand next to each other."""
    body, offsets = raw(pa.array([w.encode("latin-1") for w in words.to_pylist()], pa.binary()))
    size = np.diff(offsets)
    counts = _letter_counts(body, offsets)
    norm = np.einsum("ij,ij->i", counts, counts)
    fresh = np.r_[True, (k[1:] != k[:-1]) | (m[1:] != m[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
    group = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    end = np.r_[first[1:], len(k)]
    found_i, found_j = [], []
    for r in range(0, len(k), TILE_ROWS):
        rows = slice(r, min(r + TILE_ROWS, len(k)))
        columns = slice(first[group[rows.start]], end[group[rows.stop - 1]])
        distance = norm[rows, None] + norm[None, columns] - 2 * (counts[rows] @ counts[columns].T)
        close = (distance <= 2) & (distance > 0) & (group[rows, None] == group[None, columns])
        i, j = np.nonzero(close)
        i, j = i + rows.start, j + columns.start
        # the shorter word first; of two equally long ones the earlier
        keep = (size[i] == m[i]) & ((size[j] == m[i] + 1) | ((size[j] == m[i]) & (i < j)))
        found_i.append(i[keep])
        found_j.append(j[keep])
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    if not len(i):
        return i, j
    place = _edit_place(body, offsets, i, j)
    inside = (place >= lo[i]) & ((place < hi[i]) | ((place == hi[i]) & (place == m[i])))
    return i[inside], j[inside]


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of a partition sorted by key; a key's words may span batches."""
    held: pa.Table | None = None

    def numbers(t: pa.Table, name: str) -> np.ndarray:
        return t.column(name).to_numpy()

    def search(t: pa.Table) -> Iterator[pa.RecordBatch]:
        words = t.column("word").combine_chunks()
        i, j = near_in_block(words, *(numbers(t, c) for c in _KEY))
        n = numbers(t, "n")
        columns = [words.take(pa.array(i)), words.take(pa.array(j)), pa.array(n[i]), pa.array(n[j])]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "a_n", "b_n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows < TILE_ROWS:
            continue
        key = np.stack([numbers(held, c).astype(np.int64) for c in _KEY])
        differs = np.flatnonzero((key[:, -1:] != key).any(axis=0))  # rows before the last key
        if len(differs):
            whole = int(differs[-1]) + 1
            yield from search(held.slice(0, whole))
            held = held.slice(whole).combine_chunks()
    if held is not None and held.num_rows:
        yield from search(held)


def near_words(vocabulary: DataFrame, shortest: int = SHORTEST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(a, b, a_n, b_n): every pair of near words of ``vocabulary(word, n)`` once."""
    rows = blocks(vocabulary, shortest, block_words).select("word", "n", *_KEY)
    dealt = rows.repartition("k").sortWithinPartitions(*_KEY)
    return dealt.mapInArrow(_near_pairs, _PAIRS)


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) for ``links(word, form)``; each form occurs five times as often, so there are no circles."""
    roots = durable(links.select("word", F.col("form").alias("root")))
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("_up"))
        longer = durable(roots.join(up, "root", "left").select("word", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved")))
        roots = longer.select("word", "root")
        if longer.where("_moved").isEmpty():
            return roots


def group_variants(vocabulary: DataFrame, factor: int = FORM_FACTOR, shortest: int = SHORTEST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``vocabulary(word, n)``."""
    vocabulary = durable(vocabulary.select("word", F.col("n").cast("long").alias("n")))
    pairs = durable(near_words(vocabulary, shortest, block_words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("m"))
    )
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("near").alias("w"))).alias("best"))
    judged = vocabulary.join(best, "word", "left")
    is_form = -F.col("best.m") >= factor * F.col("n")
    judged = durable(
        judged.select(
            "word",
            F.when(is_form, F.col("best.w")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, -F.col("best.m")).alias("form_n"),
        )
    )
    roots = _roots(judged.where("form IS NOT NULL").select("word", "form"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", damage_every: int | None = None) -> DataFrame:
    """Variants among the words of all texts; ``damage_every`` first damages one run in so many."""
    runs = letter_runs(docs, doc_id, text)
    word = F.col("run") if damage_every is None else damaged(F.col("run"), F.col("doc_id"), damage_every)
    return group_variants(count_words(runs.select(word.alias("word"))))
