"""Substring dedup by recompression.

Texts are words. In every round neighbouring symbols are merged and named anew: runs of one symbol, and
pairs whose left symbol falls into the left half and whose right symbol falls into the right half of the round's partition of all names. A
name is a hash of what it stands for, so every task gives equal strings equal names without
talking to the others. Whether two neighbours merge depends on these two symbols only, so equal substrings get equal symbols
except near their ends; the reach ``[lo, hi)`` of words that decided a boundary is carried along, and
a boundary counts for a window only if the window holds its reach.

Triples of the highest level's symbols are the anchors by which repeats are found (see ``repeats``): Spark groups them over all documents, equal
ones are verified by hashes of whole spans and, where spans differ, window by window.

A window of ``width`` words repeats if its words also start in a document of smaller id. Null texts have
no words; null ids count as larger than all others; of repeated rows none removes words of the other. Empty tables
give empty results. Extra columns may have any name but are only kept when asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from qrelia.llm.repeats import ANCHORS, UNITS, Parsed, Repeats, apply_repeats, same_by_hash
from qrelia.llm.textarrays import Prefix, U, mix, ranges, words

ROUNDS = 3
TUPLE = 3
_FAR = np.int64(1) << 40


def recompress(names: np.ndarray, units: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol names, their first words, lo, hi) after the rounds; one more boundary than symbols."""
    n = len(names)
    start = np.arange(n + 1)
    lo, hi = start.copy(), start.copy()
    edges = np.unique(units)
    lo[edges], hi[edges] = -_FAR, _FAR  # a text's ends are known only there
    hard = np.zeros(n + 1, bool)
    hard[edges] = True
    for r in range(rounds):
        if len(names) < 2:
            break
        left = (mix(names ^ U(0xA5A5A5A5 + r)) >> U(63)).astype(bool)
        merged = (names[:-1] == names[1:]) | (left[:-1] & ~left[1:])
        keep = np.ones(len(names) + 1, bool)
        keep[1:-1] = ~merged | hard[1:-1]
        lo = np.minimum(lo, np.r_[lo[0], lo[:-1]])
        hi = np.maximum(hi, np.r_[hi[1:], hi[-1]])
        # A text's end hides nothing from the text on its other side.
        at = np.flatnonzero(keep)
        size = np.diff(at)
        names = np.where(size == 1, names[at[:-1]], Prefix(names).hashes(at[:-1], at[1:]))
        start, lo, hi, hard = start[at], lo[at], hi[at], hard[at]
    return names, start, lo, hi


def parse_words(body: np.ndarray, offsets: np.ndarray, depth: int) -> Parsed:
    starts, ends, units = words(body, offsets)
    if depth == UNITS:
        return Parsed(units, starts, ends, starts)
    names = Prefix(body).hashes(starts, ends)
    p = Parsed(units, starts, ends, names, Prefix(names))
    if depth == ANCHORS:
        symbols, _, lo, hi = recompress(names, units)
        n = max(len(symbols) - TUPLE + 1, 0)
        first = np.arange(n)
        near, far = lo[first], hi[first + TUPLE]
        known = (near >= 0) & (far < _FAR) & (near < far)
        p.lo, p.hi, p.name = near[known], far[known], Prefix(symbols).hashes(first[known], first[known] + TUPLE)
    return p


def joined_words(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words, joined by one space."""
    if not len(starts):
        return b""
    size = ends - starts + 1
    out = np.append(text, np.uint8(32))[ranges(starts, size)]
    out[np.cumsum(size) - 1] = 32
    return out[:-1].tobytes()


def _kept(n: int, runs) -> np.ndarray:
    keep = np.ones(n, bool)
    keep[ranges(runs[0], runs[1] - runs[0])] = False
    return keep


def digest_words(text: np.ndarray, places, runs) -> tuple[int, int, str]:
    starts, ends = places
    keep = _kept(len(starts), runs)
    return len(starts), int((~keep).sum()), hashlib.sha256(joined_words(text, starts[keep], ends[keep])).hexdigest()


def kept_words(text: np.ndarray, places, runs) -> tuple[str, int]:
    starts, ends = places
    keep = _kept(len(starts), runs)
    return joined_words(text, starts[keep], ends[keep]).decode("utf-8", "replace"), int((~keep).sum())


DIGEST = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
TEXTS = [T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType())]


def substring_dedup(
    docs: DataFrame, width: int = 50, keep: Sequence[str] = ("doc_id",), finish=kept_words, fields: Sequence[T.StructField] = tuple(TEXTS), **options
) -> DataFrame:
    """The ``keep`` columns and what is left of each text (or what ``finish`` makes of it)."""
    return apply_repeats(docs, Repeats(width, parse_words, True, same_by_hash), finish, fields, keep=keep, **options)
