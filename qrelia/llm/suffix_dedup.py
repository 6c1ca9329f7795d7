"""Suffix-array dedup of byte strings by rank doubling over anchored spans.

A window of ``width`` bytes repeats if it starts anywhere else too. Repeats are found by anchors (see ``repeats``): places chosen by
a hash of 16 bytes. Names that occur once rule their windows out and equal spans answer each other; what is
left, spans of many documents with a common anchor, is ranked in a task.

Rank doubling replaces a merge of Burrows-Wheeler transforms; none is built. A block is a set of suffixes that agree in the
symbols seen so far, and blocks are numbered in lexicographic order. A round takes, for every suffix, the symbol before it and the
suffix's block: blocks of (symbol, block) are the order of the suffixes one symbol longer, found by
a full sort of these pairs in every round. The round in which two neighbours
part gives the length of what they have in common; suffixes still in one block after ``width`` bytes are a repeated interval.
Symbols are stretches of up to ``SYMBOL`` bytes, named in order by doubling, so that few rounds are enough.

Null texts are empty. Null ids and repeated rows are no special case: a row's copy is another place. Empty tables give
empty results; extra columns are only kept when asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from qrelia.llm.repeats import ANCHORS, UNITS, Parsed, Repeats, apply_repeats
from qrelia.llm.textarrays import Prefix, U, mix, ranges

GRAM, TAIL, GAP = 16, 40, 32
SYMBOL = 128


def _ranks(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Ranks of the pairs (high, low) in order.

    As ``np.unique`` gives them, in half its memory: the arrays here are what a worker keeps at its largest.
    """
    if not len(high):
        return np.empty(0, np.int32)
    pair = high.astype(np.int64)
    pair *= np.int64(low.max()) + 1
    pair += low
    order = np.argsort(pair)
    pair = pair[order]
    rank = np.zeros(len(pair), np.int32)
    np.cumsum(pair[1:] != pair[:-1], out=rank[1:], dtype=np.int32)
    del pair
    out = np.empty(len(rank), np.int32)
    out[order] = rank
    return out


def symbol_names(body: np.ndarray, size: int, wanted: Sequence[int] | None = None) -> dict[int, np.ndarray]:
    """For 1, 2, 4, ... ``size``, or those ``wanted`` of them: the rank of the stretch of so many bytes at every place.

    Bytes after the end count as 0; stretches that reach beyond it are not used.
    """
    one, names, n = body.astype(np.int32), {}, 1
    while True:
        if wanted is None or n in wanted:
            names[n] = one
        if n >= size:
            return names
        one = _ranks(one, np.append(one[n:], np.zeros(min(n, len(one)), np.int32)))
        n *= 2


def interleave(body: np.ndarray, starts: np.ndarray, width: int, symbol: int = SYMBOL) -> tuple[np.ndarray, np.ndarray]:
    """(block, depth) of every window start.

    Blocks are numbered in the order of their windows. ``depth`` tells how many of a window's last bytes, in whole
    symbols, agree with another window's: the round in which the two were parted, ``width`` if never.
    """
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # The last bytes of the window first: the suffixes' blocks grow to the left, symbol by symbol.
    sizes, left = [], width
    size = largest = min(symbol, 1 << (width.bit_length() - 1))
    while size:
        sizes += [size] * (left // size)
        left %= size
        size //= 2
    names = symbol_names(body, largest, sizes)
    at, block, depth = starts + width, np.zeros(len(starts), np.int32), np.zeros(len(starts), np.int32)
    alone = np.zeros(len(starts), bool)
    for size in reversed(sizes):
        at -= size
        block = _ranks(names[size][at], block)
        alone |= np.bincount(block)[block] == 1
        depth += np.where(alone, 0, size).astype(np.int32)
    return block, depth


def same_by_interleave(p: Parsed, starts: np.ndarray, width: int) -> np.ndarray:
    return interleave(p.symbols, starts, width)[0]


def parse_bytes(body: np.ndarray, offsets: np.ndarray, depth: int) -> Parsed:
    if depth == UNITS:
        return Parsed(offsets, None, None, body)
    p = Parsed(offsets, None, None, body, Prefix(body))
    if depth == ANCHORS:
        at = np.flatnonzero(mix(p.prefix.windows(GRAM)) < U((1 << 64) // GAP))
        row = np.searchsorted(offsets, at, "right") - 1
        at = at[at + GRAM + TAIL <= offsets[row + 1]]
        p.lo, p.hi = at, at + GRAM + TAIL
        p.name = p.prefix.hashes(p.lo, p.hi)
    return p


def _kept(n: int, runs) -> np.ndarray:
    keep = np.ones(n, bool)
    keep[ranges(runs[0], runs[1] - runs[0])] = False
    return keep


def digest_bytes(text: np.ndarray, places, runs) -> tuple[int, int, int, str]:
    left = text[_kept(len(text), runs)]
    return len(text), len(text) - len(left), len(runs[0]), hashlib.sha256(left.tobytes()).hexdigest()


def kept_text(text: np.ndarray, places, runs) -> tuple[str, int]:
    """What is left as text; a run gives back the parts of characters at its ends."""
    head = (text & 0xC0) != 0x80
    starts, ends = runs[0].copy(), runs[1].copy()
    for _ in range(3):
        starts += (starts < ends) & ~head[np.minimum(starts, len(text) - 1)] if len(text) else 0
        inside = ends < len(text)
        ends -= (starts < ends) & inside & ~head[np.minimum(ends, len(text) - 1)] if len(text) else 0
    left = text[_kept(len(text), (starts, ends))].tobytes().decode("utf-8", "replace")
    return left, len(left)


DIGEST = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()),
    T.StructField("kept_sha256", T.StringType()),
]
TEXTS = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]


def suffix_dedup(
    docs: DataFrame, width: int = 400, keep: Sequence[str] = ("doc_id",), finish=kept_text, fields: Sequence[T.StructField] = tuple(TEXTS), **options
) -> DataFrame:
    """The ``keep`` columns and what is left of each text (or what ``finish`` makes of it)."""
    return apply_repeats(docs, Repeats(width, parse_bytes, False, same_by_interleave), finish, fields, keep=keep, **options)
