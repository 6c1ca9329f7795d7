"""Token ids of whole texts by a public tokenizer whose tokens never cross white space.

A text's ids are the ids of its words in order, so every different word is encoded once and looked
up by hash afterwards. The memory of words lives as long as the Python worker and starts anew when it
is full.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from qrelia.llm.textarrays import Prefix, ranges, slices, words

MOST_WORDS = 1_000_000  # remembered per worker, in about 40 bytes each


class WordIds:
    """Ids by word hash, in flat arrays."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task its cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.hashes = np.empty(0, np.uint64)  # ascending
        self.first = np.empty(0, np.int32)
        self.size = np.empty(0, np.int32)
        self.flat = np.zeros(4096, np.uint32)
        self.used = 0

    def _add(self, hashes: np.ndarray, texts: list[str]) -> None:
        """Remember words by their ascending hashes."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = [f.ids for f in found]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(size.sum())
        if self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, (self.used + total) * 5 // 4)
        self.flat[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.first = np.insert(self.first, at, self.used + np.cumsum(size) - size)
        self.size = np.insert(self.size, at, size)
        self.used += total

    def _missing(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, hashes)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == hashes[known]
        return np.flatnonzero(~known)

    def encode(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and the first id of each row (one more entry than rows)."""
        starts, ends, rows = words(body, offsets)
        hashes, where, back = np.unique(Prefix(body).hashes(starts, ends), return_index=True, return_inverse=True)
        new = self._missing(hashes)
        if len(new) and len(self.hashes) + len(new) > MOST_WORDS:
            self.clear()
            new = np.arange(len(hashes))
        if len(new):
            spans = zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)
            data = body.tobytes()
            self._add(hashes[new], [data[a:b].decode("utf-8", "replace") for a, b in spans])
        place = np.searchsorted(self.hashes, hashes)[back]
        size = self.size[place].astype(np.int64)
        ids = self.flat[ranges(self.first[place], size)]
        return ids, np.r_[0, np.cumsum(size)][rows]


_known: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _known:
        _known[path] = WordIds(path)
    return _known[path]


def encoded(column: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, first id of each row) for slices of a text column."""
    memory = word_ids(path)
    for first, body, at in slices(column):
        yield first, *memory.encode(body, at)
