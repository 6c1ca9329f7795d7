import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import WORD, awkward_rows, frame, prose, words
from hypothesis import given, settings
from hypothesis import strategies as st

from qrelia.llm import repeats, textarrays
from qrelia.llm import substring_dedup as substrings
from qrelia.llm import suffix_dedup as suffixes


def brute_words(rows, width):
    first = {}
    big = 2**63 - 1
    tokens = [(big if d is None else d, words(t)) for d, t in rows]
    for d, w in tokens:
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, big), d)
    out = []
    for (d, _), (v, w) in zip(rows, tokens, strict=True):
        cut = bytearray(len(w))
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < v:
                cut[i : i + width] = b"\1" * width
        kept = b" ".join(x for x, c in zip(w, cut, strict=True) if not c)
        out.append((d, len(w), sum(cut), hashlib.sha256(kept).hexdigest()))
    return out


def brute_bytes(rows, width):
    bodies = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + width] for b in bodies for i in range(len(b) - width + 1))
    out = []
    for (d, _), b in zip(rows, bodies, strict=True):
        cut = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                cut[i : i + width] = b"\1" * width
        kept = bytes(x for x, c in zip(b, cut, strict=True) if not c)
        out.append((d, len(b), sum(cut), len(re.findall(b"\x01+", bytes(cut))), hashlib.sha256(kept).hexdigest()))
    return out


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("in_task", [5000, 1])
def test_words_against_brute_force(spark, in_task):
    rows = awkward_rows()
    got = substrings.substring_dedup(frame(spark, rows), finish=substrings.digest_words, fields=substrings.DIGEST, spans_in_task=in_task)
    assert _sorted(got.collect()) == _sorted(brute_words(rows, 50))


@pytest.mark.parametrize("in_task", [5000, 1])
def test_bytes_against_brute_force(spark, in_task):
    rows = awkward_rows()
    got = suffixes.suffix_dedup(frame(spark, rows), finish=suffixes.digest_bytes, fields=suffixes.DIGEST, spans_in_task=in_task)
    assert _sorted(got.collect()) == _sorted(brute_bytes(rows, 400))


def test_edits_near_each_other(spark):
    base = prose(20, 400).split()
    rows = []
    for i in range(12):
        own = list(base)
        for k in range(i, len(own), 37 + i):
            own[k] = f"edit{i}x{k}"
        rows.append((100 - i, " ".join(own)))
    got = substrings.substring_dedup(frame(spark, rows), width=20, finish=substrings.digest_words, fields=substrings.DIGEST)
    assert _sorted(got.collect()) == _sorted(brute_words(rows, 20))
    got = suffixes.suffix_dedup(frame(spark, rows), width=150, finish=suffixes.digest_bytes, fields=suffixes.DIGEST)
    assert _sorted(got.collect()) == _sorted(brute_bytes(rows, 150))


def test_empty_table(spark):
    empty = frame(spark, [])
    assert substrings.substring_dedup(empty).collect() == []
    assert suffixes.suffix_dedup(empty).collect() == []


def test_kept_text_leaves_whole_characters():
    text = np.frombuffer("aéb".encode(), np.uint8)
    assert suffixes.kept_text(text, None, (np.array([2]), np.array([4])))[0] == "aé"
    assert suffixes.kept_text(text, None, (np.array([0]), np.array([2]))) == ("éb", 2)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=6))
def test_words_of_slices(bodies):
    column = pa.array(bodies, pa.binary())
    for first, body, at in textarrays.slices(column, 50):
        starts, ends, rows = textarrays.words(body, at)
        for i in range(len(at) - 1):
            own = [body[a:b].tobytes() for a, b in zip(starts[rows[i] : rows[i + 1]], ends[rows[i] : rows[i + 1]], strict=True)]
            assert own == WORD.findall(bodies[first + i])


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=120).map(lambda b: bytes(x % 3 for x in b)), st.integers(1, 30))
def test_interleave_numbers_windows_in_order(body, width):
    n = max(len(body) - width + 1, 0)
    block, depth = suffixes.interleave(np.frombuffer(body, np.uint8), np.arange(n), width)
    windows = [body[i : i + width] for i in range(n)]
    rank = {w: k for k, w in enumerate(sorted(set(windows)))}
    assert block.tolist() == [rank[w] for w in windows]
    count = Counter(windows)
    assert [d == width for d in depth] == [count[w] > 1 for w in windows]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["the", "of", "a", "bb", "c"]), max_size=200), st.integers(5, 30))
def test_every_window_has_one_owner(tokens, width):
    body = np.frombuffer(" ".join(tokens).encode(), np.uint8)
    p = substrings.parse_words(body, np.array([0, len(body)]), repeats.ANCHORS)
    _, s0, s1 = repeats.owned(p, width)
    alone = repeats.bare(p, width, s0, s1)
    windows = sorted([*textarrays.ranges(s0, s1 - s0 + 1).tolist(), *alone.tolist()])
    assert windows == list(range(max(len(tokens) - width + 1, 0)))


@pytest.mark.parametrize("least", [None, 1])
def test_very_many_equal_rows(spark, least):
    """Equal rows with a null id, beside others, and for one case a row of the same text with a smaller id."""
    text = prose(40, 900)
    some = [(5, prose(41, 200)), (6, prose(42, 100) + " " + " ".join(text.split()[300:600])), (least, text), (None, text)]
    rows = [(None, text)] * 1600 + some
    df = frame(spark, rows).repartition(8)
    few = brute_words(some, 50)  # more equal rows change nothing here
    got = substrings.substring_dedup(df, finish=substrings.digest_words, fields=substrings.DIGEST).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == set(few)
    cut = suffixes.suffix_dedup(df, finish=suffixes.digest_bytes, fields=suffixes.DIGEST).collect()
    assert len(cut) == len(rows)
    assert {tuple(r) for r in cut} == set(brute_bytes(some, 400))


def test_ranking_takes_few_bytes_for_each_byte_of_text():
    """What a Python worker keeps at its largest; ranks of all lengths in 64 bits took 150 bytes."""
    import tracemalloc

    body = np.random.default_rng(4).integers(97, 100, 200_000).astype(np.uint8)
    tracemalloc.start()
    suffixes.interleave(body, np.arange(len(body) - 400), 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * len(body)
