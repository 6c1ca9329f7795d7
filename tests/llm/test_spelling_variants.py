import collections
import random
import re
import zlib

import pytest
from helpers import frame

from qrelia.llm import spelling_variants as sv

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows, every=199):
    counts = collections.Counter()
    for d, t in rows:
        for run in RUN.findall(t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out)


def wordy_rows():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    rows = [(None, None), (1, ""), (2, "x" * 3000), (2, "x" * 2999 + "y"), (3, "É×÷ÿ")]
    for i in range(400):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = base[min(int(rng.expovariate(0.08)), 59)]
            if rng.random() < 0.2:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abÀ") + w[k:], w[:k] + "c" + w[k + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((None if i % 17 == 0 else i % 150, rng.choice([" ", "1", "-", "Ā"]).join(words)))
    rows.append((903, "chainaaa " * 250 + "chainaab " * 50 + "chainabb " * 10))
    return rows + rows[:30] + [(900, "x" * 3000)] * 5 + [(901, "x" * 2999)] * 5 + [(902, "x" * 1499 + "y" + "x" * 1500)] * 5


def listed(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants_against_brute_force(spark):
    rows = wordy_rows()
    want = brute_variants(brute_counts(rows))
    assert sum(1 for r in want if r[1]) > 20 and any(r[2] not in (r[0], r[1]) for r in want)
    assert listed(sv.spelling_variants(frame(spark, rows), damage_every=199)) == want


def test_undamaged_words_and_reordered_input(spark):
    rows = wordy_rows()
    want = brute_variants(brute_counts(rows, every=None))
    assert listed(sv.spelling_variants(frame(spark, rows[::-1]).repartition(7))) == want


@pytest.mark.parametrize("bound", [2, 5, 40])
def test_crowded_keys_are_cut_into_finer_ones(spark, bound):
    counts = brute_counts(wordy_rows())
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n long")
    sizes = sv.blocks(vocabulary, block_words=bound).groupBy("k", "m", "lo", "hi").count()
    assert sizes.where((sizes["count"] > bound) & (sizes["hi"] - sizes["lo"] > 1)).isEmpty()
    assert listed(sv.group_variants(vocabulary, block_words=bound)) == brute_variants(counts)


def test_every_pair_is_found_once(spark):
    words = ["aaaaaa", "aaaaaaa", "aaaaab", "aabaaa", "baaaaa", "aaaaaaaa", "abcdef", "bacdef", "bcdefé"]
    vocabulary = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = sorted(tuple(sorted((r.a, r.b))) for r in sv.near_words(vocabulary).collect())
    assert got == sorted(tuple(sorted((a, b))) for i, a in enumerate(words) for b in words[:i] if one_edit(a, b))


def test_no_words(spark):
    assert sv.spelling_variants(frame(spark, [])).collect() == []
    assert sv.spelling_variants(frame(spark, [(1, None), (None, "short words only")])).collect() == []
