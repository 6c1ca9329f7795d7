import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from helpers import awkward_rows, frame, labelled_shingles, prose, words

from qrelia.llm import decontamination, html_main_text, lm_scoring, order_minhash, packing, quality_classifier, quality_rules, url_filter

# ---- near duplicates ------------------------------------------------------------------------------------------


def near_copies():
    base = prose(50, 200).split()
    rows = awkward_rows() + [(100, " ".join(base))]
    for i in range(1, 14):
        own = list(base)
        for k in range(i):
            own[(7 + 29 * k * (i % 3 + 1)) % len(own)] = f"new{i}{k}"
        rows.append((100 + i, " ".join(own)))
    rows.append((200, " ".join(base[100:] + base[:100])))  # the same shingles in another order
    return rows


def brute_classes(rows):
    marks = [labelled_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            place = {s: k for k, s in enumerate(marks[j])}
            common = [place[s] for s in marks[i] if s in place]
            n = order_minhash._longest_rising(np.array(common, int))
            total = len(marks[i]) + len(marks[j])
            if same or (n and n / (total - n) >= 0.8):
                root[find(i)] = find(j)
    big = 2**63 - 1
    least = collections.defaultdict(lambda: big)
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], big if d is None else d)
    return sorted((d is None, d or 0, least[find(i)]) for i, (d, _) in enumerate(rows))


def test_near_duplicates_against_brute_force(spark):
    rows = near_copies()
    got = order_minhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.class_id) for r in got) == brute_classes(rows)


def test_one_row_of_each_class_stays(spark):
    rows = near_copies()
    kept = order_minhash.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    classes = {c for _, _, c in brute_classes(rows)}
    assert sorted(2**63 - 1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(classes)
    assert order_minhash.drop_near_duplicates(frame(spark, [])).collect() == []


def test_column_names_of_the_input_do_not_clash(spark):
    names = ["k1_", "k2", "_k1", "_d", "copies_", "_copies", "least"]
    rows = frame(spark, [(1, prose(7, 40)), (2, prose(7, 40)), (3, prose(8, 40))]).withColumns({n: F.lit(i) for i, n in enumerate(names)})
    kept = order_minhash.drop_near_duplicates(rows).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3]
    assert all([r[n] for n in names] == list(range(len(names))) for r in kept)


def test_pairs_of_common_prefixes_hold_every_near_pair(spark):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(12):  # edited copies, and texts that share a passage of up to 0.9 of their length
        base = rng.integers(0, 400, 60).tolist()
        texts += [base] + [[x if rng.random() > share else 1000 + int(rng.integers(400)) for x in base] for share in (0.05, 0.1, 0.12, 0.2)]
        texts.append([*base[:50], *rng.integers(2000, 2400, 8).tolist()])
    sequences = [np.array(sorted(set(t), key=t.index), np.uint32) for t in texts]
    table = spark.createDataFrame([(i, -i, s.tobytes()) for i, s in enumerate(sequences)], "k1 long, k2 long, seq binary")
    known = spark.createDataFrame([(i, -i, len(s), i // 2) for i, s in enumerate(sequences)], "k1 long, k2 long, n long, r long")
    possible = order_minhash._possible(known, table, 0.8)
    found = {(p.a1, p.b1) for p in order_minhash._cross_pairs(order_minhash._prefixes(possible, table, 0.8), 0.8).collect()}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if i // 2 != j // 2]
    near = {(i, j) for i, j in pairs if order_minhash.aligned_similarity(sequences[i], sequences[j]) >= 0.8}
    assert len(near) > 5 and near <= found and len(found) < len(pairs) / 4


def test_marks_hold_every_key(spark):
    keys = [0, 1, -1, 2**62, -(2**63), 32_767, 32_768, 2**63 - 1]
    bits = order_minhash._marked(spark.createDataFrame([(k,) for k in keys], "k1 long"))
    slots = np.array(keys) % (len(bits) * 8)
    assert ((bits[slots >> 3] >> (slots & 7)) & 1).all() and np.unpackbits(bits).sum() == len(set(slots.tolist()))


def unrelated_rows():
    """Different texts without an id, with one id, and near copies among them."""
    base = prose(900, 100)
    return [(None, prose(901, 60)), (None, prose(902, 60)), (None, prose(903, 60)), (None, base), (None, base + " end"), (4, prose(904, 60)), (4, prose(905, 60)), (4, prose(905, 60)), (5, None), (None, "")]


def test_classes_of_unrelated_texts_with_null_or_equal_ids(spark):
    rows = unrelated_rows()
    kept = order_minhash.drop_near_duplicates(frame(spark, rows)).collect()
    base = rows[3][1]
    texts = {r.text or "" for r in kept}
    assert len(kept) == 7 and len(texts & {base, base + " end"}) == 1
    assert texts - {base, base + " end"} == {t or "" for _, t in rows} - {base, base + " end"}
    assert [r.doc_id for r in kept if not r.text] == [5]
    got = order_minhash.near_duplicates(frame(spark, rows)).collect()
    sizes = collections.Counter(r.class_key for r in got)
    assert len(got) == len(rows) and sorted(sizes.values()) == [1, 1, 1, 1, 2, 2, 2]
    assert all(r.class_size == sizes[r.class_key] for r in got)


def test_alignment_is_banded():
    a = np.arange(100, dtype=np.uint32)
    assert order_minhash.aligned_similarity(a, a) == 1
    assert order_minhash.aligned_similarity(a, np.r_[a[50:], a[:50]]) == 0
    assert order_minhash.aligned_similarity(a, a[10:]) == pytest.approx(0.9)


def test_exact_ties_are_near():
    for m in (1, 2, 7, 100, 1999):
        a = np.arange(5 * m, dtype=np.uint32)
        assert order_minhash.aligned_similarity(a, a[: 4 * m]) == 0.8
        assert order_minhash.aligned_similarity(a, a[: 4 * m - 1]) == 0
    text = prose(60, 49).split()
    one, two = ([hash(s) & 0xFFFFFFFF for s in labelled_shingles(" ".join(t))] for t in (text, [*text[:24], "other", *text[25:]]))
    assert len(one) == 45 and order_minhash.aligned_similarity(np.array(one, np.uint32), np.array(two, np.uint32)) == 0.8


def test_components_of_a_chain(spark):
    from qrelia.llm.components import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(31, 30), (30, 31)], "a long, b long")
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    assert roots == {**{i: 0 for i in range(21)}, 30: 30, 31: 30}


# ---- URLs -----------------------------------------------------------------------------------------------------


def test_urls_against_plain_rules(spark):
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"), ("block", "b.com/"), ("allow", "b.com/")]
    urls = [None, "", "no scheme", "http://", "https://A.Example.ORG/es/x?y#z", "http://example.org/es", "http://example.org/en/12", "http://example.org?x=/en/1",
            "http://notexample.org/es/", "http://x.com/de/", "http://x.com/defrost", "ftp://b.com", "http://b.com:80/", "http://a.b.com//x", "http://org", "x://y://z.org/"]

    def plain(url):
        host, path = "", ""
        if url and "://" in url:
            host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
            host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [(len(r), v == "block", r, v) for v, r in rules
                if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and (r.endswith("/") and r.count("/") == 1 or path.startswith("/" + r.split("/", 1)[1]))]
        best = max(fits, default=None)
        return url, host, path, best and best[2], best[3] if best else "allow"

    df = spark.createDataFrame([(u, "mine") for u in urls], "url string, host string")
    for limit in (10, 10**6):
        got = url_filter.filter_urls(df, rules, max_broadcast_chars=limit).select("url", "host", "path", "rule", "verdict").collect()
        assert [tuple(r) for r in got] == [plain(u) for u in urls]


# ---- HTML -----------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><a href=1>one</a></nav>
<div class="sidebar"><p>Latest, and, more and more and more and more text.</p></div><article><h1>Head &amp; more</h1><p>First  par,\n with <b>bold<br>text.<p>Second one, &eacute;, long enough.
<form><input value=x><p>Your mail</p></form><script>x()</script></article><div id="comments"><p>Reader, says, a lot of words, really.</p></div><footer>&copy; x</footer></body></html>"""


def test_main_text_of_pages(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "just text"), (5, "u", "<p>" * 3000 + "deep"), (6, "u", "<div>" * 5000 + "<p>deep, deep</p>")]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_main_text.extract_main_text(df).collect()}
    text = "Head & more First par, with bold text. Second one, é, long enough."
    assert got == {1: (text, len(text)), 2: ("", 0), 3: ("", 0), None: ("just text", 9), 5: ("deep", 4), 6: ("deep, deep", 10)}


def test_text_after_a_declaration_stays():
    for mark in ("<![x y]>", "<![ foo ]>", "<![5]>", "<![>", "<![if !IE]>", "<![endif]>", "<![if x>", "<![cdata[ x>", "<!foo [x]>", "<!>"):
        assert html_main_text.main_text(f"<article><p>First part {mark}second part.</p><p>Third, part.</p></article>") == "First part second part. Third, part."
    assert html_main_text.main_text("<p>open a <![5] b") == "open a <![5] b"
    assert html_main_text.main_text("<p>a <![5 b<p>c</p>") == "a c"


# ---- quality rules --------------------------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    w = [x.decode() for x in words(text)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    repeat = len(covered)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, len(w) < 10 or 100 * repeat > 20 * len(w)


def test_counts_against_brute_force(spark):
    rows = awkward_rows() + [(20, "a b c d e a b c d e f"), (21, "l\nl\n\n \nl"), (22, "x " * 4), (23, "# * $%&|<> é ü\u00a0x " * 4), (24, prose(8, 400) + " " + prose(8, 20))]
    got = quality_rules.quality_rules(frame(spark, rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    expected = [(d, *brute_counts(t)) for d, t in rows]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, *(r[n] for n in names)) for r in got), key=key) == sorted(expected, key=key)
    assert all(not r.kept for r in got if r.base_failed)
    assert quality_rules.quality_rules(frame(spark, [])).collect() == []


def test_counts_keep_columns_of_any_name(spark):
    names = ["_words", "_lines", "_hashes", "_unique", "words_", "lines_"]
    rows = frame(spark, [(1, prose(7, 40))]).withColumns({n: F.lit(i) for i, n in enumerate(names)})
    (row,) = quality_rules.base_counts(rows).collect()
    assert [row[n] for n in names] == list(range(len(names))) and row.n_words == 40


def test_cascade_does_not_depend_on_its_order(spark):
    df = quality_rules.base_counts(frame(spark, awkward_rows() + [(30, "BIG!! " * 5 + prose(9, 20)), (31, "a*** b*** " * 3 + prose(10, 40))]))
    rules = quality_rules.default_rules()
    names = sorted(rules)
    a = df.select("text", quality_rules.cascade(rules, names).isNull().alias("k")).collect()
    b = df.select("text", quality_rules.cascade(rules, names[::-1]).isNull().alias("k")).collect()
    assert a == b


# ---- decontamination ------------------------------------------------------------------------------------------


def test_contaminated_documents(spark):
    items = [(i, prose(300 + i, 12 + 3 * i)) for i in range(8)] + [(50, "two words"), (51, None), (52, ""), (53, prose(302, 18))]
    docs = [(i, prose(400 + i, 80)) for i in range(1, 6)] + [(None, None), (7, ""), (8, items[0][1])]
    hit = items[5][1].split()
    hit[4], hit[11], hit[20] = "x", "y", "z"
    docs += [(20, prose(1, 30) + " " + items[3][1].upper() + " " + prose(2, 30)), (21, " ".join(hit)), (21, " ".join(hit)), (22, " ".join(hit[:12])), (23, "say two words here")]
    docs += [(None, items[4][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_contamination(frame(spark, docs), bench)
    got = sorted((r.doc_id or -1, r.item_id, r.n_matched, r.n_item_words) for r in found.collect())
    low = lambda t: [w.lower() for w in words(t)]  # noqa: E731  of bytes, so A-Z only
    expected = []
    for d, t in docs:
        for i, x in items:
            a, b = low(t), low(x)
            best = max((sum(a[s + k] == b[k] for k in range(len(b)) if 0 <= s + k < len(a)) for s in range(-len(b), len(a))), default=0)
            if b and best >= 0.8 * len(b):
                expected.append((d or -1, i, best, len(b)))
    assert got == sorted(expected) and got
    clean = decontamination.decontaminate(frame(spark, docs), bench, block_chars=200)
    assert sorted(r.text or "" for r in clean.collect()) == sorted(t or "" for d, t in docs if not any(e[0] == (d or -1) for e in expected) or not t)
    assert decontamination.find_contamination(frame(spark, docs), bench.where("false")).collect() == []
    assert decontamination.decontaminate(frame(spark, []), bench).collect() == []


def test_item_cut_at_both_ends_between_others():
    item = prose(310, 20).split()
    bench = decontamination.index_benchmark([1], [" ".join(item)])
    cut = " ".join(item[1:-1])
    for texts in ([cut], [prose(311, 30), cut, prose(312, 30)], [cut, "", cut, cut]):
        body = "".join(texts).encode()
        at = np.cumsum([0, *(len(t.encode()) for t in texts)])
        row, found, start, agree = decontamination.overlaps(bench, *decontamination.names_of(np.frombuffer(body, np.uint8), at), 0.8)
        assert row.tolist() == [i for i, t in enumerate(texts) if t == cut]
        assert set(found) == {0} and set(start) == {-1} and set(agree) == {18}


def test_cleaning_keeps_columns_of_any_name(spark):
    bench = spark.createDataFrame([(i, prose(340 + i, 20)) for i in range(6)], "item_id long, text string")
    rows = frame(spark, [(i, prose(340 + i, 20) if i < 6 else prose(360 + i, 30)) for i in range(9)]).withColumns({"_text": F.lit(1), "text_": F.lit(2)})
    for block_chars in (100, 10_000):  # one block, and many
        kept = decontamination.decontaminate(rows, bench, block_chars=block_chars).collect()
        assert sorted(r.doc_id for r in kept) == [6, 7, 8] and all((r["_text"], r["text_"]) == (1, 2) for r in kept)
        found = decontamination.find_contamination(rows, bench, block_chars=block_chars).collect()
        assert sorted((r.doc_id, r.item_id) for r in found) == [(i, i) for i in range(6)]


def test_replaced_words_in_short_items():
    import itertools

    for n in range(4, 15):
        item = prose(330 + n, 40).split()[:n]
        bench = decontamination.index_benchmark([1], [" ".join(item)])
        texts = [" ".join("other" if k in out else w for k, w in enumerate(item)) for m in range(n // 5 + 1) for out in itertools.combinations(range(n), m)]
        body, at = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
        row, *_ = decontamination.overlaps(bench, *decontamination.names_of(body, at), 0.8)
        assert row.tolist() == list(range(len(texts)))


# ---- language model -------------------------------------------------------------------------------------------


def test_base_scores_and_counts(spark):
    rows = [(i, prose(500 + i % 7, 40).upper() if i % 2 else prose(500 + i % 7, 40)) for i in range(60)] + [(60, None), (None, "a b"), (1, prose(501, 40).upper())]
    got = lm_scoring.score_texts(frame(spark, rows), frequent=20, rounds=2, steps=10).collect()
    low = lambda t: [bytes(c + 32 if 65 <= c < 91 else c for c in w) for w in words(t)] + [None]
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    count = collections.Counter(x for d, t in rows if not out(d) for x in low(t))
    n, v = sum(count.values()), len(count)
    expected = []
    for d, t in rows:
        tokens = low(t)
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens)
        expected.append((-1 if d is None else d, out(d), len(tokens), sum(x in count for x in tokens), n, round(base, 6)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(expected)
    assert all(r.score < 0 for r in got)
    assert lm_scoring.score_texts(frame(spark, [])).collect() == []


def test_model_probabilities_sum_to_one():
    model = lm_scoring.Model.start(np.full(300, 1 / 300))
    sums = model.log_sums()
    for one, two in ((0, 0), (3, 200), (299, 17)):
        z = (model.predicted(np.array([one]), np.array([two])) @ model.q.T + model.b)[0]
        assert np.exp(z - sums[one, two]).sum() == pytest.approx(1, abs=1e-4)
    every = np.repeat(np.arange(300), 300), np.tile(np.arange(300), 300)
    assert np.allclose(model.log_sums_of(*every).reshape(300, 300), sums, atol=1e-4)


def test_sums_of_contexts_whose_halves_disagree():
    model = lm_scoring.Model.start(np.full(20, 1 / 20))
    model.r[0], model.r[1], model.q[:] = 0, 0, 0
    model.r[0, 0], model.r[1, 1], model.q[2, 0], model.q[3, 1] = 200, 200, 1, 1
    sums = model.log_sums()
    assert np.isfinite(sums).all()
    assert sums[0, 1] == pytest.approx(model.log_sums_of(np.array([0]), np.array([1]))[0], rel=1e-5)


def test_model_grows_with_the_corpus_and_beats_word_counts(spark, tmp_path):
    rng = np.random.default_rng(4)
    follow = rng.permutation(400)  # the next word is mostly given by the last one

    def text():
        out = [int(rng.integers(400))]
        for _ in range(120):
            out.append(int(follow[out[-1]]) if rng.random() < 0.8 else int(rng.integers(400)))
        return " ".join(f"w{x}" for x in out)

    rows = [(i, text()) for i in range(400)]
    gain, sizes = [], []
    for n in (100, 400):
        docs = frame(spark, rows[:n]).repartition(2)
        held = [r for r in lm_scoring.score_texts(docs).collect() if r.held_out]
        gain.append(sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held))
        sizes.append(lm_scoring.own_words(held[0].train_tokens))
    assert sizes[1] > sizes[0]
    assert gain[1] > gain[0] > 0


def test_training_lowers_the_loss_and_slopes_are_right():
    rng = np.random.default_rng(0)
    symbols = 150
    unigram = rng.random(symbols)
    unigram /= unigram.sum()
    model = lm_scoring.Model.start(unigram)
    model.flat = model.flat.astype(float)
    model = lm_scoring.Model(model.flat)
    one, two, target, noise = (rng.integers(0, symbols, n) for n in (30, 30, 30, 8))

    def loss(flat):
        m = lm_scoring.Model(flat)
        guess = m.predicted(one, two)
        data = (guess * m.q[target]).sum(1) + m.b[target] - np.log(8 * unigram[target])
        other = guess @ m.q[noise].T + m.b[noise] - np.log(8 * unigram[noise])
        return (np.log1p(np.exp(-data)).sum() + np.log1p(np.exp(other)).sum()) / 30

    slope = lm_scoring.nce_slope(model, one, two, target, noise, np.log(unigram))
    for i in (int(one[0]) * lm_scoring.WIDTH, symbols * lm_scoring.WIDTH + int(target[0]) * lm_scoring.WIDTH, len(slope) - 1 - 3, 2 * symbols * lm_scoring.WIDTH + 2):
        up, down = model.flat.copy(), model.flat.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        assert slope[i] == pytest.approx((loss(up) - loss(down)) / 2e-4, abs=1e-4)


def test_hashes_are_found_by_their_first_bits():
    rng = np.random.default_rng(5)
    ends = [-(2**63), -1, 0, 2**63 - 1]
    for n in (0, 1, 2, 5, 1000):
        keys = np.unique(np.r_[rng.integers(-(2**63), 2**63 - 1, n), ends[: n // 2]].astype(np.int64))
        asked = np.r_[keys, keys - 1, rng.integers(-(2**63), 2**63 - 1, 500), ends].astype(np.int64)
        at, found = lm_scoring.Places(keys).find(asked)
        assert found.tolist() == np.isin(asked, keys).tolist()
        assert (keys[at[found]] == asked[found]).all()
    crowd = np.arange(-40, 40)  # hashes that share all their first bits
    at, found = lm_scoring.Places(crowd).find(np.arange(-60, 60))
    assert found.tolist() == [-40 <= x < 40 for x in range(-60, 60)] and at[found].tolist() == list(range(80))


def test_steps_share_room_and_draw_the_same():
    rng = np.random.default_rng(6)
    unigram = rng.random(90)
    unigram /= unigram.sum()
    model, room = lm_scoring.Model.start(unigram), np.full((700, 8), np.nan, np.float32)
    for _ in range(3):  # what an earlier step left in the room does not matter
        one, two, target, noise = (rng.integers(0, 90, n) for n in (700, 700, 700, 8))
        alone = lm_scoring.nce_slope(model, one, two, target, noise, np.log(unigram).astype(np.float32))
        assert (lm_scoring.nce_slope(model, one, two, target, noise, np.log(unigram).astype(np.float32), room) == alone).all()
    total, x = np.cumsum(rng.integers(1, 9, 400)).astype(float), rng.integers(0, 2000, 300).astype(float)
    assert (lm_scoring._places(total, x) == np.searchsorted(total, x, "right")).all()


# ---- packing --------------------------------------------------------------------------------------------------


def test_pieces_are_whole_and_sequences_full(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [r for r in awkward_rows()] + [(40 + i, prose(600 + i, 30 + 17 * i)) for i in range(30)] + [(99, "it's <|endoftext|> x2 naïve\u2003É")]
    got = packing.pack_documents(frame(spark, rows), path, rows_per_salt=7).collect()
    tokenizer = Tokenizer.from_file(path)
    texts = collections.Counter()
    for _, t in rows:
        own = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for s in range(0, len(own), 4096):
            piece = own[s : s + 4096]
            texts[(s, len(piece), zlib.crc32(piece.tobytes()), len(own))] += 1
    assert collections.Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == texts
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // 4096) + 1
    assert packing.pack_documents(frame(spark, []), path).collect() == []


def test_best_filling_against_all_subsets():
    rng = np.random.default_rng(4)
    for _ in range(60):
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, 40, 5), rng.integers(1, 4, 5), strict=True)}
        sums = {0}
        for n, c in counts.items():
            sums = {s + k * n for s in sums for k in range(c + 1)}
        room = int(rng.integers(1, 120))
        filling = packing.best_filling(counts, room)
        assert sum(n * m for n, m in filling) == max(s for s in sums if s <= room)
        assert all(m <= counts[n] for n, m in filling)


# ---- quality classifier ---------------------------------------------------------------------------------------


def test_classifier_on_held_out_rows(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_classifier.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in scored)
    assert len(scored) > 5 and right >= 0.9 * len(scored)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored)


def test_classifier_edges(spark):
    docs = frame(spark, awkward_rows())
    labels = spark.createDataFrame([(3, 1), (4, 1), (6, 1), (8, 0), (None, 1), (9, None)], "doc_id long, quality int")
    got = quality_classifier.classify(docs, labels).collect()
    assert len(got) == len(awkward_rows()) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    none = quality_classifier.classify(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_classifier.classify(frame(spark, []), labels).collect() == []


def test_classifier_in_many_parts(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    one, _ = quality_classifier.train(docs, labels)
    many, _ = quality_classifier.train(docs, labels, part_rows=70)
    assert np.allclose(one[0], many[0]) and np.allclose(one[1], many[1])
    assert np.corrcoef(one[2], many[2])[0, 1] > 0.9


def test_many_rows_with_one_trusted_id(spark):
    good, bad = "Plain words stand here, one after another.", "$$$ ### ||| 99 !!! ***"
    docs = frame(spark, [(1, good)] * 300 + [(i, bad) for i in range(10, 110)] + [(None, good)] * 50)
    labels = spark.createDataFrame([(1, 1), (10, 0), (11, 0)], "doc_id long, quality int")
    got = quality_classifier.classify(docs, labels, sample_rows=20).collect()
    assert len(got) == 450
    of = lambda d: {r.score for r in got if r.doc_id == d}
    assert of(1) == of(None) and min(of(1)) > max(of(50))
    statistics = quality_classifier._statistics(docs.select("text", (docs.doc_id == 1).alias("trusted")).na.fill(False))
    assert quality_classifier._moments(statistics)[:2].tolist() == [450, 300]
    assert statistics.select("place").distinct().count() == 450


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    a, b = "Some text, here!! A|B".encode(), b"other # text"
    both = quality_classifier.features(np.frombuffer(a + b, np.uint8), np.array([0, len(a), len(a) + len(b), len(a) + len(b)]))
    alone = quality_classifier.features(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
    assert np.allclose(both[1], alone[0]) and not both[2].any()


def test_word_ids_equal_the_tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from qrelia.llm.tokens import encoded

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["", "Hello  World's\tΣΑΣ e\u0301 <|startoftext|>ab 12", None, "x\u2028y\u00a0z \u0301"]
    got = [ids[at[i] : at[i + 1]].tolist() for _, ids, at in encoded(pa.array(texts), path) for i in range(len(at) - 1)]
    tokenizer = Tokenizer.from_file(path)
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_memory_of_words_is_small_and_starts_anew(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import tracemalloc

    from qrelia.llm import tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = pa.array([" ".join(f"w{i * 400 + j}x" for j in range(500)) for i in range(100)])
    monkeypatch.setattr(tokens, "_known", {})

    def ids():
        return [found[at[i] : at[i + 1]].tolist() for _, found, at in tokens.encoded(texts, path) for i in range(len(at) - 1)]

    want = ids()
    tracemalloc.start()
    memory = tokens.WordIds(path)
    memory.encode(*tokens_of(texts))
    n = len(memory.hashes)
    held = sum(x.nbytes for x in (memory.hashes, memory.first, memory.size, memory.flat))
    current = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert n == 40_100 and held < 60 * n and current < 90 * n
    monkeypatch.setattr(tokens, "MOST_WORDS", 700)
    small = tokens.WordIds(path)
    got = []
    for row in texts.to_pylist():
        found, at = small.encode(*tokens_of(pa.array([row])))
        got.append(found[at[0] : at[1]].tolist())
        assert len(small.hashes) <= 700
    assert got == want


def tokens_of(column):
    from qrelia.llm.textarrays import raw

    return raw(column)


def paragraphs(n):
    return "".join(f"<p>{prose(60 + i, 40)}, and, so on.</p>" for i in range(n))


@pytest.mark.parametrize(
    "around",
    [
        '<div class="layout no-sidebar">{}</div>',
        '<div id=wrap class="has-banner">{}</div>',
        '<div class="related-work">{}</div>',
        '<section id="comments-policy">{}</section>',
        '<div class="page with-sidebar"><div class="sidebar"><p>Aside, text.</p></div><div class="main-header">{}</div></div>',
        '<div class="social widget">{}</div><div class="menu"><ul><li><a href=1>one</a><li><a href=2>two</a></ul></div>',
    ],
)
def test_articles_are_not_lost_by_class_names(around):
    """Pages without article or main, whose article stands in an element with an unwanted word."""
    body = paragraphs(4)
    want = re.sub(r"\s+", " ", re.sub(r"</?p>", " ", body)).strip()
    page = f"<html><body><nav><a href=1>Home</a></nav>{around.format(body)}<footer>x</footer></body></html>"
    assert html_main_text.main_text(page) == want


def test_unwanted_parts_go_where_something_else_is_the_article():
    body = paragraphs(3)
    want = re.sub(r"\s+", " ", re.sub(r"</?p>", " ", body)).strip()
    side = "<p>One, two, three words of the side.</p>"
    for word in ("sidebar", "related", "newsletter", "cookie-notice", "site-header", "promo"):
        assert html_main_text.main_text(f'<div id="content">{body}<div class="{word}">{side}</div></div>') == want
        assert html_main_text.main_text(f'<div class="{word}">{side}</div><div id="content">{body}</div>') == want
    # Reader comments may be longer than the article.
    assert html_main_text.main_text(f'<div id="content">{body}</div><div class="comments">{paragraphs(12)}</div>') == want
    assert html_main_text.main_text(f'<div id="content">{body}<p hidden>no</p><div role="navigation">{side}</div></div>') == want


def test_pages_empty_table_and_repeated_rows(spark):
    schema = "page_id long, url string, html string"
    assert html_main_text.extract_main_text(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "u", "<p>Same, page.</p>")] * 3 + [(1, None, None), (None, "u", "")]
    got = html_main_text.extract_main_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.text, r.n_chars) for r in got) == [("", 0)] * 2 + [("Same, page.", 11)] * 3
