import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import qrelia.operators.blocks as blocks
import qrelia.operators.joins as joins
import qrelia.operators.positions as positions
from qrelia.operators import bm25, dense, ranking
from qrelia.operators.joins import lookup_join
from qrelia.operators.positions import nth_position, with_row_position


def brute_bm25(corpus, queries):
    """Scores of all documents for all queries."""
    tf = {d: Counter(t.lower().split()) for d, t in corpus.items()}
    length = {d: sum(c.values()) for d, c in tf.items()}
    n, mean = len(corpus), sum(length.values()) / len(corpus)
    df = Counter(w for c in tf.values() for w in c)
    idf = {w: math.log(n - x + 0.5) - math.log(x + 0.5) for w, x in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: x if x >= 0 else low for w, x in idf.items()}
    out = {}
    for q, text in queries.items():
        for d in corpus:
            out[q, d] = sum(
                idf.get(w, 0) * tf[d][w] * 2.5 / (tf[d][w] + 1.5 * (0.25 + 0.75 * length[d] / mean))
                for w in text.lower().split()
            )
    return out


def brute_rank(scores, queries, docs, k):
    return {
        q: sorted(docs, key=lambda d: (-round(scores[q, d], 9), d))[:k] for q in queries
    }


def random_corpus(n=60, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    def text(m):
        return " ".join(rng.choices(words, weights, k=rng.randrange(m)))
    docs = {f"d{i}": text(20) for i in range(n)}
    docs["empty"], docs["copy"] = "", docs["d1"]
    queries = {f"q{i}": text(8) for i in range(9)} | {"none": "", "unknown": "zz zz"}
    return docs, queries


def ranked(run):
    out = {}
    for r in run.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], round(r["score"], 9)))
    return out


@pytest.mark.parametrize("k,cells,postings", [(5, 4_000_000, 2_000_000), (100, 4_000_000, 2_000_000), (7, 40, 9)])
def test_bm25_against_brute_force(spark, monkeypatch, k, cells, postings):
    monkeypatch.setattr(bm25, "MATRIX_CELLS", cells)
    monkeypatch.setattr(bm25, "_POSTINGS_PER_SLICE", postings)
    docs, queries = random_corpus()
    corpus = spark.createDataFrame(list(docs.items()), "doc_id string, text string").repartition(3)
    asked = spark.createDataFrame(list(queries.items()), "query_id string, text string")
    got = ranked(bm25.bm25_rank(corpus, asked, k))
    scores = brute_bm25(docs, queries)
    want = brute_rank(scores, queries, docs, k)
    assert set(got) == set(queries)
    for q, rows in got.items():
        assert [d for _, d, _ in rows] == want[q]
        assert [r for r, _, _ in rows] == list(range(1, len(rows) + 1))
        for _, d, s in rows:
            assert s == pytest.approx(scores[q, d], abs=1e-9)


def test_bm25_without_padding(spark):
    docs, queries = random_corpus()
    corpus = spark.createDataFrame(list(docs.items()), "doc_id string, text string")
    asked = spark.createDataFrame(list(queries.items()), "query_id string, text string")
    got = ranked(bm25.bm25_rank(corpus, asked, 100, pad_zero_scores=False))
    scores = brute_bm25(docs, queries)
    for q in queries:
        assert {d for _, d, _ in got.get(q, [])} == {d for d in docs if scores[q, d] != 0}


@pytest.mark.parametrize(
    "docs,want",
    [
        ({"a": "a", "b": "a", "c": "a", "d": ""}, ["a", "b"]),  # negative weights rank below 0
        ({"a": "a", "b": "a", "c": "b", "d": "c"}, ["a", "b"]),  # the term's weight is exactly 0
        ({"a": "b", "b": "c", "c": "a"}, ["c"]),
    ],
)
def test_matches_are_found_whatever_their_weight(spark, docs, want):
    corpus = spark.createDataFrame(list(docs.items()), "doc_id string, text string")
    asked = spark.createDataFrame([("q", "a")], "query_id string, text string")
    got = ranked(bm25.bm25_rank(corpus, asked, 2, pad_zero_scores=False))["q"]
    assert [(r, d) for r, d, _ in got] == list(enumerate(want, 1))


@pytest.mark.parametrize("k,limit,levels", [(3, "1000", True), (60, "50", False), (1500, "1000", False)])
def test_two_levels_give_the_same_ranks(spark, k, limit, levels):
    rows = [(q, f"d{i:04d}", float(i * 7 % 13)) for q in "ab" for i in range(2000)]
    df = spark.createDataFrame(rows, "query_id string, doc_id string, score double").repartition(9)
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", limit)
    try:
        got = ranking.rank_topk(df, k, two_levels=levels).collect()
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    for q in "ab":
        want = sorted(((-s, d) for x, d, s in rows if x == q))[:k]
        assert [r["doc_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [d for _, d in want]


def test_tiny_corpus_with_negative_mean_idf(spark):
    docs = {"b": "x y", "a": "x y", "c": "x"}
    corpus = spark.createDataFrame(list(docs.items()), "doc_id string, text string")
    asked = spark.createDataFrame([("q", "x")], "query_id string, text string")
    got = ranked(bm25.bm25_rank(corpus, asked, 3))
    scores = brute_bm25(docs, {"q": "x"})
    assert [d for _, d, _ in got["q"]] == brute_rank(scores, ["q"], docs, 3)["q"]


def test_many_query_blocks_give_the_same_run(spark, monkeypatch):
    docs, queries = random_corpus()
    corpus = spark.createDataFrame(list(docs.items()), "doc_id string, text string")
    asked = spark.createDataFrame(list(queries.items()), "query_id string, text string")
    one = ranked(bm25.bm25_rank(corpus, asked, 10))
    monkeypatch.setattr(blocks, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 2)
    assert ranked(bm25.bm25_rank(corpus, asked, 10)) == one


def test_empty_corpus_and_no_queries(spark):
    corpus = spark.createDataFrame([("d", "x y")], "doc_id string, text string")
    asked = spark.createDataFrame([("q", "x")], "query_id string, text string")
    assert bm25.bm25_rank(corpus.limit(0), asked, 5).count() == 0
    assert bm25.bm25_rank(corpus, asked.limit(0), 5).count() == 0


@pytest.mark.parametrize("cells", [4_000_000, 30])
def test_dense_against_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(dense, "MATRIX_CELLS", cells)
    rng = np.random.default_rng(5)
    docs, queries = rng.normal(size=(70, 6)), rng.normal(size=(8, 6))
    docs[3] = 0
    docs[10] = docs[11]
    corpus = spark.createDataFrame([(f"d{i}", v.tolist()) for i, v in enumerate(docs)], "doc_id string, vector array<float>").repartition(4)
    asked = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(queries)], "query_id string, vector array<float>")
    run = dense.dense_rank(corpus, asked, 12, [6, 3, 50])

    def unit(m):
        m = m.astype(np.float32).astype(float)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(norm > 0, norm, 1)

    for dim in (6, 3, 50):
        scores = unit(queries[:, :dim]) @ unit(docs[:, :dim]).T
        table = {(f"q{i}", f"d{j}"): scores[i, j] for i in range(8) for j in range(70)}
        want = brute_rank(table, [f"q{i}" for i in range(8)], [f"d{j}" for j in range(70)], 12)
        got = ranked(run.where(F.col("truncate_dim") == dim))
        assert {q: [d for _, d, _ in rows] for q, rows in got.items()} == want


def test_vectors_of_different_length_are_an_error(spark):
    corpus = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "doc_id string, vector array<double>").coalesce(1)
    asked = spark.createDataFrame([("q", [1.0, 2.0])], "query_id string, vector array<double>")
    with pytest.raises(Exception, match="differ in length"):
        dense.dense_rank(corpus, asked, 1, [2]).collect()


def test_rank_topk_same_for_any_partitioning_and_large_k(spark):
    rng = random.Random(1)
    rows = [(f"q{rng.randrange(3)}", f"d{i}", float(rng.randrange(5))) for i in range(300)]
    df = spark.createDataFrame(rows, "query_id string, doc_id string, score double")
    runs = [set(ranking.rank_topk(df.repartition(n), 40).collect()) for n in (1, 3, 8)]
    assert runs[0] == runs[1] == runs[2]
    spark.conf.set("spark.sql.window.group.limit.threshold", "10")
    try:
        assert set(ranking.rank_topk(df, 40).collect()) == runs[0]
    finally:
        spark.conf.unset("spark.sql.window.group.limit.threshold")


@pytest.mark.parametrize("how", ["inner", "left", "semi", "anti"])
@pytest.mark.parametrize("bound", [1_000, 0])
def test_lookup_join_with_a_hot_key(spark, monkeypatch, how, bound):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(joins, "HOT_SHARE", 5)
    rows = [(i, "hot" if i % 3 else f"k{i % 40}") for i in range(400)] + [(900, None), (901, "no match")]
    left = spark.createDataFrame(rows, "i int, key string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("k6", 3), ("unused", 4)], "key string, v int")
    got = lookup_join(left, right, "key", how)
    plain = {"semi": "left_semi", "anti": "left_anti"}.get(how, how)
    want = left.join(right, "key", plain).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_row_positions_and_cutoffs(spark, monkeypatch):
    df = spark.range(500).select((F.col("id") * 7 % 1009).alias("pos"))
    rows = with_row_position(df, ["pos"], "n").orderBy("n").collect()
    values = [r["pos"] for r in rows]
    assert values == sorted(values) and [r["n"] for r in rows] == list(range(500))
    assert nth_position(df, "pos", 1) == values[0]
    assert nth_position(df, "pos", 500) == values[-1]
    assert nth_position(df, "pos", 501) is None
    monkeypatch.setattr(positions, "HEAP_ROWS", 10)
    assert nth_position(df, "pos", 77) == values[76]
    assert nth_position(df, "pos", 501) is None


def test_cumulative_hits(spark):
    run = spark.createDataFrame([("q", f"d{i}", i) for i in range(1, 6)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "d2", 1), ("q", "d4", 3), ("q", "d5", 0)], "query_id string, doc_id string, score int")
    rows = ranking.cumulative_hits(ranking.join_run_qrels(run, qrels)).orderBy("rank").collect()
    assert [(r["rel"], r["hits"]) for r in rows] == [(0, 0), (1, 1), (0, 1), (1, 2), (0, 2)]


@pytest.mark.parametrize("tied", [False, True])
def test_floors_cut_what_tasks_emit(spark, monkeypatch, tied):
    """64 splits: without floors every task would send k rows per query."""
    rng = np.random.default_rng(4)
    k, n_splits, n_queries = 10, 64, 12
    vectors = rng.normal(size=(64 * 60, 4))
    if tied:  # a handful of different vectors, so that nearly every score is tied
        vectors = vectors[rng.integers(0, 9, len(vectors))]
    docs = [(f"d{i:05d}", v.tolist()) for i, v in enumerate(vectors)]
    queries = [(f"q{i}", rng.normal(size=4).tolist()) for i in range(n_queries)]
    corpus = spark.createDataFrame(docs, "doc_id string, vector array<double>").repartition(n_splits)
    asked = spark.createDataFrame(queries, "query_id string, vector array<double>")
    emitted = []
    real = blocks.candidates

    def counted(*args, **kwargs):
        out = real(*args, **kwargs)
        emitted.append(out.count())
        return out

    monkeypatch.setattr(blocks, "candidates", counted)
    assert blocks.estimated_splits(corpus) == 1  # nothing is known of its size
    want = ranked(dense.dense_rank(corpus, asked, k))
    monkeypatch.setattr(blocks, "estimated_splits", lambda df: n_splits)
    assert ranked(dense.dense_rank(corpus, asked, k)) == want
    free, pilot, bounded = emitted
    assert free >= n_splits * k * n_queries * 0.9
    assert pilot <= blocks.PILOT_SPLITS * 60 * n_queries
    assert bounded < free / 4


def test_floors_with_padding_and_short_lists(spark, monkeypatch):
    """Queries with fewer matches than k are filled by id: all those scores are tied at 0."""
    docs, queries = random_corpus(400)
    corpus = spark.createDataFrame(list(docs.items()), "doc_id string, text string").repartition(64)
    asked = spark.createDataFrame(list(queries.items()), "query_id string, text string")
    scores = brute_bm25(docs, queries)
    want = brute_rank(scores, queries, docs, 30)
    monkeypatch.setattr(blocks, "estimated_splits", lambda df: 64)
    got = ranked(bm25.bm25_rank(corpus, asked, 30))
    assert {q: [d for _, d, _ in rows] for q, rows in got.items()} == want
    short = ranked(bm25.bm25_rank(corpus, asked, 10_000, pad_zero_scores=False))
    assert {q: {d for _, d, _ in rows} for q, rows in short.items()} == {q: m for q in queries if (m := {d for d in docs if scores[q, d] != 0})}


def test_floors_compare_ids_as_bytes():
    import pyarrow as pa

    found = pa.table({"truncate_dim": [4], "query_id": ["b"], "score": [1.0], "doc_id": ["é"]})
    floors = blocks.Floors(found, pa.array(["a", "b"]))
    ids = sorted(x.encode() for x in ["z", "é", "ö", "a"])
    scores = np.array([[0.0, 1.0, 2.0, 0.5], [1.0, 1.0, 1.0, 1.0]])
    assert floors.reached(4, scores, ids).tolist() == [[True] * 4, [True, True, True, False]]
    assert floors.reached(8, scores, ids).all()
    assert not floors.reached(4, scores - 1.5, ids)[1].any()


@pytest.mark.parametrize("tied", [False, True])
def test_many_queries_are_ranked_in_one_task_each(spark, monkeypatch, tied):
    """Queries dealt over tasks that read all documents: the same rows, and no more than k of a query are emitted."""
    docs, queries = random_corpus(400)
    if tied:  # a few texts only, so that most scores are equal
        docs = {d: docs[sorted(docs)[i % 7]] for i, d in enumerate(docs)}
    corpus = spark.createDataFrame(list(docs.items()), "doc_id string, text string").repartition(9)
    asked = spark.createDataFrame([*queries.items(), ("none", ""), ("null", None)], "query_id string, text string")
    rng = np.random.default_rng(6)
    vectors = corpus.select("doc_id", F.array(*[F.length("text") % p for p in (2, 3, 5)]).cast("array<double>").alias("vector"))
    points = spark.createDataFrame([(f"q{i}", rng.normal(size=3).tolist()) for i in range(40)], "query_id string, vector array<double>")
    k = 30
    runs = {
        "padded": lambda: bm25.bm25_rank(corpus, asked, k),
        "short": lambda: bm25.bm25_rank(corpus, asked, 500, pad_zero_scores=False),
        "dense": lambda: dense.dense_rank(vectors, points, k, [3, 2]),
    }
    want = {name: ranked(run()) for name, run in runs.items()}
    emitted = []
    real = blocks.stream_queries

    def counted(*args, **kwargs):
        out = real(*args, **kwargs)
        emitted.append(out.count())
        return out

    monkeypatch.setattr(blocks, "stream_queries", counted)
    monkeypatch.setattr(blocks, "MANY_QUERIES", 1)
    monkeypatch.setattr(blocks, "STREAM_QUERIES", 7)
    monkeypatch.setattr(blocks, "STREAM_ROWS", 64)
    got = {name: ranked(run()) for name, run in runs.items()}
    for name, rows in want.items():
        assert {q: [d for _, d, _ in r] for q, r in got[name].items()} == {q: [d for _, d, _ in r] for q, r in rows.items()}
        for q, r in rows.items():
            assert [s for _, _, s in got[name][q]] == pytest.approx([s for _, _, s in r], abs=1e-9)
    assert emitted[0] == k * (len(queries) + 2) and emitted[2] == 2 * k * 40


def test_a_task_emits_only_its_best_rows():
    """Documents that get better and better: k rows of a query leave the task, not k of every batch."""
    import pyarrow as pa

    weights = pa.table({"query_id": ["q", "r"], "vector": [[1.0], [-1.0]]})
    batches = [pa.RecordBatch.from_arrays([pa.array([f"d{i:03d}-{j:02d}" for j in range(50)]), pa.array([[1.0, (i * 50 + j) / 1000] for j in range(50)])], names=["doc_id", "vector"]) for i in range(40)]

    class Plain(dense.DenseScorer):
        def matrices(self, batch):
            yield 1, 0, np.outer([1.0, -1.0], dense.to_matrix(batch.column("vector"))[:, 1])

    out = pa.Table.from_batches(blocks.emit_topk(Plain(weights, [1]), iter(batches), 10))
    assert out.num_rows == 20
    rows = out.to_pylist()
    assert [r["doc_id"] for r in rows if r["query_id"] == "q"] == [f"d039-{j:02d}" for j in range(49, 39, -1)]
    assert [r["doc_id"] for r in rows if r["query_id"] == "r"] == [f"d000-{j:02d}" for j in range(10)]
