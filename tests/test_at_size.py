"""What evaluations do with many queries and many texts: rank in tasks, count and split in Arrow."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import qrelia.operators.blocks as blocks
import qrelia.operators.encode as encode
from qrelia.functions.text import word_lists, words
from qrelia.operators import bm25, dense

ODD = "a\x1cb c 　 d\x85e f"


def best(scores, ids, k):
    """The k best (id, rank) by rounded score and id."""
    order = sorted(range(len(ids)), key=lambda i: (-round(scores[i], 9), ids[i]))
    return [(ids[i], r) for r, i in enumerate(order[:k], 1)]


def streamed(scorer, batches, k):
    ids = [b.column("doc_id") for b in batches]
    out = {}
    for r in pa.Table.from_batches(list(blocks.stream_topk(scorer, iter(batches), iter(ids), k))).to_pylist():
        out.setdefault((r["truncate_dim"], r["query_id"]), []).append((r["doc_id"], r["rank"]))
    return out


@pytest.mark.parametrize("cells,tied", [(1 << 18, False), (90, False), (90, True)])
def test_few_cells_of_a_stream_are_scored_in_double_precision(monkeypatch, cells, tied):
    rng = np.random.default_rng(2)
    vectors, asked = rng.normal(size=(3_000, 5)), rng.normal(size=(30, 5))
    if tied:
        vectors = vectors[rng.integers(0, 40, len(vectors))]
    asked[3] = 0  # every score of this query is 0
    ids = [f"d{i:04d}" for i in range(3_000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + 700]), pa.array(vectors[i : i + 700].tolist())], names=["doc_id", "vector"]) for i in range(0, 3_000, 700)]
    scorer = dense.DenseScorer(pa.table({"query_id": [f"q{i}" for i in range(30)], "vector": asked.tolist()}), (5, 2))
    monkeypatch.setattr(blocks, "PIECE_CELLS", cells)
    whole, alone = [], []
    exact, at = dense.DensePiece.exact, dense.DensePiece.at
    monkeypatch.setattr(dense.DensePiece, "exact", lambda self: whole.append(exact(self).size) or exact(self))
    monkeypatch.setattr(dense.DensePiece, "at", lambda self, c, m: alone.append(len(c)) or at(self, c, m))
    got = streamed(scorer, batches, 7)
    for dim in (5, 2):
        scores = dense.unit_rows(asked[:, :dim]) @ dense.unit_rows(vectors[:, :dim]).T
        assert {q: got[dim, f"q{q}"] for q in range(30)} == {q: best(scores[q], ids, 7) for q in range(30)}
    if cells == 90 and not tied:
        assert sum(whole) + sum(alone) < 2 * 30 * 3_000 / 4


@pytest.mark.parametrize("padded", [True, False])
@pytest.mark.parametrize("common", [500, 0, 10**9])  # all three ways to share terms between matrix and sums
def test_streamed_bm25_equals_scores_of_all_pairs(monkeypatch, padded, common):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [rng.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=rng.randrange(25)) for _ in range(900)]
    texts[5], texts[500] = texts[77], texts[77]
    asked = [rng.choices([*vocabulary, "unknown"], k=rng.randrange(9)) for _ in range(25)]
    weight = {w: 0.0 if i == 0 else i / 7 for i, w in enumerate(vocabulary)}  # a weight of 0 is a match, too
    ids = [f"d{i:03d}" for i in range(900)]
    norm = [1.5 * (0.25 + 0.75 * len(t) / 12) for t in texts]
    batches = []
    for i in range(0, 900, 250):
        counted = [Counter(t) for t in texts[i : i + 250]]
        batches.append(pa.RecordBatch.from_arrays([pa.array(ids[i : i + 250]), pa.array([sorted(c) for c in counted], pa.list_(pa.string())), pa.array([[c[w] for w in sorted(c)] for c in counted], pa.list_(pa.int32())), pa.array(norm[i : i + 250])], names=["doc_id", "terms", "tfs", "norm"]))
    used = [Counter(w for w in a if w in weight) for a in asked]
    queries = pa.table({"query_id": [f"q{i}" for i in range(25)], "terms": pa.array([list(u) for u in used], pa.list_(pa.string())), "weights": pa.array([[u[w] * weight[w] for w in u] for u in used], pa.list_(pa.float64()))})
    monkeypatch.setattr(blocks, "PIECE_CELLS", 800)
    monkeypatch.setattr(bm25, "_COMMON_PIECES", common or 1e-9)
    monkeypatch.setattr(bm25, "_POSTINGS_PER_SLICE", 40)
    got = streamed(bm25.Bm25Scorer(queries, only_matches=not padded), batches, 20)
    for q, u in enumerate(used):
        tf = [Counter(t) for t in texts]
        scores = [sum(u[w] * weight[w] * c[w] * 2.5 / (c[w] + n) for w in u) for c, n in zip(tf, norm)]
        kept = range(900) if padded else [i for i in range(900) if set(u) & set(tf[i])]
        assert got.get((-1, f"q{q}"), []) == best([scores[i] for i in kept], [ids[i] for i in kept], 20)


def test_ranks_of_many_queries_come_from_their_tasks(spark, monkeypatch):
    """Nothing is shuffled to rank a large run; rows of an id that repeats are still one list."""
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(f"d{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))], "doc_id string, vector array<double>").repartition(7)
    points = [(f"q{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(20, 4)))]
    schema = "query_id string, vector array<double>"
    want = [set(dense.dense_rank(docs, spark.createDataFrame(p, schema), 9, [4]).select("query_id", "doc_id", "rank").collect()) for p in (points, points + [("q0", points[1][1])])]
    monkeypatch.setattr(blocks, "MANY_QUERIES", 1)
    monkeypatch.setattr(blocks, "FEW_ROWS", 0)
    ranked = []
    real = blocks.rank_topk
    monkeypatch.setattr(blocks, "rank_topk", lambda *args, **kwargs: ranked.append(1) or real(*args, **kwargs))
    for p, rows, n in ((points, want[0], 0), (points + [("q0", points[1][1])], want[1], 1)):
        run = dense.dense_rank(docs, spark.createDataFrame(p, schema), 9, [4])
        assert set(run.select("query_id", "doc_id", "rank").collect()) == rows and dict(run.dtypes)["rank"] == "int"
        assert len(ranked) == n


def test_arrow_splits_as_spark_does(spark):
    texts = ["", " ", "a  b\n", ODD, None, "É ü ", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", words(F.col("t")).alias("w"))
    want = {r["t"]: r["w"] or [] for r in df.collect()}
    assert dict(zip(texts, word_lists(pa.array(texts)).to_pylist())) == want
    assert word_lists(pa.array([], pa.string())).to_pylist() == []


def test_a_task_counts_each_term_once(spark, monkeypatch):
    texts = ["the cat the", "The dog", "", ODD, None, "cat"] * 50
    batch = pa.RecordBatch.from_arrays([pa.array([t and t.lower() for t in texts])], names=["text"])
    rows = [r for b in bm25._count_documents(iter([batch] * 3)) for r in b.to_pylist()]
    assert max(Counter(r["term"] for r in rows).values()) == 1
    for held in (bm25._HELD_TERMS, 3):  # counts that are sent on early are added up by Spark
        monkeypatch.setattr(bm25, "_HELD_TERMS", held)
        again = Counter()
        for r in (r for b in bm25._count_documents(iter([batch] * 3)) for r in b.to_pylist()):
            again[r["term"]] += r["df"]
        assert again == {r["term"]: r["df"] for r in rows}
    corpus = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(3)
    got = {r["term"]: (r["df"], r["tokens"]) for r in bm25.bm25_terms(corpus).collect()}
    assert got == {**{w: (50, 0) for w in "abcdef"}, "the": (100, 0), "cat": (100, 0), "dog": (50, 0), None: (250, 600)}


def test_a_different_word_is_looked_up_once(monkeypatch):
    asked = []
    real = hashlib.md5
    monkeypatch.setattr(encode.hashlib, "md5", lambda data: asked.append(data) or real(data))
    texts = ["a B a", "", "b  a c", "C"]
    got = encode.hashing_encoder(5)()(texts)
    assert sorted(asked) == [b"a", b"b", b"c"]
    want = np.zeros((4, 5))
    for i, t in enumerate(texts):
        for w in t.lower().split():
            digest = real(w.encode()).hexdigest()
            want[i, int(digest[:8], 16) % 5] += 1 - 2 * (int(digest[8], 16) % 2)
    assert (got == want).all()
