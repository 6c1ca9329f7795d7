import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_ranking import brute_bm25, brute_rank, random_corpus, ranked

from qrelia.operators import blocks, bm25, bm25_store
from qrelia.operators.metrics import Cutoffs
from qrelia.plans.evaluate import evaluate_bm25
from qrelia.sources.retrieval import RetrievalSpec, load_spec


def frames(spark, docs, queries, parts=5):
    corpus = spark.createDataFrame(list(docs.items()), "doc_id string, text string").repartition(parts)
    return corpus, spark.createDataFrame(list(queries.items()), "query_id string, text string")


@pytest.mark.parametrize("k", [7, 1000])
def test_stored_index_against_brute_force(spark, tmp_path, k):
    docs, queries = random_corpus(300)
    corpus, asked = frames(spark, docs, queries)
    index = bm25_store.stored_index(corpus, str(tmp_path), "one")
    got = ranked(bm25_store.rank_by_index(index, asked, k))
    scores = brute_bm25(docs, queries)
    assert {q: [d for _, d, _ in rows] for q, rows in got.items()} == brute_rank(scores, queries, docs, k)
    for q, rows in got.items():
        assert [s for _, _, s in rows] == pytest.approx([scores[q, d] for _, d, _ in rows], abs=1e-9)
    bare = ranked(bm25_store.rank_by_index(index, asked, k, pad_zero_scores=False))
    assert bare == ranked(bm25.bm25_rank(corpus, asked, k, pad_zero_scores=False))


@pytest.mark.parametrize("docs", [{"b": "x y", "a": "x y", "c": "x"}, {"a": "a", "b": "a", "c": "a", "d": ""}, {"a": "a", "b": "a", "c": "b", "d": "c"}])
def test_negative_and_zero_weights(spark, tmp_path, docs):
    queries = {"q": "a x", "r": "y a a", "none": ""}
    corpus, asked = frames(spark, docs, queries, 3)
    index = bm25_store.stored_index(corpus, str(tmp_path), "one")
    for k in (1, 2, 4):
        assert ranked(bm25_store.rank_by_index(index, asked, k)) == ranked(bm25.bm25_rank(corpus, asked, k))
        assert ranked(bm25_store.rank_by_index(index, asked, k, False)) == ranked(bm25.bm25_rank(corpus, asked, k, False))


def test_no_documents(spark, tmp_path):
    corpus, asked = frames(spark, {"a": "x"}, {"q": "x"})
    index = bm25_store.stored_index(corpus.limit(0), str(tmp_path), "none")
    assert bm25_store.rank_by_index(index, asked, 5).collect() == []


def test_blocks_are_skipped(spark, tmp_path):
    """Topics live in their own blocks, as in a corpus that is stored by source."""
    rng = random.Random(8)
    docs = {}
    for topic in range(40):
        for i in range(30):
            words = [f"t{topic}w{int(rng.expovariate(0.3))}" for _ in range(rng.randint(3, 20))] + ["common"]
            docs[f"d{topic:02d}-{i:02d}"] = " ".join(words)
    queries = {f"q{j}": f"t{j}w0 t{j}w2 common" for j in (3, 17, 31)}
    corpus, asked = frames(spark, docs, queries)
    corpus = corpus.repartitionByRange(40, "doc_id")
    index = bm25_store.stored_index(corpus, str(tmp_path), "topics")
    n_blocks = index.blocks.count()
    weights = bm25.query_weights(asked, index)
    sent = spark.sparkContext.broadcast(weights.toArrow())
    want = bm25.bm25_rank(corpus, asked, 5)
    kth = want.where("rank = 5").select("truncate_dim", "query_id", F.round("score", 9).alias("score"), "doc_id")
    wanted = bm25_store.reachable_blocks(index, sent, spark.sparkContext.broadcast(kth.toArrow()), False).count()
    assert n_blocks >= 35 and wanted <= n_blocks / 4
    assert ranked(bm25_store.rank_by_index(index, asked, 5)) == ranked(want)


def test_a_block_that_only_ties_is_read_for_smaller_ids():
    found = pa.table({"truncate_dim": [-1, -1], "query_id": ["a", "b"], "score": [0.0, 2.0], "doc_id": ["m", "m"]})
    floors = blocks.Floors(found, pa.array(["a", "b", "c"]))
    import numpy as np

    bounds = np.array([[0.0, 0.0, 1e-12], [2.0 - 1e-12, 1.9, 2.1], [0.0, -np.inf, 5.0]])
    got = bm25_store.reaching(bounds, [b"a", b"z", b"z"], floors)
    assert got.tolist() == [[True, False, True], [True, False, True], [True, False, True]]


def test_second_evaluation_reads_no_text(spark, tmp_path, monkeypatch):
    docs, queries = random_corpus(80)
    for name, rows, schema in [
        ("corpus", [(d, x) for d, x in docs.items()], "id string, text string"),
        ("queries", list(queries.items()), "query_id string, question string"),
        ("qrels", [(q, "d1", 1) for q in queries], "query_id string, corpus_id string, score int"),
    ]:
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/data/{name}")
    spec = RetrievalSpec(f"{tmp_path}/data", name="x")

    def run():
        return evaluate_bm25([spec], lambda s: load_spec(spark, s), Cutoffs(), index_dir=f"{tmp_path}/index").toPandas()

    plain = evaluate_bm25([spec], lambda s: load_spec(spark, s), Cutoffs()).toPandas()
    built = []
    real = bm25_store._build
    monkeypatch.setattr(bm25_store, "_build", lambda *a: (built.append(1), real(*a)))
    first = run()
    assert first.equals(plain) and built == [1]

    def no_text(column):
        raise AssertionError("texts of the corpus were tokenized")

    monkeypatch.setattr(bm25_store, "bm25_tokenize", no_text)
    assert run().equals(first) and built == [1]
    monkeypatch.undo()
    spark.createDataFrame([("new", "w1 w1")], "id string, text string").write.mode("append").parquet(f"{tmp_path}/data/corpus")
    monkeypatch.setattr(bm25_store, "_build", lambda *a: (built.append(1), real(*a)))
    run()
    assert built == [1, 1]


@pytest.mark.parametrize("k", [7, 1000])
def test_many_queries_read_the_blocks_in_their_tasks(spark, tmp_path, monkeypatch, k):
    docs, queries = random_corpus(300)
    corpus, asked = frames(spark, docs, {**queries, "none": ""})
    monkeypatch.setattr(bm25_store, "BLOCK_DOCS", 40)
    index = bm25_store.stored_index(corpus, str(tmp_path), "many")
    want = {pad: ranked(bm25_store.rank_by_index(index, asked, k, pad)) for pad in (True, False)}
    jobs = []
    real = bm25_store._stream_queries
    monkeypatch.setattr(bm25_store, "_stream_queries", lambda *args: jobs.append(1) or real(*args))
    monkeypatch.setattr(bm25_store, "MANY_QUERIES", 1)
    for pad, rows in want.items():
        got = ranked(bm25_store.rank_by_index(index, asked, k, pad))
        assert {q: [d for _, d, _ in r] for q, r in got.items()} == {q: [d for _, d, _ in r] for q, r in rows.items()}
    assert len(jobs) == 2
