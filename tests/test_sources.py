import pytest
from pyspark.sql import functions as F

from qrelia.sources.retrieval import RetrievalSpec, load_beir, load_spec, load_squad
from qrelia.sources.tables import (
    ID_ALIASES,
    QREL_DOC_ALIASES,
    QREL_QUERY_ALIASES,
    SCORE_ALIASES,
    TEXT_ALIASES,
    load_triplets,
    read_table,
    resolve_col,
    trim_triplets,
    union_sources,
)

# Rows in order: repeated query q1, repeated document d2, repeated judgement (q1, d1)
# that is first relevant and then not.
CORPUS = [("d1", "T1", "one  text"), ("d2", None, "old"), ("d3", "T3", None), ("d2", "", "new"), ("d4", "", "four"), ("d5", "", "five")]
QUERIES = [("q1", "first"), ("q2", " second  q "), ("q1", "first again"), ("q3", "third"), (None, "no id")]
QRELS = [("q1", "d1", 1), ("q1", "d2", 0), ("q2", "d3", 2), ("q1", "d1", 0), ("q3", "gone", 1), ("q9", "d1", 1)]


def frames(spark):
    def make(rows, schema):
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos long, " + schema).repartition(3)

    return (
        make(CORPUS, "id string, title string, text string"),
        make(QUERIES, "query_id string, question string"),
        make(QRELS, "query_id string, corpus_id string, score int"),
    )


def expected(limit, extra):
    """The loading rules over plain rows."""
    queries, selected = {}, []
    for qid, text in QUERIES:
        if qid is None:
            continue
        if limit is not None and len(selected) >= limit:
            break
        selected.append(qid)
        queries[qid] = " ".join(text.split())
    judged, required = {}, set()
    for qid, did, score in QRELS:
        if qid in selected:
            judged[qid, did] = score
            if score > 0:
                required.add(did)
    docs, left = {}, extra
    for did, title, text in CORPUS:
        if did not in required and left is not None:
            if left <= 0:
                continue
            left -= 1
        parts = [" ".join(x.split()) for x in (title, text) if x]
        docs[did] = "\n".join(p for p in parts if p)
    judged = {k: v for k, v in judged.items() if k[1] in docs}
    asked = {q for q, _ in judged}
    return docs, {q: t for q, t in queries.items() if q in asked}, judged


@pytest.mark.parametrize("limit", [None, 0, 1, 2, 3, 10])
@pytest.mark.parametrize("extra", [None, 0, 1, 2, 5])
def test_three_table_rules(spark, limit, extra):
    data = load_beir(*frames(spark), limit=limit, extra_corpus_docs=extra)
    docs, queries, judged = expected(limit, extra)
    assert {r["doc_id"]: r["text"] for r in data.corpus.collect()} == docs
    assert data.corpus.count() == len(docs)
    assert {r["query_id"]: r["text"] for r in data.queries.collect()} == queries
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in data.qrels.collect()} == judged


def test_first_position_is_kept(spark):
    data = load_beir(*frames(spark))
    assert data.corpus.where("doc_id = 'd2'").first()["pos"] == 1
    assert data.queries.where("query_id = 'q1'").first()["pos"] == 0


def test_resolve_col_order():
    assert resolve_col(["qid", "corpus_id"], "id", ID_ALIASES, "corpus id") == "qid"
    assert resolve_col(["a", "sentence", "query"], "x", TEXT_ALIASES, "text") == "query"
    assert resolve_col(["q_id"], "query_id", QREL_QUERY_ALIASES, "q") == "q_id"
    assert resolve_col(["document_id", "did"], "c", QREL_DOC_ALIASES, "d") == "did"
    assert resolve_col(["label", "mine"], "mine", SCORE_ALIASES, "s") == "mine"
    with pytest.raises(KeyError, match="score"):
        resolve_col(["a"], "score", SCORE_ALIASES, "score")


def test_corpus_without_title_and_text_is_an_error(spark):
    corpus, queries, qrels = frames(spark)
    with pytest.raises(KeyError):
        load_beir(corpus.drop("title", "text"), queries, qrels)


QA = [
    ("a", "ctx  one", "q a", "T"), ("b", "ctx one", "q b", "U"), ("a", "ctx two", "q a2", ""),
    ("c", "ctx three", "q c", None), ("a", "ctx four", "q a3", "V"), ("d", "ctx one", "q d", "W"),
]


def expected_qa(limit):
    ids, corpus, queries, judged = {}, {}, {}, set()
    for qid, ctx, question, title in QA:
        ctx = " ".join(ctx.split())
        if ctx not in ids:
            ids[ctx] = f"corpus_{len(ids)}"
            corpus[ids[ctx]] = f"{title}\n{ctx}" if title else ctx
        if limit is not None and len(queries) >= limit:
            break
        queries.setdefault(qid, question)
        judged.add((qid, ids[ctx]))
    return corpus, queries, judged


@pytest.mark.parametrize("limit", [None, 0, 1, 2, 3, 4, 9])
def test_question_answer_rules(spark, limit):
    rows = [(i, *r) for i, r in enumerate(QA)]
    table = spark.createDataFrame(rows, "pos long, id string, context string, question string, title string")
    data = load_squad(table.repartition(3), limit=limit)
    corpus, queries, judged = expected_qa(limit)
    assert {r["doc_id"]: r["text"] for r in data.corpus.collect()} == corpus
    assert {r["query_id"]: r["text"] for r in data.queries.collect()} == queries
    assert {(r["query_id"], r["doc_id"]) for r in data.qrels.collect()} == judged


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_load_spec_from_files(spark, tmp_path, fmt):
    corpus, queries, qrels = frames(spark)
    for name, df in (("corpus", corpus), ("queries", queries), ("qrels", qrels)):
        df.withColumnRenamed("pos", "n").write.format(fmt).option("header", True).save(f"{tmp_path}/{name}/test")
    spec = RetrievalSpec(dataset=str(tmp_path), split="test", file_format=fmt, order_by=["n"])
    data = load_spec(spark, spec)
    docs, asked, _ = expected(None, None)
    assert {r["query_id"]: r["text"] for r in data.queries.collect()} == asked
    assert {r["doc_id"] for r in data.corpus.collect()} == set(docs)


def test_unknown_format_is_an_error(spark):
    with pytest.raises(ValueError):
        load_spec(spark, RetrievalSpec(dataset="x", format="other"), read=lambda _: None)


def test_parquet_row_order_without_order_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(50).select((49 - F.col("id")).alias("v")).coalesce(1).write.parquet(path)
    rows = read_table(spark, path).orderBy("pos").collect()
    assert [r["v"] for r in rows] == list(range(49, -1, -1))
    with pytest.raises(ValueError):
        read_table(spark, path, "json")


def test_load_triplets_concatenates_in_order(spark, tmp_path):
    paths = []
    for name in ("one", "two"):
        paths.append(str(tmp_path / name))
        rows = [(f"{name} q{i}", f" p  {i}", f"n{i}") for i in range(3)] + [(None, "p", "n")]
        spark.createDataFrame(rows, "query string, positive string, negative string").coalesce(1).write.parquet(paths[-1])
    got = load_triplets(spark, paths).orderBy("pos").collect()
    assert [r["query"] for r in got] == [f"{n} q{i}" for n in ("one", "two") for i in range(3)]
    assert got[1]["positive"] == "p 1"
    assert "negative" not in load_triplets(spark, paths[0], hard_negatives=False).columns


def test_union_keeps_repeated_rows(spark):
    df = spark.createDataFrame([(0, "q", "p", "n")], "pos long, query string, positive string, negative string")
    assert union_sources([("a", trim_triplets(df)), ("a", trim_triplets(df))]).count() == 2
