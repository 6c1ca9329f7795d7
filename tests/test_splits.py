import json

import pytest
from pyspark.sql import functions as F

import qrelia.sources.splits as splits
from qrelia.sources.report import write_results_json
from qrelia.operators.metrics import Cutoffs
from qrelia.plans.evaluate import union_datasets
from qrelia.sources.retrieval import RetrievalSpec, load_spec
from qrelia.sources.splits import read_split, split_files, split_names
from qrelia.sources.tables import load_triplets


def in_order(df, *columns):
    return [tuple(r) for r in df.orderBy("pos").select(*columns).collect()]


def json_lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows))


def test_json_rows_keep_their_order_over_pieces_and_files(spark, tmp_path, monkeypatch):
    rows = [{"_id": i, "text": f"row é{i} " * (i % 7), "title": None if i % 3 else "t"} for i in range(500)]
    json_lines(tmp_path / "d" / "corpus" / "test-00000-of-00002.jsonl", rows[:300])
    json_lines(tmp_path / "d" / "corpus" / "test-00001-of-00002.jsonl", rows[300:])
    json_lines(tmp_path / "d" / "corpus" / "train.jsonl", rows[:3])
    monkeypatch.setattr(splits, "PIECE_BYTES", 1000)
    df = read_split(spark, str(tmp_path / "d"), "corpus", fmt="json")
    assert df.rdd.getNumPartitions() > 10
    assert in_order(df, "_id", "text", "title") == [(r["_id"], r["text"], r["title"]) for r in rows]
    assert df.select(F.count_distinct("pos")).first()[0] == 500
    assert split_names(str(tmp_path / "d"), "corpus", "json") == ["test", "train"]
    assert read_split(spark, (tmp_path / "d").as_uri(), "corpus", "train", "json").count() == 3


def test_csv_with_quoted_line_ends(spark, tmp_path):
    folder = tmp_path / "d" / "validation"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text('id,question\n1,"two\nlines, ""quoted"""\n2,\n')
    (folder / "b.csv").write_text("id,question\n3,x\n")
    (folder / "_SUCCESS").write_text("")
    df = read_split(spark, str(tmp_path / "d"), None, None, "csv", "squad")
    assert in_order(df, "id", "question") == [("1", 'two\nlines, "quoted"'), ("2", None), ("3", "x")]


def test_parquet_split_is_read_by_spark(spark, tmp_path):
    for name, rows in (("train", [(1, "a")]), ("test", [(2, "b"), (3, "c")])):
        spark.createDataFrame(rows, "id long, text string").coalesce(1).write.parquet(str(tmp_path / "d" / "corpus" / name))
    df = read_split(spark, str(tmp_path / "d"), "corpus")
    assert in_order(df, "id") == [(2,), (3,)]
    assert len(split_files(str(tmp_path / "d"), "corpus", "train")) == 1
    with pytest.raises(FileNotFoundError, match="test.*train"):
        read_split(spark, str(tmp_path / "d"), "corpus", "dev")


def test_a_dataset_is_loaded_by_its_default_split(spark, tmp_path):
    d = tmp_path / "d"
    for split, n in (("test", 4), ("train", 9)):
        json_lines(d / "corpus" / f"{split}.jsonl", [{"_id": f"c{i}", "text": f"text {i}"} for i in range(n)])
        json_lines(d / "queries" / f"{split}.jsonl", [{"qid": f"q{i}", "query": f"query {i}"} for i in range(n)])
        json_lines(d / "qrels" / f"{split}.jsonl", [{"query-id": f"q{i}", "corpus-id": f"c{i}", "score": 1} for i in range(n)])
    for named, n in ((None, 4), ("train", 9)):
        data = load_spec(spark, RetrievalSpec(str(d), split=named, file_format="json"))
        assert data.corpus.count() == data.queries.count() == data.qrels.count() == n
        assert in_order(data.corpus, "doc_id") == [(f"c{i}",) for i in range(n)]
    limited = load_spec(spark, RetrievalSpec(str(d), split="train", file_format="json"), limit=2, extra_corpus_docs=1)
    assert sorted(r[0] for r in limited.corpus.select("doc_id").collect()) == ["c0", "c1", "c2"]


def test_triplets_of_a_split(spark, tmp_path):
    for name, n in (("train", 5), ("dev", 2)):
        json_lines(tmp_path / "one" / f"{name}.jsonl", [{"query": f"q{i}", "positive": "p", "negative": "n"} for i in range(n)])
    assert load_triplets(spark, str(tmp_path / "one"), "json", split="train").count() == 5
    assert load_triplets(spark, [str(tmp_path / "one")] * 2, "json", split="dev").count() == 4


def test_combined_results_keep_list_order_and_equal_names(spark, tmp_path):
    def part(value):
        return spark.createDataFrame([(0, "bm25", -1, value)], "seq int, system string, truncate_dim int, accuracy_1 double")

    specs = [RetrievalSpec("z"), RetrievalSpec("a"), RetrievalSpec("z", split="dev"), RetrievalSpec("a")]
    results = union_datasets([(s, part(i / 10)) for i, s in enumerate(specs)])
    write_results_json(results.repartition(3), str(tmp_path), Cutoffs((1,), (5,), 10), "m")
    combined = spark.read.json(f"{tmp_path}/combined").first()["datasets"]
    assert [(x["dataset"], x["results"][0]["bm25_accuracy@1"]) for x in combined] == [("z", 0.0), ("a", 0.1), ("z", 0.2), ("a", 0.3)]
    assert spark.read.json(f"{tmp_path}/datasets").count() == 4
