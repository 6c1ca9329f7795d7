import json
import math
import os
import random

import pytest

from qrelia.operators.metrics import Cutoffs
from qrelia.operators.runlog import evaluations, stop_and_best
from qrelia.plans import evaluate
from qrelia.sources import report
from qrelia.sources.retrieval import RetrievalData, RetrievalSpec
from qrelia.operators.encode import hashing_encoder


def by_hand(values, patience, greater):
    best = best_step = stop = None
    wait = 0
    for step, v in values:
        if v is None or math.isnan(v):
            continue
        if best is None or (v > best if greater else v < best):
            best, best_step, wait = v, step, 0
        else:
            wait += 1
            if wait >= patience:
                stop = step
                break
    return stop, best_step, best


@pytest.mark.parametrize("greater", [False, True])
@pytest.mark.parametrize("patience", [1, 2, 4])
@pytest.mark.parametrize("chunk", [65_536, 7])
def test_early_stop_and_best(spark, monkeypatch, greater, patience, chunk):
    import qrelia.operators.runlog as module

    monkeypatch.setattr(module.evaluations, "__defaults__", (False, chunk))
    rng = random.Random(patience)
    runs = {r: [(s * 10, rng.choice([1.0, 2.0, 3.0, 4.0, 5.0, None, float("nan")])) for s in range(40)] for r in range(12)}
    runs[50] = [(1, 3.0)]
    runs[51] = [(s, float(-s if not greater else s)) for s in range(30)]
    rows = [(r, s, v) for r, vs in runs.items() for s, v in vs]
    df = spark.createDataFrame(rows, "run_id int, step int, value double").repartition(5)
    got = {r["run_id"]: (r["stop_step"], r["best_step"], r["best_value"]) for r in stop_and_best(df, patience, greater).collect()}
    want = {r: by_hand(vs, patience, greater) for r, vs in runs.items()}
    assert got == {r: w for r, w in want.items() if w[1] is not None}


def test_waits(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([3.0, 2.0, 2.0, 5.0, 1.0])], "run_id int, step int, value double")
    rows = evaluations(df).orderBy("step").collect()
    assert [r["wait"] for r in rows] == [0, 0, 1, 2, 0]
    assert [r["improved"] for r in rows] == [True, True, False, False, True]


def small_data(spark):
    corpus = spark.createDataFrame([("d1", "red apple", 0), ("d2", "green pear", 1), ("d3", "red car", 2)], "doc_id string, text string, pos int")
    queries = spark.createDataFrame([("q1", "apple", 0), ("q2", "car red", 1)], "query_id string, text string, pos int")
    qrels = spark.createDataFrame([("q1", "d1", 1), ("q2", "d3", 1), ("q2", "d2", 0)], "query_id string, doc_id string, score int")
    return RetrievalData(corpus, queries, qrels)


def evaluated(spark):
    settings = evaluate.EvalSettings(Cutoffs((1, 3), (5, 2), 10), (32, 8), hashing_encoder(32))
    specs = [RetrievalSpec(dataset="team/one", split="test"), RetrievalSpec(dataset="two", name="second")]
    return settings, evaluate.evaluate_all(specs, lambda s: small_data(spark), settings)


def test_evaluate_all_and_reports(spark, tmp_path):
    settings, results = evaluated(spark)
    rows = results.orderBy("dataset", "seq").collect()
    assert [(r["dataset"], r["system"], r["truncate_dim"]) for r in rows] == [
        (d, s, n) for d in ("second", "team/one") for s, n in (("bm25", -1), ("cosine", 32), ("cosine", 8))
    ]
    assert rows[0]["precision_1"] is None and rows[1]["precision_1"] is not None
    assert rows[0]["accuracy_1"] == 1.0

    report.write_results_json(results, str(tmp_path / "json"), settings.cutoffs, "m")
    folders = sorted(os.listdir(tmp_path / "json" / "datasets"))
    assert [f for f in folders if f.startswith("folder=")] == ["folder=second", "folder=team_one"]
    folder = tmp_path / "json" / "datasets" / "folder=team_one"
    part = next(f for f in os.listdir(folder) if f.startswith("part-"))
    one = json.loads((folder / part).read_text())
    assert one["eval_split"] == "test" and one["model_path"] == "m" and one["dataset"] == "team/one"
    assert [r["truncate_dim"] for r in one["results"]] == [-1, 32, 8]
    assert one["results"][0]["bm25_accuracy@1"] == 1.0
    assert not [k for k in one["results"][0] if k.startswith("cosine")]
    combined = tmp_path / "json" / "combined"
    part = next(f for f in os.listdir(combined) if f.startswith("part-"))
    assert len(json.loads((combined / part).read_text())["datasets"]) == 2

    lines = [r["line"] for r in report.results_markdown(results, settings.cutoffs).where("dataset = 'second'").orderBy("line_no").collect()]
    assert lines[0] == "| method | Accuracy@1 | Accuracy@3 | NDCG@3 | MRR@3 | Recall@2 | Recall@5 | MAP@10 |"
    assert lines[1].count("---") == 8 and lines[2].startswith("| BM25 | 1.000000 | ") and lines[3].startswith("| 32 | ")

    card = report.results_card(results, settings.cutoffs, "model", (32, 8), ["team/one", "second"])
    report.write_lines(card, str(tmp_path / "card"), ["section", "line_no"])
    part = next(f for f in os.listdir(tmp_path / "card") if f.startswith("part-"))
    text = (tmp_path / "card" / part).read_text().splitlines()
    assert text[0] == "# model" and text[6] == "- Truncate dims: `[32, 8]`"
    assert text.index("### team/one") < text.index("### second")
    assert text[text.index("### team/one") + 2].startswith("| method")


def test_all_artifacts(spark, tmp_path):
    rows = [(d, "test", s, "bm25" if s == 0 else "cosine", -1 if s == 0 else 8 * s, 0.5) for d in ("team/one", "two") for s in range(4)]
    results = spark.createDataFrame(rows, "dataset string, split string, seq int, system string, truncate_dim int, accuracy_1 double")
    cutoffs = Cutoffs((1,), (5,), 10)
    report.write_artifacts(results.repartition(3), str(tmp_path), cutoffs, "runs/model", (8, 16, 24), ["team/one", "two"])

    def text(folder):
        part = next(f for f in os.listdir(tmp_path / folder) if f.startswith("part-"))
        return (tmp_path / folder / part).read_text().splitlines()

    table = text("tables/folder=team_one")
    assert [line.split(" | ")[0] for line in table] == ["| method", "|---|---|---|---|", "| BM25", "| 8", "| 16", "| 24"]
    assert text("tables/folder=two") == table
    assert text("card")[0] == "# model" and text("card").count(table[2]) == 2
    first = json.loads(text("datasets/folder=two")[0])["results"][1]
    assert first == {"truncate_dim": 8, "cosine_accuracy@1": 0.5}


def test_missing_metric_is_zero(spark):
    rows = spark.createDataFrame([("d", 0, "bm25", -1)], "dataset string, seq int, system string, truncate_dim int")
    lines = report.results_markdown(rows, Cutoffs((1,), (5,), 10)).orderBy("line_no").collect()
    assert lines[-1]["line"] == "| BM25 | 0.000000 | 0.000000 | 0.000000 |"


def test_default_dataset_is_used_only_without_a_list(spark):
    settings, _ = evaluate.EvalSettings(Cutoffs((1,), (5,), 10), (), hashing_encoder(16)), None
    default = RetrievalSpec(dataset="default")
    out = evaluate.evaluate_all([], lambda s: small_data(spark), settings, default, run_bm25=False).collect()
    assert [(r["dataset"], r["truncate_dim"]) for r in out] == [("default", 16)]
    with pytest.raises(ValueError):
        evaluate.evaluate_all([], lambda s: None, settings)


def test_append_metric_log(spark, tmp_path):
    path = str(tmp_path / "log")
    for epoch, steps, value in ((0.5, 250, 1.23456789), (1.0, 500, 1.0)):
        row = spark.createDataFrame([(epoch, steps, value)], "epoch double, steps long, validation_loss double")
        report.append_metric_log(row, path)
    back = spark.read.schema(report.METRIC_LOG_SCHEMA).option("header", True).csv(path).orderBy("steps").collect()
    assert [tuple(r) for r in back] == [(0.5, 250, "1.234568"), (1.0, 500, "1.000000")]


def test_six_decimals_round_the_exact_number_half_to_even(spark):
    df = spark.createDataFrame([(0.0078125,), (0.0234375,), (2 / 3,), (None,)], "x double")
    got = [r[0] for r in df.select(report.six_decimals("x")).collect()]
    assert got == ["0.007812", "0.023438", "0.666667", None]


def test_bm25_falls_back_to_the_default_dataset():
    with pytest.raises(ValueError):
        evaluate.evaluate_bm25([], None, Cutoffs())


def test_encoded_texts_are_cut(spark):
    def frame(rows, key):
        return spark.createDataFrame(rows, f"{key} string, text string")

    corpus = [("a", "x y"), ("b", "x z w")]
    qrels = spark.createDataFrame([("q", "b", 1)], "query_id string, doc_id string, score int")
    data = RetrievalData(frame(corpus, "doc_id"), frame([("q", "x z w")], "query_id"), qrels)
    cutoffs = Cutoffs([1], [1], 1)
    results = []
    for n in (None, 1):
        settings = evaluate.EvalSettings(cutoffs, (16,), hashing_encoder(16), max_tokens=n)
        results.append(evaluate.evaluate_dense(data, settings, run_bm25=False).first()["accuracy_1"])
    assert results == [1.0, 0.0]  # cut to one word, both documents are equal and the id decides
