import math
import random

import pytest

from qrelia.operators.metrics import Cutoffs, query_hits, query_metrics, run_metrics

CUTOFFS = Cutoffs(top_k=(1, 3, 5), recall_at_k=(2, 5), map_at_k=6)


def by_hand(ranked, relevant, c=CUTOFFS):
    """Metrics of one ranked list, straight from their definitions."""
    hit = [d in relevant for d in ranked]
    out = {}
    for k in c.top_k:
        top = hit[:k]
        out[f"accuracy_{k}"] = float(any(top))
        out[f"precision_{k}"] = sum(top) / k
        if k != 1:
            gain = sum(1 / math.log2(i + 2) for i, h in enumerate(top) if h)
            best = sum(1 / math.log2(i + 2) for i in range(min(len(relevant), k)))
            out[f"ndcg_{k}"] = gain / best if best else 0.0
            out[f"mrr_{k}"] = next((1 / (i + 1) for i, h in enumerate(top) if h), 0.0)
    for k in c.recalls:
        out[f"recall_{k}"] = sum(hit[:k]) / max(len(relevant), 1)
    k = c.map_at_k
    total = sum(sum(hit[: i + 1]) / (i + 1) for i, h in enumerate(hit[:k]) if h)
    out[f"map_{k}"] = total / min(len(relevant), k) if relevant else 0.0
    return out


# name: (ranked list, relevant documents)
CASES = {
    "no_hits": (["a", "b", "c"], {"z"}),
    "all_hits": (["a", "b", "c", "d", "e", "f"], set("abcdef")),
    "short_list": (["a"], {"a", "b"}),
    "nothing_relevant": (["a", "b"], set()),
    "more_relevant_than_k": (list("abcdef"), set("abcdefghijk")),
    "late_hit": (list("abcdef"), {"f"}),
    "empty_list": ([], {"a"}),
}


def frames(spark, cases):
    run = [(-1, q, d, i + 1) for q, (docs, _) in cases.items() for i, d in enumerate(docs)]
    qrels = [(q, d, 1) for q, (_, rel) in cases.items() for d in rel]
    qrels += [(q, f"judged-{q}", 0) for q in cases] + [(q, "a", 0) for q, (_, rel) in cases.items() if "a" not in rel]
    return (
        spark.createDataFrame(run, "truncate_dim int, query_id string, doc_id string, rank int"),
        spark.createDataFrame([(q,) for q in cases], "query_id string"),
        spark.createDataFrame(qrels, "query_id string, doc_id string, score int"),
    )


def check(spark, cases):
    run, queries, qrels = frames(spark, cases)
    rows = query_metrics(query_hits(run, queries, qrels, [-1]), CUTOFFS).collect()
    assert {r["query_id"] for r in rows} == set(cases)
    for r in rows:
        got = {k: v for k, v in r.asDict().items() if k not in ("query_id", "truncate_dim")}
        assert got == pytest.approx(by_hand(*cases[r["query_id"]]))
        assert all(0 <= v <= 1 for v in got.values())
        assert r["accuracy_1"] <= r["accuracy_3"] <= r["accuracy_5"] and r["recall_2"] <= r["recall_5"]
    return rows


def test_named_cases(spark):
    check(spark, CASES)


def test_random_cases(spark):
    rng = random.Random(11)
    docs = [chr(97 + i) for i in range(12)]
    cases = {
        f"q{i}": (rng.sample(docs, rng.randrange(7)), set(rng.sample(docs, rng.randrange(9))))
        for i in range(40)
    }
    check(spark, cases)


def test_average_counts_every_query(spark):
    run, queries, qrels = frames(spark, CASES)
    row = run_metrics(run, queries, qrels, [-1], CUTOFFS, with_precision=False).first().asDict()
    each = [by_hand(*c) for c in CASES.values()]
    for name, value in row.items():
        if name != "truncate_dim":
            assert value == pytest.approx(sum(e[name] for e in each) / len(each))
    assert not [n for n in row if n.startswith("precision")]


def test_no_queries_give_no_rows(spark):
    run, queries, qrels = frames(spark, CASES)
    assert run_metrics(run, queries.limit(0), qrels, [-1], CUTOFFS).count() == 0


def test_default_recall_cutoffs():
    assert Cutoffs(recall_at_k=()).recalls == (5, 10, 100)
    assert Cutoffs(top_k=(1, 200), recall_at_k=(5,), map_at_k=10).max_k == 200
