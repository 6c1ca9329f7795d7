"""The pipeline stage by stage against brute force, each stage on its own input."""

from collections import Counter

import pytest
from helpers import words
from test_operators import brute_classes

import corpus_pipeline
from qrelia.llm.suffix_dedup import kept_text
from qrelia.session import durable


@pytest.fixture(scope="module")
def outputs(spark, sf_dir):
    docs = corpus_pipeline.table(spark, sf_dir, "documents")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, sf_dir))
        out.append(docs.collect())
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    return out


def test_clean_documents_stay_and_bad_ones_go(spark, sf_dir, outputs):
    labels = {r.doc_id: r.quality for r in corpus_pipeline.table(spark, sf_dir, "labels").collect()}
    kept = {r.doc_id for r in outputs[1]}
    assert kept <= {r.doc_id for r in outputs[0]}
    right = sum((d in kept) == (q == 1) for d, q in labels.items())
    assert right >= 0.95 * len(labels)


def test_one_document_of_each_class_stays(outputs):
    classes = {c for _, _, c in brute_classes([(r.doc_id, r.text) for r in outputs[1]])}
    assert Counter(r.doc_id for r in outputs[2]) == Counter(classes)
    texts = {r.doc_id: r.text for r in outputs[1]}
    assert all(texts[r.doc_id] == r.text for r in outputs[2])


def test_repeated_passages_are_cut(outputs):
    import numpy as np

    bodies = {r.doc_id: r.text.encode() for r in outputs[2]}
    count = Counter(b[i : i + 400] for b in bodies.values() for i in range(len(b) - 399))
    got = {r.doc_id: (r.text, r.n_chars) for r in outputs[3]}
    for d, b in bodies.items():
        cut = np.zeros(len(b) + 1, np.int8)
        for i in range(len(b) - 399):
            if count[b[i : i + 400]] > 1:
                cut[i : i + 400] = 1
        edge = np.diff(np.r_[0, cut])
        runs = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        assert got[d] == kept_text(np.frombuffer(b, np.uint8), None, runs)
    assert set(got) == set(bodies)


def test_contaminated_documents_go(spark, sf_dir, outputs):
    items = [[w.lower() for w in words(r.text)] for r in corpus_pipeline.table(spark, sf_dir, "benchmark").collect()]

    def contaminated(text):
        a = [w.lower() for w in words(text)]
        return any(sum(a[s + k] == b[k] for k in range(len(b)) if 0 <= s + k < len(a)) >= 0.8 * len(b) for b in items for s in range(-(len(b) // 4), len(a)))

    expected = sorted(r.doc_id for r in outputs[3] if not contaminated(r.text))
    assert sorted(r.doc_id for r in outputs[4]) == expected


def test_all_that_stayed_is_packed(outputs):
    tokens = Counter()
    for r in outputs[5]:
        tokens[r.doc_id] += r.length
    assert set(tokens) == {r.doc_id for r in outputs[4]}
    assert all(tokens[r.doc_id] == r.doc_tokens for r in outputs[5])
