import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import qrelia.operators.batching as batching
import qrelia.operators.loss as loss_module
from qrelia.operators.batching import no_duplicate_batches
from qrelia.operators.encode import encode_texts, hashing_encoder
from qrelia.operators.loss import in_batch_loss
from qrelia.operators.pooling import pool_vectors
from qrelia.session import durable
from qrelia.operators.triplets import (
    evaluator_payload,
    sentence_columns,
    split_by_query,
    split_counts,
    texts_array,
    validation_head,
)
from qrelia.plans.prepare import PrepareSettings, prepare_training, write_prepared
from qrelia.sources.tables import trim_triplets, union_sources

SCHEMA = "pos long, query string, positive string, negative string"


def triplets(spark, n=120, queries=23, seed=2):
    """Rows of which a third share one query."""
    rng = random.Random(seed)
    rows = [
        (i, "hot" if i % 3 == 0 else f"q{rng.randrange(queries)}", f"p{rng.randrange(n)}", f"n{i}")
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("size", [0.0, 0.0001, 0.1, 0.5, 0.99, 1.0, 3.0])
def test_split_by_query(spark, size):
    rows, df = triplets(spark)
    got = {r["pos"]: r["split"] for r in split_by_query(df, size, 42).collect()}
    names = sorted({r[1] for r in rows}, key=lambda q: hashlib.md5(f"42|{q}".encode()).hexdigest())
    held_out = set(names[: max(1, int(len(names) * size))]) if size > 0 else set()
    assert got == {r[0]: "validation" if r[1] in held_out else "train" for r in rows}


def test_split_is_independent_of_partitioning(spark):
    _, df = triplets(spark)
    splits = [sorted(split_by_query(df.repartition(n), 0.3, 1).collect()) for n in (1, 3, 8)]
    assert splits[0] == splits[1] == splits[2]


def test_split_counts(spark):
    _, df = triplets(spark)
    counts = {r["split"]: r["n_rows"] for r in split_counts(split_by_query(df, 0.2, 1)).collect()}
    assert counts["loaded"] == 120 == counts["train"] + counts["validation"]


def test_payload_and_head(spark):
    _, df = triplets(spark)
    assert [r["pos"] for r in validation_head(df, 5).orderBy("pos").collect()] == [0, 1, 2, 3, 4]
    assert validation_head(df, None).count() == validation_head(df, 1000).count() == 120
    assert validation_head(df, 0).count() == 0
    payload = evaluator_payload(df.drop("negative"), 3).collect()
    assert len(payload) == 3 and all(r["negative"] == r["positive"] for r in payload)


def test_sentence_columns(spark):
    _, df = triplets(spark, 6)
    rows = df.select("pos", texts_array(df).alias("texts"), F.lit(0).alias("y"))
    assert sentence_columns(rows, label="y").columns == ["pos", "sentence_0", "sentence_1", "sentence_2"]
    some = rows.withColumn("y", (F.col("pos") == 3).cast("int"))
    assert sentence_columns(some, label="y").columns[-1] == "label"
    pairs = df.drop("negative")
    assert sentence_columns(pairs.select(texts_array(pairs).alias("texts"))).columns == ["sentence_0", "sentence_1"]


def check_batches(rows, got, size):
    texts = {r[0]: {t.strip().lower() for t in r[1:] if t is not None} for r in rows}
    assert sorted(got) == sorted(texts)
    members = defaultdict(list)
    for row, batch in got.items():
        if batch is not None:
            members[batch].append(row)
    for batch, ids in members.items():
        assert 0 <= batch < len(rows) // size and len(ids) <= size
        seen = Counter(t for i in ids for t in texts[i])
        assert max(seen.values()) == 1
    return members


@pytest.mark.parametrize("size", [4, 16, 500])
def test_batches_hold_no_text_twice(spark, size):
    rows, df = triplets(spark)
    out = no_duplicate_batches(df, texts_array(df), size, "pos").collect()
    assert len(out) == len(rows)
    check_batches(rows, {r["row_id"]: r["batch_id"] for r in out}, size)


def test_batches_are_full_where_texts_allow(spark):
    rows = [(i, f"q{i % 10}", f"p{i}", None) for i in range(103)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = no_duplicate_batches(df, texts_array(df), 5, "pos").collect()
    members = check_batches(rows, {r["row_id"]: r["batch_id"] for r in out}, 5)
    assert len(members) == 20 and all(len(m) == 5 for m in members.values())


def test_text_shared_by_more_rows_than_batches(spark):
    rows = [(i, "Same " if i < 50 else f"q{i}", f"p{i}", None) for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = no_duplicate_batches(df, texts_array(df), 8, "pos").collect()
    members = check_batches(rows, {r["row_id"]: r["batch_id"] for r in out}, 8)
    assert sum(1 for m in members.values() for i in m if i < 50) == 10
    assert sum(1 for m in members.values() for i in m if i >= 50) == 30


def test_no_row_is_left_that_fits(spark):
    rows = [
        (i, f"q{i}", f"p{i}", "shared" if i < 100 else "common" if i < 300 else f"n{i}") for i in range(400)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    batches = durable(no_duplicate_batches(df, texts_array(df), 4, "pos"))
    got = {r["row_id"]: r["batch_id"] for r in batches.collect()}
    members = check_batches(rows, got, 4)
    held = {b: {t for i in ids for t in rows[i][1:]} for b, ids in members.items()}
    room = [b for b in range(100) if len(members.get(b, ())) < 4]
    left = [i for i, b in got.items() if b is None]
    assert not [i for i in left for b in room if not held.get(b, set()) & set(rows[i][1:])]
    assert batching.placeable_rows(df, texts_array(df), batches, 4, "pos").count() == 0


def test_row_repeating_its_own_text_is_allowed(spark):
    rows = [(i, f"q{i}", f"Q{i} ", f"q{i}") for i in range(8)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = no_duplicate_batches(df, texts_array(df), 4, "pos").collect()
    assert all(r["batch_id"] is not None for r in out)


def test_prepare_and_write(spark, tmp_path):
    rows, df = triplets(spark)
    loaded = union_sources([("a", trim_triplets(df)), ("b", trim_triplets(df.withColumn("query", F.concat(F.lit("b"), "query"))))])
    ready = prepare_training(loaded, PrepareSettings(0.2, 10, 8, 3))
    write_prepared(ready, str(tmp_path))
    train = spark.read.parquet(f"{tmp_path}/train").collect()
    held_out = spark.read.parquet(f"{tmp_path}/validation").collect()
    assert 0 < len(held_out) <= 10
    assert not {r["sentence_0"] for r in train} & {r["sentence_0"] for r in held_out}
    in_batch = Counter((r["batch_id"], t) for r in train for t in (r["sentence_0"], r["sentence_1"], r["sentence_2"]))
    assert max(in_batch.values()) == 1


def plain_loss(a, p, n, size, dims):
    def unit(m):
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    totals = []
    for s in range(0, len(a), size):
        total = 0.0
        for d in dims:
            x = unit(a[s : s + size, :d])
            c = unit(np.concatenate([p[s : s + size, :d], n[s : s + size, :d]]))
            sims = 20 * x @ c.T
            total += np.mean([np.log(np.exp(r).sum()) - r[i] for i, r in enumerate(sims)])
        totals.append(total)
    return np.mean(totals)


@pytest.mark.parametrize("group", [4096, 16])
def test_in_batch_loss(spark, monkeypatch, group):
    monkeypatch.setattr(loss_module, "_ROWS_PER_TASK_GROUP", group)
    rng = np.random.default_rng(0)
    a, p, n = (rng.normal(size=(37, 6)) for _ in range(3))
    rows = [(100 + 3 * i, a[i].tolist(), p[i].tolist(), n[i].tolist()) for i in range(37)]
    df = spark.createDataFrame(rows, "pos long, anchor array<double>, positive array<double>, negative array<double>")
    got = in_batch_loss(df.repartition(5), 8, [6, 3]).first()
    assert got["n_batches"] == 5
    assert got["loss"] == pytest.approx(plain_loss(a, p, n, 8, [6, 3]))
    empty = in_batch_loss(df.limit(0), 8, [6]).first()
    assert (empty["n_batches"], empty["loss"]) == (0, 0.0)


def test_pooling(spark):
    rows = [("a", 2, [1.0, 5.0]), ("a", 1, [3.0, -1.0]), ("b", 7, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "k string, pos int, v array<double>")
    def pooled(mode):
        return {r["k"]: r["pooled"] for r in pool_vectors(df, "k", "v", "pos", mode).collect()}
    assert pooled("mean") == {"a": [2.0, 2.0], "b": [0.0, 2.0]}
    assert pooled("max") == {"a": [3.0, 5.0], "b": [0.0, 2.0]}
    assert pooled("cls") == {"a": [3.0, -1.0], "b": [0.0, 2.0]}
    with pytest.raises(ValueError):
        pooled("sum")


def test_encode_texts(spark):
    texts = ["a b a", "", "A  b", None, "c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    plain = {r["i"]: r["vector"] for r in encode_texts(df, "t", hashing_encoder(8), 2).collect()}
    other = {r["i"]: r["vector"] for r in encode_texts(df.repartition(3), "t", hashing_encoder(8), 100).collect()}
    assert plain == other
    assert plain[1] == plain[3] == [0.0] * 8
    assert sum(x * x for x in plain[0]) == pytest.approx(1)


def test_set_bits_are_counted_in_order():
    rng = np.random.default_rng(1)
    bits = rng.random((200, 64)) < rng.random((200, 1)) ** 2
    bits[0] = False
    turn = rng.integers(0, 1 << 40, 200)
    got = batching.nth_set_bit(np.packbits(bits, axis=1, bitorder="little"), turn)
    for row, k, place in zip(bits, turn, got):
        places = np.flatnonzero(row)
        assert place == (places[k % len(places)] if len(places) else -1)


def test_bitmaps_never_make_more_rows_than_texts(spark, monkeypatch):
    """Texts that nearly every batch holds: a join of rows and batches would have 300 x 90 rows."""
    made, wanted = [], []
    real = batching.texts_held

    def counted(state, left):
        joined = real(state, left)
        made.append(joined.count())
        wanted.append(left.agg(F.sum(F.size("keys"))).first()[0] or 0)
        return joined

    monkeypatch.setattr(batching, "texts_held", counted)
    rows = [(i, f"q{i % 3}", f"p{i % 5}", f"n{i % 290}") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = no_duplicate_batches(df, texts_array(df), 4, "pos").collect()
    check_batches(rows, {r["row_id"]: r["batch_id"] for r in out}, 4)
    assert made and all(m <= w for m, w in zip(made, wanted))


@pytest.mark.parametrize("window", [8, 16])
def test_rows_go_on_to_the_next_window(spark, monkeypatch, window):
    """The bitmaps are 4 KB whatever the window, so a short window only makes more of them."""
    monkeypatch.setattr(batching, "WINDOW_BATCHES", window)
    rows = [(i, f"q{i % 30}", f"p{i % 40}", "shared" if i % 2 else f"n{i}") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    batches = durable(no_duplicate_batches(df, texts_array(df), 4, "pos"))
    got = {r["row_id"]: r["batch_id"] for r in batches.collect()}
    members = check_batches(rows, got, 4)
    held = {b: {t for i in ids for t in rows[i][1:]} for b, ids in members.items()}
    room = [b for b in range(75) if len(members.get(b, ())) < 4]
    assert not [i for i, b in got.items() if b is None for r in room if not held.get(r, set()) & set(rows[i][1:])]
    assert batching.placeable_rows(df, texts_array(df), batches, 4, "pos").count() == 0


def test_encoder_remembers_a_bounded_number_of_words(monkeypatch):
    import qrelia.operators.encode as encode

    texts = [" ".join(f"w{(i * 7 + j) % 90}" for j in range(30)) for i in range(40)]
    want = hashing_encoder(8)()(texts)
    monkeypatch.setattr(encode, "MOST_WORDS", 11)
    encoder = hashing_encoder(8)()
    assert (encoder(texts) == want).all()
    slot = next(c.cell_contents for c in encoder.__closure__ if callable(c.cell_contents))
    remembered = [c.cell_contents for c in slot.__closure__ if isinstance(c.cell_contents, dict)]
    assert [0 < len(m) <= 11 for m in remembered] == [True]


def test_texts_are_encoded_in_small_batches(spark):
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, "10000")

    def widths():
        def encode(texts):
            return np.full((len(texts), 1), float(len(texts)))

        return encode

    try:
        df = spark.range(0, 2_500, 1, 1).select(F.col("id").cast("string").alias("t"))
        got = [r["vector"][0] for r in encode_texts(df, "t", widths, 5_000, normalize=False).collect()]
        assert len(got) == 2_500 and max(got) <= 1_000
    finally:
        spark.conf.set(rows, before)
