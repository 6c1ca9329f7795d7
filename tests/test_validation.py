import numpy as np
import pytest

from qrelia.operators.encode import hashing_encoder
from qrelia.operators.loss import batch_loss
from qrelia.plans.validation import Checkpoint, LossSettings, judge_runs, log_checkpoint, log_run, validation_loss
from qrelia.sources.metric_log import append_metrics, appends, read_metrics

LOG = "run_id string, epoch double, steps long, value double"


def held_out(spark, n=21, negatives=True):
    rows = [(i, f"word{i} a b", f"word{i} c", f"word{(i * 7) % n} d e") for i in range(n)]
    df = spark.createDataFrame(rows, "pos long, sentence_0 string, sentence_1 string, sentence_2 string").repartition(4)
    return rows, df if negatives else df.drop("sentence_2")


@pytest.mark.parametrize("negatives", [True, False])
def test_loss_of_texts(spark, negatives):
    rows, df = held_out(spark, negatives=negatives)
    encode = hashing_encoder(24)()
    sides = [encode([r[1 + i] for r in rows]) for i in range(3 if negatives else 2)]
    want = [
        sum(batch_loss(sides[0][b : b + 8, :d], np.concatenate([s[b : b + 8, :d] for s in sides[1:]])) for d in (24, 5))
        for b in range(0, len(rows), 8)
    ]
    got = validation_loss(df, hashing_encoder(24), LossSettings(8, (24, 5))).first()
    assert got["n_batches"] == 3 and got["loss"] == pytest.approx(np.mean(want))


def test_a_retry_replaces_and_the_last_append_wins(spark, tmp_path):
    path = str(tmp_path / "log")

    def add(value, steps=100, number=None, run="a"):
        return append_metrics(spark.createDataFrame([(run, 0.5, steps, value)], LOG), path, number)

    assert read_metrics(spark, path).collect() == []
    assert [add(3.0), add(2.0, 200), add(9.0, 200, run="b")] == [0, 1, 2]
    assert add(2.5, 200, number=1) == 1
    assert add(1.5) == 3
    broken = tmp_path / "log" / "append=000000004"
    broken.mkdir()
    (broken / "part-0.csv").write_text("run_id,epoch,steps,value\na,0.5,100,0.000001\n")  # never committed
    assert appends(spark, path) == [0, 1, 2, 3]
    got = sorted(tuple(r) for r in read_metrics(spark, path).select("run_id", "step", "value").collect())
    assert got == [("a", 100, 1.5), ("a", 200, 2.5), ("b", 200, 9.0)]


def test_run_stops_after_patience(spark, tmp_path):
    _, df = held_out(spark)
    path, settings = str(tmp_path), LossSettings(8)
    dims = [4, 64, 64, 2, 128]  # equal losses are no improvement
    log_run(df, "r", [Checkpoint(i, 10 * i, hashing_encoder(d)) for i, d in enumerate(dims, 1)], path, settings)
    row = judge_runs(spark, path, 2).first()
    assert (row["run_id"], row["stop_step"], row["best_step"]) == ("r", 40, 20)
    log_checkpoint(df, "r", Checkpoint(3, 30, hashing_encoder(256)), path, settings)  # step 30 is judged anew
    assert judge_runs(spark, path, 2).first()["best_step"] in (20, 30, 50)


def test_no_rows_have_no_loss(spark):
    _, df = held_out(spark)
    row = validation_loss(df.limit(0), hashing_encoder(8), LossSettings(4)).first()
    assert (row["n_batches"], row["loss"]) == (0, 0.0)
