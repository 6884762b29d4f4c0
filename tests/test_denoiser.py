import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators.autodiff import Value, concatenate
from tidewell.operators.denoiser import AttentionDenoiser, make_batch, sines
from tidewell.operators.forecast import DiffusionForecaster, schedule_table
from tidewell.operators.numbering import hash_rank


def sample(rng, n_x=5, n_y=3):
    n = n_x + n_y
    return pd.DataFrame({"pos": range(n), "vind": rng.integers(0, 3, n), "minute": np.sort(rng.integers(0, 40, n)), "value": rng.standard_normal(n), "is_target": [0] * n_x + [1] * n_y})


def test_gradients_of_operations():
    rng = np.random.default_rng(0)
    a, b, t = rng.standard_normal((2, 3, 4)), rng.standard_normal((4, 4)), rng.standard_normal((5, 4))

    def run(a, b, t):
        x, y, z = Value(a), Value(b), Value(t)
        h = (x @ y).silu().unit() + z.rows(np.array([[0, 1, 1], [2, 4, 0]]))
        h = concatenate(h, x * 2.0, 1).softmax()
        return x, y, z, (h.swap(1, 2) @ h * 0.3).reshape(2, -1).silu().sum()

    x, y, z, out = run(a, b, t)
    out.backward()
    for array, node in ((a, x), (b, y), (t, z)):
        for _ in range(6):
            i = tuple(rng.integers(0, s) for s in array.shape)
            old, got = array[i], []
            for step in (1e-6, -1e-6):
                array[i] = old + step
                got.append(run(a, b, t)[3].data)
            array[i] = old
            assert (got[0] - got[1]) / 2e-6 == pytest.approx(node.grad[i], abs=1e-5)


def test_padding_has_no_influence():
    rng = np.random.default_rng(1)
    model = AttentionDenoiser(3, channels=8, heads=2, layers=2)
    model.weights["out"].data = rng.standard_normal((8, 1))
    small, large = sample(rng), sample(rng, 9, 6)
    both, alone = make_batch([small, large]), make_batch([small])
    noise = rng.standard_normal((2, 6))
    a = model.predict(both, noise, np.array([3, 3])).data[0, :3]
    b = model.predict(alone, noise[:1, :3], np.array([3])).data[0]
    assert a == pytest.approx(b)


def test_training_lowers_the_loss_and_keeps_the_best():
    rng = np.random.default_rng(2)
    batch = make_batch([sample(rng) for _ in range(24)])
    model = AttentionDenoiser(3, channels=8, heads=2, layers=1, steps=10)
    scores = iter([3.0, 1.0, 2.0, 2.0, 2.0])
    kept = []

    def valid():
        kept.append(model.state())
        return next(scores)

    losses = model.fit(lambda epoch: [batch] * 4, valid, epochs=90, rate=5e-3, every=10, patience=3)
    assert len(losses) == 50 and np.mean(losses[-10:]) < 0.9 * losses[0]
    assert all((model.weights[k].data == v).all() for k, v in kept[1].items())
    other = AttentionDenoiser(3, channels=8, heads=2, layers=1, steps=10, seed=9)
    other.from_bytes(model.to_bytes())
    assert (other.weights["q0"].data == model.weights["q0"].data).all()


def test_forecast_in_spark(spark):
    rng, rows = np.random.default_rng(3), []
    for stay in (1, 2):
        s = sample(rng)
        rows += [(stay, int(r.pos), int(r.vind), int(r.minute), float(r.value), int(r.is_target)) for r in s.itertuples()]
    df = spark.createDataFrame(rows, "stay_id long, pos int, vind int, minute long, value double, is_target int")
    model = AttentionDenoiser(3, channels=8, heads=2, layers=1, steps=6)
    made = DiffusionForecaster(model, seed=1, steps=6).forecast(df, 5).collect()
    assert len(made) == 6 and all(len(r["draws"]) == 5 and np.isfinite(r["draws"]).all() for r in made)


def test_sines():
    assert sines(np.array([0.0]), 4).tolist() == [[0.0, 0.0, 1.0, 1.0]] and sines(np.zeros((2, 3)), 5).shape == (2, 3, 5)


def test_schedule_table(spark):
    rows = schedule_table(spark, 50).orderBy("step").collect()
    assert rows[0]["alpha"] == pytest.approx(1 - 0.0001) and rows[49]["beta"] == pytest.approx(0.5) and len(rows) == 50


def test_hash_rank(spark):
    df = spark.range(500).withColumn("d", F.md5(F.col("id").cast("string")))
    got = hash_rank(df, F.col("d"), "id").orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(500)) and [r["d"] for r in got] == sorted(r["d"] for r in got) and got[0]["n"] == 500
