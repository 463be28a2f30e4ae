"""Fitted calibrators against a plain descent on the same data, all at once and with a group left out."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from granary.operators import fitting as C


def descended(x, rows, loss):
    """Plain descent with halving, for long."""
    step, (f, g) = 1e-3, loss(x, rows)
    for _ in range(20_000):
        f2, g2 = loss(x - step * g, rows)
        if f2 < f:
            x, f, g, step = x - step * g, f2, g2, step * 1.3
        else:
            step /= 2
        if np.abs(g).max() < 1e-6 * len(rows) or step < 1e-15:
            break
    return x, f / len(rows)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    out = []
    for i in range(600):
        k, src = int(rng.choice([3, 4])), "abc"[i % 3]
        z = rng.normal(size=k) * 2
        p = np.exp(z / 2 + 0.5 * np.arange(k))
        y = int(rng.choice(k, p=p / p.sum()))
        q = float(rng.uniform(0.01, 0.99))
        out.append((src, z.tolist(), np.eye(k)[y].tolist(), q, float(rng.random() < 1 / (1 + math.exp(-(0.7 * math.log(q) - 1.5 * math.log(1 - q) + 0.3))))))
    return pd.DataFrame(out, columns=["s", "logits", "target", "p", "y"])


def test_gradients(data):
    rng = np.random.default_rng(2)
    for loss, size in ((C.vector_loss, 3), (C.vector_loss, 6), (C.beta_loss, 3)):
        x = rng.normal(size=size) * 0.3
        f, g = loss(x, data)
        for i in range(size):
            e = np.eye(size)[i] * 1e-5
            assert (loss(x + e, data)[0] - loss(x - e, data)[0]) / 2e-5 == pytest.approx(g[i], abs=1e-3)


@pytest.mark.parametrize("left_out", [False, True])
def test_fits(spark, data, left_out):
    df = spark.createDataFrame(data).repartition(5)
    of = lambda s: data[data.s != s] if left_out else data[data.s == s]
    for r in C.vector_scaling(df, "s", places=4, left_out=left_out).collect():
        x, f = descended(np.zeros(4), of(r.s), C.vector_loss)
        assert r.n == len(of(r.s)) and r.nll == pytest.approx(f, abs=1e-6) and [math.log(r.t), *r.bias] == pytest.approx(x.tolist(), abs=5e-3)
    for r in C.beta_scaling(df, "s", left_out=left_out).collect():
        x, f = descended(np.array([1.0, 1.0, 0.0]), of(r.s), C.beta_loss)
        assert r.nll == pytest.approx(f, abs=1e-6) and [r.a, r.b, r.c] == pytest.approx(x.tolist(), abs=2e-2)


def test_scaled_and_batch_calibrated(spark, data):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], 2.0, [0.5, -0.5])], "z array<double>, t double, b array<double>")
    assert df.select(C.scaled(F.col("z"), F.col("t"), F.col("b"))).first()[0] == [0.5, 1.5, 1.0, 1.5]
    rows = spark.createDataFrame([(i, "choice" if i < 100 else "score", z) for i, z in enumerate(data.logits)], "id long, type string, logits array<double>")
    got = {r.id: r.logits for r in C.batch_calibrated(rows).collect()}
    for k in (3, 4):
        mine = [z for z in data.logits[:100] if len(z) == k]
        mean = np.mean([np.exp(z) / np.exp(z).sum() for z in mine], axis=0)
        for i, z in enumerate(data.logits[:100]):
            if len(z) == k:
                assert got[i] == pytest.approx((np.array(z) - np.log(mean)).tolist())
    assert got[200] == data.logits[200]


def test_empty(spark):
    assert C.vector_scaling(spark.createDataFrame([], "s string, logits array<double>, target array<double>"), "s").count() == 0
