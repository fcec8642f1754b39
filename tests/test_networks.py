import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import calibration as C, models as G, networks as N


def rows(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)  # no line tells these apart
    return spark.createDataFrame([(i, *map(float, v), int(w)) for i, (v, w) in enumerate(zip(x, y))], "id long, a double, b double, c double, wrong int")


def test_gradient_against_differences():
    rng, shape = np.random.default_rng(1), N.Shape([3, 5, 4, 1])
    flat, x, y = shape.start(2, 3), rng.normal(size=(20, 3)), rng.integers(0, 2, 20).astype(float)
    weight = rng.integers(0, 3, (2, 20)).astype(float)

    def loss(w):
        p = shape.forward(w, x)[-1][:, :, 0]
        part = -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum(1) / weight.sum(1)
        return part + 0.3 * sum((m ** 2).sum((1, 2)) for m, _ in shape.layers(w)) / 2 / len(x)

    g = shape.gradient(flat, x, y, weight, 0.3)
    for i in range(0, shape.n, 3):
        up, down = flat.copy(), flat.copy()
        up[:, i] += 1e-6
        down[:, i] -= 1e-6
        np.testing.assert_allclose(g[:, i], (loss(up) - loss(down)) / 2e-6, rtol=1e-4, atol=1e-7)
    weight[0] = 0
    assert not shape.gradient(flat, x, y, weight, 0.3)[0].any()


def test_draws_are_poisson_and_members_differ():
    h = np.arange(200_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    d = N.draws(N.uniform(h, 3, 0), 0.8)
    assert abs(d.mean() - 0.8) < 0.01 and abs(d.var() - 0.8) < 0.02
    assert abs(np.corrcoef(d, N.draws(N.uniform(h, 4, 0), 0.8))[0, 1]) < 0.01
    assert abs((N.uniform(h, 3, 1) < 0.15).mean() - 0.15) < 0.005


def test_learns_what_lines_cannot_and_repeats_itself(spark):
    d, test = rows(spark), rows(spark, 400, 9)
    how = dict(members=4, layers=(16, 8), max_iter=200)
    a = G.ensemble_risk(d.repartition(7), test, "id", ["a", "b", "c"], **how)
    b = G.ensemble_risk(d, test.repartition(3), "id", ["a", "b", "c"], **how)
    got = {r.id: (r.risk, r.uncertainty) for r in a.collect()}
    assert all(got[r.id] == pytest.approx((r.risk, r.uncertainty), abs=1e-12) for r in b.collect())
    scored = a.join(test.select("id", "wrong"), "id")
    assert C.auroc(scored, "risk", "wrong").first()["auroc"] > 0.9
    assert min(u for _, u in got.values()) >= 0 and max(u for _, u in got.values()) > 0


def test_shards_are_averaged_and_noise_stops_early(spark):
    d = rows(spark)
    scale = G.moments(d, ["a", "b", "c"])
    m = N.fit(d, ["a", "b", "c"], "wrong", F.col("id"), scale, (16, 8), members=2, epochs=150, shard=25)  # 24 shards, two levels
    scored = d.withColumn("risk", m.risk()["risk"])
    assert C.auroc(scored, "risk", "wrong").first()["auroc"] > 0.8
    noise = d.withColumn("wrong", F.pmod(F.xxhash64("id"), F.lit(2)))
    m = N.fit(noise, ["a", "b", "c"], "wrong", F.col("id"), scale, (32, 16), members=3, validation=0.3)
    assert max(m.rounds) < 15 and all(0.6 < v < 0.8 for v in m.losses)


def test_penalty_shrinks_weights(spark):
    d = rows(spark, 200)
    scale = G.moments(d, ["a", "b", "c"])
    size = [float((N.fit(d, ["a", "b", "c"], "wrong", F.col("id"), scale, (8,), alpha=a, epochs=100, patience=99).weights ** 2).sum()) for a in (0.0, 50.0)]
    assert size[1] < 0.8 * size[0]  # a hundred steps of at most a thousandth
