import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import calibration as C, knn as K, models as G, novelty as N
from plumbline.operators.ordered import order_statistics


@pytest.fixture(scope="module")
def scores(spark):
    rnd = random.Random(3)
    rows = [(i, "ab"[i % 3 == 0], round(rnd.random(), 2), int(rnd.random() < 0.4)) for i in range(500)]
    return rows, spark.createDataFrame(rows, "id long, k string, s double, wrong int")


def brute_auroc(rows):
    p, n = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n))


def test_auroc(scores):
    rows, d = scores
    assert C.auroc(d, "s", "wrong").first()["auroc"] == pytest.approx(brute_auroc([(s, y) for _, _, s, y in rows]))
    for r in C.auroc(d, "s", "wrong", ["k"]).collect():
        assert r.auroc == pytest.approx(brute_auroc([(s, y) for _, k, s, y in rows if k == r.k]))
    assert C.auroc(d.filter("wrong = 1"), "s", "wrong").first()["auroc"] is None


def test_order_statistics(scores):
    rows, d = scores
    n = F.col("_n") - 1
    got = {r.k: r for r in order_statistics(d, ["k"], "s", {"a": n * 0.5, "b": n * 0.95}, blocks=7).collect()}
    for k in "ab":
        v = [s for _, kk, s, _ in rows if kk == k]
        assert got[k]["a"] == pytest.approx(np.quantile(v, 0.5)) and got[k]["b"] == pytest.approx(np.quantile(v, 0.95)) and got[k]["n"] == len(v)


def test_conformal(scores, spark):
    rows, d = scores
    w = sorted(s for _, _, s, y in rows if y)
    n = len(w)
    assert C.conformal_threshold(d, "s", "wrong").first()["threshold"] == w[min(int(np.ceil((n + 1) * 0.85)) - 1, n - 1)]
    assert C.conformal_threshold(d.filter("wrong = 0"), "s", "wrong").first()["threshold"] == 0.5


def test_bootstrap_is_repeatable(scores):
    _, d = scores
    a, b = (C.bootstrap_auroc(x, "id", "s", "wrong", 100).first() for x in (d, d.repartition(7)))
    assert a == b and a.lower < a.mean < a.upper


def test_kalman(spark):
    z = [.8, .2, .9, .1, .7, .3, .8, .2]
    x, p = z[0], 1.0
    for v in z[1:]:
        p += 0.01
        g = p / (p + 0.05)
        x, p = x + g * (v - x), (1 - g) * p
    d = spark.createDataFrame([(z,), ([],), ([2.0],)], "r array<double>")
    got = [r[0] for r in d.select(C.kalman(F.col("r"), q=0.01)).collect()]
    assert got == [pytest.approx(x, abs=1e-12), 0.5, 1.0]


def test_mesh_against_pairs(spark):
    from helpers import words
    rnd = random.Random(5)
    vocab = "red blue green cat dog bird sun moon star".split()
    ans = {(c, a): " ".join(rnd.sample(vocab, rnd.randint(0, 5))) for c in range(6) for a in range(1 + c)}
    d = spark.createDataFrame([(c, a, t) for (c, a), t in ans.items()], "chain_id long, agent long, answer string")
    t = spark.createDataFrame([(c, "LOW") for c in range(6)], "chain_id long, tier string")

    def f1(a, b):
        a, b = words(a), words(b)
        return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0
    for r in C.mesh(d, t).collect():
        texts = [v for (c, _), v in ans.items() if c == r.chain_id]
        pairs = [f1(a, b) for a, b in itertools.combinations(texts, 2)]
        mean = sum(pairs) / len(pairs) if pairs else 0.0
        assert r.agreement == pytest.approx(mean, abs=1e-9) and r.escalate == (mean < 0.3)
        assert r.upgraded_tier == ("MEDIUM" if mean >= 0.6 else "LOW")
        if mean >= 0.3:
            assert r.consensus == max(texts, key=lambda x: round(sum(f1(x, y) for y in texts) - f1(x, x), 9))


def test_mesh_limits_met_exactly(spark):
    """Two agents whose agreement is 0.3 or 0.6, at many sizes of their answers."""
    word = lambda i: "x" + chr(97 + i // 26) + chr(97 + i % 26)
    cases = [(a, total - a, shared) for total, shared in ((20, 3), (40, 6), (20, 6), (40, 12)) for a in range(shared, total // 2 + 1) if total - a >= shared]
    rows, want = [], {}
    for c, (a, b, shared) in enumerate(cases):
        rows += [(c, 0, " ".join(map(word, range(a)))), (c, 1, " ".join(map(word, range(a - shared, a - shared + b))))]
        want[c] = 2 * shared / (a + b)
    d = spark.createDataFrame(rows, "chain_id long, agent long, answer string")
    t = spark.createDataFrame([(c, "LOW") for c in want], "chain_id long, tier string")
    for r in C.mesh(d, t).collect():
        assert r.agreement == want[r.chain_id] and not r.escalate and r.consensus is not None, cases[r.chain_id]
        assert r.upgraded_tier == ("MEDIUM" if want[r.chain_id] == 0.6 else "LOW"), cases[r.chain_id]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    m = np.concatenate([rng.normal(c, 0.2, (60, 6)) for c in (0, 2, 5)])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    return m, spark.createDataFrame(rows, "vec_id long, v array<double>")


@pytest.mark.parametrize("limit", [K.BROADCAST_BYTES, 0])
def test_nearest_mean_both_ways(vectors, limit):
    m, d = vectors
    bank = d.filter("vec_id % 3 <> 0")
    ids = [i for i in range(len(m)) if i % 3]
    got = {r.vec_id: r.risk for r in K.nearest_mean(d, bank, 5, limit).collect()}
    for i in range(len(m)):
        dist = sorted(np.linalg.norm(m[i] - m[j]) for j in ids if j != i)[:5]
        assert got[i] == pytest.approx(np.mean(dist), abs=1e-9)


def test_search_in_many_blocks(vectors):
    m, d = vectors
    got = {r.vec_id: r.risk for r in K._by_blocks(d, d, 3, len(m), 10).collect()}
    want = {i: np.mean(sorted(np.linalg.norm(m - m[i], axis=1))[1:4]) for i in range(len(m))}
    assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_blocks_grow_with_the_bank(vectors, monkeypatch):
    """A query is sent to ``BLOCKS`` blocks of the nearest centres at most, however small the blocks asked for."""
    m, d = vectors
    asked, build = [], K.build_index
    monkeypatch.setattr(K, "BLOCKS", 4)
    monkeypatch.setattr(K, "build_index", lambda bank, n, block: (asked.append((n, block)), build(bank, n, block))[1])
    got = {r.vec_id: r.risk for r in K.nearest_mean(d, d, 3, 0, 2).collect()}
    want = {i: np.mean(sorted(np.linalg.norm(m - m[i], axis=1))[1:4]) for i in range(len(m))}
    assert asked == [(len(m), len(m) // 4)] and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


@pytest.mark.parametrize("limit", [K.BROADCAST_BYTES, 0])
def test_repeated_ids(spark, limit):
    bank = spark.createDataFrame([(1, [0.0]), (1, [0.5]), (1, [1.0]), (2, [5.0]), (3, [6.0]), (4, [9.0])], "vec_id long, v array<double>")
    q = spark.createDataFrame([(1, [0.0]), (1, [8.0]), (7, [0.0])], "vec_id long, v array<double>")
    got = sorted((r.vec_id, r.risk) for r in K.nearest_mean(q, bank, 2, limit, 2).collect())
    assert got == [(1, 1.5), (1, 5.5), (7, 0.25)]
    few = K.nearest_mean(q.filter("vec_id = 1 AND v[0] = 0"), bank.filter("vec_id < 3"), 3, limit, 2).collect()
    none = K.nearest_mean(q.filter("vec_id = 1"), bank.filter("vec_id = 1"), 2, limit, 2).collect()
    assert [r.risk for r in few] == [5.0] and {r.risk for r in none} == {0.5}


def test_index_visits_few_blocks_of_a_clustered_bank(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 10, (40, 8))
    m = centres[rng.integers(0, 40, 4000)] + rng.normal(0, 0.1, (4000, 8))
    d = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, v array<double>")
    q = d.filter("vec_id % 20 = 0")
    index = K.build_index(d, len(m), 20)
    asked = q.withColumn("row", F.col("vec_id"))
    first = K.visits(asked, index, 3).count()
    rest = K.visits(asked.withColumn("kth", F.lit(1.0)), index, 3).count()  # beyond every third distance here
    assert sum(index.size) == 4000 and first + rest < 200 * len(index.size) / 10
    got = {r.vec_id: r.risk for r in K._by_blocks(q, d, 3, len(m), 20).collect()}
    want = {i: np.mean(sorted(np.linalg.norm(m - m[i], axis=1))[1:4]) for i in got}
    assert len(got) == 200 and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_unfitted_bank(vectors):
    _, d = vectors
    assert {r.risk for r in K.nearest_mean(d, d.filter("vec_id < 1")).collect()} == {0.5}


def test_tightness(vectors):
    m, d = vectors
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = np.mean([u[i] @ u[j] for i, j in itertools.combinations(range(len(u)), 2)])
    assert K.tightness(d.withColumn("g", F.lit(1)), "g").first()["tightness"] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("tile,narrow", [(2048, 200_000), (25, 300)])
def test_pair_median(vectors, tile, narrow):
    m, d = vectors
    want = np.median([np.linalg.norm(a - b) for a, b in itertools.combinations(m, 2)])
    assert N.pair_median(d, tile, narrow) == pytest.approx(want, abs=1e-12)


def test_pair_median_takes_two_passes(spark, vectors, monkeypatch):
    from pyspark.sql import GroupedData
    m, d = vectors
    calls, run = [], GroupedData.applyInPandas
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda *a: (calls.append(1), run(*a))[1])
    want = np.median([np.linalg.norm(a - b) for a, b in itertools.combinations(m, 2)])
    assert N.pair_median(d, 25, 300, sample=60) == pytest.approx(want, abs=1e-12) and len(calls) == 2
    far = spark.createDataFrame([(i, [0.0 if i < 40 else 1e6 + i]) for i in range(60)], "vec_id long, v array<double>")
    x = [0.0 if i < 40 else 1e6 + i for i in range(60)]
    want = np.median([abs(a - b) for a, b in itertools.combinations(x, 2)])
    assert N.pair_median(far, 25, 300, sample=3, bins=64) == pytest.approx(want, abs=1e-9)  # the sample may mislead


def test_pair_median_sends_a_vector_to_few_tiles(spark, vectors, monkeypatch):
    """However small the tiles asked for, and with ids that occur twice."""
    m, d = vectors
    seen, run = [], N.F.sequence
    monkeypatch.setattr(N.F, "sequence", lambda a, b: (seen.append(b), run(a, b))[1])
    monkeypatch.setattr(N, "SPLITS", 4)
    want = np.median([np.linalg.norm(a - b) for a, b in itertools.combinations(m, 2)])
    assert N.pair_median(d, tile=2, narrow=300) == pytest.approx(want, abs=1e-12)
    assert [str(c) for c in seen] == [str(N.F.lit(3))]
    twice = spark.createDataFrame([(1, [0.0]), (1, [9.0]), (2, [1.0]), (3, [5.0])], "vec_id long, v array<double>")
    assert N.pair_median(twice, tile=1) == 4.0  # of 1, 4, 4, 5 and 8, without the pair of one id


def test_models_separate_and_repeat(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(i % 2 + rng.normal(0, 0.4)), float(rng.normal()), i % 2) for i in range(120)]
    d = spark.createDataFrame(rows, "id long, a double, b double, wrong int")
    m = G.fit_linear(d, ["a", "b"], balanced=True)
    assert C.auroc(d.withColumn("risk", m.risk()), "risk", "wrong").first()["auroc"] > 0.9
    assert m.importances()[0][1] > m.importances()[1][1]
    assert G.cross_validated(d, "id", ["a", "b"]) > 0.85 and G.cross_validated(d.filter("wrong = 1"), "id", ["a"]) is None
    folds = {(r.fold, r.wrong): r["count"] for r in G.stratified(d, "id", "wrong", 5).groupBy("fold", "wrong").count().collect()}
    assert set(folds.values()) == {12}
    iso = G.fit_isotonic(d, "a", "wrong")(d, "a").orderBy("a").collect()
    cal = [r.calibrated for r in iso]
    assert cal == sorted(cal) and 0 <= cal[0] and cal[-1] <= 1
    with pytest.raises(ValueError):
        G.fit_linear(d.filter("wrong = 1"), ["a"])
    assert G.promote(0.81, 0.80) and not G.promote(0.804, 0.80) and G.promote(0.5, None)


def test_bandit_starts_with_unpulled(spark):
    arms = spark.createDataFrame([(0, "x"), (1, "y")], "pos int, arm string")
    log = spark.createDataFrame([("x", 1.0)], "arm string, reward double")
    got = {r.arm: r for r in C.bandit_arms(log, arms, ["arm"], "reward", 2.0).collect()}
    assert got["y"].next and not got["x"].next and got["x"].mean_reward == 1.0


@pytest.mark.parametrize("scale,points", [(1.0, 4), (1e6, 4), (1e6, 300), (1.0, 1)])
def test_pair_median_with_equal_distances(spark, scale, points):
    from plumbline.operators.novelty import pair_median
    rng = np.random.default_rng(5)
    pts = rng.normal(size=(points, 3)) * scale
    vs = [pts[i % points].tolist() for i in range(300)]
    d = spark.createDataFrame(list(enumerate(vs)), "vec_id long, v array<double>")
    x = np.array(vs)
    want = np.median([np.sqrt(((x[i] - x[j]) ** 2).sum()) for i in range(300) for j in range(i)])
    assert abs(pair_median(d, tile=64, narrow=50) - want) <= 1e-9 * max(scale, 1)


def test_filter_over_a_whole_key(spark):
    rng = np.random.default_rng(6)
    rows = [(k, t, t, float(rng.random())) for k, n in ((1, 1), (2, 2), (3, 200)) for t in range(n)]
    d = spark.createDataFrame(rows, "k int, ts long, c long, risk double")
    want = {}
    for k, _, _, z in rows:
        if k not in want:
            want[k] = (z, 1.0)
        else:
            x, p = want[k][0], want[k][1] + 0.2
            g = p / (p + 0.05)
            want[k] = (x + g * (z - x), (1 - g) * p)
    got = {r.k: r.risk for r in C.kalman_by_key(d, ["k"], ["ts", "c"], "risk").collect()}
    assert all(abs(got[k] - min(max(x, 0), 1)) < 1e-12 for k, (x, _) in want.items())


def test_arms_of_many_domains_have_one_winner(spark):
    log = spark.createDataFrame([("m", f"d{i}", 0.5) for i in range(7)], "failure_mode string, domain string, reward double")
    arms = spark.createDataFrame([(m, f"d{i}", k * 7 + i) for k, m in enumerate(("m", "n")) for i in range(7)], "failure_mode string, domain string, pos int")
    assert C.bandit_arms(log, arms, ["failure_mode", "domain"], "reward", 1.0).where("next").count() == 1


def test_networks_train_as_published(spark, monkeypatch):
    asked = []
    net, lin = G.networks.fit, G.LogisticRegression

    def spy(df, names, label, row, scale, layers, members=1, share=None, alpha=1e-4, validation=0.1, epochs=500, seed=42):
        asked.append((list(layers), members, share, alpha, validation, epochs))
        return net(df, names, label, row, scale, layers, members, share, alpha, validation, 10, seed)

    monkeypatch.setattr(G.networks, "fit", spy)
    monkeypatch.setattr(G, "LogisticRegression", lambda **k: asked.append(k["maxIter"]) or lin(**{**k, "maxIter": 1}))
    d = spark.createDataFrame([(i, i % 2, float(i % 2), float(i % 7)) for i in range(60)], "chain_id long, wrong int, a double, b double")
    G.ensemble_risk(d, d, "chain_id", ["a", "b"]).count()
    G.fit_pair(d, ["a", "b"])
    assert asked == [([32, 16], 30, 0.8, 0.01, 0.15, 500), 1000, ([64, 32], 1, None, 1e-4, 0.1, 500)]


def test_linear_fit_takes_few_passes_however_many_rows(spark, monkeypatch):
    """Features that go together, one of them twice and one that never varies; the optimum is that of Newton's method on all rows."""
    passes = []

    class Counted(G.LogisticRegression):
        def _fit(self, d):
            m = super()._fit(d)
            passes.append(m.summary.totalIterations)
            return m

    monkeypatch.setattr(G, "LogisticRegression", Counted)
    names = ["a", "b", "c", "e", "f", "g"]
    for n in (400, 40_000):
        rng = np.random.default_rng(n)
        base, noise = rng.normal(size=n), rng.normal(size=(n, 4))
        x = np.column_stack([base, base + 0.1 * noise[:, 0], base + 0.01 * noise[:, 1], base - 0.003 * noise[:, 2] + 0.1 * noise[:, 0], base, np.full(n, 7.0)])
        y = (rng.random(n) < 1 / (1 + np.exp(-(base + noise[:, 1] - noise[:, 2])))).astype(int)
        d = spark.createDataFrame(pd.DataFrame({**dict(zip(names, x.T)), "wrong": y}))
        m = G.fit_linear(d, names, balanced=True)
        dev = np.where(x.std(0) < 1e-8, 1.0, x.std(0))
        z = np.column_stack([(x - x.mean(0)) / dev, np.ones(n)])
        w, ridge, want = np.where(y == 1, n / 2 / y.sum(), n / 2 / (n - y.sum())), np.array([1.0] * len(names) + [0.0]), np.zeros(len(names) + 1)
        for _ in range(30):
            q = 1 / (1 + np.exp(-z @ want))
            want = want - np.linalg.solve((z.T * (w * q * (1 - q))) @ z + np.diag(ridge), z.T @ (w * (q - y)) + ridge * want)
        np.testing.assert_allclose([*m.coef, m.intercept], want, atol=1e-7)
    assert max(passes) <= 25, passes


def test_newton_steps_end_at_the_optimum_from_afar(spark):
    """One row lies 70 deviations out; undamped steps from this start make the loss larger."""
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=500), np.ones(500)])
    x[0, 0] = 70.0
    y = (rng.random(500) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    data = spark.createDataFrame([([float(a)], float(b), 1.0) for a, b in zip(x[:, 0], y)], "x array<double>, y double, w double").withColumn("x", G.array_to_vector("x"))
    b = G._newton(data, np.array([-3.0, 4.0]), 1.0)
    g = x.T @ (1 / (1 + np.exp(-x @ b)) - y) + np.array([1.0, 0.0]) * b
    assert np.abs(g).max() < 1e-8
