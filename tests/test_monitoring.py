import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.streaming import folds, jobs as J, replay, rules as M


def stability(target, ref):
    edges = np.linspace(0, 1, 11)
    t, r = (np.histogram(x, bins=edges)[0] for x in (target, ref))
    t, r = (t + 1e-4) / (len(target) + 1e-3), (r + 1e-4) / (len(ref) + 1e-3)
    return max(0.0, round(float(((t - r) * np.log(t / r)).sum()), 6))


def monitor(scores):
    """The self-fitting monitor, one score at a time."""
    events, base, buf, n, c, warm, thr = [], None, [], 0, 0.0, None, None
    for i, x in enumerate(scores, 1):
        if base is None:
            buf.append(x)
            if len(buf) >= 20:
                base, buf, n, c = list(buf), [], 0, 0.0
            continue
        buf, n, hit = [*buf, x][-50:], n + 1, None
        if n >= 20:
            mu, sd = np.mean(base), max(np.std(base), 1e-4)
            c = max(0.0, c + x - mu - 0.5 * sd)
            p = stability(buf, base)
            if c > 5 * sd:
                hit, c = ("ALARM", "CUSUM"), 0.0
            elif p >= 0.2:
                hit = ("ALARM", "PSI")
            elif p >= 0.1:
                hit = ("WARN", "PSI")
        if hit and hit[0] == "ALARM":
            base, buf, warm = None, [], [x]
        elif warm is not None:
            warm.append(x)
            if len(warm) >= 20:
                thr, warm = float(np.percentile(warm, 75)), None
        if hit:
            events.append((i, *hit, thr))
    return events


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(11)
    rows = []
    for k in ("x", "y"):
        for i in range(600):
            level = 0.3 if (i // 150) % 2 == 0 else 0.6
            rows.append((k, i * 60 + (0 if k == "x" else 7), len(rows), min(1.0, max(0.0, round(rnd.gauss(level, 0.1), 3)))))
    return rows, spark.createDataFrame(rows, "domain string, ts long, chain_id long, risk_score double")


def test_bins_match_histogram():
    v = np.array([0.0, 0.1, 0.3, 0.30000000000000004, 0.7, 0.7000000000000001, 0.9999, 1.0, -0.1, 1.1])
    b = folds.bins(v)
    h = np.histogram(v, bins=np.linspace(0, 1, 11))[0]
    assert [int((b == i).sum()) for i in range(10)] == h.tolist() and list(b[-2:]) == [-1, -1]


def test_monitor_batch_and_stream(spark, series):
    rows, d = series
    want = {(k, *e) for k in ("x", "y") for e in monitor([r[3] for r in rows if r[0] == k])}
    assert any(e[2] == "ALARM" for e in want)
    got = {(r.domain, r.seq, r.severity, r.detector, r.threshold) for r in M.drift_monitor(d).collect()}
    assert got == want
    J.use_rocksdb(spark)
    s = J.stream_of(spark, J.sliced(d, "ts", 3), d.schema)
    out = J.run_now(J.keyed_fold(s, ["domain"], ["ts", "chain_id"], folds.Drift())).collect()
    assert {(r.domain, r.seq, r.severity, r.detector, r.threshold) for r in out} == want


@pytest.mark.parametrize("block", [7, 40, 5000])
def test_detector_blocks_equal_one_walk(spark, series, block):
    rows, d = series
    base = M.baseline(d.filter("ts < 6000"), ["domain"])
    new = d.filter("ts >= 6000")
    key = lambda df: sorted((r.domain, r.seq, r.severity, r.detector, round(r.psi, 6), round(r.cusum, 9)) for r in df.collect())
    num = replay.numbered(new, ["domain"], "ts", "chain_id").join(base, "domain")
    assert key(M.drift_events(new, base, block=block)) == key(replay.in_order(num, ["domain"], ["seen"], folds.Drift(relearn=False)))


@pytest.fixture(scope="module")
def calm(spark):
    """Long runs without an alarm and a level that jumps, no noise at all, noise that never settles, and too few rows."""
    rnd, rows = random.Random(3), []
    for i in range(2400):
        rows.append(("quiet", i, len(rows), round(rnd.gauss(0.35 if (i // 800) % 2 == 0 else 0.65, 0.004), 5)))
        rows.append(("flat", i, len(rows), 0.25))
        if i < 500:
            rows.append(("wild", i, len(rows), round(rnd.random(), 3)))
    rows += [("short", i, len(rows) + i, 0.5) for i in range(15)]
    return rows, spark.createDataFrame(rows, "domain string, ts long, chain_id long, risk_score double")


@pytest.mark.parametrize("keys, block, rounds", [(("quiet", "flat", "short"), 64, 10), (("wild", "quiet", "short"), 150, 6)])
def test_restarts_join_up_to_one_walk(spark, calm, keys, block, rounds, monkeypatch):
    rows = [r for r in calm[0] if r[0] in keys]
    want = {(k, *e) for k in keys for e in monitor([r[3] for r in rows if r[0] == k])}
    names, write = [], replay.written
    monkeypatch.setattr(replay, "written", lambda s, df, name: (names.append(name), write(s, df, name))[1])
    got = M.drift_monitor(calm[1].filter(F.col("domain").isin(*keys)), block=block).collect()
    assert {(r.domain, r.seq, r.severity, r.detector, r.threshold) for r in got} == want and len(got) == len(want)
    assert names.count("crossed") <= rounds  # a walk block by block would take 37 and 15


def test_noise_takes_no_more_rounds_than_blocks(spark, monkeypatch):
    """Noise keeps each run's own beat of 40 rows; 4 blocks of 300 rows, not 60 of 20."""
    rnd = random.Random(4)
    rows = [("wild", i, i, round(rnd.random(), 3)) for i in range(1200)]
    d = spark.createDataFrame(rows, "domain string, ts long, chain_id long, risk_score double")
    names, write = [], replay.written
    monkeypatch.setattr(replay, "written", lambda s, df, name: (names.append(name), write(s, df, name))[1])
    monkeypatch.setattr(M, "RESTART_BLOCKS", 4, raising=False)
    got = M.drift_monitor(d, block=20).collect()
    assert {(r.domain, r.seq, r.severity, r.detector, r.threshold) for r in got} == {("wild", *e) for e in monitor([r[3] for r in rows])}
    assert names.count("crossed") <= 4


def test_fifty_quiet_blocks_in_few_rounds(spark, monkeypatch):
    """A CUSUM that creeps up over all blocks and is never at zero."""
    n = 50 * 20
    rows = [("a", i, i, 0.3501 + 0.0002 * (i % 2)) for i in range(n)] + [("b", i, n + i, 0.3) for i in range(n)]
    d = spark.createDataFrame(rows, "domain string, ts long, chain_id long, risk_score double")
    base = spark.createDataFrame([(k, 0.3, 0.1, [0, 0, 0, 50, 0, 0, 0, 0, 0, 0], 50) for k in "ab"],
                                 "domain string, base_mean double, base_std double, base_hist array<long>, base_n long")
    names, write = [], replay.written
    monkeypatch.setattr(replay, "written", lambda s, df, name: (names.append(name), write(s, df, name))[1])
    monkeypatch.setattr(replay, "FAN", 4)
    key = lambda df: sorted((r.domain, r.seq, r.severity, r.detector, round(r.psi, 6), round(r.cusum, 9)) for r in df.collect())
    got = key(M.drift_events(d, base, block=20))
    assert names.count("maps") == 3 and names.count("entries") == 3
    num = replay.numbered(d, ["domain"], "ts", "chain_id").join(base, "domain")
    assert got == key(replay.in_order(num, ["domain"], ["seen"], folds.Drift(relearn=False)))


def test_effects_of_blocks_chain_up():
    """Against a walk, from many entries, for noise, creep and jumps."""
    rnd, f = np.random.default_rng(1), folds.Cusum()

    def rows(x, first):
        return {"risk_score": x, "seen": np.arange(first, first + len(x)), "ts": 0, "_lead": False, "base_mean": 0.3, "base_std": 0.1,
                "base_hist": [[5] * 10] * len(x), "base_n": 50}

    import pandas as pd
    for trial in range(60):
        level, noise = [(0.35, 0.1), (0.3, 0.1), (0.4, 0.3), (0.349, 0.0001), (0.3505, 0.002), (0.9, 0.2)][trial % 6]
        parts = [pd.DataFrame(rows(rnd.normal(level, noise, rnd.integers(1, 40)), 100 * (i + 1))) for i in range(3)]
        whole = f.chain([f.effect(p) for p in parts])
        for c in [0.0, 0.001, 0.1, 0.25, 0.4, 0.49, 0.5, *rnd.uniform(0, 0.5, 4)]:
            now = c
            for p in parts:
                now = f.run(now, p)[0]
            assert abs(f.after(whole, c) - now) < 1e-12


def cisc(rows):
    ht, lt, out, hist = 0.5, 0.7, [], []
    clamp = lambda v: max(0.25, min(0.9, round(v, 3)))
    for tier, wrong in rows:
        hist.append((tier, wrong))
        na, nw = sum(t == "LOW" for t, _ in hist), sum(w for _, w in hist)
        nt = sum(t == "LOW" and w for t, w in hist)
        if len(hist) >= 20:
            pg, rg = (nt + 1) / (na + 2) - 0.8, (nt + 1) / (nw + 2) - 0.6
            if pg > 0.05 and rg < -0.05:
                lt = clamp(lt - 0.02)
            elif pg < -0.05:
                lt = clamp(lt + 0.02)
            high = [w for t, w in hist if t == "HIGH"]
            rate = sum(high) / len(high) if high else 0.0
            if rate > 0.35:
                ht = clamp(ht - 0.02)
            elif rate < 0.10 and ht < lt - 0.10:
                ht = clamp(ht + 0.02)
            if ht >= lt - 0.10:
                lt = clamp(ht + 0.10)
        out.append((ht, lt))
    return out


@pytest.mark.parametrize("block", [5, 4096])
def test_adaptive_thresholds(spark, block):
    rnd = random.Random(2)
    rows = [("u", i * 10, i, rnd.choice(["HIGH", "MEDIUM", "LOW"]), rnd.random() < (0.05 if i < 120 else 0.6)) for i in range(260)]
    d = spark.createDataFrame(rows, "domain string, ts long, chain_id long, tier string, was_wrong boolean")
    want = cisc([(r[3], r[4]) for r in rows])
    got = {r.seq: (r.high_threshold, r.low_threshold) for r in M.cisc_thresholds(d, ["domain"], block).collect()}
    assert [got[i + 1] for i in range(len(rows))] == want
    assert all(fixed.CISC_MIN <= v <= fixed.CISC_MAX for p in want for v in p)


def test_suppression_counts_from_the_last_fired(spark):
    times = [0, 10, 250, 299, 300, 361, 601, 602]
    d = spark.createDataFrame([(1, "d", "m", t, i) for i, t in enumerate(times)] + [(2, "d", "m", 5, 99)], "user_id long, domain string, mode string, ts long, chain_id long")
    got = sorted((r.user_id, r.ts) for r in M.fired_alerts(d).collect())
    assert got == [(1, 0), (1, 300), (1, 601), (2, 5)]
    J.use_rocksdb(spark)
    s = J.stream_of(spark, J.sliced(d, "ts", 3, 1), d.schema, 1)
    out = J.run_now(J.keyed_fold(s, ["user_id", "domain", "mode"], ["ts", "chain_id"], folds.Dedup())).filter("NOT late")
    assert sorted((r.user_id, r.ts) for r in out.collect()) == got


def test_late_rows_change_nothing(spark):
    J.use_rocksdb(spark)
    path = J.sliced(spark.createDataFrame([(1, 1000, 1)], "k long, ts long, chain_id long"), "ts", 1, 1)
    spark.createDataFrame([(1, 10, 2), (1, 1400, 3)], "k long, ts long, chain_id long").coalesce(1).write.mode("append").parquet(path)
    s = J.stream_of(spark, path, "k long, ts long, chain_id long", 1)
    got = {(r.ts, r.late) for r in J.run_now(J.keyed_fold(s, ["k"], ["ts", "chain_id"], folds.Dedup())).collect()}
    assert got == {(1000, False), (1400, False), (10, True)}


def test_stability_index(spark, series):
    rows, d = series
    ref, new = d.filter("ts < 9000"), d.filter("ts >= 9000")
    for r in M.stability_index(ref, new, ["domain"]).collect():
        a = [x[3] for x in rows if x[0] == r.domain and x[1] < 9000]
        b = [x[3] for x in rows if x[0] == r.domain and x[1] >= 9000]
        assert r.psi == pytest.approx(stability(b, a), abs=2e-6)


def test_rate_window(spark):
    rnd = random.Random(4)
    ts = sorted(rnd.randrange(0, 20_000) for _ in range(400))
    d = spark.createDataFrame([("k", t) for t in ts], "k string, ts long")
    for r in M.rate_check(d, ["k"], 3600, 50).collect():
        n = sum(r.ts - 3600 <= t <= r.ts for t in ts)
        assert r.in_window == n and r.over_limit == (n > 50)


def test_thresholds_fall_back(spark):
    e = spark.createDataFrame([("a", 1, 0.8), ("a", 2, 0.9), ("b", 1, None)], "domain string, seq long, threshold double")
    m = spark.createDataFrame([("b", 0.6), ("c", 0.5)], "domain string, manual double")
    assert {r.domain: r.threshold for r in M.domain_thresholds(e).collect()} == {"a": 0.9, "b": 0.7}
    assert {r.domain: r.threshold for r in M.domain_thresholds(e, m).collect()} == {"a": 0.9, "b": 0.6, "c": 0.5}


def test_online_calibration_keeps_refitting(spark):
    online = J.OnlineIsotonic(keep=50, every=10)
    for b in range(12):
        online(spark.createDataFrame([(b * 10 + i, b * 10 + i, i / 10, int(i > 5)) for i in range(10)], "ts long, chain_id long, score double, label int"), b)
    assert online.versions.last(spark)["fits"] == 12 and online.buffer(spark).count() == 50


def test_guardrail_staircase_equals_every_rule(spark):
    rnd = random.Random(8)
    rules = [(i, rnd.choice(["a", "b", "*"]), round(rnd.random(), 2), f"act{i}", rnd.random() < 0.7) for i in range(60)]
    chains = [(i, rnd.choice(["a", "b", "c"]), round(rnd.random(), 3)) for i in range(300)]
    r = spark.createDataFrame(rules, "rule_id int, rule_domain string, threshold double, action string, enabled boolean")
    c = spark.createDataFrame(chains, "chain_id int, domain string, risk_score double")
    want = {}
    for i, d, s in chains:
        hit = [x for x in rules if x[4] and x[1] in ("*", d) and s >= x[2]]
        if hit:
            want[i] = (min(hit)[0], min(hit)[3])
    assert {x.chain_id: (x.rule_id, x.action) for x in M.match_guardrails(c, r).collect()} == want


def test_threshold_tables_equal_one_walk(spark, monkeypatch):
    import random
    rng, rows = random.Random(3), []
    for i in range(900):  # one calibrated domain, which makes no moves, and one that drifts
        rows.append(("calm", i, i, "LOW" if rng.random() < 0.4 else "HIGH" if rng.random() < 0.5 else "MEDIUM", rng.random() < 0.3))
        rows.append(("wild", i, i, rng.choice(["LOW", "HIGH", "MEDIUM"]), rng.random() < (0.9 if i % 300 < 150 else 0.05)))
    d = spark.createDataFrame(rows, "domain string, ts long, chain_id long, tier string, was_wrong boolean")
    c = M.cisc_counters(d, ["domain"])
    key = lambda df: sorted((r.domain, r.seq, r.high_threshold, r.low_threshold) for r in df.collect())
    want = key(replay.in_order(c, ["domain"], ["n_obs"], folds.Cisc()))
    monkeypatch.setattr(replay, "FAN", 4)
    for block in (10, 64, 5000):
        assert key(M.cisc_thresholds(d, ["domain"], block)) == want
