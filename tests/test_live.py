"""Live scores: order, gaps, late steps and idle chains."""

import datetime as dt

from plumbline.session import new_dir
from plumbline.streaming import folds, jobs as J

KIND = "chain_id long, step_idx int, at timestamp, thought string, action_type string, action_arg string, observation string"


def run(spark, files, idle_ms=3_600_000, lateness="1 minute"):
    J.use_rocksdb(spark)
    path, t0 = new_dir(spark, "live"), dt.datetime(2024, 1, 1)
    for rows in files:
        data = [(c, i, t0 + dt.timedelta(minutes=m), f"think about thing {i}", "Search", "x", f"thing {i} was found") for c, i, m in rows]
        spark.createDataFrame(data, KIND).coalesce(1).write.mode("append").parquet(path)
    got = J.run_now(J.live_scores(J.stream_of(spark, path, spark.read.parquet(path).schema, 1), lateness, idle_ms)).collect()
    return sorted(((r.chain_id, r.t, r.status) for r in got), key=str), {(r.chain_id, r.t): r.risk_score for r in got if r.status != "late"}


def test_chain_silent_for_a_batch_keeps_its_state(spark):
    got, _ = run(spark, [[(1, 0, 0)], [(2, 0, 1)], [(1, 1, 2)], [(1, 2, 3)]])
    assert got == [(1, 1, "scored"), (1, 2, "scored"), (1, 3, "scored"), (2, 1, "scored")]


def test_steps_out_of_order_give_the_scores_of_the_order(spark):
    got, late = run(spark, [[(1, 0, 0), (1, 2, 2)], [(1, 1, 1)], [(1, 1, 1)]], lateness="1 hour")
    assert got == [(1, 1, "scored"), (1, 2, "late"), (1, 2, "scored"), (1, 3, "scored")]
    _, plain = run(spark, [[(1, 0, 0)], [(1, 1, 1)], [(1, 2, 2)]], lateness="1 hour")
    assert late == plain


def test_idle_chain_leaves_and_its_waiting_steps_are_scored(spark):
    got, _ = run(spark, [[(1, 0, 0), (1, 2, 1)], [(2, 0, 200)], [(2, 1, 400)], [(2, 2, 401)]])
    assert got == [(1, 1, "scored"), (1, 2, "gap"), (2, 1, "scored"), (2, 2, "scored"), (2, 3, "scored")] or got == [
        (1, 1, "scored"), (1, 2, "gap"), (2, 1, "scored"), (2, 1, "scored"), (2, 2, "scored")]


def test_step_after_a_pause_goes_on_where_the_chain_stopped(spark):
    got, risks = run(spark, [[(1, 0, 0), (1, 1, 1)], [(2, 0, 100)], [(2, 1, 200)], [(1, 2, 201), (1, 1, 201)], [(2, 2, 202)]])
    assert [r for r in got if r[0] == 1] == [(1, 1, "scored"), (1, 2, "late"), (1, 2, "scored"), (1, 3, "scored")]
    _, plain = run(spark, [[(1, 0, 0), (1, 1, 1), (1, 2, 2)]])
    assert all(risks[1, t] == plain[1, t] for t in (1, 2, 3))


def test_alert_state_ends_with_its_window(spark):
    J.use_rocksdb(spark)
    rows = [("a", 0, 1), ("a", 10, 2), ("b", 20, 3), ("a", 290, 4), ("a", 300, 5), ("b", 500, 6), ("c", 5000, 7), ("c", 9000, 8), ("b", 9001, 9)]
    path = new_dir(spark, "alerts")
    for k, t, c in rows:
        spark.createDataFrame([(k, t + 1000, c)], "domain string, ts long, chain_id long").coalesce(1).write.mode("append").parquet(path)
    s = J.stream_of(spark, path, spark.read.parquet(path).schema, 1)
    out, check = new_dir(spark, "sink"), new_dir(spark, "check")
    d = J.keyed_fold(s, ["domain"], ["ts", "chain_id"], folds.Dedup(300), ttl=300)
    d.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.domain, r.ts - 1000) for r in spark.read.parquet(out).collect()) == [("a", 0), ("a", 300), ("b", 20), ("b", 500), ("b", 9001), ("c", 5000), ("c", 9000)]
    left = spark.read.format("statestore").option("stateVarName", "fold").load(check).select("key.domain").collect()
    assert {r.domain for r in left} <= {"b", "c"}  # the last fired at 9001 and 9000, "a" at 300


def test_alerts_reach_a_callback_batch_by_batch(spark):
    rows = [(i, i % 3 == 0, i) for i in range(30)]
    d = spark.createDataFrame(rows, "chain_id long, needs_alert boolean, ts long")
    s, got = J.stream_of(spark, J.sliced(d, "ts", 3, 1), d.schema, 1), []
    J.alert_batches(s, lambda batch, number: got.append((number, [r.chain_id for r in batch.collect()])), new_dir(spark, "check")).trigger(
        availableNow=True).start().awaitTermination()
    assert [n for n, _ in got] == [0, 1, 2] and sorted(c for _, cs in got for c in cs) == list(range(0, 30, 3))


def test_batch_state_survives_a_restart(spark):
    rows = [(i, i, (i * 37 % 100) / 100, int(i * 37 % 100 > 50), "ab"[i % 2]) for i in range(90)]
    d = spark.createDataFrame(rows, "ts long, chain_id long, score double, label int, domain string")
    path = J.sliced(d, "ts", 6, 1)
    stream = lambda files=1: J.stream_of(spark, path, d.schema, files)

    whole = J.OnlineIsotonic(40, 10)
    J.run_batches(stream(), whole, "append")
    folder, check = new_dir(spark, "state"), new_dir(spark, "check")
    stopped = J.OnlineIsotonic(40, 10, folder)

    def until(batch, batch_id):
        if batch_id == 3:
            raise RuntimeError("lost")
        stopped(batch, batch_id)
    try:
        J.run_batches(stream(), until, "append", check)
    except Exception as lost:
        assert "lost" in str(lost)
    again = J.OnlineIsotonic(40, 10, folder)
    again(d.limit(15), 2)  # a batch that is done already
    J.run_batches(stream(), again, "append", check)
    key = lambda o: sorted(tuple(r) for r in o.buffer(spark).collect())
    assert key(again) == key(whole) and again.versions.last(spark) == whole.versions.last(spark)
    fit = lambda o: [r.calibrated for r in o.model(spark)(d.orderBy("ts"), "score").select("ts", "calibrated").orderBy("ts").collect()]
    assert fit(again) == fit(whole)

    sums = stream().groupBy("domain").count()
    one = J.Snapshot(["domain"])
    J.run_batches(sums, one)
    one(spark.createDataFrame([("a", 5)], "domain string, count long"), 1)
    assert {(r.domain, r["count"]) for r in one.table(spark).collect()} == {("a", 45), ("b", 45)}


def test_prefix_score_is_the_one_of_the_batch(spark):
    """Half-way scores, which a corrected sum lifts over a limit that the batch's sum stays below."""
    from pyspark.sql import functions as F
    from plumbline.operators.features import nano_mean
    for gap, words in ((0.5, 40.0), (0.25, 27.5), (0.7, 50.0), (0.4, 35.0)):
        row = {"action_type": "Search", "gap": gap, "used": 0.5, "step_risk": None, "th_words": words, "tt": []}
        parts = {"sc1": 0.0, "sc2": 0.1, "sc3": 1 - gap, "sc5": words / 50, "sc6": 0.5, "sc11": 1.0, "sc9": None, "sc10": None, "sc12": None}
        batch = spark.range(1).select(*[F.lit(v).cast("double").alias(c) for c, v in parts.items()]).select(nano_mean()).first()[0]
        assert J.LiveChain.step(J.LiveChain.fresh(), row) == batch
