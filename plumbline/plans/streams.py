"""Queries: the streaming jobs, run over everything there is and compared with the batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import analytics as A
from plumbline.plans import views as V
from plumbline.plans.monitoring import alerts, outcomes
from plumbline.plans.registry import ORACLE, query
from plumbline.plans.traces import prefix_sql, r6
from plumbline.plans.views import with_views
from plumbline.session import written
from plumbline.streaming import folds, jobs as J


def as_stream(df, ts="ts", slices=4):
    J.use_rocksdb(df.sparkSession)
    return J.stream_of(df.sparkSession, J.sliced(df, ts, slices), df.schema)


@query("i4_drift_stream", ORACLE["i4_drift_monitor"])
def i4_stream(spark, base):
    s = as_stream(V.scored(spark, base).select("domain", "ts", "chain_id", "risk_score"))
    d = J.run_now(J.keyed_fold(s, ["domain"], ["ts", "chain_id"], folds.Drift()))
    return d.filter("NOT late").select("domain", "seq", "ts", "severity", "detector", "n_samples", *r6("psi", "cusum", "threshold"))


@query("i7_adaptive_stream", ORACLE["i7_adaptive_thresholds"])
def i7_stream(spark, base):
    o = written(spark, outcomes(spark, base).select("domain", "ts", "chain_id", "tier", "was_wrong"), "outcomes")
    d = J.run_now(J.keyed_fold(as_stream(o), ["domain"], ["ts", "chain_id"], folds.Cisc()))
    return d.select("domain", "seq", F.round("high_threshold", 3).alias("high_threshold"), F.round("low_threshold", 3).alias("low_threshold"))


@query("i9_suppression_stream", ORACLE["i9_suppressed_alerts"])
def i9_stream(spark, base):
    d = J.run_now(J.keyed_fold(as_stream(alerts(spark, base)), ["domain", "mode"], ["ts", "chain_id"], folds.Dedup(3600), ttl=3600))
    return d.filter("NOT late").select("domain", "mode", "ts", "chain_id")


@query("i11_online_isotonic", None)
def i11_stream(spark, base):
    o = outcomes(spark, base).select("ts", "chain_id", F.col("risk_score").alias("score"), F.col("was_wrong").cast("int").alias("label"))
    online = J.OnlineIsotonic()
    J.run_batches(as_stream(written(spark, o, "labels")), online, "append")
    return online.model(spark)(online.buffer(spark), "score").select("chain_id", "score", "calibrated")


@query("i13_feedback_stream", with_views("""SELECT chain_id, f.user_id || ':' || domain AS cisc_key, label = 'incorrect' AS was_wrong, round(risk_score, 6) AS score, CASE WHEN label = 'incorrect' THEN 1 ELSE 0 END AS isotonic_label,
 CASE WHEN (tier <> 'LOW') = (label = 'correct') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM feedback_v f JOIN scored_v s USING (chain_id)""", "feedback_v"))
def i13_stream(spark, base):
    """Labels given one hour after their chain."""
    s = V.scored(spark, base).select("chain_id", "domain", "tier", "risk_score", "ts", F.timestamp_seconds("ts").alias("scored_at"))
    f = V.feedback(spark, base).select("chain_id", "user_id", "label").join(s.select("chain_id", (F.col("ts") + 3600).alias("fts")), "chain_id")
    f = written(spark, f.withColumn("label_at", F.timestamp_seconds("fts")), "feedback")
    d = J.run_now(J.feedback_join(as_stream(f, "fts", 3), as_stream(s, "ts", 3).drop("ts")))
    return d.withColumn("score", F.round("score", 6))


@query("i14_live_scores", prefix_sql("SELECT chain_id, t, round(behaviour, 6) AS risk_score, CASE WHEN behaviour < 0.5 THEN 'low' WHEN behaviour < 0.7 THEN 'medium' ELSE 'high' END AS risk, CASE WHEN t <= 2 THEN 1 - behaviour ELSE behaviour END >= 0.65 AS abort FROM pv"))
def i14_stream(spark, base):
    """Steps reach the stream in files dealt by a hash, so that many come before the ones they follow."""
    s = V.steps(spark, base).withColumn("at", F.timestamp_seconds(F.lit(1704067200) + F.col("step_idx") * 600))
    s = written(spark, s, "steps").withColumn("ts", F.pmod(F.xxhash64("chain_id", "step_idx"), F.lit(3)))
    d = J.run_now(J.live_scores(as_stream(s, "ts", 3).drop("ts"), "30 days"))
    return d.where("status <> 'late'").select("chain_id", "t", "risk", "abort", *r6("risk_score"))


@query("a15_metric_stream", ORACLE["a15_metric_snapshot"])
def a15_stream(spark, base):
    s = V.scored(spark, base).select("domain", "ts", "chain_id", "risk_score", "needs_alert", "tier")
    keep = J.Snapshot(["domain"])
    J.run_batches(A.metric_snapshot(as_stream(s)), keep)
    return keep.table(spark).withColumn("last_risk", F.round("last_risk", 6))


@query("j3_window_stream", with_views("SELECT ts // 86400 * 86400 AS timestamp, round(avg(risk_score), 6) AS avg_risk, count(*) AS n_chains, count(CASE WHEN needs_alert THEN 1 END) AS n_alerts FROM scored_v GROUP BY ts // 86400", "scored_v"))
def j3_stream(spark, base):
    s = V.scored(spark, base).select("ts", "risk_score", "needs_alert", F.timestamp_seconds("ts").alias("at"))
    keep = J.Snapshot(["timestamp"])
    J.run_batches(J.windowed_series(as_stream(s)), keep)
    return keep.table(spark).withColumn("avg_risk", F.round("avg_risk", 6))
