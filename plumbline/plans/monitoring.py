"""Queries: drift, adaptive thresholds, suppression, guardrails, rates, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.operators import analytics as A
from plumbline.plans import views as V
from plumbline.plans.registry import ORACLE, query
from plumbline.plans.traces import r6
from plumbline.session import written
from plumbline.plans.views import with_views
from plumbline.streaming import rules as M

SPLIT = 1704326400  # three days after the first event


def halves(spark, base):
    s = V.scored(spark, base)
    return s.filter(F.col("ts") < SPLIT), s.filter(F.col("ts") >= SPLIT)


BIN_SQL = "CASE WHEN risk_score < 0 OR risk_score > 1 THEN NULL " + " ".join(f"WHEN risk_score < {e!r}::DOUBLE THEN {i}" for i, e in enumerate(fixed.PSI_EDGES[1:10])) + " ELSE 9 END"


@query("i1_baseline", with_views(f"SELECT domain, round(avg(risk_score), 6) AS base_mean, round(greatest(stddev_pop(risk_score), 1e-4), 6) AS base_std, count(*) AS base_n FROM scored_v WHERE ts < {SPLIT} GROUP BY domain", "scored_v"))
def i1(spark, base):
    return M.baseline(halves(spark, base)[0], ["domain"]).select("domain", "base_n", *r6("base_mean", "base_std"))


@query("i2_stability_index", with_views(f"""
, b AS (SELECT domain, ts < {SPLIT} AS ref, {BIN_SQL} AS bin FROM scored_v), n AS (SELECT domain, count(CASE WHEN ref THEN 1 END) AS rn, count(CASE WHEN NOT ref THEN 1 END) AS tn FROM b GROUP BY domain),
h AS (SELECT n.domain, i, rn, tn, count(CASE WHEN ref THEN 1 END) AS r, count(CASE WHEN NOT ref THEN 1 END) AS t FROM n CROSS JOIN range(10) x(i) LEFT JOIN b ON b.domain = n.domain AND b.bin = i GROUP BY ALL),
p AS (SELECT domain, (r + 1e-4) / (rn + 1e-3) AS rp, (t + 1e-4) / (tn + 1e-3) AS tp FROM h)
SELECT domain, round(sum((tp - rp) * ln(tp / rp)), 6) AS psi FROM p GROUP BY domain""", "scored_v"))
def i2(spark, base):
    ref, new = halves(spark, base)
    return M.stability_index(ref, new, ["domain"])


@query("i3_drift_events", with_views(f"""
RECURSIVE_MARK , bl AS (SELECT domain, avg(risk_score) AS mu, greatest(stddev_pop(risk_score), 1e-4) AS sd, count(*) AS bn FROM scored_v WHERE ts < {SPLIT} GROUP BY domain),
bh AS (SELECT domain, {BIN_SQL} AS bin, count(*) AS c FROM scored_v WHERE ts < {SPLIT} GROUP BY ALL),
s AS (SELECT domain, ts, risk_score, {BIN_SQL} AS bin, row_number() OVER (PARTITION BY domain ORDER BY ts, chain_id) AS rn FROM scored_v WHERE ts >= {SPLIT}),
w AS (SELECT domain, ts, rn, risk_score, list(bin) OVER (PARTITION BY domain ORDER BY rn ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS l FROM s),
q AS (SELECT w.domain, ts, rn, risk_score, list_sum(list_transform(range(10), lambda i: ((len(list_filter(l, lambda y: y = i)) + 1e-4) / (len(l) + 1e-3) - (coalesce(m[i], 0) + 1e-4) / (bn + 1e-3)) * ln(((len(list_filter(l, lambda y: y = i)) + 1e-4) / (len(l) + 1e-3)) / ((coalesce(m[i], 0) + 1e-4) / (bn + 1e-3))))) AS psi, mu, sd
 FROM w JOIN bl USING (domain) JOIN (SELECT domain, map_from_entries(list((CAST(bin AS BIGINT), c))) AS m FROM bh GROUP BY domain) mm USING (domain)),
f AS (SELECT domain, rn, 0.0::DOUBLE AS c, 0.0::DOUBLE AS shown, psi, sd, ts FROM q WHERE rn = 1
 UNION ALL SELECT q.domain, q.rn, CASE WHEN q.rn < 20 THEN 0.0::DOUBLE WHEN greatest(0.0::DOUBLE, f.c + q.risk_score - q.mu - 0.5*q.sd) > 5*q.sd THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, f.c + q.risk_score - q.mu - 0.5*q.sd) END,
 CASE WHEN q.rn < 20 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, f.c + q.risk_score - q.mu - 0.5*q.sd) END, q.psi, q.sd, q.ts FROM f JOIN q ON q.domain = f.domain AND q.rn = f.rn + 1)
SELECT domain, rn AS seq, ts, CASE WHEN shown > 5*sd OR round(psi,6) >= 0.2 THEN 'ALARM' ELSE 'WARN' END AS severity, CASE WHEN shown > 5*sd THEN 'CUSUM' ELSE 'PSI' END AS detector, round(psi, 6) AS psi, round(shown, 6) AS cusum
FROM f WHERE rn >= 20 AND (shown > 5*sd OR round(psi, 6) >= 0.1)""", "scored_v").replace("RECURSIVE_MARK ", "").replace("WITH ", "WITH RECURSIVE ", 1))
def i3(spark, base):
    ref, new = halves(spark, base)
    d = M.drift_events(new, M.baseline(ref, ["domain"]))
    return d.select("domain", "seq", "ts", "severity", "detector", *r6("psi", "cusum"))


#: The monitor row by row: p is the row of the last alarm, c the CUSUM; the baseline is the 20 rows that end at p + 20.
MONITOR_SQL = with_views(f"""
, s AS (SELECT domain, ts, risk_score AS x, {BIN_SQL} AS bin, row_number() OVER (PARTITION BY domain ORDER BY ts, chain_id) AS rn FROM scored_v),
q AS (SELECT *, avg(x) OVER b AS mu, greatest(stddev_pop(x) OVER b, 1e-4) AS sd, list(bin) OVER b AS bl, list(bin) OVER (PARTITION BY domain ORDER BY rn ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS w,
  list(x) OVER (PARTITION BY domain ORDER BY rn ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS xs FROM s WINDOW b AS (PARTITION BY domain ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
f AS (SELECT domain, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS p, 0.0::DOUBLE AS c, CAST(NULL AS DOUBLE) AS thr, 0.0::DOUBLE AS shown, 0.0::DOUBLE AS psi, CAST(NULL AS VARCHAR) AS detector, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS ts FROM (SELECT DISTINCT domain FROM q)
 UNION ALL SELECT domain, rn, CASE WHEN hit THEN rn ELSE p END, CASE WHEN hit OR n < 20 THEN 0.0::DOUBLE ELSE now END, CASE WHEN p > 0 AND n = 19 THEN list_aggregate(list_concat([xs[1]], xs[22:]), 'quantile_cont', 0.75) ELSE thr END,
   now, psi, CASE WHEN now > 5 * sd THEN 'CUSUM' WHEN psi >= 0.1 THEN 'PSI' END, n, ts FROM (SELECT *, n >= 20 AND (now > 5 * sd OR psi >= 0.2) AS hit FROM (
  SELECT q.domain, q.rn, q.ts, q.xs, f.p, f.thr, q.rn - f.p - 20 AS n, z.sd, CASE WHEN q.rn - f.p < 40 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, f.c + (q.x - z.mu) - 0.5 * z.sd) END AS now,
   CASE WHEN q.rn - f.p < 40 THEN 0.0::DOUBLE ELSE (SELECT greatest(0.0::DOUBLE, round(list_sum(list_transform(range(10), lambda i: ((len(list_filter(l, lambda y: y = i)) + 1e-4) / (len(l) + 1e-3) - (len(list_filter(z.bl, lambda y: y = i)) + 1e-4) / 20.001)
     * ln(((len(list_filter(l, lambda y: y = i)) + 1e-4) / (len(l) + 1e-3)) / ((len(list_filter(z.bl, lambda y: y = i)) + 1e-4) / 20.001)))), 6)) FROM (SELECT list_slice(q.w, -least(50, q.rn - f.p - 20), -1) AS l)) END AS psi
  FROM f JOIN q ON q.domain = f.domain AND q.rn = f.rn + 1 LEFT JOIN q z ON z.domain = f.domain AND z.rn = f.p + 20))),
monitor_v AS (SELECT domain, rn AS seq, ts, CASE WHEN detector = 'CUSUM' OR psi >= 0.2 THEN 'ALARM' ELSE 'WARN' END AS severity, detector, round(psi, 6) AS psi, round(shown, 6) AS cusum, n AS n_samples, round(thr, 6) AS threshold FROM f WHERE n >= 20 AND detector IS NOT NULL)
""", "scored_v").replace("WITH ", "WITH RECURSIVE ", 1)


def monitor(spark, base):
    return M.drift_monitor(V.scored(spark, base))


@query("i4_drift_monitor", MONITOR_SQL + "SELECT * FROM monitor_v")
def i4(spark, base):
    d = monitor(spark, base)
    return d.select("domain", "seq", "ts", "severity", "detector", "n_samples", *r6("psi", "cusum", "threshold"))


@query("i5_domain_thresholds", MONITOR_SQL + "SELECT domain, coalesce(max_by(threshold, seq), 0.7) AS threshold FROM monitor_v GROUP BY domain")
def i5(spark, base):
    return M.domain_thresholds(monitor(spark, base)).select("domain", *r6("threshold"))


@query("i6_mean_shift", with_views("""SELECT domain, round(current_mean, 6) AS current_mean, round(previous_mean, 6) AS previous_mean, n_current, n_previous, round(current_mean - previous_mean, 6) AS delta,
 coalesce(abs(current_mean - previous_mean) > 0.01, false) AS drift, CASE WHEN current_mean - previous_mean > 0.01 THEN 'UP' WHEN current_mean - previous_mean < -0.01 THEN 'DOWN' END AS direction FROM shift_v""", "shift_v"))
def i6(spark, base):
    d = A.mean_shift(V.scored(spark, base), cut=0.01)
    return d.select("domain", "n_current", "n_previous", "drift", "direction", *r6("current_mean", "previous_mean", "delta"))


def outcomes(spark, base):
    """Labelled chains in label order: the label's time orders them."""
    s = V.scored(spark, base).select("chain_id", "domain", "tier", "risk_score")
    f = V.feedback(spark, base).select("chain_id", "user_id", "fts", (F.col("label") == "incorrect").alias("was_wrong"))
    return f.join(s, "chain_id").withColumnRenamed("fts", "ts")


V.cte("out_v", "SELECT f.chain_id, f.user_id, domain, tier, risk_score, fts AS ts, label = 'incorrect' AS was_wrong FROM feedback_v f JOIN scored_v USING (chain_id)", "feedback_v")


@query("i7_adaptive_thresholds", with_views("""
, c AS (SELECT domain, row_number() OVER w AS n, count(CASE WHEN tier='LOW' THEN 1 END) OVER w AS na, count(CASE WHEN tier='LOW' AND was_wrong THEN 1 END) OVER w AS nt, count(CASE WHEN was_wrong THEN 1 END) OVER w AS nw,
 count(CASE WHEN tier='HIGH' THEN 1 END) OVER w AS nh, count(CASE WHEN tier='HIGH' AND was_wrong THEN 1 END) OVER w AS nhw FROM out_v WINDOW w AS (PARTITION BY domain ORDER BY ts, chain_id)),
g AS (SELECT domain, n, (nt + 1.0::DOUBLE) / (na + 2) - 0.8 AS p, (nt + 1.0::DOUBLE) / (nw + 2) - 0.6 AS r, CASE WHEN nh = 0 THEN 0 ELSE nhw::DOUBLE / nh END AS h FROM c),
f AS (SELECT domain, CAST(0 AS BIGINT) AS n, 0.5::DOUBLE AS ht, 0.7::DOUBLE AS lt FROM (SELECT DISTINCT domain FROM g)
 UNION ALL SELECT domain, n, h2, CASE WHEN n >= 20 AND h2 >= l1 - 0.1 THEN greatest(0.25::DOUBLE, least(0.9::DOUBLE, round(h2 + 0.1, 3))) ELSE l1 END FROM (
  SELECT domain, n, l1, CASE WHEN n >= 20 AND h > 0.35 THEN greatest(0.25::DOUBLE, least(0.9::DOUBLE, round(ht - 0.02, 3))) WHEN n >= 20 AND h < 0.1 AND ht < l1 - 0.1 THEN greatest(0.25::DOUBLE, least(0.9::DOUBLE, round(ht + 0.02, 3))) ELSE ht END AS h2 FROM (
   SELECT g.domain, g.n, g.h, f.ht, CASE WHEN g.n >= 20 AND g.p > 0.05 AND g.r < -0.05 THEN greatest(0.25::DOUBLE, least(0.9::DOUBLE, round(f.lt - 0.02, 3))) WHEN g.n >= 20 AND g.p < -0.05 THEN greatest(0.25::DOUBLE, least(0.9::DOUBLE, round(f.lt + 0.02, 3))) ELSE f.lt END AS l1
   FROM f JOIN g ON g.domain = f.domain AND g.n = f.n + 1)))
SELECT domain, n AS seq, round(ht, 3) AS high_threshold, round(lt, 3) AS low_threshold FROM f WHERE n > 0""", "out_v").replace("WITH ", "WITH RECURSIVE ", 1))
def i7(spark, base):
    d = M.cisc_thresholds(outcomes(spark, base), ["domain"])
    return d.select("domain", "seq", F.round("high_threshold", 3).alias("high_threshold"), F.round("low_threshold", 3).alias("low_threshold"))


def _after_alarms_sql() -> str:
    sql = ORACLE["i7_adaptive_thresholds"].replace("FROM out_v WINDOW", "FROM ep_v WINDOW")
    marks = f""", al AS ({ORACLE["i3_drift_events"]}),
ep_v AS (SELECT o.* REPLACE (o.domain || '#' || (SELECT count(*) FROM al WHERE al.domain = o.domain AND al.severity = 'ALARM' AND al.ts <= o.ts) AS domain) FROM out_v o),
c AS (SELECT domain"""
    head, tail = sql.split(", c AS (SELECT domain", 1)
    body, last = (head.rstrip() + marks + tail).rsplit("SELECT domain, n AS seq", 1)
    return body + "SELECT split_part(domain, '#', 1) AS domain, CAST(split_part(domain, '#', 2) AS BIGINT) AS epoch, split_part(domain, '#', 2) <> '0' AS verifier_stale, n AS seq" + last


@query("i4_alarm_resets", _after_alarms_sql())
def i4_alarm_resets(spark, base):
    """Alarms of the second half's detector start the adaptive thresholds anew."""
    ref, new = halves(spark, base)
    alarms = M.drift_events(new, M.baseline(ref, ["domain"])).filter("severity = 'ALARM'").select("domain", "ts")
    d = M.cisc_after_alarms(outcomes(spark, base), written(spark, alarms, "alarms"))
    return d.select("domain", "epoch", "verifier_stale", "seq", F.round("high_threshold", 3).alias("high_threshold"), F.round("low_threshold", 3).alias("low_threshold"))



@query("i8_adaptive_summary", with_views("""SELECT user_id, domain, n_observations, n_alerts, round(p, 6) AS precision, round(r, 6) AS recall, round(p - 0.8, 6) AS gap_precision, round(r - 0.6, 6) AS gap_recall FROM (SELECT user_id, domain, count(*) AS n_observations, count(CASE WHEN tier='LOW' THEN 1 END) AS n_alerts,
 (count(CASE WHEN tier='LOW' AND was_wrong THEN 1 END) + 1.0::DOUBLE) / (count(CASE WHEN tier='LOW' THEN 1 END) + 2) AS p, (count(CASE WHEN tier='LOW' AND was_wrong THEN 1 END) + 1.0::DOUBLE) / (count(CASE WHEN was_wrong THEN 1 END) + 2) AS r FROM out_v GROUP BY user_id, domain)""", "out_v"))
def i8(spark, base):
    d = M.cisc_summary(outcomes(spark, base))
    return d.select("user_id", "domain", "n_observations", "n_alerts", *r6("precision", "recall", "gap_precision", "gap_recall"))


def alerts(spark, base):
    return V.scored(spark, base).filter("needs_alert").select("domain", F.coalesce("failure_mode", F.lit("none")).alias("mode"), "ts", "chain_id")


@query("i9_suppressed_alerts", with_views("""
, a AS (SELECT domain, coalesce(failure_mode, 'none') AS mode, ts, min(chain_id) AS chain_id FROM scored_v WHERE needs_alert GROUP BY ALL),
f AS (SELECT domain, mode, min(ts) AS ts FROM a GROUP BY domain, mode UNION ALL SELECT f.domain, f.mode, (SELECT min(a.ts) FROM a WHERE a.domain = f.domain AND a.mode = f.mode AND a.ts >= f.ts + 3600) FROM f WHERE f.ts IS NOT NULL)
SELECT domain, mode, ts, chain_id FROM f JOIN a USING (domain, mode, ts)""", "scored_v").replace("WITH ", "WITH RECURSIVE ", 1))
def i9(spark, base):
    """One hour instead of five minutes, so that the sparse events suppress each other."""
    return M.fired_alerts(alerts(spark, base), ["domain", "mode"], 3600)


@query("i10_guardrails", with_views("""SELECT chain_id, rule_id, action FROM (SELECT chain_id, rule_id, action, row_number() OVER (PARTITION BY chain_id ORDER BY rule_id) AS rn FROM scored_v JOIN guardrails_v ON enabled AND rule_domain IN ('*', domain) AND risk_score >= threshold) WHERE rn = 1""", "scored_v", "guardrails_v"))
def i10(spark, base):
    return M.match_guardrails(V.scored(spark, base), V.guardrails(spark)).select("chain_id", "rule_id", "action")


@query("i12_retrain_triggers", with_views("""SELECT user_id, chain_id, n_labels FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY fts, chain_id) AS n_labels FROM feedback_v) WHERE n_labels % 20 = 0""", "feedback_v"))
def i12(spark, base):
    return M.retrain_triggers(V.feedback(spark, base)).select("user_id", "chain_id", "n_labels")


@query("i13_feedback_fan_out", with_views("""SELECT chain_id, f.user_id || ':' || domain AS cisc_key, label = 'incorrect' AS was_wrong, round(risk_score, 6) AS score, CASE WHEN label = 'incorrect' THEN 1 ELSE 0 END AS isotonic_label,
 CASE WHEN (tier <> 'LOW') = (label = 'correct') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM feedback_v f JOIN scored_v s USING (chain_id)""", "feedback_v"))
def i13(spark, base):
    from plumbline.streaming.jobs import fan_out
    s = V.scored(spark, base).select("chain_id", "domain", "tier", "risk_score")
    return fan_out(V.feedback(spark, base).join(s, "chain_id")).withColumn("score", F.round("score", 6))


@query("i15_rate_check", with_views("""SELECT domain, ts, calls, in_window, in_window > 15 AS over_limit FROM (SELECT domain, ts, count(*) AS calls, CAST(sum(count(*)) OVER (PARTITION BY domain ORDER BY ts RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window FROM scored_v GROUP BY domain, ts)""", "scored_v"))
def i15(spark, base):
    return M.rate_check(V.scored(spark, base), ["domain"], 3600, 15)


@query("i16_rate_notices", with_views("""
, p AS (SELECT domain, ts // 86400 * 86400 AS ts, count(*) AS n, avg(CASE WHEN needs_alert THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate FROM scored_v GROUP BY ALL), a AS (SELECT * FROM p WHERE n >= 10 AND rate > 0.5),
f AS (SELECT domain, min(ts) AS ts FROM a GROUP BY domain UNION ALL SELECT f.domain, (SELECT min(a.ts) FROM a WHERE a.domain = f.domain AND a.ts >= f.ts + 172800) FROM f WHERE f.ts IS NOT NULL)
SELECT domain, ts, n, round(rate, 6) AS rate FROM f JOIN a USING (domain, ts)""", "scored_v").replace("WITH ", "WITH RECURSIVE ", 1))
def i16(spark, base):
    return M.rate_notices(V.scored(spark, base)).select("domain", "ts", "n", *r6("rate"))


@query("i16_drift_notices", with_views("""
, p AS (SELECT domain, ts // 86400 * 86400 AS ts, count(*) AS n, avg(risk_score) AS m FROM scored_v GROUP BY ALL),
a AS (SELECT c.domain, c.ts, c.n, c.m, b.m AS pm FROM p c JOIN p b ON b.domain = c.domain AND b.ts = c.ts - 86400 WHERE c.n >= 10 AND b.n >= 10 AND abs(c.m - b.m) > 0.01),
f AS (SELECT domain, min(ts) AS ts FROM a GROUP BY domain UNION ALL SELECT f.domain, (SELECT min(a.ts) FROM a WHERE a.domain = f.domain AND a.ts >= f.ts + 172800) FROM f WHERE f.ts IS NOT NULL)
SELECT 'drift:' || domain AS key, domain, ts, n, round(m, 6) AS current_mean, round(pm, 6) AS previous_mean, round(m - pm, 6) AS delta, CASE WHEN m > pm THEN 'up' ELSE 'down' END AS direction FROM f JOIN a USING (domain, ts)""", "scored_v").replace("WITH ", "WITH RECURSIVE ", 1))
def i16_drift(spark, base):
    """A small cut, so that the even events give notices."""
    d = M.drift_notices(V.scored(spark, base), cut=0.01)
    return d.select("key", "domain", "ts", "n", "direction", *r6("current_mean", "previous_mean", "delta"))


@query("i17_monthly_usage", with_views("SELECT user_id, strftime(make_timestamp(ts * 1000000), '%Y-%m') AS month, count(*) AS used, round(count(*) / 500.0::DOUBLE, 6) AS share, count(*) > 500 AS over FROM scored_v GROUP BY ALL", "scored_v"))
def i17(spark, base):
    return M.monthly_usage(V.scored(spark, base)).select("user_id", "month", "used", "over", *r6("share"))


@query("i18_detector_summaries", MONITOR_SQL + """SELECT domain, count(*) AS events, count(CASE WHEN severity = 'ALARM' THEN 1 END) AS alarms, max_by(severity, seq) AS last_severity, max(seq) AS last_seq FROM monitor_v GROUP BY domain""")
def i18(spark, base):
    """Last event per domain."""
    e = monitor(spark, base)
    return e.groupBy("domain").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("severity") == "ALARM").alias("alarms"),
                                   F.max_by("severity", "seq").alias("last_severity"), F.max("seq").alias("last_seq"))
