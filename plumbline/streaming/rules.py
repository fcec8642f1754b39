"""Drift, adaptive thresholds, guardrails, rates and triggers over tables of scored chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline import fixed
from plumbline.operators.ordered import running_sums
from plumbline.streaming import folds, replay

RESTART_BLOCKS, RESTART_ROWS = 16, 1 << 20


def psi_bin(c: Column) -> Column:
    """Range number by literal edges; null outside [0, 1]."""
    edges = fixed.PSI_EDGES
    out = F.when((c < edges[0]) | (c > edges[-1]), F.lit(None).cast("int"))
    for i in range(1, 10):
        out = out.when(c < edges[i], i - 1)
    return out.when(c <= edges[-1], 9)


def baseline(df: DataFrame, keys: Sequence[str], score: str = "risk_score") -> DataFrame:
    """Mean, population deviation (at least 1e-4) and range counts per key."""
    b = psi_bin(F.col(score))
    hist = F.array(*[F.count_if(b == i) for i in range(10)])
    return df.groupBy(*keys).agg(F.avg(score).alias("base_mean"), F.greatest(F.stddev_pop(score), F.lit(1e-4)).alias("base_std"),
                                 F.count(score).alias("base_n"), hist.alias("base_hist"))


def stability_index(reference: DataFrame, target: DataFrame, keys: Sequence[str], score: str = "risk_score") -> DataFrame:
    """Stability index per key of two sets of scores."""
    r = baseline(reference, keys, score)
    t = baseline(target, keys, score).select(*keys, F.col("base_n").alias("tn"), F.col("base_hist").alias("th"))
    eps = fixed.PSI_EPS
    pct = lambda c, n: (c + eps) / (n + eps * 10)
    term = F.zip_with("base_hist", "th", lambda a, b: (pct(b, F.col("tn")) - pct(a, F.col("base_n")))
                      * F.ln(pct(b, F.col("tn")) / pct(a, F.col("base_n"))))
    total = F.aggregate(term, F.lit(0.0), lambda s, x: s + x)
    return r.join(t, list(keys)).select(*keys, F.greatest(F.lit(0.0), F.round(total, 6)).alias("psi"))


def drift_events(df: DataFrame, base: DataFrame, key: str = "domain", score: str = "risk_score", block: int = 4096) -> DataFrame:
    """Detector events against a fitted baseline: blocks' effects on the CUSUM chain up, so a key with many rows stays spread out."""
    d = replay.numbered(df.select(key, "ts", "chain_id", score), [key], "ts", "chain_id")
    d = d.join(base.select(key, "base_mean", "base_std", "base_hist", "base_n"), key)
    return replay.by_maps(d, [key], ["seen"], folds.Cusum(score), block)


def drift_monitor(df: DataFrame, key: str = "domain", score: str = "risk_score", block: int = 4096) -> DataFrame:
    """Self-fitting monitor: the first scores are the baseline, alarms start over, thresholds follow. In parallel inside each key.

    Where scores are noise an alarm comes 40 rows after the last one again and again, and runs with other starts seldom meet: a
    round may settle one block of a key only. So a key has ``RESTART_BLOCKS`` blocks at most, and as many rounds, as long as a block is below
    ``RESTART_ROWS``.
    """
    most = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    block = max(block, min(-(-most // RESTART_BLOCKS), RESTART_ROWS))
    d = replay.numbered(df.select(key, "ts", "chain_id", score), [key], "ts", "chain_id")
    return replay.by_restarts(d, [key], ["seen"], folds.Drift(score), block)


def domain_thresholds(events: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Latest learnt threshold per domain; manual rows win; .70 where neither exists."""
    t = events.groupBy("domain").agg(F.max_by("threshold", "seq").alias("learnt"))
    if manual is not None:
        t = t.join(manual, "domain", "full")
        return t.select("domain", F.coalesce("manual", "learnt", F.lit(fixed.ALERT_AT)).alias("threshold"))
    return t.select("domain", F.coalesce("learnt", F.lit(fixed.ALERT_AT)).alias("threshold"))


def cisc_counters(outcomes: DataFrame, keys: Sequence[str], width: int = 60) -> DataFrame:
    """Running counters per key in time order."""
    low, high, wrong = F.col("tier") == "LOW", F.col("tier") == "HIGH", F.col("was_wrong")
    one = lambda c: c.cast("long")
    d = outcomes.withColumn("_hr", F.floor(F.col("ts") / width))
    return running_sums(d, list(keys), "_hr", ["ts", "chain_id"], {
        "n_obs": F.lit(1).cast("long"), "n_alerts": one(low), "n_true": one(low & wrong), "n_wrong": one(wrong),
        "n_high": one(high), "n_high_wrong": one(high & wrong)}).drop("_hr")


def cisc_thresholds(outcomes: DataFrame, keys: Sequence[str] = ("user_id", "domain"), block: int = 4096) -> DataFrame:
    """Thresholds after every outcome: counters in parallel, then the blocks' effects as tables of states."""
    c = cisc_counters(outcomes, keys)
    return replay.by_maps(c, keys, ["n_obs"], folds.Cisc(), block, seq="n_obs")


def alarm_epochs(outcomes: DataFrame, alarms: DataFrame, key: str = "domain", width: int = 60) -> DataFrame:
    """``outcomes`` with ``epoch``, the number of the key's alarms up to each of them in time."""
    both = outcomes.withColumn("_alarm", F.lit(0)).unionByName(alarms.select(key, "ts", F.lit(1).alias("_alarm")), allowMissingColumns=True)
    both = both.withColumn("_hr", F.floor(F.col("ts") / width))
    d = running_sums(both, [key], "_hr", ["ts", F.desc("_alarm")], {"epoch": F.col("_alarm").cast("long")})
    return d.filter("_alarm = 0").drop("_alarm", "_hr")


def cisc_after_alarms(outcomes: DataFrame, alarms: DataFrame, key: str = "domain", block: int = 4096) -> DataFrame:
    """Thresholds that a drift alarm puts back to the first ones, with counters and history at zero.

    An epoch begins at each alarm and is a key of its own; ``verifier_stale`` says that an alarm has come since the
    verifier was fitted.
    """
    d = cisc_thresholds(alarm_epochs(outcomes, alarms, key), [key, "epoch"], block)
    return d.withColumn("verifier_stale", F.col("epoch") > 0)


def cisc_summary(outcomes: DataFrame, keys: Sequence[str] = ("user_id", "domain"), target_precision: float = 0.80,
                 target_recall: float = 0.60) -> DataFrame:
    """Smoothed precision and recall with their gaps; plain aggregates."""
    low, wrong = F.col("tier") == "LOW", F.col("was_wrong")
    g = outcomes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_observations"), F.count_if(low).alias("n_alerts"),
                                    F.count_if(low & wrong).alias("n_true"), F.count_if(wrong).alias("n_wrong"))
    p, r = (F.col("n_true") + 1) / (F.col("n_alerts") + 2), (F.col("n_true") + 1) / (F.col("n_wrong") + 2)
    return g.withColumns({"precision": p, "recall": r, "gap_precision": p - target_precision, "gap_recall": r - target_recall})


def fired_alerts(alerts: DataFrame, keys: Sequence[str] = ("user_id", "domain", "mode"), window: int = fixed.ALERT_DEDUP_SECONDS) -> DataFrame:
    """Alerts that fire after suppression.

    Rows first shrink to one per key and second, so a key never holds more rows than seconds.
    """
    once = alerts.groupBy(*keys, "ts").agg(F.min("chain_id").alias("chain_id"))
    return replay.in_order(once, list(keys), ["ts"], folds.Dedup(window))


def match_guardrails(chains: DataFrame, rules: DataFrame) -> DataFrame:
    """First matching rule per chain, by rule number; named domains and ``*`` compete.

    Of the rules of one domain only those can come first whose threshold lies below all thresholds
    before them. That short falling staircase is what meets the chains, never rule by rule.
    """
    on = rules.filter("enabled").select("rule_id", F.col("rule_domain").alias("domain"), "threshold", "action")
    before = W.partitionBy("domain").orderBy("rule_id").rowsBetween(W.unboundedPreceding, -1)
    stairs = on.withColumn("_low", F.min("threshold").over(before)).filter("_low IS NULL OR threshold < _low")
    packed = lambda r: F.array_sort(F.collect_list(F.struct("rule_id", "threshold", "action"))).alias(r)
    named = stairs.filter("domain <> '*'").groupBy("domain").agg(packed("own"))
    star = stairs.filter("domain = '*'").agg(packed("every"))
    d = chains.join(named, "domain", "left").join(F.broadcast(star))
    first = lambda c: F.get(F.filter(c, lambda r: F.col("risk_score") >= r["threshold"]), F.lit(0))
    hit = F.least(first("own"), first("every"))
    return d.withColumn("_h", hit).filter("_h IS NOT NULL").select(*chains.columns, "_h.rule_id", "_h.action")


def retrain_triggers(labels: DataFrame, every: int = 20, width: int = 600) -> DataFrame:
    """Labels at which a user's count passes a multiple of ``every``."""
    d = labels.withColumn("_d", F.floor(F.col("fts") / width))
    d = running_sums(d, ["user_id"], "_d", ["fts", "chain_id"], {"n_labels": F.lit(1)})
    return d.filter(F.col("n_labels") % every == 0).drop("_d")


def rate_check(calls: DataFrame, keys: Sequence[str], seconds: int = 3600, limit: int = 1000) -> DataFrame:
    """Calls in the sliding window up to each call.

    Running counts at a call and just before its window replace a frame over a whole key: counts per
    second are joined to the same counts ``seconds`` later, both taken in blocks of one window.
    """
    per = calls.groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("c"))
    per = per.withColumn("_b", F.floor(F.col("ts") / seconds))
    # a window reaches into one earlier block only: give each block a copy of the one before
    copies = per.select("*", F.explode(F.array(F.col("_b"), F.col("_b") + 1)).alias("home"))
    w = W.partitionBy(*keys, "home").orderBy("ts").rangeBetween(-seconds, 0)
    out = copies.withColumn("in_window", F.sum("c").over(w)).filter(F.col("home") == F.col("_b"))
    return out.select(*keys, "ts", F.col("c").alias("calls"), "in_window", (F.col("in_window") > limit).alias("over_limit"))


def monthly_usage(chains: DataFrame, limit: int = 500) -> DataFrame:
    """Chains per user and calendar month with the share of the plan's limit."""
    # calendar months of UTC, whatever the session time zone
    month = F.expr("date_format(timestampadd(SECOND, ts, TIMESTAMP_NTZ '1970-01-01 00:00:00'), 'yyyy-MM')")
    g = chains.groupBy("user_id", month.alias("month")).agg(F.count(F.lit(1)).alias("used"))
    return g.withColumns({"share": F.col("used") / limit, "over": F.col("used") > limit})


def drift_notices(chains: DataFrame, width: int = 86400, cut: float = 0.10, min_rows: int = 10, cooldown: int = 2 * 86400) -> DataFrame:
    """Notices when the mean risk of a period differs by more than ``cut`` from the period before it; their key is ``drift:`` and the domain.

    Both periods need ``min_rows`` rows, and a domain is quiet for the cooldown after a notice. Only one row per domain and period is ordered.
    """
    per = chains.groupBy("domain", (F.floor(F.col("ts") / width) * width).cast("long").alias("ts")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("risk_score").alias("current_mean"))
    w = W.partitionBy("domain").orderBy("ts")
    last = F.when(F.lag("ts").over(w) == F.col("ts") - width, F.lag(F.struct("n", "current_mean")).over(w))
    per = per.withColumn("_p", last).withColumn("previous_mean", F.col("_p.current_mean"))
    delta = F.col("current_mean") - F.col("previous_mean")
    moved = per.filter((F.col("n") >= min_rows) & (F.col("_p.n") >= min_rows) & (F.abs(delta) > cut))
    fired = replay.in_order(moved.select("domain", "ts", F.col("n").alias("chain_id")), ["domain"], ["ts"], folds.Dedup(cooldown))
    d = moved.join(fired.select("domain", "ts"), ["domain", "ts"])
    return d.select(F.concat(F.lit("drift:"), "domain").alias("key"), "domain", "ts", "n", "current_mean", "previous_mean", delta.alias("delta"),
                    F.when(delta > 0, "up").otherwise("down").alias("direction"))


def rate_notices(chains: DataFrame, width: int = 86400, cut: float = 0.5, min_rows: int = 10, cooldown: int = 2 * 86400) -> DataFrame:
    """Notices when the alert rate of a period passes ``cut``, not more often than the cooldown."""
    per = chains.groupBy("domain", (F.floor(F.col("ts") / width) * width).alias("ts")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("needs_alert").cast("double")).alias("rate"))
    hot = per.filter((F.col("n") >= min_rows) & (F.col("rate") > cut)).select(
        "domain", F.col("ts").cast("long").alias("ts"), F.col("n").alias("chain_id"))
    fired = replay.in_order(hot, ["domain"], ["ts"], folds.Dedup(cooldown))
    return fired.select("domain", "ts", F.col("chain_id").alias("n")).join(per.select("domain", "ts", "rate"), ["domain", "ts"])
