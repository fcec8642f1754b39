"""Reports over the chain store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators.ordered import top_per_key

NEWEST = lambda: [F.desc("ts"), F.desc("chain_id")]
BUCKETS = {"hour": 3600, "day": 86400, "week": 604800}


def recent_chains(store: DataFrame, feedback: DataFrame, n: int = 20) -> DataFrame:
    """Latest ``n`` chains of every user with the user's own label."""
    top = top_per_key(store, ["user_id"], NEWEST(), n)
    return top.join(feedback.select("chain_id", "user_id", F.col("label").alias("feedback")), ["chain_id", "user_id"], "left")


def domain_rollup(store: DataFrame, keys: tuple[str, ...] = ("domain",)) -> DataFrame:
    return store.groupBy(*keys).agg(F.count(F.lit(1)).alias("chain_count"), F.max("ts").alias("last_seen"),
                                    F.avg("risk_score").alias("avg_risk"), F.count_if("needs_alert").alias("n_alerts"))


def time_series(store: DataFrame, bucket: str = "day", since: Column | None = None) -> DataFrame:
    """Counts and mean risk per epoch-aligned bucket; weeks therefore start on Thursdays."""
    b = BUCKETS.get(bucket, 86400)
    d = store if since is None else store.filter(F.col("ts") >= since)
    return d.groupBy((F.floor(F.col("ts") / b) * b).alias("timestamp")).agg(
        F.avg("risk_score").alias("avg_risk"), F.count(F.lit(1)).alias("n_chains"), F.count_if("needs_alert").alias("n_alerts"))


def as_of(store: DataFrame) -> DataFrame:
    """One row: the latest second in the table."""
    return store.agg(F.max("ts").alias("now"))


def platform_stats(store: DataFrame) -> DataFrame:
    """One pass over the table with the latest second as the present."""
    d = store.join(F.broadcast(as_of(store)))
    today = F.col("ts") >= F.col("now") - F.col("now") % 86400
    return d.agg(F.count(F.lit(1)).alias("total_chains"), F.sum("cost").alias("total_cost"), F.count_if(today).alias("chains_today"),
                 F.count_if(today & F.col("needs_alert")).alias("alerts_today"))


def daily_counts(store: DataFrame, days: int = 14) -> DataFrame:
    """Dense daily counts, zeros included."""
    now = as_of(store).select((F.floor(F.col("now") / 86400) * 86400).alias("today"))
    cal = now.select(F.explode(F.sequence(F.col("today") - (days - 1) * 86400, F.col("today"), F.lit(86400).cast("long"))).alias("timestamp"))
    per = store.groupBy((F.floor(F.col("ts") / 86400) * 86400).alias("timestamp")).agg(F.count(F.lit(1)).alias("n"))
    return cal.join(per, "timestamp", "left").select("timestamp", F.coalesce("n", F.lit(0)).alias("n_chains"))


def search_users(users: DataFrame, text: str, page: int = 1, size: int = 50) -> DataFrame:
    """A page of the users whose name or mail contains ``text``, with the total."""
    hit = users.filter(F.col("email").ilike(f"%{text}%") | F.col("name").ilike(f"%{text}%"))
    total = hit.agg(F.count(F.lit(1)).alias("total"))
    return hit.orderBy(F.desc("user_id")).offset((page - 1) * size).limit(size).join(F.broadcast(total))


def org_rollup(orgs: DataFrame, members: DataFrame, store: DataFrame) -> DataFrame:
    """Owner, members and chains per organisation, from pre-aggregated counts."""
    m = members.groupBy("org_id").agg(F.count(F.lit(1)).alias("member_count"))
    per_user = store.groupBy("user_id").agg(F.count(F.lit(1)).alias("c"), F.sum("cost").alias("cost"))
    c = per_user.join(members, "user_id").groupBy("org_id").agg(F.sum("c").alias("chain_count"), F.sum("cost").alias("org_cost"))
    zero = F.lit(0)
    return orgs.join(m, "org_id", "left").join(c, "org_id", "left").withColumns({
        "member_count": F.coalesce("member_count", zero), "chain_count": F.coalesce("chain_count", zero),
        "org_cost": F.coalesce("org_cost", F.lit(0.0))})


def cost_per_user(users: DataFrame, store: DataFrame) -> DataFrame:
    """Chains, paid judge calls and cost per user, users without chains included."""
    paid = F.col("judge_label").isNotNull() & ~F.col("judge_label").isin("LOCAL", "")
    c = store.groupBy("user_id").agg(F.count(F.lit(1)).alias("chains"), F.count_if(paid).alias("judge_calls"), F.sum("cost").alias("total_cost"))
    return users.join(c, "user_id", "left").withColumns({"chains": F.coalesce("chains", F.lit(0)), "judge_calls": F.coalesce("judge_calls", F.lit(0)),
                                                         "total_cost": F.coalesce("total_cost", F.lit(0.0))})


def proxy_stats(proxy: DataFrame, days: int = 7) -> DataFrame:
    d = proxy.join(F.broadcast(as_of(proxy))).filter(F.col("ts") >= F.col("now") - days * 86400)
    return d.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_calls"), F.sum("prompt_tokens").alias("total_prompt"),
                                    F.sum("completion_tokens").alias("total_completion"), F.avg("latency_ms").alias("avg_latency"),
                                    F.avg("risk_score").alias("avg_risk"), F.count_if(F.col("status") != "ok").alias("n_errors"))


def period_metrics(store: DataFrame, feedback: DataFrame, days: int = 7) -> DataFrame:
    """Totals, tiers, aborted chains, mean risk and label error rate of the last days."""
    d = store.join(F.broadcast(as_of(store))).filter(F.col("ts") >= F.col("now") - days * 86400)
    d = d.join(feedback.select("chain_id", "label"), "chain_id", "left")
    return d.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("risk_score") >= 0.95).alias("aborted"),
                 *[F.count_if(F.col("tier") == t).alias(f"tier_{t}") for t in ("LOW", "MEDIUM", "HIGH")],
                 F.avg("risk_score").alias("mean_risk"), F.count("label").alias("n_labeled"),
                 F.count_if(F.col("label") == "incorrect").alias("n_wrong_labeled"),
                 F.avg(F.when(F.col("label").isNotNull(), (F.col("label") == "incorrect").cast("double"))).alias("label_error_rate"))


def pending_review(store: DataFrame, feedback: DataFrame, n: int = 50) -> DataFrame:
    """Riskiest alerts nobody has labelled."""
    open_ = store.filter("needs_alert").join(feedback.select("chain_id"), "chain_id", "left_anti")
    return open_.orderBy(F.desc("risk_score"), F.asc("chain_id")).limit(n)


def mean_shift(store: DataFrame, window: int = 7 * 86400, cut: float = 0.10, min_rows: int = 10) -> DataFrame:
    """Mean risk of the latest window against the one before, per domain."""
    d = store.join(F.broadcast(as_of(store)))
    age = F.col("now") - F.col("ts")
    cur, prev = age <= window, (age > window) & (age <= 2 * window)
    g = d.groupBy("domain").agg(F.avg(F.when(cur, F.col("risk_score"))).alias("current_mean"), F.avg(F.when(prev, F.col("risk_score"))).alias("previous_mean"),
                                F.count_if(cur).alias("n_current"), F.count_if(prev).alias("n_previous"))
    delta = F.col("current_mean") - F.col("previous_mean")
    fired = (F.col("n_current") >= min_rows) & (F.col("n_previous") >= min_rows) & (F.abs(delta) > cut)
    return g.withColumns({"delta": delta, "drift": F.coalesce(fired, F.lit(False)),
                          "direction": F.when(fired, F.when(delta > 0, "UP").otherwise("DOWN"))})


def metric_snapshot(store: DataFrame) -> DataFrame:
    """Latest gauges and counters per domain."""
    at = F.struct("ts", "chain_id")
    return store.groupBy("domain").agg(F.max_by("risk_score", at).alias("last_risk"), F.count(F.lit(1)).alias("chains"),
                                       F.count_if("needs_alert").alias("alerts"),
                                       *[F.count_if(F.col("tier") == t).alias(f"tier_{t}") for t in ("HIGH", "MEDIUM", "LOW")])


def monitor_history(store: DataFrame) -> DataFrame:
    """Alert rate, mean, 95th percentile and three riskiest chains per domain."""
    from plumbline.operators.ordered import order_statistics
    g = store.groupBy("domain").agg(F.count(F.lit(1)).alias("n_tracked"), F.count_if("needs_alert").alias("n_alerts"), F.avg("risk_score").alias("avg_risk"))
    p = order_statistics(store, ["domain"], "risk_score", {"p95_risk": (F.col("_n") - 1) * 0.95}).drop("n")
    top = top_per_key(store, ["domain"], [F.desc("value"), F.asc("chain_id")], 3, "rn").groupBy("domain").agg(
        F.array_sort(F.collect_list(F.struct("rn", "chain_id"))).alias("t"))
    top = top.select("domain", F.array_join(F.col("t.chain_id").cast("array<string>"), ",").alias("riskiest"))
    return g.join(p, "domain").join(top, "domain").withColumn("alert_rate", F.col("n_alerts") / F.col("n_tracked"))
