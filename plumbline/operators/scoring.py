"""Chain scores: behaviour, second opinions, tiers, alerts, prefixes and batch summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


from plumbline import fixed
from plumbline.functions import risk as R, text as T
from plumbline.operators import failure as X, features as D, models
from plumbline.operators.ordered import histogram, running_sums, value_blocks


def verdict(df: DataFrame, risk: Column, alert_at: float = fixed.ALERT_AT) -> DataFrame:
    """Tier, alert and words from the unrounded risk."""
    return df.withColumn("risk_score", risk).withColumns({
        "tier": R.tier(F.col("risk_score")), "needs_alert": R.alert(F.col("risk_score"), alert_at)})


def nano_scores(steps: DataFrame, chains: DataFrame, judge_raw: Column | None = None,
                alert_at: float = fixed.ALERT_AT) -> DataFrame:
    """Self-contained score; a four-part judge reply takes three quarters of the blend."""
    d = D.nano_signals(steps, chains).withColumn("failure_mode", X.nano_mode())
    risk, label = F.col("behaviour"), F.lit(None).cast("string")
    if judge_raw is not None:
        j, lab = R.four_part_judge(judge_raw)
        has = judge_raw.isNotNull()
        risk = F.when(has, 0.25 * F.col("behaviour") + 0.75 * j).otherwise(F.col("behaviour"))
        label = F.when(has, lab)
    return verdict(d, risk, alert_at).withColumn("judge_label", label)


def chain_scores(steps: DataFrame, chains: DataFrame, second_risk: Column | None = None,
                 second_label: Column | None = None, alert_at: float = fixed.ALERT_AT) -> DataFrame:
    """Full score: behaviour, failure mode, optional second opinion (weight 3 to 1), tier and alert."""
    d = D.nano_signals(steps, chains, X.GUARD_KINDS).withColumn("failure_mode", X.guard_mode())
    second = second_risk if second_risk is not None else F.lit(None).cast("double")
    d = verdict(d, R.blend(F.col("behaviour"), second), alert_at)
    return d.withColumns({
        "judge_label": second_label if second_label is not None else F.lit(None).cast("string"),
        "step_count": F.col("n_search")})


#: The structural model's features and the signals they are.
STRUCTURE = {"sc2_step_count": "sc2", "sc3_obs_thought_gap": "sc3", "sc5_thought_len": "sc5"}


def model_scores(steps: DataFrame, chains: DataFrame, table, judge_raw: Column | None = None, structural: bool = True, local: bool = True,
                 alert_at: float = fixed.ALERT_AT) -> DataFrame:
    """Full score with the first second opinion there is: the promoted structural model, the local one, the judge's reply.

    ``table`` is a :class:`~plumbline.operators.model_table.ModelTable`. The opinion weighs 3 to 1; labels are STRUCTURAL, LOCAL or
    the judge's. Without any the behavioural score stands alone.
    """
    if structural and (m := table.current("structural")):
        model, scale = m
        d = D.nano_signals(steps, chains, X.GUARD_KINDS).withColumns({k: F.col(v) for k, v in STRUCTURE.items()})
        second, label = models.rescaled(d, model.names, scale).select(*d.columns, model.risk().alias("second")), F.lit("STRUCTURAL")
    elif local and (m := table.current("local")):
        model, _ = m
        d = D.nano_signals(steps, chains, X.GUARD_KINDS)
        risk = D.fifteen_features(steps, chains).select("chain_id", model.risk().alias("second"))
        second, label = d.join(risk, "chain_id", "left"), F.lit("LOCAL")
    else:
        label = R.judge_label(judge_raw) if judge_raw is not None else F.lit(None).cast("string")
        second = D.nano_signals(steps, chains, X.GUARD_KINDS).withColumn("second", R.judge_risk(label))
    d = second.withColumns({"failure_mode": X.guard_mode(), "judge_label": label, "step_count": F.col("n_search")})
    return verdict(d, R.blend(F.col("behaviour"), F.col("second")), alert_at)


def question_only(chains: DataFrame) -> DataFrame:
    """Score of a chain before it has run: no steps and no answer."""
    q = F.size(T.content_tokens(T.text("question")))
    d = chains.withColumns({"sc1": F.lit(1.0), "sc2": F.lit(0.0), "sc3": F.lit(0.5), "sc5": F.lit(0.0),
                            "sc6": F.lit(0.5), "sc11": F.when(q >= 0, 1.0), "sc9": F.lit(None).cast("double"),
                            "sc10": F.lit(None).cast("double"), "sc12": F.lit(None).cast("double")})
    d = verdict(d.withColumn("behaviour", D.nano_mean()), F.col("behaviour"))
    return d.withColumns({
        "confidence": R.confidence_word(F.col("risk_score")), "outcome": R.outcome_word(F.col("risk_score")),
        "recommended_action": R.lookup(F.col("tier"), {
            "LOW": "use_stronger_model_or_add_verification", "MEDIUM": "proceed_with_monitoring", "HIGH": "proceed"})})


def stream_guard(prefixes: DataFrame, judge_risk: Column, on_track: Column, abort_at: float = 0.65,
                 at_step: int = 2) -> DataFrame:
    """Abort decision at ``at_step``: prefix scores in, one row per chain out.

    Up to step two the behavioural prefix score points the other way and is inverted.
    """
    last = prefixes.filter(F.col("t") <= at_step).groupBy("chain_id").agg(
        F.max("t").alias("t"), F.max_by("behaviour", "t").alias("behaviour"))
    own = F.when(F.col("t") <= 2, 1.0 - F.col("behaviour")).otherwise(F.col("behaviour"))
    last = last.withColumns({"judge_risk": judge_risk, "on_track": on_track})
    mix = F.when(F.col("judge_risk").isNotNull(), 0.30 * own + 0.70 * F.col("judge_risk")).otherwise(own)
    risk = F.when(~F.coalesce("on_track", F.lit(True)), F.greatest(mix, F.lit(0.68))).otherwise(mix)
    return last.withColumn("risk_at_step", risk).withColumns({
        "abort": F.col("risk_at_step") >= abort_at, "step_index": F.col("t") - 1})


def step_monitor(prefixes: DataFrame, chains: DataFrame) -> DataFrame:
    """Row per chain and number of finished steps; nothing finished yet reads .5 and medium."""
    start = chains.select("chain_id", F.lit(0).alias("t"), F.lit(0.5).alias("risk_score"))
    d = start.unionByName(prefixes.select("chain_id", "t", F.col("behaviour").alias("risk_score")))
    return d.withColumns({"risk": R.risk_word(F.col("risk_score")), "confidence": R.confidence_word(F.col("risk_score")),
                          "outcome": R.outcome_word(F.col("risk_score"))})


def nano_prefix(prefixes: DataFrame) -> DataFrame:
    """Announced next step: pending-prefix score damped by .85, cut at .65 and .45."""
    r = F.least(F.col("behaviour") * 0.85, F.lit(1.0))
    return prefixes.select("chain_id", (F.col("t") + 1).alias("step"), r.alias("risk_score"),
                           F.when(r >= 0.65, "high").when(r >= 0.45, "medium").otherwise("low").alias("risk"))


def process_scores(features: DataFrame, names: list[str], output: str = "final_answer", judge: Column | None = None,
                   judge_weight: float = 0.5, alert_at: float = fixed.ALERT_AT) -> DataFrame:
    """Mean of the extractor features, optional judge column, tier, mode and repair hint."""
    mean = sum((F.col(n) for n in names), F.lit(0.0)) / float(len(names))
    beh = T.clip01(mean)
    risk = beh if judge is None else F.when(judge.isNotNull(), (1 - judge_weight) * beh + judge_weight * judge).otherwise(beh)
    d = verdict(features.withColumn("behaviour", beh), T.clip01(risk), alert_at)
    d = d.withColumn("failure_mode", X.process_mode(F.col(output)))
    return d.withColumn("repair_hint", X.repair_hint(F.col("failure_mode")))


def evaluation_summary(scored: DataFrame) -> DataFrame:
    """One row: chains, mean risk, alerts and tier counts. Rows without a risk read .5 and UNKNOWN."""
    risk = F.coalesce("risk_score", F.lit(0.5))
    t = F.when(F.col("risk_score").isNull(), "UNKNOWN").otherwise(F.col("tier"))
    alert = F.coalesce("needs_alert", F.lit(False))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg(risk).alias("mean_risk"),
                      F.avg(alert.cast("double")).alias("alert_rate"), F.count_if(alert).alias("alert_count"),
                      *[F.count_if(t == x).alias(f"tier_{x}") for x in ("HIGH", "MEDIUM", "LOW", "UNKNOWN")])


def relative_ranks(df: DataFrame, scores: dict[str, str], blocks: int = 256) -> DataFrame:
    """``rank / (n - 1)`` of scores in the whole table, ties at their lowest rank; ``{score: name}``.

    Ranks come from a histogram of distinct scores with block-wise running counts, never from one
    window over all rows.
    """
    out = df
    for score, name in scores.items():
        hist = value_blocks(histogram(df, score, [], {"_c": F.lit(1)}), score, blocks)
        below = running_sums(hist, [], "_blk", [score], {"_below": F.col("_c")}, inclusive=False)
        n = hist.agg(F.sum("_c").alias("_n"))
        ranked = below.join(F.broadcast(n)).select(
            F.col(score).alias("_s"), (F.col("_below") / F.greatest(F.col("_n") - 1, F.lit(1))).alias(name))
        out = out.join(ranked, F.col(score) == F.col("_s")).drop("_s")
    return out
