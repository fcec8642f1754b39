"""Calibration and evaluation statistics over whole score tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline import fixed
from plumbline.functions import risk as R, text as T
from plumbline.operators.ordered import order_statistics, running_sums, value_blocks
from plumbline.session import written


def score_counts(df: DataFrame, score: str, wrong: str, keys: Sequence[str] = (), blocks: int = 256,
                 weight: str | None = None) -> DataFrame:
    """Distinct scores with counts of wrong and right rows at and below each, and the totals."""
    one = F.col(weight) if weight else F.lit(1)
    hist = df.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(
        F.sum(F.when(F.col(wrong) == 1, one).otherwise(0)).cast("double").alias("pos"),
        F.sum(F.when(F.col(wrong) == 1, 0).otherwise(one)).cast("double").alias("neg"))
    hist = value_blocks(hist, score, blocks)
    total = hist.groupBy(*keys).agg(F.sum("pos").alias("pos_all"), F.sum("neg").alias("neg_all"))
    run = running_sums(hist, keys, "_blk", [score], {"pos_upto": F.col("pos"), "neg_upto": F.col("neg")})
    # one row of totals without keys; per key the planner decides by size
    return (run.join(total, list(keys)) if keys else run.join(F.broadcast(total))).drop("_blk")


def auroc(df: DataFrame, score: str, wrong: str, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """AUROC with half credit for ties; null where only one class is present."""
    c = score_counts(df, score, wrong, keys, weight=weight)
    won = F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2.0)
    g = c.groupBy(*keys).agg(F.sum(won).alias("_w"), F.first("pos_all").alias("n_wrong"), F.first("neg_all").alias("n_right"))
    return g.select(*keys, F.try_divide(F.col("_w"), F.col("n_wrong") * F.col("n_right")).alias("auroc"), "n_wrong", "n_right")


def safe_auroc(a: Column) -> Column:
    return F.greatest(a, 1 - a)


def bootstrap_auroc(df: DataFrame, row_id: str, score: str, wrong: str, resamples: int = 1000, seed: int = 42,
                    rows_per_block: int = 20_000) -> DataFrame:
    """Mean AUROC with its 2.5 and 97.5 percentiles over Poisson-weighted resamples.

    Rows shrink to counts per distinct score first; the weight of ``c`` equal rows is one Poisson(c)
    draw. Draws depend on score, class and seed only, so any partitioning gives the same numbers. A
    block of scores returns three sums per resample; resamples with one class only are left out.
    """
    hist = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count_if(F.col(wrong) == 1).alias("pos"), F.count_if(F.col(wrong) == 0).alias("neg"))
    hist = written(df.sparkSession, hist, "scores")
    hist = value_blocks(hist, "s", max(2, hist.count() // rows_per_block))

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s")
        pos, neg, won = np.zeros(resamples), np.zeros(resamples), np.zeros(resamples)
        for s, p, n in zip(pdf["s"], pdf["pos"], pdf["neg"], strict=True):
            key = [seed, int(np.float64(s).view(np.uint64))]
            wp = np.random.Generator(np.random.Philox(key=np.array([key[0], key[1]], np.uint64))).poisson(p, resamples) if p else 0.0
            wn = np.random.Generator(np.random.Philox(key=np.array([key[0] + 1, key[1]], np.uint64))).poisson(n, resamples) if n else 0.0
            won += wp * (neg + wn / 2.0)
            pos, neg = pos + wp, neg + wn
        return pd.DataFrame({"blk": float(pdf["_blk"].iloc[0]), "rep": np.arange(resamples), "pos": pos, "neg": neg, "won": won})

    per = hist.groupBy("_blk").applyInPandas(sums, "blk double, rep int, pos double, neg double, won double")
    lower = W.partitionBy("rep").orderBy("blk").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("_below", F.coalesce(F.sum("neg").over(lower), F.lit(0.0)))
    g = per.groupBy("rep").agg((F.sum("won") + F.sum(F.col("pos") * F.col("_below"))).alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    g = g.select(F.try_divide(F.col("w"), F.col("p") * F.col("n")).alias("auroc")).filter("auroc IS NOT NULL")
    q = F.percentile("auroc", F.array(F.lit(0.025), F.lit(0.975)))  # at most one value per resample
    return g.agg(F.count(F.lit(1)).alias("resamples"), F.avg("auroc").alias("mean"), q.alias("_q")).select(
        "resamples", "mean", F.element_at("_q", 1).alias("lower"), F.element_at("_q", 2).alias("upper"))


def conformal_threshold(df: DataFrame, score: str, wrong: str, keys: Sequence[str] = (), alpha: float = 0.15,
                        mode: str = "as_published") -> DataFrame:
    """Order statistic of the wrong rows' scores.

    ``as_published`` takes rank ``ceil((n + 1)(1 - alpha))`` and so alerts on about ``alpha`` of the
    wrong rows; ``coverage`` takes the ``alpha`` rank and catches about ``1 - alpha`` of them.
    """
    c = score_counts(df, score, wrong, keys)
    n = F.col("pos_all")
    share = 1.0 - alpha if mode == "as_published" else alpha
    rank = F.greatest(F.lit(1.0), F.least(F.ceil((n + 1) * share).cast("double"), n))
    hit = (F.col("pos_upto") >= rank) & (F.col("pos_upto") - F.col("pos") < rank)
    g = c.groupBy(*keys).agg(F.max(F.when(hit & (n > 0), F.col(score))).alias("_t"), F.first("pos_all").cast("long").alias("n_wrong"))
    return g.select(*keys, F.coalesce("_t", F.lit(0.5)).alias("threshold"), "n_wrong")


def precision_at(df: DataFrame, order: Sequence[Column], wrong: str, ks: Sequence[int] = (10, 50, 100)) -> DataFrame:
    """Share of wrong rows among the ``k`` riskiest."""
    top = df.orderBy(*order).limit(max(ks)).select(wrong, F.row_number().over(W.orderBy(*order)).alias("rn"))
    rows = top.select(wrong, "rn", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).filter(F.col("rn") <= F.col("k"))
    return rows.groupBy("k").agg(F.avg(F.col(wrong).cast("double")).alias("precision"))


def at_false_positive_rate(df: DataFrame, score: str, wrong: str, keys: Sequence[str] = (), alpha: float = 0.10) -> DataFrame:
    """Lowest threshold whose false positive rate stays within ``alpha``, with precision and recall."""
    c = score_counts(df, score, wrong, keys)
    tp = F.col("pos_all") - F.col("pos_upto") + F.col("pos")
    fp = F.col("neg_all") - F.col("neg_upto") + F.col("neg")
    c = c.withColumns({"tp": tp, "fp": fp})
    ok = c.filter(F.coalesce(F.try_divide(F.col("fp"), F.col("neg_all")), F.lit(0.0)) <= alpha)
    best = ok.groupBy(*keys).agg(F.min_by(F.struct(F.col(score).alias("threshold"), "tp", "fp", "pos_all", "neg_all"), score).alias("b"))
    b = lambda n: F.col(f"b.{n}")
    return best.select(*keys, b("threshold").alias("threshold"),
                       F.try_divide(b("tp"), b("tp") + b("fp")).alias("precision"), F.try_divide(b("tp"), b("pos_all")).alias("recall"),
                       F.coalesce(F.try_divide(b("fp"), b("neg_all")), F.lit(0.0)).alias("fpr"),
                       ((b("tp") + b("fp")) / (b("pos_all") + b("neg_all"))).alias("coverage"))


def alert_quality(df: DataFrame, thresholds: DataFrame, score: str, wrong: str, key: str) -> DataFrame:
    """Precision and recall per key when each key alerts at its own threshold."""
    d = df.join(thresholds.select(key, "threshold"), key)
    fired = F.col(score) >= F.col("threshold")
    g = d.groupBy(key).agg(F.count_if(fired).alias("alerts"), F.count_if(fired & (F.col(wrong) == 1)).alias("hits"),
                           F.count_if(F.col(wrong) == 1).alias("wrong_rows"))
    return g.select(key, "alerts", F.try_divide("hits", "alerts").alias("precision"), F.try_divide("hits", "wrong_rows").alias("recall"))


def agreement(a: Column, b: Column, c: Column) -> Column:
    """Mean pairwise token F1 of three answers, without a stop list."""
    x, y, z = (T.content_tokens(v, fixed.NO_STOP) for v in (a, b, c))
    return (T.token_f1(x, y) + T.token_f1(x, z) + T.token_f1(y, z)) / 3.0


def agreement_threshold(df: DataFrame, score: str, agree: str, at: float = 0.5, alpha: float = 0.10, min_rows: int = 10) -> DataFrame:
    """Quantile of the scores of chains whose agents agree; null when fewer than ``min_rows`` do."""
    good = df.filter(F.col(agree) >= at)
    n = F.col("_n")
    q = F.least(F.lit(1.0), (1 + 1.0 / n) * (1 - alpha))
    d = order_statistics(good, [], score, {"threshold": q * (n - 1)})
    return d.select(F.when(F.col("n") >= min_rows, F.col("threshold")).alias("threshold"), "n")


def kalman(risks: Column, q: float = 0.2, r: float = 0.05) -> Column:
    """One-dimensional Kalman filter over an ordered array of risks."""
    start = F.struct(F.get(risks, F.lit(0)).cast("double").alias("x"), F.lit(1.0).alias("p"))

    def step(s, z):
        p = s["p"] + q
        gain = p / (p + r)
        return F.struct((s["x"] + gain * (z - s["x"])).alias("x"), ((1.0 - gain) * p).alias("p"))
    out = F.aggregate(F.slice(risks, F.lit(2), F.greatest(F.size(risks) - 1, F.lit(0))), start, step, lambda s: T.clip01(s["x"]))
    return F.when(F.size(risks) > 0, out).otherwise(0.5)


def kalman_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], risk: str, q: float = 0.2, r: float = 0.05, settled: int = 64) -> DataFrame:
    """The filter over all rows of a key in order, as one weighted sum; rows tie by ``order`` alone.

    Gains depend on a row's place only, and stay the same from place ``settled`` on (they do so to the last bit), so a row
    counts with its gain times what the later rows leave of it, both by its place and the key's number of rows. Places come
    from running counts, so no task holds a key.
    """
    gains, p = [1.0], 1.0
    while len(gains) < settled:
        p += q
        gains.append(p / (p + r))
        p *= 1.0 - gains[-1]
    left = [0.0]  # logarithm of what the gains up to a place leave
    for g in gains[1:]:
        left.append(left[-1] + math.log(1.0 - g))
    d = df.select(*keys, *order, F.col(risk).cast("double").alias("_z")).where(F.col("_z").isNotNull())
    d = value_blocks(d, order[0])
    d = running_sums(d, keys, "_blk", order, {"_t": F.lit(1)})
    d = d.join(d.groupBy(*keys).agg(F.max("_t").alias("_n")), list(keys))
    at = lambda values, place: F.element_at(F.array(*[F.lit(v) for v in values]), F.least(place, F.lit(settled)).cast("int"))
    beyond = lambda place: F.greatest(place - settled, F.lit(0)) * math.log(1.0 - gains[-1])
    log = lambda place: at(left, place) + beyond(place)
    weight = at(gains, F.col("_t")) * F.exp(log(F.col("_n")) - log(F.col("_t")))
    return d.groupBy(*keys).agg(T.clip01(F.sum(weight * F.col("_z"))).alias(risk))


def majority(answers: DataFrame, key: str = "chain_id", answer: str = "answer") -> DataFrame:
    """Most frequent answer per key and its share; equal counts go to the later answer in order."""
    c = answers.groupBy(key, answer).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(key).agg(F.max_by(answer, F.struct("n", answer)).alias("majority_answer"),
                              (F.max("n") / F.sum("n")).alias("majority_fraction"), F.sum("n").alias("samples"))


def mesh(answers: DataFrame, tiers: DataFrame, key: str = "chain_id", high: float = 0.60, low: float = 0.30) -> DataFrame:
    """Agreement of all agents of a chain: mean pairwise F1, tier upgrade, escalation, consensus.

    F1 of two token sets is ``2 shared / (size a + size b)``. Summed over all partners of an agent
    that is a sum over its tokens and over the set sizes in which the token occurs, so no pair of
    agents is ever formed: work grows with tokens, not with the square of a group. The agreement adds whole
    numbers of shared tokens for each pair of sizes and divides last, as sums of small shares would miss a limit that it
    meets exactly; the limits are compared at 12 digits.
    """
    a = answers.select(key, "agent", "answer", T.content_tokens(F.col("answer"), fixed.MESH_STOP).alias("tok"))
    a = a.withColumn("size", F.size("tok"))
    tok = a.select(key, "agent", "size", F.explode("tok").alias("t"))
    sizes = tok.groupBy(key, "t", "size").agg(F.count(F.lit(1)).alias("c"))
    by_token = sizes.select(key, "t", F.col("size").alias("other"), F.col("c").alias("others"))
    mine = sizes.join(by_token, [key, "t"])
    weight = mine.groupBy(key, "t", "size").agg(F.sum(2.0 * F.col("others") / (F.col("size") + F.col("other"))).alias("w"))
    total = tok.join(weight, [key, "t", "size"]).groupBy(key, "agent").agg(F.sum("w").alias("w"))
    n = answers.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    per = a.select(key, "agent", "answer").join(total, [key, "agent"], "left").join(n, key)
    # an agent with tokens agrees fully with itself; that is not a pair
    per = per.withColumn("to_others", F.coalesce(F.try_divide(F.col("w") - 1.0, F.col("n") - 1), F.lit(0.0)))
    own = a.groupBy(key, "size", F.col("size").alias("other")).agg((-F.sum("size")).cast("long").alias("shared"))
    shared = mine.groupBy(key, "size", "other").agg(F.sum(F.col("c") * F.col("others")).alias("shared")).unionByName(own)
    shared = shared.groupBy(key, "size", "other").agg(F.sum("shared").alias("shared"))
    pairs = shared.groupBy(key).agg(F.sum(F.coalesce(F.try_divide(2.0 * F.col("shared"), F.col("size") + F.col("other")), F.lit(0.0))).alias("pairs"))
    g = per.groupBy(key).agg(F.first("n").alias("n_agents"), F.max_by("answer", F.struct(F.round("to_others", 9), -F.col("agent"))).alias("best"))
    g = g.join(pairs, key).join(tiers, key, "left")
    g = g.withColumn("agreement", F.coalesce(F.try_divide("pairs", F.col("n_agents") * (F.col("n_agents") - 1)), F.lit(0.0)))
    met = F.round("agreement", 12)
    esc = met < low
    return g.select(key, "n_agents", "tier", "agreement",
                    F.when((met >= high) & (F.col("tier") == "LOW"), "MEDIUM").otherwise(F.col("tier")).alias("upgraded_tier"),
                    esc.alias("escalate"), F.when(~esc | (F.col("n_agents") == 1), F.col("best")).alias("consensus"))


def bandit_arms(log: DataFrame, arms: DataFrame, arm: Sequence[str], reward: str, c: float) -> DataFrame:
    """UCB1 table: pulls, mean reward, bound and the arm to pull next.

    Arms carry ``pos``; an arm that was never pulled goes first, in that order.
    """
    stats = log.groupBy(*arm).agg(F.count(F.lit(1)).alias("pulls"), F.sum(reward).alias("rewards"))
    d = arms.join(stats, list(arm), "left").withColumn("pulls", F.coalesce("pulls", F.lit(0)))
    total = d.agg(F.sum("pulls").alias("total"))
    d = d.join(F.broadcast(total))
    mean = F.coalesce(F.try_divide("rewards", "pulls"), F.lit(0.0))
    bound = F.when(F.col("pulls") > 0, mean + F.sqrt(c * F.ln(F.greatest(F.col("total"), F.lit(1))) / F.greatest("pulls", F.lit(1))))
    d = d.select(*arm, "pos", "pulls", mean.alias("mean_reward"), bound.alias("bound"))
    pick = d.agg(F.max_by("pos", F.struct(F.coalesce("bound", F.lit(float("inf"))), -F.col("pos"))).alias("_pick"))
    return d.join(F.broadcast(pick)).withColumn("next", F.col("pos") == F.col("_pick")).drop("_pick")


def top_arms(table: DataFrame, n: int = 5) -> DataFrame:
    """The arms of highest mean reward that were pulled at all, earlier ones first on equal reward."""
    return table.filter("pulls > 0").orderBy(F.desc("mean_reward"), "pos").limit(n)


def nearest_arm(weight: Column) -> Column:
    """Closest candidate weight, the earlier one on equal distance."""
    gaps = F.array(*[F.struct(F.abs(weight - a).alias("d"), F.lit(i).alias("i"), F.lit(a).alias("a")) for i, a in enumerate(fixed.BANDIT_ARMS)])
    return F.array_min(gaps)["a"]


def diversity_reward(share: Column) -> Column:
    return F.when(share >= 0.67, 1.0).when(share >= 0.33, 0.5).otherwise(0.0)


def lifecycle(seen: Column) -> tuple[Column, Column]:
    """(stage, alert threshold) by chains seen so far."""
    stage = F.when(seen < 10, "COLD").when(seen < 50, "WARMING").otherwise("DEPLOYED")
    return stage, R.lookup(stage, {"COLD": 0.70, "WARMING": 0.60, "DEPLOYED": 0.55}).cast("double")
