"""Queries: fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import risk as R
from plumbline.operators import calibration as C, features as D, models as G, scoring as Z
from plumbline.operators.model_table import ModelTable
from plumbline.plans import views as V
from plumbline.plans.fits import logistic_sql, risk_sql
from plumbline.plans.registry import query
from plumbline.plans.scores import bank_and_queries
from plumbline.plans.store import taxonomy
from plumbline.plans.traces import r6
from plumbline.plans.views import sql_tier, with_views
from plumbline.session import written, written_once
from plumbline.streaming.replay import numbered


def labelled_features(spark, base, kind="fifteen"):
    fn = {"eleven": D.eleven_features, "fifteen": D.fifteen_features, "seven": D.seven_features}[kind]
    return written_once(spark, f"{kind}:{base}", lambda: fn(V.steps(spark, base), V.labelled_chains(spark, base)))


@query("g1_eleven_feature_model")
def g1(spark, base):
    d = labelled_features(spark, base, "eleven")
    cv = G.cross_validated(d, "chain_id", D.ELEVEN)
    m = G.fit_linear(d, D.ELEVEN)
    return d.select("chain_id", "wrong", *[F.round(m.risk(), 6).alias("risk")], F.lit(cv).cast("double").alias("cv_auroc"))


V.cte("fifteen_l", "SELECT f.*, l.wrong FROM fifteen_v f JOIN labelled_v l USING (chain_id)", "fifteen_v", "labelled_v")
LOCAL_SQL = logistic_sql("fifteen_l", D.FIFTEEN, balanced=True)


@query("g2_local_verifier", with_views(LOCAL_SQL + f"SELECT chain_id, wrong, round({risk_sql(D.FIFTEEN)}, 6) AS risk FROM fifteen_l, lr", "fifteen_l"))
def g2(spark, base):
    d = labelled_features(spark, base)
    m = G.fit_linear(d, D.FIFTEEN, balanced=True)
    return d.select("chain_id", "wrong", F.round(m.risk(), 6).alias("risk"))


@query("g3_importances", with_views(LOCAL_SQL + " UNION ALL ".join(f"SELECT '{n}' AS feature, round(abs(b{i}), 4) AS importance FROM lr" for i, n in enumerate(D.FIFTEEN)), "fifteen_l"))
def g3(spark, base):
    m = G.fit_linear(labelled_features(spark, base), D.FIFTEEN, balanced=True)
    return spark.createDataFrame(m.importances(), "feature string, importance double")


STRUCTURE = ["sc2_step_count", "sc3_obs_thought_gap", "sc5_thought_len"]
_SCALED = ", ".join(f"({n} - avg_{i}) / dev_{i} AS {n}" for i, n in enumerate(STRUCTURE))
V.cte("target_v", "SELECT count(*) AS target_n, " + ", ".join(
    f"avg({n}) AS avg_{i}, CASE WHEN stddev_pop({n}) < 1e-8 THEN 1.0 ELSE stddev_pop({n}) END AS dev_{i}" for i, n in enumerate(STRUCTURE)) + " FROM fifteen_v", "fifteen_v")
V.cte("structure_l", f"SELECT chain_id, wrong, {_SCALED} FROM fifteen_l, target_v", "fifteen_l", "target_v")
V.cte("structure_v", f"SELECT chain_id, {_SCALED} FROM fifteen_v, target_v", "fifteen_v", "target_v")
STRUCTURAL_SQL = logistic_sql("structure_l", STRUCTURE, balanced=True)


def structural(spark, base):
    """Fitted on labelled chains, scaled to all unlabelled ones: model, scale and the target rows."""
    d = labelled_features(spark, base)
    target = D.fifteen_features(V.steps(spark, base), V.chains(spark, base)).select("chain_id", *STRUCTURE)
    target = written(spark, target, "target")
    scale = G.target_scale(target, STRUCTURE)
    return G.fit_linear(G.rescaled(d, STRUCTURE, scale), STRUCTURE, balanced=True), scale, target


@query("g4_structural_verifier", with_views(STRUCTURAL_SQL + f"SELECT chain_id, round({risk_sql(STRUCTURE)}, 6) AS risk FROM structure_v, lr", "structure_l", "structure_v"))
def g4(spark, base):
    m, scale, target = structural(spark, base)
    return G.rescaled(target, STRUCTURE, scale).select("chain_id", F.round(m.risk(), 6).alias("risk"))


def model_score_sql(fit: str, risk: str, label: str, *views: str) -> str:
    return with_views(fit + f""", s AS (SELECT chain_id, {risk} AS second FROM {views[-1]}, lr), r AS (SELECT nano_v.*, (behaviour + 3.0 * second) / 4.0 AS risk FROM nano_v JOIN s USING (chain_id))
SELECT chain_id, round(risk, 6) AS risk_score, {sql_tier('risk')} AS tier, risk >= 0.7 AS needs_alert, guard_mode AS failure_mode, '{label}' AS judge_label, n_search AS step_count, round(behaviour, 6) AS behaviour FROM r""", *views, "nano_v")


def scored_by(spark, base, table, **how):
    d = Z.model_scores(V.steps(spark, base), V.chains(spark, base), table, **how)
    return d.select("chain_id", "tier", "needs_alert", "failure_mode", "judge_label", "step_count", *r6("risk_score", "behaviour"))


@query("f4_structural_opinion", model_score_sql(STRUCTURAL_SQL, risk_sql(STRUCTURE), "STRUCTURAL", "structure_l", "structure_v"))
def f4_structural(spark, base):
    """Both models are in the table; the structural one comes first."""
    table, (m, scale, _) = ModelTable(spark), structural(spark, base)
    table.offer("local", G.fit_linear(labelled_features(spark, base), D.FIFTEEN, balanced=True), None)
    table.offer("structural", m, None, target=scale)
    return scored_by(spark, base, table)


@query("f4_local_opinion", model_score_sql(LOCAL_SQL, risk_sql(D.FIFTEEN), "LOCAL", "fifteen_l", "fifteen_v"))
def f4_local(spark, base):
    table = ModelTable(spark)
    table.offer("local", G.fit_linear(labelled_features(spark, base), D.FIFTEEN, balanced=True), None)
    return scored_by(spark, base, table)


def isotonic_sql(view: str, fit_score: str, score: str) -> str:
    """Max-min form of the monotone fit on distinct scores, linear between them."""
    return f"""
, p AS (SELECT {fit_score} AS x, avg(wrong) AS y, count(*) AS w FROM {view} GROUP BY 1), c AS (SELECT x, sum(y*w) OVER (ORDER BY x) AS cy, sum(w) OVER (ORDER BY x) AS cw, y*w AS yw, w FROM p),
seg AS (SELECT a.x AS i, b.x AS j, (b.cy - a.cy + a.yw) / (b.cw - a.cw + a.w) AS m FROM c a JOIN c b ON a.x <= b.x),
f AS (SELECT k, max(m) AS fit FROM (SELECT p.x AS k, i, min(m) AS m FROM p JOIN seg ON i <= p.x AND j >= p.x GROUP BY p.x, i) GROUP BY k),
n AS (SELECT k, fit, lead(k) OVER (ORDER BY k) AS k2, lead(fit) OVER (ORDER BY k) AS fit2, min(k) OVER () AS k0, max(k) OVER () AS k1 FROM f)
SELECT chain_id, round(CASE WHEN n.k2 IS NULL OR {score} <= n.k THEN n.fit ELSE n.fit + (n.fit2 - n.fit) * ({score} - n.k) / (n.k2 - n.k) END, 6) AS calibrated
FROM {view} JOIN n ON ({score} >= n.k AND ({score} < n.k2 OR n.k2 IS NULL)) OR ({score} < n.k0 AND n.k = n.k0)"""


@query("g5_isotonic", "WITH RECURSIVE " + with_views("""
, p AS (SELECT risk_score AS x, sum(wrong) AS yw, count(*) AS w FROM scored_v GROUP BY 1),
c AS (SELECT row_number() OVER (ORDER BY x) AS i, x, CAST(sum(yw) OVER (ORDER BY x) AS DOUBLE) AS cy, CAST(sum(w) OVER (ORDER BY x) AS DOUBLE) AS cw FROM p),
g AS (SELECT CAST(0 AS BIGINT) AS i, 0.0::DOUBLE AS cy, 0.0::DOUBLE AS cw, NULL::DOUBLE AS m
 UNION ALL SELECT r.i, r.cy, r.cw, r.m FROM (SELECT arg_min({'i': c.i, 'cy': c.cy, 'cw': c.cw, 'm': (c.cy - g.cy) / (c.cw - g.cw)}, {'m': (c.cy - g.cy) / (c.cw - g.cw), 'n': -c.i}) AS r FROM g JOIN c ON c.i > g.i) WHERE r IS NOT NULL),
f AS (SELECT i AS hi, lag(i) OVER (ORDER BY i) AS lo, m FROM g)
SELECT chain_id, round(m, 6) AS calibrated FROM scored_v JOIN c ON x = risk_score JOIN f ON c.i > lo AND c.i <= hi""", "scored_v").strip().removeprefix("WITH"))
def g5(spark, base):
    """Fitted on the scores as they are; in SQL, by the corners of the greatest convex minorant of the running sums."""
    s = V.scored(spark, base).select("chain_id", "risk_score", "wrong")
    return G.fit_isotonic(s, "risk_score", "wrong", 10)(s, "risk_score").select("chain_id", F.round("calibrated", 6).alias("calibrated"))


@query("g6_quick_calibration", with_views(", ln AS (SELECT chain_id, behaviour, wrong FROM nano_v JOIN labelled_v USING (chain_id))" + isotonic_sql("ln", "behaviour", "behaviour"), "nano_v", "labelled_v"))
def g6(spark, base):
    d = D.nano_signals(V.steps(spark, base), V.labelled_chains(spark, base), ("action", "answer_hit")).select("chain_id", "behaviour", "wrong")
    d = written(spark, d, "nano")
    return G.fit_isotonic(d, "behaviour", "wrong", 20)(d, "behaviour").select("chain_id", F.round("calibrated", 6).alias("calibrated"))


@query("g7_fit_report", with_views(LOCAL_SQL + f""", r AS (SELECT wrong, round({risk_sql(D.FIFTEEN)}, 9) AS risk FROM fifteen_l, lr)
SELECT (SELECT count(*) FROM r) AS n_runs, (SELECT count(*) FROM r WHERE wrong = 0) AS n_correct, (SELECT count(*) FROM r WHERE wrong = 1) AS n_wrong,
 round(avg(CASE WHEN a.risk > b.risk THEN 1.0::DOUBLE WHEN a.risk = b.risk THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 6) AS auroc FROM r a, r b WHERE a.wrong = 1 AND b.wrong = 0""", "fifteen_l"))
def g7(spark, base):
    """Counts and AUROC of a fit; needs five runs."""
    d = labelled_features(spark, base)
    if d.count() < 5:
        raise ValueError("at least 5 runs are needed")
    m = G.fit_linear(d, D.FIFTEEN, balanced=True)
    a = C.auroc(d.withColumn("risk", F.round(m.risk(), 9)), "risk", "wrong")
    return a.select((F.col("n_wrong") + F.col("n_right")).cast("long").alias("n_runs"), F.col("n_right").cast("long").alias("n_correct"),
                    F.col("n_wrong").cast("long").alias("n_wrong"), F.round("auroc", 6).alias("auroc"))


@query("g8_promotion_gate")
def g8(spark, base):
    """Three runs against one table: the first model is stored, the others replace the stored one only if they are better by more than .005."""
    d, table = labelled_features(spark, base, "eleven"), ModelTable(spark)
    for names, fit in ((["steps_norm"], None), (D.ELEVEN, lambda train: G.fit_pair(train, D.ELEVEN)), (["steps_norm"], None)):
        table.offer("mini_judge", G.fit_linear(d, names), G.cross_validated(d, "chain_id", names, fit=fit))
    return table.versions().select("version", F.col("stored").alias("stored_auroc"), F.col("metric").alias("new_auroc"), "promoted")


@query("g9_before_after")
def g9(spark, base):
    d = written(spark, G.stratified(labelled_features(spark, base, "eleven"), "chain_id", "wrong", 10), "split")
    train, test = d.filter("fold < 7"), d.filter("fold >= 7")
    # failures of the taxonomy, chains without a label of their own, enter the training side only
    tax = taxonomy(spark, base).withColumn("chain_id", F.col("question").cast("long")).join(d.select("chain_id"), "chain_id", "left_anti")
    tax = written(spark, tax, "taxonomy")
    steps = tax.select("chain_id", F.posexplode("steps").alias("step_idx", "s")).select("chain_id", F.col("step_idx").cast("long").alias("step_idx"), "s.*")
    extra = written(spark, D.eleven_features(steps, tax.select("chain_id", "question", "final_answer", "wrong")), "extra")
    return G.before_after(train, extra, test, "chain_id", D.ELEVEN)


@query("g10_network_ensemble")
def g10(spark, base):
    d = labelled_features(spark, base, "seven")
    return G.ensemble_risk(d, d, "chain_id", D.SEVEN)


@query("g11_replay_buffer")
def g11(spark, base):
    """The ensemble fitted on the latest 2000 labelled runs; no rows when there are fewer than 20."""
    d = labelled_features(spark, base, "seven").orderBy(F.desc("ts"), F.desc("chain_id")).limit(2000)
    d = written(spark, d, "replay")
    if d.count() < 20:
        return d.select("chain_id", F.lit(None).cast("double").alias("risk")).limit(0)
    return G.ensemble_risk(d, d, "chain_id", D.SEVEN).select("chain_id", "risk")


@query("g12_feedback_retrain")
def g12(spark, base):
    """Feedback joined with its chains' features; small sets skip or leave out the validation."""
    f = V.feedback(spark, base).select("chain_id", (F.col("label") == "incorrect").cast("int").alias("wrong"))
    d = D.fifteen_features(V.steps(spark, base), V.chains(spark, base)).join(f, "chain_id")
    d = written(spark, d, "feedback")
    n = d.count()
    status = "skipped" if n < 5 else "retrained"
    cv = G.cross_validated(d, "chain_id", D.FIFTEEN) if n >= 60 else None
    if status == "retrained":
        G.fit_linear(d, D.FIFTEEN, balanced=n >= 10)
    return spark.createDataFrame([(status, n, cv)], "status string, n_feedback long, cv_auroc double")


@query("g13_density")
def g13(spark, base):
    bank, q = bank_and_queries(spark, base)
    return G.density_risk(bank, q).withColumn("surprise", F.round("surprise", 4))


@query("g13_rank_ensemble")
def g13_ranks(spark, base):
    """Mixtures of two and of four parts; the mean of the two ranks."""
    bank, q = bank_and_queries(spark, base)
    return G.density_ranks(bank, q).withColumn("risk", F.round("risk", 6))


@query("g14_decay_sample", with_views("""
, a AS (SELECT domain, chain_id, row_number() OVER (PARTITION BY domain ORDER BY ts DESC, chain_id DESC) - 1 AS age FROM scored_v),
d AS (SELECT *, ln(-ln((CAST('0x' || sha256(CAST(chain_id AS VARCHAR))[1:8] AS BIGINT) + 0.5) / 4294967296.0::DOUBLE)) - age / 100.0::DOUBLE * ln(0.2::DOUBLE) AS draw FROM a)
SELECT domain, chain_id FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY draw, chain_id) AS rn FROM d) WHERE rn <= 200""", "scored_v"))
def g14(spark, base):
    s = V.scored(spark, base).select("domain", "chain_id", "ts")
    d = numbered(s, ["domain"], "ts", "chain_id")
    n = s.groupBy("domain").agg(F.count(F.lit(1)).alias("_n"))
    pool = d.join(n, "domain").withColumn("age", F.col("_n") - F.col("seen"))
    return G.decay_sample(pool, ["domain"], "chain_id", "age", 200).select("domain", "chain_id")


@query("g15_federated_average", with_views("""
, p AS (SELECT domain, k % 4 AS component, n_steps AS position, avg(risk_score) AS value FROM scored_v GROUP BY ALL), n AS (SELECT domain, count(*) AS n_chains FROM scored_v GROUP BY domain)
SELECT component, position, round(sum(value * n_chains) / sum(n_chains), 6) AS value FROM p JOIN n USING (domain) GROUP BY component, position""", "scored_v"))
def g15(spark, base):
    """Sites are domains; their parameters are component means."""
    s = V.scored(spark, base)
    p = s.groupBy("domain", (F.col("k") % 4).alias("component"), F.col("n_steps").alias("position")).agg(F.avg("risk_score").alias("value"))
    n = s.groupBy("domain").agg(F.count(F.lit(1)).alias("n_chains"))
    return G.average_parameters(p.join(n, "domain")).withColumn("value", F.round("value", 6))


@query("g16_failure_clusters")
def g16(spark, base):
    """Vectors of the chains that went wrong."""
    failed = V.scored(spark, base).filter("wrong = 1").select(F.col("chain_id").alias("vec_id"))
    return G.failure_clusters(V.vectors(spark, base).join(failed, "vec_id", "left_semi")).withColumn("distance", F.round("distance", 6))


@query("g17_fingerprints")
def g17(spark, base):
    d = D.eleven_features(V.steps(spark, base), V.chains(spark, base))
    return G.fingerprints(d, "user_id", D.ELEVEN)


@query("g18_pool_growth", with_views("""
, l AS (SELECT domain, s.chain_id, fts AS ts, k, label = 'correct' AS ok FROM feedback_v f JOIN scored_v s USING (chain_id)),
x AS (SELECT *, ok AND row_number() OVER (PARTITION BY domain, k, ok ORDER BY ts, chain_id) = 1 AS grows, row_number() OVER w AS n, count(CASE WHEN ok THEN 1 END) OVER w AS r, count(CASE WHEN NOT ok THEN 1 END) OVER w AS e FROM l WINDOW w AS (PARTITION BY domain ORDER BY ts, chain_id)),
t AS (SELECT domain, min(n) AS st FROM x WHERE n >= 50 AND r >= 10 AND e >= 10 GROUP BY domain)
SELECT domain, chain_id, grows AS pool_grows, n AS n_labels, CAST(sum(CASE WHEN grows THEN 1 ELSE 0 END) OVER (PARTITION BY domain ORDER BY ts, chain_id) AS BIGINT) AS pool_size, NOT ok AND e % 5 = 0 AS heals, coalesce(n >= st AND (n - st) % 50 = 0, false) AS refits FROM x LEFT JOIN t USING (domain)""", "feedback_v"))
def g18(spark, base):
    s = V.scored(spark, base).select("chain_id", "domain", "k")
    lab = V.feedback(spark, base).select("chain_id", F.col("fts").alias("ts"), (F.col("label") == "correct").alias("is_correct")).join(s, "chain_id")
    d = G.pool_triggers(lab, ["domain"], "k")
    return d.select("domain", "chain_id", "pool_grows", "n_labels", "pool_size", "heals", "refits")


FIVE = ["risk_score", "beh_score", "ptrue_score", "n_steps_norm", "tier_num"]


_FIVE_SQL = "risk_score, risk_score * 0.8 AS beh_score, k / 100.0::DOUBLE AS ptrue_score, n_steps / 10.0::DOUBLE AS n_steps_norm, CASE tier WHEN 'HIGH' THEN 0.0 WHEN 'MEDIUM' THEN 1.0 ELSE 2.0 END::DOUBLE AS tier_num"
V.cte("five_v", f"SELECT chain_id, CASE WHEN label = 'incorrect' THEN 1 ELSE 0 END AS wrong, {_FIVE_SQL} FROM feedback_v JOIN scored_v USING (chain_id)", "feedback_v", "scored_v")


@query("g19_label_model", with_views(logistic_sql("five_v", FIVE) + f"SELECT chain_id, round({risk_sql(FIVE)}, 6) AS risk FROM five_v, lr", "five_v"))
def g19(spark, base):
    """Needs 30 labels with 5 of each class."""
    s = V.scored(spark, base)
    f = V.feedback(spark, base).select("chain_id", (F.col("label") == "incorrect").cast("int").alias("wrong"))
    d = s.drop("wrong").join(f, "chain_id").select(
        "chain_id", "wrong", "risk_score", (F.col("risk_score") * 0.8).alias("beh_score"), (F.col("k") / 100.0).alias("ptrue_score"),
        (F.col("n_steps") / 10.0).alias("n_steps_norm"), R.lookup(F.col("tier"), {"HIGH": 0.0, "MEDIUM": 1.0, "LOW": 2.0}).alias("tier_num"))
    d = written(spark, d, "labels")
    wrong, right = G.class_counts(d, "wrong")
    if wrong + right < 30 or min(wrong, right) < 5:
        return d.select("chain_id", F.lit(None).cast("double").alias("risk")).limit(0)
    return d.select("chain_id", F.round(G.fit_linear(d, FIVE).risk(), 6).alias("risk"))


@query("g20_consistent_questions", """WITH c AS (SELECT conv_id AS chain_id, role, count(*) AS n FROM conversations GROUP BY 1, 2)
SELECT chain_id, round(max(n)::DOUBLE / sum(n), 6) AS majority_fraction FROM c GROUP BY chain_id HAVING max(n)::DOUBLE / sum(n) >= 0.5""")
def g20(spark, base):
    d = C.majority(V.messages(spark, base).select("chain_id", F.col("role").alias("answer")))
    return d.filter("majority_fraction >= 0.5").select("chain_id", *r6("majority_fraction"))
