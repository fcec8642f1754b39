"""Queries: calibration and evaluation statistics."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from plumbline import fixed
from plumbline.operators import calibration as C, features as D
from plumbline.operators.ordered import running_sums
from plumbline.plans import views as V
from plumbline.plans.registry import ORACLE, query
from plumbline.plans.scores import attempts, bank_and_queries, knn_sql
from plumbline.plans.traces import prefix_sql, r6
from plumbline.plans.views import sql_f1, sql_tokens, with_views

AUC_SQL = """sum(CASE WHEN wrong=1 THEN rk END) AS rs, count(CASE WHEN wrong=1 THEN 1 END) AS p, count(CASE WHEN wrong=0 THEN 1 END) AS q"""


def ranked(part: str = "", src: str = "scored_v", score: str = "risk_score") -> str:
    """Mid-ranks of a score."""
    p = f"PARTITION BY {part}" if part else ""
    extra = f", {part}" if part else ""
    return (f"(SELECT wrong{extra}, rank() OVER ({p} ORDER BY {score}) + (count(*) OVER (PARTITION BY {part + ', ' if part else ''}{score}) - 1) / 2.0::DOUBLE AS rk FROM {src})")


@query("h1_conformal_threshold", with_views("""
, w AS (SELECT domain, risk_score, row_number() OVER (PARTITION BY domain ORDER BY risk_score) AS rn, count(*) OVER (PARTITION BY domain) AS n FROM scored_v WHERE wrong = 1)
SELECT domain, round(max(CASE WHEN rn = least(n, ceil((n+1)*0.85::DOUBLE)) THEN risk_score END), 6) AS threshold, round(max(CASE WHEN rn = greatest(1, least(n, ceil((n+1)*0.15::DOUBLE))) THEN risk_score END), 6) AS coverage_threshold, max(n) AS n_wrong FROM w GROUP BY domain""", "scored_v"))
def h1(spark, base):
    s = V.scored(spark, base)
    a = C.conformal_threshold(s, "risk_score", "wrong", ["domain"])
    b = C.conformal_threshold(s, "risk_score", "wrong", ["domain"], mode="coverage").select("domain", F.col("threshold").alias("coverage_threshold"))
    return a.join(b, "domain").select("domain", "n_wrong", *r6("threshold", "coverage_threshold"))


@query("h2_auroc", with_views(f"""SELECT domain, round((rs - p*(p+1)/2.0) / (p*q)::DOUBLE, 6) AS auroc, CAST(p AS DOUBLE) AS n_wrong, CAST(q AS DOUBLE) AS n_right FROM (SELECT domain, {AUC_SQL} FROM {ranked('domain')} GROUP BY domain)
UNION ALL SELECT 'ALL', round((rs - p*(p+1)/2.0) / (p*q)::DOUBLE, 6), CAST(p AS DOUBLE), CAST(q AS DOUBLE) FROM (SELECT {AUC_SQL} FROM {ranked()})""", "scored_v"))
def h2(spark, base):
    s = V.scored(spark, base)
    per = C.auroc(s, "risk_score", "wrong", ["domain"])
    return per.unionByName(C.auroc(s, "risk_score", "wrong").withColumn("domain", F.lit("ALL"))).select("domain", "n_wrong", "n_right", *r6("auroc"))


@query("h3_bootstrap_interval", None)
def h3(spark, base):
    """Behavioural score of the labelled chains."""
    d = D.nano_signals(V.steps(spark, base), V.labelled_chains(spark, base), ("action", "answer_hit"))
    return C.bootstrap_auroc(d, "chain_id", "behaviour", "wrong")


@query("h4_safe_auroc", with_views(f"SELECT domain, round(greatest(a, 1 - a), 6) AS safe_auroc FROM (SELECT domain, (rs - p*(p+1)/2.0) / (p*q)::DOUBLE AS a FROM (SELECT domain, {AUC_SQL} FROM {ranked('domain', score='n_steps')} GROUP BY domain))", "scored_v"))
def h4(spark, base):
    s = V.scored(spark, base).withColumn("n_steps", F.col("n_steps").cast("double"))
    return C.auroc(s, "n_steps", "wrong", ["domain"]).select("domain", F.round(C.safe_auroc(F.col("auroc")), 6).alias("safe_auroc"))


@query("h5_precision_at_k", with_views("""
, o AS (SELECT wrong, row_number() OVER (ORDER BY value DESC, chain_id) AS rn FROM scored_v)
SELECT CAST(k AS INTEGER) AS k, round(avg(wrong), 6) AS precision FROM o, (VALUES (10),(50),(100)) t(k) WHERE rn <= k GROUP BY k""", "scored_v"))
def h5(spark, base):
    d = C.precision_at(V.scored(spark, base), [F.desc("value"), F.asc("chain_id")], "wrong")
    return d.select("k", *r6("precision"))


@query("h6_precision_at_fpr", with_views("""
, h AS (SELECT domain, risk_score AS s, sum(wrong) AS p, count(*) - sum(wrong) AS n FROM scored_v GROUP BY domain, risk_score),
c AS (SELECT *, sum(p) OVER (PARTITION BY domain ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY domain ORDER BY s DESC) AS fp, sum(p) OVER (PARTITION BY domain) AS pa, sum(n) OVER (PARTITION BY domain) AS na FROM h),
ok AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY s) AS rn FROM c WHERE fp::DOUBLE / na <= 0.5)
SELECT domain, round(s, 6) AS threshold, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / pa, 6) AS recall, round(fp::DOUBLE / na, 6) AS fpr, round((tp+fp)::DOUBLE / (pa+na), 6) AS coverage FROM ok WHERE rn = 1""", "scored_v"))
def h6(spark, base):
    d = C.at_false_positive_rate(V.scored(spark, base), "risk_score", "wrong", ["domain"], alpha=0.5)
    return d.select("domain", *r6("threshold", "precision", "recall", "fpr", "coverage"))


@query("h7_mondrian", with_views("""
, w AS (SELECT domain, risk_score, row_number() OVER (PARTITION BY domain ORDER BY risk_score) AS rd, count(*) OVER (PARTITION BY domain) AS nd,
 row_number() OVER (ORDER BY risk_score) AS ra, count(*) OVER () AS na FROM scored_v WHERE wrong = 1),
td AS (SELECT domain, risk_score AS t FROM w WHERE rd = greatest(1, least(nd, ceil((nd+1)*0.15::DOUBLE)))), ta AS (SELECT risk_score AS t FROM w WHERE ra = greatest(1, least(na, ceil((na+1)*0.15::DOUBLE))))
SELECT domain, 'own' AS cut, count(*) AS alerts, round(avg(wrong), 6) AS precision FROM scored_v JOIN td USING (domain) WHERE risk_score >= t GROUP BY domain
UNION ALL SELECT domain, 'pooled', count(*), round(avg(wrong), 6) FROM scored_v, ta WHERE risk_score >= t GROUP BY domain""", "scored_v"))
def h7(spark, base):
    s = V.scored(spark, base)
    own = C.conformal_threshold(s, "risk_score", "wrong", ["domain"], mode="coverage")
    pool = C.conformal_threshold(s, "risk_score", "wrong", mode="coverage").select(F.col("threshold"))
    every = own.select("domain").join(F.broadcast(pool))
    q = lambda t, name: C.alert_quality(s, t, "risk_score", "wrong", "domain").select("domain", F.lit(name).alias("cut"), "alerts", *r6("precision"))
    return q(own, "own").unionByName(q(every, "pooled"))


@query("h8_agreement_threshold", with_views(f"""
, a AS (SELECT conv_id AS chain_id, max_by(text, turn) FILTER (WHERE role='assistant') AS x, min_by(text, turn) FILTER (WHERE role='assistant') AS y, min_by(text, turn) FILTER (WHERE role='user') AS z FROM conversations GROUP BY conv_id),
g AS (SELECT a.chain_id, ({sql_f1(sql_tokens('x',[]), sql_tokens('y',[]))} + {sql_f1(sql_tokens('x',[]), sql_tokens('z',[]))} + {sql_f1(sql_tokens('y',[]), sql_tokens('z',[]))}) / 3 AS agree FROM a WHERE x IS NOT NULL AND z IS NOT NULL),
p AS (SELECT behaviour AS b FROM g JOIN nano_v USING (chain_id) WHERE agree >= 0.5),
s AS (SELECT b, row_number() OVER (ORDER BY b) - 1 AS i, count(*) OVER () AS n FROM p), r AS (SELECT max(n) AS n, least(1.0::DOUBLE, (1 + 1.0::DOUBLE/max(n)) * 0.9) * (max(n)-1) AS k FROM s)
SELECT CASE WHEN r.n >= 10 THEN round((SELECT b FROM s WHERE i = floor(k)) + (k - floor(k)) * ((SELECT b FROM s WHERE i = ceil(k)) - (SELECT b FROM s WHERE i = floor(k))), 6) END AS threshold, r.n AS n FROM r""", "nano_v"))
def h8(spark, base):
    """Competing answers of a conversation: last and first assistant text, first user text."""
    m = V.messages(spark, base)
    pick = lambda fn, role: fn("content", F.when(F.col("role") == role, F.col("pos")))
    a = m.groupBy("chain_id").agg(pick(F.max_by, "assistant").alias("x"), pick(F.min_by, "assistant").alias("y"), pick(F.min_by, "user").alias("z"))
    a = a.filter("x IS NOT NULL AND z IS NOT NULL").select("chain_id", C.agreement(F.col("x"), F.col("y"), F.col("z")).alias("agree"))
    d = D.nano_signals(V.steps(spark, base), V.chains(spark, base), ("action", "answer_hit")).select("chain_id", "behaviour").join(a, "chain_id")
    return C.agreement_threshold(d, "behaviour", "agree").select("n", *r6("threshold"))


@query("h9_kalman", "WITH RECURSIVE " + with_views("""
, z AS (SELECT user_id, risk_score AS z, row_number() OVER (PARTITION BY user_id ORDER BY ts, chain_id) AS t FROM scored_v),
k AS (SELECT user_id, t, z::DOUBLE AS x, 1.0::DOUBLE AS p FROM z WHERE t = 1
 UNION ALL SELECT z.user_id, z.t, k.x + (k.p + 0.2) / (k.p + 0.25) * (z.z - k.x), (1 - (k.p + 0.2) / (k.p + 0.25)) * (k.p + 0.2) FROM k JOIN z ON z.user_id = k.user_id AND z.t = k.t + 1)
SELECT user_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, arg_max(x, t))), 6) AS risk FROM k GROUP BY user_id""", "scored_v").strip().removeprefix("WITH"))
def h9(spark, base):
    s = V.scored(spark, base).select("user_id", "ts", "chain_id", "risk_score")
    return C.kalman_by_key(s, ["user_id"], ["ts", "chain_id"], "risk_score").select("user_id", F.round("risk_score", 6).alias("risk"))


F1M = sql_f1("a.tok", "b.tok")


@query("h10_mesh", with_views(f"""
, t AS (SELECT chain_id, agent, answer, {sql_tokens('answer', fixed.MESH_STOP)} AS tok FROM agents_v),
pr AS (SELECT a.chain_id, a.agent, avg({F1M}) AS m FROM t a JOIN t b ON a.chain_id = b.chain_id AND a.agent <> b.agent GROUP BY a.chain_id, a.agent),
g AS (SELECT t.chain_id, count(*) AS n_agents, avg(coalesce(m, 0)) AS agreement, max_by(answer, (round(coalesce(m,0), 9), -agent)) AS best FROM t LEFT JOIN pr USING (chain_id, agent) GROUP BY t.chain_id),
z AS (SELECT g.*, {V.sql_tier('n.behaviour * 1.4')} AS tier FROM g JOIN nano_v n USING (chain_id))
SELECT chain_id, n_agents, tier, round(agreement + 1e-9, 6) AS agreement, CASE WHEN agreement >= 0.6 AND tier = 'LOW' THEN 'MEDIUM' ELSE tier END AS upgraded_tier, agreement < 0.3 AS escalate,
 CASE WHEN agreement >= 0.3 OR n_agents = 1 THEN best END AS consensus FROM z""", "agents_v", "nano_v"))
def h10(spark, base):
    from plumbline.functions.risk import tier
    t = D.nano_signals(V.steps(spark, base), V.chains(spark, base), ("action", "answer_hit")).select("chain_id", tier(F.col("behaviour") * 1.4).alias("tier"))
    return C.mesh(V.agents(spark, base), t).withColumn("agreement", F.round(F.col("agreement") + 1e-9, 6))


ARMS_SQL = "(VALUES " + ",".join(f"({i},{a}::DOUBLE)" for i, a in enumerate(fixed.BANDIT_ARMS)) + ") AS arms(pos, arm)"


@query("h11_blend_bandit", with_views(f"""
, l AS (SELECT CASE WHEN (tier <> 'LOW') = (label = 'correct') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward, k / 100.0::DOUBLE AS w FROM feedback_v JOIN scored_v USING (chain_id)),
b AS (SELECT reward, (SELECT arm FROM {ARMS_SQL} ORDER BY abs(w - arm), pos LIMIT 1) AS arm FROM l),
s AS (SELECT pos, arms.arm, count(reward) AS pulls, coalesce(avg(reward), 0) AS mean_reward FROM {ARMS_SQL} LEFT JOIN b ON b.arm = arms.arm GROUP BY pos, arms.arm),
u AS (SELECT *, mean_reward + sqrt(2 * ln(sum(pulls) OVER ()) / nullif(pulls,0)) AS bound FROM s)
SELECT arm, CAST(pos AS INTEGER) AS pos, pulls, round(mean_reward, 6) AS mean_reward, round(bound, 6) AS bound, pos = (SELECT pos FROM u ORDER BY coalesce(bound, 1e300) DESC, pos LIMIT 1) AS next FROM u""", "feedback_v"))
def h11(spark, base):
    s = V.scored(spark, base).select("chain_id", "tier", "k")
    log = V.feedback(spark, base).join(s, "chain_id").select(
        C.nearest_arm(F.col("k") / 100.0).alias("arm"),
        F.when((F.col("tier") != "LOW") == (F.col("label") == "correct"), 1.0).otherwise(0.0).alias("reward"))
    arms = spark.createDataFrame(list(enumerate(fixed.BANDIT_ARMS)), "pos int, arm double")
    return C.bandit_arms(log, arms, ["arm"], "reward", 2.0).select("arm", "pos", "pulls", "next", *r6("mean_reward", "bound"))


MODES_SQL = "(VALUES " + ",".join(f"({i},'{m}')" for i, m in enumerate(fixed.FAILURE_MODES)) + ") AS m(mp, failure_mode)"


@query("h12_hunt_bandit", with_views(f"""
, v AS (SELECT user_id, failure_mode, domain, avg(wrong) AS share FROM scored_v WHERE failure_mode IS NOT NULL GROUP BY ALL),
l AS (SELECT failure_mode, domain, CASE WHEN share >= 0.67 THEN 1.0::DOUBLE WHEN share >= 0.33 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM v),
d AS (SELECT domain, row_number() OVER (ORDER BY domain) - 1 AS dp FROM (SELECT DISTINCT domain FROM scored_v)),
s AS (SELECT mp * (SELECT count(*) FROM d) + dp AS pos, m.failure_mode, d.domain, count(reward) AS pulls, coalesce(avg(reward), 0) AS mean_reward FROM {MODES_SQL} CROSS JOIN d LEFT JOIN l ON l.failure_mode = m.failure_mode AND l.domain = d.domain GROUP BY ALL),
u AS (SELECT *, mean_reward + sqrt(ln(sum(pulls) OVER ()) / nullif(pulls,0)) AS bound FROM s)
SELECT failure_mode, domain, CAST(pos AS INTEGER) AS pos, pulls, round(mean_reward, 6) AS mean_reward, round(bound, 6) AS bound, pos = (SELECT pos FROM u ORDER BY coalesce(bound, 1e300) DESC, pos LIMIT 1) AS next FROM u""", "scored_v"))
def h12(spark, base):
    return hunt_arms(spark, base).select("failure_mode", "domain", "pos", "pulls", "next", *r6("mean_reward", "bound"))


def hunt_arms(spark, base):
    s = V.scored(spark, base).filter(F.col("failure_mode").isNotNull())
    share = s.groupBy("user_id", "failure_mode", "domain").agg(F.avg("wrong").alias("share"))
    log = share.withColumn("reward", C.diversity_reward(F.col("share")))
    # the arms: every mode for every domain that occurs (a dimension of the chain table)
    dom = s.select("domain").distinct().withColumn("dp", F.row_number().over(W.orderBy("domain")) - 1)
    n_dom = F.lit(s.agg(F.countDistinct("domain")).first()[0])
    modes = F.array(*[F.struct(F.lit(i).alias("mp"), F.lit(m).alias("failure_mode")) for i, m in enumerate(fixed.FAILURE_MODES)])
    arms = dom.select("domain", "dp", F.explode(modes).alias("m")).select("domain", "m.failure_mode", (F.col("m.mp") * n_dom + F.col("dp")).cast("int").alias("pos"))
    return C.bandit_arms(log, arms, ["failure_mode", "domain"], "reward", 1.0)


@query("h12_top_arms", ORACLE["h12_hunt_bandit"].rsplit("SELECT failure_mode, domain, CAST", 1)[0] + """
SELECT failure_mode || '/' || domain AS arm, round(mean_reward, 3) AS mean_reward FROM u WHERE pulls > 0 ORDER BY u.mean_reward DESC, pos LIMIT 5""")
def h12_top(spark, base):
    d = C.top_arms(hunt_arms(spark, base))
    return d.select(F.concat("failure_mode", F.lit("/"), "domain").alias("arm"), F.round("mean_reward", 3).alias("mean_reward"))


@query("h13_diversity", with_views("SELECT user_id, round(avg(wrong), 6) AS diversity FROM scored_v GROUP BY user_id", "scored_v"))
def h13(spark, base):
    return V.scored(spark, base).groupBy("user_id").agg(F.round(F.avg("wrong"), 6).alias("diversity"))


@query("h14_novelty", knn_sql("").rstrip() + """
, nn AS (SELECT q.vec_id, min(list_distance(q.v, b.v)) AS d FROM vec_v q, vec_v b WHERE q.label >= 5 AND b.label < 5 GROUP BY q.vec_id),
sg AS (SELECT greatest(median(list_distance(a.v, b.v)), 0.01) AS s FROM vec_v a, vec_v b WHERE a.label < 5 AND b.label < 5 AND a.vec_id < b.vec_id)
SELECT vec_id, round(least(1.0::DOUBLE, d / s), 6) AS novelty FROM nn, sg""")
def h14(spark, base):
    from plumbline.operators.novelty import novelty
    known, new = bank_and_queries(spark, base)
    return novelty(new, known).select("vec_id", *r6("novelty"))


@query("h15_failure_filter", with_views("""SELECT chain_id, needs_alert OR risk_score > 0.6 OR (k % 2 = 0 AND n_steps >= 5) OR (coalesce(failure_mode,'') = 'retrieval_fail' AND k % 2 = 1 AND n_steps <= 3) AS is_failure FROM scored_v""", "scored_v"))
def h15(spark, base):
    from plumbline.operators.novelty import is_failure
    s = V.scored(spark, base).withColumns({"finished": F.col("k") % 2 == 1,
                                           "mode": F.when(F.col("failure_mode") == "retrieval_fail", "confident_wrong").otherwise(F.col("failure_mode"))})
    return s.select("chain_id", is_failure(0.6, "mode").alias("is_failure"))


@query("h16_confidence_accuracy", with_views("SELECT tier AS confidence, count(*) AS total, CAST(sum(1 - wrong) AS BIGINT) AS correct, round(avg(1 - wrong), 6) AS accuracy FROM scored_v GROUP BY tier", "scored_v"))
def h16(spark, base):
    return V.scored(spark, base).groupBy(F.col("tier").alias("confidence")).agg(
        F.count(F.lit(1)).alias("total"), F.sum(1 - F.col("wrong")).alias("correct"), F.round(F.avg(1 - F.col("wrong")), 6).alias("accuracy"))


@query("h17_rolling_auroc", with_views(f"""
, d AS (SELECT wrong, n_steps, ts // 86400 AS day FROM scored_v), r AS {ranked('day', 'd', 'n_steps')},
a AS (SELECT day, CASE WHEN p + q >= 10 THEN (rs - p*(p+1)/2.0) / nullif(p*q,0)::DOUBLE END AS auroc, p + q AS n FROM (SELECT day, {AUC_SQL} FROM r GROUP BY day))
SELECT day, n, round(auroc, 6) AS auroc, round(max(auroc) OVER (ORDER BY day), 6) AS peak, coalesce(max(auroc) OVER (ORDER BY day) - auroc >= 0.05, false) AS drift FROM a""", "scored_v"))
def h17(spark, base):
    s = V.scored(spark, base).select("wrong", F.col("n_steps").cast("double").alias("n_steps"), F.floor(F.col("ts") / 86400).alias("day"))
    a = C.auroc(s, "n_steps", "wrong", ["day"])
    a = a.select("day", (F.col("n_wrong") + F.col("n_right")).cast("long").alias("n"), "auroc").withColumn("auroc", F.when(F.col("n") >= 10, F.col("auroc")))
    peak = F.max("auroc").over(W.orderBy("day"))  # one row per day
    return a.select("day", "n", F.round("auroc", 6).alias("auroc"), F.round(peak, 6).alias("peak"), F.coalesce(peak - F.col("auroc") >= 0.05, F.lit(False)).alias("drift"))


@query("h18_error_cooccurrence", with_views("""
, x AS (SELECT wrong AS b, CASE WHEN needs_alert THEN 1 ELSE 0 END AS a, domain FROM scored_v)
SELECT domain, round(corr(a, b), 6) AS correlation, round(avg(CASE WHEN a=1 THEN b END), 6) AS p_given_fail, round(avg(CASE WHEN a=0 THEN b END), 6) AS p_given_ok,
 round(avg(CASE WHEN a=1 THEN b END) / nullif(avg(CASE WHEN a=0 THEN b END), 0), 6) AS lift FROM x GROUP BY domain""", "scored_v"))
def h18(spark, base):
    x = V.scored(spark, base).select("domain", F.col("needs_alert").cast("double").alias("a"), F.col("wrong").cast("double").alias("b"))
    g = x.groupBy("domain").agg(F.corr("a", "b").alias("correlation"), F.avg(F.when(F.col("a") == 1, F.col("b"))).alias("p_given_fail"),
                                F.avg(F.when(F.col("a") == 0, F.col("b"))).alias("p_given_ok"))
    return g.withColumn("lift", F.try_divide("p_given_fail", "p_given_ok")).select("domain", *r6("correlation", "p_given_fail", "p_given_ok", "lift"))


@query("h19_lifecycle", with_views("""
, s AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts, chain_id) AS seen FROM scored_v), z AS (SELECT *, CASE WHEN seen < 10 THEN 'COLD' WHEN seen < 50 THEN 'WARMING' ELSE 'DEPLOYED' END AS stage FROM s)
SELECT chain_id, domain, seen, stage, risk_score > CASE stage WHEN 'COLD' THEN 0.70 WHEN 'WARMING' THEN 0.60 ELSE 0.55 END AS alert FROM z""", "scored_v"))
def h19(spark, base):
    s = V.scored(spark, base).select("chain_id", "domain", "ts", "risk_score", F.floor(F.col("ts") / 60).alias("minute"))
    d = running_sums(s, ["domain"], "minute", ["ts", "chain_id"], {"seen": F.lit(1)})
    stage, cut = C.lifecycle(F.col("seen"))
    return d.select("chain_id", "domain", "seen", stage.alias("stage"), (F.col("risk_score") > cut).alias("alert"))


@query("h20_group_profile", with_views("""SELECT round(avg(CASE WHEN wrong=0 THEN n_steps END), 6) AS steps_right, round(avg(CASE WHEN wrong=1 THEN n_steps END), 6) AS steps_wrong,
 round(avg(CASE WHEN wrong=1 THEN n_steps END) - avg(CASE WHEN wrong=0 THEN n_steps END), 6) AS steps_delta, round(avg(CASE WHEN wrong=0 THEN risk_score END), 6) AS risk_right,
 round(avg(CASE WHEN wrong=1 THEN risk_score END), 6) AS risk_wrong, round(avg(CASE WHEN wrong=1 THEN risk_score END) - avg(CASE WHEN wrong=0 THEN risk_score END), 6) AS risk_delta FROM scored_v""", "scored_v"))
def h20(spark, base):
    m = lambda c, w: F.avg(F.when(F.col("wrong") == w, F.col(c)))
    cols = {}
    for name, c in (("steps", "n_steps"), ("risk", "risk_score")):
        cols |= {f"{name}_right": m(c, 0), f"{name}_wrong": m(c, 1), f"{name}_delta": m(c, 1) - m(c, 0)}
    return V.scored(spark, base).agg(*[F.round(v, 6).alias(k) for k, v in cols.items()])


@query("h21_early_stop", prefix_sql("""
, e AS (SELECT pv.chain_id, t, behaviour, wrong, n FROM pv JOIN labelled_v USING (chain_id) JOIN so_m USING (chain_id)), f AS (SELECT *, behaviour >= 0.55 AS stop FROM e)
SELECT t, count(*) AS chains, round(avg(CASE WHEN stop THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS stop_rate, round(avg(CASE WHEN stop AND wrong = 0 THEN 1.0::DOUBLE WHEN wrong = 0 THEN 0.0::DOUBLE END), 6) AS false_stop_rate,
 round(sum(CASE WHEN stop THEN n - t ELSE 0 END)::DOUBLE / sum(n), 6) AS steps_saved FROM f GROUP BY t"""))
def h21(spark, base):
    s, lab = V.steps(spark, base), V.labelled_chains(spark, base)
    p = D.prefix_signals(s, lab).select("chain_id", "t", "behaviour").join(lab.select("chain_id", "wrong"), "chain_id")
    n = s.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n"))
    d = p.join(n, "chain_id").withColumn("stop", F.col("behaviour") >= 0.55)
    g = d.groupBy("t").agg(F.count(F.lit(1)).alias("chains"), F.avg(F.col("stop").cast("double")).alias("stop_rate"),
                           F.avg(F.when(F.col("wrong") == 0, F.col("stop").cast("double"))).alias("false_stop_rate"),
                           (F.sum(F.when(F.col("stop"), F.col("n") - F.col("t")).otherwise(0)) / F.sum("n")).alias("steps_saved"))
    return g.select("t", "chains", *r6("stop_rate", "false_stop_rate", "steps_saved"))
