"""Queries: failure modes, repair, routing, scores, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions import risk as R, text as T
from plumbline.operators import failure as X, features as D, knn as K, scoring as Z
from plumbline.operators.ordered import order_statistics, top_per_key
from plumbline.plans import views as V
from plumbline.plans.registry import ORACLE, query
from plumbline.plans.traces import prefix_sql, r6
from plumbline.plans.views import sql_shared, sql_tier, sql_tokens, sql_words, with_views


def sql_case(key: str, pairs: dict, default: str | None = None) -> str:
    q = lambda s: "'" + str(s).replace("'", "''") + "'"
    end = f" ELSE {q(default)}" if default is not None else ""
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in pairs.items()) + end + " END"


@query("e1_failure_modes", with_views("SELECT chain_id, nano_mode AS failure_mode FROM nano_v", "nano_v"))
def e1(spark, base):
    return D.nano_signals(V.steps(spark, base), V.chains(spark, base)).select("chain_id", X.nano_mode().alias("failure_mode"))


@query("e2_confident_wrong", with_views(
    f"SELECT chain_id, {V.CONFIDENT_SQL} AS confident_wrong, guard_mode AS failure_mode FROM nano_v", "nano_v"))
def e2(spark, base):
    d = D.nano_signals(V.steps(spark, base), V.chains(spark, base), X.GUARD_KINDS)
    return d.select("chain_id", X.confident_wrong().alias("confident_wrong"), X.guard_mode().alias("failure_mode"))


PROCESS_SQL = r"""CASE WHEN trim(final_answer, ' ' || chr(10)) = '' THEN 'empty_output'
 WHEN sc2_step_count <= 0.2 AND sc4_uncertainty_density < 0.05 AND sc5_backtrack_rate < 0.05 THEN 'confident_wrong'
 WHEN retrieval_conf < 0.05 AND empty_obs > 0.5 THEN 'retrieval_fail' WHEN sc5_backtrack_rate > 0.5 THEN 'repeated_query'
 WHEN sc2_step_count > 0.4 THEN 'long_chain' END"""


@query("e3_process_modes", with_views(f"SELECT chain_id, {PROCESS_SQL} AS failure_mode FROM d4_full", "d4_full"))
def e3(spark, base):
    d = D.nine_features(V.steps(spark, base), V.chains(spark, base))
    return d.select("chain_id", X.process_mode(F.col("final_answer")).alias("failure_mode"))


@query("e4_documented_rules", with_views(r"""
SELECT chain_id, CASE WHEN length(trim(final_answer, ' ' || chr(10))) < 5 THEN 'empty_answer' WHEN d < c THEN 'repeated_query' WHEN bad THEN 'retrieval_fail' WHEN n >= 4 THEN 'long_chain' END AS failure_mode
FROM chains_v JOIN (SELECT chain_id, count(*) AS n, count(DISTINCT CASE WHEN action_type='Search' THEN action_arg END) AS d, count(CASE WHEN action_type='Search' THEN 1 END) AS c,
 bool_or(regexp_matches(lower(observation), 'no results|not found')) AS bad FROM steps_v GROUP BY chain_id) USING (chain_id)""", "chains_v", "steps_v"))
def e4(spark, base):
    return documented_measures(spark, base).select("chain_id", X.documented_mode().alias("failure_mode"))


def documented_measures(spark, base):
    s, c = V.steps(spark, base), V.chains(spark, base)
    bad = F.regexp_like(F.lower("observation"), F.lit("|".join(fixed.NO_RESULT_PHRASES)))
    m = s.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(bad).alias("any_no_result"))
    d = c.join(m, "chain_id").join(D.distinct_measures(s, c, ("open_query",)), "chain_id", "left")
    return d.withColumns({"answer_len": F.length(T.strip(F.col("final_answer"))), "c_open_query": F.coalesce("c_open_query", F.lit(0)),
                          "d_open_query": F.coalesce("d_open_query", F.lit(0))})


@query("e5_taxonomy", with_views(f"""
, m AS (SELECT *, CASE WHEN n_search <= 1 AND NOT finished THEN 'PREMATURE_STOP' WHEN n_search > 4 THEN 'EXCESSIVE_SEARCH' WHEN retrieval_conf < 0.05 AND empty_obs > 0.5 THEN 'RETRIEVAL_FAILURE'
 WHEN semantic_gap > 0.95 AND sc5_backtrack_rate < 0.5 AND n_search >= 2 THEN 'CONFLICTING_EVIDENCE' WHEN retrieval_conf < 0.05 AND n_search >= 2 THEN 'INSUFFICIENT_EVIDENCE'
 WHEN {sql_shared(sql_tokens('final_answer'), sql_tokens('obs_all'))} = 0 THEN 'ANSWER_UNSUPPORTED' ELSE 'LOW_RISK' END AS mode FROM d4_full JOIN (SELECT chain_id, count(CASE WHEN action_type='Search' THEN 1 END) AS n_search,
 bool_or(action_type='Finish') AS finished FROM steps_v GROUP BY chain_id) USING (chain_id))
SELECT chain_id, mode, {sql_case('mode', dict(X.TAXONOMY_REPAIR))} AS repair FROM m""", "d4_full"))
def e5(spark, base):
    s, c = V.steps(spark, base), V.chains(spark, base)
    d = D.nine_features(s, c)
    m = s.groupBy("chain_id").agg(F.count_if(F.col("action_type") == "Search").alias("n_search"),
                                  F.bool_or(F.col("action_type") == "Finish").alias("finished"))
    h = D.distinct_measures(s, c, ("answer_hit",)).select("chain_id", F.col("d_answer_hit").alias("answer_hits"))
    d = d.join(m, "chain_id").join(h, "chain_id", "left").withColumn("answer_hits", F.coalesce("answer_hits", F.lit(0)))
    d = d.select("chain_id", X.taxonomy().alias("mode"))
    return d.withColumn("repair", R.lookup(F.col("mode"), dict(X.TAXONOMY_REPAIR)))


@query("e6_repair_hints", with_views(
    f"SELECT chain_id, {sql_case('failure_mode', fixed.REPAIR_HINTS)} AS hint FROM scored_v", "scored_v"))
def e6(spark, base):
    return V.scored(spark, base).select("chain_id", X.repair_hint(F.col("failure_mode")).alias("hint"))


def _adapter_values():
    q = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ",".join("(" + ",".join(q(v) for v in a) + ")" for a in fixed.ADAPTERS)


@query("e7_adapters", with_views(f"""
, a AS (SELECT * FROM (VALUES {_adapter_values()}) AS t(adapter_id, mode, strategy, temp, cap, prio, hint))
SELECT chain_id, coalesce(a.adapter_id, d.adapter_id) AS adapter_id, coalesce(a.strategy, d.strategy) AS search_strategy, CAST(coalesce(a.temp, d.temp) AS DOUBLE) AS temperature_delta,
 CAST(CASE WHEN a.mode IS NULL THEN d.cap ELSE a.cap END AS INTEGER) AS max_steps_override, failure_mode IS NOT NULL AS activated, a.mode IS NULL AS fallback, coalesce(a.hint, d.hint) AS system_hint
FROM scored_v LEFT JOIN a ON a.mode = failure_mode JOIN a d ON d.mode = 'default'""", "scored_v"))
def e7(spark, base):
    d = X.select_adapter(V.scored(spark, base), X.adapters(spark))
    return d.select("chain_id", "adapter_id", "search_strategy", "temperature_delta", "max_steps_override", "activated", "fallback", "system_hint")


HINT_SQL = """CASE WHEN tier='HIGH' THEN 'proceed' WHEN tier='MEDIUM' THEN 'proceed_with_caution' WHEN judge_label='POOR' THEN 'escalate_to_human'
 WHEN failure_mode IN ('retrieval_fail','no_evidence','repeated_query') THEN 'rewrite_and_verify' ELSE 'rewrite_query' END"""


@query("e8_downstream_hints", with_views(f"SELECT chain_id, {HINT_SQL} AS hint FROM scored_v", "scored_v"))
def e8(spark, base):
    return V.scored(spark, base).select("chain_id", R.linear_trust_hint(F.col("tier"), F.col("judge_label"), F.col("failure_mode")).alias("hint"))


@query("e9_should_rewrite", with_views(
    "SELECT chain_id, coalesce(tier='LOW',false) OR coalesce(judge_label='POOR',false) OR k/100.0 > 0.5 AS rewrite FROM scored_v", "scored_v"))
def e9(spark, base):
    return V.scored(spark, base).select("chain_id", X.should_rewrite(F.col("tier"), F.col("judge_label"), F.col("k") / 100.0).alias("rewrite"))


V.cte("variants_v", rf"""SELECT chain_id, 0 AS pos, 'What is the answer to: ' || q || '?' AS variant FROM (SELECT chain_id, rtrim(trim(question, ' ' || chr(10)), '?') AS q FROM chains_v)
 UNION ALL SELECT chain_id, 1, 'What is ' || array_to_string(list_slice({sql_words('q')}, 1, 6), ' ') || '?' FROM (SELECT chain_id, rtrim(trim(question, ' ' || chr(10)), '?') AS q FROM chains_v)
 UNION ALL SELECT chain_id, 2, 'Provide background information about: ' || q FROM (SELECT chain_id, rtrim(trim(question, ' ' || chr(10)), '?') AS q FROM chains_v)""", "chains_v")


@query("e10_heuristic_variants", with_views("SELECT * FROM variants_v", "variants_v"))
def e10(spark, base):
    return V.chains(spark, base).select("chain_id", F.posexplode(X.heuristic_variants(F.col("question"))).alias("pos", "variant"))


@query("e11_parsed_variants", with_views(rf"""
SELECT chain_id, CAST(pos AS INTEGER) AS pos, CASE WHEN user_id % 2 = 0 THEN CASE pos WHEN 0 THEN domain ELSE question END ELSE variant END AS variant
FROM variants_v JOIN chains_v USING (chain_id)""", "variants_v", "chains_v"))
def e11(spark, base):
    q = F.col("question")
    good = F.concat(F.lit("```"), F.to_json(F.struct(F.col("domain").alias("paraphrase"), F.lit(" ").alias("decomposed"), q.alias("alternative"))), F.lit("```"))
    raw = F.when(F.col("user_id") % 2 == 0, good).otherwise("no block here")
    return V.chains(spark, base).select("chain_id", F.posexplode(X.parse_variants(raw, q)).alias("pos", "variant"))


@query("e12_failure_hints", with_views(f"""SELECT chain_id, {sql_case('failure_mode', fixed.FAILURE_HINTS, fixed.FAILURE_HINT_DEFAULT)}
 || CASE WHEN k % 2 = 0 THEN '{fixed.TIME_SENSITIVE_SUFFIX}' ELSE '' END AS hint FROM scored_v""", "scored_v"))
def e12(spark, base):
    return V.scored(spark, base).select("chain_id", X.failure_hint(F.col("failure_mode"), F.col("k") % 2 == 0).alias("hint"))


V.cte("routed_v", "SELECT *, CASE WHEN risk_score <= 0.3 THEN 'low' WHEN risk_score <= 0.7 THEN 'medium' ELSE 'high' END AS level FROM scored_v", "scored_v")
V.cte("cascade_v", "SELECT * FROM (VALUES " + ",".join(f"('{a}','{b}',{c}::DOUBLE,{d}::DOUBLE)" for a, b, c, d in fixed.CASCADE) + ") AS t(level, model, in_cost, out_cost)")


@query("e13_routing", with_views("""SELECT chain_id, level, model, CASE level WHEN 'low' THEN 'high' WHEN 'medium' THEN 'medium' ELSE 'low' END AS confidence,
 round(in_cost * 500 / 1e6 + out_cost * 150 / 1e6, 7) AS cost_per_500 FROM routed_v JOIN cascade_v USING (level)""", "routed_v", "cascade_v"))
def e13(spark, base):
    d = V.scored(spark, base).withColumn("level", X.route(F.col("risk_score"))).join(F.broadcast(X.cascade(spark)), "level")
    return d.select("chain_id", "level", "model", R.lookup(F.col("level"), {"low": "high", "medium": "medium", "high": "low"}).alias("confidence"),
                    F.round(F.col("in_cost") * 500 / 1e6 + F.col("out_cost") * 150 / 1e6, 7).alias("cost_per_500"))


@query("e14_routing_costs", with_views("""
, m AS (SELECT model, count(*) AS calls, sum(k*10) AS ti, sum(k*3) AS o, sum(k*10) * any_value(in_cost) / 1e6 + sum(k*3) * any_value(out_cost) / 1e6 AS cost FROM routed_v JOIN cascade_v USING (level) GROUP BY model),
t AS (SELECT sum(calls) AS c, sum(cost) AS tc, sum(ti)*15.0::DOUBLE/1e6 + sum(o)*75.0::DOUBLE/1e6 AS top, sum(ti)*0.8::DOUBLE/1e6 + sum(o)*4.0::DOUBLE/1e6 AS bot FROM m)
SELECT model, calls, round(cost,6) AS cost, CAST(c AS BIGINT) AS total_calls, round(tc,6) AS total_cost, round(greatest(0, top - tc),6) AS savings_vs_top, round(greatest(0, tc - bot),6) AS overhead_vs_cheapest,
 round(calls::DOUBLE / c, 6) AS share FROM m, t""", "routed_v", "cascade_v"))
def e14(spark, base):
    calls = V.scored(spark, base).select(X.route(F.col("risk_score")).alias("level"), (F.col("k") * 10).alias("in_tokens"), (F.col("k") * 3).alias("out_tokens"))
    d = X.routing_costs(calls)
    return d.select("model", "calls", "total_calls", *r6("cost", "total_cost", "savings_vs_top", "overhead_vs_cheapest", "share"))


V.cte("attempts_v", """SELECT user_id, list(risk_score ORDER BY ts, chain_id) AS r, count(*) AS n, min(risk_score) AS best FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, chain_id) AS rn FROM scored_v)
 WHERE rn <= 1 + user_id % 3 GROUP BY user_id""", "scored_v")


def attempts(spark, base):
    """First one to three attempts per user."""
    d = top_per_key(V.scored(spark, base), ["user_id"], [F.asc("ts"), F.asc("chain_id")], 3, "rn")
    d = d.filter(F.col("rn") <= 1 + F.col("user_id") % 3)
    g = d.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rn", "risk_score"))).alias("a"))
    return g.select("user_id", F.col("a.risk_score").alias("risks"))


@query("e15_retry_advice", with_views("""
SELECT user_id, CAST(n AS INTEGER) AS attempt, CASE WHEN l < 0.4 THEN 'use_result' WHEN n >= 3 THEN 'accept_uncertainty' WHEN n = 1 THEN 'retry' WHEN t > 0.05 THEN 'accept_uncertainty' WHEN t < -0.05 THEN 'retry'
 WHEN l >= 0.65 THEN 'retry' ELSE 'accept_uncertainty' END AS action, CAST(greatest(0, 3 - n) AS INTEGER) AS budget_remaining,
 round(CASE WHEN l >= 0.4 AND (n >= 3 OR (n > 1 AND t > 0.05)) THEN best ELSE l END, 6) AS advised_risk
FROM (SELECT *, r[-1] AS l, r[-1] - r[-2] AS t FROM attempts_v)""", "attempts_v"))
def e15(spark, base):
    d = X.retry_advice(attempts(spark, base))
    return d.select("user_id", "attempt", "action", "budget_remaining", F.round("advised_risk", 6).alias("advised_risk"))


@query("e16_weakest_mode", with_views(f"""
, m AS (SELECT * FROM (VALUES {",".join(f"({i},'{x}')" for i, x in enumerate(fixed.FAILURE_MODES))}) AS t(pos, mode)),
c AS (SELECT m.pos, m.mode, count(s.chain_id) AS n FROM m LEFT JOIN scored_v s ON s.failure_mode = m.mode AND s.needs_alert GROUP BY m.pos, m.mode)
SELECT CAST(i AS INTEGER) AS iteration, CASE WHEN i % 3 = 0 THEN (SELECT mode FROM m WHERE pos = (i // 3) % 4) ELSE (SELECT mode FROM c ORDER BY n, pos LIMIT 1) END AS target FROM range(12) t(i)""", "scored_v"))
def e16(spark, base):
    modes = [(i, m) for i, m in enumerate(fixed.FAILURE_MODES)]
    counts = V.scored(spark, base).filter("needs_alert").groupBy("failure_mode").count()
    md = spark.createDataFrame(modes, "pos int, mode string").join(counts, F.col("mode") == F.col("failure_mode"), "left")
    weak = md.agg(F.min_by("mode", F.struct(F.coalesce("count", F.lit(0)), "pos")).alias("weakest"))
    names = F.array(*[F.lit(m) for _, m in modes])
    it = F.explode(F.sequence(F.lit(0), F.lit(11)))
    d = weak.select("weakest", it.alias("iteration"))
    turn = (F.floor(F.col("iteration") / 3) % len(modes)).cast("int")
    return d.select("iteration", F.when(F.col("iteration") % 3 == 0, F.get(names, turn)).otherwise(F.col("weakest")).alias("target"))


# ---- F: scores ----------------------------------------------------------------------------------

@query("f1_tiers", with_views(f"SELECT chain_id, {sql_tier('risk_score')} AS tier FROM scored_v", "scored_v"))
def f1(spark, base):
    return V.scored(spark, base).select("chain_id", R.tier(F.col("risk_score")).alias("tier"))


@query("f2_labels", with_views("""SELECT chain_id, CASE tier WHEN 'HIGH' THEN 'low' WHEN 'MEDIUM' THEN 'medium' ELSE 'high' END AS risk, lower(tier) AS confidence,
 CASE tier WHEN 'HIGH' THEN 'likely_success' WHEN 'MEDIUM' THEN 'uncertain' ELSE 'likely_failure' END AS outcome FROM scored_v""", "scored_v"))
def f2(spark, base):
    r = F.col("risk_score")
    return V.scored(spark, base).select("chain_id", R.risk_word(r).alias("risk"), R.confidence_word(r).alias("confidence"), R.outcome_word(r).alias("outcome"))


def judge_reply(label, k):
    """Model replies as a judge would write them: fenced JSON, unknown labels, or no JSON at all."""
    body = F.concat(F.lit("Verdict: {\"label\": \""), F.lower(label), F.lit("\", \"reason\": \"x\"} end"))
    return F.when(k % 11 == 0, "no verdict").otherwise(body)


V.cte("judged_v", """SELECT *, CASE WHEN k % 11 = 0 OR judge_label IS NULL THEN NULL WHEN judge_label IN ('GOOD','POOR') THEN judge_label ELSE 'BORDERLINE' END AS jl FROM scored_v""", "scored_v")


@query("f3_judge_blend", with_views("""SELECT chain_id, jl AS label, round(CASE WHEN jl IS NULL THEN risk_score ELSE (risk_score + 3.0 * CASE jl WHEN 'GOOD' THEN 0.25::DOUBLE WHEN 'POOR' THEN 0.85::DOUBLE ELSE 0.55::DOUBLE END) / 4.0 END, 6) AS risk FROM judged_v""", "judged_v"))
def f3(spark, base):
    d = V.scored(spark, base).withColumn("label", R.judge_label(judge_reply(F.col("judge_label"), F.col("k"))))
    return d.select("chain_id", "label", F.round(R.blend(F.col("risk_score"), R.judge_risk(F.col("label"))), 6).alias("risk"))


F4_SQL = f"""
, s AS (SELECT *, CASE user_id % 3 WHEN 0 THEN 'GOOD' WHEN 1 THEN 'POOR' END AS jl FROM nano_v),
f4 AS (SELECT *, CASE WHEN jl IS NULL THEN behaviour ELSE (behaviour + 3.0 * CASE jl WHEN 'GOOD' THEN 0.25::DOUBLE ELSE 0.85::DOUBLE END) / 4.0 END AS risk FROM s)
"""


def full_scores(spark, base):
    label = R.lookup((F.col("user_id") % 3).cast("string"), {"0": "GOOD", "1": "POOR"})
    return Z.chain_scores(V.steps(spark, base), V.chains(spark, base), R.judge_risk(label), label)


@query("f4_chain_score", with_views(F4_SQL + f"""SELECT chain_id, round(risk, 6) AS risk_score, {sql_tier('risk')} AS tier, risk >= 0.7 AS needs_alert, guard_mode AS failure_mode,
 jl AS judge_label, n_search AS step_count, round(behaviour, 6) AS behaviour FROM f4""", "nano_v"))
def f4(spark, base):
    return full_scores(spark, base).select("chain_id", "tier", "needs_alert", "failure_mode", "judge_label", "step_count", *r6("risk_score", "behaviour"))


@query("f6_four_part_judge", with_views("""SELECT chain_id, round(CASE WHEN k % 7 = 0 THEN 0.5::DOUBLE ELSE greatest(0.0, least(1.0, (20 - (1 + k % 5 + 3 + 2 + 3)) / 16.0::DOUBLE + (k % 3) * 0.1::DOUBLE)) END, 6) AS risk,
 CASE WHEN k % 7 = 0 THEN NULL ELSE coalesce(judge_label, 'BORDERLINE') END AS label FROM scored_v""", "scored_v"))
def f6(spark, base):
    k = F.col("k")
    flags = F.transform(F.slice(F.array(*[F.lit(m) for m in ("no_evidence", "long_chain")]), F.lit(1), k % 3), lambda x: x)
    body = F.to_json(F.struct((1 + k % 5).alias("step_relevance"), F.lit(2).alias("conclusion_support"), flags.alias("failure_flags"), F.col("judge_label").alias("quality_label")))
    raw = F.when(k % 7 == 0, "{broken").otherwise(F.concat(F.lit("text "), body))
    risk, label = R.four_part_judge(raw)
    return V.scored(spark, base).select("chain_id", F.round(risk, 6).alias("risk"), label.alias("label"))


@query("f7_self_rating", with_views("""SELECT chain_id, round(CASE WHEN k % 9 = 0 THEN risk_score ELSE 0.1::DOUBLE * risk_score + 0.9::DOUBLE * (1.0 - (k % 5) / 4.0::DOUBLE) END, 6) AS risk,
 CASE WHEN k % 9 = 0 THEN NULL ELSE round(1.0::DOUBLE - (k % 5) / 4.0, 6) END AS ptrue_risk FROM scored_v""", "scored_v"))
def f7(spark, base):
    k = F.col("k")
    raw = F.when(k % 9 == 0, "none").otherwise(F.concat(F.lit("Rating "), (1 + k % 5).cast("string"), F.lit(".")))
    d = V.scored(spark, base).withColumn("ptrue_risk", R.self_rating_risk(raw))
    return d.select("chain_id", F.round(R.blend(F.col("risk_score"), F.col("ptrue_risk"), 0.1, 0.9), 6).alias("risk"), F.round("ptrue_risk", 6).alias("ptrue_risk"))


@query("f8_two_score_blend", with_views("SELECT chain_id, round(0.25 * risk_score + 0.75 * (k / 100.0::DOUBLE), 6) AS risk FROM scored_v", "scored_v"))
def f8(spark, base):
    return V.scored(spark, base).select("chain_id", F.round(R.blend(F.col("risk_score"), F.col("k") / 100.0, 0.25, 0.75), 6).alias("risk"))


STEP_JUDGE_SQL = """CASE k % 4 WHEN 0 THEN 0.25::DOUBLE WHEN 1 THEN 0.85::DOUBLE WHEN 2 THEN 0.55::DOUBLE END"""


def step_reply(k):
    return (F.when(k % 4 == 0, '{"on_track": true_or_false, "risk_assessment": "low"}')
            .when(k % 4 == 1, 'Here: {"on_track": false, "step_quality": 1-5, "risk_assessment": HIGH_or_LOW }')
            .when(k % 4 == 2, '{"risk_assessment": "odd"}').otherwise("no block"))


@query("f9_step_judge", with_views(f"SELECT chain_id, {STEP_JUDGE_SQL} AS risk, CASE k % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS on_track FROM scored_v", "scored_v"))
def f9(spark, base):
    risk, ok = R.step_judge(step_reply(F.col("k")))
    return V.scored(spark, base).select("chain_id", risk.alias("risk"), ok.alias("on_track"))


GUARD_SQL = f"""
, lastp AS (SELECT chain_id, max(t) AS t, max_by(behaviour, t) AS b FROM pv WHERE t <= 2 GROUP BY chain_id),
jj AS (SELECT *, chain_id AS k, {STEP_JUDGE_SQL.replace('k %', 'chain_id %')} AS jr, coalesce(chain_id % 4 <> 1, true) AS ok FROM lastp),
mm AS (SELECT *, CASE WHEN jr IS NOT NULL THEN 0.3 * (1 - b) + 0.7 * jr ELSE 1 - b END AS mix FROM jj),
guard AS (SELECT *, CASE WHEN NOT ok THEN greatest(mix, 0.68::DOUBLE) ELSE mix END AS risk FROM mm)
"""


def guard_rows(spark, base):
    risk, ok = R.step_judge(step_reply(F.col("chain_id")))
    return Z.stream_guard(D.prefix_signals(V.steps(spark, base), V.chains(spark, base)), risk, ok)


@query("f10_stream_guard", prefix_sql(GUARD_SQL + "SELECT chain_id, CAST(t - 1 AS INTEGER) AS step_index, round(risk, 6) AS risk_at_step, risk >= 0.65 AS abort FROM guard"))
def f10(spark, base):
    return guard_rows(spark, base).select("chain_id", F.col("step_index").cast("int").alias("step_index"), "abort", *r6("risk_at_step"))


@query("f11_step_monitor", prefix_sql("""SELECT chain_id, t, round(r, 6) AS risk_score, CASE WHEN r < 0.5 THEN 'low' WHEN r < 0.7 THEN 'medium' ELSE 'high' END AS risk,
 CASE WHEN r < 0.5 THEN 'high' WHEN r < 0.7 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN r < 0.5 THEN 'likely_success' WHEN r < 0.7 THEN 'uncertain' ELSE 'likely_failure' END AS outcome
FROM (SELECT chain_id, t, behaviour AS r FROM pv UNION ALL SELECT chain_id, 0, 0.5::DOUBLE FROM chains_v)"""))
def f11(spark, base):
    c = V.chains(spark, base)
    return Z.step_monitor(D.prefix_signals(V.steps(spark, base), c), c).select("chain_id", "t", "risk", F.col("confidence"), "outcome", *r6("risk_score"))


@query("f12_pending_prefix", prefix_sql("""SELECT chain_id, t + 1 AS step, round(least(behaviour * 0.85, 1.0), 6) AS risk_score,
 CASE WHEN behaviour * 0.85 >= 0.65 THEN 'high' WHEN behaviour * 0.85 >= 0.45 THEN 'medium' ELSE 'low' END AS risk FROM pv""", pending=True))
def f12(spark, base):
    return Z.nano_prefix(D.prefix_signals(V.steps(spark, base), V.chains(spark, base), pending=True)).select("chain_id", "step", "risk", *r6("risk_score"))


@query("f13_question_only", with_views("""SELECT chain_id, round(3.2::DOUBLE / 6.2, 6) AS risk_score, 'MEDIUM' AS tier, 'medium' AS confidence, 'uncertain' AS outcome, 'proceed_with_monitoring' AS recommended_action FROM chains_v""", "chains_v"))
def f13(spark, base):
    return Z.question_only(V.chains(spark, base)).select("chain_id", "tier", "confidence", "outcome", "recommended_action", *r6("risk_score"))


@query("f14_two_stage_alert", prefix_sql(GUARD_SQL + """SELECT g.chain_id, g.risk >= 0.65 AS early, n.behaviour >= 0.7 AS late, g.risk >= 0.65 OR n.behaviour >= 0.7 AS alert
FROM guard g JOIN nano_v n USING (chain_id)"""))
def f14(spark, base):
    late = Z.chain_scores(V.steps(spark, base), V.chains(spark, base)).select("chain_id", F.col("needs_alert").alias("late"))
    d = guard_rows(spark, base).select("chain_id", F.col("abort").alias("early")).join(late, "chain_id")
    return d.withColumn("alert", F.col("early") | F.col("late"))


@query("f15_process_monitor", with_views(f"""SELECT chain_id, round(r, 6) AS risk_score, {sql_tier('r')} AS tier, r >= 0.7 AS needs_alert, {PROCESS_SQL} AS failure_mode
FROM (SELECT *, (sc2_step_count + sc4_uncertainty_density + sc5_backtrack_rate + retrieval_conf + semantic_gap + thought_len_norm + empty_obs + ans_entity_match + obs_entity_coverage) / 9.0 AS r FROM d4_full)""", "d4_full"))
def f15(spark, base):
    d = Z.process_scores(D.nine_features(V.steps(spark, base), V.chains(spark, base)), D.STEP_NINE)
    return d.select("chain_id", "tier", "needs_alert", "failure_mode", *r6("risk_score"))


@query("f16_batch_summary", with_views("SELECT count(*) AS n_chains, count(CASE WHEN behaviour >= 0.7 THEN 1 END) AS n_alerts FROM nano_v", "nano_v"))
def f16(spark, base):
    d = Z.chain_scores(V.steps(spark, base), V.chains(spark, base))
    return d.agg(F.count(F.lit(1)).alias("n_chains"), F.count_if("needs_alert").alias("n_alerts"))


@query("f17_evaluation_summary", with_views("""SELECT count(*) AS n, round(avg(risk_score), 6) AS mean_risk, round(avg(CASE WHEN needs_alert THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS alert_rate, count(CASE WHEN needs_alert THEN 1 END) AS alert_count,
 count(CASE WHEN tier='HIGH' THEN 1 END) AS "tier_HIGH", count(CASE WHEN tier='MEDIUM' THEN 1 END) AS "tier_MEDIUM", count(CASE WHEN tier='LOW' THEN 1 END) AS "tier_LOW", CAST(0 AS BIGINT) AS "tier_UNKNOWN" FROM scored_v""", "scored_v"))
def f17(spark, base):
    d = Z.evaluation_summary(V.scored(spark, base))
    return d.withColumns({c: F.round(c, 6) for c in ("mean_risk", "alert_rate")})


@query("f18_rank_blend", with_views("""SELECT chain_id, round(0.5 * percent_rank() OVER (ORDER BY n_steps) + 0.5 * percent_rank() OVER (ORDER BY risk_score), 6) AS risk FROM scored_v""", "scored_v"))
def f18(spark, base):
    d = V.scored(spark, base).select("chain_id", F.col("n_steps").cast("double").alias("n_steps"), "risk_score")
    d = Z.relative_ranks(d, {"n_steps": "r1", "risk_score": "r2"})
    return d.select("chain_id", F.round(0.5 * F.col("r1") + 0.5 * F.col("r2"), 6).alias("risk"))


# ---- vectors ---------------------------------------------------------------------------------

def bank_and_queries(spark, base):
    v = V.vectors(spark, base)
    return v.filter("label < 5"), v.filter("label >= 5")


KNN_SQL = """, kq AS (SELECT q.vec_id, avg(d) AS risk FROM (SELECT q.vec_id, list_distance(q.v, b.v) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, b.v)) AS rn
 FROM vec_v q, vec_v b WHERE q.label >= 5 AND b.label < 5) q WHERE rn <= 5 GROUP BY q.vec_id),
kb AS (SELECT q.vec_id, avg(d) AS risk FROM (SELECT q.vec_id, list_distance(q.v, b.v) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, b.v)) AS rn
 FROM vec_v q, vec_v b WHERE q.label < 5 AND b.label < 5 AND q.vec_id <> b.vec_id) q WHERE rn <= 5 GROUP BY q.vec_id)
"""


def knn_sql(body):
    return with_views(KNN_SQL + body, "vec_v")


@query("f19_knn_risk", knn_sql("SELECT vec_id, round(risk, 6) AS risk FROM kq"))
def f19(spark, base):
    bank, q = bank_and_queries(spark, base)
    return K.nearest_mean(q, bank).select("vec_id", *r6("risk"))


@query("f19_knn_blocks", ORACLE["f19_knn_risk"])
def f19_blocks(spark, base):
    """The way of a bank too large to send: blocks against blocks."""
    bank, q = bank_and_queries(spark, base)
    return K.nearest_mean(q, bank, limit=0, block=200).select("vec_id", *r6("risk"))


@query("f20_knn_thresholds", knn_sql("SELECT count(*) AS n, round(quantile_cont(risk, 0.75), 6) AS low_cut, round(quantile_cont(risk, 0.95), 6) AS high_cut FROM kb"))
def f20(spark, base):
    bank, _ = bank_and_queries(spark, base)
    d = K.nearest_mean(bank, bank)
    n = F.col("_n") - 1
    return order_statistics(d, [], "risk", {"low_cut": n * 0.75, "high_cut": n * 0.95}).select("n", *r6("low_cut", "high_cut"))


@query("f21_empirical_confidence", knn_sql("SELECT vec_id, round((SELECT count(*) FROM kb WHERE kb.risk > kq.risk)::DOUBLE / (SELECT count(*) FROM kb), 6) AS confidence FROM kq"))
def f21(spark, base):
    bank, q = bank_and_queries(spark, base)
    return K.share_above(K.nearest_mean(bank, bank), K.nearest_mean(q, bank), "risk").select("vec_id", *r6("confidence"))


@query("f22_centroid_distance", with_views("""
, c AS (SELECT list(x ORDER BY i) AS c FROM (SELECT i, avg(x) AS x FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec_v WHERE label < 5) GROUP BY i))
SELECT vec_id, round(list_distance(v, c), 6) AS distance FROM vec_v, c""", "vec_v"))
def f22(spark, base):
    bank, _ = bank_and_queries(spark, base)
    mid = F.array(*[F.lit(x) for x in K.centroid(bank)])
    return V.vectors(spark, base).select("vec_id", F.round(K.distance(F.col("v"), mid), 6).alias("distance"))


@query("f22_kmeans_distance", None)
def f22k(spark, base):
    from plumbline.operators.models import centre_distances
    bank, q = bank_and_queries(spark, base)
    return centre_distances(bank, q, k=5)


@query("f23_self_consistency", """WITH c AS (SELECT conv_id AS chain_id, role AS answer, count(*) AS n FROM conversations GROUP BY 1, 2)
SELECT chain_id, max_by(answer, (n, answer)) AS majority_answer, round(max(n)::DOUBLE / sum(n), 6) AS majority_fraction, CAST(sum(n) AS BIGINT) AS samples FROM c GROUP BY chain_id""")
def f23(spark, base):
    from plumbline.operators.calibration import majority
    d = majority(V.messages(spark, base).select("chain_id", F.col("role").alias("answer")))
    return d.withColumn("majority_fraction", F.round("majority_fraction", 6))


@query("f23_tightness", with_views("""SELECT a.label, count(DISTINCT a.vec_id) AS n, round(avg(list_cosine_similarity(a.v, b.v)), 6) AS tightness FROM vec_v a JOIN vec_v b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.label""", "vec_v"))
def f23t(spark, base):
    return K.tightness(V.vectors(spark, base), "label").select("label", "n", *r6("tightness"))


@query("f24_step_count_baseline", with_views("SELECT chain_id, round(n_steps / 7.0::DOUBLE, 6) AS risk FROM scored_v", "scored_v"))
def f24(spark, base):
    return V.scored(spark, base).select("chain_id", F.round(F.col("n_steps") / 7.0, 6).alias("risk"))


def question_vectors(spark, base):
    """A label's first vector as the question, its others as observations."""
    v = V.vectors(spark, base)
    q = v.groupBy("label").agg(F.min_by("v", "vec_id").alias("v"), F.min("vec_id").alias("qid"))
    return q, v.join(q.select("label", "qid"), "label").filter(F.col("vec_id") != F.col("qid"))


@query("d12_step_similarities", with_views("""
, q AS (SELECT label, min_by(v, vec_id) AS qv, min(vec_id) AS qid FROM vec_v GROUP BY label)
SELECT label, vec_id, round(list_cosine_similarity(v, qv), 6) AS similarity FROM vec_v JOIN q USING (label) WHERE vec_id <> qid""", "vec_v"))
def d12_steps(spark, base):
    q, obs = question_vectors(spark, base)
    return K.observation_similarities(q, obs, "label", "vec_id").select("label", "vec_id", *r6("similarity"))


@query("e4_low_retrieval", with_views(r"""
, q AS (SELECT label, min_by(v, vec_id) AS qv, min(vec_id) AS qid FROM vec_v GROUP BY label),
w AS (SELECT label, avg(list_cosine_similarity(v, qv)) AS sim FROM vec_v JOIN q USING (label) WHERE vec_id <> qid GROUP BY label)
SELECT chain_id, CASE WHEN length(trim(final_answer, ' ' || chr(10))) < 5 THEN 'empty_answer' WHEN d < c THEN 'repeated_query' WHEN bad THEN 'retrieval_fail' WHEN n >= 4 THEN 'long_chain' WHEN sim < 0.3 THEN 'low_retrieval_quality' END AS failure_mode
FROM chains_v JOIN (SELECT chain_id, count(*) AS n, count(DISTINCT CASE WHEN action_type='Search' THEN action_arg END) AS d, count(CASE WHEN action_type='Search' THEN 1 END) AS c,
 bool_or(regexp_matches(lower(observation), 'no results|not found')) AS bad FROM steps_v GROUP BY chain_id) USING (chain_id) LEFT JOIN w ON w.label = chain_id % 10""", "chains_v", "steps_v", "vec_v"))
def e4_low(spark, base):
    """The documented rules with the retrieval quality of the chain's group of vectors."""
    q, obs = question_vectors(spark, base)
    sim = K.retrieval_quality(q, obs.select("label", "v"), "label").select("label", "mean_sim")
    d = documented_measures(spark, base).withColumn("label", F.col("chain_id") % 10).join(sim, "label", "left")
    return d.select("chain_id", X.documented_mode(F.col("mean_sim")).alias("failure_mode"))


@query("f22_question_length", with_views(r"""SELECT chain_id, round((rank() OVER (ORDER BY w) - 1)::DOUBLE / greatest(count(*) OVER () - 1, 1), 6) AS question_risk, round((rank() OVER (ORDER BY a) - 1)::DOUBLE / greatest(count(*) OVER () - 1, 1), 6) AS answer_risk
FROM (SELECT chain_id, len(regexp_extract_all(question, '\S+')) AS w, len(regexp_extract_all(final_answer, '\S+')) AS a FROM chains_v)""", "chains_v"))
def f22_length(spark, base):
    """Length baselines: longer questions and longer answers rank as riskier."""
    c = V.chains(spark, base).select("chain_id", T.word_count(F.col("question")).alias("w"), T.word_count(F.col("final_answer")).alias("a"))
    return Z.relative_ranks(c, {"w": "question_risk", "a": "answer_risk"}).select("chain_id", *r6("question_risk", "answer_risk"))


@query("d12_retrieval_quality", with_views("""
, q AS (SELECT label, min_by(v, vec_id) AS qv, min(vec_id) AS qid FROM vec_v GROUP BY label),
s AS (SELECT label, list_cosine_similarity(v, qv) AS c FROM vec_v JOIN q USING (label) WHERE vec_id <> qid)
SELECT label, count(*) AS n, round(avg(c), 6) AS mean_sim, round(min(c), 6) AS min_sim, CASE WHEN avg(c) >= 0.55 THEN 'GOOD' WHEN avg(c) >= 0.45 THEN 'OK' ELSE 'POOR' END AS quality_label, avg(c) < 0.30 AS low_retrieval_quality
FROM s GROUP BY label""", "vec_v"))
def d12(spark, base):
    q, obs = question_vectors(spark, base)
    d = K.retrieval_quality(q, obs.select("label", "v"), "label")
    return d.select("label", "n", "quality_label", "low_retrieval_quality", *r6("mean_sim", "min_sim"))


@query("d13_chain_embedding", with_views("SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(max(x), 6) AS value FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec_v) GROUP BY label, i", "vec_v"))
def d13(spark, base):
    return K.chain_vectors(V.vectors(spark, base), "label").select("label", "pos", *r6("value"))
