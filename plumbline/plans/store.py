"""Queries: sources and sinks, store reports, trust envelopes."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from plumbline.functions import signing as G
from plumbline.operators import analytics as A, trust as K
from plumbline.operators.ordered import top_per_key
from plumbline.plans import views as V
from plumbline.plans.registry import query, table
from plumbline.plans.scores import HINT_SQL
from plumbline.plans.traces import r6
from plumbline.plans.views import epoch, sql_tier, with_views
from plumbline.session import new_dir
from plumbline.sources import store as S

STEP_STRUCT = ["thought", "action_type", "action_arg", "observation"]


def chain_json(spark, base):
    """One JSON list per chain, as a chain file would hold it; labels only where one is known."""
    s = V.steps(spark, base).groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("step_idx", *STEP_STRUCT))).alias("s"))
    lab = table(spark, base, "labels").select(F.col("doc_id").alias("chain_id"), (F.col("quality") == 1).alias("correct"))
    c = V.chains(spark, base).join(s, "chain_id").join(lab, "chain_id", "left")
    steps = F.transform("s", lambda x: F.struct(*[x[f].alias(f) for f in STEP_STRUCT]))
    return c.select("chain_id", F.to_json(F.array(F.struct("question", steps.alias("steps"), "final_answer", "correct"))).alias("value"))


@query("a1_chain_lists", with_views("""SELECT c.chain_id, question, final_answer, coalesce(quality = 1, false) AS correct, (SELECT count(*) FROM steps_v s WHERE s.chain_id = c.chain_id) AS n_steps
FROM chains_v c LEFT JOIN labels l ON l.doc_id = c.chain_id""", "chains_v", "steps_v"))
def a1(spark, base):
    d = S.chain_rows(chain_json(spark, base))
    return d.select("chain_id", "question", "final_answer", "correct", F.size("steps").cast("long").alias("n_steps"))


def raw_lines(spark, base):
    k = F.get_json_object("props", "$.k").cast("int")
    good = F.to_json(F.struct(F.col("event_id").alias("id"), k.alias("k")))
    line = F.when(k % 10 == 0, F.concat(good, F.lit(", oops"))).when(k % 10 == 1, F.concat(F.lit("{"), good)).when(k % 10 == 2, "  ").otherwise(good)
    return table(spark, base, "events").select(line.alias("value"))


@query("a2_json_lines", with_views("""SELECT chain_id AS id, k FROM ev WHERE k % 10 NOT IN (0, 1, 2)
UNION ALL SELECT -1, CAST(count(*) AS INTEGER) FROM ev WHERE k % 10 IN (0, 1)""", "ev"))
def a2(spark, base):
    """Good rows, and one row (-1) with the number of malformed lines."""
    good, bad = S.json_lines(raw_lines(spark, base), "id long, k int")
    return good.unionByName(bad.agg(F.lit(-1).cast("long").alias("id"), F.count(F.lit(1)).cast("int").alias("k")))


def telemetry(spark, base):
    s = V.scored(spark, base)
    width = F.when(F.col("k") % 6 == 0, 10).otherwise(11)
    f = F.transform(F.sequence(F.lit(1), width), lambda i: F.col("risk_score") / i)
    y = F.when(F.col("k") % 5 != 0, F.col("wrong"))
    return s.select("chain_id", f.alias("f"), y.alias("y"), "domain", F.lit("1").alias("v"))


@query("a3_telemetry_labels", with_views("SELECT chain_id, CAST(wrong AS INTEGER) AS y, round(risk_score / 11, 6) AS f11 FROM scored_v WHERE k % 6 <> 0 AND k % 5 <> 0", "scored_v"))
def a3(spark, base):
    d = S.valid_telemetry(telemetry(spark, base))
    return d.select("chain_id", "y", F.round(F.element_at("f", 11), 6).alias("f11"))


@query("a4_taxonomy_entries", with_views("""SELECT chain_id, CASE WHEN chain_id % 2 = 0 THEN 'long_chain' ELSE 'no_evidence' END AS mode, CAST((SELECT count(*) FROM steps_v s WHERE s.chain_id = c.chain_id) AS INTEGER) AS n_steps, 1 AS wrong
FROM chains_v c WHERE final_answer <> ''""", "chains_v", "steps_v"))
def a4(spark, base):
    return taxonomy(spark, base).select(F.col("question").cast("long").alias("chain_id"), "mode", F.size("steps").alias("n_steps"), "wrong")


def taxonomy(spark, base):
    """Chains as a failure taxonomy would list them, by mode, read as labelled rows."""
    s = V.steps(spark, base).groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("step_idx", *STEP_STRUCT))).alias("s"))
    steps = F.transform("s", lambda x: F.struct(*[x[f].alias(f) for f in STEP_STRUCT]))
    none = F.array().cast(f"array<{S.STEP}>")
    c = V.chains(spark, base).join(s, "chain_id")
    even = F.col("chain_id") % 2 == 0
    some = F.when(F.col("final_answer") != "", steps).otherwise(none)
    entry = F.struct(F.col("chain_id").cast("string").alias("question"), F.when(even, some).otherwise(none).alias("step_details"),
                     F.when(even, none).otherwise(some).alias("steps"), "final_answer")
    raw = c.select(F.to_json(F.create_map(F.when(even, "long_chain").otherwise("no_evidence"), F.array(entry))).alias("value"))
    return S.taxonomy_rows(raw.select(F.from_json("value", f"map<string,array<{S.TAXONOMY_ENTRY}>>").alias("m")))


@query("a5_flexible_columns", with_views("""SELECT chain_id, CASE WHEN question = '' THEN '(unknown)' ELSE question END AS question, final_answer,
 CASE WHEN chain_id % 3 = 0 THEN 0 ELSE CAST((SELECT count(*) FROM steps_v s WHERE s.chain_id = c.chain_id) AS INTEGER) END AS n_steps FROM chains_v c""", "chains_v", "steps_v"))
def a5(spark, base):
    s = V.steps(spark, base).groupBy("chain_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("step_idx", *STEP_STRUCT)))).alias("j"))
    c = V.chains(spark, base).join(s, "chain_id")
    odd = F.col("chain_id") % 2 == 1
    rows = c.select("chain_id", F.when(odd, F.col("question")).otherwise("").alias("question"), F.when(~odd, F.col("question")).alias("input"),
                    F.when(F.col("chain_id") % 3 == 0, "[{broken").alias("steps"), F.col("j").alias("chain_steps"),
                    F.lit("").alias("output"), F.col("final_answer").alias("answer"))
    return S.flexible_runs(rows).select("chain_id", "question", "final_answer", F.size("steps").alias("n_steps"))


@query("a6_question_csv", with_views("SELECT CAST(chain_id AS VARCHAR) AS id, question FROM chains_v WHERE question <> ''", "chains_v"))
def a6(spark, base):
    path = new_dir(spark, "questions")
    c = V.chains(spark, base).filter("question <> ''").select(F.col("chain_id").cast("string").alias("id"), F.regexp_replace("question", "\n", "\\\\n").alias("question"))
    c.write.option("header", True).option("escape", '"').csv(path)
    return S.read_questions(spark, path).withColumn("question", F.regexp_replace("question", r"\\n", "\n"))


@query("a7_store_rows", with_views("""SELECT chain_id, question[1:500] AS question, final_answer[1:500] AS final_answer, CASE WHEN user_id = 0 THEN 'default' ELSE domain END AS domain,
 CASE WHEN user_id % 3 = 1 THEN 0.007::DOUBLE ELSE 0.0::DOUBLE END AS cost FROM chains_v""", "chains_v"))
def a7(spark, base):
    """Written by domain and read back."""
    c = V.chains(spark, base).withColumns({
        "domain": F.when(F.col("user_id") == 0, "").otherwise(F.col("domain")),
        "judge_label": F.when(F.col("user_id") % 3 == 1, "GOOD").when(F.col("user_id") % 3 == 2, "LOCAL")})
    path = new_dir(spark, "store")
    S.append_chains(c, path)
    return spark.read.parquet(path).select("chain_id", "question", "final_answer", "domain", "cost")


@query("a8_feedback_upsert", with_views("SELECT chain_id, user_id, label, fts FROM feedback_v", "feedback_v"))
def a8(spark, base):
    """First submissions form the table, all later ones are merged into it."""
    own = V.scored(spark, base).select("chain_id", "user_id")
    log = V.feedback_log(spark, base).join(own, "chain_id")
    keys, order = ["user_id", "chain_id"], ["fts", "line", "part", "label"]
    old = log.filter("line <= 2")
    return S.merge_feedback(S.latest_feedback(old, keys, order), log, keys, order).select("chain_id", "user_id", "label", "fts")


@query("a9_guardrail_upsert", with_views("""SELECT user_id, domain, round(risk_score, 6) AS threshold, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, domain ORDER BY ts DESC, chain_id DESC) AS rn FROM scored_v) WHERE rn = 1""", "scored_v"))
def a9(spark, base):
    rules = V.scored(spark, base).select("user_id", "domain", F.round("risk_score", 6).alias("threshold"), "ts", "chain_id")
    return S.latest_feedback(rules, ["user_id", "domain"], ["ts", "chain_id"]).drop("chain_id")


@query("a10_audit_export", with_views("SELECT chain_id, round(risk_score, 6) AS risk_score, tier, ts FROM scored_v WHERE domain = 'error' AND ts BETWEEN 1704500000 AND 1705500000", "scored_v"))
def a10(spark, base):
    """Exported as CSV and read back."""
    path = new_dir(spark, "audit")
    S.export_audit(V.scored(spark, base).select("chain_id", F.round("risk_score", 6).alias("risk_score"), "tier", "ts", "domain"), "error", 1704500000, 1705500000, path)
    return spark.read.schema("chain_id long, risk_score double, tier string, ts long, domain string").csv(path, header=True).drop("domain")


@query("a11_clear_domain", with_views("SELECT domain, count(*) AS n FROM scored_v WHERE domain <> 'click' GROUP BY domain", "scored_v"))
def a11(spark, base):
    path = new_dir(spark, "clear")
    V.scored(spark, base).select("chain_id", "domain").write.partitionBy("domain").parquet(path)
    S.clear_domain(spark, path, "click")
    return spark.read.schema("chain_id long, domain string").parquet(path).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query("a12_seed_domain", with_views("SELECT chain_id, 'fresh' AS domain, ts FROM scored_v WHERE domain = 'view' ORDER BY ts DESC, chain_id DESC LIMIT 25", "scored_v"))
def a12(spark, base):
    return S.seed_domain(V.scored(spark, base), "view", "fresh", 25).select("chain_id", "domain", "ts")


@query("a13_calibration_pool", with_views("SELECT domain, chain_id FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts DESC, chain_id DESC) AS rn FROM scored_v) WHERE rn <= 200", "scored_v"))
def a13(spark, base):
    return S.latest_n(V.scored(spark, base), 200).select("domain", "chain_id")


@query("a14_anonymous_export", with_views("SELECT CAST(wrong AS INTEGER) AS y, CASE WHEN domain = 'view' THEN '' ELSE sha256(domain)[1:6] END AS d, '1' AS v, round(risk_score / 3, 6) AS f3 FROM scored_v WHERE k % 5 <> 0 AND k % 6 <> 0", "scored_v"))
def a14(spark, base):
    t = S.valid_telemetry(telemetry(spark, base)).withColumn("domain", F.when(F.col("domain") != "view", F.col("domain")))
    return S.anonymised(t).select("y", "d", "v", F.element_at("f", 3).alias("f3"))


@query("a15_metric_snapshot", with_views("""SELECT domain, round(max_by(risk_score, (ts, chain_id)), 6) AS last_risk, count(*) AS chains, count(CASE WHEN needs_alert THEN 1 END) AS alerts, count(CASE WHEN tier='HIGH' THEN 1 END) AS "tier_HIGH",
 count(CASE WHEN tier='MEDIUM' THEN 1 END) AS "tier_MEDIUM", count(CASE WHEN tier='LOW' THEN 1 END) AS "tier_LOW" FROM scored_v GROUP BY domain""", "scored_v"))
def a15(spark, base):
    return A.metric_snapshot(V.scored(spark, base)).withColumn("last_risk", F.round("last_risk", 6))


@query("a16_monitor_history", with_views("""SELECT domain, count(*) AS n_tracked, count(CASE WHEN needs_alert THEN 1 END) AS n_alerts, round(avg(risk_score), 6) AS avg_risk, round(quantile_cont(risk_score, 0.95), 6) AS p95_risk,
 (SELECT string_agg(CAST(chain_id AS VARCHAR), ',' ORDER BY rn) FROM (SELECT chain_id, domain, row_number() OVER (PARTITION BY domain ORDER BY value DESC, chain_id) AS rn FROM scored_v) t WHERE t.domain = s.domain AND rn <= 3) AS riskiest,
 round(count(CASE WHEN needs_alert THEN 1 END)::DOUBLE / count(*), 6) AS alert_rate FROM scored_v s GROUP BY domain""", "scored_v"))
def a16(spark, base):
    d = A.monitor_history(V.scored(spark, base))
    return d.select("domain", "n_tracked", "n_alerts", "riskiest", *r6("avg_risk", "p95_risk", "alert_rate"))


@query("a17_retrain_set", with_views("""SELECT 'chain' AS origin, chain_id, CAST(wrong AS INTEGER) AS y FROM labelled_v
UNION ALL SELECT 'telemetry', chain_id, CAST(wrong AS INTEGER) FROM scored_v WHERE k % 6 <> 0 AND k % 5 <> 0""", "labelled_v", "scored_v"))
def a17(spark, base):
    own = V.labelled_chains(spark, base).select(F.lit("chain").alias("origin"), "chain_id", F.col("wrong").cast("int").alias("y"))
    return own.unionByName(S.valid_telemetry(telemetry(spark, base)).select(F.lit("telemetry").alias("origin"), "chain_id", "y"))


# ---- J: reports -----------------------------------------------------------------------------------

@query("j1_recent_chains", with_views("""SELECT s.chain_id, s.user_id, s.domain, round(risk_score, 6) AS risk_score, tier, ts, f.label AS feedback
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, chain_id DESC) AS rn FROM scored_v) s LEFT JOIN feedback_v f ON f.chain_id = s.chain_id AND f.user_id = s.user_id WHERE rn <= 20""", "feedback_v"))
def j1(spark, base):
    d = A.recent_chains(V.scored(spark, base), V.feedback(spark, base))
    return d.select("chain_id", "user_id", "domain", "tier", "ts", "feedback", *r6("risk_score"))


@query("j2_domain_rollup", with_views("SELECT user_id, domain, count(*) AS chain_count, max(ts) AS last_seen, round(avg(risk_score) + 1e-9, 6) AS avg_risk, count(CASE WHEN needs_alert THEN 1 END) AS n_alerts FROM scored_v GROUP BY user_id, domain", "scored_v"))
def j2(spark, base):
    return A.domain_rollup(V.scored(spark, base), ("user_id", "domain")).withColumn("avg_risk", F.round(F.col("avg_risk") + 1e-9, 6))


@query("j3_time_series", with_views(" UNION ALL ".join(
    f"SELECT '{n}' AS bucket, (ts // {s}) * {s} AS timestamp, round(avg(risk_score), 6) AS avg_risk, count(*) AS n_chains, count(CASE WHEN needs_alert THEN 1 END) AS n_alerts FROM scored_v GROUP BY (ts // {s}) * {s}"
    for n, s in A.BUCKETS.items()), "scored_v"))
def j3(spark, base):
    s = V.scored(spark, base)
    out = None
    for n in A.BUCKETS:
        d = A.time_series(s, n).select(F.lit(n).alias("bucket"), "timestamp", "n_chains", "n_alerts", *r6("avg_risk"))
        out = d if out is None else out.unionByName(d)
    return out


NOW_SQL = "(SELECT max(ts) FROM scored_v)"


@query("j4_platform_stats", with_views(f"""SELECT count(*) AS total_chains, round(sum(cost), 4) AS total_cost, count(CASE WHEN ts >= {NOW_SQL} - {NOW_SQL} % 86400 THEN 1 END) AS chains_today,
 count(CASE WHEN needs_alert AND ts >= {NOW_SQL} - {NOW_SQL} % 86400 THEN 1 END) AS alerts_today FROM scored_v""", "scored_v"))
def j4(spark, base):
    return A.platform_stats(V.scored(spark, base)).withColumn("total_cost", F.round("total_cost", 4))


@query("j5_daily_counts", with_views(f"""SELECT d AS timestamp, count(s.chain_id) AS n_chains FROM (SELECT ({NOW_SQL} // 86400 - i) * 86400 AS d FROM range(14) t(i)) LEFT JOIN scored_v s ON s.ts // 86400 * 86400 = d GROUP BY d""", "scored_v"))
def j5(spark, base):
    return A.daily_counts(V.scored(spark, base))


@query("j6_user_search", with_views("""SELECT user_id, name, email, plan, (SELECT count(*) FROM users_v WHERE email ILIKE '%building%' OR name ILIKE '%building%') AS total
FROM users_v WHERE email ILIKE '%building%' OR name ILIKE '%building%' ORDER BY user_id DESC LIMIT 50 OFFSET 50""", "users_v"))
def j6(spark, base):
    return A.search_users(V.users(spark, base), "BuilDing", page=2).select("user_id", "name", "email", "plan", "total")


@query("j7_user_chains", with_views("SELECT user_id, chain_id, domain, tier, round(cost, 6) AS cost, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, chain_id DESC) AS rn FROM scored_v) WHERE rn <= 50", "scored_v"))
def j7(spark, base):
    d = top_per_key(V.scored(spark, base), ["user_id"], A.NEWEST(), 50)
    return d.select("user_id", "chain_id", "domain", "tier", "ts", *r6("cost"))


def orgs(spark, base):
    owner = V.users(spark, base).groupBy("org_id").agg(F.min_by(F.struct("email", "plan"), "user_id").alias("o"))
    n = table(spark, base, "nation").select(F.col("n_nationkey").alias("org_id"), F.col("n_name").alias("org_name"))
    return n.join(owner, "org_id", "left").select("org_id", "org_name", F.coalesce("o.email", F.lit("")).alias("owner_email"), F.coalesce("o.plan", F.lit("free")).alias("owner_plan"))


@query("j8_org_rollup", with_views("""SELECT n_nationkey AS org_id, n_name AS org_name, coalesce((SELECT min_by(email, user_id) FROM users_v u WHERE u.org_id = n_nationkey), '') AS owner_email,
 coalesce((SELECT min_by(plan, user_id) FROM users_v u WHERE u.org_id = n_nationkey), 'free') AS owner_plan, (SELECT count(*) FROM users_v u WHERE u.org_id = n_nationkey) AS member_count,
 (SELECT count(*) FROM users_v u JOIN scored_v s USING (user_id) WHERE u.org_id = n_nationkey) AS chain_count FROM nation""", "users_v", "scored_v"))
def j8(spark, base):
    m = V.users(spark, base).select("user_id", "org_id")
    return A.org_rollup(orgs(spark, base), m, V.scored(spark, base)).drop("org_cost")


@query("j9_cost_per_user", with_views("SELECT u.user_id, u.email, u.plan, count(s.chain_id) AS chains, round(coalesce(sum(cost), 0), 6) AS total_cost FROM users_v u LEFT JOIN scored_v s USING (user_id) GROUP BY ALL", "users_v", "scored_v"))
def j9(spark, base):
    return A.cost_per_user(V.users(spark, base), V.scored(spark, base)).select("user_id", "email", "plan", "chains", *r6("total_cost"))


@query("j10_judge_calls", with_views("SELECT u.user_id, count(CASE WHEN judge_label IN ('GOOD','POOR') THEN 1 END) AS judge_calls FROM users_v u LEFT JOIN scored_v s USING (user_id) GROUP BY u.user_id", "users_v", "scored_v"))
def j10(spark, base):
    return A.cost_per_user(V.users(spark, base), V.scored(spark, base)).select("user_id", "judge_calls")


@query("j11_proxy_stats", with_views("""SELECT user_id, count(*) AS n_calls, CAST(sum(prompt_tokens) AS BIGINT) AS total_prompt, CAST(sum(completion_tokens) AS BIGINT) AS total_completion, round(avg(latency_ms) + 1e-9, 4) AS avg_latency, round(avg(risk_score) + 1e-9, 6) AS avg_risk,
 count(CASE WHEN status <> 'ok' THEN 1 END) AS n_errors FROM proxy_v WHERE ts >= (SELECT max(ts) FROM proxy_v) - 7 * 86400 GROUP BY user_id""", "proxy_v"))
def j11(spark, base):
    d = A.proxy_stats(V.proxy(spark, base))
    return d.withColumns({"avg_latency": F.round(F.col("avg_latency") + 1e-9, 4), "avg_risk": F.round(F.col("avg_risk") + 1e-9, 6)})


@query("j12_proxy_requests", with_views("SELECT id, user_id, model, prompt_tokens, completion_tokens, status, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS rn FROM proxy_v) WHERE rn <= 50", "proxy_v"))
def j12(spark, base):
    d = top_per_key(V.proxy(spark, base), ["user_id"], [F.desc("ts"), F.desc("id")], 50)
    return d.select("id", "user_id", "model", "prompt_tokens", "completion_tokens", "status", "ts")


@query("j13_members", with_views("""SELECT u.user_id, u.email, n_name AS org_name FROM users_v u JOIN nation ON n_nationkey = org_id WHERE org_id IN (SELECT org_id FROM users_v WHERE plan = 'pro')""", "users_v"))
def j13(spark, base):
    """Members with their organisation, where the organisation has a paying member."""
    u = V.users(spark, base)
    allowed = u.filter("plan = 'pro'").select("org_id")
    return u.join(orgs(spark, base).select("org_id", "org_name"), "org_id").join(allowed, "org_id", "left_semi").select("user_id", "email", "org_name")


@query("j15_runs_per_parent", """SELECT o_custkey AS parent_id, o_orderkey AS run_id, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 20""")
def j15(spark, base):
    o = table(spark, base, "orders").select(F.col("o_custkey").alias("parent_id"), F.col("o_orderkey").alias("run_id"), epoch("o_orderdate").alias("ts"))
    return top_per_key(o, ["parent_id"], [F.desc("ts"), F.desc("run_id")], 20)


@query("j16_versions", """SELECT l_orderkey AS parent_id, CAST(max(l_linenumber) + 1 AS INTEGER) AS next_version, '{"part":' || CAST(min_by(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS VARCHAR) || ',"supp":' || CAST(min_by(l_suppkey, (l_linenumber, l_partkey, l_suppkey)) AS VARCHAR) || '}' AS restored FROM lineitem GROUP BY l_orderkey""")
def j16(spark, base):
    """Next version number, and the JSON of the first version to restore."""
    v = table(spark, base, "lineitem")
    body = F.to_json(F.struct(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")))
    return v.groupBy(F.col("l_orderkey").alias("parent_id")).agg(
        (F.max("l_linenumber") + 1).alias("next_version"), F.min_by(body, F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("restored"))


@query("j17_case_counts", with_views("SELECT chain_id, CAST(CASE WHEN k % 7 = 6 THEN 0 ELSE k % 7 END AS INTEGER) AS n_cases FROM scored_v", "scored_v"))
def j17(spark, base):
    s = V.scored(spark, base)
    n = F.col("k") % 7
    cases = F.when(n == 6, "not json").otherwise(F.to_json(F.array_repeat(F.struct(F.col("domain").alias("q")), n)))
    return s.select("chain_id", F.coalesce(F.json_array_length(cases), F.lit(0)).alias("n_cases"))


@query("j18_period_metrics", with_views(f"""SELECT count(*) AS total, count(CASE WHEN risk_score >= 0.95 THEN 1 END) AS aborted, count(CASE WHEN tier='LOW' THEN 1 END) AS "tier_LOW", count(CASE WHEN tier='MEDIUM' THEN 1 END) AS "tier_MEDIUM", count(CASE WHEN tier='HIGH' THEN 1 END) AS "tier_HIGH",
 round(avg(risk_score), 6) AS mean_risk, count(label) AS n_labeled, count(CASE WHEN label='incorrect' THEN 1 END) AS n_wrong_labeled, round(avg(CASE WHEN label='incorrect' THEN 1.0::DOUBLE WHEN label IS NOT NULL THEN 0.0::DOUBLE END), 6) AS label_error_rate
FROM scored_v s LEFT JOIN feedback_v f ON f.chain_id = s.chain_id WHERE ts >= {NOW_SQL} - 7 * 86400""", "feedback_v"))
def j18(spark, base):
    d = A.period_metrics(V.scored(spark, base), V.feedback(spark, base))
    return d.withColumns({c: F.round(c, 6) for c in ("mean_risk", "label_error_rate")})


@query("j19_pending_review", with_views("SELECT chain_id, round(risk_score, 6) AS risk_score, domain FROM scored_v WHERE needs_alert AND chain_id NOT IN (SELECT chain_id FROM feedback_v) ORDER BY scored_v.risk_score DESC, chain_id LIMIT 50", "feedback_v"))
def j19(spark, base):
    return A.pending_review(V.scored(spark, base), V.feedback(spark, base)).select("chain_id", "domain", *r6("risk_score"))


@query("j20_failure_counts", with_views("SELECT domain, coalesce(failure_mode, 'none') AS failure_mode, count(*) AS n FROM scored_v WHERE needs_alert GROUP BY ALL", "scored_v"))
def j20(spark, base):
    return V.scored(spark, base).filter("needs_alert").groupBy("domain", F.coalesce("failure_mode", F.lit("none")).alias("failure_mode")).agg(F.count(F.lit(1)).alias("n"))


V.cte("shift_v", f"""SELECT domain, avg(CASE WHEN age <= 604800 THEN risk_score END) AS current_mean, avg(CASE WHEN age > 604800 AND age <= 1209600 THEN risk_score END) AS previous_mean, count(CASE WHEN age <= 604800 THEN 1 END) AS n_current,
 count(CASE WHEN age > 604800 AND age <= 1209600 THEN 1 END) AS n_previous FROM (SELECT *, {NOW_SQL} - ts AS age FROM scored_v) GROUP BY domain""", "scored_v")


@query("j21_domain_status", with_views("""SELECT domain, chains, alerts, round(avg_risk, 6) AS avg_risk, round(last_auroc, 6) AS last_auroc, coalesce(abs(current_mean - previous_mean) > 0.01, false) AS drift
FROM (SELECT domain, count(*) AS chains, count(CASE WHEN needs_alert THEN 1 END) AS alerts, avg(risk_score) AS avg_risk, max_by(k / 100.0::DOUBLE, (ts, chain_id)) AS last_auroc FROM scored_v GROUP BY domain) JOIN shift_v USING (domain)""", "shift_v"))
def j21(spark, base):
    s = V.scored(spark, base)
    g = A.domain_rollup(s).select("domain", F.col("chain_count").alias("chains"), F.col("n_alerts").alias("alerts"), "avg_risk")
    cal = s.groupBy("domain").agg(F.max_by(F.col("k") / 100.0, F.struct("ts", "chain_id")).alias("last_auroc"))
    d = g.join(cal, "domain").join(A.mean_shift(s, cut=0.01).select("domain", "drift"), "domain")
    return d.select("domain", "chains", "alerts", "drift", *r6("avg_risk", "last_auroc"))


@query("j22_risk_window", with_views("SELECT chain_id, domain, ts, round(risk_score, 6) AS risk_score FROM scored_v WHERE ts >= 1705000000 AND ts < 1705600000", "scored_v"))
def j22(spark, base):
    return V.scored(spark, base).filter((F.col("ts") >= 1705000000) & (F.col("ts") < 1705600000)).select("chain_id", "domain", "ts", *r6("risk_score"))


@query("j23_dashboard_log", with_views("SELECT chain_id, domain, round(risk_score, 6) AS risk_score, tier, failure_mode FROM scored_v WHERE needs_alert AND domain ILIKE '%cl%' ORDER BY scored_v.risk_score DESC, ts DESC, chain_id LIMIT 50 OFFSET 50", "scored_v"))
def j23(spark, base):
    s = V.scored(spark, base).filter("needs_alert").filter(F.col("domain").ilike("%cl%"))
    return s.orderBy(F.desc("risk_score"), F.desc("ts"), F.asc("chain_id")).offset(50).limit(50).select("chain_id", "domain", "tier", "failure_mode", *r6("risk_score"))


@query("j24_audit_log", with_views("""SELECT rn AS position, chain_id AS id, CASE WHEN k % 10 = 0 THEN 'fallback' ELSE 'agent' || CAST(k AS VARCHAR) END AS from_agent, total FROM (SELECT *, row_number() OVER (ORDER BY ts, chain_id) AS rn FROM
 (SELECT *, count(*) OVER () AS total FROM scored_v ORDER BY ts DESC, chain_id DESC LIMIT 100))""", "scored_v"))
def j24(spark, base):
    s = V.scored(spark, base)
    payload = F.when(F.col("k") % 10 == 0, "broken").otherwise(F.to_json(F.struct(F.concat(F.lit("agent"), F.col("k").cast("string")).alias("from_agent"))))
    last = s.withColumn("payload_json", payload).orderBy(F.desc("ts"), F.desc("chain_id")).limit(100)
    total = s.agg(F.count(F.lit(1)).alias("total"))
    agent = F.coalesce(F.from_json("payload_json", "from_agent string")["from_agent"], F.lit("fallback"))
    return last.join(F.broadcast(total)).select(F.row_number().over(W.orderBy("ts", "chain_id")).cast("long").alias("position"),
                                                F.col("chain_id").alias("id"), agent.alias("from_agent"), "total")


@query("j25_org_running_cost", with_views("""SELECT org_id, day, round(sum(c) OVER (PARTITION BY org_id ORDER BY day), 4) AS running_cost FROM (SELECT org_id, ts // 86400 AS day, sum(cost) AS c FROM scored_v JOIN users_v USING (user_id) GROUP BY 1, 2)""", "users_v", "scored_v"))
def j25(spark, base):
    d = V.scored(spark, base).join(V.users(spark, base).select("user_id", "org_id"), "user_id")
    day = d.groupBy("org_id", F.floor(F.col("ts") / 86400).alias("day")).agg(F.sum("cost").alias("c"))
    return day.select("org_id", "day", F.round(F.sum("c").over(W.partitionBy("org_id").orderBy("day")), 4).alias("running_cost"))


# ---- K: envelopes -----------------------------------------------------------------------------------

SECRETS = {"planner": "alpha-secret", "searcher": "beta-secret", "writer": "gamma" * 20}


def scored_envelopes(spark, base):
    """Envelopes of the scored chains of the event table."""
    s = V.scored(spark, base)
    s = s.withColumns({"final_answer": F.concat(F.lit('é "a"\\ '), "domain", F.lit("\n"), F.col("k").cast("string")), "step_count": F.col("n_steps")})
    return K.envelopes(s, keep=("ts", "k"))


def signer():
    return F.when(F.col("chain_id") % 2 == 0, "planner").otherwise("writer")


def sql_jstr(e):
    """JSON string in ASCII, for texts of the basic plane."""
    ch = (r"""CASE WHEN x = '"' THEN '\"' WHEN x = '\' THEN '\\' WHEN x = chr(10) THEN '\n' WHEN unicode(x) BETWEEN 32 AND 126 THEN x ELSE printf('\u%04x', unicode(x)) END""")
    return f"""coalesce('"' || array_to_string(list_transform(string_split({e}, ''), lambda x: {ch}), '') || '"', 'null')"""


def sql_num(e):
    d = f"regexp_replace(CAST(CAST({e} AS DECIMAL(20,7)) AS VARCHAR), '0+$', '')"
    return f"(CASE WHEN ends_with({d}, '.') THEN {d} || '0' ELSE {d} END)"


def sql_blob(b):
    return "'" + "".join(f"\\x{c:02X}" for c in b) + "'::BLOB"


def sql_hmac(msg, secret):
    i, o = G.pads(secret)
    return f"sha256({sql_blob(o)} || unhex(sha256({sql_blob(i)} || encode({msg}))))"


V.cte("env_v", f"""SELECT chain_id, 'é "a"\\ ' || domain || chr(10) || CAST(k AS VARCHAR) AS answer, round(risk_score, 4) AS risk_score, tier AS confidence_tier, failure_mode, n_steps AS step_count, judge_label,
 {HINT_SQL} AS downstream_hint, tier = 'LOW' AS should_rewrite, ts + 0.25::DOUBLE AS issued_at, 300 AS ttl FROM scored_v""", "scored_v")
CANON_SQL = ("""'{"answer":' || """ + sql_jstr("answer") + """ || ',"confidence_tier":' || """ + sql_jstr("confidence_tier") + """ || ',"downstream_hint":' || """ + sql_jstr("downstream_hint")
             + """ || ',"failure_mode":' || """ + sql_jstr("failure_mode") + """ || ',"issued_at":' || """ + sql_num("issued_at") + """ || ',"judge_label":' || """ + sql_jstr("judge_label")
             + """ || ',"risk_score":' || """ + sql_num("risk_score") + """ || ',"should_rewrite":' || CAST(should_rewrite AS VARCHAR) || ',"step_count":' || CAST(step_count AS VARCHAR) || ',"ttl":' || CAST(ttl AS VARCHAR) || '}'""")
V.cte("signed_v", f"SELECT *, CASE WHEN chain_id % 2 = 0 THEN {sql_hmac('canon', SECRETS['planner'])} ELSE {sql_hmac('canon', SECRETS['writer'])} END AS sig FROM (SELECT *, {CANON_SQL} AS canon FROM env_v)", "env_v")


@query("k1_envelopes", with_views(f"""SELECT chain_id, final_answer AS answer, round(behaviour, 4) AS risk_score, {sql_tier('behaviour')} AS confidence_tier, guard_mode AS failure_mode, CAST(n_search AS INTEGER) AS step_count,
 CASE {sql_tier('behaviour')} WHEN 'HIGH' THEN 'proceed' WHEN 'MEDIUM' THEN 'proceed_with_caution' ELSE CASE WHEN guard_mode IN ('retrieval_fail','no_evidence','repeated_query') THEN 'rewrite_and_verify' ELSE 'rewrite_query' END END AS downstream_hint,
 behaviour >= 0.7 AS should_rewrite, round(sc3, 4) AS sc3 FROM nano_v""", "nano_v"))
def k1(spark, base):
    from plumbline.operators.scoring import chain_scores
    e = K.envelopes(chain_scores(V.steps(spark, base), V.chains(spark, base)), ("sc1", "sc2", "sc3", "sc5", "sc6", "sc11", "sc12"))
    return e.select("chain_id", "answer", "risk_score", "confidence_tier", "failure_mode", "step_count", "downstream_hint", "should_rewrite",
                    F.col("behavioral_components")["sc3"].alias("sc3"))


@query("k2_wire_round_trip", with_views("SELECT chain_id, answer, round(risk_score, 4) AS risk_score, confidence_tier, failure_mode, step_count, ttl, CAST(2 AS INTEGER) AS hops FROM env_v", "env_v"))
def k2(spark, base):
    """Envelopes that two agents have handed on."""
    d = K.from_wire(K.to_wire(hopped(spark, base)))
    return d.select("chain_id", "answer", "risk_score", "confidence_tier", "failure_mode", "step_count", "ttl", F.size("trust_chain").alias("hops"))


def signed(spark, base):
    e = scored_envelopes(spark, base).withColumn("signer", signer())
    return K.sign(e, G.key_table(spark, SECRETS), "signer", F.col("ts") + F.lit(0.25))


@query("k3_sign", with_views("SELECT chain_id, sig AS trust_signature FROM signed_v", "signed_v"))
def k3(spark, base):
    return signed(spark, base).select("chain_id", "trust_signature")


@query("k4_verify", with_views("""SELECT chain_id, chain_id % 5 <> 0 AND chain_id % 7 <> 0 AND (SELECT max(issued_at) FROM env_v) - issued_at <= 1000000 AS valid FROM signed_v""", "signed_v"))
def k4(spark, base):
    """Some risks tampered, some unsigned, old ones expired by their own signed life."""
    keys = G.key_table(spark, SECRETS)
    e = scored_envelopes(spark, base).withColumns({"signer": signer(), "ttl": F.lit(1_000_000)})
    d = K.sign(e, keys, "signer", F.col("ts") + F.lit(0.25))
    d = d.withColumns({"risk_score": F.when(F.col("chain_id") % 5 == 0, F.col("risk_score") + 0.5).otherwise(F.col("risk_score")),
                       "trust_signature": F.when(F.col("chain_id") % 7 != 0, F.col("trust_signature"))})
    now = V.scored(spark, base).agg((F.max("ts") + 0.25).alias("_now"))
    return K.verify(d.join(F.broadcast(now)), keys, "signer", F.col("_now")).select("chain_id", "valid")


def hopped(spark, base):
    keys = G.key_table(spark, SECRETS)
    e = scored_envelopes(spark, base)
    e = K.add_hop(e.withColumn("agent", F.lit("searcher")), keys, "agent", F.col("ts") + 0.5)
    return K.add_hop(e.withColumn("agent", F.lit("writer")), keys, "agent", F.col("ts") + 1.125, F.lit("card:w"))


def sql_hop_msg(agent, prev, ts):
    return f"""'{{"agent_id":"{agent}","prev_hash":"' || {prev} || '","risk_score":' || {sql_num('round(risk_score,4)')} || ',"timestamp":' || {sql_num(ts)} || '}}'"""


V.cte("hop_v", f"""SELECT *, {sql_hmac(sql_hop_msg('writer', 'p2', 'issued_at + 0.875'), SECRETS['writer'])} AS s2 FROM (SELECT *, sha256('[{{"agent_card_ref":null,"agent_id":"searcher","hop_signature":"' || s1 || '","risk_score":' || {sql_num('round(risk_score,4)')}
 || ',"timestamp":' || {sql_num('issued_at + 0.25')} || '}}]')[1:16] AS p2 FROM (SELECT *, {sql_hmac(sql_hop_msg('searcher', "sha256('[]')[1:16]", 'issued_at + 0.25'), SECRETS['searcher'])} AS s1 FROM env_v))""", "env_v")


@query("k5_hops", with_views("SELECT chain_id, s1, s2 FROM hop_v", "hop_v"))
def k5(spark, base):
    d = hopped(spark, base)
    sig = lambda i: F.element_at("trust_chain", i)["hop_signature"]
    return d.select("chain_id", sig(1).alias("s1"), sig(2).alias("s2"))


@query("k6_verify_hops", with_views("SELECT chain_id, k % 4 <> 1 AND k % 4 <> 2 AS chain_valid FROM scored_v", "scored_v"))
def k6(spark, base):
    """Tampered risk in one quarter, an unknown agent in another, no hops in a third."""
    d = hopped(spark, base)
    kk = F.col("k") % 4
    bent = F.transform("trust_chain", lambda h: F.when(kk == 1, h.withField("risk_score", h["risk_score"] + 0.5))
                       .when(kk == 2, h.withField("agent_id", F.lit("stranger"))).otherwise(h))
    d = d.withColumn("trust_chain", F.when(kk == 3, F.array().cast(f"array<{K.HOP}>")).otherwise(bent))
    return K.verify_chain(d, G.key_table(spark, SECRETS)).select("chain_id", "chain_valid")


@query("k7_handoff_audit", with_views("SELECT chain_id, 'searcher' AS from_agent, 'writer' AS to_agent, round(risk_score, 4) AS risk_score, CAST(2 AS INTEGER) AS chain_length FROM env_v", "env_v"))
def k7(spark, base):
    return K.handoffs(hopped(spark, base)).select("chain_id", "from_agent", "to_agent", "risk_score", "chain_length")
