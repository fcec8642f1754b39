"""Trace tables derived from the given tables, in Spark and as SQL for the comparison engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline import fixed
from plumbline.functions import risk as R, text as T
from plumbline.plans.registry import table
from plumbline.session import written_once
from plumbline.sources.formats import from_messages


def epoch(ts: str) -> Column:
    """Whole seconds since 1970, whatever the session time zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


# ---- chains and steps from conversations ----------------------------------------------------

def messages(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "conversations")
    return c.select(F.col("conv_id").alias("chain_id"), F.col("turn").alias("pos"), "role",
                    F.col("text").alias("content"))


def steps(spark: SparkSession, base: str) -> DataFrame:
    """Canonical steps, normalised once per application and stored; features read the stored form."""
    return written_once(spark, f"steps:{base}", lambda: normalised_steps(spark, base))


def normalised_steps(spark: SparkSession, base: str) -> DataFrame:
    """Conversations as search traces: the last step finishes, the others search."""
    s = from_messages(messages(spark, base))
    last = s.groupBy("chain_id").agg(F.max("step_idx").alias("_last"))
    s = s.join(last, "chain_id")
    arg = F.array_join(F.slice(T.white_words(F.col("thought")), 1, 3), " ")
    return s.select("chain_id", "step_idx", "thought",
                    F.when(F.col("step_idx") == F.col("_last"), "Finish").otherwise("Search").alias("action_type"),
                    arg.alias("action_arg"), "observation")


def chains(spark: SparkSession, base: str) -> DataFrame:
    m = messages(spark, base).groupBy("chain_id").agg(
        F.min_by("content", F.when(F.col("role") == "user", F.col("pos"))).alias("q"),
        F.max_by("content", F.when(F.col("role") == "assistant", F.col("pos"))).alias("a"))
    return m.select("chain_id", T.text("q").alias("question"), T.text("a").alias("final_answer"),
                    F.concat(F.lit("d"), (F.col("chain_id") % 5).cast("string")).alias("domain"),
                    (F.col("chain_id") % 7).alias("user_id"),
                    (F.lit(1704067200) + F.col("chain_id") * 3600).alias("ts"))


def labelled_chains(spark: SparkSession, base: str) -> DataFrame:
    lab = table(spark, base, "labels").select(F.col("doc_id").alias("chain_id"), (1 - F.col("quality")).alias("wrong"))
    return chains(spark, base).join(lab, "chain_id")


def agents(spark: SparkSession, base: str) -> DataFrame:
    """Assistant turns of one conversation as answers of competing agents."""
    m = messages(spark, base).filter(F.col("role") == "assistant")
    return m.select("chain_id", F.col("pos").alias("agent"), F.col("content").alias("answer"))


# ---- scored chains from events ---------------------------------------------------------------

def scored(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.select(F.col("event_id").alias("chain_id"), "user_id", F.col("event_type").alias("domain"),
                 epoch("ts").alias("ts"), "value", k.alias("k"))
    mode = (F.when(F.col("k") % 5 == 1, "retrieval_fail").when(F.col("k") % 5 == 2, "no_evidence")
            .when(F.col("k") % 5 == 3, "repeated_query").when(F.col("k") % 5 == 4, "long_chain"))
    label = (F.when(F.col("k") % 4 == 1, "LOCAL").when(F.col("k") % 4 == 2, "GOOD")
             .when(F.col("k") % 4 == 3, "POOR"))
    r = F.least(F.lit(1.0), F.col("value") / 50)
    return e.select("chain_id", "user_id", "domain", "ts", "k", "value", r.alias("risk_score"),
                    R.tier(r).alias("tier"), R.alert(r).alias("needs_alert"), mode.alias("failure_mode"),
                    label.alias("judge_label"), (F.col("k") % 10).alias("n_steps"),
                    F.when(label.isin("GOOD", "POOR"), fixed.JUDGE_CALL_COST).otherwise(0.0).alias("cost"),
                    F.when(F.col("k") + F.col("value") > 90, 1).otherwise(0).alias("wrong"))


def feedback_log(spark: SparkSession, base: str) -> DataFrame:
    """Every label ever submitted: line items as submissions on the chain with the order's number."""
    li = table(spark, base, "lineitem")
    return li.select(F.col("l_orderkey").alias("chain_id"),
                     F.when(F.col("l_returnflag") == "R", "incorrect").otherwise("correct").alias("label"),
                     epoch("l_shipdate").alias("fts"), F.col("l_linenumber").alias("line"),
                     F.col("l_partkey").alias("part"))


def feedback(spark: SparkSession, base: str) -> DataFrame:
    """Latest label per chain, by the chain's owner."""
    from plumbline.sources.store import latest_feedback
    own = scored(spark, base).select("chain_id", "user_id")
    log = feedback_log(spark, base).join(own, "chain_id")
    return latest_feedback(log, ["user_id", "chain_id"], ["fts", "line", "part", "label"]).select(
        "chain_id", "user_id", "label", "fts")


GUARDRAILS = [(1, "error", 0.90, "block", True), (2, "click", 0.95, "notify", False),
              (3, "*", 0.97, "page", True), (4, "click", 0.80, "notify", True),
              (5, "purchase", 0.75, "review", True), (6, "*", 0.85, "log", False)]


def guardrails(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GUARDRAILS, "rule_id int, rule_domain string, threshold double, action string, enabled boolean")


def users(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"),
                    F.concat(F.lower("c_name"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".org")).alias("email"),
                    F.when(F.col("c_mktsegment") == "BUILDING", "pro").otherwise("free").alias("plan"),
                    F.col("c_nationkey").alias("org_id"), F.col("c_acctbal").alias("acctbal"))


def proxy(spark: SparkSession, base: str) -> DataFrame:
    s = scored(spark, base)
    return s.select(F.col("chain_id").alias("id"), "user_id", (F.col("k") * 10).alias("prompt_tokens"),
                    (F.col("k") * 3).alias("completion_tokens"), (F.col("value") * 10).alias("latency_ms"),
                    "risk_score", F.when(F.col("domain") == "error", "error").otherwise("ok").alias("status"),
                    F.concat(F.lit("model_"), (F.col("k") % 3).cast("string")).alias("model"), "ts")


def vectors(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


# ---- the same in SQL ---------------------------------------------------------------------------

def sql_list(words) -> str:
    return "(" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def sql_tokens(e: str, stop=fixed.NANO_STOP) -> str:
    keep = f" AND x NOT IN {sql_list(stop)}" if stop else ""
    return f"list_distinct(list_filter(regexp_extract_all(lower({e}), '[a-z]+'), lambda x: length(x) > 1{keep}))"


def sql_caps(e: str) -> str:
    return f"list_distinct(regexp_extract_all({e}, '[A-Z][a-zA-Z]+'))"


def sql_words(e: str) -> str:
    return rf"regexp_extract_all({e}, '\S+')"


def sql_wset(e: str) -> str:
    return f"list_distinct({sql_words(f'lower({e})')})"


def sql_shared(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def sql_jac(a: str, b: str) -> str:
    return f"({sql_shared(a, b)}::DOUBLE / greatest(len(list_distinct(list_concat({a}, {b}))), 1))"


def sql_f1(a: str, b: str) -> str:
    i = sql_shared(a, b)
    return f"(CASE WHEN {i} > 0 THEN 2.0::DOUBLE * {i} / (len({a}) + len({b})) ELSE 0.0::DOUBLE END)"


def sql_tier(r: str) -> str:
    return f"CASE WHEN {r} < 0.5 THEN 'HIGH' WHEN {r} < 0.7 THEN 'MEDIUM' ELSE 'LOW' END"


HEDGE_SQL = r"'(?i)\b(?:" + "|".join(h.replace("'", "''") for h in fixed.HEDGES) + r")\b'"

_CTE: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    _CTE[name] = (body.strip(), needs)


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the named views and all they need."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in _CTE[n][1]:
            visit(d)
        order.append(n)
    for n in names:
        visit(n)
    body = body.strip()
    glue = "" if body.startswith(",") else "\n"
    return "WITH " + ",\n".join(f"{n} AS ({_CTE[n][0]})" for n in order) + glue + body


cte("isl", """SELECT conv_id, turn, role, coalesce(text,'') AS text,
 SUM(CASE WHEN role='assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS sid FROM conversations""")
cte("raw_steps", """SELECT conv_id AS chain_id, CAST(sid - 1 AS BIGINT) AS step_idx,
 max(CASE WHEN role='assistant' THEN text END) AS thought,
 coalesce(string_agg(CASE WHEN role IN ('user','tool') THEN text END, ' ' ORDER BY turn), '') AS observation
 FROM isl WHERE sid > 0 GROUP BY conv_id, sid
 UNION ALL
 SELECT conv_id, CAST(0 AS BIGINT), min_by(text, turn), '' FROM isl GROUP BY conv_id HAVING max(sid) = 0""", "isl")
cte("steps_v", rf"""SELECT chain_id, step_idx, thought,
 CASE WHEN step_idx = max(step_idx) OVER (PARTITION BY chain_id) THEN 'Finish' ELSE 'Search' END AS action_type,
 array_to_string(list_slice({sql_words('thought')}, 1, 3), ' ') AS action_arg, observation FROM raw_steps""", "raw_steps")
cte("chains_v", """SELECT conv_id AS chain_id, coalesce(min_by(text, turn) FILTER (WHERE role='user'), '') AS question,
 coalesce(max_by(text, turn) FILTER (WHERE role='assistant'), '') AS final_answer,
 'd' || CAST(conv_id % 5 AS VARCHAR) AS domain, conv_id % 7 AS user_id, 1704067200 + conv_id * 3600 AS ts
 FROM conversations GROUP BY conv_id""")
cte("labelled_v", "SELECT c.*, 1 - l.quality AS wrong FROM chains_v c JOIN labels l ON l.doc_id = c.chain_id", "chains_v")
cte("agents_v", "SELECT conv_id AS chain_id, turn AS agent, text AS answer FROM conversations WHERE role='assistant'")
cte("ev", """SELECT event_id AS chain_id, user_id, event_type AS domain, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value,
 CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
cte("scored_v", f"""SELECT chain_id, user_id, domain, ts, k, value, r AS risk_score, {sql_tier('r')} AS tier, r >= 0.7 AS needs_alert,
 CASE k % 5 WHEN 1 THEN 'retrieval_fail' WHEN 2 THEN 'no_evidence' WHEN 3 THEN 'repeated_query' WHEN 4 THEN 'long_chain' END AS failure_mode,
 CASE k % 4 WHEN 1 THEN 'LOCAL' WHEN 2 THEN 'GOOD' WHEN 3 THEN 'POOR' END AS judge_label, k % 10 AS n_steps,
 CASE WHEN k % 4 IN (2,3) THEN 0.007::DOUBLE ELSE 0.0::DOUBLE END AS cost, CASE WHEN k + value > 90 THEN 1 ELSE 0 END AS wrong
 FROM (SELECT *, least(1.0::DOUBLE, value / 50) AS r FROM ev)""", "ev")
cte("feedback_log_v", """SELECT l_orderkey AS chain_id, CASE WHEN l_returnflag='R' THEN 'incorrect' ELSE 'correct' END AS label,
 CAST(floor(epoch(l_shipdate)) AS BIGINT) AS fts, l_linenumber AS line, l_partkey AS part FROM lineitem""")
cte("feedback_v", """SELECT chain_id, user_id, label, fts FROM (SELECT f.*, s.user_id, row_number() OVER
 (PARTITION BY s.user_id, f.chain_id ORDER BY fts DESC, line DESC, part DESC, label DESC) AS rn
 FROM feedback_log_v f JOIN scored_v s USING (chain_id)) WHERE rn = 1""", "feedback_log_v", "scored_v")
cte("guardrails_v", "SELECT * FROM (VALUES " + ",".join(
    f"({i},'{d}',{t}::DOUBLE,'{a}',{str(e).lower()})" for i, d, t, a, e in GUARDRAILS)
    + ") AS g(rule_id, rule_domain, threshold, action, enabled)")
cte("users_v", """SELECT c_custkey AS user_id, c_name AS name, lower(c_name) || '@' || lower(c_mktsegment) || '.org' AS email,
 CASE WHEN c_mktsegment='BUILDING' THEN 'pro' ELSE 'free' END AS plan, c_nationkey AS org_id, c_acctbal AS acctbal FROM customer""")
cte("proxy_v", """SELECT chain_id AS id, user_id, k*10 AS prompt_tokens, k*3 AS completion_tokens, value*10 AS latency_ms, risk_score,
 CASE WHEN domain='error' THEN 'error' ELSE 'ok' END AS status, 'model_' || CAST(k % 3 AS VARCHAR) AS model, ts FROM scored_v""", "scored_v")
cte("vec_v", "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings")

# behavioural signals
cte("so_base", f"""SELECT s.*, lag(thought) OVER w AS prev_thought, lag(action_type) OVER w AS prev_action,
 {sql_tokens('thought')} AS tt, {sql_tokens('observation')} AS ot,
 {sql_tokens("coalesce(lag(thought) OVER w, '')")} AS pt FROM steps_v s WINDOW w AS (PARTITION BY chain_id ORDER BY step_idx)""", "steps_v")
cte("so", f"""SELECT *, thought <> '' AND observation <> '' AS filled, {sql_shared('tt','ot')} AS i,
 len(list_distinct(list_concat(tt, ot))) AS u, {sql_shared('pt','tt')} AS pi, len(list_distinct(list_concat(pt, tt))) AS pu FROM so_base""", "so_base")
cte("so_m", f"""SELECT chain_id, count(*) AS n, avg(CASE WHEN filled AND u > 0 THEN i::DOUBLE / u END) AS gap_avg,
 avg(CASE WHEN filled THEN i::DOUBLE / greatest(len(ot),1) END) AS used_avg,
 avg(CASE WHEN prev_thought IS NOT NULL AND pu > 0 THEN pi::DOUBLE / pu END) AS coh_avg,
 coalesce(sum(CASE WHEN thought <> '' THEN len({sql_words('thought')}) END), 0) AS th_words, count(CASE WHEN thought <> '' THEN 1 END) AS th_n,
 string_agg(observation, ' ' ORDER BY step_idx) AS obs_all,
 count(CASE WHEN filled THEN 1 END) AS risk_n,
 min_by(1 - i::DOUBLE / greatest(u,1), step_idx) FILTER (WHERE filled) AS risk_first,
 max_by(1 - i::DOUBLE / greatest(u,1), step_idx) FILTER (WHERE filled) AS risk_last,
 count(DISTINCT action_type) AS d_action, count(CASE WHEN action_type='Search' THEN 1 END) AS n_search,
 count(CASE WHEN action_type='Search' THEN 1 END) AS c_query,
 count(DISTINCT CASE WHEN action_type='Search' THEN trim(lower(action_arg)) END) AS d_query,
 count(CASE WHEN lower(action_type) <> 'finish' THEN 1 END) AS n_open,
 count(DISTINCT CASE WHEN lower(action_type) <> 'finish' THEN action_arg END) AS d_open,
 bool_or(regexp_matches(thought, {HEDGE_SQL})) AS hedged FROM so GROUP BY chain_id""", "so")
cte("nano_t", f"""SELECT c.*, coalesce(n,0) AS n, gap_avg, used_avg, coh_avg, coalesce(th_words,0) AS th_words, coalesce(th_n,0) AS th_n,
 coalesce(obs_all,'') AS obs_all, coalesce(risk_n,0) AS risk_n, risk_first, risk_last, coalesce(d_action,0) AS d_action, coalesce(n_search,0) AS n_search,
 coalesce(c_query,0) AS c_query, coalesce(d_query,0) AS d_query, coalesce(n_open,0) AS n_open, coalesce(d_open,0) AS d_open, coalesce(hedged,false) AS hedged,
 {sql_tokens('final_answer')} AS ft, {sql_tokens('question')} AS qt, {sql_tokens("coalesce(obs_all,'')")} AS oat
 FROM chains_v c LEFT JOIN so_m USING (chain_id)""", "chains_v", "so_m")
cte("nano_s", f"""SELECT *, 1.0 - d_action::DOUBLE / greatest(n,1) AS sc1, least(n / 10.0::DOUBLE, 1.0) AS sc2, 1.0 - coalesce(gap_avg, 0.5::DOUBLE) AS sc3,
 least(th_words::DOUBLE / (50 * greatest(th_n,1)), 1.0) AS sc5,
 CASE WHEN final_answer <> '' AND obs_all <> '' THEN 1.0 - {sql_shared('ft','oat')}::DOUBLE / greatest(len(ft),1) ELSE 0.5::DOUBLE END AS sc6,
 1.0 - {sql_jac('qt','ft')} AS sc11,
 CASE WHEN n >= 3 THEN coalesce(used_avg, 0.5::DOUBLE) END AS sc9, CASE WHEN n >= 3 THEN coalesce(coh_avg, 0.5::DOUBLE) END AS sc10,
 CASE WHEN n >= 3 AND risk_n >= 3 THEN tanh(5 * (risk_last - risk_first) / greatest(n-1,1)) * 0.5 + 0.5 END AS sc12 FROM nano_t""", "nano_t")
NANO_MEAN_SQL = """(sc1 + sc2 + sc3 + sc5 + sc6 + sc11*1.2 + CASE WHEN sc9 IS NULL THEN 0 ELSE sc9*1.3 + sc10*1.3 END + CASE WHEN sc12 IS NULL THEN 0 ELSE sc12*0.8 END)
 / (6.2::DOUBLE + CASE WHEN sc9 IS NULL THEN 0 ELSE 2.6 END + CASE WHEN sc12 IS NULL THEN 0 ELSE 0.8 END)"""
cte("nano_b", f"SELECT *, CAST({NANO_MEAN_SQL} AS DOUBLE) AS behaviour FROM nano_s", "nano_s")
NANO_MODE_SQL = f"""CASE WHEN len(oat) < 5 AND n > 1 THEN 'retrieval_fail'
 WHEN final_answer <> '' AND obs_all <> '' AND {sql_shared('ft','oat')} = 0 THEN 'no_evidence'
 WHEN c_query >= 2 AND d_query < c_query * 0.7 THEN 'repeated_query' WHEN n >= 7 THEN 'long_chain' END"""
CONFIDENT_SQL = "(n_open <= 2 AND NOT hedged AND n_open <= d_open)"
cte("nano_v", f"""SELECT *, {NANO_MODE_SQL} AS nano_mode,
 CASE WHEN {CONFIDENT_SQL} THEN 'confident_wrong' ELSE {NANO_MODE_SQL} END AS guard_mode FROM nano_b""", "nano_b")
