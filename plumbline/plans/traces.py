"""Queries: trace formats, text functions, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions import risk as R, text as T
from plumbline.operators import extend, failure as X, features as D, scoring as Z
from plumbline.plans import views as V
from plumbline.plans.registry import query, table
from plumbline.sources import formats as S
from plumbline.plans.views import (HEDGE_SQL, sql_caps, sql_f1, sql_jac, sql_shared, sql_tier, sql_tokens, sql_words,
                                   sql_wset, with_views)


def r6(*names):
    return [F.round(F.col(n), 6).alias(n) for n in names]


def q6(*names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query("d1_nano_score", with_views(
    f"SELECT chain_id, n, {q6(*D.NANO_COLUMNS)} FROM nano_v", "nano_v"))
def d1(spark, base):
    d = D.nano_signals(V.steps(spark, base), V.chains(spark, base), ("action", "answer_hit"))
    return d.select("chain_id", "n", *r6(*D.NANO_COLUMNS))


@query("f5_nano_chain_score", with_views(f"""
SELECT domain, count(*) AS n_chains, count(CASE WHEN behaviour >= 0.7 THEN 1 END) AS n_alerts, round(avg(behaviour), 6) AS mean_risk,
 count(CASE WHEN nano_mode IS NOT NULL THEN 1 END) AS n_modes FROM nano_v GROUP BY domain""", "nano_v"))
def f5(spark, base):
    d = D.nano_signals(V.steps(spark, base), V.chains(spark, base)).withColumn("mode", X.nano_mode())
    return d.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_chains"), F.count_if(R.alert(F.col("behaviour"))).alias("n_alerts"),
        F.round(F.avg("behaviour"), 6).alias("mean_risk"), F.count("mode").alias("n_modes"))


@query("f5_judge_blend", with_views(f"""
, j AS (SELECT *, chain_id % 4 <> 0 AS has, greatest(0.0, least(1.0, (20 - (1 + chain_id % 5 + 3 + 2 + 3)) / 16.0::DOUBLE + 0.1::DOUBLE)) AS judge FROM nano_v),
r AS (SELECT *, CASE WHEN NOT has THEN behaviour WHEN chain_id % 4 = 1 THEN 0.25 * behaviour + 0.75 * 0.5::DOUBLE ELSE 0.25 * behaviour + 0.75 * judge END AS risk FROM j)
SELECT chain_id, round(risk, 6) AS risk_score, {sql_tier('risk')} AS tier, risk >= 0.7 AS needs_alert, nano_mode AS failure_mode, CASE WHEN chain_id % 4 > 1 THEN 'POOR' END AS judge_label FROM r""", "nano_v"))
def f5_judge(spark, base):
    """Replies for three of four chains, one of which is not readable."""
    k = F.col("chain_id")
    body = F.to_json(F.struct((1 + k % 5).alias("step_relevance"), F.lit(2).alias("conclusion_support"), F.array(F.lit("no_evidence")).alias("failure_flags"), F.lit("POOR").alias("quality_label")))
    raw = F.when(k % 4 == 1, "no rating").when(k % 4 > 1, F.concat(F.lit("My rating: "), body))
    d = Z.nano_scores(V.steps(spark, base), V.chains(spark, base), raw)
    return d.select("chain_id", "tier", "needs_alert", "failure_mode", "judge_label", *r6("risk_score"))


# ---- A/B: formats ---------------------------------------------------------------------------

STEP_OUT = ["chain_id", "step_idx", "thought", "action_type", "action_arg", "observation"]


@query("b1_format_detection", """
SELECT conv_id AS chain_id, CASE conv_id % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'autogen' WHEN 2 THEN 'langchain' ELSE 'react' END AS format
FROM conversations GROUP BY conv_id""")
def b1(spark, base):
    m = V.messages(spark, base)
    on = lambda i, c: F.when(F.col("chain_id") % 4 == i, F.col(c))
    raw = m.select("chain_id", "pos", on(0, "role").alias("role"), on(1, "role").alias("sender"),
                   on(2, "role").alias("tool"), on(2, "content").alias("log"),
                   F.lit(None).cast("string").alias("tool_input"))
    return S.chain_formats(raw, ["role", "sender", "tool", "tool_input", "log"])


@query("b2_react_aliases", rf"""
SELECT conv_id AS chain_id, turn AS step_idx, text AS thought, CASE WHEN turn % 3 = 0 THEN 'Action' ELSE role END AS action_type,
 CASE WHEN conv_id % 2 = 0 THEN '' ELSE array_to_string(list_slice({sql_words('text')}, 1, 3), ' ') END AS action_arg,
 CASE WHEN turn % 2 = 0 THEN text ELSE '' END AS observation FROM conversations""")
def b2(spark, base):
    even = F.col("chain_id") % 2 == 0
    raw = V.messages(spark, base).select(
        "chain_id", "pos", F.when(even, F.col("content")).alias("thought"), F.when(~even, F.col("content")).alias("thinking"),
        F.when(F.col("pos") % 3 == 0, "").alias("action_type"), F.col("role").alias("action"),
        F.when(even, "").alias("action_arg"),
        F.array_join(F.slice(T.white_words(F.col("content")), 1, 3), " ").alias("query"),
        F.when(F.col("pos") % 2 == 0, F.col("content")).alias("output"))
    return S.from_react(raw)


@query("b3_message_islands", with_views(
    "SELECT chain_id, step_idx, thought, 'Action' AS action_type, '' AS action_arg, observation FROM raw_steps", "raw_steps"))
def b3(spark, base):
    return S.from_messages(V.messages(spark, base)).select(*STEP_OUT)


@query("b4_tool_call_argument", """
SELECT event_id AS chain_id, CASE CAST(json_extract_string(props,'$.k') AS INT) % 3 WHEN 0 THEN event_type WHEN 1 THEN event_type || '?' ELSE props END AS arg
FROM events""")
def b4(spark, base):
    e = table(spark, base, "events")
    k = F.get_json_object("props", "$.k").cast("int") % 3
    obj = lambda name, v: F.to_json(F.struct(v.alias(name)))
    args = (F.when(k == 0, obj("query", F.col("event_type")))
            .when(k == 1, obj("input", F.concat("event_type", F.lit("?")))).otherwise(F.col("props")))
    return e.select(F.col("event_id").alias("chain_id"), S.call_argument(args).alias("arg"))


REACT_TEXT_SQL = rf"'Thought: ' || text || chr(10) || 'Action: Search' || chr(10) || 'Action Input: ' || array_to_string(list_slice({sql_words('text')}, 1, 3), ' ')"


def react_text(c):
    return F.concat(F.lit("Thought: "), c, F.lit("\nAction: Search\nAction Input: "),
                    F.array_join(F.slice(T.white_words(c), 1, 3), " "))


@query("b5_autogen_messages", rf"""
WITH m AS (SELECT conv_id, turn, role, CASE WHEN role='assistant' THEN {REACT_TEXT_SQL} ELSE text END AS content, text,
 lead(role) OVER w AS n_role, lead(text) OVER w AS n_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id AS chain_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step_idx, trim(text, ' ' || chr(10)) AS thought,
 CASE WHEN role='assistant' THEN 'Search' ELSE 'Action' END AS action_type,
 CASE WHEN role='assistant' THEN array_to_string(list_slice({sql_words('text')}, 1, 3), ' ') ELSE '' END AS action_arg,
 CASE WHEN n_role = 'user' THEN n_text ELSE '' END AS observation FROM m WHERE role <> 'user'""")
def b5(spark, base):
    m = V.messages(spark, base)
    agent = F.col("role") == "assistant"
    raw = m.select("chain_id", "pos", "role", F.when(agent, "planner").otherwise(F.col("role")).alias("sender"),
                   F.when(agent, react_text(F.col("content"))).otherwise(F.col("content")).alias("content"))
    return S.from_autogen(raw).select(*STEP_OUT)


@query("b6_langchain_actions", r"""
SELECT conv_id AS chain_id, turn AS step_idx, text AS thought, CASE WHEN turn % 2 = 0 THEN role ELSE 'Tool' END AS action_type,
 CAST(turn AS VARCHAR) AS action_arg, CASE WHEN conv_id % 2 = 0 THEN role ELSE '' END AS observation FROM conversations""")
def b6(spark, base):
    m = V.messages(spark, base)
    odd = F.col("pos") % 2 == 1
    raw = m.select("chain_id", "pos", F.when(odd, F.col("content")).alias("log"), F.when(~odd, F.col("content")).alias("thought"),
                   F.when(~odd, F.col("role")).alias("tool"), F.col("pos").cast("string").alias("tool_input"),
                   F.when(F.col("chain_id") % 2 == 0, F.col("role")).alias("observation"))
    return S.from_langchain(raw)


@query("b7_content_blocks", "SELECT conv_id AS chain_id, turn AS pos, text || ' ' || role AS content FROM conversations")
def b7(spark, base):
    m = V.messages(spark, base)
    block = F.to_json(F.struct(F.lit("text").alias("type"), F.col("content").alias("text")))
    raw = F.concat(F.lit("["), block, F.lit(', "'), F.col("role"), F.lit('"]'))
    return m.select("chain_id", "pos", S.content_text(raw).alias("content"))


@query("b8_react_text", rf"""
SELECT conv_id AS chain_id, turn AS pos, trim(text, ' ' || chr(10)) AS thought, 'Search' AS action_type,
 array_to_string(list_slice({sql_words('text')}, 1, 3), ' ') AS action_arg FROM conversations""")
def b8(spark, base):
    th, ac, ai = S.parse_react_text(react_text(F.col("content")))
    return V.messages(spark, base).select("chain_id", "pos", th.alias("thought"), ac.alias("action_type"), ai.alias("action_arg"))


@query("b9_lenient_steps", """
SELECT conv_id AS chain_id, turn AS step_idx, text AS thought, CASE WHEN turn % 2 = 0 THEN role ELSE 'Lookup' END AS action_type,
 CASE WHEN turn % 2 = 0 THEN role ELSE 'Lookup' END AS action_arg, '' AS observation FROM conversations""")
def b9(spark, base):
    even = F.col("pos") % 2 == 0
    raw = V.messages(spark, base).select(
        "chain_id", "pos", F.col("content").alias("thought"), F.when(even, "").otherwise("Lookup").alias("action_type"),
        F.when(even, "").otherwise("Lookup").alias("action_arg"), F.col("role").alias("action"),
        F.lit(None).cast("string").alias("observation"))
    return S.lenient(raw)


@query("b10_callback_events", rf"""
WITH m AS (SELECT conv_id, turn, text, CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN 'finish' WHEN role='assistant' THEN 'action'
 WHEN role='system' THEN 'tool_error' ELSE 'tool_end' END AS kind FROM conversations),
n AS (SELECT *, lag(kind) OVER w AS pk, lag(text) OVER w AS pt FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id AS chain_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step_idx,
 CASE WHEN kind <> 'finish' AND pk = 'action' THEN trim(split_part(pt, chr(10), 1)) ELSE '' END AS thought,
 CASE WHEN kind='finish' THEN 'Finish' ELSE 'Search' END AS action_type,
 CASE WHEN kind='finish' THEN text[1:300] WHEN pk='action' THEN array_to_string(list_slice({sql_words('pt')}, 1, 3), ' ') ELSE '' END AS action_arg,
 CASE WHEN kind='finish' THEN '' WHEN kind='tool_error' THEN '[TOOL ERROR] ' || text ELSE text[1:500] END AS observation FROM n WHERE kind <> 'action'""")
def b10(spark, base):
    m = V.messages(spark, base)
    last = m.groupBy("chain_id").agg(F.max("pos").alias("_last"))
    kind = (F.when(F.col("pos") == F.col("_last"), "finish").when(F.col("role") == "assistant", "action")
            .when(F.col("role") == "system", "tool_error").otherwise("tool_end"))
    c = F.col("content")
    ev = m.join(last, "chain_id").select(
        "chain_id", "pos", kind.alias("kind"), F.concat(F.lit("Plan\nThought: "), c, F.lit("\nAction: Search")).alias("log"),
        F.lit("Search").alias("tool"),
        F.to_json(F.struct(F.array_join(F.slice(T.white_words(c), 1, 3), " ").alias("query"))).alias("tool_input"), c.alias("output"))
    return S.from_events(ev).select(*STEP_OUT)


@query("b11_crew_steps", with_views("""
SELECT chain_id, step_idx, thought[1:300] AS thought, action_type, action_arg[1:300] AS action_arg, observation[1:500] AS observation FROM steps_v
UNION ALL SELECT doc_id, 0, '', 'Finish', 'quality ' || CAST(quality AS VARCHAR), '' FROM labels WHERE doc_id NOT IN (SELECT chain_id FROM steps_v)""", "steps_v"))
def b11(spark, base):
    s = V.steps(spark, base).select("chain_id", F.col("step_idx").alias("pos"), "thought", F.col("action_type").alias("tool"),
                                    F.col("action_arg").alias("tool_input"), F.col("observation").alias("result"))
    tasks = table(spark, base, "labels").select(F.col("doc_id").alias("chain_id"),
                                                F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("raw"))
    return S.from_crew(s, tasks).select(*STEP_OUT)


@query("b12_run_records", with_views("""
SELECT chain_id, step_idx, thought, action_type, action_arg, observation[1:500] AS observation FROM steps_v
UNION ALL SELECT c.chain_id, n, '', 'Finish', final_answer[1:300], '' FROM chains_v c JOIN (SELECT chain_id, count(*) AS n FROM steps_v GROUP BY 1) USING (chain_id)
WHERE final_answer <> ''""", "steps_v", "chains_v"))
def b12(spark, base):
    s = V.steps(spark, base).groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct(
        "step_idx", "thought", "action_type", "action_arg", "observation"))).alias("s"))
    runs = V.chains(spark, base).join(s.select("chain_id", F.to_json("s").alias("steps_json")), "chain_id")
    return S.from_run_records(runs).select(*STEP_OUT)


@query("b13_argument_rename", with_views("SELECT chain_id, step_idx, action_arg AS action_args FROM steps_v", "steps_v"))
def b13(spark, base):
    return V.steps(spark, base).withColumnRenamed("action_arg", "action_args").select("chain_id", "step_idx", "action_args")


@query("b14_validity_flags", with_views(r"""
SELECT chain_id, false AS foreign_format, count(CASE WHEN lower(action_type) NOT IN ('finish','final') THEN 1 END) < 2 AS short_chain,
 count(CASE WHEN trim(observation, ' ' || chr(10)) = '' THEN 1 END)::DOUBLE / count(*) > 0.5 AS sparse_observations,
 length(regexp_replace(string_agg(thought || ' ' || observation, ' '), '[\x00-\x7F]', '', 'g'))::DOUBLE / length(string_agg(thought || ' ' || observation, ' ')) > 0.15 AS non_english
FROM steps_v GROUP BY chain_id""", "steps_v"))
def b14(spark, base):
    return S.validity_flags(V.steps(spark, base))


@query("b15_coverage_report", with_views("""
SELECT *, n_search_steps < 2 AS warn_short, obs_fill_rate < 0.5 AS warn_sparse FROM (SELECT chain_id, count(*) AS n_steps,
 count(CASE WHEN lower(action_type) <> 'finish' THEN 1 END) AS n_search_steps, count(CASE WHEN lower(action_type) = 'finish' THEN 1 END) AS n_finish_steps,
 round(avg(CASE WHEN trim(observation, ' ' || chr(10)) <> '' THEN 1.0::DOUBLE ELSE 0 END), 6) AS obs_fill_rate,
 round(avg(length(thought)), 6) AS avg_thought_len, round(avg(length(observation)), 6) AS avg_obs_len FROM steps_v GROUP BY chain_id)""", "steps_v"))
def b15(spark, base):
    d = S.coverage_report(V.steps(spark, base))
    return d.withColumns({c: F.round(c, 6) for c in ("obs_fill_rate", "avg_thought_len", "avg_obs_len")})


@query("b16_judge_prompt", with_views(r"""
SELECT chain_id, string_agg('Step ' || CAST(step_idx + 1 AS VARCHAR) || ': ' || trim(thought, ' ' || chr(10))[1:300] || chr(10) || '  Action: ' || action_type
 || '[' || action_arg[1:200] || ']' || chr(10) || '  Result: ' || trim(observation, ' ' || chr(10))[1:300], chr(10) ORDER BY step_idx) AS prompt
FROM steps_v GROUP BY chain_id""", "steps_v"))
def b16(spark, base):
    return S.judge_prompt(V.steps(spark, base))


# ---- C: text functions over whole documents --------------------------------------------------

def _set_digest(c):
    return F.md5(F.array_join(F.array_sort(c), " "))


def _sql_digest(e):
    return f"md5(array_to_string(list_sort({e}), ' '))"


@query("c1_content_tokens", f"SELECT doc_id, len({sql_tokens('text')}) AS n, {_sql_digest(sql_tokens('text'))} AS digest FROM documents")
def c1(spark, base):
    t = table(spark, base, "documents").select("doc_id", T.content_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), _set_digest(F.col("t")).alias("digest"))


@query("c2_stop_list_variants", f"""SELECT doc_id, len({sql_tokens('text', fixed.MESH_STOP)}) AS mesh_n, len({sql_tokens('text', fixed.STEP_STOP)}) AS step_n,
 len({sql_tokens('text', [])}) AS plain_n FROM documents""")
def c2(spark, base):
    t = F.col("text")
    return table(spark, base, "documents").select("doc_id", *[
        F.size(T.content_tokens(t, stop)).cast("long").alias(n) for n, stop in
        (("mesh_n", fixed.MESH_STOP), ("step_n", fixed.STEP_STOP), ("plain_n", fixed.NO_STOP))])


@query("c3_capitalised_tokens", f"SELECT doc_id, len({sql_caps('text')}) AS n, {_sql_digest(sql_caps('text'))} AS digest FROM documents")
def c3(spark, base):
    t = table(spark, base, "documents").select("doc_id", T.capitalised_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), _set_digest(F.col("t")).alias("digest"))


@query("c4_token_f1", with_views(
    f"SELECT chain_id, round({sql_f1(sql_tokens('question'), sql_tokens('final_answer'))}, 6) AS f1 FROM chains_v", "chains_v"))
def c4(spark, base):
    f1 = T.token_f1(T.content_tokens(F.col("question")), T.content_tokens(F.col("final_answer")))
    return V.chains(spark, base).select("chain_id", F.round(f1, 6).alias("f1"))


@query("c5_content_jaccard", with_views(
    f"SELECT chain_id, step_idx, round({sql_jac(sql_tokens('thought', fixed.STEP_STOP), sql_tokens('observation', fixed.STEP_STOP))}, 6) AS jaccard FROM steps_v", "steps_v"))
def c5(spark, base):
    jac = T.jaccard(*[T.content_tokens(F.col(c), fixed.STEP_STOP) for c in ("thought", "observation")])
    return V.steps(spark, base).select("chain_id", "step_idx", F.round(jac, 6).alias("jaccard"))


@query("c6_white_space_jaccard", with_views(
    f"SELECT chain_id, step_idx, round({sql_jac(sql_wset('thought'), sql_wset('observation'))}, 6) AS jaccard FROM steps_v", "steps_v"))
def c6(spark, base):
    jac = T.jaccard(T.white_tokens(F.col("thought")), T.white_tokens(F.col("observation")))
    return V.steps(spark, base).select("chain_id", "step_idx", F.round(jac, 6).alias("jaccard"))


@query("c7_hedges", rf"""SELECT doc_id, regexp_matches(text, {HEDGE_SQL}) AS hedged, len(regexp_extract_all(text, {HEDGE_SQL})) AS n,
 round(least(len(regexp_extract_all(text, {HEDGE_SQL})) / (greatest(len({sql_words('text')}), 1) / 10.0::DOUBLE + 1e-6), 1.0), 6) AS density FROM documents""")
def c7(spark, base):
    t = F.col("text")
    return table(spark, base, "documents").select("doc_id", T.has_hedge(t).alias("hedged"), T.hedge_count(t).cast("long").alias("n"),
                                                  F.round(T.hedge_density(t), 6).alias("density"))


@query("c8_word_count", f"SELECT doc_id, len({sql_words('text')}) AS n FROM documents")
def c8(spark, base):
    return table(spark, base, "documents").select("doc_id", T.word_count(F.col("text")).cast("long").alias("n"))


FACTOID_SQL = " OR ".join(f"starts_with(trim(lower(text), ' ' || chr(10)), '{p}')" for p in fixed.FACTOID_PREFIXES)


@query("c9_factoid_flags", f"""SELECT doc_id, ({FACTOID_SQL}) AS factoid,
 CASE WHEN ({FACTOID_SQL}) AND len({sql_words('text')}) > 8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS long_answer FROM documents""")
def c9(spark, base):
    t = F.col("text")
    return table(spark, base, "documents").select("doc_id", T.is_factoid(t).alias("factoid"), T.long_factoid_answer(t, t).alias("long_answer"))


@query("c10_safe_names", r"SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}_-]', '_', 'g') AS safe FROM pages")
def c10(spark, base):
    return table(spark, base, "pages").select("page_id", T.safe_name(F.col("url")).alias("safe"))


@query("c11_marked_answers", "SELECT event_id, CAST(value AS VARCHAR) AS answer, props AS tail FROM events")
def c11(spark, base):
    e = table(spark, base, "events")
    body = F.concat("event_type", F.lit(" #### "), F.col("value").cast("string"), F.lit("\n"), F.col("props"), F.lit("\n \n"))
    return e.select("event_id", T.marked_number(body).alias("answer"), T.last_line(body).alias("tail"))


# ---- D: features ------------------------------------------------------------------------------

BLANK = "' ' || chr(10)"


@query("d2_eleven_features", with_views(f"""
, m AS (SELECT chain_id, count(*) AS n, avg(CASE WHEN length(trim(observation, {BLANK})) < 15 THEN 1.0::DOUBLE ELSE 0 END) AS empty,
 count(CASE WHEN prev_action = action_type THEN 1 END) AS same, avg(len({sql_words('observation')})) AS ow, avg(len({sql_words('thought')})) AS tw,
 stddev_pop(len({sql_words('thought')})) AS tsd, max_by(observation, step_idx) AS last_obs, count(DISTINCT action_type) AS da,
 count(CASE WHEN action_type='Search' THEN 1 END) AS cs, count(DISTINCT CASE WHEN action_type='Search' THEN action_arg END) AS ds FROM so_base GROUP BY chain_id),
j AS (SELECT c.*, m.*, {sql_wset('final_answer')} AS aw, {sql_wset('last_obs')} AS lw, len({sql_words('question')}) AS ql, len({sql_words('final_answer')}) AS al FROM chains_v c JOIN m USING (chain_id))
SELECT chain_id, n, round(1.0::DOUBLE - da::DOUBLE / n, 6) AS loop_rate, round(least(1.0, n / 6.0::DOUBLE), 6) AS steps_norm, round(empty, 6) AS empty_obs_rate,
 round(CASE WHEN cs > 0 THEN 1.0 - ds::DOUBLE / cs ELSE 0.0::DOUBLE END, 6) AS repeated_search, round(greatest(0.0::DOUBLE, 1.0 - al / greatest(1.0::DOUBLE, greatest(ql,1) * 0.5::DOUBLE)), 6) AS answer_gap,
 round(CASE WHEN n > 1 THEN same::DOUBLE / (n - 1) ELSE 0.0::DOUBLE END, 6) AS backtrack_rate, round(1.0 - least(1.0, ow / 50), 6) AS obs_util,
 round(CASE WHEN n >= 2 THEN tsd / greatest(1.0, tw) ELSE 0.0::DOUBLE END, 6) AS coherence_drop, round(1.0 - {sql_jac('aw','lw')}, 6) AS ans_obs_mismatch,
 round(cs::DOUBLE / n, 6) AS search_share, round(least(1.0, ow / 100), 6) AS avg_obs_norm FROM j""", "so_base", "chains_v"))
def d2(spark, base):
    return D.eleven_features(V.steps(spark, base), V.chains(spark, base)).select("chain_id", "n", *r6(*D.ELEVEN))


V.cte("fifteen_v", f"""SELECT chain_id, n, {", ".join(f"{e} AS {n}" for n, e in zip(D.FIFTEEN, [
 "sc1", "sc2", "sc3", "sc5", "sc6", "sc11", "coalesce(sc9,0.5::DOUBLE)", "coalesce(sc10,0.5::DOUBLE)", "coalesce(sc12,0.5::DOUBLE)", "least(n/10.0::DOUBLE,1.0)",
 "least(n_search/8.0::DOUBLE,1.0)", "CASE WHEN n >= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
 f"CASE WHEN len({sql_caps('final_answer')}) > 0 THEN {sql_shared(sql_caps('final_answer'), sql_caps('obs_all'))}::DOUBLE / len({sql_caps('final_answer')}) ELSE 0.5::DOUBLE END",
 "CASE WHEN (" + FACTOID_SQL.replace('text', 'question') + f") AND len({sql_words('final_answer')}) > 8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
 f"CASE WHEN len({sql_caps('question')}) > 0 THEN {sql_shared(sql_caps('question'), sql_caps('obs_all'))}::DOUBLE / len({sql_caps('question')}) ELSE 0.5::DOUBLE END"]))}
FROM nano_v""", "nano_v")


@query("d3_fifteen_features", with_views(f"SELECT chain_id, n, {q6(*D.FIFTEEN)} FROM fifteen_v", "fifteen_v"))
def d3(spark, base):
    return D.fifteen_features(V.steps(spark, base), V.chains(spark, base)).select("chain_id", "n", *r6(*D.FIFTEEN))


_ST = lambda e: sql_tokens(e, fixed.STEP_STOP)
V.cte("d4_v", f"""SELECT c.chain_id, c.final_answer, m.* EXCLUDE (chain_id) FROM chains_v c JOIN (SELECT chain_id, count(*) AS n,
 avg(least(len(regexp_extract_all(thought, {HEDGE_SQL})) / (greatest(len({sql_words('thought')}),1) / 10.0::DOUBLE + 1e-6), 1.0)) AS sc4_uncertainty_density,
 1.0::DOUBLE - count(DISTINCT action_arg)::DOUBLE / count(*) AS sc5_backtrack_rate, least(count(*) / 10.0::DOUBLE, 1.0) AS sc2_step_count,
 avg(CASE WHEN action_arg <> '' AND observation <> '' THEN {sql_jac(_ST('action_arg'), _ST('observation'))} ELSE 0.0::DOUBLE END) AS retrieval_conf,
 avg(CASE WHEN prev_thought IS NOT NULL THEN 1.0 - {sql_jac(_ST('thought'), _ST("coalesce(prev_thought,'')"))} ELSE 0.5::DOUBLE END) AS semantic_gap,
 avg(least(len({sql_words('thought')}) / 50.0::DOUBLE, 1.0)) AS thought_len_norm, avg(CASE WHEN len({sql_words('observation')}) < 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS empty_obs,
 string_agg(observation, ' ') AS obs_all FROM so_base GROUP BY chain_id) m USING (chain_id)""", "so_base", "chains_v")
V.cte("d4_full", f"""SELECT *, CASE WHEN len({sql_caps('final_answer')}) > 0 THEN {sql_shared(sql_caps('final_answer'), sql_caps('obs_all'))}::DOUBLE / len({sql_caps('final_answer')})
 ELSE 0.5::DOUBLE END AS ans_entity_match, 0.5::DOUBLE AS obs_entity_coverage FROM d4_v""", "d4_v")


@query("d4_step_extractor", with_views(f"SELECT chain_id, n, {q6(*D.STEP_NINE)} FROM d4_full", "d4_full"))
def d4(spark, base):
    return D.nine_features(V.steps(spark, base), V.chains(spark, base)).select("chain_id", "n", *r6(*D.STEP_NINE))


@query("d5_generic_extractor", with_views(f"""
SELECT chain_id, n, round(avg_words, 6) AS thought_words, round(fin, 6) AS finish_share FROM (SELECT chain_id, count(*) AS n, avg(len({sql_words('thought')})) AS avg_words,
 avg(CASE WHEN action_type='Finish' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS fin FROM steps_v GROUP BY chain_id)""", "steps_v"))
def d5(spark, base):
    cols = {"thought_words": T.word_count(F.col("thought")),
            "finish_share": F.when(F.col("action_type") == "Finish", 1.0).otherwise(0.0)}
    return D.mean_step_features(V.steps(spark, base), V.chains(spark, base), cols).select("chain_id", "n", *r6(*cols))


def weighted_extractor():
    """Longest thought, mean length with later steps weighing more, and whether the last step saw nothing."""
    extend.register_extractor("weighted", lambda: {"words": T.word_count(F.col("thought")), "blank": F.col("observation") == ""}, lambda: extend.StepAggregate(
        update={"top": F.max("words"), "late": F.sum((F.col("step_idx") + 1) * F.col("words")), "weight": F.sum(F.col("step_idx") + 1),
                "end": F.max_by("blank", "step_idx")},
        merge={"top": F.max("top"), "late": F.sum("late"), "weight": F.sum("weight"), "end": F.max_by("end", "block")},
        finish={"top_words": F.col("top"), "late_words": F.col("late") / F.col("weight"), "blank_at_end": F.col("end").cast("int")}))
    return "weighted"


@query("l2_own_aggregate", with_views(f"""
SELECT chain_id, coalesce(n, 0) AS n, coalesce(top_words, 0.0::DOUBLE) AS top_words, round(coalesce(late_words, 0.0::DOUBLE), 6) AS late_words, coalesce(blank_at_end, 0.0::DOUBLE) AS blank_at_end FROM chains_v LEFT JOIN
 (SELECT chain_id, count(*) AS n, max(len({sql_words('thought')}))::DOUBLE AS top_words, sum((step_idx + 1) * len({sql_words('thought')}))::DOUBLE / sum(step_idx + 1) AS late_words,
 max_by(CASE WHEN observation = '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, step_idx) AS blank_at_end FROM steps_v GROUP BY chain_id) USING (chain_id)""", "chains_v", "steps_v"))
def l2(spark, base):
    """Blocks of two steps, so that chains have several parts."""
    d = extend.domain_features(V.steps(spark, base), V.chains(spark, base), weighted_extractor(), block=2)
    return d.select("chain_id", "n", "top_words", "blank_at_end", *r6("late_words"))


V.cte("d6_v", f"""SELECT c.chain_id, n, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5 - 0.3*th_obs - 0.3*obs_fa + 0.3*empty + 0.2*(1.0 - d_obs::DOUBLE/n))) AS beh, 0.5::DOUBLE AS ptrue, 0.0::DOUBLE AS se,
 1.0 - coalesce(gap, 0.5) AS sc3_gap, CASE WHEN final_answer <> '' AND obs_all <> '' THEN 1.0 - {sql_shared(sql_tokens('final_answer'), sql_tokens('obs_all'))}::DOUBLE / greatest(len({sql_tokens('final_answer')}),1) ELSE 0.5::DOUBLE END AS sc6_gap,
 least(n/10.0::DOUBLE, 1.0) AS n_steps_norm, empty AS empty_frac FROM chains_v c JOIN (SELECT s.chain_id, count(*) AS n, avg({sql_jac(sql_wset('thought'), sql_wset('observation'))}) AS th_obs,
 avg({sql_jac(sql_wset('observation'), sql_wset('final_answer'))}) AS obs_fa, avg(CASE WHEN len({sql_words('observation')}) < 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS empty,
 avg(CASE WHEN thought <> '' AND observation <> '' THEN {sql_jac(sql_wset('thought'), sql_wset('observation'))} END) AS gap, count(DISTINCT observation) AS d_obs,
 string_agg(observation, ' ') AS obs_all FROM steps_v s JOIN chains_v USING (chain_id) GROUP BY s.chain_id) USING (chain_id)""", "steps_v", "chains_v")


@query("d6_seven_features", with_views(f"SELECT chain_id, n, {q6(*D.SEVEN)} FROM d6_v", "d6_v"))
def d6(spark, base):
    return D.seven_features(V.steps(spark, base), V.chains(spark, base)).select("chain_id", "n", *r6(*D.SEVEN))


@query("d7_linear_risk", with_views("SELECT domain, round(avg(beh), 6) AS mean_risk, round(max(beh), 6) AS max_risk FROM d6_v JOIN chains_v USING (chain_id) GROUP BY domain", "d6_v"))
def d7(spark, base):
    d = D.seven_features(V.steps(spark, base), V.chains(spark, base))
    return d.groupBy("domain").agg(F.round(F.avg("beh"), 6).alias("mean_risk"), F.round(F.max("beh"), 6).alias("max_risk"))


@query("d8_step_sequence", with_views(f"""
, f AS (SELECT *, row_number() OVER (PARTITION BY chain_id, observation ORDER BY step_idx) > 1 AS seen FROM so_base WHERE step_idx < 8),
g AS (SELECT chain_id, pos FROM chains_v, (SELECT CAST(range AS INTEGER) AS pos FROM range(8)))
SELECT g.chain_id, g.pos, (SELECT count(*) FROM f f2 WHERE f2.chain_id = g.chain_id) AS n_real,
 round(coalesce(CASE WHEN f.chain_id IS NULL OR action_arg = '' OR observation = '' THEN 0.0::DOUBLE ELSE {sql_jac(sql_wset('action_arg'), sql_wset('observation'))} END, 0), 6) AS retrieval_conf,
 round(CASE WHEN f.chain_id IS NULL THEN 0.0::DOUBLE WHEN prev_thought IS NULL THEN 0.5::DOUBLE ELSE 1.0 - {sql_jac(sql_wset('thought'), sql_wset("coalesce(prev_thought,'')"))} END, 6) AS semantic_gap,
 round(CASE WHEN f.chain_id IS NULL THEN 0.0::DOUBLE ELSE least(len({sql_words('thought')}) / 50.0::DOUBLE, 1.0) END, 6) AS thought_len_n, CASE WHEN len({sql_words('observation')}) < 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS empty_obs,
 CASE WHEN seen THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS repeat_obs, round(coalesce(f.step_idx, 0) / 7.0::DOUBLE, 6) AS step_idx_n
FROM g LEFT JOIN f ON f.chain_id = g.chain_id AND f.step_idx = g.pos""", "so_base", "chains_v"))
def d8(spark, base):
    d = D.step_sequence(V.steps(spark, base), V.chains(spark, base))
    return d.select("chain_id", "pos", "n_real", *r6(*D.SEQUENCE))


@query("d9_labelled_features", with_views("SELECT chain_id, CAST(CASE WHEN wrong = 0 THEN 0 ELSE 1 END AS INTEGER) AS label, round(beh, 6) AS beh, round(sc3_gap, 6) AS sc3_gap FROM d6_v JOIN labelled_v USING (chain_id)", "d6_v", "labelled_v"))
def d9(spark, base):
    d = D.seven_features(V.steps(spark, base), V.labelled_chains(spark, base))
    return d.select("chain_id", F.when(F.col("wrong") == 0, 0).otherwise(1).alias("label"), *r6("beh", "sc3_gap"))


@query("d10_published_signals", with_views(f"""
SELECT chain_id, CAST(coalesce(max(CASE WHEN action_type='Finish' THEN 1 END),0) AS INTEGER) AS completed, round(least(count(CASE WHEN action_type='Search' THEN 1 END) / 7.0::DOUBLE, 1.0), 6) AS search_norm,
 round(var_pop(length(thought)), 4) AS thought_variance, round(coalesce(count(DISTINCT CASE WHEN action_type='Search' THEN action_arg END)::DOUBLE / nullif(count(CASE WHEN action_type='Search' THEN 1 END),0), 1.0), 6) AS search_diversity,
 round(avg(CASE WHEN regexp_matches(thought, {HEDGE_SQL}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS uncertain_share , round((SELECT length(final_answer) / greatest(length(question), 1)::DOUBLE FROM chains_v c WHERE c.chain_id = steps_v.chain_id), 6) AS answer_ratio FROM steps_v GROUP BY chain_id""", "steps_v", "chains_v"))
def d10(spark, base):
    """Thought variance uses text length where no embedding norm is given; the answer's length is measured against the question's."""
    s = V.steps(spark, base)
    search = F.col("action_type") == "Search"
    m = s.groupBy("chain_id").agg(
        F.max(F.when(F.col("action_type") == "Finish", 1).otherwise(0)).alias("completed"),
        F.round(F.least(F.count_if(search) / 7.0, F.lit(1.0)), 6).alias("search_norm"),
        F.round(F.var_pop(F.length("thought")), 4).alias("thought_variance"), F.count_if(search).alias("_c"),
        F.round(F.avg(F.when(T.has_hedge(F.col("thought")), 1.0).otherwise(0.0)), 6).alias("uncertain_share"))
    once = s.filter(search).groupBy("chain_id", "action_arg").agg(F.count(F.lit(1)).alias("_n"))
    uniq = once.groupBy("chain_id").agg(F.count(F.lit(1)).alias("_u"))
    ratio = F.length("final_answer") / F.greatest(F.length("question"), F.lit(1))
    d = m.join(uniq, "chain_id", "left").join(V.chains(spark, base).select("chain_id", F.round(ratio, 6).alias("answer_ratio")), "chain_id")
    return d.select("chain_id", "completed", "search_norm", "thought_variance", "answer_ratio",
                    F.round(F.coalesce(F.try_divide(F.col("_u"), F.col("_c")), F.lit(1.0)), 6).alias("search_diversity"), "uncertain_share")


@query("d11_topic_agnostic", with_views(rf"""
SELECT chain_id, n_steps, completed, n_search, n_finish, round(coalesce(slope, 0), 6) AS thought_progression, round(clarity, 6) AS thought_clarity_words, round(tl, 6) AS avg_thought_len, round(cov, 6) AS obs_coverage,
 round(ol, 6) AS avg_obs_len, CAST(len({sql_words('final_answer')}) AS INTEGER) AS answer_len, round(len(regexp_extract_all(final_answer, '[0-9A-Z]'))::DOUBLE / greatest(length(final_answer), 1), 6) AS answer_specificity, uq AS n_unique_queries,
 round(coalesce(uq::DOUBLE / nullif(n_search, 0), 0), 6) AS query_diversity, round(1 - coalesce(uq::DOUBLE / nullif(n_search, 0), 0), 6) AS repeat_rate, round(coalesce(n_steps::DOUBLE / nullif(th, 0), 0), 6) AS steps_per_thought,
 round(coalesce(late::DOUBLE / nullif(n_search, 0), 0), 6) AS late_search_rate FROM chains_v JOIN (SELECT chain_id, count(*) AS n_steps, max(CASE WHEN action_type='Finish' THEN 1 ELSE 0 END) AS completed, count(CASE WHEN action_type='Search' THEN 1 END) AS n_search,
 count(CASE WHEN action_type='Finish' THEN 1 END) AS n_finish, CASE WHEN count(*) > 1 THEN regr_slope(len({sql_words('thought')}), step_idx) END AS slope, avg(least(len(regexp_extract_all(thought, {HEDGE_SQL})) / (greatest(len({sql_words('thought')}),1) / 10.0::DOUBLE + 1e-6), 1.0)) AS clarity,
 avg(len({sql_words('thought')})) AS tl, avg(CASE WHEN len({sql_words('observation')}) >= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS cov, avg(len({sql_words('observation')})) AS ol, count(DISTINCT CASE WHEN action_type='Search' THEN trim(lower(action_arg)) END) AS uq,
 count(CASE WHEN len({sql_words('thought')}) > 0 THEN 1 END) AS th, count(CASE WHEN action_type='Search' AND step_idx >= 3 THEN 1 END) AS late FROM steps_v GROUP BY chain_id) USING (chain_id)""", "steps_v", "chains_v"))
def d11(spark, base):
    """Documented feature names; the formulas are choices of this library."""
    s, c = V.steps(spark, base), V.chains(spark, base)
    words = T.word_count(F.col("thought"))
    m = s.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("n_steps"), F.max(F.when(F.col("action_type") == "Finish", 1).otherwise(0)).alias("completed"),
        F.count_if(F.col("action_type") == "Search").alias("n_search"), F.count_if(F.col("action_type") == "Finish").alias("n_finish"),
        F.regr_slope(words.cast("double"), F.col("step_idx").cast("double")).alias("thought_progression"),
        F.avg(T.hedge_density(F.col("thought"))).alias("thought_clarity_words"), F.avg(words).alias("avg_thought_len"),
        F.avg(F.when(T.word_count(F.col("observation")) >= 5, 1.0).otherwise(0.0)).alias("obs_coverage"),
        F.avg(T.word_count(F.col("observation"))).alias("avg_obs_len"), F.count_if(words > 0).alias("_thoughts"),
        F.count_if((F.col("action_type") == "Search") & (F.col("step_idx") >= 3)).alias("_late"))
    u = D.distinct_measures(s, c, ("query",))
    d = c.join(m, "chain_id", "left").join(u, "chain_id", "left")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    chars = F.greatest(F.length("final_answer"), F.lit(1))
    out = d.select(
        "chain_id", "n_steps", "completed", "n_search", "n_finish", F.coalesce("thought_progression", F.lit(0.0)).alias("thought_progression"),
        "thought_clarity_words", "avg_thought_len", "obs_coverage", "avg_obs_len", T.word_count(F.col("final_answer")).alias("answer_len"),
        (F.regexp_count("final_answer", F.lit(r"[0-9A-Z]")) / chars).alias("answer_specificity"),
        F.coalesce("d_query", F.lit(0)).alias("n_unique_queries"), share("d_query", "c_query").alias("query_diversity"),
        (1 - share("d_query", "c_query")).alias("repeat_rate"), share("n_steps", "_thoughts").alias("steps_per_thought"),
        share("_late", "n_search").alias("late_search_rate"))
    return out.withColumns({n: F.round(n, 6) for n, t in out.dtypes if t == "double"})


PREFIX_CTE = f"""
, p AS (SELECT a.chain_id, a.step_idx + 1 AS t, b.* EXCLUDE (chain_id) FROM so a JOIN so b ON a.chain_id = b.chain_id AND b.step_idx <= a.step_idx),
pm AS (SELECT chain_id, CAST(t AS INTEGER) AS t, count(*) + PEND AS n, count(DISTINCT action_type) + PENDACT AS da,
 avg(CASE WHEN filled AND u > 0 THEN i::DOUBLE / u END) AS gap, avg(CASE WHEN filled THEN i::DOUBLE / greatest(len(ot),1) END) AS used,
 sum(CASE WHEN prev_thought IS NOT NULL AND pu > 0 THEN pi::DOUBLE / pu END) AS coh_s, count(CASE WHEN prev_thought IS NOT NULL AND pu > 0 THEN 1 END) + PENDCOH AS coh_c,
 coalesce(sum(CASE WHEN thought <> '' THEN len({sql_words('thought')}) END),0) AS thw, count(CASE WHEN thought <> '' THEN 1 END) AS thn, count(CASE WHEN filled THEN 1 END) AS rn,
 min_by(1 - i::DOUBLE / greatest(u,1), step_idx) FILTER (WHERE filled) AS rf, max_by(1 - i::DOUBLE / greatest(u,1), step_idx) FILTER (WHERE filled) AS rl FROM p GROUP BY chain_id, t),
ps AS (SELECT chain_id, t, 1.0 - da::DOUBLE / n AS sc1, least(n/10.0::DOUBLE,1.0) AS sc2, 1.0 - coalesce(gap,0.5) AS sc3, least(thw::DOUBLE/(50*greatest(thn,1)),1.0) AS sc5, 0.5::DOUBLE AS sc6, 1.0::DOUBLE AS sc11,
 CASE WHEN n >= 3 THEN coalesce(used,0.5) END AS sc9, CASE WHEN n >= 3 THEN CASE WHEN coh_c = 0 THEN 0.5::DOUBLE ELSE coalesce(coh_s,0)::DOUBLE / coh_c END END AS sc10,
 CASE WHEN n >= 3 AND rn >= 3 THEN tanh(5 * (rl - rf) / greatest(n-1,1)) * 0.5 + 0.5 END AS sc12 FROM pm),
pv AS (SELECT *, CAST({V.NANO_MEAN_SQL} AS DOUBLE) AS behaviour FROM ps)
"""


def prefix_sql(body, pending=False):
    c = PREFIX_CTE
    if pending:
        c = (c.replace("PENDACT", "CASE WHEN count(CASE WHEN action_type='Search' THEN 1 END) = 0 THEN 1 ELSE 0 END")
             .replace("PENDCOH", "CASE WHEN len(max_by(tt, step_idx)) > 0 THEN 1 ELSE 0 END").replace("PEND", "1"))
    else:
        c = c.replace("PENDACT", "0").replace("PENDCOH", "0").replace("PEND", "0")
    return with_views(c + body, "so", "labelled_v", "nano_v")


@query("d14_prefix_scores", prefix_sql(f"SELECT chain_id, t, {q6(*D.NANO_COLUMNS)} FROM pv"))
def d14(spark, base):
    return D.prefix_signals(V.steps(spark, base), V.chains(spark, base)).select("chain_id", "t", *r6(*D.NANO_COLUMNS))
