"""Trace formats: raw logs of several frameworks to canonical steps.

Message tables carry ``chain_id, pos`` (from 0, no gaps) and the fields of the format. Results carry
``chain_id, step_idx, thought, action_type, action_arg, observation``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import text as T
from plumbline.operators.ordered import running_sums, with_previous

MESSAGE_BLOCK = 4096
OUT = ["chain_id", "step_idx", "thought", "action_type", "action_arg", "observation"]


def canonical(thought: Column, action_type: Column, action_arg: Column, observation: Column) -> list[Column]:
    """Four string fields; empty or missing action types read ``Action``."""
    kind = F.when(action_type.isNull() | (action_type == ""), "Action").otherwise(action_type)
    return [T.text(thought).alias("thought"), kind.alias("action_type"),
            T.text(action_arg).alias("action_arg"), T.text(observation).alias("observation")]


def detect_format(first: dict[str, Column]) -> Column:
    """Format by the fields present on the first step."""
    has = lambda k: first[k].isNotNull() if k in first else F.lit(False)
    return (F.when(has("role"), "openai").when(has("sender"), "autogen")
            .when(has("tool") & (has("tool_input") | has("log")), "langchain").otherwise("react"))


def chain_formats(raw: DataFrame, fields: list[str]) -> DataFrame:
    """One row per chain with its detected format."""
    first = raw.groupBy("chain_id").agg(F.min_by(F.struct(*fields), "pos").alias("f"))
    return first.select("chain_id", detect_format({k: F.col(f"f.{k}") for k in fields}).alias("format"))


def from_react(raw: DataFrame) -> DataFrame:
    """ReAct rows with alias keys; an alias counts only where the key before it is absent."""
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in raw.columns], F.lit(""))
    return raw.select("chain_id", F.col("pos").alias("step_idx"), *canonical(
        pick("thought", "thinking"), pick("action_type", "action"),
        pick("action_arg", "action_input", "query"), pick("observation", "result", "output")))


def content_text(content: Column) -> Column:
    """Text of a message: a plain string, or the ``text`` of JSON content blocks joined by blanks."""
    blocks = F.from_json(content, "array<string>")
    part = lambda b: F.coalesce(F.get_json_object(b, "$.text"), b)
    is_list = F.ltrim(content).startswith("[") & blocks.isNotNull()
    return F.when(is_list, F.array_join(F.transform(blocks, part), " ")).otherwise(T.text(content))


def call_argument(args: Column) -> Column:
    """``query``, else ``input``, else the raw text of a tool call's arguments."""
    obj = F.ltrim(args).startswith("{")
    return T.text(F.coalesce(F.when(obj, F.get_json_object(args, "$.query")),
                             F.when(obj, F.get_json_object(args, "$.input")), args))


def from_messages(raw: DataFrame) -> DataFrame:
    """Role messages: an assistant row opens a step, tool and user rows after it are its observation.

    The step number is a running count of assistant rows, taken block by block. A chain without
    any assistant row becomes one step that holds its first message.
    """
    calls = "tool_calls" in raw.columns
    first_call = F.try_element_at("tool_calls", F.lit(1))["function"] if calls else None
    m = raw.select(
        "chain_id", "pos", "role", T.text("content").alias("content"),
        (first_call["name"] if calls else F.lit(None).cast("string")).alias("tool"),
        (first_call["arguments"] if calls else F.lit(None).cast("string")).alias("args"))
    m = with_previous(m, "chain_id", "pos", {"prev_role": "role"}, MESSAGE_BLOCK, keep_block="blk")
    opens = F.col("role") == "assistant"
    m = running_sums(m, ["chain_id"], "blk", ["pos"], {"sid": opens.cast("long")})
    reply = F.col("role").isin("tool", "user") & (F.col("sid") > 0)
    g = m.groupBy("chain_id", "sid").agg(
        F.max(F.when(opens, F.struct("content", "tool", "args"))).alias("a"),
        F.array_sort(F.collect_list(F.when(reply, F.struct(
            "pos", "content", (F.col("prev_role") == "assistant").alias("next"))))).alias("r"),
        F.min_by("content", "pos").alias("first"))
    seed = F.when(F.element_at("r", 1)["next"], F.element_at("r", 1)["content"]).otherwise("")
    later = F.filter("r", lambda x: ~F.coalesce(x["next"], F.lit(False)))
    obs = F.when(F.size("r") > 0, F.aggregate(
        later, seed, lambda acc, x: T.strip(F.concat(acc, F.lit(" "), x["content"])))).otherwise("")
    tool = F.coalesce(F.col("a.tool"), F.when(F.col("a.args").isNotNull(), "Tool"), F.lit("Action"))
    steps = g.filter(F.col("sid") > 0).select(
        "chain_id", (F.col("sid") - 1).alias("step_idx"),
        *canonical(F.col("a.content"), tool, call_argument(F.col("a.args")), obs))
    bare = g.filter(F.col("sid") == 0).join(
        g.filter(F.col("sid") == 1).select("chain_id"), "chain_id", "left_anti")
    empty = F.lit("")
    return steps.unionByName(bare.select("chain_id", F.lit(0).cast("long").alias("step_idx"),
                                         *canonical(F.col("first"), empty, empty, empty)))


def parse_react_text(body: Column) -> tuple[Column, Column, Column]:
    """Thought, action and action input from plain ReAct text."""
    grab = lambda p: F.regexp_extract(body, p, 1)
    found = lambda p: F.regexp_like(body, F.lit(p))
    th, ac, ai = (r"(?is)Thought\s*:\s*(.+?)(?:\nAction|$)", r"(?i)Action\s*:\s*(.+?)(?:\n|$)",
                  r"(?i)Action\s*Input\s*:\s*(.+?)(?:\n|$)")
    return (F.when(found(th), T.strip(grab(th))).otherwise(body),
            F.when(found(ac), T.strip(grab(ac))).otherwise("Action"),
            F.when(found(ai), T.strip(grab(ai))).otherwise(""))


def from_autogen(raw: DataFrame) -> DataFrame:
    """Agent messages with the tool-like message after each as observation.

    A message used as observation cannot open a step itself. Within a run of rows where each could
    follow the one before, use alternates, so the parity of the place in the run decides.
    """
    s = F.lower(F.coalesce("sender", F.lit("")))
    r = F.coalesce("role", F.lit(""))
    agent = (r == "assistant") | ((s != "") & ~s.isin("user", "human", "tool"))
    replies = r.isin("tool", "function", "user") | s.isin("user", "human", "tool", "userproxyagent")
    m = raw.select("chain_id", "pos", T.text("content").alias("content"),
                   agent.alias("agent"), replies.alias("replies"))
    m = with_previous(m, "chain_id", "pos", {"p_agent": "agent"}, MESSAGE_BLOCK, keep_block="blk")
    # a link: this row could be consumed by the row before it
    m = m.withColumn("link", F.coalesce(F.col("p_agent") & F.col("replies"), F.lit(False)))
    m = running_sums(m, ["chain_id"], "blk", ["pos"], {"run": (~F.col("link")).cast("long")})
    start = m.groupBy("chain_id", "run").agg(F.min("pos").alias("run_at"))
    m = m.join(start, ["chain_id", "run"])
    used = (F.col("pos") - F.col("run_at")) % 2 == 1
    m = m.withColumn("used", used).withColumn("opens", F.col("agent") & ~used)
    nxt = m.filter("used").select("chain_id", (F.col("pos") - 1).alias("pos"),
                                  F.col("content").alias("reply"))
    o = m.filter("opens").select("chain_id", "pos", "blk", "content").join(
        nxt, ["chain_id", "pos"], "left")
    o = running_sums(o, ["chain_id"], "blk", ["pos"], {"k": F.lit(1)})
    th, ac, ai = parse_react_text(F.col("content"))
    steps = o.select("chain_id", (F.col("k") - 1).alias("step_idx"), *canonical(th, ac, ai, F.col("reply")))
    empty = F.lit("")
    bare = m.join(o.select("chain_id").distinct(), "chain_id", "left_anti").groupBy("chain_id").agg(
        F.min_by("content", "pos").alias("first"))
    return steps.unionByName(bare.select("chain_id", F.lit(0).cast("long").alias("step_idx"),
                                         *canonical(F.col("first"), empty, empty, empty)))


def from_langchain(raw: DataFrame) -> DataFrame:
    """Action rows with optional observation."""
    pick = lambda default, *names: F.coalesce(*[F.col(n) for n in names if n in raw.columns], F.lit(default))
    kind = pick("Tool", "tool", "action_type")
    return raw.select("chain_id", F.col("pos").alias("step_idx"), *canonical(
        pick("", "log", "thought"), kind, pick("", "tool_input", "action_arg"), pick("", "observation")))


def lenient(raw: DataFrame) -> DataFrame:
    """Rows where ``action`` may stand for type and argument."""
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    return raw.select("chain_id", F.col("pos").alias("step_idx"), *canonical(
        F.col("thought"), F.coalesce(full("action_type"), F.col("action"), F.lit("Action")),
        F.coalesce(full("action_arg"), F.col("action"), F.lit("")), F.col("observation")))


def from_events(events: DataFrame) -> DataFrame:
    """Callback events to steps.

    ``chain_id, pos, kind`` (action, tool_end, tool_error, finish), ``log, tool, tool_input,
    output``. A tool result takes the action right before it; a finish adds a Finish step.
    """
    e = with_previous(events, "chain_id", "pos",
                      {"p_kind": "kind", "p_log": "log", "p_tool": "tool", "p_input": "tool_input"},
                      MESSAGE_BLOCK, keep_block="blk")
    e = e.filter(F.col("kind") != "action")
    e = running_sums(e, ["chain_id"], "blk", ["pos"], {"k": F.lit(1)})
    acted = F.col("p_kind") == "action"
    log = T.text("p_log")
    line = F.regexp_extract(log, r"(?m)^\s*Thought:[ \t]*(.*?)\s*$", 1)
    before = T.strip(F.regexp_extract(log, r"(?s)^(.*?)(?:\nAction:|$)", 1))
    thought = F.when(acted, F.when(line != "", line).otherwise(before)).otherwise("")
    is_fin = F.col("kind") == "finish"
    out = T.text("output")
    arg = F.when(is_fin, F.substring(out, 1, 300)).otherwise(F.when(acted, call_argument(F.col("p_input"))))
    tool = F.when(is_fin, "Finish").otherwise(F.coalesce(F.when(acted & (F.col("p_tool") != ""), F.col("p_tool")), F.lit("Search")))
    obs = (F.when(is_fin, "").when(F.col("kind") == "tool_error", F.concat(F.lit("[TOOL ERROR] "), out))
           .otherwise(F.substring(out, 1, 500)))
    return e.select("chain_id", (F.col("k") - 1).alias("step_idx"),
                    *canonical(F.when(is_fin, "").otherwise(thought), tool, arg, obs))


def from_crew(steps: DataFrame, tasks: DataFrame) -> DataFrame:
    """Crew step rows, cut to 300/300/500 characters; a task without steps gets a Finish step."""
    cut = lambda c, n: F.substring(T.text(c), 1, n)
    rows = steps.select("chain_id", F.col("pos").alias("step_idx"), *canonical(
        cut("thought", 300), F.coalesce("tool", F.lit("Action")), cut("tool_input", 300), cut("result", 500)))
    bare = tasks.join(steps.select("chain_id").distinct(), "chain_id", "left_anti")
    empty = F.lit("")
    return rows.unionByName(bare.select("chain_id", F.lit(0).cast("long").alias("step_idx"), *canonical(
        empty, F.lit("Finish"), cut("raw", 300), empty)))


STEP_JSON = ("array<struct<thought:string,action_type:string,tool:string,action_arg:string,"
             "tool_input:string,observation:string>>")


def from_run_records(runs: DataFrame) -> DataFrame:
    """Run records with ``chain_id, steps_json, final_answer``: steps plus a closing Finish step."""
    parsed = F.coalesce(F.from_json("steps_json", STEP_JSON), F.array().cast(STEP_JSON))
    finish = F.when(T.text("final_answer") != "", F.array(F.struct(
        F.lit("").alias("thought"), F.lit("Finish").alias("action_type"), F.lit("").alias("tool"),
        F.substring("final_answer", 1, 300).alias("action_arg"), F.lit("").alias("tool_input"),
        F.lit("").alias("observation")))).otherwise(F.array().cast(STEP_JSON))
    e = runs.select("chain_id", F.posexplode(F.concat(parsed, finish)).alias("step_idx", "s"))
    return e.select("chain_id", F.col("step_idx").cast("long").alias("step_idx"), *canonical(
        F.col("s.thought"), F.coalesce("s.action_type", "s.tool", F.lit("Search")),
        F.coalesce("s.action_arg", "s.tool_input"), F.substring("s.observation", 1, 500)))


def validity_flags(steps: DataFrame, formats: DataFrame | None = None) -> DataFrame:
    """Per chain: conditions under which the scores are less reliable."""
    s = steps.select("chain_id", "action_type", T.text("thought").alias("t"), T.text("observation").alias("o"))
    other = r"[^\x00-\x7F]"
    m = s.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.lower("action_type").isin("finish", "final")).alias("open_steps"),
        F.count_if(T.strip(F.col("o")) == "").alias("blank_obs"),
        F.sum(F.length("t") + F.length("o") + 1).alias("chars"),
        F.sum(F.regexp_count("t", F.lit(other)) + F.regexp_count("o", F.lit(other))).alias("non_ascii"))
    m = m.join(formats, "chain_id", "left") if formats is not None else m.withColumn("format", F.lit("react"))
    chars = F.col("chars") + F.col("n") - 1
    return m.select("chain_id", (F.col("format") != "react").alias("foreign_format"),
                    (F.col("open_steps") < 2).alias("short_chain"),
                    (F.col("blank_obs") / F.col("n") > 0.5).alias("sparse_observations"),
                    (F.col("non_ascii") / chars > 0.15).alias("non_english"))


def coverage_report(steps: DataFrame) -> DataFrame:
    """Per chain: counts, share of filled observations and mean lengths."""
    o, t = T.text("observation"), T.text("thought")
    m = steps.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.count_if(F.lower("action_type") != "finish").alias("n_search_steps"),
        F.count_if(F.lower("action_type") == "finish").alias("n_finish_steps"),
        F.avg(F.when(T.strip(o) != "", 1.0).otherwise(0.0)).alias("obs_fill_rate"),
        F.avg(F.length(t)).alias("avg_thought_len"), F.avg(F.length(o)).alias("avg_obs_len"))
    return m.select("*", (F.col("n_search_steps") < 2).alias("warn_short"),
                    (F.col("obs_fill_rate") < 0.5).alias("warn_sparse"))


def judge_prompt(steps: DataFrame, cuts: tuple[int, int, int] = (300, 200, 300)) -> DataFrame:
    """Prompt text of each chain for an external judge."""
    cut = lambda c, n: F.substring(T.strip(T.text(c)), 1, n)
    line = F.concat(F.lit("Step "), (F.col("step_idx") + 1).cast("string"), F.lit(": "), cut("thought", cuts[0]),
                    F.lit("\n  Action: "), F.col("action_type"), F.lit("["), cut("action_arg", cuts[1]),
                    F.lit("]\n  Result: "), cut("observation", cuts[2]))
    parts = steps.groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("step_idx", line.alias("l")))).alias("p"))
    return parts.select("chain_id", F.array_join(F.col("p.l"), "\n").alias("prompt"))
