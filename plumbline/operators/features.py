"""Feature extraction: long steps and one row per chain in, one feature row per chain out.

Steps carry ``chain_id, step_idx, thought, action_type, action_arg, observation``; ``step_idx``
starts at 0 and has no gaps. Chains carry ``chain_id, question, final_answer``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline import fixed
from plumbline.functions import text as T
from plumbline.operators.ordered import running_sums, with_previous
from plumbline.session import written

STEP_FIELDS = ["thought", "action_type", "action_arg", "observation"]


def _clean_steps(steps: DataFrame) -> DataFrame:
    return steps.select("chain_id", "step_idx", *[T.text(c).alias(c) for c in STEP_FIELDS])


def _both(a: str, b: str) -> Column:
    return (F.col(a) != "") & (F.col(b) != "")


def step_overlaps(steps: DataFrame) -> DataFrame:
    """Per step: token overlap of thought with observation and with the thought before."""
    s = _clean_steps(steps)
    s = with_previous(s, "chain_id", "step_idx",
                      {"prev_thought": "thought", "prev_action": "action_type"})
    s = s.select("*", T.content_tokens(F.col("thought")).alias("tt"),
                 T.content_tokens(F.col("observation")).alias("ot"),
                 T.content_tokens(F.col("prev_thought")).alias("pt"))
    s = s.select("*", T.shared(F.col("tt"), F.col("ot")).alias("to_i"),
                 T.shared(F.col("pt"), F.col("tt")).alias("pp_i"),
                 F.size("tt").alias("tt_n"), F.size("ot").alias("ot_n"), F.size("pt").alias("pt_n"))
    to_u = F.col("tt_n") + F.col("ot_n") - F.col("to_i")
    pp_u = F.col("pt_n") + F.col("tt_n") - F.col("pp_i")
    both = _both("thought", "observation")
    return s.select(
        "chain_id", "step_idx", *STEP_FIELDS, "prev_thought", "prev_action", "ot",
        F.when(both & (to_u > 0), F.col("to_i") / to_u).alias("gap"),
        F.when(both, 1 - F.col("to_i") / F.greatest(to_u, F.lit(1))).alias("step_risk"),
        F.when(both, F.col("to_i") / F.greatest(F.col("ot_n"), F.lit(1))).alias("used"),
        F.when(F.col("prev_thought").isNotNull() & (pp_u > 0), F.col("pp_i") / pp_u).alias("coh"),
        F.when(F.col("thought") != "", T.word_count(F.col("thought"))).alias("th_words"),
    )


def overlap_measures(steps: DataFrame) -> DataFrame:
    """Per chain: sums over :func:`step_overlaps`."""
    s = step_overlaps(steps)
    risky = F.col("step_risk").isNotNull()
    return s.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("gap").alias("gap_avg"), F.avg("used").alias("used_avg"), F.avg("coh").alias("coh_avg"),
        F.sum("th_words").alias("th_words"), F.count("th_words").alias("th_n"),
        F.max(F.length("observation")).alias("obs_max_len"),
        F.count("step_risk").alias("risk_n"),
        F.min_by("step_risk", F.when(risky, F.col("step_idx"))).alias("risk_first"),
        F.max_by("step_risk", F.when(risky, F.col("step_idx"))).alias("risk_last"),
        F.count_if(F.col("action_type") == "Search").alias("n_search"),
        F.bool_or(T.has_hedge(F.col("thought"))).alias("hedged"),
        F.count_if(F.lower("action_type") != "finish").alias("n_open"),
    )


DISTINCT_KINDS = ("action", "query", "open_query", "arg", "obs", "obs_token", "answer_hit",
                  "answer_cap", "question_cap", "search_arg")


def distinct_measures(steps: DataFrame, chains: DataFrame, kinds: Iterable[str]) -> DataFrame:
    """Per chain: number of distinct values of each kind, in one exchange on (chain, kind, value).

    Two-stage counting keeps a chain that holds a large share of all steps spread over many tasks.
    ``obs_token`` is exact up to 5: a step sends at most five of its tokens.
    """
    kinds = list(kinds)
    s = _clean_steps(steps)
    obs_t = T.content_tokens(F.col("observation"))
    need_chain = {"answer_hit", "answer_cap", "question_cap"} & set(kinds)
    if need_chain:
        c = chains.select("chain_id", T.content_tokens(T.text("final_answer")).alias("_ft"),
                          T.capitalised_tokens(T.text("final_answer")).alias("_fc"),
                          T.capitalised_tokens(T.text("question")).alias("_qc"))
        s = s.join(c, "chain_id")
    else:
        s = s.withColumn("_ft", F.lit(None).cast("array<string>"))
    if {"obs_token", "answer_hit"} & set(kinds):
        s = s.withColumn("_ot", obs_t)
    if {"answer_cap", "question_cap"} & set(kinds):
        s = s.withColumn("_oc", T.capitalised_tokens(F.col("observation")))
    is_search = F.col("action_type") == "Search"
    one = lambda c: F.array(c)
    none = F.array().cast("array<string>")
    values = {
        "action": lambda: one(F.col("action_type")),
        "query": lambda: F.when(is_search, one(T.strip(F.lower("action_arg")))).otherwise(none),
        "open_query": lambda: F.when(F.lower("action_type") != "finish",
                                     one(F.col("action_arg"))).otherwise(none),
        "search_arg": lambda: F.when(T.strip(F.lower("action_type")) == "search",
                                     one(F.col("action_arg"))).otherwise(none),
        "arg": lambda: one(F.col("action_arg")),
        "obs": lambda: one(F.sha2("observation", 256)),
        "obs_token": lambda: F.slice("_ot", 1, 5),
        "answer_hit": lambda: F.array_intersect("_ft", "_ot"),
        "answer_cap": lambda: F.array_intersect("_fc", "_oc"),
        "question_cap": lambda: F.array_intersect("_qc", "_oc"),
    }
    def tag(kind: str) -> Column:
        return F.transform(values[kind](), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    tagged = [tag(k) for k in kinds]
    tall = s.select("chain_id", F.explode(F.concat(*tagged) if len(tagged) > 1 else tagged[0]).alias("e"))
    once = tall.groupBy("chain_id", F.col("e.kind").alias("kind"), F.col("e.value").alias("value")).agg(
        F.count(F.lit(1)).alias("rows"))
    aggs = []
    for k in kinds:
        hit = F.col("kind") == k
        aggs += [F.count_if(hit).alias(f"d_{k}"),
                 F.coalesce(F.sum(F.when(hit, F.col("rows"))), F.lit(0)).alias(f"c_{k}")]
    return once.groupBy("chain_id").agg(*aggs)


def _attach(chains: DataFrame, *measures: DataFrame) -> DataFrame:
    out = chains
    for m in measures:
        out = out.join(m, "chain_id", "left")
    counts = [c for m in measures for c in m.columns
              if c.startswith(("d_", "c_")) or c in ("n", "n_search", "risk_n", "th_n", "n_open")]
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})


NANO_KINDS = ("action", "query", "obs_token", "answer_hit")


def nano_signals(steps: DataFrame, chains: DataFrame, kinds: Iterable[str] = NANO_KINDS) -> DataFrame:
    """Chains with the self-contained behavioural signals and their weighted mean ``behaviour``."""
    d = _attach(chains, overlap_measures(steps), distinct_measures(steps, chains, kinds))
    n = F.col("n")
    fa, q = T.text("final_answer"), T.text("question")
    d = d.withColumn("ft", T.content_tokens(fa)).withColumn("qt", T.content_tokens(q))
    d = d.withColumn("obs_any", (n >= 2) | (F.coalesce(F.col("obs_max_len"), F.lit(0)) > 0))
    slope = (F.col("risk_last") - F.col("risk_first")) / F.greatest(n - 1, F.lit(1))
    half = F.lit(0.5)
    d = d.withColumns({
        "sc1": 1.0 - F.col("d_action") / F.greatest(n, F.lit(1)),
        "sc2": F.least(n / 10.0, F.lit(1.0)),
        "sc3": 1.0 - F.coalesce(F.col("gap_avg"), half),
        "sc5": F.least(F.coalesce(F.col("th_words"), F.lit(0))
                       / (50 * F.greatest(F.col("th_n"), F.lit(1))), F.lit(1.0)),
        "sc6": F.when((fa != "") & F.col("obs_any"),
                      1.0 - F.col("d_answer_hit") / F.greatest(F.size("ft"), F.lit(1))).otherwise(half),
        "sc11": 1.0 - T.jaccard(F.col("qt"), F.col("ft")),
        "sc9": F.when(n >= 3, F.coalesce(F.col("used_avg"), half)),
        "sc10": F.when(n >= 3, F.coalesce(F.col("coh_avg"), half)),
        "sc12": F.when((n >= 3) & (F.col("risk_n") >= 3), F.tanh(5 * slope) * 0.5 + 0.5),
    })
    return d.withColumn("behaviour", nano_mean())


def nano_mean() -> Column:
    late = F.col("sc9").isNotNull()
    slope = F.col("sc12").isNotNull()
    zero = F.lit(0.0)
    total = (F.col("sc1") + F.col("sc2") + F.col("sc3") + F.col("sc5") + F.col("sc6")
             + F.col("sc11") * 1.2
             + F.when(late, F.col("sc9") * 1.3 + F.col("sc10") * 1.3).otherwise(zero)
             + F.when(slope, F.col("sc12") * 0.8).otherwise(zero))
    weight = 6.2 + F.when(late, 2.6).otherwise(zero) + F.when(slope, 0.8).otherwise(zero)
    return total / weight


NANO_COLUMNS = ["sc1", "sc2", "sc3", "sc5", "sc6", "sc11", "sc9", "sc10", "sc12", "behaviour"]

ELEVEN = ["loop_rate", "steps_norm", "empty_obs_rate", "repeated_search", "answer_gap",
          "backtrack_rate", "obs_util", "coherence_drop", "ans_obs_mismatch", "search_share",
          "avg_obs_norm"]


def eleven_features(steps: DataFrame, chains: DataFrame) -> DataFrame:
    """The 11 judge features."""
    s = with_previous(_clean_steps(steps), "chain_id", "step_idx", {"prev_action": "action_type"})
    s = s.withColumns({"ow": T.word_count(F.col("observation")), "tw": T.word_count(F.col("thought"))})
    m = s.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.length(T.strip(F.col("observation"))) < 15, 1.0).otherwise(0.0)).alias("empty"),
        F.count_if(F.col("prev_action") == F.col("action_type")).alias("same"),
        F.avg("ow").alias("ow_avg"), F.avg("tw").alias("tw_avg"), F.stddev_pop("tw").alias("tw_sd"),
        F.max_by("observation", "step_idx").alias("last_obs"),
        F.count_if(T.strip(F.lower("action_type")) == "search").alias("n_search"),
    )
    d = _attach(chains, m, distinct_measures(steps, chains, ("action", "search_arg")))
    n = F.greatest(F.col("n"), F.lit(1))
    fa, q = T.text("final_answer"), T.text("question")
    one, zero = F.lit(1.0), F.lit(0.0)
    d = d.withColumn("_aw", T.white_tokens(fa)).withColumn("_lw", T.white_tokens(T.text("last_obs")))
    q_len = F.greatest(T.word_count(q), F.lit(1))
    ow = F.coalesce(F.col("ow_avg"), zero)
    vec = {
        "loop_rate": 1.0 - F.col("d_action") / n,
        "steps_norm": F.least(one, n / 6.0),
        "empty_obs_rate": F.coalesce(F.col("empty"), zero),
        "repeated_search": F.when(F.col("c_search_arg") > 0, 1.0 - F.col("d_search_arg")
                                  / F.greatest(F.col("c_search_arg"), F.lit(1))).otherwise(zero),
        "answer_gap": F.greatest(zero, 1.0 - T.word_count(fa) / F.greatest(q_len * 0.5, one)),
        "backtrack_rate": F.when(F.col("n") > 1, F.col("same") / F.greatest(F.col("n") - 1, F.lit(1)))
                           .otherwise(zero),
        "obs_util": 1.0 - F.least(one, ow / 50.0),
        "coherence_drop": F.when(F.col("n") >= 2, F.col("tw_sd") / F.greatest(one, F.col("tw_avg")))
                           .otherwise(zero),
        "ans_obs_mismatch": 1.0 - T.jaccard(F.col("_aw"), F.col("_lw")),
        "search_share": F.coalesce(F.col("n_search"), F.lit(0)) / n,
        "avg_obs_norm": F.least(one, ow / 100.0),
    }
    return d.select(*chains.columns, "n", *[v.cast("double").alias(k) for k, v in vec.items()])


FIFTEEN = ["sc1_loop_rate", "sc2_step_count", "sc3_obs_thought_gap", "sc5_thought_len",
           "sc6_ans_obs_gap", "sc11_ans_q_mismatch", "sc9_context_use", "sc10_coherence",
           "sc12_risk_slope", "n_steps_norm", "n_searches_norm", "is_multi_step",
           "ans_entity_match", "ans_len_type_match", "obs_entity_coverage"]


def fifteen_features(steps: DataFrame, chains: DataFrame) -> DataFrame:
    """The 15 local-verifier features."""
    d = nano_signals(steps, chains, ("action", "answer_hit", "answer_cap", "question_cap"))
    fa, q = T.text("final_answer"), T.text("question")
    half, one = F.lit(0.5), F.lit(1.0)
    fc, qc = F.size(T.capitalised_tokens(fa)), F.size(T.capitalised_tokens(q))
    vec = [F.col("sc1"), F.col("sc2"), F.col("sc3"), F.col("sc5"), F.col("sc6"), F.col("sc11"),
           F.coalesce("sc9", half), F.coalesce("sc10", half), F.coalesce("sc12", half),
           F.least(F.col("n") / 10.0, one), F.least(F.col("n_search") / 8.0, one),
           F.when(F.col("n") >= 2, 1.0).otherwise(0.0),
           F.when(fc > 0, F.col("d_answer_cap") / fc).otherwise(half),
           T.long_factoid_answer(q, fa),
           F.when(qc > 0, F.col("d_question_cap") / qc).otherwise(half)]
    return d.select(*chains.columns, "n",
                    *[v.cast("double").alias(k) for k, v in zip(FIFTEEN, vec, strict=True)])


STEP_NINE = ["sc2_step_count", "sc4_uncertainty_density", "sc5_backtrack_rate", "retrieval_conf",
             "semantic_gap", "thought_len_norm", "empty_obs", "ans_entity_match",
             "obs_entity_coverage"]


def react_step_columns() -> dict[str, Column]:
    """Per-step expressions of the nine-feature extractor (needs ``prev_thought``)."""
    stop = fixed.STEP_STOP
    t, p, o, a = (F.col(c) for c in ("thought", "prev_thought", "observation", "action_arg"))
    jac = lambda x, y: T.jaccard(T.content_tokens(x, stop), T.content_tokens(y, stop))
    return {
        "sc4_uncertainty_density": T.hedge_density(t),
        "retrieval_conf": F.when((a != "") & (o != ""), jac(a, o)).otherwise(0.0),
        "semantic_gap": F.when(p.isNotNull(), 1.0 - jac(t, p)).otherwise(0.5),
        "thought_len_norm": F.least(T.word_count(t) / 50.0, F.lit(1.0)),
        "empty_obs": F.when(T.word_count(o) < 5, 1.0).otherwise(0.0),
    }


def mean_step_features(steps: DataFrame, chains: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Generic extractor: mean of each per-step expression, zeros for a chain without steps."""
    s = with_previous(_clean_steps(steps), "chain_id", "step_idx",
                      {"prev_thought": "thought", "prev_action": "action_type"})
    m = s.select("chain_id", *[c.cast("double").alias(n) for n, c in columns.items()]).groupBy(
        "chain_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(n).alias(n) for n in columns])
    d = _attach(chains, m)
    return d.withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for n in columns})


def aggregated_step_features(steps: DataFrame, chains: DataFrame, columns: Mapping[str, Column], how, block: int) -> DataFrame:
    """Features by an own aggregate (see ``extend.StepAggregate``); a chain of many steps is several blocks, which merge."""
    s = with_previous(_clean_steps(steps), "chain_id", "step_idx", {"prev_thought": "thought", "prev_action": "action_type"}, block, "block")
    s = s.select("chain_id", "block", "step_idx", *[c.alias(n) for n, c in columns.items()])
    parts = s.groupBy("chain_id", "block").agg(F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in how.update.items()])
    m = parts.groupBy("chain_id").agg(F.sum("n").alias("n"), *[c.alias(n) for n, c in how.merge.items()])
    d = _attach(chains, m.select("chain_id", "n", *[c.cast("double").alias(n) for n, c in how.finish.items()]))
    return d.withColumns({n: F.coalesce(F.col(n), F.lit(how.empty)) for n in how.finish})


def nine_features(steps: DataFrame, chains: DataFrame) -> DataFrame:
    """Nine step-extractor features with their chain-level overrides."""
    d = mean_step_features(steps, chains, react_step_columns())
    d = _attach(d, distinct_measures(steps, chains, ("arg", "answer_cap")))
    n = F.col("n")
    fc = F.size(T.capitalised_tokens(T.text("final_answer")))
    some = n > 0
    d = d.withColumns({
        "sc2_step_count": F.least(n / 10.0, F.lit(1.0)),
        "sc5_backtrack_rate": F.when(some, 1.0 - F.col("d_arg") / F.greatest(n, F.lit(1))).otherwise(0.0),
        "ans_entity_match": F.when(~some, 0.0).when(fc > 0, F.col("d_answer_cap") / fc).otherwise(0.5),
        "obs_entity_coverage": F.when(some, 0.5).otherwise(0.0),
    })
    return d.select(*chains.columns, "n", *STEP_NINE)


SEVEN = ["beh", "ptrue", "se", "sc3_gap", "sc6_gap", "n_steps_norm", "empty_frac"]


def seven_features(steps: DataFrame, chains: DataFrame, ptrue: Column | None = None,
                   se: Column | None = None) -> DataFrame:
    """Seven features with the linear behavioural risk ``beh``."""
    answers = chains.select("chain_id", T.white_tokens(T.text("final_answer")).alias("_fw"))
    s = _clean_steps(steps).join(answers, "chain_id")
    s = s.withColumns({"_tw": T.white_tokens(F.col("thought")), "_ow": T.white_tokens(F.col("observation"))})
    s = s.withColumn("th_obs", T.jaccard(F.col("_tw"), F.col("_ow")))
    m = s.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("th_obs").alias("th_obs"),
        F.avg(T.jaccard(F.col("_ow"), F.col("_fw"))).alias("obs_fa"),
        F.avg(F.when(T.word_count(F.col("observation")) < 5, 1.0).otherwise(0.0)).alias("empty"),
        F.avg(F.when(_both("thought", "observation"), F.col("th_obs"))).alias("gap"),
        F.max(F.length("observation")).alias("obs_max_len"))
    d = _attach(chains, m, distinct_measures(steps, chains, ("obs", "answer_hit")))
    n, fa = F.col("n"), T.text("final_answer")
    obs_any = (n >= 2) | (F.coalesce(F.col("obs_max_len"), F.lit(0)) > 0)
    beh = T.clip01(0.5 - 0.3 * F.col("th_obs") - 0.3 * F.col("obs_fa") + 0.3 * F.col("empty")
                   + 0.2 * (1.0 - F.col("d_obs") / F.greatest(n, F.lit(1))))
    vec = [F.when(n > 0, beh).otherwise(0.5), ptrue if ptrue is not None else F.lit(0.5),
           se if se is not None else F.lit(0.0), 1.0 - F.coalesce("gap", F.lit(0.5)),
           F.when((fa != "") & obs_any, 1.0 - F.col("d_answer_hit")
                  / F.greatest(F.size(T.content_tokens(fa)), F.lit(1))).otherwise(0.5),
           F.least(n / 10.0, F.lit(1.0)), F.coalesce("empty", F.lit(0.0))]
    return d.select(*chains.columns, "n", *[v.cast("double").alias(k) for k, v in zip(SEVEN, vec, strict=True)])


SEQUENCE = ["retrieval_conf", "semantic_gap", "thought_len_n", "empty_obs", "repeat_obs", "step_idx_n"]


def step_sequence(steps: DataFrame, chains: DataFrame, max_steps: int = 8) -> DataFrame:
    """First ``max_steps`` steps as rows of six features, padded with zeros; ``n_real`` is the length."""
    s = _clean_steps(steps).filter(F.col("step_idx") < max_steps)
    s = with_previous(s, "chain_id", "step_idx", {"prev_thought": "thought"})
    first = s.groupBy("chain_id", "observation").agg(F.min("step_idx").alias("_first"))
    s = s.join(first, ["chain_id", "observation"])
    jac = lambda a, b: T.jaccard(T.white_tokens(a), T.white_tokens(b))
    t, p, o, a = (F.col(c) for c in ("thought", "prev_thought", "observation", "action_arg"))
    vals = {
        "retrieval_conf": F.when((a != "") & (o != ""), jac(a, o)).otherwise(0.0),
        "semantic_gap": F.when(p.isNotNull(), 1.0 - jac(t, p)).otherwise(0.5),
        "thought_len_n": F.least(T.word_count(t) / 50.0, F.lit(1.0)),
        "empty_obs": F.when(T.word_count(o) < 5, 1.0).otherwise(0.0),
        "repeat_obs": F.when(F.col("step_idx") > F.col("_first"), 1.0).otherwise(0.0),
        "step_idx_n": F.col("step_idx") / float(max(max_steps - 1, 1)),
    }
    real = s.select("chain_id", F.col("step_idx").cast("int").alias("pos"),
                    *[v.cast("double").alias(k) for k, v in vals.items()])
    counts = real.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n_real"))
    grid = chains.select("chain_id", F.explode(F.sequence(F.lit(0), F.lit(max_steps - 1))).alias("pos"))
    out = grid.join(real, ["chain_id", "pos"], "left").join(counts, "chain_id", "left")
    return out.select("chain_id", "pos", F.coalesce("n_real", F.lit(0)).alias("n_real"),
                      *[F.coalesce(F.col(k), F.lit(0.0)).alias(k) for k in SEQUENCE])


def prefix_signals(steps: DataFrame, chains: DataFrame, pending: bool = False,
                   block: int = 1024) -> DataFrame:
    """Behavioural score of every prefix of every chain (no final answer yet), in one pass.

    Running sums per block replace a join of each step with all steps before it; the measures of a
    step are written once, as five branches read them. With ``pending``
    each prefix also counts one Search step that has been announced but not run.
    """
    s = step_overlaps(steps).select(
        "chain_id", "step_idx", "action_type", "gap", "used", "coh", "step_risk", "th_words",
        (F.size(T.content_tokens(F.col("thought"))) > 0).alias("th_any"))
    s = written(s.sparkSession, s, "measures")
    first = s.groupBy("chain_id", "action_type").agg(F.min("step_idx").alias("_first"))
    ends = s.groupBy("chain_id").agg(
        F.min_by("step_risk", F.when(F.col("step_risk").isNotNull(), F.col("step_idx"))).alias("risk_first"))
    s = s.join(first, ["chain_id", "action_type"]).withColumn("blk", F.floor(F.col("step_idx") / block))
    s = s.select("chain_id", "step_idx", "blk", "gap", "used", "coh", "step_risk", "th_words",
                 "th_any", (F.col("action_type") == "Search").cast("long").alias("is_search"),
                 (F.col("step_idx") == F.col("_first")).cast("long").alias("new_action"))
    cnt = lambda c: F.col(c).isNotNull().cast("long")
    val = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    # position of the latest scored step: running maximum, as block maxima plus a maximum inside
    mark = F.when(F.col("step_risk").isNotNull(), F.struct("step_idx", "step_risk"))
    tops = s.groupBy("chain_id", "blk").agg(F.max(mark).alias("_m"))
    tops = tops.select("chain_id", "blk", F.max("_m").over(
        W.partitionBy("chain_id").orderBy("blk").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    run = running_sums(s, ["chain_id"], "blk", ["step_idx"], {
        "gap_s": val("gap"), "gap_c": cnt("gap"), "used_s": val("used"), "used_c": cnt("used"),
        "coh_s": val("coh"), "coh_c": cnt("coh"), "risk_c": cnt("step_risk"),
        "th_s": val("th_words"), "th_c": cnt("th_words"), "actions": F.col("new_action"), "searches": F.col("is_search")})
    inside = W.partitionBy("chain_id", "blk").orderBy("step_idx").rowsBetween(W.unboundedPreceding, 0)
    run = run.join(tops, ["chain_id", "blk"]).join(ends, "chain_id")
    run = run.withColumn("_last", F.greatest(F.max(mark).over(inside), F.col("_before")))
    run = run.join(chains.select("chain_id", T.text("question").alias("question")), "chain_id")
    n = F.col("step_idx") + 1
    if pending:
        n = n + 1
        run = run.withColumns({
            "actions": F.col("actions") + (F.col("searches") == 0).cast("long"),
            "coh_c": F.col("coh_c") + F.col("th_any").cast("long")})
    half = F.lit(0.5)
    mean = lambda p: F.coalesce(F.try_divide(F.col(f"{p}_s"), F.col(f"{p}_c")), half)
    slope = (F.col("_last.step_risk") - F.col("risk_first")) / F.greatest(n - 1, F.lit(1))
    d = run.withColumn("t", (F.col("step_idx") + 1).cast("int")).withColumns({
        "sc1": 1.0 - F.col("actions") / n,
        "sc2": F.least(n / 10.0, F.lit(1.0)),
        "sc3": 1.0 - mean("gap"),
        "sc5": F.least(F.col("th_s") / (50 * F.greatest(F.col("th_c"), F.lit(1))), F.lit(1.0)),
        "sc6": half, "sc11": F.lit(1.0),
        "sc9": F.when(n >= 3, mean("used")), "sc10": F.when(n >= 3, mean("coh")),
        "sc12": F.when((n >= 3) & (F.col("risk_c") >= 3), F.tanh(5 * slope) * 0.5 + 0.5),
    })
    return d.withColumn("behaviour", nano_mean()).select("chain_id", "t", *NANO_COLUMNS)
