"""Failure modes, repair lookups, routing and retry advice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline import fixed
from plumbline.functions import risk as R, text as T

GUARD_KINDS = ("action", "query", "obs_token", "answer_hit", "open_query")


def nano_mode(long_from: int = 7) -> Column:
    """Mode from :func:`plumbline.operators.features.nano_signals` columns, first match wins."""
    fa = T.text("final_answer")
    return (F.when((F.col("d_obs_token") < 5) & (F.col("n") > 1), "retrieval_fail")
            .when((fa != "") & F.col("obs_any") & (F.col("d_answer_hit") == 0), "no_evidence")
            .when((F.col("c_query") >= 2) & (F.col("d_query") < F.col("c_query") * 0.7), "repeated_query")
            .when(F.col("n") >= long_from, "long_chain"))


def confident_wrong() -> Column:
    """At most two open steps, no hedge anywhere, no repeated argument."""
    return ((F.col("n_open") <= 2) & ~F.coalesce(F.col("hedged"), F.lit(False))
            & (F.col("c_open_query") <= F.col("d_open_query")))


def guard_mode() -> Column:
    return F.when(confident_wrong(), "confident_wrong").otherwise(nano_mode())


def process_mode(output: Column) -> Column:
    """Mode from the nine step features."""
    c = F.col
    return (F.when(T.strip(T.text(output)) == "", "empty_output")
            .when((c("sc2_step_count") <= 0.2) & (c("sc4_uncertainty_density") < 0.05)
                  & (c("sc5_backtrack_rate") < 0.05), "confident_wrong")
            .when((c("retrieval_conf") < 0.05) & (c("empty_obs") > 0.5), "retrieval_fail")
            .when(c("sc5_backtrack_rate") > 0.5, "repeated_query")
            .when(c("sc2_step_count") > 0.4, "long_chain"))


def repair_hint(mode: Column) -> Column:
    return R.lookup(mode, fixed.REPAIR_HINTS)


def failure_hint(mode: Column, time_sensitive: Column | None = None) -> Column:
    hint = R.lookup(mode, fixed.FAILURE_HINTS, fixed.FAILURE_HINT_DEFAULT)
    if time_sensitive is None:
        return hint
    return F.concat(hint, F.when(time_sensitive, fixed.TIME_SENSITIVE_SUFFIX).otherwise(""))


ADAPTER_SCHEMA = ("adapter_id string, adapter_mode string, search_strategy string, temperature_delta double, "
                  "max_steps_override int, priority int, system_hint string")


def adapters(spark: SparkSession, custom: Sequence[tuple] = ()) -> DataFrame:
    """Built-in adapters, with custom rows replacing those of the same mode."""
    rows = {a[1]: a for a in fixed.ADAPTERS} | {a[1]: tuple(a) for a in custom}
    return spark.createDataFrame(list(rows.values()), ADAPTER_SCHEMA)


def select_adapter(df: DataFrame, registry: DataFrame, mode: str = "failure_mode") -> DataFrame:
    """Join each row to its adapter, else to the default one. The registry has a handful of rows."""
    known = F.broadcast(registry.select(F.col("adapter_mode").alias("_known")))
    out = df.join(known, F.col(mode) == F.col("_known"), "left")
    out = out.withColumn("_key", F.coalesce("_known", F.lit("default")))
    out = out.join(F.broadcast(registry), F.col("_key") == F.col("adapter_mode"), "left")
    return out.withColumns({"activated": F.col(mode).isNotNull(), "fallback": F.col("_known").isNull()}).drop(
        "_known", "_key")


def should_rewrite(tier: Column, label: Column, tv_risk: Column) -> Column:
    return F.coalesce(tier == "LOW", F.lit(False)) | F.coalesce(label == "POOR", F.lit(False)) | F.coalesce(
        tv_risk > 0.5, F.lit(False))


def heuristic_variants(question: Column) -> Column:
    """Three rewrites of a question without any model call."""
    q = F.regexp_replace(T.strip(question), r"\?+$", "")
    core = F.array_join(F.slice(T.white_words(q), 1, 6), " ")
    return F.array(F.concat(F.lit("What is the answer to: "), q, F.lit("?")),
                   F.concat(F.lit("What is "), core, F.lit("?")),
                   F.concat(F.lit("Provide background information about: "), q))


def parse_variants(raw: Column, question: Column) -> Column:
    """Variants from a model's JSON reply; blanks and echoes go, the question pads to three."""
    block = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    d = F.from_json(block, "paraphrase string, decomposed string, alternative string")
    names = ("paraphrase", "decomposed", "alternative")
    got = F.filter(F.array(*[T.strip(F.coalesce(d[n], question)) for n in names]),
                   lambda v: (v != "") & (v != question))
    padded = F.slice(F.concat(got, F.array_repeat(question, 3)), 1, 3)
    readable = F.try_parse_json(block).isNotNull() & (F.length(block) > 0)
    return F.when(readable, padded).otherwise(heuristic_variants(question))


def route(risk: Column, low: float | None = None, high: float | None = None) -> Column:
    """Cascade level of a risk; missing or zero cuts read .3 and .7."""
    lo, hi = low or 0.3, high or 0.7
    return F.when(risk <= lo, "low").when(risk <= hi, "medium").otherwise("high")


def cascade(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.CASCADE, "level string, model string, in_cost double, out_cost double")


def routing_costs(calls: DataFrame) -> DataFrame:
    """Cost per model with the totals of always using the top or the cheapest model.

    ``calls`` carries ``level, in_tokens, out_tokens``. Totals come from the few per-model rows.
    """
    models = {lv: (m, ci, co) for lv, m, ci, co in fixed.CASCADE}
    pick = lambda i: R.lookup(F.col("level"), {lv: v[i] for lv, v in models.items()})
    per = calls.groupBy("level").agg(F.count(F.lit(1)).alias("calls"), F.sum("in_tokens").alias("in_tokens"),
                                     F.sum("out_tokens").alias("out_tokens"))
    per = per.withColumn("model", pick(0)).withColumn(
        "cost", F.col("in_tokens") * pick(1) / 1e6 + F.col("out_tokens") * pick(2) / 1e6)
    (_, _, bi, bo), (_, _, ti, to) = fixed.CASCADE[0], fixed.CASCADE[-1]
    total = per.agg(F.sum("calls").alias("total_calls"), F.sum("cost").alias("total_cost"),
                    (F.sum("in_tokens") * ti / 1e6 + F.sum("out_tokens") * to / 1e6).alias("_top"),
                    (F.sum("in_tokens") * bi / 1e6 + F.sum("out_tokens") * bo / 1e6).alias("_bottom"))
    zero = F.lit(0.0)
    return per.join(F.broadcast(total)).select(
        "model", "calls", "cost", "total_calls", "total_cost",
        F.greatest(zero, F.col("_top") - F.col("total_cost")).alias("savings_vs_top"),
        F.greatest(zero, F.col("total_cost") - F.col("_bottom")).alias("overhead_vs_cheapest"),
        (F.col("calls") / F.col("total_calls")).alias("share"))


def retry_advice(attempts: DataFrame, max_retries: int = 3, low: float = 0.40, high: float = 0.65,
                 min_gain: float = 0.05) -> DataFrame:
    """Advice from ``risks``, the array of attempt risks in order (bounded by the retry budget)."""
    r = F.col("risks")
    n = F.size(r)
    left = F.greatest(F.lit(0), max_retries - n)
    last = F.try_element_at(r, F.lit(-1))
    trend = last - F.try_element_at(r, F.lit(-2))
    action = (F.when(n == 0, "retry").when(last < low, "use_result").when(left <= 0, "accept_uncertainty")
              .when(n == 1, "retry").when(trend > min_gain, "accept_uncertainty").when(trend < -min_gain, "retry")
              .when(last >= high, "retry").otherwise("accept_uncertainty"))
    reason = (F.when(n == 0, "no_attempts").when(last < low, "reliable").when(left <= 0, "budget_spent")
              .when(n == 1, "first_attempt").when(trend > min_gain, "worse").when(trend < -min_gain, "improving")
              .when(last >= high, "high_and_flat").otherwise("stalled"))
    best = F.when(reason.isin("budget_spent", "worse"), F.array_min(r)).otherwise(last)
    return attempts.withColumns({"action": action, "attempt": n, "budget_remaining": left,
                                 "advised_risk": best, "reason": reason})


def documented_mode(mean_sim: Column | None = None, no_result: Sequence[str] = fixed.NO_RESULT_PHRASES) -> Column:
    """Documented rule set: needs ``answer_len, c_open_query, d_open_query, any_no_result, n``."""
    out = (F.when(F.col("answer_len") < 5, "empty_answer")
           .when(F.col("d_open_query") < F.col("c_open_query"), "repeated_query")
           .when(F.col("any_no_result"), "retrieval_fail").when(F.col("n") >= 4, "long_chain"))
    return out if mean_sim is None else out.when(mean_sim < 0.30, "low_retrieval_quality")


TAXONOMY_REPAIR: Mapping[str, str] = {
    "RETRIEVAL_FAILURE": "REPHRASE_QUERY", "EXCESSIVE_SEARCH": "CONSOLIDATE",
    "CONFLICTING_EVIDENCE": "CONSOLIDATE", "INSUFFICIENT_EVIDENCE": "ADDITIONAL_SEARCH",
    "ANSWER_UNSUPPORTED": "VERIFY_ANSWER", "PREMATURE_STOP": "ADDITIONAL_SEARCH", "LOW_RISK": "NO_ACTION",
}


def taxonomy(weak_retrieval: float = 0.05, varied: float = 0.5) -> Column:
    """Seven-way taxonomy over nine-feature columns plus ``n, n_search, finished, answer_hits``.

    The cuts for weak retrieval and for conflicting evidence are choices of this library; no
    published values exist.
    """
    c = F.col
    return (F.when((c("n_search") <= 1) & ~c("finished"), "PREMATURE_STOP")
            .when(c("n_search") > 4, "EXCESSIVE_SEARCH")
            .when((c("retrieval_conf") < weak_retrieval) & (c("empty_obs") > 0.5), "RETRIEVAL_FAILURE")
            .when((c("semantic_gap") > 1 - weak_retrieval) & (c("sc5_backtrack_rate") < varied) & (c("n_search") >= 2),
                  "CONFLICTING_EVIDENCE")
            .when((c("retrieval_conf") < weak_retrieval) & (c("n_search") >= 2), "INSUFFICIENT_EVIDENCE")
            .when(c("answer_hits") == 0, "ANSWER_UNSUPPORTED").otherwise("LOW_RISK"))
