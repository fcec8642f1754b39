"""Risk labels, blends and parsers of judge text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plumbline import fixed
from plumbline.functions.text import clip01


def tier(risk: Column) -> Column:
    return (F.when(risk < fixed.MEDIUM_FROM, "HIGH")
            .when(risk < fixed.LOW_FROM, "MEDIUM").otherwise("LOW"))


def risk_word(risk: Column) -> Column:
    return (F.when(risk < fixed.MEDIUM_FROM, "low")
            .when(risk < fixed.LOW_FROM, "medium").otherwise("high"))


def confidence_word(risk: Column) -> Column:
    return F.lower(tier(risk))


def outcome_word(risk: Column) -> Column:
    return (F.when(risk < fixed.MEDIUM_FROM, "likely_success")
            .when(risk < fixed.LOW_FROM, "uncertain").otherwise("likely_failure"))


def alert(risk: Column, at: float = fixed.ALERT_AT) -> Column:
    return risk >= at


def lookup(key: Column, pairs: dict, default=None) -> Column:
    """Small constant lookup as one CASE expression."""
    out = None
    for k, v in pairs.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def judge_label(raw: Column) -> Column:
    """Label in the JSON block of a judge reply; unknown labels count as BORDERLINE."""
    block = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    parsed = F.from_json(block, "label string", {"mode": "PERMISSIVE"})
    label = F.upper(F.trim(F.coalesce(parsed["label"], F.lit("BORDERLINE"))))
    known = F.when(label.isin(*fixed.JUDGE_RISK), label).otherwise("BORDERLINE")
    return F.when(F.length(block) > 0, known)


def judge_risk(label: Column) -> Column:
    """Risk of a label; null when there is no label."""
    return F.when(label.isNotNull(),
                  F.coalesce(lookup(label, fixed.JUDGE_RISK), F.lit(fixed.JUDGE_RISK["BORDERLINE"])))


def blend(behaviour: Column, second: Column, w_behaviour: float = 1.0,
          w_second: float = 3.0) -> Column:
    """Weighted mean of behaviour and a second opinion; behaviour alone when that is null."""
    return F.coalesce(
        (w_behaviour * behaviour + w_second * second) / (w_behaviour + w_second), behaviour)


_FOUR = ("step_relevance double, coherence double, conclusion_support double, "
         "answer_specificity double, failure_flags array<string>, quality_label string")


def four_part_judge(raw: Column) -> tuple[Column, Column]:
    """(risk, label) of a reply that rates four parts from 1 to 5; (0.5, null) when unreadable."""
    block = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    d = F.from_json(block, _FOUR)
    total = sum((F.coalesce(d[n], F.lit(3.0)) for n in (
        "step_relevance", "coherence", "conclusion_support", "answer_specificity")), F.lit(0.0))
    flags = F.when(d["failure_flags"].isNull(), 0).otherwise(F.size(d["failure_flags"]))
    readable = F.try_parse_json(block).isNotNull() & (F.length(block) > 0)
    risk = F.when(readable, clip01((20 - total) / 16.0 + flags * 0.1)).otherwise(0.5)
    label = F.when(readable, F.coalesce(d["quality_label"], F.lit("BORDERLINE")))
    return risk, label


def self_rating_risk(raw: Column) -> Column:
    """First digit from 1 to 5 as a risk; null when there is none."""
    digit = F.regexp_extract(raw, r"[1-5]", 0)
    return F.when(F.length(digit) > 0, 1.0 - (F.try_to_number(digit, F.lit("9")).cast("double") - 1) / 4.0)


def step_judge(raw: Column) -> tuple[Column, Column]:
    """(risk, on_track) of a mid-chain reply, after repair of echoed placeholders."""
    fixed_up = F.regexp_replace(raw, r":\s*true_or_false\b", ": true")
    fixed_up = F.regexp_replace(fixed_up, r":\s*(LOW|MEDIUM|HIGH)_or_\S+", ': "$1"')
    fixed_up = F.regexp_replace(fixed_up, r":\s*1-5\b", ": 3")
    block = F.regexp_extract(fixed_up, r"(?s)\{.*\}", 0)
    d = F.from_json(block, "on_track boolean, risk_assessment string")
    readable = F.try_parse_json(block).isNotNull() & (F.length(block) > 0)
    level = F.upper(F.trim(F.coalesce(d["risk_assessment"], F.lit("MEDIUM"))))
    risk = F.when(readable, F.coalesce(lookup(level, fixed.STEP_JUDGE_RISK), F.lit(0.55)))
    return risk, F.when(readable, F.coalesce(d["on_track"], F.lit(True)))


def linear_trust_hint(t: Column, label: Column, mode: Column) -> Column:
    """What a downstream agent should do."""
    return (F.when(t == "HIGH", "proceed")
            .when(t == "MEDIUM", "proceed_with_caution")
            .when(label == "POOR", "escalate_to_human")
            .when(mode.isin("retrieval_fail", "no_evidence", "repeated_query"),
                  "rewrite_and_verify")
            .otherwise("rewrite_query"))
