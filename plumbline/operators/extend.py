"""Extension points: own step features, own judges."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators import features as D
from plumbline.operators.ordered import STEP_BLOCK


@dataclass(frozen=True)
class StepAggregate:
    """How a chain's features come from its steps, in parts that merge.

    ``update`` are aggregates over the step columns (and ``step_idx``) of one block of a chain, ``merge`` aggregates of the
    same names over the blocks' results (and ``block``, their number in order), ``finish`` the features over the merged ones.
    A chain without steps has ``empty`` for each feature.
    """

    update: Mapping[str, Column]
    merge: Mapping[str, Column]
    finish: Mapping[str, Column]
    empty: float = 0.0


_EXTRACTORS: dict[str, tuple[Callable[[], Mapping[str, Column]], Callable[[], StepAggregate] | None]] = {"react": (D.react_step_columns, None)}


def register_extractor(domain: str, columns: Callable[[], Mapping[str, Column]], aggregate: Callable[[], StepAggregate] | None = None) -> None:
    """Name a set of per-step expressions, which may use ``prev_thought`` and ``prev_action``; the mean of each is a feature unless ``aggregate`` says otherwise."""
    _EXTRACTORS[domain] = columns, aggregate


def domain_features(steps: DataFrame, chains: DataFrame, domain: str, block: int = STEP_BLOCK) -> DataFrame:
    """Features of a registered domain."""
    if domain not in _EXTRACTORS:
        raise KeyError(f"no extractor for {domain}; known: {sorted(_EXTRACTORS)}")
    columns, aggregate = _EXTRACTORS[domain]
    if aggregate is None:
        return D.mean_step_features(steps, chains, columns())
    return D.aggregated_step_features(steps, chains, columns(), aggregate(), block)


def judged(chains: DataFrame, judge: Callable[[pd.DataFrame], pd.Series], columns: list[str], name: str = "judge_score") -> DataFrame:
    """Add the score of an own judge, and what it raised where it failed (``<name>_error``); a failed row's score is null.

    The judge is called once per Arrow batch, and row by row for a batch in which it fails, so that one row
    takes no other's score. A null score leaves the behavioural score alone in every blend. Filter the chains that need a
    judge before the call: a condition beside the call does not spare it.
    """
    kept = ["chain_id", *columns]

    def scores_of(pdf: pd.DataFrame) -> pd.Series:
        return pd.to_numeric(pd.Series(judge(pdf), index=pdf.index), errors="coerce").clip(0.0, 1.0)

    def call(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pdf = pdf.reset_index(drop=True)
            error = pd.Series([None] * len(pdf), dtype=object)
            try:
                score = scores_of(pdf)
            except Exception:  # a judge must not break the scoring job
                score = pd.Series(np.nan, index=pdf.index)
                for i in pdf.index:
                    try:
                        score[i] = scores_of(pdf.loc[[i]]).iloc[0]
                    except Exception as problem:
                        error[i] = f"{type(problem).__name__}: {problem}"
            yield pd.DataFrame({"chain_id": pdf["chain_id"], name: score.astype(object).where(score.notna(), None), f"{name}_error": error})

    scores = chains.select(*kept).mapInPandas(call, f"chain_id long, {name} double, {name}_error string")
    return chains.join(scores, "chain_id", "left")
