import pytest
from pyspark.errors import AnalysisException  # noqa: F401
from pyspark.sql import functions as F

from helpers import CHAINS, frames
from plumbline.operators import features as D, models as G, scoring as Z
from plumbline.operators.model_table import ModelTable


def linear(names, shift=0.0):
    return G.Linear(list(names), [0.0] * len(names), [1.0] * len(names), [1.0] * len(names), shift, 5, 7)


def test_promotion_against_the_stored_metric(spark):
    t = ModelTable(spark)
    assert t.current("judge") is None
    for metric, promoted, stored in ((0.70, True, None), (0.704, False, 0.70), (0.71, True, 0.70), (None, False, 0.71), (0.70, False, 0.71)):
        row = t.offer("judge", linear("ab", metric or 0.0), metric)
        assert (row["promoted"], row["stored"]) == (promoted, stored)
    assert t.offer("other", linear("a"), None)["version"] == 1
    again = ModelTable(spark, t.folder)  # another reader of the same table
    model, scale = again.current("judge")
    assert model.intercept == 0.71 and scale is None and [r.version for r in again.versions().where("kind = 'judge'").orderBy("version").collect()] == [1, 2, 3, 4, 5]


def test_first_opinion_that_there_is(spark):
    steps, chains = frames(spark)
    t, raw = ModelTable(spark), F.when(F.col("chain_id") == 1, '{"label": "GOOD"}')
    plain = {r.chain_id: r.behaviour for r in Z.chain_scores(steps, chains).collect()}

    def got(**how):
        return {r.chain_id: (r.judge_label, r.risk_score, r.behaviour) for r in Z.model_scores(steps, chains, t, **how).collect()}

    none = got(judge_raw=raw)
    assert none[1] == ("GOOD", pytest.approx((plain[1] + 3 * 0.25) / 4), plain[1]) and none[2][:2] == (None, plain[2])
    t.offer("local", linear(D.FIFTEEN, -3.0), 0.8)
    local = got(judge_raw=raw)
    assert set(local) == set(CHAINS) and {v[0] for v in local.values()} == {"LOCAL"} and all(v[2] == plain[k] for k, v in local.items())
    t.offer("structural", linear(Z.STRUCTURE, 0.5), None, target=([0.1, 0.2, 0.3], [1.0, 2.0, 1.0]))
    both = got()
    assert {v[0] for v in both.values()} == {"STRUCTURAL"} and both != local and got(structural=False) == local
    assert all(0 <= v[1] <= 1 for v in both.values())
