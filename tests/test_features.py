import pytest
from pyspark.sql import functions as F

from helpers import CHAINS, behaviour, frames, step
from plumbline.functions import text as T
from plumbline.operators import extend, failure as X, features as D, scoring as Z
from plumbline.operators.ordered import running_sums, with_previous


def rows(df, key="chain_id"):
    return {r[key]: r for r in df.collect()}


def test_behaviour_matches_written_out_mean(spark):
    got = rows(D.nano_signals(*frames(spark)))
    for c, (q, ss, a) in CHAINS.items():
        assert got[c]["behaviour"] == pytest.approx(behaviour(q, ss, a), abs=1e-12), c
    assert all(0 <= r["behaviour"] <= 1 for r in got.values())
    assert (got[5]["sc1"], got[5]["sc11"], got[5]["n"]) == (1.0, 1.0, 0)


def test_modes(spark):
    d = D.nano_signals(*frames(spark), X.GUARD_KINDS).select("chain_id", X.nano_mode().alias("m"), X.guard_mode().alias("g"))
    got = rows(d)
    assert got[2]["m"] == "retrieval_fail" and got[4]["m"] == "no_evidence" and got[6]["m"] == "repeated_query"
    assert got[1]["g"] == "confident_wrong" and got[2]["g"] == "retrieval_fail"


def test_joined_blank_observations_count_as_text(spark):
    got = rows(D.nano_signals(*frames(spark, {1: ("q", [step(obs=""), step(obs="")], "answer words"), 2: ("q", [step(obs="")], "answer words")})))
    assert got[1]["sc6"] == 1.0 and got[2]["sc6"] == 0.5


def test_blocks_do_not_change_results(spark):
    s = spark.createDataFrame([(k, i, f"t{i}") for k in (1, 2) for i in range(23)], "k long, i long, t string")
    for block in (1, 2, 5, 100):
        got = {(r.k, r.i): r.p for r in with_previous(s, "k", "i", {"p": "t"}, block).collect()}
        assert got == {(k, i): (f"t{i - 1}" if i else None) for k in (1, 2) for i in range(23)}
        holes = s.filter("i NOT IN (3, 4, 5, 9, 14, 15)").withColumn("i", F.col("i") * 3 + 1)
        got = {(r.k, r.i): r.p for r in with_previous(holes, "k", "i", {"p": "t"}, block).collect()}
        left = [i for i in range(23) if i not in (3, 4, 5, 9, 14, 15)]
        assert got == {(k, i * 3 + 1): (f"t{j}" if j is not None else None) for k in (1, 2) for j, i in zip([None, *left], left)}
        run = running_sums(s.withColumn("b", F.floor(F.col("i") / block)), ["k"], "b", ["i"], {"n": F.lit(1), "total": F.col("i")})
        assert all(r.n == r.i + 1 and r.total == r.i * (r.i + 1) // 2 for r in run.collect())


@pytest.mark.parametrize("block", [1, 2, 1024])
def test_prefixes_equal_scores_of_cut_chains(spark, block):
    s, c = frames(spark)
    got = {(r.chain_id, r.t): r.behaviour for r in D.prefix_signals(s, c, block=block).collect()}
    ahead = {(r.chain_id, r.t): r.behaviour for r in D.prefix_signals(s, c, pending=True, block=block).collect()}
    for k, (q, ss, _) in CHAINS.items():
        for t in range(1, len(ss) + 1):
            assert got[k, t] == pytest.approx(behaviour(q, ss[:t], ""), abs=1e-12)
            assert ahead[k, t] == pytest.approx(behaviour(q, [*ss[:t], step()], ""), abs=1e-12)


def test_vectors_have_no_missing_values(spark):
    s, c = frames(spark)
    for df, names in ((D.eleven_features(s, c), D.ELEVEN), (D.fifteen_features(s, c), D.FIFTEEN), (D.nine_features(s, c), D.STEP_NINE),
                      (D.seven_features(s, c), D.SEVEN)):
        got = df.collect()
        assert len(got) == len(CHAINS)
        assert all(r[n] is not None and -1e-9 <= r[n] <= 5 for r in got for n in names)
    seq = D.step_sequence(s, c).collect()
    assert len(seq) == 8 * len(CHAINS) and {r.n_real for r in seq if r.chain_id == 6} == {8}


def test_text_functions(spark):
    d = spark.createDataFrame([("The iPhone, perhaps 2x better than X's A-b", "  a b\n")], "t string, u string")
    r = d.select(T.content_tokens(F.col("t")).alias("c"), T.capitalised_tokens(F.col("t")).alias("k"), T.hedge_count(F.col("t")).alias("h"),
                 T.word_count(F.col("u")).alias("w"), T.strip(F.col("u")).alias("s"), T.non_ascii_share(F.lit("aé")).alias("n")).first()
    assert set(r.c) == {"iphone", "perhaps", "better"} and set(r.k) == {"The", "Phone"} and r.h == 1 and r.w == 2 and r.s == "a b" and r.n == 0.5


def test_alerts_and_tiers_agree(spark):
    for r in Z.chain_scores(*frames(spark)).collect():
        assert r.tier == ("HIGH" if r.risk_score < 0.5 else "MEDIUM" if r.risk_score < 0.7 else "LOW")
        assert r.needs_alert == (r.risk_score >= 0.7)


def test_extension_points(spark):
    s, c = frames(spark)
    extend.register_extractor("short", lambda: {"blank": F.when(F.col("observation") == "", 1.0).otherwise(0.0)})
    got = rows(extend.domain_features(s, c, "short"))
    assert got[3]["blank"] == 1.0 and got[5]["blank"] == 0.0
    with pytest.raises(KeyError):
        extend.domain_features(s, c, "nowhere")

    def judge(pdf):
        if (pdf.chain_id == 3).any():
            raise RuntimeError("no")
        return pdf.final_answer.str.len() / 100
    scored = rows(extend.judged(c.coalesce(1), judge, ["final_answer"]))
    assert scored[1]["judge_score"] == pytest.approx(0.19) and scored[1]["judge_score_error"] is None
    assert scored[3]["judge_score"] is None and scored[3]["judge_score_error"] == "RuntimeError: no"


def test_retry_advice(spark):
    cases = [([0.3], "use_result"), ([0.9, 0.8, 0.7], "accept_uncertainty"), ([0.9, 0.7], "retry"), ([0.5, 0.9], "accept_uncertainty"),
             ([0.7, 0.7], "retry"), ([0.5, 0.5], "accept_uncertainty"), ([0.5], "retry"), ([], "retry")]
    d = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "i int, risks array<double>")
    assert [r.action for r in X.retry_advice(d).orderBy("i").collect()] == [a for _, a in cases]


def test_one_chain_with_most_steps(spark, monkeypatch):
    import random
    from plumbline.operators import ordered
    rnd = random.Random(9)
    vocab = "river tower paris result maybe history garden music table window".split()
    text = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    hot = [step(text(6), rnd.choice(["Search", "Lookup"]), text(2), text(7)) for _ in range(1500)]
    small = {k: ("Which river?", [step(text(5), "Search", text(2), text(4))] * 2, "Paris river") for k in range(2, 12)}
    chains = {1: ("Which tower in Paris?", hot, "history of the tower"), **small}
    monkeypatch.setattr(ordered.with_previous, "__defaults__", (64, None))
    got = rows(D.nano_signals(*frames(spark, chains)))
    for c, (q, ss, a) in chains.items():
        assert got[c]["behaviour"] == pytest.approx(behaviour(q, ss, a), abs=1e-9)
    last = {r.chain_id: r.behaviour for r in D.prefix_signals(*frames(spark, chains), block=100).filter("t = 1500").collect()}
    assert last[1] == pytest.approx(behaviour(chains[1][0], hot, ""), abs=1e-9)
