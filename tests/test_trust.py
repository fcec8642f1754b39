import hashlib
import hmac
import json

from pyspark.sql import functions as F

from plumbline.functions import signing as G
from plumbline.operators import trust as K

SECRETS = {"a": "s1", "b": "x" * 100}


def envelope(spark, answer='He said "é"\n\\ 😀\x7f\x01'):
    d = spark.createDataFrame([(1, answer, 0.81234, "LOW", None, 2, "POOR", "a")],
                              "chain_id long, final_answer string, risk_score double, tier string, failure_mode string, step_count int, judge_label string, signer string")
    return K.envelopes(d.drop("signer")).withColumn("signer", F.lit("a"))


def test_canonical_text_equals_python_json(spark):
    keys = G.key_table(spark, SECRETS)
    for answer in ('He said "é"\n\\ 😀\x7f\x01\t', "plain", "", "back\\slash \"q\""):
        r = K.sign(envelope(spark, answer), keys, "signer", F.lit(1704067200.25)).first()
        body = {k: r[k] for k in K.SIGNED}
        text = json.dumps(body, sort_keys=True, separators=(",", ":"))
        assert r.trust_signature == hmac.new(b"s1", text.encode(), hashlib.sha256).hexdigest()


def test_verify_finds_every_change(spark):
    keys = G.key_table(spark, SECRETS)
    d = K.sign(envelope(spark), keys, "signer", F.lit(1000.0))
    ok = lambda x, at=None: K.verify(x, keys, "signer", at).first()["valid"]
    assert ok(d) and ok(d, F.lit(1300.0)) and not ok(d, F.lit(1301.0))
    changes = {"answer": "z", "risk_score": 0.1, "confidence_tier": "HIGH", "failure_mode": "x", "step_count": 9, "judge_label": "GOOD",
               "downstream_hint": "proceed", "should_rewrite": False, "issued_at": 1001.0, "ttl": 301}
    assert set(changes) == set(K.SIGNED)
    for k, v in changes.items():
        assert not ok(d.withColumn(k, F.lit(v))), k
    assert not ok(d.withColumn("trust_signature", F.lit(None).cast("string")))
    assert not ok(d.withColumn("signer", F.lit("stranger")))
    assert ok(d.withColumn("issued_at", F.lit(None).cast("double")), F.lit(9e9)) is False  # signature covers issued_at


def test_custody_chain(spark):
    keys = G.key_table(spark, SECRETS)
    d = envelope(spark)
    valid = lambda x: K.verify_chain(x, keys).first()["chain_valid"]
    assert valid(d)
    one = K.add_hop(d.withColumn("ag", F.lit("a")), keys, "ag", F.lit(5.0))
    two = K.add_hop(one.withColumn("ag", F.lit("b")), keys, "ag", F.lit(6.5), F.lit("card"))
    assert valid(one) and valid(two)
    hops = [h.asDict() for h in two.first()["trust_chain"]]
    prev = hashlib.sha256(json.dumps(hops[:1], sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
    msg = json.dumps({"prev_hash": prev, "agent_id": "b", "risk_score": hops[1]["risk_score"], "timestamp": 6.5}, sort_keys=True, separators=(",", ":"))
    assert hops[1]["hop_signature"] == hmac.new(SECRETS["b"].encode(), msg.encode(), hashlib.sha256).hexdigest()
    cut = two.withColumn("trust_chain", F.slice("trust_chain", 2, 1))
    swapped = two.withColumn("trust_chain", F.reverse("trust_chain"))
    unknown = two.withColumn("trust_chain", F.transform("trust_chain", lambda h: h.withField("agent_id", F.lit("nobody"))))
    assert not valid(cut) and not valid(swapped) and not valid(unknown)
    h = K.handoffs(two).first()
    assert (h.from_agent, h.to_agent, h.chain_length) == ("a", "b", 2) and K.handoffs(one).first()["from_agent"] == "upstream"


def test_wire_defaults(spark):
    w = spark.createDataFrame([(1, "{}")], "chain_id long, payload string")
    r = K.from_wire(w).first()
    assert (r.risk_score, r.confidence_tier, r.downstream_hint, r.ttl, r.trust_chain) == (0.5, "MEDIUM", "proceed_with_caution", 300, [])
    d = envelope(spark)
    assert K.from_wire(K.to_wire(d.drop("signer"))).select("answer", "risk_score").first() == d.select("answer", "risk_score").first()
