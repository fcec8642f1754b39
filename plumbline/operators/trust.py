"""Trust envelopes in bulk: build, sign, verify, and chains of custody."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import risk as R, signing as G

HOP = "struct<agent_id:string,risk_score:double,timestamp:double,agent_card_ref:string,hop_signature:string>"
TEMPORAL = "struct<is_time_sensitive:boolean,stale_score:double,recency_score:double,tv_risk:double>"
ENVELOPE = (f"answer string, risk_score double, confidence_tier string, failure_mode string, step_count int, judge_label string, "
            f"downstream_hint string, should_rewrite boolean, behavioral_components map<string,double>, temporal_validity {TEMPORAL}, "
            f"trust_signature string, agent_card_ref string, trust_chain array<{HOP}>, issued_at double, ttl int")
SIGNED = ["answer", "risk_score", "confidence_tier", "failure_mode", "step_count", "judge_label", "downstream_hint",
          "should_rewrite", "issued_at", "ttl"]


def envelopes(scored: DataFrame, components: tuple[str, ...] = (), ttl: int = 300, keep: tuple[str, ...] = ()) -> DataFrame:
    """Unsigned envelopes from scored chains; ``keep`` names further columns to carry along."""
    parts = [x for c in components for x in (F.lit(c), F.round(F.col(c), 4))]
    comp = (F.map_filter(F.create_map(*parts), lambda k, v: v.isNotNull()) if parts else F.lit(None)).cast("map<string,double>")
    return scored.select(
        "chain_id", *keep, F.col("final_answer").alias("answer"), F.round("risk_score", 4).alias("risk_score"),
        F.col("tier").alias("confidence_tier"), "failure_mode", F.col("step_count").cast("int").alias("step_count"), "judge_label",
        R.linear_trust_hint(F.col("tier"), F.col("judge_label"), F.col("failure_mode")).alias("downstream_hint"),
        (F.col("tier") == "LOW").alias("should_rewrite"), comp.alias("behavioral_components"),
        F.lit(None).cast(TEMPORAL).alias("temporal_validity"), F.lit(None).cast("string").alias("trust_signature"),
        F.lit(None).cast("string").alias("agent_card_ref"), F.array().cast(f"array<{HOP}>").alias("trust_chain"),
        F.lit(None).cast("double").alias("issued_at"), F.lit(ttl).alias("ttl"))


def to_wire(env: DataFrame) -> DataFrame:
    """JSON text per envelope."""
    cols = [c for c in env.columns if c != "chain_id"]
    return env.select("chain_id", F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("payload"))


def from_wire(wire: DataFrame) -> DataFrame:
    """Envelopes from JSON text, with defaults for whatever is missing."""
    e = wire.select("chain_id", F.from_json("payload", ENVELOPE).alias("e")).select("chain_id", "e.*")
    fill = {"answer": F.lit(""), "risk_score": F.lit(0.5), "confidence_tier": F.lit("MEDIUM"), "step_count": F.lit(0),
            "downstream_hint": F.lit("proceed_with_caution"), "should_rewrite": F.lit(False), "ttl": F.lit(300),
            "trust_chain": F.array().cast(f"array<{HOP}>")}
    return e.withColumns({k: F.coalesce(F.col(k), v) for k, v in fill.items()})


def canonical() -> Column:
    c = F.col
    return G.json_object({
        "answer": G.json_string(c("answer")), "risk_score": G.json_number(c("risk_score")),
        "confidence_tier": G.json_string(c("confidence_tier")), "failure_mode": G.json_string(c("failure_mode")),
        "step_count": G.json_plain(c("step_count")), "judge_label": G.json_string(c("judge_label")),
        "downstream_hint": G.json_string(c("downstream_hint")), "should_rewrite": G.json_plain(c("should_rewrite")),
        "issued_at": G.json_number(c("issued_at")), "ttl": G.json_plain(c("ttl"))})


def _with_keys(df: DataFrame, keys: DataFrame, agent: str) -> DataFrame:
    """Key blocks beside each row; a large key table is shuffled, a small one broadcast by the planner."""
    return df.join(keys, F.col(agent) == F.col("key_agent"), "left")


def sign(env: DataFrame, keys: DataFrame, signer: str, issued_at: Column) -> DataFrame:
    d = _with_keys(env.withColumn("issued_at", issued_at), keys, signer)
    return d.withColumn("trust_signature", G.hmac_sha256(canonical(), F.col("ipad"), F.col("opad"))).drop("key_agent", "ipad", "opad")


def verify(env: DataFrame, keys: DataFrame, signer: str, as_of: Column | None = None) -> DataFrame:
    """Add ``valid``: known key, same signature and, when ``as_of`` is given, not older than ``ttl``."""
    d = _with_keys(env, keys, signer)
    same = F.col("trust_signature") == G.hmac_sha256(canonical(), F.col("ipad"), F.col("opad"))
    fresh = F.lit(True) if as_of is None else F.coalesce(as_of - F.col("issued_at") <= F.col("ttl"), F.lit(True))
    return d.withColumn("valid", F.coalesce(same, F.lit(False)) & fresh).drop("key_agent", "ipad", "opad")


def _hop_json(h: Column) -> Column:
    return G.json_object({"agent_id": G.json_string(h["agent_id"]), "risk_score": G.json_number(F.round(h["risk_score"], 4)),
                          "timestamp": G.json_number(F.round(h["timestamp"], 3)), "agent_card_ref": G.json_string(h["agent_card_ref"]),
                          "hop_signature": G.json_string(h["hop_signature"])})


def chain_hash(hops: Column) -> Column:
    """First 16 hex digits over the hops so far."""
    body = F.concat(F.lit("["), F.array_join(F.transform(hops, _hop_json), ","), F.lit("]"))
    return F.substring(F.sha2(body, 256), 1, 16)


def _hop_message(prev: Column, agent: Column, risk: Column, ts: Column) -> Column:
    quoted = F.concat(F.lit('"'), prev, F.lit('"'))  # hex digits need no escapes
    return G.json_object({"prev_hash": quoted, "agent_id": G.json_string(agent),
                          "risk_score": G.json_number(F.round(risk, 4)), "timestamp": G.json_number(F.round(ts, 3))})


def add_hop(env: DataFrame, keys: DataFrame, agent: str, ts: Column, card: Column | None = None) -> DataFrame:
    d = _with_keys(env.withColumn("_ts", F.round(ts.cast("double"), 3)), keys, agent)
    msg = _hop_message(chain_hash(F.col("trust_chain")), F.col(agent), F.col("risk_score"), F.col("_ts"))
    hop = F.struct(F.col(agent).alias("agent_id"), F.col("risk_score"), F.col("_ts").alias("timestamp"),
                   (card if card is not None else F.lit(None)).cast("string").alias("agent_card_ref"),
                   G.hmac_sha256(msg, F.col("ipad"), F.col("opad")).alias("hop_signature"))
    return d.withColumn("trust_chain", F.concat("trust_chain", F.array(hop))).drop("key_agent", "ipad", "opad", "_ts")


def verify_chain(env: DataFrame, keys: DataFrame) -> DataFrame:
    """``chain_id, chain_valid``; no hops is valid, an unknown agent is not. One pass over the envelopes."""
    hops = env.select("chain_id", "trust_chain", F.posexplode_outer("trust_chain").alias("pos", "h"))
    prev = chain_hash(F.slice("trust_chain", F.lit(1), F.coalesce("pos", F.lit(0))))
    hops = hops.select("chain_id", "h", prev.alias("prev"), F.col("h.agent_id").alias("hop_agent"))
    d = _with_keys(hops, keys, "hop_agent")
    msg = _hop_message(F.col("prev"), F.col("h.agent_id"), F.col("h.risk_score"), F.col("h.timestamp"))
    same = F.coalesce(F.col("h.hop_signature") == G.hmac_sha256(msg, F.col("ipad"), F.col("opad")), F.lit(False))
    ok = F.when(F.col("h").isNull(), True).otherwise(same)
    return d.select("chain_id", ok.alias("ok")).groupBy("chain_id").agg(F.bool_and("ok").alias("chain_valid"))


def handoffs(env: DataFrame) -> DataFrame:
    """Audit rows: who handed over to whom, with risk and chain length."""
    n = F.size("trust_chain")
    # the filter stands on the exploded hop: on the chain itself it would sink below the signing and repeat it
    last = env.select("chain_id", "risk_score", "confidence_tier", n.alias("chain_length"),
                      F.try_element_at("trust_chain", F.lit(-2))["agent_id"].alias("before"), F.explode_outer(F.slice("trust_chain", -1, 1)).alias("h"))
    return last.filter("h IS NOT NULL").select(
        "chain_id", F.coalesce("before", F.lit("upstream")).alias("from_agent"), F.col("h.agent_id").alias("to_agent"), "risk_score",
        "confidence_tier", "chain_length", F.col("h.timestamp").alias("ts"))
