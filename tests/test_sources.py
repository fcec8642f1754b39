import json

import pytest
from pyspark.sql import functions as F

from plumbline.sources import formats as S, store as ST


def steps_of(df):
    return [(r.thought, r.action_type, r.action_arg, r.observation) for r in df.orderBy("chain_id", "step_idx").collect()]


CALLS = "array<struct<function:struct<name:string,arguments:string>>>"


def messages(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], f"chain_id long, pos long, role string, content string, tool_calls {CALLS}")


def test_messages_with_calls_and_orphans(spark, monkeypatch):
    rows = [("system", "s", None), ("user", "q", None), ("assistant", "think", [(("find", '{"query": "cats"}'),)]), ("tool", " found ", None),
            ("tool", " more ", None), ("assistant", "again", [(("look", "raw text"),)]), ("system", "x", None), ("user", "late", None),
            ("assistant", "done", None)]
    want = [("think", "find", "cats", "found   more"), ("again", "look", "raw text", "late"), ("done", "Action", "", "")]
    for block in (1, 3, 4096):
        monkeypatch.setattr(S, "MESSAGE_BLOCK", block)
        assert steps_of(S.from_messages(messages(spark, rows))) == want


def test_no_assistant_gives_first_message(spark):
    assert steps_of(S.from_messages(messages(spark, [("user", "hello", None), ("user", "there", None)]))) == [("hello", "Action", "", "")]


def test_autogen_alternation(spark):
    # agent rows in a tool role: each may be eaten by the row before, but an eaten row opens nothing
    rows = [("planner", "assistant", "Thought: t1\nAction: Search\nAction Input: cats"), ("bot", "function", "r1"), ("bot", "function", "r2"),
            ("bot", "function", "r3"), ("user", "user", "r4"), ("user", "user", "skip")]
    raw = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "chain_id long, pos long, sender string, role string, content string")
    assert steps_of(S.from_autogen(raw)) == [("t1", "Search", "cats", "r1"), ("r2", "Action", "", "r3")]


def test_react_alias_only_where_absent(spark):
    raw = spark.createDataFrame([(1, 0, "", "alias", None, None), (1, 1, None, "alias", "go", "out")],
                                "chain_id long, pos long, thought string, thinking string, action string, output string")
    assert steps_of(S.from_react(raw)) == [("", "Action", "", ""), ("alias", "go", "", "out")]


def test_events(spark):
    rows = [("action", "Plan\n Thought: why \nAction: go", "Tool", '{"input": "a"}', None), ("tool_end", None, None, None, "x" * 600),
            ("tool_error", None, None, None, "boom"), ("finish", None, None, None, "end")]
    raw = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "chain_id long, pos long, kind string, log string, tool string, tool_input string, output string")
    assert steps_of(S.from_events(raw)) == [("why", "Tool", "a", "x" * 500), ("", "Search", "", "[TOOL ERROR] boom"), ("", "Finish", "end", "")]


def test_file_readers(spark, tmp_path):
    step = {"thought": "t", "action_type": "Search", "action_arg": "a", "observation": "o"}
    (tmp_path / "hotpot.json").write_text(json.dumps([{"question": "q1", "steps": [step], "final_answer": "a", "correct": True}, {"question": "q2", "steps": []}], indent=1))
    (tmp_path / "hotpot_cache.json").write_text("[]")
    got = {r.question: (r.domain, r.correct, len(r.steps)) for r in ST.read_chains(spark, str(tmp_path / "*.json")).collect()}
    assert got == {"q1": ("hotpot", True, 1), "q2": ("hotpot", False, 0)}
    f = tmp_path / "t.jsonl"
    f.write_text('{"f": [' + ",".join(["1.0"] * 11) + '], "y": 1, "d": "x", "v": "1"}\n\n{"f": [1.0], "y": 0}\n{"f": null, "y": 1}\nbroken\n{"y": 1} trailing\n')
    assert ST.read_telemetry(spark, str(f)).count() == 1
    good, bad = ST.read_json_lines(spark, str(f), ST.TELEMETRY_SCHEMA)
    assert (good.count(), bad.count()) == (3, 2)
    t = tmp_path / "tax.txt"
    t.write_text(json.dumps({"long_chain": [{"question": "q", "step_details": [step], "final_answer": "f"}, {"question": "none", "steps": []}], "other": [{"question": "r", "steps": [step, step]}]}))
    assert {(r.mode, r.question, len(r.steps), r.wrong) for r in ST.read_taxonomy(spark, str(t)).collect()} == {("long_chain", "q", 1, 1), ("other", "r", 2, 1)}
    c = tmp_path / "q.csv"
    c.write_text("question,id\nwhy,1\n")
    assert ST.read_questions(spark, str(c)).count() == 1
    (tmp_path / "bad.csv").write_text("x\n1\n")
    with pytest.raises(ValueError):
        ST.read_questions(spark, str(tmp_path / "bad.csv"))


def test_store_upkeep(spark, tmp_path):
    d = spark.createDataFrame([(i, "q" * 600, "a", "" if i == 0 else "d1", "GOOD" if i % 2 else "LOCAL", i) for i in range(6)],
                              "chain_id long, question string, final_answer string, domain string, judge_label string, ts long")
    path = str(tmp_path / "store")
    ST.append_chains(d, path)
    back = spark.read.parquet(path)
    assert {(r.domain, r.cost, len(r.question)) for r in back.collect()} == {("default", 0.0, 500), ("d1", 0.0, 500), ("d1", 0.007, 500)}
    assert ST.clear_domain(spark, path, "d1") == 5 and spark.read.parquet(path).count() == 1 and ST.clear_domain(spark, path, "gone") == 0
    assert [r.chain_id for r in ST.latest_n(d, 2).filter("domain = 'd1'").orderBy("chain_id").collect()] == [4, 5]
    for fmt in ("csv", "json"):
        ST.export_audit(d, "d1", 2, 3, str(tmp_path / fmt), fmt)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == spark.read.json(str(tmp_path / "json")).count() == 2


def test_merge_keeps_latest(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, ts long")
    n = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k long, v string, ts long")
    assert {(r.k, r.v) for r in ST.merge_feedback(t, n, ["k"], ["ts"]).collect()} == {(1, "a"), (2, "d"), (3, "e")}
