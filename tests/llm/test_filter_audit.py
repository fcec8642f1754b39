import itertools
import re

import duckdb
from corpus import SCHEMA, documents

from plumbline.llm import filter_audit as fa
from plumbline.llm.base import ORACLE

COLS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def expected(docs, labels, least=200):
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    good, toxic = ({d for d, *v in labels if v[i] == 1} for i in (0, 1))
    rows = []
    for d, t, p in docs:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        f = {"A": len(w) < least, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
             "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and first[t] < d}
        rows.append((p or "", {k for k, v in f.items() if v}, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        value = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left, gone = mine, []
            for step, k in enumerate(order, 1):
                here = [r for r in left if k in r[1]]
                out[part, order, step] = [len(left) - len(here), len(here), sum(k in r[1] for r in gone), sum(r[1] == {k} for r in mine),
                                          sum(r[2] for r in here), sum(r[3] for r in here)]
                value[k] += len(here)
                left, gone = [r for r in left if k not in r[1]], gone + here
        for (p, order, step), v in out.items():
            if p == part:
                v.append(value[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def run(spark, docs, labels, least=200):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as mask", "2 as n", "'x' as part", "true as good")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'y' as part")
    got = fa.audit(d, lab, fa.text_failures(least)).select(*COLS).collect()
    assert len(got) == len({r[:3] for r in got})
    return {tuple(r) for r in got}


def test_against_plain_python(spark):
    docs = [(d, t, s) for d, t, _, s, _ in documents(7, 200)]
    docs += [(9_000 + i, "a copy many times over | marked", "s0") for i in range(80)] + [(99_000, "Word#" * 30_000, "s2"), (99_001, "x " * 90_000, "s2")]
    labels = [(d, i % 2, i % 3 == 0) for i, (d, *_) in enumerate(docs) if i % 4 < 3]
    labels = [(d, q, int(t)) for d, q, t in labels] + [(docs[0][0], 1, 1), (None, 1, 1), (123_456, 1, 1), (docs[1][0], None, None)]
    assert run(spark, docs, labels, 20) == expected(docs, labels, 20)


def test_repeats_nulls_and_no_rows(spark):
    docs = [(1, "A b", "p"), (1, "A b", "p"), (1, "A b", "q"), (2, "A b", None), (None, "A b", "p"), (None, None, "p"), (3, None, ""), (4, "", "q"), (5, "\t  \x0b", "q")]
    labels = [(1, 1, 0), (2, 0, 1), (1, 0, 1)]
    assert run(spark, docs, labels, 2) == expected(docs, labels, 2)
    assert run(spark, [], labels) == set()


def test_fields_do_not_run_over():
    steps = fa.Steps("ABCDE")
    most = 2 ** 62
    got = steps.unpack(sum(steps.code(m, most // 32, most // 64, most // 64) for m in range(32)))
    first = [i for i in range(steps.n) if i % 5 == 0]
    assert {int(got["removed"][i]) for i in first} == {most // 2} and {int(got["kept"][i]) for i in range(4, 600, 5)} == {most // 32}
    assert {int(v) for v in got["unique_fails"]} == {most // 32} and {int(got["good_lost"][i]) for i in first} == {most // 4}


def test_query_against_sql(spark, base):
    for name in ("documents", "labels"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{base}/{name}.parquet'")
    want = duckdb.sql(f"SELECT {', '.join(COLS)} FROM ({ORACLE['op12_filter_audit']})").fetchall()
    got = fa.op12_filter_audit(spark, base).select(*COLS).collect()
    assert sorted(map(tuple, got)) == sorted(want)
