"""Every stage against plain Python, on its own input, and the whole of it."""

import collections

import corpus_pipeline as cp
from corpus import SCHEMA, documents
from test_near_dedup import groups
from test_packing import check
from test_quality import corpus

from plumbline.llm import quality, suffix_dedup


def written(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_stages_in_turn(spark, tmp_path):
    rows, labels = corpus(240)
    docs = [*rows, *[(d + 10_000, t, lang, s, n) for d, t, lang, s, n in documents(21, 90)]]
    d = written(spark.createDataFrame(docs, SCHEMA).selectExpr("*", "doc_id * 2 as label", "'k' as `row`"), tmp_path / "documents.parquet")
    written(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), tmp_path / "labels.parquet")
    base, take = str(tmp_path), lambda df: {r.doc_id: r for r in df.collect()}

    a = written(cp.quality_stage(spark, d, base), tmp_path / "a")
    assert a.columns == d.columns
    model = quality.fit(d, spark.read.parquet(base + "/labels.parquet"))
    kept = {r.doc_id for r in quality.judge(d, model).where("kept").collect()}
    assert set(take(a)) == kept
    clean = {x for x, q, t in labels if q == 1 and t == 0}
    assert len(clean - kept) <= 0.02 * len(clean) and len(kept & ({x for x, _, _ in labels} - clean)) <= 0.1 * len(labels)

    b = written(cp.line_stage(spark, a, base), tmp_path / "b")
    was, now = take(a), take(b)
    total = collections.Counter(r.source for r in was.values())
    pages = collections.Counter((r.source, x) for r in was.values() for x in {y.strip(" ") for y in (r.text or "").split("\n")} if x)
    bad = {k for k, n in pages.items() if n >= 5 and n > 0.05 * total[k[0]]}
    for i, r in was.items():
        want = None if r.text is None else "\n".join(x for x in r.text.split("\n") if (r.source, x.strip(" ")) not in bad)
        assert now[i].text == want and now[i].n_chars == (None if want is None else len(want)) and now[i]["label"] == r["label"]

    c = written(cp.near_stage(spark, b, base), tmp_path / "c")
    assert c.columns == d.columns and {i for i, (_, _, k) in groups([(r.doc_id, r.text) for r in now.values()], 5, 80).items() if k} == set(take(c))

    e = written(cp.suffix_stage(spark, c, base), tmp_path / "e")
    was, now = take(c), take(e)
    seen = collections.Counter(x[i:i + 200] for r in was.values() for x in [(r.text or "").encode()] for i in range(len(x) - 199))
    for i, r in was.items():
        x = (r.text or "").encode()
        gone = suffix_dedup.merged([(k, k + 200) for k in range(len(x) - 199) if seen[x[k:k + 200]] > 1])
        if not gone:
            assert now[i].text == r.text
        else:
            assert abs(len(now[i].text.encode()) - len(suffix_dedup.without(x, gone))) <= 6 * len(gone) and now[i].n_chars == len(now[i].text)

    check(cp.packing_stage(spark, e, base).collect(), [(r.doc_id, r.text) for r in now.values()], 4096)
    got = cp.run(spark, base)
    assert sum(r["length"] for r in got.collect()) == sum(r["length"] for r in cp.packing_stage(spark, e, base).collect())


def test_no_rows_and_odd_rows(spark, tmp_path):
    odd = [(None, None, None, None, None), (None, None, None, None, None), (1, "", None, "s", 0), (1, "", None, "s", 0), (2, "word", "en", None, 4)]
    for name, rows in (("none", []), ("odd", odd)):
        base = tmp_path / name
        written(spark.createDataFrame(rows, SCHEMA), base / "documents.parquet")
        written(spark.createDataFrame([], "doc_id long, quality int, toxic int"), base / "labels.parquet")
        assert sum(r["length"] for r in cp.run(spark, str(base)).collect()) == (6 if rows else 0)


def test_a_group_of_copies_leaves_one_document(spark, tmp_path):
    text = "\n".join(f"line {i} of a clean document says {i * i} and {i * 7}" for i in range(12))
    rows = [(i, "\n".join(f"page {i} writes {i * 31 + k} then {k}" for k in range(8)) + "\nMenu", "en", "s", 0) for i in range(40)]
    d = spark.createDataFrame([*rows, *[(100 + i, text, "en", "s", 0) for i in range(10)]], SCHEMA)
    b = written(cp.line_stage(spark, d, str(tmp_path)), tmp_path / "b")
    assert {r.text for r in b.where("doc_id >= 100").collect()} == {text}
    assert b.where("doc_id < 100 and text like '%Menu%'").count() == 0
    assert [r.text for r in cp.near_stage(spark, b, str(tmp_path)).where("doc_id >= 100").collect()] == [text]
