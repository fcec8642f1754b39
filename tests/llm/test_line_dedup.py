import collections

from corpus import SCHEMA, documents

from plumbline.llm.line_dedup import drop_site_lines


def test_against_plain_python(spark):
    docs = documents(3) + [(None, "Menu here\nMenu here\nrest", "en", None, 0), (None, "Menu here\nMenu here\nrest", "en", None, 0)]
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as `row`", "2 as bad", "3 as key")
    total = collections.Counter(s for _, _, _, s, _ in docs)
    pages = collections.Counter((s, x) for _, t, _, s, _ in docs for x in {y.strip(" ") for y in (t or "").split("\n")} if x)
    bad = {k for k, n in pages.items() if n >= 3 and n > 0.1 * total[k[0]]}
    assert bad
    want = collections.Counter()
    for d, t, _, s, _ in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if (s, x.strip(" ")) not in bad]
        want[d, s, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    out = drop_site_lines(df, 0.1, 3)
    assert collections.Counter(tuple(r) for r in out.select("row.doc_id", "row.source", "n_lines", "n_dropped", "text").collect()) == want
    assert out.select("row.*").columns == df.columns
    assert drop_site_lines(df.limit(0)).count() == 0


def test_copies_of_a_page_are_one_page(spark):
    lines = lambda i: f"head of {i}\nShared menu\nbody of {i}"
    docs = [(i, lines(i), "en", "s", 0) for i in range(40)] + [(100 + i, "clean one\nclean two", "en", "s", 0) for i in range(12)]
    docs += [(200 + i, "clean one\nclean two", "en", None, 0) for i in range(6)] + [(300 + i, None, "en", None, 0) for i in range(6)]
    got = {r.row.doc_id: r.text for r in drop_site_lines(spark.createDataFrame(docs, SCHEMA), copies_once=True).collect()}
    assert got == {d: "\n".join(x for x in (t or "").split("\n") if x != "Shared menu") for d, t, *_ in docs}
    assert drop_site_lines(spark.createDataFrame([], SCHEMA), copies_once=True).count() == 0
