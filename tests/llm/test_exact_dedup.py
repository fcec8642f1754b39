import collections
import hashlib

from corpus import LOW, SCHEMA, documents

from plumbline.llm.exact_dedup import exact_groups


def expected(docs, best):
    by = collections.defaultdict(list)
    for d, t, *_ in docs:
        by[(t or "").translate(LOW)].append(d)
    return {d: (best(v), len(v), d == best(v), hashlib.sha256(k.encode()).hexdigest()) for k, v in by.items() for d in v}


def test_against_plain_python(spark):
    docs = documents()
    docs += [(20_000 + i, "A hot text, many times over", "en", "s0", 27) for i in range(150)]
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as prefix", "'x' as norm", "true as kept")
    for keep, best in (("smallest", min), ("largest", max)):
        got = {r.doc_id: tuple(r)[1:] for r in exact_groups(df, keep).collect()}
        assert got == expected(docs, best)


def test_hot_prefix_of_different_texts(spark):
    docs = [(i, "the same long beginning of all these texts " + str(i % 40), None, None, None) for i in range(400)]
    got = {r.doc_id: tuple(r)[1:] for r in exact_groups(spark.createDataFrame(docs, SCHEMA), "largest").collect()}
    assert got == expected(docs, max)


def test_ties_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, None), (3, "")], "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(df, "largest").collect())
    assert got == {(1, 1, 3, True): 1, (1, 1, 3, False): 1, (None, 1, 3, False): 1, (None, None, 2, True): 1, (None, None, 2, False): 1,
                   (2, 3, 2, False): 1, (3, 3, 2, True): 1}
    assert exact_groups(df.limit(0)).count() == 0
