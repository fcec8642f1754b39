import hashlib
import random

import numpy as np

from plumbline.llm import fingerprint as fp


def jaccard(a, b):
    keys = {*a, *b}
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys)


def test_collision_rate_is_the_generalised_jaccard_similarity():
    rng = random.Random(2)
    s = fp.Sampler(1024, 4096)
    for _ in range(12):
        x = fp.Counter({b"t%d" % i: rng.choice([1, 1, 2, 3, 9]) for i in range(60)})
        y = fp.Counter({k: (v if rng.random() < 0.6 else rng.choice([1, 4])) for k, v in x.items() if rng.random() < 0.8})
        y[b"other"] = 5
        assert abs(fp.likeness(s.of(x), s.of(y)) - jaccard(x, y)) < 0.08


def test_long_texts_and_full_tables_change_nothing():
    x = {b"w%d" % i: 1 + i % 3 for i in range(9000)}
    a, b = fp.Sampler(64, 3000).of(x), fp.Sampler(64, 20000).of(dict(reversed(x.items())))
    assert np.array_equal(a, b)


def test_edited_fingerprints_against_plain_python(spark):
    rng = random.Random(4)
    texts = ["", None, "one", "A b a", "   ", "ééé😀 x"] + ["".join(rng.choice("ab cé😀\n") for _ in range(rng.randint(0, 90))) for _ in range(150)]
    docs = [(7 * i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as bucket", "2 as guest", "'x' as home", "3 as b").repartition(5)
    got = {r.doc_id: r for r in fp.edited_fingerprints(df).collect()}
    assert len(got) == len(docs)
    s = fp.Sampler()
    order = sorted(docs, reverse=True)
    for (d, t), (_, u) in zip(order, [*order[1:], order[0]]):
        t, u, r = t or "", u or "", got[d]
        h = len(t) // 2
        e = t[:len(t) - h] + u[:h]
        f, g, n = (s.of(fp.terms(x)) for x in (t, e, u))
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), fp.digits(f), fp.digits(g))
        assert r.near_edited == (f == g).mean() and r.near_next == (f == n).mean()
    assert got[0].fingerprint == got[7].fingerprint


def test_ties_nulls_one_row_and_none(spark):
    some = spark.createDataFrame([(None, "a"), (None, "a"), (3, "b"), (3, "b"), (3, "c")], "doc_id long, text string")
    assert fp.edited_fingerprints(some).count() == 5
    one = fp.edited_fingerprints(some.where("text = 'c'")).collect()
    assert len(one) == 1 and one[0].near_next == 1 and one[0].near_edited == 1
    assert fp.edited_fingerprints(some.limit(0)).count() == 0
    assert fp.fingerprints(some).where("doc_id is null").select("fingerprint").distinct().count() == 1


def test_the_query_takes_96_samples(spark, base):
    r = fp.op2_fingerprint(spark, base).first()
    assert len(r.fingerprint) == len(r.edited_fingerprint) == 4 * 96 and r.near_next * 96 == int(r.near_next * 96)
    assert len(fp.fingerprints(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).first().fingerprint) == 4 * 96
