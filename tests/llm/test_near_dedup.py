import collections
import random

import pytest
from corpus import LOW, SCHEMA, documents

from plumbline.llm import near_dedup as nd
from plumbline.llm.graph import components


def groups(docs, k, percent):
    sets = []
    for d, t, *_ in docs:
        w = [x for x in __import__("re").split("[\x20\x09-\x0D]+", (t or "").translate(LOW)) if x]
        sets.append(({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set(), d))
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, (a, _) in enumerate(sets):
        for j in range(i):
            b = sets[j][0]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, (_, d) in enumerate(sets):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(a), least[find(i)], d == least[find(i)]) for i, (a, d) in enumerate(sets)}


@pytest.mark.parametrize("k,percent,rounds", [(3, 85, 3), (5, 80, 1), (3, 85, 0)])
def test_against_all_pairs(spark, k, percent, rounds):
    docs = documents(7, 180)
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as node", "2 as label", "3 as mark")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_groups(df, k, percent, rounds).collect()}
    want = groups(docs, k, percent)
    assert got == want and len({c for _, c, _ in want.values()}) < 150


def test_chain_of_copies_without_a_common_leader(spark):
    rng = random.Random(9)
    w, docs = [f"w{i}" for i in range(120)], []
    for i in range(40):
        docs.append((100 - i, " ".join(w), None, None, None))
        w[(i * 7) % 120] = f"n{rng.random()}"
    df = spark.createDataFrame(docs, SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_groups(df, 3, 85).collect()}
    assert got == groups(docs, 3, 85)


def test_odd_rows_and_the_kept_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "A b c d"), (2, "a b  c d"), (2, "a b  c d"), (5, None), (6, ""), (7, " \t"), (8, "x y"), (None, "q")],
                               "doc_id long, text string").selectExpr("*", "1 as label", "2 as blank")
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in nd.near_groups(df).collect())
    assert got == {(None, 2, False): 2, (2, 2, True): 2, (5, 5, True): 1, (6, 6, True): 1, (7, 7, True): 1, (8, 8, True): 1, (None, None, False): 1}
    kept = nd.keep_one(df)
    assert kept.columns == df.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == {2: 1, 5: 1, 6: 1, 7: 1, 8: 1, None: 1}
    assert nd.near_groups(df.limit(0)).count() == 0 and nd.keep_one(df.limit(0)).count() == 0


def test_odd_sketches_estimate_high_similarity():
    import numpy as np
    rng, s = np.random.default_rng(1), nd.Signer()
    for share in (0.8, 0.9, 0.97):
        err = []
        for _ in range(20):
            a = rng.integers(0, 1 << 63, 600).astype(np.uint64)
            n = int(600 * (1 - share) / (1 + share))
            b = np.concatenate([a[n:], rng.integers(0, 1 << 63, n).astype(np.uint64)])
            x, y = (np.frombuffer(s.sketch(s.samples(np.unique(v))), np.uint64) for v in (a, b))
            err.append(nd.sketch_similarity(np.bitwise_count(x ^ y).sum()) - share)
        assert abs(np.mean(err)) < 0.02 and np.std(err) < 0.05


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 4), (7, 8), (8, 7), (20, 21), *[(50, i) for i in range(51, 120)], (119, 120)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([1, 2, 3, 4, 10], 1), 7: 7, 8: 7, 20: 20, 21: 20, **dict.fromkeys(range(50, 121), 50)}
