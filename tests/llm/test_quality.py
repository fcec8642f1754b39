import math
import random

import numpy as np
from corpus import SCHEMA, documents

from plumbline.llm import quality as q


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        kind, w = i % 8, [rng.choice(vocab) for _ in range(rng.randint(30, 120))]
        if kind == 0:
            w = [x + rng.choice(["***", "$$$"]) for x in w]
        elif kind == 1:
            w = [rng.choice(vocab)] * len(w)
        elif kind == 2:
            w[::9] = [rng.choice(["rotten", "vile"]) for _ in w[::9]]
        rows.append((i, " ".join(w) + ".", "en", f"s{i % 3}", 0))
        labels.append((i, int(kind not in (0, 1)), int(kind == 2)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, quality int, toxic int")
    model = q.fit(docs, known)
    got = {r.doc_id: r.kept for r in q.judge(docs.selectExpr("*", "1 as site", "2 as bad"), model).collect()}
    held = [x for x in labels if x[0] % 5 == 0]
    assert sum(got[d] == (good == 1 and toxic == 0) for d, good, toxic in held) >= 0.95 * len(held)
    kept = q.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(got.values())


def test_posteriors_against_plain_python(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice(["x", "y", None]), rng.gauss(-1, 2)) for _ in range(300)]
    rows += [("lone", "x", 6.0)]
    got = {(r.site, r.path): r for r in q.posteriors(spark.createDataFrame(rows, "site string, path string, evidence double")).collect()}
    p = lambda e: 1 / (1 + math.exp(-e))
    every = [p(e) for _, _, e in rows]
    mu, n = np.mean(every), len(every)
    noise = np.mean(np.square(every)) - mu * mu

    def strength(key):
        g = {}
        for s, t, e in rows:
            g.setdefault(key(s, t), []).append(p(e))
        between = sum(len(v) * (np.mean(v) - mu) ** 2 for v in g.values())
        spread = (between - (len(g) - 1) * noise) / (n - sum(len(v) ** 2 for v in g.values()) / n)
        return min(max(mu * (1 - mu) / max(spread, 1e-9) - 1, 1.0), 1e6), g
    above, sites = strength(lambda s, t: s)
    below, paths = strength(lambda s, t: (s, t))
    for k, v in paths.items():
        site = (sum(sites[k[0]]) + above * mu) / (len(sites[k[0]]) + above)
        path = (sum(v) + below * site) / (len(v) + below)
        assert abs(got[k].site_rate - site) < 1e-9 and abs(got[k].path_rate - path) < 1e-9 and got[k].n == len(v)
        assert abs(got[k]["shift"] - (math.log(path / (1 - path)) - math.log(mu / (1 - mu)))) < 1e-9
    assert abs(got["lone", "x"].path_rate - mu) < abs(p(6.0) - mu)


def test_odd_rows(spark):
    docs = spark.createDataFrame(documents(2, 20) + [(None, None, None, None, None)] * 2, SCHEMA)
    labels = spark.createDataFrame([(None, 0, 1), (1, None, None), (1, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    for l in (labels, labels.limit(0)):
        model = q.fit(docs, l)
        assert q.judge(docs, model).where("kept").count() == docs.count()
        assert q.keep_good(docs, model).count() == docs.count()
    assert q.judge(docs.limit(0), model).count() == 0 and q.keep_good(docs.limit(0), model).count() == 0
    rows, known = corpus(160)
    model = q.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(known, "doc_id long, quality int, toxic int"))
    assert q.judge(docs, model).count() == docs.count()
