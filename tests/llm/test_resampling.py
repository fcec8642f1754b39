import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from corpus import LOW, SCHEMA, documents

from plumbline.llm import resampling as rs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def parts(text):
    w = WORD.findall((text or "").translate(LOW))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def expected(docs, target, percent=25, seed=7, k=10_000, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % k
    s = collections.Counter(bucket(f) for _, t in docs for f in parts(t)[1])
    t = collections.Counter(bucket(f) for x in target for f in parts(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + k) / ((s[b] + 1) * (n_t + k))))
    rows = []
    for d, x in docs:
        w, f = parts(x)
        weight = sum(gain(bucket(i)) for i in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[2]))
    return rows, able[:percent * len(able) // 100]


def compare(got, docs, target, **how):
    rows, won = expected(docs, target, **how)
    assert collections.Counter(tuple(r)[:5] for r in got) == collections.Counter(rows)
    assert [tuple(r)[:5] for r in sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)] == won
    assert sorted(r.rank for r in got if r.rank is not None) == list(range(1, len(won) + 1))


def test_against_plain_python(spark):
    docs = [(d, t) for d, t, *_ in documents(3, 300)] + [(50_000, "Ab " * 30_000), (50_001, "z" * 400 + " " + "ÄÖ" * 300 + " a " * 30)]
    target = ["what is the second word", None, "", docs[20][1], "ab ab ab"]
    df = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, score int, k0 int").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for chunk in (7, 1 << 20):
        compare(rs.resample(df, goal, chunk=chunk).collect(), docs, target)
    compare(rs.resample(df, goal, percent=100, min_words=0, seed=3, buckets=50).collect(), docs, target, percent=100, least=0, seed=3, k=50)


def test_ties_nulls_and_no_rows(spark):
    text = "one two three " * 10
    docs = [(1, text)] * 9 + [(None, text)] * 3 + [(2, None), (3, ""), (1, text + " more words")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    goal = df.limit(0).select("text")
    compare(rs.resample(df, goal, percent=60).collect(), docs, [], percent=60)
    assert rs.resample(df.limit(0), goal).count() == 0
    assert all(r.rank is None for r in rs.resample(df.where("text = ''"), goal).collect())


def test_features_of_odd_words():
    rng = random.Random(2)
    long = ["".join(rng.choice("aZ9é日") for _ in range(n)) for n in (1, 200, 254, 255, 256, 700)]
    texts = ["", " ", " ".join(rng.choice(long) for _ in range(60)), "ends with word", "begins", "É\x00b-c", *long]
    one, two, ends = rs.features(pa.array(["skipped", *texts]).slice(1), 9973)
    at = 0
    for text, end in zip(texts, ends.tolist()):
        w, f = parts(text)
        assert one[at:end].tolist() == [zlib.crc32(x.encode()) % 9973 for x in w]
        assert [b for b in two[at:end].tolist() if b >= 0] == [zlib.crc32(x.encode()) % 9973 for x in f[len(w):]]
        at = end


def test_each_round_discards_a_share(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(50), i) for i in range(3_000)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(6)
    ordered = sorted(rows)
    for k in (1, 1500, 3000):
        assert rs.smallest_keys_end(df, ["a", "b"], k, chunk=40) == ordered[k - 1]


def test_gains_lean_towards_the_target(spark):
    like, unlike = "sun moon star " * 20, "mud dust clay " * 20
    docs = [(i, like if i % 2 else unlike) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rs.resample(df, spark.createDataFrame([("star moon sun " * 50,)] * 100, "text string")).collect()
    drawn = [r for r in got if r.rank is not None]
    assert len(drawn) == 100 and np.mean([r.doc_id % 2 for r in drawn]) > 0.95
