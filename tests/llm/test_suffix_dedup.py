import collections
import hashlib
import random

import numpy as np
import pytest
from corpus import SCHEMA, documents

from plumbline.llm import suffix_dedup as sd


def expected(docs, length):
    texts = [(t or "").encode() for _, t, *_ in docs]
    seen = collections.Counter(b[i:i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for (d, *_), b in zip(docs, texts):
        cut = sd.merged([(i, i + length) for i in range(len(b) - length + 1) if seen[b[i:i + length]] > 1])
        out.append((d, len(b), sum(e - s for s, e in cut), len(cut), hashlib.sha256(sd.without(b, cut)).hexdigest()))
    return collections.Counter(out)


def test_refined_windows_against_brute_force():
    rng = random.Random(2)
    for _ in range(40):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 90))) for _ in range(6)]
        texts += [texts[0][3:], b"a" * 70, b""]
        weights = [rng.choice([1, 1, 2]) for _ in texts]
        n = rng.choice([8, 9, 20, 47])
        seen = collections.Counter()
        for t, w in zip(texts, weights):
            for i in range(len(t) - n + 1):
                seen[t[i:i + n]] += w
        want = [[seen[t[i:i + n]] > 1 for i in range(len(t) - n + 1)] for t in texts]
        assert [x.tolist() for x in sd.refine(texts, weights, n)] == want


def test_anchors_cover_all_windows_and_depend_on_them_alone():
    rng = random.Random(4)
    a = sd.Anchors(60)
    for _ in range(20):
        common = bytes(rng.choice(b"abc ") for _ in range(150))
        x = bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 200))) + common
        y = common + bytes(rng.choice(b"abc ") for _ in range(90))

        def at(text):
            h, _, p, lo, hi = a.of(text)
            assert np.array_equal(np.concatenate([np.arange(i, j + 1) for i, j in zip(lo, hi)]), np.arange(len(text) - 59))
            return {s: (int(k), int(q) - s) for k, q, i, j in zip(h, p, lo, hi) for s in range(i, j + 1)}
        u, v = at(x), at(y)
        for s in range(len(common) - 59):
            assert u[len(x) - len(common) + s] == v[s]


@pytest.mark.parametrize("many", [2048, 1])
def test_against_all_windows(spark, monkeypatch, many):
    monkeypatch.setattr(sd, "MANY", many)
    docs = documents(11, 150)
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as k1", "2 as body", "3 as cut")
    for length in (200, 60):
        got = collections.Counter(tuple(r)[:5] for r in sd.repeated_spans(df, length).collect())
        assert got == expected(docs, length)


def test_odd_rows_and_shorter_texts(spark):
    p = "é" * 130
    docs = [(1, "x" + p), (2, p + "yy"), (None, None), (3, ""), (4, "z" * 700), (5, "same " * 50 + "end"), (5, "same " * 50 + "end"), (6, "short")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as cut", "2 as spans")
    got = collections.Counter(tuple(r)[:5] for r in sd.repeated_spans(df).collect())
    assert got == expected(docs, 200)
    out = sd.drop_repeats(df)
    assert out.select("row.*").columns == df.columns
    texts = collections.Counter((r[0].doc_id, r.text) for r in out.collect())
    assert texts == collections.Counter([(1, "x"), (2, "yy"), (None, None), (3, ""), (4, ""), (5, ""), (5, ""), (6, "short")])
    assert sd.repeated_spans(df.limit(0)).count() == 0 and sd.drop_repeats(df.limit(0)).count() == 0


def test_long_text_over_several_blocks(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(sd, "BLOCK", 256)
    x = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    docs = [(1, x), (2, "q" + x[500:2500] + "w"), (3, x[:900])]
    a = [sd.Anchors(200).of(t.encode()) for _, t in docs]
    assert all(len(h) for h, *_ in a)
    got = collections.Counter(tuple(r)[:5] for r in sd.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == expected(docs, 200)


def test_passage_of_many_texts_gives_one_span_a_text(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(5)) for _ in range(n))
    passage, twin = word(120), word(50)
    docs = [(i, f"{word(rng.randint(0, 9))} {passage} {word(rng.randint(0, 9))}" + (f" {twin}" if i < 3 else "") + (f" {passage}" if i % 40 == 0 else ""), None, None, 0) for i in range(130)]
    docs += [(1000 + i, docs[i][1], None, None, 0) for i in range(3)]
    asked, crowded = [], sd._crowded
    monkeypatch.setattr(sd, "_crowded", lambda texts, hot, length: (asked.append((crowded(texts, hot, length), len(hot))), asked[-1][0])[1])
    df = spark.createDataFrame(docs, SCHEMA)
    assert collections.Counter(tuple(r)[:5] for r in sd.repeated_spans(df).collect()) == expected(docs, 200)
    assert asked[0][1] > 3 and asked[0][0].count() == 127 + 3  # texts that stand twice have no spans, three others hold it twice
