import random

from plumbline.llm import license_scan as ls


def longest(text, templates, end):
    """Longest run of words ending before ``end`` that stands in a template."""
    best = 0
    for t in templates:
        for i in range(len(t)):
            n = 0
            while n < end and i - n >= 0 and text[end - 1 - n] == t[i - n]:
                n += 1
            best = max(best, n)
    return best


def test_matching_statistics_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        ab = [b"a", b"b", b"c"]
        ts = [[rng.choice(ab) for _ in range(rng.randint(1, 9))] for _ in range(3)]
        ph = [([rng.choice(ab) for _ in range(rng.randint(1, 3))], str(k)) for k in range(2)]
        auto = ls.Automaton(ts, ph)
        text = [rng.choice([*ab, b"x"]) for _ in range(40)]
        every = ts + [p for p, _ in ph]
        ms = [longest(text, every, e) for e in range(len(text) + 1)]
        ends = {e: ms[e] for e in range(1, len(text) + 1) if ms[e] and (e == len(text) or ms[e + 1] != ms[e] + 1)}
        runs, found = auto.stream(text, 1)
        assert {s + n: n for s, n, _ in runs} == ends
        for s, n, state in runs:
            for k, places in auto.places[state].items():
                assert all(ts[k][e - n:e] == text[s:s + n] for e in places)
        assert sorted(found) == sorted((i, label) for p, label in ph for i in range(len(text)) if text[i:i + len(p)] == p)


def test_scan(spark):
    mit = ls.TEMPLATES["MIT"][1]
    docs = [(1, "Is MIT  License, mit-LICENSE? Apache License"), (2, None), (3, ""), (4, f"so {mit} end"), (4, f"so {mit} end"),
            (5, "GENERAL public license"), (6, "x " * 50000 + "Released under the MIT License."), (None, "é"), (7, "general public licenses"),
            (8, mit.replace("free of charge", "at no cost"))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("text", "Text").selectExpr("*", "1 as labels", "'x' as score")
    got = {(r.doc_id, k): r for k, r in enumerate(ls.scan(df, text_col="Text").collect())}
    by = {}
    for (d, _), r in got.items():
        by.setdefault(d, []).append(r)
    assert (by[1][0].n_words, by[1][0].n_base, by[1][0].first_word, by[1][0].last_word, by[1][0].base_labels) == (7, 3, 1, 5, "apache,mit")
    for d in (2, 3):
        r = by[d][0]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, r.spans) == (0, 0, None, None, "", "", 0.0, [])
    assert len(by[4]) == 2 and by[4][0] == by[4][1] and by[4][0].labels == "MIT" and by[4][0].score == 1
    span = by[4][0].spans[0]
    assert (span.start, span.end) == (1, 1 + len(ls.words(mit.encode())))
    assert by[5][0].base_labels == "gpl" and by[7][0].n_base == 0 and by[None][0].n_words == 1
    assert by[6][0].labels == "MIT,mit" and by[6][0].first_word == 50003
    assert by[8][0].labels == "MIT" and 0.8 < by[8][0].score < 1


def labels(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.labels for r in ls.scan(df).orderBy("doc_id").collect()]


def test_every_wording_has_its_own_label(spark):
    flat = [(label, t) for label, ts in ls.TEMPLATES.items() for t in ts]
    got = labels(spark, *(f"Copyright the authors. {t} More words follow here." for _, t in flat))
    assert [[x for x in g.split(",") if x not in ls.PHRASES.values()] for g in got] == [[label] for label, _ in flat]
    assert len(ls.TEMPLATES) >= 20
    two = labels(spark, ls.TEMPLATES["GPL-2.0"][1] + " and also " + ls.TEMPLATES["Zlib"][0], ls.TEMPLATES["LGPL-2.1"][0].replace("your", "any"))
    assert two == ["GPL-2.0,Zlib,gpl", "LGPL-2.1,gpl"]


def plain_chains(runs, ends, gap):
    """All ways to place the runs in one template; the words covered by the longest chain from the first run on."""
    def on(i, at, end):
        best = 0
        for j in range(i, len(runs)):
            start, n = runs[j]
            if start - at > gap:
                break
            for e in ends[j]:
                if 0 <= e - n - end <= gap:
                    best = max(best, n + on(j + 1, start + n, e))
        return best
    start, n = runs[0]
    return max((n + on(1, start + n, e) for e in ends[0]), default=0)


def test_chains_against_all_ways():
    rng = random.Random(12)
    for _ in range(300):
        runs, ends, at = [], [], 0
        for _ in range(rng.randint(1, 5)):
            at += rng.randint(0, 2)
            n = rng.randint(3, 5)
            runs.append((at, n))
            at += n
        first = rng.randint(3, 6)
        place = first
        for i, (start, n) in enumerate(runs):  # one true way and some other places of the same run
            place += (start - runs[i - 1][0] - runs[i - 1][1] + n) if i else 0
            ends.append(sorted({place, *(rng.randint(n, 40) for _ in range(rng.randint(0, 2)))}))
        got = ls.chains([(s, n, i) for i, (s, n) in enumerate(runs)], [{0: e} for e in ends], 2)
        assert got == [[0, runs[0][0], runs[-1][0] + runs[-1][1], sum(n for _, n in runs)]]
        assert plain_chains(runs, ends, 2) == got[0][3]


def test_empty_table(spark):
    assert ls.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
