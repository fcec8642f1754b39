import random

import numpy as np
import pytest

from plumbline.operators import isotonic


def plain(points):
    """Equal scores first, then adjacent violators pooled one by one."""
    by = {}
    for x, y in points:
        by.setdefault(x, []).append(y)
    out = []
    for x in sorted(by):
        out.append((sum(by[x]), len(by[x]), [x]))
        while len(out) > 1 and out[-2][0] * out[-1][1] >= out[-1][0] * out[-2][1]:
            y, n, xs = out.pop()
            out[-1] = (out[-1][0] + y, out[-1][1] + n, out[-1][2] + xs)
    return {x: y / n for y, n, xs in out for x in xs}


def make(kind, n=1500):
    rnd = random.Random(kind)
    xs = [rnd.randrange(4000) / 1000 for _ in range(n)] if kind != "rising" else [i / 7 for i in range(n)]
    ys = {"noise": lambda x: int(rnd.random() < x / 4), "falling": lambda x: int(rnd.random() < 1 - x / 4), "rising": lambda x: x ** 1.5,
          "valley": lambda x: abs(x - 2) + rnd.random(), "cliff": lambda x: 0.01 * x if x < 3.9 else -50.0}[kind]
    return [(x, float(ys(x))) for x in xs]


@pytest.mark.parametrize("kind", ["noise", "falling", "rising", "valley", "cliff"])
def test_ranges_join_up_to_the_plain_fit(spark, kind):
    points = make(kind)
    d = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(-1, None, 1.0), (-2, 0.5, None)], "id long, s double, y double")
    want = plain(points)
    for size in (150, 1 << 18):
        table = isotonic.fit(d, "s", "y", size).cache()
        for sent in (1 << 17, 0):
            got = isotonic.apply(d, table, "s", "v", sent).collect()
            assert len(got) == len(points) + 2 and [r.v for r in got if r.id == -1] == [None]
            np.testing.assert_allclose([r.v for r in got if r.id >= 0], [want[r.s] for r in got if r.id >= 0], rtol=1e-12, atol=1e-12)


def test_between_and_outside_of_scores(spark):
    points = [(0.1, 0), (0.3, 1), (0.5, 0), (0.7, 1), (0.9, 1)]
    table = isotonic.fit(spark.createDataFrame(points, "s double, y int"), "s", "y").cache()
    asked = spark.createDataFrame([(x,) for x in (-1.0, 0.1, 0.2, 0.3, 0.4, 0.6, 0.8, 2.0)] * 3, "s double")
    for sent in (100, 0):
        got = {r.s: r.v for r in isotonic.apply(asked, table, "s", "v", sent).collect()}
        assert {k: round(v, 9) for k, v in got.items()} == {-1.0: 0.0, 0.1: 0.0, 0.2: 0.25, 0.3: 0.5, 0.4: 0.5, 0.6: 0.75, 0.8: 1.0, 2.0: 1.0}
    empty = isotonic.fit(spark.createDataFrame([], "s double, y int"), "s", "y")
    for sent in (100, -1):
        assert {r.v for r in isotonic.apply(asked, empty, "s", "v", sent).collect()} == {None}
