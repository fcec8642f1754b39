"""Monotone calibration of scores, fitted and applied without bringing the scores together.

The fitted value of a score is the slope of the greatest convex minorant of the running sums (weight, sum of labels) at
it. Ranges of scores pool their own rows (pool adjacent violators). What then reaches over the end of a range is one edge of the
minorant: the common tangent of all points before the end and all after it. For a given slope the point that
touches is the least of y - s w, which ranges find on their own and which combines like any minimum; the slopes close in on
the tangents of all range ends together. Only numbers per range reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.session import written

#: Distinct scores of a range, and pools that may be sent to all executors (24 bytes each).
RANGE, SENT = 1 << 18, 1 << 17


def pools(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Ends (exclusive) of the pools of adjacent violators; means rise strictly from pool to pool."""
    ends, ys, ws = [], [], []
    for i, (a, b) in enumerate(zip(y.tolist(), w.tolist()), 1):
        while ends and ys[-1] * b >= a * ws[-1]:
            a, b = a + ys.pop(), b + ws.pop()
            ends.pop()
        ends.append(i)
        ys.append(a)
        ws.append(b)
    return np.array(ends, np.int64)


def _corners(pdf: pd.DataFrame, before: tuple[float, float] | None, y0: float, w0: float) -> tuple[np.ndarray, np.ndarray]:
    """Corners of the minorant of a range's own points; ``before`` is the origin, which only the first range has."""
    y, w = y0 + np.cumsum(pdf["y"].to_numpy(float)), w0 + np.cumsum(pdf["w"].to_numpy(float))
    if before is not None:
        y, w = np.concatenate([[before[0]], y]), np.concatenate([[before[1]], w])
    at = np.concatenate([[0], pools(np.diff(y), np.diff(w))]) if len(y) > 1 else np.array([0])
    return y[at], w[at]


def _tangents(corners: DataFrame, parts: list[int]) -> dict[int, tuple[float, float, float]]:
    """For the end of each range but the last: slope, and weight sums at the left and right end, of the edge that crosses it."""
    low, high = corners.agg(F.min("slope"), F.max("slope")).first()
    low, high = (low or 0.0) - 1.0, (high or 0.0) + 1.0
    spark, found = corners.sparkSession, {}
    bound = {p: (low, high) for p in parts[:-1]}
    slope = {p: (low + high) / 2 for p in parts[:-1]}
    while slope:
        asked = sorted(slope)
        s = np.array([slope[p] for p in asked])

        def touch(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("w")
            y, w = pdf["y"].to_numpy(), pdf["w"].to_numpy()
            edge = np.diff(y) / np.diff(w)
            i = np.searchsorted(edge, s)
            side = np.where(np.array(asked) >= key[0], 0, 1)
            return pd.DataFrame({"end": asked, "side": side, "gap": y[i] - s * w[i], "y": y[i], "w": w[i]})

        near = corners.groupBy("part").applyInPandas(touch, "end int, side int, gap double, y double, w double")
        rows = near.groupBy("end", "side").agg(F.min_by(F.struct("gap", "y", "w"), F.struct("gap", "w")).alias("t")).collect()
        got = {(r.end, r.side): r.t for r in rows}
        for p in asked:
            a, b, (lo, hi) = got[p, 0], got[p, 1], bound[p]
            new = (b.y - a.y) / (b.w - a.w)
            gap, grain = a.gap - b.gap, 8 * np.finfo(float).eps * max(abs(a.y), abs(b.y), abs(slope[p] * b.w), 1.0)
            lo, hi = (lo, slope[p]) if gap > 0 else (slope[p], hi)
            middle = (lo + hi) / 2
            if abs(gap) <= grain or not lo < middle < hi:
                found[p] = (new, a.w, b.w)
                del slope[p]
            else:
                bound[p], slope[p] = (lo, hi), new if lo < new < hi else middle
    return found


def fit(df: DataFrame, score: str = "risk", label: str = "wrong", size: int = RANGE) -> DataFrame:
    """lo, hi, fit, next_lo, next_fit: pools of scores with one fitted value, and where the next one begins.

    Equal scores are merged first. Null scores and labels are left out. A pool that goes over the end of a range is one row in
    each; the last row has no next.
    """
    spark, x = df.sparkSession, F.col(score).cast("double")
    g = df.filter(x.isNotNull() & F.col(label).isNotNull()).groupBy(x.alias("x")).agg(
        F.sum(F.col(label).cast("double")).alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
    g = written(spark, g, "scores")
    d = g.repartitionByRange(max(1, math.ceil(g.count() / size)), "x").withColumn("part", F.spark_partition_id())
    d = written(spark, d, "ranges")
    start, y0, w0 = {}, 0.0, 0.0
    for r in d.groupBy("part").agg(F.sum("y").alias("y"), F.sum("w").alias("w")).orderBy("part").collect():
        start[r.part] = (y0, w0)
        y0, w0 = y0 + r.y, w0 + r.w
    parts = sorted(start)
    first = parts[0] if parts else None

    def corners(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y, w = _corners(pdf.sort_values("x"), (0.0, 0.0) if key[0] == first else None, *start[key[0]])
        slope = np.append(np.diff(y) / np.diff(w), np.nan)
        return pd.DataFrame({"part": key[0], "y": y, "w": w, "slope": pd.array(slope, "Float64")})

    edge = {}
    if len(parts) > 1:
        own = d.groupBy("part").applyInPandas(corners, "part int, y double, w double, slope double")
        edge = _tangents(written(spark, own.withColumn("slope", F.nanvl("slope", F.lit(None).cast("double"))), "corners"), parts)
    left = dict(zip(parts[1:], parts))

    def fitted(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, p = pdf.sort_values("x"), key[0]
        cy, cw = _corners(pdf, (0.0, 0.0) if p == first else None, *start[p])
        end = start[p][1] + np.cumsum(pdf["w"].to_numpy(float))
        own = np.diff(cy) / np.diff(cw)
        at = np.searchsorted(cw, end, side="left") - 1  # the edge that ends at or beyond a score's own end
        v = own[np.clip(at, 0, len(own) - 1)] if len(own) else np.zeros(len(end))
        begin = end - pdf["w"].to_numpy(float)
        if p in edge:
            v = np.where(begin >= edge[p][1], edge[p][0], v)
        if p in left:
            over = edge[left[p]]
            v = np.where(end <= over[2], over[0], v)
        x = pdf["x"].to_numpy()
        new = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        last = np.append(new[1:], len(v)) - 1
        return pd.DataFrame({"part": p, "lo": x[new], "hi": x[last], "fit": v[new]})

    out = written(spark, d.groupBy("part").applyInPandas(fitted, "part int, lo double, hi double, fit double"), "pools")
    heads = {r.part: (r.lo, r.fit) for r in out.groupBy("part").agg(F.min("lo").alias("lo"), F.min_by("fit", "lo").alias("fit")).collect()}
    then = spark.createDataFrame([(p, *heads[n]) for n, p in left.items()], "part int, _lo double, _fit double")
    w = W.partitionBy("part").orderBy("lo")
    return out.join(F.broadcast(then), "part", "left").select(
        "lo", "hi", "fit", F.coalesce(F.lead("lo").over(w), "_lo").alias("next_lo"), F.coalesce(F.lead("fit").over(w), "_fit").alias("next_fit"))


def apply(d: DataFrame, table: DataFrame, column: str, out: str, sent: int = SENT) -> DataFrame:
    """``d`` with the fitted value of ``column``: linear between pools, the first or last value outside of them.

    Up to ``sent`` pools go to every task. More are sorted into the rows: each row takes the last pool at or below it, which it
    finds in its own range of scores or, at the beginning, in the last range that has one.
    """
    spark, x = d.sparkSession, F.col(column).cast("double")
    if table.count() <= sent:
        rows = table.select("lo", "hi", "fit").orderBy("lo").collect()
        if not rows:
            return d.withColumn(out, F.lit(None).cast("double"))
        knots = [(r.lo, r.fit) for r in rows] + [(r.hi, r.fit) for r in rows if r.hi > r.lo]
        xs, ys = (np.array(c) for c in zip(*sorted(knots)))

        @F.pandas_udf("double")
        def value(v: pd.Series) -> pd.Series:
            return pd.Series(np.interp(v.to_numpy(float, na_value=np.nan), xs, ys)).where(v.notna().to_numpy())

        return d.withColumn(out, value(x))
    knot = F.struct("lo", "hi", "fit", "next_lo", "next_fit")
    rows = d.select(F.struct(*d.columns).alias("_row"), x.alias("_x"), F.lit(1).alias("_kind"))
    rows = rows.unionByName(table.select(F.col("lo").alias("_x"), F.lit(0).alias("_kind"), knot.alias("_knot")), allowMissingColumns=True)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a score that many rows share is dealt to several ranges
    rows = rows.withColumn("_salt", F.when(F.col("_kind") == 1, F.xxhash64("_row")).otherwise(0))
    rows = written(spark, rows.repartitionByRange(n, "_x", "_kind", "_salt").withColumn("_part", F.spark_partition_id()), "calibrated")
    ends = rows.groupBy("_part").agg(F.max_by("_knot", F.when(F.col("_kind") == 0, F.col("_x"))).alias("_last"))
    ends = ends.select("_part", F.last("_last", ignorenulls=True).over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    first = table.agg(F.min_by("fit", "lo").alias("_first"))
    inside = F.last("_knot", ignorenulls=True).over(W.partitionBy("_part").orderBy("_x", "_kind").rowsBetween(W.unboundedPreceding, 0))
    k = rows.join(F.broadcast(ends), "_part").withColumn("_k", F.coalesce(inside, "_before")).filter("_kind = 1").join(F.broadcast(first))
    share = (F.col("_x") - F.col("_k.hi")) / (F.col("_k.next_lo") - F.col("_k.hi"))
    v = (F.when(F.col("_x").isNull(), None).when(F.col("_k").isNull(), F.col("_first"))
         .when((F.col("_x") <= F.col("_k.hi")) | F.col("_k.next_lo").isNull(), F.col("_k.fit"))
         .otherwise(F.col("_k.fit") + (F.col("_k.next_fit") - F.col("_k.fit")) * share))
    return k.select("_row.*", v.alias(out))
