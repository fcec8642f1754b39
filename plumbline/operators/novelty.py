"""Novelty of new failures against known ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators.knn import nearest_mean

SPLITS, TILE_BYTES = 32, 16 << 20


def is_failure(risk_over: float, mode: str = "failure_mode") -> Column:
    """Alert, high risk, stuck after five steps, or confidently wrong in at most three."""
    c = F.col
    return (c("needs_alert") | (c("risk_score") > risk_over) | (~c("finished") & (c("n_steps") >= 5))
            | (F.coalesce(c(mode) == "confident_wrong", F.lit(False)) & c("finished") & (c("n_steps") <= 3)))


def _bracket(vectors: DataFrame, sample: int, spread: float = 0.15) -> tuple[float, float]:
    """Distances that the median of all pairs very likely lies between: quantiles of the pairs of a bounded sample."""
    m = np.stack(vectors.orderBy(F.xxhash64("vec_id", "v")).limit(sample).toPandas()["v"].to_numpy()).astype(float)
    d = np.concatenate([np.sqrt(((m[i + 1:] - m[i]) ** 2).sum(1)) for i in range(len(m))])
    return float(np.quantile(d, 0.5 - spread)), float(np.quantile(d, 0.5 + spread))


def pair_median(vectors: DataFrame, tile: int = 2048, narrow: int = 200_000, sample: int = 2048, bins: int = 1 << 16) -> float | None:
    """Exact median distance over all pairs, as a rule in two passes over the tiles of pairs.

    Vectors are hashed into tiles of ``tile`` rows at least, in ``SPLITS`` tiles at most as long as a tile is below ``TILE_BYTES``: up to
    there a vector is sent ``SPLITS`` + 1 times, however many there are. A task takes one pair of tiles, whose squared distances are a matrix
    product, and returns only counts per range, which add up. The pairs of ``sample`` vectors say where ranges must be fine. The range
    that holds the median is split again if it holds more than ``narrow`` values, also when the sample was wrong; then the distances in it, and
    as far around it as the product may be off, are taken anew from the differences and counted, so pairs never leave the task that forms them.
    """
    n, dim, norm2 = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    if n < 2:
        return None
    g = max(min(-(-n // tile), SPLITS), -(-n * max(dim, 1) * 8 // TILE_BYTES))
    v = vectors.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(g)).cast("int").alias("g"))
    every = F.sequence(F.lit(0), F.lit(g - 1))
    left = v.select("vec_id", "v", F.col("g").alias("a"), F.explode(F.filter(every, lambda x: x >= F.col("g"))).alias("b"), F.lit(0).alias("side"))
    right = v.select("vec_id", "v", F.explode(F.filter(every, lambda x: x <= F.col("g"))).alias("a"), F.col("g").alias("b"), F.lit(1).alias("side"))
    tiles = left.unionByName(right)
    off = 4e-15 * (dim + 16) * norm2  # more than a squared distance from the product can be wrong by

    def products(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Some rows of the left tile, the right tile, their squared distances, and which of them are pairs."""
        x, y = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if not len(x) or not len(y):
            return
        mx, my = np.stack(x.v.to_numpy()).astype(float), np.stack(y.v.to_numpy()).astype(float)
        ix, iy, same = x.vec_id.to_numpy(), y.vec_id.to_numpy(), pdf.a.iloc[0] == pdf.b.iloc[0]
        norms, width = (my * my).sum(1), max(1, 500_000 // len(my))
        for at in range(0, len(mx), width):
            part = mx[at:at + width]
            d2 = (part * part).sum(1)[:, None] + norms[None, :] - 2.0 * part @ my.T
            yield part, my, d2, iy[None, :] > ix[at:at + width, None] if same else np.ones(d2.shape, bool)

    low, high = (x * x for x in _bracket(vectors.select("vec_id", "v"), sample))
    top = 4.0 * norm2 + off
    while True:
        step = max((high - low) / bins, off, np.finfo(float).tiny)

        def count(pdf: pd.DataFrame) -> pd.DataFrame:
            full = np.zeros(bins + 2, np.int64)
            for _, _, d2, pair in products(pdf):
                at = np.clip((d2 - low) / step, -1.0, bins)
                full += np.bincount(np.floor(at[pair]).astype(np.int64) + 1, minlength=bins + 2)
            at = np.flatnonzero(full)
            return pd.DataFrame({"bin": at.astype("int32"), "c": full[at]})

        hist = tiles.groupBy("a", "b").applyInPandas(count, "bin int, c long").groupBy("bin").agg(F.sum("c").alias("c")).toPandas()
        full = np.zeros(bins + 2, np.int64)
        full[hist["bin"]] = hist["c"]
        cum = np.cumsum(full)
        if not cum[-1]:
            return None
        want = [(cum[-1] - 1) // 2, cum[-1] // 2]
        b0, b1 = (int(np.searchsorted(cum, w, side="right")) for w in want)
        lo, hi = low + (b0 - 1) * step if b0 else -off, low + b1 * step if b1 <= bins else top
        # an edge may round to either side of it, and the median of the distances is within ``off`` of that of the products
        lo, hi = lo - 2 * off - 1e-15 * abs(lo), hi + 2 * off + 1e-15 * abs(hi)
        if int(full[b0:b1 + 1].sum()) <= narrow or hi - lo <= 8 * off or (lo, hi) == (low, high):

            def values(pdf: pd.DataFrame) -> pd.DataFrame:
                below, d, c = 0, np.zeros(0), np.zeros(0, np.int64)
                for part, my, d2, pair in products(pdf):
                    below += int((pair & (d2 < lo)).sum())
                    i, j = np.nonzero(pair & (d2 >= lo) & (d2 <= hi))
                    for k in range(0, len(i), 100_000):
                        some = np.sqrt(((my[j[k:k + 100_000]] - part[i[k:k + 100_000]]) ** 2).sum(1))
                        d, at = np.unique(np.append(d, some), return_inverse=True)
                        c = np.bincount(at, np.append(c, np.ones(len(some))), len(d)).astype(np.int64)
                return pd.DataFrame({"d": np.append(-1.0, d), "c": np.append(below, c).astype("int64")})

            # Equal distances are one row: about ``narrow`` rows, or the few numbers in a range that cannot be split.
            got = tiles.groupBy("a", "b").applyInPandas(values, "d double, c long").groupBy("d").agg(F.sum("c").alias("c")).orderBy("d").toPandas()
            upto, d = got["c"].cumsum().to_numpy(), got["d"].to_numpy()
            return float(sum(d[int(np.searchsorted(upto, w, side="right"))] for w in want) / 2)
        low, high = float(lo), float(hi)


def novelty(new: DataFrame, known: DataFrame) -> DataFrame:
    """Distance to the nearest known failure over the median known pair distance, at most 1.

    Everything is novel while nothing is known; the scale is at least .01.
    """
    sigma = pair_median(known)
    if known.isEmpty():
        return new.select("vec_id", F.lit(1.0).alias("novelty"))
    scale = max(sigma, 0.01) if sigma is not None else 1.0
    near = nearest_mean(new, known, k=1)
    return near.select("vec_id", F.least(F.lit(1.0), F.col("risk") / scale).alias("novelty"))
