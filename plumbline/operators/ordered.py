"""Ordered work that stays spread out when one key holds a large share of the rows.

A window over a key puts the whole key into one task. The helpers here cut a key into blocks of
bounded size first: a block is a window partition, and only one summary row per block is ordered
across the whole key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.session import written

STEP_BLOCK = 4096


def with_previous(df: DataFrame, key: str, idx: str, cols: Mapping[str, str],
                  block: int = STEP_BLOCK, keep_block: str | None = None) -> DataFrame:
    """Add the value of the row before in ``idx`` order for each ``{new: old}`` in ``cols``.

    Numbers may have gaps. A window holds one block of ``block`` numbers; a block's first row takes its values from
    the last row of the block before that has any, by one summary row per block. Where all numbers of the table fall into one block
    there is nothing to take over. ``keep_block`` names the block number in the result, so that further work per block finds its rows
    already in place.
    """
    name = keep_block or "_blk"
    b = df.withColumn(name, F.floor(F.col(idx) / block))
    low, high = df.agg(F.min(idx), F.max(idx)).first()
    if low is None or low // block == high // block:
        w = W.partitionBy(key, name).orderBy(idx)
        out = b.select("*", *[F.lag(old).over(w).alias(new) for new, old in cols.items()])
        return out if keep_block else out.drop(name)
    ends = b.groupBy(key, name).agg(F.max_by(F.struct(*[F.col(old).alias(new) for new, old in cols.items()]), F.col(idx)).alias("_end"))
    ends = ends.select(key, name, F.lag("_end").over(W.partitionBy(key).orderBy(name)).alias("_end"))
    w = W.partitionBy(key, name).orderBy(idx)
    inner = b.select("*", F.struct(*[F.lag(old).over(w).alias(new) for new, old in cols.items()]).alias("_in"), F.row_number().over(w).alias("_at"))
    out = inner.join(ends, [key, name], "left")
    out = out.select(*[F.col(c) for c in b.columns], *[F.when(F.col("_at") > 1, F.col("_in")[new]).otherwise(F.col("_end")[new]).alias(new) for new in cols])
    return out if keep_block else out.drop("_blk")


def running_sums(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[Column | str],
                 sums: Mapping[str, Column], inclusive: bool = True) -> DataFrame:
    """Running sums over ``keys`` in ``order``; ``block`` must rise with that order.

    Block totals give each block its starting value; the rows are only ordered inside a block.
    """
    raw = {f"_v_{n}": c for n, c in sums.items()}
    base = df.select("*", *[c.alias(n) for n, c in raw.items()])
    totals = base.groupBy(*keys, block).agg(*[F.sum(n).alias(n) for n in raw])
    before = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*keys, block, *[
        F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_s{n}") for n in raw])
    inside = W.partitionBy(*keys, block).orderBy(*order).rowsBetween(
        W.unboundedPreceding, 0 if inclusive else -1)
    joined = base.join(starts, [*keys, block])
    return joined.select(*df.columns, *[
        (F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) + F.col(f"_s_v_{n}")).alias(n)
        for n in sums])


def value_blocks(df: DataFrame, col: str, blocks: int = 256, name: str = "_blk") -> DataFrame:
    """Number rows by quantile ranges of ``col`` (at most ``blocks`` edges reach the driver).

    ``df`` is a histogram: it is written once, as the edges, the block totals and the rows each read it.
    """
    df = written(df.sparkSession, df, "histogram")
    probs = [i / blocks for i in range(1, blocks)]
    edges = sorted(set(df.approxQuantile(col, probs, 0.25 / blocks)))
    splits = [float("-inf"), *edges, float("inf")]
    if len(splits) < 3:
        return df.withColumn(name, F.lit(0.0))
    return Bucketizer(splits=splits, inputCol=col, outputCol=name, handleInvalid="keep").transform(df)


def histogram(df: DataFrame, score: str, keys: Sequence[str], counts: Mapping[str, Column]) -> DataFrame:
    """One row per distinct score (and key); hot scores shrink to one row before any ordering."""
    return df.groupBy(*keys, score).agg(*[F.sum(c).cast("long").alias(n) for n, c in counts.items()])


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key. Catalyst puts a partial limit per task before the exchange."""
    name = rank or "_rn"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(
        F.col(name) <= n)
    return out if rank else out.drop(name)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key as an aggregate, so map tasks already combine."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return packed.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Column],
                     blocks: int = 256) -> DataFrame:
    """Exact order statistics with linear interpolation.

    ``ranks`` gives zero-based fractional ranks as columns over ``_n``, the number of rows per key.
    """
    hist = histogram(df.filter(F.col(value).isNotNull()), value, keys, {"_c": F.lit(1)})
    hist = value_blocks(hist, value, blocks)
    run = running_sums(hist, keys, "_blk", [value], {"_upto": F.col("_c")})
    total = hist.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    run = run.join(total, list(keys)) if keys else run.join(F.broadcast(total))
    low, high = {}, {}
    for name, rank in ranks.items():
        r = F.greatest(F.lit(0.0), F.least(rank, F.col("_n") - F.lit(1.0)))
        low[name], high[name] = F.floor(r), F.ceil(r)
    aggs = [F.first("_n").alias("_n")]
    for name in ranks:
        inside = lambda k: (F.col("_upto") > k) & (F.col("_upto") - F.col("_c") <= k)
        aggs += [F.max(F.when(inside(low[name]), F.col(value))).alias(f"_l{name}"),
                 F.max(F.when(inside(high[name]), F.col(value))).alias(f"_h{name}")]
    got = run.groupBy(*keys).agg(*aggs)
    out = []
    for name, rank in ranks.items():
        r = F.greatest(F.lit(0.0), F.least(rank, F.col("_n") - F.lit(1.0)))
        part = r - F.floor(r)
        out.append((F.col(f"_l{name}") + part * (F.col(f"_h{name}") - F.col(f"_l{name}"))).alias(name))
    return got.select(*keys, F.col("_n").alias("n"), *out)
