"""Distances to known-good vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.session import written

BROADCAST_BYTES = 64 << 20
BLOCKS, BLOCK_BYTES = 16, 32 << 20
OUT = "vec_id long, risk double"


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def _scores(block: np.ndarray, bank: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return (block * block).sum(1)[:, None] + norms[None, :] - 2.0 * block @ bank.T


def nearest_mean(queries: DataFrame, bank: DataFrame, k: int = 5, limit: int = BROADCAST_BYTES, block: int = 20_000) -> DataFrame:
    """Mean distance of each query to its ``k`` nearest bank vectors, those with its own id left out.

    Where fewer others are left, the mean is over those; without any it is 0.5. A bank whose measured size is under ``limit`` goes
    to every executor; a larger one is searched in blocks, see :func:`_by_blocks`. Both ways are exact. Blocks have ``block`` vectors at
    least, and there are ``BLOCKS`` at most as long as a block is below ``BLOCK_BYTES``: where bounds rule nothing out, as in many dimensions,
    a query goes to every block and a block to every ``block`` queries, which would grow with the square of the rows.
    """
    n, dim = bank.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if n < 2:
        return queries.select("vec_id", F.lit(0.5).alias("risk"))
    k = min(k, n - 1)
    if n * (dim or 1) * 8 <= limit:
        return _by_broadcast(queries, bank, k)
    return _by_blocks(queries, bank, k, n, max(block, min(-(-n // BLOCKS), BLOCK_BYTES // (8 * max(dim or 1, 1)))))


def _least(q: np.ndarray, q_ids: np.ndarray, bank: np.ndarray, ids: np.ndarray, norms: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` least distances of each query to vectors of other ids, in order; infinite where there are no more."""
    d2 = _scores(q, bank, norms)
    d2[q_ids[:, None] == ids[None, :]] = np.inf
    near = np.argpartition(d2, k - 1, axis=1)[:, :k]
    exact = np.sqrt(((bank[near] - q[:, None, :]) ** 2).sum(2))
    exact[np.isinf(np.take_along_axis(d2, near, 1))] = np.inf
    return np.sort(exact, axis=1)


def _by_broadcast(queries: DataFrame, bank: DataFrame, k: int) -> DataFrame:
    rows = bank.select("vec_id", "v").toPandas()  # size checked by the caller
    mat, ids = np.stack(rows["v"].to_numpy()).astype(float), rows["vec_id"].to_numpy()
    held = queries.sparkSession.sparkContext.broadcast((mat, ids, (mat * mat).sum(1)))

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bank_m, bank_ids, norms = held.value
        width = max(1, 4_000_000 // len(bank_ids))
        for pdf in parts:
            q_all, id_all, out = list(pdf["v"]), pdf["vec_id"].to_numpy(), []
            for at in range(0, len(id_all), width):
                d = _least(np.stack(q_all[at:at + width]).astype(float), id_all[at:at + width], bank_m, bank_ids, norms, k)
                some = np.isfinite(d)
                out.append(np.where(some.any(1), np.where(some, d, 0.0).sum(1) / np.maximum(some.sum(1), 1), 0.5))
            if out:
                yield pd.DataFrame({"vec_id": id_all, "risk": np.concatenate(out)})

    return queries.select("vec_id", "v").mapInPandas(score, OUT)


@dataclass
class Index:
    """The bank in blocks around pivots: ``rows`` (vec_id, v, blk), and for each block its pivot, rows, and least and largest distance from it."""

    rows: DataFrame
    pivots: np.ndarray
    cell: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray


def build_index(bank: DataFrame, n: int, block: int, most: int = 4096) -> Index:
    """Deal the bank to its nearest pivots; what is dealt to a pivot is split by hash into blocks of about ``block`` vectors.

    Pivots, up to ``most``, are centres of a bounded sample, eight vectors for each. Every vector is in the index.
    """
    spark, p = bank.sparkSession, max(1, min(-(-n // block), most))
    some = bank.orderBy(F.xxhash64("vec_id", "v")).limit(8 * p).select("v").toPandas()
    m = np.stack(some["v"].to_numpy()).astype(float)
    pivots = m[:p].copy()
    for _ in range(8):
        near = _scores(m, pivots, (pivots * pivots).sum(1)).argmin(1)
        for i in np.unique(near):
            pivots[i] = m[near == i].mean(0)
    held = spark.sparkContext.broadcast((pivots, (pivots * pivots).sum(1)))

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, norms = held.value
        for pdf in parts:
            x = np.stack(pdf["v"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, at.shape[1]))
            c = _scores(x, at, norms).argmin(1)
            yield pdf.assign(cell=c.astype("int32"), r=np.sqrt(((x - at[c]) ** 2).sum(1)))

    v = dict(bank.dtypes)["v"]
    dealt = written(spark, bank.select("vec_id", "v").mapInPandas(deal, f"vec_id long, v {v}, cell int, r double"), "dealt")
    parts = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("parts"))
    dealt = dealt.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")))
    info = dealt.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("size"), F.min("r").alias("low"), F.max("r").alias("high"))
    info = info.orderBy("cell", "part").toPandas()  # a row for each pivot and for every ``block`` vectors
    names = spark.createDataFrame([(int(c), int(i), b) for b, (c, i) in enumerate(zip(info["cell"], info["part"]))], "cell int, part long, blk int")
    rows = dealt.join(F.broadcast(names), ["cell", "part"]).select("vec_id", "v", "blk")
    return Index(rows, pivots, *(info[c].to_numpy() for c in ("cell", "size", "low", "high")))


def visits(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """Blocks that each query visits. Without a column ``kth``: the nearest ones, up to more than ``k`` vectors. With it: all others that may hold a nearer vector.

    No vector of a block is nearer than the query's distance from the pivot less the block's largest, or the block's least less that distance.
    """
    held = queries.sparkSession.sparkContext.broadcast((index.pivots, index.cell, index.size, index.low, index.high))
    types = dict(queries.dtypes)
    later = "kth" in types

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots, cell, size, low, high = held.value
        norms = (pivots * pivots).sum(1)
        for pdf in parts:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at:at + 256]
                x = np.stack(part["v"].to_numpy()).astype(float)
                d = np.sqrt(np.maximum(_scores(x, pivots, norms), 0.0))[:, cell]
                grain = 1e-7 * (1.0 + np.sqrt((x * x).sum(1)) + np.sqrt(norms.max()))[:, None]
                bound = np.maximum(np.maximum(d - high, low - d), 0.0) - grain
                order = np.argsort(d, axis=1, kind="stable")
                upto = np.cumsum(size[order], axis=1) - size[order]
                first = np.zeros(d.shape, bool)
                np.put_along_axis(first, order, upto <= k, 1)
                i, b = np.nonzero(~first & (bound <= part["kth"].to_numpy()[:, None]) if later else first)
                yield part.iloc[i][["row", "vec_id", "v"]].assign(blk=b.astype("int32"))

    return queries.mapInPandas(ask, f"row long, vec_id long, v {types['v']}, blk int")


def _by_blocks(queries: DataFrame, bank: DataFrame, k: int, n: int, block: int) -> DataFrame:
    """Exact search in the blocks that may hold near vectors.

    A query first visits the blocks around its nearest pivots; its ``k``-th distance there rules out all blocks whose bound is beyond it.
    Each task holds one block of queries and one of the bank, compares them as matrices and gives ``k`` distances for each of its
    queries; no pair of vectors is ever a row.
    """
    spark, index = queries.sparkSession, build_index(bank, n, block)
    index.rows = written(spark, index.rows, "index")
    q = written(spark, queries.select("vec_id", "v").withColumn("row", F.monotonically_increasing_id()), "queries")

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"row": [], "d": []}).astype({"row": "int64", "d": "float64"})
        m, ids = np.stack(right["v"].to_numpy()).astype(float), right["vec_id"].to_numpy()
        norms, vs, q_ids, rows, out = (m * m).sum(1), list(left["v"]), left["vec_id"].to_numpy(), left["row"].to_numpy(), []
        kk, width = min(k, len(ids)), max(1, 4_000_000 // len(ids))
        for at in range(0, len(vs), width):
            out.append(_least(np.stack(vs[at:at + width]).astype(float), q_ids[at:at + width], m, ids, norms, kk))
        d = np.concatenate(out)
        got = pd.DataFrame({"row": np.repeat(rows, d.shape[1]), "d": d.ravel()})
        return got[np.isfinite(got["d"])]

    def search(asked: DataFrame) -> DataFrame:
        """The least distances in the blocks asked for; a block that many queries visit meets them in several tasks."""
        asked = written(spark, asked, "asked")
        parts = asked.groupBy("blk").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("parts"))
        left = asked.join(F.broadcast(parts), "blk").select("row", "vec_id", "v", "blk", F.pmod(F.xxhash64("row"), F.col("parts")).alias("qb"))
        homes = parts.select("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("qb"))
        right = index.rows.join(F.broadcast(homes), "blk").select("vec_id", "v", "blk", "qb")
        near = left.groupBy("blk", "qb").cogroup(right.groupBy("blk", "qb")).applyInPandas(tile, "row long, d double")
        return written(spark, near, "near")

    def best(near: DataFrame) -> DataFrame:
        return near.withColumn("rn", F.row_number().over(W.partitionBy("row").orderBy("d"))).filter(F.col("rn") <= k)

    first = search(visits(q, index, k))
    kth = best(first).groupBy("row").agg(F.when(F.count(F.lit(1)) == k, F.max("d")).alias("kth"))
    rest = q.join(kth, "row", "left").withColumn("kth", F.coalesce("kth", F.lit(float("inf"))))
    mean = best(first.unionAll(search(visits(rest, index, k)))).groupBy("row").agg(F.avg("d").alias("risk"))
    return q.join(mean, "row", "left").select("vec_id", F.coalesce("risk", F.lit(0.5)).alias("risk"))


def centroid(bank: DataFrame) -> list[float]:
    """Mean vector (as many numbers as the vectors have)."""
    rows = bank.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).orderBy("i").collect()
    return [r["x"] for r in rows]


def chain_vectors(step_vectors: DataFrame, key: str) -> DataFrame:
    """Element-wise maximum over the vectors of a key, in long form (key, position, value)."""
    return step_vectors.select(key, F.posexplode("v").alias("pos", "x")).groupBy(key, "pos").agg(F.max("x").alias("value"))


def tightness(vectors: DataFrame, key: str) -> DataFrame:
    """Mean pairwise cosine per key without forming pairs.

    For unit vectors the sum over pairs is ``(|sum|^2 - n) / 2``.
    """
    unit = vectors.select(key, F.transform("v", lambda x: F.try_divide(x, F.sqrt(dot(F.col("v"), F.col("v"))))).alias("u"))
    sums = unit.select(key, F.posexplode("u").alias("i", "x")).groupBy(key, "i").agg(F.sum("x").alias("s"))
    sq = sums.groupBy(key).agg(F.sum(F.col("s") * F.col("s")).alias("sq"))
    n = vectors.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sq.join(n, key).select(key, "n", F.coalesce(F.try_divide(F.col("sq") - F.col("n"), F.col("n") * (F.col("n") - 1)),
                                                       F.lit(1.0)).alias("tightness"))


def retrieval_quality(questions: DataFrame, observations: DataFrame, key: str, good: float = 0.55, poor: float = 0.45) -> DataFrame:
    """Cosine of a question with each observation of its chain: mean, lowest, label.

    The label cuts are choices of this library; only ``< .30`` is documented as low.
    """
    j = observations.join(questions.select(key, F.col("v").alias("qv")), key)
    m = j.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(cosine(F.col("v"), F.col("qv"))).alias("mean_sim"),
                           F.min(cosine(F.col("v"), F.col("qv"))).alias("min_sim"))
    return m.withColumns({"quality_label": F.when(F.col("mean_sim") >= good, "GOOD").when(F.col("mean_sim") >= poor, "OK").otherwise("POOR"),
                          "low_retrieval_quality": F.col("mean_sim") < 0.30})


def observation_similarities(questions: DataFrame, observations: DataFrame, key: str, row_id: str) -> DataFrame:
    """Cosine of a question with each observation of its chain, one row each."""
    j = observations.join(questions.select(key, F.col("v").alias("qv")), key)
    return j.select(key, row_id, cosine(F.col("v"), F.col("qv")).alias("similarity"))


def share_above(calibration: DataFrame, tests: DataFrame, value: str, blocks: int = 256) -> DataFrame:
    """Share of calibration values above each test value, by running counts instead of a range join."""
    from plumbline.operators.ordered import running_sums, value_blocks
    both = calibration.select(F.col(value), F.lit(1).alias("_c")).unionByName(tests.select(F.col(value), F.lit(0).alias("_c")))
    hist = value_blocks(both.groupBy(value).agg(F.sum("_c").alias("_c")), value, blocks)
    run = running_sums(hist, [], "_blk", [value], {"_upto": F.col("_c")})
    n = calibration.agg(F.count(F.lit(1)).alias("_n"))
    share = run.join(F.broadcast(n)).select(F.col(value).alias("_v"), (1 - F.col("_upto") / F.greatest(F.col("_n"), F.lit(1))).alias("confidence"))
    return tests.join(share, F.col(value) == F.col("_v")).drop("_v")
