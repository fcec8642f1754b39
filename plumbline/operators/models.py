"""Models fitted and applied with Spark ML.

Feature tables are written once before a fit, since every optimiser pass reads them again. Linear
models come back as plain coefficients and are applied as one native expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators import isotonic, knn as K, networks
from plumbline.operators.calibration import auroc, bootstrap_auroc
from plumbline.operators.ordered import running_sums
from plumbline.session import written


@dataclass
class Linear:
    """Standardised logistic regression as plain numbers."""

    names: list[str]
    mean: list[float]
    std: list[float]
    coef: list[float]
    intercept: float
    n_wrong: int
    n_right: int

    def risk(self) -> Column:
        z = F.lit(self.intercept)
        for n, m, s, w in zip(self.names, self.mean, self.std, self.coef, strict=True):
            z = z + (F.coalesce(F.col(n), F.lit(0.0)) - m) / s * w
        return 1.0 / (1.0 + F.exp(-z))

    def importances(self) -> list[tuple[str, float]]:
        return [(n, round(abs(w), 4)) for n, w in zip(self.names, self.coef, strict=True)]


def moments(df: DataFrame, names: list[str]) -> tuple[list[float], list[float], int]:
    """Means, population deviations (1 where a feature does not vary) and the row count, in one pass."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(n).alias(f"m_{n}") for n in names],
                 *[F.stddev_pop(n).alias(f"s_{n}") for n in names]).first()
    std = [row[f"s_{n}"] if (row[f"s_{n}"] or 0.0) >= 1e-8 else 1.0 for n in names]
    return [row[f"m_{n}"] or 0.0 for n in names], std, row["n"]


def scaled(names: list[str], mean: list[float], std: list[float]) -> Column:
    return array_to_vector(F.array(*[((F.coalesce(F.col(n), F.lit(0.0)) - m) / s).cast("double")
                                     for n, m, s in zip(names, mean, std, strict=True)]))


def class_counts(df: DataFrame, label: str) -> tuple[int, int]:
    r = df.agg(F.count_if(F.col(label) == 1).alias("w"), F.count_if(F.col(label) == 0).alias("c")).first()
    return r["w"], r["c"]


def fit_linear(df: DataFrame, names: list[str], label: str = "wrong", balanced: bool = False, c: float = 1.0,
               max_iter: int = 1000) -> Linear:
    """Scaler and logistic regression; ``balanced`` weights both classes alike.

    The optimiser works along the principal axes of the features. Turning the axes leaves the penalty as it is, and the optimiser
    scales each axis on its own, so features that go together cost no more passes over the rows, however many rows there are.
    Axes on which the penalty far outweighs the rows are left to the Newton steps.
    """
    wrong, right = class_counts(df, label)
    if not wrong or not right:
        raise ValueError("both classes are needed")
    df = written(df.sparkSession, df.select(*names, label), "linear")
    mean, std, n = moments(df, names)
    y = F.col(label).cast("double")
    w = F.when(y == 1, n / (2.0 * wrong)).otherwise(n / (2.0 * right)) if balanced else F.lit(1.0)
    data = df.select(scaled(names, mean, std).alias("x"), y.alias("y"), w.alias("w"))
    axes, turned = np.eye(len(names)), data.withColumnRenamed("x", "z")
    if len(names) > 1:
        pca = PCA(k=len(names), inputCol="x", outputCol="turned").fit(data)
        told = max(1, int((pca.explainedVariance.toArray() * len(names) * n > 0.01 / c).sum()))  # variances fall
        axes = pca.pc.toArray()[:, :told]
        turned = VectorSlicer(inputCol="turned", outputCol="z", indices=list(range(told))).transform(pca.transform(data))
    m = LogisticRegression(featuresCol="z", labelCol="y", weightCol="w", regParam=1.0 / (c * n), elasticNetParam=0.0,
                           standardization=False, maxIter=max_iter, tol=1e-6).fit(turned)
    b = _newton(data, np.array([*axes @ m.coefficients.toArray(), m.intercept], float), 1.0 / c)
    return Linear(list(names), mean, std, b[:-1].tolist(), float(b[-1]), wrong, right)


def _newton(data: DataFrame, b: np.ndarray, penalty: float, steps: int = 100) -> np.ndarray:
    """From near the optimum to it: a step needs the sums of loss, gradient and curvature, (p + 1)(p + 2) / 2 + p + 2 numbers a task.

    A step that makes the loss larger is halved. Errors are squared from step to step, so what is left after a move of 1e-9 is lost in rounding.
    """
    p = len(b)
    upper = np.triu_indices(p)
    ridge = np.append(np.full(p - 1, penalty), 0.0)
    rows = data.select(vector_to_array("x").alias("x"), "y", "w")
    least, move = np.inf, np.zeros(p)
    for _ in range(steps):
        def sums(parts: Iterator[pd.DataFrame], b=b) -> Iterator[pd.DataFrame]:
            loss, g, h = 0.0, np.zeros(p), np.zeros((p, p))
            for pdf in parts:
                x = np.column_stack([np.stack(pdf["x"].to_numpy()), np.ones(len(pdf))]) if len(pdf) else np.zeros((0, p))
                z, y, w = x @ b, pdf["y"].to_numpy(float), pdf["w"].to_numpy(float)
                q = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                loss += float(w @ (np.logaddexp(0, z) - y * z))
                g += x.T @ (w * (q - y))
                h += (x.T * (w * q * (1 - q))) @ x
            both = np.concatenate([[loss], g, h[upper]])
            yield pd.DataFrame({"i": np.arange(len(both)), "v": both})

        got = rows.mapInPandas(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")["v"].to_numpy()
        loss = got[0] + float(ridge @ (b * b)) / 2
        if loss > least * (1 + 1e-10):
            move = move / 2
            b = b + move
            continue
        h = np.zeros((p, p))
        h[upper] = got[p + 1:]
        h = h + np.triu(h, 1).T + np.diag(ridge)
        least, move = loss, np.linalg.lstsq(h, got[1:p + 1] + ridge * b, rcond=None)[0]
        b = b - move
        if np.abs(move).max() < 1e-9:
            break
    return b


def stratified(df: DataFrame, row_id: str, label: str, parts: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """Number rows of each class in hash order and deal them into ``parts``; no random state."""
    h = F.xxhash64(F.col(row_id), F.lit(seed))
    d = df.withColumns({"_h": h, "_hb": F.shiftright(h, 54)})
    d = running_sums(d, [label], "_hb", ["_h", row_id], {"_rn": F.lit(1)})
    return d.withColumn(name, ((F.col("_rn") - 1) % parts).cast("int")).drop("_h", "_hb", "_rn")


def _mean_auroc(scored: DataFrame, label: str, key: str = "fold") -> float | None:
    return auroc(scored, "risk", label, [key]).agg(F.avg("auroc")).first()[0]


def cross_validated(df: DataFrame, row_id: str, names: list[str], label: str = "wrong", parts: int = 5, balanced: bool = False,
                    fit=None) -> float | None:
    """Mean AUROC over stratified folds; null without two classes or with fewer than two rows per fold and class."""
    wrong, right = class_counts(df, label)
    if min(wrong, right) == 0 or wrong + right < parts * 2:
        return None
    d = written(df.sparkSession, stratified(df, row_id, label, parts), "folds")
    fit = fit or (lambda train: (lambda test: test.withColumn("risk", fit_linear(train, names, label, balanced).risk())))

    def one(i: int) -> DataFrame:
        return fit(d.filter(F.col("fold") != i))(d.filter(F.col("fold") == i)).select("fold", label, "risk")
    with ThreadPoolExecutor(max_workers=parts) as pool:
        pieces = list(pool.map(one, range(parts)))
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return _mean_auroc(out, label)


def fit_network(df: DataFrame, names: list[str], label: str = "wrong", layers: tuple[int, ...] = (64, 32), seed: int = 42, max_iter: int = 500,
                alpha: float = 1e-4, validation: float = 0.1, row_id: str | None = None):
    """Small feed-forward network on scaled features with penalty and early stop; returns a function that adds ``risk``.

    Without ``row_id`` rows are told apart by what they hold.
    """
    row = F.col(row_id) if row_id else F.xxhash64(*names, label)
    m = networks.fit(df, names, label, row, moments(df, names), layers, alpha=alpha, validation=validation, epochs=max_iter, seed=seed)
    return lambda d: d.withColumn("risk", m.risk()["risk"])


def fit_pair(df: DataFrame, names: list[str], label: str = "wrong"):
    """Mean of logistic regression and network."""
    lin, net = fit_linear(df, names, label), fit_network(df, names, label)
    return lambda d: net(d).withColumn("risk", (F.col("risk") + lin.risk()) / 2.0)


def promote(new: float | None, stored: float | None, gain: float = 0.005) -> bool:
    """A new model replaces the stored one only when it is clearly better."""
    return new is not None and (stored is None or new > stored + gain)


def fit_isotonic(df: DataFrame, score: str = "risk", label: str = "wrong", min_rows: int = 0):
    """Monotone map of score to share of wrong rows; equal scores are merged before the fit. The pools stay a table."""
    if min_rows and df.count() < min_rows:
        raise ValueError(f"at least {min_rows} rows are needed")
    table = written(df.sparkSession, isotonic.fit(df, score, label), "isotonic")
    return lambda d, column=score, out="calibrated": isotonic.apply(d, table, column, out)


def target_scale(df: DataFrame, names: list[str], min_rows: int = 10) -> tuple[list[float], list[float]] | None:
    """Mean and deviation of an unlabelled target domain, when it has enough rows."""
    mean, std, n = moments(df, names)
    return (mean, std) if n >= min_rows else None


def rescaled(df: DataFrame, names: list[str], scale: tuple[list[float], list[float]] | None) -> DataFrame:
    if scale is None:
        return df
    return df.withColumns({n: (F.col(n) - m) / s for n, m, s in zip(names, *scale, strict=True)})


def fit_ensemble(train: DataFrame, row_id: str, names: list[str], label: str = "wrong", members: int = 30, share: float = 0.8, seed: int = 42,
                 layers: tuple[int, ...] = (32, 16), max_iter: int = 500, alpha: float = 0.01, validation: float = 0.15) -> networks.Networks:
    """Networks on hash-seeded resamples with replacement, all trained in the same passes over the rows."""
    return networks.fit(train, names, label, F.col(row_id), moments(train, names), layers, members, share, alpha, validation, max_iter, seed)


def ensemble_risk(train: DataFrame, score: DataFrame, row_id: str, names: list[str], label: str = "wrong", **how) -> DataFrame:
    """Mean and spread of the ensemble's members for each row of ``score``."""
    r = fit_ensemble(train, row_id, names, label, **how).risk()
    return score.select(row_id, r.alias("_r")).select(row_id, "_r.risk", "_r.uncertainty")


def density_risk(pool: DataFrame, score: DataFrame, dims: int = 32, k: int = 4, min_rows: int = 20, seed: int = 42) -> DataFrame:
    """Negative log density of each vector under a mixture fitted to the pool (high = unusual)."""
    n = pool.count()
    if n < min_rows:
        raise ValueError(f"at least {min_rows} vectors are needed")
    width = len(pool.first()["v"])
    x = array_to_vector("v")
    data = pool.select("vec_id", x.alias("x"))
    pca = PCA(k=min(dims, width, n), inputCol="x", outputCol="p").fit(data)
    gm = GaussianMixture(k=k, seed=seed, featuresCol="p", maxIter=50).fit(pca.transform(data))
    parts = [(w, np.array(g.mean), g.cov.toArray() + 1e-6 * np.eye(len(g.mean)))
             for w, g in zip(gm.weights, gm.gaussians, strict=True)]  # k small matrices

    @F.pandas_udf("double")
    def surprise(v: pd.Series) -> pd.Series:
        m = np.stack(v.to_numpy())
        logs = []
        for w, mu, cov in parts:
            d = m - mu
            sol = np.linalg.solve(cov, d.T).T
            logs.append(math.log(max(w, 1e-300)) - 0.5 * ((d * sol).sum(1) + np.linalg.slogdet(cov)[1] + m.shape[1] * math.log(2 * math.pi)))
        top = np.max(logs, axis=0)
        return pd.Series(-(top + np.log(np.exp(np.array(logs) - top).sum(0))))

    return pca.transform(score.select("vec_id", x.alias("x"))).select("vec_id", surprise(vector_to_array("p")).alias("surprise"))


def density_ranks(pool: DataFrame, score: DataFrame, dims: int = 32, parts: tuple[int, ...] = (2, 4), min_rows: int = 5, seed: int = 42) -> DataFrame:
    """Mean relative rank of a vector's surprise under mixtures of several sizes, 0 for the most usual row and 1 for the least."""
    from plumbline.operators.scoring import relative_ranks
    d = None
    for k in parts:
        one = density_risk(pool, score, dims, k, min_rows, seed).withColumnRenamed("surprise", f"_s{k}")
        d = one if d is None else d.join(one, "vec_id")
    d = relative_ranks(written(pool.sparkSession, d, "surprise"), {f"_s{k}": f"_r{k}" for k in parts})
    return d.select("vec_id", (sum((F.col(f"_r{k}") for k in parts), F.lit(0.0)) / float(len(parts))).alias("risk"))


def average_parameters(params: DataFrame) -> DataFrame:
    """Mean of parameters over sites, weighted by each site's number of chains."""
    return params.groupBy("component", "position").agg((F.sum(F.col("value") * F.col("n_chains")) / F.sum("n_chains")).alias("value"))


def decay_sample(pool: DataFrame, keys: list[str], row_id: str, age: str, n: int, decay: float = 0.2, every: int = 100) -> DataFrame:
    """Weighted sample without replacement, weight ``decay ^ (age / every)``, by hash and not by random state.

    Works on logarithms, so old rows never lose their order to underflow.
    """
    from plumbline.operators.ordered import top_per_key
    u = (F.conv(F.substring(F.sha2(F.col(row_id).cast("string"), 256), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    draw = F.ln(-F.ln(u)) - F.col(age) / float(every) * math.log(decay)
    return top_per_key(pool.withColumn("_draw", draw), keys, [F.asc("_draw"), F.asc(row_id)], n).drop("_draw")


def centre_distances(bank: DataFrame, queries: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Distance of each query to the nearest of ``k`` KMeans centres of the bank."""
    model = KMeans(k=k, seed=seed, featuresCol="x").fit(bank.select(array_to_vector("v").alias("x")))
    gaps = [K.distance(F.col("v"), F.array(*[F.lit(float(x)) for x in c])) for c in model.clusterCenters()]
    return queries.select("vec_id", F.least(*gaps).alias("distance") if len(gaps) > 1 else gaps[0].alias("distance"))


def failure_clusters(vectors: DataFrame, lowest: int = 2, highest: int = 10, nearest: int = 5, min_rows: int = 5, seed: int = 42) -> DataFrame:
    """KMeans with the number of clusters that separates best; size and the rows nearest each centre."""
    from plumbline.operators.ordered import top_per_key
    spark = vectors.sparkSession
    n = vectors.count()
    schema = "cluster int, size long, rank int, vec_id long, distance double"
    if n < min_rows:
        return spark.createDataFrame([], schema)
    data = written(spark, vectors.select("vec_id", "v"), "failures").withColumn("x", array_to_vector("v"))
    judge = ClusteringEvaluator(featuresCol="x", predictionCol="cluster")

    def attempt(k: int):
        m = KMeans(k=k, seed=seed, featuresCol="x", predictionCol="cluster").fit(data)
        return judge.evaluate(m.transform(data)), k, m
    with ThreadPoolExecutor(max_workers=4) as pool:
        tries = list(pool.map(attempt, range(lowest, min(highest, n - 1) + 1)))
    _, _, best = max(tries, key=lambda t: (t[0], -t[1]))
    centre = F.when(F.lit(False), F.array(F.lit(0.0)))
    for i, c in enumerate(best.clusterCenters()):
        centre = centre.when(F.col("cluster") == i, F.array(*[F.lit(float(v)) for v in c]))
    d = best.transform(data).withColumn("distance", K.distance(F.col("v"), centre))
    size = d.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    top = top_per_key(d.select("cluster", "vec_id", "distance"), ["cluster"], [F.asc("distance"), F.asc("vec_id")], nearest, "rank")
    return top.join(size, "cluster").select("cluster", "size", "rank", "vec_id", "distance")


def fingerprints(features: DataFrame, agent: str, names: list[str], k: int = 3, seed: int = 42) -> DataFrame:
    """Mean behaviour per agent and the cluster it falls into."""
    g = written(features.sparkSession, features.groupBy(agent).agg(*[F.avg(n).alias(n) for n in names], F.count(F.lit(1)).alias("chains")), "agents")
    mean, std, n = moments(g, names)
    m = KMeans(k=max(2, min(k, n - 1)), seed=seed, featuresCol="x", predictionCol="cluster").fit(g.withColumn("x", scaled(names, mean, std)))
    return m.transform(g.withColumn("x", scaled(names, mean, std))).select(agent, "chains", "cluster")


def before_after(train: DataFrame, extra: DataFrame, test: DataFrame, row_id: str, names: list[str], label: str = "wrong",
                 resamples: int = 1000) -> DataFrame:
    """Test AUROC with interval of a fit without and with the extra rows; significant when the intervals part."""
    a = fit_linear(train, names, label, balanced=True)
    b = fit_linear(train.select(label, *names).unionByName(extra.select(label, *names)), names, label, balanced=True)
    ci = lambda m, tag: bootstrap_auroc(test.withColumn("risk", m.risk()), row_id, "risk", label, resamples).select(
        *[F.col(c).alias(f"{tag}_{c}") for c in ("mean", "lower", "upper")])
    return ci(a, "before").join(F.broadcast(ci(b, "after"))).withColumn("significant", F.col("after_lower") > F.col("before_upper"))


def pool_triggers(labels: DataFrame, keys: list[str], question: str, width: int = 600, heal: int = 5, fit_every: int = 50,
                  min_class: int = 10) -> DataFrame:
    """Growth of the known-good pool and the refits each label sets off, all from running counts."""
    good = F.col("is_correct")
    first = labels.filter(good).groupBy(*keys, question).agg(F.min(F.struct("ts", "chain_id")).alias("_first"))
    d = labels.join(first, [*keys, question], "left").withColumn("_b", F.floor(F.col("ts") / width))
    new = good & (F.struct("ts", "chain_id") == F.col("_first"))
    d = d.withColumn("pool_grows", F.coalesce(new, F.lit(False))).drop("_first")
    one = lambda c: c.cast("long")
    d = running_sums(d, keys, "_b", ["ts", "chain_id"], {"pool_size": one(F.col("pool_grows")), "n_labels": F.lit(1).cast("long"),
                                                         "n_right": one(good), "n_errors": one(~good)})
    ready = (F.col("n_labels") >= fit_every) & (F.col("n_right") >= min_class) & (F.col("n_errors") >= min_class)
    start = d.filter(ready).groupBy(*keys).agg(F.min("n_labels").alias("_start"))
    d = d.join(start, keys, "left")
    return d.withColumns({"heals": ~good & (F.col("n_errors") % heal == 0),
                          "refits": F.coalesce((F.col("n_labels") >= F.col("_start")) & ((F.col("n_labels") - F.col("_start")) % fit_every == 0), F.lit(False))}
                         ).drop("_b", "_start")
