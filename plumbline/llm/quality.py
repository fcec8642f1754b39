"""Quality by hierarchical empirical Bayes.

A classifier fitted on labelled documents gives each document the log-odds of being bad. Grouped sums of the
probabilities give every site and every path of a site a rate; few documents leave it near the rate above
(path to site, site to all), more so the less the rates of sites or paths differ from one another. The
document's log-odds move by what its path's rate says beyond the overall rate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import session
from plumbline.llm.base import LOWER, id_of, query, resident, rows, table, text_of

_WORD_BYTES = {b for b in range(256) if b >= 128 or chr(b).isalnum() and b < 128}
WORDS = bytes(b if b in _WORD_BYTES else 32 for b in LOWER)
MARKS = bytes(32 if b in _WORD_BYTES or b < 33 else b for b in range(256))


def tokens(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Words, lower-cased, and runs of marks of a text in UTF-8."""
    return text.translate(WORDS).split(), text.translate(MARKS).split()


def traits(text: bytes, odds: dict[bytes, float]) -> list[float]:
    """What the classifier sees of a text: learned words, repetition, and the make-up of words and marks."""
    words, marks = tokens(text)
    n, m, size = max(len(words), 1), max(len(marks), 1), max(len(text), 1)
    parts = {*words, *marks}
    found = [odds[t] for t in parts & odds.keys()]
    same = sum(map(bytes.__eq__, words[1:], words))
    plain = sum(x in (b".", b",") for x in marks)
    return [1.0, max(found, default=0.0), math.log1p(sum(found)), same / n, len(set(words)) / n, math.log1p(n), 1 - plain / m if marks else 0.0,
            min(len(marks) / n, 2.0), sum(map(len, words)) / n / 10, min(sum(map(bytes.isdigit, words)) / n, 1.0), text.count(b"\n") / size * 50]


@dataclass
class Model:
    """Log-odds of telling tokens, and the weights of the traits after scaling."""

    odds: dict[bytes, float]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        z[:, 0] = 1.0
        return np.clip(z @ self.weights, -30, 30)


def _fit_weights(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps with a ridge on scaled traits."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - mean) / scale
    z[:, 0] = 1.0
    w, pull = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    pull[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (y - p) - pull * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, max_tokens: int = 5_000, least: int = 6, ridge: float = 1.0,
        id_col: str = "doc_id", text_col: str = "text", good_col: str = "quality", bad_col: str | None = "toxic") -> Model:
    """Fit on at most ``max_labelled`` labelled documents, chosen by a hash of their identifiers.

    Equal texts count once. A document is bad if any of its labels says so (``good_col`` 0 or ``bad_col`` 1); a null label says nothing. The tokens'
    log-odds (at most ``max_tokens`` of them, seen ``least`` times, by the lower end of their range) come from the whole
    sample; for the weights, each half of it is seen with what the other half teaches. Without labels of both kinds every
    document gets even odds.
    """
    said = F.coalesce(F.col(good_col), F.lit(1)) == 0
    if bad_col is not None:
        said |= F.coalesce(F.col(bad_col), F.lit(0)) == 1
    sample = (labels.where(F.col(id_col).isNotNull()).groupBy(id_of(id_col).alias("id")).agg(F.max(said.cast("int")).alias("bad"))
              .orderBy(F.xxhash64("id"), "id").limit(max_labelled))
    known = session.written(docs.sparkSession, docs.select(id_of(id_col).alias("id"), text_of(text_col).cast("binary").alias("text"))
                            .join(F.broadcast(sample), "id").groupBy(F.xxhash64("text").alias("copy")).agg(F.max("bad").alias("bad"), F.first("text").alias("text"))
                            .withColumn("half", F.pmod(F.xxhash64(F.lit(7), "copy"), F.lit(2)).cast("int")).drop("copy"), "quality-sample")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, bads, halves in rows(batches, 64):
            got, of, at = [], [], []
            for text, b, half in zip(texts, bads, halves):
                w, m = tokens(text)
                t = [x for x in {*w, *m} if len(x) <= 40]
                got += t
                of += [b] * len(t)
                at += [half] * len(t)
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), pa.array(of, pa.int32()), pa.array(at, pa.int32())], ["token", "bad", "half"])

    size = {(r.half, r.bad): r.n for r in known.groupBy("half", "bad").agg(F.count("*").alias("n")).collect()}
    even = Model({}, np.zeros(11), np.ones(11), np.zeros(11))
    if any(not size.get((h, b)) for h in (0, 1) for b in (0, 1)):
        return even
    sums = [F.count_if((F.col("half") == h) & (F.col("bad") == b)).alias(f"n{h}{b}") for h in (0, 1) for b in (0, 1)]
    counts = session.written(docs.sparkSession, known.select("text", "bad", "half").mapInArrow(seen, "token binary, bad int, half int").groupBy("token").agg(*sums)
                             .where(f"n00 + n01 + n10 + n11 >= {least}"), "quality-tokens")

    def telling(halves: tuple[int, ...]) -> dict[bytes, float]:
        bad, good = (sum((F.col(f"n{h}{b}") for h in halves), F.lit(0.0)) for b in (1, 0))
        n_bad, n_good = (sum(size[h, b] for h in halves) for b in (1, 0))
        low = F.log((bad + 0.5) / (good + 0.5)) - math.log((n_bad + 1) / (n_good + 1)) - 1.96 * F.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
        top = counts.where(bad + good >= least * len(halves) / 2).select("token", low.alias("w")).where("w > 1").orderBy(F.desc("w"), "token").limit(max_tokens).collect()
        return {bytes(r.token): r.w for r in top}

    taught = {h: telling((1 - h,)) for h in (0, 1)}

    def seen_traits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, bads, halves in rows(batches, 64):
            yield pa.RecordBatch.from_arrays([pa.array([traits(t, taught[h]) for t, h in zip(texts, halves)], pa.list_(pa.float64())), pa.array(bads, pa.int32())], ["x", "bad"])

    rest = known.select("text", "bad", "half").mapInArrow(seen_traits, "x array<double>, bad int").collect()
    return Model(telling((0, 1)), *_fit_weights(np.array([r.x for r in rest]), np.array([r.bad for r in rest], float), ridge))


def evidence(model: Model, text: Column) -> Column:
    """The classifier's log-odds that a text is bad."""
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        resident("quality", dict)
        out = []
        for at in range(0, len(texts), 64):
            part = texts.slice(at, 64).to_pylist()
            out.append(model.log_odds(np.array([traits(t, model.odds) for t in part])))
        return pa.array(np.concatenate(out) if out else [], pa.float64())
    return score(text.cast("binary"))


def _odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def posteriors(scored: DataFrame) -> DataFrame:
    """site, path, n, site_rate, path_rate, shift of the log-odds: from ``scored`` (site, path, evidence), one row per path.

    The strength of each level's prior is that of a beta distribution whose variance is what the rates below
    it vary beyond the chance of small groups. Null sites and paths are groups of their own.
    """
    p = 1 / (1 + F.exp(-F.col("evidence")))
    paths = session.written(scored.sparkSession, scored.groupBy("site", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q")), "quality-paths")
    sites = paths.groupBy("site").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    tot = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).first()
    if not tot.n:
        return paths.select("site", "path", "n", *[F.lit(0.0).alias(c) for c in ("site_rate", "path_rate", "shift")])
    mu = min(max(tot.s / tot.n, 1e-6), 1 - 1e-6)
    noise = max(tot.q / tot.n - mu * mu, 1e-12)

    def strength(groups: DataFrame) -> float:
        """Of the prior above these groups, by moments."""
        k, between, sq = groups.agg(F.count("*"), F.sum(F.col("n") * (F.col("s") / F.col("n") - mu) ** 2), F.sum(F.col("n") * F.col("n"))).first()
        spread = (between - (k - 1) * noise) / max(tot.n - sq / tot.n, 1e-9) if k > 1 else 0.0
        return min(max(mu * (1 - mu) / max(spread, 1e-9) - 1, 1.0), 1e6)

    above, below = strength(sites), strength(paths)
    rate = sites.select(F.col("site").alias("of"), ((F.col("s") + above * mu) / (F.col("n") + above)).alias("site_rate"))
    both = paths.join(rate, F.col("site").eqNullSafe(F.col("of"))).withColumn("path_rate", (F.col("s") + below * F.col("site_rate")) / (F.col("n") + below))
    return session.written(scored.sparkSession, both.select("site", "path", "n", "site_rate", "path_rate", (_odds(F.col("path_rate")) - math.log(mu / (1 - mu))).alias("shift")),
                           "quality-rates")


def judge(docs: DataFrame, model: Model, reject: float = 0.85, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", path_col: str = "lang") -> DataFrame:
    """doc_id, site, path, evidence, site_rate, path_rate, bad (probability), kept: one row per row of ``docs``.

    A row is rejected when ``bad`` exceeds ``reject``. A null text is empty. Other columns are ignored.
    """
    scored = session.written(docs.sparkSession, docs.select(id_of(id_col).alias("doc_id"), F.col(site_col).alias("site"), F.col(path_col).alias("path"),
                                                            evidence(model, text_of(text_col)).alias("evidence")), "quality-evidence")
    return _decided(scored, posteriors(scored), reject).select("doc_id", "site", "path", "evidence", "site_rate", "path_rate", "bad", "kept")


def _decided(scored: DataFrame, rates: DataFrame, reject: float) -> DataFrame:
    r = rates.select(F.col("site").alias("s"), F.col("path").alias("p"), "site_rate", "path_rate", "shift")
    return (scored.join(r, F.col("site").eqNullSafe(F.col("s")) & F.col("path").eqNullSafe(F.col("p")), "left")
            .withColumn("bad", 1 / (1 + F.exp(-(F.col("evidence") + F.col("shift")))))
            .withColumn("kept", F.col("bad") <= reject))


def keep_good(docs: DataFrame, model: Model, reject: float = 0.85, text_col: str = "text", site_col: str = "source", path_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns as they are."""
    small = docs.select(F.col(site_col).alias("site"), F.col(path_col).alias("path"), evidence(model, text_of(text_col)).alias("evidence"))
    rates = posteriors(small)
    full = docs.select(F.struct("*").alias("row"), F.col(site_col).alias("site"), F.col(path_col).alias("path"), evidence(model, text_of(text_col)).alias("evidence"))
    return _decided(full, rates, reject).where("kept").select("row.*")


@query("op8_quality")
def op8_quality(spark, base):
    docs = table(spark, base, "documents")
    return judge(docs, fit(docs, table(spark, base, "labels"))).withColumnsRenamed({"site": "source", "path": "lang"})
