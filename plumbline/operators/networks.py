"""Small feed-forward networks for a yes or no, several at a time over the same rows.

Rows are dealt to shards by hash. In a round every shard trains all members on mini-batches of its rows for some epochs,
each member with its own weights of the rows (resampling) and its own validation share; weights and
moments are then averaged over the shards, summed up a tree. A member stops when a number of rounds has brought its validation loss
no further, and keeps its best weights. Shards depend on row hashes alone, so any partitioning gives the same networks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.session import written

FAN = 16
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def uniform(h: np.ndarray, member: int, purpose: int) -> np.ndarray:
    """A number in (0, 1) for each row hash, member and purpose."""
    x = h ^ np.uint64((2 * member + purpose + 1) * int(_MIX[0]) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) + 2.0 ** -54


def draws(u: np.ndarray, share: float) -> np.ndarray:
    """Poisson(``share``) counts by inversion, down to the last cut that a double tells from one."""
    cuts, p, k = [math.exp(-share)], math.exp(-share), 0
    while cuts[-1] < 1.0:
        k += 1
        p *= share / k
        if cuts[-1] + p == cuts[-1]:
            break
        cuts.append(cuts[-1] + p)
    return np.searchsorted(np.array(cuts), u, side="left").astype(float)


@dataclass
class Shape:
    """Layer widths; the weights of all members lie one after the other, layer by layer, matrix before offset."""

    sizes: list[int]
    cuts: list[tuple[int, int, int, int]] = field(init=False)

    def __post_init__(self):
        self.cuts, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            self.cuts.append((at, at + a * b, a, b))
            at += a * b + b
        self.n = at

    def layers(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(flat[:, i:j].reshape(-1, a, b), flat[:, None, j:j + b]) for i, j, a, b in self.cuts]

    def start(self, members: int, seed: int) -> np.ndarray:
        out = np.zeros((members, self.n))
        for m in range(members):
            rng = np.random.default_rng([seed, m])
            for i, j, a, b in self.cuts:
                out[m, i:j + b] = rng.uniform(-1, 1, a * b + b) * math.sqrt(6 / (a + b))
        return out

    def forward(self, flat: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """Activations of all layers, the last as probabilities (members, rows, 1)."""
        acts, layers = [x[None]], self.layers(flat)
        for k, (w, b) in enumerate(layers):
            z = acts[-1] @ w + b
            acts.append(np.maximum(z, 0) if k + 1 < len(layers) else 1 / (1 + np.exp(-np.clip(z, -35, 35))))
        return acts

    def gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, alpha: float) -> np.ndarray:
        """Of the weighted mean log loss and alpha / 2n times the squared weights; members without any row stay."""
        acts, layers, out = self.forward(flat, x), self.layers(flat), np.zeros_like(flat)
        total = np.maximum(weight.sum(1), 1e-300)
        delta = (acts[-1] - y[None, :, None]) * (weight / total[:, None])[:, :, None]
        for k in range(len(layers) - 1, -1, -1):
            i, j, _, b = self.cuts[k]
            w = layers[k][0]
            g = np.swapaxes(np.broadcast_to(acts[k], (len(flat), *acts[k].shape[1:])), 1, 2) @ delta + alpha * w / len(x)
            out[:, i:j], out[:, j:j + b] = g.reshape(len(flat), -1), delta.sum(1)
            if k:
                delta = (delta @ np.swapaxes(w, 1, 2)) * (acts[k] > 0)
        return out * (weight.sum(1) > 0)[:, None]


@dataclass
class Networks:
    """Fitted members. ``rounds`` says how long each was trained, ``losses`` its best validation loss."""

    names: list[str]
    mean: list[float]
    std: list[float]
    shape: Shape
    weights: np.ndarray
    rounds: list[int]
    losses: list[float]

    def risk(self) -> Column:
        """Struct of the members' mean probability and its spread (population deviation)."""
        shape, weights, mean, std = self.shape, self.weights, np.array(self.mean), np.array(self.std)

        @F.pandas_udf("risk double, uncertainty double")
        def value(v: pd.Series) -> pd.DataFrame:
            x = (np.stack(v.to_numpy()).astype(float) - mean) / std if len(v) else np.zeros((0, len(mean)))
            p = np.concatenate([shape.forward(weights, x[i:i + 1024])[-1][:, :, 0] for i in range(0, len(x), 1024)] or [np.zeros((len(weights), 0))], axis=1)
            return pd.DataFrame({"risk": p.mean(0), "uncertainty": p.std(0)})

        return value(F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in self.names]))


def fit(df: DataFrame, names: Sequence[str], label: str, row: Column, scale: tuple[list[float], list[float], int], layers: Sequence[int], members: int = 1,
        share: float | None = None, alpha: float = 1e-4, validation: float = 0.1, epochs: int = 500, seed: int = 42, batch: int = 200,
        rate: float = 1e-3, every: int = 25, patience: int = 2, shard: int = 1 << 16) -> Networks:
    """Train ``members`` networks with hidden ``layers`` on the columns ``names``; ``row`` tells rows apart, ``scale`` is their means, deviations and number.

    With ``share`` each member draws each row a Poisson(share) number of times, else it takes all. ``alpha`` is the
    weight of the penalty. A round is ``every`` epochs; after ``patience`` rounds without a better validation loss a member stops,
    after ``epochs`` epochs at the latest. A shard holds about ``shard`` rows.
    """
    spark, (mean, std, n), shape = df.sparkSession, scale, Shape([len(names), *layers, 1])
    shards = max(1, -(-n // shard))
    x = F.array(*[(F.coalesce(F.col(c), F.lit(0.0)).cast("double") - m) / s for c, m, s in zip(names, mean, std, strict=True)])
    d = df.select(F.xxhash64(row, F.lit(seed)).alias("h"), x.alias("x"), F.col(label).cast("double").alias("y"))
    d = written(spark, d.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")), "network")

    def one_round(number: int, live: list[int], state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Averaged state after one more round, and the validation loss and rows of the state it began with."""
        sent = spark.sparkContext.broadcast(state)

        def train(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["h", "y"])
            h = pdf["h"].to_numpy(np.int64).view(np.uint64)
            x, y = np.stack(pdf["x"].to_numpy()).astype(float), pdf["y"].to_numpy()
            flat, m1, m2 = sent.value[:, 0].copy(), sent.value[:, 1].copy(), sent.value[:, 2].copy()
            count = np.stack([draws(uniform(h, m, 0), share) if share else np.ones(len(h)) for m in live])
            held = np.stack([uniform(h, m, 1) < validation for m in live])
            p = np.concatenate([shape.forward(flat, x[i:i + 1024])[-1][:, :, 0] for i in range(0, len(x), 1024)], axis=1)
            loss = -(y * np.log(p) + (1 - y) * np.log(1 - p))
            weight, step = count * ~held, number * every * -(-len(x) // batch)
            for epoch in range(every):
                order = np.random.default_rng([seed, number, epoch, key[0]]).permutation(len(x))
                for at in range(0, len(order), batch):
                    rows = order[at:at + batch]
                    g = shape.gradient(flat, x[rows], y[rows], weight[:, rows], alpha)
                    step += 1
                    m1 = 0.9 * m1 + 0.1 * g
                    m2 = 0.999 * m2 + 0.001 * g * g
                    flat = flat - rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
            out = np.stack([flat, m1, m2], 1) * len(x)
            return pd.DataFrame({"node": [key[0]], "rows": [float(len(x))], "state": [out.tobytes()], "loss": [(loss * count * held).sum(1).tobytes()],
                                 "held": [(count * held).sum(1).tobytes()]})

        def total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            add = lambda c: np.sum([np.frombuffer(b) for b in pdf[c]], axis=0).tobytes()
            return pd.DataFrame({"node": [key[0]], "rows": [pdf["rows"].sum()], **{c: [add(c)] for c in ("state", "loss", "held")}})

        kind = "node int, rows double, state binary, loss binary, held binary"
        sums, nodes = d.groupBy("shard").applyInPandas(train, kind), shards
        while nodes > 1:
            sums = sums.groupBy(F.floor(F.col("node") / FAN).cast("int").alias("node")).applyInPandas(total, kind)
            nodes = -(-nodes // FAN)
        r = sums.first()
        sent.unpersist()
        return (np.frombuffer(r["state"]).reshape(state.shape) / r["rows"], np.frombuffer(r["loss"]), np.frombuffer(r["held"]))

    state = np.stack([w := shape.start(members, seed), np.zeros_like(w), np.zeros_like(w)], 1)
    best, losses, last, since = w.copy(), np.full(members, np.inf), np.zeros(members, int), np.zeros(members, int)
    live, number = list(range(members)), 0
    while live and n:
        before = state[live, 0]
        state[live], loss, held = one_round(number, live, state[live])
        now = loss / np.maximum(held, 1e-300)
        better = (held == 0) | (now < losses[live] - 1e-4)
        for k, m in enumerate(live):
            if better[k]:
                best[m], losses[m], last[m], since[m] = before[k], now[k] if held[k] else np.inf, number, 0
            else:
                since[m] += 1
        number += 1
        if number * every > epochs:
            break
        live = [m for m in live if since[m] < patience]
    return Networks(list(names), mean, std, shape, best, last.tolist(), losses.tolist())
