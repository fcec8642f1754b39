"""A table of model versions, from which scoring takes the promoted one."""

from __future__ import annotations

from dataclasses import asdict, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators.models import Linear, promote
from plumbline.session import new_dir

KIND = ("kind string, version long, metric double, stored double, promoted boolean, names array<string>, mean array<double>, std array<double>, "
        "coef array<double>, intercept double, n_wrong long, n_right long, target_mean array<double>, target_std array<double>")


class ModelTable:
    """One row for every model that was fitted, with its metric, the metric it was compared with and whether it was promoted.

    A row is one write of one file, which is there as a whole or not at all. Of each kind the promoted row of the highest version counts, so a
    reader sees the old model or the new one.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or new_dir(spark, "models")

    def versions(self) -> DataFrame:
        try:
            return self.spark.read.schema(KIND).parquet(self.folder)
        except AnalysisException:  # nothing has been fitted yet
            return self.spark.createDataFrame([], KIND)

    def _latest(self, kind: str, promoted: bool) -> dict | None:
        rows = self.versions().filter(F.col("kind") == kind)
        row = (rows.filter("promoted") if promoted else rows).agg(F.max_by(F.struct("*"), "version").alias("r")).first()
        return row.r.asDict() if row.r else None

    def offer(self, kind: str, model: Linear, metric: float | None, gain: float = 0.005, target: tuple[list[float], list[float]] | None = None) -> dict:
        """Store a model; it is promoted when there is none yet or its metric is better by more than ``gain``. Returns its row."""
        last, now = self._latest(kind, False), self._latest(kind, True)
        stored = now["metric"] if now else None
        good = now is None or promote(metric, stored, gain)
        row = {"kind": kind, "version": last["version"] + 1 if last else 1, "metric": metric, "stored": stored, "promoted": good, **asdict(model),
               "target_mean": target[0] if target else None, "target_std": target[1] if target else None}
        names = [c.split()[0] for c in KIND.split(", ")]
        self.spark.createDataFrame([tuple(row[n] for n in names)], KIND).coalesce(1).write.mode("append").parquet(self.folder)
        return row

    def current(self, kind: str) -> tuple[Linear, tuple[list[float], list[float]] | None] | None:
        """The promoted model of a kind and the scale of its target domain, if it has one."""
        r = self._latest(kind, True)
        if r is None:
            return None
        return Linear(**{f.name: r[f.name] for f in fields(Linear)}), (r["target_mean"], r["target_std"]) if r["target_mean"] is not None else None
