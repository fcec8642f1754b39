"""Structured Streaming jobs.

Keyed rules keep one small JSON state per key in the state store. A micro-batch is bounded by the
source's limits; inside it the rows of a key are put in time order. Rows older than what a key has
already taken come back marked late and change nothing.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.functions import text as T
from plumbline.operators.models import fit_isotonic
from plumbline.session import new_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class FoldProcessor(StatefulProcessor):
    """Runs a fold per key. With ``ttl`` a key's state ends that many seconds of event time after the row that it counts from."""

    def __init__(self, fold, keys: Sequence[str], order: Sequence[str], ttl: int | None = None):
        self.fold, self.keys, self.order, self.ttl = fold, list(keys), list(order), ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", "state string, counts string, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(self.order)
        got = self.state.get()
        state, counts, last = (json.loads(got[0]), json.loads(got[1]), got[2]) if got is not None else (self.fold.init(), {}, -(1 << 62))
        late, pdf = pdf[pdf["ts"] < last], pdf[pdf["ts"] >= last]
        out = []
        if len(pdf):
            counts, pdf = self.fold.number(counts, pdf)
            state, res = self.fold.run(state, pdf)
            last = int(pdf["ts"].max())
            self.state.update((json.dumps(state), json.dumps(counts), last))
            out.append(res.assign(late=False))
            if self.ttl is not None:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer((self.fold.counts_from(state, last) + self.ttl) * 1000)
        if len(late):
            names = [p.split()[0] for p in self.fold.out.split(", ")]
            out.append(pd.DataFrame({n: late[n] if n in late.columns else None for n in names}).assign(late=True))
        for part in out:
            if len(part):
                for i, k in enumerate(self.keys):
                    part.insert(i, k, key[i])
                yield part

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def keyed_fold(stream: DataFrame, keys: Sequence[str], order: Sequence[str], fold, ttl: int | None = None, lateness: str = "1 minute") -> DataFrame:
    """Streaming form of a fold: drift detectors, adaptive thresholds, alert suppression.

    With ``ttl`` seconds of event time without a row that counts, a key leaves the state; it starts anew when it comes again. Rows more
    than ``lateness`` behind the stream are then dropped. Suppression loses nothing by a ``ttl`` of its window; detectors and thresholds
    take a long one. Of alerts of one second that come in different batches the first to arrive fires.
    """
    types = dict(stream.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + fold.out + ", late boolean"
    if ttl is not None:
        stream = stream.withColumn("_at", F.timestamp_seconds("ts")).withWatermark("_at", lateness)
    return stream.groupBy(*keys).transformWithStateInPandas(
        FoldProcessor(fold, keys, order, ttl), outputStructType=schema, outputMode="Append", timeMode="None" if ttl is None else "EventTime")


class LiveChain(StatefulProcessor):
    """Scores a chain after every step from sums that grow with the step, not with the chain.

    Steps are taken in the order of their numbers. One that is ahead waits in the state until those before it have
    come, or until the chain has been idle for ``idle_ms`` of event time beyond its latest step; then it is scored as
    the next one there is, with status ``gap``. A number that was taken already comes back as ``late`` without a score.
    An idle chain keeps its sums for ``keep_ms`` more, so that a step after the pause goes on from there; then it leaves the state.
    """

    out = ("chain_id long, t int, risk_score double, risk string, abort boolean, status string")
    names = ["chain_id", "t", "risk_score", "risk", "abort", "status"]

    def __init__(self, idle_ms: int = 3_600_000, abort_at: float = 0.65, keep_ms: int = 86_400_000):
        self.idle, self.abort_at, self.keep = idle_ms, abort_at, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("chain", "s string")

    @staticmethod
    def fresh() -> dict:
        return {"n": 0, "acts": [], "gap": [0.0, 0], "used": [0.0, 0], "coh": [0.0, 0], "words": [0, 0], "first": None, "last": None,
                "risks": 0, "prev": None, "next": 0, "held": {}, "at": 0, "idle": False}

    @staticmethod
    def step(s: dict, row: dict) -> float:
        n = s["n"] = s["n"] + 1
        if row["action_type"] not in s["acts"]:
            s["acts"].append(row["action_type"])
        for k, v in (("gap", row["gap"]), ("used", row["used"]), ("words", row["th_words"])):
            if v is not None:
                s[k] = [s[k][0] + v, s[k][1] + 1]
        if row["step_risk"] is not None:
            s["first"] = row["step_risk"] if s["first"] is None else s["first"]
            s["last"], s["risks"] = row["step_risk"], s["risks"] + 1
        if s["prev"] is not None:
            a, b = set(s["prev"]), set(row["tt"])
            if a | b:
                s["coh"] = [s["coh"][0] + len(a & b) / len(a | b), s["coh"][1] + 1]
        s["prev"] = row["tt"]
        mean = lambda k: s[k][0] / s[k][1] if s[k][1] else 0.5
        # Added up in the order of features.nano_mean: sum() corrects itself from Python 3.12 on, and a prefix would not get its batch score.
        total = 1 - len(s["acts"]) / n + min(n / 10, 1.0) + (1 - mean("gap")) + min(s["words"][0] / (50 * max(s["words"][1], 1)), 1.0) + 0.5 + 1.2
        weight = 6.2
        if n >= 3:
            total += mean("used") * 1.3 + mean("coh") * 1.3
            weight += 2.6
            if s["risks"] >= 3:
                total += (math.tanh(5 * (s["last"] - s["first"]) / max(n - 1, 1)) * 0.5 + 0.5) * 0.8
                weight += 0.8
        return total / weight

    def _scored(self, key, s: dict, idx: int, row: dict, status: str) -> tuple:
        r = self.step(s, row)
        s["next"] = idx + 1
        own = 1 - r if s["n"] <= 2 else r
        return key[0], s["n"], r, "low" if r < 0.5 else "medium" if r < 0.7 else "high", own >= self.abort_at, status

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = self.state.get()
        s = json.loads(got[0]) if got is not None else self.fresh()
        out = []
        for pdf in rows:
            for row in pdf.to_dict("records"):
                idx, at = int(row.pop("step_idx")), int(pd.Timestamp(row.pop("at")).timestamp() * 1000)
                s["at"] = max(s["at"], at)
                if idx < s["next"] or str(idx) in s["held"]:
                    out.append((key[0], idx + 1, None, None, None, "late"))
                    continue
                row["tt"] = [str(w) for w in row["tt"]]
                s["held"][str(idx)] = {k: None if k != "tt" and pd.isna(v) else v for k, v in row.items() if k != "chain_id"}
        while str(s["next"]) in s["held"]:
            out.append(self._scored(key, s, s["next"], s["held"].pop(str(s["next"])), "scored"))
        s["idle"] = False
        self.state.update((json.dumps(s),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(s["at"] + self.idle)
        yield pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        got = self.state.get()
        s = json.loads(got[0]) if got is not None else self.fresh()
        out = [self._scored(key, s, i, s["held"][str(i)], "gap") for i in sorted(map(int, s["held"]))]
        if s["idle"]:
            self.state.clear()
        else:
            s["held"], s["idle"] = {}, True
            self.state.update((json.dumps(s),))
            self.handle.registerTimer(s["at"] + self.idle + self.keep)
        yield pd.DataFrame(out, columns=self.names).astype({"chain_id": "int64", "t": "int32", "risk_score": "float64", "risk": "object", "abort": "object",
                                                            "status": "object"})

    def close(self) -> None:
        pass


def live_steps(steps: DataFrame) -> DataFrame:
    """What the live scorer needs of a step, made before the state and without it; ``at`` is its event time."""
    th, ob = T.text("thought"), T.text("observation")
    s = steps.select("chain_id", "step_idx", "at", T.text("action_type").alias("action_type"), th.alias("_th"), ob.alias("_ob"),
                     T.content_tokens(th).alias("tt"), T.content_tokens(ob).alias("_ot"))
    both = (F.col("_th") != "") & (F.col("_ob") != "")
    common = T.shared(F.col("tt"), F.col("_ot"))
    union = F.size("tt") + F.size("_ot") - common
    return s.select("chain_id", "step_idx", "at", "action_type", "tt", F.when(both & (union > 0), common / union).alias("gap"),
                    F.when(both, 1 - common / F.greatest(union, F.lit(1))).alias("step_risk"),
                    F.when(both, common / F.greatest(F.size("_ot"), F.lit(1))).alias("used"),
                    F.when(F.col("_th") != "", T.word_count(F.col("_th"))).cast("double").alias("th_words"))


def live_scores(step_stream: DataFrame, lateness: str = "1 hour", idle_ms: int = 3_600_000, keep_ms: int = 86_400_000) -> DataFrame:
    """Prefix score of each chain as its steps arrive; chains that stay idle leave the state. Steps older than the watermark are dropped by Spark."""
    return live_steps(step_stream).withWatermark("at", lateness).groupBy("chain_id").transformWithStateInPandas(
        LiveChain(idle_ms, keep_ms=keep_ms), outputStructType=LiveChain.out, outputMode="Append", timeMode="EventTime")


def fan_out(joined: DataFrame) -> DataFrame:
    """What one label feeds: threshold adaptation, online calibration and the blend bandit.

    Works on a batch join and on a stream-stream join of feedback with scored chains.
    """
    wrong = F.col("label") == "incorrect"
    right = (F.col("tier") != "LOW") == (F.col("label") == "correct")
    return joined.select("chain_id", F.concat(F.col("user_id").cast("string"), F.lit(":"), "domain").alias("cisc_key"),
                         wrong.alias("was_wrong"), F.col("risk_score").alias("score"),
                         F.when(wrong, 1).otherwise(0).alias("isotonic_label"), F.when(right, 1.0).otherwise(0.0).alias("reward"))


def feedback_join(feedback: DataFrame, scored: DataFrame, lateness: str = "30 days") -> DataFrame:
    """Stream-stream join: a label finds its chain within the watermark."""
    f = feedback.withWatermark("label_at", lateness)
    s = scored.withWatermark("scored_at", lateness).withColumnRenamed("chain_id", "s_chain")
    on = (F.col("chain_id") == F.col("s_chain")) & (F.col("label_at") >= F.col("scored_at")) & (
        F.col("label_at") <= F.col("scored_at") + F.expr("INTERVAL 30 DAYS"))
    return fan_out(f.join(s, on).drop("s_chain"))


def windowed_series(stream: DataFrame, bucket: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Tumbling counts and mean risk."""
    g = stream.withWatermark("at", lateness).groupBy(F.window("at", bucket)).agg(
        F.avg("risk_score").alias("avg_risk"), F.count(F.lit(1)).alias("n_chains"), F.count_if("needs_alert").alias("n_alerts"))
    return g.select(F.unix_timestamp("window.start").alias("timestamp"), "avg_risk", "n_chains", "n_alerts")


def alert_batches(stream: DataFrame, on_alert: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand every micro-batch of alerts to a callback."""
    return stream.filter("needs_alert").writeStream.foreachBatch(on_alert).option("checkpointLocation", checkpoint)


class Versions:
    """A table with one version per micro-batch and a log of the batches that are done, both below ``folder``.

    A batch counts once its log row is there; a batch that comes again after a restart is known by its number.
    """

    def __init__(self, folder: str | None, name: str):
        self.folder, self.name = folder, name

    def last(self, spark: SparkSession) -> dict | None:
        """Log row of the latest batch."""
        self.folder = self.folder or new_dir(spark, self.name)
        try:
            log = spark.read.parquet(f"{self.folder}/log")
        except AnalysisException:  # nothing is done yet
            return None
        row = log.agg(F.max_by(F.struct("*"), "batch_id").alias("r")).first()
        return row.r.asDict() if row.r else None

    def read(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/v{batch_id}")

    def commit(self, df: DataFrame, batch_id: int, **facts: int | None) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/v{batch_id}")
        row = {"batch_id": batch_id, **facts}
        df.sparkSession.createDataFrame([tuple(row.values())], ", ".join(f"{k} long" for k in row)).write.mode("append").parquet(f"{self.folder}/log")


class OnlineIsotonic:
    """Calibration that follows the labels: the last ``keep`` pairs, refitted every ``every`` new ones.

    Counts rows seen, so it goes on refitting once the buffer is full. What it knows is in ``folder``; a new object there
    goes on where the last one stopped, and a batch that is repeated counts once.
    """

    def __init__(self, keep: int = 500, every: int = 10, folder: str | None = None):
        self.keep, self.every, self.versions = keep, every, Versions(folder, "online")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, rows = batch.sparkSession, batch.select("ts", "chain_id", "score", "label")
        old, n = self.versions.last(spark), batch.count()
        if not n or old and batch_id <= old["batch_id"]:
            return
        seen, fitted, fits, at = (old["seen"], old["fitted"], old["fits"], old["fit_batch"]) if old else (0, 0, 0, None)
        seen += n
        if old:
            rows = rows.unionByName(self.versions.read(spark, old["batch_id"]))
        if seen >= self.every and seen - fitted >= self.every:
            fitted, fits, at = seen, fits + 1, batch_id
        self.versions.commit(rows.orderBy(F.desc("ts"), F.desc("chain_id")).limit(self.keep), batch_id, seen=seen, fitted=fitted, fits=fits, fit_batch=at)

    def buffer(self, spark: SparkSession) -> DataFrame:
        return self.versions.read(spark, self.versions.last(spark)["batch_id"])

    def model(self, spark: SparkSession):
        """The latest fit, made from the version it was due in; nothing before the first."""
        last = self.versions.last(spark)
        return fit_isotonic(self.versions.read(spark, last["fit_batch"]), "score", "label") if last and last["fit_batch"] is not None else None


class Snapshot:
    """Keeps the newest value per key of an update-mode aggregation in a versioned table; a repeated batch changes nothing."""

    def __init__(self, keys: Sequence[str], folder: str | None = None):
        self.keys, self.versions = list(keys), Versions(folder, "snapshot")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        last = self.versions.last(batch.sparkSession)
        if last and batch_id <= last["batch_id"]:
            return
        if last:
            batch = self.versions.read(batch.sparkSession, last["batch_id"]).join(batch.select(*self.keys), self.keys, "left_anti").unionByName(batch)
        self.versions.commit(batch, batch_id)

    def table(self, spark: SparkSession) -> DataFrame:
        return self.versions.read(spark, self.versions.last(spark)["batch_id"])


def sliced(df: DataFrame, ts: str, slices: int = 4, files: int = 2) -> str:
    """Write a table as time slices, one after the other, for a file stream to read in order."""
    spark, path = df.sparkSession, new_dir(df.sparkSession, "slices")
    lo, hi = df.agg(F.min(ts), F.max(ts)).first()
    width = max(1, -(-(hi - lo + 1) // slices))
    for i in range(slices):
        part = df.filter((F.col(ts) >= lo + i * width) & (F.col(ts) < lo + (i + 1) * width))
        part.repartition(files).write.mode("append").parquet(path)
    return path


def stream_of(spark: SparkSession, path: str, schema, files: int = 2) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_now(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything there is and read what it wrote."""
    spark = stream.sparkSession
    out, check = new_dir(spark, "sink"), new_dir(spark, "check")
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], mode: str = "update", checkpoint: str | None = None) -> None:
    check = checkpoint or new_dir(stream.sparkSession, "check")
    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
