"""The chain store: readers, writers and table upkeep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as ST

from plumbline import fixed
from plumbline.functions import text as T
from plumbline.operators.ordered import latest_per_key, top_per_key

STEP = "struct<thought:string,action_type:string,action_arg:string,observation:string>"
CHAIN_FIELDS = f"question:string,steps:array<{STEP}>,final_answer:string,correct:boolean"
TELEMETRY_SCHEMA = "f array<double>, y int, d string, v string"


def chain_rows(texts: DataFrame, col: str = "value") -> DataFrame:
    """JSON lists of chains to rows; a missing label reads as wrong."""
    keep = [c for c in texts.columns if c != col]
    d = texts.select(*keep, F.explode(F.from_json(col, f"array<struct<{CHAIN_FIELDS}>>")).alias("c"))
    return d.select(*keep, "c.question", "c.steps", "c.final_answer", F.coalesce("c.correct", F.lit(False)).alias("correct"))


def read_chains(spark: SparkSession, path: str) -> DataFrame:
    """Chain JSON lists, one file per domain. Cache and result files are left out."""
    d = spark.read.text(path, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    d = d.select("value", name.alias("_file"))
    d = d.filter(~F.col("_file").contains("cache") & ~F.col("_file").contains("results"))
    return chain_rows(d.select("value", F.regexp_replace("_file", r"\.[^.]*$", "").alias("domain")))


def json_lines(lines: DataFrame, schema: str, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines). Blank lines are skipped.

    Each line is read as the only item of a list, so text after the object counts as malformed too.
    """
    lines = lines.filter(T.strip(F.col(col)) != "")
    one = F.concat(F.lit("["), F.col(col), F.lit("]"))
    d = lines.select(col, F.from_json(one, ST.ArrayType(ST._parse_datatype_string(schema))).alias("r"))
    good = F.coalesce(F.size("r") == 1, F.lit(False)) & F.get("r", F.lit(0)).isNotNull()
    return d.filter(good).select(F.get("r", F.lit(0)).alias("r")).select("r.*"), d.filter(~good).select(F.col(col).alias("line"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    return json_lines(spark.read.text(path), schema)


def valid_telemetry(rows: DataFrame, width: int = 11) -> DataFrame:
    return rows.filter((F.size("f") == width) & F.col("y").isNotNull())


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return valid_telemetry(read_json_lines(spark, path, TELEMETRY_SCHEMA)[0])


TAXONOMY_ENTRY = (f"struct<question:string,step_details:array<{STEP}>,steps:array<{STEP}>,final_answer:string>")


def taxonomy_rows(parsed: DataFrame, col: str = "m") -> DataFrame:
    """Map of failure mode to entries as labelled chains (label 1); entries without steps are dropped."""
    e = parsed.select(F.explode(col).alias("mode", "entries")).select("mode", F.explode("entries").alias("e"))
    use = lambda a: F.when(F.size(a) > 0, a)
    e = e.select("mode", "e.question", F.coalesce(use(F.col("e.step_details")), F.col("e.steps")).alias("steps"),
                 "e.final_answer")
    return e.filter(F.size("steps") > 0).withColumn("wrong", F.lit(1))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True)
    return taxonomy_rows(raw.select(F.from_json("value", f"map<string,array<{TAXONOMY_ENTRY}>>").alias("m")))


def first_filled(df: DataFrame, names: Sequence[str], default: str = "") -> Column:
    """First non-empty value among alias columns."""
    have = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*have, F.lit(default))


def flexible_runs(df: DataFrame) -> DataFrame:
    """Runs with any of the known column names; steps that are not readable become an empty list."""
    text = first_filled(df, ["steps", "chain_steps"], "[]")
    empty = F.array().cast(f"array<{STEP}>")
    return df.select("chain_id", first_filled(df, ["question", "input", "query"], "(unknown)").alias("question"),
                     F.coalesce(F.from_json(text, f"array<{STEP}>"), empty).alias("steps"),
                     first_filled(df, ["final_answer", "output", "answer"]).alias("final_answer"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.csv(path, header=True)
    if "question" not in d.columns:
        raise ValueError("the file needs a column named question")
    return d


def judge_cost(label: Column) -> Column:
    """Price of a chain: only judge calls cost, not labels of local or structural models."""
    return F.when(label.isNotNull() & ~label.isin("LOCAL", "STRUCTURAL", ""), fixed.JUDGE_CALL_COST).otherwise(0.0)


def store_rows(scored: DataFrame) -> DataFrame:
    """Scored chains in store form: texts cut to 500 characters, default domain, price."""
    return scored.withColumns({
        "question": F.substring("question", 1, 500), "final_answer": F.substring("final_answer", 1, 500),
        "domain": F.coalesce(F.nullif("domain", F.lit("")), F.lit("default")),
        "cost": judge_cost(F.col("judge_label"))})


def append_chains(scored: DataFrame, path: str) -> None:
    """Append by domain; partitions are rebalanced by size, so a hot domain gets as many writers as it fills."""
    store_rows(scored).hint("rebalance", "domain").write.mode("append").partitionBy("domain").parquet(path)


def latest_feedback(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, latest submission wins; combined on the map side."""
    return latest_per_key(log, keys, order)


def merge_feedback(table: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Upsert ``new`` into ``table``."""
    fresh = latest_per_key(new, keys, order)
    return table.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh)


def audit_rows(store: DataFrame, domain: str, start: int, end: int, cut: int = 200) -> DataFrame:
    d = store.filter((F.col("domain") == domain) & F.col("ts").between(start, end))
    return d.withColumn("question", F.substring("question", 1, cut)) if "question" in d.columns else d


def export_audit(store: DataFrame, domain: str, start: int, end: int, path: str, fmt: str = "csv") -> None:
    rows = audit_rows(store, domain, start, end)
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def without_domain(store: DataFrame, domain: str) -> DataFrame:
    return store.filter(F.col("domain") != domain)


def clear_domain(spark: SparkSession, path: str, domain: str) -> int:
    """Drop one domain's partition of a stored table; the other partitions are not touched."""
    n = spark.read.parquet(path).filter(F.col("domain") == domain).count()
    if n:
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path, f"domain={domain}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return n


def latest_n(store: DataFrame, n: int, keys: Sequence[str] = ("domain",)) -> DataFrame:
    """Calibration pool: last ``n`` chains of each domain."""
    return top_per_key(store, keys, [F.desc("ts"), F.desc("chain_id")], n)


def seed_domain(store: DataFrame, source: str, target: str, n: int = 25) -> DataFrame:
    """Latest ``n`` chains of one domain, relabelled as another."""
    return latest_n(store.filter(F.col("domain") == source), n).withColumn("domain", F.lit(target))


def anonymised(features: DataFrame, feature_col: str = "f") -> DataFrame:
    short = F.when(T.text("domain") != "", F.substring(F.sha2("domain", 256), 1, 6)).otherwise("")
    return features.select(F.transform(feature_col, lambda x: F.round(x, 6)).alias("f"), "y", short.alias("d"), "v")
