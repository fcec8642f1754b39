"""Exact duplicates by content sort.

Splitters sampled from the texts' first characters deal the rows to ranges; each range is sorted by the
whole normalised text, which puts equal texts side by side, and each row is compared in full with its
neighbour. A prefix that holds more than its share of the rows is dealt to several ranges; the runs found
there are compared once more by their whole texts, one row a run.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline import session
from plumbline.llm.base import ascii_lower, id_of, query, shuffle_partitions, table, text_of

#: A range of the sort gets at most one part in this many of a partition's fair share from one prefix.
PARTS = 4


def exact_groups(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text",
                 prefix: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Texts are equal when identical after lower-casing A-Z. ``keep`` ("smallest" or "largest") names the
    identifier of the row that stays. A null text counts as empty. Of rows that share both text and
    identifier one stays. A null identifier is never preferred; a group of null identifiers only has a
    null ``keep_id`` and one row that stays. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    best = F.max if keep == "largest" else F.min
    raw = docs.select(id_of(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn(
        "prefix", ascii_lower(F.substring("text", 1, prefix)))
    share = raw.groupBy("prefix").agg(F.count("*").alias("n"))
    # At most PARTS * n prefixes can hold more than a PARTS * n-th part of all rows.
    top = share.orderBy(F.desc("n"), "prefix").limit(PARTS * n).collect()
    total = docs.count()
    hot = [(r.prefix, math.ceil(r.n * PARTS * n / total)) for r in top if r.n * PARTS * n > total and r.n > 1]
    hot = spark.createDataFrame(hot, "prefix string, parts int")
    dealt = (raw.join(F.broadcast(hot), "prefix", "left")
             .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))).cast("int"))
             .withColumn("split", F.col("parts").isNotNull()).drop("parts")
             .repartitionByRange(n, "prefix", "salt")
             .withColumn("norm", ascii_lower(F.col("text"))).drop("text"))
    order = F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last()
    w = Window.partitionBy("prefix", "salt").orderBy("norm", order)
    runs = (dealt.withColumn("head", ~F.col("norm").eqNullSafe(F.lag("norm").over(w)))
            .withColumn("run", F.sum(F.col("head").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .select("doc_id", "prefix", "salt", "split", "run", F.sha2("norm", 256).alias("text_sha256"),
                    F.when(F.col("head") & F.col("split"), F.col("norm")).alias("rep")))
    g = Window.partitionBy("prefix", "salt", "run").orderBy(order)
    whole = g.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = session.written(spark, runs.select(
        "*", best("doc_id").over(whole).alias("run_keep"), F.count("*").over(whole).alias("run_n"),
        F.row_number().over(g).alias("place")), "exact-runs")
    same = Window.partitionBy("rep")
    joined = (runs.where("rep is not null")
              .select(F.col("prefix").alias("p"), F.col("salt").alias("s"), F.col("run").alias("r"),
                      best("run_keep").over(same).alias("keep_id"), F.sum("run_n").over(same).alias("group_size"),
                      F.row_number().over(same.orderBy(F.col("run_keep").desc_nulls_last() if keep == "largest"
                                                       else F.col("run_keep").asc_nulls_last(), "salt")).alias("first")))
    spread = runs.where("split").join(joined, (F.col("prefix") == F.col("p")) & (F.col("salt") == F.col("s")) & (F.col("run") == F.col("r")))
    plain = runs.where("not split").withColumns({"keep_id": F.col("run_keep"), "group_size": F.col("run_n"), "first": F.lit(1)})
    cols = ["doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("place") == 1) & (F.col("first") == 1)).alias("kept"), "text_sha256"]
    return plain.select(*cols).unionAll(spread.select(*cols))


@query("op10_exact_dedup", """
    WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
    FROM n""")
def op10_exact_dedup(spark, base):
    return exact_groups(table(spark, base, "documents"), keep="largest")
