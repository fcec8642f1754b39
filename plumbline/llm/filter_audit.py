"""What each filter removes, in every order of the filters.

A document is a mask of the filters it fails. For each mask a big integer is prepared whose fields hold the outcomes of
all steps of all orders (600 for five filters): is it kept, is it removed here, does it fail a filter that came too
late. A mask that n documents share adds n times its integer, so a part's sum holds all counts at once. Fields have 64 bits and
counts are below 2^63, so no field runs into the next one. Masks are counted before anything is sent, and a
part's rows are at most four for each mask.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import session
from plumbline.llm.base import id_of, query, table, text_of

FIELD = 64
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


class Steps:
    """All orders of ``letters`` and, for each mask, its outcomes as one wide integer. Bit i of a mask is letter i."""

    def __init__(self, letters: str):
        self.letters = letters
        self.orders = ["".join(p) for p in itertools.permutations(letters)]
        self.n = len(self.orders) * len(letters)
        bit = {c: 1 << i for i, c in enumerate(letters)}
        planes = {c: np.zeros((1 << len(letters), self.n), np.uint64) for c in COUNTS[:4]}
        for mask in range(1 << len(letters)):
            at = 0
            for order in self.orders:
                alive = True
                for c in order:
                    fails = bool(mask & bit[c])
                    planes["removed"][mask, at] = alive and fails
                    planes["redundant"][mask, at] = fails and not alive
                    planes["unique_fails"][mask, at] = mask == bit[c]
                    alive = alive and not fails
                    planes["kept"][mask, at] = alive
                    at += 1
        wide = lambda rows: [int.from_bytes(r.astype("<u8").tobytes(), "little") for r in rows]
        shift = self.n * FIELD
        whole = [np.concatenate([planes[c][m] for c in COUNTS[:4]]) for m in range(1 << len(letters))]
        self.codes, self.lost = wide(whole), wide(planes["removed"])
        self.good, self.toxic = 4 * shift, 5 * shift

    def code(self, mask: int, n: int, good: int, toxic: int) -> int:
        """The integer that ``n`` documents of a mask add, ``good`` and ``toxic`` of which are labelled so."""
        return n * self.codes[mask] + (good * self.lost[mask] << self.good) + (toxic * self.lost[mask] << self.toxic)

    def unpack(self, total: int) -> dict[str, np.ndarray]:
        fields = np.frombuffer(total.to_bytes(len(COUNTS) * self.n * FIELD // 8, "little"), "<u8").astype(np.int64)
        out = dict(zip(COUNTS, fields.reshape(len(COUNTS), self.n)))
        letter = np.array([self.letters.index(c) for o in self.orders for c in o])
        sums = np.zeros(len(self.letters), np.int64)
        np.add.at(sums, letter, out["removed"])
        return out | {"shapley": sums[letter]}


def audit(docs: DataFrame, labels: DataFrame, failures: Mapping[str, Column], copies: str = "E", id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row per part and step of each order.

    ``failures`` names a filter by one letter and says, over the column ``text``, which documents fail it. The filter
    ``copies`` fails a document whose whole text a document of smaller identifier has, in any part; texts are told apart
    by their sha256. A null text or part is an empty string. Rows may repeat: each counts, and rows of one identifier are no
    copies of each other. A row without identifier fails no such filter, makes no other fail it and has no labels. An
    identifier is good (toxic) when any of its ``labels`` rows has quality (toxic) 1. With no rows there are no parts.
    Other columns are ignored.
    """
    spark, steps = docs.sparkSession, Steps("".join(sorted([*failures, copies])))
    bit = {c: 1 << i for i, c in enumerate(steps.letters)}
    text = docs.select(id_of(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_of(text_col).alias("text"))
    fails = [F.when(c, bit[k]).otherwise(0) for k, c in failures.items()]
    mask = fails[0]
    for f in fails[1:]:
        mask = mask.bitwiseOR(f)
    seen = (text.select("doc_id", "part", F.sha2("text", 256).alias("sha"), mask.alias("mask"))
            .groupBy("doc_id", "part", "sha", "mask").agg(F.count("*").alias("n")))
    seen = session.written(spark, seen, "masks")
    named = seen.where("doc_id is not null")
    # The first document of a text is found again by text and identifier, so that no text, however frequent, is one task's.
    first = named.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = named.join(first, ["doc_id", "sha"], "left").select(
        "doc_id", "part", "n", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask").bitwiseOR(bit[copies])).alias("mask"))
    tags = (labels.select(id_of(id_col).alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
            .groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).where("good or toxic"))
    counted = marked.join(tags, "doc_id", "left").unionByName(seen.where("doc_id is null").drop("sha", "doc_id"), allowMissingColumns=True)
    counted = counted.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = [o for o in steps.orders for _ in o]
        step = list(range(1, len(steps.letters) + 1)) * len(steps.orders)

        def out(part: str, total: int) -> pa.RecordBatch:
            got = steps.unpack(total)
            return pa.RecordBatch.from_pydict({"part": pa.array([part] * steps.n, pa.string()), "filter_order": pa.array(order, pa.string()),
                                               "step": pa.array(step, pa.int32()), **{c: pa.array(v, pa.int64()) for c, v in got.items()}})

        now, total = None, 0
        for batch in batches:
            for part, *counts in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    if now is not None:
                        yield out(now, total)
                    now, total = part, 0
                total += steps.code(*counts)
        if now is not None:
            yield out(now, total)

    rows = counted.select("part", "mask", "n", "good", "toxic").repartition("part").sortWithinPartitions("part")
    return rows.mapInArrow(summed, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in (*COUNTS, "shapley")))


def text_failures(min_words: int = 200, distinct_percent: int = 50, upper_percent: int = 2, marks: str = "#$%&*|") -> dict[str, Column]:
    """Filters A to D over ``text``: too few words, too few different ones, too many capitals, any of the marks."""
    text = F.col("text")
    words = F.filter(F.split(text, "[ \t-\r]+"), lambda w: w != "")
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    return {"A": n < min_words, "B": 100 * distinct < distinct_percent * n,
            "C": 100 * capitals.cast("long") > upper_percent * F.char_length(text).cast("long"),
            "D": F.char_length(F.translate(text, marks, "")) < F.char_length(text)}


@query("op12_filter_audit", r"""
    WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    f AS (SELECT t.doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
            100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
            coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM t),
    l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT part, a, b, c, d, e, count(*) AS n, count(CASE WHEN good THEN 1 END) AS good, count(CASE WHEN toxic THEN 1 END) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
    x AS (SELECT * FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(k)),
    o AS (SELECT x1.k || x2.k || x3.k || x4.k || x5.k AS filter_order FROM x x1, x x2, x x3, x x4, x x5 WHERE len(list_distinct([x1.k, x2.k, x3.k, x4.k, x5.k])) = 5),
    s AS (SELECT m.*, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails FROM m),
    r AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS k, n, good, toxic, fails, contains(fails, substr(filter_order, step, 1)) AS here,
            fails <> '' AND regexp_matches(substr(filter_order, 1, step - 1), '[' || fails || '_]') AS before FROM s, o, (SELECT CAST(range AS INTEGER) AS step FROM range(1, 6))),
    g AS (SELECT part, filter_order, step, k, CAST(sum(CASE WHEN NOT here AND NOT before THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN here AND NOT before THEN n ELSE 0 END) AS BIGINT) AS removed,
            CAST(sum(CASE WHEN here AND before THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fails = k THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
            CAST(sum(CASE WHEN here AND NOT before THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN here AND NOT before THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM r GROUP BY ALL)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM g""")
def op12_filter_audit(spark, base):
    return audit(table(spark, base, "documents"), table(spark, base, "labels"), text_failures())
