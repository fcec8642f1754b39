"""Lines that most pages of a site repeat.

For each site and line the pages that contain it are counted and divided by the site's pages; lines above
the ratio go. A page names a line once, so the counts combine before the shuffle and a line on every page
of a site costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import session
from plumbline.llm.base import query, table, text_of


def _key(line: Column) -> Column:
    """Two 64-bit hashes stand for a line without its outer spaces."""
    return F.struct(F.xxhash64(F.trim(line)).alias("a"), F.xxhash64(F.lit(1), F.trim(line)).alias("b"))


def _keys(text_col: str) -> Column:
    lines = F.filter(F.split(text_of(text_col), "\n"), lambda x: F.trim(x) != "")
    return F.array_distinct(F.transform(lines, _key))


def _page_lines(docs: DataFrame, id_col: str, site_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(site_col).alias("site"), F.explode(_keys(text_col)).alias("key"))


def _texts(docs: DataFrame, site_col: str, text_col: str) -> DataFrame:
    """site, keys: a row for each different text of a site. Copies meet before the shuffle and the text itself stays behind."""
    text = text_of(text_col)
    return (docs.select(F.col(site_col).alias("site"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), _keys(text_col).alias("keys"))
            .groupBy("site", "a", "b").agg(F.first("keys").alias("keys")).select("site", "keys"))


def site_lines(docs: DataFrame, max_ratio: float = 0.05, min_pages: int = 5, id_col: str = "doc_id",
               site_col: str = "source", text_col: str = "text", copies_once: bool = False) -> DataFrame:
    """site, key, pages, site_pages: lines on more than ``max_ratio`` of a site's pages and on at least ``min_pages``.

    With ``copies_once``, rows of a site with equal texts are one page in both counts.
    """
    if copies_once:
        texts = session.written(docs.sparkSession, _texts(docs, site_col, text_col), "site-texts")
        sites, lines = texts.withColumnRenamed("site", "of"), texts.select("site", F.explode("keys").alias("key"))
    else:
        sites, lines = docs.select(F.col(site_col).alias("of")), _page_lines(docs, id_col, site_col, text_col)
    totals = sites.groupBy("of").agg(F.count("*").alias("site_pages"))
    counts = lines.groupBy("site", "key").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    return (counts.join(totals, F.col("site").eqNullSafe(F.col("of"))).drop("of")
            .where(F.col("pages") > max_ratio * F.col("site_pages")))


def drop_site_lines(docs: DataFrame, max_ratio: float = 0.05, min_pages: int = 5, id_col: str = "doc_id",
                    site_col: str = "source", text_col: str = "text", copies_once: bool = False) -> DataFrame:
    """row (all columns of ``docs`` as they are), n_lines, n_dropped, text: one row per row of ``docs``.

    ``text`` is what stays, its lines joined again. Blank lines are never dropped and count as lines. A null
    text is empty: one blank line. Rows with a null site form one site. Rows may repeat or share identifiers; each
    counts as a page, or equal texts of a site as one with ``copies_once``. A page whose lines all go keeps its row with an empty text.
    """
    spark = docs.sparkSession
    common = session.written(spark, site_lines(docs, max_ratio, min_pages, id_col, site_col, text_col, copies_once), "site-lines")
    c = common.select(F.col("site").alias("of"), F.col("key").alias("bad"))
    pages = _page_lines(docs, id_col, site_col, text_col)
    hits = (pages.join(c, F.col("site").eqNullSafe(F.col("of")) & (F.col("key") == F.col("bad")), "left_semi")
            .groupBy("id", "site").agg(F.collect_set("key").alias("bad")))
    d = docs.select(F.struct("*").alias("row"))
    lines = F.split(F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")), "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains("bad", _key(x)))
    return (d.join(hits, F.col("row")[id_col].eqNullSafe(F.col("id")) & F.col("row")[site_col].eqNullSafe(F.col("site")), "left")
            .withColumn("kept", F.when(F.col("bad").isNull(), lines).otherwise(kept))
            .select("row", F.size(lines).cast("long").alias("n_lines"),
                    (F.size(lines) - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text")))


@query("op6_line_dedup", """
    WITH p AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT p.doc_id, p.source, u.i, p.lines[u.i] AS line FROM p, unnest(generate_series(1, len(p.lines))) AS u(i)),
    t AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
    c AS (SELECT source, trim(line) AS line, count(DISTINCT doc_id) AS n FROM l WHERE trim(line) <> '' GROUP BY ALL),
    bad AS (SELECT c.source, c.line FROM c JOIN t USING (source) WHERE c.n >= 5 AND c.n > 0.05 * t.n)
    SELECT l.doc_id, any_value(l.source) AS source, count(*) AS n_lines, count(bad.line) AS n_dropped,
           coalesce(string_agg(l.line, chr(10) ORDER BY i) FILTER (WHERE bad.line IS NULL), '') AS text
    FROM l LEFT JOIN bad ON l.source = bad.source AND trim(l.line) = bad.line GROUP BY l.doc_id""")
def op6_line_dedup(spark, base):
    return drop_site_lines(table(spark, base, "documents")).select("row.doc_id", "row.source", "n_lines", "n_dropped", "text")
