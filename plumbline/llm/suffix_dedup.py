"""Byte strings that occur more than once, by bucket-pointer refinement.

Every window of ``length`` bytes holds q-grams; the one of least hash is its anchor, so equal windows have equal anchors
at equal offsets. Anchors are the initial buckets: those of one member hold no repeat. Neighbouring windows of one anchor
form a context (its bytes from the first window to the last one's end). Contexts that occur twice are repeats as they
stand; the others of a bucket are refined: their positions start in buckets of 8-byte grams, and sorting on the pairs of
bucket numbers of a position and of a later offset doubles the length that a bucket stands for, until it is
``length``. Windows that share a bucket then are equal. Buckets of many contexts are split by hashes of their
windows' parts instead of being gathered in a task. Equal texts are one text with a mark; all of their windows are repeats.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import session
from plumbline.llm.base import id_of, query, resident, rows, shuffle_partitions, table, text_of

GRAM = 32
BLOCK = 1 << 19  # window starts of a text looked at together; a position of a block and its overlap fits in 20 bits
GATHER = 1 << 18  # bytes of contexts refined together
MANY = 2048  # contexts of a bucket beyond which it is split by the hashes of its windows' parts
HOT = 1 << 16  # contexts at most that are found again by a set that each task holds, 16 bytes each
PIECE = 8  # neighbouring windows told apart together in such a bucket

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


class Anchors:
    """Anchors of texts: hash, context hash, position, first and last window start."""

    def __init__(self, length: int):
        if length < GRAM + 8:
            raise ValueError(f"length must be at least {GRAM + 8}")
        self.length, self.width = length, length - GRAM + 1
        self.value = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
        self.up, self.down = _powers(_ODD, 4096), _powers(_INVERSE, 4096)

    def _least(self, x: np.ndarray) -> np.ndarray:
        """Least of each ``width`` neighbours."""
        w, n = self.width, len(x)
        pad = -n % w
        y = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
        ahead = np.minimum.accumulate(y, 1).ravel()
        behind = np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
        return np.minimum(behind[:n - w + 1], ahead[w - 1:n])

    def of(self, text: bytes) -> tuple[np.ndarray, ...]:
        found = []
        for first in range(0, len(text) - self.length + 1, BLOCK):
            b = np.frombuffer(text, np.uint8, min(BLOCK + self.length - 1, len(text) - first), first)
            n = len(b)
            if len(self.up) <= n:
                self.up, self.down = _powers(_ODD, 2 * n), _powers(_INVERSE, 2 * n)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.value[b] * self.up[:n], out=sums[1:])
            grams = (sums[GRAM:] - sums[:-GRAM]) * self.down[:n - GRAM + 1]
            grams = _mixed(grams)
            at = (self._least(grams & ~np.uint64(0xFFFFF) | np.arange(len(grams), dtype=np.uint64)) & np.uint64(0xFFFFF)).astype(np.int64)
            lo = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
            hi = np.concatenate([lo[1:] - 1, [len(at) - 1]])
            p = at[lo]
            context = (sums[hi + self.length] - sums[lo]) * self.down[lo]
            context = _mixed(context ^ ((p - lo) * 65536 + (p - hi)).astype(np.uint64) * np.uint64(_ODD))
            found.append((grams[p], context, p + first, lo + first, hi + first))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3


def refine(texts: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """For each text, which of its windows of ``length`` bytes weigh at least 2 together with their equals.

    A bucket number stands for the bytes from a position on; the numbers of a position and of one further on give, by
    sorting, the numbers for the longer string. Texts are shorter than 2^31 bytes together.
    """
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    n = len(data) - 8
    end = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(n)
    gram = np.zeros(n, np.uint64)
    for j in range(8):
        gram |= data[j:n + j].astype(np.uint64) << np.uint64(8 * j)
    span = 8
    bucket = np.full(n, -1, np.int64)
    live = at[at + span <= end]
    bucket[live] = np.unique(gram[live], return_inverse=True)[1]
    while span < length:
        step = min(span, length - span)
        live = live[live + span + step <= end[live]]
        pair = bucket[live] * np.int64(n + 1) + bucket[live + step]
        bucket[live] = np.unique(pair, return_inverse=True)[1]
        span += step
    total = np.bincount(bucket[live], np.repeat(weights, sizes)[live])
    twice = np.zeros(n, bool)
    twice[live] = total[bucket[live]] >= 2
    ends = np.cumsum(sizes)
    return [twice[e - s:max(e - length + 1, e - s)] for s, e in zip(sizes, ends)]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of true flags."""
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _key(text) -> list:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    """k1, k2, body (compressed), n_bytes, twice: each different text once, dealt to buckets by its key."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    keyed = docs.select(*_key(text_of(text_col)), text_of(text_col).cast("binary").alias("text"))
    often = session.written(spark, keyed.groupBy("k1", "k2").count().where("count > 1").select(F.col("k1").alias("o1"), F.col("k2").alias("o2")), "repeat-texts")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, press = set(), zstandard.ZstdCompressor(3).compress
        for k1, k2, texts in rows(batches):
            if len(seen) > 1 << 20:  # ``first`` finds what comes again after that
                seen.clear()
            got = [[], [], [], []]
            for a, b, text in zip(k1, k2, texts):
                if (a, b) not in seen:
                    seen.add((a, b))
                    for c, v in zip(got, (a, b, press(text), len(text))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(got, (pa.int64(), pa.int64(), pa.binary(), pa.int64()))], ["k1", "k2", "body", "n_bytes"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            keep = [k != j for k, j in zip(keys, [last, *keys])]
            last = keys[-1] if keys else last
            yield batch.filter(pa.array(keep, pa.bool_()))

    kind = "k1 long, k2 long, body binary, n_bytes long"
    one = (keyed.mapInArrow(once, kind).repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(first, kind))
    name, path = f"plumbline_texts_{uuid.uuid4().hex}", session.new_dir(spark, "repeat-bodies")
    one.repartition(n, "k1", "k2").write.bucketBy(n, "k1", "k2").option("path", path).option("compression", "none").saveAsTable(name)
    body = spark.table(name)
    return body.join(often, (F.col("k1") == F.col("o1")) & (F.col("k2") == F.col("o2")), "left").withColumn("twice", F.col("o1").isNotNull()).drop("o1", "o2")


ANCHOR = "h long, c long, k1 long, k2 long, place long, weight int"


def _anchors(texts: DataFrame, length: int) -> DataFrame:
    """``place`` packs the anchor's position and its distances from the first and last window start."""
    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, unpress = resident(("anchors", length), lambda: Anchors(length)), zstandard.ZstdDecompressor().decompress
        for k1, k2, bodies, twice in rows(batches, 32):
            parts = [a.of(unpress(b)) for b in bodies]
            sizes = [len(p[0]) for p in parts]
            h, c, p, lo, hi = (np.concatenate([x[i] for x in parts]) for i in range(5))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                h.view(np.int64), c.view(np.int64), np.repeat(np.array(k1, np.int64), sizes), np.repeat(np.array(k2, np.int64), sizes),
                p << 16 | (p - lo) << 8 | (p - hi), np.repeat(np.array(twice, np.int32) + np.int32(1), sizes))], ["h", "c", "k1", "k2", "place", "weight"])
    if length > 255:
        raise ValueError("length must be at most 255")
    return texts.select("k1", "k2", "body", "twice").mapInArrow(anchored, ANCHOR)


def _windows(place: list[int]) -> list[tuple[int, int]]:
    """First and last window start of packed places."""
    return [((x >> 16) - (x >> 8 & 255), (x >> 16) - (x & 255)) for x in place]


SPAN = "k1 long, k2 long, start long, stop long"


def _crowded(texts: DataFrame, hot: list[tuple[int, int]], length: int) -> DataFrame:
    """Spans of the contexts (h, c) in ``hot`` in texts that occur once: one row per maximal run, not one per anchor."""
    h_, c_ = (np.array(x, np.int64) for x in (zip(*sorted(hot, key=lambda x: (x[1], x[0])))))
    sent = texts.sparkSession.sparkContext.broadcast((h_, c_))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, unpress = resident(("anchors", length), lambda: Anchors(length)), zstandard.ZstdDecompressor().decompress
        hs, cs = sent.value
        alone = len(np.unique(cs)) == len(cs)
        pairs = set(zip(hs.tolist(), cs.tolist()))
        for k1, k2, bodies in rows(batches, 32):
            got = [[], [], [], []]
            for x, y, body in zip(k1, k2, bodies):
                h, c, _, lo, hi = a.of(unpress(body))
                h, c = h.view(np.int64), c.view(np.int64)
                at = np.minimum(np.searchsorted(cs, c), len(cs) - 1)
                hit = np.flatnonzero(cs[at] == c)
                keep = hit[hs[at[hit]] == h[hit]] if alone else np.array([i for i in hit.tolist() if (int(h[i]), int(c[i])) in pairs], np.int64)
                for start, stop in merged(list(zip(lo[keep].tolist(), (hi[keep] + length).tolist()))):
                    for col, v in zip(got, (x, y, start, stop)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], ["k1", "k2", "start", "stop"])

    return texts.where("not twice").select("k1", "k2", "body").mapInArrow(spans, SPAN)


def _refined(wanted: DataFrame, length: int) -> DataFrame:
    """Repeated spans of lone contexts in buckets that a task can gather."""
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor().decompress
        for k1, k2, bodies, lists in rows(batches, 64):
            got = [[] for _ in range(6)]
            for a, b, body, asked in zip(k1, k2, bodies, lists):
                text = unpress(body)
                for x, (lo, hi) in zip(asked, _windows([x["place"] for x in asked])):
                    for c, v in zip(got, (x["h"], a, b, lo, x["m"], text[lo:hi + length])):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(got, (*[pa.int64()] * 4, pa.int32(), pa.binary()))], ["h", "k1", "k2", "lo", "m", "context"])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def flush():
            got = [[], [], [], []]
            for (_, k1, k2, lo, m, _), twice in zip(held, refine([x[5] for x in held], [x[4] for x in held], length)):
                if m == 1:
                    for s, e in zip(*_runs(twice)):
                        for c, v in zip(got, (k1, k2, lo + s, lo + e + length)):
                            c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], ["k1", "k2", "start", "stop"])

        for columns in rows(batches, 1024):
            for x in zip(*columns):
                if x[0] != last and size >= GATHER:
                    yield flush()
                    held, size = [], 0
                last, size = x[0], size + len(x[5])
                held.append(x)
        if held:
            yield flush()

    return (wanted.mapInArrow(contexts, "h long, k1 long, k2 long, lo long, m int, context binary").repartition("h").sortWithinPartitions("h")
            .mapInArrow(spans, SPAN))


def _digests(text: bytes, seed: int) -> tuple[int, int]:
    return xxhash.xxh3_64_intdigest(text, seed) - (1 << 63), xxhash.xxh3_64_intdigest(text, ~seed & 0xFFFFFFFF) - (1 << 63)


def _pieces(wanted: DataFrame, length: int) -> DataFrame:
    """One row per context and ``PIECE`` neighbouring distances j of a window start before the anchor.

    ``core`` stands for the bytes that all windows of the piece have in common, ``whole`` for those of any of them.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor().decompress
        names = ["h", "t", "core1", "core2", "whole1", "whole2", "k1", "k2", "p", "near", "far", "m"]
        for k1, k2, bodies, lists in rows(batches, 64):
            got = [[] for _ in names]
            for a, b, body, asked in zip(k1, k2, bodies, lists):
                text = unpress(body)
                for x, (lo, hi) in zip(asked, _windows([x["place"] for x in asked])):
                    p = x["place"] >> 16
                    for t in range((p - hi) // PIECE, (p - lo) // PIECE + 1):
                        first, last = t * PIECE, t * PIECE + PIECE - 1
                        left = max(p - last, 0)
                        for c, v in zip(got, (x["h"], t, *_digests(text[p - first:p + length - last], t), *_digests(text[left:p + length - first], 256 * (p - left) + t),
                                              a, b, p, max(first, p - hi), min(last, p - lo), x["m"])):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], names)
    return wanted.mapInArrow(cut, "h long, t long, core1 long, core2 long, whole1 long, whole2 long, k1 long, k2 long, p long, near long, far long, m long")


def _split(wanted: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """Repeated spans of lone contexts in buckets of many, which no task gathers.

    A piece whose bytes occur twice is repeated, one whose core occurs once is not. Of the others, and of
    one partner for each of their neighbours in the core's bucket, every window's hash is counted.
    """
    spark = wanted.sparkSession
    core, whole = ["h", "t", "core1", "core2"], ["h", "t", "whole1", "whole2"]
    pieces = session.written(spark, _pieces(wanted, length), "repeat-pieces")
    kinds = session.written(spark, pieces.groupBy(*core, "whole1", "whole2").agg(F.sum("m").alias("n"), F.min(F.struct("k1", "k2", "p", "near", "far")).alias("one")), "repeat-kinds")
    yes = pieces.where("m = 1").join(session.written(spark, kinds.where("n > 1").select(*whole), "repeat-whole"), whole).select(
        "k1", "k2", (F.col("p") - F.col("far")).alias("start"), (F.col("p") - F.col("near") + length).alias("stop"))
    open_ = session.written(spark, kinds.groupBy(*core).agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select(*core), "repeat-open")
    asked = kinds.join(open_, core).select(F.least("n", F.lit(2)).alias("m"), "one.*")
    lists = asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("p", "near", "far", "m")).alias("asked"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor().decompress
        for k1, k2, bodies, lists in rows(batches, 64):
            got = [[] for _ in range(6)]
            for a, b, body, asked in zip(k1, k2, bodies, lists):
                text = unpress(body)
                for x in asked:
                    for s in range(x["p"] - x["far"], x["p"] - x["near"] + 1):
                        for c, v in zip(got, (*_digests(text[s:s + length], 0), a, b, s, x["m"])):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], ["w1", "w2", "k1", "k2", "start", "m"])

    w = session.written(spark, texts.join(lists, ["k1", "k2"]).select("k1", "k2", "body", "asked").mapInArrow(
        hashed, "w1 long, w2 long, k1 long, k2 long, start long, m long"), "repeat-windows")
    often = session.written(spark, w.groupBy("w1", "w2").agg(F.sum("m").alias("n")).where("n > 1").select("w1", "w2"), "repeat-often")
    return yes.unionAll(w.where("m = 1").join(often, ["w1", "w2"]).select("k1", "k2", "start", (F.col("start") + length).alias("stop")))


def repeats(docs: DataFrame, length: int = 200, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The different texts (k1, k2, body, n_bytes, twice) and the spans of those that occur once: k1, k2, spans.

    A span's bytes are covered by strings of ``length`` bytes (40 to 255) that start elsewhere too, in the same text or another
    one; spans may overlap. All windows of a text that stands more than once (``twice``) are repeats, which no span says.
    """
    spark = docs.sparkSession
    texts = _texts(docs, text_col)
    buckets = session.written(spark, _anchors(texts, length).groupBy("h").agg(F.sum("weight").alias("n")).where("n > 1").select(F.col("h").alias("b")), "repeat-buckets")
    members = session.written(spark, _anchors(texts, length).join(buckets, F.col("h") == F.col("b")).drop("b"), "repeat-members")
    contexts = session.written(spark, members.groupBy("h", "c").agg(F.sum("weight").alias("m"), F.min(F.struct("k1", "k2", "place")).alias("one")), "repeat-contexts")
    # At most HOT contexts can hold more than a HOT-th part of all members.
    many = max(64, -(-(contexts.agg(F.sum("m")).first()[0] or 0) // HOT))
    hot = contexts.where(F.col("m") > many).select("h", "c")
    lone = members.where("weight = 1").join(F.broadcast(hot), ["h", "c"], "left_anti")
    known = lone.join(contexts.where((F.col("m") > 1) & (F.col("m") <= many)).select("h", "c"), ["h", "c"])
    p = F.shiftright("place", 16)
    whole = known.select("k1", "k2", (p - F.shiftright("place", 8).bitwiseAND(255)).alias("start"), (p - F.col("place").bitwiseAND(255) + length).alias("stop"))
    mixed = session.written(spark, contexts.groupBy("h").agg(F.count("*").alias("n"), F.min("m").alias("least")).where("n > 1 and least = 1").select(F.col("h").alias("b"), "n"), "repeat-mixed")
    asked = session.written(spark, contexts.join(mixed, F.col("h") == F.col("b")).select("h", F.least("m", F.lit(2)).cast("int").alias("m"), "n", "one.*"), "repeat-asked")

    def wanted(which: str) -> DataFrame:
        lists = asked.where(which).groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "place", "m")).alias("asked"))
        return texts.join(lists, ["k1", "k2"]).select("k1", "k2", "body", "asked")

    if crowd := [tuple(r) for r in hot.collect()]:
        whole = whole.unionAll(_crowded(texts, crowd, length))
    found = whole.unionAll(_refined(wanted(f"n <= {MANY}"), length)).unionAll(_split(wanted(f"n > {MANY}"), texts, length))
    spans = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return texts, session.written(spark, spans, "repeat-spans")


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return out


def without(text: bytes, spans: list[list[int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _result(texts: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """k1, k2, n_bytes, n_removed, n_spans, kept_sha256, cut: one row per different text."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor().decompress
        kinds = (*[pa.int64()] * 5, pa.string(), pa.list_(pa.list_(pa.int64())))
        for k1, k2, bodies, sizes, twice, lists in rows(batches, 128):
            got = [[] for _ in kinds]
            for a, b, body, n, t, found in zip(k1, k2, bodies, sizes, twice, lists):
                gone = ([[0, n]] if n >= length else []) if t else merged([(x["start"], x["stop"]) for x in found or []])
                kept = without(unpress(body), gone)
                for c, v in zip(got, (a, b, n, n - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), gone)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(got, kinds)], ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "cut"])
    return texts.join(spans, ["k1", "k2"], "left").select("k1", "k2", "body", "n_bytes", "twice", "spans").mapInArrow(
        cut, "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, cut array<array<long>>")


def repeated_spans(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, cut ([start, stop] of each removed run): one row per row of ``docs``.

    Texts are taken as UTF-8 bytes, null as empty. A byte goes if a string of ``length`` bytes over it starts anywhere else as well,
    judged on the input. Repeated rows repeat one another's windows. Other columns are ignored.
    """
    texts, spans = repeats(docs, length, text_col)
    result = session.written(docs.sparkSession, _result(texts, spans, length), "repeat-result")
    return docs.select(id_of(id_col).alias("doc_id"), *_key(text_of(text_col))).join(result, ["k1", "k2"]).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "cut")


def drop_repeats(docs: DataFrame, length: int = 200, text_col: str = "text") -> DataFrame:
    """row (the columns of ``docs`` as they are) and text without its repeated spans, drawn in to whole characters."""
    texts, spans = repeats(docs, length, text_col)
    result = session.written(docs.sparkSession, _result(texts, spans, length).where("n_removed > 0").select("k1", "k2", "cut"), "repeat-cuts")

    @F.arrow_udf("string")
    def shorter(text: pa.Array, cuts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(text), 64):
            for t, spans_ in zip(text.slice(at, 64).to_pylist(), cuts.slice(at, 64).to_pylist()):
                inner = []
                for start, stop in spans_ or []:
                    while start < stop and t[start] & 0xC0 == 0x80:
                        start += 1
                    while stop > start and stop < len(t) and t[stop] & 0xC0 == 0x80:
                        stop -= 1
                    inner.append([start, stop])
                out.append(None if t is None else without(t, inner).decode())
        return pa.array(out, pa.string())

    d = docs.select(F.struct("*").alias("row"), *_key(text_of(text_col)))
    j = d.join(result.hint("merge"), ["k1", "k2"], "left")
    return j.select("row", shorter(F.col("row")[text_col].cast("string").cast("binary"), "cut").alias("text"))


@query("op7_suffix_dedup")
def op7_suffix_dedup(spark, base):
    return repeated_spans(table(spark, base, "documents")).drop("cut")
