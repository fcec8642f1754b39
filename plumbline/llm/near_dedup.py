"""Near duplicates by MinHash with odd sketches.

A document is its set of word shingles. Documents with the same set become one node. Bands of MinHash
samples put similar nodes into common buckets; an odd sketch, the parities of the samples hashed to a bitmap, tells
from the bits of two sketches' exclusive or how many samples differ, and so which pairs of a bucket are worth
a check of the full sets. A bucket's pairs are not listed: its best connected member is compared with the others,
then the best of those that are left, and only members that still stand in different components go on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline import session
from plumbline.llm.base import LOWER, id_of, query, resident, rows, table, text_of
from plumbline.llm.graph import components

SAMPLES, BITS = 152, 512
TILE, TILE_BYTES = 1024, 4 << 20  # members, and bytes of their texts, of one side of a tile
SIGNED = "doc_id long, mark long, n_shingles long, node binary, bands array<long>, sketch binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """64-bit hashes of words; at most ``most`` are kept."""

    most = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = h
        return h


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of fewer words, one of them all; of none, none.

    A-Z are lower-cased; words stand between spaces and the controls 9 to 13.
    """
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(resident("shingle words", WordHash).__getitem__, words), np.uint64, len(words))
    n = min(k, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        s = (s ^ h[j:j + len(s)]) * np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(29)
    return np.unique(_mixed(s))


def bands_of(threshold: float) -> tuple[int, int]:
    """Bands and rows: the longest bands that miss a pair at the threshold less than once in ten million times."""
    return max(((SAMPLES // r, r) for r in range(1, 9) if (1 - threshold ** r) ** (SAMPLES // r) < 1e-7), key=lambda x: x[1])


class Signer:
    def __init__(self, bands: int = 0, rows_: int = 0, samples: int = SAMPLES, bits: int = BITS):
        self.bands, self.rows, self.bits = bands, rows_, bits
        seeds = _mixed(np.arange(1, 2 * samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.odd = (seeds[:samples] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.odd2 = (seeds[samples:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.numbers = np.arange(samples, dtype=np.uint64) << np.uint64(32)

    def samples(self, s: np.ndarray) -> np.ndarray:
        least = np.full(len(self.odd), 0xFFFFFFFF, np.uint32)
        h = (s >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(h), 1024):
            x = self.odd[:, None] * h[at:at + 1024]
            x ^= x >> np.uint32(15)
            x *= self.odd2[:, None]
            np.minimum(least, x.min(1), out=least)
        return least

    def keys(self, m: np.ndarray) -> np.ndarray:
        """Band keys of samples."""
        keys = np.arange(1, self.bands + 1, dtype=np.uint64)
        for j in range(self.rows):
            keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) ^ m[j:self.bands * self.rows:self.rows])
        return keys.view(np.int64)

    def sketch(self, m: np.ndarray) -> bytes:
        """Odd sketch of samples: each flips the bit that its number and value hash to."""
        bit = (_mixed(self.numbers | m) >> np.uint64(40)) % np.uint64(self.bits)
        return np.packbits((np.bincount(bit.astype(np.int64), minlength=self.bits) & 1).astype(bool)).tobytes()


def sketch_similarity(differing_bits: np.ndarray, samples: int = SAMPLES, bits: int = BITS) -> np.ndarray:
    """Similarity that the number of differing bits of two odd sketches speaks for."""
    left = np.clip(1 - 2 * differing_bits / bits, 1e-9, 1)
    return 1 + bits / (4 * samples) * np.log(left)


def _docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``mark`` tells rows of one identifier apart by their texts."""
    return docs.select(id_of(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("mark"), text_of(text_col).cast("binary").alias("text"))


def _signed(docs: DataFrame, k: int, bands: int, rows_: int) -> DataFrame:
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows_)
        for ids, marks, texts in rows(batches):
            n, nodes, keys, sketches = [], [], [], []
            for text in texts:
                s = shingles(text, k)
                m = signer.samples(s) if len(s) else None
                n.append(len(s))
                nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(signer.keys(m) if len(s) else None)
                sketches.append(signer.sketch(m) if len(s) else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()),
                                              pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                                             ["doc_id", "mark", "n_shingles", "node", "bands", "sketch"])
    return docs.mapInArrow(signed, SIGNED)


def _confirmed(pairs: DataFrame, texts: DataFrame, sketches: DataFrame, k: int, percent: int, margin: float) -> DataFrame:
    """The pairs (a, b) whose full sets have ``percent`` of their union in common; sketches rule out those far from it."""
    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, set_ = None, None
        for a, b, ta, tb in rows(batches, 64):
            out = []
            for node, text, other in zip(a, ta, tb):
                if node != last:
                    last, set_ = node, shingles(text, k)
                s = shingles(other, k)
                common = len(np.intersect1d(set_, s, assume_unique=True))
                out.append(100 * common >= percent * (len(set_) + len(s) - common))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in ([v for v, o in zip(a, out) if o], [v for v, o in zip(b, out) if o])], ["a", "b"])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (2, 3))
                ok = sketch_similarity(np.bitwise_count(x ^ y).sum(1)) >= percent / 100 - margin
                yield batch.select([0, 1]).filter(pa.array(ok))

    sa, sb = (sketches.select(F.col("node").alias(c), F.col("sketch").alias(f"s{c}")) for c in "ab")
    near = session.written(pairs.sparkSession, pairs.join(sb, "b").join(sa, "a").select("a", "b", "sa", "sb").mapInArrow(likely, "a binary, b binary"), "near-likely")
    ta, tb = (texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    return near.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInArrow(checked, "a binary, b binary")


def _tiled(active: DataFrame, k: int, percent: int, margin: float) -> DataFrame:
    """Links (a, b) between members of one bucket and different components, tile by tile.

    A tile compares two bounded blocks of a bucket: sketches first, then all full sets that some sketch speaks for
    at once, as a product of their membership matrices. Only links leave the task.
    """
    size = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum(F.length("text")) / TILE_BYTES)).cast("int")
    sizes = session.written(active.sparkSession, active.groupBy("key").agg(size.alias("blocks")), "near-sizes")
    tiles = (active.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label", "sketch", "text")
             .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "block"))

    def linked(tile, held) -> list[tuple[bytes, bytes]]:
        if len(held) < 2:
            return []
        bits = np.array([np.frombuffer(h[3], np.uint64) for h in held])
        names: dict[bytes, int] = {}
        label = np.array([names.setdefault(h[2], len(names)) for h in held])
        block = np.array([h[0] for h in held])
        ok = np.zeros((len(held), len(held)), bool)
        for x in range(len(held) - 1):
            ok[x, x + 1:] = (label[x + 1:] != label[x]) & (sketch_similarity(np.bitwise_count(bits[x + 1:] ^ bits[x]).sum(1)) >= percent / 100 - margin)
        if tile[1] != tile[2]:
            ok &= block[:, None] != block
        some = np.flatnonzero(ok.any(0) | ok.any(1))
        if not len(some):
            return []
        sets = [shingles(held[i][4], k) for i in some]
        sizes = np.array([len(x) for x in sets])
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row, shared = np.repeat(np.arange(len(some)), sizes), (np.cumsum(count > 1) - 1)[column]
        common = np.zeros((len(some), len(some)), np.float32)
        twice = count[column] > 1
        row, shared = row[twice], shared[twice]
        for at in range(0, int(shared.max(initial=-1)) + 1, 2048):
            here = (shared >= at) & (shared < at + 2048)
            m = np.zeros((len(some), 2048), np.float32)
            m[row[here], shared[here] - at] = 1
            common += m @ m.T
        common = common.astype(np.int64)  # 100 times a count may be more than a float holds exactly
        link = ok[np.ix_(some, some)] & (100 * common >= percent * (sizes[:, None] + sizes - common))
        return [(held[some[x]][1], held[some[y]][1]) for x, y in zip(*np.nonzero(link))]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []
        for columns in rows(batches):
            found = []
            for t in zip(*columns):
                if t[:3] != tile:
                    found += linked(tile, held)
                    tile, held = t[:3], []
                held.append(t[3:])
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.binary()) for c in (0, 1)], ["a", "b"])
        found = linked(tile, held)
        yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.binary()) for c in (0, 1)], ["a", "b"])

    return tiles.mapInArrow(compared, "a binary, b binary").distinct()


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, rounds: int = 1, margin: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark, n_shingles, component_id, label, kept: one row per row of ``docs``.

    Two documents are linked when their sets of k-word shingles have at least ``percent`` of their union in common;
    ``component_id`` is the least identifier that links reach. ``kept`` says doc_id = component_id. ``label``
    names the component; a text without words has none and stands alone. Null texts count as empty. A null
    identifier is never a ``component_id`` unless alone or among nulls. Rows may repeat: equal texts share a node.
    A pair at the threshold is missed with a probability under 1e-7 (bands) plus that of a sketch more than
    ``margin`` too low, over six standard deviations.
    """
    spark = docs.sparkSession
    d = _docs(docs, id_col, text_col)
    signed = session.written(spark, _signed(d, k, *bands_of(percent / 100)), "near-signed")
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    nodes = session.written(spark, signed.where("node is not null").groupBy("node").agg(
        F.min(one).alias("row"), F.min_by(F.struct("bands", "sketch"), one).alias("of")).select("node", "row", "of.*"), "near-nodes")
    spread = nodes.select("node", F.explode("bands").alias("key"))
    shared = session.written(spark, spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-buckets")
    members = session.written(spark, spread.join(shared, "key"), "near-members")
    fame = session.written(spark, members.groupBy("node").agg(F.sum("n").alias("fame")), "near-fame")
    # Texts of the nodes that share a bucket with another.
    wanted = nodes.join(fame, "node").select("node", F.col("row.doc_id").alias("id"), F.col("row.mark").alias("m"))
    texts = session.written(spark, d.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m"))).groupBy("node").agg(
        F.min("text").alias("text")), "near-texts")
    active = session.written(spark, members.select("key", "node").join(fame, "node"), "near-active")
    links, labels = None, None
    for turn in range(rounds + 1):
        if labels is not None:
            named = labels.withColumnRenamed("node", "x")
            active = active.join(named, F.col("node") == F.col("x"), "left").withColumn("label", F.coalesce(F.col("label"), F.col("node"))).drop("x")
            open_ = active.groupBy("key").agg((F.min("label") != F.max("label")).alias("open")).where("open").select("key")
            active = session.written(spark, active.join(session.written(spark, open_, "near-open"), "key"), "near-active")
            if active.isEmpty():
                break
        if turn < rounds:
            first = session.written(spark, active.groupBy("key").agg(F.max(F.struct("fame", "node")).alias("top")).select("key", F.col("top.node").alias("leader")), "near-leaders")
            led = active.join(first, "key").where("node <> leader")
            pairs = (led if labels is None else led.join(labels.select(F.col("node").alias("leader"), F.col("label").alias("of")), "leader", "left").where(
                F.coalesce("of", "leader") != F.col("label"))).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
            active = led.select("key", "node", "fame")
            found = _confirmed(session.written(spark, pairs, "near-pairs"), texts, nodes, k, percent, margin)
        else:
            if labels is None:
                active = active.withColumn("label", F.col("node"))
            found = _tiled(active.join(nodes.select("node", "sketch"), "node").join(texts, "node"), k, percent, margin)
        found = session.written(spark, found, "near-links")
        links = found if links is None else links.unionAll(found)
        labels = components(links)
    whole = nodes.select("node", "row").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = whole.groupBy("label").agg(F.min("row.doc_id").alias("component"))
    named = session.written(spark, whole.select("node", "label").join(session.written(spark, least, "near-least"), "label"), "near-named")
    return (signed.select("doc_id", "mark", "n_shingles", "node").join(named, "node", "left")
            .withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")))
            .select("doc_id", "mark", "n_shingles", "component_id", "label", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, columns as they are, without all but one row of each group of near duplicates.

    The row with the least identifier stays (null ones last, then by a hash of the text); of repeated rows one
    stays. Texts without words all stay.
    """
    groups = session.written(docs.sparkSession, near_groups(docs, k, percent, id_col=id_col, text_col=text_col), "near-groups")
    best = groups.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("row"))
    stay = best.select(F.col("row.doc_id").alias("id"), F.col("row.mark").alias("m"))
    d = docs.select(F.struct("*").alias("row"), id_of(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("mark"),
                    (F.length(F.regexp_replace(text_of(text_col), "[ \\t-\\r]", "")) == 0).alias("blank"))
    chosen = (d.where("not blank").join(stay.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m")))
              .groupBy("doc_id", "mark").agg(F.first("row").alias("row")).select("row.*"))
    return chosen.unionAll(d.where("blank").select("row.*"))


@query("op3_near_dedup")
def op3_near_dedup(spark, base):
    return near_groups(table(spark, base, "documents"), k=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")
