"""Importance resampling towards a target distribution.

Words and pairs of words are hashed to buckets. What a bucket gains is the logarithm of its share in the target
texts over its share in all documents; a document's weight is the mean gain of its features, looked up in an array.
Gumbel noise from the identifier turns the weights into keys of a draw without replacement: the highest win.

The last winning key is found by weighted median of medians. Each chunk of rows names the median of what it has left;
the median of those, weighted by the chunks' sizes, has at least a quarter of all remaining rows on either side, so
that each round discards a guaranteed part until the exact key is reached. Only winners are sorted.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import session
from plumbline.llm.base import LOWER, id_of, query, resident, shuffle_partitions, table, text_of
from plumbline.llm.packing import slices

#: Lower-cased bytes of words (0-9, a-z, all beyond ASCII); 0 for what stands between words.
WORD_BYTES = np.array([b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b >= 0x80 else 0 for b in LOWER], np.uint8)
LONGEST = 2 ** 63 - 1


class PairSums:
    """Checksums (crc32) of a word, a space and another word from the two words' own checksums.

    A checksum is linear over bits: that of two strings is the first one's, moved on over as many zero bytes as the
    second has, and the second one's. ``moved[n]`` holds that move for n zero bytes, byte by byte of the checksum.
    """

    def __init__(self, longest: int = 255):
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = (step >> np.uint32(1)) ^ np.where(step & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
        self.moved = np.empty((longest + 1, 4, 256), np.uint32)
        for k in range(4):
            self.moved[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for n in range(1, longest + 1):
            last = self.moved[n - 1]
            self.moved[n] = (last >> np.uint32(8)) ^ step[last & np.uint32(255)]

    def __call__(self, first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
        """``first``: checksums of words with a space; ``second``, ``length``: checksums and sizes of the words after them."""
        n = np.minimum(length, len(self.moved) - 1)
        out = second.copy()
        for k in range(4):
            out ^= self.moved[n, k, first >> np.uint32(8 * k) & np.uint32(255)]
        return out


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, bucket of each word with the next one of its text (-1: none), and the texts' ends in words."""
    offsets = np.frombuffer(texts.buffers()[1], "<i4", len(texts) + 1, 4 * texts.offset).astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    raw = np.frombuffer(texts.buffers()[2], np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)
    data = WORD_BYTES[raw]
    cut = np.zeros(size + 1, bool)  # a text begins here
    cut[offsets - offsets[0]] = True
    word = data != 0
    begins = word.copy()
    begins[1:] &= ~word[:-1] | cut[1:-1]
    starts = np.flatnonzero(begins)
    bytes_before = np.concatenate([[0], np.cumsum(word)])
    at = np.append(bytes_before[starts], bytes_before[-1])
    ends = np.searchsorted(starts, offsets[1:] - offsets[0])  # words up to each text's end
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), ends
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype("<i8").tobytes()), pa.py_buffer(data[word].tobytes())])
    coded = words.dictionary_encode()
    distinct, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    own = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))
    spaced = np.fromiter((zlib.crc32(b" ", int(c)) for c in own), np.uint32, len(distinct))
    length = np.fromiter(map(len, distinct), np.int64, len(distinct))
    join = resident("pair sums", PairSums)
    a, b = index[:-1], index[1:]
    pairs = join(spaced[a], own[b], length[b])
    for i in np.flatnonzero(length[b] >= len(join.moved)).tolist():
        pairs[i] = zlib.crc32(distinct[b[i]], int(spaced[a[i]]))
    second = np.append(pairs.astype(np.int64) % buckets, -1)
    second[ends[ends > 0] - 1] = -1
    return own[index].astype(np.int64) % buckets, second, ends


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket of the column ``text``. A task counts in an array; one number a bucket reaches the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for part in slices(batches):
            one, two, _ = features(part.column(1), buckets)
            n += np.bincount(one, minlength=buckets) + np.bincount(two[two >= 0], minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(F.lit(0), "text").mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """floor(1000 ln of a bucket's smoothed share in the target over that in all documents)."""
    t, s, k = target.tolist(), all_.tolist(), len(target)
    total_t, total_s = sum(t) + k, sum(s) + k
    return np.array([math.floor(1000 * math.log((x + 1) * total_s / ((y + 1) * total_t))) for x, y in zip(t, s)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """floor(1000 times a Gumbel variate) of seed and identifier; a null identifier is an empty one."""
    name = "" if doc_id is None else doc_id
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(docs: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    buckets = len(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            one, two, ends = features(part.column(1), buckets)
            per_word = gain[one] + np.where(two < 0, 0, gain[two])
            n_words = np.diff(ends, prepend=0)
            total = np.diff(np.concatenate([[0], np.cumsum(per_word)])[ends], prepend=0)
            n = n_words + np.maximum(n_words - 1, 0)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            drawn = weight + np.array([noise(d, seed) for d in part.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in (n_words, n, weight, drawn))],
                                             names=["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


def _less(keys: Sequence[np.ndarray], than: Sequence[int]) -> np.ndarray:
    out = np.zeros(len(keys[0]), bool)
    for k, v in zip(reversed(keys), reversed(than)):
        out = (k < v) | ((k == v) & out)
    return out


def _below(cols: Sequence[str], than: Sequence[int], strict: bool = True) -> Column:
    out = F.lit(not strict)
    for c, v in zip(reversed(cols), reversed(than)):
        out = (F.col(c) < v) | ((F.col(c) == v) & out)
    return out


def smallest_keys_end(rows: DataFrame, cols: Sequence[str], k: int, chunk: int = 1 << 20) -> tuple[int, ...]:
    """The ``k``-th smallest of the rows' keys, which are whole numbers in ``cols``, different from row to row.

    A round reads the rows still between the bounds, chunk by chunk, and sends the sizes and medians of each chunk's
    rows on both sides of the pivot: a few numbers for every ``chunk`` rows or task. What is left is written anew when
    it has come down to an eighth, so that all rounds together read little more than the first few.
    """
    cols, spark = list(cols), rows.sparkSession
    rows = rows.select(*cols)
    kind = "side int, n long, " + ", ".join(f"{c} long" for c in cols)

    def medians(pivot):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0

            def close():
                nonlocal held, n
                keys = [np.concatenate([h[i] for h in held]) for i in range(len(cols))]
                held, n = [], 0
                low = _less(keys, pivot) if pivot else np.zeros(len(keys[0]), bool)
                high = ~low & ~np.logical_and.reduce([k == p for k, p in zip(keys, pivot)]) if pivot else ~low
                out = []
                for side, mask in ((-1, low), (1, high)):
                    part = [k[mask] for k in keys]
                    if len(part[0]):
                        mid = np.lexsort(part[::-1])[(len(part[0]) - 1) // 2]
                        out.append([side, len(part[0]), *(int(p[mid]) for p in part)])
                names = ["side", "n", *cols]
                return pa.RecordBatch.from_pydict({c: pa.array([o[i] for o in out], pa.int32() if not i else pa.int64()) for i, c in enumerate(names)})

            for batch in batches:
                for at in range(0, batch.num_rows, chunk):
                    part = batch.slice(at, chunk)
                    held.append([c.to_numpy() for c in part.columns])
                    n += part.num_rows
                    if n >= chunk:
                        yield close()
            if held:
                yield close()
        return run

    low, high, pivot, left, size = None, None, None, k, None
    while True:
        inside = F.lit(True)
        if low:
            inside = inside & ~_below(cols, low, strict=False)
        if high:
            inside = inside & _below(cols, high)
        got = rows.where(inside).mapInArrow(medians(pivot), kind).collect()
        under = sum(r.n for r in got if r.side < 0)
        over = sum(r.n for r in got if r.side > 0)
        if size is None:
            size = over
        if pivot:
            if left == under + 1:
                return pivot
            if left <= under:
                high, side = pivot, -1
            else:
                low, side, left = pivot, 1, left - under - 1
        else:
            side = 1
        got, remain = sorted((tuple(r[2:]), r.n) for r in got if r.side == side), under if side < 0 else over
        if 8 * remain <= size:
            inside = F.lit(True)
            for bound, cond in ((low, lambda b: ~_below(cols, b, strict=False)), (high, lambda b: _below(cols, b))):
                inside = inside & cond(bound) if bound else inside
            rows, size = session.written(spark, rows.where(inside), "cutoff"), remain
        seen = 0
        for key, n in got:
            seen += n
            if 2 * seen >= remain:
                pivot = key
                break


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, buckets: int = 10_000, min_words: int = 20,
             id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", chunk: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: one row per row of ``docs``.

    Words are runs of 0-9, a-z and all beyond ASCII in texts whose A-Z are lower-cased; a null text has none and weighs
    0. Of the rows with at least ``min_words`` words the floor of ``percent`` in a hundred with the highest scores are drawn and
    ranked from 1, ties to the smaller identifier, then to more features; rows equal in all of these are drawn in any
    order, which shows in no other column. A null identifier comes after the others. No row is left out; with no rows, or
    none that is long enough, nothing is drawn. Other columns are ignored. The two texts' bucket counts are all that
    grows with ``buckets`` on the driver.
    """
    spark = docs.sparkSession
    texts = docs.select(id_of(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    gain = gains(bucket_counts(target.select(text_of(target_col).alias("text")), buckets), bucket_counts(texts, buckets))
    rows = _scored(texts, gain, seed).withColumns({
        "k0": -F.col("score"), "k1": F.coalesce("doc_id", F.lit(LONGEST)), "k2": -F.col("n_features"), "k3": F.monotonically_increasing_id()})
    rows = session.written(spark, rows, "scored")
    keys, out = ["k0", "k1", "k2", "k3"], ["doc_id", "n_words", "n_features", "weight", "score"]
    long_enough = F.col("n_words") >= min_words
    draw = percent * rows.where(long_enough).count() // 100
    if not draw:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    end = smallest_keys_end(rows.where(long_enough), keys, draw, chunk)
    wins = long_enough & _below(keys, end, strict=False)
    order = [*keys]
    won = (rows.where(wins).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
           .select(*out, F.monotonically_increasing_id().alias("at")))
    won = session.written(spark, won, "winners").select("*", F.shiftright("at", 33).alias("part"))
    before, starts = 0, []
    for r in sorted(won.groupBy("part").count().collect()):  # one row a partition
        starts.append((r.part, before))
        before += r["count"]
    won = won.join(F.broadcast(spark.createDataFrame(starts, "part long, before long")), "part")
    won = won.select(*out, (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).alias("rank"))
    return won.unionAll(rows.where(~wins).select(*out, F.lit(None).cast("long").alias("rank")))


@query("op11_resampling")
def op11_resampling(spark, base):
    return resample(table(spark, base, "documents"), table(spark, base, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")
