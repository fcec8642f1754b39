"""Document fingerprints by consistent weighted sampling.

For every sample and every term a gamma variate r, a gamma variate c and a uniform b are drawn from the term's
hash alone. A term of weight w stands at level t = floor(ln w / r + b) with value ln c - r (t + 1 - b); the
term of least value and its level are the sample. Two texts share a sample with the probability that is their
generalised Jaccard similarity: the sum over terms of the lesser weight over the sum of the greater.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import LOWER, id_of, out_batch, query, resident, rows, shuffle_partitions, table, text_of

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
COLUMNS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
           "near_next double")


def _gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2, at the middles of n equal shares: 1 - (1 + x) exp(-x) = p."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        less = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return (low + high) / 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sampler:
    """``samples`` consistent weighted samples of term counts, each a 16-bit hash of term and level; 0 is no term."""

    def __init__(self, samples: int = 96, most: int = 32_000):
        q = _gamma_quantiles()
        self.gamma, self.log_gamma = q.astype(np.float32), np.log(q).astype(np.float32)
        self.samples, self.most = samples, most
        self.odd = _mixed(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        self.at: dict[bytes, int] = {}
        self.hash = np.zeros(most, np.uint32)
        self.r, self.c, self.b = (np.zeros((most, samples), np.float32) for _ in range(3))

    def _rows(self, terms: list[bytes]) -> np.ndarray:
        """Rows of the terms' variates; at most ``most`` terms are kept, drawing them again changes nothing."""
        fresh = [t for t in terms if t not in self.at]
        if len(self.at) + len(fresh) > self.most:
            self.at, fresh = {}, terms
        if fresh:
            lo, hi = len(self.at), len(self.at) + len(fresh)
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, fresh), np.uint64, len(fresh))
            x = h[:, None] * self.odd
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(29)
            part = x.view(np.uint16).reshape(*x.shape, 4)
            self.hash[lo:hi] = (h >> np.uint64(32)).astype(np.uint32)
            self.r[lo:hi] = self.gamma.take(part[..., 0])
            self.c[lo:hi] = self.log_gamma.take(part[..., 1])
            self.b[lo:hi] = (part[..., 2] + np.float32(0.5)) / np.float32(1 << 16)
            self.at.update(zip(fresh, range(lo, hi)))
        return np.fromiter(map(self.at.__getitem__, terms), np.int64, len(terms))

    def of(self, counts: dict[bytes, float]) -> np.ndarray:
        if not counts:
            return np.zeros(self.samples, np.uint16)
        terms, weights = list(counts), np.log(np.fromiter(counts.values(), np.float32, len(counts)))
        least, best = np.full(self.samples, np.inf, np.float32), np.zeros(self.samples, np.uint64)
        for lo in range(0, len(terms), 2048):
            at = self._rows(terms[lo:lo + 2048])
            r, b = self.r[at], self.b[at]
            t = weights[lo:lo + 2048, None] / r
            t += b
            np.floor(t, out=t)
            value = t - b
            value += 1
            value *= r
            np.subtract(self.c[at], value, out=value)
            k = value.argmin(0)
            cols = np.arange(self.samples)
            v = value[k, cols]
            level = t[k, cols].astype(np.int64).astype(np.uint64)
            sample = _mixed((self.hash[at[k]].astype(np.uint64) << np.uint64(32)) ^ (level & np.uint64(0xFFFFFFFF)))
            less = v < least
            least, best = np.where(less, v, least), np.where(less, sample, best)
        return (best % np.uint64(65535) + np.uint64(1)).astype(np.uint16)


def _sampler(samples: int) -> Sampler:
    """One for all tasks of a worker process."""
    return resident(("sampler", samples), lambda: Sampler(samples))


def terms(text: str) -> Counter:
    """Counts of the words between white space, A-Z lower-cased; a text of white space alone is one term."""
    data = text.encode()
    return Counter(data.translate(LOWER).split() or ([data] if data else []))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def digits(f: np.ndarray) -> str:
    return f.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last half of the code points gives way to the first as many, or all, of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, samples: int = 96, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint: ``samples`` 16-bit samples in hexadecimal. A null text is empty: all zeros."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _sampler(samples)
        for ids, texts in rows(batches, 64):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                                              pa.array([digits(s.of(terms(t))) for t in texts], pa.string())], ["doc_id", "n_chars", "fingerprint"])
    return docs.select(id_of(id_col), text_of(text_col)).mapInArrow(made, "doc_id long, n_chars long, fingerprint string")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_partition: int = 4) -> DataFrame:
    """doc_id, text, bucket, guest: rows dealt by identifier, each bucket joined by its successor's first rows as guests.

    Sorted by (bucket, guest, id descending, text hash) inside a partition, every row that is no guest is
    followed by the next document; the first bucket's head follows the last bucket. Cuts come from a sketch of
    the identifiers, ``per_partition`` for each shuffle partition, and are all that the driver sees.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    d = docs.select(id_of(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    some = n * per_partition
    cuts = sorted(set(d.approxQuantile("doc_id", [k / some for k in range(1, some)], 1 / (4 * some)) or []))
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
    above = F.size(F.filter(bounds, lambda c: c < F.col("doc_id")))
    # Descending: the bucket of the greatest identifiers is 0, null identifiers come last.
    d = d.withColumn("bucket", F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(len(cuts) - above))
    heads = sorted((r.bucket, r.head) for r in d.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect())  # a row a cut
    to = [(b, head, heads[k - 1][0]) for k, (b, head) in enumerate(heads)]
    heads = spark.createDataFrame(to, "b int, head long, before int")
    homes = F.array(F.struct("bucket", F.lit(False).alias("guest")))
    also = F.array(F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guest")))
    return (d.join(F.broadcast(heads), F.col("bucket") == F.col("b"))
            .withColumn("home", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.concat(homes, also)).otherwise(homes)))
            .select("doc_id", "text", "home.*").repartition(n, "bucket")
            .sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text")))


def edited_fingerprints(docs: DataFrame, samples: int = 96, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its fingerprint and that of its text with the last half overwritten by the next document's start.

    The next document is that of the next smaller identifier; after the last comes the first, a single row
    follows itself. Rows that share an identifier follow one another by a hash of their texts, null
    identifiers come last. A null text is empty; empty texts are alike. Other columns are ignored.
    """
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _sampler(samples)
        last = None  # bucket, id, text and fingerprint of the row before, while it waits for its next one
        for ids, texts, buckets, guests in rows(batches, 64):
            got = [[] for _ in SCHEMA]
            for doc, text, bucket, guest in zip(ids, texts, buckets, guests):
                f = s.of(terms(text))
                if last and last[0] == bucket:
                    e = edited(last[2], text)
                    g = s.of(terms(e))
                    for c, v in zip(got, (last[1], len(last[2]), hashlib.sha256(e.encode()).hexdigest(), digits(last[3]), digits(g),
                                          likeness(last[3], g), likeness(last[3], f))):
                        c.append(v)
                last = None if guest else (bucket, doc, text, f)
            yield out_batch(SCHEMA, got)

    return with_next(docs, id_col, text_col).mapInArrow(compared, COLUMNS)


@query("op2_fingerprint")
def op2_fingerprint(spark, base):
    return edited_fingerprints(table(spark, base, "documents"))
