"""Cost-balanced packing of token ids into training sequences.

The cost of a piece of n tokens inside a sequence is linear * n + quadratic * n^2 (projections, attention).
Documents fill whole sequences as far as they can; what is left over is gathered in blocks of bounded size,
sorted from long to short, and each piece goes to the cheapest sequence that has room for it. If none has, it
is cut and fills the cheapest one that has any room. A block's sequences hold just its tokens: those that
do not fill a last sequence form sequences of power-of-two length, which need no padding.
Each task packs the rows it scans, so no token crosses the network.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from plumbline.llm.base import id_of, out_batch, query, resident, table, text_of

SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_length", pa.int64())])
COLUMNS = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
           "sequence_length long")


#: Marks of ASCII but the apostrophe, which may take letters to its token.
MARKS = string.punctuation.replace("'", "")


class ChunkIds:
    """Ids, as little-endian 32-bit bytes, of a text between spaces and line ends.

    The tokenizer never joins tokens over white space, nor letters and marks, so chunks are looked up one by
    one. It lower-cases, so A-Z may be lower-cased before. New words of a text are encoded together and told apart
    by the tokens that end a word. At most ``most`` chunks are kept in each of two generations; that changes no id.
    """

    def __init__(self, path: str, most: int = 200_000):
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        self.encode, self.encode_fast, self.most, self.new, self.old = t.encode, t.encode_batch_fast, most, {}, {}
        self.ends = np.zeros(t.get_vocab_size(), bool)
        self.ends[[i for token, i in t.get_vocab().items() if token.endswith("</w>")]] = True

    def _one(self, chunk: str) -> bytes:
        return np.array(self.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _words(self, words: list[str]) -> None:
        """Take in chunks of letters alone."""
        ids = np.array(self.encode_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(words) and cuts[-1] == len(ids):
            data, at = ids.tobytes(), 0
            for word, cut in zip(words, (4 * cuts).tolist()):
                self.new[word] = data[at:cut]
                at = cut
        else:
            self.new.update((w, self._one(w)) for w in words)

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text. The texts' different chunks are looked up once."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # else a text might come to spell a special token
            texts = pc.ascii_lower(texts)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = pc.list_flatten(lists).dictionary_encode()
        chunks = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        self.new[""] = b""
        got = list(map(self.new.get, chunks))
        if None in got:
            lost = [i for i, g in enumerate(got) if g is None]
            self._learn({chunks[i] for i in lost})
            for i in lost:
                got[i] = self.new[chunks[i]]
        data, size = np.frombuffer(b"".join(got), "<u4"), np.fromiter(map(len, got), np.int64, len(got)) // 4
        at = words.indices.to_numpy()
        n = size[at]
        ends = np.cumsum(n)
        ids = data[np.repeat((np.cumsum(size) - size)[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
        return np.split(ids, cuts[:-1])

    def ids(self, text: str) -> bytes:
        return self.batch(pa.array([text], pa.string()))[0].tobytes()

    def _learn(self, chunks: set[str]) -> None:
        new, old, marked, words, rest = self.new, self.old, [], {}, set()
        for c in chunks:
            if c in old:
                new[c] = old[c]
            elif c.isalpha():
                words[c] = None
            elif (stem := c.rstrip(MARKS)).isalpha():  # one run of letters, one of marks
                marked.append((c, stem, c[len(stem):]))
            else:
                rest.add(c)
        words |= {stem: None for _, stem, _ in marked if stem not in new}
        rest.update(tail for _, _, tail in marked if tail not in new)
        for c in rest:
            new[c] = self._one(c)
        words = list(words)
        for at in range(0, len(words), 256):
            self._words(words[at:at + 256])
        for c, stem, tail in marked:
            new[c] = new[stem] + new[tail]


def slices(batches: Iterator[pa.RecordBatch], size: int = 1 << 20, most: int = 512) -> Iterator[pa.RecordBatch]:
    """Rows together as long as their texts (second column) have at most ``size`` bytes; a longer text comes alone."""
    for batch in batches:
        ends, first = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)), 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            stop = min(max(int(np.searchsorted(ends, before + size, side="right")), first + 1), first + most)
            yield batch.slice(first, stop - first)
            first = stop


def place(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1.0) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pieces (item, start, length, sequence, offset) and the sequences' lengths, for items of at most ``capacity`` tokens.

    The quadratic weight is per token of a full sequence: a piece as long as a sequence costs linear + quadratic a token.
    """
    total = sum(lengths)
    sizes = [capacity] * (total // capacity)
    rest = total % capacity
    sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    size = np.array(sizes, np.int64)
    free, cost = size.copy(), np.zeros(len(size))
    out = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at, left = 0, lengths[item]
        while left:
            fits = free >= left
            ok = fits if fits.any() else free > 0
            k = int(np.where(ok, cost, np.inf).argmin())
            n = min(left, int(free[k]))
            out.append((item, at, n, k, int(size[k] - free[k])))
            free[k] -= n
            cost[k] += linear * n + quadratic * n * n / capacity
            at, left = at + n, left - n
    return out, sizes


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, linear: float = 1.0, quadratic: float = 1.0,
         block: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document in a sequence of at most ``capacity`` tokens.

    A document's ids are those of the tokenizer file ``tokenizer`` and ``end_id``; a null or empty text has
    ``end_id`` alone. ``start`` counts the document's ids before the piece, ``offset`` the sequence's. Rows
    may repeat or share identifiers: each row is packed for itself. ``block`` is the number of sequences
    packed together. Sequence ids are unique within one result; other columns of ``docs`` are ignored.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = resident(("chunks", tokenizer), lambda: ChunkIds(tokenizer)).batch, np.array([end_id], "<u4")
        base, seq = TaskContext.get().partitionId() << 33, 0
        waiting, held = [], 0

        def close():
            nonlocal seq, waiting, held
            pieces, sizes = place([len(w[2]) // 4 for w in waiting], capacity, linear, quadratic)
            got = [[] for _ in SCHEMA]
            for item, at, n, k, offset in pieces:
                doc, start, ids, total = waiting[item]
                for c, v in zip(got, (doc, start + at, n, zlib.crc32(ids[4 * at:4 * (at + n)]), total, base + seq + k, offset, sizes[k])):
                    c.append(v)
            seq, waiting, held = seq + len(sizes), [], 0
            return out_batch(SCHEMA, got)

        for batch in slices(batches):
            full = [[] for _ in SCHEMA]
            for doc, body in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                ids = np.concatenate([body, end]).tobytes()
                total = len(ids) // 4
                whole = total - total % capacity
                for start in range(0, whole, capacity):
                    for c, v in zip(full, (doc, start, capacity, zlib.crc32(ids[4 * start:4 * (start + capacity)]), total, base + seq, 0, capacity)):
                        c.append(v)
                    seq += 1
                if total > whole:
                    waiting.append((doc, whole, ids[4 * whole:], total))
                    held += total - whole
                if held >= block * capacity:
                    yield close()
            if full[0]:
                yield out_batch(SCHEMA, full)
        if waiting:
            yield close()

    return docs.select(id_of(id_col), text_of(text_col)).mapInArrow(packed, COLUMNS)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op5_packing")
def op5_packing(spark, base):
    return pack(table(spark, base, "documents"), tokenizer_path())
