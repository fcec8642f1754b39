"""Unigram encoding: the best split of a text into scored pieces, found by Viterbi over a double-array trie.

Spaces become the marker U+2581 and a text gets one in front. No piece joins a marker to what stands before
it, nor holds a line end, so a text falls into chunks that are solved one by one and remembered; a chunk falls
apart between two characters that stand side by side in no piece. A character without a piece becomes its UTF-8 bytes' pieces, at the lowest score less a penalty.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import id_of, query, resident, rows, table, text_of

MARK = "▁"
INF = float("inf")
PENALTY = 10.0  # of a character without a piece, below the lowest score
MOST = 800_000  # chunks remembered in each of two generations
_CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_byte_tokens", pa.int64()), ("score", pa.float64()), ("round_trip", pa.bool_()),
                    ("ids", pa.list_(pa.int32()))])
COLUMNS = "doc_id long, n_tokens long, n_byte_tokens long, score double, round_trip boolean, ids array<int>"


#: Ids as 32-bit bytes, score, number of ids, number of byte pieces, whether the ids decode to the chunk.
Chunk = tuple[bytes, float, int, int]


class DoubleArray:
    """Trie of byte strings: from node s byte b leads to t = base[s] + b + 1 if check[t] is s."""

    def __init__(self, keys: dict[bytes, int]):
        self.base, self.check, self.value = [0], [0], [-1]
        order = sorted(keys)
        todo, free, wide = [(0, 0, len(order), 0)], 258, 258  # first place left for one child, for several
        used = bytearray(b"\1")

        def room(size):
            if size > len(used):
                extra = size - len(used) + 65_536
                used.extend(bytes(extra))
                self.base.extend([0] * extra)
                self.check.extend([-1] * extra)
                self.value.extend([-1] * extra)

        room(258)
        while todo:
            node, lo, hi, depth = todo.pop()
            if lo < hi and len(order[lo]) == depth:
                self.value[node] = keys[order[lo]]
                lo += 1
            groups = []
            while lo < hi:
                b, start = order[lo][depth], lo
                while lo < hi and order[lo][depth] == b:
                    lo += 1
                groups.append((b + 1, start, lo))
            if not groups:
                continue
            while free < len(used) and used[free]:
                free += 1
            first = at = (free if len(groups) == 1 else max(free, wide)) - groups[0][0]
            room(at + 258)
            while any(used[at + c] for c, _, _ in groups):
                at += 1
                room(at + 258)
            if at - first > 64:
                wide = at
            self.base[node] = at
            for c, start, end in groups:
                used[at + c] = 1
                self.check[at + c] = node
                todo.append((at + c, start, end, depth + 1))


class Pieces:
    """Pieces, scores and the trie of a model file."""

    def __init__(self, path: str):
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.load({m.id_to_piece(i): i for i in plain}, {i: m.get_score(i) for i in plain},
                  {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)})

    @classmethod
    def of(cls, ids: dict[str, int], scores: dict[int, float], byte_ids: dict[int, int]) -> Pieces:
        self = cls.__new__(cls)
        self.load(ids, scores, byte_ids)
        return self

    def load(self, ids: dict[str, int], scores: dict[int, float], byte_ids: dict[int, int]) -> None:
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in ids):
            raise ValueError("a piece joins a marker to what stands before it, or holds a line end")
        self.scores, self.byte_ids = scores, byte_ids
        self.lowest = min(scores.values(), default=0.0) - PENALTY
        self.trie = DoubleArray({p.encode(): i for p, i in ids.items()})
        self.bytes = {i: p.replace(MARK, " ").encode() for p, i in ids.items()} | {i: bytes([b]) for b, i in byte_ids.items()}
        self.is_byte = set(byte_ids.values())
        self.ahead = [b + 1 for b in self.trie.base]  # every base leaves room for all bytes after it
        self.gain = [scores[v] if v >= 0 else None for v in self.trie.value]
        self.pairs = {p[i:i + 2] for p in ids for i in range(len(p) - 1)}
        self.seen: dict[str, Chunk] = {}
        self.old: dict[str, Chunk] = {}

    def best(self, text: str) -> tuple[list[int], float]:
        """Ids and score of the best split; of equal ones that with the longest last piece, and so on forward."""
        data = text.encode()
        n = len(data)
        ahead, check, value, gain = self.ahead, self.trie.check, self.trie.value, self.gain
        top, start, piece = [-INF] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        top[0], at, lowest = 0.0, 0, self.lowest
        while at < n:
            lead = data[at]
            after = at + (1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4)
            node, end, alone, here = 0, at, False, top[at]
            for b in data[at:]:
                t = ahead[node] + b
                if check[t] != node:
                    break
                node = t
                end += 1
                score = gain[t]
                if score is not None:
                    if end == after:
                        alone = True
                    score += here
                    if score > top[end]:
                        top[end] = score
                        start[end] = at
                        piece[end] = value[t]
            if not alone and here + lowest > top[after]:
                top[after], start[after], piece[after] = here + lowest, at, -1
            at = after
        out, at = [], n
        while at:
            if piece[at] >= 0:
                out.append(piece[at])
            else:
                out += [self.byte_ids[b] for b in reversed(data[start[at]:at])]
            at = start[at]
        out.reverse()
        return out, top[n]

    def _solved(self, text: str) -> Chunk:
        ids, score = self.best(text)
        return array("i", ids).tobytes(), score, len(ids), 0 if self.is_byte.isdisjoint(ids) else sum(i in self.is_byte for i in ids)

    def _keep(self, text: str, got: Chunk) -> Chunk:
        """Remember a chunk; the last ``MOST`` and those of the generation before are kept."""
        if len(text) < 64:
            if len(self.seen) >= MOST:
                self.old, self.seen = self.seen, {}
            self.seen[text] = got
        return got

    def chunk(self, text: str) -> Chunk:
        """Solved between pairs of characters that no piece holds."""
        got = self.old.get(text)
        if got is None:
            pairs = self.pairs
            cuts = [i for i in range(1, len(text)) if text[i - 1:i + 1] not in pairs]
            if not cuts:
                got = self._solved(text)
            else:
                parts = [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)])]
                each = [self.seen.get(p) or self.old.get(p) or self._keep(p, self._solved(p)) for p in parts]
                ids, scores, n, n_bytes = zip(*each)
                got = b"".join(ids), sum(scores), sum(n), sum(n_bytes)
        return self._keep(text, got)

    def encode(self, text: str) -> list[Chunk]:
        if not text:
            return []
        spaced = (MARK + text.replace(" ", MARK)) if MARK not in text else None
        if spaced is not None:
            return [self.seen.get(c) or self.chunk(c) for c in _CHUNK.findall(spaced)]
        # A marker that the text itself holds is written in bytes, so that it does not read as a space.
        own = array("i", [self.byte_ids[b] for b in MARK.encode()]).tobytes(), self.lowest, 3, 3
        out: list[Chunk] = []
        for i, part in enumerate(text.split(MARK)):
            part = part.replace(" ", MARK)
            out += [own] if i else []
            out += [self.seen.get(c) or self.chunk(c) for c in _CHUNK.findall(part if i else MARK + part)]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: pieces and bytes joined, the marker in front taken off, the others spaces."""
        look = self.bytes
        return b"".join([look[i] for i in ids])[1:].decode("utf-8", "replace")


def pieces(path: str) -> Pieces:
    return resident(("pieces", path), lambda: Pieces(path))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: number of ids and of byte pieces, score of the split, whether decoding gives the text, the ids.

    A null or empty text has no ids, score 0 and decodes to itself. A marker that a text holds itself is written as its three bytes. ``round_trip``
    compares what the ids decode to with the whole text. Rows may repeat; other columns of ``docs`` are ignored.
    """
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for docs_, texts in rows(batches, 64):
            head, parts, ends = [[] for _ in range(5)], [], [0]
            for doc, text in zip(docs_, texts):
                raw, scores, n, n_bytes = zip(*p.encode(text)) if text else ((),) * 4
                ids = np.frombuffer(b"".join(raw), "<i4")
                for c, v in zip(head, (doc, sum(n), sum(n_bytes), float(sum(scores)), p.decode(ids.tolist()) == text)):
                    c.append(v)
                parts.append(ids)
                ends.append(ends[-1] + len(ids))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(head, SCHEMA)), ids], schema=SCHEMA)

    return docs.select(id_of(id_col), text_of(text_col)).mapInArrow(encoded, COLUMNS)


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``encoded`` with a column of the ids' texts. Null or no ids give an empty text; an unknown id fails the job."""
    @F.pandas_udf("string")
    def texts(ids):
        p = pieces(model)
        return ids.map(lambda x: "" if x is None else p.decode(x.tolist()))
    return encoded.withColumn(out_col, texts(F.col(ids_col)))


@query("op9_unigram")
def op9_unigram(spark, base):
    import public_tokenizers
    return encode(table(spark, base, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
