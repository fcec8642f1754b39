"""Best-fit packing in as few sequences as possible, by partitions first and then up a tree.

A document is cut only where it is longer than a sequence. Each task packs what it scans: blocks of pieces from long to
short, each to the fullest sequence with room for it. Sequences that are full, or nearly, are done. Of the underfull ones
a task hands on the emptiest as items for the next round, in which a group of tasks' sequences is packed best-fit
again, up to one group.

How many are handed on follows from best fit: at most one sequence of a packing is half full or less (else the later
one's pieces would have fitted into the earlier one), and two that are more than half full never fit together. So each
of the groups that meet brings at most one item that can move, and whatever has room for it has no more room than the
emptiest sequences have. With as many of these as there are items to come on the way to the root nothing is lost, and
no task of the tree holds more than that bound, however many rows there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import session
from plumbline.llm.base import id_of, query, resident, table, text_of
from plumbline.llm.packing import ChunkIds, slices, tokenizer_path

#: Tasks whose sequences meet in one group, and rounds of that at most: more tasks than any job has.
FAN, ROUNDS = 16, 8
NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "leaf", "open"]
COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, leaf long, open boolean"


class BestFit:
    """Sequences by the room they have. An item goes to the one with the least room that is enough, else to a new one."""

    def __init__(self, capacity: int):
        self.capacity, self.mask = capacity, 0
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, sequence: int, used: int) -> None:
        room = self.capacity - used
        self.by_room[room].append(sequence)
        self.mask |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        """Sequence and used tokens of the best fit, which leaves the set."""
        fits = self.mask >> size
        if not fits:
            return None
        room = size + (fits & -fits).bit_length() - 1
        sequence = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask ^= 1 << room
        return sequence, self.capacity - room

    def emptiest(self, most: int, below: int) -> list[tuple[int, int]]:
        """Up to ``most`` (sequence, used) with fewer than ``below`` tokens, from the emptiest."""
        out: list[tuple[int, int]] = []
        for room in range(self.capacity, self.capacity - below, -1):
            out += [(s, self.capacity - room) for s in self.by_room[room][:most - len(out)]]
            if len(out) == most:
                break
        return out


def place(lengths: Sequence[int], bins: BestFit, new: Iterator[int]) -> tuple[list[int], list[int]]:
    """Sequence and offset of each item, longest first."""
    where, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        where[i], offset[i] = bins.take(lengths[i]) or (next(new), 0)
        bins.add(where[i], offset[i] + lengths[i])
    return where, offset


def _scan(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, full: int, block: int) -> DataFrame:
    """Pieces in sequences of their task; ``open`` marks those whose sequence is handed on."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = resident(("chunks", tokenizer), lambda: ChunkIds(tokenizer)).batch, np.array([end_id], "<u4")
        leaf = TaskContext.get().partitionId()
        ids = iter(range(leaf << 33, (leaf + 1) << 33))
        carried: list[tuple[int, int]] = []
        held: dict[int, list[tuple]] = {}  # pieces of carried sequences
        waiting: list[tuple] = []

        def batch_of(rows: list[tuple], open_: bool) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int32()] + [pa.int64()] * 5
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds)), pa.array([leaf] * len(rows), pa.int64()),
                                               pa.array([open_] * len(rows), pa.bool_())], names=NAMES)

        def close() -> pa.RecordBatch:
            """Pack what waits; sequences that are not carried on to the next block are done."""
            nonlocal carried, waiting
            bins = BestFit(capacity)
            for sequence, used in carried:
                bins.add(sequence, used)
            where, offset = place([w[3] for w in waiting], bins, ids)
            carried = bins.emptiest(FAN * ROUNDS, full)
            keep = {s for s, _ in carried}
            done = [row for s, rows in held.items() if s not in keep for row in rows]
            for s in [s for s in held if s not in keep]:
                del held[s]
            for item, s, at in zip(waiting, where, offset):
                if s in keep:
                    held.setdefault(s, []).append((*item, s, at))
                else:
                    done.append((*item, s, at))
            waiting = []
            return batch_of(done, False)

        for batch in slices(batches):
            whole = []
            for doc, body in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                data = np.concatenate([body, end]).tobytes()
                n = len(data) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - start)
                    row = (doc, piece, start, size, zlib.crc32(data[4 * start:4 * (start + size)]))
                    if size == capacity:
                        whole.append((*row, next(ids), 0))
                    else:
                        waiting.append(row)
            if whole:
                yield batch_of(whole, False)
            if len(waiting) >= block:
                yield close()
        yield close()
        yield batch_of([row for rows in held.values() for row in rows], True)

    return docs.mapInArrow(packed, COLUMNS)


MEMBERS = "array<struct<sequence: long, shift: long>>"


def _round(nodes: DataFrame, capacity: int, full: int, most: int = FAN * ROUNDS) -> DataFrame:
    """One level of the tree: the sequences of ``FAN`` nodes are items of one. ``done`` marks those that are not handed on."""

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["used", "sequence"], ascending=[False, True], ignore_index=True)
        bins, names = BestFit(capacity), iter(pdf["sequence"].tolist())
        # a sequence that stays by itself keeps its name, one that moves takes the name of where it goes
        members: dict[int, list[dict]] = {}
        for used, own in zip(pdf["used"].tolist(), pdf["members"].tolist()):
            name = next(names)
            to, at = bins.take(used) or (name, 0)
            bins.add(to, at + used)
            members.setdefault(to, []).extend({"sequence": m["sequence"], "shift": m["shift"] + at} for m in own)
        on = {s for s, _ in bins.emptiest(most, full)}
        used = {s: capacity - room for room, ss in enumerate(bins.by_room) for s in ss}
        return pd.DataFrame({"node": key[0], "sequence": list(members), "used": [used[s] for s in members], "members": list(members.values()),
                             "done": [s not in on for s in members]})

    up = nodes.withColumn("node", F.floor(F.col("node") / FAN))
    return up.groupBy("node").applyInPandas(merge, f"node long, sequence long, used long, members {MEMBERS}, done boolean")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, nearly_full: float = 0.995, block: int = 1 << 17,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of a document in a sequence.

    A document's ids are those of the tokenizer file ``tokenizer`` and ``end_id``; a null or empty text has ``end_id``
    alone. Only documents of more than ``capacity`` ids are cut, into pieces of that size and a last one. A sequence of at
    least ``nearly_full`` of the capacity is not opened again after its block of ``block`` pieces. Rows may repeat or
    share identifiers: each is packed for itself. Equal lengths keep the order of the scan. With no rows there are no
    pieces. Sequence ids are unique in one result; other columns are ignored.
    """
    spark, full = docs.sparkSession, max(1, int(capacity * nearly_full))
    pieces = session.written(spark, _scan(docs.select(id_of(id_col), text_of(text_col)), tokenizer, capacity, end_id, full, block), "pieces")
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    open_ = pieces.where("open")
    nodes = open_.groupBy(F.col("leaf").alias("node"), F.col("sequence_id").alias("sequence")).agg(F.sum("length").alias("used"))
    nodes = nodes.withColumn("members", F.array(F.struct("sequence", F.lit(0).cast("long").alias("shift"))))
    most, done = open_.agg(F.max("leaf")).first()[0], None
    while most:
        level = session.written(spark, _round(nodes, capacity, full), "packing-round")
        done = level.where("done") if done is None else done.unionByName(level.where("done"))
        nodes, most = level.where("not done").drop("done"), most // FAN
    if done is None:
        return pieces.select(*out)
    settled = done.drop("done").unionByName(nodes)
    moves = settled.select(F.col("sequence").alias("to"), F.explode("members").alias("m")).select(F.col("m.sequence").alias("sequence_id"), "to", "m.shift")
    moved = open_.join(moves, "sequence_id").select(*out[:5], F.col("to").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"))
    return pieces.where("not open").select(*out).unionAll(moved)


@query("op13_best_fit")
def op13_best_fit(spark, base):
    return pack(table(spark, base, "documents"), tokenizer_path())
