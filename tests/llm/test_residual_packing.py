import collections
import itertools
import random
import zlib

import numpy as np
from corpus import SCHEMA, documents
from tokenizers import Tokenizer

from plumbline.llm import residual_packing as rp
from plumbline.llm.packing import tokenizer_path

PATH = tokenizer_path()


def check(rows, docs, capacity):
    """Every id in one piece, gapless sequences within the capacity, cuts only where needed; how many sequences."""
    t = Tokenizer.from_file(PATH)
    seqs, by = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append(r)
        by[r.doc_id].append(r)
    for v in seqs.values():
        at = 0
        for r in sorted(v, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    for d, x, *_ in docs:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        cut = [ids[i:i + capacity] for i in range(0, len(ids), capacity)]
        got = sorted(by[d], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in got] == [
            (i, i * capacity, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for i, c in enumerate(cut)]
    return len(seqs)


def one_packing(lengths, capacity):
    """Best fit of everything at once, by plain search."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] + n <= capacity]
        if fits:
            max(fits)[0] += n
        else:
            bins.append([n])
    return len(bins)


def test_pack(spark):
    docs = documents(5) + [(99_999, "word " * 5000, None, None, 0)]
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as start", "2 as leaf", "true as open", "3 as sequence_id").repartition(40)
    for capacity, block in ((256, 1 << 17), (256, 2), (2048, 1 << 17)):
        rows = rp.pack(df, PATH, capacity, block=block).collect()
        n = check(rows, docs, capacity)
        best = one_packing([r.length for r in rows], capacity)
        assert -(-sum(r.length for r in rows) // capacity) <= n <= best + (3 if block > 2 else 12)


def test_ties_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None), (1, "")], "doc_id long, text string").repartition(4)
    rows = rp.pack(df, PATH).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 3), (0, 3), (1, 1), (1, 1)] and len({r.sequence_id for r in rows}) == 1
    assert sorted(r.offset for r in rows)[0] == 0 and max(r.offset + r.length for r in rows) == 8
    assert rp.pack(df.limit(0), PATH).count() == 0


def test_best_fit_against_plain_search():
    rng = random.Random(4)
    for _ in range(30):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(0, 200))]
        bins = rp.BestFit(64)
        where, offset = rp.place(lengths, bins, itertools.count())
        assert len(set(where)) == one_packing(lengths, 64)
        assert sum(1 for room, ss in enumerate(bins.by_room) for _ in ss if 64 - room <= 32) <= 1


def test_handing_on_the_emptiest_loses_nothing(spark):
    """As many sequences as when every one is handed on up to the root."""
    rng = random.Random(9)
    for low, high in ((1, 64), (20, 64), (33, 64)):
        count = []
        leaves = [[rng.randint(low, high - 1) for _ in range(rng.randint(1, 60))] for _ in range(60)]
        for most in (rp.FAN * rp.ROUNDS, 1 << 30):
            rows, names = [], itertools.count()
            for leaf, lengths in enumerate(leaves):
                bins = rp.BestFit(64)
                rp.place(lengths, bins, names)
                rows += [(leaf, s, u, [(s, 0)]) for s, u in bins.emptiest(most, 64)]
            nodes, done = spark.createDataFrame(rows, f"node long, sequence long, used long, members {rp.MEMBERS}"), []
            for _ in range(2):
                level = rp._round(nodes, 64, 64, most).collect()
                done += [r for r in level if r.done]
                nodes = spark.createDataFrame([r[:4] for r in level if not r.done], nodes.schema)
            level = done + [r for r in level if not r.done]
            moved = collections.Counter(m.sequence for r in level for m in r.members)
            assert sorted(moved) == sorted(r[1] for r in rows) and set(moved.values()) == {1}
            count.append(len(level))
        assert count[0] == count[1]
