import collections
import random
import zlib

import numpy as np
from corpus import SCHEMA, documents
from tokenizers import Tokenizer

from plumbline.llm import packing as pk

PATH = pk.tokenizer_path()


def test_ids_are_the_tokenizers():
    t, c = Tokenizer.from_file(PATH), pk.ChunkIds(PATH, 50)
    rng = random.Random(6)
    texts = ["", "a<|endoftext|>b", "<|STARTOFTEXT|> x", "É́x  y　z it's  'S don't 12a\t3", "ΑΣ Σ", "\x1ca b\x85c", ". . ' 't", "e ́f", "words, marks; (both)... ok!?",
             "İstanbul ﬁne ÅÅ", "tab\there", "a-b c.d e,f"]
    texts += ["".join(rng.choice("aAbZé ,.'1\n!ß\t日") for _ in range(80)) for _ in range(300)]
    for x in texts:
        assert np.frombuffer(c.ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_place_fills_sequences_evenly():
    rng = random.Random(1)
    lengths = [rng.randint(1, 64) for _ in range(400)]
    pieces, sizes = pk.place(lengths, 64)
    got = collections.Counter()
    for item, _, n, _, _ in pieces:
        got[item] += n
    assert got == dict(enumerate(lengths)) and sum(sizes) == sum(lengths)
    assert all(s == 64 or s & (s - 1) == 0 for s in sizes) and sizes.count(64) == sum(lengths) // 64
    cost = np.zeros(len(sizes))
    for _, _, n, k, _ in pieces:
        cost[k] += n + n * n / 64
    full = cost[np.array(sizes) == 64]
    arrival = np.array([n + n * n / 64 for n in lengths]).sum() / sum(lengths) * 64
    assert full.std() < 0.25 * arrival


def check(rows, docs, capacity):
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
        assert at <= capacity and (at == capacity or at & (at - 1) == 0) and all(r.sequence_length == at for r in v)
    for d, x, *_ in docs:
        ids, at = t.encode(x or "", add_special_tokens=False).ids + [2], 0
        for r in sorted(by[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_pack(spark):
    docs = documents(5) + [(99_999, "word " * 5000, None, None, 0)]
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as start", "2 as length")
    check(pk.pack(df, PATH, 256, block=4).collect(), docs, 256)
    check(pk.pack(df, PATH).collect(), docs, 4096)
    assert pk.pack(df.limit(0), PATH).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    assert sum(r.length for r in pk.pack(twice, PATH).collect()) == 3 + 3 + 1
