import random

from plumbline.llm import unigram as u
from plumbline.llm.packing import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")


def splits(text, ids):
    if not text:
        yield []
    for n in range(1, len(text) + 1):
        if text[:n] in ids:
            for rest in splits(text[n:], ids):
                yield [text[:n], *rest]
        elif n == 1 and text[0] not in ids:
            for rest in splits(text[1:], ids):
                yield [None, *rest]


def test_best_split_against_all_splits():
    rng = random.Random(5)
    for _ in range(80):
        words = {"".join(rng.choice("abé▁"[:3]) for _ in range(rng.randint(1, 4))) for _ in range(6)} | {"▁a", "▁"}
        ids = {w: i for i, w in enumerate(sorted(words))}
        scores = {i: -rng.random() * 9 for i in ids.values()}
        p = u.Pieces.of(ids, scores, {b: 1000 + b for b in range(256)})
        text = "▁" + "".join(rng.choice("abé") for _ in range(8))
        got, score = p.best(text)
        best = max(sum(scores[ids[x]] if x else p.lowest for x in s) for s in splits(text, ids))
        assert abs(best - score) < 1e-9
        assert b"".join(p.bytes[i] for i in got).decode() == text.replace("▁", " ")


def test_trie_holds_all_pieces():
    p = u.pieces(MODEL)
    t = p.trie
    for i, piece in p.bytes.items():
        if i in p.is_byte:
            continue
        node = 0
        for b in piece.decode().replace(" ", "▁").encode():
            nxt = t.base[node] + b + 1
            assert t.check[nxt] == node
            node = nxt
        assert t.value[node] == i


def test_chunks_equal_the_whole_text():
    p = u.pieces(MODEL)
    for text in ("Hello world", "  two  spaces ", "a\nb \n c", "日本語 テスト 😀", " ", "\n", "ünïcödé wörds, and: marks!"):
        got = p.encode(text)
        whole, score = p.best("▁" + text.replace(" ", "▁"))
        assert abs(sum(g[1] for g in got) - score) < 1e-6
        assert p.decode(whole) == text


def test_marker_in_a_text_stays_a_marker():
    p = u.pieces(MODEL)
    for text in ("▁", "a▁b", "▁▁ a", " ▁", "a ▁ b▁", "▁\n▁"):
        ids = [i for raw, *_ in p.encode(text) for i in u.np.frombuffer(raw, "<i4").tolist()]
        assert p.decode(ids) == text


def test_encode_and_decode(spark):
    docs = [(1, "The quick brown fox"), (2, None), (3, ""), (4, "a▁b"), (5, "x" * 30000), (6, "😀\t\x00é" * 20), (6, "😀\t\x00é" * 20), (None, " lead")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'c' as ids", "1 as score")
    out = u.encode(df, MODEL)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r)
    assert all(r.round_trip for rs in got.values() for r in rs) and len(got[6]) == 2
    assert got[2][0].n_tokens == 0 and got[2][0].score == 0 and got[3][0].ids == []
    back = {r.doc_id: r.text for r in u.decode(out, MODEL).select("doc_id", "text").collect()}
    assert back[1] == docs[0][1] and back[4] == "a▁b" and back[5] == docs[4][1] and back[6] == docs[5][1] and back[None] == " lead"
    assert got[6][0].n_byte_tokens > 0
    assert u.encode(df.limit(0), MODEL).count() == 0
