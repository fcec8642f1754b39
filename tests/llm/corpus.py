"""Small made-up documents with copies, near copies, shared passages and odd rows."""

import random

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=1, n=120):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage = say(60)
    texts = ["", None, " ", "\n\n", "one", "two words", "Two Words", "é" * 300, "ab" * 400]
    base = say(200)
    for i in range(n):
        kind = i % 6
        if kind == 0:
            texts.append(say(rng.randint(1, 120)))
        elif kind == 1:
            texts.append(rng.choice(texts[5:]))
        elif kind == 2:
            texts.append((texts[-1] or "").upper())
        elif kind == 3:
            w = base.split()
            for _ in range(rng.randint(0, 12)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
        elif kind == 4:
            texts.append(say(20) + "\n" + passage + "\n" + say(rng.randint(0, 30)))
        else:
            texts.append("\n".join(rng.choice(["Menu here", say(4), "", " All rights "]) for _ in range(6)))
    ids = rng.sample(range(10_000), len(texts))
    return [(d, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", None]), None if t is None else len(t)) for d, t in zip(ids, texts)]
