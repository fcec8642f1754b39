import html
import math
import random
import time

from plumbline.llm import html_text as ht

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="with-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<!-- c --><div class="ad">Buy</div><div class="wrap">{article}</div><aside>Side</aside>
<section id="comments"><p>{comment}</p></section><form><p>Search <input></p></form><div class="sidebar"><p>{comment}</p></div>
<footer>&copy; x</footer></body></html>"""


def test_pages_built_from_paragraphs():
    rng = random.Random(8)
    for _ in range(60):
        paras = [" ".join(rng.choice(["über", "a<b", "&", "word", "x", "été"]) for _ in range(rng.choice([1, 2, 30, 90]))) for _ in range(rng.randint(1, 9))]
        body = ""
        for p in paras:
            form = rng.choice(["<p>{}</p>", "<p>{}", "<p><b>{}<br>\n", "<p>{}</p>\n\n", "<h2>{}</h2>", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</ul>"])
            body += form.format(html.escape(p).replace("été", "&eacute;t&#233;"))
        tag = rng.choice(["<article>{}</article>", "<main>{}</main>", "<article class=post>{}</article>"])
        page = PAGE.format(article=tag.format(body), comment="A reader says a lot of things here, at length. " * rng.randint(1, 40))
        assert ht.main_text(page) == "\n\n".join(paras)


def test_without_article_element():
    text = ["Long enough text of an article, with many words in it. " * 6, "Short.", "Another paragraph that is about as long as the first one. " * 5]
    page = PAGE.format(article="".join(f"<p>{t}</p>" for t in text), comment="c")
    assert ht.main_text(page) == "\n\n".join(t.strip() for t in text)


def test_odd_input():
    for h in ("", "<", "<p", "plain &amp; simple", "</div></p>", "<!-- ", "<script>x", "<p>" * 3000 + "deep", "<div>" * 2000 + "deep"):
        ht.main_text(h)
    assert ht.main_text("plain &amp; simple") == "plain & simple"
    assert ht.main_text("<nav><a>x</a><article><p>kept</article>") == "kept"
    assert ht.main_text("<article>a<br>b  c&nbsp;d</article>") == "a b c d"


def test_extract(spark):
    pages = [(1, "u", "<article><p>a</p><p>b</p></article>"), (2, None, None), (None, "v", ""), (1, "u", "<article><p>a</p><p>b</p></article>"),
             (3, "w", "<article>" + "<p>word</p>" * 20000 + "</article>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in ht.extract(df).collect()), key=str)
    long = "\n\n".join(["word"] * 20000)
    assert got == sorted([(1, "u", "a\n\nb", 4), (1, "u", "a\n\nb", 4), (2, None, "", 0), (None, "v", "", 0), (3, "w", long, len(long))], key=str)
    assert ht.extract(df.limit(0)).count() == 0


LONG = "A long paragraph of the article with many words in it, which goes on for a while and has no links at all."


def test_parts_with_doubtful_names():
    text = f"{LONG}\n\n{LONG}"
    assert ht.main_text(f'<body><form id="aspnetForm"><div><p>{LONG}</p><p>{LONG}</p></div></form></body>') == text
    shared = '<div class="share-buttons"><a>Tweet</a> <a>Post</a></div>'
    assert ht.main_text(f'<article><p class="share-price">{LONG}</p><div class="form-of-government"><p>{LONG}</p></div>{shared}</article>') == text
    assert ht.main_text(f'<article><div class="entry-header"><h1>Head</h1></div><p>{LONG}</p></article>') == f"Head\n\n{LONG}"
    assert ht.main_text(f'<article><p>{LONG}</p></article><article><p>{LONG}</p><p>short</p></article>') == f"{text}\n\nshort"
    small = '<form><p>Your name</p><p>Your address</p></form>'
    assert ht.main_text(f'<body><div><p>{LONG}</p><p>{LONG}</p></div>{small}</body>') == text
    assert ht.main_text(f'<article><p>{LONG}</p><div class="notice">{LONG}</div><div class="ad-box">{LONG}</div></article>') == LONG


PLAIN = (f'<body><ul><li><a>One</a></li><li><a>Two</a></li><li><a>Three</a></li></ul><div class="head"><h1>Head</h1></div>'
         f'<div class="body"><p>{LONG}</p><p>brief</p><p>{LONG}</p><p>{LONG}</p></div><div><a>Next</a><br><a>Last</a></div></body>')


def test_clusters_decide_without_an_article(monkeypatch):
    got = ht.main_text(PLAIN)
    assert got == f"Head\n\n{LONG}\n\nbrief\n\n{LONG}\n\n{LONG}"
    monkeypatch.setattr(ht, "threshold", lambda values: -1.0)
    assert ht.main_text(PLAIN) != got and "Three" in ht.main_text(PLAIN)


def test_smoothing_and_clusters_against_plain_sums():
    rng = random.Random(3)
    for _ in range(20):
        lines = [("x" * rng.randint(1, 300), rng.randint(0, 6), -1, -1, False) for _ in range(rng.randint(1, 25))]
        raw = [len(t) / max(n, 1) for t, n, *_ in lines]
        weight = lambda d: math.exp(-d * d / 2) if abs(d) <= 3 else 0.0
        want = [sum(weight(i - j) * v for j, v in enumerate(raw)) / sum(weight(i - j) for j in range(len(raw))) for i in range(len(raw))]
        got = ht.ratios(lines, 1.0)
        assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))
        cut = ht.threshold(got)
        below, above = [v for v in got if v < cut], [v for v in got if v >= cut]
        assert not below or abs(cut - (sum(below) / len(below) + sum(above) / len(above)) / 2) < 1e-9


def test_deep_pages_take_time_in_proportion():
    took = []
    for n in (4_000, 32_000):
        began = time.process_time()
        assert ht.main_text("<div>a" * n).count("a") == n
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.02)
