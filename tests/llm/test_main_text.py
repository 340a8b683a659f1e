import random
import time

import pytest

from foliant.llm.main_text import best_region, extract, learned, main_texts

P = "<p>one two three four five six seven eight nine ten</p>"
T = "one two three four five six seven eight nine ten"


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("no markup at all but words", "no markup at all but words"), ("<html><body></body></html>", ""),
    (f"<nav><a href='/'>Home page</a></nav><div class=ad>Buy now and save a lot</div><article><h1>Big title</h1>{P}{P}</article><footer>&copy; us</footer>", f"Big title\n\n{T}\n\n{T}"),
    (f"<article>{P}<div class='advert'>buy this great thing now</div>{P}<form>name <input> <label>mail me</label></form></article><div id=comments><p>nice text, thank you so much</p></div>", f"{T}\n\n{T}"),
    (f"<main>{P}<aside>more stories to read here</aside>{P}</main>", f"{T}\n\n{T}"),
    (f"<article><p>a &amp; b &lt;c&gt; &#228;&eacute; x\n\t y<br>z one two three</p><script>var a = '<p>no</p>';</script><style>p {{}}</style>{P}</article>", f"a & b <c> äé x y z one two three\n\n{T}"),
    (f"<article><p><b>{T}<br><p>{T}", f"{T}\n\n{T}"), (f"<article>{P}<!-- hidden <p>words</p> -->{P}<!-- open", f"{T}\n\n{T}"), (f"<article>{P}<script>never ends", T),
    (f"<div id='cookie-consent'><p>we use cookies and more cookies</p></div><article>{P}</article><aside class=sidebar>{P}{P}</aside>", T),
    (f"<article class='post comments-open category-newsletter'>{P}{P}</article>", f"{T}\n\n{T}"),
    (f"<body class='has-sidebar'><div class='wrap sidebar-right'><main class='content'>{P}{P}</main><div class='sidebar'>{P}</div></div></body>", f"{T}\n\n{T}"),
    (f"<article>{P}{P}<div class='ad'><p>{'buy ' * 400}</p></div>{P}{P}</article>", "\n\n".join([T] * 4)),
    (f"<article>{P}{P}</article><div class='x1'><p>Copyright 2020 some company of some place and all its friends</p></div>", f"{T}\n\n{T}"),
    (f"<article>{P}<p>Copyright law protects works that people write, draw, sing or build.</p></article>", f"{T}\n\nCopyright law protects works that people write, draw, sing or build."),
    (f"<article>{P}</article><article class='comment'>{P}</article><ol class='comment-list'><li><article class='comment-body'>{P}</article></li></ol>", T),
    (f"<article>{P}<p>All rights reserved.</p></article><footer>All rights reserved.</footer>", f"{T}\n\nAll rights reserved."),
    (f"<article><h1>Copyright 2024 reform explained</h1>{P}<p>Copyright by law is a right that ends.</p>{P}</article>", f"Copyright 2024 reform explained\n\n{T}\n\nCopyright by law is a right that ends.\n\n{T}"),
    (f"<main>{P}<p>All rights reserved seats were sold out on the first day of May.</p></main>", f"{T}\n\nAll rights reserved seats were sold out on the first day of May."),
    ("<article><p>(c) 2020 was the name of a band that nobody knew then</p></article>", "(c) 2020 was the name of a band that nobody knew then"),
    (f"<article><p class=it's>{T}</p>{P}</article>", f"{T}\n\n{T}"), (f"<article><p title='a > b' data-x=a\"b>{T}</p></article>", T), (f"<article><p title=\"never ends>{T}</p></article>{P}", ""),
    (f"<article>{P}{P}<div class='newsletter'>Sign up for our weekly letter</div>{P}</article>", f"{T}\n\n{T}\n\n{T}"), (f"<article>{P}<div class='adbox'>Buy one and get two of them</div>{P}</article>", f"{T}\n\n{T}"),
    (f"<div class='cookiebar'>We use cookies on this site of ours</div><article>{P}{P}</article>", f"{T}\n\n{T}"), (f"<article>{P}{P}</article><div class='feedback'>{P}</div>", f"{T}\n\n{T}"),
    (f"<div class='content'>{P}{P}</div><div class='right column'><h3>Latest</h3><ul><li><a href='/'>one two</a></li></ul></div>", f"{T}\n\n{T}"),
    (f"<article>{P}{P}</article><section><h2>Comments</h2><article class='comment'>{P}</article></section>", f"{T}\n\n{T}"), (f"<article>{P}<h2>Comments</h2>{P}</article>", f"{T}\n\nComments\n\n{T}"),
    ("<article>a < b and 5 > 3 one two three four five six seven</article>", "a < b and 5 > 3 one two three four five six seven"),
])
def test_pages(page, text):
    assert extract(page, learned()) == text


def test_very_long_page_keeps_all():
    page = "<nav><a>x</a></nav><article>" + P * 20_000 + "</article><footer>f</footer>"
    assert extract(page, learned()) == "\n\n".join([T] * 20_000)


def test_query_columns(spark):
    rows = [(1, "u", f"<article>{P}</article>"), (1, "u", f"<article>{P}</article>"), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    assert sorted((tuple(r) for r in main_texts(df).collect()), key=str) == sorted([(1, "u", T, len(T)), (1, "u", T, len(T)), (None, None, "", 0)], key=str)
    assert main_texts(df.where("false")).count() == 0


def test_damaged_nesting_is_quick():
    begin = time.perf_counter()
    for page in ("<b>" * 50_000 + "</i>" * 50_000, "<p>" + "<b>" * 50_000 + "<li>" * 50_000, "<p>x" * 50_000, "<section>" * 50_000 + "</div>" * 50_000, "<ul><li>" * 30_000 + "</article>" * 50_000):
        extract(page, learned())
    assert time.perf_counter() - begin < 10
    assert extract("</div></p></x>" * 50 + f"<article><p><i>{T}</b></i></section></p></div></article></article>", learned()) == T


def test_best_region_equals_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        scores = [rng.choice([-3.0, -1.0, -0.5, 0.0, 1.0, 2.0, 5.0]) for _ in range(rng.randrange(0, 14))]
        for gap in (0.0, 2.0, 1e9):
            up = [i for i, s in enumerate(scores) if s > 0]

            def value(a, b):
                inside = [i for i in up if a <= i <= b]
                gaps = [min(-sum(scores[i + 1 : j]), gap) for i, j in zip(inside, inside[1:], strict=False)]
                return sum(scores[i] for i in inside) - sum(gaps)

            begin, end = best_region(scores, gap)
            want = max((value(a, b) for a in up for b in up if a <= b), default=0.0)
            assert (value(begin, end - 1) if end else 0.0) == pytest.approx(want)
            assert not end or (begin in up and end - 1 in up)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_tables_give_their_article_elements(spark, sf):
    """The tables' pages have one article element each, with its own headers and adverts; what main_texts() gives is its text."""
    import html
    import re

    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    got = {r.page_id: r.text for r in main_texts(pages).collect()}
    plain = lambda x: " ".join(html.unescape(x).split())
    wrong = []
    for r in pages.collect():
        inner = re.search(r"(?s)<article[^>]*>(.*?)</article>", r.html or "")
        text = re.sub(r"(?s)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ", inner[1] if inner else "")
        if plain(re.sub("<[^>]*>", " ", text)) != plain(got[r.page_id]):
            wrong.append(r.page_id)
    assert wrong == []
