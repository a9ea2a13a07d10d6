import html
import math
import re
import time

import numpy as np

from panelspark.llm import html_extract
from panelspark.llm.html_extract import extract, extract_pages, marks, smoothed, threshold

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
<body class="home"><header><h1>Site name</h1><nav><a href="/">Home</a></nav></header><div class="cookie-notice">We use cookies a lot, really long text of a notice here.</div>
<main><article><header><h2>Title &amp; more</h2></header><p>First   paragraph with <a href="x">a link</a> and <em>words</em>&nbsp;here, long enough to count.<br>After a break.</p>
<div class="ad">Buy now, this is an advert with plenty of words in it for nothing.</div><ul><li>one item</li><li>two items</li></ul><p>Last.</p><form><p>Name</p></form></article>
<section id="comments"><article class="comment"><p>Reader comment which is also rather long, with many words in it.</p></article></section></main>
<aside>Sidebar text</aside><footer>Footer &copy; 2020</footer></body></html>"""


def test_article_without_the_rest():
    assert extract(PAGE) == "Title & more\nFirst paragraph with a link and words here, long enough to count. After a break.\none item\ntwo items\nLast."


def test_page_without_marked_article():
    body = "".join(f"<p>Paragraph {i} " + "with a good many plain words in it " * 4 + "</p>" for i in range(6))
    page = f"<html><body><div id='top'><a href=1>Home</a> <a href=2>News</a></div><div><div><h1>Head</h1>{body}</div></div><div><a href=3>About</a></div></body></html>"
    got = extract(page).split("\n")
    assert got[0] == "Head" and len(got) == 7


ARTICLE = "<article><h1>Head</h1><p>Some words of the first paragraph here.</p><p>And more of them in the second.</p></article>"
TEXT = "Head\nSome words of the first paragraph here.\nAnd more of them in the second."


def test_parts_of_names_mark_nothing():
    for page in ('<div class="page with-sidebar">{}</div>', '<main class="no-comments">{}</main>', '<div id="share-page">{}</div>', '<div class="search"><div class="widget">{}</div></div>', '<form id="aspnetForm">{}</form>'):
        assert extract(page.format(ARTICLE)) == TEXT, page
    assert extract(ARTICLE.replace("<p>And", '<div class="related-work"><p>And').replace("</article>", "</div></article>")) == TEXT
    assert extract(ARTICLE.replace("<p>And", '<div class="related-posts"><p>Not this</p></div><div class="cookie_notice">Nor this</div><p>And')) == TEXT
    assert marks("x site-footer") and marks("comments-area") and marks("ad-slot-3") and not marks("header-image") and not marks("article-with-comments")


def test_several_articles_stay():
    assert extract(f"<body><nav>menu</nav><main>{ARTICLE}{ARTICLE.replace('Head', 'Other')}</main></body>") == TEXT + "\n" + TEXT.replace("Head", "Other")
    assert extract(f"<body>{ARTICLE}<div class='ad'>ad ad</div>{ARTICLE.replace('Head', 'Other')}</body>") == TEXT + "\n" + TEXT.replace("Head", "Other")


def unmarked_page():
    """Two dense halves among short lines, without any tag or name that tells them apart."""
    short = lambda k: "".join(f"<div><span>Tag</span> <b>{k}</b> <i>x</i></div>" for k in range(k, k + 9))
    dense = lambda k: "<div>" + "".join(f"<p>Paragraph {i} " + "with a good many plain words in it " * 6 + "</p>" for i in range(k, k + 4)) + "</div>"
    want = "\n".join(f"Paragraph {i} " + ("with a good many plain words in it " * 6).strip() for i in range(8))
    return f"<html><body><div>{short(0)}</div>{dense(0)}{dense(4)}<div>{short(20)}</div></body></html>", want


def test_clusters_decide(monkeypatch):
    page, want = unmarked_page()
    assert extract(page) == want
    monkeypatch.setattr(html_extract, "is_content", lambda ratios, sigma: np.ones(len(ratios), bool))
    assert extract(page) != want


def test_smoothing_decides(monkeypatch):
    """A short line among long ones, and a long one among short ones, go with their neighbours."""
    long = "<div><p>" + "plain words of the article go on here " * 5 + "</p></div>"
    one, odd = "<div><p>Yes.</p></div>", "<div><b>A single longer teaser line</b> here</div>"
    short = "<div><b>Tag</b> <i>x</i></div>" * 8
    page = f"<body>{short}{odd}{short}{long * 4}{one}{long * 4}{short}</body>"
    want = extract(page)
    assert want.count("plain words") == 40 and "Yes." in want and "teaser" not in want
    monkeypatch.setattr(html_extract, "smoothed", lambda ratios, sigma: ratios)
    cut = html_extract.is_content(np.array([1, 40, 1, 190, 4, 190], float), 1.5)
    assert cut.tolist() == [False, False, False, True, False, True]


def by_definition(ratios, sigma):
    """The denser cluster, with the convolution and the two means written out."""
    reach = max(1, int(3 * sigma))
    smooth = []
    for i in range(len(ratios)):
        near = [(math.exp(-0.5 * ((j - i) / sigma) ** 2), ratios[j]) for j in range(max(0, i - reach), min(len(ratios), i + reach + 1))]
        smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    cut = sum(smooth) / len(smooth)
    for _ in range(50):
        low, high = [x for x in smooth if x < cut], [x for x in smooth if x >= cut]
        if not low or not high:
            break
        cut = (sum(low) / len(low) + sum(high) / len(high)) / 2
    return [x >= cut - 1e-9 for x in smooth]


def test_clusters_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        ratios = np.concatenate([rng.uniform(0, 8, rng.integers(1, 12)), rng.uniform(30, 90, rng.integers(0, 12)), rng.uniform(0, 8, rng.integers(1, 9))])
        assert html_extract.is_content(ratios, 1.5).tolist() == by_definition(ratios.tolist(), 1.5)


def test_time_is_linear_in_nesting():
    start = time.process_time()
    extract("<div>" * 30000 + "<p>x</p>" + "</section>" * 30000)
    assert time.process_time() - start < 5


def test_odd_pages():
    assert extract(None) == extract("") == extract("<p></p>") == extract("<script>x</script>") == ""
    assert extract("plain &lt;text&gt; only") == "plain <text> only"
    assert extract("<article><p>cut off in the middle of a <b>wor") == "cut off in the middle of a wor"
    assert extract("</p></div><article><p>a<p>b</article>") == "a\nb"
    assert extract("<article>" + "<p>x</p>" * 30000 + "</article>").count("\n") == 29999
    assert extract("<div>" * 3000 + "<p>deep text</p>") == "deep text"


def test_generated_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in extract_pages(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n".join(x for x in parts if x)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, None, None, "x", "y"), (None, "u", "<p>a", None, None), (1, None, None, "x", "y")]
    out = extract_pages(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out) == [(0, "a", 1), (1, "", 0), (1, "", 0)]
    assert extract_pages(spark.createDataFrame([], schema)).collect() == []


def test_smoothing_and_threshold():
    flat = smoothed(np.ones(9), 1.5)
    assert np.allclose(flat, 1)
    spike = smoothed(np.eye(9)[4], 1.0)
    assert spike.argmax() == 4 and spike[3] == spike[5] > spike[2]
    assert 2 < threshold(np.array([1, 1.2, 0.9, 5, 5.2])) < 4
