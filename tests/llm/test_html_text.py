import html
import random
import re
from collections import Counter

import pytest

from lexipress.llm import html_text as H

SF = "/root/testdata/sf0.01"


def test_corpus_pages(spark):
    """The corpus pages have an article of paragraphs; a plain cut along their tags gives its blocks."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    out = {r.page_id: r for r in H.main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", x.replace("<b>", "").replace("</b>", "")))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        assert out[r.page_id].text == "\n\n".join(p for p in parts if p)
        assert out[r.page_id].n_chars == len(out[r.page_id].text) and out[r.page_id].url == r.url


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("just  text &amp; more", "just text & more"),
        ("<p>a<p>b<b>c</b>d<br>e</p>f", "a\nbcd e\nf"),
        ("<body><header>site</header><nav><ul><li>menu</ul></nav><article><header><h1>T</h1></header><p>x&nbsp;y &#233;&eacute;&lt;z</p><aside>side</aside><div class='share-buttons social'>s</div></article><div class=comments>c</div><footer>f</footer>", "T\nx y éé<z"),
        ("<div id='cookie-notice'>n</div><div class=\"sidebar\">s</div><form><p>in</form><p>body<script>var a='<p>no</p>';</script> text<style>p{}</style></p><!-- <p>no</p> --><p hidden>h</p>", "body text"),
        ("<main><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table></main>", "one\ntwo\na\nb\nc"),
        ("<article><p>5 < 6 and a<b>c</b></article>", "5 < 6 and ac"),
        ("<p>cut off <a href='x", "cut off <a href='x"),
        ("<p>new\nline\t tab</p>\n<pre>k  l</pre>", "new line tab\nk l"),
        ("<DIV><P CLASS=adviser>kept</P><p class='ad'>gone</p></DIV>", "kept"),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_pages(page, text):
    assert "\n".join(H.blocks(page, set())) == text


def test_templates(spark):
    """What recurs over a host goes; what recurs in articles stays; the same parts on another host stay."""
    box = "<div><p>Read more stories from around the world</p></div>"
    rows = [(i, f"http://a.com/{i}", f"<body>{box}<div><p>text {i}</p><p>more {i}</p></div></body>") for i in range(30)]
    rows += [(100, "http://b.com/", f"<body>{box}<p>b</p></body>"), (101, None, None), (102, "no url", "<p>x</p>")]
    rows += [(200 + i, f"https://c.com:80/{i}", f"<article><p>same passage</p><div><a href=x>Next</a></div><p>own {i}</p></article>") for i in range(30)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in H.main_text(df).collect()}
    assert got[3] == "text 3\n\nmore 3" and got[100].startswith("Read more") and got[101] == "" and got[102] == "x"
    assert got[205] == "same passage\n\nown 5"
    assert H.main_text(df.limit(0)).count() == 0
    twice = H.main_text(df.where("page_id = 102").union(df.where("page_id = 102"))).collect()
    assert [r.text for r in twice] == ["x", "x"]


@pytest.mark.parametrize("small", [4 << 20, 0])
def test_templates_against_brute_force(spark, monkeypatch, small):
    """Pages without a marked article, one host with half of them: a block goes exactly if it's on 10 pages and a fifth of
    its host's; both ways of the joins."""
    monkeypatch.setattr(H, "SMALL", small)
    rng = random.Random(4)
    pool = {h: [f"{h} site block {k}" for k in range(6)] for h in ("big.org", "mid.org", "few.org")}
    rows = []
    for i in range(240):
        host = rng.choice(["big.org", "big.org", "mid.org"]) if i % 40 else "few.org"
        rows.append((i, host, [x for k, x in enumerate(pool[host]) if rng.random() < (k + 1) / 8] + [f"own {i} {k}" for k in range(rng.randint(0, 3))]))
    on = Counter((h, b) for _, h, some in rows for b in some)
    pages = Counter(h for _, h, _ in rows)
    df = spark.createDataFrame([(i, f"https://{h}/{i}", "<body>" + "".join(f"<div><p>{b}</p></div>" for b in some) + "</body>") for i, h, some in rows], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in H.main_text(df).collect()}
    gone = {x for x, n in on.items() if n >= H.TEMPLATE_PAGES and n >= H.TEMPLATE_SHARE * pages[x[0]]}
    assert len(gone) >= 6 and len(on) - len(gone) >= 100
    for i, h, some in rows:
        text = "\n\n".join(b for b in some if (h, b) not in gone)
        assert got[i] == (text, len(text))
