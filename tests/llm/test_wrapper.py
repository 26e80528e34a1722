import html as entities
import random
import re

import pytest

from lexigrain.llm import common, wrapper


def article_text(html):
    """Plain reading of the test tables' own template."""
    found = re.search(r"<article>(.*?)</article>", html or "", re.S)
    blocks = re.split(r"</?(?:p|h1)>", found[1]) if found else []
    cleaned = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks)
    return "\n".join(b for b in cleaned if b)


def test_equals_plain_reading_of_articles(spark):
    pages = common.table(spark, "/root/testdata/sf0.01", "pages")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in wrapper.extract_pages(pages).collect()}
    assert got == {i: (t := article_text(h), len(t)) for i, h in html.items()}


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def sentence(rng, n=30):
    return " ".join(rng.choices(WORDS, k=n)) + f" {rng.random():.6f}."


def divs(rng, i):
    """A page without a semantic element; returns html and the paragraphs."""
    ps = [sentence(rng) for _ in range(rng.randint(2, 5))]
    return (
        f'<html><body><div id="top"><a href="/">Home</a> <a href="/x">News {i}</a></div><div class="wrap"><div id="box-{i}"><h2>Title {i} {rng.random()}</h2>'
        + "".join(f"<p>{p}" for p in ps)
        + '<p>Subscribe to our daily letter</div></div><div class="comments"><p>First! I liked it very much</p></div><div>All rights reserved &copy; Example</div></body></html>'
    ), ps


def test_divs_by_wrapper(spark):
    rng = random.Random(1)
    made = [divs(rng, i) for i in range(12)]
    rows = [(i, "http://Div.example.com/a", h, "x") for i, (h, _) in enumerate(made)]
    got = {r["page_id"]: r["text"].split("\n") for r in wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    for i, (_, ps) in enumerate(made):
        assert got[i][1:] == ps and got[i][0].startswith(f"Title {i}")


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<p>a&amp;b &lt;c&gt; &#233;&nbsp;x</p><p>  two\n words </p>", "a&b <c> é x\ntwo words"),
        ("<article><header><h1>T</h1><span>by me</span></header><p>x<br>y</p><form><input><p>z</p></form><aside>n</aside></article><footer>f</footer>", "T\nx y"),
        ("<body><nav>m</nav><main><h1>T</h1><div class='notice'>old</div><p>x</p><section id='comments'><p>c</p></section></main>", "T\nx"),
        ("<article><p>one<ul><li>a<li>b</ul><table><tr><td>1<td>2</table></article>", "one\na\nb\n1\n2"),
        ("<article><p>x<script>var a='<p>no</p>'</script>y<style>p{}</style></p></article><!-- c --><article class='comment'><p>reader says a lot of things here</p></article>", "xy"),
        ("<article><p>open <b>bold <i>both</p><p>next</p><!-- never closed", "open bold both\nnext"),
        ("<div class='content'><p>body text</p></div><div class='sidebar'><p>side</p></div>", "body text"),
        ("<article><p>a < b and c</p><p>x<", "a < b and c\nx<"),
        ("<article>" + "<p>w</p>" * 3 + "</article>", "w\nw\nw"),
        ("<article><p>read <a href='/'>this link</a> now</p><ul><li><a>more</a></li><li><a>links</a></li></ul></article>", "read this link now"),
    ],
)
def test_single_pages(html, want):
    assert wrapper.extract(html, None) == want


def test_copies_stay_and_notices_go(spark):
    rng = random.Random(2)
    copy = "<article><h1>Same</h1><p>" + sentence(rng) + "</p></article>"
    rows = [(i, "http://copy.example.com/", copy) for i in range(9)]
    rows += [(100 + i, "http://note.example.com/", f"<article><p>{sentence(rng)}</p><p>Read our terms of use</p></article>") for i in range(9)]
    rows += [(200, None, "<p>no host</p>"), (201, "http://note.example.com/", None)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == article_text(copy) for i in range(9))
    assert all("terms of use" not in got[100 + i] and got[100 + i] for i in range(9))
    assert got[200] == "no host" and got[201] == ""


def test_joined_wrappers_give_the_same(spark, monkeypatch):
    pages = common.table(spark, "/root/testdata/sf0.001", "pages")
    sent = {r["page_id"]: r["text"] for r in wrapper.extract_pages(pages).collect()}
    monkeypatch.setattr(wrapper, "SEND", -1)
    assert {r["page_id"]: r["text"] for r in wrapper.extract_pages(pages).collect()} == sent
    assert wrapper.extract_pages(pages.limit(0)).count() == 0


def test_long_page():
    text = "<article>" + "<p>word &amp; more</p>" * 50_000 + "</article>"
    assert wrapper.extract(text, None).count("word & more") == 50_000


def test_merging_is_like_absorbing():
    rng = random.Random(3)
    pages = [wrapper.Page(divs(rng, i)[0]) for i in range(8)]
    whole, one, two = wrapper.Wrapper(), wrapper.Wrapper(), wrapper.Wrapper()
    for i, p in enumerate(pages):
        whole.absorb(p)
        (one if i % 2 else two).absorb(p)
    one.merge(two)
    assert one.pages == whole.pages == 8 and sorted(zip(one.label, one.count, one.mass)) == sorted(zip(whole.label, whole.count, whole.mass))


@pytest.mark.parametrize("send", [wrapper.SEND, -1])
def test_notices_go_from_pages_of_many_paragraphs(spark, monkeypatch, send):
    monkeypatch.setattr(wrapper, "SEND", send)
    rng = random.Random(4)
    ps = {i: [sentence(rng, 8) for _ in range(30)] for i in range(24)}
    notices = {"on all pages": range(24), "on half of them": range(0, 24, 2), "on fewer": range(11)}

    def page(i):
        own = ps[i] + [f"This notice is {k}" for k, on in notices.items() if i in on]
        return "<article>" + "".join(f"<p>{x}</p>" for x in own) + "</article>"

    rows = spark.createDataFrame([(i, "http://long.example.com/", page(i)) for i in ps], "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"].split("\n") for r in wrapper.extract_pages(rows).collect()}
    assert got == {i: ps[i] + ["This notice is on fewer"] * (i < 11) for i in ps}


def test_short_sections_stay_and_teasers_go():
    body = "<article class='post'><h1>T</h1><p>" + "long text " * 80 + "</p></article>"
    html = f"<body>{body}<article class='update'><p>A short update.</p></article><article class='teaser'><a href='/x'>Read another page of ours</a></article></body>"
    assert wrapper.extract(html, None) == "T\n" + ("long text " * 80).strip() + "\nA short update."


def test_notices_go_from_short_pages_and_near_copies_stay(spark):
    rng = random.Random(5)
    notice = "<p>" + "This site has terms of use that everybody should read. " * 3 + "</p>"
    rows = [(i, "http://short.example.com/", f"<article><p>{sentence(rng, 120)}</p>{notice}</article>") for i in range(12)]
    rows += [(20, "http://short.example.com/", f"<article><p>Brief news.</p>{notice}</article>")]
    text = "".join(f"<p>{sentence(rng)}</p>" for _ in range(6))
    rows += [(30 + i, "http://near.example.com/", f"<article><h1>Edition {i}</h1>{text}</article>") for i in range(9)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[20] == "Brief news." and all("terms of use" not in got[i] and got[i] for i in range(12))
    assert all(got[30 + i] == article_text(rows[13 + i][2]) for i in range(9))
