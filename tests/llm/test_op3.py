import html
import re

import pytest

from galley.llm import op3_pages as op


def page(body):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def text(body, other=None):
    own, near = op.blocks(page(body)), op.blocks(page(other)) if other else None
    return op.main_text(own, op.deleted([t for _, t in own], near and [t for _, t in near]))


def test_article_without_furniture():
    body = """<nav><ul><li>Home</li></ul></nav><header>Site</header><div class="ad">Buy</div><div id="cookie-notice">OK?</div>
      <article><header><h1>A &amp; B</h1></header><p>One<br>two   <b>thr</b>ee&nbsp;four</p><script>var x="</p>";</script><!-- c -->
      <aside>Side</aside><p>x &lt; y &#233; &eacute &copy;</p><div class="comments"><p>First!</p></div><form>Mail</form></article>
      <section class="related">More</section><footer>End</footer>"""
    assert text(body) == "A & B\nOne two three four\nx < y é é ©"


@pytest.mark.parametrize("broken, want", [("<article><p>a<p>b</article></nav>c", "a\nb"), ("<article><p>a <b", "a"), ("<article>1 < 2 <i>x</article>", "1 < 2 x"), ("<nav>m<article>x</article>", ""), ("<article><!-- open", "")])
def test_broken_markup(broken, want):
    assert text(broken) == want


def test_differencing_deletes_shared_lines_of_unnamed_pages():
    a = "<div>Logo</div><p>first</p><p>second</p><div>Imprint</div>"
    b = "<div>Logo</div><p>other</p><p>second thing</p><div>Imprint</div>"
    assert text(a, b) == "first\nsecond" and text(a, a) == "Logo\nfirst\nsecond\nImprint"
    assert text(f"<article>{a}</article>", f"<article>{b}</article>") == "Logo\nfirst\nsecond\nImprint"


@pytest.mark.parametrize("body", ['<article class="post comments-open">{}</article>', '<main class="with-sidebar">{}</main>', '<article><section id="related-work">{}</section></article>', '<div role="main" class="no-header">{}</div>',
                                  '<div class="has-sidebar"><article id="nav">{}</article></div>', '<article><div class="notice banner">{}</div></article>'])
def test_articles_keep_their_text(body):
    assert text(body.format("<p>one</p><p>two</p>")) == "one\ntwo"


@pytest.mark.parametrize("body", ['<article class="comment">x</article>', '<article><div id="comments">x</div></article>', '<div class="ad-slot">x</div>', '<div class="site-header">x</div>', '<div id="left_sidebar">x</div>', '<section class="main-nav wide">x</section>', '<article><p class="Advert">x</p><div class="ad">y</div></article>'])
def test_named_boilerplate_goes(body):
    assert "y" not in text(body) and (text(body) == "" or "<p" in body)


def test_unnamed_articles_come_by_differencing(spark):
    """A corpus of pages without article markup: shared lines go wherever the nearest page has them, the rest stays."""
    rows, want = [], {}
    for host in range(4):
        for i in range(25):
            own = [f"Host {host} page {i} line {k}" for k in range(i % 4 + 1)]
            rows.append((100 * host + i, f"https://h{host}.org/news/{i:03}.html", page("".join(f"<div>{t}</div>" for t in [f"Logo {host}", "All news", *own, "Imprint", f"Contact {host}"]))))
            want[100 * host + i] = "\n".join(own)
    got = op.extracted(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in got.collect()} == want


def test_common_is_longest():
    import random

    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
        got = [a[i] for i in sorted(op.common(a, b))]
        assert len(got) == size[-1][-1]
        it = iter(b)
        assert all(x in it for x in got)


def test_address():
    assert op.address("HTTP://u@Www.Ex.org:80/a/b?c#d") == ("www.ex.org", "/a/b") and op.address(None)[0] == "" and op.address("x.org#f") == ("x.org", "/")


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_pairs_do_not_depend_on_partitions(spark, parts):
    rows = []
    for i in range(40):
        host = "hot.org" if i % 3 else f"h{i % 5}.org"
        shared = f"<p>menu {i // 4}</p>"
        rows.append((i, f"https://{host}/{i % 7}/{i}.html?q={i}", page(f"{shared}<p>own {i}</p><p>tail {host}</p>")))
    rows += [(100, None, None), (101, "https://hot.org/x", ""), (102, rows[5][1], rows[5][2]), (102, rows[5][1], rows[5][2]), (None, "https://hot.org/zz", "<p>z</p>")]
    order = sorted(((*op.address(u), -1 if i is None else i, op._key(i, u, h)), i, op.blocks(h or "")) for i, u, h in rows)
    want = []
    for k, (at, i, own) in enumerate(order):
        near = [(None, None, *order[j][0][:2], None, [t for _, t in order[j][2]]) if 0 <= j < len(order) else None for j in (k - 1, k + 1)]
        found = op._nearest(near[0], (None, None, *at[:2]), near[1])
        want.append((i, op.main_text(own, op.deleted([t for _, t in own], found))))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    out = op.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as host"))
    got = [(r.page_id, r.text) for r in out.collect()]
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in op.extracted(pages).collect()}
    for r in pages.collect():
        body = re.search("<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        lines = [" ".join(html.unescape(re.sub("<[^>]*(>|$)", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1|li|ul|div)>", body)]
        assert got[r.page_id].text == "\n".join(x for x in lines if x) and got[r.page_id].n_chars == len(got[r.page_id].text)
    assert len(got) == pages.count() and op.extracted(pages.limit(0)).collect() == []


def test_every_page_is_judged_by_its_neighbour(spark):
    """Pages that name an article go through differencing too, and what it deletes of the article comes back."""
    shared = "<nav>menu</nav><article><p>said by both</p><p>own {}</p></article><p>foot</p>"
    rows = [(i, f"https://a.org/{i}", page(shared.format(i))) for i in range(6)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    gone = {r.key: r.gone for r in op.differences(frame).collect()}
    assert [gone[op._key(*r)] for r in rows] == [[0, 1, 3]] * 6
    assert {r.page_id: r.text for r in op.extracted(frame).collect()} == {i: f"said by both\nown {i}" for i in range(6)}
