"""Wrapper induction: hand-made sites, and simple tree matching against all alignments."""

import random
from itertools import combinations

import pytest

from logweave.llm import html as H


def text(page, template=()):
    return H.Wrapper(H.Wrapper.tree(page), template).extract(H.Page(page))


def test_blocks_and_references():
    page = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
            "<nav><ul><li><a href='/a'>Menu</a></li></ul></nav><!-- ad <p>no</p> --><div class=\"ad\">Buy</div>"
            "<article><h1>Head &amp; tail</h1><p><b>One <i>two</i>\n\t three<br>four<p>F&uuml;nf &#x41;&#66; 1 < 2"
            "<span class='ad'>buy</span> end</p><form>name</form><div id='comments'>first!</div>"
            "<p hidden>no</p></article><aside>side</aside><footer>&copy; x</footer></body></html>")
    assert text(page) == "Head & tail\nOne two three four\nFünf AB 1 < 2 end"


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("  \n ", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\nb"), ("a<script>x", "a"),
    ("<p>a</p><a href='x", "a"), ("<ul><li>a<li>b</ul>c", "a\nb\nc"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("</p></div>x<b>y", "xy"),
    ("<main><p>in</p></main><p>out</p>", "in"), ("<div role=navigation>n</div><p>x</p>", "x"),
    ("<header>site</header><article><header><h1>T</h1></header>x</article>", "T\nx"),
    ("<div class='cookie-notice'>c</div><div class='post-12'>x</div>", "x"), ("<p>a&nbsp;&nbsp;b</p>", "a b"),
])
def test_small_pages(page, want):
    assert text(page) == want


def test_very_long_page():
    body = "".join(f"<p>para {i} &amp; more</p>" for i in range(30_000))
    assert text(f"<article>{body}</article>").count("\n") == 29_999


def slow_match(a, b):
    """Size of the best alignment of (label, children) trees, over all order-keeping choices."""
    if a[0] != b[0]:
        return 0
    best = 0
    for n in range(min(len(a[1]), len(b[1])) + 1):
        for x in combinations(a[1], n):
            for y in combinations(b[1], n):
                sizes = [slow_match(s, t) for s, t in zip(x, y)]
                if all(sizes):
                    best = max(best, sum(sizes))
    return 1 + best


def test_matching_against_all_alignments():
    r = random.Random(4)

    def tree(depth):
        return r.choice("ab") if depth < 3 else "a", [tree(depth - 1) for _ in range(r.randint(0, 3) if depth else 0)]

    def flat(t):
        labels, parents = [], []

        def walk(node, up):
            labels.append(node[0])
            parents.append(up)
            k = len(labels) - 1
            for c in node[1]:
                walk(c, k)
        walk(t, -1)
        return labels, H.children(parents), parents

    for _ in range(150):
        a, b = tree(3), tree(3)
        (la, ka, pa), (lb, kb, pb) = flat(a), flat(b)
        size, pairs = H.match(la, ka, lb, kb)
        assert size == slow_match(a, b) == len(pairs)
        assert all(la[i] == lb[j] and (pa[i] < 0 or (pa[i], pb[j]) in pairs) for i, j in pairs)


def test_long_sibling_lists_are_matched_by_label():
    la = ["#"] + [f"x{i}" for i in range(700)]
    kids = [list(range(1, 701))] + [[]] * 700
    assert H.match(la, kids, la, kids)[0] == 701


def test_constant_slots_become_template(spark):
    def page(i, extra=""):
        return (f"<body><div class='top'>Site of things</div><div class='c'><p>Story {i} tells {i * 7}.</p>"
                f"<p>Read more on this site</p>{extra}</div></body>")
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(12)]
    rows += [(100 + i, f"http://b.example/{i}", page(1)) for i in range(3)]  # too few pages to tell
    rows += [(200, None, None), (201, "no host", "<p>x</p>"), (201, "no host", "<p>x</p>"), (None, "http://c/", "")]
    df = spark.createDataFrame([(*r, "h", "t") for r in rows],
                               "page_id long, url string, html string, host string, text string").repartition(3)
    for limit in (32 << 20, 0):
        got = H.main_text(df, broadcast_bytes=limit).collect()
        assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
        by = {r.id: r.text for r in got}
        assert all(by[i] == f"Story {i} tells {i * 7}." for i in range(12))
        assert all(by[100 + i].endswith("Read more on this site") for i in range(3))
        assert by[200] == "" and by[201] == "x" and by[None] == ""
    assert H.main_text(df.limit(0)).count() == 0


def test_pages_give_their_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in H.main_text(pages).collect():
        article = source[r.id].split("<article>")[1].split("</article>")[0]
        assert r.text == text(f"<article>{article}</article>") and r.text and "<" not in r.text


def test_copies_are_no_evidence_and_empty_pages_no_reference(spark):
    def page(i):
        return f"<body><div class='top'>Site</div><div class='c'><p>Story {i}.</p><p>Told {i} times.</p></div></body>"

    def other(i):
        return f"<body><table><tr><td>Shop</td><td>Ware {i}</td></tr></table></body>"
    rows = [(i, f"http://copies.example/{i}", f"<article>{page(1)}</article>") for i in range(8)]
    rows += [(100 + i, f"http://some.example/{i}", page(0 if i < 20 else i)) for i in range(28)]
    rows += [(200 + i, f"http://empty.example/{i}", None if i % 3 == 0 else "" if i % 3 == 1 else page(i)) for i in range(60)]
    rows += [(300 + i, f"http://two.example/{i}", page(i) if i % 2 else other(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for limit in (32 << 20, 0):
        by = {r.id: r.text for r in H.main_text(df, broadcast_bytes=limit).collect()}
        assert len(by) == len(rows)
        assert all(by[i] == "Site\nStory 1.\nTold 1 times." for i in range(8))
        assert all(by[100 + i] == "Story {0}.\nTold {0} times.".format(0 if i < 20 else i) for i in range(28))
        assert all(by[200 + i] == ("" if i % 3 < 2 else f"Story {i}.\nTold {i} times.") for i in range(60))
        assert all(by[300 + i] == (f"Story {i}.\nTold {i} times." if i % 2 else f"Ware {i}") for i in range(40))


@pytest.mark.parametrize("attrs", [
    'class="layout has-sidebar"', 'class="post has-comments"', 'id="page" class="menu-open"', 'class="skip-lazy"',
    'class="related-work"', 'title="x class=comment "', "data-x='class=\"footer\"' class=body", 'class="no-ads js-nav"',
    'class="search-results"'])
def test_a_wrapper_keeps_the_article(attrs):
    page = H.Page(f"<body><div {attrs}><p>The article itself.</p></div><div class='site-footer'>Imprint</div></body>")
    assert [text for _, text, apart, _ in page.blocks if not apart] == ["The article itself."]


@pytest.mark.parametrize("name", ["site-footer", "nav-main", "comment-list", "cookie-banner", "ad-slot", "related-posts",
                                  "skip-link", "search-form", "post sidebar", "SideBar left", "related", "share_buttons"])
def test_parts_apart_by_name(name):
    page = H.Page(f"<p>The article.</p><div class='{name}'><p>Other things</p></div>")
    assert [text for _, text, apart, _ in page.blocks if not apart] == ["The article."]
