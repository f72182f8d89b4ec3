"""Wrapper induction on long child lists and on hosts full of copies."""

import random

import pytest

from quern.llm import wrapper


@pytest.mark.parametrize("cells", [1, 20, 40_000])
def test_long_lists_are_matched_maximally(monkeypatch, cells):
    monkeypatch.setattr(wrapper, "DP_CELLS", cells)
    rng = random.Random(4)

    def tree(d):
        return wrapper.Node(rng.choice("abc"), "", [tree(d - 1) for _ in range(rng.randrange(0, 7))] if d else [])

    def best(a, b):
        if a.label != b.label:
            return 0
        m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
        for i, x in enumerate(a.children):
            for j, y in enumerate(b.children):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + best(x, y))
        return 1 + m[-1][-1]

    for _ in range(150):
        a, b = tree(2), tree(2)
        found = wrapper.match(a, b)
        assert len(found) == best(a, b)
        order = {id(n): k for k, (_, n) in enumerate(wrapper._preorder(b))}
        first = {id(n): k for k, (_, n) in enumerate(wrapper._preorder(a))}
        got = sorted((first[id(x)], order[id(y)]) for x, y in found)
        assert all(p[1] < q[1] for p, q in zip(got, got[1:]))


def test_closing_block_of_a_long_page_is_aligned():
    # the rows of the first page stand around a subtree that only one place of the second can pair with
    def page(n):
        return wrapper.Node("body", "", [wrapper.Node("p") for _ in range(n)] + [wrapper.Node("p", "", [wrapper.Node("b")]), wrapper.Node("p")])

    a, b = page(1000), page(60)
    pairs = {id(x): y for x, y in wrapper.match(a, b)}
    assert pairs[id(a.children[1000])] is b.children[60]
    assert len(pairs) == 64


@pytest.mark.parametrize("broadcast_bytes", [32 << 20, -1])
def test_copies_and_second_layouts_get_their_template(spark, broadcast_bytes):
    def page(i, story):
        if i % 3:
            return f"<body><div>Company line</div><div><p>{story}</div><div>All rights reserved</div>"
        return f"<body><table><tr><td>Other layout line</table><section><p>{story}</section><table><tr><td>Closing line</table>"

    stories = ["one and the same article" if i < 180 else f"article {i}" for i in range(210)]
    rows = [(i, f"http://host.example/{i}", page(i, s)) for i, s in enumerate(stories)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in wrapper.extract(pages, broadcast_bytes=broadcast_bytes).collect()}
    assert got == dict(enumerate(stories))


def neutral_page(k):
    """No telling tag, no telling name: only what repeats from page to page gives the template away."""
    body = "".join(f"<div class='x7'>Block {k}-{i} tells of matter {k * 31 + i}.</div>" for i in range(1 + k % 4))
    return (
        "<html><body><div class='a1'><div>Home of things</div><div>Start</div><div>Places</div></div>"
        f"<div class='b2'><div class='c3'>Title number {k}</div>{body}</div>"
        "<div class='d4'><div>All rights with the house</div><div>Write to us</div></div></body></html>"
    ), [f"Title number {k}", *(f"Block {k}-{i} tells of matter {k * 31 + i}." for i in range(1 + k % 4))]


def test_the_template_alone_drops_boilerplate_of_neutral_pages(spark):
    pages = [neutral_page(k) for k in range(40)]
    t = spark.createDataFrame([(k, f"http://neutral/{k}", h) for k, (h, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrapper.extract(t).collect()}
    assert got == {k: "\n".join(want) for k, (_, want) in enumerate(pages)}



PAGES = [
    ('<body><div class="content-with-sidebar"><article><p>Hello there</p><p class="share-price">Price is 5</p></article></div><div class="sidebar">x</div>', ["Hello there", "Price is 5"]),
    ('<body><div class="layout has-sidebar"><article><p>Hello there</p></article></div>', ["Hello there"]),
    ('<body><form id="aspnetForm"><nav>Menu</nav><div><p>The whole of the body is in this form</p></div></form>', ["The whole of the body is in this form"]),
    ('<body><form><article><p>Short</p></article><div class="comments"><article class="comment">a far longer comment of a reader on it</article></div></form>', ["Short"]),
    ('<body><article><p>Hello</p></article><div class="comment-list"><article>a comment</article></div><div class="cookie-banner">c</div><div class="page-header">h</div>', ["Hello"]),
    ('<body><div class="sidebar layout"><p>the body of this page is long</p><div class="ad">buy</div></div>', ["the body of this page is long"]),
    ('<body><nav>long long long long long menu</nav><p>text</p>', ["text"]),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_cues_take_away_neither_the_article_nor_most_of_the_text(page, want):
    assert wrapper._page(page, lambda k: None) == want


def blocks_of(rng, n):
    return "<body>" + "".join("<div class='c'>" + "<p>a</p>" * rng.randrange(1, 6) + "</div>" for _ in range(n))


def test_ties_are_broken_alike_by_both_ways(monkeypatch):
    rng = random.Random(9)
    for _ in range(60):
        a, b = wrapper.parse(blocks_of(rng, rng.randrange(1, 25))), wrapper.parse(blocks_of(rng, rng.randrange(1, 25)))
        found = []
        for cells in (1, 7, 40_000):
            monkeypatch.setattr(wrapper, "DP_CELLS", cells)
            found.append(sorted((id(x), id(y)) for x, y in wrapper.match(a, b)))
        assert found[0] == found[1] == found[2]


def test_many_blocks_are_matched_at_once():
    import time

    plain = wrapper.parse("<body>" + "".join(f"<div class='c'><p>a{i}</p><p>b</p></div>" for i in range(1500)))
    rng, began = random.Random(2), time.time()
    assert len(wrapper.match(plain, plain)) == 1 + 1 + 1500 * 3
    assert time.time() - began < 1
    wrapper.match(wrapper.parse(blocks_of(rng, 1500)), wrapper.parse(blocks_of(rng, 1500)))
    assert time.time() - began < 4
