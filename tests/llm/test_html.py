"""op4: the suffix array against a plain version with a dictionary of windows, and markup that class names, tags or length make hard."""

import time
from collections import defaultdict

import numpy as np
import pytest

html = pytest.importorskip("wardscribe.llm.html")


def plain(pages, least=html.RUN, frequent=html.FREQUENT):
    """unique_runs by sets of windows."""
    outside, inside = defaultdict(set), defaultdict(set)

    def windows(zone):
        t = [w for b in zone for w in ["|edge", *b.split()]]
        return t, [tuple(t[k : k + least]) for k in range(len(t) - least + 1)]

    articles = {"\n".join(p[0]) for p in pages if p[0]}
    for i, p in enumerate(pages):
        for z in (1, 2):
            for w in windows(p[z])[1]:
                outside[w].add(i)
        for w in windows(p[0])[1]:
            inside[w].add("\n".join(p[0]))
    out = []
    for p in pages:
        zones = []
        for z in (0, 1):
            t, ws = windows(p[z])
            gone = [False] * len(t)
            for k, w in enumerate(ws):
                hit = len(inside[w]) >= frequent and 2 * len(inside[w]) > len(articles) if z == 0 else len(outside[w]) > 1
                if hit:
                    gone[k : k + least] = [True] * least
            word = [x != "|edge" for x in t]
            if z == 0 and 2 * sum(g and x for g, x in zip(gone, word)) > sum(word):
                gone = [False] * len(t)
            kept, some = [], []
            for x, g in zip([*t, "|edge"], [*gone, False]):
                if x == "|edge":
                    kept, some = kept + [" ".join(some)], []
                elif not g:
                    some.append(x)
            zones.append([b for b in kept if b])
        out.append(zones)
    return out


def made_pages(rng, n):
    bits = [" ".join(f"b{k}w{j}" for j in range(rng.integers(5, 14))) for k in range(6)]
    pages = []
    for i in range(n):
        zones = []
        for _ in range(3):
            blocks = []
            for _ in range(rng.integers(0, 4)):
                words = [f"w{v}" for v in rng.integers(0, 40, rng.integers(1, 20))]
                blocks.append(" ".join(words))
            for k in rng.integers(0, 6, rng.integers(0, 3)):
                blocks.insert(int(rng.integers(0, len(blocks) + 1)), bits[k])
            zones.append(blocks)
        if rng.random() < 0.5 and pages:
            zones[0] = list(pages[rng.integers(0, len(pages))][0])
        pages.append(tuple(zones))
    return pages


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_the_plain_version(seed):
    rng = np.random.default_rng(seed)
    pages = made_pages(rng, int(rng.integers(1, 30)))
    assert html.unique_runs(pages) == plain(pages)


def shop_page(i, inside=""):
    return f'<html><head><title>T{i}</title></head><body><header>Shop of all things that one may ever need</header><article><h1>Item {i}</h1><p>{" ".join(f"own{i}x{j}" for j in range(30))}</p>{inside}</article></body></html>'


def test_templates_inside_articles_go(spark):
    """A line in most articles of a host goes, one in a few stays, an article that repeats whole stays, whatever the shards."""
    line = "<p>Join our list today and never miss a single word of ours</p>"
    few = "<p>To be or not to be that is the question here</p>"
    rows = [(i, f"http://h.org/{i}", shop_page(i, line + (few if i < 3 else ""))) for i in range(40)]
    rows += [(100 + i, f"http://copies.org/{i}", shop_page(7)) for i in range(30)]
    rows += [(200 + i, None if i % 2 else "/rel", shop_page(i, line)) for i in range(6)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_text(d).collect()}
    own = lambda i: f"Item {i} " + " ".join(f"own{i}x{j}" for j in range(30))
    assert all(got[i] == own(i) + (" To be or not to be that is the question here" if i < 3 else "") for i in range(40))
    assert all(got[100 + i] == own(7) for i in range(30))
    assert all(got[200 + i] == own(i) + " Join our list today and never miss a single word of ours" for i in range(6))
    assert {r.page_id: r.text for r in html.main_text(d, shard=9).collect()} == got
    assert {r.page_id: r.text for r in html.main_text(d, shard_bytes=4000).collect()} == got


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="site has-sidebar"><article class="post no-comments"><p>kept</article></div>', "kept"),
        ('<div class="layout-sidebar"><main>kept</main><div class="sidebar">gone</div></div>', "kept"),
        ('<article class="post with-comments">kept<div class="post-comments">gone</div></article>', "kept"),
        ('<main>kept</main><div id="comments"><article class="comment">gone</article></div>', "kept"),
        ("<header>gone</header><article><header><h1>Head</h1></header>kept<footer>gone</footer></article>", "Head kept"),
        ("<article>a<aside>gone</aside><nav>gone</nav>b</article>", "a b"),
        ("<p>one<div>two <b>thr</b>ee &eacute;&#8212;</div>", "one two three é—"),
        ("<article>a <noscript>gone</noscript><select><option>gone</select>b", "a b"),
    ],
)
def test_markup(page, text):
    ins, outs, _, seen = html.blocks(page)
    assert " ".join(ins if seen else outs) == text


def test_long_and_broken_pages_take_linear_time(spark):
    began = time.time()
    many = "<b>" * 80_000 + "</i>" * 80_000 + "<i><div>" + "<b>" * 40_000 + "</i>" * 40_000 + "<p>" * 40_000
    long = " ".join(f"w{k}" for k in range(150_000))
    rows = [(1, "http://l.org/a", f"<article>{long}</article>"), (2, "http://l.org/b", f"<p>{long}</p>"), (3, "http://l.org/c", many + "end"), (4, "http://l.org/d", f"<p>{long} tail</p>")]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: long, 2: "", 3: "end", 4: "tail"}
    assert time.time() - began < 60
