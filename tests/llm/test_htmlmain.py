import itertools
import random
import time

import numpy as np
import pytest
from tokenloom.llm import htmlmain as hm

PARA = "This is a paragraph with a good number of plain words in it, as articles have them."


def test_article_among_everything_else():
    page = f"""<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";x(1)</script></head><body class="has-sidebar">
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-notice"><p>{PARA}</p></div><div class="ad">{PARA}</div>
<article><header><h1>Head &amp; line</h1></header><p>{PARA}<p>Short one.<br>Next&nbsp;line<p><b>{PARA}</b> with <a href="x">a link</a>.
<form><label>Name</label><input><button>Send</button></form><div class="share"><a>Share</a></div>
<section class="comments"><p>{PARA} I disagree.</p></section></article>
<aside><p>{PARA}</p></aside><footer>&copy; site</footer></body></html>"""
    assert hm.main_text(page) == f"Head & line\n\n{PARA}\n\nShort one. Next line\n\n{PARA} with a link."


@pytest.mark.parametrize("name", ["comments", "post-comments", "comment-body", "articleComments", "related-content", "newsletter-text", "main-menu", "ad", "cookie-content"])
def test_boilerplate_by_name_within_an_article(name):
    assert hm.main_text(f"<article><h1>Title</h1><p>{PARA}</p><div class='{name}'><p>{PARA} {PARA}</p></div><p>End.</p></article>") == f"Title\n\n{PARA}\n\nEnd."


@pytest.mark.parametrize("name", ["article-header", "entry-header", "story-body", "content", "lead"])
def test_article_parts_by_name(name):
    assert hm.main_text(f"<article><div class='{name}'><h1>Title</h1><p>{PARA}</p></div><p>End.</p></article>") == f"Title\n\n{PARA}\n\nEnd."


def test_without_article_element():
    page = f"<div id=wrap><div class=menu><a href=1>One</a> <a href=2>Two</a></div><div class=content><p>{PARA}</p><p>Yes.</p><p>{PARA}</p></div><div class=comments><p>{PARA}</p></div></div>"
    assert hm.main_text(page) == f"{PARA}\n\nYes.\n\n{PARA}"


@pytest.mark.parametrize("page", ["", "   ", "<", "<p", "&am", "<article><p>a &lt b &#233; &unknown; &amp</article", "<script>never ends", "</p></div>" * 50, "<div>" * 3000 + "x"])
def test_broken_pages_do_not_fail(page):
    assert isinstance(hm.main_text(page), str)


WRAPPED = f"<article><h1>Title</h1><p>{PARA}</p><p>Short.</p></article>"


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='layout has-sidebar'>{WRAPPED}</div>",
        f"<div class='no-comments'>{WRAPPED}</div>",
        f"<div class='sidebar-right'><div class=ad>{PARA}</div>{WRAPPED}</div>",
        f"<form id=aspnetForm><input><label>Find</label>{WRAPPED}<button>Go</button></form>",
        f"<nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul>{WRAPPED}<footer>Foot</footer>",
        f"<div class=overlay><aside><p>{PARA}</p></aside>{WRAPPED}</div>",
        f"<div role=main class=modal><h1>Title</h1><p>{PARA}</p><p>Short.</p></div>",
        f"{WRAPPED}<div class=comments><article class=comment><p>{PARA}</p></article><article><p>Me too.</p></article></div>",
        f"<article><form><h1>Title</h1><p>{PARA}</p><p>Short.</p></form></article>",
    ],
)
def test_wrappers_do_not_lose_the_article(page):
    assert hm.main_text(page) == f"Title\n\n{PARA}\n\nShort."


def test_a_form_around_a_page_without_an_article():
    assert hm.main_text(f"<form><div class=content><p>{PARA}</p><p>{PARA}</p></div></form>") == f"{PARA}\n\n{PARA}"


def test_names_that_only_seem_to_be_boilerplate():
    assert hm.main_text(f"<article><p>{PARA}</p><p class='share-price'>Up by two in the hundred.</p><p class='no-ads'>Yes.</p></article>") == f"{PARA}\n\nUp by two in the hundred.\n\nYes."


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x y z", "<ul>" + "<div>" * 30_000 + "<li>x" * 30_000, "<nav>" * 50_000 + f"<article><p>{PARA}", "".join(f"<div><p>{PARA}</p>" for _ in range(5_000)), f"<p>{PARA}</p><p>x</p>" * 8_000, "<b>" * 50_000 + "</i>" * 50_000 + "x"])
def test_time_is_linear_in_depth_and_length(page):
    began = time.process_time()
    hm.main_text(page)
    assert time.process_time() - began < 20


def test_a_fitted_model_tells_text_from_links(spark):
    links = "<div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div>"
    rows = [(k, f"{links}<div>Imprint</div><article><h1>A title {k}</h1><p>{PARA}</p><p>{PARA} {PARA}</p></article>{links}<div>All rights</div>") for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    weights = hm.fit(pages)
    assert len(weights) == len(hm.FEATURES) and not np.array_equal(weights, hm.FIXED)
    assert hm.main_text(f"<body>{links}<div><p>{PARA}</p><p>{PARA}</p></div>{links}</body>", weights) == f"{PARA}\n\n{PARA}"
    assert np.array_equal(hm.fit(pages.repartition(7)), weights) and np.array_equal(hm.fit(pages.limit(0)), hm.FIXED)
    assert len(hm.fit(pages, most=5)) == len(hm.FEATURES)


def test_references():
    assert hm.main_text("<article><p>a &lt; b &#233; &eacute; &amp;amp;</p></article>") == "a < b é é &amp;"


def test_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 7)
        source, sink = [rng.randint(0, 9) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        edges = [(a, b, rng.randint(0, 6)) for a in range(n) for b in range(a) if rng.random() < 0.5]
        net = hm.FlowNetwork(n + 2)
        for k in range(n):
            net.add(n, k, source[k])
            net.add(k, n + 1, sink[k])
        for a, b, c in edges:
            net.add(a, b, c, c)
        cost = lambda side: sum(sink[k] if side[k] else source[k] for k in range(n)) + sum(c for a, b, c in edges if side[a] != side[b])
        assert cost(net.source_side(n, n + 1)[:n]) == min(map(cost, itertools.product([False, True], repeat=n)))


def test_pages(spark):
    rows = [(1, "u", f"<article><p>{PARA}</p></article>", "c"), (2, None, None, "c"), (3, "u", "", "c"), (None, "u", f"<article>{PARA}</article>", None), (1, "u", f"<article><p>{PARA}</p></article>", "c"), (5, "u", "<article>" + f"<p>{PARA}</p>" * 3000 + "</article>", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = hm.extract(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[None] == PARA and by[2] == by[3] == "" and by[5].count("\n\n") == 2999
    assert hm.extract(df.limit(0)).count() == 0


def test_controls_in_a_sentence_are_words_of_it():
    assert hm.main_text(f"<article><p>Use <label>here</label> and <button>there</button>.</p><p>{PARA}</p></article>") == f"Use here and there.\n\n{PARA}"
    assert hm.main_text(f"<article><p>{PARA}</p><button>Share</button><form><p>Your <label>name</label></p></form><label>Name</label></article>") == PARA


def test_teasers_beside_the_article_are_not_text():
    other = f"<h2>Other</h2><p>{PARA} {PARA} {PARA}</p>"
    assert hm.main_text(f"{WRAPPED}<section class='more'><article><h2>More</h2><p>Read this too.</p></article></section>") == f"Title\n\n{PARA}\n\nShort."
    assert hm.main_text(f"<article>{other}</article><article>{other}<p>Shorter.</p></article>").count("Other") == 2


def decided(page, weights=hm.FIXED):
    """(text, label by the sign of the score, label by the cut) of each block."""
    read = hm.read(page)
    return [(b.text, z > 0, kept) for b, z, kept in zip(read.found, hm.scores(read, weights), hm.label(read, weights), strict=True)]


def test_the_cut_decides_where_a_block_is_unsure():
    lines = decided(f"<div><p>{PARA}</p><p>{PARA}</p><div>Onwards</div><p>{PARA}</p><p>{PARA}</p></div>")
    assert lines[2] == ("Onwards", False, True) and all(kept for *_, kept in lines)
    links = "".join(f"<li><a href=/{k}>Link number {k}</a></li>" for k in range(4))
    lines = decided(f"<ul>{links}<li>More on this</li>{links}</ul>", np.array([-1.0, 1.1, -3.5, 0.8, 0.0, 0.0]))
    assert lines[4] == ("More on this", True, False) and not any(kept for *_, kept in lines)
    # within an article: a line of links alone is let go, one between paragraphs stays
    lines = decided(f"<article><p>{PARA}</p><p><a href=1>See the whole table</a></p><p>{PARA}</p></article>")
    assert [kept for *_, kept in lines] == [True, True, True] and not lines[1][1]
