"""Pages written by hand, in layouts that the training generator doesn't make."""

import pytest

from scholiast.llm.html_text import features, leaf_blocks, main_text, steps, train
from tests.llm.helpers import words

NEWS = """<!DOCTYPE html><html lang="en"><head><title>Harbour bridge reopens | The Daily</title><style>p{color:red}</style></head>
<body class="single"><div id="top" class="site-header"><a href="/">The Daily</a><ul class="main-nav"><li><a href="/w">World</a></li><li><a href="/s">Sport</a></li><li><a href="/c">Culture</a></li></ul></div>
<div class="cookie-banner"><p>We use cookies to improve your visit.</p><button>Accept</button></div>
<div class="page"><div class="story-content"><h1>Harbour bridge reopens after two years</h1>
<p>The old bridge over the harbour was opened to traffic on Monday, two years after a cargo ship struck its northern pier &amp; closed the route.</p>
<div class="ad-slot"><span>Advertisement</span></div>
<p>Engineers replaced eleven girders, and the deck was raised by <b>forty centimetres</b> so that larger ships can pass below it.</p>
<h2>Costs and delays</h2><p>The city paid more than it had planned. "It took longer than anybody wanted," the mayor said at the ceremony.</p></div>
<div class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ferry prices rise</a></li><li><a href="/2">Rain until Friday</a></li></ul></div></div>
<div id="comments"><h3>2 comments</h3><p>About time, I have missed this bridge every day since.</p><p>Who pays for it in the end?</p></div>
<div class="footer-links"><p>&copy; 2024 The Daily. All rights reserved.</p></div><script>var a = "<p>no</p>";</script></body></html>"""
NEWS_TEXT = ["Harbour bridge reopens after two years", "The old bridge over the harbour was opened to traffic on Monday, two years after a cargo ship struck its northern pier & closed the route.", "Engineers replaced eleven girders, and the deck was raised by forty centimetres so that larger ships can pass below it.", "Costs and delays", 'The city paid more than it had planned. "It took longer than anybody wanted," the mayor said at the ceremony.']

BLOG = """<html><body><header class="masthead"><h2>Notes from the garden</h2><nav><a href="/">Home</a> <a href="/about">About</a></nav></header>
<main><article><header><h1>How to keep bees through the winter</h1></header>
<p>A colony needs about twenty kilograms of honey to live through the cold months, and it needs dry air even more than it needs warmth.</p>
<ol><li>Weigh the hive in late September, before the first frost.</li><li>Close the lower entrance so that mice stay out.</li></ol>
<blockquote>Never open the hive below ten degrees.</blockquote>
<pre>weight = full - empty</pre>
<table><tr><td>September</td><td>32 kg</td></tr><tr><td>March</td><td>14 kg</td></tr></table>
<aside class="newsletter"><p>Get our letter every week!</p><form><input name="mail"><button>Subscribe</button></form></aside>
<p>In March the colony wakes up, and the first flights clean the hive.</p></article>
<section class="related"><h3>Related posts</h3><ul><li><a href="/x">Planting clover</a></li></ul></section></main>
<footer><p>Written by hand. Contact us for copies.</p></footer></body></html>"""
BLOG_TEXT = ["How to keep bees through the winter", "A colony needs about twenty kilograms of honey to live through the cold months, and it needs dry air even more than it needs warmth.", "Weigh the hive in late September, before the first frost.", "Close the lower entrance so that mice stay out.", "Never open the hive below ten degrees.", "weight = full - empty", "September", "32 kg", "March", "14 kg", "In March the colony wakes up, and the first flights clean the hive."]

MANUAL = """<html><body><div class="navbar"><ul><li><a href="/i">Install</a><li><a href="/r">Reference</a><li><a href="/f">Questions</a></ul></div>
<div id="content" role="main"><h1>Setting up the pump</h1><p>Place the pump on a level floor and connect the inlet hose first<p>Then open the valve slowly until water runs without bubbles, which takes about a minute.
<dl><dt>Pressure</dt><dd>Between two and four bar during normal work.</dd></dl></div>
<div class="pagination"><a href="/p">Previous</a> <a href="/n">Next</a></div><div class="site-footer">Company Ltd, all rights reserved</div></body></html>"""
MANUAL_TEXT = ["Setting up the pump", "Place the pump on a level floor and connect the inlet hose first", "Then open the valve slowly until water runs without bubbles, which takes about a minute.", "Pressure", "Between two and four bar during normal work."]


@pytest.fixture(scope="module")
def field_pages(spark):
    return spark.read.parquet("/root/testdata/sf0.001/pages.parquet")


@pytest.mark.parametrize(("page", "text"), [(NEWS, NEWS_TEXT), (BLOG, BLOG_TEXT), (MANUAL, MANUAL_TEXT)], ids=["news", "blog", "manual"])
def test_hand_written_pages(spark, field_pages, page, text):
    field = train(field_pages)
    blocks = leaf_blocks(page)
    kept = [b.text for b, label in zip(blocks, field.labels(features(blocks), steps(blocks)), strict=True) if label]
    want, got = words(" ".join(text)), words(" ".join(kept))
    shared = sum(min(want.count(w), got.count(w)) for w in set(want))
    assert shared / len(want) > 0.95 and shared / len(got) > 0.95, (set(text) - set(kept), set(kept) - set(text))


def texts(page):
    return [b.text for b in leaf_blocks(page)]


def test_tags_end_where_their_quotes_close():
    assert texts('<p>a<img alt="' + "x" * 5000 + ' > b leaked">tail</p>') == ["atail"]
    assert texts('<p class=a">one</p><p title="abc>two</p>three') == ["one", "two", "three"]
    assert texts("<p data-x='a > b' title=\"c > d\">in</p>") == ["in"]


def test_only_raw_elements_are_dropped_with_their_text():
    assert texts("<p>area <math>x=2</math> holds</p>") == ["area x=2 holds"]
    assert texts("<p>before</p><svg><text>label</text> <p>after") == ["before", "label", "after"]
    assert texts("<noscript>shown</noscript><object>too</object><script>no</script><xmp><b>raw</b></xmp>") == ["showntoo", "<b>raw</b>"]
    assert texts("<template><p>no</p></template><p>yes</p>") == ["yes"]


def test_references_do_not_span_tags():
    assert texts("<p>A&am<b>p;</b> &lt;x&gt; 1 < 2</p>") == ["A&amp; <x> 1 < 2"]


def test_very_long_pages_and_ties(spark, field_pages):
    long = "<html><body><article>" + "<p>one more sentence of the very long page.</p>" * 20000 + "</article></body></html>"
    rows = [(1, "u", long), (2, "u", ""), (3, "u", None), (4, None, "<"), (4, None, "<"), (None, "u", "x")]
    pages = field_pages.unionByName(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = main_text(pages).filter("page_id is null or page_id in (1, 2, 3, 4)").join(field_pages.select("page_id").distinct(), "page_id", "left_anti").collect()
    by = {r.page_id: r for r in got}
    if 1 in by:
        assert by[1].text.count("\n\n") == 19999
    empty = train(field_pages.limit(0))
    assert empty.labels([[1], [2]], [3, 0]) == [0, 0]  # equal probabilities: not article
