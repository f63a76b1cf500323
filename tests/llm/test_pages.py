"""Pages written by hand, unlike those that the labeller is trained on: what is article and what is not."""

import html
import random

import pytest

from wirescore.llm import html_extract

PROSE = [
    "The river rose in the night and by morning the lower fields stood under water.",
    "Farmers had moved the cattle to the hill two days before, when the first warnings came.",
    "Nobody was hurt, the council said, although three roads will stay closed until Friday.",
    "Repairs to the old bridge are expected to take most of the summer.",
]

#: (page, blocks of the article, in order).
PAGES = [
    (f"<table width=100%><tr><td class=nav><a href=/>Home</a> | <a href=/n>News</a> | <a href=/s>Sport</a></td></tr><tr><td><h2>Flood</h2><p>{PROSE[0]}</p><p>{PROSE[1]}</p><p>{PROSE[2]}</p></td></tr><tr><td class=footer>Copyright 2019 The Paper</td></tr></table>", ["Flood", *PROSE[:3]]),
    (f'<div id="mw-head"><ul><li><a>Read</a></li><li><a>Edit</a></li></ul></div><div class="mw-parser-output"><p>{PROSE[0]}</p><h2>History</h2><p>{PROSE[1]} <a href="/x">See more</a>.</p><p>{PROSE[3]}</p></div><div id="catlinks" class="catlinks"><a>Categories</a>: <ul><li><a>Mammals</a></li><li><a>Rivers</a></li></ul></div><div id="footer">This page was last edited on 3 May.</div>', [PROSE[0], "History", PROSE[1] + " See more.", PROSE[3]]),
    (f'<header class="site-header"><a href="/">My blog</a></header><article><h1>A wet week</h1><div class="entry-content"><p>{PROSE[0]}</p><ul><li><a href="/a">The first warning came from upstream villages.</a></li><li>{PROSE[2]}</li></ul><p>{PROSE[3]}</p></div></article><div class="comments"><div class="comment-body"><p>Great post, thanks!</p></div><div class="comment-body"><p>I agree with the first reply.</p></div></div><footer>Powered by nothing</footer>', ["A wet week", PROSE[0], "The first warning came from upstream villages.", PROSE[2], PROSE[3]]),
    (f'<nav><ul><li><a>Docs</a></li><li><a>API</a></li></ul></nav><main><h1>Gauges</h1><p>{PROSE[1]}</p><pre><code>read_gauge --station 4</code></pre><dl><dt>Station</dt><dd>The place where the level of the river is measured.</dd></dl><p>{PROSE[2]}</p></main><aside class="sidebar"><h3>Related</h3><ul><li><a>Install</a></li></ul></aside>', ["Gauges", PROSE[1], "read_gauge --station 4", "Station", "The place where the level of the river is measured.", PROSE[2]]),
    (f'<div class="cookie-consent">We use cookies to improve this site. <button>Accept</button></div><div class="story"><h1>Water</h1><p>{PROSE[0]}</p><div class="advert">Buy two boots, get one free!</div><p>{PROSE[1]}</p><blockquote>{PROSE[2]}</blockquote></div><form><label>Email</label><button>Subscribe</button></form>', ["Water", *PROSE[:3]]),
    (f'<ul class="menu"><li><a>Start</a></li><li><a>Kontakt</a></li></ul><div id="content"><h1>Hochwasser</h1><p title=it\'s>{PROSE[3]}</p><p>Tom &amp; Anna&#39;s&nbsp;field,\n under   water.</p><select><option>unclosed<p>{PROSE[0]}</p></div><div id="footer">Impressum</div>', None),
]


def test_hand_written_pages():
    net = html_extract.train()
    right = total = 0
    for page, want in PAGES[:-1]:
        found = html_extract.blocks(page)
        kept = html_extract.label(net, [found])[0] > 0.5
        right += sum(k == (b.text in want) for k, b in zip(kept, found))
        total += len(found)
        assert [b.text for b in found if b.text in want] == want
    print(f"\nblocks labelled right: {right} of {total}")
    assert right / total >= 0.9


def test_markup_does_not_leak_and_text_is_not_lost():
    texts = [b.text for b in html_extract.blocks(PAGES[-1][0])]
    assert PROSE[3] in texts and PROSE[0] in texts and "Tom & Anna's field, under water." in texts
    for name in ("object", "select", "noscript", "iframe", "canvas", "template", "svg"):
        assert [b.text for b in html_extract.blocks(f"<p>a</p><{name}><p>b</p>")] == ["a", "b"]
        assert [b.text for b in html_extract.blocks(f"<p>a</p><{name} x='>'>c</{name}><p>b</p>")] == ["a", "b"]
    assert [b.text for b in html_extract.blocks("<object>x<object>y</object>z</object><p>b <math><mi>x</mi></math></p>")][-1] == "b x"
    assert [b.text for b in html_extract.blocks("<p>a</p><script>if (a < b) {'</p>'}")] == ["a"]
    for page in ("", "<", "<p", "a < b > c", "<p class='", "</p></p>", "&#0;&bogus;", "<a <b>x"):
        html_extract.blocks(page)


def test_blocks_match_a_plain_reading():
    """White space, references and order, against text built alongside the page."""
    rng = random.Random(6)
    for _ in range(200):
        page, want = [], []
        for _ in range(rng.randint(0, 8)):
            words = ["".join(rng.choice("ab&<é\"'") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 5))]
            inner = rng.choice([" ", "\n\t ", "&nbsp;", "<br>", " <b></b> "]).join(html.escape(w) if rng.random() < 0.7 else f"<i>{html.escape(w)}</i>" for w in words)
            page.append(rng.choice(["<p>{}</p>", "<div class=\"x y\">{}</div>", "<li data-a='>'>{}", "<!-- c --><h3>{}</h3>"]).replace("{}", inner))
            want.append(" ".join(words))
        assert [b.text for b in html_extract.blocks("".join(page))] == want


@pytest.mark.parametrize("page", ["<div>" * 30_000 + "x" + "</div>" * 30_000, "<p>word</p>" * 40_000, "<p>" + "long text " * 200_000])
def test_large_pages(page):
    net = html_extract.train()
    text = html_extract.main_texts(net, [page])[0]
    assert isinstance(text, str) and len(html_extract.blocks(page)) in (1, 40_000)
