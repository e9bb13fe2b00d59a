"""Pages in layouts that no generated page has: none is lost, and hostile ones take time in proportion."""

import time

import pytest

from seamline.llm import html_text

A = "The river reached its highest level since 1974 on Monday. Crews worked through the night to raise the walls."
B = "Schools in three villages stayed closed, the council said. They will open again on Thursday if the water falls."
C = "No one was hurt, and the trains were running again by noon."
NAV = '<a href="/">Home</a> <a href="/n">News</a> <a href="/s">Sport</a>'
FOOT = "&copy; 2020 Daily Planet. All rights reserved."

#: (page, main text in blocks, words that must not be found)
LAYOUTS = [
    (f"<article><p>{A}</p><p>{B}</p></article>", [A, B], []),
    (f"<nav>{NAV}</nav><article><p>{A}</p><p>{B}</p></article><footer>{FOOT}</footer>", [A, B], ["Sport", "rights"]),
    (f"<div id=content>{A}<br>{B}<br>{C}</div>", [A, B, C], []),
    (f"{A} {B}", [A + " " + B], []),
    (f'<div class="main-content with-sidebar"><h1>River rises</h1><p>{A}</p><p>{B}</p></div>', ["River rises", A, B], []),
    (f"<p>{A}</p>", [A], []),
    (f"<html><body>{A}<p>{B}<p>{C}</body></html>", [A, B, C], []),
    (f'<body class="page with-sidebar"><div class="layout sidebar-right"><ul class=menu><li>{NAV}</ul><div class="content"><p>{A}</p><p>{B}</p></div><div class="sidebar"><h4>Popular</h4><ul><li><a href=1>Storms</a></ul></div></div>', [A, B], ["Storms", "Sport"]),
    (f'<div class="site-header-fixed site"><header><div>Daily Planet</div></header><div class="post"><h2>River rises</h2><p>{A}</p><p>{B}</p></div><footer><p>{FOOT}</p></footer></div>', ["River rises", A, B], ["rights"]),
    (f"<table><tr><td>{NAV}</td></tr><tr><td><p>{A}<p>{B}</td></tr><tr><td><font size=1>{FOOT}</font></td></tr></table>", [A, B], ["Sport"]),
    (f'<div class="cookie-banner"><p>We use cookies on this site.</p><button>Fine</button></div><main><p>{A}</p><p>{B}</p><p>{C}</p></main>', [A, B, C], ["cookies"]),
    (f'<section id=story><h1>River rises</h1>{A}<br><br>{B}<br><br>{C}</section><section class=comments><h3>Comments</h3><div><b>Ann</b><p>I have seen this coming.</p></div></section>', ["River rises", A, B, C], ["coming"]),
    (f'<div><div><div><p>{A}</p></div><div><p>{B}</p></div></div></div><div class="footer">{FOOT}</div>', [A, B], ["rights"]),
    (f'<div class="col-md-8 blog-main"><h2>River rises</h2><p>{A}</p><blockquote>{C}</blockquote><p>{B}</p></div><div class="col-md-4 sidebar"><h4>About</h4><p>A blog on rivers.</p></div>', ["River rises", A, C, B], ["blog on"]),
    (f'<header><h1>Daily Planet</h1><nav><ul><li>{NAV}</ul></nav></header><article class="no-sidebar"><header><h1>River rises</h1></header><p>{A}</p><p>{B}</p></article>', [A, B], ["Sport"]),
    (f'<div id="page" class="hfeed site"><div id="masthead" class="site-header"><a href=/>Planet</a></div><div id="primary" class="content-area has-sidebar"><p>{A}</p><p>{B}</p><p>{C}</p></div></div>', [A, B, C], ["Planet"]),
    (f"<body><center><font size=5>River rises</font></center><font face=arial>{A}</font><p><font>{B}</font><p>{C}<hr><font size=1><a href=/>Back</a></font></body>", [A, B, C], []),
    (f'<div class="newsletter-signup"><p>Get our news.</p><form><input><button>Sign up</button></form></div><div class="entry-content"><p>{A}</p><p>{B}</p></div>', [A, B], ["Sign up"]),
    (f"<main><ol><li>{A}</li><li>{B}</li><li>{C}</li></ol></main><aside><p>Also read this story.</p></aside>", [A, B, C], ["Also read"]),
    (f'<div class="wrapper header-dark"><nav class="navbar"><ul><li>{NAV}</ul></nav><div class="story"><p><b>{A}</b></p><p>{B}</p></div><div class="ads"><p>Buy a boat today.</p></div></div>', [A, B], ["boat", "Sport"]),
]


def extracted(page: str) -> str:
    blocks = html_text.blocks_of(page)
    return " ".join(b[0] for b, y in zip(blocks, html_text.trained().viterbi([html_text.features_of(blocks)])[0]) if y)


def test_no_layout_is_lost():
    found = wanted = 0
    lost, wrong = [], []
    for k, (page, main, never) in enumerate(LAYOUTS):
        text = extracted(page)
        hits = sum(len(m) for m in main if m in text)
        found, wanted = found + hits, wanted + sum(map(len, main))
        if not text:
            lost.append(k)
        wrong += [(k, w) for w in never if w in text]
    assert not lost and found >= 0.9 * wanted, (lost, found, wanted)
    assert len(wrong) <= 2, wrong


@pytest.mark.parametrize(
    "page",
    ["<a " * 333_333, '<p a="' * 170_000, "<div>" * 100_000 + "</p>" * 100_000, "<x>" * 150_000 + "<hr>" * 120_000, '<p ">"' * 160_000 + '"', "<p><svg>" + "<x>" * 150_000 + "<hr>" * 120_000, "<script>" * 120_000, "<p '" * 250_000 + ">", "<li>" * 250_000, "&" * 1_000_000, "<" * 1_000_000],
    ids=["open tags", "open quotes", "ends without beginnings", "unknown tags", "quoted ends", "skipped tags", "scripts", "odd quotes", "items", "ampersands", "less-than"],
)
def test_hostile_pages_of_a_megabyte(page):
    began = time.process_time()
    html_text.features_of(html_text.blocks_of(page))
    half = time.process_time()
    html_text.features_of(html_text.blocks_of(page[: len(page) // 2]))
    whole, part = half - began, time.process_time() - half
    assert whole < 4 and (whole < 0.5 or whole < 3.5 * part)  # 2 s on an ordinary machine


def test_scanner_edges():
    texts = lambda page: [b[0] for b in html_text.blocks_of(page)]
    assert texts('<p title="a > b">one</p><p title="never closed>two</p>three') == ["one", "two", "three"]
    assert texts("<p>one <!-- two > --> three <!-- four") == ["one three"]
    assert texts("a &#" + "1" * 5000 + "; &#x0000041; &#0000000066; b") == ["a � A B b"]
    assert texts("<p>1 < 2 <3 and a<b") == ["1 < 2 <3 and a<b"]
    assert texts("<svg><title/><desc>no</desc></svg><p>yes") == ["yes"]
    assert texts("x<textarea>no</textarea>y<title>no") == ["x", "y"]
    assert html_text.unescaped("&amp;lt;") == "&lt;"
