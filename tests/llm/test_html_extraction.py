from __future__ import annotations

import re
from html import unescape

import pytest

from tidemill.llm import html_extraction as H

LONG = "This is the text of the page and it is long, with many of the words that are in all texts."
CASES = [
    (None, ""), ("", ""), ("plain text only", ""), ("<p></p>", ""), ("<", ""), ("<article>a < b &amp; c&#33; &nbsp; d</article>", "a < b & c! d"),
    (f"<nav>x</nav><article><h1>T</h1><p>{LONG}<br>more<p>end</article><footer>{LONG}</footer>", f"T\n{LONG} more\nend"),
    (f"<main><p>{LONG}</p><aside>{LONG}</aside><div class='ad-box'>{LONG}</div><form><p>{LONG}</p></form><section id=comments><p>{LONG}</p></section><p>tail</p></main>", f"{LONG}\ntail"),
    (f"<div class='cookie-notice'>{LONG}</div><h2>Head</h2><div>{LONG}</div><p>short</p><div>{LONG}</div><ul><li><a href=x>one</a><li><a href=y>two</a></ul>", f"Head\n{LONG}\nshort\n{LONG}"),
    (f"<article><script>var t=\"</p>\";</script><style>p{{}}</style><!-- <p>no</p> --><p>{LONG}</p></article", LONG),
    (f"<article><p>{LONG} cut off &am", f"{LONG} cut off &am"), (f"<article><p>{LONG}</p><scr", LONG), (f"<article><p>{LONG}<script>never closed {LONG}", LONG),
    (f"<ARTICLE><P>{LONG}</P><p hidden>{LONG}</p><div role=navigation>{LONG}</div></ARTICLE>", LONG),
    (f"<article><p title=don't>{LONG}</p><p>it's {LONG}</p></article>", f"{LONG}\nit's {LONG}"), (f"<article><!--><p>{LONG}</p><!-- x --!><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
    (f"<article><p>{LONG}</p><p><a href=x>the whole of this paragraph is a link to what it is of</a></p><a href=y><div>{LONG}</div></a><p class='form-factor'>{LONG}</p><div id=\"tags-explained\">{LONG}</div></article>",
     f"{LONG}\nthe whole of this paragraph is a link to what it is of\n{LONG}\n{LONG}\n{LONG}"),
    ("<nav>\u30e1\u30cb\u30e5\u30fc</nav><div>" + "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0" * 40 + "</div>", "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0" * 40), (f'<article><p data-x="a > b" / title=\'c>d\'>{LONG}</p></article>', LONG),
    (f"<div>{LONG} {LONG} {LONG}</div><div>{'nostop ' * 40}</div><div><a href=x>{LONG} {LONG}</a></div>", f"{LONG} {LONG} {LONG}"),
    ("<a>" * 3000 + "x" + "</div>" * 3000, ""), ("<div>" * 2000 + "<article>deep" , "deep"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_case(html, text):
    assert H.main_text(html or "") == text


def test_rules_decide_in_articles():
    """Inside an article stop words, length and links still part what is text from what isn't."""
    found, has = H.blocks(f"<article><p>{LONG}</p><ul><li><a href=a>one</a><li><a href=b>two</a></ul><div>short</div><p>{LONG}</p></article>")
    assert has and H.first_pass(found, has) == ["good", "bad", "bad", "short", "good"]
    found, has = H.blocks(f"<div>{'nostop ' * 40}</div><p>{LONG} {LONG} {LONG}</p>")
    assert not has and H.first_pass(found, has) == ["bad", "good"]


def test_very_long_page():
    html = "<article>" + f"<p>{LONG} &amp;</p>" * 30000 + "<p x='" * 2000
    text = H.main_text(html)
    assert text.startswith("\n".join([f"{LONG} &"] * 30000))


def test_pages(spark):
    """Against the article element's blocks, which are the main text of these pages."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {r.page_id: r for r in H.extracted(pages).collect()}
    for r in pages.collect():
        body = r.html[r.html.find("<article>") :].split("</article>")[0]
        body = re.sub(r"</?(p|h1|article)>", "\n", re.sub(r"<br>", " ", body))
        lines = [" ".join(unescape(x).split()) for x in re.sub(r"<[^>]*>?", "", body).split("\n")]
        assert rows[r.page_id].text == "\n".join(x for x in lines if x)
    odd = spark.createDataFrame([(1, None, None, "t"), (1, None, None, "t"), (None, "u", f"<article>{LONG}", "t")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in H.extracted(odd).collect()) == [(0, LONG), (1, ""), (1, "")]
    assert H.extracted(pages.limit(0)).count() == 0


POLISH = "Wczoraj wieczorem mieszkańcy miasta zobaczyli niezwykłe zjawisko świetlne nad rzeką. " * 2
PLACES = [
    (f"<body><form><div><p>{LONG} {LONG}</p></div></form></body>", f"{LONG} {LONG}"),
    (f"<nav><a href=x>the home of it</a> <a href=y>and the news</a></nav><article><p>{POLISH}</p><p>Nikt nie potrafi tego do dziś wyjaśnić.</p></article>", f"{POLISH.strip()}\nNikt nie potrafi tego do dziś wyjaśnić."),
    (f"<div class='side'><p>{LONG} {LONG} {LONG}</p></div>", f"{LONG} {LONG} {LONG}"), ("<p>Short note only.</p>", "Short note only."),
    (f"<main><p>{LONG}</p><section class='reviews'><p>{LONG} {LONG} {LONG}</p></section></main>", f"{LONG}\n{LONG} {LONG} {LONG}"),
    (f"<article><p>{LONG}</p></article><section><h2>3 Comments</h2><article><p>{LONG}</p></article></section>", LONG),
    (f"<article><p>{LONG}</p><div><h3>Kommentare (2)</h3><p>{LONG}</p></div><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
    (f"<div class='sidebar'><p>{LONG} {LONG} {LONG}</p></div><p>{LONG} {LONG} {LONG}</p>", f"{LONG} {LONG} {LONG}"),
    (f"<div class='sidebar'><p>{LONG} {LONG} {LONG}</p></div><p>{'nostop ' * 40}</p><p>that is for you</p>", f"{LONG} {LONG} {LONG}"),
]


@pytest.mark.parametrize("html,text", PLACES)
def test_place_is_only_evidence(html, text):
    assert H.main_text(html) == text


def brute(found: list) -> list[str]:
    """The two passes over blocks whose place says nothing, every neighbour looked for anew."""
    counts = [(sum(w.strip(".,;:!?\"'()") in H.STOP for w in b.text.lower().split()), len(b.text.split())) for b in found]
    linked = [b.linked > 0.4 * b.size for b in found]
    known = sum(s for (s, _), x in zip(counts, linked) if not x) >= 0.02 * sum(w for (_, w), x in zip(counts, linked) if not x)
    labels = []
    for b, (s, w), x in zip(found, counts, linked):
        p = -(2 if b.leaf else 4) if x else 0
        if len(b.text) >= 70:
            p += (3 if s >= 0.18 * w else 2 if s >= 0.08 * w or not known else -2) + (len(b.text) >= 200)
        labels.append("good" if p >= 3 else "bad" if p < 0 else "?")
    out = []
    for i, x in enumerate(labels):
        if x == "?":
            before = next((k for k in range(i - 1, -1, -1) if labels[k] != "?"), None)
            after = next((k for k in range(i + 1, len(labels)) if labels[k] != "?"), None)
            near = [k for k in (before, after) if k is not None]
            if before is None and not found[i].heading:
                x = "bad"
            elif len(near) == 1:
                x = labels[near[0]]
            elif found[i].heading:
                x = labels[after]
            else:
                x = labels[before if i - before <= after - i else after]
        out.append(x)
    return out


def test_pages_without_their_marks(spark):
    """Tags and classes that name the article or the furniture gone: blocks are judged by the rules alone, and most of the text is still found."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    found_chars = all_chars = given = by_rules = 0
    for r in pages:
        want = set(H.main_text(r.html).split("\n"))
        html = re.sub(r"<(/?)(article|nav|footer|header|aside|main)\b[^>]*>", r"<\1div>", re.sub(r' class="[^"]*"', "", r.html))
        blocks, has_article = H.blocks(html)
        assert not has_article and not any(b.furniture for b in blocks)
        got = H.main_text(html)
        labels = brute(blocks)
        if "good" in labels:
            by_rules += 1
            assert got == "\n".join(b.text for b, x in zip(blocks, labels) if x == "good")
        lines = set(got.split("\n"))
        found_chars, all_chars, given = found_chars + sum(map(len, want & lines)), all_chars + sum(map(len, want)), given + sum(map(len, lines))
    assert by_rules > 200 and found_chars > 0.9 * all_chars and found_chars > 0.85 * given
