"""Main text of web pages by two-pass block rules.

The page is tokenized as HTML (quotes count only where an attribute's value begins) and
cut into blocks at block-level tags. The first pass gives every block points for what it is: its density of
stop words (-2 to 3), its length (1) and its link density (to -4). Where it stands is evidence of bounded weight: 2 inside an
article or main element, -3 outside the one that the page has, or in a menu, header, footer, sidebar, notice, advert, form or
comment section by element, role, class or the section's own heading. Blocks of 3 points or more are good, below 0 bad, and what
lies between is ambiguous. In the second pass ambiguous blocks that evidence speaks against are bad, the others
take the label of their nearest decided neighbours: that of both if they agree,
else of the nearer one, a heading that of the block it leads. Of a page with an article only blocks in it decide about others.

Where no block is good, the ambiguous ones inside an article are; without any, blocks are judged again by what they are,
whatever speaks against their place (a page that is one form); and if still none is good, paragraphs that nothing speaks against are.

A page on whose candidate blocks hardly any word is a stop word of the languages known here is judged by
length and links. Null html is an empty page, and gives an empty string. Unclosed comments end
with the page; a tag that the page's end cuts off is markup and goes. Repeated rows each
get their row; pages of any length are read whole, in time that grows with their length; an empty
table gives an empty one. Only page id, url and html of the input are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import _runtime as R

#: HTML's elements by how they lay out, and names that page furniture goes by.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
LEAF = set("p h1 h2 h3 h4 h5 h6 hr".split())
RAW = set("script style noscript template textarea title svg iframe object canvas audio video select button noframes xmp head".split())
FURNITURE = set("nav header footer aside form menu dialog fieldset".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status note".split())
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer foot header masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register paywall comment comments commentlist respond reply replies disqus feedback "
    "share sharing social related recommended recommendations widget widgets pagination pager legal copyright tagcloud search form outbrain taboola skip".split()
)
STOP = set(
    "the of and to in is that it was for on are as with be by at this have from or an not they which you "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se "
    "el los las y del que con no una por su para es al lo como más o pero sus".split()
)
#: Words that only say where or what kind of box something with one of NAMES is.
BOXES = set("site page main top bottom left right list box area section block blocks wrapper wrap container content item items link links post bar panel header inner outer group row col column unit slot text".split())
#: What a section of readers' comments is headed in the languages known here, with or without their number.
COMMENTS = re.compile(r"(?:\d+ )?(?:reader |user )?(?:comments?|kommentare?|commentaires?|comentarios?)(?: \(?\d+\)?)?:?", re.I)
SHORT, LONG, LOW, HIGH, LINKS = 70, 200, 0.08, 0.18, 0.4
GOOD, UNKNOWN, FOR, AGAINST = 3, 0.02, 2, -3

_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>)))?+)*+)>", re.S)
_CUT_OFF = re.compile(r"</?[a-zA-Z]")
_ATTR = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)))?+")
_ENDS: dict[str, re.Pattern] = {}


class Block:
    __slots__ = ("parts", "linked", "size", "inside", "furniture", "heading", "leaf", "text", "box")

    def __init__(self, inside: bool, furniture: bool, tag: str) -> None:
        self.parts: list[str] = []
        self.linked = self.size = 0
        self.inside, self.furniture, self.box = inside, furniture, 0
        self.heading, self.leaf = tag[:1] == "h" and tag in LEAF, tag in LEAF
        self.text = ""


def is_furniture(tag: str, attrs: str, inside: bool) -> bool:
    if tag in FURNITURE and not (tag == "header" and inside):
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id") and any(named(x) for x in value.split()):
            return True
        if name == "role" and value in ROLES or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value) or name == "hidden" and value != "false":
            return True
    return False


def named(token: str) -> bool:
    """Whether a class or id is furniture's name, as ad-box or site-footer; form-factor is not."""
    parts = [x for x in re.split(r"[^a-z0-9]+|(?<=[a-z])(?=\d)", token) if x]
    return not NAMES.isdisjoint(parts) and all(x in NAMES or x in BOXES or x[0].isdigit() for x in parts)


def blocks(html: str) -> tuple[list[Block], bool]:
    """The page's blocks that have text, and whether it has an article or main element."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []  # name, inside an article, furniture, number
    ends: dict[int, int] = {}  # of a container, the blocks there were when it closed
    made = 0
    inside = furniture = seen = False
    links = 0
    now = Block(False, False, "")

    def cut(tag: str = "") -> None:
        nonlocal now
        if now.size:
            out.append(now)
        now = Block(inside, furniture, tag)
        now.box = stack[-1][3] if stack else 0

    at, end = 0, len(html)
    while at < end:
        if html[at] == "<" and (m := _COMMENT.match(html, at)):
            at = m.end()
            continue
        m = _TAG.match(html, at) if html[at] == "<" else None
        if m is None:
            if _CUT_OFF.match(html, at):
                break
            stop = html.find("<", at + 1)
            stop = end if stop < 0 else stop
            chunk, at = html[at:stop], stop
            now.parts.append(chunk)
            n = len(chunk) - chunk.count(" ")
            if chunk.strip():
                now.size += n
                now.linked += n if links else 0
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "br":
                now.parts.append(" ")
            if tag not in BLOCK:
                continue
            if tag not in LEAF:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        if now.size:
                            cut()
                        ends.update((box, len(out)) for *_, box in stack[k:])
                        del stack[k:]
                        _, inside, furniture, _ = stack[-1] if stack else ("", False, False, 0)
                        links = 0
                        break
            cut()
        elif tag in RAW and not (tag == "head"):
            if not m[3].rstrip().endswith("/") or tag in ("script", "style"):
                e = _ENDS.setdefault(tag, re.compile(rf"</{tag}\s*(?:>|\Z)", re.I)).search(html, at)
                at = e.end() if e else end
        elif tag == "a":
            links = 1
        elif tag in ("br", "img", "input", "wbr"):
            now.parts.append("" if tag == "wbr" else " ")
        elif tag in BLOCK:
            if tag not in LEAF:
                if tag == "li" or tag in ("td", "th", "tr", "dt", "dd"):
                    links = 0
                core = tag in ("article", "main") or 'role="main"' in m[3]
                seen |= core and not furniture
                held = furniture and not (core and all(n == "form" or not f for n, _, f, _ in stack))
                inside, furniture = inside or core and not held, held or is_furniture(tag, m[3], inside)
                if m[3].rstrip().endswith("/") and tag not in ("html", "body", "div"):
                    _, inside, furniture, _ = stack[-1] if stack else ("", False, False, 0)
                else:
                    made += 1
                    stack.append((tag, inside, furniture, made))
                cut()
            else:
                links = 0
                cut("" if tag == "hr" else tag)
                if m[3] and is_furniture(tag, m[3], inside):
                    now.furniture = True
    if now.size:
        out.append(now)
    kept, until = [], 0
    for k, b in enumerate(out):
        b.text = " ".join(unescape("".join(b.parts)).split())
        if b.heading and b.box and COMMENTS.fullmatch(b.text):
            until = max(until, ends.get(b.box, len(out)))  # to the end of the section that it heads
        b.furniture |= k < until
        if b.text:
            kept.append(b)
    return kept, seen


def stop_words(text: str) -> tuple[int, int]:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP for w in words), len(words)


def evidence(b: Block, has_article: bool) -> int:
    """What a block's place says."""
    return AGAINST if b.furniture or has_article and not b.inside else FOR if b.inside else 0


def features(b: Block, stops: int, words: int, known: bool) -> int:
    """What the block itself says."""
    out = 0
    if len(b.text) >= SHORT:
        density = stops / words
        out += 3 if density >= HIGH else 2 if density >= LOW or not known else -2
        out += len(b.text) >= LONG
    return out - (2 if b.leaf else 4) * (b.linked > LINKS * b.size)


def judged(found: list[Block], has_article: bool, place: bool) -> list[int]:
    """Every block's points, with or without what its place says."""
    counts = [stop_words(b.text) for b in found]
    said = [evidence(b, has_article) for b in found]
    candidates = [c for b, c, e in zip(found, counts, said) if e >= 0 and b.linked <= LINKS * b.size] or counts
    known = sum(s for s, _ in candidates) >= UNKNOWN * sum(w for _, w in candidates)
    return [features(b, s, w, known) + (e if place else 0) for b, (s, w), e in zip(found, counts, said)]


def labels_of(points: list[int]) -> list[str]:
    return ["good" if p >= GOOD else "bad" if p < 0 else "short" for p in points]


def first_pass(found: list[Block], has_article: bool) -> list[str]:
    return labels_of(judged(found, has_article, True))


def second_pass(found: list[Block], labels: list[str], has_article: bool) -> list[str]:
    """Labels of all blocks; ambiguous ones look to the nearest decided ones before and after."""
    said = [evidence(b, has_article) for b in found]
    if "good" not in labels:
        if any(x == "short" and e > 0 for x, e in zip(labels, said)):
            labels = ["good" if x == "short" and e > 0 else x for x, e in zip(labels, said)]
        else:
            labels, said = labels_of(judged(found, has_article, False)), [0] * len(found)
            if "good" not in labels:
                return ["good" if x == "short" and b.leaf and evidence(b, has_article) >= 0 else "bad" for b, x in zip(found, labels)]
    decided = [i for i, x in enumerate(labels) if x == "good" or x == "bad" and not has_article]
    out, before = list(labels), None
    k = 0
    for i, x in enumerate(labels):
        while k < len(decided) and decided[k] <= i:
            before, k = decided[k], k + 1
        if x != "short":
            continue
        after = decided[k] if k < len(decided) else None
        if said[i] < 0 or before is None and not found[i].heading and not found[i].inside:
            out[i] = "bad"
        elif before is None or after is None:
            out[i] = labels[after if before is None else before]
        elif labels[before] == labels[after]:
            out[i] = labels[before]
        elif found[i].heading:
            out[i] = labels[after]
        else:
            out[i] = labels[before if i - before <= after - i else after]
    return out


def main_text(html: str) -> str:
    found, has_article = blocks(html)
    labels = second_pass(found, first_pass(found, has_article), has_article)
    return "\n".join(b.text for b, x in zip(found, labels) if x == "good")


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_blocks_kept of each page."""
    R.ship(pages.sparkSession)
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in R.pieces(batch, "h"):
                texts = [main_text(x or "") for x in b.column(2).to_pylist()]
                yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([x.count("\n") + bool(x) for x in texts], pa.int64())], names=["i", "u", "text", "n_blocks"])

    got = pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), F.col(html_col).cast("string").alias("h")).mapInArrow(run, f"i {kinds[id_col]}, u {kinds[url_col]}, text string, n_blocks long")
    return got.withColumnsRenamed({"i": id_col, "u": url_col})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_html_extraction": query}
