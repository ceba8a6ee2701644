"""Blocks of a web page, their features, and the hand-labelled pages that a block classifier starts from."""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser
from typing import NamedTuple

# --- fixed values: names of HTML elements and roles, by what they mean for a page's text ---
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("audio button canvas datalist head iframe noscript object script select style svg template textarea title video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p blockquote pre dd figcaption".split())
ITEMS = frozenset("li td th dt option".split())
MAIN_TAGS, SIDE_TAGS = frozenset({"article", "main"}), frozenset("nav footer aside form menu dialog search".split())
MAIN_ROLES = frozenset({"main", "article"})
SIDE_ROLES = frozenset("navigation contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())

# --- fixed values: words of class and id names, by what they mean ---
MAIN_WORDS = frozenset("article articlebody content entry main post prose story text".split())
SIDE_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs byline comment commentlist comments consent cookie cookies copyright "
    "disqus footer form login menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion recommended "
    "related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe tags teaser toolbar topbar widget".split()
)
TOP_WORDS = frozenset({"header", "masthead", "head"})

#: Open elements that a start tag ends where nothing else did, and how far up they are looked for.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
}

NEUTRAL, MAIN, SIDE = 0, 1, 2


class Element(NamedTuple):
    """An open element: number, parent's number, tag, what its surroundings are, whether its text counts, hand-given label."""

    number: int
    parent: int
    tag: str
    place: int
    silent: bool
    label: int | None


class Block(NamedTuple):
    """A stretch of text between block boundaries."""

    text: str
    tag: str
    element: int
    parent: int
    place: int
    linked: int
    links: int
    label: int | None


def _words(value: str | None) -> set[str]:
    parts = re.sub(r"([a-z])([A-Z])", r"\1 \2", value or "")
    return set(re.split(r"[^a-z]+", parts.lower()))


def _place(tag: str, attributes: dict[str, str | None], above: int) -> int:
    """What an element says about its text: names and roles first, then the tag; else as what is above it."""
    if tag in ("html", "body"):
        return above
    role = (attributes.get("role") or "").strip().lower()
    names = _words(attributes.get("class")) | _words(attributes.get("id"))
    style = (attributes.get("style") or "").replace(" ", "").lower()
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style:
        return SIDE
    if role in SIDE_ROLES or tag in SIDE_TAGS or names & SIDE_WORDS:
        return SIDE
    if tag == "header" or role == "banner" or names & TOP_WORDS:
        # the head of an article belongs to it, that of a page does not
        return above if above != NEUTRAL else SIDE
    if above == SIDE and tag not in MAIN_TAGS and role not in MAIN_ROLES:
        return SIDE
    if tag in MAIN_TAGS or role in MAIN_ROLES or names & MAIN_WORDS:
        return MAIN
    return above


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[Element] = [Element(0, 0, "", NEUTRAL, False, None)]
        self.made, self.pieces, self.linked, self.links, self.anchor = 0, [], 0, 0, 0

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                at = self.open[-1]
                self.blocks.append(Block(text, at.tag, at.number, at.parent, at.place, min(self.linked, len(text)), self.links, at.label))
        self.pieces, self.linked, self.links = [], 0, 0

    def leave(self, depth: int) -> None:
        self.flush()
        del self.open[depth:]
        if self.anchor > depth:
            self.anchor = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.pieces.append(" ")
        if tag == "a":
            self.anchor = len(self.open)
            self.links += 1
        if tag in VOID_TAGS and tag != "hr" or tag not in BLOCK_TAGS and tag not in SILENT_TAGS:
            return
        if tag in BLOCK_TAGS:
            self.flush()
            if self.open[-1].tag == "p":
                self.leave(len(self.open) - 1)
            if tag in HEADINGS and self.open[-1].tag in HEADINGS:
                self.leave(len(self.open) - 1)
        ended, within = _ENDS.get(tag, ((), ()))
        for depth in range(len(self.open) - 1, 0, -1) if ended else ():
            if self.open[depth].tag in within:
                break
            if self.open[depth].tag in ended:
                self.leave(depth)
                break
        if tag == "hr":
            return
        above, given = self.open[-1], dict(attrs)
        self.made += 1
        label = given.get("data-content")
        place = _place(tag, given, above.place)
        silent = above.silent or tag in SILENT_TAGS
        self.open.append(Element(self.made, above.number, tag, place, silent, above.label if label is None else int(label)))

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.anchor = 0
        if tag not in BLOCK_TAGS and tag not in SILENT_TAGS:
            return
        if tag in BLOCK_TAGS:
            self.flush()
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                if tag in BLOCK_TAGS:
                    self.leave(depth)
                else:
                    del self.open[depth:]
                return
            if self.open[depth].tag in ("table", "html") and tag in ("p", "li"):
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1].silent:
            return
        self.pieces.append(data)
        if self.anchor:
            self.linked += len(data.strip())


def blocks_of(html: str | None) -> list[Block]:
    """The blocks of a page in page order, references decoded, white space within a block as one blank."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.blocks


#: Names of the features, in order.
FEATURES = ("length", "link_share", "links", "sentence_end", "commas", "heading", "prose", "item", "main", "side", "short", "near_links", "kin_text", "symbols")


def features(blocks: list[Block]) -> list[list[float]]:
    """One row of numbers for each block, from its text, links, tag, surroundings and neighbours."""
    share = [b.linked / len(b.text) for b in blocks]
    plain: dict[int, int] = {}
    for b in blocks:
        plain[b.parent] = plain.get(b.parent, 0) + len(b.text) - b.linked
    rows = []
    for i, b in enumerate(blocks):
        near = share[max(0, i - 1) : i] + share[i + 1 : i + 2]
        rows.append([
            min(math.log1p(len(b.text)), 8.0),
            share[i],
            min(math.log1p(b.links), 4.0),
            float(b.text[-1] in ".!?…。！？\"”»:"),
            min(math.log1p(b.text.count(",") + b.text.count(". ")), 4.0),
            float(b.tag in HEADINGS),
            float(b.tag in PROSE),
            float(b.tag in ITEMS),
            float(b.place == MAIN),
            float(b.place == SIDE),
            float(len(b.text) < 25),
            sum(near) / len(near) if near else 0.0,
            min(math.log1p(plain[b.parent]), 10.0),
            float(any(c in "©®|·»›" for c in b.text)),
        ])
    return rows


_LONG = (
    "The river rose through the night, and by the morning the lower fields were under water as far as the old mill.",
    "She had kept the letters for twenty years, tied with a ribbon, in a drawer that nobody else was allowed to open.",
    "Measurements were taken at four sites over two seasons; the differences between them were small, but they did not go away.",
    "Nobody at the meeting could say when the bridge had last been painted, or who had paid for it at the time.",
)
_SHORT = ("It worked.", "The results were clear.", "What happened next", "Three days later, the rain stopped.")

#: Hand-labelled pages: data-content tells what is the main text.
SEED_PAGES = tuple(
    page.format(*_LONG, *_SHORT)
    for page in (
        '<body><nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></nav><div class="ad">{1}</div><article data-content="1"><h1>{6}</h1>'
        "<p>{0}</p><p>{1}</p><p>{4}</p><h2>{7}</h2><p>{2} {3}</p><p>{5}</p></article><footer>&copy; example &middot; {3}</footer></body>",
        '<div id="top"><a href="/">News</a> | <a href="/b">Sport</a> | <a href="/c">Weather</a></div><div data-content="1"><h1>{6}</h1><p>{0} {1}</p><p>{2}</p><p>{7}</p>'
        '<p>{3} {0}</p></div><div><a href="/1">Previous</a> <a href="/2">Next</a></div><div>Copyright &copy; 2020 | <a href="/i">Imprint</a></div>',
        '<header class="masthead"><h1><a href="/">The Daily Example</a></h1><p>{7}</p></header><div class="wrap"><div class="post-content" data-content="1"><h2>{6}</h2><p>{2}</p><ul><li>{5}</li>'
        '<li>{0}</li></ul><p>{1} <a href="/x">{4}</a></p></div><div class="sidebar"><h3>Most read</h3><ul><li><a href="/m">{6}</a></li><li><a href="/n">{7}</a></li></ul><p>{3}</p></div></div>'
        '<div id="comments"><h3>2 comments</h3><p>{0}</p><p>{4} {2}</p></div><div class="cookie-notice">{1} <a href="/p">More</a></div>',
        '<table><tr><td><a href="/1">One</a><br><a href="/2">Two</a></td><td data-content="1"><p>{1} {2}</p><p>{0}</p><p>{3}</p><p>{4}</p></td></tr></table><p><a href="/t">Terms</a> &middot; <a href="/q">Contact</a></p>',
        '<main data-content="1"><section><h1>{6}</h1><p>{3} {0}</p><aside data-content="0"><h4>{7}</h4><p>{2}</p></aside><p>{5}</p><p>{1}</p></section>'
        '<section class="comments" data-content="0"><h2>{7}</h2><article class="comment"><p>{1}</p><p>{5}</p></article><form><label>Name</label><p>{2}</p></form></section></main><footer><p>{0}</p><ul><li><a href="/z">Imprint</a></li></ul></footer>',
        '<div data-content="1"><p>{0}</p><p>{2}</p><p>{5}</p><p>{1} {3}</p></div>',
    )
)
