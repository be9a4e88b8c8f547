"""One page of HTML as a stream of tokens: tags with their place in the tree
and blocks of text."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import xxhash

#: fixed values: element kinds of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe object title".split())
#: elements of other vocabularies: all inside them stands in the line
FOREIGN = frozenset("svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr br img".split())
#: an opening tag of the key ends an open element of these names
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
#: closing tags look no further out than these, a tag that ends an open paragraph than those
SCOPE = frozenset("table td th body html article main section nav aside footer header".split())
BARRIER = SCOPE | frozenset("ul ol div select".split())
#: fixed values: elements, roles and class words that are not an article's text
NOT_TEXT = frozenset("nav footer aside form button select dialog menu head".split())
NOT_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
NOT_TEXT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies copyright disqus footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice "
    "notices overlay pager pagination paywall popup promo promotion recommended related replies reply respond search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split())
HEADS = frozenset("header masthead head".split())
#: words that leave the meaning of a class name to its other words
NEUTRAL = frozenset("area articles bar block body box button buttons container content form group icon icons inner item items "
                    "link links list module page panel post posts row section site stories story title wrap wrapper".split())
#: elements that hold an article's text itself, and class words that speak against it even there
OWN_TEXT = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre li dt dd td th caption figcaption".split())
SURE_WORDS = frozenset("ad ads advert adverts advertisement hidden sponsored".split())
#: parts of a class name that tells a state or layout, not what the element is
STATES = frozenset("has no not with without is open closed enabled disabled".split())
#: how an element is set apart: by a part of a class name, unless it holds most
#: of the page's text; or in any case
PERHAPS, APART = 1, 2
#: elements, item properties and class words of an article's text
TEXT_WORDS = frozenset("article articlebody content entry post story".split())

#: what a tag is read on to: its end, or a value in quotes
_STOP = re.compile(r">|=[\t\n\f\r ]*([\"'])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>]|$)", re.IGNORECASE) for name in RAW}
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Block:
    """Text of one block element; ``linked`` of its characters are links."""

    path: int
    text: str
    linked: int
    excluded: bool
    region: int
    at: int
    token: int = 0


@dataclass
class Page:
    """``tags``: (position, token) of every tag; ``regions``: how strongly
    each container claims to be the article, by its number."""

    tags: list[tuple[int, int]] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    regions: dict[int, int] = field(default_factory=dict)
    #: the container each container stands in, 0 if in none; it has a smaller number
    parents: dict[int, int] = field(default_factory=dict)


def _name(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def _judge(name: str, attributes: dict[str, str], inside: bool) -> tuple[int, int]:
    """Whether an element is set apart from the text (0, PERHAPS, APART), and
    how strongly it claims to hold it (3: article, 2: main, 1: by its class).
    ``inside``: it stands in a container of text, where a header is the
    article's own, a class or id speaks against an element only by all of its
    words, and elements of the text itself are judged by few words, never by
    their id. A claim holds against parts of class names; that of an
    article or main element also against whole ones, unless it is inside
    another container and has no class word of a text."""
    if name in ("html", "body"):
        return 0, 0
    own_text = inside and name in OWN_TEXT
    names = [n for key in (("class",) if own_text else ("class", "id")) for n in attributes.get(key, "").split()]
    whole = {n.lower() for n in names}
    parts = [{w.lower() for w in _WORD.findall(n)} for n in names]
    role = attributes.get("role", "").lower()
    style = attributes.get("style", "").replace(" ", "").lower()
    if (name in NOT_TEXT or role in NOT_TEXT_ROLES or "display:none" in style or name == "header" and not inside
            or attributes.get("aria-hidden", "").lower() == "true" or "hidden" in attributes):
        return APART, 0
    body = attributes.get("itemprop", "").lower() == "articlebody"
    claim = (3 if name == "article" or body else 2 if name == "main" or role == "main"
             else 1 if any(w & TEXT_WORDS for w in parts) else 0)
    words = SURE_WORDS if own_text else NOT_TEXT_WORDS if inside else NOT_TEXT_WORDS | HEADS
    if whole & words and (claim < 2 or inside and not whole & TEXT_WORDS):
        return APART, 0
    if claim < 2 and not whole & TEXT_WORDS and not own_text:
        if inside and any(w & words and w <= words | NEUTRAL for w in parts):
            return APART, 0
        if not inside and any(w & words and not w & STATES for w in parts):
            return PERHAPS, 0
    return 0, claim


def _revive(page: Page, holders: list[int], outer: dict[int, int]) -> None:
    """Sets blocks apart that stand in an element that is PERHAPS set apart,
    but for those that hold most of the page's text. ``holders``: for each
    block the innermost such element, or 0; ``outer``: the one around it."""
    mass = dict.fromkeys([0, *outer], 0)
    for b, h in zip(page.blocks, holders, strict=True):
        if not b.excluded:
            mass[h] += len(b.text)
    for h in reversed(outer):
        mass[outer[h]] += mass[h]
    away: dict[int, bool] = {0: False}
    for h in outer:
        away[h] = away[outer[h]] or 2 * mass[h] <= mass[0]
    for b, h in zip(page.blocks, holders, strict=True):
        b.excluded = b.excluded or away[h]


_ABOUT: dict[tuple, tuple] = {}
#: attributes that say something about an element
_TELLING = re.compile(r"class|id|role|style|hidden|itemprop", re.IGNORECASE)


def _about(path: int, name: str, raw: str, inside: bool) -> tuple[int, int, int, int]:
    """An element's path, that of its closing tag, and ``_judge`` of it.
    Pages of a host repeat their tags, so answers are kept, a bounded number."""
    if raw and not _TELLING.search(raw):
        raw = ""
    known = _ABOUT.get((path, name, raw, inside))
    if known is None:
        attributes: dict[str, str] = {}
        for a in _ATTRIBUTE.finditer(raw):
            attributes.setdefault(a.group(1).lower(), html.unescape(a.group(2) or a.group(3) or a.group(4) or ""))
        if re.search(r"(?:^|\s)hidden(?:\s|/|$)", raw):
            attributes["hidden"] = ""
        own = _name(path, name, attributes.get("class", ""), attributes.get("id", ""))
        known = (own, _name("/", own), *_judge(name, attributes, inside))
        if len(_ABOUT) > 100_000:
            _ABOUT.clear()
        _ABOUT[path, name, raw, inside] = known
    return known


class _Reader:
    """Pieces of a page from left to right: ``(text, None, "", "")`` or
    ``("", name, slash, attributes)`` of a tag. Nothing is read twice: a tag
    without an end is the last piece, and what a search has not found after
    some place is not looked for again."""

    def __init__(self, source: str):
        self.source, self.at, self.nothing = source, 0, {}

    def find(self, what: str, at: int) -> int:
        if at >= self.nothing.get(what, len(self.source) + 1):
            return -1
        found = self.source.find(what, at)
        if found < 0:
            self.nothing[what] = at
        return found

    def tag_end(self, at: int) -> int:
        """Where the ``>`` of a tag is; -1 if it has none. A quote that is
        not closed on the page is a character like others."""
        while True:
            m = _STOP.search(self.source, at)
            if m is None:
                return -1
            if m.group(1) is None:
                return m.start()
            closed = self.find(m.group(1), m.end())
            if closed < 0:
                return self.find(">", m.end())
            at = closed + 1

    def skip_raw(self, name: str) -> None:
        """Past the end of an element whose content is no text; if it has no
        end, it is taken to be empty."""
        if self.at >= self.nothing.get("</" + name, len(self.source) + 1):
            return
        m = _RAW_END[name].search(self.source, self.at)
        if m is None:
            self.nothing["</" + name] = self.at
            return
        end = self.find(">", m.end())
        self.at = len(self.source) if end < 0 else end + 1

    def __iter__(self):
        source = self.source
        while self.at < len(source):
            lo = self.at
            if source[lo] != "<":
                hi = source.find("<", lo)
                self.at = len(source) if hi < 0 else hi
                yield source[lo:self.at], None, "", ""
                continue
            after = source[lo + 1:lo + 2]
            if after in ("!", "?"):
                comment = source.startswith("<!--", lo)
                end = self.find("-->" if comment else ">", lo + 4 if comment else lo)
                self.at = len(source) if end < 0 else end + (3 if comment else 1)
                continue
            slash = after if after == "/" else ""
            m = _NAME.match(source, lo + 1 + len(slash))
            if m is None:
                self.at = lo + 1
                yield "<", None, "", ""
                continue
            end = self.tag_end(m.end())
            self.at = len(source) if end < 0 else end + 1
            if end >= 0:
                yield "", m.group().lower(), slash, source[m.end():end]


class _Open(dict):
    """How deep the open elements of each name stand, innermost last."""

    def __missing__(self, name: str) -> list[int]:
        own = self[name] = []
        return own

    def top(self, names) -> int:
        return max((self[n][-1] for n in names if self.get(n)), default=0)


def parse(source: str) -> Page:
    """Tokens and blocks of a page, in time that grows with its length. Never
    fails: unclosed and stray tags are put where browsers would roughly put
    them, a tag that the page ends in is left out."""
    page = Page()
    # (name, path, closing path, excluded, region, in a container, link, perhaps set apart by, foreign, path and region of its block)
    stack: list[tuple] = [("", 0, 0, False, 0, False, False, 0, False, (0, 0))]
    depths = _Open()
    scopes: list[int] = [0]
    barriers: list[int] = [0]
    holders: list[int] = []
    outer_holder: dict[int, int] = {}
    text: list[str] = []
    linked = 0

    def flush(at: int) -> None:
        nonlocal linked
        if text:
            joined = "".join(text)
            joined = " ".join((html.unescape(joined) if "&" in joined else joined).split())
            text.clear()
            if joined:
                path, region = stack[-1][9]
                page.blocks.append(Block(path, joined, min(linked, len(joined)), stack[-1][3], region, at))
                holders.append(stack[-1][7])
            linked = 0

    def close(depth: int) -> None:
        for name, *_ in stack[depth:]:
            depths[name].pop()
            if name in BARRIER:
                barriers.pop()
            if name in SCOPE:
                scopes.pop()
        del stack[depth:]

    at = 0
    reader = _Reader(source)
    for piece, name, slash, raw in reader:
        at += 1
        if name is None:
            text.append(piece)
            if stack[-1][6]:
                linked += len(piece.strip())
            continue
        inline = name in INLINE or name in FOREIGN or stack[-1][8]
        if not inline:
            flush(at)
        if slash:
            depth = depths[name][-1] if depths.get(name) else 0
            if depth and (name in SCOPE or depth > scopes[-1]):
                page.tags.append((at, stack[depth][2]))
                close(depth)
            continue
        if not inline:
            # a block ends an open paragraph, and with it what is open inside
            depth = depths.top(("p", *CLOSES.get(name, ())))
            if depth and depth >= barriers[-1]:
                close(depth)
        elif name == "br":
            text.append(" ")
        _, path, _, excluded, region, inside, link, holder, foreign, block = stack[-1]
        path, closing, apart, claim = _about(path, name, raw, inside)
        page.tags.append((at, path))
        if name in RAW:
            if not raw.rstrip().endswith("/"):
                reader.skip_raw(name)
            continue
        if name in VOID or foreign and raw.endswith("/"):
            continue
        if claim and not (excluded or apart):
            outer, region = region, len(page.regions) + 1
            page.regions[region] = claim
            page.parents[region] = outer
            inside = True
        if apart == PERHAPS and not excluded:
            outer, holder = holder, len(outer_holder) + 1
            outer_holder[holder] = outer
        depths[name].append(len(stack))
        if name in BARRIER:
            barriers.append(len(stack))
        if name in SCOPE:
            scopes.append(len(stack))
        stack.append((name, path, closing, excluded or apart == APART, region, inside, link or name == "a", holder,
                      foreign or name in FOREIGN, block if inline else (path, region)))
    flush(at + 1)
    if outer_holder:
        _revive(page, holders, outer_holder)
    for b in page.blocks:
        b.token = xxhash.xxh3_64_intdigest(b.text.encode("utf-8", "surrogatepass"), b.path & 0xFFFFFFFF) - (1 << 63)
    return page
