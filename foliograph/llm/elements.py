"""Elements of a web page and what of their text is the article: a helper for one page at a time.

``Page`` reads HTML as browsers do where it matters for text: implied end tags, raw text
elements, comments, attributes in quotes, unmatched end tags. Elements are known by number in page
order; each has a hash of its tag, text and children. All of it is linear in the page's length.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import xxhash

# Element names of HTML by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
#: Inline elements that are no more than a style of their text.
STYLE = frozenset("abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small strike strong sub sup time tt u var".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td template tfoot th thead title tr ul xmp".split()
)
#: What a start tag ends if it is open, up to the elements that shield it.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
ENDS |= {"thead": ENDS["tbody"], "tfoot": ENDS["tbody"], "body": ({"head"}, {"html"})}
#: Elements that end an open paragraph, and those across which an end tag or paragraph does not reach.
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "head", "html", "body", "noscript", "template", "title"}
SHIELD = frozenset("td th caption table button template".split())

# What is no part of an article, by element, role and word of a class or id.
DROPPED = frozenset("applet aside audio button canvas datalist dialog embed footer form head iframe map menu nav noembed noframes noscript object option optgroup script search select style svg template textarea title video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar tooltip".split())
WORDS = frozenset(
    "ad ads adsense adslot adv advert adverts advertisement advertisements advertising alert alerts banner banners breadcrumb breadcrumbs ccpa consent cookie cookies copyright crumbs dialog disclaimer "
    "donate follow foot footer gdpr legal lightbox login masthead menu menus modal nav navbar navigation navi newsletter newsletters notice notices notification notifications outbrain overlay pager "
    "pagination paywall popup promo promos promoted promotion recirc recommendation recommendations recommended register related search searchbox share sharebar sharing sidebar sidebars signin signup "
    "skip social sponsor sponsored sponsors subscribe subscription subnav taboola teaser teasers toolbar topbar trending widget widgets".split()
)
PARTS = ("sidebar", "navbar", "breadcrumb", "newsletter", "cookie", "advert", "sponsor", "pagination", "masthead", "copyright")
COMMENTS = frozenset("comment commentary comments commentlist comentarios commentaires disqus kommentare replies reply respond".split())
#: Words in names of layout: with a sidebar, comments open.
AROUND = frozenset("has no with without open opened closed off on enabled disabled".split())
#: Elements that hold what an article says; they are never taken for template inside an article.
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr tbody thead tfoot caption figcaption".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
NONE, BOILERPLATE, READERS, HEADER = range(4)


@lru_cache(1 << 14)
def kind_of(tag: str, attributes: str) -> int:
    """What an element is by its name and attributes."""
    if tag in DROPPED:
        return BOILERPLATE
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    style = values.get("style", "").replace(" ", "").lower()
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return BOILERPLATE
    if values.get("role", "").lower() in ROLES:
        return BOILERPLATE
    kinds = {HEADER} if tag == "header" else {NONE}
    for name in f"{values.get('class', '')} {values.get('id', '')}".split():
        words = {w.lower() for w in _WORD.findall(name)}
        if words & AROUND:  # says what a page has beside this
            continue
        kinds.add(READERS if words & COMMENTS else BOILERPLATE if words & WORDS or any(x in name.lower() for x in PARTS) else HEADER if "header" in words else NONE)
    return READERS if READERS in kinds else BOILERPLATE if BOILERPLATE in kinds else HEADER if HEADER in kinds else NONE


class Page:
    """Elements in page order (``tag``, ``parent``, ``last``, ``kind``, ``hash``) and runs of text with their element.

    ``runs`` has (element, text), with None as text where a block begins or ends.
    """

    def __init__(self, html: str):
        self.tag, self.parent, self.kind, self.last, self.hash = ["#"], [-1], [NONE], [0], [0]
        self.runs: list[tuple[int, str | None]] = []
        self._stack = [0]
        self._open: dict[str, list[int]] = {}
        self._shields, self._blocks = [0], [0]
        self._pieces: list[list[str]] = [[]]
        self._read(html)
        while len(self._stack) > 1:
            self._close()
        self.last[0] = len(self.tag) - 1

    def _read(self, html: str) -> None:
        at, end, no_tag = 0, len(html), html.rfind(">")
        while at < end:
            less = html.find("<", at)
            if less < 0:
                return self._text(html[at:])
            found = _TAG.match(html, less) if less < no_tag else None
            if found is None:
                follows = html[less + 1 : less + 2]
                markup = follows and (follows in "!?/" or follows.isascii() and follows.isalpha())
                self._text(html[at : less if markup else less + 1])
                if not markup:
                    at = less + 1
                    continue
                closing = "-->" if html.startswith("<!--", less) else ">"
                stop = html.find(closing, less + (2 if closing == "-->" else 1))
                at = end if stop < 0 else stop + len(closing)
                continue
            if less > at:
                self._text(html[at:less])
            at = found.end()
            tag = found[2].lower()
            if found[1]:
                self._end(tag)
                continue
            self._start(tag, found[3])
            if tag in RAW and self.tag[self._stack[-1]] == tag:
                stop = re.compile(f"</{tag}", re.IGNORECASE).search(html, at)
                at = stop.start() if stop else end
                self._end(tag)

    def _text(self, text: str) -> None:
        if text:
            text = unescape(text) if "&" in text else text
            self.runs.append((self._stack[-1], text))
            if not text.isspace():
                self._pieces[-1].append(" ".join(text.split()))

    def _start(self, tag: str, attributes: str) -> None:
        if tag in STYLE:
            return
        if tag in VOID:
            if tag == "br":
                self.runs.append((self._stack[-1], " "))
            elif tag == "hr":
                self.runs.append((0, None))
            return
        if tag in ENDS_P and self._reaches("p"):
            self._close_to(self._open["p"][-1])
        if tag in ENDS:
            ended, shield = ENDS[tag]
            wall = max((self._open[x][-1] for x in shield if self._open.get(x)), default=0)
            places = [self._open[x][-1] for x in ended if self._open.get(x) and self._open[x][-1] > wall]
            for _ in range(2 if tag in ("tr", "tbody", "thead", "tfoot") else 1):
                if places:
                    self._close_to(min(places))
                places = [self._open[x][-1] for x in ended if self._open.get(x) and self._open[x][-1] > wall]
        number = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self._stack[-1])
        self.kind.append(kind_of(tag, attributes))
        self.last.append(number)
        self.hash.append(0)
        self._open.setdefault(tag, []).append(len(self._stack))
        if tag in SHIELD:
            self._shields.append(len(self._stack))
        if tag in BLOCK:
            self._blocks.append(len(self._stack))
            self.runs.append((number, None))
        self._stack.append(number)
        self._pieces.append([])

    def _reaches(self, tag: str) -> bool:
        places = self._open.get(tag)
        return bool(places) and places[-1] >= self._shields[-1]

    def _end(self, tag: str) -> None:
        if tag == "br":
            self.runs.append((self._stack[-1], " "))
        elif self._reaches(tag):
            place = self._open[tag][-1]
            # An inline end tag closes no block.
            if tag in BLOCK or place > self._blocks[-1]:
                self._close_to(place)

    def _close_to(self, place: int) -> None:
        while len(self._stack) > place:
            self._close()

    def _close(self) -> None:
        number = self._stack.pop()
        tag = self.tag[number]
        pieces = self._pieces.pop()
        self._open[tag].pop()
        if tag in SHIELD:
            self._shields.pop()
        self.last[number] = len(self.tag) - 1
        if tag in BLOCK:
            self._blocks.pop()
            self.runs.append((number, None))
        if pieces:
            own = self.hash[number] = xxhash.xxh64_intdigest(f"{tag}\0{'\0'.join(pieces)}") or 1
            self._pieces[-1].append(f"\1{own:x}")

    # What is the article.

    def _marks(self, found: list[int]) -> list[bool]:
        """For each element whether it is one of those found or inside one."""
        out = [False] * len(self.tag)
        for e in found:
            out[e] = True
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.parent[e]]
        return out

    def _holds(self, found: list[int]) -> list[bool]:
        """For each element whether one of those found is inside it."""
        out = [False] * len(self.tag)
        for e in reversed(found):
            while e > 0 and not out[self.parent[e]]:
                e = self.parent[e]
                out[e] = True
        return out

    def survey(self) -> None:
        """Sets ``dropped`` (marked as no article by name, class or role) and ``roots`` (the article's elements)."""
        tags = self.tag
        headings = [e for e, t in enumerate(tags) if t == "h1"]
        mains = [e for e, t in enumerate(tags) if t == "main"]
        articles = [e for e, t in enumerate(tags) if t == "article" and self.kind[e] in (NONE, HEADER)]
        in_article = self._marks(mains + articles)
        title = self._holds(headings + mains)
        post = self._holds(articles)
        found = []
        for e in range(1, len(tags)):
            kind, t = self.kind[e], tags[e]
            if kind == NONE or t in ("html", "body", "main"):
                continue
            if t == "form":
                drop = not (title[e] or post[e])
            elif kind == HEADER:
                drop = not in_article[e] and not post[e] and not (title[e] and t != "header")
            elif t in DROPPED:
                drop = True
            else:
                drop = not title[e] and not (kind == BOILERPLATE and post[e])
            if drop:
                found.append(e)
        self.dropped = self._marks(found)
        kept = [e for e in articles if not self.dropped[e]]
        inside = self._marks(kept)
        kept = [e for e in kept if not inside[self.parent[e]]]
        titled = [e for e in kept if title[e]]
        self.landmark = True
        if kept:
            # A title that stands before the article, in the same main element.
            above = [] if titled else [h for h in headings if not self.dropped[h] and in_article[h]]
            self.roots = sorted((titled or kept) + above)
        elif any(not self.dropped[e] for e in mains):
            self.roots = [e for e in mains if not self.dropped[e]]
        else:
            self.roots, self.landmark = [0], False
        self.inside = self._marks(self.roots) if self.landmark else [True] * len(tags)

    def subtrees(self) -> dict[int, list[int]]:
        """Hashes of subtrees that may be the site's template, with their elements; never the article or what holds it."""
        holds = self._holds(self.roots) if self.landmark else [False] * len(self.tag)
        out: dict[int, list[int]] = {}
        for e in range(1, len(self.tag)):
            t = self.tag[e]
            if not self.hash[e] or t not in BLOCK or t in ("html", "body", "head", "title") or holds[e]:
                continue
            if self.landmark and self.inside[e] and (t in CONTENT or e in self.roots):
                continue
            out.setdefault(self.hash[e], []).append(e)
        return out

    def blocks(self, template: set[int] = frozenset()) -> list[str]:
        """The article's blocks in page order, without subtrees whose hash is one of the template's."""
        cut = [e for h, elements in self.subtrees().items() if h in template for e in elements]
        gone = self._marks(cut) if cut else None
        whole = self._joined(None)
        if gone is None:
            return whole
        rest = self._joined(gone)
        # A page of which nothing or, inside an article, less than half stays is a copy, and no template.
        most = sum(map(len, whole)) / 2 if self.landmark else 1
        return rest if sum(map(len, rest)) >= most else whole

    def _joined(self, gone: list[bool] | None) -> list[str]:
        out, run, links = [], [], 0
        dropped, inside, tags = self.dropped, self.inside, self.tag
        for e, text in self.runs:
            if text is None:
                if run:
                    self._block(out, run, links)
                    run, links = [], 0
            elif inside[e] and not dropped[e] and (gone is None or not gone[e]):
                run.append(text)
                links += len(text) if tags[e] == "a" else 0
        self._block(out, run, links)
        return out

    def _block(self, out: list[str], run: list[str], links: int) -> None:
        text = " ".join("".join(run).split())
        # Without an article's element, lines of hardly anything but links are menus.
        if text and (self.landmark or links < 0.7 * len(text)):
            out.append(text)
