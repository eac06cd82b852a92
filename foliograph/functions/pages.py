r"""Finishing of pages: what is left of markup in tags becomes what a reader of the target expects.

A page is first read as text: macros in one walk, then tags one by one, each by a table of
names. Then it is an element tree, on which rules about what stands in, before or after what are
statements about children and neighbours. One writer gives the text back, with each tag where its
kind stands on the page. All of it takes time in proportion to the page, however long a
run of blanks is and whatever is left open.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

from pyspark.sql import Column

from .scanner import Action, column, filled, rewrite_uses

_TAG = re.compile(r"<(/?)([A-Za-z][\w:-]*)((?:\s[^<>]*?)?)(/?)>")
_BLANKS = re.compile(r"\s*")


# ---- the tree


class Element:
    """An element; ``children`` are texts and elements. ``open_only`` and ``end_only`` are tags without their partner, which stay where they are."""

    __slots__ = ("tag", "attributes", "children", "empty")

    def __init__(self, tag: str, attributes: str = "", children: list | None = None, empty: bool = False):
        self.tag, self.attributes, self.children, self.empty = tag, attributes, [] if children is None else children, empty


def parse(text: str) -> Element:
    """A page as a tree; tags without a partner are text."""
    tags = list(_TAG.finditer(text))
    partner: dict[int, int] = {}
    held: list[int] = []
    by_tag: dict[str, int] = {}
    for k, m in enumerate(tags):
        if m.group(4):
            continue
        if not m.group(1):
            held.append(k)
            by_tag[m.group(2)] = by_tag.get(m.group(2), 0) + 1
        elif by_tag.get(m.group(2)):
            while (last := held.pop()) is not None:  # left open inside: text
                name = tags[last].group(2)
                by_tag[name] -= 1
                if name == m.group(2):
                    partner[last] = k
                    break
    closing = set(partner.values())
    root = Element("")
    stack, at = [root], 0
    for k, m in enumerate(tags):
        here = stack[-1].children
        if at < m.start():
            here.append(text[at : m.start()])
        at = m.end()
        if m.group(4):
            here.append(Element(m.group(2), m.group(3), empty=True))
        elif k in partner:
            here.append(Element(m.group(2), m.group(3)))
            stack.append(here[-1])
        elif k in closing:
            stack.pop()
        else:
            here.append(m.group(0))
    if at < len(text):
        root.children.append(text[at:])
    return root


def render(root: Element) -> str:
    out: list[str] = []
    todo: list = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.empty:
            out.append(f"<{x.tag}{x.attributes}/>")
        else:
            if x.tag:
                out.append(f"<{x.tag}{x.attributes}>")
                todo.append(f"</{x.tag}>")
            todo.extend(reversed(x.children))
    return "".join(out)


def elements(root: Element) -> list[Element]:
    """All elements, the root included, outer ones first."""
    out = [root]
    for x in out:
        out.extend(c for c in x.children if isinstance(c, Element))
    return out


def words_of(x: Element) -> str:
    """The text of an element and what is in it."""
    out, todo = [], [x]
    while todo:
        y = todo.pop()
        if isinstance(y, str):
            out.append(y)
        else:
            todo.extend(reversed(y.children))
    return "".join(out)


def is_blank(x: str | Element) -> bool:
    return isinstance(x, str) and not x.strip()


def named(x: str | Element | None, *tags: str) -> bool:
    return isinstance(x, Element) and x.tag in tags


def first_of(children: list) -> str | Element | None:
    return next((x for x in children if not is_blank(x)), None)


def last_of(children: list) -> str | Element | None:
    return next((x for x in reversed(children) if not is_blank(x)), None)


def trimmed(children: list) -> list:
    """Children without blanks at the start and end."""
    a, b = 0, len(children)
    while a < b and is_blank(children[a]):
        a += 1
    while b > a and is_blank(children[b - 1]):
        b -= 1
    out = children[a:b]
    if out and isinstance(out[0], str):
        out[0] = out[0].lstrip()
    if out and isinstance(out[-1], str):
        out[-1] = out[-1].rstrip()
    return out


def apart(children: list, wanted: Callable[[Element], list | None]) -> list:
    """Children in which those that ``wanted`` gives something for are that, without the blanks around them."""
    out: list = []
    tight = False
    for x in children:
        new = wanted(x) if isinstance(x, Element) else None
        if new is not None:
            while out and is_blank(out[-1]):
                out.pop()
            if out and isinstance(out[-1], str):
                out[-1] = out[-1].rstrip()
            out.extend(new)
            tight = True
        elif tight and isinstance(x, str):
            out.append(x.lstrip()) if x.strip() else None
            tight = tight and not x.strip()
        else:
            out.append(x)
            tight = False
    return out


def on_tree(step: Callable[[Element], None]) -> Callable[[str], str]:
    """A rule on the tree as a function of a page's text."""

    @wraps(step)
    def run(text: str) -> str:
        root = parse(text)
        step(root)
        return render(root)

    run.tree = step
    return run


def rewrite(text: str, tags: Iterable[str], use: Callable[[str, str, str], str]) -> str:
    """``use(tag, attributes, content)`` in place of each element of the tags, inner ones first; unpaired tags are text."""
    wanted = set(tags)
    root = parse(text)
    for x in reversed(elements(root)):
        x.children = [use(c.tag, c.attributes, render(Element("", "", c.children))) if isinstance(c, Element) and not c.empty and c.tag in wanted else c for c in x.children]
    return render(root)


# ---- tags of both targets

# Lists whose label is a marker; where a line breaks anyway; environments that are elements; elements without blanks inside.
MARKED_LISTS = ("ol", "ul")
BREAKS_BEFORE = ("ol", "ul", "image", "figure")
ELEMENT_ENVIRONMENTS = "objectives outcomes project investigation exploration annotation program commentary".split()
TRIMMED = "em idx h".split()
_ENVIRONMENT = re.compile(rf"(<p>\s*)?\\(begin|end)\s*\{{({'|'.join(ELEMENT_ENVIRONMENTS)}|center|reactions?\*?)\}}(?:\s*\[([^\[\]]+)\](?=\s*</p>))?")
_AFTER = re.compile(r"\s*</p>")


def _environments(text: str) -> str:
    """Environments that are elements, out of the paragraphs that hold nothing else; centring goes."""
    out, at = [], 0
    for m in _ENVIRONMENT.finditer(text):
        if m.start() < at:
            continue
        before, which, name, title = m.groups()
        end = m.end()
        alone = _AFTER.match(text, end) if before else None
        if name == "center":
            out += [text[at : m.start()].rstrip() if not before else text[at : m.start()], before or ""]
            at = _BLANKS.match(text, end).end()
            continue
        tag = "me" if name in ("reaction", "reaction*") else "md" if name.startswith("reaction") else name
        shown = f"</{tag}>" if which == "end" else f'<{tag} class="reaction">' if tag != name else f"<{tag}>"
        if title and which == "begin" and not (alone and name in ("objectives", "outcomes")):
            end = m.end(3) + 1
        elif title:
            shown += f"<title>{title}</title>"
        out += [text[at : m.start()], "" if alone else before or "", shown]
        at = alone.end() if alone else end
    return "".join([*out, text[at:]])


def _spaced_text(args: list[str]) -> str:
    r"""Words in math with a blank on either side."""
    words = args[0]
    bare = words.lstrip()
    if bare.startswith(("\\,", "\\ ")):
        words = " " + bare[2:]
    if "{" not in words and "}" not in words and len(words) > 1:
        words = (words if words[0] == " " else f" {words}") + ("" if words[-1] == " " else " ")
    return f"\\text{{{words}}}"


def _kept(name: str) -> Callable[[list[str]], str]:
    """A macro without meaning if its first argument is empty."""
    return lambda args: "".join([f"\\{name}", *[f"{{{a}}}" for a in args]]) if args[0].strip() else ""


_COMMON: dict[str, Action] = {"addtocontents": (1, filled("")), "normalfont": (0, filled("")), "text": (1, _spaced_text), "mbox": (1, _kept("mbox")), "hbox": (1, _kept("hbox"))}
_COMMON |= {name: (2, _kept(name)) for name in ("newcommand", "renewcommand")}


def _marked(m: re.Match) -> str:
    end, tag, attributes, empty = m.groups()
    if not end and tag in MARKED_LISTS and attributes.startswith(" label="):
        return f"<{tag} marker={attributes[len(' label=') :]}{empty}>"
    return m.group(0)


def _breaks(root: Element) -> None:
    """No break before the end of a paragraph or item, nor beside what stands on its own line."""
    for x in elements(root):
        out: list = []
        for k, c in enumerate(x.children):
            if not named(c, "br"):
                if out and out[-1] == "\0" and isinstance(c, str):
                    out[-1], c = "\n" if c.strip() or x.tag != "li" else "", c.lstrip()
                elif out and out[-1] == "\0":
                    out[-1] = "\n"
                out.append(c) if c != "" else None
                continue
            after = first_of(x.children[k + 1 : k + 3])
            ends = after is None and x.tag in ("p", "li") and k + 3 > len(x.children)
            beside = named(after, *BREAKS_BEFORE) or isinstance(after, str) and after.lstrip().startswith(("\\begin{", "\\end{"))
            before = next((y for y in reversed(out[-2:]) if not is_blank(y)), None)
            if not (ends or beside or named(before, "image")):
                out.append(c)
                continue
            while out and is_blank(out[-1]):
                out.pop()
            if out and isinstance(out[-1], str):
                out[-1] = out[-1].rstrip()
            out.append("" if ends and x.tag == "li" else "\0")
        x.children = ["\n" if c == "\0" else c for c in out]


def _trim(root: Element) -> None:
    for x in elements(root):
        if x.tag in TRIMMED and not x.attributes:
            x.children = trimmed(x.children)


def _no_empty_paragraphs(root: Element) -> None:
    empty = lambda x: x.tag == "p" and (not x.attributes or x.attributes.startswith(" id")) and all(isinstance(c, str) for c in x.children) and not "".join(x.children).strip(" \t\r\n{}")
    for x in elements(root):
        x.children = apart(x.children, lambda c: ["\n"] if empty(c) else None)


def fix_tags(text: str) -> str:
    """Fixes that both targets need: breaks, list markers, environments, spaces in tags and texts, empty paragraphs."""
    text = rewrite_uses(text, _COMMON, short=lambda use: use) if "\\" in text else text
    text = _TAG.sub(_marked, _environments(text))
    root = parse(text)
    for step in (_breaks, _trim, _no_empty_paragraphs):
        step(root)
    return render(root)


# ---- tags of the structured target

# Elements, entities and words that stand for something else; letters that lose their accent; macros that are dropped.
CHARACTERS = {"hash": "#", "percent": "%", "dollar": "$", "ampersand": "&amp;"}
ENTITIES = {"Scaron": "S", "scaron": "s", "ccaron": "c", "cacute": "c", "copy": "<copyright/>"}
DROPPED_MACROS = "notag quad hfill null".split()
# Macro, number of arguments, template.
MACRO_TAGS = [
    ("code", 1, "<c>#1</c>"), ("terminology", 1, "<term>#1</term>"), ("term", 1, "<term>#1</term>"), ("exercisetitle", 1, "<title>#1</title>"),
    ("tipBoxTitle", 1, "<title>#1</title>"), ("calckey", 1, "<kbd>#1</kbd>"), ("href", 2, '<url href="#1">#2</url>'),
    ("intertext", 1, "</mrow>\n<intertext>#1</intertext>\n<mrow>"), ("dollar", 0, "$"), ("textregistered", 0, "<registered/>"),
    ("paragraphs", 1, "<heading>#1</heading>"), ("alert", 1, "<alert>#1</alert>"),
]
_MATH_TEXT = re.compile(r"\s*\$([^{}$]+)\$\s*(\.*)\s*")


def _math_alone(args: list[str]) -> str:
    """Words that are math are math."""
    m = _MATH_TEXT.fullmatch(args[0])
    return f"${m.group(1)}${m.group(2)}" if m else f"\\text{{{args[0]}}}"


_STRUCTURED: dict[str, Action] = {name: (count, filled(template)) for name, count, template in MACRO_TAGS} | {name: (0, filled("")) for name in DROPPED_MACROS} | {"text": (1, _math_alone)}
_ALONE = re.compile(r"<p>\s*(?:(startofproof)|(endofproof)|\\(endparagraphs))\s*</p>")
_SIGN = re.compile(r"&(?:([A-Za-z]+);)?|<(?=[= ])|_(?:<ndash */>|-)_|myampersand|width=\"[1-9][0-9][0-9][.0-9]*%\"")
_HREF = re.compile(r'href="([^"]*)"')
_KEYS = re.compile(r"\\calckey([^{A-Za-z])")


def _sign(m: re.Match) -> str:
    found = m.group(0)
    if found[0] == "&":
        if m.group(1):
            return ENTITIES.get(m.group(1), found)
        follows = m.string[m.end() : m.end() + 1]
        return "&" if follows == "#" or follows.isascii() and follows.isalpha() else "&amp;"
    return {"<": "&lt;", "_": "___", "m": "&amp;", "w": 'width="92.5%"'}[found[0]]


def _address(m: re.Match) -> str:
    """An address with its characters as they are, and ampersands escaped once."""
    inside = re.sub(r"<(hash|percent|nbsp) */>", lambda x: {"hash": "#", "percent": "%", "nbsp": "~"}[x.group(1)], m.group(1))
    return f'href="{re.sub("&(?!amp;)", "&amp;", inside)}"'


def _character(m: re.Match) -> str:
    return CHARACTERS.get(m.group(2), m.group(0)) if m.group(4) else m.group(0)


def _math_in_words(x: Element) -> None:
    """Words between rows: dollars and round brackets are math elements again."""
    parts = render(Element("", "", x.children)).split("$")
    content = "".join(p + ("" if k + 1 == len(parts) else ("<m>", "</m>")[k % 2]) for k, p in enumerate(parts))
    x.children = [content.replace("\\(", "<m>").replace("\\)", "</m>")]


def _structure(x: Element) -> None:
    """What the children of an element are in the structured target."""
    kind = x.tag
    if kind in ("me", "md") and x.attributes.startswith(" xml:id"):
        x.tag = kind + "n"
    elif kind == "intertext":
        _math_in_words(x)
    elif kind == "title":
        while x.children and (named(x.children[-1], "nbsp") or is_blank(x.children[-1])):
            x.children.pop()
        if x.children and isinstance(x.children[-1], str):
            x.children[-1] = x.children[-1].rstrip(" ")
    out: list = []
    for c in x.children:
        if named(c, "u") and not c.attributes:
            c = Element("em", "", c.children) if c.children and first_of(c.children) is not None else Element("fillin", empty=True)
        elif named(c, "sup") and [y.tag if isinstance(y, Element) else y.strip() for y in trimmed(c.children)] == ["registered"]:
            c = Element("trademark", empty=True)
        elif named(c, "p"):
            out += _headed(c)
            continue
        out.append(c)
    x.children = [f"\\paragraphs{{{render(Element('', '', c.children))}}}" if named(c, "heading") else f"\\alert{{{render(Element('', '', c.children))}}}" if named(c, "alert") else c for c in out] if kind != "p" else out


def _headed(p: Element) -> list:
    """A paragraph that begins with a heading of its own, as a part with a title."""
    body = trimmed(p.children)
    if p.attributes or not body or not (named(body[0], "heading") or named(body[0], "alert") and is_blank(p.children[0])):
        return [p]
    title, rest = Element("title", "", body[0].children), body[1:]
    if body[0].tag == "alert" and rest and isinstance(rest[0], str):
        rest[0] = rest[0].removeprefix(".")
    rest = trimmed(rest)
    if not rest and body[0].tag == "heading":
        return ["<paragraphs>", title]  # up to where its author ends it
    return [Element("paragraphs", "", [title, Element("p", "", rest)])]


def _no_bare_rows(root: Element) -> None:
    """Paragraphs without a letter and rows without anything go; a part's heading stands outside paragraphs."""
    for x in elements(root):
        x.children = apart(x.children, lambda c: ["\n"] if c.tag == "p" and not c.attributes and not re.search("[a-zA-Z]", render(c)[3:-4]) or c.tag == "mrow" and not c.attributes and first_of(c.children) is None else None)
        if x.tag != "p":
            flat: list = []
            for c in x.children:
                body = trimmed(c.children) if named(c, "p") and not c.attributes else []
                flat += body if body and named(body[0], "paragraphs") and len(body) == 1 else [c]
            x.children = flat


def fix_structured_tags(text: str) -> str:
    """Fixes of the structured target: characters, macros that are tags, paragraphs, addresses, rows."""
    text = _ALONE.sub(lambda m: "<proof>" if m.group(1) else "</proof>" if m.group(2) else "</paragraphs>", text)
    text = rewrite_uses(_KEYS.sub(r"\\calckey{\1}", text), _STRUCTURED, short=lambda use: use) if "\\" in text else text
    text = _HREF.sub(_address, _SIGN.sub(_sign, _TAG.sub(_character, text)))
    root = parse(text)
    for x in reversed(elements(root)):
        _structure(x)
    _no_bare_rows(root)
    return render(root)


# ---- elements

# Elements whose body is a statement, and what may follow it inside them.
STATEMENTS = "theorem proposition lemma corollary definition axiom example exercise problem question conjecture".split()
AFTER_STATEMENT = "proof solution answer hint".split()


@on_tree
def wrap_statements(root: Element) -> None:
    """The body of theorem-like elements as a ``statement``, between their title and a proof, solution, answer or hint at their end."""
    for x in reversed(elements(root)):
        held = [c for c in x.children if named(c, *STATEMENTS) and not c.empty]
        for c in held:
            body = trimmed(c.children)
            if not any(named(y, "statement") for y in body):
                title = body[:1] if body and named(body[0], "title") else []
                rest = body[len(title) :]
                last = rest[-1].tag if rest and named(rest[-1], *AFTER_STATEMENT) else None
                cut = next(k for k, y in enumerate(rest) if named(y, last)) if last else len(rest)
                body = [*title, Element("statement", "", rest[:cut]), *rest[cut:]]
            c.children = ["\n", *body, "\n"]
        if held:
            x.children = _blank_lines(x.children, held)


def _blank_lines(children: list, held: list[Element]) -> list:
    """Children with an empty line on either side of those held."""
    some = {id(c) for c in held}
    out = apart(children, lambda c: ["\n\n", c, "\n\n"] if id(c) in some else None)
    return [c for k, c in enumerate(out) if not (c == "\n\n" and k and out[k - 1] == "\n\n")]


_DRAWING = re.compile(r"\\(begin|end)\{(overpic|tikzpicture|circuitikz)\}")


def wrap_drawings(text: str) -> str:
    """Drawings as character data of an image."""
    out, at = [], 0
    for m in _DRAWING.finditer(text):
        if m.group(1) == "begin":
            out += [text[at : m.start()].rstrip(), "\n<image>\n<latex-image>\n          <![CDATA[", m.group(0)]
            at = m.end()
        else:
            out += [text[at : m.end()], "]]>\n</latex-image>\n</image>\n"]
            at = _BLANKS.match(text, m.end()).end()
    return "".join([*out, text[at:]])


def _ties(children: list) -> list:
    return ["\\ " if named(c, "nbsp") and c.empty else c for c in children]


@on_tree
def math_delimiters(root: Element) -> None:
    """Inside math and drawings, inline math as brackets and ties as forced blanks; in words inside them too."""
    for x in reversed(elements(root)):
        if x.tag in ("latex-image", "mrow", "me", "men"):
            x.children = [y for c in _ties(x.children) for y in (["\\(", *c.children, "\\)"] if named(c, "m") and not c.attributes else [c])]
        elif x.tag == "m":
            x.children = _ties(x.children)
    for x in elements(root):
        if any(isinstance(c, str) and "\\text{" in c for c in x.children) and x.tag != "m":
            x.children = [_words_plain(render(Element("", "", x.children)))]


def _words_plain(text: str) -> str:
    plain = lambda a: f"\\text{{{re.sub('<nbsp */>', lambda m: chr(92) + ' ', a[0].replace('<m>', chr(92) + '(').replace('</m>', chr(92) + ')'))}}}"
    return rewrite_uses(text, {"text": (1, plain)}, short=lambda use: use)


@on_tree
def tables_of_figures(root: Element) -> None:
    """A figure that holds a tabular and no other figure is a table."""
    holds: dict[int, set[str]] = {}
    for x in reversed(elements(root)):
        inside = {c.tag for c in x.children if isinstance(c, Element)}.union(*(holds[id(c)] for c in x.children if isinstance(c, Element)))
        holds[id(x)] = inside & {"tabular", "figure"}
        if x.tag == "figure" and holds[id(x)] == {"tabular"}:
            x.tag = "table"


#: Markup that inline code has no use for, and what stands for it.
IN_CODE = {"nbsp": " ", "b": "", "em": " ", "fillin": "____", "m": " "}
_CODE_TAG = re.compile(r"</?(nbsp|b|em|fillin|m) */?>")


@on_tree
def clean_code(root: Element) -> None:
    """Inline code without markup."""
    for x in elements(root):
        if x.tag == "c":
            x.children = [_CODE_TAG.sub(lambda m: IN_CODE[m.group(1)], render(Element("", "", x.children)))]


@on_tree
def items_in_paragraphs(root: Element) -> None:
    """Item labels as titles, and the text of items, up to a list inside them, in paragraphs."""
    for x in reversed(elements(root)):
        if x.tag == "title" and x.children and isinstance(x.children[-1], str):
            x.children[-1] = x.children[-1].removesuffix(".")
        if x.tag != "li":
            continue
        label = re.fullmatch(r'\s+class="[^"]*"\s+label="([^"]+)"\s*', x.attributes)
        cut = next((k for k, c in enumerate(x.children) if named(c, "ol", "ul")), len(x.children))
        words = trimmed(x.children[:cut])
        if label:
            x.attributes = ""
            words = [Element("title", "", [label.group(1).removesuffix(".")]), *words]
        x.children = [*(words if not words or named(words[0], "p") else [Element("p", "", words)]), *x.children[cut:]]


@on_tree
def hints_in_paragraphs(root: Element) -> None:
    """A hint or solution that is only a list, as a paragraph."""
    for x in elements(root):
        body = trimmed(x.children)
        if x.tag in ("hint", "solution") and body and named(body[0], "ol") and named(body[-1], "ol"):
            x.children = ["\n", Element("p", "", body), "\n"]


#: Elements of math.
MATH = ("m", "me", "men", "md", "mdn")


@on_tree
def answers_in_paragraphs(root: Element) -> None:
    """An answer or quotation that begins with math, as a paragraph."""
    for x in elements(root):
        if x.tag in ("answer", "blockquote") and named(first_of(x.children), *MATH):
            x.children = ["\n", Element("p", "", trimmed(x.children)), "\n"]


def _move_in(root: Element, outer: tuple[str, ...], inner: tuple[str, ...], nested: bool = False) -> None:
    """Elements that follow one of ``outer``, one by one, become its last children; those that hold their like stay."""
    plain = {id(x) for x in elements(root)}
    if not nested:
        holds: dict[int, set[str]] = {}
        for x in reversed(elements(root)):
            inside = set().union(*({c.tag} | holds[id(c)] for c in x.children if isinstance(c, Element)))
            holds[id(x)] = inside & set(inner)
        plain = {k for k in plain if k in holds}
    for x in reversed(elements(root)):
        out: list = []
        into: Element | None = None
        for c in x.children:
            if into is not None and named(c, *inner) and not c.empty and id(c) in plain and (nested or c.tag not in holds[id(c)]):
                while out and is_blank(out[-1]):
                    out.pop()
                into.children += ["\n", c, "\n"]
                out.append("\n")
                continue
            if into is not None and is_blank(c):
                if not out or out[-1] != "\n":
                    out.append(c)
                continue
            if into is not None and isinstance(c, str) and out and out[-1] == "\n" and into.children and into.children[-1] == "\n":
                c = c.lstrip()
            into = c if named(c, *outer) and not c.empty else None
            out.append(c)
        x.children = out


@on_tree
def math_in_paragraphs(root: Element) -> None:
    """Display math after a paragraph is part of it, as are words after it that begin in lower case."""
    display = MATH[1:]
    _move_in(root, ("p",), display, nested=True)
    for x in elements(root):
        out: list = []
        for c in x.children:
            k = len(out) - 1
            while k >= 0 and is_blank(out[k]):
                k -= 1
            before = out[k] if k >= 0 else None
            if named(c, "p") and not c.attributes and named(before, "p") and named(last_of(before.children), *display) and _begins_low(c):
                while is_blank(before.children[-1]):
                    before.children.pop()
                before.children += ["\n", *trimmed(c.children)]
                del out[k + 1 :]
                continue
            if named(c, "me") and not c.attributes and named(before, "figure"):
                del out[k + 1 :]
                out += ["\n", Element("p", "", ["\n", c, "\n"]), "\n"]
                continue
            out.append(c)
        x.children = out


def _begins_low(p: Element) -> bool:
    first = first_of(p.children)
    return isinstance(first, str) and re.match(r"\s*[a-z]", first) is not None


@on_tree
def lists_in_paragraphs(root: Element) -> None:
    """Lists after a paragraph are part of it."""
    _move_in(root, ("p",), ("ol", "ul", "dl"))


@on_tree
def hints_in_activities(root: Element) -> None:
    """Hints, answers and solutions after an activity are part of it."""
    _move_in(root, ("activity", "exploration", "example", "exercise", "question"), ("hint", "answer", "solution"))


@on_tree
def titles_before_paragraphs(root: Element) -> None:
    """A title that begins a paragraph stands before it."""
    for x in elements(root):
        out: list = []
        for c in x.children:
            first = first_of(c.children) if named(c, "p") and not c.attributes else None
            if named(first, "title"):
                c.children = c.children[c.children.index(first) + 1 :]
                out += [first, "\n"]
            out.append(c)
        x.children = out


_AS_WRITTEN = {"mdash": "---", "ndash": "--", "nbsp": " ", "amp": "&", "br": "\\\\"}
_WRITTEN = re.compile(r"<(mdash|ndash|nbsp|amp|br) */>")


def drawings_as_written(text: str) -> str:
    """Drawings with the characters that text conversion made tags of."""
    out, at, opened = [], 0, None
    for m in _DRAWING.finditer(text):
        if m.group(2) == "overpic":
            continue
        if m.group(1) == "begin" and opened is None:
            out.append(text[at : m.end()])
            at, opened = m.end(), m.group(2)
        elif m.group(1) == "end" and m.group(2) == opened:
            out.append(_WRITTEN.sub(lambda x: _AS_WRITTEN[x.group(1)], text[at : m.start()]))
            at, opened = m.start(), None
    return "".join([*out, text[at:]])


@on_tree
def joined_columns(root: Element) -> None:
    """Numbered lists one after the other are the columns of one list; beyond six columns, of two."""
    for x in elements(root):
        out: list = []
        run: list[Element] = []
        blanks: list = []

        def end_run(out=out, run=run, blanks=blanks) -> None:
            if len(run) > 1:
                body = [y for k, c in enumerate(run) for y in ([*(["\n"] if k else []), *trimmed(c.children)])]
                out.append(Element("ol", f' cols="{len(run) if len(run) <= 6 else 2}" ', body))
            else:
                out.extend(run)
            out.extend(blanks)
            run.clear()
            blanks.clear()

        for c in x.children:
            if named(c, "ol") and not c.attributes and not any(named(y, "ol") for y in elements(c)[1:]):
                blanks.clear() if run else out.extend(blanks)
                blanks.clear()
                run.append(c)
            elif is_blank(c) and run:
                blanks.append(c)
            else:
                end_run()
                out.append(c)
        end_run()
        x.children = out


#: What may stand alone where panels would stand side by side.
ALONE = "ol ul definition theorem md figure".split()


@on_tree
def single_side_by_side(root: Element) -> None:
    """Side-by-side panels without a second panel are no panels."""
    for x in reversed(elements(root)):
        out: list = []
        for c in x.children:
            if not named(c, "sidebyside") or c.empty:
                out.append(c)
                continue
            c.children = trimmed(c.children)
            found = [y for y in c.children if isinstance(y, Element) and y.tag != "index"]
            alone = not c.attributes and len(found) == 1 and found[0] is c.children[0] and found[0].tag in ALONE and isinstance(c.children[-1], Element)
            out += c.children if alone else [c]
        x.children = out


@on_tree
def neighbouring_side_by_side(root: Element) -> None:
    """Side-by-side panels that follow one another are one."""
    for x in elements(root):
        out: list = []
        for c in x.children:
            k = len(out) - 1
            while k >= 0 and is_blank(out[k]):
                k -= 1
            if named(c, "sidebyside") and not c.attributes and k >= 0 and named(out[k], "sidebyside"):
                while out[k].children and is_blank(out[k].children[-1]):
                    out[k].children.pop()
                out[k].children += ["\n", *trimmed(c.children)]
                del out[k + 1 :]
            else:
                out.append(c)
        x.children = out


_IMAGE_START, _IMAGE_END = "<!-- START", "END -->"


@on_tree
def images_outside_paragraphs(root: Element) -> None:
    """Marked images out of the paragraph that holds nothing else."""

    def bare(p: Element) -> list | None:
        if p.tag != "p" or p.attributes:
            return None
        body = render(Element("", "", p.children)).strip()
        return ["\n", body, "\n"] if body.startswith(_IMAGE_START) and body.endswith(_IMAGE_END) and body.count(_IMAGE_START) == 1 else None

    for x in elements(root):
        x.children = apart(x.children, bare)


@on_tree
def last_fixes(root: Element) -> None:
    """Breaks are ends of lines, bold is emphasis, dashes between blanks are long."""
    for x in elements(root):
        out: list = []
        for k, c in enumerate(x.children):
            after = x.children[k + 1] if k + 1 < len(x.children) else ""
            if named(c, "br"):
                c = "\n"
            elif named(c, "b") and not c.attributes and not c.empty:
                c.tag = "em"
            elif named(c, "p") and not c.attributes and [getattr(y, "tag", None) for y in trimmed(c.children)] == ["pagebreak"]:
                c = Element("pagebreak", empty=True)
            elif named(c, "m") and not c.attributes and words_of(c).strip() == "\\times":
                c = Element("times", empty=True)
            elif named(c, "ndash") and out and isinstance(out[-1], str) and out[-1][-1:].isspace() and isinstance(after, str) and after[:1].isspace():
                out[-1] = out[-1][:-1] + " "
                c, x.children[k + 1] = Element("mdash", " ", empty=True), " " + after[1:]
            out.append(c)
        x.children = out


@on_tree
def without_empty_tags(root: Element) -> None:
    """Paragraphs of blanks and index entries without a heading go."""

    def empty(c: Element) -> list | None:
        if c.tag == "p" and not c.attributes and all(is_blank(y) or named(y, "nbsp") for y in c.children):
            return ["\n"]
        inner = trimmed(c.children)
        if c.tag == "idx" and len(inner) == 1 and named(inner[0], "h") and first_of(inner[0].children) is None:
            return ["\n"]
        return None

    for x in elements(root):
        x.children = apart(x.children, empty)


_PREFORMATTED = re.compile(r"\\(begin|end)\{genericpreformat\}(?:\s*\[([^\[\]]+)\])?")
_GLOSSARY: dict[str, Action] = {name: (1, filled("#1<idx><h>#1</h></idx>")) for name in ("gls", "Gls")}


def without_empty_labels(text: str) -> str:
    """Rules for pages of any author: empty labels, preformatted blocks, glossary words."""
    text = _TAG.sub(lambda m: f"<{m.group(1)}{m.group(2)}{m.group(3).replace(' label=\"\"', '').rstrip() if ' label=\"\"' in m.group(3) else m.group(3)}{m.group(4)}>", text)
    text = _PREFORMATTED.sub(lambda m: "</pre>" if m.group(1) == "end" else f'<pre class="{m.group(2)}">' if m.group(2) else "<pre>", text)
    return rewrite_uses(clean_code(text), _GLOSSARY, short=lambda use: use)


_SKIP = re.compile(r"\\flexskip\s*\{([^{}]+)\}")


@on_tree
def workspaces(root: Element) -> None:
    """Room that an exercise or task asks for, as an attribute; a text before a solution as a statement."""
    for x in reversed(elements(root)):
        if x.tag not in ("exercise", "task", "subtask") or x.empty:
            continue
        found = [m for c in x.children if isinstance(c, str) for m in _SKIP.finditer(c)] or [m for e in elements(x)[1:] for c in e.children if isinstance(c, str) for m in _SKIP.finditer(c)]
        for e in elements(x) if found else ():
            e.children = [_SKIP.sub("", c) if isinstance(c, str) else c for c in e.children]
        if found:
            x.attributes += f' workspace="{found[0].group(1)}0%"'
        cut = next((k for k, c in enumerate(x.children) if named(c, "solution")), None)
        if cut is not None and not any(e.tag == "statement" for e in elements(x)):
            x.children = [Element("statement", "", x.children[:cut]), "\n", *x.children[cut:]]


def video_links(text: str) -> str:
    """Videos by what follows the last hyphen of their address, as links."""
    link = lambda a: f'&nbsp;&nbsp;<span class="videolink"><a href="https://www.youtube.com/watch?v={a[0].split("&")[0].rsplit("-", 1)[-1]}">&#127909;</a></span>'
    return rewrite_uses(text, {"vvideohref": (1, link)}, short=lambda use: use)


# ---- the writer

# How tags stand: what is before an opening tag and after it, before a closing tag and after it; None leaves what there is.
LAYOUT = [
    ("m row cell", None, "", "", None),
    ("me men md mdn", "\n", "\n  ", "\n", "\n"),
    ("mrow", "\n  ", "", "", "\n"),
    ("p ul ol dl blockquote pre sidebyside figure table image", "\n", "\n", "\n", "\n"),
    ("theorem proposition lemma corollary proof example", "\n\n", "\n", "\n", "\n\n"),
    ("statement tabular", "\n", "\n", "\n", "\n"),
    ("title caption", "\n", "", "", "\n"),
    ("chapter section subsection subsubsection introduction exercises", "\n\n\n", "\n", "\n", "\n"),
    ("tr", "\n", "\n", "\n    ", "\n"),
    ("xi:include", "\n", None, None, None),
]
_PLACES = {tag: tuple(places) for names, *places in LAYOUT for tag in names.split()}
_PLAIN = ("m", "row", "cell", "title", "caption", "p", "ul", "ol", "dl", "blockquote", "pre", "sidebyside", "figure", "table", "image")
#: Blocks of text with an empty line between them.
_TEXT_BLOCKS = ("p", "ul", "ol")


def _gap(left: re.Match | None, right: re.Match | None) -> str | None:
    """What stands between two tags with only blanks between them."""
    sides = []
    for m, closing, opening in ((left, 3, 1), (right, 2, 0)):
        places = _PLACES.get(m.group(2)) if m is not None else None
        if places and not (m.group(3) and m.group(2) in _PLAIN):
            sides.append(places[closing if m.group(1) else opening] if not m.group(4) or m is right else None)
    if left is not None and right is not None:
        names = (left.group(1) + left.group(2), right.group(1) + right.group(2))
        if names in (("li", "p"), ("/p", "/li")):
            return ""
        if names[0][0] == "/" and names[0][1:] in _TEXT_BLOCKS and names[1] in _TEXT_BLOCKS:
            return "\n\n"
        if names == ("/li", "/li") or right.group(2) == "li" and not right.group(1):
            sides.append("\n" if names[1] == "li" and left.group(2) in ("li", "ol", "ul") else None)
    known = [s for s in sides if s is not None]
    return max(known, key=lambda s: (s.count("\n"), len(s))) if known else None


def white_space(text: str) -> str:
    """Each tag where its kind stands: alone on a line, at the start of one, or in the text."""
    tags = list(_TAG.finditer(text))
    out: list[str] = []
    at = 0
    for k, m in enumerate([*tags, None]):
        left = tags[k - 1] if k else None
        between = text[at : m.start() if m else len(text)]
        if between.strip() or left is None or m is None:
            # A paragraph that an item begins or ends with is tight there.
            tight = left is not None and k > 1 and left.group(2) == "p" and not left.group(1) and tags[k - 2].group(2) == "li" and not tags[k - 2].group(1) and not text[tags[k - 2].end() : left.start()].strip()
            after = m is not None and k + 1 < len(tags) and m.group(2) == "p" and m.group(1) and tags[k + 1].group(2) == "li" and tags[k + 1].group(1) and not text[m.end() : tags[k + 1].start()].strip()
            before = "" if tight else _gap(left, None)
            behind = "" if after else _gap(None, m)
            core = between.strip()
            lead, tail = between[: len(between) - len(between.lstrip())], between[len(between.rstrip()) :] if core else ""
            between = (lead if before is None else before) + core + (tail if behind is None else behind) if core else (before if m is None and before is not None else behind if left is None and behind is not None else between)
        else:
            gap = _gap(left, m)
            between = between if gap is None else gap
        out += [between, m.group(0) if m else ""]
        at = m.end() if m else at
    return "".join(out).lstrip()


#: The passes of the structured target, in order, after those of both targets.
STRUCTURED = [
    tables_of_figures, fix_structured_tags, answers_in_paragraphs, hints_in_paragraphs, hints_in_activities, neighbouring_side_by_side, joined_columns, wrap_statements, wrap_drawings,
    math_delimiters, items_in_paragraphs, titles_before_paragraphs, math_in_paragraphs, lists_in_paragraphs, drawings_as_written, last_fixes, white_space, images_outside_paragraphs,
    single_side_by_side, without_empty_tags, without_empty_labels,
]


def _in_turn(text: str, steps: Iterable[Callable]) -> str:
    """Passes one after the other; neighbours that work on the tree share one."""
    root: Element | None = None
    for step in steps:
        if hasattr(step, "tree"):
            root = parse(text) if root is None else root
            step.tree(root)
        else:
            text = step(text if root is None else render(root))
            root = None
    return text if root is None else render(root)


def finish_page(text: str, target: str = "ptx") -> str:
    return _in_turn(fix_tags(text), STRUCTURED if target == "ptx" else ())


def finish(text: Column, target: str = "ptx") -> Column:
    """A page of a target with all its passes; null stays null."""
    return column(lambda t: finish_page(t, target))(text)


# ---- identities

_ID = re.compile(r'(\s(?:xml:)?id=")([^"]*)(")')


def letters() -> Iterator[str]:
    """a to z, then aa, ab and so on."""
    k = 0
    while True:
        name, n = "", k
        while True:
            name = chr(97 + n % 26) + name
            n = n // 26 - 1
            if n < 0:
                break
        yield name
        k += 1


def _unique_ids(root: Element, parents: tuple[str, ...] = ("problem", "exercise"), kinds: tuple[str, ...] = ("solution",)) -> None:
    inside: dict[int, Element | None] = {id(root): None}
    groups: dict[tuple[int, str], list[Element]] = {}
    for x in elements(root):
        own = x if x.tag in parents else inside[id(x)]
        for c in x.children:
            if isinstance(c, Element):
                inside[id(c)] = own
                found = _ID.search(c.attributes) if own is not None and c.tag in kinds else None
                if found:
                    groups.setdefault((id(own), found.group(2)), []).append(c)
    place: dict[int, int] = {}
    todo: list[Element] = [root]
    while todo:  # in the order of the page
        x = todo.pop()
        place[id(x)] = len(place)
        todo.extend(reversed([c for c in x.children if isinstance(c, Element)]))
    for same in groups.values():
        if len(same) > 1:
            for c, letter in zip(sorted(same, key=lambda c: place[id(c)]), letters()):
                c.attributes = _ID.sub(lambda m, letter=letter: m.group(1) + m.group(2) + letter + m.group(3), c.attributes, count=1)


@on_tree
def unique_ids(root: Element) -> None:
    """Solutions of one problem that have one id get a letter each, in the order of the page; other ids stay."""
    _unique_ids(root)
