r"""One form for what authors write in many: archaic and AMS commands, aliases of environments, layout that no page needs.

Literal stretches (verbatim environments, ``\verb``) are left as they are. Everything else is
read twice, each time in one walk over its macros: first macros that are another spelling,
or leave only their arguments or nothing, by a table of names; then, with a stack of what is
open, macros whose form depends on where they stand: tags of the form ``\x ... \endx``,
fractions with an infix, environments, headings, math. No step depends on the order of another.
"""

from __future__ import annotations

import re

from pyspark.sql import Column

from ..catalog import ABBREVIATIONS, ENVIRONMENTS, VERBATIM
from .scanner import column, filled, group_at, rewrite_uses

# Macros, number of arguments, what is left of them.
WITH_ARGUMENTS = [
    ("maxtocdepth", 1, ""), ("hypersetup", 1, ""), ("texorpdfstring", 2, "#1"), ("vadjust", 1, ""), ("AtBeginDocument", 1, "#1"), ("makeop", 1, "\\DeclareMathOperator{\\#1}{#1}"),
    ("thanksref", 1, ""), ("phantom", 1, ""), ("hphantom", 1, ""), ("vphantom", 1, ""), ("markleft", 1, ""), ("date", 1, ""), ("nocite", 1, ""), ("runningtitle", 1, ""), ("runningauthor", 1, ""),
    ("address", 1, ""), ("dedicatory", 1, ""), ("lstset", 1, ""), ("adjustfootnotemark", 1, ""), ("keywords", 1, ""), ("pacs", 1, ""), ("psset", 1, ""), ("enlargethispage", 1, ""),
    ("pagenumbering", 1, ""), ("setboxwidth", 1, ""), ("refstepcounter", 1, ""), ("theoremstyle", 1, ""), ("markright", 1, ""), ("center", 1, "#1"), ("centerline", 1, "#1"),
    ("lowercase", 1, "#1"), ("framebox", 1, "#1"), ("boxed", 1, "#1"), ("setcounter", 2, ""), ("multicolumn", 3, "#3"), ("IEEEPARstart", 2, "#1#2"), ("bibselect", 1, "\\include{#1.ltb}"),
]
# Macros that are only taken away.
DROPPED = (
    "centering newpage newline smallskip medskip bigskip noindent nopagebreak reallynopagebreak smallbreak medbreak bigbreak raggedright pagebreak bigpagebreak "
    "tableofcontents frenchspacing mainmatter dominitoc onehalfspacing nobreak long global"
).split()
# Macros and what they are another spelling of.
SPELLINGS = {
    "bolds": "\\boldsymbol", "vspace": "\\vspace", "hspace": "\\hspace", "bgroup": "{", "egroup": "}", "IEEEnonumber": " ", "printbibliography": "\\bibliography{biblio}", "xspace": " ",
    "nobreakdash": "-", "textemdash": " -- ", "par": "\n\n", "upmu": "\\mu", "upgamma": "\\gamma", "uppsi": "\\psi", "edef": "\\def",
}
# Alphabets of AMS and plain TeX.
ALPHABETS = {"Cal": "mathcal", "Bbb": "mathbb", "bold": "mathbf", "frak": "mathfrak", "roman": "mathrm", "slanted": "mathit"}
# Tags \x ... \endx that are a macro of one argument, or an environment.
TAGS_OF_MACROS = {"title": "title", "author": "author", "address": "address", "email": "email", "keywords": "keywords", "head": "section*", "heading": "section*", "specialhead": "chapter*", "subhead": "subsection*", "subheading": "subsection*"}
TAGS_OF_ENVIRONMENTS = {"abstract": "abstract", "document": "document", "Refs": "thebibliography", "demo": "proof", "proof": "proof", "roster": "enumerate", "block": "quote"}
MATH_TAGS = "matrix pmatrix bmatrix vmatrix Vmatrix smallmatrix cases align aligned alignedat gather gathered split multline xalignat".split()
SCRIPT_TAGS = {"Sb": "_", "Sp": "^"}
#: Statements of AMS-TeX, whose heading is an argument, end in these.
STATEMENT_TAGS = {"proclaim", "definition", "remark", "example"}
# Infixes of plain TeX, and macros whose argument has rows that end in \cr.
INFIXES = {"over": "frac", "choose": "binom", "atop": "genfrac{}{}{0pt}{}"}
ROWS = {"matrix": "matrix", "pmatrix": "pmatrix", "cases": "cases", "eqalign": "aligned", "displaylines": "gathered"}
# Environments of other packages, and environments that are only taken away.
ENVIRONMENT_NAMES = {
    "IEEEproof": "proof", "IEEEeqnarray": "eqnarray", "IEEEkeywords": "keywords", "bibsection": "thebibliography", "displayquote": "quote", "smallmatrix": "matrix",
    "numlist": "enumerate", "enumlist": "enumerate",
}
UNWRAPPED_ENVIRONMENTS = ["subequations", "smaller", "small", "tiny", "footnotesize", "titlepage", "multicols"]
DELETED_ENVIRONMENTS = ["classification", "keywords", "keyword"]
#: Arguments of environments that say where or how wide they are.
PLACED_ENVIRONMENTS = {"multicols": 1, "wrapfigure": 2}
#: Macros whose argument may stand apart; fonts that have no business in math of their own.
TIGHT = ("ref", "cite", "eqref", "caption")
FONTS_AS_MATH = ("emph", "it", "em", "rm", "mathit", "mathrm")
HEADINGS = ("chapter", "section", "subsection", "subsubsection")
#: What a quotation in straight closing marks may hold.
QUOTED = re.compile(r"([^`'\x22\n]{0,50})\x22")
NOTHING_WIDE = re.compile(r"[0.]*(?:in|pt|cm|mm|em|ex)")

_LITERAL = re.compile(r"\\begin\{(" + "|".join(VERBATIM) + r")\}|\\verb\*?([^A-Za-z\s*])")
_TOKEN = re.compile(r"\\(?:([A-Za-z]+)(\*?)|.)|\$\$?|``|[{}]", re.S)
_ALIAS = {a: name for name, aliases in ABBREVIATIONS.items() for a in aliases.split()}
_KNOWN = {m for _, _, _, names in ENVIRONMENTS for m in names.split()}
_ACTIONS = {name: (0, filled("")) for name in DROPPED} | {name: (0, filled(text)) for name, text in SPELLINGS.items()} | {name: (0, filled(f"\\{text} ")) for name, text in ALPHABETS.items()}
_ACTIONS |= {name: (count, filled(template)) for name, count, template in WITH_ARGUMENTS}


def environment_name(name: str) -> str:
    """The catalogue's name of an environment: other packages' names, aliases and any case."""
    name = ENVIRONMENT_NAMES.get(name, name)
    low = name.lower()
    return _ALIAS.get(low) or (low if low in _KNOWN or low in ABBREVIATIONS else name)


class _Walk:
    """One walk over the tokens of a text; ``out`` is what it has become so far."""

    def __init__(self, text: str, archaic: bool):
        self.text, self.archaic, self.at = text, archaic, 0
        self.out: list[str] = []
        #: Open groups and math as [sign, place in out, place of an infix, what ends it]; places in out of open tags.
        self.groups: list[list] = []
        self.tags: dict[str, list[int]] = {}
        self.math, self.rows = "", 0

    def run(self) -> str:
        text = self.text
        while (m := _TOKEN.search(text, self.at)) is not None:
            self.out.append(text[self.at : m.start()])
            self.at = m.end()
            token = m.group(0)
            if m.group(1):
                self._macro(m.group(1), token)
            elif token[0] == "$":
                self._dollar(token)
            elif token in "{}":
                self._bracket(token)
            elif token == "``":
                self._quotation()
            else:
                self._symbol(token)
        self.out.append(text[self.at :])
        return "".join(self.out)

    # What stands at the present place.

    def _group(self) -> str | None:
        """The content of a braced argument, which is passed over."""
        start, end = group_at(self.text, self.at)
        if start == end:
            return None
        self.at = end
        return self.text[start + 1 : end - 1]

    def _option(self) -> str | None:
        start, end = group_at(self.text, self.at, "[", "]")
        if start == end:
            return None
        self.at = end
        return self.text[start + 1 : end - 1]

    def _skip(self, pattern: str) -> str:
        m = re.compile(pattern).match(self.text, self.at)
        self.at = m.end() if m else self.at
        return m.group(0) if m else ""

    # Signs.

    def _dollar(self, sign: str) -> None:
        if self.math:
            closes = self.math == sign or sign == "$$"
            self._close(sign) if closes else self.out.append(sign)
            self.math = "" if closes else self.math
            return
        alone = re.compile(r"\s*\\([A-Za-z]+)\s*").match(self.text, self.at)
        if sign == "$" and alone and alone.group(1) == "qed" and self.text.startswith("$", alone.end()):
            self.out.append("\\qed")
            self.at = alone.end() + 1
        elif sign == "$" and alone and alone.group(1) in FONTS_AS_MATH and not self.text[self.at].isspace():
            start, end = group_at(self.text, alone.end())
            if start < end and self.text.startswith("$", end):
                self.out.append(f"\\{alone.group(1)}{self.text[start:end]}")
                self.at = end + 1
            else:
                self._open(sign)
                self.math = sign
        elif alone and sign == "$$" and alone.group(1) in ("align", "aligned"):
            self.math = ""  # the environment is display math itself
        else:
            self._open(sign)
            self.math = sign

    def _bracket(self, sign: str) -> None:
        if sign == "{":
            self._open(sign)
        else:
            self._close(sign)

    def _open(self, sign: str, start: str = "", end: str = "") -> None:
        """A group or math opens; ``start`` and ``end`` are what its signs become."""
        self.groups.append([sign, len(self.out), None, end])
        self.rows += end.startswith("\\end") and end != "\\end{abstract}\n\n"
        self.out.append(start or sign)

    def _open_argument(self, start: str, end: str) -> bool:
        """Opens the braced argument at the present place with other signs, if there is one."""
        first, last = group_at(self.text, self.at)
        if first < last:
            self._open("{", start, end)
            self.at = first + 1
        return first < last

    def _close(self, sign: str) -> None:
        wanted = "{" if sign == "}" else self.math
        if not self.groups or self.groups[-1][0] != wanted:
            self.out.append(sign)
            return
        _, start, infix, end = self.groups.pop()
        self.rows -= end.startswith("\\end") and end != "\\end{abstract}\n\n"
        if infix is not None:
            self.out[start] += f"\\{INFIXES[self.out[infix]]}{{"
            self.out[infix] = "}{"
            sign = "}" + sign
        self.out.append(sign[:-1] + end if end else sign)

    def _quotation(self) -> None:
        m = QUOTED.match(self.text, self.at)
        if m:
            self.at = m.end()
        self.out.append(f"``{m.group(1)}''" if m else "``")

    def _symbol(self, token: str) -> None:
        if token == "\\$":
            self.out.append("\\dollar")
        elif token == "\\/":  # italic correction, with the blank that ends it
            self._skip(r"\s(?=\S)") and self.out.append(" ")
        elif token == "\\\\" and self.text.startswith("$", self.at):
            self.out.append("\\\\ ")
        elif token == "\\[" and (m := re.compile(r"\s*\\align(?:ed)?(?![A-Za-z])").match(self.text, self.at)):
            self.at = m.start()
        else:
            self.out.append(token)

    # Macros.

    def _macro(self, name: str, token: str) -> None:
        if name in ("begin", "end"):
            self._environment(name)
        elif name == "iffalse":
            self._passed_over()
        elif name == "footnote":
            self._option()
            self.out.append(token)
        elif name in TIGHT:
            self._skip(r"\s+(?=\{)")
            self.out.append(token)
        elif name.startswith("subfigure") and len(name) > len("subfigure"):
            pass
        elif name == "penalty":
            self._skip(r"\s*-?[0-9]+")
        elif name in ("parskip", "baselineskip"):
            self._skip(r"[^\n]*\n?")
        elif name == "rule":
            self._rule(token)
        elif name in HEADINGS:
            self._heading(token)
        elif name in INFIXES and self.groups and self.groups[-1][2] is None:
            self.groups[-1][2] = len(self.out)
            self.out.append(name)
        elif name in ("eqno", "leqno"):
            number = self._skip(r"\s*\(?[0-9A-Za-z.]+\)?").strip().strip("()")
            self.out.append(f"\\tag{{{number}}}")
        elif name in ROWS and self._open_argument(f"\\begin{{{ROWS[name]}}}", f"\\end{{{ROWS[name]}}}"):
            pass
        elif name == "cr" and self.rows:
            self.out.append("\\\\")
        elif name == "abstract" and self._open_argument("\\begin{abstract}", "\\end{abstract}\n\n"):
            pass
        elif name.startswith("end") and name[3:] or name == "qed":
            self._tag_ends("proof" if name == "qed" else name[3:], token)
        else:
            self._tag_begins(name, token)

    def _tag_begins(self, name: str, token: str) -> None:
        known = name in MATH_TAGS or name in SCRIPT_TAGS or name in ("proof", "demo") or self.archaic and (name in TAGS_OF_MACROS or name in TAGS_OF_ENVIRONMENTS or name in STATEMENT_TAGS)
        if known and not token.endswith("*"):
            self.tags.setdefault(name, []).append(len(self.out))
        self.out.append(token)

    def _tag_ends(self, name: str, token: str) -> None:
        name = "demo" if name == "proof" and not self.tags.get("proof") else name
        if not self.tags.get(name):
            self.out.append(token)
            return
        start = self.tags[name].pop()
        out = self.out
        if name in TAGS_OF_MACROS:
            if start + 1 < len(out):
                out[start + 1], out[-1] = out[start + 1].lstrip(), out[-1].rstrip() if start + 1 < len(out) - 1 else out[-1].strip()
            out[start] = f"\\{TAGS_OF_MACROS[name]}{{"
            out.append("}")
        elif name in SCRIPT_TAGS:
            out[start] = f"{SCRIPT_TAGS[name]}{{"
            out.append("}")
        elif name in STATEMENT_TAGS:
            # The heading names the statement: Theorem 2.1, Definition, ...
            heading = re.compile(r"\s*\{?\s*([A-Za-z]*)").match("".join(out[start + 1 : start + 5]))
            marker = environment_name(heading.group(1) or name)
            marker = marker if marker in _KNOWN else name if name in _KNOWN else "theorem"
            close = next((k for k in range(start + 1, len(out)) if out[k] == "}"), None) if heading.group(0).lstrip().startswith("{") else None
            out[start : start + 1 if close is None else close + 1] = [f"\\begin{{{marker}}}"]
            out.append(f"\\end{{{marker}}}")
        else:
            marker = TAGS_OF_ENVIRONMENTS.get(name, "align" if name == "aligned" and not self.math else name)
            marker = ENVIRONMENT_NAMES.get(marker, marker)
            out[start] = f"\\begin{{{marker}}}"
            out.append(f"\\end{{{marker}}}")
            if name in ("align", "aligned") and not self.math:
                self._skip(r"\s*(?:\$\$|\\\])")

    def _environment(self, which: str) -> None:
        self._skip(r"\s+(?=\{)")
        name = self._group()
        if name is None or not re.fullmatch(r"[A-Za-z]+\*?", name):
            self.out.append(f"\\{which}" if name is None else f"\\{which}{{{name}}}")
            return
        bare, star = name.rstrip("*"), "*" if name.endswith("*") else ""
        if bare in UNWRAPPED_ENVIRONMENTS:
            for _ in range(PLACED_ENVIRONMENTS.get(bare, 0) if which == "begin" else 0):
                self._group()
            self._skip(r"\s*")
        elif bare in DELETED_ENVIRONMENTS or ENVIRONMENT_NAMES.get(bare) in DELETED_ENVIRONMENTS:
            held = self.tags.setdefault(f"begin {bare}", [])
            if which == "begin":
                held.append(len(self.out))
            elif held:
                start = held.pop()
                del self.out[start:]
                while self.groups and self.groups[-1][1] >= start:
                    self.groups.pop()
                self.tags = {k: [x for x in v if x < start] for k, v in self.tags.items()}
        else:
            self.out.append(f"\\{which}{{{environment_name(bare)}{star}}}")
            for _ in range(PLACED_ENVIRONMENTS.get(bare, 0) if which == "begin" else 0):
                self._option()
                self._group()

    def _passed_over(self) -> None:
        depth = 1
        for m in re.compile(r"\\(if(?!f(?![A-Za-z])|thenelse)[a-zA-Z@]*|fi(?![A-Za-z]))").finditer(self.text, self.at):
            depth += 1 if m.group(1) != "fi" else -1
            if not depth:
                self.at = m.end()
                return

    def _rule(self, token: str) -> None:
        before = self.at
        self._option()
        wide, high = self._group(), self._group()
        if high is None or not (NOTHING_WIDE.fullmatch(wide.strip()) or NOTHING_WIDE.fullmatch(high.strip())):
            self.at = before
            self.out.append(token)

    def _heading(self, token: str) -> None:
        """A label that stands first in a heading's title follows the heading."""
        start, end = group_at(self.text, self.at)
        if start == end or not self.text.startswith("\\label", start + 1):
            self.out.append(token)
            return
        first, last = group_at(self.text, start + 1 + len("\\label"))
        if first == last or last >= end - 1:
            self.out.append(token)
            return
        self.out.append(token)
        self._open("{", end=f"}}\\label{self.text[first:last]}")
        self.at = last


def _plain(text: str, archaic: bool = False) -> str:
    return _Walk(rewrite_uses(text, _ACTIONS, short=lambda use: use), archaic).run() if "\\" in text or "$" in text or "``" in text else text


def literal_spans(text: str) -> list[tuple[int, int]]:
    """The spans of literal stretches, in order."""
    out, at = [], 0
    ends = {name: text.rfind(f"\\end{{{name}}}") for name in VERBATIM}
    while (m := _LITERAL.search(text, at)) is not None:
        sign = f"\\end{{{m.group(1)}}}" if m.group(1) else m.group(2)
        stop = text.find(sign, m.end()) if not m.group(1) or ends[m.group(1)] >= m.end() else -1
        if stop < 0:
            at = m.end()
            continue
        at = stop + len(sign)
        out.append((m.start(), at))
    return out


def _outside(text: str, rewrite) -> str:
    """A text with what stands outside literal stretches rewritten; ``rewrite`` gets a piece and whether it begins the text."""
    out, at = [], 0
    for start, end in literal_spans(text):
        out += [rewrite(text[at:start], at == 0), text[start:end]]
        at = end
    return "".join([*out, rewrite(text[at:], at == 0)])


def canonical_text(text: str) -> str:
    archaic = "\\documentstyle" in text or "\\begin{document}" not in text
    return _outside(text, lambda piece, first: _plain(piece, archaic))


def canonical(text: Column) -> Column:
    """A text in canonical form; null stays null."""
    return column(canonical_text)(text)


def _uncommented(text: str, starts_line: bool = True) -> str:
    """Text without comments: one that fills its line takes the line along, others join it with the next."""
    lines, out, joined = text.split("\n"), [], False
    for k, line in enumerate(lines):
        last = k == len(lines) - 1
        line = line.lstrip(" \t") if joined else line
        sign = re.search(r"(?<!\\)%", line)
        if not sign:
            out.append(line if last else line + "\n")
            joined = False
        elif not line[: sign.start()].strip(" \t") and (k or starts_line) and not joined:
            continue  # a line that is a comment
        else:
            out.append(line[: sign.start()])
            joined = True
    return "".join(out)


def uncommented(text: str) -> str:
    """A text without its comments; literal stretches keep their signs."""
    return _outside(text, _uncommented)


def without_comments(text: Column) -> Column:
    """``uncommented`` of a column; null stays null."""
    return column(uncommented)(text)
