"""Markup conversion per target: accents, fonts, spacing, deleted formatting, text macros.

Everything that is regular is a rule fold. Macros with braced arguments go through one
Arrow-batched function that walks a text once, inner groups first.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .accents import ACCENTS
from .rules import apply_rules
from .scanner import Action, filled, rewrite_uses

# Font macro, element for each target.
FONTS = [
    ("emph", "em", "em"), ("termx", "em", "em"), ("textbf", "b", "b"), ("bfseries", "b", "b"), ("textit", "i", "em"), ("tmtextit", "i", "em"),
    ("textsl", "em", "em"), ("textsf", "em", "em"), ("texttt", "tt", "c"), ("textsc", "span", "sc"), ("underline", "u", "u"),
]
# Font switches inside braces and the macros they stand for.
SWITCHES = [(s, f"text{s}") for s in ("it", "sl", "sc", "tt", "bf", "sf")]
# Formatting that is deleted.
DELETED = (
    "centering newpage smallskip medskip bigskip noindent nopagebreak reallynopagebreak smallbreak medbreak bigbreak raggedright pagebreak bigpagebreak "
    "tableofcontents frenchspacing snug large Large LARGE huge Huge HUGE normalsize small newfootnote"
).split()
DELETED_WITH_ARGUMENT = (
    "nocite runningtitle runningauthor address dedicatory lstset adjustfootnotemark keywords pacs psset enlargethispage pagenumbering setboxwidth refstepcounter "
    "theoremstyle markright markleft hspace vspace"
).split()
UNWRAPPED = "centerline lowercase framebox boxed text mbox textup ensuremath".split()

# Text macros, number of arguments, template for each target.
TEXT_MACROS = [
    ("paragraph", 1, "<br /><br />\n<b>#1</b> ", "#1"), ("paragraphs", 1, "<br /><br />\n<b>#1</b> ", "\\paragraphs{#1}"), ("enquote", 1, "&ldquo;#1&rdquo;", "<q>#1</q>"),
    ("textsuperscript", 1, "<sup>#1</sup>", "<sup>#1</sup>"), ("textcolor", 2, "#2", "#2"), ("numberwithin", 2, "", ""), ("addtolength", 2, "", ""), ("markboth", 2, "", ""),
    ("color", 2, "#2", "#2"), ("newline", 0, "<br />", "<br />"), ("indent", 0, "&nbsp;" * 8, ""), ("hrule", 0, '\n<hr style="width:50%;" align="left" />\n', '\n<hr style="width:50%;" align="left" />\n'),
    ("lq", 0, "`", "`"), ("ldots", 0, "...", "<ellipsis />"), ("dots", 0, "...", "<ellipsis />"), ("xautoref", 1, "#1", '<xref ref="#1" autoname="yes" />'),
    ("href", 2, '<a href="#1">#2</a>', '<url href="#1">#2</url>'), ("url", 1, '<a href="#1">#1</a>', '<url href="#1"/>'), ("knownterminology", 1, '<span class="terminology">#1</span>', "<term>#1</term>"),
    ("terminology", 1, '<span class="terminology">#1</span>', "<term>#1</term>"), ("knownindex", 1, "", "<idx>#1</idx>"), ("index", 1, "", "<idx><h>#1</h></idx>"),
]
# Commands without meaning in text.
DELETED_IN_TEXT = (
    "nopagebreak reallynopagebreak pagebreak bigpagebreak leavevmode goodbreak NoBlackBoxes nolinebreak unskip hfil hfill vfil vfill makeatletter makeatother tiny footnotesize "
    "scriptsize normalsize onehalfspace rm itshape slshape upshape protect topmatter endtopmatter eject mathopen paperintro backmatter printindex makeshorttitle clearpage today "
    "boldmath allowdisplaybreaks"
).split()

#: Accented letters have entities by a rule: letter and accent name.
_SIGNS = [(sign, name) for sign, name, _ in ACCENTS if name not in ("dot", "macr", "dblac")]
ACCENT_RULES = [
    (r"\\([^A-Za-z\s])\{\\([ij])\}", r"\\$1$2"),
    *[(rf"\\{re.escape(sign)}\{{([a-zA-Z])\}}", f"&$1{name};") for sign, name in _SIGNS],
    *[(rf"\\{re.escape(sign)}([a-zA-Z])", f"&$1{name};") for sign, name in _SIGNS if not sign.isalpha()],
    (r"\{\\ss\}", "&szlig;"),
    (r"\{\\([oO])\}", "&$1slash;"),
    (r"\{\\(oe|OE|ae|AE)\}", "&$1lig;"),
    (r"\\S(?![a-zA-Z]) ?", "&#xa7;"),
]
DASH_RULES = [(r"([^-])---([^-])", "$1&#8202;&#x2014;&#8202;$2"), (r"--", "&#x2013;")]
#: Stands after what a macro without arguments leaves, until the blank there is taken.
_EATEN = "\0\ue001"
SPACE = {"html": "&nbsp;", "ptx": "<nbsp/>"}


def spacing_rules(target: str) -> list[tuple[str, str]]:
    s = SPACE[target]
    return [
        (r"(?<!\\)~~", s * 4),
        (r"(?<!\\)~", s),
        (r"(?<!\\)\\ ", s),
        (r"\\quad\b", s * 2),
        (r"\\qquad\b", s * 3),
        (r"^\s*(?:\\\\)+", ""),
        (r"\\linebreak\b", "<br/>"),
        (r"\\\\(?:\[[^\[\]]*\])?", "<br/>"),
    ]


def macro_table(target: str) -> dict[str, tuple[int, str]]:
    k = 1 if target == "html" else 2
    table = {row[0]: (1, f"<{row[k]}>#1</{row[k]}>") for row in FONTS}
    table |= {name: (1, "") for name in DELETED_WITH_ARGUMENT} | {name: (1, "#1") for name in UNWRAPPED}
    table |= {name: (0, "") for name in DELETED + DELETED_IN_TEXT}
    return table | {row[0]: (row[1], row[k + 1]) for row in TEXT_MACROS}


def cut(table: dict[str, tuple[int, str]]) -> dict[str, Action]:
    return {name: (n, filled(template if n else template + _EATEN)) for name, (n, template) in table.items()}


@lru_cache
def macro_actions(target: str) -> dict[str, Action]:
    """The table of a target with its templates cut, once and not for each text."""
    return cut(macro_table(target))


def convert(text: str, table: dict[str, tuple[int, str]]) -> str:
    """Replace macros by their templates, arguments first; other text is left as it is."""
    return convert_by(text, cut(table))


def convert_by(text: str, actions: dict[str, Action]) -> str:
    """As ``convert``, by templates that are cut."""
    if "\\" not in text and _EATEN not in text:
        return text
    text = re.sub(r"\{\\(it|sl|sc|tt|bf|sf)\b\s*", lambda m: "\\text" + m.group(1) + "{", text)
    # A macro without arguments takes the blank after it along.
    return rewrite_uses(text, actions, short=lambda use: use).replace(f"{_EATEN} ", "").replace(_EATEN, "")


def _converter(target: str):
    @F.pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda x: None if x is None else convert_by(x, macro_actions(target)))

    return run


def _where_marked(text: Column, done: Column) -> Column:
    """What all rules leave alone, texts without a backslash, a tie or a dash of two, is not matched against each of them."""
    return F.when(text.rlike("[\\\\~]|--"), done).otherwise(text)


def tex_to_html(text: Column) -> Column:
    return _where_marked(text, apply_rules(_converter("html")(text), ACCENT_RULES + DASH_RULES + spacing_rules("html")))


def tex_to_ptx(text: Column) -> Column:
    """Spacing before accents, as tags must not be taken for text."""
    return _where_marked(text, apply_rules(_converter("ptx")(text), ACCENT_RULES + [(r"--", "&#x2013;")] + spacing_rules("ptx")))
