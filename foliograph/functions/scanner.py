"""Bracket scanning: nesting is not regular, so these are Arrow-batched Python functions.

A text's brackets are paired once, in one walk; after that the group at any place is a
lookup, also in texts whose groups never close. Macros are read by one walk too, which
takes what stands in their arguments along, so nesting of any depth costs no more.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Mapping
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANK = re.compile(r"\s*")
_MACRO = re.compile(r"\\(?:([A-Za-z]+)\*?|.)", re.S)


@lru_cache(16)
def group_ends(text: str, left: str = "{", right: str = "}") -> dict[int, int]:
    """Where the group of each opening bracket ends; those that never close are not in it.

    A bracket after a backslash does not count, unless the backslash itself is escaped.
    """
    ends, held = {}, []
    for m in re.finditer(rf"\\.|[{re.escape(left + right)}]", text, re.S):
        if m.group(0) == left:
            held.append(m.start())
        elif m.group(0) == right and held:
            ends[held.pop()] = m.end()
    return ends


def group_at(text: str, at: int = 0, left: str = "{", right: str = "}") -> tuple[int, int]:
    """(start, end) of the bracket group at ``at``, white space before it skipped; start = end without one."""
    start = _BLANK.match(text, at).end()
    return start, group_ends(text, left, right).get(start, start) if text.startswith(left, start) else start


@lru_cache(16)
def _plain_group(left: str, right: str) -> re.Pattern:
    """A group that holds no bracket but escaped ones."""
    other = rf"[^{re.escape(left + right)}\\]*+"
    return re.compile(rf"{re.escape(left)}{other}(?:\\.{other})*+{re.escape(right)}", re.S)


@lru_cache(16)
def _bracket_marks(left: str, right: str) -> re.Pattern:
    return re.compile(rf"\\.|[{re.escape(left + right)}]", re.S)


class Groups:
    """The groups of one text for places that are asked for from left to right; only what they hold is read, and once.

    Same groups as those of ``group_ends``, for brackets that no backslash stands before.
    """

    def __init__(self, text: str, left: str = "{", right: str = "}"):
        self.text, self.left, self.right, self.at = text, left, right, 0
        self.held: list[int] = []
        self.ends: dict[int, int] = {}
        self.marks = _bracket_marks(left, right)
        self.plain = _plain_group(left, right)

    def end(self, start: int) -> int | None:
        """Where the group of the bracket at ``start`` ends; none where it never closes."""
        if start >= self.at:  # what was open before does not end inside
            self.at = start
            self.ends.clear()
            self.held.clear()
        elif start in self.ends:
            return self.ends[start]
        search, text, held = self.marks.search, self.text, self.held
        while self.at <= start or self._is_open(start):
            m = search(text, self.at)
            if m is None:
                self.at = len(text) + 1
                return None
            self.at = m.end()
            if m.group(0) == self.left:
                held.append(m.start())
            elif m.group(0) == self.right and held:
                self.ends[held.pop()] = self.at
        return self.ends.get(start)

    def _is_open(self, start: int) -> bool:
        k = bisect_left(self.held, start)
        return self.at <= len(self.text) and k < len(self.held) and self.held[k] == start

    def group_at(self, at: int) -> tuple[int, int]:
        """As ``group_at``."""
        start = _BLANK.match(self.text, at).end()
        if not self.text.startswith(self.left, start):
            return start, start
        if plain := self.plain.match(self.text, start):
            return start, plain.end()
        end = self.end(start)
        return start, start if end is None else end


def first_group(text: str, left: str = "{", right: str = "}") -> tuple[str, str]:
    """The leading bracket group with its brackets, and the text after it.

    White space before it is skipped. Without a group the first part is empty; an open
    group that never closes loses its bracket.
    """
    text = text or ""
    start, end = group_at(text, 0, left, right)
    if start == end:
        return "", text[start + text.startswith(left, start) :]
    return text[start:end], text[end:]


def arguments_at(text: str, at: int, count: int) -> tuple[list[str], int]:
    """Up to ``count`` braced arguments from ``at`` on, without their braces, and where they end."""
    found = []
    for _ in range(count):
        start, end = group_at(text, at)
        if start == end:
            break
        found.append(text[start + 1 : end - 1])
        at = end
    return found, at


def strip_groups(text: str, left: str = "{", right: str = "}", depth: int | None = None) -> str:
    """``text`` without whole outer layers of brackets, at most ``depth`` of them."""
    ends, at, tails = group_ends(text, left, right), 0, []
    stop = len(text)
    while depth is None or len(tails) < depth:
        start = _BLANK.match(text, at, stop).end()
        if start not in ends or ends[start] > stop:
            break
        tails.append(text[ends[start] : stop])
        at, stop = start + 1, ends[start] - 1
    return text[at:stop] + "".join(reversed(tails))


def balanced(text: str) -> bool:
    bare = re.sub(r"\\\\|\\[{}]", "", text)
    return bare.count("{") == bare.count("}")


#: What a macro's arguments become, and how many it takes.
Action = tuple[int, Callable[[list[str]], str]]
_SINGLE = re.compile(r"\s*(\\[A-Za-z]+|[0-9A-Za-z])")


def filled(template: str) -> Callable[[list[str]], str]:
    """The action that puts arguments in place of ``#1`` to ``#9``."""
    parts = re.split(r"#([1-9])", template)
    if len(parts) == 1:
        return lambda args: template
    return lambda args: "".join(p if k % 2 == 0 else args[int(p) - 1] if int(p) <= len(args) else f"#{p}" for k, p in enumerate(parts))


def rewrite_uses(text: str, actions: Mapping[str, Action], bare: bool = False, short: Callable[[str], str] = lambda use: "") -> str:
    r"""Each use of the macros of ``actions`` by what they make of it, uses inside arguments first.

    Arguments are braced; ``bare`` also takes a digit, a letter or a macro. A use with fewer arguments becomes
    what ``short`` makes of it, nothing by default. One walk: an open use waits on a stack while its arguments are read.
    """
    ends = group_ends(text)
    stack: list[list] = [[None, [], [], [], len(text)]]  # action, spans to come, arguments so far, parts of the current one, where it stops
    at = 0
    while True:
        action, spans, args, parts, stop = stack[-1]
        m = _MACRO.search(text, at, stop)
        if m is None:
            parts.append(text[at:stop])
            if action is None:
                return "".join(parts)
            args.append("".join(parts))
            if len(spans) > 1:
                spans.pop(0)
                stack[-1][3], stack[-1][4], at = [], spans[0][1], spans[0][0]
                continue
            stack.pop()
            at = spans[0][2]
            stack[-1][3].append(action(args))
            continue
        parts.append(text[at : m.start()])
        at = m.end()
        known = actions.get(m.group(1)) if m.group(1) else None
        if known is None:
            parts.append(m.group(0))
            continue
        count, use = known
        found, end = [], at
        while len(found) < count:
            start = _BLANK.match(text, end).end()
            single = None
            if start in ends and start < stop:
                found.append((start + 1, ends[start] - 1, ends[start]))
            elif bare and (single := _SINGLE.match(text, end, stop)):
                found.append((single.start(1), single.end(1), single.end()))
            else:
                break
            end = found[-1][2]
        if len(found) < count:
            parts.append(short(m.group(0)))
        elif not count:
            parts.append(use([]))
        else:
            stack.append([use, found, [], [], found[0][1]])
            at = found[0][0]


def rewrite_macro(text: str, name: str, count: int, template: str) -> str:
    r"""Every ``\name`` with ``count`` braced arguments by ``template``, in which ``#k`` is argument k.

    Inner uses are rewritten too. A use with fewer arguments loses its macro only.
    """
    return rewrite_uses(text, {name: (count, filled(template))})


def nth_argument(text: str, name: str, number: int = 1) -> str:
    """Argument ``number`` of the first use of a macro; empty without it."""
    m = re.search(rf"\\{re.escape(name)}(?![A-Za-z])", text or "")
    args = arguments_at(text, m.end(), number)[0] if m else []
    return args[number - 1] if len(args) == number else ""


def delete_environment(text: str, name: str) -> str:
    """``text`` without its environments of a name, each up to the first end."""
    return re.sub(rf"\\begin\{{{re.escape(name)}\}}.*?\\end\{{{re.escape(name)}\}}", "", text, flags=re.S)


def column(function, kind: T.DataType = T.StringType()):  # noqa: B008
    """A function of one text as a column function; null stays null."""

    @F.pandas_udf(kind)
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda x: None if x is None else function(x))

    return run


@F.pandas_udf(T.StructType([T.StructField("group", T.StringType()), T.StructField("rest", T.StringType())]))
def split_group(text: pd.Series) -> pd.DataFrame:
    """``first_group`` of a column."""
    return pd.DataFrame([first_group(x) for x in text], columns=["group", "rest"])


strip_outer = column(strip_groups)


def macro_column(name: str, count: int, template: str):
    """``rewrite_macro`` as a column function; an empty template deletes, ``#1`` keeps the argument."""
    return column(lambda text: rewrite_macro(text, name, count, template) if "\\" + name in text else text)


def expand_conditionals(text: str) -> str:
    r"""Resolve ``\ifthenelse{test}{yes}{no}``: yes only where the test reads ``true``."""
    return rewrite_uses(text, {"ifthenelse": (3, lambda a: a[1] if a[0].strip() == "true" else a[2])})


choose_branches = column(expand_conditionals)
