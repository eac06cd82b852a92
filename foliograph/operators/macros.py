r"""Author macros: extraction, filters, usage, expansion; declared theorems."""

from __future__ import annotations

import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import aliases
from ..functions.scanner import balanced, filled, group_at, rewrite_uses, strip_groups
from ..session import ship

FOUND = "ordinal int, start int, end int, command string, name string, numargs int, default string, definition string"
_COMMAND = re.compile(r"\\(let|def|newcommand|renewcommand|providecommand|DeclareMathOperator)(?![A-Za-z])\*?")
_NAME = re.compile(r"\s*(?:\{\s*\\([A-Za-z]+|[^A-Za-z])\s*\}|\\([A-Za-z]+|[^A-Za-z]))")
_LET = re.compile(r"\s*=?\s*(\\[A-Za-z]+|\S)")
_PLACES = re.compile(r"(?:#[1-9])*")
_COUNT = re.compile(r"\s*\[([0-9])\]")

# Macros that an author cannot redefine.
KNOWN_MACROS = "ref eqref cite href emph textbf textit texttt mathcal mathbb Cal rm date address hfill S H begin end term terminology knownterminology index sum prod int i u".split()
# Macros whose definitions are not taken over.
IGNORED_MACROS = (
    "thetitle theshorttitle theauthors lastauthor theshortauthors theaddress thededicatory doubletitle singletitle lefthead righthead maketitle bysame "
    "thesection thesubsection thesubsubsection xymatrix urladdr email isdraft newcommand bar frac cr \\ to ref href eqref cite qed big mod bmod pmod mid nmid label "
    "longlongrightarrow longlonglongrightarrow sum prod mathcal mathbb bibitem endbibitem gamma mu begin end address"
).split()
# Macros that are another name of one.
RENAMED_MACROS = [("upmu", "mu"), ("upgamma", "gamma"), ("uppsi", "psi")]
#: A definition with one of these shapes the document and is expanded before its structure is read.
STRUCTURAL = r"\\(?:begin|end|(?:sub)*section|item|bibitem|ref|cite|label|newcommand|DeclareMathOperator)(?![A-Za-z])"


def find_macros(text: str) -> list[tuple[int, int, str, str, int, str, str]]:
    """(start, end, command, name, numargs, default, definition) in order of appearance.

    A command that defines nothing (no name, no closed body) is ordinary text.
    """
    out, at = [], 0
    while (m := _COMMAND.search(text, at)) is not None:
        at = m.end()
        name = _NAME.match(text, at)
        if not name:
            continue
        end, word, n, default = name.end(), name.group(1) or name.group(2), 0, ""
        if m.group(1) == "let":
            other = _LET.match(text, end)
            if other:
                at = other.end()
                out.append((m.start(), at, m.group(1), word, 0, "", other.group(1)))
            continue
        if m.group(1) == "def":
            args = _PLACES.match(text, end)
            n, end = len(args.group(0)) // 2, args.end()
        elif count := _COUNT.match(text, end):
            n, end = int(count.group(1)), count.end()
            first, last = group_at(text, end, "[", "]")
            if first < last:
                default, end = text[first + 1 : last - 1], last
        first, last = group_at(text, end)
        if first < last:
            out.append((m.start(), last, m.group(1), word, n, default, strip_groups(text[first:last], depth=1)))
            at = last
    return out


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans; one that has its lines to itself takes the end of line along."""
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        alone = text[text.rfind("\n", 0, start) + 1 : start].strip() == "" and start >= at
        line = text.find("\n", end)
        line = len(text) if line < 0 else line
        at = min(line + 1, len(text)) if alone and not text[end:line].strip() else end
    return "".join([*out, text[at:]])


@F.udtf(returnType=FOUND)
class MacroDefinitions:
    """The definitions of a text, one row each, with the span that each takes up."""

    def eval(self, text: str):
        for k, found in enumerate(find_macros(text or ""), 1):
            yield (k, *found)


def extract_macros(docs: DataFrame) -> DataFrame:
    """One row per definition, with three verdicts.

    ``accepted``: not one of the ignored macros. ``expandable``: also not a known macro, not
    recursive, named by letters, without internals. ``structural``: expandable early, as it
    has at most one argument and is empty or holds markup of the document's structure.
    """
    ship(docs.sparkSession)
    m = docs.select("doc_id", "text").lateralJoin(MacroDefinitions(F.col("text").outer())).drop("text")
    recursive = F.expr(r"definition rlike concat('\\\\', name, '(?![A-Za-z])')")
    accepted = ~F.col("name").isin(*IGNORED_MACROS)
    ok = accepted & ~recursive & F.col("name").rlike("^[A-Za-z]") & ~F.col("definition").contains("@") & ~F.col("name").isin(*KNOWN_MACROS)
    early = ok & (F.col("numargs") <= 1) & (F.length("name") > 1) & (F.length("definition") < 100) & ~F.col("definition").contains("newif") & ((F.trim("definition") == "") | F.col("definition").rlike(STRUCTURAL))
    return m.withColumns({"accepted": accepted, "expandable": ok, "structural": early})


def macro_usage(docs: DataFrame) -> DataFrame:
    """(doc_id, name, uses) of every macro-like token."""
    found = F.explode(F.regexp_extract_all("text", F.lit(r"\\([A-Za-z]+)"), F.lit(1))).alias("name")
    return docs.select("doc_id", found).groupBy("doc_id", "name").agg(F.count("*").alias("uses"))


def missing_macros(docs: DataFrame, macros: DataFrame, known: tuple[str, ...] = (*KNOWN_MACROS, *IGNORED_MACROS)) -> DataFrame:
    """Used names that nothing defines."""
    used = macro_usage(docs).where(~F.col("name").isin(*known, "newcommand", "def", "let", "renewcommand", "providecommand", "DeclareMathOperator", "begin", "end", "section", "item"))
    return used.join(macros.select("doc_id", "name").distinct(), ["doc_id", "name"], "left_anti")


#: What a reader's target shows of macros whose definitions no page needs; they go last.
TARGET_MACROS = {"thinspace": (0, " "), "negthinspace": (0, ""), "protect": (0, ""), "ignorespaces": (0, ""), "leavevmode": (0, "")}


def expand_text(text: str, table: Mapping[str, tuple[int, str]], rounds: int = 20) -> str:
    """Expand uses left to right until none is left; more rounds than allowed are an error.

    A use without its argument is removed and the rest goes on. An argument that is a digit
    or a macro stands without braces.
    """
    actions = {name: (n, filled(body)) for name, (n, body) in table.items()}
    if not actions:
        return text
    wanted = re.compile(r"\\(?:" + "|".join(sorted(map(re.escape, actions), key=len, reverse=True)) + r")(?![A-Za-z])")
    for _ in range(rounds):
        if not wanted.search(text):
            return text
        after = rewrite_uses(text, actions, bare=True)
        if after == text:
            return text
        text = after
    raise ValueError("macros do not settle")


def staged_text(text: str, names, counts, bodies, early, target: Mapping[str, tuple[int, str]] = {}) -> str:  # noqa: B006
    """A text without its definitions, its own macros expanded: those that shape the document, the others, the target's."""
    text = without_spans(text, [(x[0], x[1]) for x in find_macros(text)])
    rows = [] if names is None else [(n, (int(c), b), e) for n, c, b, e in zip(names, counts, bodies, early, strict=True) if balanced(b)]
    for table in ({n: d for n, d, e in rows if e}, {n: d for n, d, e in rows if not e}, target):
        text = expand_text(text, table)
    # What a late macro has brought in may itself be shaped by an early one.
    return expand_text(text, {n: d for n, d, e in rows}) if any(e for *_, e in rows) else text


def expand_macros(docs: DataFrame, macros: DataFrame, which: str = "expandable", target: Mapping[str, tuple[int, str]] = {}) -> DataFrame:  # noqa: B006
    """Documents with their own macros of a verdict expanded in stages; the definitions' spans are cut out first.

    Structural macros come first, then the author's other macros, then the ``target``'s
    (name to arguments and template). Text beside, between and after definitions stays.
    """
    last = macros.where(which).groupBy("doc_id", "name").agg(F.max_by(F.struct("numargs", "definition", "structural"), "ordinal").alias("d"))
    own = last.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("name", "d.numargs", "d.definition", "d.structural"))).alias("m"))

    @F.pandas_udf(T.StringType())
    def expand(text: pd.Series, names: pd.Series, counts: pd.Series, bodies: pd.Series, early: pd.Series) -> pd.Series:
        return pd.Series([staged_text(t or "", *row, target) for t, *row in zip(text, names, counts, bodies, early, strict=True)])

    ship(docs.sparkSession)
    joined = docs.join(own, "doc_id", "left")
    return joined.withColumn("text", expand("text", "m.name", "m.numargs", "m.definition", "m.structural")).drop("m")


def declared_theorems(docs: DataFrame) -> DataFrame:
    r"""(doc_id, alias, display, canonical) of ``\newtheorem``; unknown ones are ``generictheorem``."""
    pattern = r"\\newtheorem\*?\{([^}]*)\}(?:\[[^\]]*\])?\{([^}]*)\}"
    pairs = F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("alias"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("display"))).alias("t")
    declared = docs.select("doc_id", pairs).select("doc_id", "t.alias", "t.display")
    return canonical(canonical(declared, F.lower("alias"), "by_alias"), F.lower("display"), "by_name").select(
        "doc_id", "alias", "display", F.coalesce("by_alias", "by_name", F.lit("generictheorem")).alias("canonical")
    )


def canonical(df: DataFrame, name: Column, out: str) -> DataFrame:
    """Join the fixed alias table on a lower-case name."""
    table = F.broadcast(aliases(df.sparkSession).select(F.col("alias").alias("__alias"), F.col("canonical").alias(out)))
    return df.withColumn("__name", name).join(table, F.col("__name") == F.col("__alias"), "left").drop("__name", "__alias")
