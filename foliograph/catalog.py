"""The environment catalogue: class, placeholder kind and counter of each marker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Class, display, counter, markers.
ENVIRONMENTS = [
    ("macro", "anY", "none", "macro"),
    ("mathmacro", "anY", "none", "mathmacro"),
    ("section", "section", "chapter", "chapter"),
    ("section", "section", "section", "section"),
    ("section", "section", "subsection", "subsection"),
    ("section", "section", "subsubsection", "subsubsection"),
    ("section", "section", "worksheet", "worksheet"),
    ("section", "section", "exercises", "exercises"),
    ("section", "section", "none", "abstract paragraphs"),
    ("mathinline", "mathinline", "none", "$"),
    ("math", "mathdisplay", "equation", "equation reaction multline split"),
    ("mathcomponent", "mathdisplay", "misc", "diagram aligned"),
    ("mathwrapper", "mathdisplay", "misc", "eqnarray align reactions gather alignat"),
    ("mathrow", "anY", "equation", "mathrow"),
    ("mathcomponent", "block", "misc", "cases matrix pmatrix bmatrix array"),
    ("image", "block", "misc", "picture mathpicture"),
    ("remark", "block", "subsection", "acknowledgement"),
    ("hint", "block", "misc", "hint answer"),
    ("aside", "block", "misc", "aside scrapwork marginalnote historicalnote commentary"),
    ("layout", "block", "subsection", "para"),
    ("exercise", "block", "theorem", "task subtask exercise"),
    ("figure", "block", "figure", "table figure wrapfigure"),
    ("table", "block", "misc", "tabu tabular tabularx tabbing"),
    ("list", "anY", "list", "enumerate itemize parts subparts description descriptionlist list"),
    ("none", "anY", "endlist", "endlist"),
    ("item", "anY", "item", "item"),
    ("proof", "block", "misc", "proof proofsketch"),
    ("layout", "block", "misc", "minipage"),
    ("remark", "block", "misc", "program"),
    (
        "layout",
        "anY",
        "misc",
        "quote quotation flushleft flushright verbatim sageexample lstlisting trinket stdout code verb verse tikz tikzpicture circuitikz lateximage objectives sidebyside blob",
    ),
    ("layout", "FOOT", "misc", "footnote"),
    ("text", "anY", "misc", "text"),
    ("theorem", "block", "theorem", "theorem computationaltheorem proposition lemma corollary heuristic algorithm subalgorithm slogan generictheorem"),
    ("example", "block", "theorem", "example counterexample problem project homework challenge exploration investigation activity scratchwork application"),
    (
        "definition",
        "block",
        "theorem",
        "definition conjecture question note claim subclaim fact identity assumption situation hypothesis setup axiom principle convention observation notation construction keyidea previewactivity conundrum",
    ),
    ("remark", "block", "theorem", "remark remarks scholium warning caution case assemblage summary review solution"),
]

# Names under which authors declare a marker.
ABBREVIATIONS = {
    "abstract": "abs abstr",
    "acknowledgement": "ack",
    "assumption": "assu ass",
    "axiom": "axm",
    "center": "centering",
    "claim": "cla",
    "conjecture": "con conj conjec",
    "construction": "",
    "convention": "conv",
    "corollary": "cor corr coro corol corss",
    "definition": "def defn dfn defi defin de",
    "enumerate": "enum enuma enumerit",
    "example": "exam exa eg exmp expl exm",
    "exercise": "exer exers",
    "hypothesis": "hyp",
    "lemma": "lem lma lemm",
    "notation": "no nota ntn nt notn notat",
    "observation": "obs",
    "problem": "prob prb",
    "proof": "pf prf demo",
    "proposition": "prop pro prp props",
    "question": "qu ques quest qsn",
    "remark": "rem rmk rema bem subrem",
    "remarks": "rems rmks",
    "scholium": "sch schol",
    "theorem": "thm theo theor thmss",
    "verbatim": "python",
    "warning": "warn wrn",
}

ENV_COUNTERS = ("theorem", "equation", "figure")
#: Headings that have a page of their own.
PAGE_MARKERS = ("chapter", "section")
SECTION_LEVELS = ("chapter", "section", "subsection", "subsubsection")
MULTILINE_MATH = ("eqnarray", "align", "reactions", "gather", "alignat")
LISTS = ("enumerate", "itemize", "parts", "subparts", "description", "descriptionlist", "list")
VERBATIM = ("verbatim", "sageexample", "lstlisting", "trinket", "stdout", "code")


def env_catalog(spark: SparkSession) -> DataFrame:
    """(marker, class, display, counter), one row per marker; a fixed table."""
    rows = [(m, c, d, k) for c, d, k, names in ENVIRONMENTS for m in names.split()]
    return spark.createDataFrame(rows, "marker string, class string, display string, counter string")


def aliases(spark: SparkSession) -> DataFrame:
    """(alias, canonical), in lower case; a marker is an alias of itself."""
    markers = {m for *_, names in ENVIRONMENTS for m in names.split()}
    rows = {m: m for m in markers} | {a: m for m, short in ABBREVIATIONS.items() for a in [m, *short.split()]}
    return spark.createDataFrame(sorted(rows.items()), "alias string, canonical string")
