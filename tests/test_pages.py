"""Pages, canonical form, references and trees on hand-written and generated cases."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliograph.functions import canonical, markup, pages, scanner
from foliograph.operators import content, macros, peel, references

ENVIRONMENTS = ["theorem", "proof", "align", "cases", "equation", "gather", "itemize", "quote"]


def back(text):
    """A text taken apart and put together."""
    rows = peel.parse(text.translate(peel._ESCAPES))
    out = content.fill([(r[1], r[17], r[16], r[18]) for r in rows])
    for k, x in (("a", peel.OPEN), ("b", peel.CLOSE), ("c", peel.ESCAPE)):
        out = out.replace(peel.ESCAPE + k, x)
    return out


texts = st.recursive(
    st.text(alphabet="ab &$\\{}[]%\n⟦⟧0", max_size=12),
    lambda inner: st.one_of(
        st.builds(lambda e, x: f"\\begin{{{e}}}{x}\\end{{{e}}}", st.sampled_from(ENVIRONMENTS), inner),
        st.builds(lambda x, y: x + " \\\\ " + y, inner, inner),
        st.builds(lambda x: f"\\item {x}", inner),
        st.builds(lambda x: f"\\section{{T}}{x}", inner),
    ),
    max_leaves=25,
)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_tree_gives_the_text_back(text):
    assert back(text) == text


def test_rows_own_what_they_hold():
    rows = peel.parse(r"\begin{align}a &= \begin{cases}1 \\ 2\end{cases} \\ b &= \begin{cases}3\end{cases}\label{x} \nonumber \cr c\end{align}")
    by = {r[1]: r for r in rows}
    assert [(r[11], by[r[2]][11] if r[2] is not None else None, r[4]) for r in rows] == [
        ("document", None, 0), ("align", "document", 1), ("mathrow", "align", 2), ("cases", "mathrow", 3), ("mathrow", "align", 2), ("cases", "mathrow", 3), ("mathrow", "align", 2),
    ]
    assert [r[12] for r in rows if r[11] == "mathrow"] == [False, True, False] and [r[15] for r in rows if r[11] == "mathrow"] == ["", "x", ""]


def test_signs_of_placeholders_survive():
    assert back("x ⟦3⟧  \0 y $⟦1⟧$") == "x ⟦3⟧  \0 y $⟦1⟧$"


def test_time_grows_with_the_text():
    """Headings, macros and groups are walked once: twice the text, about twice the time."""
    def took(n):
        text = "".join(f"\\section{{H {k}}}" + "words " * 60 for k in range(n))
        start = time.process_time()
        peel.parse(text)
        return time.process_time() - start

    took(200)
    assert took(4000) < 10 * took(1000)


@pytest.mark.parametrize("one", ["\\section{", "\\emph{", "\\begin{verbatim}", "\\begin{theorem}[", "\\[", "\\item[", "\\begin{align}", "{", "$", "\\title ", "{a\\over "])
def test_open_groups_take_no_longer(one):
    """What never closes is looked for once."""
    text = one * 50_000
    table = markup.macro_table("html")
    for f in (peel.parse, canonical.canonical_text, lambda t: markup.convert(t, table), lambda t: scanner.rewrite_macro(t, "emph", 1, "#1"), macros.find_macros):
        start = time.process_time()
        f(text)
        assert time.process_time() - start < 8


def test_labels_of_floats():
    """What layout inside a figure holds is the figure's."""
    rows = peel.parse(r"\begin{figure}\begin{minipage}\includegraphics{a}\caption{C}\label{f}\end{minipage}\begin{equation}\label{e}\end{equation}\end{figure}")
    assert [(r[11], r[15], r[8]) for r in rows] == [("document", "", None), ("figure", "f", 1), ("minipage", "", 1), ("equation", "e", None)]
    assert [(r[1], r[5]) for r in rows] == [(0, 3), (1, 3), (2, 2), (3, 3)]


@pytest.mark.parametrize(
    ("f", "page", "want"),
    [
        (pages.fix_tags, "<p>a <br/> </p><ol label=\"x\">", "<p>a\n</p><ol marker=\"x\">"),
        (pages.fix_tags, "\\text{ab}<em> b </em>\\normalfont", "\\text{ ab }<em>b</em>"),
        (pages.tables_of_figures, "<figure><tabular/></figure><figure>x</figure>", "<table><tabular/></table><figure>x</figure>"),
        (pages.clean_code, "<c>a<nbsp/><b>b</b></c>", "<c>a b</c>"),
        (pages.wrap_statements, "<lemma><statement>s</statement></lemma>", "\n\n<lemma>\n<statement>s</statement>\n</lemma>\n\n"),
        (pages.joined_columns, "<ol>1</ol> <ol>2</ol> <ol>3</ol>", '<ol cols="3" >1\n2\n3</ol>'),
        (pages.single_side_by_side, "<sidebyside> <ol><li/></ol> </sidebyside>", "<ol><li/></ol>"),
        (pages.images_outside_paragraphs, "<p> <!-- START a END --> </p>", "\n<!-- START a END -->\n"),
        (pages.drawings_as_written, "<ndash/>\\begin{tikzpicture}a <ndash/> b\\end{tikzpicture}", "<ndash/>\\begin{tikzpicture}a -- b\\end{tikzpicture}"),
        (pages.wrap_drawings, "a \\begin{tikzpicture}d\\end{tikzpicture} b", "a\n<image>\n<latex-image>\n          <![CDATA[\\begin{tikzpicture}d\\end{tikzpicture}]]>\n</latex-image>\n</image>\nb"),
        (pages.without_empty_tags, "a <p> <nbsp/> </p> b", "a\nb"),
        (pages.without_empty_labels, '<li label="" >\\gls{x}', "<li>x<idx><h>x</h></idx>"),
        (pages.lists_in_paragraphs, "<p>a</p><ol><li><ol>b</ol></li></ol>", "<p>a</p><ol><li><ol>b</ol></li></ol>"),
        (pages.rewrite, None, None),
    ],
)
def test_passes(f, page, want):
    if page is None:
        assert pages.rewrite("<p>a<p>b</p></q></p>", ["p"], lambda t, a, c: f"[{c}]") == "[a[b]</q>]"
    else:
        assert f(page) == want


def test_nothing_breaks_on_odd_pages():
    rng = random.Random(3)
    parts = ["<p>", "</p>", "<ol>", "</ol>", "<li>", "</li>", "<me>", "</me>", "&", "<", ">", "\\code{", "}", "<theorem>", "</theorem>", "<figure>", "</figure>", "a", " ", "<sidebyside>", "</sidebyside>"]
    for _ in range(300):
        pages.finish_page("".join(rng.choice(parts) for _ in range(40)))
    assert pages.finish_page("") == ""


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (r"\begin{THM}x\end{THM}", r"\begin{theorem}x\end{theorem}"),
        (r"\begin{Thm}x\end{Thm}", r"\begin{theorem}x\end{theorem}"),
        (r"\begin{document}$\emph{a b}$ 5\$", r"\begin{document}\emph{a b} 5\dollar"),
        (r"\title T \endtitle \proof p \qed", r"\title{T} \begin{proof} p \end{proof}"),
        (r"\begin{verbatim}\noindent\end{verbatim}\noindent", r"\begin{verbatim}\noindent\end{verbatim}"),
        (r"\bgroup\phantom{a{b}}c\egroup", "{c}"),
    ],
)
def test_canonical(text, want):
    assert canonical.canonical_text(text) == want


def test_macro_rewriting():
    assert scanner.rewrite_macro(r"\t{a\t{b}} \tt{c} \t", "t", 1, "<#1>") == r"<a<b>> \tt{c} "
    assert scanner.nth_argument(r"x \m{a}{b{c}}", "m", 2) == "b{c}" and scanner.nth_argument("x", "m") == ""


def test_references(spark):
    rows = [(1, 1, "in \\ref{a}, by Lemma~\\ref{a} and \\eqref{e}; \\ref{a}"), (1, 2, None), (2, 1, "\\ref{a}")]
    nodes = spark.createDataFrame(rows, "doc_id long, pos long, body string")
    labels = spark.createDataFrame([(1, "a", "subsection", "2.1", "n1"), (1, "e", "equation", "3", "n2")], "doc_id long, label string, marker string, codenumber string, node_id string")
    got = {(r.doc_id, r.pos): r.body for r in references.with_links(nodes, labels).collect()}
    link = lambda x: f'<a class="internal" href="section2.html#subsection2-1">{x}</a>'
    assert got[1, 1] == f'in {link("2.1")}, by {link("Lemma&nbsp;2.1")} and <a knowl="n2.knowl">(3)</a>; {link("2.1")}'
    assert got[1, 2] is None or got[1, 2] == ""
    assert got[2, 1] == "\\missingreflink{a}"
    assert references.link_references(nodes.limit(0)).count() == 0


def test_finish_of_null(spark):
    assert spark.createDataFrame([(None,)], "t string").select(pages.finish(F.col("t"))).first()[0] is None
