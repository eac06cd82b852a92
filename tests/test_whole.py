"""Macros, bibliographies, pages, terms, projects and rules on hand-written cases."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliograph.functions import canonical, pages, rules
from foliograph.functions import text as X
from foliograph.operators import bibliography, content, floats, intervals, links, macros, numbering, paging, papers, tags, terms
from foliograph.operators.peel import peel
from foliograph.sources import documents, project


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (r"\newcommand{\a}{x} rest of line \a", " rest of line x"),
        ("\\newcommand{\\a}[1]{x\n #1 y} tail \\a{1}", " tail x\n 1 y"),
        (r"mid \newcommand{\Z}{Z} \Z end", "mid  Z end"),
        ("a\n\\def\\q#1{[#1]}\nb \\q7", "a\nb [7]"),
        (r"\newcommand{\x}[2][d [e]]{#1-#2}\x{a}{b}", "a-b"),
        (r"\newcommand{\open}{ x", r"\newcommand{\open}{ x"),
        (r"\newcommand{\s}{\t\t}\newcommand{\t}{u} \s", " uu"),
        ("", ""),
        (None, ""),
    ],
)
def test_text_beside_definitions_stays(spark, text, want):
    d = docs(spark, text)
    assert macros.expand_macros(d, macros.extract_macros(d)).first().text == want


def test_definition_spans(spark):
    text = "a \\newcommand{\\b}{c}\n\\def\\d#1{e}\\let\\f=\\g h"
    found = macros.extract_macros(docs(spark, text)).orderBy("ordinal").collect()
    assert [(text[r.start : r.end], r.name, r.numargs) for r in found] == [("\\newcommand{\\b}{c}", "b", 0), ("\\def\\d#1{e}", "d", 1), ("\\let\\f=\\g", "f", 0)]
    assert macros.extract_macros(docs(spark, None, "")).count() == 0


def test_bibliographies(spark):
    assert [r[3:5] for r in bibliography.read_records(r"\bibitem[A [1]]{k} One \bibitem{} Two \bibitem no")] == [("k", "A [1]"), ("", "")]
    got = bibliography.read_records('@article{a, title = {x = {y}, z}, year = 1999}@book{b, title="q {"} r"} @comment{c, x={1}} @misc{lonely}')
    assert [(r[0], r[2], r[3], r[6], r[7]) for r in got] == [(1, "article", "a", "title", "x = {y}, z"), (1, "article", "a", "year", "1999"), (2, "book", "b", "title", 'q {"} r'), (3, "misc", "lonely", "raw", "")]
    assert bibliography.read_records(r"\ref \no 3\by A\yr {\by x} 1990 \endref \ref{label}") == [(1, "records", "article", "3", "3", 1, "author", "A"), (1, "records", "article", "3", "3", 2, "year", r"{\by x} 1990")]
    for one in ["@article{a, b = ", "\\bibitem[", "\\bib{a}{b}{", "\\ref\\by ", '@a{b, c = "']:
        start = time.process_time()
        bibliography.read_records(one * 5_000)
        assert time.process_time() - start < 8
    entries = bibliography.entries(bibliography.record_fields(docs(spark, None, "", r"\bib{k}{article}{author={B}, author={A}}")))
    assert [tuple(r) for r in entries.collect()] == [(2, 1, "amsrefs", "article", "k", "1", "B, A.")]


def test_intervals(spark):
    outer = spark.createDataFrame([(1, 0, 999), (1, 10, 600), (1, 300, 310), (2, 0, 5)], "doc_id long, start int, last int")
    inner = spark.createDataFrame([(1, 5), (1, 10), (1, 305), (1, 600), (1, 601), (2, 5), (2, 6)], "doc_id long, pos int")
    got = {(r.doc_id, r.pos): r.page for r in intervals.innermost(inner, outer, "page").collect()}
    assert got == {(1, 5): 0, (1, 10): 10, (1, 305): 300, (1, 600): 10, (1, 601): 0, (2, 5): 0}


def test_pages_of_documents_without_chapters(spark):
    text = r"Before. \section{A}\label{sec:a} one \subsection{B} two \section{C} three"
    n = numbering.assign_ids(numbering.number_nodes(peel(docs(spark, text, "no sections"))))
    found = {(r.doc_id, r.file): r.text for r in paging.pages(tags.converted(tags.tagged(n, "ptx"), "ptx"), "ptx").collect()}
    assert set(found) == {(0, "main.ptx"), (0, "sec_a.ptx"), (0, "section2.ptx"), (1, "main.ptx")}
    assert found[0, "main.ptx"] == 'Before. <xi:include  href="sec_a.ptx" />\n<xi:include  href="section2.ptx" />\n' and found[1, "main.ptx"] == "no sections"
    assert "<subsection" in found[0, "sec_a.ptx"] and "two" in found[0, "sec_a.ptx"]


def test_edges_of_subtrees(spark):
    text = r"\begin{definition}\label{d}x\end{definition}\begin{theorem}\label{t}\begin{itemize}\item \ref{d}\end{itemize}\[ \eqref{e} \]\begin{lemma}\label{l} \ref{t}\end{lemma}\end{theorem} \ref{l}\begin{equation}\label{e}y\end{equation}"
    n = numbering.number_nodes(peel(docs(spark, text, text)))
    got = {(r.doc_id, r.source, r.target) for r in links.dependency_edges(n, numbering.labels(n)).collect()}
    assert got == {(d, s, t) for d in (0, 1) for s, t in (("t", "d"), ("t", "e"), ("t", "t"), ("l", "t"))}


def test_terms_by_either_way(spark):
    wanted = spark.createDataFrame([("normal group",), ("group",), ("group action",), ("Cayley graph",), ("lemma",)], "term string")
    d = docs(spark, "A normal group action of groups.", "normal, group", "Cayley\n graphs and normal-group", None)
    want = {(0, "normal group"), (0, "group"), (0, "group action"), (0, "groups"), (1, "group"), (2, "Cayley graphs")}
    for most in (1000, 0):
        assert {(r.doc_id, r.phrase) for r in terms.link_terms(d, wanted, broadcast_forms=most).collect()} == want
    files = wanted.withColumn("file", F.concat("term", F.lit(".knowl")))
    linked = {r.doc_id: r.text for r in terms.write_term_links(d, terms.link_terms(d, wanted), files).collect()}
    assert linked[0] == 'A <span class="autoterm"><a knowl="normal group.knowl">normal&nbsp;group</a></span> action of <span class="autoterm"><a knowl="group.knowl">groups</a></span>.'
    assert linked[3] is None and linked[1] == 'normal, group'.replace(" group", ' <span class="autoterm"><a knowl="group.knowl">group</a></span>')


def test_many_terms():
    """Ten thousand terms take one walk of a text."""
    root = terms.automaton((f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} x", k) for k in range(10_000))
    text = "waaa x and wbbb x " * 20_000
    start = time.process_time()
    assert sum(1 for _ in terms.matches(text, root)) == 40_000
    assert time.process_time() - start < 8


def test_deep_includes(spark):
    files = spark.createDataFrame([(f"f{k}", f"\\input{{f{k + 1}}}") for k in range(12)] + [("f12", "\\input{f3} end")], "file string, text string")
    got = documents.expand_includes(files, files.where("file = 'f0'").select("file")).collect()
    assert len(got) == 14 and [(r.file, r.depth) for r in got if r.cyclic] == [("f3", 13)]


def test_project(spark, tmp_path):
    rows = [("a", "x.html", "café\r\n\t1"), ("a/b", "y.html", ""), (None, "index.html", "top")]
    project.write_project(spark.createDataFrame(rows, "folder string, file string, text string").repartition(3), str(tmp_path / "site"))
    assert (tmp_path / "site/a/x.html").read_bytes() == "café\r\n\t1".encode()
    (tmp_path / "site/a/old.tex").write_bytes("café\ttab".encode("latin-1"))
    got = {r.file: r.text for r in project.read_project(spark, str(tmp_path / "site")).collect()}
    assert got == {"a/x.html": "café\n 1", "a/b/y.html": "", "index.html": "top", "a/old.tex": "café tab"}
    assert [r.file for r in project.read_project(spark, str(tmp_path / "site"), ".tex,.sty").collect()] == ["a/old.tex"]
    assert not [p for p in Path(tmp_path / "site").iterdir() if p.name.startswith("_staged")]


def test_failed_pages_leave_nothing(spark, tmp_path):
    """Two pages of one name, a page outside its folder: no page is there afterwards."""
    for rows in ([("a", "x", "1"), ("a", "x", "2")], [("a", "ok", "1"), ("..", "x", "2")]):
        with pytest.raises(Exception, match="one name|outside"):
            project.write_project(spark.createDataFrame(rows, "folder string, file string, text string").repartition(2), str(tmp_path / "site"))
        assert not [p for p in tmp_path.rglob("*") if p.is_file() and "_staged-" not in str(p)]
        assert project.read_project(spark, str(tmp_path)).count() == 0
    assert project.decoded(b"\xff\r\n") == "ÿ\n"


def test_packs(spark):
    packs = spark.createDataFrame([("p", "s", 2, "b", "c$0"), ("p", "s", 1, "a", "b"), ("q", "t", 1, "a", "z")], rules.RULE_SCHEMA)
    d = spark.createDataFrame([(1, "p", "ab"), (2, "q", "ab"), (3, None, "ab"), (4, "p", None)], "id int, pack string, text string")
    assert {r.id: r.text for r in rules.apply_packs(d, packs, "s").collect()} == {1: "cbcb", 2: "ab", 3: "ab", 4: None}


def test_ids_and_letters():
    same = '<problem>' + '<solution xml:id="s"/>' * 28 + "</problem>"
    got = pages.unique_ids(same)
    assert 'id="sa"' in got and 'id="sz"' in got and 'id="sab"' in got and got.count("<solution") == 28
    assert pages.unique_ids('<problem><solution xml:id="s"/></problem><problem><solution xml:id="s"/></problem>').count('"s"') == 2


def test_finished_pages_take_no_longer():
    for text in ("<p>" + " " * 100_000 + "x</p>", "<p>a</p> <me>x</me> " * 5_000, "<p>\\paragraphs{" * 5_000, "<ol><li>" * 5_000, "<br/> " * 10_000):
        start = time.process_time()
        pages.finish_page(text)
        assert time.process_time() - start < 12


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (r"\proclaim{Theorem 2.1} body \endproclaim \definition{Definition} d \enddefinition", r"\begin{theorem} body \end{theorem} \begin{definition} d \end{definition}"),
        (r"${a \over b} + x \choose y$", r"$\binom{{\frac{a }{ b}} + x }{ y}$"),
        (r"\matrix{a&b\cr c&\cases{1\cr 2}\cr}", r"\begin{matrix}a&b\\ c&\begin{cases}1\\ 2\end{cases}\\\end{matrix}"),
        (r"\begin{multicols}{2}a\end{multicols}\begin{keywords}k\end{keywords}b", "ab"),
        (r"\iffalse a \ifx b\fi c\fi d \rule{0pt}{2em}\rule{1in}{2in}", r" d \rule{1in}{2in}"),
        ("\\section{\\label{a}B {c}} \\footnote [3] {x} \\ref {y}", "\\section{B {c}}\\label{a} \\footnote {x} \\ref{y}"),
        ("``abc\" and ``never", "``abc'' and ``never"),
    ],
)
def test_archaic(text, want):
    assert canonical.canonical_text(text) == want


def test_papers(spark):
    known = papers.parse_papers(spark.createDataFrame([('{"c": {"title": "T", "authors": [{"firstname": "A", "lastname": "B"}]}, "d": {"authors": []}}',), ("not json",), (None,)], "text string"))
    fronts = spark.createDataFrame([(1, "", [], "c"), (2, "Own", ["X"], "c"), (3, None, None, "d"), (4, "", [], "e"), (5, "", [], None)], "doc_id int, title string, authors array<string>, code string")
    got = {r.doc_id: (r.title, r.authors) for r in papers.fill_from_papers(fronts, known).collect()}
    assert got == {1: ("T", ["A B"]), 2: ("Own", ["X"]), 3: ("", []), 4: ("", []), 5: ("", [])}


def test_paragraphs_and_images(spark):
    assert content.body_paragraphs("a ⟦1⟧ b ⟦2⟧ c\n\nd", frozenset([2])) == ["a ⟦1⟧ b", "c", "d"]
    assert floats.find_floats(r"\scalebox{.5}{\includegraphics[width=2in]{a} \psfig{file=b, width=1in}}\epsfbox{c}\includegraphics{open") == [("image", "scale=.5,width=2in", "a"), ("image", "scale=.5,width=1in", "b"), ("image", "", "c")]
    assert X.key_of_title("Part ii: The Graphs on 3-manifolds") == X.key_of_title("part 2 the graph of 3 manifold")
