import random

import pytest
from pyspark.sql import functions as F

from foliograph import catalog
from foliograph.operators import content, links, macros, numbering, terms
from foliograph.operators.peel import NODES, parse, peel
from foliograph.sources import documents, sinks
from foliograph.streaming import documents as streaming

BOOK = r"""Intro text.
\section{First}\label{s1} Some $a+b$ and $$c$$.
\begin{theorem}[Name]\label{t1} Let \[x\] be. \begin{proof} By \ref{s1} and \ref{none}. \end{proof}\end{theorem}
\subsection*{Star} \begin{itemize}\item one \item[x] two \begin{enumerate}\item deep\end{enumerate}\end{itemize}
\section{}
\begin{align} a &= b \\ c &= d \nonumber \\ e &= f \end{align}
\begin{verbatim} \section{No} $x$ \end{verbatim} \verb|$y$| \{ \\ \$5 \end{nothing}
\section{Second \label{s2}} \begin{theorem*} T \end{theorem*}\begin{lemma} L"""


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def nodes_of(text):
    names = [x.split()[0] for x in NODES.split(", ")]
    return [dict(zip(names, r, strict=True)) for r in parse(text)]


def test_tree(spark):
    n = nodes_of(BOOK)
    assert [x["pos"] for x in n] == list(range(len(n)))
    kinds = [x["marker"] for x in n]
    assert kinds.count("section") == 2 and kinds.count("item") == 3 and kinds.count("mathrow") == 3 and kinds.count("verb") == 1
    assert [x["title"] for x in n if x["marker"] == "section"] == ["First", "Second"]
    assert [x["label"] for x in n if x["label"]] == ["s1", "t1", "s2"]
    assert [x["star"] for x in n if x["marker"] == "mathrow"] == [False, True, False]
    assert all(x["parent"] is None or x["parent"] < x["pos"] for x in n)
    assert next(x for x in n if x["marker"] == "item" and x["option"])["option"] == "[x]"


@pytest.mark.parametrize("text", ["", "plain", "{unbalanced", r"\begin{a} x", r"x \end{a}", r"$a$ $b", "$a\n\nb$", r"\begin{theorem}\begin{theorem}x\end{theorem}\end{theorem}", BOOK.replace("\\section{}\n", "")])
def test_round_trip(spark, text):
    d = docs(spark, text)
    assert [r.text for r in content.assemble(peel(d)).collect()] == [text]


def test_nulls_and_empty(spark):
    assert peel(docs(spark, None)).count() == 1
    assert peel(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def simulate(events, toplevel):
    """Codes by sequential counting, from the rules."""
    level = {m: k for k, m in enumerate(catalog.SECTION_LEVELS)}
    sec, star, env, out = [0] * 4, [0] * 4, {}, []
    for marker, starred in events:
        if marker in level:
            k = level[marker]
            if starred:
                star[k] += 1
            else:
                sec[k] += 1
                sec[k + 1 :] = [0] * (3 - k)
                if k <= toplevel + 1:
                    env = {}
            parts = [str(sec[j]) for j in range(toplevel, k)] + [f"{star[k]}x" if starred else str(sec[k])]
            out.append(".".join(parts))
        else:
            counter = {"lemma": "theorem"}.get(marker, marker)
            if not starred:
                env[counter] = env.get(counter, 0) + 1
            parts = [str(sec[toplevel])] + ([str(sec[toplevel + 1])] if sec[toplevel + 1] else []) + [str(env.get(counter, 0))]
            out.append(".".join(parts))
    return out


def test_numbering_against_a_simulation(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for d in range(40):
        names = ["section", "subsection", "subsubsection", "theorem", "lemma", "equation", "figure"] + (["chapter"] if d % 2 else [])
        events = ([("chapter", False)] if d % 2 else []) + [(rng.choice(names), rng.random() < 0.2) for _ in range(50)]
        want[d] = simulate(events, 0 if d % 2 else 1)
        rows += [(d, k, m, s) for k, (m, s) in enumerate(events)]
    n = numbering.number_nodes(spark.createDataFrame(rows, "doc_id long, pos int, marker string, star boolean"))
    got: dict = {}
    for r in n.orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.codenumber)
    assert got == want


def test_references_and_labels(spark):
    n = numbering.number_nodes(peel(docs(spark, BOOK)))
    labels = numbering.labels(n)
    assert {r.label: r.codenumber for r in labels.collect()} == {"s1": "1", "t1": "1.1", "s2": "2"}
    shown = links.splice(n, links.resolve(links.references(n), labels)).where("marker = 'proof'").first().body
    assert shown == " By 1 and \\missingreflink{none}. "
    ids = {r.marker: r.out_id for r in numbering.assign_ids(n).where("label = '' and codenumber is not null").collect()}
    assert ids["lemma"] == "lemma-2-1"
    near = {r.pos: r.near for r in numbering.nearest_number(n).collect()}
    assert near[next(r.pos for r in n.where("marker = 'proof'").collect())] == "1.1"
    assert {r.code for r in numbering.item_codes(n).collect()} == {"1", "2", "2.1"}


def test_citations_and_bibliography(spark):
    d = docs(spark, r"As in \cite{a, b} and \cite[p. 3]{zz}. \begin{thebibliography}{9}\bibitem[AB]{a} One" "\n" r"two \bibitem{b} Three\end{thebibliography}")
    bib = links.bib_entries(d)
    assert [tuple(r) for r in bib.orderBy("ordinal").collect()] == [(0, 1, "a", "AB", "One\ntwo"), (0, 2, "b", "2", "Three")]
    c = links.citations(d.select("doc_id", F.lit(0).alias("pos"), F.col("text").alias("body")))
    assert [r.shown for r in links.resolve_citations(c, bib).orderBy("k").collect()] == ["[AB,2]", "[zz, p. 3]"]
    parts = content.document_parts(docs(spark, "pre\\begin{document}head\\maketitle body\\end{document}x", "no markup")).orderBy("doc_id").collect()
    assert (parts[0].preamble, parts[0].header, parts[0].main) == ("pre", "head", " body") and parts[1].main == "no markup"


def test_macros(spark):
    text = r"""\newcommand{\a}{A}
\newcommand{\b}[2]{#2-#1}
\def\c#1{<#1>}
\let\d=\a
\DeclareMathOperator{\op}{op}
\newcommand{\loop}{\loop x}
\newcommand{\odd}[1][z]{#1}
\a \b{1}{\a} \c2 \c\a \d \op \loop \b"""
    d = docs(spark, text)
    m = macros.extract_macros(d)
    got = {r.name: (r.numargs, r.definition, r.expandable) for r in m.collect()}
    assert got["b"] == (2, "#2-#1", True) and got["c"] == (1, "<#1>", True) and got["d"] == (0, "\\a", True) and not got["loop"][2]
    assert {r.name: r.default for r in m.collect()}["odd"] == "z"
    assert macros.expand_macros(d, m).first().text.strip() == r"A A-1 <2> <A> A op \loop"
    assert [r.name for r in macros.missing_macros(docs(spark, r"\a \gone \frac"), m).collect()] == ["gone"]
    with pytest.raises(ValueError):
        macros.expand_text(r"\x", {"x": (0, r"\y"), "y": (0, r"\x")})
    t = macros.declared_theorems(docs(spark, r"\newtheorem{thm}{Satz}\newtheorem{foo}{Lemma}\newtheorem{bar}{Baz}"))
    assert {r.alias: r.canonical for r in t.collect()} == {"thm": "theorem", "foo": "lemma", "bar": "generictheorem"}


def test_content(spark):
    p = content.paragraphs(docs(spark, "a\n\n \n b c\n\n{\n\nd", None, "")).orderBy("doc_id", "ordinal").collect()
    assert [(r.doc_id, r.ordinal, r.paragraph) for r in p] == [(0, 1, "a"), (0, 2, "b c"), (0, 3, "d")]
    t = spark.createDataFrame([(0, "a & b \\\\ \\hline c & d \\\\", "|l|r|")], "doc_id long, body string, spec string")
    assert content.tables_html(t).first().html == '<table><tr><td class="left">a</td><td class="right">b</td></tr><tr class="hline"><td class="left">c</td><td class="right">d</td></tr></table>'
    e = spark.createDataFrame([(0, "beta"), (0, "Alpha!two"), (0, "Alpha"), (0, "zz@beta"), (0, "beta")], "doc_id long, entry string")
    assert [(r.letter, r.main, r["sub"]) for r in content.build_index(e).orderBy("place").collect()] == [("A", "Alpha", None), ("A", "Alpha", "two"), ("B", "beta", None), ("Z", "beta", None)]
    wanted = spark.createDataFrame([("graph",), ("category",), ("box",), ("boss",)], "term string")
    found = terms.link_terms(docs(spark, "graphs categories bosses boxes graph photograph"), wanted).collect()
    assert {(r.phrase, r.term) for r in found} == {("graphs", "graph"), ("graph", "graph"), ("categories", "category"), ("bosses", "boss")}
    assert spark.createDataFrame([("(The  groups)",)], "t string").select(terms.normal_term(F.col("t"))).first()[0] == "The group"


def test_authors(spark):
    names = spark.createDataFrame([("Ann Ba Smith",), ("B. Jones",), ("Zed Zed",)], "name string")
    people = spark.createDataFrame([(1, "Anna", "Smith"), (2, "Bo", "Jones"), (3, "Bea", "Jones")], "person_id long, firstname string, lastname string")
    assert [tuple(r) for r in content.author_matches(names, people).collect()] == [("Ann Ba Smith", 1)]


def test_includes(spark):
    files = spark.createDataFrame([("main", "\\input{a} \\input{b} \\input{a}"), ("a", "x \\include{c}"), ("b", ""), ("c", "\\input{main}")], "file string, text string")
    got = documents.expand_includes(files, files.where("file = 'main'").select("file")).orderBy("place").collect()
    assert [(r.file, r.cyclic) for r in got] == [("main", False), ("a", False), ("c", False), ("main", True), ("b", False), ("a", False), ("c", False), ("main", True)]
    with pytest.raises(Exception, match="RECURSION_LEVEL"):
        documents.expand_includes(files, files.where("file = 'main'").select("file"), max_depth=1).collect()


def test_files_sinks_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.tex").write_bytes("caf\u00e9\r\nx\ty".encode())
    (tmp_path / "in/b.tex").write_bytes("caf\u00e9".encode("latin-1"))
    texts = {r.path[-5:]: r.text for r in documents.read_documents(spark, str(tmp_path / "in")).collect()}
    assert texts == {"a.tex": "café\nx y", "b.tex": "café"}
    n = peel(docs(spark, BOOK, r"\begin{tikzpicture}draw\end{tikzpicture}"))
    assert sinks.render_requests(n).first().tex == r"\begin{tikzpicture}draw\end{tikzpicture}"
    sinks.write_nodes(n, str(tmp_path / "nodes"), 2)
    assert spark.read.parquet(str(tmp_path / "nodes")).count() == n.count()
    sinks.write_pages(spark.createDataFrame([(1, "a.html", "x\ny")], "doc_id long, file string, text string"), str(tmp_path / "pages"))
    page = spark.read.text(str(tmp_path / "pages"), wholetext=True).first()
    assert (page.value, page.doc_id, page.file) == ("x\ny\n", 1, "a.html")
    docs(spark, BOOK, "plain").write.parquet(str(tmp_path / "arriving"))
    q = streaming.run_batches(streaming.stream_documents(spark, str(tmp_path / "arriving")), peel, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == peel(docs(spark, BOOK, "plain")).count()


def test_catalogue(spark):
    rows = catalog.env_catalog(spark).collect()
    assert len({r.marker for r in rows}) == len(rows) > 130
    assert {r.counter for r in rows if r.marker in ("lemma", "section", "mathrow")} == {"theorem", "section", "equation"}
