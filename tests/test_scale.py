"""What is held at once, how work is dealt out, and keys beyond those of the small tables."""

import gc

import pyarrow as pa
import pytest

from foliograph.functions import markup, scanner
from foliograph.operators import content, edges, links, numbering, peel
from foliograph.plans import output, whole
from foliograph.sources import documents, synthetic


def test_nodes_come_in_bounded_batches():
    """Many documents in one batch, and one document with many nodes, are never held as rows as a whole."""
    small = "\\section{A}" + "\\begin{theorem}b\\end{theorem}" * 20
    large = "\\section{A}" + "\\begin{theorem}b\\end{theorem}" * 3 * peel.CHUNK
    batch = pa.RecordBatch.from_arrays([pa.array(range(2001)), pa.array([small] * 2000 + [large])], ["doc_id", "text"])
    sizes = [b.num_rows for b in peel._peel(iter([batch]))]
    assert sum(sizes) == 2000 * 22 + 2 + 3 * peel.CHUNK
    assert max(sizes) <= 2 * peel.CHUNK and len(sizes) > 5


def test_groups_from_left_to_right():
    text = "a{b{c}\\}{d}} {e"
    ends = scanner.group_ends(text)
    asked = scanner.Groups(text)
    for at in (1, 3, 8, 13):
        assert asked.end(at) == ends.get(at)


def test_templates_are_cut_once(monkeypatch):
    """Converting many texts does not cut the templates of all macros for each."""
    calls = []
    monkeypatch.setattr(markup, "filled", lambda t: calls.append(t) or scanner.filled(t))
    markup.macro_actions.cache_clear()
    assert [markup.convert_by(f"\\emph{{{k}}}", markup.macro_actions("html")) for k in range(100)] == [f"<em>{k}</em>" for k in range(100)]
    assert len(calls) == len(markup.macro_table("html"))
    markup.macro_actions.cache_clear()


def test_small_files_are_dealt_out(spark, tmp_path):
    """A table of one small file is worked on by all cores where each of its rows is a text."""
    spark.range(100).selectExpr("id p_partkey", "'x' p_name").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    rows = synthetic.table(spark, str(tmp_path), "part")
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert rows.count() == 100


def test_edges_of_one_read(spark):
    """Dependency edges with the nodes' own labels read the documents once and equal those with given labels."""
    text = "\\begin{theorem}\\label{a}\\ref{b}\\ref{none}" + "\\begin{itemize}\\item x\\end{itemize}" * 300 + "\\ref{c}\\end{theorem}\\begin{proof}\\label{b}\\ref{a}\\end{proof}\\begin{definition}\\label{c}\\begin{proof}\\eqref{c}\\end{proof}\\end{definition}"
    nodes = peel.peel(spark.createDataFrame([(1, text), (2, text.replace("{b}", "{d}"))], "doc_id long, text string"))
    edges = links.dependency_edges(nodes)
    got = sorted(map(tuple, edges.collect()))
    assert got == [(1, "a", "b"), (1, "a", "c"), (1, "c", "c"), (2, "a", "c"), (2, "a", "d"), (2, "c", "c")]
    assert got == sorted(map(tuple, links.dependency_edges(nodes, numbering.labels(numbering.number_nodes(nodes))).collect()))
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_edges_need_no_exchange(spark):
    """Edges of whole documents are those of their nodes, whichever reader takes a text, and nothing is dealt out for them."""
    statement = r"\begin{theorem}[after \ref{b}]\label{a}x \ref{none}\begin{itemize}\item[\eqref{c}] y\item\label{c}$z \ref{d}$\end{itemize}\begin{proof}\label{b}\ref{a}\end{proof}\end{theorem} \ref{a}"
    odd = ["", None, statement, statement * 2, statement + r"\begin{lemma}\label{d}\verb|\ref{a}|\end{lemma}", statement + r"\section{T \ref{a}}\label{d}\begin{definition} [\]\ref{a}]\label{e}\[u\]\begin{align}v\ref{d}\\w\label{a}\end{align}\end{definition}",
           r"\begin{lemma}\label{a}\ref{a\$}\\ref{a}\item \begin{figure}\begin{minipage}\label{f}\ref{f}\end{minipage}\end{foo}\end{figure}" + "⟦\\end{lemma}", statement + "\\begin{theorem}" * 300 + "\\end{foo}" * 300, r"\begin{theorem}\label{a}$x" + "\n\n" + r"\ref{a}$ \begin{lemma}\label{b}\ref{a}"]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = edges.document_edges(docs)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, links.dependency_edges(peel.peel(docs)).collect())) and len(rows) > 20
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    of = frozenset(("theorem", "lemma", "definition"))
    assert edges._quick(statement, of) is not None and edges._quick(odd[4], of) is None
    assert edges._quick(statement * 2, of)[1] == edges._parsed(statement * 2, of)[1] == {"a", "b", "c"}


def test_subtree_edges_deal_out_once(spark, tmp_path):
    """The query's one exchange is that of line items to orders; items without an order have no edges, as in the SQL."""
    spark.createDataFrame([(7,), (7,), (7,), (8,), (None,)], "l_orderkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = whole.subtree_edges(spark, str(tmp_path))
    want = [(7, "1", "1"), (7, "1", "2"), (7, "2", "1"), (7, "2", "2"), (7, "2", "3"), (7, "3", "1"), (7, "3", "2"), (8, "1", "1")]
    assert sorted(map(tuple, got.collect())) == want
    assert got._jdf.queryExecution().sparkPlan().toString().count("Exchange") <= 1


def test_unmatched_ends_do_not_pass_all_open_nodes_each():
    """50,000 open nodes and 50,000 ends that close none of them: time grows with the text."""
    text = "\\begin{theorem}\\label{a}\\ref{a}" + "\\begin{proof}" * 50000 + "\\end{foo}" * 50000
    assert list(edges.edges_of(text, frozenset(("theorem",)))) == [("a", "a")]


def test_paper_links_of_large_keys(spark, tmp_path):
    """Keys of five digits: numbers of preprints have four, as in the SQL."""
    spark.createDataFrame([(12345,), (12346,), (12347,)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r.s_suppkey: r.link for r in output.paper_links(spark, str(tmp_path)).collect()}
    assert got == {12345: '<div><a href="http://arxiv.org/abs/1234.1234">paper</a></div>', 12346: '<div><a href="http://ams.org/mathscinet/0012346">AMS Math Review</a></div>', 12347: ""}


def test_long_includes(spark):
    """A run of 3,000 files, a branch behind it, a file included twice, and a way back into the run: levels are branches, not files."""
    text = lambda k: f"\\input{{f{k + 1}}}" if k < 3000 else "\\input{a}\\input{a}\\input{f0}"
    files = spark.createDataFrame([("top", "x \\input{f0}"), *((f"f{k}", text(k)) for k in range(3001)), ("a", "\\input{b}"), ("b", "end")], "file string, text string")
    got = documents.expand_includes(files, files.where("file = 'top'").select("file"), max_depth=None).orderBy("place").collect()
    assert [(r.file, r.depth, r.cyclic) for r in got[:3002]] == [("top", 0, False), *((f"f{k}", k + 1, False) for k in range(3001))]
    assert [(r.file, r.depth, r.cyclic, r.place[-2:]) for r in got[3002:]] == [("a", 3002, False, [1, 1]), ("b", 3003, False, [1, 1]), ("a", 3002, False, [1, 2]), ("b", 3003, False, [2, 1]), ("f0", 3002, True, [1, 3])]
    with pytest.raises(Exception, match="deeper"):
        documents.expand_includes(files, files.where("file = 'top'").select("file"), max_depth=3002).collect()


def test_brackets_are_looked_for_where_one_stands(monkeypatch):
    """An environment without an option asks for no bracket group, and text without placeholder signs is not translated."""
    calls = []
    held = scanner.Groups.group_at
    monkeypatch.setattr(scanner.Groups, "group_at", lambda self, at: calls.append(at) or held(self, at))
    nodes = peel.parse("\\begin{theorem}a\\end{theorem}\\begin{proof} [of b]c\\end{proof}" * 3)
    assert [n[14] for n in nodes] == ["", *["", "of b"] * 3]
    assert len(calls) == 3


def test_nodes_do_not_wait_for_the_collector():
    """While nodes are read the collector is off, as they leave no cycles; afterwards it is as before, also where reading is given up."""
    text = "\\begin{figure}\\begin{minipage}{1in}\\label{a}\\begin{align}a\\\\b\\end{align}\\end{minipage}\\end{figure}" * 2000
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([text] * 5)], ["doc_id", "text"])
    found = peel._peel(iter([batch]))
    next(found)
    assert not gc.isenabled()
    found.close()
    assert gc.isenabled()
    gc.collect()
    assert sum(b.num_rows for b in peel._peel(iter([batch]))) == 5 * (1 + 5 * 2000)
    assert gc.collect() < 100


def test_trees_are_filled_some_at_a_time(monkeypatch):
    """Small trees become values together, a large one alone; texts are those of the trees, also of sliced arrays and of none."""
    text = lambda k: "\\section{A}" + "\\begin{proof}$x$ \\emph{y}\\end{proof}\n" * k
    trees = [[dict(zip(("pos", "before", "body", "after"), (r[1], r[17], r[16], r[18]), strict=True)) for r in reversed(peel.parse(text(k)))] for k in (1, 2, 3, 100, 0)]
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("before", pa.string()), ("body", pa.string()), ("after", pa.string())]))
    nodes = pa.array([trees[0], None, *trees[1:]], kind)
    monkeypatch.setattr(content, "TOGETHER", 16)
    want = [text(1), None, *map(text, (2, 3, 100, 0))]
    assert list(content.filled_trees(nodes)) == want
    assert list(content.filled_trees(nodes.slice(2, 3))) == want[2:5]


def test_bibliography_items_need_no_exchange(spark):
    """Items come from the reader as entries of the general reader, and pages of both targets read them once."""
    from foliograph.operators import bibliography, links, paging

    odd = ["", None, "none", "\\bibitem[A [1]]{k} x {\\bibitem{in} y}", "\\bibitem [a{]b}] { k } z \\bibitem{open", "\\bibitem[open {k} x\\bibitem{l}\\end{thebibliography} \\bibitem{m} & \\% n", "\\bibitem{}", "\\\\bibitem\\{a}{b}[c]{d}"]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    general = bibliography.entries(bibliography.record_fields(docs)).where("notation = 'items'").select("doc_id", "ordinal", "key", "label", "raw")
    found = links.bib_entries(docs)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, general.collect())) and found.count() > 4
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    both = paging.bibliography_pages(found, "html", "ptx")
    apart = paging.bibliography_pages(found).unionByName(paging.bibliography_pages(found, "ptx"))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, apart.collect()))
    assert both._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_many_items_leave_in_bounded_batches(spark):
    import pyarrow as pa

    from foliograph.operators import bibliography

    text = "".join(f"\\bibitem{{k{k}}} x\n" for k in range(20000))
    out = list(bibliography._items(iter([pa.RecordBatch.from_arrays([pa.array([7]), pa.array([text])], ["doc", "text"])])))
    assert sum(b.num_rows for b in out) == 20000 and max(b.num_rows for b in out) <= bibliography.CHUNK


def test_numbers_need_one_sort_of_plain_nodes(spark):
    """Documents are sorted once, before flags and totals widen their rows."""
    nodes = peel.peel(spark.createDataFrame([(1, "\\section{A}\\begin{theorem}b\\end{theorem}"), (2, "\\chapter{B}\\section{A}\\begin{theorem}b\\end{theorem}")], "doc_id long, text string"))
    numbered = numbering.number_nodes(nodes).select("doc_id", "pos", "codenumber")
    assert [tuple(r) for r in numbered.where("codenumber is not null").orderBy("doc_id", "pos").collect()] == [(1, 1, "1"), (1, 2, "1.1"), (2, 1, "1"), (2, 2, "1.1"), (2, 3, "1.1.1")]
    plan = numbered._jdf.queryExecution().executedPlan().toString().split("\n")
    sorts = [k for k, line in enumerate(plan) if "- Sort [" in line]
    assert len(sorts) == 1
    assert not any("CASE WHEN" in line for line in plan[sorts[0] :])


def test_trees_pass_as_rows(spark, monkeypatch):
    """No value but its text holds a tree: rows of one tree come in many batches, trees of many keys in one, and are filled as they pass."""
    text = lambda k: "\\section{A}" + "\\begin{proof}$x$ \\emph{y}\\end{proof}\n" * k
    rows = [(d, r[1], r[17], r[16], r[18], {"file": f"f{d}.{r[1]}"}) for d, k in enumerate((1, 400, 2, 0, 3)) for r in peel.parse(text(k))]
    kind = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), *((n, pa.string()) for n in ("before", "body", "after")), ("root", pa.struct([("file", pa.string())]))])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 100], strict=True), kind, strict=True)], schema=kind) for at in range(0, len(rows), 100)]
    monkeypatch.setattr(content, "LEAVING", 10000)
    out = list(content.assembled(iter(batches), 1))
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [(d, {"file": f"f{d}.0"}, text(k)) for d, k in enumerate((1, 400, 2, 0, 3))]
    assert len(out) == 2 and not list(content.assembled(iter([]), 1))
    from foliograph.operators import paging

    docs = spark.createDataFrame([(1, "a" + text(3)), (2, "")], "doc_id long, text string")
    nodes = numbering.number_nodes(peel.peel(docs)).withColumnsRenamed({"opening": "open_tag", "closing": "close_tag"})
    pages = paging.pages(nodes)
    assert "collect_list" not in pages._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.doc_id, r.file): (r.start, r.marker, r.text) for r in pages.collect()}
    assert got == {(1, "index.html"): (0, "document", 'a<h2 class="link"><a href="section1.html">A</a></h2>\n'), (1, "section1.html"): (1, "section", text(3)), (2, "index.html"): (0, "document", "")}


def test_nodes_have_the_columns_that_are_asked_for(spark):
    """The parser makes no column that a query does not read; what it makes is as before."""
    text = "\\section{A}\\label{a}" + "\\begin{theorem}[o]b\\end{theorem}" * 3
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, None])], ["doc_id", "text"])
    whole, some = pa.Table.from_batches(peel._peel(iter([batch]))), pa.Table.from_batches(peel._peel(iter([batch]), ("doc_id", "title", "pos")))
    assert some.column_names == ["doc_id", "title", "pos"] and some.equals(whole.select(some.column_names))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert peel.peel(docs, ("pos", "marker", "star")).columns == ["doc_id", "pos", "marker", "star", "node_id"]
    assert peel.peel(docs, ("depth",)).columns == ["doc_id", "depth"]
    assert peel.peel(docs).columns[-2:] == ["content_hash", "node_id"]


def test_containing_sections_read_the_atlas_for_each_side_once(spark):
    """A statement, what it is in and its number are three reads, and no read climbs back to the statement."""
    from foliograph.plans import structure

    plan = structure.containing_section(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3 and "body" not in plan
