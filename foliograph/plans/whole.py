r"""Queries on whole documents: pages as files, edges, macros in stages, bibliographies, projects, rule packs; oracles are SQL over the rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical
from ..functions import pages as P
from ..functions.rules import apply_packs
from ..operators import bibliography, content, edges, floats, frontmatter, links, macros, navigation, numbering, paging, papers, tags
from ..operators.peel import peel
from ..sources import documents, project, synthetic
from ..sources.synthetic import joined, table
from .structure import COUNTED, HEADINGS


def _tagged(nodes: DataFrame, target: str) -> DataFrame:
    done = tags.converted(tags.tagged(numbering.assign_ids(nodes), target), target)
    return done.withColumn("open_tag", F.concat("open_tag", "heading"))


def _atlas(spark: SparkSession, sf_dir: str, only: tuple[str, ...] = ()) -> DataFrame:
    return numbering.number_nodes(peel(synthetic.atlas(spark, sf_dir), only))


def page_files(spark, sf_dir):
    """The atlas cut into pages: a region's chapter with links to its nations, and a page for each of these."""
    return paging.pages(_tagged(_atlas(spark, sf_dir), "html"), "html").select(F.col("doc_id").alias("r_regionkey"), "file", "text")


def page_files_ptx(spark, sf_dir):
    return paging.pages(_tagged(_atlas(spark, sf_dir), "ptx"), "ptx").select(F.col("doc_id").alias("r_regionkey"), "file", "text")


def main_pages(spark, sf_dir):
    """Main files of the atlas with authors, an abstract for some, and an index."""
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("{A}tlas of "), "r_name").alias("title"), F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit(" On "), "r_name")).alias("abstract"))
    names = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("doc_id")).agg(F.sort_array(F.collect_list("n_name")).alias("authors"))
    roots = paging.page_roots(_atlas(spark, sf_dir, (*HEADINGS, "last", "label")), "ptx")
    preludes = region.select("doc_id", F.concat(F.lit("<macros>"), "doc_id", F.lit("</macros>\n")).alias("prelude"))
    return paging.top_pages(region.join(names, "doc_id", "left"), roots, preludes, F.col("doc_id") > 1).select(F.col("doc_id").alias("r_regionkey"), "file", "text")


def bibliography_files(spark, sf_dir):
    docs = synthetic.citing_orders(spark, sf_dir)
    found = links.bib_entries(docs)
    return paging.bibliography_pages(found, "html", "ptx").select(F.col("doc_id").alias("l_orderkey"), "file", "text")


def subtree_edges(spark, sf_dir):
    """Statements whose references stand in list items, equations, an option and a proof inside them; the last line refers from outside."""
    return edges.document_edges(_edge_documents(spark, sf_dir)).select(F.col("doc_id").alias("l_orderkey"), "source", "target")


def _edge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's items are known by their numbers alone, which run from 1 to how many there are: none is sorted or collected.

    The parts are set, as counts are small and what is read out of them is long.
    """
    keys = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id")).where("doc_id is not null")
    orders = keys.repartition(8 * spark.sparkContext.defaultParallelism, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    one = lambda k: F.concat(
        F.lit("\\begin{theorem}[after \\ref{1}]\\label{"), k.cast("string"),
        F.lit("}A.\\begin{itemize}\\item by \\eqref{2}\\item no\\end{itemize}\\begin{equation}x\\text{ as in \\ref{"), (k + 1).cast("string"),
        F.lit("}}\\end{equation}\\begin{proof}\\ref{none}\\end{proof}\\end{theorem} \\ref{3}\n"),
    )
    return orders.select("doc_id", F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), "n"), one), "").alias("text"))


def macro_stages(spark, sf_dir):
    """Definitions with text around them, over several lines and of every kind; structural, author and target macros in turn."""
    text = F.format_string(
        "a \\newcommand{\\be}[1]{\\begin{lemma}\\label{#1}} b\n\\newcommand{\\two}[2]{#2\n-#1 %d}\n\\def\\q#1{<#1>} c \\be{x%d} \\two{\\q y}{z}\\let\\w=\\q \\w1 \\open \\newcommand{\\open}{",
        "p_size", "p_partkey",
    )
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))
    out = macros.expand_macros(docs, macros.extract_macros(docs), target={"label": (1, "[#1]")})
    return out.select(F.col("doc_id").alias("p_partkey"), "text")


def macro_spans(spark, sf_dir):
    """Where definitions stand in their text."""
    docs = synthetic.macro_documents(spark, sf_dir)
    m = macros.extract_macros(docs).join(docs, "doc_id")
    return m.select(F.col("doc_id").alias("p_partkey"), "name", F.col("start").cast("long").alias("start"), F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("source"))


def bib_sources(spark, sf_dir):
    """One entry per supplier in four notations, which give one table; labels with brackets, braces and quotes in values."""
    s = table(spark, sf_dir, "supplier")
    text = F.format_string(
        "\\bibitem[A [%d]]{k%d} Smith, {\\it T}.\n\\end{thebibliography}\n@string{jj = \"Jour\"}@article{b%d, author = {A {B}. %d and C. D.}, title = \"On {\"}x{\"}\" # { y}, journal = jj, volume = 3, year = 1999, pages={1--%d}}\n"
        "\\bib{r%d}{book}{ author={E. F.}, author={G. H.}, title={Rings}, publisher={P}, date={2001-05}}\n\\ref\\no %d\\by I. {\\it J.}\\paper Words\\jour J\\vol 7\\yr 1980\\endref",
        *["s_suppkey"] * 7,
    )
    docs = s.select(F.col("s_suppkey").alias("doc_id"), text.alias("text"))
    return bibliography.entries(bibliography.record_fields(docs)).select(F.col("doc_id").alias("s_suppkey"), "notation", "kind", "key", "label", "raw")


def include_chain(spark, sf_dir):
    """A file per supplier that includes the next of its nation, and a nation that includes its first: as deep as a nation has suppliers."""
    s = table(spark, sf_dir, "supplier")
    from pyspark.sql import Window as W

    w = W.partitionBy("s_nationkey").orderBy("s_suppkey")
    following = F.lead("s_suppkey").over(w)
    leaves = s.select(F.concat(F.lit("s"), "s_suppkey").alias("file"), F.when(following.isNull(), "end").otherwise(F.format_string("x \\input{s%d}", following)).alias("text"))
    roots = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("k")).select(F.concat(F.lit("n"), "s_nationkey").alias("file"), F.format_string("\\include{s%d}", "k").alias("text"))
    found = documents.expand_includes(roots.unionByName(leaves), roots.select("file"), max_depth=None)
    return found.select("root", "file", F.col("depth").cast("long").alias("depth"), "cyclic")


def _folder(spark: SparkSession) -> str:
    """A new folder that executors share: below the session's ``spark.checkpoint.dir``, or a local one on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="foliograph-")
    return f"{root.rstrip('/')}/pages-{uuid.uuid4().hex}"


def pages_written(spark, sf_dir):
    """Pages of the atlas written under their own names, and read back."""
    pages = page_files(spark, sf_dir).select(F.concat(F.lit("r"), "r_regionkey").alias("folder"), "file", "text")
    path = _folder(spark)
    project.write_project(pages, path)
    back = project.read_project(spark, path, raw=True)
    return back.select("file", F.sha1("text").alias("text_sha1"), F.length("text").cast("long").alias("chars"))


def project_files(spark, sf_dir):
    """Sources of several endings in folders by nation; those with .tex are read."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    file = F.concat(F.lower("c_mktsegment"), F.when(F.col("c_nationkey") % 2 == 0, ".tex").otherwise(".txt"))
    path = _folder(spark)
    project.write_project(c.select(F.concat(F.lit("n"), "c_nationkey").alias("folder"), file.alias("file"), F.format_string("caf\u00e9\t%d\r\nx", "n").alias("text")), path)
    return project.read_project(spark, path, ".tex").select("file", "text")


def rule_packs(spark, sf_dir):
    """Two packs of rules, chosen by row, and parts that have none."""
    rules = spark.createDataFrame(
        [("even", "before", 2, "b+", "<$0>"), ("even", "before", 1, "a", "b"), ("odd", "before", 1, "(?i)A([0-9])", "$1!"), ("odd", "after", 1, ".", "never")], "pack string, stage string, seq int, pattern string, replacement string"
    )
    text = F.format_string("ab a%d A%d", "p_size", "p_size")
    pack = F.when(F.col("p_size") % 3 == 0, "even").when(F.col("p_size") % 3 == 1, "odd")
    docs = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), pack.alias("pack"))
    return apply_packs(docs, rules, "before").select("p_partkey", "text")


def float_labels(spark, sf_dir):
    """Figures whose caption, image and label stand in a minipage inside them."""
    text = F.format_string("\\begin{figure}\\caption{first}\\end{figure}\\begin{figure}\\begin{minipage}{2in}\\includegraphics{p%d}\\caption{Size %d}\\label{f:%d}\\end{minipage}\\end{figure} see \\ref{f:%d}", "p_partkey", "p_size", "p_partkey", "p_partkey")
    nodes = numbering.number_nodes(peel(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text")), (*COUNTED, "label", "body", "float")))
    labels = numbering.labels(nodes)
    shown = links.splice(nodes, links.resolve(links.references(nodes), labels)).where("marker = 'document'").select("doc_id", F.substring_index("body", " see ", -1).alias("shown"))
    held = floats.owned(floats.floats(nodes), nodes).groupBy("doc_id", "owner").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "kind", "content"))), ";").alias("holds"))
    figures = nodes.where("marker = 'figure'").select("doc_id", F.col("pos").alias("owner"), "label", "codenumber")
    return figures.join(held, ["doc_id", "owner"]).join(shown, "doc_id").select(F.col("doc_id").alias("p_partkey"), "label", "codenumber", "holds", "shown")


def paper_records(spark, sf_dir):
    """Suppliers' papers by code: known ones fill what a document lacks, unknown ones change nothing; the records that lead to them."""
    s = table(spark, sf_dir, "supplier")
    paper = F.struct(F.format_string("Paper %d", "s_suppkey").alias("title"), F.array(*[F.struct(F.lit(a).alias("firstname"), F.col("s_name").alias("lastname")) for a in ("Ann", "Bo", "Cy")]).alias("authors"))
    known = s.where("s_suppkey % 2 = 0").select(F.to_json(F.create_map(F.concat(F.lit("c"), "s_suppkey"), paper)).alias("text"))
    fronts = s.select(F.col("s_suppkey").alias("doc_id"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("Own")).alias("title"), F.when(F.col("s_suppkey") % 5 == 0, F.array(F.lit("D. E."))).otherwise(F.array().cast("array<string>")).alias("authors"), F.concat(F.lit("c"), "s_suppkey").alias("code"))
    filled = papers.title_lines(papers.fill_from_papers(fronts, papers.parse_papers(known)))
    return paging.title_records(filled.withColumn("folder", F.concat(F.lit("out/"), "doc_id"))).select(F.col("doc_id").alias("s_suppkey"), "file", "text")


def solution_ids(spark, sf_dir):
    """Problems whose solutions have one id."""
    one = F.format_string('<solution xml:id="s%d"><p>x</p></solution>', "p_partkey")
    text = F.concat(F.lit('<exercise xml:id="e">'), F.repeat(one, F.col("p_size") % 4), F.lit('<hint xml:id="h"/></exercise>'), one)
    from ..functions.scanner import column

    return table(spark, sf_dir, "part").select("p_partkey", column(P.unique_ids)(text).alias("page"))


def node_paragraphs(spark, sf_dir):
    """Paragraphs around statements, math in a line and on its own, literal words and lists."""
    text = F.format_string("One\nline $x_%d$ and \\verb|q|.\n\nTwo \\begin{theorem}In %d.\n \nMore\\end{theorem} three $$y$$ {\n\n}\\begin{itemize}\\item a\\\\b\\end{itemize}", "s_suppkey", "s_suppkey")
    nodes = peel(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), text.alias("text")))
    found = content.node_paragraphs(nodes).withColumn("target", F.lit("html")).unionByName(content.node_paragraphs(nodes, "ptx").withColumn("target", F.lit("ptx")))
    return found.select(F.col("doc_id").alias("s_suppkey"), "target", F.col("pos").cast("long").alias("pos"), F.col("ordinal").cast("long").alias("ordinal"), "paragraph")


def image_elements(spark, sf_dir):
    """Images of every kind and size: none, scaled, in inches, in shares of the line, in a scaled box."""
    text = F.format_string("\\includegraphics{a/b%d.pdf}\\psfig{figure=c.eps,width=2in}\\epsfbox{d.eps}\\includegraphics[width=.%d\\textwidth]{e}\\scalebox{0.25}{x \\includegraphics{f}} \\epsfig{file=g.eps, scale=1.5}", "p_size", "p_size")
    nodes = part_nodes(spark, sf_dir, text)
    found = floats.floats(nodes)
    both = floats.image_markup(found).withColumn("target", F.lit("html")).unionByName(floats.image_markup(found, "ptx").withColumn("target", F.lit("ptx")))
    return both.groupBy(F.col("doc_id").alias("p_partkey"), "target").agg(navigation.in_order(F.col("k"), F.col("markup")).alias("markup"))


def context_snippets(spark, sf_dir):
    """Terms and index entries in a statement, an item's list and a section: their surroundings, whole, with links to their places."""
    text = F.format_string(
        "\\section{Sup %d}\\label{s:%d}\\begin{theorem}\\label{t:%d}A \\index{a}$x$ \\begin{proof}\\label{p:%d}by \\index{b}%d\\end{proof}\\end{theorem}\\section{Two}\\label{u:%d}no \\index{c}.", *["s_suppkey"] * 6
    )
    nodes = numbering.assign_ids(numbering.number_nodes(peel(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), text.alias("text")))))
    entries = frontmatter.marked_entries(nodes, "index")
    done = tags.converted(tags.tagged(nodes, "html"), "html").withColumn("open_tag", F.concat("open_tag", "heading"))
    return paging.context_snippets(done, entries).withColumnRenamed("doc_id", "s_suppkey")


def part_nodes(spark, sf_dir, text) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("pos"), text.alias("body"))


def workspaces(spark, sf_dir):
    """Room for answers, statements before solutions, and videos."""
    from ..functions.scanner import column

    text = F.format_string('<exercise>Do %d \\flexskip{%d}<solution>s</solution></exercise><task><p>\\flexskip{2}t</p></task> \\vvideohref{x-y-%d&t=1}.', "p_partkey", "p_size", "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", column(lambda t: P.video_links(P.workspaces(t)))(text).alias("page"))


def archaic_forms(spark, sf_dir):
    """AMS and plain TeX: statements, tags, infixes, rows, alphabets, numbers of equations, zero rules, passages that are passed over."""
    text = F.format_string(
        "\\head On %d\\endhead \\proclaim{Lemma 2} \\Bbb R^{a \\over %d} \\endproclaim $$x = 1 \\eqno(%d)$$ $\\matrix{a & b\\cr c}$ \\iffalse no \\ifx y\\fi\\fi $n \\choose k$ \\rule{0in}{2em}\\par end $$\\align u&=v\\endalign$$ \\demo{} p \\enddemo \\Sb i\\endSb",
        "p_size", "p_size", "p_partkey",
    )
    return table(spark, sf_dir, "part").select("p_partkey", canonical.canonical(text).alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        page_files, page_files_ptx, main_pages, bibliography_files, subtree_edges, macro_stages, macro_spans, bib_sources, include_chain, pages_written, project_files, rule_packs, float_labels,
        paper_records, solution_ids, node_paragraphs, image_elements, workspaces, archaic_forms, context_snippets,
    )
}

_ATLAS = """c AS (SELECT c_custkey, c_mktsegment, n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS t FROM customer JOIN nation ON c_nationkey = n_nationkey),
n AS (SELECT n_nationkey, n_name, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS s FROM nation)"""
_PAGES = f"""{_ATLAS},
a AS (SELECT c.n_nationkey, string_agg(chr(10) || '<article class="theorem-like" id="c:' || c_custkey || '"><h5 class="heading"><span class="type">Theorem</span><span class="codenumber">1.' || s || '.' || t || '</span></h5>' || c_mktsegment || chr(10) || '</article>' || chr(10) || chr(10), '' ORDER BY c_custkey) AS body FROM c JOIN n USING (n_nationkey) GROUP BY 1),
p AS (SELECT n_regionkey::BIGINT AS r_regionkey, 'section1-' || s || '.html' AS file, chr(10) || '<section class="section" id="n:' || n_nationkey || '"><h2 class="heading hide-type"><span class="type">Section</span> <span class="codenumber">1.' || s || '</span><span class="title">' || n_name || '</span></h2>' || chr(10) || coalesce(body, '') || chr(10) || '</section>' || chr(10) AS text FROM n LEFT JOIN a USING (n_nationkey)
UNION ALL SELECT r_regionkey::BIGINT, 'chapter1.html', chr(10) || '<section class="chapter" id="r:' || r_regionkey || '"><h1 class="heading hide-type"><span class="type">Chapter</span> <span class="codenumber">1</span><span class="title">' || r_name || '</span></h1>' || chr(10) || string_agg('<h2 class="link"><a href="section1-' || s || '.html">' || n_name || '</a></h2>' || chr(10), '' ORDER BY s) || chr(10) || '</section>' || chr(10) FROM region JOIN n ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name
UNION ALL SELECT r_regionkey::BIGINT, 'index.html', '<h2 class="link"><a href="chapter1.html">' || r_name || '</a></h2>' || chr(10) FROM region)"""
_TIKZ = " || ".join(f"'{x}' || chr(10)" for x in navigation.PREAMBLE_TIKZ)

ORACLES = {
    "context_snippets": """WITH t AS (SELECT s_suppkey AS k, chr(10) || '<article class="proof" id="p:' || s_suppkey || '"><h5 class="heading">Proof</h5>by ' || s_suppkey || chr(10) || '</article>' || chr(10) AS p FROM supplier)
SELECT k AS s_suppkey, sha1(k || ':2') || '.knowl' AS file, chr(10) || '<article class="theorem-like" id="t:' || k || '"><h5 class="heading"><span class="type">Theorem</span><span class="codenumber">1.1</span></h5>A \\(x\\) ' || p || chr(10) || '</article>' || chr(10) || '<span class="incontext"><a href="section1.html#t:' || k || '">in context</a></span>' AS text FROM t
UNION ALL SELECT k, sha1(k || ':4') || '.knowl', p || '<span class="incontext"><a href="section1.html#p:' || k || '">in context</a></span>' FROM t
UNION ALL SELECT k, sha1(k || ':5') || '.knowl', chr(10) || '<section class="section" id="u:' || k || '"><h2 class="heading hide-type"><span class="type">Section</span> <span class="codenumber">2</span><span class="title">Two</span></h2>no .' || chr(10) || '</section>' || chr(10) || '<span class="incontext"><a href="section2.html#u:' || k || '">in context</a></span>' FROM t""",
    "node_paragraphs": """WITH v(target, pos, ordinal, a, b) AS (VALUES ('html', 0, 1, 'One' || chr(10) || 'line ⟦1⟧ and ⟦2⟧.', ''), ('html', 0, 2, 'Two', ''), ('html', 0, 3, 'three', ''), ('html', 3, 1, 'In ', '.'), ('html', 3, 2, 'More', ''), ('html', 6, 1, 'a\\\\b', ''))
SELECT s_suppkey, target, pos, ordinal, CASE WHEN b = '' THEN a ELSE a || s_suppkey || b END AS paragraph FROM supplier, v
UNION ALL SELECT s_suppkey, 'ptx', pos, ordinal, CASE WHEN b = '' THEN a ELSE a || s_suppkey || b END FROM supplier, v WHERE pos < 6 UNION ALL SELECT s_suppkey, 'ptx', 6, k, ['a', 'b'][k] FROM supplier, (VALUES (1), (2)) AS w(k)""",
    "image_elements": """SELECT p_partkey, 'html' AS target, '<img src="a/b' || p_size || '.pdf" /><img src="c.eps" /><img src="d.eps" /><img src="e" /><img src="f" /><img src="g.eps" />' AS markup FROM part
UNION ALL SELECT p_partkey, 'ptx', '<image width="73%" source="images/b' || p_size || '.pdf" /><image width="37%" source="images/c.eps" /><image width="73%" source="images/d.eps" /><image width="' || trunc(100::DOUBLE * ('0.' || p_size)::DOUBLE)::INT || '%" source="images/e" /><image width="25%" source="images/f" /><image width="150%" source="images/g.eps" />' FROM part""",
    "workspaces": """SELECT p_partkey, '<exercise workspace="' || p_size || '0%"><statement>Do ' || p_partkey || ' </statement>' || chr(10) || '<solution>s</solution></exercise><task workspace="20%"><p>t</p></task> &nbsp;&nbsp;<span class="videolink"><a href="https://www.youtube.com/watch?v=' || p_partkey || '">&#127909;</a></span>.' AS page FROM part""",
    "archaic_forms": r"""SELECT p_partkey, '\section*{On ' || p_size || '} \begin{lemma} \mathbb  R^{\frac{a }{ ' || p_size || '}} \end{lemma} $$x = 1 \tag{' || p_partkey || '}$$ $\begin{matrix}a & b\\ c\end{matrix}$  $\binom{n }{ k}$ ' || chr(10) || chr(10) || ' end \begin{align} u&=v\end{align} \begin{proof}{} p \end{proof} _{ i}' AS text FROM part""",
    "page_files": f"WITH {_PAGES} SELECT * FROM p",
    "page_files_ptx": f"""WITH {_ATLAS}, a AS (SELECT n_nationkey, string_agg(chr(10) || '<theorem xml:id="c:' || c_custkey || '">' || c_mktsegment || chr(10) || '</theorem>' || chr(10) || chr(10), '' ORDER BY c_custkey) AS body FROM c GROUP BY 1)
SELECT n_regionkey::BIGINT AS r_regionkey, 'n_' || n_nationkey || '.ptx' AS file, chr(10) || '<section xml:id="n:' || n_nationkey || '">' || chr(10) || '<title>' || n_name || '</title>' || chr(10) || coalesce(body, '') || '</section>' AS text FROM n LEFT JOIN a USING (n_nationkey)
UNION ALL SELECT r_regionkey::BIGINT, 'r_' || r_regionkey || '.ptx', chr(10) || '<chapter xmlns:xi="http://www.w3.org/2001/XInclude"  xml:id="r:' || r_regionkey || '">' || chr(10) || '<title>' || r_name || '</title>' || chr(10) || string_agg('<xi:include  href="n_' || n_nationkey || '.ptx" />' || chr(10), '' ORDER BY s) || '</chapter>' FROM region JOIN n ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name
UNION ALL SELECT r_regionkey::BIGINT, 'main.ptx', '<xi:include  href="r_' || r_regionkey || '.ptx" />' || chr(10) FROM region""",
    "main_pages": f"""WITH a AS (SELECT n_regionkey, string_agg('<author>' || chr(10) || '<personname>' || n_name || '</personname>' || chr(10) || '</author>' || chr(10), '' ORDER BY n_name) AS authors FROM nation GROUP BY 1)
SELECT r_regionkey::BIGINT AS r_regionkey, 'main.ptx' AS file, '<?xml version="1.0" encoding="UTF-8" ?>' || chr(10) || '<pretext xmlns:xi="http://www.w3.org/2001/XInclude">' || chr(10) || '<docinfo>' || chr(10) || '<macros>' || r_regionkey || '</macros>' || chr(10) || chr(10) || '<latex-image-preamble>' || chr(10) || {_TIKZ} || chr(10) || '\\usepackage{{pgfplots}}' || chr(10) || chr(10) || '</latex-image-preamble>' || chr(10) || chr(10) || '</docinfo>' || repeat(chr(10), 3)
 || '<book>' || chr(10) || '    <title>Atlas of ' || r_name || '    </title>' || chr(10) || '<frontmatter>' || chr(10) || '<titlepage>' || chr(10) || authors || '</titlepage>' || chr(10) || CASE WHEN r_regionkey % 2 = 0 THEN chr(10) || '<abstract>' || chr(10) || 'On ' || r_name || chr(10) || '</abstract>' || chr(10) ELSE '' END
 || '</frontmatter>' || chr(10) || chr(10) || chr(10) || '<xi:include href="./r_' || r_regionkey || '.ptx" />' || chr(10) || chr(10) || '<backmatter>' || chr(10) || CASE WHEN r_regionkey > 1 THEN '<index>' || chr(10) || '<title>Index</title>' || chr(10) || '<index-list />' || chr(10) || '</index>' || chr(10) ELSE '' END || chr(10) || '</backmatter>' || chr(10) || '</book>' || chr(10) || '</pretext>' || chr(10) AS text FROM region JOIN a ON n_regionkey = r_regionkey""",
    "bibliography_files": """WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey AS k FROM lineitem WHERE l_suppkey % 2 = 0)
SELECT l_orderkey, 'bibliography.html' AS file, '<section class="section" id="section1*"><h2 class="heading hide-type"><span class="type">Section</span><span class="title">Bibliography</span></h2>' || string_agg('<div class="bib"><span class="bibitem">[S' || k || ']</span><span id="s' || k || '" class="bibentry">Supplier</span></div>' || chr(10), '' ORDER BY k) || '</section>' || chr(10) AS text FROM s GROUP BY 1
UNION ALL SELECT l_orderkey, 'bibliography.ptx', chr(10) || '<references>' || chr(10) || chr(10) || '<title>Bibliography</title>' || chr(10) || string_agg(chr(10) || '<biblio type="raw" xml:id="s' || k || '">Supplier</biblio>', '' ORDER BY k) || chr(10) || '</references>' || chr(10) FROM s GROUP BY 1""",
    "subtree_edges": """WITH m AS (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY 1), e AS (SELECT l_orderkey, l_linenumber AS s, unnest([1, 2, l_linenumber + 1]) AS t FROM lineitem)
SELECT DISTINCT l_orderkey, s::VARCHAR AS source, t::VARCHAR AS target FROM e JOIN m USING (l_orderkey) WHERE t <= n""",
    "macro_stages": r"""SELECT p_partkey, 'a  b' || chr(10) || ' c \begin{lemma}[x' || p_partkey || '] z' || chr(10) || '-<y> ' || p_size || ' <1> \open \newcommand{\open}{' AS text FROM part""",
    "macro_spans": """WITH t AS (SELECT p_partkey, '\\newcommand{\\brand}{' || p_brand || '}' AS a, '\\newcommand{\\size}[1]{size #1 of ' || p_size || '}' AS b, '\\newcommand{\\both}[2]{#2 before #1}' AS c FROM part)
SELECT p_partkey, 'brand' AS name, 0 AS start, a AS source FROM t UNION ALL SELECT p_partkey, 'size', length(a) + 1, b FROM t UNION ALL SELECT p_partkey, 'both', length(a) + length(b) + 2, c FROM t""",
    "bib_sources": r"""SELECT s_suppkey, 'items' AS notation, 'item' AS kind, 'k' || s_suppkey AS key, 'A [' || s_suppkey || ']' AS label, 'Smith, {\it T}.' AS raw FROM supplier
UNION ALL SELECT s_suppkey, 'bib', 'article', 'b' || s_suppkey, '1', 'A {B}. ' || s_suppkey || ', C. D., \textit{On {"}x{"} y}, Jour \textbf{3} (1999), 1--' || s_suppkey || '.' FROM supplier
UNION ALL SELECT s_suppkey, 'amsrefs', 'book', 'r' || s_suppkey, '1', 'E. F., G. H., \textit{Rings}, P (2001).' FROM supplier
UNION ALL SELECT s_suppkey, 'records', 'article', s_suppkey::VARCHAR, s_suppkey::VARCHAR, 'I. {\it J.}, \textit{Words}, J \textbf{7} (1980).' FROM supplier""",
    "include_chain": """SELECT 'n' || s_nationkey AS root, 's' || s_suppkey AS file, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS depth, false AS cyclic FROM supplier UNION ALL SELECT DISTINCT 'n' || s_nationkey, 'n' || s_nationkey, 0, false FROM supplier""",
    "pages_written": f"WITH {_PAGES} SELECT 'r' || r_regionkey || '/' || file AS file, sha1(text) AS text_sha1, length(text) AS chars FROM p",
    "project_files": "SELECT 'n' || c_nationkey || '/' || lower(c_mktsegment) || '.tex' AS file, 'caf\u00e9 ' || count(*) || chr(10) || 'x' AS text FROM customer WHERE c_nationkey % 2 = 0 GROUP BY c_nationkey, c_mktsegment",
    "rule_packs": "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '<bb> <b>' || p_size || ' A' || p_size WHEN 1 THEN 'ab ' || left(p_size::VARCHAR, 1) || '!' || substr(p_size::VARCHAR, 2) || ' ' || left(p_size::VARCHAR, 1) || '!' || substr(p_size::VARCHAR, 2) ELSE 'ab a' || p_size || ' A' || p_size END AS text FROM part",
    "float_labels": "SELECT p_partkey, 'f:' || p_partkey AS label, '0.2' AS codenumber, 'caption:Size ' || p_size || ';image:p' || p_partkey AS holds, '0.2' AS shown FROM part UNION ALL SELECT p_partkey, '', '0.1', 'caption:first', '0.2' FROM part",
    "paper_records": """WITH t AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'Own' WHEN s_suppkey % 2 = 0 THEN 'Paper ' || s_suppkey ELSE '' END AS title, CASE WHEN s_suppkey % 5 = 0 THEN 'D. E.' WHEN s_suppkey % 2 = 0 THEN 'Ann ' || s_name || ', Bo ' || s_name || ', and Cy ' || s_name ELSE '' END AS authors FROM supplier)
SELECT k AS s_suppkey, 'titleauthor.txt' AS file, chr(10) || chr(10) || '<div class="title"><a href="out/' || k || '">' || title || '</a></div>' || repeat(chr(10), 3) || '<div class="author">by ' || authors || '</div>' || chr(10) || chr(10) AS text FROM t""",
    "solution_ids": """WITH p AS (SELECT p_partkey, p_size % 4 AS n FROM part)
SELECT p_partkey, '<exercise xml:id="e">' || array_to_string([CASE WHEN k < n THEN '<solution xml:id="s' || p_partkey || CASE WHEN n > 1 THEN chr(97 + k) ELSE '' END || '"><p>x</p></solution>' ELSE '' END FOR k IN [0, 1, 2]], '') || '<hint xml:id="h"/></exercise><solution xml:id="s' || p_partkey || '"><p>x</p></solution>' AS page FROM p""",
}
_ITEMS = f"(SELECT * REPLACE (row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(synthetic.ITEM_ORDER)}) AS l_linenumber) FROM lineitem)"
ORACLES = {k: re.sub(r"\b(FROM|JOIN) lineitem\b", rf"\1 {_ITEMS} AS li", v) for k, v in ORACLES.items()}
