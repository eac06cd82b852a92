r"""Queries on pages, links, tags, terms and sources; every oracle is SQL over the relational rows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import canonical, pages, scanner
from ..functions import text as X
from ..operators import content, frontmatter, links, macros, navigation, numbering, references, tags, terms
from ..operators.peel import peel
from ..sources import documents, sinks, synthetic
from ..sources.synthetic import joined, table
from .structure import COUNTED, HEADINGS


def nested_math(spark, sf_dir):
    """Cases inside the rows of an align: each belongs to its row, and the document comes back from the tree."""
    s = F.format_string("x_{%d} &= \\begin{cases}%d & a\\\\ 0 & b\\end{cases}", "l_linenumber", F.col("l_quantity").cast("int"))
    rows = synthetic.line_items(spark, sf_dir).groupBy("l_orderkey").agg(joined(F.collect_list(F.struct("l_linenumber", s.alias("s"))), " \\\\\n").alias("rows"))
    docs = rows.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("⟦7⟧ \\begin{align}"), "rows", F.lit("\\end{align}")).alias("text"))
    cases = F.collect_list(F.when(F.col("marker") == "cases", F.struct(F.col("outer").alias("row"), "depth"))).alias("cases")
    back = content.assemble(peel(docs), also=(cases,)).withColumnRenamed("text", "back").join(docs, "doc_id")
    each = back.select("doc_id", (F.col("back") == F.col("text")).alias("same"), F.explode("cases").alias("c"))
    return each.select(F.col("doc_id").alias("l_orderkey"), F.col("c.row").cast("long").alias("row"), F.col("c.depth").cast("long").alias("depth"), "same")


def part(spark, sf_dir):
    return table(spark, sf_dir, "part")


def page_statements(spark, sf_dir):
    text = F.format_string('a <theorem xml:id="t%d"><title>%s</title><p>b</p><proof><p>c</p></proof></theorem> d<example><p>%d</p></example>', "p_partkey", "p_name", "p_size")
    return part(spark, sf_dir).select("p_partkey", scanner.column(pages.wrap_statements)(text).alias("page"))


def page_lists(spark, sf_dir):
    text = F.format_string('<p>x</p> <ol><li>%d<ul><li class="c" label="(a)" >%s</li></ul></li></ol>', "p_size", "p_name")
    return part(spark, sf_dir).select("p_partkey", scanner.column(lambda t: pages.titles_before_paragraphs(pages.items_in_paragraphs(pages.lists_in_paragraphs(t))))(text).alias("page"))


def page_math(spark, sf_dir):
    text = F.format_string("<p>so</p> <me>%d\\text{ if <m>y</m>}</me> <md><mrow>b<nbsp/>c</mrow></md> <p>and on</p> <p>Then</p>", "p_size")
    return part(spark, sf_dir).select("p_partkey", scanner.column(lambda t: pages.math_in_paragraphs(pages.math_delimiters(t)))(text).alias("page"))


def page_hints(spark, sf_dir):
    text = F.format_string("<exercise><p>%d</p></exercise> <hint><ol><li>a</li></ol></hint><answer><m>%d</m></answer> <p>z</p>", "p_size", "p_partkey")
    return part(spark, sf_dir).select("p_partkey", scanner.column(lambda t: pages.hints_in_activities(pages.hints_in_paragraphs(pages.answers_in_paragraphs(t))))(text).alias("page"))


def page_tags(spark, sf_dir):
    text = F.format_string('\\code{%s} <u>%d</u> & <hash/> \\href{http://x/?a&b<hash/>%d}{t} <p>...</p> width="140%%" \\alpha\\quad <u> </u>', "p_name", "p_size", "p_partkey")
    return part(spark, sf_dir).select("p_partkey", scanner.column(lambda t: pages.fix_structured_tags(pages.fix_tags(t)))(text).alias("page"))


def page_layout(spark, sf_dir):
    text = F.format_string('<section xml:id="s%d"><title> %s </title> <p> x <m> y </m></p><p>z</p><me>%d</me></section>', "p_partkey", "p_name", "p_size")
    return part(spark, sf_dir).select("p_partkey", scanner.column(pages.white_space)(text).alias("page"))


def page_finished(spark, sf_dir):
    """All passes of the structured target on one page."""
    text = F.format_string("<p>See <b>%s</b> <br/></p><p></p><theorem><p>%d</p><p>b</p></theorem> <p>\\begin{investigation}</p><p>w</p><p>\\end{investigation}</p>", "p_name", "p_size")
    return part(spark, sf_dir).select("p_partkey", pages.finish(text).alias("page"))


def _tagged_docs(spark, sf_dir):
    text = F.format_string(
        "\\section{Part %d}\\label{s:%d}\\begin{theorem}[of %s]\\label{t:%d}Size $x<%d$.\\end{theorem}\\begin{proof}Clear.\\end{proof}\\begin{enumerate}\\item one\\item[(b)] two\\end{enumerate}\\begin{equation}\\label{e:%d}q=%d\\end{equation}",
        "p_partkey", "p_partkey", "p_brand", "p_partkey", "p_size", "p_partkey", "p_size",
    )
    docs = part(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), text.alias("text"))
    return numbering.assign_ids(numbering.number_nodes(peel(docs)))


def _html_nodes(spark, sf_dir):
    n = _tagged_docs(spark, sf_dir).withColumn("codenumber", F.coalesce("codenumber", "place"))
    return n.withColumn("out_id", F.when(F.col("marker").isin("item", "proof"), F.col("marker")).otherwise(F.col("out_id")))


def tags_html(spark, sf_dir):
    return tags.pages_text(_html_nodes(spark, sf_dir), "html").select(F.col("doc_id").alias("p_partkey"), "text")


def tags_ptx(spark, sf_dir):
    n = _tagged_docs(spark, sf_dir)
    return tags.pages_text(n, "ptx").select(F.col("doc_id").alias("p_partkey"), "text")


def hidden_proofs(spark, sf_dir):
    """Whole documents whose proofs are links to snippets of their own."""
    return tags.pages_text(_html_nodes(spark, sf_dir), "html", hide=("proof",)).select(F.col("doc_id").alias("p_partkey"), "text")


def _referring(spark, sf_dir):
    """An order is a document; its first item refers to the section and theorem of its part, to an equation, and to a label that nothing has."""
    item = synthetic.line_items(spark, sf_dir).where("l_linenumber = 1")
    body = F.format_string("See Section~\\ref{s:%d} and \\ref{t:%d}, Theorem \\ref{t:%d} by \\eqref{e:%d}; \\autoref{t:%d} or Lemma \\ref{none}.", *["l_partkey"] * 5)
    nodes = item.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("pos"), body.alias("body"))
    one = lambda p, m, c: F.struct(F.concat(F.lit(p), "p_partkey").alias("label"), F.lit(m).alias("marker"), c.cast("string").alias("codenumber"), F.concat(F.lit(p[0]), "p_partkey").alias("node_id"))
    known = part(spark, sf_dir).select("p_partkey", F.explode(F.array(one("s:", "section", F.col("p_size")), one("t:", "theorem", F.concat("p_size", F.lit(".1"))), one("e:", "equation", F.concat("p_size", F.lit(".2"))))).alias("l"))
    return nodes, item.select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("p_partkey")).join(known, "p_partkey").select("doc_id", "l.*")


def links_html(spark, sf_dir):
    nodes, known = _referring(spark, sf_dir)
    return references.with_links(nodes, known, "html").select(F.col("doc_id").alias("l_orderkey"), F.col("body").alias("text"))


def links_ptx(spark, sf_dir):
    nodes, known = _referring(spark, sf_dir)
    return references.with_links(nodes, known, "ptx").select(F.col("doc_id").alias("l_orderkey"), F.col("body").alias("text"))


def cites_html(spark, sf_dir):
    item = synthetic.line_items(spark, sf_dir).where("l_linenumber = 1")
    body = F.format_string("By \\cite[p. %d]{s%d}. Also \\cite{s%d, none} and \\citeib[ibid.][p. 2]{s%d}", "l_partkey", "l_suppkey", "l_suppkey", "l_suppkey")
    nodes = item.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("pos"), body.alias("body"))
    bib = item.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("s"), "l_suppkey").alias("key"), F.concat(F.lit("S"), "l_suppkey").alias("label"))
    shown = links.splice(nodes, references.resolve_cites(nodes, bib), references.CITE_RE)
    return shown.select(F.col("doc_id").alias("l_orderkey"), F.col("body").alias("text"))


def paper_links(spark, sf_dir):
    entry = F.when(F.col("s_suppkey") % 3 == 0, F.format_string("A. B., arXiv:%s.1234v2", F.lpad(F.col("s_suppkey").cast("string"), 4, "0"))).when(F.col("s_suppkey") % 3 == 1, F.format_string("C. D., MR%s", F.lpad(F.col("s_suppkey").cast("string"), 7, "0"))).otherwise("E. F.")
    return table(spark, sf_dir, "supplier").select("s_suppkey", references.paper_link(entry).alias("link"))


def term_phrases(spark, sf_dir):
    """Terms of one and two words in texts made of them: phrases with plurals, hyphens and words in between."""
    text = F.format_string("The normal groups of size %d and a Cayley graph; %s. normal, group", "p_size", F.when(F.col("p_size") % 2 == 0, "normal group").otherwise("symmetries"))
    docs = part(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), text.alias("text"))
    wanted = spark.createDataFrame([("normal group",), ("symmetry",), ("Cayley graph",), ("lemma",), ("abc",)], "term string")
    return terms.link_terms(docs, wanted).select(F.col("doc_id").alias("p_partkey"), "phrase", "term")


def term_links_written(spark, sf_dir):
    text = F.format_string("A normal  group of %d is a group, a subgroup.", "p_size")
    docs = part(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), text.alias("text"))
    wanted = spark.createDataFrame([("normal group", "n.knowl"), ("group", "g.knowl")], "term string, file string")
    return terms.write_term_links(docs, terms.link_terms(docs, wanted), wanted).select(F.col("doc_id").alias("p_partkey"), "text")


def normal_terms(spark, sf_dir):
    term = F.format_string("(normal  groups of class%d),", "p_size")
    return part(spark, sf_dir).select("p_partkey", terms.normal_term(F.regexp_replace(term, ",$", "")).alias("a"), terms.normal_term(F.concat(F.col("p_brand"), F.lit(" rings;"))).alias("b"))


def marked_entries(spark, sf_dir):
    text = F.format_string("\\begin{theorem}A \\terminology{ring {\\it of} size %d} and \\terminology{unit}.\\end{theorem} \\index{p!%s}", "p_size", "p_brand")
    nodes = peel(part(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), text.alias("text")))
    both = frontmatter.marked_entries(nodes, "terminology").withColumn("kind", F.lit("term")).unionByName(frontmatter.marked_entries(nodes, "index").withColumn("kind", F.lit("index")))
    return both.select(F.col("doc_id").alias("p_partkey"), "kind", F.col("k").cast("long").alias("k"), "entry", F.col("context").cast("long").alias("context"))


def front_matter(spark, sf_dir):
    text = F.format_string("\\title[Short]{On $x$ of %s\\thanks{Grant %d}}\\author{A. %d\\footnote{x} and B. Two$^1$}\\author{C. Three \\\\ There}\\email{a@%d}\\begin{abstract} We {do}. \\end{abstract}", "s_name", "s_suppkey", "s_suppkey", "s_suppkey")
    found = frontmatter.front_matters(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), text.alias("text")))
    return found.select(F.col("doc_id").alias("s_suppkey"), "title", "title_short", frontmatter.serial_names(F.col("authors")).alias("authors"), "thanks", "email", "abstract")


def canonical_form(spark, sf_dir):
    text = F.format_string("\\begin{document}\\begin{Thm} \\phantom{a%d}%s \\texorpdfstring{$x$}{y}\\xspace\\end{Thm}\\noindent\\begin{IEEEproof}p\\end{IEEEproof}\\verb|\\noindent|\\section{\\label{a}B}``q\" \\multicolumn{2}{c}{m}", "p_size", "p_brand")
    return part(spark, sf_dir).select("p_partkey", canonical.canonical(text).alias("text"))


def included_text(spark, sf_dir):
    """Region files with their nations' texts in place; candidates with and without an ending; one file that is missing."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    line = F.concat(F.lit("[\\input{n"), F.col("n_nationkey"), F.lit("}]"))
    roots = nation.groupBy("n_regionkey").agg(joined(F.collect_list(F.struct("n_nationkey", line.alias("s")))).alias("text")).select(F.concat(F.lit("r"), F.col("n_regionkey"), F.lit(".tex")).alias("file"), F.concat("text", F.lit("\\input{gone}.")).alias("text"))
    leaves = nation.select(F.concat(F.lit("n"), F.col("n_nationkey"), F.when(F.col("n_nationkey") % 2 == 0, ".tex").otherwise("")).alias("file"), F.col("n_name").alias("text"))
    files = roots.unionByName(leaves)
    edge = documents.located(documents.includes(files), files)
    found = documents.expand_includes(files, region.select(F.concat(F.lit("r"), F.col("r_regionkey"), F.lit(".tex")).alias("file")), edges=edge)
    return documents.included_text(files, found)


def packages(spark, sf_dir):
    text = F.format_string("\\documentclass[a4]{article}\\usepackage{amsmath, own%d}\\usepackage[x]{other%d}", "s_suppkey", "s_suppkey")
    docs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), text.alias("text"))
    files = docs.select(F.format_string("own%d.sty", "doc_id").alias("file")).unionByName(docs.where("doc_id % 2 = 0").select(F.format_string("other%d.cls", "doc_id").alias("file")))
    return documents.package_texts(docs, files).select(F.col("doc_id").alias("s_suppkey"), F.col("ordinal").cast("long").alias("ordinal"), "package", "file")


def table_lines(spark, sf_dir):
    body = F.format_string("%s & %d & c \\\\ \\hline \\cline{2-3} d & e & f", "s_name", "s_suppkey")
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), body.alias("body"))
    return content.table_cells(t).select(F.col("doc_id").alias("s_suppkey"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "cell", "rule", "lined")


def _arrays(spark, sf_dir, target):
    body = F.format_string("%s & %d & c \\\\ \\hline\\hline d & e & f & g \\\\ \\cline{2-3} h & i \\\\ \\hline", "s_name", "s_suppkey")
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), body.alias("body"), F.when(F.col("s_suppkey") % 2 == 0, "|l|p{2cm} r").otherwise("*{3}{c}").alias("spec"))
    return content.arrays(t, target).withColumnRenamed("doc_id", "s_suppkey")


def arrays_html(spark, sf_dir):
    return _arrays(spark, sf_dir, "html")


def arrays_ptx(spark, sf_dir):
    return _arrays(spark, sf_dir, "ptx")


def sessions(spark, sf_dir):
    """Sessions with indented prompts, continued lines, two cells, a cell without an answer, and texts without prompts."""
    text = F.when(F.col("p_size") % 5 == 0, F.col("p_name")).otherwise(F.format_string("sage: f(%d)\n....: g\\\\\nh\n%s <1\nmore\n  sage: k", "p_size", "p_name"))
    return content.session_markup(part(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), text.alias("text"))).withColumnRenamed("doc_id", "p_partkey")


def comments_guarded(spark, sf_dir):
    text = F.format_string("a%%x\n  b %d \\verb|%%| \\%% c %%y\n%% whole\n\\begin{verbatim}%%k\n\\end{verbatim}%%z", "p_size")
    return part(spark, sf_dir).select("p_partkey", canonical.without_comments(text).alias("text"))


def text_cuts(spark, sf_dir):
    text = F.format_string("\\size{%d} a^{2}_%d <b> {R}ough \\term{x{y}} rest", "p_size", "p_size")
    cut = X.text_before(text, "<b>", "rest")
    return part(spark, sf_dir).select(
        "p_partkey", cut["before"].alias("before"), cut["rest"].alias("rest"), X.text_up_to(text, "<b>").alias("up_to"), X.has_macro(text, "siz").alias("siz"), X.has_macro(text, "size").alias("size"),
        X.rearrange_subscripts(text).alias("turned"), X.remove_silly_braces(F.lit("{R}ough {\\\"a}")).alias("bare"), scanner.macro_column("term", 1, "<t>#1</t>")(text).alias("wrapped"),
        scanner.column(lambda t: scanner.nth_argument(t, "size"))(text).alias("argument"), scanner.column(lambda t: scanner.delete_environment("a\\begin{x}b\\end{x}c" + t, "x"))(F.lit("!")).alias("deleted"),
    )


def svg_sizes(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", X.rescale_svg(F.format_string('<svg width="%d0pt" height="5pt" x="%d">', "p_size", "p_size"), 2.0).alias("svg"))


def early_macros(spark, sf_dir):
    """Verdicts on definitions: taken over, expandable, expandable before the structure is read."""
    text = F.format_string("\\newcommand{\\be}{\\begin{equation}}\\newcommand{\\xx}[2]{#1#2 %d}\\newcommand{\\frac}{f}\\def\\emph{e}\\newcommand{\\re}{\\re}", "p_size")
    m = macros.extract_macros(part(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), text.alias("text")))
    return m.select(F.col("doc_id").alias("p_partkey"), "name", "accepted", "expandable", "structural")


def main_files(spark, sf_dir):
    n = numbering.number_nodes(peel(synthetic.customer_books(spark, sf_dir), COUNTED))
    return sinks.main_files(links.page_names(n, "ptx")).select(F.col("doc_id").alias("c_custkey"), "text")


def snippets(spark, sf_dir):
    """Statements, proofs and equations as snippets, with what they hold."""
    n = peel(synthetic.nested_orders(spark, sf_dir), ("pos", "marker", "label", "body")).withColumn("text", F.col("body"))
    return sinks.snippets(n).withColumnRenamed("doc_id", "l_orderkey")


def render_manifest(spark, sf_dir):
    text = F.format_string("\\begin{figure}\\begin{tikzpicture}\\draw (0,0) -- (%d,1);\\end{tikzpicture}\\end{figure}", "p_size")
    nodes = peel(part(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), text.alias("text")))
    return sinks.render_requests(nodes).select(F.col("doc_id").alias("p_partkey"), "tex")


def display_math(spark, sf_dir):
    """Math in every kind of delimiters: numbers of nodes by kind and star, rows of bracketed alignments."""
    text = F.format_string("$a$ $$b_%d$$ \\[c\\] \\(d\\) \\[x &= %d \\\\ y &= 2\\]", "p_size", "p_size")
    n = peel(part(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), text.alias("text"))).where("marker <> 'document'")
    return n.groupBy(F.col("doc_id").alias("p_partkey"), "marker", "star").agg(F.count("*").alias("n"))


def paper_authors(spark, sf_dir):
    """Pages made of suppliers: the author entry of each, against people with full or first names only."""
    html = F.format_string('<head><meta name="citation_author" content="Smith%d, J." /><meta name="citation_author" content="M\u00fcller, Anna" /></head>', F.col("s_suppkey") % 7)
    page = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page_id"), html.alias("html"))
    people = spark.createDataFrame([(1, "John", "Smith3"), (2, "Anna", "Muller"), (3, "Otto", "Smith4")], "person_id long, firstname string, lastname string")
    return frontmatter.paper_authors(page, people)


def toc_linked(spark, sf_dir):
    return navigation.toc_html(numbering.number_nodes(peel(synthetic.atlas(spark, sf_dir), HEADINGS))).select(F.col("doc_id").alias("r_regionkey"), F.sha1("toc").alias("toc_sha1"), F.length("toc").cast("long").alias("chars"))


def page_buttons(spark, sf_dir):
    pages_of = links.page_names(numbering.number_nodes(peel(synthetic.customer_books(spark, sf_dir), COUNTED)))
    around = links.prev_next(pages_of, "pos")
    return around.select(F.col("doc_id").alias("c_custkey"), "file", navigation.buttons(F.col("prev"), F.col("next")).alias("html"))


def framed_pages(spark, sf_dir):
    n = numbering.number_nodes(peel(synthetic.atlas(spark, sf_dir), HEADINGS))
    pages_of = links.page_names(n).join(n.select("doc_id", "pos", "title"), ["doc_id", "pos"]).where("title is not null").withColumn("text", F.col("title"))
    return navigation.framed(pages_of, navigation.toc_html(n)).select(F.col("doc_id").alias("r_regionkey"), "file", "text")


def index_pages(spark, sf_dir):
    """An index per region: nations under their first letter, with a sort key, a sub-entry and links of two kinds."""
    n = table(spark, sf_dir, "nation")
    row = lambda entry, marker: F.struct(entry.alias("entry"), F.lit(marker).alias("marker"))
    both = F.array(row(F.concat("n_name", F.lit("@"), F.initcap("n_name")), "theorem"), row(F.concat("n_name", F.lit("!"), "n_nationkey"), "text"))
    entries = n.select(F.col("n_regionkey").alias("doc_id"), F.explode(both).alias("e"), F.col("n_nationkey").cast("string").alias("number"), F.concat(F.lit("k"), "n_nationkey", F.lit(".knowl")).alias("file")).select("doc_id", "e.*", "number", "file")
    return navigation.index_page(entries).select(F.col("doc_id").alias("n_regionkey"), "html")


def macro_preludes(spark, sf_dir):
    text = F.format_string("\\newcommand{\\be}[1]{a #1 %d}\\providecommand{\\xx}{x}\\def\\be{b%d}\\newcommand{\\frac}{f}", "p_size", "p_size")
    m = macros.extract_macros(part(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), text.alias("text")))
    return navigation.macro_prelude(m).join(navigation.macro_prelude(m, "ptx").withColumnRenamed("prelude", "ptx"), "doc_id").select(F.col("doc_id").alias("p_partkey"), "prelude", "ptx")


def drawing_documents(spark, sf_dir):
    text = F.format_string("\\newcommand{\\be}{%d}\\begin{tikzpicture}d%d\\end{tikzpicture}", "p_size", "p_size")
    docs = part(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), text.alias("text"))
    made = navigation.drawing_documents(sinks.render_requests(peel(docs)), navigation.macro_prelude(macros.extract_macros(docs)))
    return made.select(F.col("doc_id").alias("p_partkey"), "node_id", "tex")


QUERIES = {
    f.__name__: f
    for f in (
        nested_math, page_statements, page_lists, page_math, page_hints, page_tags, page_layout, page_finished, tags_html, tags_ptx, hidden_proofs, links_html, links_ptx, cites_html, paper_links,
        term_phrases, term_links_written, normal_terms, marked_entries, front_matter, canonical_form, included_text, packages, table_lines, text_cuts, svg_sizes, early_macros, main_files, snippets,
        render_manifest, display_math, paper_authors, toc_linked, page_buttons, framed_pages, index_pages, macro_preludes, drawing_documents, arrays_html, arrays_ptx, sessions, comments_guarded,
    )
}

_SECTIONS = "s AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS s FROM nation)"
_MACROS = " || chr(10) || ".join(f"'{x}'" for x in (r"\def\C{\mathbb C}", r"\def\R{\mathbb R}", r"\def\Z{\mathbb Z}", r"\def\Q{\mathbb Q}", r"\def\F{\mathbb F}", r"\def\smash{}", r"\def\phantomplus{}", r"\def\nobreak{}", r"\def\omit{}", r"\def\hidewidth{}", r"\require{cancel}"))
_TOC = """t AS (SELECT r_regionkey::BIGINT AS r_regionkey, '<h2 class="link"><a href="chapter1.html" data-scroll="chapter1"><span class="codenumber">1.</span><span class="title">' || r_name || '</span></a></h2>' || chr(10) || '<ul>' || chr(10)
 || string_agg('<li><a href="section1-' || s || '.html" data-scroll="section1-' || s || '">' || n_name || '</a></li>' || chr(10), '' ORDER BY s) || '</ul>' || chr(10) AS toc FROM s JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name)"""
_TOP = " || ".join(f"'{x}' || chr(10)" for x in [*navigation.PREAMBLE, *navigation.PREAMBLE_TIKZ])
ORACLES = {
    "toc_linked": f"WITH {_SECTIONS}, {_TOC} SELECT r_regionkey, sha1(toc) AS toc_sha1, length(toc) AS chars FROM t",
    "page_buttons": """WITH o AS (SELECT o_custkey, row_number() OVER w AS s, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey AS c_custkey, 'section' || s || '.html' AS file, '<a class="previous-button toolbar-item button' || CASE WHEN s = 1 THEN ' disabled" href="' ELSE '" href="section' || (s - 1) || '.html' END || '">Previous</a><a class="next-button toolbar-item button' || CASE WHEN s = n THEN ' disabled" href="' ELSE '" href="section' || (s + 1) || '.html' END || '">Next</a>' AS html FROM o""",
    "framed_pages": f"""WITH {_SECTIONS}, p AS (SELECT n_regionkey::BIGINT AS r, 'section1-' || s || '.html' AS file, n_name AS t, s FROM s UNION ALL SELECT r_regionkey, 'chapter1.html', r_name, 0 FROM region),
{_TOC},
q AS (SELECT p.*, toc, lag(file) OVER w AS a, lead(file) OVER w AS b FROM p JOIN t ON r = r_regionkey WINDOW w AS (PARTITION BY r ORDER BY s))
SELECT r AS r_regionkey, file, '<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head><title>' || t || '</title></head>' || chr(10) || '<body>' || chr(10) || '<nav><a class="previous-button toolbar-item button' || coalesce('" href="' || a, ' disabled" href="') || '">Previous</a><a class="next-button toolbar-item button' || coalesce('" href="' || b, ' disabled" href="') || '">Next</a></nav>' || chr(10)
 || '<div class="page">' || chr(10) || '<aside id="sidebar-left" class="sidebar"><nav id="toc">' || toc || '</nav></aside>' || chr(10) || '<main class="main">' || chr(10) || '<div id="content" class="pretext-content">' || chr(10) || t || '</div></main></div></body></html>' AS text FROM q""",
    "index_pages": """WITH i AS (SELECT n_regionkey, n_name, lower(left(n_name, 1)) AS letter, chr(10) || '<div class="indexitem">' || n_name || chr(10) || '<div class="subindexitem">' || n_nationkey || '<span class="indexknowl"><a knowl="k' || n_nationkey || '.knowl">&sect;' || n_nationkey || '-p</a></span></div></div>' AS a,
  chr(10) || '<div class="indexitem">' || upper(left(n_name, 1)) || lower(substr(n_name, 2)) || '<span class="indexknowl"><a knowl="k' || n_nationkey || '.knowl">thm-' || n_nationkey || '</a></span></div>' AS b FROM nation),
l AS (SELECT n_regionkey, letter, string_agg(line, '' ORDER BY k) AS s FROM (SELECT *, a AS line, upper(n_name) || '!' AS k FROM i UNION ALL SELECT *, b, upper(n_name) || '@' FROM i) GROUP BY 1, 2)
SELECT n_regionkey, string_agg(chr(10) || '<div id="indexletter-' || letter || '" class="indexletter">' || s || chr(10) || '</div>', '' ORDER BY letter) AS html FROM l GROUP BY 1""",
    "macro_preludes": f"""SELECT p_partkey, {_MACROS} || chr(10) || '\\renewcommand{{\\xx}}{{x}}' || chr(10) || '\\def\\be{{b' || p_size || '}}' || chr(10) AS prelude, '<macros>' || chr(10) || '\\renewcommand{{\\xx}}{{x}}' || chr(10) || '\\def\\be{{b' || p_size || '}}' || chr(10) || '</macros>' || chr(10) AS ptx FROM part""",
    "drawing_documents": f"""SELECT p_partkey, sha1(p_partkey || ':1') AS node_id, {_TOP} || {_MACROS} || chr(10) || '\\newcommand{{\\be}}{{' || p_size || '}}' || chr(10) || '\\begin{{document}}' || chr(10) || '\\pagestyle{{empty}}' || chr(10) || '\\begin{{tikzpicture}}d' || p_size || '\\end{{tikzpicture}}' || chr(10) || '\\end{{document}}' || chr(10) AS tex FROM part""",
    "arrays_html": """WITH k AS (SELECT *, s_suppkey % 2 = 0 AS e FROM supplier), c AS (SELECT *, CASE WHEN e THEN 'vlv' ELSE 'c' END AS a, CASE WHEN e THEN 'l' ELSE 'c' END AS b, CASE WHEN e THEN 'r' ELSE 'c' END AS d FROM k)
SELECT s_suppkey, '<tr><td class="' || a || '">' || s_name || '</td><td class="' || b || '">' || s_suppkey || '</td><td class="' || d || '">c</td></tr>' || chr(10) || '<tr><td class=''hlinethick'' colspan=''3''><hr/></td></tr>' || chr(10)
 || '<tr><td class="' || a || '">d</td><td class="' || b || '">e</td><td class="' || d || '">f</td><td class="unknown">g</td></tr>' || chr(10) || '<tr><td class="' || a || '">h</td><td class="' || b || ' t2">i</td></tr>' || chr(10) || '<tr><td class=''hline'' colspan=''3''><hr/></td></tr>' || chr(10) AS markup FROM c""",
    "arrays_ptx": """SELECT s_suppkey, '<row><cell>' || s_name || '</cell><cell>' || s_suppkey || '</cell><cell>c</cell></row>' || chr(10) || '<row bottom="medium"><cell></cell><cell></cell><cell></cell></row>' || chr(10) || '<row><cell>d</cell><cell>e</cell><cell>f</cell><cell>g</cell></row>' || chr(10)
 || '<row><cell>h</cell><cell>i</cell></row>' || chr(10) || '<row bottom="minor"><cell></cell><cell></cell><cell></cell></row>' || chr(10) AS markup FROM supplier""",
    "sessions": """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '<pre>' || p_name || '</pre>' ELSE chr(10) || '<sage><input>f(' || p_size || ')' || chr(10) || '    g\\\\' || chr(10) || 'h' || chr(10) || '</input>' || chr(10) || chr(10) || '<output>' || p_name || ' &lt;1' || chr(10) || 'more' || chr(10) || '</output></sage>' || chr(10)
 || chr(10) || '<sage><input>k' || chr(10) || '</input></sage>' || chr(10) END AS markup FROM part""",
    "comments_guarded": """SELECT p_partkey, 'ab ' || p_size || ' \\verb|%| \\% c \\begin{verbatim}%k' || chr(10) || '\\end{verbatim}' AS text FROM part""",
    "nested_math": "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS row, 3 AS depth, true AS same FROM lineitem",
    "page_statements": """SELECT p_partkey, 'a' || chr(10) || chr(10) || '<theorem xml:id="t' || p_partkey || '">' || chr(10) || '<title>' || p_name || '</title><statement><p>b</p></statement><proof><p>c</p></proof>' || chr(10) || '</theorem>' || chr(10) || chr(10)
 || 'd' || chr(10) || chr(10) || '<example>' || chr(10) || '<statement><p>' || p_size || '</p></statement>' || chr(10) || '</example>' || chr(10) || chr(10) AS page FROM part""",
    "page_lists": """SELECT p_partkey, '<p>x' || chr(10) || '<ol><li><p>' || p_size || '</p><ul><li><title>(a)</title>' || chr(10) || '<p>' || p_name || '</p></li></ul></li></ol>' || chr(10) || '</p>' || chr(10) AS page FROM part""",
    "page_math": """SELECT p_partkey, '<p>so' || chr(10) || '<me>' || p_size || '\\text{ if \\(y\\)}</me>' || chr(10) || chr(10) || '<md><mrow>b\\ c</mrow></md>' || chr(10) || 'and on</p> <p>Then</p>' AS page FROM part""",
    "page_hints": """SELECT p_partkey, '<exercise><p>' || p_size || '</p>' || chr(10) || '<hint>' || chr(10) || '<p><ol><li>a</li></ol></p>' || chr(10) || '</hint>' || chr(10) || chr(10) || '<answer>' || chr(10) || '<p><m>' || p_partkey || '</m></p>' || chr(10) || '</answer>' || chr(10) || '</exercise>' || chr(10) || '<p>z</p>' AS page FROM part""",
    "page_tags": """SELECT p_partkey, '<c>' || p_name || '</c> <em>' || p_size || '</em> &amp; # <url href="http://x/?a&amp;b#' || p_partkey || '">t</url>' || chr(10) || 'width="92.5%" \\alpha <fillin/>' AS page FROM part""",
    "page_layout": """SELECT p_partkey, '<section xml:id="s' || p_partkey || '">' || chr(10) || '<title>' || p_name || '</title>' || chr(10) || '<p>' || chr(10) || 'x <m>y</m>' || chr(10) || '</p>' || chr(10) || chr(10) || '<p>' || chr(10) || 'z' || chr(10) || '</p>' || chr(10) || '<me>' || chr(10) || '  ' || p_size || chr(10) || '</me>' || chr(10) || '</section>' || chr(10) AS page FROM part""",
    "page_finished": """SELECT p_partkey, '<p>' || chr(10) || 'See <em>' || p_name || '</em>' || chr(10) || '</p>' || chr(10) || chr(10) || '<theorem>' || chr(10) || '<statement>' || chr(10) || '<p>' || chr(10) || 'b' || chr(10) || '</p>' || chr(10) || '</statement>' || chr(10) || '</theorem>' || chr(10) || chr(10)
 || '<investigation>' || chr(10) || '<p>' || chr(10) || 'w' || chr(10) || '</p>' || chr(10) || '</investigation>' AS page FROM part""",
    "tags_html": """SELECT p_partkey, chr(10) || '<section class="section" id="s:' || p_partkey || '"><h2 class="heading hide-type"><span class="type">Section</span> <span class="codenumber">1</span><span class="title">Part ' || p_partkey || '</span></h2>'
 || chr(10) || '<article class="theorem-like" id="t:' || p_partkey || '"><h5 class="heading"><span class="type">Theorem</span><span class="codenumber">1.1</span>(<span class="parentitle">of ' || p_brand || '</span>)</h5>Size \\(x<' || p_size || '\\).' || chr(10) || '</article>' || chr(10)
 || chr(10) || '<article class="proof" id="proof"><h5 class="heading">Proof</h5>Clear.' || chr(10) || '</article>' || chr(10)
 || '<ol><li label="(1)" id="item">one</li>' || chr(10) || '<li class="custom-list-style-type" label="(b)" id="item"> two</li>' || chr(10) || '</ol>\\begin{equation}q=' || p_size || '\\quad\\quad\\tag{1.1}' || chr(10) || '\\end{equation}' || chr(10) || '</section>' || chr(10) AS text FROM part""",
    "tags_ptx": """SELECT p_partkey, chr(10) || '<section xml:id="s:' || p_partkey || '">' || chr(10) || '<title>Part ' || p_partkey || '</title>' || chr(10) || '<theorem xml:id="t:' || p_partkey || '"><title>of ' || p_brand || '</title>' || chr(10) || 'Size <m>x<' || p_size || '</m>.' || chr(10) || '</theorem>' || chr(10)
 || chr(10) || '<proof>' || chr(10) || 'Clear.' || chr(10) || '</proof>' || chr(10) || '<ol><li>one</li>' || chr(10) || '<li class="custom-list-style-type" label="(b)" > two</li>' || chr(10) || '</ol>' || chr(10) || '<men xml:id="e:' || p_partkey || '" >' || chr(10) || 'q=' || p_size || chr(10) || '</men>' || chr(10) || '</section>' AS text FROM part""",
    "links_html": """SELECT l_orderkey, 'See <a class="internal" href="section' || p_size || '.html">Section&nbsp;' || p_size || '</a> and <a knowl="t' || p_partkey || '.knowl">' || p_size || '.1</a>, <a knowl="t' || p_partkey || '.knowl">Theorem&nbsp;' || p_size || '.1</a> by <a knowl="e' || p_partkey || '.knowl">(' || p_size || '.2)</a>; <a knowl="t' || p_partkey || '.knowl">Theorem&nbsp;' || p_size || '.1</a> or \\missingreflink{none}.' AS text
 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1""",
    "links_ptx": """SELECT l_orderkey, 'See <xref ref="s_' || p_partkey || '">Section</xref> and <xref ref="t_' || p_partkey || '"></xref>, <xref ref="t_' || p_partkey || '">Theorem</xref> by <xref ref="e_' || p_partkey || '" />; <xref ref="t_' || p_partkey || '">Theorem</xref> or <xref ref="none">Lemma</xref>.' AS text
 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1""",
    "cites_html": """SELECT l_orderkey, 'By&nbsp;<a knowl="s' || l_suppkey || '.knowl">[S' || l_suppkey || ', p. ' || l_partkey || ']</a>. Also&nbsp;[<a knowl="s' || l_suppkey || '.knowl">S' || l_suppkey || '</a>, <a knowl="none.knowl">none</a>] and&nbsp;<a knowl="s' || l_suppkey || '.knowl">[ibid., p. 2]</a>' AS text FROM lineitem WHERE l_linenumber = 1""",
    "paper_links": """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '<div><a href="http://arxiv.org/abs/' || lpad(s_suppkey::VARCHAR, 4, '0') || '.1234">paper</a></div>' WHEN 1 THEN '<div><a href="http://ams.org/mathscinet/' || lpad(s_suppkey::VARCHAR, 7, '0') || '">AMS Math Review</a></div>' ELSE '' END AS link FROM supplier""",
    "term_phrases": """SELECT p_partkey, 'normal groups' AS phrase, 'normal group' AS term FROM part UNION ALL SELECT p_partkey, 'Cayley graph', 'Cayley graph' FROM part UNION ALL SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'normal group' ELSE 'symmetries' END, CASE WHEN p_size % 2 = 0 THEN 'normal group' ELSE 'symmetry' END FROM part""",
    "term_links_written": """SELECT p_partkey, 'A <span class="autoterm"><a knowl="n.knowl">normal&nbsp;group</a></span> of ' || p_size || ' is a <span class="autoterm"><a knowl="g.knowl">group</a></span>, a subgroup.' AS text FROM part""",
    "normal_terms": """SELECT p_partkey, 'normal group of class' || p_size AS a, p_brand || ' ring' AS b FROM part""",
    "marked_entries": """SELECT p_partkey, 'term' AS kind, 1 AS k, 'ring {\\it of} size ' || p_size AS entry, 1 AS context FROM part UNION ALL SELECT p_partkey, 'term', 2, 'unit', 1 FROM part UNION ALL SELECT p_partkey, 'index', 1, 'p!' || p_brand, 0 FROM part""",
    "front_matter": """SELECT s_suppkey, 'On \\(x\\) of ' || s_name AS title, 'Short' AS title_short, 'A. ' || s_suppkey || ', B. Two, and C. Three' AS authors, 'Grant ' || s_suppkey AS thanks, 'a@' || s_suppkey AS email, 'We {do}.' AS abstract FROM supplier""",
    "canonical_form": """SELECT p_partkey, '\\begin{document}\\begin{theorem} ' || p_brand || ' $x$ \\end{theorem}\\begin{proof}p\\end{proof}\\verb|\\noindent|\\section{B}\\label{a}``q'''' m' AS text FROM part""",
    "included_text": """SELECT 'r' || n_regionkey || '.tex' AS root, string_agg('[' || n_name || ']', '' ORDER BY n_nationkey) || '.' AS text FROM nation GROUP BY n_regionkey""",
    "packages": """SELECT s_suppkey, 3 AS ordinal, 'own' || s_suppkey AS package, 'own' || s_suppkey || '.sty' AS file FROM supplier UNION ALL SELECT s_suppkey, 4, 'other' || s_suppkey, 'other' || s_suppkey || '.cls' FROM supplier WHERE s_suppkey % 2 = 0""",
    "table_lines": """SELECT s_suppkey, 1 AS row, c AS col, [s_name, s_suppkey::VARCHAR, 'c'][c] AS cell, false AS rule, false AS lined FROM supplier, (SELECT unnest([1, 2, 3]) AS c) UNION ALL SELECT s_suppkey, 2, c, ['d', 'e', 'f'][c], true, c > 1 FROM supplier, (SELECT unnest([1, 2, 3]) AS c)""",
    "text_cuts": """SELECT p_partkey, '\\size{' || p_size || '} a^{2}_' || p_size || ' ' AS before, '<b> {R}ough \\term{x{y}} rest' AS rest, '\\size{' || p_size || '} a^{2}_' || p_size || ' <b>' AS up_to, false AS siz, true AS size,
 '\\size{' || p_size || '} a_' || left(p_size::VARCHAR, 1) || '^{2}' || substr(p_size::VARCHAR, 2) || ' <b> {R}ough \\term{x{y}} rest' AS turned, 'Rough \\"a' AS bare, '\\size{' || p_size || '} a^{2}_' || p_size || ' <b> {R}ough <t>x{y}</t> rest' AS wrapped, p_size::VARCHAR AS argument, 'ac!' AS deleted FROM part""",
    "svg_sizes": """SELECT p_partkey, '<svg width="' || (p_size * 20)::DECIMAL(9, 1) || 'pt" height="10.0pt" x="' || p_size || '">' AS svg FROM part""",
    "early_macros": """SELECT p_partkey, 'be' AS name, true AS accepted, true AS expandable, true AS structural FROM part UNION ALL SELECT p_partkey, 'xx', true, true, false FROM part UNION ALL SELECT p_partkey, 'frac', false, false, false FROM part
 UNION ALL SELECT p_partkey, 'emph', true, false, false FROM part UNION ALL SELECT p_partkey, 're', true, false, false FROM part""",
    "main_files": """WITH o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS s FROM orders)
SELECT o_custkey AS c_custkey, '<?xml version="1.0" encoding="UTF-8" ?>' || chr(10) || '<pretext xmlns:xi="http://www.w3.org/2001/XInclude">' || chr(10) || '<book>' || chr(10) || string_agg('<xi:include href="./section' || s || '.ptx"/>', chr(10) ORDER BY s) || chr(10) || '</book>' || chr(10) || '</pretext>' || chr(10) AS text FROM o GROUP BY 1""",
    "snippets": """WITH i AS (SELECT l_orderkey, l_linenumber AS l, l_quantity::INT AS q FROM lineitem)
SELECT l_orderkey, sha1(l_orderkey || ':1') || '.knowl' AS file, '\\label{t:' || l_orderkey || '}' || chr(10) || string_agg('⟦' || 2 * l || '⟧' || chr(10), '' ORDER BY l) AS text FROM i GROUP BY 1
UNION ALL SELECT l_orderkey, sha1(l_orderkey || ':' || 2 * l) || '.knowl', 'Item ' || l || '.⟦' || (2 * l + 1) || '⟧' FROM i UNION ALL SELECT l_orderkey, sha1(l_orderkey || ':' || (2 * l + 1)) || '.knowl', '\\label{e:' || l_orderkey || ':' || l || '}q=' || q FROM i""",
    "render_manifest": "SELECT p_partkey, '\\begin{tikzpicture}\\draw (0,0) -- (' || p_size || ',1);\\end{tikzpicture}' AS tex FROM part",
    "display_math": """SELECT p_partkey, marker, star, n FROM part, (VALUES ('$', false, 2), ('equation', true, 2), ('align', false, 1), ('mathrow', false, 2)) AS v(marker, star, n)""",
    "paper_authors": """SELECT s_suppkey AS page_id, 1 AS person_id FROM supplier WHERE s_suppkey % 7 = 3 UNION ALL SELECT s_suppkey, 2 FROM supplier""",
}
_ITEMS = f"(SELECT * REPLACE (row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(synthetic.ITEM_ORDER)}) AS l_linenumber) FROM lineitem)"
#: The documents of ``tags_html`` with their proof, the fourth node after the inline math, as a link.
_PROOF = """chr(10) || '<article class="proof" id="proof"><h5 class="heading">Proof</h5>Clear.' || chr(10) || '</article>' || chr(10)"""
_LINK = """chr(10) || replace('<article class=~hiddenproof~><a knowl=~' || sha1(p_partkey || ':4') || '.knowl~><h5 class=~heading~><span class=~type~>Proof</span></h5></a></article>', '~', chr(39)) || chr(10)"""
ORACLES["hidden_proofs"] = f"SELECT p_partkey, replace(text, {_PROOF}, {_LINK}) AS text FROM ({ORACLES['tags_html']})"
ORACLES = {k: re.sub(r"\b(FROM|JOIN) lineitem\b", rf"\1 {_ITEMS} AS li", v) for k, v in ORACLES.items()}
