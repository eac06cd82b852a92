"""Queries on document structure; documents are built from relational rows, oracles use the rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markup import tex_to_html
from ..functions.scanner import choose_branches
from ..operators import content, floats, links, macros, numbering
from ..operators.peel import peel
from ..sources import documents, synthetic
from ..sources.synthetic import joined, table



#: Columns of nodes that numbers are made of, and with those that headings show.
COUNTED = ("pos", "marker", "star")
HEADINGS = (*COUNTED, "title")


def numbered_books(spark: SparkSession, sf_dir: str, starred: bool = False, only: tuple[str, ...] = (*COUNTED, "label")) -> DataFrame:
    return numbering.number_nodes(peel(synthetic.customer_books(spark, sf_dir, starred), only))


def numbered_sections(spark, sf_dir):
    found = numbering.labels(numbered_books(spark, sf_dir))
    return found.select(F.col("doc_id").alias("c_custkey"), "label", "codenumber")


def starred_numbering(spark, sf_dir):
    found = numbering.labels(numbered_books(spark, sf_dir, starred=True)).where("marker = 'theorem'")
    return found.select(F.col("doc_id").alias("c_custkey"), "label", "codenumber")


def section_split(spark, sf_dir):
    nodes = peel(synthetic.customer_books(spark, sf_dir), ("ordinal", "marker", "title", "body")).where("marker = 'section'")
    return nodes.select(F.col("doc_id").alias("c_custkey"), F.col("ordinal").cast("long").alias("ordinal"), "title", F.size(F.regexp_extract_all("body", F.lit("\u27e6"), F.lit(0))).cast("long").alias("n_children"))


def env_extract(spark, sf_dir):
    nodes = peel(synthetic.nested_orders(spark, sf_dir), ("depth", "marker")).where("marker <> 'document'")
    return nodes.groupBy(F.col("doc_id").alias("l_orderkey"), "marker", "depth").agg(F.count("*").alias("n"))


def list_items(spark, sf_dir):
    nodes = peel(synthetic.part_catalogues(spark, sf_dir))
    codes = numbering.item_codes(nodes).join(nodes.select("doc_id", "pos", "body"), ["doc_id", "pos"])
    inner = codes.where("body rlike '^part [0-9]+'")
    return inner.select(F.regexp_extract("body", "part ([0-9]+)", 1).cast("long").alias("p_partkey"), "code")


def math_rows(spark, sf_dir):
    n = numbering.number_nodes(peel(synthetic.math_rows(spark, sf_dir), (*COUNTED, "ordinal"))).where("marker = 'mathrow'")
    return n.select(F.col("doc_id").alias("l_orderkey"), F.col("ordinal").cast("long").alias("row"), "star", "codenumber")


def labels_and_ids(spark, sf_dir):
    n = numbering.assign_ids(numbered_books(spark, sf_dir)).where("marker in ('section', 'theorem')")
    return n.select(F.col("doc_id").alias("c_custkey"), F.col("pos").cast("long").alias("pos"), "marker", "label", "out_id", "node_id")


def refs_resolved(spark, sf_dir):
    """Line items refer to their part's page within their order; odd parts have no label."""
    item = synthetic.line_items(spark, sf_dir)
    nodes = item.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("see \\ref{p:"), F.col("l_partkey"), F.lit("}.")).alias("body"))
    used = item.select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("p_partkey")).distinct()
    parts = used.join(table(spark, sf_dir, "part").where("p_partkey % 2 = 0"), "p_partkey").select("doc_id", F.concat(F.lit("p:"), "p_partkey").alias("label"), F.col("p_partkey").alias("pos"), F.lit("section").alias("marker"), F.col("p_size").cast("string").alias("codenumber"))
    shown = links.splice(nodes, links.resolve(links.references(nodes), parts))
    return shown.select(F.col("doc_id").alias("l_orderkey"), F.col("pos").cast("long").alias("l_linenumber"), F.col("body").alias("shown"))


def citing(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = synthetic.citing_orders(spark, sf_dir)
    return docs, links.bib_entries(docs)


def cites_multi(spark, sf_dir):
    docs, bib = citing(spark, sf_dir)
    shown = links.resolve_citations(links.citations(docs.select("doc_id", F.lit(0).alias("pos"), F.col("text").alias("body"))), bib)
    return shown.select(F.col("doc_id").alias("l_orderkey"), "shown")


def bib_entries(spark, sf_dir):
    _, bib = citing(spark, sf_dir)
    return bib.select(F.col("doc_id").alias("l_orderkey"), F.col("ordinal").cast("long").alias("ordinal"), "key", "label")


def macro_table(spark, sf_dir):
    m = macros.extract_macros(synthetic.macro_documents(spark, sf_dir))
    return m.select(F.col("doc_id").alias("p_partkey"), "name", F.col("numargs").cast("long").alias("numargs"), "definition", "expandable")


def macro_expand(spark, sf_dir):
    docs = synthetic.macro_documents(spark, sf_dir)
    out = macros.expand_macros(docs, macros.extract_macros(docs))
    return out.select(F.col("doc_id").alias("p_partkey"), F.trim("text").alias("text"))


def macro_usage(spark, sf_dir):
    docs = synthetic.macro_documents(spark, sf_dir)
    found = macros.missing_macros(docs, macros.extract_macros(docs))
    return found.groupBy("name").agg(F.count("*").alias("n_docs"), F.sum("uses").alias("uses"))


def theorem_aliases(spark, sf_dir):
    """Parts declare an environment: an alias of the catalogue, or one that it lacks."""
    names = F.array(*[F.lit(x) for x in ("thm", "Lem", "defn", "strange")])
    alias = F.element_at(names, (F.col("p_size") % 4 + 1).cast("int"))
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("\\newtheorem{"), alias, F.lit("}{Shown}")).alias("text"))
    return macros.declared_theorems(docs).select(F.col("doc_id").alias("p_partkey"), "alias", "canonical")


def tables_html(spark, sf_dir):
    row = F.concat("n_name", F.lit(" & "), F.col("n_nationkey"), F.lit(" \\\\ \\hline\n"))
    t = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("doc_id")).agg(joined(F.collect_list(F.struct("n_nationkey", row.alias("s")))).alias("body"))
    return content.tables_html(t.withColumn("spec", F.lit("|l|r|"))).select(F.col("doc_id").alias("n_regionkey"), "html")


def numbered_atlas(spark, sf_dir, only: tuple[str, ...] = ()) -> DataFrame:
    return numbering.number_nodes(peel(synthetic.atlas(spark, sf_dir), only))


def toc_two_levels(spark, sf_dir):
    return links.toc(numbered_atlas(spark, sf_dir, HEADINGS)).select(F.col("doc_id").alias("r_regionkey"), "toc")


def prev_next(spark, sf_dir):
    pages = links.page_names(numbered_books(spark, sf_dir, only=COUNTED))
    return links.prev_next(pages, "pos").select(F.col("doc_id").alias("c_custkey"), "file", "prev", "next")


def dependency_edges(spark, sf_dir):
    """Each line item depends on the first of its order."""
    item = synthetic.line_items(spark, sf_dir)
    s = F.format_string("\\begin{theorem}\\label{%d}By \\ref{1} and \\ref{none}.\\end{theorem}\n", "l_linenumber")
    docs = item.groupBy(F.col("l_orderkey").alias("doc_id")).agg(joined(F.collect_list(F.struct("l_linenumber", s.alias("s")))).alias("text"))
    return links.dependency_edges(peel(docs)).select(F.col("doc_id").alias("l_orderkey"), "source", "target")


def containing_section(spark, sf_dir):
    """Statements with the title of the section around them and the nearest number: what a statement asks for is read once with it."""
    n = numbered_atlas(spark, sf_dir, (*HEADINGS, "label", "section", "near"))
    inside = n.where("marker = 'theorem' and section is not null and near is not null").select("doc_id", "label", F.col("section").alias("section_pos"), F.col("near").alias("at"))
    heads = n.where("marker = 'section'").select("doc_id", F.col("pos").alias("section_pos"), "title")
    numbers = n.where("codenumber is not null").select("doc_id", F.col("pos").alias("at"), F.col("codenumber").alias("near"))
    found = inside.join(heads, ["doc_id", "section_pos"]).join(numbers, ["doc_id", "at"])
    return found.select(F.regexp_extract("label", "([0-9]+)", 1).cast("long").alias("c_custkey"), "title", "near")


def ordinal_of_code(spark, sf_dir):
    from ..functions.text import code_ordinal

    n = numbered_books(spark, sf_dir).where("marker = 'theorem'")
    return n.select(F.col("doc_id").alias("c_custkey"), "label", code_ordinal(F.col("codenumber")).alias("place"))


def assemble_html(spark, sf_dir):
    n = numbering.assign_ids(numbered_atlas(spark, sf_dir)).where("true")
    tags = spark.createDataFrame([("section", "section"), ("theorem", "article")], "class string, tag string")
    wrapped = content.wrap(n.withColumn("body", F.regexp_replace("body", r"\\label\{[^}]*\}|\n", "")), tags)
    named = wrapped.withColumn("open_tag", F.when(F.col("depth") == 0, "").when(F.col("class") == "section", F.concat("open_tag", F.lit("<h1>"), "title", F.lit("</h1>"))).otherwise(F.col("open_tag")))
    named = named.withColumn("close_tag", F.when(F.col("depth") == 0, "").otherwise(F.col("close_tag")))
    return content.assemble(named, "open_tag", "close_tag").select(F.col("doc_id").alias("r_regionkey"), F.sha1("text").alias("html_sha1"), F.length("text").cast("long").alias("chars"))


def include_graph(spark, sf_dir):
    """Region files include their nations' files; nation 0 includes its own region, a cycle."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    line = F.concat(F.lit("\\input{n"), F.col("n_nationkey"), F.lit("}\n"))
    roots = nation.groupBy("n_regionkey").agg(joined(F.collect_list(F.struct("n_nationkey", line.alias("s")))).alias("text")).select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("file"), "text")
    leaves = nation.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("file"), F.when(F.col("n_nationkey") == 0, F.concat(F.lit("\\input{r"), F.col("n_regionkey"), F.lit("}"))).otherwise("text").alias("text"))
    found = documents.expand_includes(roots.unionByName(leaves), region.select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("file")))
    return found.select("root", "file", F.col("depth").cast("long").alias("depth"), "cyclic")


def tree_round_trip(spark, sf_dir):
    """Decomposing and assembling a book gives the book."""
    books = synthetic.customer_books(spark, sf_dir)
    back = content.assemble(peel(books)).select("doc_id", F.col("text").alias("back"))
    return books.join(back, "doc_id").select(F.col("doc_id").alias("c_custkey"), (F.col("text") == F.col("back")).alias("same"))


def ptx_wrap_lists(spark, sf_dir):
    """Lists inside paragraphs: every list of a catalogue wrapped as an element with its items."""
    nodes = peel(synthetic.part_catalogues(spark, sf_dir))
    tag = F.when(F.col("marker") == "item", "li").when(F.col("marker") == "enumerate", "ol")
    marked = nodes.withColumn("open_tag", F.coalesce(F.concat(F.lit("<"), tag, F.lit(">")), F.lit(""))).withColumn("close_tag", F.coalesce(F.concat(F.lit("</"), tag, F.lit(">")), F.lit("")))
    marked = marked.withColumn("body", F.regexp_replace("body", r"\n", ""))
    return content.assemble(marked, "open_tag", "close_tag").select("doc_id", F.sha1("text").alias("ptx_sha1"))


def figures(spark, sf_dir):
    """Per part: a figure with an image and a caption that holds braces."""
    text = F.format_string("\\begin{figure}\\includegraphics[width=%d.5\\textwidth]{p%d.pdf}\\caption{Size {\\bf %d} here}\\label{f:%d}\\end{figure}", "p_size", "p_partkey", "p_size", "p_partkey")
    n = numbering.number_nodes(peel(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text")))).where("marker = 'figure'")
    found = floats.floats(n)
    captions = found.where("kind = 'caption'").select("doc_id", F.col("content").alias("caption"))
    return n.join(floats.image_sizes(found).select("doc_id", "file", "percent"), "doc_id").join(captions, "doc_id").select(F.col("doc_id").alias("p_partkey"), "label", "codenumber", "file", "percent", "caption")


def markup_html(spark, sf_dir):
    text = F.concat(F.lit("\\textbf{\\emph{"), "p_name", F.lit("}} {\\it "), "p_brand", F.lit("}~caf\\'{e} -- \\centering \\textcolor{red}{"), "p_size", F.lit("}\\\\x"))
    return table(spark, sf_dir, "part").select("p_partkey", tex_to_html(text).alias("html"))


def conditionals(spark, sf_dir):
    text = F.concat(F.lit("a\\ifthenelse{"), (F.col("p_size") % 2 == 0).cast("string"), F.lit("}{even {"), "p_size", F.lit("}}{odd}b"))
    return table(spark, sf_dir, "part").select("p_partkey", choose_branches(text).alias("text"))


def document_parts(spark, sf_dir):
    text = F.concat(F.lit("\\usepackage{p"), F.col("s_suppkey"), F.lit("}\\begin{document}\\title{"), "s_name", F.lit("}\\maketitle Body of "), "s_name", F.lit(".\\begin{thebibliography}{1}x\\end{thebibliography}\\end{document} rest"))
    return content.document_parts(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), text.alias("text"))).withColumnRenamed("doc_id", "s_suppkey")


QUERIES = {
    f.__name__: f
    for f in (
        numbered_sections, starred_numbering, section_split, env_extract, list_items, math_rows, labels_and_ids, refs_resolved, cites_multi, bib_entries, macro_table, macro_expand,
        macro_usage, theorem_aliases, tables_html, toc_two_levels, prev_next, dependency_edges, containing_section, ordinal_of_code, assemble_html, include_graph, tree_round_trip, ptx_wrap_lists,
        figures, markup_html, conditionals, document_parts,
    )
}

_BOOK = """o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS s FROM orders),
i AS (SELECT o_custkey, o_orderkey, s, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber) AS t FROM o JOIN lineitem ON o_orderkey = l_orderkey)"""
_ATLAS = """c AS (SELECT c_custkey, c_mktsegment, n_nationkey, n_name, n_regionkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS t FROM customer JOIN nation ON c_nationkey = n_nationkey),
n AS (SELECT n_nationkey, n_name, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS s FROM nation)"""

ORACLES = {
    "numbered_sections": f"WITH {_BOOK} SELECT o_custkey AS c_custkey, 'o:' || o_orderkey AS label, s::VARCHAR AS codenumber FROM o UNION ALL SELECT o_custkey, 'l:' || o_orderkey || ':' || l_linenumber, s || '.' || t FROM i",
    "starred_numbering": f"WITH {_BOOK} SELECT o_custkey AS c_custkey, 'l:' || o_orderkey || ':' || l_linenumber AS label, s || '.' || (count(*) FILTER (l_returnflag <> 'R') OVER (PARTITION BY o_orderkey ORDER BY l_linenumber)) AS codenumber FROM i",
    "section_split": f"WITH {_BOOK} SELECT o.o_custkey AS c_custkey, o.s AS ordinal, 'Order ' || o.o_orderkey AS title, count(l_linenumber) AS n_children FROM o LEFT JOIN i ON o.o_orderkey = i.o_orderkey GROUP BY ALL",
    "env_extract": "WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, 'theorem' AS marker, 1 AS depth, 1 AS n FROM c UNION ALL SELECT l_orderkey, 'proof', 2, n FROM c UNION ALL SELECT l_orderkey, 'equation', 3, n FROM c",
    "list_items": "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_type) || '.' || row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS code FROM part",
    "math_rows": """SELECT l_orderkey, row_number() OVER w AS row, l_returnflag = 'R' AS star, '0.' || (count(*) FILTER (l_returnflag <> 'R') OVER w) AS codenumber FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)""",
    "labels_and_ids": f"""WITH {_BOOK}, x AS (SELECT o_custkey, o_orderkey, 0 AS t, 'section' AS marker, 'o:' || o_orderkey AS id FROM o UNION ALL SELECT o_custkey, o_orderkey, l_linenumber, 'theorem', 'l:' || o_orderkey || ':' || l_linenumber FROM i),
y AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, t) AS pos FROM x) SELECT o_custkey AS c_custkey, pos, marker, id AS label, id AS out_id, sha1(o_custkey || ':' || pos) AS node_id FROM y""",
    "refs_resolved": "SELECT l_orderkey, l_linenumber, 'see ' || CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE '\\missingreflink{p:' || l_partkey || '}' END || '.' AS shown FROM lineitem LEFT JOIN part ON l_partkey = p_partkey",
    "cites_multi": "SELECT l_orderkey, '[' || string_agg(CASE WHEN l_suppkey % 2 = 0 THEN 'S' ELSE 's' END || l_suppkey, ',' ORDER BY l_linenumber) || ', p. 1]' AS shown FROM lineitem GROUP BY l_orderkey",
    "bib_entries": "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS ordinal, 's' || l_suppkey AS key, 'S' || l_suppkey AS label FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_suppkey % 2 = 0)",
    "macro_table": "SELECT p_partkey, 'brand' AS name, 0 AS numargs, p_brand AS definition, true AS expandable FROM part UNION ALL SELECT p_partkey, 'size', 1, 'size #1 of ' || p_size, true FROM part UNION ALL SELECT p_partkey, 'both', 2, '#2 before #1', true FROM part",
    "macro_expand": "SELECT p_partkey, p_brand || ': size ' || p_partkey || ' of ' || p_size || '; ' || p_brand || ' before a. \\unknown' AS text FROM part",
    "macro_usage": "SELECT 'unknown' AS name, count(*) AS n_docs, count(*) AS uses FROM part",
    "theorem_aliases": "SELECT p_partkey, ['thm', 'Lem', 'defn', 'strange'][p_size % 4 + 1] AS alias, ['theorem', 'lemma', 'definition', 'generictheorem'][p_size % 4 + 1] AS canonical FROM part",
    "tables_html": """WITH r AS (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k,
  '<td class="left">' || n_name || '</td><td class="right">' || n_nationkey || '</td></tr>' AS tds FROM nation)
SELECT n_regionkey::BIGINT AS n_regionkey, '<table>' || string_agg(CASE WHEN k = 1 THEN '<tr>' ELSE '<tr class="hline">' END || tds, '' ORDER BY k) || '</table>' AS html FROM r GROUP BY n_regionkey""",
    "toc_two_levels": f"WITH {_ATLAS} SELECT r_regionkey::BIGINT AS r_regionkey, '1 ' || r_name || chr(10) || string_agg('  1.' || s || ' ' || n_name, chr(10) ORDER BY s) AS toc FROM n JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name",
    "prev_next": f"WITH {_BOOK}, f AS (SELECT o_custkey AS c_custkey, s, 'section' || s || '.html' AS file FROM o) SELECT c_custkey, file, lag(file) OVER w AS prev, lead(file) OVER w AS next FROM f WINDOW w AS (PARTITION BY c_custkey ORDER BY s)",
    "dependency_edges": "SELECT l_orderkey, l_linenumber::VARCHAR AS source, '1' AS target FROM lineitem",
    "containing_section": f"WITH {_ATLAS} SELECT c_custkey, c.n_name AS title, '1.' || s || '.' || t AS near FROM c JOIN n USING (n_nationkey)",
    "ordinal_of_code": f"WITH {_BOOK} SELECT o_custkey AS c_custkey, 'l:' || o_orderkey || ':' || l_linenumber AS label, s * 100000000.0::DOUBLE + t * 1000000.0::DOUBLE AS place FROM i",
    "assemble_html": f"""WITH {_ATLAS}, p AS (SELECT n_nationkey, string_agg('<article id="c:' || c_custkey || '">' || c_mktsegment || '</article>', '' ORDER BY c_custkey) AS body FROM c GROUP BY 1),
q AS (SELECT n_regionkey, string_agg('<section id="n:' || n_nationkey || '"><h1>' || n_name || '</h1>' || coalesce(body, '') || '</section>', '' ORDER BY n_nationkey) AS body FROM n LEFT JOIN p USING (n_nationkey) GROUP BY 1),
h AS (SELECT r_regionkey::BIGINT AS r_regionkey, '<section id="r:' || r_regionkey || '"><h1>' || r_name || '</h1>' || body || '</section>' AS html FROM region JOIN q ON n_regionkey = r_regionkey)
SELECT r_regionkey, sha1(html) AS html_sha1, length(html) AS chars FROM h""",
    "include_graph": """SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS file, 0 AS depth, false AS cyclic FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 1, false FROM nation
UNION ALL SELECT 'r' || n_regionkey, 'r' || n_regionkey, 2, true FROM nation WHERE n_nationkey = 0""",
    "figures": """SELECT p_partkey, 'f:' || p_partkey AS label, '0.1' AS codenumber, 'p' || p_partkey || '.pdf' AS file, p_size * 100 + 50 AS percent, 'Size {\\bf ' || p_size || '} here' AS caption FROM part""",
    "markup_html": """SELECT p_partkey, '<b><em>' || p_name || '</em></b> <i>' || p_brand || '</i>&nbsp;caf&eacute; &#x2013; ' || p_size || '<br/>x' AS html FROM part""",
    "conditionals": """SELECT p_partkey, 'a' || CASE WHEN p_size % 2 = 0 THEN 'even {' || p_size || '}' ELSE 'odd' END || 'b' AS text FROM part""",
    "document_parts": """SELECT s_suppkey, '\\usepackage{p' || s_suppkey || '}' AS preamble, '\\title{' || s_name || '}' AS header, ' Body of ' || s_name || '.' AS main, '\\begin{thebibliography}{1}x\\end{thebibliography}' AS bibliography FROM supplier""",
    "tree_round_trip": "SELECT DISTINCT o_custkey AS c_custkey, true AS same FROM orders",
    "ptx_wrap_lists": """WITH t AS (SELECT p_brand, p_type, '<li>' || p_type || '<ol>' || string_agg('<li>part ' || p_partkey || '</li>', '' ORDER BY p_partkey) || '</ol></li>' AS s FROM part GROUP BY 1, 2)
SELECT regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT AS doc_id, sha1('<ol>' || string_agg(s, '' ORDER BY p_type) || '</ol>') AS ptx_sha1 FROM t GROUP BY p_brand""",
}

_ITEMS = f"(SELECT * REPLACE (row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(synthetic.ITEM_ORDER)}) AS l_linenumber) FROM lineitem)"
ORACLES = {k: re.sub(r"\b(FROM|JOIN) lineitem\b", rf"\1 {_ITEMS} AS li", v) for k, v in ORACLES.items()}
