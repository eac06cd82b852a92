"""Pages of a document: its tree cut at chapters and sections, and the pages that no part of the tree has.

Each node belongs to the innermost page around it, which the parser's stack knows; where a page is cut out,
the page above shows a link. Pages are assembled one by one, so no value holds a whole document, in one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import PAGE_MARKERS
from ..functions.markup import tex_to_html
from ..functions.text import remove_silly_braces, safe_name
from . import content
from .intervals import contained, innermost
from .navigation import PREAMBLE_TIKZ

TOP_PAGE = {"html": "index.html", "ptx": "main.ptx"}


def page_file(target: str = "html") -> Column:
    """The file of a node that begins a page: by marker and number; in the structured target by its label, where it has one."""
    made = F.concat("marker", F.replace(F.coalesce("codenumber", F.lit("")), F.lit("."), F.lit("-")))
    if target == "ptx":
        made = F.when(F.coalesce("label", F.lit("")) != "", safe_name(F.col("label"), as_id=True)).otherwise(made)
    return F.when(F.col("marker") == "document", F.lit(TOP_PAGE[target])).otherwise(F.concat(made, F.lit(f".{target}")))


def page_roots(numbered: DataFrame, target: str = "html") -> DataFrame:
    """(doc_id, start, last, marker, title, file) of the nodes that begin a page, the document itself among them."""
    rows = numbered.where(F.col("marker").isin("document", *PAGE_MARKERS))
    return rows.select("doc_id", F.col("pos").alias("start"), "last", "marker", "title", page_file(target).alias("file"))


def page_link(file: Column, title: Column, target: str = "html") -> Column:
    """What stands on a page in place of a section that has a page of its own."""
    if target == "html":
        return F.concat(F.lit('<h2 class="link"><a href="'), file, F.lit('">'), F.when(title == "XXXX", "").otherwise(tex_to_html(title)), F.lit("</a></h2>\n"))
    return F.concat(F.lit('<xi:include  href="'), file, F.lit('" />\n'))


def pages(nodes: DataFrame, target: str = "html") -> DataFrame:
    """(doc_id, start, file, marker, title, text): the pages of documents whose nodes have ``open_tag`` and ``close_tag``.

    ``nodes`` are numbered, with bodies in the target's markup. Sections that are cut out leave a link; what no
    chapter or section holds is on the document's own page.
    """
    begins = F.col("pos") == F.col("page")
    rows = nodes.withColumn("__file", page_file(target)).withColumn("__link", page_link(F.col("__file"), F.col("title"), target))
    cell = lambda page, before, body, after: F.struct(F.col(page).alias("page"), before.alias("opening"), body.alias("body"), after.alias("closing"))
    own = cell("page", F.col("open_tag"), F.col("body"), F.col("close_tag"))
    # A page's root stands on the page above it too: a link with nothing inside.
    both = F.when(begins & F.col("above").isNotNull(), F.array(own, cell("above", F.col("__link"), F.lit(""), F.lit("")))).otherwise(F.array(own))
    rows = rows.select("doc_id", "pos", F.when(begins, F.struct(F.col("__file").alias("file"), "marker", "title")).alias("root"), F.explode(both).alias("c")).select("doc_id", "pos", "root", "c.*")
    root = F.when(F.col("pos") == F.col("page"), F.col("root")).alias("root")
    whole = content.assemble(rows, by=("doc_id", "page"), carried=(root,))
    return whole.select("doc_id", F.col("page").alias("start"), "root.file", "root.marker", "root.title", "text")


def subtree_texts(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, start, text): the subtrees that begin at ``roots`` (doc_id, start, last), each whole; subtrees may lie in one another."""
    own = nodes.select("doc_id", "pos", F.col("open_tag").alias("opening"), "body", F.col("close_tag").alias("closing"))
    return content.assemble(contained(own, roots.select("doc_id", "start", "last")), by=("doc_id", "start"))


def context_snippets(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc_id, file, text): what surrounds index entries and terms, each context once, with a link to its place on its section's page.

    ``nodes`` are numbered, with ids and tags, ``entries`` as of ``frontmatter.marked_entries``.
    """
    places = entries.select("doc_id", F.col("context").alias("pos")).distinct()
    roots = nodes.join(places, ["doc_id", "pos"]).where("marker <> 'document'").select("doc_id", F.col("pos").alias("start"), "last", "out_id", "node_id")
    sections = nodes.where("marker = 'section'").select("doc_id", F.col("pos").alias("start"), "last", F.col("codenumber").alias("number"))
    around = innermost(roots.select("doc_id", F.col("start").alias("pos")), sections, "section").withColumnsRenamed({"pos": "start"})
    number = sections.select("doc_id", F.col("start").alias("section"), F.replace("number", F.lit("."), F.lit("-")).alias("number"))
    known = roots.join(around.join(number, ["doc_id", "section"]), ["doc_id", "start"], "left")
    link = F.concat(F.lit('<span class="incontext"><a href="section'), F.coalesce("number", F.lit("")), F.lit('.html#'), "out_id", F.lit('">in context</a></span>'))
    whole = subtree_texts(nodes, roots).join(known, ["doc_id", "start"])
    return whole.select("doc_id", F.concat("node_id", F.lit(".knowl")).alias("file"), F.concat("text", link).alias("text"))


def bibliography_pages(entries: DataFrame, *targets: str) -> DataFrame:
    """(doc_id, file, text): the bibliography of each document for each target, html by default; entries (doc_id, ordinal, key, label, raw).

    Entries are read and gathered once, whatever the number of targets.
    """
    raw = F.regexp_replace("raw", r"\\*&\s*", "&amp; ")
    shown = {
        "html": F.concat(F.lit('<div class="bib"><span class="bibitem">['), "label", F.lit(']</span><span id="'), "key", F.lit('" class="bibentry">'), tex_to_html(F.col("raw")), F.lit("</span></div>\n")),
        "ptx": F.concat(F.lit('\n<biblio type="raw" xml:id="'), "key", F.lit('">'), raw, F.lit("</biblio>")),
    }
    around = {
        "html": ('<section class="section" id="section1*"><h2 class="heading hide-type"><span class="type">Section</span><span class="title">Bibliography</span></h2>', "</section>\n"),
        "ptx": ("\n<references>\n\n<title>Bibliography</title>\n", "\n</references>\n"),
    }
    targets = targets or ("html",)
    lines = entries.select("doc_id", "ordinal", *[shown[t].alias(t) for t in targets])
    each = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", *targets))).alias("all"))
    page = lambda t: F.struct(F.lit(f"bibliography.{t}").alias("file"), F.concat(F.lit(around[t][0]), F.array_join(F.transform("all", lambda x: x[t]), ""), F.lit(around[t][1])).alias("text"))
    return each.select("doc_id", F.explode(F.array(*[page(t) for t in targets])).alias("p")).select("doc_id", "p.file", "p.text")


def title_records(fronts: DataFrame) -> DataFrame:
    """(doc_id, file, text): the record that leads to a document, of (doc_id, folder, title, authors) with authors as one text."""
    text = F.concat(F.lit('\n\n<div class="title"><a href="'), "folder", F.lit('">'), "title", F.lit('</a></div>\n\n\n<div class="author">by '), "authors", F.lit("</div>\n\n"))
    return fronts.select("doc_id", F.lit("titleauthor.txt").alias("file"), text.alias("text"))


def top_pages(fronts: DataFrame, roots: DataFrame, preludes: DataFrame, has_index: Column | None = None) -> DataFrame:
    """(doc_id, file, text): the main file of the structured target, from its head to its closed back matter.

    ``fronts`` has (doc_id, title, authors array<string>, abstract), ``preludes`` the macros of each document;
    pages of the top level are included in order, and the bibliography as back matter where ``roots`` has one.
    """
    chapters = F.max(F.when(F.col("marker") == "chapter", 1).otherwise(0))
    heads = roots.where("marker <> 'document'").groupBy("doc_id").agg(chapters.alias("chapters"), F.sort_array(F.collect_list(F.struct("start", "marker", "file"))).alias("all"))
    line = lambda x: F.concat(F.lit('\n<xi:include href="./'), x["file"], F.lit('" />\n'))
    top = F.filter("all", lambda x: (x["marker"] != "bibliography") & ((x["marker"] != "section") | (F.col("chapters") == 0)))
    last = F.filter("all", lambda x: x["marker"] == "bibliography")
    d = fronts.join(heads, "doc_id", "left").join(preludes, "doc_id", "left")
    kind = F.when(F.coalesce("chapters", F.lit(0)) == 1, "book").otherwise("article")
    author = F.array_join(F.transform("authors", lambda a: F.concat(F.lit("<author>\n<personname>"), a, F.lit("</personname>\n</author>\n"))), "")
    drawing = "".join(x + "\n" for x in PREAMBLE_TIKZ)
    text = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8" ?>\n<pretext xmlns:xi="http://www.w3.org/2001/XInclude">\n<docinfo>\n'), F.coalesce("prelude", F.lit("")),
        F.lit("\n<latex-image-preamble>\n" + drawing + "\n\\usepackage{pgfplots}\n\n</latex-image-preamble>\n\n</docinfo>\n\n\n<"), kind, F.lit(">\n    <title>"), remove_silly_braces(F.coalesce("title", F.lit(""))),
        F.lit("    </title>\n<frontmatter>\n<titlepage>\n"), F.coalesce(author, F.lit("")), F.lit("</titlepage>\n"),
        F.when(F.trim(F.coalesce("abstract", F.lit(""))) != "", F.concat(F.lit("\n<abstract>\n"), F.trim("abstract"), F.lit("\n</abstract>\n"))).otherwise(""),
        F.lit("</frontmatter>\n\n"), F.coalesce(F.array_join(F.transform(top, line), ""), F.lit("")), F.lit("\n<backmatter>\n"), F.coalesce(F.array_join(F.transform(last, line), ""), F.lit("")),
        F.when(F.lit(False) if has_index is None else has_index, "<index>\n<title>Index</title>\n<index-list />\n</index>\n").otherwise(""), F.lit("\n</backmatter>\n</"), kind, F.lit(">\n</pretext>\n"),
    )
    return d.select("doc_id", F.lit("main.ptx").alias("file"), text.alias("text"))
