r"""Ways through a document: contents with links, previous and next, the index page, the frame of a page; and its macros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.markup import tex_to_html
from . import links

# Short names of index links; macros that every page of math gets; preambles of drawings.
INDEX_NAMES = {"tabular": "table", "definition": "defn", "proposition": "prop", "theorem": "thm", "exercise": "exer", "example": "example", "footnote": "note", "historicalnote": "hist", "remark": "rmk", "text": "par"}
STANDARD_MACROS = [
    r"\def\C{\mathbb C}", r"\def\R{\mathbb R}", r"\def\Z{\mathbb Z}", r"\def\Q{\mathbb Q}", r"\def\F{\mathbb F}",
    r"\def\smash{}", r"\def\phantomplus{}", r"\def\nobreak{}", r"\def\omit{}", r"\def\hidewidth{}",
]
PREAMBLE = [r"\documentclass{article}", r"\usepackage{etex}", r"\usepackage{amsmath}", r"\usepackage{amssymb}", r"\usepackage{amsopn}", r"\usepackage{pstricks,pst-text,pst-node}"]
PREAMBLE_OTHER = [
    r"\DeclareGraphicsRule{.pdftex}{pdf}{.pdftex}{}", r"\usepackage{color}", r"\usepackage{epic}", r"\usepackage{eepic}", r"\usepackage{psfrag}", r"\usepackage{pgfplots}", r"\usepackage{pinlabel}",
    r"\usepackage{amscd}", r"\usepackage{multirow, booktabs, makecell}", r"\usepackage[all]{xy}", r"\usepackage{pb-diagram,pb-xy}",
]
PREAMBLE_TIKZ = [
    r"\usepackage{tikz}", r"\usepackage{tkz-graph}", r"\usepackage{tkz-euclide}", r"\usetikzlibrary{patterns}", r"\usetikzlibrary{positioning}", r"\usetikzlibrary{matrix,arrows}",
    r"\usetikzlibrary{calc}", r"\usetikzlibrary{shapes}", r"\usetikzlibrary{through,intersections,decorations,shadows,fadings}",
]


def in_order(order: Column, text: Column, sep: str = "") -> Column:
    """Texts of a group in an order, as one."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), sep)


def toc_html(numbered: DataFrame, target: str = "html") -> DataFrame:
    """(doc_id, toc): two levels of headings as linked lists; the second level lies on pages of its own where chapters are the top."""
    heads = numbered.where(F.col("marker").isin("chapter", "section", "subsection"))
    doc = W.partitionBy("doc_id")
    heads = heads.withColumn("top", F.when(F.max((F.col("marker") == "chapter").cast("int")).over(doc) == 1, "chapter").otherwise("section"))
    second = F.when(F.col("top") == "chapter", "section").otherwise("subsection")
    heads = heads.withColumn("first", F.col("marker") == F.col("top")).where(F.col("first") | (F.col("marker") == second))
    heads = heads.withColumn("group", F.sum(F.col("first").cast("int")).over(doc.orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)))
    stub = F.concat("marker", F.replace(F.coalesce("codenumber", F.lit("")), F.lit("."), F.lit("-")))
    title = F.when(F.col("title") == "XXXX", "The paper").otherwise(tex_to_html(F.col("title")))
    number = F.when(F.coalesce("codenumber", F.lit("")).rlike("^[^x*]+$"), F.concat(F.lit('<span class="codenumber">'), "codenumber", F.lit(".</span>"))).otherwise("")
    top_line = F.concat(F.lit('<h2 class="link"><a href="'), stub, F.lit(f'.{target}" data-scroll="'), stub, F.lit('">'), number, F.lit('<span class="title">'), title, F.lit("</span></a></h2>\n"))
    page = F.when(F.col("top") == "chapter", F.concat(stub, F.lit(f".{target}"))).otherwise(F.concat(F.lit("section"), F.substring_index("codenumber", ".", 1), F.lit(f".{target}#"), stub))
    line = F.concat(F.lit('<li><a href="'), page, F.lit('" data-scroll="'), stub, F.lit('">'), title, F.lit("</a></li>\n"))
    parts = heads.select("doc_id", "pos", "group", "first", F.when(F.col("first"), top_line).otherwise(line).alias("line"))
    groups = parts.groupBy("doc_id", "group").agg(in_order(F.col("pos"), F.when(F.col("first"), F.col("line")).otherwise("")).alias("head"), in_order(F.col("pos"), F.when(F.col("first"), "").otherwise(F.col("line"))).alias("rest"))
    whole = F.concat("head", F.when(F.col("rest") != "", F.concat(F.lit("<ul>\n"), "rest", F.lit("</ul>\n"))).otherwise(""))
    return groups.groupBy("doc_id").agg(in_order(F.col("group"), whole).alias("toc"))


def buttons(previous: Column, following: Column) -> Column:
    """The links to the pages before and after; without one the button is disabled."""
    one = lambda kind, name, at: F.concat(F.lit(f'<a class="{kind}-button toolbar-item button'), F.when(at.isNull(), " disabled").otherwise(""), F.lit('" href="'), F.coalesce(at, F.lit("")), F.lit(f'">{name}</a>'))
    return F.concat(one("previous", "Previous", previous), one("next", "Next", following))


def framed(pages: DataFrame, tocs: DataFrame, order: str = "pos") -> DataFrame:
    """(doc_id, file, text): pages in the frame of their document, with contents and buttons."""
    around = links.prev_next(pages, order).join(tocs, "doc_id", "left")
    text = F.concat(
        F.lit("<!DOCTYPE html>\n<html>\n<head><title>"), F.coalesce("title", F.lit("")), F.lit("</title></head>\n<body>\n<nav>"), buttons(F.col("prev"), F.col("next")),
        F.lit('</nav>\n<div class="page">\n<aside id="sidebar-left" class="sidebar"><nav id="toc">'), F.coalesce("toc", F.lit("")),
        F.lit('</nav></aside>\n<main class="main">\n<div id="content" class="pretext-content">\n'), "text", F.lit("</div></main></div></body></html>"),
    )
    return around.select("doc_id", "file", text.alias("text"))


def index_page(entries: DataFrame) -> DataFrame:
    r"""(doc_id, html): the index of each document.

    ``entries`` has doc_id, entry, marker, number and file of the place. Entries sort by their
    upper case; what stands before ``@`` sorts only; ``main!sub`` has two levels; equal
    entries share a line with a link each, and equal links are one.
    """
    part = F.split("entry", "!")
    shown = lambda c: F.regexp_replace(c, r"^[^!]*@", "")
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in INDEX_NAMES.items() for x in pair]), F.col("marker")), F.col("marker"))
    link_name = F.when(name == "par", F.concat(F.lit("&sect;"), "number", F.lit("-p"))).otherwise(F.concat(name, F.lit("-"), "number"))
    link = F.concat(F.lit('<span class="indexknowl"><a knowl="'), "file", F.lit('">'), link_name, F.lit("</a></span>"))
    e = entries.where(F.trim("entry") != "").select("doc_id", F.upper("entry").alias("sort"), F.lower(F.substring("entry", 1, 1)).alias("letter"), shown(part[0]).alias("main"), shown(F.get(part, 1)).alias("sub"), link.alias("link"))
    lines = e.groupBy("doc_id", "letter", "main", "sub").agg(F.min("sort").alias("sort"), F.array_join(F.array_sort(F.collect_set("link")), "").alias("links"))
    lines = lines.withColumn("line", F.when(F.col("sub").isNull(), F.col("links")).otherwise(F.concat(F.lit('\n<div class="subindexitem">'), tex_to_html(F.col("sub")), "links", F.lit("</div>"))))
    items = lines.groupBy("doc_id", "letter", "main").agg(F.min("sort").alias("sort"), in_order(F.struct(F.col("sub").isNotNull(), F.col("sort")), F.col("line")).alias("body"))
    items = items.withColumn("item", F.concat(F.lit('\n<div class="indexitem">'), tex_to_html(F.col("main")), "body", F.lit("</div>")))
    letters = items.groupBy("doc_id", "letter").agg(F.concat(F.lit('\n<div id="indexletter-'), "letter", F.lit('" class="indexletter">'), in_order(F.col("sort"), F.col("item")), F.lit("\n</div>")).alias("section"), F.min("sort").alias("sort"))
    return letters.groupBy("doc_id").agg(in_order(F.col("sort"), F.col("section")).alias("html"))


def macro_prelude(macros: DataFrame, target: str = "html") -> DataFrame:
    """(doc_id, prelude): the definitions that a page's math needs, standard ones first, the last of each name of an author's own."""
    command = F.when(F.col("command") == "providecommand", "renewcommand").otherwise(F.col("command"))
    head = F.when(command.isin("def", "let"), F.concat(F.lit("\\"), command, F.lit("\\"), "name")).otherwise(F.concat(F.lit("\\"), command, F.lit("{\\"), "name", F.lit("}")))
    line = F.concat(head, F.when(F.col("numargs") > 0, F.concat(F.lit("["), F.col("numargs").cast("string"), F.lit("]"))).otherwise(""), F.lit("{"), "definition", F.lit("}"))
    last = macros.where("accepted").groupBy("doc_id", "name").agg(F.max_by(F.struct("command", "numargs", "definition"), "ordinal").alias("d"), F.max("ordinal").alias("ordinal")).select("doc_id", "name", "ordinal", "d.*")
    own = last.groupBy("doc_id").agg(in_order(F.col("ordinal"), line, "\n").alias("own"))
    standard = "\n".join(STANDARD_MACROS)
    if target == "ptx":
        return own.select("doc_id", F.concat(F.lit("<macros>\n"), "own", F.lit("\n</macros>\n")).alias("prelude"))
    return own.select("doc_id", F.concat(F.lit(standard + "\n\\require{cancel}\n"), "own", F.lit("\n")).alias("prelude"))


def drawing_documents(requests: DataFrame, preludes: DataFrame) -> DataFrame:
    """(doc_id, node_id, tex): complete documents of drawings that a typesetter can run, each with its author's macros."""
    top, tikz, other = ("\n".join(x) + "\n" for x in (PREAMBLE, PREAMBLE_TIKZ, PREAMBLE_OTHER))
    head = F.concat(F.lit(top), F.when(F.col("tex").rlike("tikz"), F.lit(tikz)).otherwise(F.lit(other)))
    joined = requests.join(preludes, "doc_id", "left")
    return joined.select("doc_id", "node_id", F.concat(head, F.coalesce("prelude", F.lit("")), F.lit("\\begin{document}\n\\pagestyle{empty}\n"), "tex", F.lit("\n\\end{document}\n")).alias("tex"))
