r"""Opening tag, heading and closing tag of every node, by class and target, from one table of templates.

A template holds fields in braces. A field that depends on an optional value (a label, a
title, a number) is empty where the value is. The node table is joined with the templates
by marker where the marker has its own and else by class. Templates are cut at their fields beforehand; the
values of a node are one map, computed once, in which each piece of its three templates is looked up.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import SECTION_LEVELS
from ..functions.markup import tex_to_html, tex_to_ptx
from . import content

# Class or marker, target, opening tag, heading, closing tag.
_BLOCK_HTML = ('\n<article class="{class}-like" id="{id}">', '<h5 class="heading"><span class="type">{type}</span>{unstarred}{parentitle}</h5>', "\n</article>\n")
_BLOCK_PTX = ("\n<{tag}{xid}>", "{title}", "\n</{tag}>\n")
_DRAWING = ("\\begin{{marker}}", "", "\\end{{marker}}")
TEMPLATES = [
    *[(c, "html", *_BLOCK_HTML) for c in ("definition", "theorem", "exercise", "example", "remark")],
    *[(c, "ptx", *_BLOCK_PTX) for c in ("definition", "theorem", "exercise", "example", "remark")],
    ("generictheorem", "html", '\n<article class="{class}-like" id="{id}">', '<h5 class="heading"><span class="title">{option:GTheorem}</span></h5>', "\n</article>\n"),
    ("generictheorem", "ptx", "<paragraphs{xid}>", "{titletag}", "</paragraphs>"),
    ("aside", "html", '\n<article class="{class}-like" id="{id}">', '<h5 class="heading"><span class="type">{type}</span><span class="codenumber">{number}</span>{spacedtitle}</h5>', "\n</article>\n"),
    ("aside", "ptx", "\n<aside>\n", "{titletag}", "\n</aside>\n"),
    ("text", "html", '\n<p id="{id}">', "", "</p>\n"),
    ("text", "ptx", "\n<p>\n", "", "\n</p>\n"),
    ("mathrow", "html", "", "", "{rowtag}{rowend}"),
    ("mathrow", "ptx", "<mrow{xidnumber}>", "", "</mrow>\n"),
    ("mathwrapper", "html", "\\begin{{marker}}", "", "\n\\end{{marker}}"),
    ("mathwrapper", "ptx", "\n<md{wrapped}>", "", "\n</md{n}>\n"),
    ("mathcomponent", "html", "\\begin{{marker}}", "", "\n\\end{{marker}}"),
    ("mathcomponent", "ptx", "\\begin{{marker}}", "", "\n\\end{{marker}}"),
    ("math", "html", "\\begin{{marker}}", "", "{mathtag}\n\\end{{marker}}"),
    ("math", "ptx", "\n<md{xidspace}>", "", "\n</md>\n"),
    ("equation", "ptx", "\n<me{unstarredn}{xidspace}>\n", "", "\n</me{unstarredn}>\n"),
    ("reaction", "ptx", "\n<me{unstarredn}{xidspace}>\n", "", "\n</me{unstarredn}>\n"),
    ("mathinline", "html", "\\(", "", "\\)"),
    ("mathinline", "ptx", "<m>", "", "</m>"),
    ("hint", "html", '<span class="hint"><a knowl="" class="internal" value="', "", '">{type}</a></span>'),
    ("hint", "ptx", "<{marker}{xidspace}>", "", "</{marker}>"),
    ("section", "html", '{anchor}\n<section class="{marker}" id="{id}">', '<h{level} class="heading hide-type"><span class="type">{type}</span> {sectionnumber}<span class="title">{sectiontitle}</span></h{level}>', "\n</section>\n"),
    ("section", "ptx", "\n<{marker}{namespace}{xid}>\n", "<title>{name}</title>", "</{marker}>"),
    ("proof", "html", '\n<article class="proof" id="{id}">', '<h5 class="heading">{prooftitle}</h5>', "\n</article>\n"),
    ("proof", "ptx", "\n<proof>\n", "", "\n</proof>\n"),
    ("list", "html", "<ul>", "", "</ul>"),
    ("list", "ptx", "<ul>", "", "</ul>"),
    ("enumerate", "html", "<ol{listtype}>", "", "</ol>"),
    ("enumerate", "ptx", "<ol{listlabel}>", "", "</ol>"),
    *[("descriptionlist", t, "<dl>", "", "</dl>") for t in ("html", "ptx")],
    *[(m, t, "", "", "") for m in ("parts", "subparts", "sageexample", "picture") for t in ("html", "ptx")],
    ("item", "html", '<li{itemlabel} id="{id}">', "", "</li>\n"),
    ("item", "ptx", "{itemopen}", "", "{itemclose}"),
    ("quote", "html", '<div class="quote">', "", "</div>"),
    ("quote", "ptx", "<blockquote>", "", "</blockquote>"),
    ("minipage", "html", '<div class="minipage">', "", "{captionof}</div>"),
    ("minipage", "ptx", "{captioncomment}<sidebyside>", "", "</sidebyside>"),
    ("layout", "html", '<div class="{marker}">', "", "{captionof}</div>"),
    ("layout", "ptx", "", "", ""),
    ("blob", "ptx", "<introduction>", "", "</introduction>"),
    *[(m, "ptx", "<{marker}>", "{titletag}", "</{marker}>") for m in ("objectives", "sidebyside")],
    ("lateximage", "ptx", "<image>\n<latex-image>", "", "</latex-image>\n</image>"),
    ("table", "html", '<table id="{id}" >', "", "</table>"),
    ("table", "ptx", "<tabular{xidspace}>", "", "</tabular>"),
    ("figure", "html", "\n<figure>\n", "", "{figcaption}\n</figure>\n"),
    ("figure", "ptx", "{figopen}", "\n{caption}\n", "</figure>\n"),
    ("wrapfigure", "html", '<figure class="wrap">', "", "\n{figcaption}\n</figure>\n"),
    ("footnote", "html", '<sup><a knowl="" class="id-ref" refid="{id}">note</a></sup><span id="{id}" style="display: none" class="tex2jax_ignore" >', "", "</span>"),
    ("footnote", "ptx", "<fn{xid}>", "", "</fn>"),
    *[("verbatim", t, "<pre>", "", "</pre>") for t in ("html", "ptx")],
    *[(m, t, "<{marker}>", "", "</{marker}>") for m in ("lstlisting", "trinket", "stdout", "code") for t in ("html", "ptx")],
    *[("program", t, "<program><input>", "", "</input></program>") for t in ("html", "ptx")],
    ("verb", "html", '<code class="inline">', "", "</code>"),
    ("verb", "ptx", "<c>", "", "</c>"),
    *[("tikz", t, "\\begin{tikzpicture}", "", "\\end{tikzpicture}") for t in ("html", "ptx")],
    *[(m, t, *_DRAWING) for m in ("tikzpicture", "circuitikz") for t in ("html", "ptx")],
    *[("document", t, "", "", "") for t in ("html", "ptx")],
    *[("none", t, "", "", "") for t in ("html", "ptx")],
]
UNKNOWN = ('<div class="unprocessed">', "", "</div>")
# Markers whose element has no name of its own.
TYPE_NAMES = {"previewactivity": "Preview Activity", "keyidea": "Key Idea", "computationaltheorem": "Computational Theorem", "subclaim": "Subclaim"}


def _fields(target: str) -> dict[str, Column]:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    when = lambda value, *parts: F.when(value != "", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise("")
    label, option, number, marker, title, caption = (text(c) for c in ("label", "option", "codenumber", "marker", "title", "caption"))
    shown = text("__option")
    star = F.coalesce("star", F.lit(False))
    names = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    kind = F.coalesce(F.try_element_at(names, marker), F.initcap(marker))
    bracketed = F.regexp_replace(option, r"^\[|\]$", "")
    own_tag = F.col("body").contains("\\tag{")
    quads = "\\quad\\quad"
    tagged = (number != "") & ~number.contains("x") & ~own_tag & ~star
    row_tag = F.when(tagged, F.concat(F.lit(quads * 2 + "\\quad\\quad \\quad \\tag{"), number, F.lit("}"))).otherwise("")
    math_tag = F.when(tagged, F.concat(F.when(marker.isin("multline", "split"), F.lit(quads * 2 + "\\quad")).otherwise(""), F.lit(quads + "\\tag{"), number, F.lit("}"))).otherwise("")
    proof = F.when(option.startswith("of "), F.concat(F.lit("Proof "), shown)).otherwise(shown)
    item = F.when(option != "", F.concat(F.lit(' class="custom-list-style-type" label="'), bracketed, F.lit('"'))).otherwise("")
    xid_space = when(label, ' xml:id="', label, '" ')
    parent = text("parent_marker")
    item_open = F.when(parent == "parts", "\n<task>\n").when(parent == "subparts", "\n<subtask>\n").otherwise(F.concat(F.lit("<li"), item, xid_space, F.when(option != "", " >").otherwise(">")))
    caption_of = when(caption, '<div class="caption"><span class="heading">', F.initcap(text("caption_type")), '</span><span class="codenumber">', number, "</span>", caption, "</div>")
    figure_open = F.when(caption == "", "<figure>\n").otherwise(F.concat(F.lit("<figure"), xid_space, F.when(marker == "wrapfigure", ' class = "wrap" ').otherwise(""), F.lit(">")))
    level = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in SECTION_LEVELS]), marker), F.lit(0)), F.lit(2)).cast("string")
    name = text("__title")
    heading_of = F.when(marker == "wrapfigure", "Figure").otherwise(F.initcap(marker))
    return {
        "{class}": text("class"), "{marker}": marker, "{type}": kind, "{tag}": F.when(F.lower(kind) == "task", marker).otherwise(F.lower(kind)), "{id}": text("out_id"), "{number}": number,
        "{unstarred}": F.when(star, "").otherwise(F.concat(F.lit('<span class="codenumber">'), number, F.lit("</span>"))),
        "{parentitle}": when(shown, '(<span class="parentitle">', shown, "</span>)"), "{spacedtitle}": when(shown, ' (<span class="title">', shown, "</span>)"),
        "{option:GTheorem}": F.when(shown != "", shown).otherwise("GTheorem"), "{titletag}": when(option, "<title>", option, "</title>"), "{title}": when(option, "<title>", option, "</title>\n"),
        "{xid}": when(label, ' xml:id="', label, '"'), "{xidspace}": xid_space, "{xidnumber}": when(label, ' xml:id="', label, '" number="yes"'), "{wrapped}": when(label, 'n xml:id="', label, '" '),
        "{n}": when(label, "n"), "{unstarredn}": F.when(star, "").otherwise("n"), "{rowtag}": row_tag, "{rowend}": F.when(option == "end", "").otherwise("\\\\\n"), "{mathtag}": math_tag,
        "{anchor}": F.when(marker == "subsection", F.concat(F.lit('<a name="subsection'), F.replace(number, F.lit("."), F.lit("-")), F.lit('"></a>'))).otherwise(""),
        "{level}": level, "{sectionnumber}": F.when((number != "") & ~number.endswith("x"), F.concat(F.lit('<span class="codenumber">'), number, F.lit("</span>"))).otherwise(""),
        "{sectiontitle}": name, "{name}": title, "{namespace}": F.when(marker == "chapter", ' xmlns:xi="http://www.w3.org/2001/XInclude" ').otherwise(""),
        "{prooftitle}": F.when(option != "", F.concat(F.lit('<span class="title">'), proof, F.lit("</span>"))).when(marker == "proofsketch", "Sketch of Proof").otherwise("Proof"),
        "{listtype}": when(option, ' type="', F.regexp_replace(option, "[^a-zA-Z0-9]", ""), '"'), "{listlabel}": when(option, ' label="', F.regexp_replace(option, "[^a-zA-Z0-9]", ""), '"'),
        "{itemlabel}": F.when(option != "", item).otherwise(F.concat(F.lit(' label="('), number, F.lit(')"'))), "{itemopen}": item_open,
        "{itemclose}": F.when(parent == "parts", "\n</task>\n").when(parent == "subparts", "\n</subtask>\n").otherwise("</li>\n"),
        "{captionof}": caption_of, "{captioncomment}": when(caption, "\n<!-- <caption>", caption, "</caption> -->\n"), "{figopen}": figure_open,
        "{figcaption}": when(caption, '<figcaption><span class="heading">', heading_of, '</span><span class="codenumber">', number, "</span>", caption, "</figcaption>"),
        "{caption}": F.when(caption == "", "").when(marker == "table", F.concat(F.lit("<title>"), caption, F.lit("</title>"))).otherwise(F.concat(F.lit("<caption>"), caption, F.lit("</caption>"))),
    }


#: Columns that ``tagged`` looks at and that a node table may lack.
OPTIONAL = ("caption", "caption_type", "parent_marker")


def tagged(nodes: DataFrame, target: str = "html") -> DataFrame:
    """Numbered nodes with ids, with ``open_tag``, ``heading`` and ``close_tag`` for a target.

    ``caption``, ``caption_type`` and ``parent_marker`` are used where they are there.
    Markers that the catalogue lacks come out as unprocessed.
    """
    spark = nodes.sparkSession
    full = nodes.withColumns({c: F.lit(None).cast("string") for c in OPTIONAL if c not in nodes.columns})
    table = spark.createDataFrame([(k, *map(_pieces, row)) for k, t, *row in TEMPLATES if t == target], f"key string, {', '.join(f'{n} array<string>' for n in PARTS)}")
    own = sorted({k for k, t, *_ in TEMPLATES if t == target} & _markers())
    key = F.when(F.col("marker").isin(*own), F.col("marker")).otherwise(F.coalesce("class", F.lit("unknown")))
    joined = full.withColumn("key", key).join(F.broadcast(table), "key", "left")
    # What needs conversion is converted once, before the fields that show it.
    convert = (lambda c: c) if target == "ptx" else tex_to_html
    option, title = (F.coalesce(c, F.lit("")) for c in ("option", "title"))
    joined = joined.withColumns({"__option": convert(option), "__title": F.when(title == "XXXX", "").otherwise(convert(title))})
    used = {p for _, t, *row in TEMPLATES if t == target for x in row for p in _pieces(x)}
    fields = F.create_map(*[x for name, value in _fields(target).items() if name in used for x in (F.lit(name), value)])
    filled = lambda f, name, unknown: F.array_join(F.transform(F.coalesce(name, F.array(*[F.lit(p) for p in _pieces(unknown)])), lambda p: F.coalesce(F.try_element_at(f, p), p)), "")
    # The map is a lambda's argument: as a column of its own it would be put into the lambdas below and computed for every piece.
    made = F.get(F.transform(F.array(fields), lambda f: F.struct(*[filled(f, name, unknown).alias(name) for name, unknown in zip(PARTS, UNKNOWN, strict=True)])), F.lit(0))
    joined = joined.withColumn("__made", made)
    return joined.withColumns({name: F.col(f"__made.{name}") for name in PARTS}).drop("key", "__option", "__title", "__made", *[c for c in OPTIONAL if c not in nodes.columns])


PARTS = ("open_tag", "heading", "close_tag")


def _pieces(template: str) -> list[str]:
    """A template cut at its fields, which are pieces of their own."""
    return [p for p in re.split(r"(\{[a-zA-Z:]+\})", template) if p] or [""]


def _markers() -> set[str]:
    from ..catalog import ENVIRONMENTS

    classes = {c for c, *_ in ENVIRONMENTS}
    return {m for _, _, _, names in ENVIRONMENTS for m in names.split() if m not in classes or m in ("table", "figure", "hint", "aside", "text", "mathrow")} | {"document"}


def converted(nodes: DataFrame, target: str = "html") -> DataFrame:
    """Bodies in a target's markup: math stays as it is, literal text is escaped, the rest is converted."""
    convert = tex_to_html if target == "html" else tex_to_ptx
    literal = F.replace(F.replace(F.col("body"), F.lit("<"), F.lit("&lt;")), F.lit("~"), F.lit("&#126;"))
    bare = F.regexp_replace("body", r"\\label\{[^}]*\}", "")
    body = F.when(F.col("marker").isin("verb", "verbatim", "program"), literal).when(F.coalesce(F.col("class").startswith("math"), F.lit(False)), bare).otherwise(convert(bare))
    return nodes.withColumn("body", body)


def hidden(nodes: DataFrame, kinds: tuple[str, ...] = ("proof", "solution")) -> DataFrame:
    """Nodes whose text stands in a snippet of its own, as the link that stands in its place."""
    title = F.when(F.col("marker") != "proof", F.initcap("marker")).when(F.col("option").startswith("of "), F.concat(F.lit("Proof "), "option")).otherwise(F.coalesce(F.nullif("option", F.lit("")), F.lit("Proof")))
    link = F.concat(F.lit("\n<article class='hiddenproof'><a knowl='"), "node_id", F.lit(".knowl'><h5 class='heading'><span class='type'>"), title, F.lit("</span></h5></a></article>\n"))
    is_hidden = F.col("marker").isin(*kinds)
    swap = {c: F.when(is_hidden, "").otherwise(F.col(c)) for c in ("heading", "close_tag", "body")}
    return nodes.withColumns({"open_tag": F.when(is_hidden, link).otherwise(F.col("open_tag"))} | swap)


def pages_text(nodes: DataFrame, target: str = "html", hide: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text): whole documents in a target's markup."""
    done = converted(tagged(nodes, target), target)
    done = hidden(done, hide) if hide else done
    return content.assemble(done.withColumn("open_tag", F.concat("open_tag", "heading")), "open_tag", "close_tag")
