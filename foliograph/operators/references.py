r"""What references show and where they lead: one pattern with the word before a reference, one join with labels.

``\ref``, ``\eqref``, ``\autoref`` and ``\fullref`` become links of the target. The word
before a number belongs to the link, but for words that only join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_name
from .links import splice

#: The word before, the kind and the label of a reference.
LINK_RE = r"(?:(\\S|[A-Za-z]+[.,:;]?)(?:\s|~|&nbsp;)+)?\\(ref|eqref|autoref|fullref)\*?\s*\{([^{}]+)\}"
# Words before a reference that are no part of the link.
JOINING_WORDS = ["and", "from", "of", "to", "through", "in", "by", "that"]
#: Markers whose numbers stand in brackets; sections that are pages; sections inside pages.
MATH_MARKERS = ["equation", "mathrow", "align", "multline", "split", "gather", "eqnarray", "alignat", "reaction", "reactions"]
PAGES, PARTS = ["chapter", "section"], ["subsection", "subsubsection"]
SPACE = {"html": "&nbsp;", "ptx": "<nbsp />"}


def link_references(nodes: DataFrame, text: str = "body") -> DataFrame:
    """(doc_id, pos, k, word, kind, label) of the references in a node's text."""
    part = lambda g: F.regexp_extract_all(text, F.lit(LINK_RE), F.lit(g))
    found = F.posexplode(F.arrays_zip(part(1).alias("word"), part(2).alias("kind"), part(3).alias("label"))).alias("k", "r")
    rows = nodes.where(F.col(text).rlike(r"\\(?:eq|auto|full)?ref")).select("doc_id", "pos", found)
    clean = safe_name(F.regexp_replace("r.label", r"\s*\n\s*", " "), as_id=True)
    return rows.select("doc_id", "pos", (F.col("k") + 1).alias("k"), "r.word", "r.kind", F.col("r.label").alias("raw_label"), clean.alias("label"))


def _page(marker: Column, number: Column, chapters: Column) -> Column:
    """The address of a section: its own page, or its place on the page of the section around it."""
    dash = lambda c: F.replace(c, F.lit("."), F.lit("-"))
    around = F.when(chapters, F.substring_index(number, ".", 2)).otherwise(F.substring_index(number, ".", 1))
    return F.when(marker.isin(*PAGES), F.concat(marker, dash(number), F.lit(".html"))).when(marker.isin(*PARTS), F.concat(F.lit("section"), dash(around), F.lit(".html#subsection"), dash(number)))


def resolve_links(refs: DataFrame, labels: DataFrame, target: str = "html", link: bool = True, chapters: Column | None = None) -> DataFrame:
    """References with ``shown``, the markup in their place.

    labels: (doc_id, label, marker, codenumber, node_id), labels as safe names. A missing
    label shows itself. Without ``link`` only what would be clicked on is shown. ``chapters``
    tells documents whose top level is the chapter; sections on their own are the default.
    """
    known = labels.select("doc_id", safe_name(F.col("label"), as_id=True).alias("label"), F.col("marker").alias("of"), F.col("codenumber").alias("number"), "node_id")
    j = refs.join(known, ["doc_id", "label"], "left")
    smart = F.col("kind").isin("autoref", "fullref")
    word = F.when(smart, F.initcap(F.when(F.col("of") == "blob", "section").otherwise(F.col("of")))).otherwise(F.coalesce("word", F.lit("")))
    before_smart = F.when(smart & (F.coalesce("word", F.lit("")) != ""), F.concat("word", F.lit(" "))).otherwise("")
    joining = (word == "") | word.isin(*JOINING_WORDS) | word.rlike("[.,:;]$")
    number = F.coalesce("number", F.lit(""))
    is_math = F.col("of").isin(*MATH_MARKERS)
    before = F.when(word == "", "").when(joining | (is_math & (F.lit(target) == "html")), F.concat(word, F.lit(" "))).otherwise("")
    inside = F.when(joining, number).otherwise(F.concat(word, F.when(number != "", F.concat(F.lit(SPACE[target]), number)).otherwise("")))
    missing = F.col("node_id").isNull()
    if target == "html":
        inside = F.when(is_math, F.concat(F.lit("("), number, F.lit(")"))).otherwise(inside)
        address = _page(F.col("of"), number, F.lit(False) if chapters is None else chapters)
        opening = F.when(address.isNotNull(), F.concat(F.lit('<a class="internal" href="'), address, F.lit('">'))).otherwise(F.concat(F.lit('<a knowl="'), "node_id", F.lit('.knowl">')))
        shown = F.concat(before, opening, inside, F.lit("</a>")) if link else F.concat(before, inside)
        shown = F.when(missing, F.concat(before, F.lit("\\missingreflink{"), "label", F.lit("}"))).otherwise(shown)
        knowl = F.concat(F.lit('<a knowl="'), "node_id", F.lit('.knowl">('), number, F.lit(")</a>")) if link else F.concat(F.lit("("), number, F.lit(")"))
        kept = F.when(F.coalesce("word", F.lit("")) != "", F.concat("word", F.lit(" "))).otherwise("")
        equation = F.concat(kept, F.when(missing, F.concat(F.lit("("), "label", F.lit(")"))).otherwise(knowl))
    else:
        clicked = F.when(joining, "").otherwise(word)
        shown = F.concat(before, F.lit('<xref ref="'), "label", F.lit('">'), clicked, F.lit("</xref>"))
        kept = F.when(F.coalesce("word", F.lit("")) != "", F.concat("word", F.lit(" "))).otherwise("")
        equation = F.concat(kept, F.lit('<xref ref="'), "label", F.lit('" />'))
    return j.withColumn("shown", F.when(F.col("kind") == "eqref", equation).otherwise(F.concat(before_smart, shown)))


def with_links(nodes: DataFrame, labels: DataFrame, target: str = "html", text: str = "body", link: bool = True) -> DataFrame:
    """Node texts with their references as links of a target."""
    return splice(nodes, resolve_links(link_references(nodes, text), labels, target, link), LINK_RE, text)


CITE_RE = r"(\S*)(?:\s|~|&nbsp;)*\\(cite|citeib)\s*(?:\[([^\]]*)\])?\s*(?:\[([^\]]*)\])?\s*\{([^{}]*)\}"


def resolve_cites(nodes: DataFrame, bib: DataFrame, link: bool = True, text: str = "body") -> DataFrame:
    r"""(doc_id, pos, k, shown) of ``\cite`` and ``\citeib`` with the word before them.

    One key is one link with the note in it; several keys are links of their own in one
    bracket. The first argument of ``\citeib`` stands in place of the label. A missing key
    shows itself.
    """
    part = lambda g: F.regexp_extract_all(text, F.lit(CITE_RE), F.lit(g))
    names = ("word", "kind", "first", "second", "keys")
    zipped = F.arrays_zip(*[part(g).alias(n) for g, n in enumerate(names, 1)])
    rows = nodes.where(F.col(text).contains("\\cite")).select("doc_id", "pos", F.posexplode(zipped).alias("k", "c")).select("doc_id", "pos", (F.col("k") + 1).alias("k"), "c.*")
    each = rows.select("doc_id", "pos", "k", "word", "kind", "first", "second", F.size(F.split("keys", ",")).alias("n"), F.posexplode(F.split("keys", ",")).alias("j", "raw"))
    each = each.withColumn("key", safe_name(F.trim("raw"), as_id=True)).join(bib.select("doc_id", safe_name(F.col("key"), as_id=True).alias("key"), "label"), ["doc_id", "key"], "left")
    ibid = F.col("kind") == "citeib"
    note = F.when(ibid, F.col("second")).otherwise(F.col("first"))
    name = F.when(ibid & (F.coalesce("first", F.lit("")) != ""), F.col("first")).otherwise(F.coalesce("label", "key"))
    single = F.concat(F.lit("["), name, F.when(F.coalesce(note, F.lit("")) != "", F.concat(F.lit(", "), note)).otherwise(""), F.lit("]"))
    anchor = lambda inner: F.concat(F.lit('<a knowl="'), "key", F.lit('.knowl">'), inner, F.lit("</a>")) if link else inner
    each = each.withColumn("one", F.when(F.col("n") == 1, anchor(single)).otherwise(anchor(F.coalesce("label", "key"))))
    found = each.groupBy("doc_id", "pos", "k", "word", "n").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("j", "one"))), lambda x: x["one"]), ", ").alias("links"))
    space = F.when(F.col("word") == "", "").when(F.col("word").rlike("[.,:;]$"), " ").otherwise("&nbsp;")
    return found.select("doc_id", "pos", "k", F.concat("word", space, F.when(F.col("n") > 1, F.concat(F.lit("["), "links", F.lit("]"))).otherwise(F.col("links"))).alias("shown"))


def paper_link(entry: Column) -> Column:
    """The link of a bibliography entry to its preprint or, without one, to its review; empty without either."""
    preprint = F.regexp_extract(entry, r"(?i)arXiv[ ~:]*([0-9]{4}\.[0-9]{4,5})(?:\b|v[0-9]+)", 1)
    review = F.regexp_extract(entry, r"(?i)MR:* *([0-9]{7})\b", 1)
    at = lambda site, code, name: F.concat(F.lit(f'<div><a href="http://{site}/'), code, F.lit(f'">{name}</a></div>'))
    return F.when(preprint != "", at("arxiv.org/abs", preprint, "paper")).when(review != "", at("ams.org/mathscinet", review, "AMS Math Review")).otherwise("")
