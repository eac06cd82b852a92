r"""What stands before the body of a paper: title, authors, thanks, e-mail, abstract; and its appendix."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scanner import group_at, rewrite_macro
from ..functions.text import entities_to_tex, to_ascii
from ..session import ship
from . import content

_KIND = T.StructType([T.StructField("title", T.StringType()), T.StructField("title_short", T.StringType()), T.StructField("authors", T.ArrayType(T.StringType())), T.StructField("thanks", T.StringType()), T.StructField("email", T.StringType()), T.StructField("abstract", T.StringType()), T.StructField("appendix", T.StringType())])


def _after(text: str, name: str) -> list[tuple[str, str]]:
    """(option, argument) of every use of a macro."""
    out = []
    for m in re.finditer(rf"\\{name}\*?(?![A-Za-z])", text):
        start, end = group_at(text, m.end(), "[", "]")
        option, at = text[start + 1 : end - 1] if start < end else "", end
        start, end = group_at(text, at)
        if start < end:
            out.append((option.strip(), text[start + 1 : end - 1].strip()))
    return out


def front_matter(text: str) -> dict:
    bare = text
    for name in ("footnote", "thanks", "vspace"):
        bare = rewrite_macro(bare, name, 1, "")
    titles, authors = _after(bare, "title"), []
    for _, names in _after(bare, "author"):
        names = re.sub(r"\$[^$]+\$", "", names)
        for one in names.split("\\and" if "\\and" in names else " and "):
            authors.append(re.sub(r"(?s)\\\\.*", "", one).strip())
    thanks, emails = _after(text, "thanks"), re.findall(r"\\email\{([^{}]*)\}", text)
    abstract = re.search(r"(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}", text)
    appendix = re.search(r"(?s)\\begin\{appendix\}.*\\end\{appendix\}", text)
    title = re.sub(r"\$([^$]+)\$", r"\\(\1\\)", titles[-1][1]) if titles else ""
    return {
        "title": title, "title_short": titles[-1][0] if titles else "", "authors": authors, "thanks": thanks[-1][1] if thanks else "", "email": emails[-1] if emails else "",
        "abstract": abstract.group(1).strip() if abstract else "", "appendix": appendix.group(0) if appendix else "",
    }


@F.pandas_udf(_KIND)
def _front(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([front_matter(t or "") for t in text], columns=_KIND.names)


def front_matters(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, title, title_short, authors, thanks, email, abstract, appendix); empty where there is none, the last where there are several."""
    ship(docs.sparkSession)
    return docs.select("doc_id", _front(entities_to_tex(F.coalesce(text, F.lit("")))).alias("f")).select("doc_id", "f.*")


def serial_names(authors: Column) -> Column:
    """Names as a sentence has them: ``A``, ``A and B``, ``A, B, and C``."""
    n = F.size(authors)
    return F.when(n <= 2, F.array_join(authors, " and ")).otherwise(F.concat(F.array_join(F.slice(authors, 1, n - 1), ", "), F.lit(", and "), F.element_at(authors, -1)))


def paper_authors(pages: DataFrame, people: DataFrame, limit: int = 12) -> DataFrame:
    """(page_id, person_id): people among the ``citation_author`` entries of a page.

    Last names match if one ends like the other, first names if one begins like the other;
    an initial counts only on pages of at most ``limit`` authors.
    """
    metas = F.regexp_extract_all("html", F.lit(r'<meta\s+name="citation_author"\s+content="([^"]*)"'), F.lit(1))
    each = pages.select("page_id", F.size(metas).alias("n"), F.explode(metas).alias("author"))
    name = F.regexp_replace(to_ascii(F.col("author")), "'", "")
    last = F.trim(F.regexp_replace(F.split(name, ",")[0], r"\b(?:Jr|Sr|III|IV)\b|\.", ""))
    first = F.regexp_replace(F.trim(F.coalesce(F.get(F.split(name, ","), 1), F.lit(""))), r"\..*", "")
    each = each.select("page_id", "n", last.alias("al"), first.alias("af"))
    p = people.select("person_id", to_ascii(F.col("lastname")).alias("pl"), to_ascii(F.col("firstname")).alias("pf"))
    both = content.suffix_pairs(each.withColumn("initial", F.substring("af", 1, 1)), p.withColumn("initial", F.substring("pf", 1, 1)).where("pl <> ''"), ["initial"], "al", "pl")
    same = F.col("af").startswith(F.col("pf")) | F.col("pf").startswith(F.col("af"))
    return both.where(same & ((F.length("af") > 1) | (F.col("n") <= limit))).select("page_id", "person_id").distinct()


def marked_entries(nodes: DataFrame, name: str, numbered: bool = True) -> DataFrame:
    r"""(doc_id, pos, k, entry, context): arguments of ``\name{...}`` in node bodies.

    ``context`` is the place that a link should lead to: the node's parent where the node is
    a paragraph or math and the parent is no section.
    """
    ship(nodes.sparkSession)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def arguments(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [a for _, a in _after(t or "", name)])

    rows = nodes.where(F.col("body").contains("\\" + name)).select("doc_id", "pos", "parent", "marker", F.posexplode(arguments("body")).alias("k", "entry"))
    up = nodes.select("doc_id", F.col("pos").alias("parent"), F.col("marker").alias("parent_marker"))
    joined = rows.join(up, ["doc_id", "parent"], "left")
    plain = F.col("marker").isin("text", "$", "equation", "mathrow", "align") & ~F.coalesce("parent_marker", F.lit("document")).isin("document", "blob", "chapter", "section", "subsection", "subsubsection")
    return joined.select("doc_id", "pos", (F.col("k") + 1).alias("k"), "entry", F.when(plain, F.col("parent")).otherwise(F.col("pos")).alias("context"))


def ranked(entries: DataFrame) -> DataFrame:
    """Entries of a document with their rank, longest first, by which terms are linked."""
    return entries.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.length("entry").desc(), "entry", "pos", "k")))
