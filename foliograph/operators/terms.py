r"""Terms in texts: an automaton over words that knows all terms and their plurals, walked once along each text.

The automaton is a tree of words. It is broadcast where the terms are few enough, by a count; beyond that, documents are
joined with terms by the term's first word, and each gets an automaton of the terms that may be its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Forms that are broadcast at most, and their characters.
BROADCAST_FORMS = 200_000
BROADCAST_CHARS = 8_000_000
_WORD = re.compile(r"[A-Za-z]+(?:-[A-Za-z]+)*")
_BLANK = " \t\n\r\f\v"
_ENDS = frozenset(_BLANK + ",:;.?!")
# Terms that are never linked.
RESERVED_TERMS = ["lemma", "proposition", "theorem"]
_FOUND = T.ArrayType(T.StructType([T.StructField("phrase", T.StringType()), T.StructField("term", T.StringType())]))


def normal_term(term: Column) -> Column:
    """A term without outer brackets and end punctuation, blanks as single spaces, long words without the plural s."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(term), r"^\((.*)\)$", "$1"), r"[:;,.]$", ""), r"\s+", " "))
    return F.regexp_replace(t, r"([a-z]{2}[a-rt-z])s\b", "$1")


def term_forms(terms: DataFrame, min_length: int = 4) -> DataFrame:
    """(phrase, term): the forms that a term of letters, blanks and hyphens takes in a text."""
    t = terms.where((F.length("term") >= min_length) & F.col("term").rlike("^[A-Za-z]+(?:[ -][A-Za-z]+)*$") & ~F.col("term").isin(*RESERVED_TERMS)).select("term")
    plural = F.when(F.col("term").rlike("[^aeiou]y$"), F.regexp_replace("term", "y$", "ies")).when(F.col("term").rlike("(?:s|x|ch|sh)$"), F.concat("term", F.lit("es"))).otherwise(F.concat("term", F.lit("s")))
    return t.select("term", F.explode(F.array("term", plural)).alias("phrase")).groupBy("phrase").agg(F.min("term").alias("term"))


def automaton(phrases: Iterable[tuple[str, object]]) -> dict:
    """A tree of words; the empty word leads to the phrase that ends there and its value."""
    root: dict = {}
    for phrase, value in phrases:
        node = root
        for word in phrase.split(" "):
            node = node.setdefault(word, {})
        node[""] = (phrase, value)
    return root


def matches(text: str, root: dict) -> Iterator[tuple[int, int, str, object]]:
    """(start, end, phrase, value) of every phrase in a text, at each place the longest first; only blanks may stand between words."""
    words = [m.span() for m in _WORD.finditer(text)]
    for i, (start, end) in enumerate(words):
        node, found = root.get(text[start:end]), []
        while node is not None:
            if "" in node:
                found.append((start, end, *node[""]))
            i += 1
            if i == len(words) or text[end : words[i][0]].strip(_BLANK) or end == words[i][0]:
                break
            node, end = node.get(text[words[i][0] : words[i][1]]), words[i][1]
        yield from reversed(found)


def _phrases(text: str, root: dict) -> list[dict]:
    return [{"phrase": p, "term": v} for p, v in dict.fromkeys((p, v) for _, _, p, v in matches(text or "", root))]


def link_terms(docs: DataFrame, terms: DataFrame, min_length: int = 4, broadcast_forms: int = BROADCAST_FORMS) -> DataFrame:
    """(doc_id, phrase, term): phrases of documents that are a term or its plural."""
    spark = docs.sparkSession
    ship(spark)
    forms = term_forms(terms, min_length)
    n, chars = forms.agg(F.count("*"), F.coalesce(F.sum(F.length("phrase") + F.length("term")), F.lit(0))).first()
    if n <= broadcast_forms and chars <= BROADCAST_CHARS:
        shared = spark.sparkContext.broadcast(automaton((r.phrase, r.term) for r in forms.collect()))

        @F.pandas_udf(_FOUND)
        def find(text: pd.Series) -> pd.Series:
            return text.map(lambda t: _phrases(t, shared.value))

        found = docs.select("doc_id", find("text").alias("found"))
    else:

        @F.pandas_udf(_FOUND)
        def find_own(text: pd.Series, own: pd.Series) -> pd.Series:
            return pd.Series([_phrases(t, automaton((r["phrase"], r["term"]) for r in rows)) for t, rows in zip(text, own, strict=True)])

        rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("__row"))
        words = rows.select("__row", "doc_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_WORD.pattern), F.lit(0)))).alias("first"))
        mine = words.drop("doc_id", "text").join(forms.withColumn("first", F.substring_index("phrase", " ", 1)), "first").groupBy("__row").agg(F.collect_list(F.struct("phrase", "term")).alias("own"))
        found = rows.join(mine, "__row").select("doc_id", find_own("text", "own").alias("found"))
    return found.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.phrase", "f.term")


def linked_text(text: str, root: dict) -> str:
    """A text with its phrases as links to their files: from left to right, the longest at each place, none inside another."""
    out, at = [], 0
    for start, end, phrase, file in matches(text, root):
        if start < max(at, 1) or text[start - 1] not in _BLANK or start - 1 < at or text[end : end + 1] and text[end] not in _ENDS:
            continue
        out += [text[at : start - 1], f' <span class="autoterm"><a knowl="{file}">{phrase.replace(" ", "&nbsp;")}</a></span>']
        at = end
    return "".join([*out, text[at:]])


def write_term_links(docs: DataFrame, found: DataFrame, targets: DataFrame) -> DataFrame:
    """Documents with their terms as links: ``found`` as of ``link_terms``, targets (term, file).

    Longer phrases win, and no link lies in another. A phrase needs a blank before it and a
    blank, punctuation or the end after it; blanks inside become ties. Of several files of a term the first in order is taken.
    """
    own = found.join(targets.groupBy("term").agg(F.min("file").alias("file")), "term").groupBy("doc_id").agg(F.collect_set(F.struct("phrase", "file")).alias("links"))

    @F.pandas_udf(T.StringType())
    def write(text: pd.Series, links: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or rows is None else linked_text(t, automaton((r["phrase"], r["file"]) for r in rows)) for t, rows in zip(text, links, strict=True)])

    ship(docs.sparkSession)
    return docs.join(own, "doc_id", "left").withColumn("text", write("text", "links")).drop("links")
