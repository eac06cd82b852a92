r"""References, citations, bibliographies, dependency edges: joins on (document, key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import env_catalog
from . import bibliography
from .intervals import WIDTH

REF_RE = r"\\(?:ref|eqref|autoref|fullref)\{([^}]*)\}"
CITE_RE = r"\\cite(?:\[[^\]]*\])?\{([^}]*)\}"
CITE_NOTE_RE = r"\\cite(?:\[([^\]]*)\])?\{"


def references(nodes: DataFrame) -> DataFrame:
    """(doc_id, pos, k, label), one row per reference in a node's body, k from 1."""
    found = F.posexplode(F.regexp_extract_all("body", F.lit(REF_RE), F.lit(1))).alias("k", "label")
    return nodes.select("doc_id", "pos", found).withColumn("k", F.col("k") + 1)


def resolve(refs: DataFrame, labels: DataFrame) -> DataFrame:
    """References with what they show: a number, or the key marked as missing."""
    joined = refs.join(labels.select("doc_id", "label", F.col("pos").alias("target"), "marker", "codenumber"), ["doc_id", "label"], "left")
    shown = F.when(F.col("marker").isin("equation", "mathrow"), F.concat(F.lit("("), "codenumber", F.lit(")"))).otherwise(F.col("codenumber"))
    return joined.withColumn("shown", F.coalesce(shown, F.concat(F.lit("\\missingreflink{"), "label", F.lit("}"))))


def splice(nodes: DataFrame, resolved: DataFrame, pattern: str = REF_RE, text: str = "body") -> DataFrame:
    """Node texts with each match of ``pattern`` replaced by the resolved text of its ordinal.

    The text is cut at the matches and joined again; replacements are never patterns.
    """
    shown = resolved.groupBy("doc_id", "pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "shown"))), lambda x: x["shown"]).alias("shown"))
    both = nodes.join(shown, ["doc_id", "pos"], "left")
    gaps = F.split(text, pattern, -1)
    joined = F.array_join(F.zip_with(gaps, F.coalesce("shown", F.array().cast("array<string>")), lambda g, s: F.concat(F.coalesce(g, F.lit("")), F.coalesce(s, F.lit("")))), "")
    return both.withColumn(text, joined).drop("shown")


def citations(nodes: DataFrame) -> DataFrame:
    """(doc_id, pos, k, j, key, note): key j of the k-th citation; keys are comma lists."""
    both = F.arrays_zip(F.regexp_extract_all("body", F.lit(CITE_RE), F.lit(1)).alias("keys"), F.regexp_extract_all("body", F.lit(CITE_NOTE_RE), F.lit(1)).alias("note"))
    one = nodes.select("doc_id", "pos", F.posexplode(both).alias("k", "c"))
    keys = one.select("doc_id", "pos", (F.col("k") + 1).alias("k"), "c.note", F.posexplode(F.split("c.keys", ",")).alias("j", "key"))
    return keys.withColumn("j", F.col("j") + 1).withColumn("key", F.trim("key"))


def resolve_citations(cites: DataFrame, bib: DataFrame) -> DataFrame:
    """(doc_id, pos, k, shown): ``[labels, note]``; a missing key shows itself."""
    named = cites.join(bib.select("doc_id", "key", "label"), ["doc_id", "key"], "left").withColumn("name", F.coalesce("label", "key"))
    each = named.groupBy("doc_id", "pos", "k", "note").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("j", "name"))), lambda x: x["name"]), ",").alias("names"))
    return each.select("doc_id", "pos", "k", F.concat(F.lit("["), "names", F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit(", "), "note")).otherwise(F.lit("")), F.lit("]")).alias("shown"))


def bib_entries(docs: DataFrame) -> DataFrame:
    r"""(doc_id, ordinal, key, label, raw) of ``\bibitem[label]{key} text``, brackets and braces nested; without a label the ordinal."""
    return bibliography.items(docs.where(F.col("text").contains("\\bibitem")))


def dependency_edges(nodes: DataFrame, labels: DataFrame | None = None, kinds: tuple[str, ...] = ("theorem", "definition")) -> DataFrame:
    """(doc_id, source, target) labels: references anywhere inside nodes of the given classes, in items, equations and titles too.

    A target is a label of the same document, of ``labels`` or by default of the nodes themselves. The nodes are read once: statements,
    references and labels are rows of one exchange and meet in blocks of positions, as in ``intervals.contained``.
    """
    of = [r.marker for r in env_catalog(nodes.sparkSession).where(F.col("class").isin(*kinds)).select("marker").collect()]
    labelled = F.coalesce(F.col("label"), F.lit("")) != ""
    block = lambda c: F.floor(F.col(c) / WIDTH).cast("int")
    cell = lambda block, start, last, source, target: F.struct(block.alias("block"), start.cast("int").alias("start"), last.cast("int").alias("last"), source.cast("string").alias("source"), target.cast("string").alias("target"))
    none = F.lit(None)
    statement = F.when(labelled & F.col("marker").isin(*of), F.transform(F.sequence(block("pos"), block("last")), lambda b: cell(b, F.col("pos"), F.col("last"), F.col("label"), none)))
    texts = F.concat_ws(" ", "body", "option", "title")
    has = F.col("body").contains("ref") | F.col("option").contains("ref") | F.col("title").contains("ref")
    refs = F.when(has, F.transform(F.array_distinct(F.regexp_extract_all(texts, F.lit(REF_RE), F.lit(1))), lambda t: cell(block("pos"), F.col("pos"), none, none, t)))
    known = F.when(labelled, F.array(cell(block("pos"), none, none, none, F.col("label")))) if labels is None else none
    empty = F.array().cast("array<struct<block:int,start:int,last:int,source:string,target:string>>")
    rows = nodes.select("doc_id", F.explode(F.concat(*[F.coalesce(c, empty) for c in (statement, refs, known)])).alias("c")).select("doc_id", "c.*")
    some = lambda when, *names: F.collect_list(F.when(when, F.struct(*names)))
    is_ref = F.col("source").isNull() & F.col("start").isNotNull()
    met = rows.groupBy("doc_id", "block").agg(some(F.col("source").isNotNull(), "start", "last", "source").alias("s"), some(is_ref, "start", "target").alias("r"), F.collect_set(F.when(F.col("start").isNull(), F.col("target"))).alias("l"))
    within = F.flatten(F.transform("r", lambda r: F.transform(F.filter("s", lambda s: (r["start"] >= s["start"]) & (r["start"] <= s["last"])), lambda s: F.struct(s["source"].alias("source"), r["target"].alias("target")))))
    own = F.transform("l", lambda t: F.struct(F.lit(None).cast("string").alias("source"), t.alias("target")))
    found = met.select("doc_id", F.explode(F.array_distinct(F.concat(within, own))).alias("e")).select("doc_id", "e.*")
    if labels is not None:
        return found.distinct().join(labels.select("doc_id", F.col("label").alias("target")), ["doc_id", "target"], "left_semi").select("doc_id", "source", "target")
    by_target = found.groupBy("doc_id", "target").agg(F.collect_set("source").alias("sources"), F.max(F.col("source").isNull()).alias("known"))
    return by_target.where("known").select("doc_id", F.explode("sources").alias("source"), "target")


def prev_next(pages: DataFrame, order: Column | str, key: str = "file") -> DataFrame:
    """Pages of a document with the keys before and after them."""
    w = W.partitionBy("doc_id").orderBy(order)
    return pages.withColumn("prev", F.lag(key).over(w)).withColumn("next", F.lead(key).over(w))


def page_names(numbered: DataFrame, target: str = "html") -> DataFrame:
    """(doc_id, pos, file) of chapters and sections."""
    heads = numbered.where(F.col("marker").isin("chapter", "section"))
    return heads.select("doc_id", "pos", F.concat("marker", F.replace("codenumber", F.lit("."), F.lit("-")), F.lit(f".{target}")).alias("file"))


def toc(numbered: DataFrame, levels: tuple[str, ...] = ("chapter", "section")) -> DataFrame:
    """(doc_id, toc): the numbered headings of two levels as an ordered list."""
    heads = numbered.where(F.col("marker").isin(*levels))
    line = F.concat(F.when(F.col("marker") == levels[0], "").otherwise("  "), "codenumber", F.lit(" "), "title")
    return heads.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("toc"))
