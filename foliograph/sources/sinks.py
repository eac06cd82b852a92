"""Writing pages and node tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_pages(pages: DataFrame, path: str, key: str = "doc_id") -> None:
    """One folder per page, ``doc_id=.../file=...``, that holds its text: (doc_id, file, text)."""
    pages.select(key, "file", "text").repartition(key, "file").write.mode("overwrite").option("lineSep", "\n").partitionBy(key, "file").text(path)


def snippets(nodes: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, file, text) of labelled nodes that are no sections, and of hidden proofs, solutions and hints."""
    shown = nodes.where(((F.coalesce("label", F.lit("")) != "") & ~F.col("marker").isin("chapter", "section", "subsection", "subsubsection")) | F.col("marker").isin("proof", "solution", "hint"))
    return shown.where(F.trim(text) != "").select("doc_id", F.concat("node_id", F.lit(".knowl")).alias("file"), F.col(text).alias("text"))


def main_files(pages: DataFrame, order: str = "pos") -> DataFrame:
    """(doc_id, text): the main file of the structured target, with the pages of a document included in order."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(order, "file"))), lambda x: F.concat(F.lit('<xi:include href="./'), x["file"], F.lit('"/>')))
    body = F.array_join(lines, "\n")
    return pages.groupBy("doc_id").agg(F.concat(F.lit('<?xml version="1.0" encoding="UTF-8" ?>\n<pretext xmlns:xi="http://www.w3.org/2001/XInclude">\n<book>\n'), body, F.lit("\n</book>\n</pretext>\n")).alias("text"))


def write_nodes(nodes: DataFrame, path: str, buckets: int = 0) -> None:
    """A node table; ranges of documents are contiguous, so that doc_id prunes files."""
    (nodes.repartitionByRange(buckets, "doc_id") if buckets else nodes).sortWithinPartitions("doc_id", "pos").write.mode("overwrite").parquet(path)


def render_requests(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, tex) of diagrams that only a typesetter can draw."""
    drawn = nodes.where(F.col("marker").isin("tikzpicture", "tikz", "circuitikz", "picture", "mathpicture", "diagram"))
    return drawn.select("doc_id", "node_id", F.concat("opening", "body", "closing").alias("tex"))
