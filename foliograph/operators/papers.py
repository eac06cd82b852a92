"""Papers known by a code: titles and authors that a document lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frontmatter import serial_names

PAPERS = "map<string, struct<title: string, authors: array<struct<firstname: string, lastname: string>>>>"


def parse_papers(texts: DataFrame) -> DataFrame:
    """(code, title, authors) of JSON objects by code, in a column ``text``; a code that occurs again keeps its first title in order."""
    papers = F.from_json("text", PAPERS)
    rows = texts.select(F.explode(papers).alias("code", "p"))
    names = F.transform(F.coalesce("p.authors", F.array()), lambda a: F.trim(F.concat_ws(" ", a["firstname"], a["lastname"])))
    rows = rows.select("code", F.nullif(F.trim("p.title"), F.lit("")).alias("title"), F.filter(names, lambda x: x != "").alias("authors"))
    return rows.groupBy("code").agg(F.min("title").alias("title"), F.min_by("authors", "title").alias("authors"))


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """``parse_papers`` of JSON files, each one object."""
    return parse_papers(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))


def fill_from_papers(fronts: DataFrame, papers: DataFrame, code: str = "code") -> DataFrame:
    """Front matter (title, authors array<string>, code) whose missing titles and authors come from the papers of their code.

    What a document says itself stands. An unknown or null code changes nothing.
    """
    known = papers.select(F.col("code").alias("__code"), F.col("title").alias("__title"), F.col("authors").alias("__authors"))
    joined = fronts.join(known, F.col(code) == F.col("__code"), "left")
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), "__title", F.lit(""))
    authors = F.when(F.size(F.coalesce("authors", F.array())) > 0, F.col("authors")).otherwise(F.coalesce("__authors", F.array().cast("array<string>")))
    return joined.withColumns({"title": title, "authors": authors}).drop("__code", "__title", "__authors")


def title_lines(fronts: DataFrame) -> DataFrame:
    """(doc_id, title, authors) with authors as one text, as the record of a document shows them."""
    return fronts.select("doc_id", "title", serial_names(F.col("authors")).alias("authors"))
