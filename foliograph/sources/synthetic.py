"""Markup documents built from the rows of the relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return dealt(rows) if name in TEXTS else rows


#: Tables whose rows become texts, one each: small as files, which Spark reads in a task or two, and long work.
TEXTS = ("part", "supplier")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows over all cores, also where their file is too small to be read in so many parts."""
    parts = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(parts) if rows.rdd.getNumPartitions() < parts else rows


def joined(rows: Column, sep: str = "") -> Column:
    """Text of collected (key..., s) structs in key order; the last field is the text."""
    return F.array_join(F.transform(F.sort_array(rows), lambda r: r["s"]), sep)


#: Line items of an order, numbered without gaps or ties.
ITEM_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*ITEM_ORDER))
    return table(spark, sf_dir, "lineitem").withColumn("l_linenumber", place)


def customer_books(spark: SparkSession, sf_dir: str, starred: bool = False) -> DataFrame:
    """A section per order, a theorem per line item; starred where the item was returned."""
    item = line_items(spark, sf_dir)
    env = F.when(F.col("l_returnflag") == "R", "theorem*").otherwise("theorem") if starred else F.lit("theorem")
    body = F.format_string("Part %d comes from supplier %d.", "l_partkey", "l_suppkey")
    s = F.concat(F.lit("\\begin{"), env, F.lit("}\\label{l:"), F.col("l_orderkey"), F.lit(":"), F.col("l_linenumber"), F.lit("}"), body, F.lit("\\end{"), env, F.lit("}\n"))
    lines = item.groupBy("l_orderkey").agg(joined(F.collect_list(F.struct("l_linenumber", s.alias("s")))).alias("items"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    head = F.concat(F.lit("\\section{Order "), F.col("o_orderkey"), F.lit("}\\label{o:"), F.col("o_orderkey"), F.lit("}\n"), F.coalesce("items", F.lit("")))
    return orders.groupBy(F.col("o_custkey").alias("doc_id")).agg(joined(F.collect_list(F.struct("o_orderkey", head.alias("s")))).alias("text"))


def nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: a theorem that holds a proof per line item that holds an equation."""
    s = F.format_string("\\begin{proof}Item %d.\\begin{equation}\\label{e:%d:%d}q=%d\\end{equation}\\end{proof}\n", "l_linenumber", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("int"))
    item = line_items(spark, sf_dir)
    text = F.concat(F.lit("\\begin{theorem}\\label{t:"), F.col("l_orderkey"), F.lit("}\n"), joined(F.collect_list(F.struct("l_linenumber", s.alias("s")))), F.lit("\\end{theorem}"))
    return item.groupBy("l_orderkey").agg(text.alias("text")).select(F.col("l_orderkey").alias("doc_id"), "text")


def math_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: an align with a row per line item, without a number where it was returned."""
    s = F.concat(F.lit("x_{"), F.col("l_linenumber"), F.lit("} &= "), F.col("l_quantity").cast("int"), F.when(F.col("l_returnflag") == "R", " \\nonumber").otherwise(""))
    rows = line_items(spark, sf_dir).groupBy("l_orderkey").agg(joined(F.collect_list(F.struct("l_linenumber", s.alias("s"))), " \\\\\n").alias("rows"))
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("\\begin{align}"), "rows", F.lit("\\end{align}")).alias("text"))


def part_catalogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per brand: an enumerate of types, each with an enumerate of its parts."""
    part = table(spark, sf_dir, "part").withColumn("doc_id", F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long"))
    s = F.format_string("\\item part %d\n", "p_partkey")
    types = part.groupBy("doc_id", "p_type").agg(joined(F.collect_list(F.struct("p_partkey", s.alias("s")))).alias("inner"))
    one = F.concat(F.lit("\\item "), "p_type", F.lit("\n\\begin{enumerate}\n"), "inner", F.lit("\\end{enumerate}\n"))
    docs = types.groupBy("doc_id").agg(joined(F.collect_list(F.struct("p_type", one.alias("s")))).alias("body"))
    return docs.select("doc_id", F.concat(F.lit("\\begin{enumerate}\n"), "body", F.lit("\\end{enumerate}")).alias("text"))


def atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per region: a chapter, a section per nation, a theorem per customer."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    s = F.format_string("\\begin{theorem}\\label{c:%d}%s\\end{theorem}\n", "c_custkey", "c_mktsegment")
    people = customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(joined(F.collect_list(F.struct("c_custkey", s.alias("s")))).alias("people"))
    sections = nation.join(people, "n_nationkey", "left")
    sec = F.concat(F.lit("\\section{"), "n_name", F.lit("}\\label{n:"), F.col("n_nationkey"), F.lit("}\n"), F.coalesce("people", F.lit("")))
    docs = sections.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(joined(F.collect_list(F.struct("n_nationkey", sec.alias("s")))).alias("sections")).join(table(spark, sf_dir, "region"), "r_regionkey")
    return docs.select(F.col("r_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("\\chapter{"), "r_name", F.lit("}\\label{r:"), F.col("r_regionkey"), F.lit("}\n"), "sections").alias("text"))


def citing_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: one citation of all its suppliers, and entries for those with an even key."""
    item = line_items(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_suppkey")
    keys = joined(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("s"), F.col("l_suppkey")).alias("s"))), ", ")
    entry = F.concat(F.lit("\\bibitem["), F.concat(F.lit("S"), F.col("l_suppkey")), F.lit("]{s"), F.col("l_suppkey"), F.lit("} Supplier\n"))
    even = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(F.col("l_suppkey") % 2 == 0, F.struct("l_suppkey", entry.alias("s"))))), lambda r: r["s"]))
    docs = item.groupBy("doc_id").agg(keys.alias("keys"), F.array_join(even, "").alias("bib"))
    return docs.select("doc_id", F.concat(F.lit("See \\cite[p. 1]{"), "keys", F.lit("}.\n\\begin{thebibliography}{9}\n"), "bib", F.lit("\\end{thebibliography}")).alias("text"))


def macro_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part: macros of no, one and two arguments, used once each, and one that nobody defines."""
    part = table(spark, sf_dir, "part")
    text = F.concat(
        F.lit("\\newcommand{\\brand}{"), "p_brand", F.lit("}\n\\newcommand{\\size}[1]{size #1 of "), F.col("p_size"), F.lit("}\n\\newcommand{\\both}[2]{#2 before #1}\n"),
        F.lit("\\brand: \\size{"), F.col("p_partkey"), F.lit("}; \\both{a}{\\brand}. \\unknown"),
    )
    return part.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))
