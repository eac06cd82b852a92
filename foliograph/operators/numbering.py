"""Numbers of sections, environments, rows and items by windows over document order.

A counter is a running total less its value at the last reset, an unstarred heading of a
higher level. Totals never fall, so that value is a running maximum over resets. Nothing is
counted in a loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import ENV_COUNTERS, SECTION_LEVELS, env_catalog


def number_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with ``codenumber``: null for nodes that carry no number.

    The top level is the chapter where a document has one and else the section. Starred
    headings count on their own and end in ``x``; a starred environment shows the number
    its unstarred sibling last had.
    """
    spark = nodes.sparkSession
    kinds = F.broadcast(env_catalog(spark).select("marker", "class", "counter"))
    # Rows are dealt out and sorted once, before anything is counted: flags and totals need not be held by the sort.
    n = nodes.join(kinds, "marker", "left").repartition("doc_id").sortWithinPartitions("doc_id", "pos")
    level = F.coalesce(*[F.when(F.col("counter") == m, F.lit(k)) for k, m in enumerate(SECTION_LEVELS)])
    doc = W.partitionBy("doc_id").orderBy("pos")
    run, whole = doc.rowsBetween(W.unboundedPreceding, W.currentRow), doc.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    depth = range(len(SECTION_LEVELS))
    n = n.withColumn("level", level)
    plain = ~F.col("star") & F.col("level").isNotNull()
    count = lambda flag: F.sum(F.when(flag, 1).otherwise(0)).over(run)
    # Running totals, then their values at the last reset: all windows have one order, so one sort serves all.
    n = n.withColumns(
        {"toplevel": F.when(F.max(F.col("level") == 0).over(whole), 0).otherwise(1)}
        | {f"t{j}": count(plain & (F.col("level") == j)) for j in depth}
        | {f"s{j}": count(F.col("star") & (F.col("level") == j)) for j in depth}
        | {f"t_{k}": count(~F.col("star") & (F.col("counter") == k)) for k in ENV_COUNTERS}
    )
    at_reset = lambda total, reset: F.coalesce(F.max(F.when(reset, F.col(total))).over(run), F.lit(0))
    n = n.withColumns(
        {f"c{j}": F.col(f"t{j}") - at_reset(f"t{j}", plain & (F.col("level") < j)) for j in depth}
        | {f"c_{k}": F.col(f"t_{k}") - at_reset(f"t_{k}", plain & (F.col("level") <= F.col("toplevel") + 1)) for k in ENV_COUNTERS}
    )
    n = n.withColumn("c_env", F.coalesce(*[F.when(F.col("counter") == k, F.col(f"c_{k}")) for k in ENV_COUNTERS]))
    text = lambda c: F.col(c).cast("string")
    levels = F.array(*[F.struct(F.lit(j).alias("j"), text(f"c{j}").alias("c"), text(f"s{j}").alias("s")) for j in range(len(SECTION_LEVELS))])
    parts = F.transform(F.filter(levels, lambda x: (x["j"] >= F.col("toplevel")) & (x["j"] <= F.col("level"))), lambda x: F.when(F.col("star") & (x["j"] == F.col("level")), F.concat(x["s"], F.lit("x"))).otherwise(x["c"]))
    top = F.when(F.col("toplevel") == 0, F.col("c0")).otherwise(F.col("c1"))
    second = F.when(F.col("toplevel") == 0, F.col("c1")).otherwise(F.col("c2"))
    env_code = F.concat_ws(".", top.cast("string"), F.when(second > 0, second.cast("string")), text("c_env"))
    code = F.when(F.col("level").isNotNull(), F.array_join(parts, ".")).when(F.col("counter").isin(*ENV_COUNTERS), env_code)
    numbered = n.withColumn("codenumber", code).select(*nodes.columns, "class", "counter", "codenumber")
    return numbered


def item_codes(nodes: DataFrame) -> DataFrame:
    """(doc_id, pos, code) of list items: their place in the list, after those of the lists around it."""
    return nodes.where("marker = 'item'").select("doc_id", "pos", F.col("place").alias("code"))


def assign_ids(numbered: DataFrame) -> DataFrame:
    """``out_id``: the label, or marker and number, or the node's hash."""
    made = F.when(F.coalesce("label", F.lit("")) != "", F.col("label")).when(F.col("codenumber").isNotNull(), F.concat_ws("-", "marker", F.replace(F.col("codenumber"), F.lit("."), F.lit("-"))))
    return numbered.withColumn("out_id", F.coalesce(made, F.col("node_id")))


def labels(numbered: DataFrame) -> DataFrame:
    """(doc_id, label, pos, marker, codenumber), first node of a label; ``x`` without a number."""
    first = numbered.where("label is not null and label <> ''").groupBy("doc_id", "label").agg(F.min(F.struct("pos", "marker", "codenumber", "node_id")).alias("n"))
    return first.select("doc_id", "label", "n.pos", "n.marker", F.coalesce("n.codenumber", F.lit("x")).alias("codenumber"), "n.node_id")


def nearest_number(numbered: DataFrame) -> DataFrame:
    """(doc_id, pos, near): the node's own number, or that of its nearest numbered ancestor."""
    known = numbered.where("codenumber is not null").select("doc_id", F.col("pos").alias("at"), F.col("codenumber").alias("number"))
    return numbered.select("doc_id", "pos", F.col("near").alias("at")).join(known, ["doc_id", "at"]).select("doc_id", "pos", F.col("number").alias("near"))


def containing_section(nodes: DataFrame) -> DataFrame:
    """(doc_id, pos, section_pos): the innermost heading around a node."""
    return nodes.where("section is not null").select("doc_id", "pos", F.col("section").alias("section_pos"))
