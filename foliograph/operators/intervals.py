"""Subtrees as intervals: a node holds what lies between its own position and that of its last descendant.

Containment is a join on document and block of positions. A block has a fixed number of positions, so what meets
in it is bounded however large a document is; a long interval stands in each of its blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions in a block.
WIDTH = 256


def contained(inner: DataFrame, outer: DataFrame, width: int = WIDTH) -> DataFrame:
    """Each row of ``inner`` (doc_id, pos, ...) with each interval of ``outer`` (doc_id, start, last, ...) that holds it."""
    some = inner.withColumn("__block", F.expr(f"pos div {width}"))
    whole = outer.withColumn("__block", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"last div {width}"))))
    return some.join(whole, ["doc_id", "__block"]).where("pos between start and last").drop("__block")


def innermost(inner: DataFrame, outer: DataFrame, out: str, width: int = WIDTH) -> DataFrame:
    """(doc_id, pos, out): where the innermost of the intervals around each row of ``inner`` starts."""
    return contained(inner.select("doc_id", "pos"), outer.select("doc_id", "start", "last"), width).groupBy("doc_id", "pos").agg(F.max("start").alias(out))
