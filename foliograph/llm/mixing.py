"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only.

Every document draws an exponential key ``-ln(u) / w`` from a hash of its id and text,
where ``w`` is its quality weight: sorted by key, the documents of a source come in the
order of weighted sampling without replacement. A source first gives as many complete
epochs as its budget holds; the rest of the budget goes to a fractional selection, the
documents of smallest key, prefix-summed up to the budget.

The prefix sum never sorts a whole source in one place. Keys fall into 256 slots and
each slot into 256 again (a monotone function of the key); slot totals locate the slot
in which the budget ends, and only the documents of that slot are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_RE, materialize

#: Weights by the source's rank in code-point order, repeating.
SOURCE_WEIGHTS = (3, 1, 2)
#: All targets together, as a share of all sizes.
TOTAL_SHARE = 1.5
#: A source's target stops at this many times its size.
MAX_EPOCHS = 2
SLOTS = 256
LEAST_WEIGHT = 0.25


def text_size(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """``LEAST_WEIGHT`` to 1: rises with the share of letters and spaces in the text."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\x20]+", ""))
    share = F.try_divide(letters.cast("double"), F.length(text))
    return F.lit(LEAST_WEIGHT) + F.lit(1 - LEAST_WEIGHT) * F.coalesce(share, F.lit(0.0))


def source_targets(totals: DataFrame, weights=SOURCE_WEIGHTS, share=TOTAL_SHARE, max_epochs=MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Water filling in closed form: with sources in order of ``cap / weight``, the first k
    are at their caps for the first k where the level of the others does not pass the
    next source's ratio. One row per source takes part, never one per document.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), rank + 1)
    s = totals.withColumn("wt", weight).withColumn("cap", F.col("source_size") * max_epochs)
    s = s.withColumn("ratio", F.col("cap") / F.col("wt"))
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = (
        s.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("wt_left", F.sum("wt").over(everything) - F.coalesce(F.sum("wt").over(before), F.lit(0.0)))
        .withColumn("goal", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("goal") - F.col("cap_before")) / F.col("wt_left"))
        .withColumn("final_level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    )
    target = F.least(F.col("cap").cast("double"), F.col("final_level") * F.col("wt"))
    return s.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights=SOURCE_WEIGHTS,
    share: float = TOTAL_SHARE,
    max_epochs: int = MAX_EPOCHS,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """How many words of each document a mix takes.

    Returns the ``keep`` columns, ``size``, ``source``, ``source_size``, ``target``,
    ``epochs`` (complete passes over the source) and ``taken`` (words, repeats counted).
    Taken words of a source add up to its target, rounded: the last document selected
    is cut where the budget ends, and nothing else is cut.

    Null or empty texts have size 0 and are taken 0 times; a very long text counts whole. The null source is a source of
    its own, last in rank. Equal rows draw equal keys and are interchangeable; equal keys
    of other rows are ordered by id. An empty table gives an empty result. Only
    ``doc_id``, ``text``, ``source`` and the ``keep`` columns are read; other columns,
    whatever their names, are ignored. Results depend on nothing but the rows.
    """
    text = F.col("text")
    seed = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.md5(F.coalesce(text, F.lit("")))))
    u = (F.conv(F.substring(seed, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))
    slim = docs.select(
        *[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)],
        "source",
        text_size(text).alias("size"),
        (-F.ln(u) / quality_weight(text)).alias("key"),
        seed.alias("seed"),
    )
    # Draws of the least weight fall evenly into the slots; no slot gets more than 1 / LEAST_WEIGHT times its share of any.
    level = F.least(F.floor((F.lit(1.0) - F.exp(F.col("key") * -LEAST_WEIGHT)) * (SLOTS * SLOTS)), F.lit(SLOTS * SLOTS - 1)).cast("int")
    slim = materialize(slim.withColumn("slot1", level / SLOTS).withColumn("slot1", F.col("slot1").cast("int")).withColumn("slot2", level % SLOTS), "mix-docs")

    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    budget = F.floor(F.col("target") + 0.5)
    plan = source_targets(totals, weights, share, max_epochs).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    plan = materialize(plan.withColumn("rest", (budget - F.col("epochs") * F.col("source_size")).cast("long")), "mix-plan")

    def ends_in(docs: DataFrame, slot: str, place: DataFrame) -> DataFrame:
        """The slot in which each source's budget ends, and the words before it."""
        sums = docs.groupBy("source", slot).agg(F.sum("size").alias("words"))
        run = W.partitionBy("source").orderBy(slot).rowsBetween(W.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0))).withColumnRenamed("source", "s")
        inside = (F.col("before") + F.col("base") <= F.col("rest")) & (F.col("before") + F.col("base") + F.col("words") > F.col("rest"))
        hit = place.join(sums, F.col("source").eqNullSafe(F.col("s"))).where(inside)
        return hit.groupBy("source").agg(F.min(slot).alias(slot), F.min(F.col("before") + F.col("base")).alias("base"))

    first = materialize(ends_in(slim, "slot1", plan.select("source", "rest", F.lit(0).cast("long").alias("base"))), "mix-slot1")
    at1 = plan.select("source", "rest").join(first.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    inner = slim.select("source", "size", "slot1", "slot2").join(
        first.select(F.col("source").alias("s"), F.col("slot1").alias("end1")), F.col("source").eqNullSafe(F.col("s")) & (F.col("slot1") == F.col("end1"))
    )
    second = ends_in(inner, "slot2", at1)
    ends = plan.join(first.select(F.col("source").alias("s"), F.col("slot1").alias("end1")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    ends = ends.join(second.select(F.col("source").alias("s"), F.col("slot2").alias("end2"), "base"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    ends = materialize(ends.withColumnRenamed("source", "s"), "mix-ends")

    placed = slim.join(ends, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    here, end = F.struct("slot1", "slot2"), F.struct(F.col("end1"), F.col("end2"))
    # A source whose budget ends in no slot takes nothing more (its rest is 0) or, through empty slots, everything.
    part = F.when(F.col("end1").isNull(), F.when(F.col("rest") > 0, "all").otherwise("none")).when(here == end, "some").when(here < end, "all").otherwise("none")
    placed = placed.withColumn("part", part)
    run = W.partitionBy("source").orderBy("key", "k_0", "seed").rowsBetween(W.unboundedPreceding, -1)
    some = placed.where(F.col("part") == "some").withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    some = some.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before"))).cast("long")).drop("before")
    others = placed.where(F.col("part") != "some").withColumn("extra", F.when(F.col("part") == "all", F.col("size")).otherwise(0).cast("long"))
    return some.unionByName(others).select(
        *[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)],
        "size",
        *([] if "source" in keep else ["source"]),
        "source_size",
        "target",
        "epochs",
        (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"),
    )


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(concat_ws(':', doc_id::VARCHAR, md5(coalesce(text, '')))) AS seed,
    0.25::DOUBLE + 0.75::DOUBLE * coalesce(length(regexp_replace(text, '[^\p{L}\x20]+', '', 'g'))::DOUBLE / nullif(length(text), 0), 0.0) AS w
  FROM documents),
k AS (SELECT *, -ln((('0x' || substr(seed, 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE) / w AS key FROM d),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
s1 AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS wt FROM s0),
s2 AS (SELECT *, source_size * 2 AS cap, (source_size * 2)::DOUBLE / wt AS ratio FROM s1),
s3 AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(wt) OVER () - coalesce(sum(wt) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM s2),
s4 AS (SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS final_level FROM s3),
s5 AS (SELECT source, source_size, least(cap::DOUBLE, final_level * wt) AS target FROM s4),
s6 AS (SELECT *, floor(target + 0.5)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM s5),
p AS (SELECT k.doc_id, k.size, s6.source_size, s6.target, s6.epochs, s6.budget - s6.epochs * s6.source_size AS rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id NULLS FIRST, seed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM k JOIN s6 ON k.source IS NOT DISTINCT FROM s6.source)
SELECT doc_id, size, source_size, target, epochs * size + greatest(0, least(size, rest - before)) AS taken FROM p
"""
