"""Ordered rewrite rules as data, folded into one Column expression.

A rule is (pattern, replacement) in Java's syntax; later rules see what earlier ones left,
so order is part of a rule set. ``literal`` sets use plain ``replace``, which needs no
regular expressions.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = Iterable[tuple[str, str]]


def apply_rules(text: Column, rules: Rules) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def apply_literals(text: Column, pairs: Rules) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def sql_literals(column: str, pairs: Rules) -> str:
    """The same replacements as nested SQL calls, for oracles."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    for old, new in pairs:
        column = f"replace({column}, {quote(old)}, {quote(new)})"
    return column


def sql_rules(column: str, rules: Rules) -> str:
    """The same rules for RE2 (no lookaround): ``$1`` becomes ``\\1``, all matches are replaced."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    for pattern, replacement in rules:
        out = replacement.replace("\\\\", "\0").replace("\\$", "\1").replace("$", "\\").replace("\0", "\\\\").replace("\1", "$")
        column = f"regexp_replace({column}, {quote(pattern)}, {quote(out)}, 'g')"
    return column


RULE_SCHEMA = "pack string, stage string, seq int, pattern string, replacement string"


def apply_packs(docs: DataFrame, rules: DataFrame, stage: str, pack: str = "pack", text: str = "text") -> DataFrame:
    """Documents with the rules of their own pack applied, in the order of ``seq``, at run time.

    ``rules`` has (pack, stage, seq, pattern, replacement) in Java's syntax. Which pack a document has is in its
    column ``pack``; without one, or one without rules for the stage, the text stays. Rules are folded over
    an array in the plan, so packs are data: no code depends on them.
    """
    own = rules.where(F.col("stage") == stage).groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("seq", "pattern", "replacement"))).alias("__rules"))
    joined = docs.join(own.withColumnRenamed("pack", "__pack"), F.col(pack) == F.col("__pack"), "left")
    folded = F.expr(f"aggregate(coalesce(__rules, array()), `{text}`, (t, r) -> regexp_replace(t, r.pattern, r.replacement))")
    return joined.withColumn(text, folded).drop("__rules", "__pack")
