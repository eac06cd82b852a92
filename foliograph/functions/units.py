r"""Quantities ``\SI{magnitude}{units}`` as markup with unit elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit symbol, prefix, base.
UNITS = [
    ("g", "", "gram"), ("m", "", "meter"), ("dm", "deci", "meter"), ("cm", "centi", "meter"), ("mm", "milli", "meter"), ("\\celsius", "", "celsius"),
    ("s", "", "second"), ("\\second", "", "second"), ("min", "", "minute"), ("atm", "", "atmosphere"), ("W", "", "watt"), ("MW", "mega", "watt"),
    ("J", "", "joule"), ("K", "", "kelvin"), ("yr", "", "year"), ("\\%", "", "percent"), ("ha", "", "hectare"), ("MJ", "mega", "joule"),
    ("kg", "kilo", "gram"), ("Mg", "mega", "gram"), ("l", "", "liter"), ("L", "", "liter"), ("ml", "milli", "liter"), ("mL", "milli", "liter"),
    ("mg", "milli", "gram"), ("ng", "nano", "gram"), ("\\micro\\gram", "micro", "gram"),
]


def _element(unit: Column, tag: str) -> Column:
    table = F.create_map(*[F.lit(x) for s, p, b in UNITS for x in (s, (f'prefix="{p}" ' if p else "") + f'base="{b}"')])
    symbol, power = F.element_at(F.split(unit, r"\^"), 1), F.try_element_at(F.split(unit, r"\^"), F.lit(2))
    inside = F.coalesce(F.try_element_at(table, symbol), F.lit("unknown"))
    return F.concat(F.lit(f"<{tag} "), inside, F.coalesce(F.concat(F.lit(' exp="'), power, F.lit('"')), F.lit("")), F.lit("/>"))


def unit_markup(units: Column) -> Column:
    """``kg.m/s^2``: factors joined by dots; everything after the first slash divides."""
    top, bottom = F.element_at(F.split(units, "/"), 1), F.array_join(F.slice(F.split(units, "/"), 2, F.size(F.split(units, "/"))), ".")
    part = lambda x, tag: F.array_join(F.transform(F.filter(F.split(x, r"\."), lambda u: u != ""), lambda u: _element(u, tag)), "")
    return F.concat(part(top, "unit"), part(bottom, "per"))


def quantity(si: Column) -> Column:
    r"""Markup of one ``\SI{m}{u}``; null if it is none."""
    pattern = r"^\\SI\{([^{}]*)\}\{([^{}]*)\}$"
    return F.when(
        si.rlike(pattern),
        F.concat(F.lit("<quantity><mag>"), F.regexp_extract(si, pattern, 1), F.lit("</mag>"), unit_markup(F.regexp_extract(si, pattern, 2)), F.lit("</quantity>")),
    )
