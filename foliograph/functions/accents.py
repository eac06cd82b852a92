"""Accented letters: TeX signs, entity names and Unicode marks of one table, everything else by rule."""

from __future__ import annotations

import unicodedata

# Accent as TeX writes it, name of its entities, combining mark of Unicode.
ACCENTS = [
    ("'", "acute", "\u0301"), ("`", "grave", "\u0300"), ("^", "circ", "\u0302"), ("~", "tilde", "\u0303"), ('"', "uml", "\u0308"), (".", "dot", "\u0307"),
    ("=", "macr", "\u0304"), ("v", "caron", "\u030c"), ("c", "cedil", "\u0327"), ("u", "breve", "\u0306"), ("H", "dblac", "\u030b"), ("r", "ring", "\u030a"), ("k", "ogon", "\u0328"),
]


def accented() -> list[tuple[str, str, str]]:
    """(character, base letter, TeX sign) of the Latin letters with one of the accents."""
    sign = {mark: tex for tex, _, mark in ACCENTS}
    out = []
    for code in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and parts[0].isascii() and parts[1] in sign:
            out.append((chr(code), parts[0], sign[parts[1]]))
    return out


def tex_accent(sign: str, letter: str) -> str:
    r"""``\'e``, ``\v{s}``, ``\'{\i}``."""
    if letter in "ij":
        return f"\\{sign}{{\\{letter}}}"
    return f"\\{sign}{{{letter}}}" if sign.isalpha() else f"\\{sign}{letter}"
