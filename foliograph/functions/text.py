"""Text functions on columns: hashes, names, transliteration, keys, clean-up."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .accents import ACCENTS, accented, tex_accent
from .rules import apply_literals, apply_rules
from .scanner import column, group_ends

# Accented letters and typographic characters as markup.
UNICODE_TO_TEX = [
    ("−", "-"), ("’", "'"), ("“", "``"), ("”", "''"), ("—", "--"), ("\u00a0", " "), ("±", "\\pm"), ("´", "'"),
    ("ß", "{\\ss}"), ("ł", "{\\l}"), ("á", "\\'a"), ("à", "\\`a"), ("ä", '\\"a'), ("ã", "\\~a"),
    ("é", "\\'e"), ("è", "\\`e"), ("ë", '\\"e'), ("É", "\\'E"), ("ż", "\\.z"), ("í", "\\'{\\i}"), ("î", "\\^{\\i}"),
    ("Á", "\\'{A}"), ("ń", "\\'n"), ("ñ", "\\~n"), ("ó", "\\'o"), ("ø", "{\\o}"), ("ö", '\\"o'), ("ú", "\\'u"), ("ü", '\\"u'),
    ("š", "\\v{s}"), ("Š", "\\v{S}"), ("ş", "\\c{s}"), ("ç", "\\c{c}"), ("č", "\\v{c}"), ("ć", "\\'c"), ("ř", "\\v{r}"),
]

# Character entities as markup.
ENTITIES_TO_TEX = [
    ("&#xc1;", "\\'A"), ("&#xc4;", '\\"A'), ("&#xc8;", "\\`E"), ("&#xc9;", "\\'E"), ("&#xd6;", '\\"O'), ("&#xe1;", "\\'a"), ("&#xe4;", '\\"a'),
    ("&#xe8;", "\\`e"), ("&#xe9;", "\\'e"), ("&#xf3;", "\\'o"), ("&#xf8;", "{\\o}"), ("&#xfa;", "\\'u"), ("&#xfc;", '\\"u'), ("&#xf1;", "\\~n"),
    ("&#355;", "\\c{t}"), ("&#169;", "\\~u"), ("&#259;", "\\u{a}"), ("&#287;", "\\u{g}"), ("&#281;", "\\c{e}"), ("&#301;", "\\u{\\i}"), ("&#350;", "\\c{S}"),
    ("&#351;", "\\c{s}"), ("&#x107;", "\\'c"), ("&#x10c;", "\\v{C}"), ("&#x10d;", "\\v{c}"), ("&#x11a;", "\\v{E}"), ("&#x11b;", "\\v{e}"), ("&#x141;", "\\L"),
    ("&#x160;", "\\v{S}"), ("&#x161;", "\\v{s}"), ("&#x27;", "'"), ("&iuml;", '\\"{\\i}'), ("&szlig;", "{\\ss}"), ("&#223;", "{\\ss}"), ("&ndash;", "--"),
    ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&iacute;", "\\'{\\i}"), ("&oslash;", "{\\o}"), ("&Oslash;", "{\\O}"),
]
#: Entities of a letter and an accent's name follow from the table of accents.
ENTITY_RULES = [(f"&([A-Za-z]){name};", (f"\\\\{sign}{{$1}}" if sign.isalpha() else f"\\\\{sign}$1")) for sign, name, _ in ACCENTS]

# Greek letters, which stand for themselves in ASCII.
GREEK = "alpha beta gamma delta epsilon zeta eta theta mu nu tau rho sigma xi kappa iota lambda upsilon omicron phi chi omega psi pi".split()
# Macros with another form in ASCII.
ASCII_FORMS = {
    "ge": " >= ", "geq": " >= ", "le": " <= ", "leq": " <= ", "times": " x ", "varphi": "phi", "varrho": "rho", "varnu": "nu", "varepsilon": "epsilon",
    "pm": "+-", "ell": "l", "i": "i", "l": "l", "L": "L", "o": "o", "oe": "oe", "ss": "ss", "cprime": "'", "vert": "|",
}
# Macros that leave nothing in ASCII.
ASCII_DELETED = "left right rm it sl bf tt em emph Bbb mathbb bold scr roman Cal cal mathcal mathrm mathit mathsl mathbf mathsf mathtt germ frak mathfrak v u c H".split()
#: Macros of letters and accents, which take the blank after them along.
EATS_BLANK = ("ell", "i", "l", "L", "o", "oe", "ss", "cprime", "vert", "left", "right", "v", "u", "c", "H")

# Numbers as words; openings and words without weight; spellings that count as equal.
NUMBER_WORDS = "one two three four five six seven eight nine ten".split()
ROMAN_PARTS = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "iiii": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12}
TITLE_OPENINGS = ["a note on", "notes on", "remark on", "on the", "on"]
TITLE_STOP_WORDS = ["a", "an", "the", "on", "in", "of", "at", "for"]
SPELLINGS = [
    ("mueller", "muller"), ("goedel", "godel"), ("moebius", "mobius"), ("schroed", "schrod"), ("hoelder", "holder"), ("kaehler", "kahler"),
    ("alogue", "alog"), ("colour", "color"), ("flavour", "flavor"), ("tumour", "tumor"), ("rigour", "rigor"), ("mould", "mold"),
    ("modell", "model"), ("travell", "travel"), ("cancell", "cancel"), ("annell", "annel"), ("avell", "avel"), ("biass", "bias"),
    ("disc", "disk"), ("cheque", "check"), ("centre", "center"), ("fibre", "fiber"),
    ("alise", "alize"), ("alisi", "alizi"), ("orisa", "oriza"), ("orise", "orize"), ("orisi", "orizi"), ("erisa", "eriza"), ("erise", "erize"), ("erisi", "erizi"),
    ("randomis", "randomiz"), ("itemis", "itemiz"), ("cypher", "cipher"), ("grey", "gray"), ("gramme", "gram"), ("neurone", "neuron"), ("sceptic", "skeptic"),
]


def content_id(text: Column, kind: str = "") -> Column:
    """SHA-1 of the text and its kind; null counts as empty."""
    return F.sha1(F.encode(F.concat(F.coalesce(text, F.lit("")), F.lit(kind)), "utf-8"))


def file_stub(path: Column) -> Column:
    """``a/b.c/d/e.f.g`` gives ``e.f``."""
    return F.regexp_replace(F.regexp_replace(path, r"\.[^./]*$", ""), r"(?s)^.*/", "")


#: Characters as markup: accented Latin letters by their decomposition, others by the table.
_MARKUP = {ord(c): tex_accent(sign, letter) for c, letter, sign in accented()} | {ord(c): x for c, x in UNICODE_TO_TEX}
_ENTITY = re.compile(r"&#?[0-9A-Za-z]+;")
_ENTITIES = dict(ENTITIES_TO_TEX) | {f"&{letter}{name};": f"\\{sign}{{{letter}}}" if sign.isalpha() else f"\\{sign}{letter}" for sign, name, _ in ACCENTS for letter in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" if f"&{letter}{name};" not in dict(ENTITIES_TO_TEX)}


def _as_markup(text: str) -> str:
    return text if text.isascii() else text.translate(_MARKUP)


def unicode_to_tex(text: Column) -> Column:
    """Typographic characters and accented Latin letters as markup, by one table of characters."""
    return column(_as_markup)(text)


def entities_to_tex(text: Column) -> Column:
    return F.when(text.contains("&"), apply_rules(apply_literals(text, ENTITIES_TO_TEX), ENTITY_RULES)).otherwise(text)


_FORMS = {g: g for g in GREEK} | ASCII_FORMS | dict.fromkeys(ASCII_DELETED, "")
_ACCENT = re.compile(r"\\[\^'`\x22~=-][ \t\n\r\f\v]*|\\\.(?=[A-Za-z])")
_ALONE = re.compile(r"\{\\([A-Za-z]+)[ \t\n\r\f\v]*\}")
_MACRO = re.compile(r"\\([A-Za-z]+)([ \t\n\r\f\v]*)")
_BRACED = re.compile(r"\{([^}])\}")
_BLANKS = re.compile(r"[ \t\n\r\f\v]+")


def _ascii_form(m: re.Match) -> str:
    name, blank = m.groups()
    follows = m.string[m.end() : m.end() + 1]
    if name in EATS_BLANK and blank:
        # Before a capital the last blank stays.
        blank = blank[-1] if follows.isascii() and follows.isupper() else ""
    return _FORMS.get(name, f"\\{name}") + blank


def _as_ascii(text: str) -> str:
    """Macros looked up one by one in a table of ASCII forms; unknown ones stay as they are.

    A macro of a letter or accent takes the blank after it along, unless a capital follows;
    one that is alone in braces takes none.
    """
    if "\\" in text:
        text = _ALONE.sub("\\\\\\1\1", _ACCENT.sub("", text))
        text = _MACRO.sub(_ascii_form, text).replace("\1", "")
    return _BLANKS.sub(" ", _BRACED.sub(r"\1", _BRACED.sub(r"\1", text)))


def ascii_text(text: str) -> str:
    """A text in ASCII: entities, letters and macros by what they stand for, white space as single blanks."""
    if "&" in text:
        text = _ENTITY.sub(lambda m: _ENTITIES.get(m.group(0), m.group(0)), text)
    return _as_ascii(_as_markup(text))


def tex_to_ascii(text: Column) -> Column:
    return column(_as_ascii)(text)


def to_ascii(text: Column) -> Column:
    return column(ascii_text)(text)


def rearrange_subscripts(text: Column) -> Column:
    """``x^2_1`` as ``x_1^2``."""
    part = r"(\{[^{}]+\}|[a-zA-Z0-9]|\\[a-zA-Z]+)"
    return F.regexp_replace(text, rf"\^{part}_{part}", "_$2^$1")


UNSAFE = r"[: ~!@#$%^&*|(){}<>,+=;/\\`'\x22.]"


def safe_name(text: Column, as_id: bool = False) -> Column:
    name = F.regexp_replace(to_ascii(F.trim(F.regexp_replace(text, r"\s+", " "))), UNSAFE, "_")
    if as_id:
        name = F.regexp_replace(F.regexp_replace(name, r"\bmain\b", "mainmain"), r"^([^a-zA-Z])", "x$1")
    return name


_OPENING = re.compile(rf"^(?:{'|'.join(TITLE_OPENINGS)}) ")
_DIGITS = {w: str(n) for n, w in enumerate(NUMBER_WORDS, 1)}
_SCRIPTS = re.compile(r"\^(\{[^{}]+\}|[a-zA-Z0-9]|\\[a-zA-Z]+)_(\{[^{}]+\}|[a-zA-Z0-9]|\\[a-zA-Z]+)")
_SIGNS = re.compile(r"'s(?![A-Za-z0-9_])|\\(?:frac|backslash)(?![A-Za-z0-9_])|['`^~\x22_{}$\\:;,.()]")
#: Plural endings after enough of a word, and what replaces them.
_PLURALS = [(re.compile("[a-z]{3}(?:x|ch|sh|ss)es$"), 2, ""), (re.compile("[a-z]{4}ies$"), 3, "y"), (re.compile("[a-z]{3}[a-rt-z]s$"), 1, "")]


def singular(word: str) -> str:
    """A long word without its plural ending."""
    for ending, cut, left in _PLURALS:
        if ending.search(word):
            return word[:-cut] + left
    return word


def title_words(title: str) -> list[str]:
    """The words of a title that carry weight, in the singular, numbers as digits.

    Hyphens part words but for the prefix ``non-`` and the like; accents count as none.
    """
    t = ascii_text(_SCRIPTS.sub(r"_\2^\1", re.sub(r"\\sb(?![A-Za-z0-9_])", "_", title))).lower()
    t = _OPENING.sub("", re.sub("[^a-z0-9]+", " ", _SIGNS.sub("", t).replace("on-", "on")).strip())
    words = t.split(" ")
    words = [str(ROMAN_PARTS[w]) if k and words[k - 1] == "part" and w in ROMAN_PARTS else w for k, w in enumerate(words)]
    return [_DIGITS.get(w) or singular(w) for w in words if w and w not in TITLE_STOP_WORDS]


def key_of_title(title: str) -> str:
    """A reduced form under which equal titles are equal: its words without blanks, in one spelling."""
    key = " ".join(title_words(title))
    for old, new in SPELLINGS:
        key = key.replace(old, new)
    return key.replace(" ", "")


def title_key(text: Column) -> Column:
    return column(key_of_title)(text)


# A comment runs from an unescaped % to the end of its line; one that fills its line takes the line along.
COMMENT_RULES = [(r"\\%", "\u0001"), (r"%+", "%"), (r"(?m)^[ \t]*%[^\n]*\n", ""), (r"%[^\n]*\n[ \t]*", ""), (r"%[^\n]*$", ""), ("\u0001", r"\\%")]


def kill_comments(text: Column) -> Column:
    return apply_rules(text, COMMENT_RULES)


def smart_dashes(text: Column) -> Column:
    return apply_rules(text, [(r"([^-])---([^-])", "$1\u2014$2"), (r"--", "\u2013")])


def smart_quotes(text: Column) -> Column:
    return apply_rules(text, [(r"``", "\u201c"), (r"''", "\u201d"), (r"(^|[\s(])\x22", "$1\u201c"), (r"\x22", "\u201d")])


def escape_lt(text: Column) -> Column:
    return apply_rules(text, [(r"&", "&amp;"), (r"<", "&lt;"), (r">", "&gt;")])


def integer_percent(value: Column, scale: Column | float = 1.0) -> Column:
    return (F.lit(100.0) * value.cast("double") / F.lit(scale)).cast("int") if not isinstance(scale, Column) else (F.lit(100.0) * value.cast("double") / scale).cast("int")


def code_ordinal(code: Column, scale: int = 100, depth: int = 4) -> Column:
    """A number by which codes such as ``3.1.4x`` sort; 0 without a code."""
    parts = F.transform(F.split(code, r"\."), lambda p: F.coalesce(F.try_to_number(F.nullif(F.regexp_replace(p, "[^0-9]", ""), F.lit("")), F.lit("9999999999")).cast("double"), F.lit(0.0)))
    weighted = F.transform(parts, lambda p, i: p * F.pow(F.lit(float(scale)), F.lit(depth) - i))
    return F.when(F.coalesce(code, F.lit("")) == "", F.lit(0.0)).otherwise(F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x))


def text_before(text: Column, *targets: str) -> Column:
    """(before, rest): the text up to the first of several targets, which begins the rest; all of it without one."""
    at = F.array_min(F.filter(F.array(*[F.locate(t, text) for t in targets]), lambda k: k > 0))
    return F.struct(F.when(at.isNull(), text).otherwise(F.substring(text, 1, at - 1)).alias("before"), F.when(at.isNull(), "").otherwise(text.substr(at, F.length(text))).alias("rest"))


def text_up_to(text: Column, target: str) -> Column:
    """The text up to and with the first target; empty without one."""
    at = F.locate(target, text)
    return F.when(at > 0, F.substring(text, F.lit(1), at + F.lit(len(target) - 1))).otherwise("")


def has_macro(text: Column, name: str) -> Column:
    r"""Whether ``\name`` occurs as a whole macro."""
    return text.rlike(rf"\\{name}(?![A-Za-z])")


def author_slug(first: Column, last: Column, preferred: Column) -> Column:
    """The name of an author for links: the preferred full name or first and last, as a safe name."""
    return safe_name(F.coalesce(F.nullif(preferred, F.lit("")), F.concat_ws(" ", first, last)))


def rescale_svg(svg: Column, scale: float = 1.4) -> Column:
    """The first height and width in points times ``scale``, exactly; a text without both is left as it is."""
    out = svg
    for name in ("height", "width"):
        value = F.regexp_extract(svg, rf'{name}="([0-9.]+)pt', 1).try_cast("decimal(18,6)") * F.lit(str(scale)).cast("decimal(9,4)")
        # As the shortest decimal with one place at least.
        shown = F.regexp_replace(F.regexp_replace(value.cast("string"), "0+$", ""), r"\.$", ".0")
        cut = F.split(out, rf'{name}="[0-9.]+pt', 2)
        out = F.concat(F.element_at(cut, 1), F.lit(f'{name}="'), shown, F.lit("pt"), F.try_element_at(cut, F.lit(2)))
    return F.coalesce(out, svg)


_QUOTE_ALONE = re.compile(r"'\s*")
_ENTITY_ALONE = re.compile(r"&#?[0-9A-Za-z]+;\s*")
_ACCENTED_ALONE = re.compile(r"\\['`\x22^][A-Za-z]")
_MATH_ALONE = re.compile(r"\$[^$]+\$")


def _silly(before: str, inside: str, after: str) -> bool:
    """Whether braces around ``inside`` change nothing, between the characters before and after them."""
    if not inside.strip():
        return bool(inside)
    if len(inside) == 1 and inside.isascii() and inside.isalnum():
        # One letter: not as the argument of a macro.
        return not (before.isalpha() and before.isascii()) if before else inside.isupper()
    if inside.isascii() and inside.isalpha() and inside.isupper():
        return before == " " or after == " "
    return any(x.fullmatch(inside) for x in (_QUOTE_ALONE, _ENTITY_ALONE, _ACCENTED_ALONE, _MATH_ALONE))


def without_silly_braces(text: str) -> str:
    """A text without braces around one character, capitals or an accented letter, which change nothing."""
    cut = set()
    for start, end in group_ends(text).items():
        if _silly(text[start - 1 : start] if start else "", text[start + 1 : end - 1], text[end : end + 1]):
            cut |= {start, end - 1} if text[start + 1 : end - 1].strip() else set(range(start, end))
    return "".join(c for k, c in enumerate(text) if k not in cut) if cut else text


def remove_silly_braces(text: Column) -> Column:
    return column(without_silly_braces)(text)
