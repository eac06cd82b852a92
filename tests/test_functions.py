import pytest
from hypothesis import given
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliograph.functions import markup, rules, scanner, text, units


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ("", "")),
        ("  {a}b", ("{a}", "b")),
        ("{a{b}c}d", ("{a{b}c}", "d")),
        (r"{a\}b}c", (r"{a\}b}", "c")),
        (r"{a\\}b", (r"{a\\}", "b")),
        ("{open", ("", "open")),
        ("plain {x}", ("", "plain {x}")),
    ],
)
def test_first_group(source, want):
    assert scanner.first_group(source) == want


def test_strip_groups():
    assert scanner.strip_groups("{{text}}}") == "text}"
    assert scanner.strip_groups("{{a}}", depth=1) == "{a}"
    assert scanner.expand_conditionals(r"a\ifthenelse{true}{x{y}}{z}b\ifthenelse{false}{x}{z}") == "ax{y}bz"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="{}\\ab ", max_size=30))
def test_group_and_rest_make_the_text(t):
    group, rest = scanner.first_group(t)
    if group:
        assert group + rest == t.lstrip()
        assert group[0] == "{" and group[-1] == "}"


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


@pytest.mark.parametrize(
    ("f", "source", "want"),
    [
        (text.file_stub, "a/b.c/d/e.f.g", "e.f"),
        (text.file_stub, "plain", "plain"),
        (text.kill_comments, "a % note\nb\n% whole line\nc \\% d", "a b\nc \\% d"),
        (text.unicode_to_tex, "é ß — ’", "\\'e {\\ss} -- '"),
        (text.entities_to_tex, "caf&eacute; &ouml; &oslash; &#39;", "caf\\'e \\\"o {\\o} '"),
        (text.to_ascii, "caf&eacute; \\alpha \\leq 3", "cafe alpha <= 3"),
        (text.safe_name, " On  the  (main) caf\u00e9 ", "On_the__main__cafe"),
        (lambda c: text.safe_name(c, as_id=True), "main", "mainmain"),
        (lambda c: text.safe_name(c, as_id=True), "9 main", "x9_main"),
        (text.title_key, "The Properties of Classes", "propertyclass"),
        (text.title_key, "Properties of classes.", "propertyclass"),
        (text.smart_quotes, '"a" ``b\'\'', "“a” “b”"),
        (text.smart_dashes, "a---b 1--2", "a—b 1–2"),
        (text.escape_lt, "a<b & c>d", "a&lt;b &amp; c&gt;d"),
        (text.code_ordinal, "3.1.4x", 3 * 100.0**4 + 100.0**3 + 4 * 100.0**2),
        (text.code_ordinal, "", 0.0),
        (units.quantity, "\\SI{3}{kg.m/s^2}", '<quantity><mag>3</mag><unit prefix="kilo" base="gram"/><unit base="meter"/><per base="second" exp="2"/></quantity>'),
        (units.quantity, "3 kg", None),
    ],
)
def test_columns(spark, f, source, want):
    assert column(spark, [source], f) == [want]


@pytest.mark.parametrize(("source", "want"), [("{R}ough {\\\"a}", "Rough \\\"a"), ("x{ABC} y", "xABC y"), ("\\sqrt{x}", "\\sqrt{x}"), ("a{  }b", "ab"), ("{a{B}c", "{a{B}c")])
def test_silly_braces(source, want):
    assert text.without_silly_braces(source) == want


def test_rescaled(spark):
    assert column(spark, ['<svg height="5.5pt" width="10pt">', "<svg>"], text.rescale_svg) == ['<svg height="7.7pt" width="14.0pt">', "<svg>"]


def test_content_id_of_null(spark):
    assert column(spark, [None, ""], text.content_id)[0] == column(spark, [""], text.content_id)[0]


@pytest.mark.parametrize("table", [text.ENTITY_RULES, text.COMMENT_RULES, markup.ACCENT_RULES, markup.spacing_rules("ptx")])
def test_patterns_compile(spark, table):
    for pattern, replacement in table:
        assert column(spark, ["abc"], lambda c, p=pattern, r=replacement: rules.apply_rules(c, [(p, r)])) is not None


def test_scanner_columns(spark):
    got = column(spark, ["{a}b", None], scanner.split_group)
    assert (got[0]["group"], got[0]["rest"]) == ("{a}", "b")
    assert column(spark, ["{{x}}", None], scanner.strip_outer) == ["x", None]
    assert column(spark, ["\\ifthenelse{true}{1}{2}"], scanner.choose_branches) == ["1"]
