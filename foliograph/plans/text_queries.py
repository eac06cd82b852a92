"""Queries on texts, titles, names and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import units
from ..functions.rules import sql_literals
from ..operators import content, terms
from ..sources.synthetic import table


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def content_ids(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.content_id(F.col("text"), "text").alias("content_id"))


def lines(spark, sf_dir) -> DataFrame:
    return content.paragraphs(docs(spark, sf_dir), separator=r"\n")


def duplicate_nodes(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def paragraphs(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "content_hash")


def paragraph_tree(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_children"), F.sum(F.length("paragraph")).alias("chars"))


def titles(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"))


TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


def html_entities_to_tex(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha1(X.entities_to_tex(F.col("html"))).alias("tex_sha1"))


def unicode_to_tex(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha1(X.unicode_to_tex(F.col("text"))).alias("tex_sha1"))


def ascii_fold(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha1(X.to_ascii(F.col("html"))).alias("ascii_sha1"))


def safe_names(spark, sf_dir):
    return titles(spark, sf_dir).select("page_id", X.safe_name(F.col("url")).alias("name"))


def file_stub(spark, sf_dir):
    return titles(spark, sf_dir).select("page_id", X.file_stub(F.col("url")).alias("stub"))


def title_key(spark, sf_dir):
    return content.title_pairs(titles(spark, sf_dir).select(F.col("page_id").alias("id"), "title"))


def inline_math(spark, sf_dir):
    return content.inline_math(docs(spark, sf_dir)).withColumn("ordinal", F.col("ordinal").cast("long"))


def kill_comments(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha1(X.kill_comments(F.col("text"))).alias("clean_sha1"))


def smart_punctuation(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha1(X.smart_quotes(X.smart_dashes(F.col("text")))).alias("smart_sha1"))


def lt_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha1(X.escape_lt(F.col("html"))).alias("escaped_sha1"))


def author_match(spark, sf_dir):
    """Customer names of the form ``x y`` against people made from suppliers: initial and affix."""
    names = table(spark, sf_dir, "customer").select(F.concat(F.lit("S "), F.regexp_extract("c_name", "([0-9]+)$", 1)).alias("name"))
    key = F.regexp_extract("s_name", "([0-9]+)$", 1)
    people = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("person_id"), F.lit("Sam").alias("firstname"), F.regexp_replace(key, "^0+", "").alias("lastname"))
    return content.author_matches(names, people)


def term_links(spark, sf_dir):
    wanted = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("term")).where("term rlike '^[a-z]{4,}$'").distinct()
    return terms.link_terms(docs(spark, sf_dir), wanted).groupBy("term").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_links"))


def si_units(spark, sf_dir):
    si = F.format_string("\\SI{%d}{kg.cm^2/s}", "p_size")
    return table(spark, sf_dir, "part").select("p_partkey", units.quantity(si).alias("quantity"))


def session_cells(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), F.col("text").alias("line"), "role")
    cells = content.session_cells(rows, F.col("role") == "user")
    return cells.select(F.col("doc_id").alias("conv_id"), "cell", "is_input", "n_lines", F.sha1("text").alias("text_sha1"))


def dialogue_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), F.col("text").alias("line"), "role")
    cells = content.session_cells(rows, F.col("role") == "assistant")
    return cells.groupBy(F.col("doc_id").alias("conv_id")).agg(F.count("*").alias("n_changes"), F.max("n_lines").alias("longest"))


def index_build(spark, sf_dir):
    """Part names as entries, an index for each size: brand as main entry, name as sub-entry, sorted under the name."""
    part = table(spark, sf_dir, "part")
    entries = part.select(F.col("p_size").alias("doc_id"), F.concat("p_name", F.lit("@"), "p_brand", F.lit("!"), "p_name").alias("entry"))
    return content.build_index(entries).select(F.col("doc_id").alias("p_size"), "place", "letter", "main", "sub", "new_letter", "new_main")


QUERIES = {
    f.__name__: f
    for f in (
        content_ids, duplicate_nodes, paragraphs, paragraph_tree, html_entities_to_tex, unicode_to_tex, ascii_fold, safe_names, file_stub, title_key, inline_math,
        kill_comments, smart_punctuation, lt_escape, author_match, term_links, si_units, session_cells, dialogue_lines, index_build,
    )
}

_LINES = """l AS (SELECT doc_id, i, trim(p, ' ') AS p FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS p FROM documents)
  WHERE trim(p, ' ') NOT IN ('', chr(92), '{', '}')),
o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS ordinal, sha1(p || 'text') AS content_hash, p FROM l)"""
_CELLS = """t AS (SELECT *, role = '{role}' AS is_input, coalesce(lag(role = '{role}') OVER w <> (role = '{role}'), true) AS starts FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
c AS (SELECT *, sum(starts::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS cell FROM t),
g AS (SELECT conv_id, cell, is_input, count(*) AS n_lines, string_agg(text, chr(10) ORDER BY turn) AS text FROM c GROUP BY conv_id, cell, is_input)"""
# The letters that the tables hold, by hand: what they are in markup and in ASCII.
_LETTERS = [
    ("è", "\\`e"), ("ç", "\\c{c}"), ("Í", "\\'I"), ("Ü", '\\"U'), ("È", "\\`E"), ("Ç", "\\c{C}"), ("Ä", '\\"A'), ("Ó", "\\'O"), ("ñ", "\\~n"), ("É", "\\'E"), ("ß", "{\\ss}"), ("ê", "\\^e"),
    ("Ö", '\\"O'), ("Ê", "\\^E"), ("í", "\\'{\\i}"), ("ö", '\\"o'), ("Ñ", "\\~N"), ("ó", "\\'o"), ("é", "\\'e"), ("ä", '\\"a'), ("ü", '\\"u'),
]
_PLAIN = "replace(translate({0}, 'èçÍÜÈÇÄÓñÉêÖÊíöÑóéäü', 'ecIUECAOnEeOEioNoeau'), 'ß', 'ss')"
_KEY = rf"""
WITH t AS (SELECT page_id AS id, lower({_PLAIN.format("replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', chr(34))")}) AS t FROM pages),
c AS (SELECT id, trim(regexp_replace(replace(regexp_replace(regexp_replace(t, '''s\b', '', 'g'), '[''`^~"_{{}}$\\:;,.()]', '', 'g'), 'on-', 'on'), '[^a-z0-9]+', ' ', 'g')) AS t FROM t),
o AS (SELECT id, regexp_replace(t, '^(a note on|notes on|remark on|on the|on) ', '') AS t FROM c),
w AS (SELECT id, list_filter(string_split(t, ' '), lambda x: x NOT IN ('', 'a', 'an', 'the', 'on', 'in', 'of', 'at', 'for')) AS w FROM o),
n AS (SELECT id, list_transform(w, lambda x: CASE WHEN list_position(['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten'], x) > 0
    THEN list_position(['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten'], x)::VARCHAR
  WHEN regexp_matches(x, '[a-z]{{3}}(x|ch|sh|ss)es$') THEN regexp_replace(x, 'es$', '') WHEN regexp_matches(x, '[a-z]{{4}}ies$') THEN regexp_replace(x, 'ies$', 'y')
  WHEN regexp_matches(x, '[a-z]{{3}}[a-rt-z]s$') THEN regexp_replace(x, 's$', '') ELSE x END) AS w FROM w),
k AS (SELECT id, replace({{spelled}}, ' ', '') AS key FROM (SELECT id, array_to_string(w, ' ') AS s FROM n))
SELECT key, count(*) AS n, min(id) AS first_id FROM k WHERE key <> '' GROUP BY key"""

ORACLES = {
    "content_ids": "SELECT doc_id, sha1(coalesce(text, '') || 'text') AS content_id FROM documents",
    "duplicate_nodes": f"WITH {_LINES} SELECT content_hash, count(*) AS n, min(doc_id) AS first_doc FROM o GROUP BY content_hash HAVING count(*) > 1",
    "paragraphs": f"WITH {_LINES} SELECT doc_id, ordinal, content_hash FROM o",
    "paragraph_tree": f"WITH {_LINES} SELECT doc_id, count(*) AS n_children, sum(length(p)) AS chars FROM o GROUP BY doc_id",
    "html_entities_to_tex": "SELECT page_id, sha1(replace(html, '&quot;', chr(34))) AS tex_sha1 FROM pages",
    "unicode_to_tex": f"SELECT doc_id, sha1({sql_literals('text', _LETTERS)}) AS tex_sha1 FROM documents",
    "ascii_fold": rf"SELECT page_id, sha1(regexp_replace({_PLAIN.format("replace(html, '&quot;', chr(34))")}, '\s+', ' ', 'g')) AS ascii_sha1 FROM pages",
    "safe_names": r"""SELECT page_id, regexp_replace(trim(regexp_replace(url, '\s+', ' ', 'g')), '[: ~!@#$%^&*|(){}<>,+=;/\\\\`''".]', '_', 'g') AS name FROM pages""",
    "file_stub": "SELECT page_id, regexp_replace(regexp_replace(url, '\\.[^./]*$', ''), '^.*/', '', 's') AS stub FROM pages",
    "title_key": _KEY.replace("{spelled}", sql_literals("s", X.SPELLINGS)),
    "inline_math": """WITH m AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS math FROM (SELECT doc_id, regexp_extract_all(text, '\\$([^$]+)\\$', 1) AS x FROM documents))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS ordinal, math FROM m WHERE NOT regexp_matches(math, '\\n[ \\t]*\\n')""",
    "kill_comments": r"SELECT doc_id, sha1(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '%+', '%', 'g'), '(?m)^[ \t]*%[^\n]*\n', '', 'g'), '%[^\n]*\n[ \t]*', '', 'g'), '%[^\n]*$', '', 'g')) AS clean_sha1 FROM documents",
    "smart_punctuation": r"""SELECT doc_id, sha1(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(text, '([^-])---([^-])', '\1' || chr(8212) || '\2', 'g'), '--', chr(8211)), '``', chr(8220)), '''''', chr(8221)), '(^|[\s(])"', '\1' || chr(8220), 'g'), '"', chr(8221), 'g')) AS smart_sha1 FROM documents""",
    "lt_escape": "SELECT page_id, sha1(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_sha1 FROM pages",
    "author_match": """WITH n AS (SELECT regexp_extract(c_name, '([0-9]+)$', 1) AS k FROM customer), p AS (SELECT s_suppkey, regexp_replace(regexp_extract(s_name, '([0-9]+)$', 1), '^0+', '') AS k FROM supplier)
SELECT 'S ' || n.k AS name, min(s_suppkey) AS person_id FROM n JOIN p ON p.k <> '' AND (suffix(n.k, p.k) OR suffix(p.k, n.k)) GROUP BY n.k HAVING count(*) = 1""",
    "term_links": """WITH t AS (SELECT DISTINCT term FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS term FROM benchmark) WHERE regexp_full_match(term, '[a-z]{4,}')),
f AS (SELECT term, unnest([term, CASE WHEN regexp_matches(term, '[^aeiou]y$') THEN regexp_replace(term, 'y$', 'ies') WHEN regexp_matches(term, '(s|x|ch|sh)$') THEN term || 'es' ELSE term || 's' END]) AS word FROM t),
g AS (SELECT word, min(term) AS term FROM f GROUP BY word),
w AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents))
SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS n_links FROM w JOIN g USING (word) GROUP BY term""",
    "si_units": """SELECT p_partkey, '<quantity><mag>' || p_size || '</mag><unit prefix="kilo" base="gram"/><unit prefix="centi" base="meter" exp="2"/><per base="second"/></quantity>' AS quantity FROM part""",
    "session_cells": f"WITH {_CELLS.format(role='user')} SELECT conv_id, cell, is_input, n_lines, sha1(text) AS text_sha1 FROM g",
    "dialogue_lines": f"WITH {_CELLS.format(role='assistant')} SELECT conv_id, count(*) AS n_changes, max(n_lines) AS longest FROM g GROUP BY conv_id",
    "index_build": """WITH e AS (SELECT DISTINCT p_size, upper(p_name) AS s, p_brand AS main, p_name AS sub, p_name || '@' || p_brand || '!' || p_name AS entry FROM part), w AS (SELECT *, left(s, 1) AS letter FROM e)
SELECT p_size, row_number() OVER o AS place, letter, main, sub, coalesce(lag(letter) OVER o <> letter, true) AS new_letter, coalesce(lag(main) OVER o <> main, true) AS new_main FROM w WINDOW o AS (PARTITION BY p_size ORDER BY s, entry)""",
}
