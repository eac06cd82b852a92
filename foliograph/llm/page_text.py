"""Main text of web pages: the site's template is what recurs on many pages of a host.

Every element's subtree is hashed by its tag, text and children. Spark counts on how many different
pages of a host each subtree stands; those on many are deleted. Pages that differ in nothing but
their address count once, so copies of an article do not make it a template. Names, roles and
classes of elements tell the rest (``elements``): adverts and notices that no other page has.

What is to be deleted from which page is joined with the pages, as a broadcast where its measured
size is small and else by a shuffle. It holds only subtrees that names and classes have not deleted already.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize
from .elements import Page

#: A subtree on so many different pages of a host is the host's template.
MIN_PAGES = 5
#: Hashes to be deleted that are broadcast at most, over all pages.
BROADCAST_HASHES = 1 << 20


def host_of(url: Column) -> Column:
    """The host in a URL, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, kept, said = [], [], []
        for html in batch.column(batch.num_columns - 1).to_pylist():
            page = Page(html)
            page.survey()
            found = page.subtrees()
            hashes.append([_signed(h) for h in found])
            kept.append([_signed(h) for h, elements in found.items() if any(page.inside[e] and not page.dropped[e] for e in elements)])
            said.append(_signed(xxhash.xxh64_intdigest("\n".join(page.blocks()))))
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (hashes, kept)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(said, pa.int64()), *lists], [*batch.schema.names[:-1], "said", "hashes", "kept"])
    K.release()


def _articles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for html, template in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            page = Page(html)
            page.survey()
            texts.append("\n".join(page.blocks({h & 0xFFFFFFFFFFFFFFFF for h in template or ()})))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string())], [*batch.schema.names[:-2], "text"])
    K.release()


def extract_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), min_pages: int = MIN_PAGES) -> DataFrame:
    """The ``keep`` columns, the page's main ``text`` and ``n_chars``, its code points.

    A null html is empty and has no text. Null URLs and URLs without a host make one host.
    Repeated rows give repeated results and count as one page of their host. Inside an
    article or main element paragraphs, headings, lists' items and the like always stay,
    and if less than half of it would stay, all does. Pages are read whole, however long, in linear
    time. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    slim = pages.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], host_of(F.col("url")).alias("host"), F.xxhash64("url", html).alias("a"), F.hash(html, F.length(html)).alias("b"), html.alias("html"))
    seen = slim.select("host", "a", "b", "html").mapInArrow(_subtrees, "host string, a long, b int, said long, hashes array<long>, kept array<long>")
    seen = materialize(seen.dropDuplicates(["a", "b"]), "pages-subtrees")
    each = seen.select("host", "said", F.explode("hashes").alias("hash"))
    template = each.distinct().groupBy("host", "hash").count().where(F.col("count") >= min_pages).select("host", "hash")
    cut = seen.where(F.size("kept") > 0).select("host", "a", "b", F.explode("kept").alias("hash")).join(template, ["host", "hash"])
    cut = materialize(cut.groupBy("a", "b").agg(F.collect_set("hash").alias("template")), "pages-template")
    n = cut.agg(F.coalesce(F.sum(F.size("template") + 4), F.lit(0))).first()[0]
    cut = F.broadcast(cut) if n <= BROADCAST_HASHES else cut
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields if f.name.startswith("k_"))
    found = slim.join(cut, ["a", "b"], "left").select(*[f"k_{i}" for i in range(len(keep))], "html", "template").mapInArrow(_articles, f"{fields}, text string")
    return found.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "text", F.length("text").cast("long").alias("n_chars"))


#: For pages of one article element whose blocks do not nest, with the named references that such pages have.
PAGES_SQL = r"""
WITH a AS (SELECT row_number() OVER () AS r, page_id, url, regexp_extract(coalesce(html, ''), '(?is)<article[^>]*>(.*)</article>', 1) AS a FROM pages),
b AS (SELECT r, unnest(regexp_split_to_array(a, '(?i)</?(p|h[1-6]|div|ul|ol|li|blockquote|pre)\b[^>]*>')) AS x, generate_subscripts(regexp_split_to_array(a, '(?i)</?(p|h[1-6]|div|ul|ol|li|blockquote|pre)\b[^>]*>'), 1) AS i FROM a),
s AS (SELECT r, i, regexp_replace(regexp_replace(x, '(?i)<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS x FROM b),
e AS (SELECT r, i, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(x, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS x FROM s),
t AS (SELECT r, string_agg(x, chr(10) ORDER BY i) AS text FROM e WHERE x <> '' GROUP BY r)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM a LEFT JOIN t USING (r)
"""
