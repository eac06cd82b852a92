r"""Captions, footnotes and images of nodes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scanner import group_at
from ..session import ship

_FOUND = T.ArrayType(T.StructType([T.StructField(k, T.StringType()) for k in ("kind", "about", "content")]))
_START = re.compile(r"\\(captionof|caption|footnote|includegraphics|psfig|epsfig|epsfbox|epsffile|scalebox)(?![A-Za-z])\*?")
_FILE = re.compile(r"(?:file|figure)\s*=\s*([^,\s]+)\s*,?")
_IMAGES = ("includegraphics", "psfig", "epsfig", "epsfbox", "epsffile")


def find_floats(text: str) -> list[tuple[str, str, str]]:
    r"""(kind, about, content): about is the type of a ``\captionof`` or an option list; an image in a ``\scalebox`` has its scale."""
    out, text = [], text or ""
    scaled: list[tuple[int, str]] = []  # where open scaled boxes end, and their scale
    for m in _START.finditer(text):
        name, at, about = m.group(1), m.end(), ""
        while scaled and m.start() >= scaled[-1][0]:
            scaled.pop()
        start, end = group_at(text, at, "[", "]")
        if start < end:
            about, at = text[start + 1 : end - 1], end
        if name in ("captionof", "scalebox"):
            start, at = group_at(text, at)
            about = text[start + 1 : at - 1]
        start, end = group_at(text, at)
        if start == end:
            continue
        content = text[start + 1 : end - 1].strip()
        if name == "scalebox":
            scaled.append((end, about))
            continue
        if name in ("psfig", "epsfig") and (file := _FILE.search(content)):
            about, content = (content[: file.start()] + content[file.end() :]).strip(" ,"), file.group(1)
        if name in _IMAGES and scaled:
            about = ",".join(x for x in (f"scale={scaled[-1][1].strip()}", about) if x)
        out.append(("caption" if name == "captionof" else "image" if name in _IMAGES else name, about, content))
    return out


@F.pandas_udf(_FOUND)
def _floats(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [dict(zip(("kind", "about", "content"), x, strict=True)) for x in find_floats(t)])


def floats(nodes: DataFrame, text: str = "body") -> DataFrame:
    """(doc_id, pos, k, kind, about, content) of captions, footnotes and images, in order."""
    ship(nodes.sparkSession)
    rows = nodes.where(F.col(text).rlike(r"\\(?:caption|footnote|includegraphics|psfig|epsf|scalebox)"))
    return rows.select("doc_id", "pos", F.posexplode(_floats(text)).alias("k", "f")).select("doc_id", "pos", "k", "f.*")


def image_sizes(found: DataFrame) -> DataFrame:
    """Images with their width in per cent of the line, null where none is given."""
    width = F.try_to_number(F.nullif(F.regexp_extract("about", r"(?:width|scale)\s*=\s*([0-9]*\.?[0-9]+)", 1), F.lit("")), F.lit("999999.999999")).cast("double")
    return found.where("kind = 'image'").select("doc_id", "pos", "k", F.col("content").alias("file"), (F.lit(100.0) * width).cast("int").alias("percent"))


def owned(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Captions, footnotes and images with ``owner``: the figure or table that holds them directly or through layout, else their own node."""
    up = nodes.select("doc_id", "pos", F.coalesce("float", "pos").alias("owner"))
    return found.join(up, ["doc_id", "pos"])


#: Per cent of the line that an image takes that says nothing, and inches of a line.
USUAL_PERCENT, LINE_INCHES = 73, 5.33


def image_markup(found: DataFrame, target: str = "html") -> DataFrame:
    """(doc_id, pos, k, markup): images as elements of a target; in the structured one with their width and without their folder."""
    size = r"(scale|width)\s*=\s*([0-9]*\.?[0-9]+)\s*(in)?"
    images = found.where("kind = 'image'")
    if target == "html":
        return images.select("doc_id", "pos", "k", F.concat(F.lit('<img src="'), "content", F.lit('" />')).alias("markup"))
    value = F.regexp_extract("about", size, 2).try_cast("double")
    inches = (F.regexp_extract("about", size, 1) == "width") & (F.regexp_extract("about", size, 3) == "in")
    percent = F.coalesce((F.lit(100.0) * value / F.when(inches, LINE_INCHES).otherwise(1.0)).cast("int"), F.lit(USUAL_PERCENT))
    file = F.regexp_replace("content", "(?s)^.*/", "")
    return images.select("doc_id", "pos", "k", F.concat(F.lit('<image width="'), percent.cast("string"), F.lit('%" source="images/'), file, F.lit('" />')).alias("markup"))
