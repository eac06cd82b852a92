"""Secret scans with corpus-wide ownership frequency. DataFrame functions only.

Base spans come from fixed patterns. On top of them the method looks at *candidates*:
the values of base spans and generic token-like strings. Their hashes are counted over
the corpus by distinct repositories and distinct owners (sources). A repository is a
distinct text: copies of one leaking document are one repository of one owner and make no
example. A value that many repositories and many owners carry is a widely copied example;
others are live: base values as they are (passwords are short), generic tokens if they
look random. Live generic tokens are added to the spans of a document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# The patterns of the base kinds, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "token")
ASSIGN_RE = (
    r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\x22']?\x20*[:=]\x20*[\x22']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS_RE = r"AKIA[A-Z0-9]+"
HEX_RE = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: A generic token: this many characters of the class, with an upper-case letter, a lower-case letter and a digit.
TOKEN_RE = r"[A-Za-z0-9_-]{20,}"
#: A value of fewer repositories or owners is no widely copied example.
EXAMPLE_OWNERS = 3
#: A live generic token has at least this many different characters.
MIN_DISTINCT_CHARS = 8
#: Elements of an array that are walked at once; appending to an array copies it.
WALK = 512


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _parts(rows: Column) -> Column:
    """An array in parts of ``WALK`` elements."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(rows) - 1, F.lit(0)), F.lit(WALK))
    return F.transform(starts, lambda a: F.slice(rows, a + 1, F.lit(WALK)))


def _spans(text: Column, kind: int, pattern: str, quick: Column, group: int, keep) -> Column:
    """array<struct<start,kind,end,value>> of the matches that ``keep(match, value)`` holds for; linear in their number."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    rows = F.filter(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), gaps.alias("gap")), lambda r: r["m"].isNotNull())
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def step(acc: Column, r: Column) -> Column:
        start = acc["at"] + r["gap"]
        end = start + F.length(r["m"])
        value = F.regexp_extract(r["m"], pattern, group) if group else r["m"]
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value"))
        out = F.when(keep(r["m"], value), F.concat(acc["out"], F.array(one))).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    def walk(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["at"].alias("at"), empty.alias("out")), step)
        return bind(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    found = bind(rows, lambda r: F.flatten(F.aggregate(_parts(r), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out")), walk)["out"]))
    return F.when(quick, found).otherwise(empty)


SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each base kind, by position; offsets in code points, end exclusive."""
    text = F.coalesce(text, F.lit(""))
    return {
        "assign": _spans(text, 0, ASSIGN_RE, (text.contains(":") | text.contains("=")) & text.rlike(ASSIGN_RE), 1, lambda m, v: F.length(v) >= MIN_ASSIGN),
        "access": _spans(text, 1, ACCESS_RE, text.contains("AKIA"), 0, lambda m, v: F.length(m) >= MIN_ACCESS),
        "hex": _spans(text, 2, HEX_RE, text.rlike(r"[0-9a-f]{%d}" % MIN_HEX), 0, lambda m, v: F.length(m) >= MIN_HEX),
    }


def token_spans(text: Column) -> Column:
    """Generic token-like strings, candidates only."""
    def mixed(m: Column, v: Column) -> Column:
        return m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")

    text = F.coalesce(text, F.lit(""))
    return _spans(text, 3, TOKEN_RE, text.rlike(TOKEN_RE), 0, mixed)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _copied(hashed: DataFrame, example_owners: int) -> DataFrame:
    """(hash, copied): whether a value is a widely copied example.

    Equal texts are one repository, of the first of their owners. An example stands in at
    least ``example_owners`` repositories and owners, and in at least log2 of all repositories
    with candidates and of all their owners: what is many grows with the corpus, but slowly.
    """
    texts = hashed.groupBy("text_hash").agg(F.min("owner").alias("owner"))
    n_texts, n_owners = texts.groupBy("owner").agg(F.count("*").alias("n")).agg(F.sum("n"), F.count("*")).first()
    least_texts, least_owners = (max(example_owners, math.ceil(math.log2(max(n or 1, 1)))) for n in (n_texts, n_owners))
    per_text = hashed.select("text_hash", F.explode(F.transform("cands", lambda s: s["hash"])).alias("hash")).distinct().join(texts, "text_hash")
    # Two plain sums: no distinct count, no group of a hot value in one task.
    sums = per_text.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))
    return sums.select("hash", ((F.col("n_repositories") >= least_texts) & (F.col("n_owners") >= least_owners)).alias("copied"))


def scan_secrets(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, keep: tuple[str, ...] = ("doc_id",), owner: str = "source", carry_text: bool = False) -> DataFrame:
    """Secrets of every document.

    Returns the ``keep`` columns, ``n_assign``, ``n_access``, ``n_hex``, ``base`` and
    ``found`` (arrays of start, kind, end; ``found`` also has the live generic tokens),
    ``live`` (spans of live values), ``n_live`` and ``n_example`` (candidates by ownership)
    and, if asked for, ``text``.

    Null and empty texts have no spans. The null owner counts as one owner, apart from the
    empty one. Rows are told apart by position, so repeated rows and ids are kept; equal texts
    are one repository. A very long text is searched whole; its spans are walked in parts. An
    empty table gives an empty result. Columns that are not named are ignored.
    """
    kinds = base_spans(F.col("text"))
    scanned = docs.select(
        *[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)],
        F.col(owner).alias("owner"),
        *([F.col("text").alias("k_text")] if carry_text else []),
        *[v.alias(k) for k, v in kinds.items()],
        token_spans(F.col("text")).alias("token"),
        F.xxhash64("text").alias("text_hash"),
    ).withColumn("row_id", F.monotonically_increasing_id())
    scanned = materialize(scanned, "secrets-spans")

    candidates = F.concat("assign", "access", "hex", "token")
    hashed = scanned.where(F.size(candidates) > 0).select(
        "row_id", "text_hash", "owner", F.transform(candidates, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.xxhash64(s["value"]).alias("hash"),
            (F.size(F.array_distinct(F.split(s["value"], ""))) >= MIN_DISTINCT_CHARS).alias("random"))).alias("cands")
    )
    each = hashed.select("row_id", F.explode("cands").alias("c")).select("row_id", "c.*")
    judged = each.join(_copied(hashed, example_owners), "hash").withColumn("live", ((F.col("kind") < 3) | F.col("random")) & ~F.col("copied"))
    # A document's candidates meet again; their number is that of its own spans.
    verdicts = judged.groupBy("row_id").agg(F.count(F.when(F.col("copied"), 1)).alias("n_example"), F.collect_list(F.when(F.col("live"), F.struct("start", "kind", "end"))).alias("live"))
    joined = scanned.join(verdicts, "row_id", "left")
    live = F.coalesce(F.sort_array("live"), F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    base = F.sort_array(F.transform(F.concat("assign", "access", "hex"), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return joined.select(
        *[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)],
        *([F.col("k_text").alias("text")] if carry_text else []),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        base.alias("base"),
        F.sort_array(F.concat(base, F.filter(live, lambda s: s["kind"] == 3))).alias("found"),
        live.alias("live"),
        F.size(live).cast("long").alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )


def redact_live(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Documents without candidates as they are, and the others with their live spans and text.

    Only documents with a candidate take part in counts and joins; texts of the rest are
    passed through in one scan.
    """
    kinds = [*base_spans(F.col("text")).values(), token_spans(F.col("text"))]
    any_ = F.coalesce(F.size(F.concat(*kinds)) > 0, F.lit(False))
    return docs.where(~any_), scan_secrets(docs.where(any_), keep=keep, carry_text=True)


def secret_digest(found: DataFrame) -> DataFrame:
    """The columns of the contract from the operator's spans."""
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), "n_live", "n_example"
    )


def redact(text: Column, spans: Column, mark: str = "[redacted]") -> Column:
    """``text`` with the given sorted spans replaced; overlapping spans share one mark.

    What stands between spans is cut from a part of the text for every ``WALK`` spans, as
    each cut counts characters from the start of what it is cut from.
    """
    none = F.array().cast("array<string>")

    def walk(acc: Column, part: Column) -> Column:
        base = acc["at"]
        end = F.greatest(base, F.array_max(F.transform(part, lambda s: s["end"])))

        def cut(here: Column) -> Column:
            def step(inner: Column, s: Column) -> Column:
                gap = F.array(here["text"].substr(inner["at"] - here["base"] + 1, s["start"] - inner["at"]))
                return F.struct(F.greatest(inner["at"], s["end"]).alias("at"), F.when(s["start"] >= inner["at"], F.concat(inner["out"], gap)).otherwise(inner["out"]).alias("out"))

            return F.aggregate(part, F.struct(here["base"].alias("at"), none.alias("out")), step)

        done = bind(F.struct(text.substr(base + 1, end - base).alias("text"), base.alias("base")), cut)
        return bind(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    done = F.aggregate(_parts(spans), F.struct(F.lit(0).alias("at"), F.array().cast("array<array<string>>").alias("out")), walk)
    whole = bind(done, lambda d: F.array_join(F.concat(F.flatten(d["out"]), F.array(text.substr(d["at"] + 1, F.length(text)))), mark))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def _sql_kind(name: str, kind: int, pattern: str, group: int, keep: str) -> str:
    return rf"""
{name}_m AS (SELECT row_id, source, generate_subscripts(m, 1) AS i, unnest(m) AS m, unnest(v) AS v, unnest(g) AS g FROM (
  SELECT row_id, source, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS v,
    list_slice(string_split_regex(text, '{pattern}'), 1, len(regexp_extract_all(text, '{pattern}'))) AS g FROM d)),
{name} AS (SELECT row_id, source, {kind} AS kind, (sum(length(g) + length(m)) OVER (PARTITION BY row_id ORDER BY i))::BIGINT AS e, length(m) AS n, v FROM {name}_m),
{name}_k AS (SELECT row_id, source, kind, e - n AS s, e, v FROM {name} WHERE {keep})"""


def _sql() -> str:
    quote = lambda p: p.replace("'", "''")
    parts = [
        _sql_kind("assign", 0, quote(ASSIGN_RE), 1, f"length(v) >= {MIN_ASSIGN}"),
        _sql_kind("access", 1, quote(ACCESS_RE), 0, f"n >= {MIN_ACCESS}"),
        _sql_kind("hex", 2, quote(HEX_RE), 0, f"n >= {MIN_HEX}"),
        _sql_kind("token", 3, quote(TOKEN_RE), 0, "regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')"),
    ]
    names = "['assign', 'access', 'hex', 'token']"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, source, coalesce(text, '') AS text FROM documents), {','.join(parts)},
c AS (SELECT * FROM assign_k UNION ALL SELECT * FROM access_k UNION ALL SELECT * FROM hex_k UNION ALL SELECT * FROM token_k),
r AS (SELECT text, min(source) AS source FROM d WHERE row_id IN (SELECT row_id FROM c) GROUP BY text),
least AS (SELECT greatest({EXAMPLE_OWNERS}, ceil(log2(greatest(count(*), 1)))) AS texts,
  greatest({EXAMPLE_OWNERS}, ceil(log2(greatest(count(DISTINCT source) + max((source IS NULL)::INT), 1)))) AS owners FROM r),
o AS (SELECT v, count(DISTINCT text) >= any_value(texts) AND count(DISTINCT r.source) + max((r.source IS NULL)::INT) >= any_value(owners) AS example
  FROM c JOIN d USING (row_id) JOIN r USING (text), least GROUP BY v),
j AS (SELECT c.*, example, NOT example AND (kind < 3 OR len(list_distinct(string_split(v, ''))) >= {MIN_DISTINCT_CHARS}) AS live,
  {names}[kind + 1] || ':' || s || ':' || e AS said FROM c JOIN o USING (v)),
g AS (SELECT row_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  coalesce(string_agg(said, ',' ORDER BY s, kind) FILTER (kind < 3), '') AS base, coalesce(string_agg(said, ',' ORDER BY s, kind) FILTER (kind < 3 OR live), '') AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (example) AS n_example FROM j GROUP BY row_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN g USING (row_id)
"""


SECRETS_SQL = _sql()
