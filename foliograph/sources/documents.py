"""Reading documents, and the graph of files that include each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files; UTF-8, or Latin-1 where that is not valid."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.coalesce(F.try_validate_utf8("content"), F.decode("content", "ISO-8859-1"))
    return files.select("path", F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), "\t", " ").alias("text"))


def read_people(spark: SparkSession, path: str) -> DataFrame:
    """The optional JSON list of people."""
    return spark.read.schema("firstname string, lastname string, preferredfullname string, mr_id string").option("multiLine", "true").json(path)


INCLUDE_RE = r"\\(?:input|include)\s*\{([^}]*)\}"


def includes(files: DataFrame) -> DataFrame:
    """(file, ordinal, target): the include edges of (file, text)."""
    found = F.posexplode(F.regexp_extract_all("text", F.lit(INCLUDE_RE), F.lit(1))).alias("k", "target")
    return files.select("file", found).select("file", (F.col("k") + 1).alias("ordinal"), "target")


_REACHED = """
WITH RECURSIVE reached(root, file, depth, place, chain, cyclic) MAX RECURSION LEVEL {levels} AS (
  SELECT file, file, 0, CAST(array() AS array<int>), array(file), false FROM {root}
  UNION ALL
  SELECT r.root, e.target, r.depth + e.steps, concat(r.place, e.way), concat(r.chain, array(e.target)), array_contains(r.chain, e.target)
  FROM reached r JOIN {edge} e ON r.file = e.file WHERE NOT r.cyclic)
SELECT root, file, depth, place, cyclic FROM reached LIMIT ALL"""
#: Recursion ends without a limit, as cycles are cut.
UNLIMITED = 2**31 - 2


def _runs(edge: DataFrame, root: DataFrame) -> DataFrame:
    """(file, head, offset, ordinal): files that only one include leads to, the only one of its file, under the first file of such a run.

    Found by doubling: a run of n files takes log2(n) joins. What goes round without a way in from a root has no head and is not in it.
    """
    ways_in = edge.groupBy("target").agg(F.count("*").alias("n"), F.min(F.struct("file", "ordinal")).alias("e")).where("n = 1")
    single = edge.groupBy("file").agg(F.count("*").alias("m")).where("m = 1").select("file")
    only = ways_in.select(F.col("target").alias("member"), "e.*").join(single, "file").join(root.select(F.col("file").alias("member")).distinct(), "member", "left_anti")
    way = only.select(F.col("member").alias("file"), F.col("file").alias("head"), F.lit(1).alias("offset"), "ordinal").localCheckpoint()
    n = way.count()
    for _ in range(max(n, 1).bit_length()):
        up = way.select(F.col("file").alias("head"), F.col("head").alias("above"), F.col("offset").alias("more"))
        way = way.join(up, "head", "left").select("file", F.coalesce("above", "head").alias("head"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"), "ordinal").localCheckpoint()
        if way.join(way.select(F.col("file").alias("head")), "head", "left_semi").isEmpty():
            break
    return way.join(way.select(F.col("file").alias("head")), "head", "left_anti")


def expand_includes(files: DataFrame, root: DataFrame, max_depth: int | None = 100, edges: DataFrame | None = None) -> DataFrame:
    """(root, file, depth, place, cyclic): every file reached from each root, in reading order.

    One recursive query, over runs of files that can only follow each other, so that its levels are those where files branch.
    ``place`` orders the files as an expansion would meet them. A file that is among its own
    ancestors is reported once as cyclic and not followed; other repeats are legitimate.
    Deeper chains than ``max_depth`` are an error when the result is used, and not a silent stop; None sets no limit. ``edges`` are those
    of ``includes``, by default, or of ``located``.
    """
    edge = (includes(files) if edges is None else edges).select("file", F.col("ordinal").cast("int").alias("ordinal"), "target").localCheckpoint()
    run = _runs(edge, root)
    member = run.groupBy(F.col("head").alias("file")).agg(F.sort_array(F.collect_list(F.struct("offset", "ordinal", F.col("file").alias("name")))).alias("members"))
    ordinals = lambda members: F.transform(members, lambda m: m["ordinal"])
    # An include that is no step inside a run starts at the run's last file.
    inner = run.select(F.col("file").alias("target"))
    outer = edge.join(inner, "target", "left_anti").join(run.select("file", "head"), "file", "left").select(F.coalesce("head", "file").alias("file"), "ordinal", "target").join(member, "file", "left")
    none = F.array().cast("array<struct<offset:int,ordinal:int,name:string>>")
    members = F.coalesce("members", none)
    steps = outer.select("file", "target", (F.size(members) + 1).alias("steps"), F.concat(ordinals(members), F.array("ordinal")).alias("way"))
    found = files.sparkSession.sql(_REACHED.replace("{levels}", str(UNLIMITED if max_depth is None else int(max_depth) + 1)), root=root.select("file"), edge=steps)
    own = F.array(F.struct(F.lit(0).alias("offset"), F.lit(None).cast("int").alias("ordinal"), F.col("file").alias("name")))
    whole = found.join(member, "file", "left").withColumn("members", F.when(F.col("cyclic"), none).otherwise(members))
    rows = whole.select("root", F.explode(F.concat(own, "members")).alias("m"), "depth", "place", "members", "cyclic")
    rows = rows.select("root", F.col("m.name").alias("file"), (F.col("depth") + F.col("m.offset")).alias("depth"), F.concat("place", ordinals(F.slice("members", F.lit(1), F.col("m.offset")))).alias("place"), "cyclic")
    if max_depth is None:
        return rows
    return rows.where(F.when(F.col("depth") > int(max_depth), F.raise_error(F.lit(f"includes are nested deeper than {int(max_depth)}")).cast("boolean")).otherwise(True))


def located(edges: DataFrame, files: DataFrame, folder: str = "", working: str = "") -> DataFrame:
    """Include edges with the file that a target means: with and without ``.tex``, in the input folder and then the working folder.

    ``files`` has the names that exist. A target that is nowhere keeps its name, with ``missing``.
    """
    names = [F.concat(F.lit(f), "target", F.lit(x)) for f in (folder, working) for x in (".tex", "")]
    tried = edges.withColumn("row", F.monotonically_increasing_id()).select("*", F.posexplode(F.array(*names)).alias("turn", "name"))
    found = tried.join(files.select(F.col("file").alias("name")).distinct(), "name")
    best = found.groupBy("file", "ordinal", "target").agg(F.min(F.struct("turn", "name")).alias("b")).select("file", "ordinal", "target", "b.name")
    return edges.join(best, ["file", "ordinal", "target"], "left").select("file", "ordinal", F.coalesce("name", "target").alias("target"), F.col("name").isNull().alias("missing"))


def included_text(files: DataFrame, found: DataFrame) -> DataFrame:
    """(root, text): the whole text of each root with the files of ``expand_includes`` in their places.

    Texts are cut at their includes. A piece sorts by the way to it: the place of its file,
    then its own number; a file included between two pieces sorts between them. What is
    cyclic or missing leaves nothing.
    """
    way = F.transform("place", lambda p: p * 2)
    rows = found.where(~F.col("cyclic")).join(files.select("file", "text"), "file")
    pieces = rows.select("root", way.alias("way"), F.posexplode(F.split("text", INCLUDE_RE, -1)).alias("k", "piece"))
    whole = pieces.groupBy("root").agg(F.sort_array(F.collect_list(F.struct(F.concat("way", F.array(F.col("k") * 2 + 1)).alias("key"), "piece"))).alias("p"))
    return whole.select("root", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"))


# Packages of journals and publishers that are never read.
OMITTED_PACKAGES = (
    "imsart arximspdf IEEEtran gtpart gtart birkjour birkjour_t2 dmtcs svmult svjour pnastwo babel cleveref lms HandbookOfModuli AmsArt siamltex agtart_a mdpi e-jc "
    "egastyle pinlabel graphs jtbbook jtbart diagrams elsart physics geompsfi amlts amsppt jheppub loops skeyval algorithm algorithm2e algorithmic algpseudocode "
    "jmlr2e amltd spconf amsmath amssymb amsfonts mathtools url color subfigure graphicx lgrind cite fancyhdr psfig pgfplots arximspdf smfthm smfart smfbook mhequ mhfig mhenvs "
    "subenv revtex caption subcaption ScriptFonts Symbols birkmult elsart3-1 revtex4-1 aims aomamlt2e ejpecp ltexpprt acmsmall epl2 JINST iopart iopams mysymbol acmnew mhchem "
    "amsrefs jmlrmod infocom acmart natbib llncs oldllncs ieeeconf acm_proc_article-sp aaai ltexpprt sig-alternate tufte-book sagetex tabmac chngcntr gastex mathfont yjsco"
).split()


def packages(docs: DataFrame) -> DataFrame:
    r"""(doc_id, ordinal, package): names of ``\usepackage`` and ``\documentclass``, lists taken apart."""
    lists = F.regexp_extract_all("text", F.lit(r"\\(?:usepackage|documentclass)\s*(?:\[[^\]]*\])?\s*\{([^}]*)\}"), F.lit(1))
    names = F.filter(F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, ","))), lambda x: F.trim(x)), lambda x: x != "")
    return docs.select("doc_id", F.posexplode(names).alias("k", "package")).select("doc_id", (F.col("k") + 1).alias("ordinal"), "package")


def package_texts(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, ordinal, package, file): packages that are not omitted and stand next to the document as ``.sty`` or ``.cls``."""
    used = packages(docs).where(~F.col("package").isin(*OMITTED_PACKAGES))
    return used.select("*", F.explode(F.array(*[F.concat("package", F.lit(x)) for x in (".sty", ".cls")])).alias("file")).join(files.select("file"), "file", "left_semi").select("doc_id", "ordinal", "package", "file")


def local_packages(used: DataFrame, omitted: DataFrame, present: DataFrame) -> DataFrame:
    """Package names that are used, not on the omit list, and stand next to the document."""
    return used.join(omitted, "package", "left_anti").join(present, "package")
