"""From raw documents to a training mix: five stages, each a Parquet table that the next one reads.

Quality classifier, near-duplicate removal, benchmark decontamination, secret redaction,
mixing. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm import decontam, mixing, neardup, quality_model, secrets
from foliograph.llm.common import materialize, table


#: Columns that stages read; others go under names that no operator uses while a stage is at work.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(stage):
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in READ else f"__{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).select(names).toDF(*docs.columns)

    return run


def _rest(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c != "text")


@_apart
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.

    Null texts and metadata are values like others; repeated rows and ids are scored each; texts
    are measured whole however long. Without labels of both kinds everything stays. All columns are
    returned, whatever their names. An empty table gives an empty one.
    """
    scored = quality_model.score_quality(docs, table(spark, sf_dir, "labels"), carry=tuple(docs.columns))
    return scored.where("kept").select(docs.columns)


@_apart
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id.

    Null and wordless texts are linked with nothing and stay, repeated ones too. A null id takes
    part but yields to any other; of rows with one id in a group one stays. Long texts count
    by their shingles when work is divided. An empty table gives an empty one.
    """
    return neardup.keep_one_each(docs)


@_apart
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go.

    Null texts have no words and stay. Null and repeated ids are rows like others. A very long
    text is walked alone. Empty items match nothing; an empty benchmark or table changes nothing.
    """
    found = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"), keep=_rest(docs), carry_text=True)
    return found.where("n_hit = 0").select(docs.columns)


@_apart
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are redacted; widely copied examples and generic tokens that do not look random stay as they are.

    Every row stays, null and empty texts as they are; ``n_chars`` follows a redacted text. Equal
    texts are one repository of one owner; the null source is an owner. Long texts with many
    secrets are cut in linear time. An empty table gives an empty one.
    """
    clean, found = secrets.redact_live(docs, _rest(docs))
    changed = F.size("live") > 0
    found = found.withColumn("text", F.when(changed, secrets.redact(F.col("text"), F.col("live"))).otherwise(F.col("text")))
    found = found.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.unionByName(found.select(docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words taken of each document that the mix takes at all.

    Null and empty texts have no words and are not taken. The null source is one, last in rank.
    Equal rows draw equal keys; ties are ordered by id. An empty table gives an empty one.
    """
    mixed = mixing.mix_sources(docs).where("taken > 0")
    return mixed.select("doc_id", "source", "size", "source_size", "target", "epochs", "taken")


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("source mix", mix),
]

#: The classifier and signatures have no SQL; stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
