"""What the operators of this subpackage share: scratch tables, row ids, table access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: A word for counting sizes: anything between ASCII white space.
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a local master gets a temporary folder of its own; on a cluster
    no folder of one machine would do, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="foliograph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, removed when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/foliograph/{label}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(hadoop_path.getParent())
    fs.deleteOnExit(hadoop_path)
    return path


_scopes: list[dict[str, str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Scratch tables written inside are removed at the end, but for those of the list it yields.

    For operators that compute their result in steps: what the returned DataFrame still
    reads is put on the list.
    """
    keep: list[DataFrame] = []
    _scopes.append({})
    try:
        yield keep
    finally:
        paths = _scopes.pop()
        held = {f for df in keep for f in df.inputFiles()}
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        for path in paths:
            if any(path.split(":", 1)[-1] in f for f in held):
                continue
            hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(conf).delete(hadoop_path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a shared Parquet table and read it back.

    Cuts the lineage: later stages that lose an executor restart from the table, and a
    table that is used several times is computed once. Its file size also gives the
    optimizer a measured size for choosing joins.
    """
    spark = df.sparkSession
    ship(spark)
    path = scratch_path(spark, label)
    if _scopes:
        _scopes[-1][path] = label
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def total_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes in a text column over all rows."""
    return df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0
