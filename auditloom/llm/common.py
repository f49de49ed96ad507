"""What the training-data operators share: words, tables, lineage cuts, Arrow columns."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these six; the same class in DuckDB's and Java's dialects.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """array<string> of the words of a text; null text: empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: later jobs read it and lost executors don't repeat it.

    The folder is the one the session names in ``spark.checkpoint.dir``; only where none is named (tests,
    local runs) one is made here. Never a local checkpoint: its blocks die with their executor.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, as :func:`cut` says."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="auditloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, compression: str = "snappy") -> tuple[DataFrame, str]:
    """``df`` as a Parquet table of its own in the shared folder, reread, and its path; for tables too wide to checkpoint as rows.

    The table goes when the driver ends, or by :func:`remove` before that.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.option("compression", compression).parquet(path)
    return spark.read.parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Drops a table that :func:`written` made."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Rows of one number each that may be broadcast: 16 bytes a row in the executors' hash tables.
BROADCAST_ROWS = 500_000


def small(keys: DataFrame) -> DataFrame:
    """``keys`` (a written or checkpointed table of one number a row), marked for broadcast if its rows were counted to be ``BROADCAST_ROWS`` at most."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns whose names an operator gives out (compared as Spark does: without case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
