"""Backups of tables with proof: rows and an order-free hash of every partition, held in a manifest, checked before a restore counts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Damaged(RuntimeError):
    """A backup that doesn't hold what its manifest says."""


def marks(df: DataFrame, parts: int) -> DataFrame:
    """(part, n, h): rows and the sum of their hashes for each of ``parts`` parts of the rows, by a hash of the row; any order and any partitioning give the same."""
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    own, other = F.xxhash64(*columns), F.xxhash64(F.lit("part"), *columns)
    return df.select(F.pmod(other, F.lit(parts)).cast("int").alias("part"), own.alias("h")).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("h"))


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def backup(tables: dict[str, DataFrame], path: str, parts: int = 64) -> dict:
    """Writes each table under ``path``/name and then a manifest of schemas and marks; gives the manifest. A folder that has one is refused, one without (a backup that broke off) is written over.

    Marks are taken of what was read, not of what was written, so a fault in writing shows.
    """
    spark = next(iter(tables.values())).sparkSession
    place, fs = _fs(spark, f"{path}/manifest.json")
    if fs.exists(place):
        raise FileExistsError(f"{path} holds a backup")
    manifest = {"parts": parts, "tables": {}}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        # ``parts`` rows at most.
        manifest["tables"][name] = {"schema": df.schema.json(), "marks": {str(r["part"]): [r["n"], r["h"]] for r in marks(df, parts).collect()}}
    waiting, _ = _fs(spark, f"{path}/manifest.tmp")
    stream = fs.create(waiting, True)
    stream.write(bytearray(json.dumps(manifest).encode()))
    stream.close()
    if not fs.rename(waiting, place):
        raise FileExistsError(f"{path} holds a backup")
    return manifest


def manifest_of(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0])


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(table, part, n, n_found, intact) of every part of a backup: what the manifest says and what its files hold."""
    said = manifest_of(spark, path)
    from pyspark.sql import types as T

    out = None
    for name, entry in said["tables"].items():
        rows = [(int(p), n, h) for p, (n, h) in entry["marks"].items()]
        want = spark.createDataFrame(rows, "part int, n long, h string")
        found = marks(spark.read.schema(T.StructType.fromJson(json.loads(entry["schema"]))).parquet(f"{path}/{name}"), said["parts"]).select("part", F.col("n").alias("n_found"), F.col("h").alias("h_found"))
        j = want.join(found, "part", "full_outer").select(F.lit(name).alias("table"), "part", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_found", F.lit(0)).alias("n_found"), F.coalesce((F.col("n") == F.col("n_found")) & (F.col("h") == F.col("h_found")), F.lit(False)).alias("intact"))
        out = j if out is None else out.unionByName(j)
    return out


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a backup, after every part was found intact; :class:`Damaged` otherwise, naming what differs."""
    from pyspark.sql import types as T

    bad = verify(spark, path).where("NOT intact").orderBy("table", "part").limit(5).collect()
    if bad:
        raise Damaged("; ".join(f"{r['table']} part {r['part']}: {r['n_found']} of {r['n']} rows" for r in bad))
    said = manifest_of(spark, path)
    return {name: spark.read.schema(T.StructType.fromJson(json.loads(e["schema"]))).parquet(f"{path}/{name}") for name, e in said["tables"].items()}
