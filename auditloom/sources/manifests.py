"""Dependencies of manifests: (name, version, ecosystem, manifest, line, raw). Lines are parsed by column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.software import concrete_version

COLUMNS = ["name", "version", "ecosystem", "manifest", "line", "raw"]


def _lines(files: DataFrame, name: str) -> DataFrame:
    f = files.where(F.col("file_path").rlike(rf"(^|/){name}$"))
    return f.select(F.col("file_path").alias("manifest"), F.posexplode(F.split("content", "\n")).alias("at", "raw")).select("manifest", (F.col("at") + 1).alias("line"), F.regexp_replace("raw", r"^\s+|\s+$", "").alias("raw"))


def requirements(files: DataFrame) -> DataFrame:
    rows = _lines(files, r"requirements[^/]*\.txt").where((F.col("raw") != "") & ~F.col("raw").rlike("^[#-]"))
    bare = F.trim(F.regexp_replace("raw", r"\s*(#|;).*$", ""))
    name = F.regexp_extract(bare, r"^([A-Za-z0-9._-]+)", 1)
    return rows.select(name.alias("name"), concrete_version(F.regexp_replace(F.regexp_replace(bare, r"^[A-Za-z0-9._-]+", ""), r"^\[[^\]]*\]", "")).alias("version"), F.lit("PyPI").alias("ecosystem"), "manifest", "line", "raw").where("name <> ''")


def package_json(files: DataFrame) -> DataFrame:
    f = files.where(F.col("file_path").rlike(r"(^|/)package\.json$"))
    parsed = F.from_json("content", "struct<dependencies:map<string,string>,devDependencies:map<string,string>>")
    entries = F.concat(*[F.coalesce(F.map_entries(parsed[k]), F.array().cast("array<struct<key:string,value:string>>")) for k in ("dependencies", "devDependencies")])
    return f.select(F.col("file_path").alias("manifest"), F.explode(entries).alias("e")).select(F.col("e.key").alias("name"), concrete_version(F.col("e.value")).alias("version"), F.lit("npm").alias("ecosystem"), "manifest", F.lit(0).alias("line"), F.concat_ws("@", "e.key", "e.value").alias("raw"))


def go_mod(files: DataFrame) -> DataFrame:
    rows = _lines(files, r"go\.mod").withColumn("m", F.regexp_replace("raw", r"^require\s+", "")).where(F.col("m").rlike(r"^[a-z0-9.-]+\.[a-z]{2,}/?\S*\s+v\d"))
    return rows.select(F.regexp_extract("m", r"^(\S+)", 1).alias("name"), F.regexp_extract("m", r"\sv(\d[^\s]*)", 1).alias("version"), F.lit("Go").alias("ecosystem"), "manifest", "line", "raw")


def solidity(files: DataFrame) -> DataFrame:
    rows = _lines(files, r"[^/]+\.sol").where(F.col("raw").rlike(r"^pragma\s+solidity\s"))
    return rows.select(F.lit("solc").alias("name"), concrete_version(F.regexp_extract("raw", r"^pragma\s+solidity\s+([^;]+);", 1)).alias("version"), F.lit("Solidity").alias("ecosystem"), "manifest", "line", "raw")


def packages(files: DataFrame) -> DataFrame:
    """All manifests of a file table."""
    out = requirements(files)
    for part in (package_json(files), go_mod(files), solidity(files)):
        out = out.unionByName(part)
    return out
