"""File sources: walks, inventories, incremental changes, scan reports, labels. Paths go to Spark's readers, never to open()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a walk leaves out.
SKIP_DIRS = [".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", "vendor", "target", ".tox", ".mypy_cache"]
SECRET_DOTFILES = [".env", ".npmrc", ".pypirc", ".netrc", ".htpasswd"]
NON_CODE = r"(?i)\.(png|jpe?g|gif|svg|ico|pdf|zip|gz|tar|woff2?|ttf|lock|min\.js|map)$"
TEST_FILE = r"(?i)(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]*$|_test\.[a-z]+$|\.spec\.[a-z]+$"
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "rs": "rust", "java": "java", "rb": "ruby", "php": "php", "sol": "solidity", "tf": "terraform", "yml": "yaml", "yaml": "yaml", "sh": "shell"}
MAX_BYTES = 1_000_000


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.element_at(table, extension(path))


def is_kept(path: Column, size: Column) -> Column:
    """A walk keeps a file: small, no skipped or hidden directory above it, no non-code ending; dotfiles only if they hold secrets."""
    parts = F.split(path, "/")
    dirs, name = F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)
    hidden = F.exists(dirs, lambda d: d.startswith(".") & (F.length(d) > 1))
    dotfile = name.startswith(".") & ~name.isin(SECRET_DOTFILES) & ~name.startswith(".env")
    return (size <= MAX_BYTES) & ~F.arrays_overlap(dirs, F.array(*map(F.lit, SKIP_DIRS))) & ~hidden & ~dotfile & ~path.rlike(NON_CODE)


def _dotfiles(spark: SparkSession, root: str) -> list[tuple[str, int, str]]:
    """(path, length, content) of the dotfiles that hold secrets, which Spark's readers leave out: read through the file system's client."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(root)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found, out = fs.listFiles(place, True), []
    while found.hasNext():
        status = found.next()
        name = status.getPath().getName()
        if (name in SECRET_DOTFILES or name.startswith(".env")) and status.getLen() <= MAX_BYTES:
            stream = fs.open(status.getPath())
            out.append((status.getPath().toString(), status.getLen(), jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            stream.close()
    return out


def walk(spark: SparkSession, root: str, extensions: list[str] | None = None, dotfiles: bool = False) -> DataFrame:
    """(file_path relative to root, size, language, content) of the files under ``root``; length and path are pushed into the scan.

    ``dotfiles`` also reads dotfiles that hold secrets: the driver lists the tree a second time and reads those few small files.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= MAX_BYTES)
    raw = raw.select("path", F.col("length").alias("size"), F.decode("content", "UTF-8").alias("content"))
    if dotfiles and (more := _dotfiles(spark, root)):
        raw = raw.unionByName(spark.createDataFrame(more, "path string, size long, content string"))
    base = root.rstrip("/").rpartition("://")[2].removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), f"^{base}/", "")
    f = raw.select(path.alias("file_path"), "size", "content")
    f = f.where(is_kept(F.col("file_path"), F.col("size"))).withColumn("language", language(F.col("file_path")))
    return f.where(extension(F.col("file_path")).isin(extensions)) if extensions else f


def source_files(files: DataFrame) -> DataFrame:
    return files.where(~F.col("file_path").rlike(TEST_FILE))


def inventory(files: DataFrame) -> DataFrame:
    """(language, n_files, n_bytes, n_tests, top_dirs)."""
    top = F.when(F.col("file_path").contains("/"), F.substring_index("file_path", "/", 1))
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"), F.count_if(F.col("file_path").rlike(TEST_FILE)).alias("n_tests"), F.sort_array(F.collect_set(top)).alias("top_dirs"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_path, status A/M/D) between two snapshots, by content hash."""
    h = lambda df, name: df.select("file_path", F.sha2("content", 256).alias(name))
    j = h(before, "old").join(h(after, "new"), "file_path", "full_outer")
    return j.select("file_path", F.when(F.col("old").isNull(), "A").when(F.col("new").isNull(), "D").when(F.col("old") != F.col("new"), "M").alias("status")).where("status IS NOT NULL")


FINDING_SCHEMA = "rule_id string, title string, severity string, category string, confidence double, file_path string, file string, line_number int, line int, detail string, snippet string, metadata string"


def scan_report(spark: SparkSession, path: str) -> DataFrame:
    """Findings of scan reports: JSON files that hold a list, or an object with ``findings``; aliases resolved."""
    raw = spark.read.text(path, wholetext=True)
    rows = F.when(F.trim("value").startswith("["), F.from_json("value", f"array<struct<{FINDING_SCHEMA.replace(' string', ':string').replace(' double', ':double').replace(' int', ':int')}>>")).otherwise(
        F.from_json("value", f"struct<findings:array<struct<{FINDING_SCHEMA.replace(' string', ':string').replace(' double', ':double').replace(' int', ':int')}>>>")["findings"]
    )
    f = raw.select(F.explode(rows).alias("f")).select("f.*")
    return f.select("rule_id", "title", F.coalesce("severity", "category").alias("severity"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("file_path", "file").alias("file_path"), F.coalesce("line_number", "line").alias("line_number"), F.coalesce("detail", "snippet").alias("detail"), "metadata")


def dynamic_report(spark: SparkSession, path: str) -> DataFrame:
    """Dynamic-scan results, JSON lines: template_id, name, severity, tags, matched_at."""
    schema = "`template-id` string, info struct<name:string,severity:string,tags:array<string>>, `matched-at` string"
    raw = spark.read.schema(schema).json(path)
    return raw.select(F.col("`template-id`").alias("template_id"), F.col("info.name").alias("name"), F.lower("info.severity").alias("severity"), F.col("info.tags").alias("tags"), F.col("`matched-at`").alias("matched_at"))


def expected_results(spark: SparkSession, path: str) -> DataFrame:
    """(test_id, category, is_vulnerable, cwe) of a labelled CSV, found by the cells' form rather than their place."""
    cells = F.transform(F.split("value", ","), lambda c: F.trim(c))
    first = lambda p: F.get(F.filter(cells, lambda c: c.rlike(p)), F.lit(0))
    t = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return t.select(F.get(cells, F.lit(0)).alias("test_id"), F.get(cells, F.lit(1)).alias("category"), (F.lower(first("(?i)^(true|false)$")) == "true").alias("is_vulnerable"), F.concat(F.lit("CWE-"), first(r"^\d+$")).alias("cwe")).where("is_vulnerable IS NOT NULL")


def patterns(table: DataFrame, project: str, seed: DataFrame) -> DataFrame:
    """Active patterns of a project or of all; the seed where the table has none."""
    own = table.where(F.col("active") & F.col("project").isin(project, "*")).select("title", "search_pattern", "category", "echelon")
    return own if own.limit(1).count() else seed.select("title", "search_pattern", "category", "echelon")
