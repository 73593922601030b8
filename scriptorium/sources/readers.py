"""Labelled cases and notes from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

CASE = "id string, raw string, candidate string, expected string, tags array<string>, source string"
CASE_FIELDS = ("id", "raw", "candidate", "expected", "tags", "source")
RETRY_CASE = "id string, original string, retry string, issue string, expected string, tags array<string>"
RETRY_FIELDS = ("id", "original", "retry", "issue", "expected", "tags")


def parse_cases(lines: DataFrame, schema: str = CASE, required: tuple[str, ...] = CASE_FIELDS) -> tuple[DataFrame, DataFrame]:
    """JSON lines in ``value`` to cases, and refused lines with their reason."""
    rows = lines.filter(strip("value") != "")
    rows = rows.withColumns({
        "_j": F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}),
        "_k": F.json_object_keys("value"),
    })
    missing = F.array_sort(F.array_except(F.array(*[F.lit(r) for r in required]), F.coalesce("_k", F.array().cast("array<string>"))))
    broken = F.col("_j").isNull() | F.col("_j._bad").isNotNull() | F.col("_k").isNull()
    reason = F.when(broken, F.lit("JSON invalide")).when(
        F.size(missing) > 0, F.concat(F.lit("champs manquants: "), F.array_join(missing, ", "))
    )
    rows = rows.withColumn("reason", reason)
    rest = [c for c in lines.columns if c != "value"]
    good = rows.filter("reason is null").select(*rest, "_j.*").drop("_bad")
    return good, rows.filter("reason is not null").select(*rest, "value", "reason")


def read_cases(spark: SparkSession, path: str, schema: str = CASE, required: tuple[str, ...] = CASE_FIELDS) -> tuple[DataFrame, DataFrame]:
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    return parse_cases(lines, schema, required)


def _field(front: Column, *names: str) -> Column:
    """The last value given to a key, quotes trimmed; the first key that has one."""
    def one(name):
        pattern = rf"^\s*{name}\s*:"
        lines = F.filter(front, lambda x: x.rlike(pattern))
        value = strip(F.regexp_replace(F.try_element_at(lines, F.lit(-1)), pattern, ""))
        return F.nullif(F.regexp_replace(F.regexp_replace(value, '^"+|"+$', ""), "^'+|'+$", ""), F.lit(""))
    return F.coalesce(*[one(n) for n in names])


def _items(value: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(value, F.lit("")), r"^\[(.*)\]$", "$1")
    clean = F.transform(F.split(bare, ","), lambda x: F.regexp_replace(strip(x), "^[\"']+|[\"']+$", ""))
    return F.filter(clean, lambda x: x != "")


def parse_notes(files: DataFrame) -> DataFrame:
    """Notes from (path, content): front matter, else first heading, else file name."""
    lines = F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n")
    f = files.withColumn("_lines", lines).withColumn("_open", strip(F.element_at("_lines", 1)) == "---")
    closing = F.array_min(F.filter(
        F.transform("_lines", lambda x, i: F.when((i > 0) & (strip(x) == "---"), i)), lambda i: i.isNotNull()
    ))
    inside = F.slice("_lines", 2, F.coalesce(closing, F.size("_lines")) - 1)
    front = F.filter(inside, lambda x: F.contains(x, F.lit(":")) & ~F.ltrim(x).startswith("#"))
    f = f.withColumn("_front", F.when(F.col("_open"), front).otherwise(F.array().cast("array<string>")))
    heading = F.nullif(F.regexp_extract("content", r"(?m)^#\s+(.+?)\s*$", 1), F.lit(""))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "")
    title = strip(F.coalesce(_field(F.col("_front"), "title", "titre"), heading, stem))
    return f.select(
        "path", title.alias("title"), _items(_field(F.col("_front"), "aliases")).alias("aliases"),
        _items(_field(F.col("_front"), "tags")).alias("tags"), F.coalesce(_field(F.col("_front"), "type"), F.lit("")).alias("type"),
    ).filter("title <> ''")


def index_notes(spark: SparkSession, root: str) -> DataFrame:
    """Every Markdown file below a folder."""
    files = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )
    return parse_notes(files)
