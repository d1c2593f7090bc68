"""Source texts from tables, files and folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Files that hold source code, folders that are left out, languages by extension.
EXTENSIONS = [".js", ".jsx", ".ts", ".tsx", ".mjs"]
LEFT_OUT = ["node_modules", ".git", "dist", "build"]
LANGUAGES = {
    ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".mjs": "javascript",
}
SUBMISSION = "domain STRING, filename STRING, code STRING"


def read_submissions(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Submitted texts (domain, filename, code) from JSON, Parquet, ORC or CSV files."""
    return spark.read.schema(SUBMISSION).format(format).load(path)


def as_sources(submissions: DataFrame) -> DataFrame:
    """(file, text) with ``domain/filename`` as file."""
    return submissions.select(
        F.concat_ws("/", "domain", "filename").alias("file"), F.col("code").alias("text")
    )


def read_source_tree(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of the code files under a folder; bytes that are not UTF-8 are dropped."""
    names = "|".join(e.replace(".", r"\.") for e in EXTENSIONS)
    folders = "|".join(n.replace(".", r"\.") for n in LEFT_OUT)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # only folders below the one asked for are left out
    below = F.substring_index("path", path.rstrip("/"), -1)
    kept = files.filter(F.col("path").rlike(f"(?:{names})$") & ~below.rlike(f"/(?:{folders})/"))
    text = F.col("content").cast("string")
    clean = F.when(F.is_valid_utf8(text), text).otherwise(
        F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))
    )
    return kept.select(F.col("path").alias("file"), clean.alias("text"))


def tag_language(name: Column) -> Column:
    """Language by extension, javascript if the extension is not known."""
    pairs = [F.lit(x) for pair in LANGUAGES.items() for x in pair]
    extension = F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))
    return F.coalesce(F.create_map(*pairs)[extension], F.lit("javascript"))
