"""Objects to scan and lines to look up, as DataFrames or streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Larger objects give an error row.
MAX_BYTES = 64 << 20
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def from_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """object_id (the path) and content of every file."""
    files = spark.read.format("binaryFile").options(**options).load(path)
    return files.select(F.col("path").alias("object_id"), "content")


def stream_files(spark: SparkSession, path: str, **options) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).options(**options).load(path)
    return files.select(F.col("path").alias("object_id"), "content")


def from_text(rows: DataFrame, object_id: str, text: str, *more: str) -> DataFrame:
    """object_id, content and further columns; the UTF-8 bytes of a text column."""
    return rows.select(F.col(object_id).cast("string").alias("object_id"), F.encode(F.col(text), "UTF-8").alias("content"), *more)


def limited(objects: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Adds error; the content of objects that are too large, and null content, are not scanned."""
    size = F.octet_length("content")
    error = F.when(size > max_bytes, F.format_string(f"payload too large: exceeds {max_bytes} bytes"))
    return objects.withColumn("error", error).withColumn("content", F.when(error.isNull(), F.col("content")))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (in file order) and line of a text file of lookups."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def lookup_columns(line: Column) -> dict[str, Column]:
    """digest, size and problem of a lookup line: a JSON object, algo:hex, or a bare digest."""
    line = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    schema = "hash string, sha256 string, sha1 string, md5 string, size bigint, _bad string"
    json = F.from_json(line, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    is_json = F.startswith(line, F.lit("{"))
    bad = is_json & (json["_bad"].isNotNull() | json.isNull())
    digest = (
        F.when(bad, F.lit(None))
        .when(is_json, F.coalesce(json["hash"], json["sha256"], json["sha1"], json["md5"], F.lit("")))
        .when(F.contains(line, F.lit(":")), F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1))
        .otherwise(line)
    )
    return {"line": line, "digest": digest, "size": F.when(is_json & ~bad, json["size"]), "problem": F.when(bad, F.lit("invalid json"))}
