"""Tables and page texts as DataFrames."""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Extension -> DataFrameReader format.
FORMATS = {".csv": "csv", ".json": "json", ".orc": "orc", ".parquet": "parquet", ".txt": "text"}


def load_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    header_row: int = 0,
    **options: str,
) -> DataFrame:
    """Read a table by its extension.

    Without ``schema`` a CSV is read as text columns, which keeps leading zeros; pass
    ``inferSchema=True`` for types. ``header_row`` counts the title lines above the
    header of a single CSV file.
    """
    extension = os.path.splitext(urlparse(path).path.rstrip("/"))[1].lower()
    if extension not in FORMATS:
        raise ValueError(
            f"Unsupported file type '{extension}'. Supported: {', '.join(sorted(FORMATS))}"
        )
    if not any(c in path for c in "*?[{") and not _exists(spark, path):
        raise FileNotFoundError(f"File not found: {path}")
    if extension == ".csv" and header_row:
        return _csv_below_titles(spark, path, header_row, schema, options)
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if extension == ".csv":
        reader = reader.option("header", options.get("header", True))
    return reader.format(FORMATS[extension]).load(path)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the file system that Spark would read ``path`` from has it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _csv_below_titles(spark, path, header_row, schema, options) -> DataFrame:
    lines = spark.read.text(path)
    head = [r.value for r in lines.limit(header_row + 1).collect()]
    if schema is None:
        names = spark.createDataFrame([(head[-1],)], "line string").select(
            F.from_csv("line", F.schema_of_csv(head[-1]), options)
        )
        cells = names.first()[0]
        schema = T.StructType([T.StructField(str(c), T.StringType()) for c in cells])
    ddl = schema if isinstance(schema, str) else ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields
    )
    # Ids of the first split count its lines from 0 and later splits start at 2^33,
    # so the title block is cut without a pass to number the lines.
    below = lines.filter(F.monotonically_increasing_id() > header_row).filter(F.col("value") != "")
    return below.select(F.from_csv("value", ddl, options).alias("r")).select("r.*")


def load_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page texts (doc_id, page_number, text); a page without text is empty."""
    schema = "doc_id string, page_number int, text string"
    pages = load_table(spark, path, schema=schema)
    return pages.withColumn("text", F.coalesce("text", F.lit("")))


def with_file_metadata(df: DataFrame) -> DataFrame:
    """Name, path, size and read time of the file each row came from.

    Apply right after a file read: ``_metadata`` is a column of the scan only.
    """
    return df.select(
        "*",
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_size").alias("file_size_bytes"),
        F.current_timestamp().alias("read_at"),
    )


def source_summary(df: DataFrame, file_format: str | None = None) -> DataFrame:
    """One row: format, rows, column count and names; pages and characters of page texts."""
    measures = [
        F.lit(file_format).cast("string").alias("format"),
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(", ".join(df.columns)).alias("column_names"),
    ]
    if {"page_number", "text"} <= set(df.columns):
        measures += [
            F.max("page_number").alias("page_count"),
            F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"),
        ]
    return df.agg(*measures)


def files_summary(df: DataFrame) -> DataFrame:
    """One row per file of a file-backed table: path, bytes, rows."""
    meta = df.select(
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_size").alias("file_size_bytes"),
    )
    return meta.groupBy("file_name", "file_size_bytes").agg(F.count(F.lit(1)).alias("row_count"))


# Fixed value: stands for a page without text.
EMPTY_PAGE = "[No extractable text on this page]"


def printable_pages(pages: DataFrame) -> DataFrame:
    """Heading and stripped text per page, with a placeholder for an empty page."""
    from veritab.functions.text import strip

    body = F.expr(strip("text"))
    return pages.select(
        "doc_id",
        "page_number",
        F.concat(F.lit("Page "), F.col("page_number").cast("string")).alias("heading"),
        F.when(F.coalesce(body, F.lit("")) == "", EMPTY_PAGE).otherwise(body).alias("body"),
    )


def page_totals(pages: DataFrame, separator: str = "\n\n") -> DataFrame:
    """Pages and characters per document, as if the pages were joined by ``separator``."""
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"),
        (F.sum(F.length("text")) + (F.count(F.lit(1)) - 1) * len(separator)).alias("characters"),
    )
