"""What of the landed files could not be read: malformed lines and unreadable files.

``read_landed`` goes on without them; the report here names every file that lost something, so that the rows it
keeps and the rows reported add up to what landed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weektide.schemas import LANDED_SCHEMA
from weektide.sources.events import recent_days

CORRUPT = "_corrupt_line"


def landed_lines(
    spark: SparkSession, root: str, as_of: dt.date | str, days: int, file_format: str = "csv", schema: T.StructType = LANDED_SCHEMA
) -> DataFrame:
    """Rows of the landed days with the ``file`` each is from, and the text of lines that do not fit the schema.

    Unreadable files are skipped.
    """
    reader = spark.read.option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).option("basePath", root)
    if file_format == "csv":
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        reader = reader.option("sep", "\t").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        # Lines are held against all columns, whichever are asked for.
        reader = reader.option("columnPruning", False)
    rows = recent_days(reader.schema(schema).format(file_format).load(root), as_of, days)
    rows = rows.withColumn("file", F.col("_metadata.file_name"))
    if file_format != "csv":
        return rows.withColumn(CORRUPT, F.lit(None).cast("string"))
    # Only values that are asked for are held against their types, so the text of a bad line asks for all of them.
    asked = F.abs(F.hash(*[n for n in schema.names if n != CORRUPT]).cast("bigint")) + 1
    return rows.withColumn(CORRUPT, F.when(asked >= 1, F.col(CORRUPT)))


def sound_lines(lines: DataFrame) -> DataFrame:
    """The rows that fit the schema."""
    return lines.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "file")


def file_reads(spark: SparkSession, root: str, as_of: dt.date | str, days: int, file_format: str = "csv", schema: T.StructType = LANDED_SCHEMA) -> DataFrame:
    """``(ingest_date, file, bytes, rows, malformed)`` of every landed file of the look-back, from a listing that opens none.

    Files of which nothing could be read have no rows; files of no bytes hold nothing and are not listed.
    """
    listed = spark.read.format("binaryFile").option("basePath", root).load(root)
    files = recent_days(listed, as_of, days).select(
        F.col("ingest_date").cast("date").alias("ingest_date"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes")
    )
    lines = landed_lines(spark, root, as_of, days, file_format, schema)
    counts = lines.groupBy("ingest_date", "file").agg(F.count(F.lit(1)).alias("rows"), F.count(CORRUPT).alias("malformed"))
    joined = files.join(counts, ["ingest_date", "file"], "left")
    return joined.select("ingest_date", "file", "bytes", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("rows", "malformed")])


def skipped_files(reads: DataFrame) -> DataFrame:
    """``(ingest_date, file, reason, rows)``: files with lines that do not fit, and unreadable ones, which give no row."""
    reason = F.when(F.col("malformed") > 0, "malformed lines").when(F.col("rows") == 0, "unreadable")
    return reads.select("ingest_date", "file", reason.alias("reason"), F.col("malformed").alias("rows")).where("reason IS NOT NULL")
