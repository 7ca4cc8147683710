"""Helpers shared by the operators on documents."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weektide.session import work_folder

# The white space of the contracts: blank and the five ASCII controls from tab to return.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Later jobs start from the files, so a lost executor costs nothing that came before.
    """
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model may learn from; a missing id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def other_columns(df: DataFrame, taken: list[str]) -> list[str]:
    """Columns of ``df`` whose names an operator does not give to columns of its own."""
    names = {name.lower() for name in taken}
    return [name for name in df.columns if name.lower() not in names]
