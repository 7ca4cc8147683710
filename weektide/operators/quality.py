"""Data-quality reports on the decoded log. Distinct values are formed map-side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weektide.constants import EXAMPLE_ROWS

CODE_VIEW = ["EventCode", "EventRootCode", "EventDescription", "EventRootDescription", "EventDescriptionFinal"]


def combinations(decoded: DataFrame, codes: list[str], names: list[str]) -> DataFrame:
    """Each combination of codes with its number of rows ``n``; of ``names`` only whether they are there.

    The reports on codes follow from this table, whose size depends on the code lists and not on the log.
    """
    known = [F.when(F.col(c).isNotNull(), F.lit(True)).alias(c) for c in names]
    return decoded.groupBy(*codes, *known).agg(F.count(F.lit(1)).alias("n"))


def null_profile(df: DataFrame, columns: list[str], n: str | None = None) -> DataFrame:
    """Rows, nulls and share of non-null values per column, all from one pass.

    Column ``n`` says how many rows each row stands for; without it, one.
    """
    if n is None:
        counts = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    else:
        nulls = [F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col(n))), F.lit(0)).alias(c) for c in columns]
        counts = df.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n_rows"), *nulls)
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    long = counts.select("n_rows", F.expr(f"stack({len(columns)}, {pairs}) AS (column_name, n_null)"))
    return long.withColumn("match_rate", F.try_divide(F.col("n_rows") - F.col("n_null"), F.col("n_rows")))


def unmapped_codes(events: DataFrame, code: str, lookup: DataFrame, key: str) -> DataFrame:
    """Distinct codes the lookup does not know.

    Codes are made distinct before the anti join, so the join sees the code list and not
    the events.
    """
    codes = events.select(F.col(code).alias("code")).distinct()
    return codes.join(lookup.select(F.col(key).alias("code")), "code", "left_anti")


def root_mismatches(events: DataFrame) -> DataFrame:
    """Rows whose event code does not start with their root code."""
    return events.where(F.col("EventRootFromEventCode") != F.col("EventRootCode"))


def fallback_rows(events: DataFrame) -> DataFrame:
    """Rows described by their root code only."""
    return events.where(F.col("EventDescription").isNull() & F.col("EventDescriptionFinal").isNotNull())


def examples(df: DataFrame, columns: list[str] = CODE_VIEW, rows: int = EXAMPLE_ROWS) -> DataFrame:
    """First distinct combinations, in a fixed order."""
    return df.select(*columns).dropDuplicates().orderBy(*columns).limit(rows)


def counts_by(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
