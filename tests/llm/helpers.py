"""Documents with every awkward case, and small helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PROSE = "the quick brown fox jumps over the lazy dog while the small cat sleeps under an old oak tree near a quiet river "


def documents(spark: SparkSession, texts: list[tuple[int | None, str | None]], lang: str | None = "en") -> DataFrame:
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark: SparkSession) -> DataFrame:
    """Missing and repeated ids and texts, empty, blank and very long texts, ties, repeated rows."""
    return documents(
        spark,
        [
            (1, PROSE * 3),
            (2, PROSE * 3),
            (2, PROSE * 3),
            (3, None),
            (4, ""),
            (5, " \n\t "),
            (None, "one without an id"),
            (None, "one without an id"),
            (None, None),
            (6, "word " * 60_000),
            (7, "\n".join(["line %d" % (i % 7) for i in range(3000)])),
            (8, "Grüße, naïve café — ½ ²\r\n漢字 <|endoftext|>"),
            (9, "x" * 100_000),
        ],
    )


def clashing(df: DataFrame, names: list[str]) -> DataFrame:
    """The same rows with extra columns that are named like an operator's own."""
    return df.selectExpr("*", *[f"'mine' AS `{n}`" for n in names])


def empty(df: DataFrame) -> DataFrame:
    return df.limit(0)
