"""Drop lines that many documents share.

Lines are exploded, hashed and counted by distinct documents; the positions of lines over
the threshold are gathered per text, and each document is put together again from the
positions that stay. Whole texts cross the network once, in the last join. Counting
combines before each shuffle, so a line that a third of all documents holds is no hot
spot; the joins leave hot keys to the adaptive skew handling, one side being unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weektide.llm.common import ASCII_SPACE, ascii_lower, other_columns, written


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def digest(text: Column) -> Column:
    """128 bits, so that different lines or texts do not meet at any realistic size."""
    return F.unhex(F.md5(text))


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(doc_id, text_key, pos, line_hash)`` for each line whose key has ``min_chars`` code points."""
    rows = docs.select("doc_id", digest(F.coalesce("text", F.lit(""))).alias("text_key"), F.posexplode(lines_of(F.col("text"))))
    keyed = rows.select("doc_id", "text_key", "pos", line_key(F.col("col")).alias("line"))
    return keyed.where(F.char_length("line") >= min_chars).select("doc_id", "text_key", "pos", digest(F.col("line")).alias("line_hash"))


def drop_shared_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Documents without the lines that ``min_docs`` or more documents hold.

    Returns the columns of ``docs`` with the new ``text``, and ``n_lines`` (before) and
    ``n_dropped``; columns of these names in the input are replaced. A missing or empty text
    is one empty line and comes back as empty text, as does a text that loses all lines.
    Rows of one ``doc_id`` count as one document, and so do all rows without an id. Repeated
    rows are each returned. An empty table gives an empty table.
    """
    lines = written(hashed_lines(docs, min_chars), "line-hashes")
    counted = lines.select("line_hash", "doc_id").distinct().groupBy("line_hash").agg(F.count(F.lit(1)).alias("n_docs"))
    # Written, so that the join below has two plain inputs and a hot line can be split.
    shared = written(counted.where(F.col("n_docs") >= min_docs).select("line_hash"), "shared-lines")
    dropped = (
        lines.select("text_key", "pos", "line_hash")
        .join(shared, "line_hash")
        .groupBy("text_key")
        .agg(F.collect_set("pos").alias("drop"))
    )
    keep = other_columns(docs, ["text", "n_lines", "n_dropped"])
    rows = docs.select(F.struct(*keep).alias("row") if keep else F.lit(None).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    joined = rows.join(dropped, digest(F.col("text")) == F.col("text_key"), "left").withColumn("lines", lines_of(F.col("text")))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    stay = F.when(F.col("drop").isNull(), every).otherwise(F.array_except(every, F.col("drop")))
    # array_except works by hash and keeps the order, so a text of very many lines stays linear.
    rebuilt = joined.withColumn("stay", stay).select(
        "row",
        F.array_join(F.transform("stay", lambda i: F.col("lines")[i]), "\n").alias("text"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size("stay")).cast("bigint").alias("n_dropped"),
    )
    return rebuilt.select(*[F.col("row").getField(name).alias(name) for name in keep], "text", "n_lines", "n_dropped")
