"""From raw documents to token ids, in five stages.

Each stage reads what the one before has written, and all but the last return the columns of
``documents``. Rows may be repeated, ids and texts may be missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weektide.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from weektide.llm.common import table, written
from weektide.llm.queries import VOCABULARY

TOXIC = 0.5
LINE_DOCS = 10
# Near copies: fingerprints of 64 bits over four-word shingles, at most so many bits apart.
SHINGLE_WORDS = 4
DISTANCE = 4


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of sentences, learned from ``labels``, scores below 0.5."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).where(F.col("score") < TOXIC).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more hold. ``n_chars`` follows the new text."""
    kept = line_dedup.drop_shared_lines(docs, LINE_DOCS)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by their fingerprints, the document with the smallest id."""
    return simhash.keep_first(docs, SHINGLE_WORDS, DISTANCE)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark`` to a half or more."""
    found = decontaminate.with_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, its token ``ids``, their number, and whether they decode to the tokens of the text."""
    encoded = bpe.encode_decode(docs, VOCABULARY, keep=["doc_id", "lang", "source"])
    return encoded.select(
        "doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("bpe_encoding", encode),
]

# The stages learn, hash and merge in ways that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
