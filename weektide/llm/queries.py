"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weektide.llm import (
    ann,
    bpe,
    decontaminate,
    hmm_lm,
    html_wrappers,
    lang_mix,
    line_dedup,
    sharding,
    simhash,
    token_align,
    toxicity,
    turn_repair,
    url_filter,
)
from weektide.llm.common import held_out, table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

Query = Callable[[SparkSession, str], DataFrame]
LLM_QUERIES: dict[str, Query] = {}

URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def query(fn: Query) -> Query:
    LLM_QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs, shingle=4, radius=4)
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex(F.col("fingerprint")[0]), 16, "0")).alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
    )


@query
def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "offending",
    )


@query
def op3_url_filter(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op4_html_wrappers(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_wrappers.extract(pages).withColumn("n_chars", F.char_length("text").cast("bigint"))


@query
def op5_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return bpe.encode_decode(docs, VOCABULARY, keep=["doc_id"]).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op6_line_dedup(spark, sf_dir):
    kept = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op7_decontamination(spark, sf_dir):
    """One row for each document and benchmark item whose words it covers to a half or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.with_leaks(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    leaks = found.select("doc_id", F.explode("leaks").alias("leak"))
    return leaks.select("doc_id", "leak.item_id", "leak.coverage", F.size("leak.tiles").alias("n_tiles"), "leak.tiles")


@query
def op8_neighbours(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query
def op9_sharding(spark, sf_dir):
    metadata = sharding.document_metadata(table(spark, sf_dir, "documents"))
    return sharding.document_shards(metadata, 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op10_lang_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = lang_mix.identify(docs.select("doc_id", "text"), keep=["doc_id"], model=lang_mix.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "lang_mix")


@query
def op11_token_align(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = token_align.aligned(docs, BYTE_LEVEL, PIECES, keep=["doc_id"])
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    counted = token_align.with_link_counts(found.withColumn("groups_sha256", digest).drop("groups"))
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query
def op12_hmm_lm(spark, sf_dir):
    return hmm_lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


@query
def op13_turn_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return turn_repair.report(rows, turn_repair.damaged(rows))
