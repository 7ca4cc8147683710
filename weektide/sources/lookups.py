"""Two-column lookups and the small built-in label tables."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weektide.constants import EVENT_LOOKUP_HEADER, QUAD_LABELS, ROOT_DESCRIPTIONS
from weektide.functions.text import zero_pad
from weektide.schemas import COUNTRY_SCHEMA, EVENT_CODE_SCHEMA
from weektide.sources.tables import stored

_CHECKED: WeakKeyDictionary[DataFrame, dict[str, DataFrame]] = WeakKeyDictionary()

# A lookup above either bound is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def read_country_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated, without header: code and name."""
    table = spark.read.schema(COUNTRY_SCHEMA).option("sep", "\t").csv(path)
    return table.withColumn("CountryCode", F.trim("CountryCode"))


def read_event_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated event codes; the header row inside the file is dropped."""
    table = spark.read.schema(EVENT_CODE_SCHEMA).option("sep", "\t").csv(path)
    return table.where(F.col("EventCode") != EVENT_LOOKUP_HEADER).withColumn(
        "EventCode", zero_pad(F.trim("EventCode"), 3)
    )


def checked(lookup: DataFrame, key: str) -> DataFrame:
    """Guard a lookup before it is joined.

    Keys must be unique, or the join would multiply rows. The table is stored and measured
    once, and marked for broadcast only if its rows and bytes are below the bounds; the same
    frame is not checked again.
    """
    known = _CHECKED.setdefault(lookup, {})
    if key not in known:
        known[key] = _measured(stored(lookup.where(F.col(key).isNotNull()), "lookup"), key)
    return known[key]


def _measured(lookup: DataFrame, key: str) -> DataFrame:
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in lookup.columns), F.lit(0))
    rows, keys, size = lookup.agg(
        F.count(F.lit(1)), F.count_distinct(F.col(key)), F.coalesce(F.sum(width), F.lit(0))
    ).first()
    if rows != keys:
        raise ValueError(f"lookup key {key} repeats: {rows} rows, {keys} keys")
    if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        return F.broadcast(lookup)
    return lookup


def _label_map(labels: dict) -> Column:
    return F.create_map(*[F.lit(item) for pair in labels.items() for item in pair])


def quad_label(quad_class: Column) -> Column:
    """Label of one of the four classes; a map literal, so no join is planned."""
    return F.try_element_at(_label_map(QUAD_LABELS), quad_class.cast("int"))


def root_description(root_code: Column) -> Column:
    """Description of one of the twenty root codes, from a map literal."""
    return F.try_element_at(_label_map(ROOT_DESCRIPTIONS), root_code)
