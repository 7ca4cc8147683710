"""Decode the event history and store it for the panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weektide.operators.clean import clean_events, decode_history, with_major_flag
from weektide.operators.quality import CODE_VIEW, combinations, examples, fallback_rows, null_profile, root_mismatches, unmapped_codes
from weektide.sources.events import read_history, require_columns
from weektide.sources.lookups import read_country_lookup, read_event_lookup
from weektide.sources.tables import stored, write_table

COUNTRY_NAMES = ["Actor1CountryName", "Actor2CountryName", "ActionGeo_CountryName"]
MAPPED_COLUMNS = [*COUNTRY_NAMES, "EventDescription"]


def store_history(
    spark: SparkSession,
    paths: list[str],
    country_path: str,
    event_code_path: str,
    out: str,
    file_format: str = "csv",
) -> None:
    """Period files to one typed Parquet table with year folders.

    The text is parsed here once. Later jobs read typed columns and prune by year.
    """
    raw = read_history(spark, paths, file_format)
    decoded = decode_history(raw, read_country_lookup(spark, country_path), read_event_lookup(spark, event_code_path))
    cleaned = clean_events(require_columns(with_major_flag(decoded))).drop("year")
    write_table(cleaned, out, year_of="SQLDATE")


def quality_reports(decoded: DataFrame, countries: DataFrame) -> dict[str, DataFrame]:
    """The checks made on a decoded log, each a small table.

    The log is read once, into a written table of code combinations; all reports read that.
    """
    found = combinations(decoded, ["Actor1CountryCode", *CODE_VIEW, "EventRootFromEventCode"], COUNTRY_NAMES)
    combined = stored(found, "code-combinations")
    mismatches = root_mismatches(combined)
    fallbacks = fallback_rows(combined)
    return {
        "null_profile": null_profile(combined, [*MAPPED_COLUMNS, "EventDescriptionFinal"], "n"),
        "unmapped_actor_codes": unmapped_codes(combined, "Actor1CountryCode", countries, "CountryCode"),
        "root_mismatch_examples": examples(
            mismatches, ["EventCode", "EventRootCode", "EventRootFromEventCode", "EventDescription", "EventRootDescription"]
        ),
        "fallback_examples": examples(fallbacks),
        "code_examples": examples(combined, CODE_VIEW),
    }
