"""Cleaning and decoding at event grain: projections and map-side joins, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weektide.functions import flags
from weektide.functions.dates import monday_of, parse_day
from weektide.functions.intensity import risk_score
from weektide.functions.numbers import coerce_numbers, complete_rows
from weektide.functions.text import root_of, strip_float_suffix, zero_pad
from weektide.sources.lookups import checked, quad_label, root_description

CODE_COLUMNS = [flags.ACTOR1, flags.ACTOR2, flags.GEO]


def with_week(df: DataFrame, strict: bool = False) -> DataFrame:
    """Parse ``SQLDATE`` where it is text, drop rows without a date, add year and week."""
    day = F.col("SQLDATE")
    if not isinstance(df.schema["SQLDATE"].dataType, T.DateType):
        day = parse_day(day, strict)
    df = complete_rows(df.withColumn("SQLDATE", day), ["SQLDATE"])
    return df.withColumns({"year": F.year("SQLDATE"), "week": monday_of(F.col("SQLDATE"))})


def clean_events(df: DataFrame) -> DataFrame:
    """Event log ready for the weekly features of the crisis panel."""
    df = coerce_numbers(
        with_week(df),
        ["GoldsteinScale", "QuadClass", "NumMentions", "NumArticles", "AvgTone", "is_major_country"],
        whole=["NumMentions", "NumArticles"],
    )
    df = complete_rows(df, ["GoldsteinScale", "QuadClass", "NumMentions", "AvgTone"])
    df = df.na.fill("UNK", subset=CODE_COLUMNS)
    df = df.na.fill("Unknown", subset=["QuadClassLabel", "EventRootDescription"])
    return df.withColumn("EventDescriptionFinal", F.coalesce("EventDescriptionFinal", "EventRootDescription"))


def clean_events_lite(df: DataFrame) -> DataFrame:
    """Event log for the direction panel; a date that cannot be read is an error."""
    df = with_week(df, strict=True)
    df = df.withColumn("EventDescriptionFinal", F.coalesce("EventDescriptionFinal", "EventRootDescription"))
    df = coerce_numbers(df, ["GoldsteinScale", "NumMentions", "AvgTone"], whole=["NumMentions"])
    return complete_rows(df, ["EventDescriptionFinal", "GoldsteinScale", "NumMentions", "AvgTone"])


def has_bad_date(df: DataFrame) -> Column | None:
    """True where there is a date that cannot be read; None where dates are typed and always can."""
    if isinstance(df.schema["SQLDATE"].dataType, T.DateType):
        return None
    return F.col("SQLDATE").isNotNull() & parse_day(F.col("SQLDATE")).isNull()


def skipped_days(df: DataFrame) -> DataFrame:
    """``(ingest_date, bad_rows, n_rows)`` of the ingest days that ``clean_drops`` leaves out."""
    bad = has_bad_date(df)
    counts = df.groupBy("ingest_date").agg(
        (F.lit(0).cast("bigint") if bad is None else F.count_if(bad)).alias("bad_rows"), F.count(F.lit(1)).alias("n_rows")
    )
    return counts.where(F.col("bad_rows") > 0)


def clean_drops(df: DataFrame) -> DataFrame:
    """Daily drops: bad numbers count as 0, and an ingest day with a bad date is left out whole.

    The bad days are found in a second, narrow scan of text logs. There are no more of them
    than calendar days, so they are broadcast.
    """
    if has_bad_date(df) is not None:
        days = skipped_days(df).select(F.col("ingest_date").alias("bad_day"))
        df = df.join(F.broadcast(days), F.col("ingest_date").eqNullSafe(F.col("bad_day")), "left_anti")
    return coerce_numbers(with_week(df), ["GoldsteinScale", "NumMentions", "AvgTone"], whole=["NumMentions"], fill=0)


def marked_drops(df: DataFrame) -> DataFrame:
    """Daily drops with ``bad_date`` beside the rows: numbers coerced, no row left out.

    Where the mark rides along in a per-day aggregate or rank, bad days are left out after it and the
    drops are read once. Rows without a week have no date and count for nothing else.
    """
    bad = has_bad_date(df)
    day = F.col("SQLDATE") if bad is None else parse_day(F.col("SQLDATE"))
    marked = df.withColumns({"bad_date": F.lit(False) if bad is None else bad, "SQLDATE": day})
    marked = marked.withColumns({"year": F.year("SQLDATE"), "week": monday_of(F.col("SQLDATE"))})
    return coerce_numbers(marked, ["GoldsteinScale", "NumMentions", "AvgTone"], whole=["NumMentions"], fill=0)


def trim_codes(df: DataFrame, columns: list[str] = CODE_COLUMNS) -> DataFrame:
    present = [name for name in columns if name in df.columns]
    return df.withColumns({name: F.trim(name) for name in present}) if present else df


def pad_codes(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "EventCode": zero_pad(F.col("EventCode"), 3),
            "EventRootCode": zero_pad(F.col("EventRootCode"), 2),
        }
    )


def with_country_names(df: DataFrame, countries: DataFrame) -> DataFrame:
    """Country names of both actors and of the place of action."""
    countries = checked(countries, "CountryCode")
    for code, name in [
        (flags.ACTOR1, "Actor1CountryName"),
        (flags.ACTOR2, "Actor2CountryName"),
        (flags.GEO, "ActionGeo_CountryName"),
    ]:
        side = countries.select(F.col("CountryCode").alias(code), F.col("CountryName").alias(name))
        df = df.join(side, code, "left")
    return df


def with_event_descriptions(df: DataFrame, event_codes: DataFrame) -> DataFrame:
    """Detailed description, root description, and the first of both that is known."""
    df = df.join(checked(event_codes, "EventCode"), "EventCode", "left")
    df = df.withColumn("EventRootDescription", root_description(F.col("EventRootCode")))
    return df.withColumn("EventDescriptionFinal", F.coalesce("EventDescription", "EventRootDescription"))


def with_quad_label(df: DataFrame) -> DataFrame:
    """Add the class label where the log has none."""
    if "QuadClassLabel" in df.columns:
        return df
    return df.withColumn("QuadClassLabel", quad_label(F.col("QuadClass").try_cast("double")))


def with_major_flag(df: DataFrame) -> DataFrame:
    """Add the major-country flag where the log has none."""
    if "is_major_country" in df.columns:
        return df
    return df.withColumn("is_major_country", flags.is_major_place().cast("int"))


def decode_history(df: DataFrame, countries: DataFrame, event_codes: DataFrame) -> DataFrame:
    """Historical log with padded codes, names, labels and descriptions."""
    df = trim_codes(pad_codes(df))
    df = with_event_descriptions(with_country_names(df, countries), event_codes)
    df = with_quad_label(df)
    return df.withColumn("EventRootFromEventCode", root_of(F.col("EventCode")))


def decode_live(df: DataFrame, cameo: DataFrame) -> DataFrame:
    """Live log: codes freed from float artefacts; an unknown code describes itself.

    ``cameo`` is the public code list as ``(EventCode, EventDescription)``.
    """
    df = df.withColumn("EventCode", strip_float_suffix(F.col("EventCode").cast("string")))
    df = df.withColumn("EventCodeMapped", zero_pad(F.col("EventCode"), 3))
    side = checked(cameo, "EventCode").select(
        F.col("EventCode").alias("EventCodeMapped"), F.col("EventDescription").alias("described")
    )
    df = df.join(side, "EventCodeMapped", "left")
    df = df.withColumn("EventDescriptionFinal", F.coalesce("described", "EventCodeMapped")).drop("described")
    return with_major_flag(with_quad_label(df))


def with_risk(df: DataFrame) -> DataFrame:
    return df.withColumn("RiskScore", risk_score())
