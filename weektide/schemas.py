"""Explicit schemas; nothing is inferred, so codes keep their leading zeros."""

from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("SQLDATE", T.StringType()),
        T.StructField("Actor1Name", T.StringType()),
        T.StructField("Actor1CountryCode", T.StringType()),
        T.StructField("Actor2CountryCode", T.StringType()),
        T.StructField("ActionGeo_CountryCode", T.StringType()),
        T.StructField("EventCode", T.StringType()),
        T.StructField("EventRootCode", T.StringType()),
        T.StructField("GoldsteinScale", T.DoubleType()),
        T.StructField("QuadClass", T.IntegerType()),
        T.StructField("NumMentions", T.LongType()),
        T.StructField("NumArticles", T.LongType()),
        T.StructField("AvgTone", T.DoubleType()),
        T.StructField("SOURCEURL", T.StringType()),
    ]
)

LANDED_SCHEMA = T.StructType(
    EVENT_SCHEMA.fields + [T.StructField("ingest_date", T.DateType())]
)

PRICE_SCHEMA = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("adj_close", T.DoubleType()),
    ]
)

COUNTRY_SCHEMA = "CountryCode string, CountryName string"
EVENT_CODE_SCHEMA = "EventCode string, EventDescription string"

CRISIS_SNAPSHOT_SCHEMA = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("last_updated", T.StringType()),
        T.StructField("week", T.StringType()),
        T.StructField("features", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("top_events", T.MapType(T.StringType(), T.LongType())),
        T.StructField("top_conflict_countries", T.MapType(T.StringType(), T.LongType())),
        T.StructField("evolution", T.MapType(T.StringType(), T.DoubleType())),
    ]
)

RADAR_SCHEMA = T.StructType(
    [
        T.StructField("period", T.StringType()),
        T.StructField("regions_tracked", T.ArrayType(T.StringType())),
        T.StructField("total_events_filtered", T.StringType()),
        T.StructField("events_returned", T.StringType()),
        T.StructField(
            "events",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(name, T.StringType())
                        for name in (
                            "SQLDATE",
                            "Actor1Name",
                            "ActionGeo_CountryCode",
                            "GoldsteinScale",
                            "NumMentions",
                            "SOURCEURL",
                            "RiskScore",
                        )
                    ]
                )
            ),
        ),
    ]
)

DIRECTION_SNAPSHOT_SCHEMA = T.StructType(
    [
        T.StructField("last_updated", T.StringType()),
        T.StructField("nb_events", T.LongType()),
        T.StructField("avg_tone", T.DoubleType()),
        T.StructField("tension_score", T.DoubleType()),
        T.StructField("mat_conf_mentions", T.LongType()),
        T.StructField("nb_events_lag1", T.LongType()),
        T.StructField("avg_tone_lag1", T.DoubleType()),
        T.StructField("tension_score_lag1", T.DoubleType()),
        T.StructField("nb_events_lag2", T.LongType()),
        T.StructField("avg_tone_lag2", T.DoubleType()),
        T.StructField("tension_score_lag2", T.DoubleType()),
    ]
)
