"""The supplied order tables seen as an event log, a price table and lookups.

One line item is one event. Spark broadcasts a dimension only when its measured size
allows, and splits skewed partitions otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weektide.constants import MAJOR_CODES
from weektide.functions.text import zero_pad

# Geography codes given to the remainders of a part number by 8; 7 has none.
GEO_CODES = ["US", "CH", "RS", "IR", "IS", "SY", "UK"]

# Market segments in the role of tickers; one doubles as volatility index.
TICKERS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
INDEX_TICKER = "MACHINERY"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def state(spark: SparkSession, sf_dir: str) -> tuple:
    """The folder and the size and age of the tables the models are fitted on; it changes when they are rewritten."""
    out = [sf_dir]
    for name in ("lineitem", "orders", "customer", "supplier"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        out.append((sum(f.getLen() for f in files), max(f.getModificationTime() for f in files)))
    return tuple(out)


def country_code(nation: Column) -> Column:
    """Actor code of a nation key: the major countries, one unknown, the rest made up."""
    known = F.try_element_at(F.array(*[F.lit(code) for code in MAJOR_CODES]), nation + 1)
    other = F.concat(F.lit("ZZ"), nation.cast("string"))
    return F.when(nation < len(MAJOR_CODES), known).when(nation > len(MAJOR_CODES), other)


def line_columns() -> dict[str, Column]:
    """Event columns a line item gives on its own."""
    geo = F.array(*[F.lit(code) for code in GEO_CODES])
    root = F.lpad((F.col("l_partkey") % 20 + 1).cast("string"), 2, "0")
    mentions = F.col("l_quantity").cast("int").cast("bigint")
    return {
        "l_orderkey": F.col("l_orderkey"),
        "l_linenumber": F.col("l_linenumber"),
        "ingest_date": F.col("l_shipdate").cast("date"),
        "SQLDATE": F.col("l_shipdate").cast("date"),
        "ActionGeo_CountryCode": F.try_element_at(geo, (F.col("l_partkey") % 8 + 1).cast("int")),
        "EventCode": F.concat(root, (F.col("l_linenumber") % 10).cast("string")),
        "EventRootCode": root,
        "GoldsteinScale": F.round((F.lit(0.05) - F.col("l_discount")) * 200, 1),
        "QuadClass": ((F.col("l_linenumber") - 1) % 4 + 1).cast("int"),
        "NumMentions": mentions,
        "NumArticles": mentions + F.col("l_linenumber"),
        "AvgTone": F.round((F.col("l_tax") - F.lit(0.04)) * 100, 2),
        "is_major_country": F.when(F.col("l_suppkey") % 10 == 0, 1).when(F.col("l_suppkey") % 10 != 1, 0),
        "SOURCEURL": F.when(
            F.col("l_orderkey") % 10 != 0, F.concat(F.lit("https://example.test/"), F.col("l_orderkey").cast("string"))
        ),
    }


def line_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without actors: no join at all."""
    columns = line_columns()
    return table(spark, sf_dir, "lineitem").select(*[c.alias(n) for n, c in columns.items()])


def _with_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    buyers = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")
    # Spark broadcasts a side only if its measured size allows. Customers join the orders
    # first: the lines are then shuffled once.
    lines = table(spark, sf_dir, "lineitem")
    return lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).join(
        supplier, F.col("l_suppkey") == F.col("s_suppkey")
    )


def world_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with both actors, dated by ship date."""
    columns = line_columns() | {
        "ref_date": F.col("o_orderdate").cast("date"),
        "Actor1Name": F.col("c_name"),
        "Actor1CountryCode": country_code(F.col("c_nationkey")),
        "Actor2CountryCode": country_code(F.col("s_nationkey")),
    }
    return _with_actors(spark, sf_dir).select(*[c.alias(n) for n, c in columns.items()])


def daily_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they land: the ship date is the ingest day, the order date the event's own."""
    return world_events(spark, sf_dir).withColumn("SQLDATE", F.col("ref_date")).drop("ref_date", "is_major_country")


def dirty_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drops as text, with a bad date on the first lines that land on a 13th."""
    drops = daily_drops(spark, sf_dir)
    bad = (F.dayofmonth("ingest_date") == 13) & (F.col("l_linenumber") == 1)
    return drops.withColumn("SQLDATE", F.when(bad, "bad").otherwise(F.date_format("SQLDATE", "yyyyMMdd")))


def dirty_events(events: DataFrame) -> DataFrame:
    """The same log as text, with bad dates and numbers and without some values."""
    line = F.col("l_linenumber")
    day = F.date_format("SQLDATE", "yyyyMMdd")
    return events.withColumns(
        {
            "SQLDATE": F.when(line == 7, "bad").otherwise(day),
            "GoldsteinScale": F.when(line == 6, "n/a").otherwise(F.col("GoldsteinScale").cast("string")),
            "NumMentions": F.when(line == 5, "").otherwise(F.col("NumMentions").cast("string")),
            "AvgTone": F.when(F.col("l_orderkey") % 11 != 0, F.col("AvgTone").cast("string")),
            "QuadClassLabel": F.when(line != 4, F.concat(F.lit("class "), F.col("QuadClass").cast("string"))),
            "EventRootDescription": F.when(line != 3, F.concat(F.lit("root "), F.col("EventRootCode"))),
            "EventDescriptionFinal": F.when(line % 2 == 0, F.concat(F.lit("event "), F.col("EventCode"))),
        }
    )


def country_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country names of the actor codes; the two highest nations are left out."""
    nation = table(spark, sf_dir, "nation").where(F.col("n_nationkey") < 23)
    return nation.select(country_code(F.col("n_nationkey")).alias("CountryCode"), F.col("n_name").alias("CountryName"))


def event_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event codes with a description, from part names; root 13 and last digit 5 are not described."""
    root = F.col("p_partkey") % 20 + 1
    digit = F.col("p_partkey") % 7 + 1
    described = table(spark, sf_dir, "part").where((root != 13) & (digit != 5))
    code = F.concat(zero_pad(root.cast("string"), 2), digit.cast("string"))
    return described.groupBy(code.alias("EventCode")).agg(F.min("p_name").alias("EventDescription"))


def prices(spark: SparkSession, sf_dir: str, ticker: str = "c_mktsegment", adjusted: bool = False) -> DataFrame:
    """Daily prices: highest order total per ticker and day."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col(ticker).cast("string").alias("ticker"))
    total = F.col("o_totalprice")
    extra = [F.max(F.when(F.col("o_orderstatus") != "F", total)).alias("adj_close")] if adjusted else []
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("ticker", F.col("o_orderdate").cast("date").alias("date"))
        .agg(F.max(total).alias("close"), *extra)
    )


def stream_schema() -> T.StructType:
    return T.StructType(
        [
            T.StructField("event_id", T.LongType()),
            T.StructField("ts", T.TimestampNTZType()),
            T.StructField("user_id", T.LongType()),
            T.StructField("event_type", T.StringType()),
            T.StructField("value", T.DoubleType()),
            T.StructField("props", T.StringType()),
        ]
    )


def activity_as_events(activity: DataFrame) -> DataFrame:
    """The ``events`` table in the shape of the event log; works on a stream too."""
    user = F.col("user_id").cast("int")
    mentions = (F.col("event_id") % 50 + 1).cast("bigint")
    geo = F.array(*[F.lit(code) for code in GEO_CODES])
    return activity.select(
        F.col("ts").cast("date").alias("SQLDATE"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("Actor1Name"),
        country_code(user % 25).alias("Actor1CountryCode"),
        country_code((user + 1) % 25).alias("Actor2CountryCode"),
        F.try_element_at(geo, user % 8 + 1).alias("ActionGeo_CountryCode"),
        F.col("event_type").alias("EventCode"),
        F.col("event_type").alias("EventDescriptionFinal"),
        (F.col("event_id") % 21 - 10).cast("double").alias("GoldsteinScale"),
        (F.col("event_id") % 4 + 1).cast("int").alias("QuadClass"),
        mentions.alias("NumMentions"),
        (mentions + 1).alias("NumArticles"),
        F.round(F.col("value"), 2).alias("AvgTone"),
        F.when(user % 10 == 0, 1).otherwise(0).alias("is_major_country"),
        F.concat(F.lit("https://example.test/"), F.col("event_id").cast("string")).alias("SOURCEURL"),
    )
