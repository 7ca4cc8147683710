"""Writing and reading result tables and snapshot documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weektide.session import work_folder


def write_table(df: DataFrame, path: str, file_format: str = "parquet", year_of: str | None = None) -> None:
    """Write a result table; ``year_of`` names the date column that gives the year folders.

    Rows of one year are spread over the writing tasks by AQE's rebalance, which splits
    a year that holds most of the rows and merges small ones.
    """
    writer = df
    if year_of:
        writer = df.withColumn("year", F.year(year_of)).hint("rebalance", "year")
    out = writer.write.mode("overwrite").format(file_format)
    if file_format == "csv":
        out = out.option("header", True)
    if year_of:
        out = out.partitionBy("year")
    out.save(path)


def stored(df: DataFrame, purpose: str, by: str | None = None) -> DataFrame:
    """Write a frame that several jobs read to the shared folder and read it back.

    Later jobs start from the files, so a lost executor costs no recomputation of what
    came before. The rebalance makes files of even size: small results become one file,
    large partitions are split. ``by`` names a column that gets folders of its own, so that
    a filter on it reads only those.
    """
    spark = df.sparkSession
    path = work_folder(spark, purpose)
    if by:
        df.hint("rebalance", by).write.partitionBy(by).parquet(path)
        return spark.read.schema(df.schema).parquet(path).select(df.columns)
    df.hint("rebalance").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON document per row. Nulls stay visible."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def publish(documents: dict[str, DataFrame], out: str) -> int:
    """Write a set of documents as the next version below ``out`` and return its number.

    The pointer to the version is written last, so readers of ``current_version`` have all documents of one version: if
    one cannot be written, the version before stays. Two writers of the same number do not mix: the second fails.
    """
    spark = next(iter(documents.values())).sparkSession
    number = max([0, *_numbers(spark, f"{out}/versions"), *_numbers(spark, f"{out}/pointers")]) + 1
    for name, df in documents.items():
        df.write.mode("error").option("ignoreNullFields", False).json(f"{out}/versions/number={number}/{name}")
    spark.range(1).select(F.lit(number).alias("version")).coalesce(1).write.mode("error").json(f"{out}/pointers/number={number}")
    return number


def current_version(spark: SparkSession, out: str) -> str | None:
    """Folder of the newest version whose pointer is complete; None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    done = [n for n in _numbers(spark, f"{out}/pointers") if fs.exists(path(f"{out}/pointers/number={n}/_SUCCESS"))]
    return f"{out}/versions/number={max(done)}" if done else None


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return [int(n.partition("=")[2]) for n in names if n.startswith("number=")]


def as_documents(df: DataFrame, key: str) -> DataFrame:
    """``(key, document)`` with the whole row as JSON text."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("document"))


def read_documents(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """Snapshot documents; a map that is absent reads as an empty map."""
    df = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    maps = {
        field.name: F.coalesce(F.col(field.name), F.create_map().cast(field.dataType))
        for field in schema.fields
        if isinstance(field.dataType, T.MapType)
    }
    return df.withColumns(maps) if maps else df


def pick(map_column: str, names: list[str]) -> Column:
    """Map of the named entries; names without a value map to NULL."""
    entries = [F.struct(F.lit(n).alias("key"), F.try_element_at(F.col(map_column), F.lit(n)).alias("value")) for n in names]
    return F.map_from_entries(F.array(*entries))
