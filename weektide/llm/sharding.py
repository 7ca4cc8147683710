"""Shards of documents along a Hilbert curve over their metadata.

Each dimension is quantised by its own quantiles, the cells are numbered along a Hilbert
curve, and the rows sorted by that number are cut into runs. Neighbouring runs then cover
small boxes in every dimension, so filters on any of them skip most files. Only built-in
expressions are used. The sort is Spark's range partitioning with the id as last key, so a
cell, text or source that holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weektide.llm.common import other_columns, written

BITS = 5


def text_cuts(df: DataFrame, text: Column, parts: int) -> list[str]:
    """Whole values of a text dimension that cut its rows into equal shares, at most ``parts - 1``.

    Rows are counted by value, which combines before the shuffle, and the different values are
    ranked in runs by range, so no task holds all of them.
    """
    counts = df.select(text.alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    runs = written(counts.repartitionByRange("value").withColumn("run", F.spark_partition_id()), "text-runs")
    # One row for each range partition.
    sums = runs.groupBy("run").agg(F.sum("n").alias("run_rows"))
    before = sums.selectExpr("run", "sum(run_rows) OVER (ORDER BY run) - run_rows AS first_rank", "sum(run_rows) OVER () AS total")
    ranked = runs.join(F.broadcast(before), "run").selectExpr(
        "value", "total", "n", "first_rank + sum(n) OVER (PARTITION BY run ORDER BY value) AS last"
    )
    cuts = ranked.selectExpr("value", f"least({parts - 1}, last * {parts} div total) - (last - n) * {parts} div total AS cuts").where("cuts > 0")
    return sorted(value for value, n in cuts.collect() for _ in range(n))


def points_below(points: list[Column], value: Column) -> Column:
    # A second argument of the function would be the position in the array.
    return F.size(F.filter(F.array(*points), lambda x: x <= value)) if points else F.lit(0)


def quantised(df: DataFrame, dimensions: dict[str, Column], bits: int) -> tuple[list[Column], Column]:
    """Cell number of each dimension, from cut points that hold equal shares of the rows.

    One pass of mergeable quantile sketches gives the cut points of the integer dimensions, and
    counts of the different values those of the text dimensions; they are a few dozen values,
    whatever the size of the data. A value that holds many rows holds several cut points, so
    its number keeps its place among all rows. Missing values go to the first cell.
    """
    parts = 1 << bits
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    kinds = dict(df.select(*[c.alias(f"cut_{i}") for i, c in enumerate(dimensions.values())]).dtypes)
    row = df.agg(
        *[F.percentile_approx(c, shares, 10_000).alias(n) for n, c in zip(kinds, dimensions.values()) if kinds[n] != "string"],
        F.count(F.lit(1)).alias("n_rows"),
    ).first()
    cells = []
    for name, value in zip(kinds, dimensions.values()):
        if kinds[name] == "string":
            points = [F.lit(x) for x in text_cuts(df, value, parts)]
        else:
            points = [F.lit(x).cast("bigint") for x in sorted(int(x) for x in row[name] or [])]
        cells.append(points_below(points, value))
    return [F.coalesce(c, F.lit(0)) for c in cells], row["n_rows"]


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Position of a cell on the Hilbert curve through a grid of ``2 ** bits`` cells a side.

    From the highest bit down, the cell's corner in the current cube is turned into the
    cube's own frame (entry corner ``e``, direction ``d``), numbered by the inverse Gray
    code, and the frame moves on to the sub-cube.
    """
    n = len(cells)
    full = (1 << n) - 1
    gray = [i ^ (i >> 1) for i in range(1 << n)]
    rank = {g: i for i, g in enumerate(gray)}
    entry = [0] + [gray[2 * ((w - 1) // 2)] for w in range(1, 1 << n)]
    ones = [((w ^ (w + 1)).bit_length() - 1) for w in range(1 << n)]
    turn = [0] + [(ones[w - 1] if w % 2 == 0 else ones[w]) % n for w in range(1, 1 << n)]

    def lookup(values: list[int], at: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)

    def shift(x: Column, by: Column, left: bool) -> Column:
        one, other = (F.call_function("shiftleft", x, by), F.call_function("shiftright", x, F.lit(n) - by))
        if not left:
            one, other = (F.call_function("shiftright", x, by), F.call_function("shiftleft", x, F.lit(n) - by))
        return one.bitwiseOR(other).bitwiseAND(F.lit(full))

    def corner(level: Column) -> Column:
        bit = [F.call_function("shiftright", c.cast("int"), level).bitwiseAND(F.lit(1)) for c in cells]
        out = bit[0]
        for i in range(1, n):
            out = out + bit[i] * (1 << i)
        return out

    def step(state: Column, level: Column) -> Column:
        by = (state["d"] + 1) % n
        local = shift(corner(level).bitwiseXOR(state["e"]), by, left=False)
        number = lookup([rank[i] for i in range(1 << n)], local)
        return F.transform(
            F.array(number),
            lambda w: F.struct(
                (state["h"] * (1 << n) + w).alias("h"),
                state["e"].bitwiseXOR(shift(lookup(entry, w), by, left=True)).alias("e"),
                ((state["d"] + lookup(turn, w) + 1) % n).alias("d"),
            ),
        )[0]

    start = F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    levels = F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)])
    return F.aggregate(levels, start, step, lambda s: s["h"])


def hilbert_shards(
    df: DataFrame, dimensions: dict[str, Column], ties: list[Column], n_shards: int, bits: int = BITS
) -> DataFrame:
    """``df`` with ``shard`` and ``slot``: runs of the curve whose row counts differ by one at most.

    ``dimensions`` are integer or text columns by name, ``ties`` order the rows of one cell. Columns
    of the input named ``shard``, ``slot`` or ``curve`` are replaced. Repeated rows each get
    a slot. Fewer rows than shards leave shards empty; an empty table stays empty.
    """
    keep = other_columns(df, ["shard", "slot", "curve"])
    cells, total = quantised(df, dimensions, bits)
    curve = hilbert_index(cells, bits)
    keys = [f"k{i}" for i in range(len(ties))]
    rows = df.select(F.struct(*keep).alias("row"), curve.alias("curve"), *[t.alias(k) for t, k in zip(ties, keys)])
    ordered = rows.repartitionByRange("curve", *keys).sortWithinPartitions("curve", *keys)
    # The identifier is the partition number above 33 bits of row number within the partition.
    numbered = written(
        ordered.withColumn("at", F.monotonically_increasing_id()).select(
            "row",
            "curve",
            F.shiftright("at", 33).alias("run"),
            F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("pos"),
        ),
        "curve-runs",
    )
    counts = numbered.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    # One row for each range partition, so neither the sum in one task nor the broadcast grows with the rows.
    before = counts.selectExpr("run", "sum(n) OVER (ORDER BY run) - n AS first_rank")
    rank = F.col("first_rank") + F.col("pos")
    ranked = numbered.join(F.broadcast(before), "run").select("row", "curve", rank.alias("rank"))
    shard = F.expr(f"rank * {n_shards} div {max(total, 1)}")
    placed = ranked.withColumn("shard", shard.cast("int"))
    return placed.select(
        *[F.col("row").getField(name).alias(name) for name in keep],
        "curve",
        "shard",
        F.expr(f"rank - (shard * {total}L + {n_shards - 1}) div {n_shards}").cast("bigint").alias("slot"),
    )


def document_metadata(docs: DataFrame) -> DataFrame:
    """What the curve and a shard manifest need of each document, without its text.

    ``size`` is the text's UTF-8 bytes plus 16, ``text_crc32`` its unsigned checksum; a
    missing text counts as empty.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "lang",
        "source",
        F.char_length(text).cast("bigint").alias("chars"),
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )


def document_shards(metadata: DataFrame, n_shards: int) -> DataFrame:
    """Documents along the curve over language, source, text length and id; equal texts of one cell lie side by side."""
    dimensions = {
        "lang": F.col("lang"),
        "source": F.col("source"),
        "chars": F.col("chars"),
        "doc_id": F.col("doc_id"),
    }
    return hilbert_shards(metadata, dimensions, [F.col("text_hash"), F.col("doc_id")], n_shards)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, its rows in slot order."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
