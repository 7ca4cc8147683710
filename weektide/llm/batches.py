"""Arrow batches in and out of Python tasks, in pieces of bounded size."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weektide.llm.common import other_columns

# Text handled at once by one task, so that its Python objects stay within some tens of MB
# however many rows a batch has. A single longer text is still handled whole.
PIECE_BYTES = 1_000_000


def pieces(batch: pa.RecordBatch, column: str, piece_bytes: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows whose texts have about ``piece_bytes`` together."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes + 64) // piece_bytes
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else np.array([], dtype=int)
    for start, end in zip(starts, np.r_[starts[1:], len(run)]):
        yield batch.slice(int(start), int(end - start))


def give_back() -> None:
    """Return memory that is free again to the system; C libraries other than glibc have no call for it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def with_arrow_columns(
    df: DataFrame,
    text: str,
    added: str,
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    keep: list[str] | None = None,
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """``keep`` (all columns by default) and new columns that Python makes from ``text``.

    ``make`` runs once in each task and returns the function from a piece of rows to the new
    columns; ``added`` is their schema as text. New columns replace those of the same name.
    """
    schema = T.StructType.fromDDL(added)
    keep = other_columns(df.select(*keep) if keep is not None else df, schema.names)
    row = F.struct(*keep) if keep else F.struct(F.lit(None).cast("int").alias("none"))
    source = df.select(row.alias("row"), F.col(text).alias("text"))
    out = T.StructType([source.schema["row"], *schema.fields])
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for piece in pieces(batch, "text", piece_bytes):
                yield pa.RecordBatch.from_arrays([piece.column("row"), *work(piece)], names=names)
        # The process serves later tasks and stages too.
        del work
        give_back()

    done = source.mapInArrow(run, out)
    return done.select(*[F.col("row").getField(n).alias(n) for n in keep], *[F.col(n) for n in schema.names])
