"""SimHash near-duplicates by tiled exact comparison.

Different fingerprints are sorted into tiles by their number of set bits. Fingerprints that
differ in at most r bits have bit counts at most r apart, so only tiles that close are
compared, each pair of tiles in one task, with exclusive-or and bit counts over whole
arrays. Within a pair the same bound on the sum over parts of the fingerprint skips more of
the work. No pair within the radius is missed.

A task returns the links that connect what it compares and leaves out those between
fingerprints it has connected already, so a group of n copies gives n - 1 links and not n
squared. Equal fingerprints are one before anything is compared.

The work is quadratic in the number of different fingerprints, by the method. Tiles grow
with it up to a bound, so the copies that the tile pairs need stay few.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weektide.llm.batches import with_arrow_columns
from weektide.llm.common import written
from weektide.llm.components import connected_components

SEED = 42
# Rows of a tile: about a 16th of all fingerprints between these bounds. One task holds two tiles.
# As long as the upper bound is not reached, every fingerprint is copied to as many pairs at any size.
TILES = 16
MIN_TILE, MAX_TILE = 1024, 131_072
# Distances that one step computes.
STEP = 300_000


def shingle_bytes(text: str | None, size: int) -> list[bytes]:
    """Runs of ``size`` words joined by blanks, repeats included; a shorter text is one run, an empty one none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    return [joined[a:b] for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]


def fingerprint_words(texts: list[str | None], size: int, words: int) -> np.ndarray:
    """One row of ``words`` 64-bit numbers for each text; a bit is set if over half of the shingles' hashes set it."""
    shingles = [shingle_bytes(t, size) for t in texts]
    n = np.array([len(s) for s in shingles], np.int64)
    out = np.zeros((len(texts), words), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    starts = (np.cumsum(n) - n)[some]
    for word in range(words):
        digests = b"".join([xxhash.xxh64_digest(x, SEED + word) for s in shingles for x in s])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[some, word] = np.packbits(counts * 2 > n[some, None], axis=1).view(">u8").astype(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, size: int, words: int, keep: list[str]) -> DataFrame:
    def make():
        def work(piece: pa.RecordBatch) -> list[pa.Array]:
            found = fingerprint_words(piece.column("text").to_pylist(), size, words).view(np.int64)
            bounds = pa.array(np.arange(len(found) + 1) * words, pa.int32())
            return [pa.ListArray.from_arrays(bounds, pa.array(found.ravel(), pa.int64()))]

        return work

    return with_arrow_columns(docs, "text", "fingerprint array<bigint>", make, keep)


class Forest:
    """Which items are connected, and the links that connected them."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Take the links that connect something new; the others change nothing."""
        while True:
            a, b = self.root[i], self.root[j]
            new = a != b
            if not new.any():
                return
            i, j, a, b = i[new], j[new], a[new], b[new]
            high, at = np.unique(np.maximum(a, b), return_index=True)
            self.root[high] = np.minimum(a, b)[at]
            self.links.append((i[at], j[at]))
            while True:
                further = self.root[self.root]
                if (further == self.root).all():
                    break
                self.root = further


def part_counts(rows: np.ndarray) -> np.ndarray:
    """Bit counts of the 16-bit parts of each row, or of wider parts where the cells would hold too few rows
    to be worth a look of their own."""
    for kind in (np.uint16, np.uint32, np.uint64):
        parts = np.bitwise_count(rows.view(kind).reshape(len(rows), -1)).astype(np.int16)
        if kind is np.uint64 or 8 * len(np.unique(parts, axis=0)) <= len(rows):
            return parts


def compare_tiles(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions, those of ``right`` after ``left``) that connect all rows within the radius.

    Rows with the same bit counts in all parts form a cell. The sum of the cells'
    differences is a lower bound of the distance.
    """
    rows = left if right is None else np.concatenate([left, right])
    at_right = 0 if right is None else len(left)
    forest = Forest(len(rows))
    columns = [np.ascontiguousarray(column) for column in rows.T]
    parts = part_counts(rows)
    first = len(left)
    other, other_at = parts[at_right:], np.arange(at_right, len(rows))
    order = np.lexsort(parts[:first].T)
    cells = parts[:first][order]
    starts = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]).any(axis=1)]) if first else np.array([], int)
    kinds, kind_of = np.unique(other, axis=0, return_inverse=True) if len(other) else (other, np.array([], int))
    for start, end in zip(starts, np.r_[starts[1:], first]):
        near = np.abs(kinds - cells[start]).sum(axis=1) <= radius
        there = other_at[near[kind_of]]
        if not len(there):
            continue
        target = [column[there] for column in columns]
        here = order[start:end]
        step = max(1, STEP // len(there))
        for k in range(0, len(here), step):
            some = here[k : k + step]
            distance = np.bitwise_count(columns[0][some][:, None] ^ target[0])
            for column, other_column in zip(columns[1:], target[1:]):
                distance += np.bitwise_count(column[some][:, None] ^ other_column)
            close = distance <= radius
            if close.any():
                close &= forest.root[some][:, None] != forest.root[there]
                i, j = np.nonzero(close)
                forest.join(some[i], there[j])
    if not forest.links:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in forest.links]), np.concatenate([b for _, b in forest.links])


def tile_ranges(counts: dict[int, int], tile_rows: int) -> list[tuple[int, int, int]]:
    """``(lowest, highest bit count, tiles)`` of each range: neighbours share a tile while they fit
    into one, and a bit count that does not fit is split into several."""
    ranges: list[tuple[int, int, int]] = []
    low, high, rows = None, None, 0
    for pop in sorted(counts):
        if low is not None and rows + counts[pop] > tile_rows:
            ranges.append((low, high, -(-rows // tile_rows)))
            low, rows = None, 0
        low, high, rows = (pop if low is None else low), pop, rows + counts[pop]
    if low is not None:
        ranges.append((low, high, -(-rows // tile_rows)))
    return ranges


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """``(u, v)`` nodes that connect all fingerprints of ``(node, fingerprint)`` within the radius."""
    pop = F.aggregate("fingerprint", F.lit(0), lambda n, word: n + F.bit_count(word))
    rows = distinct.select("node", "fingerprint", pop.alias("pop"))
    # A few dozen rows: one for each number of set bits.
    counts = {r["pop"]: r["n"] for r in rows.groupBy("pop").agg(F.count(F.lit(1)).alias("n")).collect()}
    tile_rows = min(max(sum(counts.values()) // TILES, MIN_TILE), MAX_TILE)
    ranges = tile_ranges(counts, tile_rows)
    first, n_tiles = [], 0
    for _, _, tiles in ranges:
        first.append(n_tiles)
        n_tiles += tiles
    reach = {}
    for at, (low, high, tiles) in enumerate(ranges):
        near = [k for k, (a, b, _) in enumerate(ranges) if a - high <= radius and low - b <= radius]
        for p in range(low, high + 1):
            reach[p] = (first[at], tiles, first[near[0]], first[near[-1]] + ranges[near[-1]][2] - 1)
    if not reach:
        return distinct.select(F.col("node").alias("u"), F.col("node").alias("v"))
    places = F.create_map(*[x for p, v in reach.items() for x in (F.lit(p), F.array(*[F.lit(y).cast("bigint") for y in v]))])
    place = F.element_at(places, F.col("pop"))
    tiled = rows.withColumn("place", place).select(
        "node",
        "fingerprint",
        (F.col("place")[0] + F.pmod(F.xxhash64("fingerprint"), F.col("place")[1])).alias("tile"),
        F.sequence(F.col("place")[2], F.col("place")[3]).alias("partners"),
    )
    paired = tiled.select("node", "fingerprint", "tile", F.explode("partners").alias("partner")).select(
        F.least("tile", "partner").alias("a"), F.greatest("tile", "partner").alias("b"), (F.col("tile") <= F.col("partner")).alias("is_a"), "node", "fingerprint"
    )

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node = group.column("node").to_numpy()
        flat = group.column("fingerprint").combine_chunks().flatten().to_numpy().view(np.uint64)
        words = np.ascontiguousarray(flat.reshape(len(node), -1))
        is_a = group.column("is_a").to_numpy(zero_copy_only=False).astype(bool)
        if group.column("a")[0] == group.column("b")[0]:
            i, j = compare_tiles(words, None, radius)
        else:
            node = np.r_[node[is_a], node[~is_a]]
            i, j = compare_tiles(words[is_a], words[~is_a], radius)
        return pa.table({"u": pa.array(node[i], pa.int64()), "v": pa.array(node[j], pa.int64())})

    return paired.groupBy("a", "b").applyInArrow(compare, "u bigint, v bigint")


def near_duplicate_groups(rows: DataFrame, radius: int) -> DataFrame:
    """``(fingerprint, first)`` for each different fingerprint of ``(first, fingerprint)``: the smallest
    ``first`` among all rows that are linked with it over any number of steps."""
    grouped = rows.groupBy("fingerprint").agg(F.min("first").alias("first"))
    distinct = written(grouped.withColumn("node", F.monotonically_increasing_id()), "fingerprints")
    roots = connected_components(links(distinct, radius))
    linked = distinct.join(roots, "node").select("root", "first")
    # Written, so that the join by root has two plain inputs and a hot group can be split.
    best = written(linked.groupBy("root").agg(F.min("first").alias("best")), "group-names")
    named = roots.join(best, "root").select("node", "best")
    joined = distinct.join(named, "node", "left")
    return written(joined.select("fingerprint", F.coalesce("best", "first").alias("first")), "near-duplicates")


def near_duplicates(docs: DataFrame, shingle: int, radius: int, words: int = 1) -> DataFrame:
    """``(doc_id, text_key, fingerprint, first)`` for every row of ``docs``.

    ``first`` is the row its group is named by: ``(missing, doc_id, text_key)``, ordered so
    that the smallest id comes first and rows without an id last. Texts without a word have
    fingerprint 0 and are linked like any other. Repeated rows are each returned. Other
    columns play no part.
    """
    keyed = docs.select("doc_id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key"))
    found = fingerprints(keyed, shingle, words, ["doc_id", "text_key"])
    rows = written(
        found.withColumn("first", F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_key")), "document-fingerprints"
    )
    groups = near_duplicate_groups(rows, radius)
    return rows.drop("first").join(groups, "fingerprint")


def keep_first(docs: DataFrame, shingle: int, radius: int, words: int = 1) -> DataFrame:
    """One row of each near-duplicate group, with all columns of ``docs``; of repeated rows one stays."""
    found = near_duplicates(docs, shingle, radius, words)
    key = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_key")
    return first_rows(docs, found.where(key.eqNullSafe(F.col("first"))).select("first").distinct())


def first_rows(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the different ``first`` name; of repeated rows one stays."""
    kept = firsts.select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_key").alias("kept_key"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key"), F.col("doc_id").alias("id"))
    joined = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("text_key") == F.col("kept_key")), "left_semi")
    return joined.dropDuplicates(["id", "text_key"]).select("row.*")
