"""Benchmark passages in documents, by greedy string tiling.

Runs of a few words that a document shares with a benchmark item are the seeds. For each
pair with seeds the longest common stretch of unmarked words is found by running
Karp-Rabin hashes, marked as a tile on both sides, and so on down to the seed length. The
share of the item's words under tiles decides, so a passage whose parts were put in another
order is found like one in order.

The documents are read where they lie and never shuffled. The benchmark goes to the tasks
in blocks of a bounded number of words; a larger benchmark takes more blocks, not larger
ones. Words of an item that many documents hold cost each document its own work only.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weektide.llm.batches import with_arrow_columns

# Shortest tile and seed, in words; share of an item's words under tiles that makes a leak.
MIN_TILE = 4
MIN_COVERAGE = 0.5
# Benchmark words in one broadcast: some tens of MB with its seeds.
BLOCK_WORDS = 2_000_000

WORD = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def codes(ids: np.ndarray) -> np.ndarray:
    """A well mixed odd number for each word number."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    return x * np.uint64(0x94D049BB133111EB) | np.uint64(1)


class Running:
    """Hashes of all stretches of a word sequence, from prefix sums of a polynomial."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        n = len(ids)
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE)], dtype=np.uint64)
        # Sums of code * BASE ** position; a stretch is compared after moving it to the last position.
        self.sums = np.r_[np.uint64(0), np.cumsum(codes(ids) * self.power[:n], dtype=np.uint64)]
        self.free = ids > 0

    def stretches(self, size: int, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the unmarked stretches of ``size`` words, and their hashes; ``top`` holds powers up to
        the longer sequence."""
        n = len(self.ids) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        blocked = np.r_[0, np.cumsum(~self.free)]
        start = np.flatnonzero(blocked[size:] == blocked[:n])
        sums = self.sums[start + size] - self.sums[start]
        return start, sums * top[len(top) - 1 - start]


def greedy_tiles(item: np.ndarray, doc: np.ndarray, min_tile: int) -> list[tuple[int, int, int]]:
    """Tiles ``(start in item, start in doc, words)``, the longest first; word number 0 matches nothing.

    Of equally long ones the first in the item is taken, at its first place in the document.
    """
    a, b = Running(item), Running(doc)
    top = np.cumprod(np.r_[np.uint64(1), np.full(max(len(item), len(doc)), BASE)], dtype=np.uint64)

    def common(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        start_a, hash_a = a.stretches(size, top)
        start_b, hash_b = b.stretches(size, top)
        both = np.isin(hash_a, hash_b)
        return start_a[both], hash_a[both], start_b, hash_b

    tiles: list[tuple[int, int, int]] = []
    most = min(len(item), len(doc))
    while most >= min_tile:
        low, high = min_tile - 1, most
        while low < high:  # a common stretch has common parts, so the longest is found by halving
            middle = (low + high + 1) // 2
            if len(common(middle)[0]):
                low = middle
            else:
                high = middle - 1
        if low < min_tile:
            break
        starts, hashes, doc_starts, doc_hashes = common(low)
        places: dict[int, list[int]] = {}
        wanted = set(hashes.tolist())
        for p, h in zip(doc_starts.tolist(), doc_hashes.tolist()):
            if h in wanted:
                places.setdefault(h, []).append(p)
        marked = False
        for i, h in zip(starts.tolist(), hashes.tolist()):
            if not a.free[i : i + low].all():
                continue
            for p in places[h]:
                if b.free[p : p + low].all() and (item[i : i + low] == doc[p : p + low]).all():
                    a.free[i : i + low] = False
                    b.free[p : p + low] = False
                    tiles.append((i, p, low))
                    marked = True
                    break
        most = low if marked else low - 1
    return tiles


class Block:
    """Items of one block: their words as numbers, and where each seed occurs."""

    def __init__(self, items: list[tuple[int | None, str | None]], min_tile: int):
        self.min_tile = min_tile
        self.numbers: dict[str, int] = {}
        self.items: list[tuple[int | None, np.ndarray]] = []
        for item_id, text in items:
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)], np.int64)
            if len(ids) >= min_tile:
                self.items.append((item_id, ids))
        seeds = [self.seeds(ids) for _, ids in self.items]
        all_seeds = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        place = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else np.empty(0, np.int64)
        order = np.lexsort((place, item, all_seeds))
        self.item, self.place = item[order], place[order]
        self.seed, self.first = np.unique(all_seeds[order], return_index=True)
        self.last = np.r_[self.first[1:], len(all_seeds)]

    def seeds(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids) - self.min_tile + 1
        out = np.zeros(max(n, 0), np.uint64)
        code = codes(ids)
        for k in range(self.min_tile):
            out = out * BASE + code[k : k + max(n, 0)]
        return out

    def matches(self, texts: list[str | None], min_coverage: float) -> list[list[dict]]:
        """Items that leak into each text. All texts are searched for seeds together."""
        numbers, ids, bounds = self.numbers.get, [], [0]
        for text in texts:
            ids.extend([numbers(w, 0) for w in words_of(text)])
            ids.append(0)
            bounds.append(len(ids))
        out: list[list[dict]] = [[] for _ in texts]
        words, size = np.array(ids, np.int64), self.min_tile
        if len(words) < size or not len(self.seed):
            return out
        unknown = np.r_[0, np.cumsum(words == 0)]
        start = np.flatnonzero(unknown[size:] == unknown[: len(words) - size + 1])
        seeds = self.seeds(words)[start]
        at = np.minimum(np.searchsorted(self.seed, seeds), len(self.seed) - 1)
        hit = self.seed[at] == seeds
        start, at = start[hit], at[hit]
        doc_of = np.searchsorted(bounds, start, side="right") - 1
        for doc in np.unique(doc_of).tolist():
            mine = doc_of == doc
            out[doc] = self.leaks(words, bounds[doc], start[mine], at[mine], min_coverage)
        return out

    def leaks(self, words: np.ndarray, begin: int, start: np.ndarray, at: np.ndarray, min_coverage: float) -> list[dict]:
        n = self.last[at] - self.first[at]
        posting = np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, place, where = self.item[posting], self.place[posting], np.repeat(start, n)
        found = []
        for k in np.unique(item).tolist():
            item_id, ids = self.items[k]
            here = item == k
            # Tiles lie within the places that seeds cover, so too little cover needs no tiling.
            if covered(place[here], self.min_tile, len(ids)).sum() < min_coverage * len(ids):
                continue
            low = where[here].min()
            mask = covered(where[here] - low, self.min_tile, int(where[here].max() - low) + self.min_tile)
            kept = np.flatnonzero(mask)
            gap = np.flatnonzero(np.diff(kept) > 1) + 1
            doc = np.insert(words[low + kept], gap, 0)
            origin = np.insert(low + kept - begin, gap, -1)
            tiles = greedy_tiles(ids, doc, self.min_tile)
            coverage = sum(t[2] for t in tiles) / len(ids)
            if coverage >= min_coverage:
                spans = [{"item_start": i, "doc_start": int(origin[p]), "n_words": w} for i, p, w in tiles]
                found.append({"item_id": item_id, "coverage": coverage, "tiles": spans})
        return found


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a stretch of ``size`` from one of the starts."""
    edges = np.zeros(n + size + 1, np.int64)
    edges[np.unique(starts)] += 1
    edges[np.unique(starts) + size] -= 1
    return np.cumsum(edges)[:n] > 0


MATCHES = "array<struct<item_id: bigint, coverage: double, tiles: array<struct<item_start: int, doc_start: int, n_words: int>>>>"
TILE = pa.struct({"item_start": pa.int32(), "doc_start": pa.int32(), "n_words": pa.int32()})
MATCH = pa.list_(pa.struct({"item_id": pa.int64(), "coverage": pa.float64(), "tiles": pa.list_(TILE)}))


def with_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    min_tile: int = MIN_TILE,
    min_coverage: float = MIN_COVERAGE,
    keep: list[str] | None = None,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``leaks`` of each whole text: the items whose words it covers to ``min_coverage`` or more, with tiles.

    Words are runs of letters, digits and underscores in lower case. Tiles count words from
    0 in the item and in the document. A missing text has none; items of fewer than
    ``min_tile`` words cannot be told from chance and never leak. Repeated items are each
    reported. A column of that name in the input is replaced.
    """
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    n_words = items.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")))).first()[0] or 0
    n_blocks = -(-n_words // block_words)
    keep = docs.columns if keep is None else keep
    keep = [c for c in keep if c.lower() != "leaks"]
    kind = F.lit(None).cast(MATCHES)
    out = docs.select(F.struct(*keep).alias("row"), "text", F.coalesce(kind, F.array().cast(MATCHES)).alias("leaks"))
    block_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n_blocks, 1)))
    for number in range(n_blocks):
        rows = items.where(block_of == number).collect()
        shared = docs.sparkSession.sparkContext.broadcast(Block([(r["item_id"], r["text"]) for r in rows], min_tile))

        def make(shared=shared):
            block = shared.value
            return lambda piece: [pa.array(block.matches(piece.column("text").to_pylist(), min_coverage), MATCH)]

        last = number == n_blocks - 1
        out = with_arrow_columns(out, "text", f"found {MATCHES}", make, keep=["row", "leaks"] if last else ["row", "text", "leaks"])
        out = out.withColumn("leaks", F.concat("leaks", "found")).drop("found")
    return out.select("row.*", "leaks")
