"""Alignment of two tokenizers over the bytes of the same text, and how often their ids meet.

A text is read as a space and the text. Both tokenizers start a new token at a single space between
two characters that are no white space, so the text is cut there into segments, and a segment has the
same tokens on its own as in the text. Each different segment is encoded once in a piece of work.

Where tokens end is read off the character spans that the libraries give. A token whose span is empty
or reaches into the next one ends within a character; its end is refined by the bytes it decodes to.
Ends that both tokenizers have cut the text into groups.

Ids that share a group are linked. How many documents hold a pair of ids is counted over the whole
corpus. The most frequent pairs, up to a bound, are sent to the tasks; the others are joined by key, so a pair that a third of all
documents hold is never a key of a shuffle of documents.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weektide.llm.batches import with_arrow_columns
from weektide.llm.bpe import byte_letters
from weektide.llm.common import other_columns, written

# A single space between characters that are no white space (of any kind) starts a segment.
SEGMENT_START = re.compile(r"(?<=\S) (?=\S)")
# White space other than spaces and line ends, and a space beside one of these two: only texts without them have a segment at each space.
OTHER_SPACE, SPACE_PAIRS = re.compile(r"[^\S \n]"), ("  ", " \n", "\n ")
# Among joined segments: a white space at the start or end of one, or the second tokenizer's own mark of a space.
NOT_JOINED = re.compile(r" \s|\s |▁")
# Segments a task remembers, and the characters and links of all of them, before it forgets them and starts anew.
REMEMBERED, REMEMBERED_SIZE = 400_000, 16_000_000
# Segments are encoded in texts of about so many characters.
RUN_CHARS = 4000
# Text handled at once; its tokens and pairs take many times its size.
PIECE_BYTES = 200_000
# Links of a group beyond which its ids are counted before they are paired.
WIDE = 256
# Pairs of ids sent to the tasks: at most these, the ones most documents hold, 17 bytes each.
SENT_PAIRS = 2_000_000
# A pair of ids is one number: the first above these bits, the second in them.
B_BITS, PAIR_BITS = 20, 40

ADDED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<bigint>"


class Tokenizers:
    """Both tokenizers, and the bytes behind each of their ids."""

    def __init__(self, byte_level_path: str, pieces_path: str):
        self.a = Tokenizer.from_file(byte_level_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        number = {letter: byte for byte, letter in enumerate(byte_letters())}
        # Special tokens are never made of a text; their entries are letters that stand for bytes all the same.
        self.a_bytes = [bytes(number[x] for x in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        piece = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(piece)]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        self.a_column, self.b_column = pa.array(self.a_bytes, pa.binary()), pa.array(self.b_bytes, pa.binary())
        # The longer of the two vocabularies has all numbers.
        self.number = pa.array([str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))], pa.string())
        # Segments are cut before a space, which only holds for the second tokenizer if its pieces have spaces at their start alone.
        self.separable = not any("▁" in p.lstrip("▁") for p in piece)

    def segments(self, text: str) -> list[str]:
        """Segments of a text, each without the space it starts with."""
        if not self.separable:
            return [text]
        plain = text[:1] != " " and text[-1:] != " " and not any(pair in text for pair in SPACE_PAIRS) and not OTHER_SPACE.search(text)
        return text.split(" ") if plain else SEGMENT_START.split(text)

    def encode_a(self, texts: list[str]) -> tuple[list[int], list[tuple[int, int]], list[int]]:
        """Ids, spans of characters, and the number of tokens of each text."""
        found = self.a.encode_batch(texts, add_special_tokens=False)
        ids, spans = [], []
        for one in found:
            ids.extend(one.ids)
            spans.extend(one.offsets)
        return ids, spans, [len(one) for one in found]

    def encode_b(self, texts: list[str]) -> tuple[list[int], list[tuple[int, int]], list[int]]:
        """The same; the tokenizer adds the leading space itself, so its spans are one character behind."""
        found = self.b.encode([t[1:] for t in texts], return_type="offset_mapping", num_threads=1)
        ids, spans = [], []
        for one in found:
            ids.extend(one["ids"])
            spans.extend(one["offsets"])
        return ids, spans, [len(one["ids"]) for one in found]


def span_array(spans: list[tuple[int, int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(spans), np.int64, 2 * len(spans)).reshape(-1, 2)


def runs_of(segments: list[str]) -> list[str]:
    """The segments, in order, joined into texts that are cut at the same places again."""
    whole = "".join(segments)
    if not NOT_JOINED.search(whole) and not whole[-1:].isspace():
        run = np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments))) // RUN_CHARS
        ends = [*(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(segments)]
        return ["".join(segments[a:b]) for a, b in zip([0, *ends], ends)]
    out, held, size = [], [], 0
    for s in segments:
        # Only between characters that are no white space does a space start a segment; the second
        # tokenizer takes its own mark of a space for one.
        joins = not s[-1:].isspace() and not s[1:2].isspace() and "▁" not in s
        if held and (not joins or size > RUN_CHARS):
            out.append("".join(held))
            held, size = [], 0
        held.append(s)
        size += len(s)
        if not joins:
            out.append("".join(held))
            held, size = [], 0
    if held:
        out.append("".join(held))
    return out


class Side:
    """Tokens of one tokenizer over joined segments: ids, the segment each is in, and the byte each ends at."""

    def __init__(self, encode, ahead: int, pieces: pa.Array, sizes: np.ndarray, runs: list[str], segments: list[bytes], first: np.ndarray, before: np.ndarray):
        ids, spans, n = encode(runs)
        run_first = np.cumsum([0, *map(len, runs[:-1])])
        self.ids = np.array(ids, np.int64)
        spans = span_array(spans) + np.repeat(run_first + ahead, n)[:, None]
        self.segment = np.searchsorted(first, spans[:, 0], "right") - 1
        last = np.r_[self.segment[1:] != self.segment[:-1], True] if ids else np.empty(0, bool)
        self.ends = byte_ends(spans, sizes[self.ids], last, before)
        self.bad = flawed(pieces.take(pa.array(self.ids)), self.segment, segments)

    def without(self, bad: np.ndarray) -> None:
        good = ~bad[self.segment]
        self.ids, self.segment, self.ends = self.ids[good], self.segment[good], self.ends[good]


def byte_ends(spans: np.ndarray, sizes: np.ndarray, last: np.ndarray, bytes_before: np.ndarray) -> np.ndarray:
    """Byte where each token of the joined segments ends.

    ``sizes`` are those of the decoded bytes, ``last`` marks the last token of a segment, ``bytes_before``
    counts the bytes before each character. A span with characters that the next one does not enter ends
    between two of them: a coarse cut. All other ends are so many decoded bytes behind the cut before them.
    """
    following = np.r_[spans[1:, 0], 0]
    coarse = last | ((spans[:, 1] > spans[:, 0]) & (following >= spans[:, 1]))
    ends = bytes_before[np.minimum(spans[:, 1], len(bytes_before) - 1)]
    decoded = np.cumsum(sizes)
    at = np.maximum.accumulate(np.where(coarse, np.arange(len(coarse)), -1))
    base = np.where(at >= 0, ends[at] - decoded[at], 0)
    return np.where(coarse, ends, base + decoded)


def flawed(tokens: pa.Array, segment: np.ndarray, segments: list[bytes]) -> np.ndarray:
    """Which segments the tokens do not spell."""
    spelt = pc.binary_join(as_lists(bounds_of(segment, len(segments)), tokens), b"")
    return pc.not_equal(spelt, pa.array(segments, pa.binary())).to_numpy(zero_copy_only=False)


def bounds_of(group: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` groups starts, and the last ends, in rows sorted by group."""
    return np.searchsorted(group, np.arange(n + 1))


def as_lists(bounds: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


@dataclass
class Aligned:
    """What segments add to a document.

    ``sums`` has a row for each segment: tokens of both, groups, links. ``groups`` are texts; the different
    pairs of segment k are ``pairs`` and ``times`` from ``bounds[k]`` to ``bounds[k + 1]``. Segments that
    tokens do not spell are ``bad`` and add nothing.
    """

    sums: np.ndarray
    groups: pa.Array
    bounds: np.ndarray
    pairs: np.ndarray
    times: np.ndarray
    bad: np.ndarray


def group_pairs(a: Side, b: Side, group_a: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(segment, pair, times)``: the different pairs of ids linked in each segment, and how often.

    Groups with very many links are not paired token by token: their repeated ids are multiplied.
    """
    a_start, b_start = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    often = np.where((n_a * n_b > WIDE)[group_a], 0, n_b[group_a])
    within = np.arange(often.sum()) - np.repeat(np.cumsum(often) - often, often)
    other = np.repeat(b_start[group_a], often) + within
    pairs = [np.repeat(a.ids, often) << B_BITS | b.ids[other]]
    of, times = [np.repeat(a.segment, often)], [np.ones(len(other), np.int64)]
    for g in np.flatnonzero(n_a * n_b > WIDE).tolist():
        a_ids, a_n = np.unique(a.ids[a_start[g] : a_start[g] + n_a[g]], return_counts=True)
        b_ids, b_n = np.unique(b.ids[b_start[g] : b_start[g] + n_b[g]], return_counts=True)
        pairs.append((a_ids[:, None] << B_BITS | b_ids).ravel())
        times.append((a_n[:, None] * b_n).ravel())
        of.append(np.full(len(pairs[-1]), segment[g]))
    return added_up(np.concatenate(of), np.concatenate(pairs), np.concatenate(times))


def added_up(of: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by ``of`` and ``pair``, with the times of equal ones added."""
    key = of << PAIR_BITS | pair
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    key = key[new]
    return key >> PAIR_BITS, key & ((1 << PAIR_BITS) - 1), np.add.reduceat(times, new) if len(new) else times


def align_segments(tokenizers: Tokenizers, segments: list[str], runs: list[str]) -> Aligned:
    """The segments, encoded as ``runs`` that are the same text. A ``bad`` segment may be a good one if it is a run of its own."""
    raw, n = [s.encode() for s in segments], len(segments)
    chars = np.fromiter(map(len, segments), np.int64, n)
    codes = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
    before = np.r_[0, np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))]
    place = (runs, raw, np.cumsum(chars) - chars, before)
    a = Side(tokenizers.encode_a, 0, tokenizers.a_column, tokenizers.a_sizes, *place)
    b = Side(tokenizers.encode_b, 1, tokenizers.b_column, tokenizers.b_sizes, *place)
    bad = a.bad | b.bad
    a.without(bad)
    b.without(bad)
    common = np.intersect1d(a.ends, b.ends, assume_unique=True)
    group_a, group_b = np.searchsorted(common, a.ends), np.searchsorted(common, b.ends)
    n_a, n_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
    segment = a.segment[np.cumsum(n_a) - n_a] if len(common) else np.empty(0, np.int64)
    of, pairs, times = group_pairs(a, b, group_a, n_a, n_b, segment)
    sides = [
        pc.binary_join(as_lists(np.r_[0, np.cumsum(size)], tokenizers.number.take(pa.array(side.ids))), ",") for side, size in ((a, n_a), (b, n_b))
    ]
    at = bounds_of(segment, n)
    groups = pc.binary_join(as_lists(at, pc.binary_join_element_wise(*sides, "|")), ";")
    sums = [np.r_[0, np.cumsum(each)][at] for each in (n_a, n_b, np.ones(len(common), np.int64), n_a * n_b)]
    return Aligned(np.diff(np.stack(sums, axis=1), axis=0), groups, bounds_of(of, n), pairs, times, bad)


class Grown:
    """An array that is added to at its end, with room for ``room`` rows; pages of it that are not written take no memory."""

    def __init__(self, dtype: type, width: tuple[int, ...] = (), room: int = REMEMBERED):
        self.held, self.n = np.empty((room, *width), dtype), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            held = np.empty((self.n + self.n // 2 + len(more), *self.held.shape[1:]), self.held.dtype)
            held[: self.n] = self.held[: self.n]
            self.held = held
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]


class Places(dict):
    """Places of segments; a segment that has none gets the next one and is a ``new`` one."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, segment: str) -> int:
        self[segment] = place = len(self)
        self.new.append(segment)
        return place


class Remembered:
    """Alignments of all segments seen since the memory was last cleared, each at a place of its own.

    The arrays stay when it is cleared and are written again from their start.
    """

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.sums, self.bad = Grown(np.int64, (4,)), Grown(bool)
        self.pairs, self.times, self.pair_ends = Grown(np.int64, room=REMEMBERED_SIZE // 4), Grown(np.int64, room=REMEMBERED_SIZE // 4), Grown(np.int64)
        self.letters, self.text_ends = Grown(np.uint8, room=REMEMBERED_SIZE), Grown(np.int64)
        self.clear()

    def clear(self) -> None:
        self.place = Places()
        self.chars = 0
        for array in (self.sums, self.bad, self.pairs, self.times, self.pair_ends, self.letters, self.text_ends):
            array.n = 0
        self.pair_ends.add(np.zeros(1, np.int64))
        self.text_ends.add(np.zeros(1, np.int64))

    def places(self, segments: list[str]) -> np.ndarray:
        """Where each of the segments is; only before this call may any be forgotten."""
        if len(self.place) > REMEMBERED or self.chars + self.letters.n + self.pairs.n > REMEMBERED_SIZE:
            self.clear()
        place = self.place
        found = np.fromiter(map(place.__getitem__, segments), np.int64, len(segments))
        new, place.new = place.new, []
        if new and not self.learn(new):
            found = np.fromiter(map(place.__getitem__, segments), np.int64, len(segments))
        return found

    def learn(self, segments: list[str]) -> bool:
        """Segments are encoded in runs; if one of a run fails, all of the run are encoded alone.

        False if these get other places than those in their order.
        """
        spaced = [" " + s for s in segments]
        runs = runs_of(spaced)
        found = align_segments(self.tokenizers, spaced, runs)
        if found.bad.any():
            ends = np.cumsum(np.fromiter(map(len, spaced), np.int64, len(spaced)))
            run_of = np.searchsorted(np.cumsum([len(r) for r in runs]), ends)
            again = np.isin(run_of, run_of[found.bad])
            for alone in (False, True):
                some = [s for s, x in zip(segments, again.tolist()) if x == alone]
                if some:
                    spaced = [" " + s for s in some]
                    self.place.update(zip(some, range(self.bad.n, self.bad.n + len(some))))
                    self.keep(some, align_segments(self.tokenizers, spaced, spaced if alone else runs_of(spaced)))
            return False
        self.keep(segments, found)
        return True

    def keep(self, segments: list[str], found: Aligned) -> None:
        self.chars += sum(map(len, segments))
        self.sums.add(found.sums)
        self.bad.add(found.bad)
        self.pair_ends.add(self.pairs.n + found.bounds[1:])
        self.pairs.add(found.pairs)
        self.times.add(found.times)
        _, ends, letters = found.groups.buffers()
        ends = np.frombuffer(ends, np.int32)[found.groups.offset :][: len(segments) + 1].astype(np.int64)
        self.text_ends.add(self.letters.n + ends[1:] - ends[0])
        self.letters.add(np.frombuffer(letters, np.uint8)[ends[0] : ends[-1]] if letters else np.empty(0, np.uint8))

    def groups(self) -> pa.Array:
        """Groups of all places, without a copy."""
        buffers = [None, pa.py_buffer(self.text_ends.all), pa.py_buffer(self.letters.all)]
        return pa.Array.from_buffers(pa.large_string(), self.bad.n, buffers)


def int_lists(bounds: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int64()))


def aligned(docs: DataFrame, byte_level_path: str, pieces_path: str, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) and the alignment of every whole text.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: the ids of each group in order. ``n_links`` counts the pairs of
    tokens that share a group, ``pairs`` are the different pairs of their ids and ``times`` how often each
    occurs. Texts that are missing or empty, or that a tokenizer does not spell byte by byte, have no
    tokens: zeros, '' and empty lists. Every row is a document of its own, repeated or not. Columns of
    these names in the input are replaced.
    """

    def make():
        # A task has one core; threads of the tokenizer's own would each keep memory.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizers = Tokenizers(byte_level_path, pieces_path)
        remembered = Remembered(tokenizers)

        def work(piece: pa.RecordBatch) -> list[pa.Array]:
            used = [tokenizers.segments(t) if t else [] for t in piece.column("text").to_pylist()]
            flat = remembered.places(list(chain.from_iterable(used)))
            n_rows, n_places, sizes = len(used), max(remembered.bad.n, 1), np.array([len(one) for one in used], np.int64)
            row = np.repeat(np.arange(n_rows), sizes)
            bad = remembered.bad.all[flat]
            if bad.any():
                good = np.bincount(row, bad, n_rows) == 0
                flat, row, sizes = flat[good[row]], row[good[row]], np.where(good, sizes, 0)
            ends = np.r_[0, np.cumsum(sizes)]
            total = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(remembered.sums.all[flat], axis=0)])
            sums = [pa.array(each, pa.int64()) for each in (total[ends[1:]] - total[ends[:-1]]).T]
            texts = remembered.groups().take(pa.array(flat)).cast(pa.string())
            groups = pc.binary_join(as_lists(ends, texts), ";")
            # Different segments of each row, and their different pairs, added up.
            cell, often = np.unique(row * n_places + flat, return_counts=True)
            cell_row, cell_place = cell // n_places, cell % n_places
            pair_ends = remembered.pair_ends.all
            start, n = pair_ends[cell_place], pair_ends[cell_place + 1] - pair_ends[cell_place]
            at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pair_row, pair, times = added_up(np.repeat(cell_row, n), remembered.pairs.all[at], remembered.times.all[at] * np.repeat(often, n))
            bounds = np.searchsorted(pair_row, np.arange(n_rows + 1))
            return [*sums, groups, int_lists(bounds, pair), int_lists(bounds, times)]

        return work

    return with_arrow_columns(docs, "text", ADDED, make, keep, PIECE_BYTES)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``(pair, n, best)``: documents that hold each pair linked, and whether no pair of the same first id has more."""
    counts = written(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    first = F.shiftright("pair", B_BITS)
    # At most one row for each id of the vocabulary.
    most = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    joined = counts.withColumn("a", first).join(most, "a")
    return written(joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-best")


def with_link_counts(found: DataFrame, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """``found`` with ``n_best`` and ``count_sum`` in place of ``pairs`` and ``times``.

    ``count_sum`` adds up over all links how many documents hold the link's pair of ids; ``n_best`` counts
    the links whose pair is the most frequent of its first id, ties included. ``sent_pairs`` bounds what is
    sent to the tasks and changes no result.
    """
    keep = other_columns(found, ["pairs", "times", "n_best", "count_sum", "row_number"])
    rows = written(found.select(*keep, "pairs", "times").withColumn("row_number", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(rows)
    top = counts.orderBy(F.desc("n"), "pair").limit(sent_pairs).toArrow()
    order = np.argsort(top.column("pair").to_numpy())
    arrays = tuple(top.column(name).to_numpy()[order] for name in ("pair", "n", "best"))
    context = found.sparkSession.sparkContext
    shared = context.broadcast(arrays)
    schema = "row_number bigint, n_best bigint, count_sum bigint, rest array<struct<pair: bigint, times: bigint>>"

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            bounds = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
            pair, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pairs", "times"))
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            sums = []
            for weight in (best, n):
                each = np.where(hit, times * weight[at], 0) if len(known) else np.zeros(len(pair), np.int64)
                total = np.r_[0, np.cumsum(each)]
                sums.append(pa.array(total[bounds[1:]] - total[bounds[:-1]], pa.int64()))
            misses = np.r_[0, np.cumsum(~hit)][bounds]
            left = pa.StructArray.from_arrays([pa.array(pair[~hit], pa.int64()), pa.array(times[~hit], pa.int64())], ["pair", "times"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_number"), *sums, pa.ListArray.from_arrays(pa.array(misses, pa.int32()), left)], names=["row_number", "n_best", "count_sum", "rest"]
            )

    looked = rows.select("row_number", "pairs", "times").mapInArrow(look_up, schema)
    if len(order) < sent_pairs:
        sums = looked.select("row_number", "n_best", "count_sum")
    else:
        looked = written(looked, "looked-up")
        rest = looked.select("row_number", F.inline("rest")).join(counts, "pair")
        more = rest.groupBy("row_number").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
        )
        both = looked.join(more, "row_number", "left")
        sums = both.select(
            "row_number",
            (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
            (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
        )
    return rows.select(*keep, "row_number").join(sums, "row_number").drop("row_number")
