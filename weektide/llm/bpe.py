"""Byte-pair encoding and decoding with a transducer lexicon of frequent words.

The words of the corpus are counted, the most frequent are encoded once, and a minimal
acyclic automaton over their bytes is built from them. Its arcs carry counts that add up to
the word's number, and the number gives the word's ids, so words share prefixes and
suffixes. The automaton is a few MB of flat arrays that each Python worker maps into memory.
Words it does not hold are merged by the ranks of the vocabulary, exactly; which words are
in the lexicon never changes a result.

The vocabulary file is of the kind that puts ``</w>`` at word ends, lower-cases and drops
white space. Its path is a parameter.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weektide.llm.batches import pieces, with_arrow_columns

# Words compiled into the lexicon at most, and the longest of them in bytes. Both bound the
# broadcast; other words are merged.
LEXICON_WORDS = 60_000
LEXICON_BYTES = 40
# Words that a task remembers, and the characters of their tokens; when there are more it starts anew.
REMEMBERED_WORDS, REMEMBERED_CHARS = 200_000, 20_000_000
# Words of so many bytes are merged by the ranks of all their pairs, longer ones with a heap.
SHORT_BYTES = 64
# Different words that a counting task holds before it hands on partial counts.
COUNTED_WORDS = 200_000

# The split pattern of the vocabulary file. Letters and numbers are those of the
# regular expressions' own Unicode tables; characters of the newest Unicode version may differ.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
# The same for composed lower-case texts of ASCII and Latin letters, which is quicker to match.
LATIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ɏ]*")
LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ɏ]+|[0-9]|[^\t-\r a-z0-9ß-öø-ɏ]+")


class Vocabulary:
    """What the file says: ids of tokens, ranks of merges, and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        everything = {i: t for t, i in (self.ids | self.special).items()}
        self.tokens = [everything.get(i, "") for i in range(max(everything) + 1)]
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")") if self.special else None
        self.letters = byte_letters()
        self.merges = Merges(self)

    def words(self, text: str) -> list[str | int]:
        """Normalised words of a text, and the ids of special tokens in it."""
        if not (self.split and any(t in text for t in self.special)):
            return split_words(text)
        out: list[str | int] = []
        for part in self.split.split(text):
            out.extend([self.special[part]] if part in self.special else split_words(part))
        return out

    def merge(self, word: str) -> list[int]:
        """Ids of one word by its merges: always the pair of the lowest rank, the leftmost first."""
        symbols = [self.letters[b] for b in word.encode()]
        symbols[-1] += self.suffix
        return self.merge_short(symbols) if len(symbols) <= SHORT_BYTES else self.merge_long(symbols)

    def merge_short(self, symbols: list[str]) -> list[int]:
        """With the ranks of all pairs in a list, which is quickest for the usual word."""
        rank, never = self.ranks.get, len(self.ranks)
        ranks = [rank(pair, never) for pair in zip(symbols, symbols[1:])]
        while ranks:
            least = min(ranks)
            if least == never:
                break
            i = ranks.index(least)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), never)
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), never)
        return [self.ids[s] for s in symbols]

    def merge_long(self, symbols: list[str]) -> list[int]:
        """With a heap over a linked list, which keeps a word of n bytes at n log n steps."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                rank = self.ranks.get((symbols[i], symbols[j]))
                if rank is not None:
                    heapq.heappush(heap, (rank, i, symbols[i], symbols[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = left + right, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [self.ids[s] for s in symbols if s]


class Merges:
    """The merges by numbers of symbols, for many short words at once."""

    def __init__(self, vocabulary: Vocabulary):
        letters, ranks = vocabulary.letters, vocabulary.ranks
        ends = [x + vocabulary.suffix for x in letters]
        symbols = list(dict.fromkeys(chain(letters, ends, chain.from_iterable((a, b, a + b) for a, b in ranks))))
        number = {s: i for i, s in enumerate(symbols)}
        self.symbols, self.never = symbols, len(ranks)
        self.inner, self.last = (np.array([number[x] for x in one], np.int64) for one in (letters, ends))
        self.ids = np.array([vocabulary.ids.get(s, -1) for s in symbols], np.int64)
        keys = np.array([number[a] * len(symbols) + number[b] for a, b in ranks], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.fromiter(ranks.values(), np.int64, len(ranks))[order]
        # What the pair of each rank becomes.
        self.made = np.zeros(self.never + 1, np.int64)
        self.made[list(ranks.values())] = [number[a + b] for a, b in ranks]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, ``never`` for those that are not merged."""
        if not len(self.keys):
            return np.full(left.shape, self.never, np.int64)
        key = left * len(self.symbols) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.never)

    def same_size(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(rows, symbols)`` of words of one size, a row of bytes each: each round merges one pair of every
        word, the lowest rank and of these the leftmost, and hands on the words that have no more."""
        row, symbols = np.arange(len(words)), self.inner[words]
        symbols[:, -1] = self.last[words[:, -1]]
        ranks = self.rank(symbols[:, :-1], symbols[:, 1:])
        while len(row) and ranks.shape[1]:
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(row)), at]
            done = least == self.never
            if done.any():
                yield row[done], symbols[done]
                on = ~done
                row, symbols, ranks, at, least = row[on], symbols[on], ranks[on], at[on], least[on]
            before = np.arange(symbols.shape[1] - 1) < at[:, None]
            symbols = np.where(before, symbols[:, :-1], symbols[:, 1:])
            symbols[np.arange(len(row)), at] = self.made[least]
            ranks = np.where(before[:, :-1], ranks[:, :-1], ranks[:, 1:])
            for side in (-1, 0):
                near = np.flatnonzero((at + side >= 0) & (at + side < ranks.shape[1]))
                left = at[near] + side
                ranks[near, left] = self.rank(symbols[near, left], symbols[near, left + 1])
        if len(row):
            yield row, symbols

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        joined, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        found, counts = [], np.zeros(len(words), np.int64)
        for size in np.unique(sizes).tolist():
            some = np.flatnonzero(sizes == size)
            for row, symbols in self.same_size(joined[starts[some][:, None] + np.arange(size)]):
                counts[some[row]] = symbols.shape[1]
                found.append((some[row], symbols))
        ids, begins = np.empty(counts.sum(), np.int64), np.cumsum(counts) - counts
        for row, symbols in found:
            ids[begins[row][:, None] + np.arange(symbols.shape[1])] = self.ids[symbols]
        if len(ids) and ids.min() < 0:
            raise KeyError("a symbol of a word is not in the vocabulary")
        return ids, counts


def byte_letters() -> list[str]:
    """Letter that stands for each byte: printable bytes for themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def lowered(text: str) -> str:
    """Composed form, each character in lower case on its own: a final sigma is not special."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def split_words(text: str) -> list[str]:
    text = lowered(text)
    return (LATIN_WORDS if LATIN.fullmatch(text) else WORDS).findall(text)


class Lexicon:
    """Minimal acyclic transducer from words to id lists, as flat arrays.

    ``arcs`` holds ``state * 256 + byte`` in order, with ``targets`` and ``weights`` beside
    it. The weights along a word add up to its number in sorted order.
    """

    FIELDS = {"arcs": np.uint64, "targets": np.uint32, "weights": np.uint32, "final": np.uint8, "offsets": np.uint32, "ids": np.uint32}

    def __init__(self, **arrays: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, entries: dict[bytes, list[int]]) -> Lexicon:
        """Sorted words are added one by one; the tail of the last word is frozen into the register
        of states as soon as the next word leaves it, so equal suffixes become one state."""
        words = sorted(w for w in entries if w)
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []
        path: list[list] = [[False, []]]  # of the last word: final, and arcs (byte, state)
        last = b""

        def freeze(down_to: int) -> None:
            while len(path) > down_to + 1:
                final, arcs = path.pop()
                key = (final, tuple(arcs))
                state = register.get(key)
                if state is None:
                    state = register[key] = len(states)
                    states.append(key)
                path[-1][1].append((last[len(path) - 1], state))

        for word in words:
            same = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
            freeze(same)
            path.extend([False, []] for _ in word[same:])
            path[-1][0] = True
            last = word
        freeze(0)
        root = (path[0][0], tuple(path[0][1]))
        states.append(root)
        # The root becomes state 0; targets always come before their sources in ``states``.
        number = {len(states) - 1 - i: i for i in range(len(states))}
        count, rows = [0] * len(states), []
        for at, (final, arcs) in enumerate(states):
            below = int(final)
            for byte, target in arcs:
                rows.append((number[at] << 8 | byte, number[target], below))
                below += count[target]
            count[at] = below
        rows.sort()
        columns = list(zip(*rows)) if rows else [(), (), ()]
        final = np.zeros(len(states), np.uint8)
        for at, (flag, _) in enumerate(states):
            final[number[at]] = flag
        lists = [entries[w] for w in words]
        return cls(
            arcs=np.array(columns[0], np.uint64),
            targets=np.array(columns[1], np.uint32),
            weights=np.array(columns[2], np.uint32),
            final=final,
            offsets=np.cumsum([0, *map(len, lists)]).astype(np.uint32),
            ids=np.array([i for ids in lists for i in ids], np.uint32),
        )

    def to_bytes(self) -> bytes:
        parts = [np.ascontiguousarray(getattr(self, name), kind).tobytes() for name, kind in self.FIELDS.items()]
        padded = [p + b"\0" * (-len(p) % 8) for p in parts]
        return np.array([len(p) for p in parts], np.uint64).tobytes() + b"".join(padded)

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """The arrays over a mapped file. It is a private scratch copy without a name; no other task reads it."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = np.frombuffer(view, np.uint64, len(cls.FIELDS)).astype(int)
        at, arrays = 8 * len(cls.FIELDS), {}
        for (name, kind), size in zip(cls.FIELDS.items(), sizes):
            arrays[name] = np.frombuffer(view, kind, size // np.dtype(kind).itemsize, at)
            at += size + -size % 8
        return cls(**arrays)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 where the lexicon does not hold it; all words take each step together."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = np.full(len(words), -1, np.int64)
        alive = np.flatnonzero((sizes > 0) & (sizes <= LEXICON_BYTES))
        if not len(alive) or not len(self.arcs):
            return out
        joined = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        state, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(alive):
            ended = sizes[alive] == step
            done = alive[ended]
            good = done[self.final[state[done]] == 1]
            out[good] = total[good]
            alive = alive[~ended]
            key = (state[alive] << 8 | joined[starts[alive] + step]).astype(np.uint64)
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            found = self.arcs[at] == key
            alive, at = alive[found], at[found]
            total[alive] += self.weights[at]
            state[alive] = self.targets[at]
            step += 1
        return out


def word_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """``(word, n)`` over the whole texts; tasks add up what they have before anything is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, counts = shared.value, Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

        for batch in batches:
            for piece in pieces(batch, "text"):
                found = Counter(chain.from_iterable([vocabulary.words(t) for t in piece.column("text").to_pylist() if t]))
                for word, n in found.items():
                    if isinstance(word, str) and len(word) <= LEXICON_BYTES:
                        counts[word] += n
                if len(counts) > COUNTED_WORDS:
                    yield out()
                    counts.clear()
        yield out()

    parts = docs.select("text").mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, vocabulary_path: str, max_words: int = LEXICON_WORDS) -> Lexicon:
    """Lexicon of the ``max_words`` most frequent words of the corpus; ties go to the smaller word."""
    top = word_counts(docs, vocabulary_path).orderBy(F.desc("n"), "word").limit(max_words).select("word").toArrow()
    vocabulary = Vocabulary(vocabulary_path)
    words = [w for w in top.column("word").to_pylist() if len(w.encode()) <= LEXICON_BYTES]
    ids, sizes = vocabulary.merges.merge([w.encode() for w in words])
    return Lexicon.build(dict(zip([w.encode() for w in words], [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])])))


def encode_decode(docs: DataFrame, vocabulary_path: str, keep: list[str] | None = None, lexicon: Lexicon | None = None) -> DataFrame:
    """``ids`` of each whole text and ``decoded``, the tokens of these ids joined by one blank.

    Columns of these names in the input are replaced. A missing text is encoded as an empty
    one: no ids and empty ``decoded``. Special tokens written out in a text become their ids.
    """
    lexicon = lexicon or compile_lexicon(docs, vocabulary_path)
    context = docs.sparkSession.sparkContext
    shared_words, shared_lexicon = context.broadcast(Vocabulary(vocabulary_path)), context.broadcast(lexicon.to_bytes())

    def make():
        words = EncodedWords(shared_words.value, Lexicon.mapped(shared_lexicon.value))

        def work(piece: pa.RecordBatch) -> list[pa.Array]:
            texts = [words.vocabulary.words(t) if t else [] for t in piece.column("text").to_pylist()]
            every = list(chain.from_iterable(texts))
            index = words.numbers(every)
            ends = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]
            sizes = words.sizes[index]
            before = np.cumsum(sizes) - sizes
            flat = words.ids[np.repeat(words.starts[index] - before, sizes) + np.arange(sizes.sum())]
            bounds = np.r_[0, np.cumsum(sizes)][ends]
            spelled = list(map(words.decoded.__getitem__, index.tolist()))
            decoded = [" ".join(spelled[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            return [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32())), pa.array(decoded, pa.string())]

        return work

    return with_arrow_columns(docs, "text", "ids array<int>, decoded string", make, keep)


class EncodedWords:
    """Ids and decoded tokens of the words a task has met, each worked out once; beyond a number it starts anew."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.clear()

    def clear(self) -> None:
        self.number: dict[str | int, int] = {}
        self.decoded: list[str] = []
        self.chars = 0
        self.starts, self.sizes, self.ids = (np.empty(0, np.int64) for _ in range(3))

    def numbers(self, words: list[str | int]) -> np.ndarray:
        """Number of each word, from 0 in the order they were met."""
        if len(self.number) > REMEMBERED_WORDS or self.chars > REMEMBERED_CHARS:
            self.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        if new:
            self.add(new)
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def add(self, new: list[str | int]) -> None:
        offsets, ids = ids_of(new, self.vocabulary, self.lexicon)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        tokens = list(map(self.vocabulary.tokens.__getitem__, ids.tolist()))
        at = offsets.tolist()
        decoded = [tokens[a] if b - a == 1 else " ".join(tokens[a:b]) for a, b in zip(at, at[1:])]
        self.decoded.extend(decoded)
        self.chars += sum(map(len, decoded))
        self.starts = np.r_[self.starts, offsets[:-1] + len(self.ids)]
        self.sizes = np.r_[self.sizes, offsets[1:] - offsets[:-1]]
        self.ids = np.r_[self.ids, ids]


def ids_of(words: list[str | int], vocabulary: Vocabulary, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one array, and where each word's begin and end in it."""
    raw = [b"" if isinstance(w, int) else w.encode() for w in words]
    number = lexicon.numbers(raw)
    held = number >= 0
    first, sizes = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)
    first[held], sizes[held] = lexicon.offsets[number[held]], np.diff(lexicon.offsets.astype(np.int64))[number[held]]
    # All ids that words have here, one word's after the other: of the lexicon, merged, and one by one.
    pool = [lexicon.ids.astype(np.int64)]
    length = np.fromiter(map(len, raw), np.int64, len(raw))
    short = np.flatnonzero(~held & (length > 0) & (length <= SHORT_BYTES))
    ids, sizes[short] = vocabulary.merges.merge([raw[i] for i in short.tolist()])
    first[short] = len(pool[0]) + np.cumsum(sizes[short]) - sizes[short]
    pool.append(ids)
    end = len(pool[0]) + len(ids)
    for i in np.flatnonzero(~held & ((length == 0) | (length > SHORT_BYTES))).tolist():
        word = words[i]
        one = [word] if isinstance(word, int) else vocabulary.merge(word)
        first[i], sizes[i] = end, len(one)
        pool.append(np.array(one, np.int64))
        end += len(one)
    offsets = np.r_[0, np.cumsum(sizes)]
    return offsets, np.concatenate(pool)[np.repeat(first - offsets[:-1], sizes) + np.arange(offsets[-1])]
