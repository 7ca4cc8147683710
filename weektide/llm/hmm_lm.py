"""Hidden Markov language model of words, trained by Baum-Welch over all training documents.

Words are counted over the corpus. The most frequent ones are symbols of their own, the others are
symbols by class, a hash of how they begin and end. A state emits symbols; a word of a class has its
smoothed share of the class, whatever the state is. So the states need a table of bounded size, every
word of the corpus keeps its own probability, and the probabilities of all texts still add up to one.

Each round of training sends the model to the tasks, which return expected counts of symbols and
transitions of whole documents by the scaled forward and backward recursions. The counts of all
partitions are added up, as integers, so their order changes nothing. Short rounds over a sample by
hash only find where to start.

The likelihood of a text is the product of the scales of the forward recursion, times the shares of its
words of classes. The counts of the most frequent of these are sent to the tasks, up to a bound; the others
are joined by word, after the words of each document are added up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weektide.llm.batches import pieces, with_arrow_columns
from weektide.llm.common import other_columns, written

STATES = 8
# Rounds of training over all training documents, and before them over those of one in so many documents.
ROUNDS, FIRST_ROUNDS, FIRST_SHARE = 3, 4, 16
# Words that are symbols of their own at most, and the longest of them in bytes; both bound the model.
FREQUENT, FREQUENT_BYTES = 32_768, 40
CLASSES = 512
# Words of classes whose counts are sent to the tasks at most, the most frequent ones; the bound changes no result.
SENT_WORDS = 98_304
# Added to every count of a word, as in the simple model that the scores are compared with.
ADDED = 0.1
# Tokens of prior that a state's symbols share like the whole corpus, and each transition's prior.
SYMBOL_PRIOR, STEP_PRIOR = 200.0, 1.0
# A state is left with this probability before training.
LEAVE = 0.05
# Tokens handled together. A longer text goes by in parts of this length.
TOKENS = 200_000
# Expected counts are added up in these parts of one.
UNIT = 10_000
# Different words that a task holds before it hands on counts.
HELD_WORDS = 200_000
SEED = 42


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words with A-Z in lower case, between blanks and ASCII controls from tab to return, and the text of each."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    text = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    words = lists.flatten()
    # Blanks at the start or end of a text leave an empty word there.
    full = pc.not_equal(words, "")
    return words.filter(full), text[full.to_numpy(zero_copy_only=False)]


def word_keys(words: pa.Array) -> pa.Array:
    """The words, or a digest of a long one; a space before it keeps the two apart."""
    long = pc.greater(pc.binary_length(words), FREQUENT_BYTES)
    digests = [" " + hashlib.md5(w.encode()).hexdigest() for w in words.filter(long).to_pylist()]
    return pc.replace_with_mask(words, long, pa.array(digests, pa.string()))


def word_classes(words: pa.Array) -> np.ndarray:
    """A hash of the first three and last two bytes, worked out once for those that begin and end alike."""
    raw = words.cast(pa.binary())
    both = pc.binary_join_element_wise(pc.binary_slice(raw, 0, 3), pc.binary_slice(raw, -2), b" ").dictionary_encode()
    classes = [xxhash.xxh32_intdigest(x, SEED) % CLASSES for x in both.dictionary.to_pylist()]
    return np.array(classes, np.int64)[both.indices.to_numpy()]


def in_training(doc_id: Column) -> Column:
    """Nine in ten documents, by hash of the id; a missing id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 != 0


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, class, n)`` over the whole texts; tasks add up what they have before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def added_up() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).combine_chunks()

        def out() -> Iterator[pa.RecordBatch]:
            for part in added_up().to_batches():
                words = part.column("word")
                columns = [word_keys(words), pa.array(word_classes(words), pa.int32()), part.column("n")]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "class", "n"])

        for batch in batches:
            for piece in pieces(batch, "text"):
                found = words_of(piece.column("text"))[0].value_counts()
                held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
                if sum(part.num_rows for part in held) > 2 * HELD_WORDS:
                    held = [added_up()]
                    if held[0].num_rows > HELD_WORDS:
                        yield from out()
                        held = []
        if held:
            yield from out()

    parts = texts.select("text").mapInArrow(run, "word string, class int, n bigint")
    return parts.groupBy("word").agg(F.any_value("class").alias("class"), F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Symbols: 0 is the end of a text, then the frequent words, then the classes."""

    words: list[str]
    counts: np.ndarray  # of the symbols before the classes
    class_tokens: np.ndarray
    class_words: np.ndarray
    tokens: int
    different: int
    # Words of classes whose counts are sent along, these, and their classes.
    sent_words: list[str]
    sent_counts: np.ndarray
    sent_classes: np.ndarray

    @property
    def size(self) -> int:
        return len(self.counts) + CLASSES

    def shares(self) -> np.ndarray:
        """Smoothed share of each symbol in the corpus."""
        n = np.r_[self.counts, self.class_tokens] + ADDED
        return n / n.sum()

    @property
    def base_total(self) -> float:
        return self.tokens + ADDED * (self.different + 1)


def lexicon_of(counts: DataFrame, texts: int, frequent: int, sent: int = SENT_WORDS) -> Lexicon:
    """``texts`` is the number of training documents, each of which has one end."""
    short = counts.where(~F.col("word").startswith(" "))
    both = short.orderBy(F.desc("n"), "word").limit(frequent + sent).toArrow()
    top, more = both.slice(0, frequent), both.slice(frequent)
    per_class = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).toArrow()
    tokens, different = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    tokens[per_class.column("class").to_numpy()] = per_class.column("n").to_numpy()
    different[per_class.column("class").to_numpy()] = per_class.column("words").to_numpy()
    total, n_words = int(tokens.sum()) + texts, int(different.sum()) + (texts > 0)
    n, of = top.column("n").to_numpy(), top.column("class").to_numpy()
    np.subtract.at(tokens, of, n)
    np.subtract.at(different, of, 1)
    own = top.column("word").to_pylist(), np.r_[texts, n].astype(np.int64), tokens, different, total, n_words
    return Lexicon(*own, more.column("word").to_pylist(), more.column("n").to_numpy(), more.column("class").to_numpy())


ENCODED = "symbols array<int>, n_tokens bigint, own_known bigint, own_log double, class_log double, sent_known bigint, sent_log double, rare array<string>, times array<bigint>"


def encoded(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """``keep`` and for each text its symbols with the end, what its words of the lexicon add to the scores, and its other words."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        lex: Lexicon = shared.value
        first_class = len(lex.counts)
        own_log = np.r_[np.log10(lex.counts + ADDED), np.zeros(CLASSES)]
        own_known = np.r_[lex.counts > 0, np.zeros(CLASSES, bool)].astype(np.int64)
        class_log = np.r_[np.zeros(first_class), np.log10(lex.class_tokens + ADDED * (lex.class_words + 1))]
        sent_log = np.r_[np.zeros(len(lex.words)), np.log10(lex.sent_counts + ADDED)]
        # Words are numbered: first those of the lexicon, then the others of a piece.
        n_own, known = len(lex.words), pa.array(lex.words + lex.sent_words, pa.string())
        n_known, known_symbols = len(known), np.r_[np.arange(n_own) + 1, first_class + lex.sent_classes].astype(np.int64)

        def work(piece: pa.RecordBatch) -> list[pa.Array]:
            words, row = words_of(piece.column("text"))
            n_rows, sizes = len(piece), np.bincount(row, minlength=len(piece))
            words = words.dictionary_encode()
            number_of = pc.fill_null(pc.index_in(words.dictionary, known), -1).to_numpy().astype(np.int64)
            others = words.dictionary.filter(pa.array(number_of < 0))
            number_of[number_of < 0] = n_known + np.arange(len(others))
            n_words, symbols = n_known + len(others), np.r_[known_symbols, first_class + word_classes(others)]
            number = number_of[words.indices.to_numpy()]
            bounds = np.r_[0, np.cumsum(sizes + 1)]
            # Each text's symbols are followed by its end, which is 0.
            at = np.zeros(bounds[-1], np.int64)
            at[np.arange(len(number)) + row] = symbols[number]

            def added(each: np.ndarray) -> np.ndarray:
                return np.add.reduceat(each[at], bounds[:-1]) if n_rows else np.empty(0)

            sent = (number >= n_own) & (number < n_known)
            rare = number >= n_known
            cell, times = np.unique(row[rare] * n_words + number[rare], return_counts=True)
            rare_bounds = pa.array(np.searchsorted(cell // n_words, np.arange(n_rows + 1)), pa.int32())
            return [
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(at, pa.int32())),
                pa.array(sizes + 1),
                pa.array(added(own_known).astype(np.int64)),
                pa.array(added(own_log), pa.float64()),
                pa.array(added(class_log), pa.float64()),
                pa.array(np.bincount(row[sent], minlength=n_rows)),
                pa.array(np.bincount(row[sent], sent_log[number[sent]], n_rows).astype(np.float64)),
                pa.ListArray.from_arrays(rare_bounds, word_keys(others).take(pa.array(cell % n_words - n_known))),
                pa.ListArray.from_arrays(rare_bounds, pa.array(times, pa.int64())),
            ]

        return work

    return with_arrow_columns(docs, "text", ENCODED, make, keep)


@dataclass
class Model:
    """Probabilities of the first state, of the next state by state, and of symbols (rows) by state (columns)."""

    first: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def start_model(lexicon: Lexicon, states: int) -> Model:
    """Every state emits like the corpus, each disturbed in its own way, and is seldom left."""
    emit = lexicon.shares()[:, None] * np.random.default_rng(SEED).uniform(0.5, 1.5, (lexicon.size, states))
    step = np.full((states, states), LEAVE / max(states - 1, 1))
    np.fill_diagonal(step, 1 - LEAVE if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), step, emit / emit.sum(axis=0))


class Together:
    """Sequences side by side, longest first: step t of all of them is one run of rows."""

    def __init__(self, sequences: list[np.ndarray]):
        sizes = np.array([len(s) for s in sequences], np.int64)
        self.order = np.argsort(-sizes, kind="stable")
        sizes = sizes[self.order]
        longest = int(sizes[0]) if len(sizes) else 0
        # Sequences that have a token at each step.
        self.active = np.searchsorted(-sizes, -np.arange(longest), side="left")
        self.starts = np.r_[0, np.cumsum(self.active)]
        steps = np.concatenate([np.arange(n) for n in sizes]) if len(sizes) else np.empty(0, np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        self.place = self.starts[steps] + row
        self.row_of = np.empty(len(steps), np.int64)
        self.row_of[self.place] = row
        self.symbols = np.empty(len(steps), np.int64)
        self.symbols[self.place] = np.concatenate([sequences[i] for i in self.order]) if len(sizes) else 0

    def spans(self) -> list[tuple[int, int]]:
        return list(zip(self.starts[:-1].tolist(), self.starts[1:].tolist()))


def forward(model: Model, together: Together, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State probabilities given the tokens so far, the scale of each token, and its emissions divided by the scale.

    ``before`` are the probabilities of the first states, where the sequences go on from earlier parts.
    """
    emit = model.emit[together.symbols]
    alpha, scale, ones = np.empty_like(emit), np.empty(len(emit)), np.ones(emit.shape[1])
    now = None
    for a, b in together.spans():
        out, total = alpha[a:b], scale[a:b]
        if now is None:
            np.multiply(model.first if before is None else before, emit[a:b], out=out)
        else:
            np.dot(now[: b - a], model.step, out=out)
            out *= emit[a:b]
        np.dot(out, ones, out=total)
        out /= total[:, None]
        now = out
    emit /= scale[:, None]
    return alpha, scale, emit


def backward(model: Model, together: Together, scaled: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """What is still to come, by state, in the units of the scales; ``scaled`` are emissions divided by these.

    ``after`` is what comes behind the last token, if more parts follow.
    """
    beta = np.ones_like(scaled)
    if after is not None:
        beta[-1] = after
    weighted = None
    turned = np.ascontiguousarray(model.step.T)
    for a, b in reversed(together.spans()):
        if weighted is not None:
            np.dot(weighted, turned, out=beta[a : a + len(weighted)])
        weighted = beta[a:b] * scaled[a:b]
    return beta


def grouped(sequences: list[np.ndarray]) -> Iterator[list[int]]:
    """Positions of sequences of like length, with about ``TOKENS`` tokens together; longer ones alone."""
    run, tokens = [], 0
    for at in np.argsort([len(s) for s in sequences], kind="stable").tolist():
        if run and tokens + len(sequences[at]) > TOKENS:
            yield run
            run, tokens = [], 0
        run.append(at)
        tokens += len(sequences[at])
    if run:
        yield run


def parts_of(sequence: np.ndarray) -> list[Together]:
    return [Together([sequence[i : i + TOKENS]]) for i in range(0, len(sequence), TOKENS)]


def log_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 of each sequence's probability, exactly, over all paths of states."""
    out = np.zeros(len(sequences))
    for run in grouped(sequences):
        if len(run) == 1:
            before = None
            for part in parts_of(sequences[run[0]]):
                alpha, scale, _ = forward(model, part, before)
                out[run[0]] += np.log10(scale).sum()
                before = alpha[-1:] @ model.step
            continue
        together = Together([sequences[i] for i in run])
        _, scale, _ = forward(model, together)
        sums = np.bincount(together.row_of, np.log10(scale), len(run))
        out[np.array(run)[together.order]] = sums
    return out


class Expected:
    """Expected counts of first states, transitions and symbols."""

    def __init__(self, states: int, symbols: int):
        self.first, self.step, self.emit = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))

    def add(self, model: Model, together: Together, alpha: np.ndarray, scaled: np.ndarray, beta: np.ndarray) -> None:
        gamma = alpha * beta
        for k in range(gamma.shape[1]):
            self.emit[:, k] += np.bincount(together.symbols, gamma[:, k], len(self.emit))
        if len(together.active) > 1:
            later = slice(int(together.starts[1]), None)
            weighted = beta[later] * scaled[later]
            earlier = np.concatenate([np.arange(a, a + n) for a, n in zip(together.starts[:-2].tolist(), together.active[1:].tolist())])
            self.step += model.step * (alpha[earlier].T @ weighted)

    def add_all(self, model: Model, sequences: list[np.ndarray]) -> None:
        for run in grouped(sequences):
            if len(run) == 1 and len(sequences[run[0]]) > TOKENS:
                self.add_long(model, parts_of(sequences[run[0]]))
                continue
            together = Together([sequences[i] for i in run])
            alpha, _, scaled = forward(model, together)
            beta = backward(model, together, scaled)
            self.add(model, together, alpha, scaled, beta)
            if len(together.starts) > 1:
                self.first += (alpha[: together.starts[1]] * beta[: together.starts[1]]).sum(axis=0)

    def add_long(self, model: Model, parts: list[Together]) -> None:
        """One long sequence: states before each part are kept, the parts are gone through again from the last."""
        before = [None]
        for part in parts[:-1]:
            before.append(forward(model, part, before[-1])[0][-1:] @ model.step)
        after = None
        for at in range(len(parts) - 1, -1, -1):
            part = parts[at]
            alpha, _, scaled = forward(model, part, before[at])
            beta = backward(model, part, scaled, after)
            self.add(model, part, alpha, scaled, beta)
            weighted = beta[:1] * scaled[:1]
            after = weighted @ model.step.T
            if at:
                last = forward(model, parts[at - 1], before[at - 1])[0][-1:]
                self.step += model.step * (last.T @ weighted)
            else:
                self.first += (alpha[0] * beta[0])


def lists_of(column: pa.Array) -> list[np.ndarray]:
    bounds = np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return [values[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]


def trained_once(rows: DataFrame, lexicon: Lexicon, model: Model) -> Model:
    """One round of Baum-Welch over the ``symbols`` of all rows."""
    states = len(model.first)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [f"s{k}" for k in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows -1 - k are transitions from state k, row -1 - states the first states.
        now, found = shared.value, Expected(states, len(shared.value.emit))
        for batch in batches:
            found.add_all(now, lists_of(batch.column("symbols")))
        some = np.flatnonzero(found.emit.any(axis=1))
        table = np.concatenate([found.emit[some], found.step, found.first[None]])
        key = np.r_[some, -1 - np.arange(states + 1)]
        counts = np.rint(table * UNIT).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), *[pa.array(counts[:, k]) for k in range(states)]], names=["symbol", *names])

    parts = rows.select("symbols").mapInArrow(run, "symbol int, " + ", ".join(f"{n} bigint" for n in names))
    sums = parts.groupBy("symbol").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    key = sums.column("symbol").to_numpy()
    counts = np.stack([sums.column(n).to_numpy() for n in names], axis=1) / UNIT if len(key) else np.zeros((0, states))
    emit = np.zeros_like(model.emit)
    emit[key[key >= 0]] = counts[key >= 0]
    step, first = np.zeros((states + 1, states)), np.zeros(states)
    step[-1 - key[key < 0]] = counts[key < 0]
    first, step = step[states], step[:states]
    emit += SYMBOL_PRIOR * lexicon.shares()[:, None]
    step += STEP_PRIOR
    first = first + STEP_PRIOR
    return Model(first / first.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def score(
    docs: DataFrame,
    keep: list[str] | None = None,
    states: int = STATES,
    rounds: int = ROUNDS,
    frequent: int = FREQUENT,
    sent: int = SENT_WORDS,
) -> DataFrame:
    """``keep`` (all columns by default) and for each whole text: ``held_out``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` and ``score``.

    The model learns from the documents that ``in_training`` names. ``score`` is log10 of the probability
    of the text's words and its end, ``base_score`` that of the smoothed counts of single words. Missing
    and empty texts are one end. Unseen words have the probability that their class keeps for all unseen
    ones. Repeated rows are each scored and each learned from. With nothing to learn from all is smoothing.
    Columns of these names in the input are replaced. ``sent`` bounds the words of classes whose counts are
    sent to the tasks and changes no result.
    """
    own = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "row_number", "first_share"]
    keep = other_columns(docs if keep is None else docs.select(*keep), [*own, *[c.split()[0] for c in ENCODED.split(", ")]])
    learned = docs.where(in_training(F.col("doc_id"))).select("text")
    counts = written(word_counts(learned), "word-counts")
    lexicon = lexicon_of(counts, learned.count(), frequent, sent)
    flagged = docs.withColumns({
        "held_out": ~in_training(F.col("doc_id")),
        "first_share": F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FIRST_SHARE)) == 0,
    })
    rows = encoded(flagged, lexicon, [*keep, "held_out", "first_share"]).withColumn("row_number", F.monotonically_increasing_id())
    rows = written(rows, "encoded")
    model = start_model(lexicon, states)
    training = rows.where("NOT held_out").select("symbols", "first_share")
    if states > 1:
        first = written(training.where("first_share"), "first-rounds")
        for _ in range(FIRST_ROUNDS):
            model = trained_once(first, lexicon, model)
    for _ in range(rounds):
        model = trained_once(training, lexicon, model)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = log_likelihoods(shared.value, lists_of(batch.column("symbols")))
            yield pa.RecordBatch.from_arrays([batch.column("row_number"), pa.array(found, pa.float64())], names=["row_number", "symbol_log"])

    likelihoods = rows.select("row_number", "symbols").mapInArrow(run, "row_number bigint, symbol_log double")
    each = rows.select("row_number", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row_number", "r.rare", "r.times")
    joined = each.join(counts.select(F.col("word").alias("rare"), "n"), "rare", "left")
    n = F.coalesce("n", F.lit(0))
    others = joined.groupBy("row_number").agg(
        F.sum(F.col("times") * F.log10(n + ADDED)).alias("rare_log"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("rare_known")
    )
    sums = likelihoods.join(others, "row_number", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    base_total = float(np.log10(lexicon.base_total))
    return rows.drop("symbols", "rare", "times", "first_share").join(sums, "row_number").select(
        *keep,
        "held_out",
        "n_tokens",
        (F.col("own_known") + F.col("sent_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(lexicon.tokens).cast("bigint").alias("train_tokens"),
        (F.col("own_log") + F.col("sent_log") + rare_log - F.col("n_tokens") * base_total).alias("base_score"),
        (F.col("symbol_log") + F.col("sent_log") + rare_log - F.col("class_log")).alias("score"),
    )
