"""Toxic sentences learned from labels of whole documents.

A document is a bag of sentences. It is toxic if at least one sentence is, so the
probabilities of its sentences combine by noisy-or, and training through that combination
from document labels alone gives a model of sentences. It then says which sentences offend.

Features are words and beginnings of words. Their document frequencies by label are counted
in the cluster over a bounded sample of labelled documents; the ones with the strongest
association are kept. Fitting sees only these few features of each sentence.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weektide.llm.batches import pieces, with_arrow_columns
from weektide.llm.common import held_out, written

# Size of the feature space, features kept, and labelled documents used to fit at most.
# The last is the bound of the fitting sample: the ids with the smallest hashes.
FEATURE_BITS = 20
FEATURES = 1024
FIT_DOCS = 40_000
PREFIXES = (3, 4, 5, 6)
MIN_DOCS = 3
# Half the likelihood-ratio statistic a feature needs; by chance one in two thousand has it.
MIN_RATIO = 6.0
ROUNDS = 400
RATE = 0.1
DECAY = 3e-5

TOKENS = re.compile(r"\w+|[.!?\n]+")
SENTENCES = re.compile(r"[^.!?\n]*[.!?\n]*")
ENDS = ".!?\n"


def word_cells(word: str) -> list[int]:
    """Cells of a lower-cased word and of its beginnings."""
    mask = (1 << FEATURE_BITS) - 1
    starts = [f"^{word[:n]}" for n in PREFIXES if len(word) >= n]
    return [zlib.crc32(x.encode("utf-8", "replace")) & mask for x in (word, *starts)]


class Reader:
    """Texts as numbers: each different word of a piece is looked at once."""

    def __init__(self, texts: list[str | None]):
        self.words: dict[str, int] = {}
        at, sentence, doc_sentences, doc_words = [], [], [], []
        n = 0
        for text in texts:
            first, began = n, len(at)
            open_words = 0
            for token in TOKENS.findall((text or "").lower()):
                if token[0] in ENDS:
                    n += open_words > 0
                    open_words = 0
                else:
                    at.append(self.words.setdefault(token, len(self.words)))
                    sentence.append(n)
                    open_words += 1
            n += open_words > 0
            doc_sentences.append(n - first)
            doc_words.append(len(at) - began)
        self.at, self.sentence = np.array(at, np.int64), np.array(sentence, np.int64)
        self.doc_sentences, self.doc_words = np.array(doc_sentences, np.int64), np.array(doc_words, np.int64)
        self.n_sentences = n
        cells = [word_cells(w) for w in self.words]
        self.sizes = np.array([len(c) for c in cells], np.int64)
        self.cells = np.array([x for c in cells for x in c], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def features(self, column_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different ``(sentence, column)`` pairs, where ``column_of`` gives each cell's column or -1."""
        columns = column_of[self.cells]
        kept = columns >= 0
        per_word = np.add.reduceat(kept, self.starts) if len(self.cells) else np.empty(0, np.int64)
        word = np.repeat(np.arange(len(self.sizes)), self.sizes)[kept]
        columns = columns[kept]
        first = np.searchsorted(word, np.arange(len(self.sizes)))
        n = per_word[self.at] if len(self.at) else np.empty(0, np.int64)
        sentence = np.repeat(self.sentence, n)
        before = np.cumsum(n) - n
        index = np.repeat(first[self.at] - before, n) + np.arange(n.sum()) if len(self.at) else np.empty(0, np.int64)
        pairs = np.unique(sentence * (FEATURES + 1) + columns[index]) if len(index) else np.empty(0, np.int64)
        return pairs // (FEATURES + 1), pairs % (FEATURES + 1)


def labelled(docs: DataFrame, labels: DataFrame, max_docs: int) -> DataFrame:
    """``(doc_id, text, toxic)`` of the fitting sample; conflicting labels of one id count as toxic.

    The sample has ``max_docs`` ids at most, those with the smallest hashes. That bounds what
    is broadcast, and the documents are read once without being shuffled.
    """
    marks = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return texts.join(F.broadcast(sample), "doc_id")


def select_features(examples: DataFrame, n_features: int = FEATURES) -> tuple[np.ndarray, int]:
    """Cells with the strongest association to the label, and the number of labelled documents.

    Each task adds up the documents it reads, so what is shuffled is bounded by the feature
    space for each task. The association is the likelihood ratio of presence against label.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, (1 << FEATURE_BITS) + 1), np.int32)
        for batch in batches:
            for piece in pieces(batch, "text"):
                reader = Reader(piece.column("text").to_pylist())
                ends = np.cumsum(reader.doc_words)
                toxic = piece.column("toxic").to_numpy(zero_copy_only=False) > 0
                word = np.repeat(np.arange(len(reader.sizes)), reader.sizes)
                first = np.searchsorted(word, np.arange(len(reader.sizes) + 1))
                for start, end, label in zip((ends - reader.doc_words).tolist(), ends.tolist(), toxic.tolist()):
                    words = np.unique(reader.at[start:end])
                    n = reader.sizes[words]
                    at = np.repeat(first[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    counts[int(label), np.unique(reader.cells[at])] += 1
                    counts[int(label), -1] += 1
        used = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_pydict(
            {"cell": pa.array(used, pa.int64()), "clean": pa.array(counts[0, used], pa.int64()), "toxic": pa.array(counts[1, used], pa.int64())}
        )

    parts = examples.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "cell bigint, clean bigint, toxic bigint")
    sums = written(parts.groupBy("cell").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "feature-counts")
    total = sums.where(F.col("cell") == 1 << FEATURE_BITS).first()
    if total is None:
        return np.empty(0, np.int64), 0
    n1, n0 = total["toxic"], total["clean"]
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")

    def part(seen, group, row):
        return F.when(seen > 0, seen * F.log(seen * F.lit(float(n1 + n0)) / (group * row))).otherwise(0.0)

    present, absent = a + b, F.lit(float(n1 + n0)) - a - b
    ratio = sum(
        (part(seen, F.lit(float(max(group, 1))), row) for seen, group, row in ((a, n1, present), (b, n0, present), (n1 - a, n1, absent), (n0 - b, n0, absent))),
        F.lit(0.0),
    )
    top = sums.where((F.col("cell") < 1 << FEATURE_BITS) & (present >= MIN_DOCS) & (ratio >= MIN_RATIO)).orderBy(F.round(ratio, 6).desc(), "cell").limit(n_features)
    return np.sort(top.select("cell").toArrow().column("cell").to_numpy()), n1 + n0


def column_index(cells: np.ndarray) -> np.ndarray:
    out = np.full(1 << FEATURE_BITS, -1, np.int64)
    out[cells] = np.arange(len(cells))
    return out


def fitting_rows(examples: DataFrame, cells: np.ndarray) -> pa.Table:
    """Kept features of the sampled documents: sentences are numbered within each document."""
    shared = examples.sparkSession.sparkContext.broadcast(cells)

    def make():
        index = column_index(shared.value)

        def work(piece: pa.RecordBatch) -> list[pa.Array]:
            reader = Reader(piece.column("text").to_pylist())
            sentence, column = reader.features(index)
            ends = np.cumsum(reader.doc_sentences)
            first = ends - reader.doc_sentences
            bounds = np.searchsorted(sentence, np.r_[0, ends]).astype(np.int32)
            return [
                pa.array(reader.doc_sentences, pa.int64()),
                pa.ListArray.from_arrays(pa.array(bounds), pa.array(sentence - np.repeat(first, np.diff(bounds)), pa.int32())),
                pa.ListArray.from_arrays(pa.array(bounds), pa.array(column, pa.int32())),
            ]

        return work

    rows = with_arrow_columns(examples, "text", "n bigint, sentence array<int>, feature array<int>", make, keep=["toxic"])
    return rows.toArrow()


def fit_rows(rows: pa.Table, n_features: int) -> np.ndarray:
    """Weights of the features, and the bias last, by gradient steps on the noisy-or likelihood."""
    weights = np.zeros(n_features + 1)
    weights[-1] = -5.0
    if rows.num_rows == 0:
        return weights
    y, n = rows.column("toxic").to_numpy() > 0, rows.column("n").to_numpy()
    doc = np.repeat(np.arange(len(n)), pc.list_value_length(rows.column("feature")).to_numpy())
    local, column = pc.list_flatten(rows.column("sentence")).to_numpy(), pc.list_flatten(rows.column("feature")).to_numpy()
    _, at = np.unique(doc * (1 << 32) + local, return_inverse=True)
    n_sentences = int(at.max()) + 1 if len(at) else 0
    sentence_doc = np.zeros(n_sentences, np.int64)
    sentence_doc[at] = doc
    plain = n - np.bincount(sentence_doc, minlength=len(n))
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, ROUNDS + 1):
        z = weights[-1] + np.bincount(at, weights[column], n_sentences)
        hazard = np.logaddexp(0, z)
        total = np.bincount(sentence_doc, hazard, len(n)) + plain * np.logaddexp(0, weights[-1])
        slope = np.where(y, -1 / np.expm1(np.maximum(total, 1e-9)), 1.0) / len(n)
        back = slope[sentence_doc] / (1 + np.exp(-z))
        gradient = np.r_[np.bincount(column, back[at], n_features), back.sum() + (slope * plain).sum() / (1 + np.exp(-weights[-1]))]
        gradient[:-1] += DECAY * weights[:-1]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        weights -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return weights


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Kept cells and weights (bias last). Without labelled documents every sentence has the same small score."""
    examples = written(labelled(docs, labels, fit_docs), "toxicity-examples")
    cells, n = select_features(examples)
    if not n:
        return cells, fit_rows(pa.table({"toxic": pa.array([], pa.int64())}), 0)
    return cells, fit_rows(fitting_rows(examples, cells), len(cells))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """``score`` of each whole text and its ``offending`` sentences as ``(start, end, score)``.

    ``start`` and ``end`` count code points; a sentence offends at 0.5 or more. Columns of
    these names in the input are replaced. A missing or empty text has no sentence and
    scores 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        cells, weights = shared.value
        index, bias = column_index(cells), weights[-1]

        def work(piece: pa.RecordBatch) -> list[pa.Array]:
            texts = piece.column("text").to_pylist()
            reader = Reader(texts)
            sentence, column = reader.features(index)
            z = bias + np.bincount(sentence, weights[column], reader.n_sentences)
            hazard = np.logaddexp(0, z)
            ends = np.cumsum(reader.doc_sentences)
            sums = np.r_[0, np.cumsum(hazard)]
            total = sums[ends] - sums[ends - reader.doc_sentences]
            spans = []
            for text, end, n in zip(texts, ends.tolist(), reader.doc_sentences.tolist()):
                hot = np.flatnonzero(z[end - n : end] >= 0)
                spans.append(sentence_spans(text, dict(zip(hot.tolist(), (1 / (1 + np.exp(-z[end - n + hot]))).tolist()))) if len(hot) else [])
            kind = pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64(), "score": pa.float64()}))
            return [pa.array(-np.expm1(-np.maximum(total, 0)), pa.float64()), pa.array(spans, kind)]

        return work

    return with_arrow_columns(docs, "text", "score double, offending array<struct<start: bigint, end: bigint, score: double>>", make, keep)


def sentence_spans(text: str, hot: dict[int, float]) -> list[dict]:
    """Places of the numbered sentences; stretches without a word have no number."""
    out, n = [], 0
    for found in SENTENCES.finditer(text):
        if re.search(r"\w", found.group()):
            if n in hot:
                out.append({"start": found.start(), "end": found.end(), "score": hot[n]})
            n += 1
    return out
