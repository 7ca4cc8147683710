"""Languages of documents as mixtures, by expectation-maximisation over n-grams.

Each language is a distribution over hashed character trigrams, counted over all labelled
documents. A text is explained as a mixture of these: expectation-maximisation finds the
proportions, and further languages count only while they raise the likelihood by more than
a penalty. The largest of the chosen set is the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weektide.llm.batches import pieces, with_arrow_columns
from weektide.llm.common import held_out

# Trigrams are hashed into this many cells; a language is one row of so many numbers, and
# the model that every task gets has one row for each learned language.
CELL_BITS = 16
SMOOTHING = 0.2
# Log-likelihood that each further language must add, for each halved logarithm of the length.
PENALTY = 8.0
ROUNDS = 30
# Languages counted at once by one task before it hands on partial counts.
COUNTED_LANGUAGES = 64


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def trigram_cells(text: str | None, bits: int = CELL_BITS) -> np.ndarray:
    """Cell of each trigram of the lower-cased letters; what lies between words counts as one blank.

    Empty for a text without a letter.
    """
    if not text:
        return np.empty(0, np.int64)
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = letters()[code]
    if not letter.any():
        return np.empty(0, np.int64)
    keep = letter | np.r_[True, letter[:-1]]
    code = np.where(letter, code, 32)[keep].astype(np.uint64)
    code = np.r_[np.uint64(32), code, np.uint64(32)] if letter[0] else np.r_[code, np.uint64(32)]
    mixed = code[:-2] * np.uint64(0x9E3779B97F4A7C15) + code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + code[2:] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def cell_counts(docs: DataFrame) -> DataFrame:
    """``(lang, cell, n)`` over whole texts; each task adds up its own documents first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, cells in counts.items():
                used = np.flatnonzero(cells)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(used), pa.string()), "cell": pa.array(used, pa.int64()), "n": pa.array(cells[used], pa.int64())})
            counts.clear()

        for batch in batches:
            for piece in pieces(batch, "text"):
                for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").to_pylist()):
                    cells = trigram_cells(text)
                    if lang not in counts:
                        counts[lang] = np.zeros(1 << CELL_BITS, np.int64)
                    counts[lang] += np.bincount(cells, minlength=1 << CELL_BITS)
                if len(counts) > COUNTED_LANGUAGES:
                    yield from out()
        yield from out()

    learned = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    return learned.select("lang", "text").mapInArrow(run, "lang string, cell bigint, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Learned languages in order, and the probability of each cell in each of them.

    A language without a single trigram in its texts is not learned. The result has at
    most 65,536 numbers for each language, whatever the size of the corpus.
    """
    rows = cell_counts(docs).toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    counts = np.zeros((len(langs), 1 << CELL_BITS))
    at = {lang: i for i, lang in enumerate(langs)}
    index = np.array([at[x] for x in rows.column("lang").to_pylist()], np.int64)
    counts[index, rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return langs, (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True)


def mixture(p: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions of the rows of ``p`` that best explain counts ``n``, and their log-likelihood."""
    share = np.full(len(p), 1 / len(p))
    total = n.sum()
    for _ in range(rounds):
        joint = share[:, None] * p
        mixed = joint.sum(axis=0)
        new = joint @ (n / mixed) / total
        moved = np.abs(new - share).max()
        share = new
        if moved < 1e-3:
            break
    return share, float(n @ np.log(share @ p))


def chosen_mixture(p: np.ndarray, n: np.ndarray) -> dict[int, float]:
    """Chosen languages and their proportions, the largest first.

    Sets are nested by the proportions of the full mixture; the next language joins while
    the penalised likelihood rises. No set can beat the full mixture, so most texts need no
    second fit.
    """
    alone = np.log(p) @ n
    best = int(alone.argmax())
    if len(p) == 1:
        return {best: 1.0}
    price = PENALTY * np.log(max(n.sum(), 2)) / 2
    share, full = mixture(p, n)
    chosen, likelihood = {best: 1.0}, alone[best]
    if full - likelihood <= price:
        return chosen
    order = np.argsort(-share, kind="stable")
    for size in range(2, len(p) + 1):
        part, with_next = mixture(p[order[:size]], n)
        if with_next - likelihood <= price:
            break
        ranked = sorted(zip(part.tolist(), order[:size].tolist()), key=lambda x: (-x[0], x[1]))
        chosen, likelihood = {i: s for s, i in ranked}, with_next
        if full - likelihood <= price:
            break
    return chosen


def identify(docs: DataFrame, keep: list[str] | None = None, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """``lang_pred``, ``score`` (its proportion) and ``lang_mix`` (chosen languages and proportions).

    Columns of these names in the input are replaced. A missing text, or one without a
    letter, is ``und`` with score 0 and an empty mixture; so is every text if no language
    could be learned. Equal proportions go to the language first in order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def make():
        langs, p = shared.value

        def work(piece: pa.RecordBatch) -> list[pa.Array]:
            pred, score, mixes = [], [], []
            for text in piece.column("text").to_pylist():
                counts = np.bincount(trigram_cells(text), minlength=1 << CELL_BITS)
                used = np.flatnonzero(counts)
                found = chosen_mixture(p[:, used], counts[used].astype(float)) if len(used) and langs else {}
                first = next(iter(found), None)
                pred.append("und" if first is None else langs[first])
                score.append(0.0 if first is None else min(1.0, found[first]))
                mixes.append([(langs[i], s) for i, s in found.items()])
            return [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixes, pa.map_(pa.string(), pa.float64()))]

        return work

    return with_arrow_columns(docs, "text", "lang_pred string, score double, lang_mix map<string, double>", make, keep)
