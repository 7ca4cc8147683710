"""The hidden Markov model against sums over all paths, and its counts against SQL."""

import itertools
import zlib

import numpy as np
import pytest

from tests.llm.helpers import awkward, clashing, documents, empty
from weektide.llm import hmm_lm as H
from weektide.llm.common import table
from weektide.llm.queries import LLM_QUERIES

BASE = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS row, crc(coalesce(doc_id::VARCHAR, '')) % 10 = 0 AS held_out,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
tokens AS (SELECT row, held_out, unnest(list_append(words, chr(10))) AS word FROM docs),
counts AS (SELECT word, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY word),
totals AS (SELECT sum(c) AS n, count(*) AS v FROM counts)
SELECT doc_id, any_value(t.held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n)::BIGINT AS train_tokens,
    sum(log10((coalesce(c, 0) + 0.1) / (n + 0.1 * (v + 1)))) AS base_score
FROM docs JOIN tokens t USING (row) LEFT JOIN counts USING (word), totals GROUP BY row, doc_id
"""


def small_model(rng, states, symbols):
    return H.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(symbols), states).T.copy())


def paths(model, sequence):
    for path in itertools.product(range(len(model.first)), repeat=len(sequence)):
        p = model.first[path[0]] * model.emit[sequence[0], path[0]]
        for t in range(1, len(sequence)):
            p *= model.step[path[t - 1], path[t]] * model.emit[sequence[t], path[t]]
        yield path, p


def plain_counts(model, sequence):
    first, step, emit = np.zeros_like(model.first), np.zeros_like(model.step), np.zeros_like(model.emit)
    total = sum(p for _, p in paths(model, sequence))
    for path, p in paths(model, sequence):
        first[path[0]] += p / total
        for t, state in enumerate(path):
            emit[sequence[t], state] += p / total
            if t:
                step[path[t - 1], state] += p / total
    return first, step, emit


@pytest.mark.parametrize("part", [200_000, 2, 1])
def test_recursions_equal_sums_over_all_paths(part, monkeypatch):
    monkeypatch.setattr(H, "TOKENS", part)
    rng = np.random.default_rng(0)
    model = small_model(rng, 3, 5)
    sequences = [rng.integers(0, 5, n) for n in (1, 4, 3, 6, 1, 5, 3)]
    assert np.allclose(H.log_likelihoods(model, sequences), [np.log10(sum(p for _, p in paths(model, s))) for s in sequences])
    found = H.Expected(3, 5)
    found.add_all(model, sequences)
    for ours, theirs in zip((found.first, found.step, found.emit), map(sum, zip(*[plain_counts(model, s) for s in sequences]))):
        assert np.allclose(ours, theirs)
    assert len(H.log_likelihoods(model, [])) == 0


def test_rounds_of_training_raise_the_likelihood(spark, small):
    docs = table(spark, small, "documents").select("doc_id", "text")
    learned = docs.where(H.in_training(docs["doc_id"]))
    lexicon = H.lexicon_of(H.word_counts(learned), learned.count(), 500)
    rows = H.encoded(learned, lexicon, ["doc_id"]).cache()
    sequences = [np.array(r["symbols"]) for r in rows.select("symbols").collect()]
    model, found = H.start_model(lexicon, 4), []
    for _ in range(4):
        found.append(H.log_likelihoods(model, sequences).sum())
        plain = H.Expected(4, lexicon.size)
        plain.add_all(model, sequences)
        model = H.trained_once(rows, lexicon, model)
        emit = plain.emit + H.SYMBOL_PRIOR * lexicon.shares()[:, None]
        assert np.allclose(model.emit, emit / emit.sum(axis=0), atol=1e-5)
        assert all(np.allclose(total, 1) for total in (model.first.sum(), model.step.sum(axis=1), model.emit.sum(axis=0)))
    rows.unpersist()
    assert found == sorted(found) and found[-1] > found[0] + 100


def test_counts_and_simple_score_equal_sql(spark, medium, duck):
    connection = duck[medium].cursor()
    connection.create_function("crc", lambda s: zlib.crc32(s.encode()), ["VARCHAR"], "UBIGINT")
    wanted = {r[0]: r[1:] for r in connection.sql(BASE).fetchall()}
    found = {r[0]: r[1:] for r in LLM_QUERIES["op12_hmm_lm"](spark, medium).collect()}
    assert found.keys() == wanted.keys()
    for doc, row in found.items():
        assert row[:4] == wanted[doc][:4]
        assert row[4] == pytest.approx(wanted[doc][4], rel=1e-9)
    held = [(row[5], row[4]) for row in found.values() if row[0]]
    assert sum(score for score, _ in held) > 0.98 * sum(base for _, base in held)
    assert all(score < 0 for score, _ in held)


def test_states_find_what_single_words_cannot(spark):
    """Two kinds of texts with words of their own: knowing the kind halves the words to choose from."""
    rng = np.random.default_rng(3)
    words = [[f"{c}{i}" for i in range(40)] for c in "ab"]
    docs = documents(spark, [(i, " ".join(rng.choice(words[i % 2], 60))) for i in range(400)])
    rows = H.score(docs, ["doc_id"], states=2, frequent=1000).where("held_out").collect()
    gain = [(r["score"] - r["base_score"]) / r["n_tokens"] for r in rows]
    assert len(rows) > 20 and min(gain) > 0.2


def test_probabilities_of_different_texts_stay_below_one(spark):
    """Frequent words, words of classes and a word never seen, each as a text of its own, and the empty text."""
    texts = ["a b", "b a", "a a a", "b", "a c", "", "c " + "d" * 60] * 3
    docs = documents(spark, list(enumerate(texts)))
    every = ["a", "b", "c", "d" * 60, "never", ""]
    held = [i for i in range(20_000, 30_000) if zlib.crc32(str(i).encode()) % 10 == 0][: len(every)]
    asked = documents(spark, list(zip(held, every)))
    rows = H.score(docs.union(asked), ["doc_id"], states=2, frequent=2).where("doc_id >= 20000").collect()
    total = sum(10 ** r["score"] for r in rows)
    assert 0.1 < total < 1


def test_awkward_rows(spark):
    docs = clashing(awkward(spark), ["symbols", "score", "rare", "row_number"])
    rows = H.score(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[3]["n_tokens"] == by_id[4]["n_tokens"] == by_id[5]["n_tokens"] == 1
    assert by_id[6]["n_tokens"] == 60_001
    assert all(np.isfinite(r["score"]) and np.isfinite(r["base_score"]) for r in rows)
    assert by_id[1]["lang"] == "en"
    same = [r for r in rows if r["doc_id"] == 2]
    assert same[0] == same[1]
    assert H.score(empty(docs)).count() == 0


def test_nothing_to_learn_from(spark):
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    rows = H.score(documents(spark, [(i, "some words") for i in held]), ["doc_id"]).collect()
    assert [(r["train_tokens"], r["n_known"], r["n_tokens"], r["base_score"]) for r in rows] == [(0, 0, 3, 0.0)] * 3
    assert all(np.isfinite(r["score"]) for r in rows)


def test_counts_sent_to_the_tasks_change_no_result(spark):
    """Words whose counts are sent are not joined any more; the scores are those without them."""
    texts = ["a a b c", "b c d", "e f", "a g " + "x" * 50, "é É h"] * 4 + ["", None, " \t\n"]
    docs = documents(spark, list(enumerate(texts)))
    found = [sorted(map(tuple, H.score(docs, ["doc_id"], states=2, frequent=2, sent=sent).collect())) for sent in (0, 3, 1000)]
    for other in found[1:]:
        assert [row[:5] for row in other] == [row[:5] for row in found[0]]
        assert np.allclose([row[5:] for row in other], [row[5:] for row in found[0]], rtol=1e-12)
    learned = docs.where(H.in_training(docs["doc_id"]))
    lexicon = H.lexicon_of(H.word_counts(learned), learned.count(), 2, 1000)
    left = {w for r in H.encoded(docs, lexicon, ["doc_id"]).collect() for w in r["rare"]}
    assert left == {str(H.word_keys(H.pa.array(["x" * 50]))[0])}


def test_words_and_classes_of_a_piece():
    words, text = H.words_of(H.pa.array([" Ab\tc\x0b\x0cÀB ", None, "", "\r", "z\xa0 z"]))
    assert words.to_pylist() == ["ab", "c", "Àb", "z\xa0", "z"] and text.tolist() == [0, 0, 0, 4, 4]
    some = ["a", "ab", "abc", "abcd", "é", "ééé", "a" * 41]
    assert H.word_classes(H.pa.array(some)).tolist() == [H.xxhash.xxh32_intdigest(w[:3] + b" " + w[-2:], H.SEED) % H.CLASSES for w in (x.encode() for x in some)]
    assert H.word_keys(H.pa.array(some)).to_pylist() == [*some[:-1], " " + H.hashlib.md5(b"a" * 41).hexdigest()]
    assert len(H.word_classes(H.pa.array([], H.pa.string()))) == 0
