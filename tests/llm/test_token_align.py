"""Alignment of two tokenizers against a plain version over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import awkward, clashing, empty
from weektide.llm import token_align as A
from weektide.llm.common import table
from weektide.llm.queries import BYTE_LEVEL, LLM_QUERIES, PIECES

NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(texts):
    """One tuple of the columns ``NAMES`` for each text, from whole encodings and every single link."""
    first = Tokenizer.from_file(BYTE_LEVEL)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    byte, other = {}, 256
    for b in range(256):
        byte[chr(b if b in printable else other)] = b
        other += b not in printable
    docs = []
    for text in texts:
        groups = []
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            a_bytes = [bytes(byte[c] for c in first.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                ends = [[sum(map(len, x[: k + 1])) for k in range(len(x))] if len(x) < 500 else running(x) for x in (a_bytes, b_bytes)]
                i = j = 0
                for end in sorted(set(ends[0]) & set(ends[1])):
                    ga, gb = [], []
                    while i < len(a) and ends[0][i] <= end:
                        ga.append(a[i])
                        i += 1
                    while j < len(b) and ends[1][j] <= end:
                        gb.append(b[j])
                        j += 1
                    groups.append((ga, gb))
        docs.append(groups)
    count, best = Counter(), defaultdict(int)
    for groups in docs:
        count.update({(x, y) for ga, gb in groups for x in ga for y in gb})
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for groups in docs:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        text = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        numbers = (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links))
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        out.append((*numbers, sum(count[k] == best[k[0]] for k in links), sum(count[k] for k in links), digest))
    return out


def running(parts):
    out, total = [], 0
    for p in parts:
        total += len(p)
        out.append(total)
    return out


def ours(docs, sent_pairs=A.SENT_PAIRS):
    found = A.aligned(docs, BYTE_LEVEL, PIECES, ["doc_id"])
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    rows = A.with_link_counts(found.withColumn("groups_sha256", digest).drop("groups"), sent_pairs).collect()
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, *(r[n] for n in NAMES)) for r in rows)


def expected(rows):
    return sorted((i is None, i or 0, *found) for (i, _), found in zip(rows, plain([t for _, t in rows])))


def made_up(n):
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", " \n", "\t", "é", "漢", "字", "🙂", "🏳️‍🌈", "\xa0", "　", "x" * 30, "1", "23", "'s", "...", "<s>", "<|endoftext|>"]
    parts += ["ﬁ", "é", "​", "the", "ing", "\r\n", "\x00", "ö", "Ω", "한국", "ा", " the", " of"]
    rare = ["▁", "▁a", "<0x41>", "<unk>"]
    return [(i, "".join(rng.choices(parts + rare * (i % 3 == 0), k=rng.randint(1, 40)))) for i in range(n)]


def test_equals_the_plain_version_whatever_is_sent(spark):
    rows = made_up(500)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    wanted = expected(rows)
    assert sum(r[2] > 0 for r in wanted) > 300
    for sent_pairs in (A.SENT_PAIRS, 50, 0):
        assert ours(docs, sent_pairs) == wanted


def test_query_on_the_table(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").collect()]
    found = LLM_QUERIES["op11_token_align"](spark, small)
    assert found.columns == ["doc_id", *NAMES]
    assert sorted((False, *r) for r in found.collect()) == expected(rows)


def test_awkward_rows(spark):
    docs = clashing(awkward(spark), ["row_number", "pairs", "n_best"])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert ours(docs) == expected(rows)
    kept = A.with_link_counts(A.aligned(docs, BYTE_LEVEL, PIECES))
    assert {"lang", "source", "n_best", "count_sum", "groups"} <= set(kept.columns)
    assert len(kept.columns) == len(set(kept.columns))
    assert ours(empty(docs)) == []


def test_wide_groups_are_multiplied(spark):
    """Neither tokenizer's ends meet within a run of one letter: one group with a great many links."""
    rows = [(1, "é" * 2001), (2, "ا" * 3000 + " b"), (3, "​" * 700)]
    assert ours(spark.createDataFrame(rows, "doc_id bigint, text string")) == expected(rows)


def test_failing_segments_do_not_change_others():
    tokenizers = A.Tokenizers(BYTE_LEVEL, PIECES)
    segments = ["the", "▁", "of", "bad▁", "end"]

    def of(asked):
        remembered = A.Remembered(tokenizers)
        places = remembered.places(asked)
        groups = remembered.groups().take(places.tolist()).to_pylist()
        return list(zip(remembered.bad.all[places].tolist(), remembered.sums.all[places].tolist(), groups))

    together, alone = of(segments), [of([s])[0] for s in segments]
    assert together == alone
    assert [bad for bad, _, _ in together] == [False, True, False, True, False]


def test_forgotten_segments_are_learned_again(monkeypatch):
    tokenizers = A.Tokenizers(BYTE_LEVEL, PIECES)
    remembered = A.Remembered(tokenizers)

    def of(asked):
        places = remembered.places(asked)
        return remembered.groups().take(places.tolist()).to_pylist()

    before = of(["some", "words"])
    monkeypatch.setattr(A, "REMEMBERED", 1)
    assert of(["words", "some"]) == before[::-1]
    assert len(remembered.place) == remembered.bad.n == 2


def test_memory_is_written_again_after_it_is_cleared():
    """New arrays for each clearing left a worker with the free space of the old ones."""
    tokenizers = A.Tokenizers(BYTE_LEVEL, PIECES)
    remembered = A.Remembered(tokenizers)
    arrays = ("sums", "bad", "pairs", "times", "pair_ends", "letters", "text_ends")

    def of(asked):
        places = remembered.places(asked)
        return remembered.sums.all[places].tolist(), remembered.groups().take(places.tolist()).to_pylist()

    before, held = of(["some", "words", "漢字"]), {name: getattr(remembered, name).held for name in arrays}
    remembered.clear()
    assert remembered.bad.n == remembered.letters.n == remembered.pairs.n == 0
    of(["others"])
    remembered.clear()
    assert of(["some", "words", "漢字"]) == before
    assert all(getattr(remembered, name).held is held[name] for name in arrays)


def test_plain_texts_are_cut_without_the_pattern(monkeypatch):
    tokenizers = A.Tokenizers(BYTE_LEVEL, PIECES)
    rng = random.Random(9)
    texts = ["".join(rng.choices("ab  \n\t\x1c\xa0　é", k=rng.randint(0, 9))) for _ in range(4000)] + ["a b\nc d", "a\n", "\na b", " a", "a "]
    pattern = A.SEGMENT_START
    assert [tokenizers.segments(t) for t in texts] == [pattern.split(t) for t in texts]
    monkeypatch.setattr(A, "SEGMENT_START", None)
    assert tokenizers.segments("the words\nof a text") == ["the", "words\nof", "a", "text"]


def test_runs_are_the_segments_in_order_and_are_cut_around_awkward_ones(monkeypatch):
    monkeypatch.setattr(A, "RUN_CHARS", 10)
    plain = [" " + "x" * n for n in (1, 30, 2, 2, 2, 9, 1)]
    runs = A.runs_of(plain)
    assert "".join(runs) == "".join(plain) and 3 <= len(runs) < len(plain)
    for awkward_one in (" ", "  a", " a\n", " ▁", " a▁b"):
        for at in range(len(plain) + 1):
            runs = A.runs_of([*plain[:at], awkward_one, *plain[at:]])
            assert "".join(runs) == "".join([*plain[:at], awkward_one, *plain[at:]])
            # Only at its end does such a segment touch another one.
            assert any(r.endswith(awkward_one) for r in runs)
    assert A.runs_of([" a"]) == [" a"]


def test_places_follow_the_order_in_which_segments_are_met():
    tokenizers = A.Tokenizers(BYTE_LEVEL, PIECES)
    remembered = A.Remembered(tokenizers)
    assert remembered.places(["b", "a", "b"]).tolist() == [0, 1, 0]
    assert remembered.places(["a", "c", "b"]).tolist() == [1, 2, 0] and remembered.place.new == []
