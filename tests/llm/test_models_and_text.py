import hashlib
import html
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import PROSE, awkward, clashing, documents, empty
from weektide.llm import ann, bpe, decontaminate, html_wrappers, lang_mix, toxicity
from weektide.llm.queries import LLM_QUERIES, VOCABULARY

# --- toxicity ---------------------------------------------------------------------------


def toy_labels(spark, n=600):
    rng = random.Random(4)
    plain = "river stone cloud maple window garden table paper candle morning".split()
    docs, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choices(plain, k=6)) for _ in range(rng.randrange(3, 9))]
        toxic = i % 5 == 0
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] += " " + rng.choice(["gruntle", "vexmire"])
        docs.append((i, ". ".join(sentences) + "."))
        labels.append((i, 1, int(toxic)))
    return documents(spark, docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxic_sentences_are_learned_and_located(spark):
    docs, labels = toy_labels(spark)
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 5 == 0) for r in rows)
    for r in rows:
        spans = [r["text"][s["start"] : s["end"]] for s in r["offending"]]
        assert all(re.search("gruntle|vexmire", s) for s in spans) and bool(spans) == (r["doc_id"] % 5 == 0)


def test_held_out_labels_play_no_part(spark):
    docs, labels = toy_labels(spark, 200)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert (a[0] == b[0]).all() and np.allclose(a[1], b[1])


def test_toxicity_accuracy_on_held_out_documents(spark, data):
    folder = f"{data}/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = LLM_QUERIES["op2_toxicity"](spark, folder).join(labels, "doc_id").where("held_out").collect()
    right = [r["predicted"] == r["toxic"] for r in rows]
    assert len(rows) > 500 and sum(right) / len(right) > 0.96


def test_toxicity_of_awkward_rows(spark):
    docs, labels = toy_labels(spark, 200)
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(clashing(awkward(spark), ["row", "score", "offending", "n"]), model)
    assert rows.count() == 13 and rows.where("score BETWEEN 0 AND 1").count() == 13
    assert rows.where("doc_id IN (3, 4, 5)").select("score").distinct().collect() == [(0.0,)]
    assert toxicity.score(empty(docs), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, none).where("score >= 0.5").count() == 0
    nulls = labels.withColumn("toxic", F.lit(None).cast("int"))
    assert toxicity.score(docs, toxicity.fit(docs, nulls)).count() == 200


# --- languages --------------------------------------------------------------------------


def test_language_accuracy_on_held_out_documents(spark, medium):
    langs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "lang")
    rows = LLM_QUERIES["op10_lang_mix"](spark, medium).join(langs, "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_mixed_text_gets_both_languages(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    model = lang_mix.fit(docs)
    texts = {l: docs.where((F.col("lang") == l) & (F.col("n_chars") > 3000)).first()["text"] for l in ("de", "fr")}
    mixed = documents(spark, [(1, texts["de"][:2000] + " " + texts["fr"][:1000]), (2, texts["de"][:1500])])
    rows = {r["doc_id"]: r for r in lang_mix.identify(mixed, model=model).collect()}
    assert set(rows[1]["lang_mix"]) == {"de", "fr"} and 0.55 < rows[1]["lang_mix"]["de"] < 0.8
    assert rows[2]["lang_mix"] == {"de": 1.0} and rows[2]["lang_pred"] == "de"


def test_mixture_is_the_likeliest(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(40), 2)
    n = rng.multinomial(4000, 0.3 * p[0] + 0.7 * p[1]).astype(float)
    share, likelihood = lang_mix.mixture(p, n, 200)
    grid = [float(n @ np.log(a * p[0] + (1 - a) * p[1])) for a in np.linspace(0.01, 0.99, 99)]
    assert abs(share[0] - 0.3) < 0.05 and likelihood >= max(grid) - 0.5


def test_languages_of_awkward_rows(spark):
    docs = documents(spark, [(i, PROSE) for i in range(9)], "en").union(documents(spark, [(20 + i, "ñandú está aquí mañana " * 9) for i in range(9)], "es"))
    model = lang_mix.fit(docs.union(documents(spark, [(50, None)], None)).union(documents(spark, [(51, "123")], "zz")))
    rows = lang_mix.identify(clashing(awkward(spark), ["lang_pred", "score", "row", "lang_mix"]), model=model)
    assert rows.count() == 13
    by_id = {r["doc_id"]: r for r in rows.collect() if r["doc_id"] is not None}
    for i in (3, 4, 5):
        assert (by_id[i]["lang_pred"], by_id[i]["score"], by_id[i]["lang_mix"]) == ("und", 0.0, {})
    assert by_id[1]["lang_pred"] == "en"
    assert lang_mix.identify(documents(spark, [(1, "1234 ...")]), model=model).first()["lang_pred"] == "und"
    nothing = lang_mix.identify(docs, model=lang_mix.fit(empty(docs)))
    assert nothing.select("lang_pred").distinct().collect() == [("und",)]


# --- byte-pair encoding -------------------------------------------------------------------

ODD = [
    "", " \n", "ΑΣ Σ", "İx", "a\x1cb\x1fc\x85d᠎e​f", "it's we'LL 'S o'clock 1½ ²", "<|endoftext|>a<|startoftext|><|ENDOFTEXT|>",
    "ﬁ é é À", "𝔘x 漢字かな ١٢", "a" * 3000, "naïve—x…", "aaaaaaa bbbbbb", "x×y÷z ª º µ ß Ÿ ŉ ǰ", "x" * 41, "word " * 20_000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_query_against_the_library(spark, small, library):
    rows = {r["doc_id"]: r for r in LLM_QUERIES["op5_bpe"](spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d["text"], add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        got = rows[d["doc_id"]]
        assert (got["n_tokens"], got["ids_sha256"], got["decoded_sha256"]) == want


@pytest.mark.parametrize("max_words", [0, 50])
def test_odd_texts_against_the_library(spark, library, max_words):
    docs = clashing(documents(spark, list(enumerate([*ODD, *ODD, None]))), ["ids", "decoded", "row"])
    lexicon = bpe.compile_lexicon(docs, VOCABULARY, max_words)
    rows = bpe.encode_decode(docs, VOCABULARY, lexicon=lexicon).collect()
    assert len(rows) == 2 * len(ODD) + 1
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(empty(docs), VOCABULARY).count() == 0


def test_lexicon_is_exact_and_minimal():
    words = [a + b for a in ("walk", "talk", "stalk", "chalk") for b in ("", "s", "ed", "ing")] + ["é", "xy"]
    entries = {w.encode(): [i, i + 1][: 1 + i % 2] for i, w in enumerate(words)}
    lexicon = bpe.Lexicon.mapped(bpe.Lexicon.build(entries).to_bytes())
    asked = [w.encode() for w in words] + [b"", b"wal", b"walkings", b"q", b"x" * 100]
    numbers = lexicon.numbers(asked)
    assert (numbers[len(words) :] == -1).all()
    for word, number in zip(asked, numbers[: len(words)]):
        assert lexicon.ids[lexicon.offsets[number] : lexicon.offsets[number + 1]].tolist() == entries[word]
    # States of a minimal automaton: as many as there are different sets of continuations.
    tails = {p: frozenset(w[len(p) :] for w in entries if w.startswith(p)) for w in entries for p in (w[:k] for k in range(len(w) + 1))}
    assert len(lexicon.final) == len(set(tails.values()))


# --- decontamination --------------------------------------------------------------------


def plain_tiling(a, b, least):
    marked_a, marked_b, tiles = set(), set(), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in marked_a and j + k not in marked_b:
                    k += 1
                best = max(best, (k, -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        if k < least:
            return tiles
        tiles.append((i, j, k))
        marked_a |= set(range(i, i + k))
        marked_b |= set(range(j, j + k))


def test_tiling_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(150):
        a, b = rng.integers(1, 4, rng.integers(1, 25)), rng.integers(1, 4, rng.integers(1, 40))
        got, want = decontaminate.greedy_tiles(a, b, 3), plain_tiling(a.tolist(), b.tolist(), 3)
        assert [t[2] for t in got] == [t[2] for t in want]
        assert sorted(got) == sorted(want)


def test_leaks_in_order_and_reordered(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=40))) for i in range(20)]
    benchmark = spark.createDataFrame(items + [(99, "too short"), (98, None)], "item_id bigint, text string")
    filler = lambda: " ".join(rng.choices(vocabulary, k=200))
    whole = items[3][1].upper().replace(" ", ", ")
    words = items[7][1].split()
    turned = " ".join(words[20:]) + " ... " + " ".join(words[:20])
    docs = documents(spark, [(1, f"{filler()} {whole} {filler()}"), (2, filler() + " " + turned), (3, filler()), (4, " ".join(words[:16])), (5, None), (6, f"{items[1][1]} {items[2][1]}")])
    for block_words in (10**6, 150):
        found = decontaminate.with_leaks(clashing(docs, ["leaks", "row", "found"]), benchmark, block_words=block_words)
        leaks = {r["doc_id"]: sorted((x["item_id"], round(x["coverage"], 2), len(x["tiles"])) for x in r["leaks"]) for r in found.collect()}
        assert leaks == {1: [(3, 1.0, 1)], 2: [(7, 1.0, 2)], 3: [], 4: [], 5: [], 6: [(1, 1.0, 1), (2, 1.0, 1)]}
    span = next(x for x in found.where("doc_id = 1").first()["leaks"])["tiles"][0]
    assert (span["item_start"], span["n_words"]) == (0, 40)


def test_leaks_of_awkward_rows(spark):
    benchmark = spark.createDataFrame([(1, PROSE), (1, PROSE), (None, "one without an id")], "item_id bigint, text string")
    rows = decontaminate.with_leaks(awkward(spark), benchmark)
    assert rows.count() == 13
    assert rows.where("doc_id IN (1, 2)").selectExpr("size(leaks) n").distinct().collect() == [(2,)]
    assert rows.where("doc_id IS NULL AND size(leaks) = 1").count() == 2
    assert decontaminate.with_leaks(awkward(spark), benchmark.limit(0)).where("size(leaks) = 0").count() == 13
    assert decontaminate.with_leaks(empty(awkward(spark)), benchmark).count() == 0


# --- neighbours -------------------------------------------------------------------------


def plain_neighbours(rows, k):
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    out = {}
    for own, vector in zip(ids, vectors):
        if own % 100 == 0:
            distance = np.sqrt(((vectors - vector) ** 2).sum(axis=1))
            order = [i for i in np.lexsort((ids, distance)) if ids[i] != own][:k]
            out[int(own)] = [(int(ids[i]), float(distance[i])) for i in order]
    return out


@pytest.mark.parametrize("shard_rows", [8192, 300])
def test_recall_and_exact_distances(spark, data, monkeypatch, shard_rows):
    monkeypatch.setattr(ann, "SHARD_ROWS", shard_rows)
    folder = f"{data}/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = plain_neighbours(rows, 10)
    got = {}
    for r in LLM_QUERIES["op8_neighbours"](spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want) and all(len(x) == 10 for x in got.values())
    vectors = {r[0]: np.array(r[1], dtype=float) for r in rows}
    for q, found in got.items():
        assert all(abs(np.sqrt(((vectors[v] - vectors[q]) ** 2).sum()) - s) < 1e-12 for v, s in found)
    recall = np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 10 for q in want])
    assert recall >= 0.9


def test_clustered_vectors_need_few_candidates():
    rng = np.random.default_rng(0)
    centers = rng.standard_normal((40, 16)) * 10
    sample = centers[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 16)) * 0.1
    assert ann.Planes(sample, 10).share <= 1 / 8


def test_neighbours_of_awkward_vectors(spark):
    schema = "vec_id bigint, embedding array<float>, label int, rank int, score string"
    good = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (100, [0.5, 0.5]), (100, [0.5, 0.5])]
    bad = [(200, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (9, []), (None, [1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 1, 1, "x") for i, v in good + bad], schema)
    rows = ann.search(frame, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in rows] == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (0, 4, 3), (100, 1, 0), (100, 2, 1), (100, 3, 2), (100, 4, 3)]
    assert ann.search(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.search(frame.where("vec_id IN (0)"), F.col("vec_id") % 100 == 0).count() == 0


# --- pages ------------------------------------------------------------------------------


def test_pages_against_their_articles(spark, medium):
    rows = {r["page_id"]: r["text"] for r in LLM_QUERIES["op4_html_wrappers"](spark, medium).collect()}
    pages = spark.read.parquet(f"{medium}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for page in pages:
        article = re.search(r"<article>(.*?)(</article>|\Z)", page["html"], re.S)[1].replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?p>|</?h1>", article)]
        assert rows[page["page_id"]] == "\n".join(b for b in blocks if b)


FULL = """<!DOCTYPE html><html><head><title>T</title></head><body class="has-sidebar"><div id="cookie-banner">We use cookies</div>
<header class="site-header"><h1>Site</h1><nav>menu</nav></header><main><article class="post"><header><h1>Title &amp; more</h1>
<p class="byline">By X</p></header><p>Para&nbsp;one <b>bold</b>text.<br>next</p><div class="ad">buy</div><ul><li>a<li>b</ul>
<form><input><p>sub</p></form><p>Two<p>Three &lt;x&gt;<pre>  code
 x</pre><section class="comments"><h2>Comments</h2><article class="comment">bad</article></section></article>
<aside>side</aside></main><footer>f</footer><script>x("</p>")</script></body></html>"""
BARE = """<html><body><div class="menu"><a href=x>Home</a></div><div><a href=y>Next</a> <a href=z>Last</a></div><div><h1>Hi {0}</h1>
<p>Some text {0} here of the story</p></div><div>Always the same</div><div class=footer>c</div></body>"""


def test_frames_are_left_out(spark):
    pages = [(1, "http://a/1", FULL), (None, None, FULL), (2, "http://a/2", None), (3, "http://a/3", ""), (4, "http://a/4", "plain"), (4, "http://a/4", "plain")]
    pages += [(10 + i, f"http://b/{i}", BARE.format(i)) for i in range(4)]
    pages += [(20, "http://c/", "<b>" * 5000 + "x<p>" * 5000), (21, "http://c/", "<div" * 5000), (22, "http://c/", "<p>" + "long text " * 50_000)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").selectExpr("*", "'m' AS wrapper", "'m' AS host", "'m' AS text")
    rows = html_wrappers.extract(frame).collect()
    assert len(rows) == len(pages)
    found = {r["page_id"]: r["text"] for r in rows}
    want = "Title & more\nPara one boldtext. next\na\nb\nTwo\nThree <x>\ncode x"
    assert found[1] == found[None] == want
    assert (found[2], found[3], found[4]) == ("", "", "plain")
    assert [found[10 + i] for i in range(4)] == [f"Hi {i}\nSome text {i} here of the story" for i in range(4)]
    assert found[22] == ("long text " * 50_000).strip() and found[20].count("x") == 5000
    assert html_wrappers.extract(frame.limit(0)).count() == 0


def test_repeated_and_rare_texts_without_a_root_stay(spark):
    page = "<div><h1>T</h1><p>text</p></div>"
    story = "<div><h1>Story {0}</h1>{1}<p>Words {0} of it</p></div><div>Always the same</div>"
    pages = [(i, "http://three/", page) for i in range(3)] + [(i, "http://many/", page) for i in range(3000)]
    # The same texts in another markup are no other page.
    pages += [(i, "http://markup/", f"<!-- {i} --><script>{i}</script>{page}") for i in range(5)]
    pages += [(i, f"http://story/{i}", story.format(i, "<h2>Conclusion</h2>" if i % 100 == 7 else "")) for i in range(1000)]
    pages += [(i, "http://story/x", "<div>Always the same</div>") for i in range(1000, 1003)]
    rows = html_wrappers.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()
    assert len(rows) == len(pages)
    for r in rows:
        i, rare = r["page_id"], "Conclusion\n" if r["page_id"] % 100 == 7 else ""
        only = "T\ntext" if "story" not in r["url"] else "Always the same"
        assert r["text"] == (f"Story {i}\n{rare}Words {i} of it" if "story" in r["url"] and i < 1000 else only), r


def test_wrappers_fold_and_align():
    a = html_wrappers.page_wrapper("<div><h2>A</h2><p>x</p><p>y</p><h2>B</h2><p>z</p><hr></div>")
    b = html_wrappers.page_wrapper("<div><h2>A</h2><p>x</p><h2>B</h2><p>q</p><h2>C</h2><p>r</p></div>")
    merged = html_wrappers.merge(a, b).items[0]
    assert merged.shape() == "div" and [i.shape() for i in merged.items] == ["(h2 p)", "hr"]
    assert merged.items[1].flags & html_wrappers.OPTIONAL and merged.items[0].flags & html_wrappers.REPEATED
    back = html_wrappers.item_of(merged.plain())
    assert back.plain() == merged.plain()
    wide = html_wrappers.page_wrapper("".join(f"<{n}>t{i}</{n}>" for i in range(200) for n in (("i", "b", "em", "u")[i % 4], ("s", "q", "code")[i % 3])))
    assert len(wide.items) <= html_wrappers.WIDE


def test_short_and_long_words_are_merged_alike():
    vocabulary = bpe.Vocabulary(VOCABULARY)
    rng = random.Random(6)
    for n in [1, 2, 3, 5, 8, 13, 40, 64, 65, 200]:
        for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "éüß漢字🙂"):
            word = "".join(rng.choices(letters, k=n))
            symbols = [vocabulary.letters[b] for b in word.encode()]
            symbols[-1] += vocabulary.suffix
            assert vocabulary.merge_short(list(symbols)) == vocabulary.merge_long(list(symbols)) == vocabulary.merge(word)


def test_words_are_looked_up_anew_when_too_many_are_remembered(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 3)
    vocabulary = bpe.Vocabulary(VOCABULARY)
    words = bpe.EncodedWords(vocabulary, bpe.Lexicon.mapped(bpe.Lexicon.build({b"the": vocabulary.merge("the")}).to_bytes()))
    for batch in (["the", "fox", 49407], ["jumps", "the"], ["over", "fox", "over"]):
        for word, k in zip(batch, words.numbers(batch).tolist()):
            ids = words.ids[words.starts[k] : words.starts[k] + words.sizes[k]].tolist()
            assert ids == ([word] if isinstance(word, int) else vocabulary.merge(word))
            assert words.decoded[k] == " ".join(vocabulary.tokens[i] for i in ids)
    assert len(words.number) <= 5


def test_words_outside_the_lexicon_are_merged_together(monkeypatch):
    vocabulary = bpe.Vocabulary(VOCABULARY)
    rng = np.random.default_rng(5)
    words = ["a", "é", "aaaaaaa", "banana", "ß" * 20, "日本語", "x" * bpe.SHORT_BYTES]
    words += ["".join(rng.choice(list("aeinrst'é12"), n)) for n in rng.integers(1, 30, 300)]
    wanted = [vocabulary.merge(w) for w in words]
    ids, sizes = vocabulary.merges.merge([w.encode() for w in words])
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == wanted
    assert [len(x) for x in vocabulary.merges.merge([])] == [0, 0]
    # Only words longer than that are merged one by one.
    alone, merge = [], bpe.Vocabulary.merge
    monkeypatch.setattr(bpe.Vocabulary, "merge", lambda self, word: alone.append(word) or merge(self, word))
    long = "ab" * bpe.SHORT_BYTES
    lexicon = bpe.Lexicon.build({b"banana": wanted[3]})
    offsets, ids = bpe.ids_of([*words, 7, long], vocabulary, lexicon)
    assert [x.tolist() for x in np.split(ids, offsets[1:-1])] == [*wanted, [7], merge(vocabulary, long)] and alone == [long]
