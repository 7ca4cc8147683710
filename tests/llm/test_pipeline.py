"""The pipeline on planted cases, and its decisions against plainer versions."""

import importlib
import random
import re
import subprocess
import sys
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from tests.llm.helpers import awkward, clashing, documents
from tests.llm.test_simhash import plain_fingerprint, plain_groups
from weektide.llm.common import table

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(4000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passage = text(60)
    items = [(i, text(30)) for i in range(10)]
    rows, labels, kind = [], [], {}

    def put(name, body):
        kind[len(rows)] = name
        rows.append((len(rows), body))

    for i in range(300):
        put("clean", f"{text(80)}.\n{text(40)}.")
        labels.append((len(rows) - 1, 1, 0))
    for i in range(60):
        put("toxic", f"{text(40)}. {text(5)} gruntle {text(5)}. {text(30)}")
        labels.append((len(rows) - 1, 0, 1))
    for i in range(12):
        put("shared line", f"{text(60)}\n{passage}\n{text(60)}")
    for i in range(10):
        put("copy", rows[i][1])
    for i in range(10, 20):
        body = rows[i][1].split(" ")
        body[30] = "changed"
        put("near copy", " ".join(body))
    for i in range(5):
        put("leak", f"{text(50)} {items[i][1]} {text(50)}")
    for i in range(5, 8):
        part = items[i][1].split()
        put("reordered leak", f"{text(50)} {' '.join(part[15:])} and {' '.join(part[:15])} {text(50)}")
    folder = str(tmp_path_factory.mktemp("planted"))
    documents(spark, rows).withColumn("n_chars", F.length("text").cast("bigint")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, kind, passage


def test_stages_catch_what_is_planted(spark, planted):
    folder, rows, kind, passage = planted
    docs, kept = table(spark, folder, "documents"), {}
    for name, stage in C.STAGES[:4]:
        before = docs.columns
        docs = C.written(stage(spark, docs, folder), f"test-{name}")
        assert docs.columns == before
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    of = lambda ids: {kind[i] for i in ids}
    everyone = set(kind)
    assert of(everyone - set(kept["toxicity"])) == {"toxic"}
    assert "toxic" not in of(kept["toxicity"])
    lines = kept["line_dedup"]
    assert set(lines) == set(kept["toxicity"])
    assert not any(passage in r["text"] for r in lines.values())
    assert all(r["n_chars"] == len(r["text"]) for r in lines.values())
    assert all(lines[i]["text"] == rows[i][1] for i in lines if kind[i] == "clean")
    dropped = set(lines) - set(kept["simhash_near_dedup"])
    assert dropped == set(lines) - plain_kept({i: r["text"] for i, r in lines.items()})
    assert {i for i in lines if kind[i] == "copy"} <= dropped
    assert of(dropped) <= {"copy", "near copy"}
    leaks = set(kept["simhash_near_dedup"]) - set(kept["benchmark_decontamination"])
    assert leaks == {i for i in everyone if "leak" in kind[i]}
    clean = {i for i in everyone if kind[i] == "clean"}
    assert clean <= set(kept["benchmark_decontamination"])


def test_run_gives_the_ids_of_what_is_kept(spark, planted):
    folder, _, kind, _ = planted
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    source = {r["doc_id"]: r["text"] for r in table(spark, folder, "documents").collect()}
    rows = C.run(spark, folder).collect()
    assert 312 <= len(rows) <= 322
    for r in rows:
        if kind[r["doc_id"]] == "clean":
            assert r["ids"] == library.encode(source[r["doc_id"]], add_special_tokens=False).ids
            assert r["n_tokens"] == len(r["ids"])


def plain_kept(texts):
    """Ids that stay: the smallest of each group of fingerprints that are linked within the distance."""
    ids = sorted(texts)
    groups = plain_groups([plain_fingerprint(texts[i], C.SHINGLE_WORDS) for i in ids], C.DISTANCE)
    return {i for at, i in enumerate(ids) if groups[at] == at}


def test_near_copy_stage_equals_brute_force(spark, small):
    texts = {r["doc_id"]: r["text"] for r in table(spark, small, "documents").collect()}
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    # Around the distance, in chains, in a large group, and texts that share a template.
    for n in (6, 20, 200, 600):
        for base in range(4):
            body = [word() for _ in range(n)]
            for _ in range(12 if base else 40):
                body = list(body)
                texts[len(texts) + 1000] = " ".join(body)
                body[rng.randrange(n)] = word()
    template = " ".join(word() for _ in range(40))
    for _ in range(60):
        texts[len(texts) + 1000] = f"{template} {word()} {word()}"
    texts |= {5000: "", 5001: None, 5002: " \n"}
    docs = clashing(documents(spark, list(texts.items())), ["node", "first", "fingerprint", "root", "text_key"])
    kept = C.drop_near_copies(spark, docs, small)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == plain_kept(texts)


def test_awkward_rows_pass_all_stages(spark, planted):
    folder = planted[0]
    docs = awkward(spark)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() >= 6
    none = awkward(spark).limit(0)
    for _, stage in C.STAGES:
        none = stage(spark, none, folder)
    assert none.count() == 0


def test_stage_functions_are_named_and_in_order():
    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "bpe_encoding"]
    assert C.ORACLE_SQL is None


def test_nothing_else_imports_the_folder():
    pattern = re.compile(r"weektide\.llm|corpus_pipeline|from \.+llm")
    for path in [*ROOT.glob("weektide/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.parts:
            assert not pattern.search(path.read_text()), path


def test_entry_works_without_the_folder(tmp_path):
    for name in ("__spark_entry__.py", "bench.py"):
        (tmp_path / name).write_text((ROOT / name).read_text())
    for path in ROOT.glob("weektide/**/*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            target = tmp_path / path.relative_to(ROOT)
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(path.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
    assert importlib.import_module("__spark_entry__").queries()["pipeline"] is C.run
