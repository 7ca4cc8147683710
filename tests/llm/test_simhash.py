import numpy as np
import pytest
import xxhash

from tests.llm.helpers import awkward, clashing, documents, empty
from weektide.llm import simhash
from weektide.llm.components import connected_components
from weektide.llm.queries import LLM_QUERIES


def plain_fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def check(rows, docs):
    docs = sorted(docs, key=lambda r: r["doc_id"])
    prints = [plain_fingerprint(r["text"]) for r in docs]
    roots = plain_groups(prints, 4)
    want = sorted((r["doc_id"], f"{p:016x}", docs[g]["doc_id"]) for r, p, g in zip(docs, prints, roots))
    assert sorted(map(tuple, rows)) == want


def test_query_against_brute_force(spark, small):
    rows = LLM_QUERIES["op1_simhash"](spark, small).collect()
    check(rows, spark.read.parquet(f"{small}/documents.parquet").collect())


def test_awkward_rows(spark):
    found = simhash.near_duplicates(awkward(spark), 4, 4).select("doc_id", "fingerprint", "first.doc_id").toDF("id", "fp", "first").collect()
    assert len(found) == 13
    by_id = {r["id"]: r for r in found if r["id"] is not None}
    assert by_id[1]["first"] == by_id[2]["first"] == 1
    assert by_id[3]["first"] == by_id[4]["first"] == by_id[5]["first"] == 3
    assert by_id[4]["fp"] == [0]
    assert sorted(r["first"] or -1 for r in found if r["id"] is None) == [-1, -1, 3]


def test_keep_first_keeps_one_row_and_all_columns(spark):
    docs = clashing(awkward(spark), ["row", "first", "fingerprint", "node", "text_key", "id", "kept_id"])
    kept = simhash.keep_first(docs, 5, 24, 2)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 6, 7, 8, 9]
    assert simhash.keep_first(empty(docs), 5, 24, 2).count() == 0


def test_near_copies_meet_and_others_do_not(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    base = [list(rng.choice(words, 300)) for _ in range(30)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        changed = list(b)
        for at in rng.choice(300, 4, replace=False):
            changed[at] = "other"
        rows.append((100 + i, " ".join(changed)))
    kept = simhash.keep_first(documents(spark, rows), 5, 24, 2)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(30))


@pytest.mark.parametrize("words,radius", [(1, 4), (1, 9), (2, 24)])
def test_tiles_find_every_link(words, radius):
    rng = np.random.default_rng(words + radius)
    rows = rng.integers(0, 1 << 63, (300, words), dtype=np.uint64)
    near = rows[:150].copy()
    for row in near:
        for _ in range(int(rng.integers(0, radius + 3))):
            row[rng.integers(0, words)] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
    everything = np.concatenate([rows, near])
    numbers = [int.from_bytes(r.astype(">u8").tobytes(), "big") for r in everything]
    want = plain_groups(numbers, radius)

    def groups(links):
        parent = list(range(len(everything)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, j in links:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
        return [find(i) for i in range(len(everything))]

    one = simhash.compare_tiles(everything, None, radius)
    assert groups(zip(*one)) == want
    left, right = everything[::2], everything[1::2]
    at = np.r_[np.arange(0, len(everything), 2), np.arange(1, len(everything), 2)]
    links = [simhash.compare_tiles(left, None, radius), simhash.compare_tiles(right, None, radius), simhash.compare_tiles(left, right, radius)]
    pairs = [(at[i], at[j]) for i, j in zip(*links[0])] + [(at[i + len(left)], at[j + len(left)]) for i, j in zip(*links[1])]
    pairs += [(at[i], at[j]) for i, j in zip(*links[2])]
    assert groups(pairs) == want


def test_small_tiles_give_the_same_groups(spark, small, monkeypatch):
    monkeypatch.setattr(simhash, "MIN_TILE", 7)
    rows = LLM_QUERIES["op1_simhash"](spark, small).collect()
    check(rows, spark.read.parquet(f"{small}/documents.parquet").collect())


def test_a_large_group_gives_few_links():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, dtype=np.uint64)
    rows = np.unique(np.array([base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 64, (2000, 2))]))[:, None]
    i, j = simhash.compare_tiles(rows, None, 4)
    assert len(i) == len(rows) - 1


def test_tile_ranges_cover_all_counts():
    counts = {20: 5, 30: 100, 31: 90, 32: 400, 40: 1}
    ranges = simhash.tile_ranges(counts, 150)
    assert [(a, b) for a, b, _ in ranges] == [(20, 30), (31, 31), (32, 32), (40, 40)]
    assert ranges[2][2] == 3


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, i) for i in range(101, 400)]
    loop = [(7, 7), (900, 901), (901, 902), (902, 900)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(chain[::-1] + star + loop, "u bigint, v bigint")).collect()))
    assert {found[i] for i in range(61)} == {0}
    assert {found[i] for i in range(100, 400)} == {100}
    assert {found[i] for i in (900, 901, 902)} == {900}
