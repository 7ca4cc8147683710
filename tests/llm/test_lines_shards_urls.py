import zlib
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from tests.compare import differences
from tests.llm.helpers import awkward, clashing, documents, empty
from weektide.llm import line_dedup, sharding, url_filter
from weektide.llm.oracle import LLM_ORACLE
from weektide.llm.queries import LLM_QUERIES, URL_RULES


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
@pytest.mark.parametrize("size", ["small", "medium"])
def test_query_matches_sql(spark, duck, request, name, size):
    folder = request.getfixturevalue(size)
    assert differences(LLM_QUERIES[name](spark, folder), duck[folder], LLM_ORACLE[name]) == []


@pytest.mark.parametrize("name", ["op3_url_filter", "op9_sharding"])
def test_native_queries_run_no_python(spark, small, name):
    plan = LLM_QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def plain_lines(rows, min_docs):
    strip = " \t\n\x0b\x0c\r"
    lower = {c: c + 32 for c in range(65, 91)}
    seen = Counter()
    for keys in {(i, k) for i, t in rows for k in {x.strip(strip).translate(lower) for x in (t or "").split("\n")}}:
        seen[keys[1]] += 1
    drop = {k for k, n in seen.items() if k and n >= min_docs}
    return [(i, "\n".join(x for x in (t or "").split("\n") if x.strip(strip).translate(lower) not in drop)) for i, t in rows]


def test_lines_against_brute_force(spark):
    rows = [(i, f"Head\n own {i}\n  SHARED \t\nÄ\n\n{'tail' if i % 2 else 'Tail '}\r") for i in range(12)]
    rows += [(20, None), (21, ""), (22, "shared"), (None, "shared\nx"), (None, "shared\nx"), (23, "\n\n")]
    rows += [(24, "once " * 20_000), (25, "\n".join(["shared", "a", "shared"]))]
    got = line_dedup.drop_shared_lines(documents(spark, rows), 10, 1).select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_lines(rows, 10)))


def test_lines_with_awkward_rows_and_clashing_names(spark):
    docs = clashing(awkward(spark), ["row", "lines", "drop", "n_lines", "stay", "text_key", "pos", "col"])
    kept = line_dedup.drop_shared_lines(docs, 2)
    assert set(kept.columns) == {*docs.columns, "n_dropped"}
    rows = {r["doc_id"]: r for r in kept.collect() if r["doc_id"] is not None}
    assert kept.count() == 13 and rows[3]["text"] == "" and rows[3]["n_lines"] == 1 and rows[3]["n_dropped"] == 0
    assert rows[1]["text"] == rows[2]["text"] == "" and rows[7]["n_dropped"] == 0 and rows[5]["n_lines"] == 2
    assert line_dedup.drop_shared_lines(empty(docs)).count() == 0


def test_hilbert_neighbours_touch(spark):
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        cells = list(product(range(1 << bits), repeat=n))
        frame = spark.createDataFrame(cells, ", ".join(f"c{i} int" for i in range(n)))
        index = sharding.hilbert_index([F.col(f"c{i}") for i in range(n)], bits)
        ordered = [tuple(r)[:-1] for r in frame.withColumn("h", index).orderBy("h").collect()]
        assert [r["h"] for r in frame.select(index.alias("h")).orderBy("h").collect()] == list(range(len(cells)))
        assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for x, y in zip(ordered, ordered[1:]))


def check_shards(rows, docs, n_shards=40):
    assert len(rows) == len(docs)
    counts = Counter(r["shard"] for r in rows)
    sizes = [counts.get(s, 0) for s in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(docs)
    for shard in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(counts[shard]))
    want = Counter((d["doc_id"], len((d["text"] or "").encode()) + 16, zlib.crc32((d["text"] or "").encode())) for d in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want


def test_shards_of_the_table(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").collect()
    rows = LLM_QUERIES["op9_sharding"](spark, medium).collect()
    check_shards(rows, docs)
    langs = {d["doc_id"]: d["lang"] for d in docs}
    per_shard = {}
    for r in rows:
        per_shard.setdefault(r["shard"], set()).add(langs[r["doc_id"]])
    # Hash or random shards would all hold all languages.
    assert sum(len(x) for x in per_shard.values()) / len(per_shard) < 2.2


def test_shards_of_awkward_rows(spark):
    docs = clashing(awkward(spark), ["row", "run", "curve", "shard", "k0"])
    found = sharding.document_shards(sharding.document_metadata(docs), 5)
    check_shards(found.collect(), docs.collect(), 5)
    assert sharding.document_shards(sharding.document_metadata(empty(docs)), 5).count() == 0
    kept = sharding.hilbert_shards(docs, {"chars": F.col("n_chars")}, [F.col("doc_id")], 3)
    assert kept.count() == 13 and {"row", "run", "k0"} <= set(kept.columns)


def test_sources_with_one_beginning_are_told_apart(spark):
    rows = spark.range(6400).selectExpr("id", "concat('https://common-crawl-', lpad(cast(id * 7919 % 64 AS string), 2, '0')) AS source")
    rows = rows.union(spark.range(3).selectExpr("id + 6400", "CAST(NULL AS string)"))
    (cell,), total = sharding.quantised(rows, {"source": F.col("source")}, 5)
    of = {r["source"]: r["cell"] for r in rows.select("source", cell.alias("cell")).distinct().collect()}
    assert total == 6403 and of.pop(None) == 0 and len(of) == 64
    # Equal shares: 64 sources of equal size in 32 cells, in their order.
    assert [of[s] for s in sorted(of)] == sorted(of.values())
    assert set(of.values()) == set(range(32)) and max(Counter(of.values()).values()) <= 3


def test_urls_of_every_kind(spark):
    urls = [
        "http://EXAMPLE.com/en/1", "https://www.Example.com/en/x?q=1", "http://a.example.com/EN/", "http://a.net/es/1#x",
        "http://net/fr/", "http://xnet/fr/", "http://b.org/fr/1", "http://com", "http://com/", "ftp://u:p@h.com:80/a?b/c",
        None, "", "no scheme", "://", "x://y", "http://a.com?x=/en/", "http://é.org/" + "ü" * 50_000, "http://b.org/fr/1",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").selectExpr("*", "'m' AS host", "'m' AS rule", "'m' AS score")
    rows = {r["page_id"]: r for r in url_filter.judge_urls(pages, URL_RULES).collect()}
    assert len(rows) == len(urls)
    for i, url in enumerate(urls):
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        cut = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
        head = rest[:cut]
        host = head.partition("/")[0]
        path = head[len(host):]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r for _, r in URL_RULES if (host == (d := r.partition("/")[0]) or host.endswith("." + d)) and path.startswith(r[len(d):])]
        rule = max(fits, key=len, default=None)
        got = rows[i]
        assert (got["host"], got["path"], got["rule"]) == (host, path, rule)
        assert got["verdict"] in ("allow", "block")
        if rule:
            assert got["verdict"] == dict((r, v) for v, r in URL_RULES)[rule]
    assert url_filter.judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_models_tell_good_from_bad_addresses(spark):
    good = [(i, f"http://good{i % 9}.com/news/{i}") for i in range(200)]
    bad = [(1000 + i, f"http://spam{i % 9}.net/es/win-{i}") for i in range(200)]
    asked = [(5000, "http://good3.org/news/5"), (5001, "http://spam4.org/es/win-7")]
    rows = url_filter.judge_urls(spark.createDataFrame(good + bad + asked, "page_id bigint, url string"), URL_RULES)
    found = {r["page_id"]: r["verdict"] for r in rows.where("page_id >= 5000").collect()}
    assert found == {5000: "allow", 5001: "block"}


def judged(spark, urls):
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    return {r["page_id"]: r for r in url_filter.judge_urls(rows, URL_RULES).collect()}


def test_the_models_read_the_whole_address(spark):
    """Addresses without a rule, a scheme or a path of their own are told apart by the characters they have."""
    good = [f"http://good{i % 9}.com/news/{i}?page=read" for i in range(200)]
    bad = [f"http://spam{i % 9}.net/es/win-{i}?prize=casino" for i in range(200)]
    asked = ["good7.example/news/8", "spam4.net/es/win", "http://x.org?page=read", "http://x.org?prize=casino", "http://x.org#page=read", "http://x.org#prize=casino"]
    found = judged(spark, [*good, *bad, *asked, None])
    assert [found[400 + k]["verdict"] for k in range(6)] == ["allow", "block"] * 3
    assert len({found[400 + k]["score"] for k in range(6)}) == 6
    assert found[401]["host"] == found[401]["path"] == ""
    assert found[406]["rule"] is None


def test_threshold_where_one_verdict_is_missing(spark):
    only_good = judged(spark, [f"http://a.com/{i}" for i in range(50)] + ["a.com/77", "zzzz"])
    assert [only_good[50 + k]["verdict"] for k in range(2)] == ["allow", "block"]
    nothing = judged(spark, ["http://b.org/x", "http://c.org/y", "http://c.org/y"])
    assert [r["verdict"] for r in nothing.values()] == ["allow"] * 3 and nothing[1]["score"] == nothing[2]["score"] == 0


def test_each_verdict_holds_one_address_back(spark):
    """The few blocked addresses have hashes that alone would keep them all in training."""
    import hashlib

    free = [u for u in (f"http://spam.net/es/win-{i}" for i in range(40)) if hashlib.md5(u.encode()).hexdigest()[0] not in "012"][:3]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(free + [f"http://good.com/{i}" for i in range(30)])], "page_id bigint, url string")
    marked = url_filter.judged_by_rule(pages, URL_RULES)
    kept_out = marked.where(url_filter.held_back(marked)).select("address").collect()
    assert [r[0] for r in kept_out if "spam" in r[0]] == [min(free, key=lambda u: hashlib.md5(u.encode()).hexdigest())]
    single = url_filter.judged_by_rule(pages.where("page_id = 0"), URL_RULES)
    assert single.where(url_filter.held_back(single)).count() == 0


def test_the_edge_above_all_scores_can_be_chosen(spark):
    scored = spark.createDataFrame([(155_000, 0, 5), (-500_000, 3, 0)], "score bigint, held_good bigint, held_bad bigint")
    assert url_filter.calibrated_threshold(scored) == 160_000
    apart = spark.createDataFrame([(-200_000, 0, 5), (300_000, 5, 0)], "score bigint, held_good bigint, held_bad bigint")
    assert url_filter.calibrated_threshold(apart) == 0
    one = spark.createDataFrame([(150_000, 0, 5)], "score bigint, held_good bigint, held_bad bigint")
    assert url_filter.calibrated_threshold(one) == 0
