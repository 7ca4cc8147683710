"""Rules and a character language model that judge page addresses.

Where no rule fits, two variable-order Markov models over characters decide: one of the
addresses that rules allow, one of those they block. Orders back off into each other by
Witten-Bell smoothing. An address is allowed when the difference of its log-likelihoods per
character reaches a threshold that is calibrated on addresses kept out of training.

The models read the whole address, scheme, query and fragment included, with its host in lower
case; one without ``://`` as it is. They take all digits for equal, so addresses are counted by
their shape and a host with a third of all pages adds few rows. Which addresses are kept out of training
is decided before that, by their hash and for each verdict. Only built-in expressions are used; n-gram
counts combine before they are shuffled, and every table that grows is joined by key and never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weektide.llm.common import ascii_lower, written

Rule = tuple[str, str]  # verdict, and host with path: ("block", "net/es/")

ORDER = 4
START, END = "\x02", "\x03"
# Scores are counted in millionths, so that sums are exact in any order.
UNIT = 1_000_000
BIN = UNIT // 100


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path, both empty where there is no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits the host or a parent domain of it, and starts the path."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def judged_by_rule(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    verdict = F.create_map(*[F.lit(x) for v, rule in rules for x in (rule, v)])
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), whole_address(F.col("url")).alias("address"))
    ruled = parsed.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    shape = F.regexp_replace("address", "[0-9]", "0")
    return ruled.select("*", F.try_element_at(verdict, F.col("rule")).alias("ruled"), shape.alias("shape"))


def whole_address(url: Column) -> Column:
    """The whole url with its host in lower case; '' only where it is missing or empty."""
    pattern = r"(?s)^(.*?://)([^/?#]*)(.*)$"
    start, host, rest = (F.regexp_extract(url, pattern, k) for k in (1, 2, 3))
    return F.coalesce(F.when(start != "", F.concat(start, ascii_lower(host), rest)), url, F.lit(""))


def windows(address: Column, order: int) -> Column:
    """Every character of the address and its end mark, each with the ``order`` characters before it."""
    padded = F.concat(F.lit(START * order), address, F.lit(END))
    starts = F.sequence(F.lit(1), F.char_length(address) + 1)
    return F.transform(starts, lambda i: F.substring(padded, i, F.lit(order + 1)))


def smoothed(grams: DataFrame, order: int) -> DataFrame:
    """``(gram, p_good, p_bad)`` of the highest order from counts ``(gram, good, bad)``.

    From order 0 up, a context seen n times with t different followers gives its own
    counts the weight n / (n + t) and the order below the rest. An unseen context takes the
    order below as it is. Below order 0 all characters are equally likely.
    """
    lower = None
    for k in range(order + 1):
        counts = grams.groupBy(F.expr(f"right(gram, {k + 1})").alias("gram")).agg(
            F.sum("good").alias("good"), F.sum("bad").alias("bad")
        )
        contexts = counts.groupBy(F.expr(f"left(gram, {k})").alias("context")).agg(
            F.sum("good").alias("n_good"),
            F.sum("bad").alias("n_bad"),
            F.count_if(F.col("good") > 0).alias("t_good"),
            F.count_if(F.col("bad") > 0).alias("t_bad"),
            F.count(F.lit(1)).alias("followers"),
        )
        joined = counts.withColumn("context", F.expr(f"left(gram, {k})")).join(contexts, "context")
        if lower is None:
            even = F.lit(1.0) / F.col("followers")
            joined = joined.withColumns({"q_good": even, "q_bad": even})
        else:
            below = lower.select(F.col("gram").alias("suffix"), F.col("p_good").alias("q_good"), F.col("p_bad").alias("q_bad"))
            joined = joined.withColumn("suffix", F.expr(f"right(gram, {k})")).join(below, "suffix")
        lower = joined.select(
            "gram",
            *[
                F.when(F.col(f"n_{c}") == 0, F.col(f"q_{c}"))
                .otherwise((F.col(c) + F.col(f"t_{c}") * F.col(f"q_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}")))
                .alias(f"p_{c}")
                for c in ("good", "bad")
            ],
        )
    return lower


def calibrated_threshold(scored: DataFrame) -> int:
    """Score, in millionths, that best separates the held-back addresses with a rule.

    It is an edge of a bin of one hundredth, that above the highest and 0 included, with the smallest sum of
    both error rates; ties go to the edge nearest 0. Bins end at +-100, so the histogram has a bounded
    size. Where no address of one verdict is held back there is nothing to weigh, and the threshold is 0.
    """
    clipped = F.least(F.greatest(F.floor(F.col("score") / BIN), F.lit(-10_000)), F.lit(10_000))
    bins = scored.where("held_good + held_bad > 0").groupBy(clipped.alias("bin")).agg(F.sum("held_good").alias("good"), F.sum("held_bad").alias("bad"))
    edges = bins.agg(F.explode(F.array(F.max("bin") + 1, F.lit(0).cast("bigint"))).alias("bin"))
    candidates = bins.unionByName(edges.selectExpr("bin", "0L AS good", "0L AS bad")).groupBy("bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    losses = candidates.selectExpr(
        "bin",
        "(sum(good) OVER (ORDER BY bin) - good) / nullif(sum(good) OVER (), 0) AS lost_good",
        "sum(bad) OVER (ORDER BY bin DESC) / nullif(sum(bad) OVER (), 0) AS kept_bad",
    )
    best = losses.where("lost_good IS NOT NULL AND kept_bad IS NOT NULL").orderBy(F.round(F.expr("lost_good + kept_bad"), 9), F.abs("bin"), "bin")
    row = best.limit(1).first()
    return int(row["bin"]) * BIN if row else 0


def held_back(judged: DataFrame) -> Column:
    """True for three sixteenths of the addresses, by hash, kept out of training to set the threshold.

    If these hold none of a verdict that has several addresses, the one with the smallest hash is held back.
    """
    digest = F.md5("address")
    some = F.substring(digest, 1, 1).isin("0", "1", "2")
    verdicts = judged.where("ruled IS NOT NULL").groupBy("ruled").agg(F.count_if(some).alias("n"), F.min(digest).alias("least"), F.max(digest).alias("most"))
    # Two rows at most, one for each verdict.
    forced = [r["least"] for r in verdicts.collect() if r["n"] == 0 and r["least"] != r["most"]]
    return some | digest.isin(forced) if forced else some


def shape_scores(judged: DataFrame, order: int = ORDER) -> tuple[DataFrame, int]:
    """``(shape, score)`` of each different shape of addresses, and the threshold; both in millionths."""
    held, allowed, blocked = held_back(judged), F.col("ruled") == "allow", F.col("ruled") == "block"
    shapes = written(
        judged.groupBy("shape").agg(
            F.count_if(allowed & ~held).alias("good"),
            F.count_if(blocked & ~held).alias("bad"),
            F.count_if(allowed & held).alias("held_good"),
            F.count_if(blocked & held).alias("held_bad"),
        ),
        "address-shapes",
    )
    exploded = shapes.select("good", "bad", F.explode(windows(F.col("shape"), order)).alias("gram"))
    grams = written(exploded.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "address-grams")
    ratio = F.round((F.log("p_good") - F.log("p_bad")) * UNIT).cast("bigint")
    model = smoothed(grams, order).select("gram", ratio.alias("ratio"))
    each = shapes.select("shape", F.explode(windows(F.col("shape"), order)).alias("gram")).join(model, "gram")
    sums = each.groupBy("shape").agg(F.sum("ratio").alias("total"), F.count(F.lit(1)).alias("n"))
    mean = F.floor(F.col("total") / F.col("n"))
    scored = written(shapes.join(sums, "shape").select("shape", "held_good", "held_bad", mean.alias("score")), "address-scores")
    return scored.select("shape", "score"), calibrated_threshold(scored)


def judge_urls(pages: DataFrame, rules: list[Rule], order: int = ORDER) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` for every page.

    ``score`` is the difference of log-likelihoods per character above the threshold, in
    millionths; at 0 or more the models allow. An address without ``://`` has empty host and path
    and is judged by the models by its own characters, a missing one like an empty one. With no rule that
    fits any address all are allowed. Repeated pages are each judged.
    """
    judged = judged_by_rule(pages, rules)
    scores, threshold = shape_scores(judged, order)
    above = F.col("score") - threshold
    return judged.join(scores, "shape").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(above >= 0, "allow").otherwise("block")).alias("verdict"),
        above.cast("bigint").alias("score"),
    )
