"""Classification metrics as aggregates over confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction", groups: list[str] = ()) -> DataFrame:
    """One row per group with the four counts; everything else derives from it."""
    truth, guess = F.col(label), F.col(prediction)
    cells = [F.count_if((truth == t) & (guess == p)).alias(f"n{t}{p}") for t in (0, 1) for p in (0, 1)]
    return df.groupBy(*groups).agg(*cells)


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction", groups: list[str] = ()) -> DataFrame:
    """Rows are true classes, columns predicted ones."""
    counts = confusion_counts(df, label, prediction, groups)
    return counts.select(
        *groups,
        F.expr("stack(2, 0, n00, n01, 1, n10, n11) AS (label, predicted_0, predicted_1)"),
    )


def rate(part: Column, whole: Column) -> Column:
    """Share that is 0 where there is nothing to share."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def class_rates(counts: DataFrame, number: int) -> dict[str, Column]:
    other = 1 - number
    hit = F.col(f"n{number}{number}")
    support = hit + F.col(f"n{number}{other}")
    claimed = hit + F.col(f"n{other}{number}")
    return {
        "precision": rate(hit, claimed),
        "recall": rate(hit, support),
        "f1": rate(2 * hit, support + claimed),
        "support": support,
    }


def per_class_report(counts: DataFrame, names: dict[int, str], groups: list[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    entries = [
        F.struct(F.lit(name).alias("class"), *[c.alias(k) for k, c in class_rates(counts, number).items()])
        for number, name in names.items()
    ]
    return counts.select(*groups, F.inline(F.array(*entries)))


def metrics(counts: DataFrame, groups: list[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy and macro F1.

    A class without true rows does not count for the balanced accuracy, and one that is
    neither true nor predicted anywhere does not count for the F1.
    """
    rates = [class_rates(counts, number) for number in (0, 1)]
    right = F.col("n00") + F.col("n11")
    rows = right + F.col("n01") + F.col("n10")

    def mean_where(values: list[Column], present: list[Column]) -> Column:
        summed = sum((F.when(p, v).otherwise(0.0) for v, p in zip(values, present)), F.lit(0.0))
        return F.try_divide(summed, sum((p.cast("int") for p in present), F.lit(0)))

    supported = [r["support"] > 0 for r in rates]
    seen = [
        (F.col("n00") + F.col("n01") + F.col("n10")) > 0,
        (F.col("n11") + F.col("n01") + F.col("n10")) > 0,
    ]
    return counts.select(
        *groups,
        rate(right, rows).alias("accuracy"),
        mean_where([r["recall"] for r in rates], supported).alias("balanced_accuracy"),
        mean_where([r["f1"] for r in rates], seen).alias("f1_macro"),
    )
