"""Wilson intervals, the metric family, labels needed for a claim, confusion counts and the upper median."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfish import config


def wilson(k: Column, n: Column, z: float = config.WILSON_Z) -> tuple[Column, Column]:
    """Lower and upper bound of a share, within 0 and 1, to four places; null without cases."""
    p, zz = k / n, z * z
    middle, width = p + zz / (2 * n), z * F.sqrt((p * (1 - p) + zz / (4 * n)) / n)
    low, high = (middle - width) / (1 + zz / n), (middle + width) / (1 + zz / n)
    return F.when(n > 0, F.bround(F.greatest(F.lit(0.0), low), 4)), F.when(n > 0, F.bround(F.least(F.lit(1.0), high), 4))


def labels_needed(target: float, errors: int = 0, z: float = config.WILSON_Z) -> int:
    """The fewest cases at which the Wilson lower bound, rounded to four places, reaches the target with so many errors."""
    n = errors + 1
    while True:
        p = (n - errors) / n
        low = (p + z * z / (2 * n) - z * math.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
        if round(low, 4) >= target:
            return n
        n += 1


def cases_needed(rows: DataFrame, target: str = "target", errors: str = "errors") -> DataFrame:
    """Rows with n_needed: labels_needed() of each row's target (below 1) and errors, found among the sizes that the bound can reach it at."""
    z = config.WILSON_Z
    t, e = F.col(target).cast("double"), F.col(errors).cast("double")
    most = F.ceil((e + z * z + 2 * z * F.sqrt(e + z * z)) / (1 - t)) + 10

    def reached(n: Column) -> Column:
        low, _ = wilson(n - e, n.cast("double"))
        return low >= t

    return rows.withColumn("n_needed", F.get(F.filter(F.sequence(F.col(errors).cast("long") + 1, most), reached), F.lit(0)))


def family(rows: DataFrame, by: str) -> DataFrame:
    """rows (flagged, bad) per group: counts, precision, recall, false positive and false negative rate and the precision's interval."""
    out = rows.groupBy(by).agg(
        F.count_if(F.col("flagged") & F.col("bad")).alias("tp"), F.count_if(F.col("flagged") & ~F.col("bad")).alias("fp"),
        F.count_if(~F.col("flagged") & F.col("bad")).alias("fn"), F.count_if(~F.col("flagged") & ~F.col("bad")).alias("tn"),
    )
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.round(F.col(a) / (F.col(a) + F.col(b)), 4))
    low, high = wilson(F.col("tp"), F.col("tp") + F.col("fp"))
    return out.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn"), "fpr": share("fp", "tn"), "fnr": share("fn", "tp"), "precision_low": low, "precision_high": high})


def upper_medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group: n, least, most and the element in the middle, the greater of two; nulls are left out.

    It is found from running sums of the counts of distinct values, so that no task holds a group's rows in memory.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumns({"_upto": upto, "_total": F.sum("_n").over(Window.partitionBy(*by))})
    middle = F.min(F.when(F.col("_upto") > F.floor(F.col("_total") / 2), F.col(value)))
    return placed.groupBy(*by).agg(F.sum("_n").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), middle.alias("upper_median"))
