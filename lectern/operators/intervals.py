"""Sweeps, unions, medians and percentiles over ordered rows of a group, as windows and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def weighted_median(rows: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """(key, median): the first value, from below, at which half of all weight is reached."""
    up = W.partitionBy(key).orderBy(value).rangeBetween(W.unboundedPreceding, W.currentRow)
    run = rows.withColumn("run", F.sum(weight).over(up)).withColumn("half", F.sum(weight).over(W.partitionBy(key)) / 2)
    return run.where("run >= half").groupBy(key).agg(F.min(value).alias("median"))


def low_percentile(rows: DataFrame, keys: list[str], value: str, share: float = 0.35) -> DataFrame:
    """(keys, low): the value at place floor((n - 1) * share) from below."""
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("v"))
    return grouped.select(*keys, F.element_at("v", (F.floor((F.size("v") - 1) * share) + 1).cast("int")).alias("low"))


def coverage(gaps: DataFrame, key: str, support: str) -> DataFrame:
    """(key, left, right): stretches that at least `support` of the gaps (left, right) cover; neighbours are one."""
    events = gaps.where(F.col("right") > F.col("left")).select(key, support, F.explode(F.array(F.struct(F.col("left").alias("x"), F.lit(1).alias("d")), F.struct(F.col("right").alias("x"), F.lit(-1).alias("d")))).alias("e"))
    at = events.groupBy(key, F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"), F.max(support).alias(support))
    order = W.partitionBy(key).orderBy("x")
    run = at.withColumn("n", F.sum("d").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("next", F.lead("x").over(order))
    good = run.where((F.col("n") >= F.col(support)) & F.col("next").isNotNull())
    fresh = good.withColumn("new", F.coalesce(F.lag("next").over(order) != F.col("x"), F.lit(True)).cast("int"))
    return fresh.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).groupBy(key, "island").agg(F.min("x").alias("left"), F.max("next").alias("right")).drop("island")


def union(spans: DataFrame, key: str, left: str = "left", right: str = "right") -> DataFrame:
    """(key, left, right, n): spans that touch or overlap as one, with how many they were."""
    order = W.partitionBy(key).orderBy(left, right)
    reach = F.max(right).over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.coalesce(F.col(left) > reach, F.lit(True)).cast("int"))
    grouped = marked.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return grouped.groupBy(key, "island").agg(F.min(left).alias("left"), F.max(right).alias("right"), F.count("*").alias("n")).drop("island")


def runs(parts: DataFrame, key: str, gap: str) -> DataFrame:
    """parts (key, x, width, paragraph) with run: a new one after more than `gap` of space, or in another paragraph."""
    order = W.partitionBy(key).orderBy("x", "width", "paragraph")
    end = F.max(F.col("x") + F.col("width")).over(order.rowsBetween(W.unboundedPreceding, -1))
    changed = F.coalesce(F.lag("paragraph").over(order) != F.col("paragraph"), F.lit(False))
    new = F.coalesce((F.col("x") - end > F.col(gap)) | changed, F.lit(True)).cast("int")
    return parts.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("new")


def within_budget(items: DataFrame, key: str, order: str, limits: dict[str, int]) -> DataFrame:
    """(key, within): whether the sums of the sizes given by `limits` stay below them up to the last item."""
    return items.groupBy(key).agg(F.bool_and(F.lit(True)).alias("_"), *(F.sum(c).alias(c) for c in limits)).select(key, _all(limits).alias("within"))


def _all(limits: dict[str, int]):
    out = F.lit(True)
    for c, most in limits.items():
        out = out & (F.col(c) <= most)
    return out


def first_excess(items: DataFrame, key: str, order: str, size: str, most: int) -> DataFrame:
    """(key, at): the first item at which the running sum of sizes exceeds the limit; only groups that exceed it."""
    up = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return items.withColumn("run", F.sum(size).over(up)).where(F.col("run") > most).groupBy(key).agg(F.min(order).alias("at"))


def numeric_table(rows: DataFrame, key: str) -> DataFrame:
    """(key, is_table): three rows or more, and 60 % of all, hold a short label and a number; rows: key, texts (an array)."""
    pair = (F.size("texts") == 2) & F.forall("texts", lambda t: F.length(t) <= 60) & F.try_element_at("texts", F.lit(2)).rlike(r"^[-+\d$€£¥%.,\s/():]+$")
    n = F.count_if(pair)
    return rows.groupBy(key).agg(((n >= 3) & (n >= F.count("*") * 0.6)).alias("is_table"))
