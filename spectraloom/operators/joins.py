"""Joins by mass bands and nearest values, and the equi-joins around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.operators.ranking import small, top_k
from spectraloom.store import saved

NEUTRON = 1.003355


def mass_windows(windows, tolerance: float, spacing: float = NEUTRON) -> list[tuple[float, float]]:
    """Offsets [w * spacing - tolerance, w * spacing + tolerance], overlapping ones merged."""
    out: list[tuple[float, float]] = []
    for lo, hi in sorted((w * spacing - tolerance, w * spacing + tolerance) for w in windows):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def band_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, windows: list[tuple[float, float]], bin_width: float | None = None) -> DataFrame:
    """Pairs with left + lo <= right <= left + hi for one of some disjoint windows. Each left row
    goes to the bins its windows touch and each right row to its own, so this is an equi-join on
    the bin with an exact condition, which hashes or sorts, splits skew and never crosses."""
    width = bin_width or max(2 * max(hi - lo for lo, hi in windows), 1e-9)
    v = F.col(left_value)
    bins = F.array_distinct(F.flatten(F.array(*(F.sequence(F.floor((v + lo) / width), F.floor((v + hi) / width)) for lo, hi in windows))))
    a = left.where(v.isNotNull()).withColumn("_bin", F.explode(bins))
    b = right.where(F.col(right_value).isNotNull()).withColumn("_bin", F.floor(F.col(right_value) / width))
    inside = F.lit(False)
    for lo, hi in windows:
        inside = inside | F.col(right_value).between(v + lo, v + hi)
    return a.join(b, "_bin").where(inside).drop("_bin")


def best_in_band(left: DataFrame, right: DataFrame, left_key: str, left_value: str, right_value: str, windows: list[tuple[float, float]], first: Column | None, order: list[Column], best: Column | None = None, inside: Column | None = None) -> DataFrame:
    """For each left row the first of the right rows in its windows (and ``inside``, a condition on both
    values): by ``first``, a column of both values, or by ``best``, one of the right row; then by the smaller
    right value, then by ``order``, columns of the right row.

    Rows of one value are alike but for their order, so pairs are made of distinct values alone, each right one
    with its least ``best``: they do not grow with the rows that share a value. The rows of chosen values
    are then read again. Right values beyond all windows are left out by the scan."""
    least, most = left.agg(F.min(left_value), F.max(left_value)).first()
    if least is None:
        return left.join(right, F.lit(False))
    low, high = F.lit(least) + min(lo for lo, _ in windows), F.lit(most) + max(hi for _, hi in windows)
    near = right.where(F.col(right_value).between(low, high))
    values = near.select(right_value).distinct()
    if best is not None:
        values = near.withColumn("_o", best).groupBy(right_value).agg(F.when(~F.max(F.col("_o").isNull()), F.min("_o")).alias("_o"))
        first = F.col("_o")
    pairs = band_join(left.select(left_value).distinct(), values, left_value, right_value, windows)
    if inside is not None:
        pairs = pairs.where(inside)
    chosen = saved(pairs.groupBy(left_value).agg(F.min(F.struct(first.alias("_f"), F.col(right_value).alias("_r"))).alias("_c")).select(F.col(left_value).alias("_l"), "_c.*"))
    few = saved(chosen.select(F.col("_r").alias("_v"), *([F.col("_f").alias("_b")] if best is not None else [])).distinct())
    same = F.col(right_value) == F.col("_v")
    rows = near.join(small(few, few.count()), same if best is None else same & best.eqNullSafe(F.col("_b"))).select(*right.columns)
    if order:
        rows = top_k(rows, [right_value], order, 1, "_n").drop("_n")
    else:
        rows = rows.dropDuplicates([right_value])
    met = left.join(small(chosen, chosen.count()), F.col(left_value) == F.col("_l")).join(rows, F.col("_r") == F.col(right_value))
    return top_k(met, [left_key], [F.col("_f"), F.col("_r"), *order], 1, "_n").select(*left.columns, *right.columns)


def nearest_join(left: DataFrame, right: DataFrame, left_key: str, left_value: str, right_value: str, tolerance: float, order: Column | None = None, best: str = "nearest") -> DataFrame:
    """For each left row the nearest right value within a strict tolerance, or with best='largest'
    the one with the largest ``order``, which must be given; ties go to the smaller right value."""
    if best == "largest" and order is None:
        raise ValueError("best='largest' needs an order")
    gap, ties = F.abs(F.col(right_value) - F.col(left_value)), [order] if order is not None else []
    return best_in_band(left, right, left_key, left_value, right_value, [(-tolerance, tolerance)], gap, ties, None if best == "nearest" else -order, gap < tolerance)


def back_off(left: DataFrame, right: DataFrame, left_at: str, right_at: str, value: Column, steps: int = 3) -> DataFrame:
    """As-of with back-off: the latest of the ``steps`` right ordinals up to the left one that has a value."""
    tried = left.withColumn("_at", F.explode(F.sequence(F.col(left_at) - steps + 1, F.col(left_at))))
    met = tried.join(right.withColumn("_v", value).where("_v IS NOT NULL"), F.col("_at") == F.col(right_at))
    keys = [F.col(c) for c in left.columns]
    return met.groupBy(*keys).agg(F.max_by("_v", "_at").alias("value"), F.max("_at").alias("found_at"))


def left_pivot(base: DataFrame, rows: DataFrame, key: str, by: str, values: list, **aggregates: Column) -> DataFrame:
    """base with one column for each of the values and aggregates, missing ones null: one
    aggregation and one left join, whatever the number of samples."""
    wide = rows.groupBy(key).pivot(by, values).agg(*(a.alias(n) for n, a in aggregates.items()))
    return base.join(wide, key, "left")
