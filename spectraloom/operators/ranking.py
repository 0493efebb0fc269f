"""Best candidates of a group, differences between ranks, and error-rate cutoffs.

Every order ends in columns that make it total, so results do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.store import saved


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark limits groups before and after the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def rank_scores(df: DataFrame, group: list[str], scores: list[str], ties: list[str], keep: int | None = None) -> DataFrame:
    """A rank from 1 for each score, largest first; with keep, rows of which any rank is at most that."""
    for s in scores:
        df = df.withColumn(f"rank_{s}", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(s), *ties)))
    return df if keep is None else df.where(F.least(*(f"rank_{s}" for s in scores)) <= keep)


def delta_to_top(df: DataFrame, group: list[str], score: str) -> Column:
    return F.max(score).over(Window.partitionBy(*group)) - F.col(score)


def delta_to_next(group: list[str], score: str, ties: list[str]) -> Column:
    """Score less that of the next rank; 0 for the last."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), *ties)
    return F.coalesce(F.col(score) - F.lead(score).over(w), F.lit(0.0))


def best_with_ties(df: DataFrame, group: list[str], order: list[Column], peers: list[str], names: str) -> DataFrame:
    """The best row of each group, with the names (array) of all rows that equal it in ``peers``: groups are
    cut to their best row before they are shuffled, and names are gathered of its peers alone."""
    best = top_k(df, group, order, 1, "_n").drop("_n", names)
    like = best.select(*(F.col(c).alias(f"_g_{c}") for c in group), *(F.col(c).alias(f"_b_{c}") for c in peers))
    on = [df[c].eqNullSafe(F.col(f"_g_{c}")) for c in group] + [df[c].eqNullSafe(F.col(f"_b_{c}")) for c in peers]
    same = df.join(like, on).select(*group, F.explode_outer(names).alias("_name"))
    known = same.groupBy(*group).agg(F.array_sort(F.collect_set("_name")).alias(names)).select(*(F.col(c).alias(f"_g_{c}") for c in group), names)
    out = best.join(known, [best[c].eqNullSafe(F.col(f"_g_{c}")) for c in group])
    return out.select(*df.columns)


#: Rows of a range over which running counts are taken, rows that one range holds without more ado, and
#: rows that are broadcast (a number and a partition value or two each).
ROWS, FEW, BROADCAST = 1_000_000, 50_000, 100_000


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST else df


def in_ranges(df: DataFrame, order: list[Column]) -> tuple[DataFrame, bool]:
    """df saved with _r, the number of the range of the order that a row lies in, and whether there are
    several: as many as there are partitions of a shuffle, more where there are many rows, one where they
    are FEW. Equal rows may lie in several."""
    once = saved(df)
    rows = once.count()
    if rows <= FEW:
        return once.withColumn("_r", F.lit(0)), False
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // ROWS)
    return saved(once.repartitionByRange(n, *order).withColumn("_r", F.spark_partition_id())), True


def beside(df: DataFrame, group: list[str], totals: DataFrame) -> DataFrame:
    """df with the columns of totals, which has a row for each range and group (_q and _g_ columns)."""
    totals = saved(totals)
    on = [F.col("_r") == F.col("_q"), *(F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group)]
    return df.join(small(totals, totals.count()), on).drop("_q", *(f"_g_{c}" for c in group))


def running(df: DataFrame, several: bool, group: list[str], order: list[Column], counts: dict[str, Column]) -> DataFrame:
    """df, which ``in_ranges`` dealt by group and order, with counts summed over all rows of the group up to
    each: in its range by a window, over the ranges before by their totals."""
    within = Window.partitionBy("_r", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({k: F.sum(v).over(within) for k, v in counts.items()})
    if not several:
        return out
    before = Window.partitionBy(*group).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("_r", *group).agg(*(F.sum(v).alias(f"_{k}") for k, v in counts.items()))
    totals = totals.select(F.col("_r").alias("_q"), *(F.col(c).alias(f"_g_{c}") for c in group), *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in counts))
    return beside(out, group, totals).withColumns({k: F.col(k) + F.col(f"_{k}") for k in counts}).drop(*(f"_{k}" for k in counts))


def fdr_cutoff(df: DataFrame, score: str, decoy: str, threshold: float, order: list[Column], partition: list[str] | None = None, first_of: list[str] | None = None) -> DataFrame:
    """Rows whose score reaches that of the longest prefix, by score and then ``order``, with
    decoys / targets at most threshold (a prefix without targets does not count).

    Rows are dealt over ranges of the whole order, ties among them too, and prefix counts are those
    within a range on top of the totals of the ranges before, so no task holds all rows or all of one
    score. With ``first_of`` only the first row of each combination of those columns counts, as for
    peptides. Without partitions the cut is one number, which reaches the scan of df as a filter."""
    group, counted = partition or [], df
    if first_of:
        w = Window.partitionBy(*group, *first_of).orderBy(F.desc(score), *order)
        counted = counted.withColumn("_f", F.row_number().over(w)).where("_f = 1")
    ties = [F.asc(o) if isinstance(o, str) else o for o in order]
    names = dict.fromkeys([*group, score, decoy, *(o for o in order if isinstance(o, str))])
    needed = counted.select(*names) if all(isinstance(o, str) for o in order) else counted
    by = [F.desc(score), *ties]
    dealt, several = in_ranges(needed.where(F.col(score).isNotNull()), [*(F.asc(c) for c in group), *by])
    run = running(dealt, several, group, by, {"_t": (~F.col(decoy)).cast("long"), "_d": F.col(decoy).cast("long")})
    good = run.where((F.col("_t") > 0) & (F.col("_d") <= threshold * F.col("_t")))
    if not group:
        cut = good.agg(F.min(score)).first()[0]
        return df.where(F.col(score) >= F.lit(cut)) if cut is not None else df.limit(0)
    cuts = saved(good.groupBy(*group).agg(F.min(score).alias("_cut")))
    return df.join(small(cuts, cuts.count()), group).where(F.col(score) >= F.col("_cut")).drop("_cut")


def q_values(df: DataFrame, score: str, decoy: str, partition: list[str] | None = None) -> DataFrame:
    """Each row with the least decoys / targets of any prefix that holds it. Rows without a score get no
    q-value and are left out. Counts are taken by distinct score, in ranges of scores."""
    group = partition or []
    by = df.where(F.col(score).isNotNull()).groupBy(*group, score).agg(F.sum((~F.col(decoy)).cast("long")).alias("_n"), F.sum(F.col(decoy).cast("long")).alias("_m"))
    dealt, several = in_ranges(by, [*(F.asc(c) for c in group), F.desc(score)])
    run = running(dealt, several, group, [F.desc(score)], {"_t": F.col("_n"), "_d": F.col("_m")})
    rates = run.select(*group, score, "_r", (F.col("_d") / F.greatest(F.col("_t"), F.lit(1))).alias("_rate"))
    up = Window.partitionBy("_r", *group).orderBy(F.asc(score)).rowsBetween(Window.unboundedPreceding, 0)
    least = F.min("_rate").over(up)
    found = rates.withColumn("q_value", least)
    if several:
        after = Window.partitionBy(*group).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
        ends = rates.groupBy("_r", *group).agg(F.min("_rate").alias("_l"))
        ends = ends.select(F.col("_r").alias("_q"), *(F.col(c).alias(f"_g_{c}") for c in group), F.min("_l").over(after).alias("_l"))
        found = beside(found, group, ends).withColumn("q_value", F.least("q_value", "_l"))
    return df.join(found.select(*group, score, "q_value"), [*group, score])
