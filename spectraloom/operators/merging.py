"""Matches of one spectrum from several searches and from targets and decoys, merged and ranked anew.

Every order ends in columns that make it total. ``group`` names the columns of a spectrum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best_of_peptide(df: DataFrame, group: list[str], peptide: str, score: str, proteins: str, percentage: str | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """One row for each peptide of a spectrum: that of the best score, of equals the smaller percentage,
    then by ``ties``; with the proteins of all of its rows, sorted. Partial aggregation, no window."""
    rest = [c for c in df.columns if c not in (*group, peptide, proteins)]
    first = [F.col(percentage).asc_nulls_last()] if percentage else []
    key = F.struct((-F.col(score)).alias("_s"), *([F.col(percentage).alias("_p")] if first else []), *(F.col(t).alias(f"_t{i}") for i, t in enumerate(ties)))
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list(proteins))))
    out = df.groupBy(*group, peptide).agg(F.min_by(F.struct(*rest), key).alias("_r"), names.alias(proteins))
    return out.select(*group, peptide, proteins, *(F.col("_r")[c].alias(c) for c in rest)).select(*df.columns)


def top_across(df: DataFrame, group: list[str], peptide: str, score: str, n: int, ties: tuple[str, ...] = (), rank: str = "rank") -> DataFrame:
    """The n best peptides of each spectrum over all searches, each at its best score; of equal scores
    the first by peptide, then by ``ties``."""
    order = Window.partitionBy(*group, peptide).orderBy(F.desc(score), *ties)
    once = df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    by = Window.partitionBy(*group).orderBy(F.desc(score), peptide)
    return once.withColumn(rank, F.row_number().over(by)).where(F.col(rank) <= n)


def with_decoys(targets: DataFrame, decoys: DataFrame, run: str, group: list[str], naked: str, score: str, ties: tuple[str, ...] = (), rank: str = "rank") -> DataFrame:
    """Targets, and decoys whose naked sequence no target of their run has, ranked anew in each spectrum."""
    seen = targets.select(run, naked).distinct()
    both = targets.withColumn("is_decoy", F.lit(False)).unionByName(decoys.join(seen, [run, naked], "left_anti").select(*decoys.columns).withColumn("is_decoy", F.lit(True)))
    by = Window.partitionBy(*group).orderBy(F.desc(score), "is_decoy", naked, *ties)
    return both.withColumn(rank, F.row_number().over(by))


def paired_runs(targets: DataFrame, decoys: DataFrame, run: str) -> DataFrame:
    """The runs that have both a target and a decoy file: run, targets, decoys (numbers of rows)."""
    a = targets.groupBy(run).agg(F.count("*").alias("targets"))
    return a.join(decoys.groupBy(run).agg(F.count("*").alias("decoys")), run)


#: Rows of a partition whose spectra are sorted in memory.
ROWS = 250_000


def purged(df: DataFrame, group: list[str], scores: list[str], ties: list[str], trigger: int = 100, keep: int = 20) -> DataFrame:
    """In spectra of more than ``trigger`` rows, those that any score ranks up to ``keep``. Partitions follow
    the rows, so what a task sorts does not grow with them; sizes are counted in the order of the last score."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // ROWS)
    out = df.repartition(parts, *group)
    for i, s in enumerate(scores):
        out = out.withColumn(f"_r{i}", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(s), *ties)))
    out = out.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    least = F.least(*(f"_r{i}" for i in range(len(scores)))) if len(scores) > 1 else F.col("_r0")
    return out.where((F.col("_size") <= trigger) | (least <= keep)).drop("_size", *(f"_r{i}" for i in range(len(scores))))


def legacy_order(score: str, distance: Column, modified: Column, peptide: str, percentage: str) -> list[Column]:
    """How the older reports order matches: score, mass distance, modifications, peptide, percentage."""
    return [F.desc(score), distance.asc(), modified.asc(), F.asc(peptide), F.asc(percentage)]


def re_rank_order(probability: str, error: str, modified: str, peptide: str) -> list[Column]:
    """How the best match of a spectrum is chosen: probability, absolute mass error, modifications, text."""
    return [F.desc(probability), F.abs(F.col(error)).asc(), F.asc(modified), F.upper(F.col(peptide)).asc()]


def delta_p(df: DataFrame, group: list[str], scores: list[str], identified: str, original: str, mass: str, measured: str, ties: tuple[str, ...] = (), close: float = 0.00005) -> DataFrame:
    """Adds ``delta_p`` to the best match of a spectrum by each score if it is modified: the mean over
    scores of its lead, as a share of the spectrum's top score, over the next form of the same peptide
    (same original, length, mass and mass error) by that score. If the match leads by several scores, the
    last of them counts. 1 for other modified matches, null for the rest; scores of top 0 add 0."""
    out = df
    tops = {s: F.max(s).over(Window.partitionBy(*group)) for s in scores}
    out = out.select("*", *(t.alias(f"_top_{i}") for i, t in enumerate(tops.values())))
    for i, s in enumerate(scores):
        out = out.withColumn(f"_rank_{i}", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(s), identified, *ties)))
    changed = F.length(original) != F.length(identified)
    lead, found = out.where(changed), None
    cols = [identified, mass, measured, *scores]
    for i in range(len(scores)):
        best = lead.where(F.col(f"_rank_{i}") == 1).select(*group, original, *(F.col(c).alias(f"_b_{c}") for c in cols))
        near = out.join(best, [*group, original]).where((F.col(identified) != F.col(f"_b_{identified}")) & (F.length(identified) == F.length(f"_b_{identified}")))
        near = near.where((F.abs(F.col(mass) - F.col(f"_b_{mass}")) < close) & (F.abs(F.abs(F.col(measured) - F.col(mass)) - F.abs(F.col(f"_b_{measured}") - F.col(f"_b_{mass}"))) < close))
        parts = F.lit(0.0)
        for k, s in enumerate(scores):
            parts = parts + F.when(F.col(f"_top_{k}") != 0, (F.col(f"_b_{s}") - F.col(s)) / F.col(f"_top_{k}")).otherwise(0.0)
        mean = parts / len(scores)
        one = near.groupBy(*group, F.col(f"_b_{identified}").alias(identified)).agg(F.min_by(mean, f"_rank_{i}").alias("_d")).withColumn("_k", F.lit(i))
        found = one if found is None else found.unionByName(one)
    last = found.groupBy(*group, identified).agg(F.max_by("_d", "_k").alias("_d"))
    joined = out.join(last, [*group, identified], "left")
    value = F.when(changed, F.coalesce("_d", F.lit(1.0)))
    return joined.select(*df.columns, value.alias("delta_p"))


def relative_leads(df: DataFrame, group: list[str], scores: list[str], ties: list[str]) -> DataFrame:
    """For each score, of the best match its score over the next one's less 1 (1 if that is 0, 0 if there is
    none), of the others their score over the best one's less 1: lead_<score>."""
    for s in scores:
        w = Window.partitionBy(*group).orderBy(F.desc(s), *ties)
        top, after = F.first(s).over(w), F.lead(s).over(w)
        lead = F.when(after.isNull(), 0.0).when(after == 0, 1.0).otherwise(F.col(s) / after - 1)
        df = df.withColumn(f"lead_{s}", F.when(F.row_number().over(w) == 1, lead).otherwise(F.try_divide(F.col(s), top) - 1))
    return df


def merged_runs(frames: list[DataFrame]) -> DataFrame:
    """Search results of one run, one after the other for each spectrum: a union, with the number of the
    search; spectra meet by their key, so files need no common order."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("search", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out
