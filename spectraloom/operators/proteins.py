"""Proteins from peptides: merging, counts, and a minimal explaining set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.store import saved


#: Edges that one task goes through in order, and rows of a name or a number or two that are broadcast.
IN_ORDER, BROADCAST = 200_000, 1_000_000


def merge_indistinguishable(edges: DataFrame, protein: str, peptide: str) -> DataFrame:
    """One row for each distinct set of peptides, with all proteins that have it."""
    sets = edges.groupBy(protein).agg(F.array_sort(F.collect_set(peptide)).alias("peptides"))
    return sets.groupBy("peptides").agg(F.array_sort(F.collect_list(protein)).alias("proteins"))


def peptide_counts(edges: DataFrame, protein: str, peptide: str) -> DataFrame:
    """Unique (one protein), shared, total and balanced (1 / number of proteins) peptides of each protein."""
    edges = edges.select(protein, peptide).distinct()
    share = edges.groupBy(peptide).agg(F.count("*").alias("_n"))
    joined = edges.join(share, peptide)
    return joined.groupBy(protein).agg(F.sum((F.col("_n") == 1).cast("long")).alias("unique_count"), F.count("*").alias("total_count"), F.sum(1 / F.col("_n")).alias("balanced"))


def normalised(counts: DataFrame, run: str, value: str) -> DataFrame:
    """value * mean of the runs' sums / the run's sum, to two places."""
    sums = counts.groupBy(run).agg(F.sum(value).alias("_s"))
    mean = sums.agg(F.avg("_s").alias("_m"))
    scaled = counts.join(F.broadcast(sums.crossJoin(mean)), run)  # a row for each run
    return scaled.withColumn("normalised", F.round(F.col(value) * F.col("_m") / F.col("_s"), 2)).drop("_s", "_m")


def concat_ordered(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Values of each key joined by commas, in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *(v for v in values if v not in order))))
    out = df.groupBy(key).agg(rows.alias("_r"))
    return out.select(key, *(F.array_join(F.col("_r")[v].cast("array<string>"), ",").alias(v) for v in values))


def parsimony(edges: DataFrame, protein: str, peptide: str, least: int = 1, unique: int = 0) -> DataFrame:
    """Accepted groups of indistinguishable proteins: first those with enough peptides of their own, each
    of which takes away the groups that have no peptide but its own; then, of what remains, one after
    the other by number of peptides (the largest first) and name, each of which takes away all that share
    a peptide with it.

    The second part goes in rounds: every group that comes before all others of each of its peptides
    is accepted at once, which is what the order gives, and those taken away leave the table. Rounds
    follow the longest chain of groups that wait for each other, not the number of groups; nothing is
    gathered by component, so one giant component is as good as many small ones. When no more than
    ``IN_ORDER`` edges are left, one task goes through them in order.

    A group is one row, numbered by its place in the order, so rounds move numbers and peptides, not names."""
    group = F.concat(F.lit("{"), F.array_join("proteins", ","), F.lit("}"))
    merged = merge_indistinguishable(edges.withColumn(protein, F.col(protein).cast("string")), protein, peptide)
    named = merged.select(F.when(F.size("proteins") > 1, group).otherwise(F.col("proteins")[0]).alias("g"), F.col("peptides").alias("qs"), F.size("peptides").alias("size")).where("size > 0")
    order = F.desc("size"), F.asc("g")
    groups = saved(named.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("id"), "g", "qs", "size"))
    pairs = lambda df: df.select("id", "size", F.explode("qs").alias("q"))
    left = groups.where(F.col("size") >= least).drop("g")
    alone = pairs(groups).groupBy("q").agg(F.count(F.lit(1)).alias("owners"), F.min("id").alias("id")).where("owners = 1")
    own = saved(alone.groupBy("id").agg(F.count(F.lit(1)).alias("own")).where(F.col("own") >= max(unique, 1)))
    first = saved(left.join(few(own), "id").drop("own"))
    accepted = first.select("id")
    if unique > 0:
        left = left.limit(0)  # those with enough peptides of their own are accepted, and others have too few
    elif not first.isEmpty():
        left = left.join(few(accepted), "id", "left_anti")
        chosen = saved(pairs(first).select(F.col("id").alias("g"), "q"))
        owners = saved(chosen.groupBy("q").agg(F.count(F.lit(1)).alias("owners")))
        covered = saved(pairs(left).join(few(owners), "q"))
        whole = covered.groupBy("id", "size").agg(F.count(F.lit(1)).alias("n")).where("n = size").select("id")
        gone = saved(subsets(covered.join(whole, "id", "left_semi").withColumnRenamed("id", "g"), chosen))
        left = left.join(few(gone.withColumnRenamed("g", "id")), "id", "left_anti")
    left = saved(left)
    while (left.agg(F.sum("size")).first()[0] or 0) > IN_ORDER:
        wins = saved(pairs(left).groupBy("q").agg(F.min("id").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("wins")))
        won = saved(left.join(few(wins), "id").where("wins = size").drop("wins"))
        taken = few(saved(pairs(won).select("q")))
        left = saved(left.join(pairs(left).join(taken, "q", "left_semi").select("id").distinct(), "id", "left_anti"))
        accepted = accepted.union(won.select("id"))
    rest = left.select("id", "qs").repartition(1).sortWithinPartitions("id").mapInArrow(in_order, "id long")
    return groups.join(few(saved(accepted.union(rest))), "id", "left_semi").select(F.col("g").alias("protein_group"))


def few(df: DataFrame) -> DataFrame:
    """A saved frame to be broadcast, if its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def in_order(batches):
    """Groups one after the other, each unless an accepted one has one of its peptides."""
    import pyarrow as pa

    taken: set = set()
    for batch in batches:
        won = []
        for number, qs in zip(batch.column("id").to_pylist(), batch.column("qs").to_pylist()):
            if taken.isdisjoint(qs):
                won.append(number)
                taken.update(qs)
        yield pa.RecordBatch.from_arrays([pa.array(won, pa.int64())], ["id"])


def subsets(others: DataFrame, chosen: DataFrame) -> DataFrame:
    """The groups of others (g, q, owners, size) whose peptides some group of chosen (g, q) has all. Each is
    held only against the chosen owners of its rarest peptide."""
    rarest = others.groupBy("g").agg(F.min_by("q", F.struct("owners", "q")).alias("q"))
    tried = rarest.join(chosen.select(F.col("g").alias("p"), "q"), "q").select("g", "p")
    met = others.join(tried, "g").join(chosen.select(F.col("g").alias("p"), "q"), ["p", "q"])
    return met.groupBy("g", "p", "size").agg(F.count(F.lit(1)).alias("met")).where("met = size").select("g").distinct()


def probabilities(edges: DataFrame, protein: str, peptide: str, probability: str, tolerance: float = 1e-4, rounds: int = 100) -> DataFrame:
    """Pairs of protein and peptide with what the peptide counts for the protein and how likely the
    protein is there: ``weight`` (of a peptide, summing to 1 over its proteins), ``protein_probability``
    and ``razor``, whether the peptide is assigned to the protein.

    A protein is there unless all of its peptides are wrong or come from others: 1 less the product of
    1 - weight * probability; a peptide's weights are in proportion to the probabilities of its proteins.
    Weights begin equal, and both are computed in turn until no probability moves by ``tolerance`` or
    more. A peptide's razor protein is the likeliest, of equals (to 6 places) the one of most peptides, then
    the first by name. Pairs that repeat count with their best probability, null ones not at all."""
    known = edges.where(F.col(probability).isNotNull() & F.col(protein).isNotNull() & F.col(peptide).isNotNull())
    pairs = known.groupBy(F.col(protein).alias("a"), F.col(peptide).alias("b")).agg(F.max(probability).cast("double").alias("p"))
    degree = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    now = saved(pairs.join(degree, "b").select("a", "b", "p", (1 / F.col("n")).alias("w"), F.lit(-1.0).alias("old")))
    for _ in range(rounds):
        whole = now.groupBy("a").agg((1 - F.product(1 - F.col("w") * F.col("p"))).alias("whole"))
        whole = saved(whole)
        with_p = now.join(F.broadcast(whole) if whole.count() <= BROADCAST else whole, "a")
        sums = with_p.groupBy("b").agg(F.sum("whole").alias("total"), F.count(F.lit(1)).alias("n"))
        weight = F.when(F.col("total") > 0, F.col("whole") / F.col("total")).otherwise(1 / F.col("n"))
        now = saved(with_p.join(sums, "b").select("a", "b", "p", weight.alias("w"), F.col("whole").alias("new"), F.abs(F.col("whole") - F.col("old")).alias("moved")))
        moved = now.agg(F.max("moved")).first()[0]
        now = now.withColumnRenamed("new", "old")
        if moved is None or moved < tolerance:
            break
    counts = now.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
    ranked = now.join(counts, "a")
    best = ranked.groupBy("b").agg(F.min_by("a", F.struct(-F.round("old", 6), -F.col("k"), "a")).alias("best"))
    out = ranked.join(best, "b")
    return out.select(F.col("a").alias(protein), F.col("b").alias(peptide), F.col("p").alias(probability), F.col("w").alias("weight"), F.col("old").alias("protein_probability"), (F.col("a") == F.col("best")).alias("razor"))


def protein_probabilities(pairs: DataFrame, protein: str) -> DataFrame:
    """A row for each protein of ``probabilities``: its probability, peptides and razor peptides."""
    return pairs.groupBy(protein).agg(F.first("protein_probability").alias("protein_probability"), F.count(F.lit(1)).alias("peptides"), F.count_if("razor").alias("razor_peptides"))
