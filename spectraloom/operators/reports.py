"""Peptide and protein reports: roll-ups, counts, features of matches, descriptions, error rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.functions.peptides import any_target
from spectraloom.operators import ranking
from spectraloom.operators.proteins import normalised
from spectraloom.store import saved


def roll_up(df: DataFrame, keys: list[str], score: str, run: str, scan: str, target: Column, proteins: str | None = None, lists: tuple[str, ...] = ()) -> DataFrame:
    """A row for each peptide (keys): spectral_count, best_score, psms as sorted run[scan], whether any is a
    target, distinct sorted values of each of ``lists``, and protein_count with proteins if they are given."""
    psm = F.concat(F.col(run).cast("string"), F.lit("["), F.col(scan).cast("string"), F.lit("]"))
    out = [F.count(F.lit(1)).alias("spectral_count"), F.max(score).alias("best_score"), F.transform(F.array_sort(F.collect_list(F.struct(F.col(run).alias("r"), F.col(scan).alias("s"), psm.alias("p")))), lambda x: x["p"]).alias("psms"), F.bool_or(target).alias("any_target")]
    out += [F.array_sort(F.collect_set(c)).alias(c) for c in lists]
    if proteins:
        out.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list(proteins)))).alias(proteins))
    got = df.groupBy(*keys).agg(*out)
    return got.withColumn("protein_count", F.size(proteins)) if proteins else got


def label_counts(df: DataFrame, kind: str, kinds: tuple[str, ...] = ("target", "train", "test", "reserve")) -> DataFrame:
    """One row: how many of each kind, and test_ratio = test / target (null without targets)."""
    counts = [F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds]
    return df.agg(*counts).withColumn("test_ratio", F.try_divide(F.col("n_test"), F.col("n_target")))


def error_rate(decoys: Column, targets: Column, ratio: float = 1.0) -> Column:
    """Decoys / targets / the ratio of the databases; null without targets."""
    return F.try_divide(decoys, targets) / ratio


def consensus(df: DataFrame, run: str, scan: str, peptide: str, scorers: int = 3) -> DataFrame:
    """Adds consensus, how many scorers chose the peptide for the spectrum, and local_rank: 0 if all did,
    else how many did not, but ``scorers`` for a lone one where two others agree."""
    same = F.count(F.lit(1)).over(Window.partitionBy(run, scan, peptide))
    out = df.withColumn("consensus", same)
    agreed = F.max(F.when(F.col("consensus") == scorers - 1, 1).otherwise(0)).over(Window.partitionBy(run, scan))
    rank = F.greatest(F.lit(scorers) - F.col("consensus"), F.lit(0))
    return out.withColumn("local_rank", F.when((rank == scorers - 1) & (agreed == 1), scorers).otherwise(rank).cast("int"))


def match_features(psms: DataFrame, edges: DataFrame, identified: str, original: str, protein: str) -> DataFrame:
    """Adds to every match: same_form and same_peptide (matches of its form, of its original peptide);
    protein_peptides, unique_peptides and shared_peptides (the most peptides of any of its proteins, all,
    unique and shared ones); is_unique (its peptide has one protein); protein_spectra (the most matches,
    unique and shared, of any of its proteins but itself). edges: distinct (original, protein) pairs;
    a match whose peptide has no protein gets zeros."""
    forms = psms.groupBy(original, identified).agg(F.count(F.lit(1)).alias("_f"))
    spectra = psms.groupBy(original).agg(F.count(F.lit(1)).alias("_s"))
    pairs = edges.select(original, protein).distinct()
    many = pairs.groupBy(original).agg(F.count(F.lit(1)).alias("_n"))
    with_n = pairs.join(many, original).join(spectra, original, "left").withColumn("_s", F.coalesce("_s", F.lit(0)))
    one = F.col("_n") == 1
    of = with_n.groupBy(protein).agg(F.count(F.lit(1)).alias("_pp"), F.count_if(one).alias("_up"), F.count_if(~one).alias("_sp"), F.sum("_s").alias("_spectra"))
    best = with_n.join(of, protein).groupBy(original).agg(
        F.max("_pp").alias("protein_peptides"),
        F.max(F.when(one, F.col("_up")).otherwise(0)).alias("unique_peptides"),
        F.max(F.when(~one, F.col("_sp")).otherwise(0)).alias("shared_peptides"),
        F.bool_or(one).alias("is_unique"),
        F.max("_spectra").alias("_most"),
    )
    out = psms.join(forms, [original, identified]).join(spectra, original).join(best, original, "left")
    added = {"same_form": F.col("_f"), "same_peptide": F.col("_s"), "protein_spectra": F.greatest(F.coalesce("_most", F.lit(1)) - 1, F.lit(0)), "is_unique": F.coalesce("is_unique", F.lit(False))}
    added |= {c: F.coalesce(c, F.lit(0)) for c in ("protein_peptides", "unique_peptides", "shared_peptides")}
    return out.withColumns(added).drop("_f", "_s", "_most")


def run_counts(peptides: DataFrame, edges: DataFrame, accepted: DataFrame, peptide: str, protein: str, run: str, spectra: str) -> DataFrame:
    """A row for each accepted protein and run: unique and total peptides and spectra, balanced (spectra
    over the number of accepted proteins that have the peptide) and normalised counts. peptides: a row
    for each peptide form and run with its number of spectra. Uniqueness counts all proteins."""
    pairs = edges.select(peptide, protein).distinct()
    all_n = pairs.groupBy(peptide).agg(F.count(F.lit(1)).alias("_all"))
    kept = pairs.join(accepted.select(protein).distinct(), protein, "left_semi")
    share = kept.groupBy(peptide).agg(F.count(F.lit(1)).alias("_share"))
    rows = peptides.select(peptide, run, spectra).join(kept, peptide).join(all_n, peptide).join(share, peptide)
    one = F.col("_all") == 1
    got = rows.groupBy(protein, run).agg(
        F.count_if(one).alias("unique_peptides"), F.count(F.lit(1)).alias("total_peptides"),
        F.coalesce(F.sum(F.when(one, F.col(spectra))), F.lit(0)).alias("unique_spectra"), F.sum(spectra).alias("total_spectra"),
        F.sum(F.col(spectra) / F.col("_share")).alias("balanced"),
    )
    return normalised(got, run, "balanced")


def protein_table(counts: DataFrame, protein: str, run: str, runs: list, descriptions: DataFrame | None = None, prefix: str = "Decoy_") -> DataFrame:
    """One row for each protein (or {a,b} group) with six counts for each run, 0 where there are none, its
    description (N/A where there is none) and whether it is a target (T, F)."""
    names = ["unique_peptides", "total_peptides", "unique_spectra", "total_spectra", "balanced", "normalised"]
    wide = counts.groupBy(protein).pivot(run, runs).agg(*(F.first(n).alias(n) for n in names))
    wide = wide.na.fill(0)
    if descriptions is not None:
        wide = described(wide, descriptions, protein)
    target = any_target(F.split(F.regexp_replace(F.col(protein).cast("string"), "[{}]", ""), ","), prefix)
    return wide.withColumn("target_match", F.when(target, "T").otherwise("F"))


def described(df: DataFrame, descriptions: DataFrame, protein: str) -> DataFrame:
    """Adds description: those of the members of an {a,b} group as {x,y}, N/A for unknown ones."""
    one = F.split(F.regexp_replace(F.col(protein).cast("string"), "[{}]", ""), ",")
    each = df.select(protein).distinct().select(protein, F.posexplode(one).alias("_i", "_p"))
    known = descriptions.select(F.col("protein_id").cast("string").alias("_p"), F.col("description").alias("_d")).groupBy("_p").agg(F.min("_d").alias("_d"))
    found = each.join(known, "_p", "left").groupBy(protein).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("_d", F.lit("N/A")).alias("d")))), lambda x: x["d"]).alias("_l"))
    text = F.when(F.size("_l") > 1, F.concat(F.lit("{"), F.array_join("_l", ","), F.lit("}"))).otherwise(F.col("_l")[0])
    return df.join(found.select(protein, text.alias("description")), protein, "left")


def nested_report(table: DataFrame, rows: DataFrame, protein: str, order: list[str]) -> DataFrame:
    """table with its rows (peptides or matches) as an ordered array of structs named ``rows``."""
    rest = [c for c in rows.columns if c != protein]
    packed = rows.groupBy(protein).agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in rest if c not in order)))).alias("rows"))
    return table.join(packed, protein, "left")


def back_filled(psms: DataFrame, peptide: str, proteins: str) -> DataFrame:
    """Every match gets all proteins that any match of its peptide names, sorted."""
    known = psms.select(peptide, F.explode(proteins).alias("_p")).distinct().groupBy(peptide).agg(F.array_sort(F.collect_list("_p")).alias("_all"))
    return psms.join(known, peptide, "left").withColumn(proteins, F.coalesce("_all", F.array().cast("array<string>"))).drop("_all")


def containing(peptides: DataFrame, proteins: DataFrame, peptide: str, seq: str, k: int = 5) -> DataFrame:
    """Pairs of a peptide and a protein that contains it: an equi-join on the first k letters (all of a
    shorter peptide) with the distinct strings of that length of each sequence, and an exact test. Only the
    lengths that peptides have (k numbers at most) are cut out of sequences, no pair is tried that does not
    share such a string, and equal sequences are one until proteins get their pairs. No side is broadcast
    but after a count: what strings a sequence has is far more than its file tells. Empty peptides are in no protein."""
    sized = peptides.where(F.length(peptide) > 0).withColumn("_k", F.least(F.length(peptide), F.lit(k))).withColumn("_w", F.expr(f"substring(`{peptide}`, 1, _k)"))
    sized = saved(sized)
    lengths = sorted(r[0] for r in sized.select("_k").distinct().collect())
    starts = lambda n: F.transform(F.sequence(F.lit(1), F.length(seq) - n + 1), lambda i: F.substring(F.col(seq), i, F.lit(n)))
    none = F.array().cast("array<string>")
    each = F.concat(none, *(F.when(F.length(seq) >= n, F.array_distinct(starts(n))).otherwise(none) for n in lengths))
    grams = proteins.select(seq).where(F.col(seq).isNotNull()).distinct().withColumn("_w", F.explode(each))
    few = lambda df: F.broadcast(df) if df.count() <= ranking.BROADCAST else df.hint("merge")
    pairs = saved(few(sized).join(grams, "_w").where(F.contains(F.col(seq), F.col(peptide))).select(*peptides.columns, F.col(seq).alias("_s")))
    return few(pairs).join(proteins, F.col("_s") == F.col(seq)).select(*peptides.columns, *proteins.columns)


def with_features(filtered: DataFrame, features: DataFrame, left: str = "PSMId", right: str = "SpecId") -> DataFrame:
    """Re-scored matches with the features of their row of the table that was re-scored."""
    return filtered.join(features, filtered[left] == features[right], "left").drop(features[right])


def picked(df: DataFrame, protein: str, score: str, prefix: str = "Decoy_", ties: tuple[str, ...] = ()) -> DataFrame:
    """Of each protein and its decoy the better one (the target among equals), with q_value by decoys over
    targets: protein, score, is_decoy, q_value."""
    decoy = F.col(protein).startswith(prefix)
    base = F.when(decoy, F.substring(protein, len(prefix) + 1, 1 << 30)).otherwise(F.col(protein))
    best = df.groupBy(base.alias("_base"), decoy.alias("is_decoy")).agg(F.max(score).alias(score))
    chosen = best.groupBy("_base").agg(F.max(F.struct(score, (~F.col("is_decoy")).alias("t"))).alias("_m"))
    out = chosen.select(F.when(F.col("_m.t"), F.col("_base")).otherwise(F.concat(F.lit(prefix), F.col("_base"))).alias(protein), F.col("_m")[score].alias(score), (~F.col("_m.t")).alias("is_decoy"))
    return ranking.q_values(out, score, "is_decoy")


def error_probabilities(df: DataFrame, score: str, decoy: str, name: str = "posterior_error_prob") -> DataFrame:
    """Adds the probability that a match of this score is wrong: by isotonic regression, the share of
    decoys at the score, doubled odds against targets: p / (1 - p), at most 1. The regression pools scores
    in parallel and keeps a row for each step."""
    from pyspark.ml.regression import IsotonicRegression

    rows = df.select(F.col(score).cast("double").alias("_x"), F.col(decoy).cast("double").alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    pooled = rows.groupBy("_x").agg(F.avg("_y").alias("_y"), F.count(F.lit(1)).cast("double").alias("_w"))
    if pooled.isEmpty():
        return df.withColumn(name, F.lit(None).cast("double"))
    model = IsotonicRegression(featuresCol="_x", labelCol="_y", weightCol="_w", isotonic=False, predictionCol="_p").fit(pooled)
    out = model.transform(df.withColumn("_x", F.col(score).cast("double")).where("_x IS NOT NULL")).drop("_x")
    value = F.when(F.col("_p") >= 0.5, 1.0).otherwise(F.col("_p") / (1 - F.col("_p")))
    return out.withColumn(name, value).drop("_p").unionByName(df.where(F.col(score).isNull()).withColumn(name, F.lit(None).cast("double")))


def accepted(df: DataFrame, q_value: str = "q-value", most: float = 0.01, probability: str | None = None, below: float = 0.5) -> DataFrame:
    """Rows with a q-value up to ``most`` and, if asked, an error probability under ``below``."""
    out = df.where(F.col(f"`{q_value}`") <= most)
    return out.where(F.col(f"`{probability}`") < below) if probability else out


def labelled_only(df: DataFrame, label: str = "Label", abundance: str = "MS2IsotopicAbundances", least: float = 2.0, q_value: str = "q-value", most: float = 0.01) -> DataFrame:
    """Accepted targets whose enrichment reaches ``least`` per cent."""
    return accepted(df, q_value, most).where((F.col(label) == 1) & (F.col(abundance) >= least))


def without_kinds(df: DataFrame, kind: str, *kinds: str) -> DataFrame:
    """Rows of none of the kinds, such as train and reserve; a null kind stays."""
    return df.where(~F.coalesce(F.col(kind).isin(*kinds), F.lit(False)))


def within_error(df: DataFrame, measured: str, calculated: str, tolerance: float, ppm: bool = False, error: str | None = None) -> DataFrame:
    """Rows whose mass error is at most the tolerance: in millionths of the calculated mass, or in Da, by
    the column ``error`` if that holds the folded difference."""
    plain = F.abs(F.col(error)) if error else F.abs(F.col(measured) - F.col(calculated))
    off = F.abs(F.col(measured) - F.col(calculated)) / F.col(calculated) * 1e6 if ppm else plain
    return df.where(off <= tolerance)


def cluster_summary(df: DataFrame, keys: list[str], value: str, spectrum: list[str], least: int = 1) -> DataFrame:
    """n, mean, deviation (population) and distinct spectra of each cluster of at least so many rows."""
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.count_distinct(*spectrum).alias("spectra"))
    return out.where(F.col("n") >= least)


def same_spectra(df: DataFrame, cluster: str, spectrum: str) -> DataFrame:
    """Clusters with the same set of spectra as one row: clusters (sorted) and how many spectra."""
    sets = df.groupBy(cluster).agg(F.array_sort(F.collect_set(spectrum)).alias("_s"))
    return sets.groupBy("_s").agg(F.array_sort(F.collect_list(cluster)).alias("clusters")).select("clusters", F.size("_s").alias("spectra"))


def neighbours_cut(df: DataFrame, group: list[str], value: str, order: list[str], share: float = 0.98, most: int = 300) -> DataFrame:
    """Rows of a group, largest first, until they reach a share of its sum, and at most so many."""
    w = Window.partitionBy(*group)
    down = w.orderBy(F.desc(value), *order)
    before = F.sum(value).over(down.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    rows = df.withColumns({"_b": before, "_t": F.sum(value).over(w), "_n": F.row_number().over(down)})
    return rows.where((F.col("_b") < share * F.col("_t")) & (F.col("_n") <= most)).drop("_b", "_t", "_n")


def parent_bounds(scans: DataFrame, mass: str, charge: str, keys: list[str] | None = None) -> DataFrame:
    """The largest mass and charge, of each of ``keys`` or over all."""
    return scans.groupBy(*(keys or [])).agg(F.max(mass).alias("most_mass"), F.max(charge).alias("most_charge"))


def intensity_sums(scans: DataFrame, peaks: str = "peaks") -> DataFrame:
    """Adds total_intensity and top_intensity of each scan's peaks (0 without peaks)."""
    each = F.transform(peaks, lambda p: p["intensity"])
    return scans.withColumns({"total_intensity": F.aggregate(each, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))), "top_intensity": F.coalesce(F.array_max(each), F.lit(0.0))})


def task_list(*frames: DataFrame) -> DataFrame:
    """All combinations of some short lists (configurations, files, target and decoy): the product of
    their counts must stay under a million."""
    n = 1
    for f in frames:
        n *= f.count()
    if n > 1_000_000:
        raise ValueError(f"{n} combinations are no list of tasks")
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(F.broadcast(f))
    return out
