"""The tables that end a workflow: accepted matches with their features, those that a labelled experiment
scores again, and proteins with the matches of each sample beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.functions import peptides
from spectraloom.operators import reports

#: Columns of a re-scored table that are kept.
SCORED = ("PSMId", "score", "q-value", "posterior_error_prob")
#: What a protein shows of its matches: column of the match -> ending of the protein's column.
SHOWN = {"PeptideSequence": "PeptideSequences", "MS1IsotopicAbundances": "MS1IsotopicAbundances", "MS2IsotopicAbundances": "MS2IsotopicAbundances", "log10_precursorIntensities": "log10_precursorIntensities"}


def filtered_psms(targets: DataFrame, decoys: DataFrame, features: DataFrame, most: float = 0.01) -> DataFrame:
    """Targets and decoys with a q-value up to ``most``, with the features of their row."""
    both = targets.select(*(f"`{c}`" for c in SCORED)).unionByName(decoys.select(*(f"`{c}`" for c in SCORED)))
    return reports.with_features(reports.accepted(both, "q-value", most), features)


def probable_psms(targets: DataFrame, decoys: DataFrame, features: DataFrame, below: float = 0.5) -> DataFrame:
    """As ``filtered_psms`` of matches that are wrong with a probability under ``below``: what pepXML gets."""
    both = targets.select(*(f"`{c}`" for c in SCORED)).unionByName(decoys.select(*(f"`{c}`" for c in SCORED)))
    return reports.with_features(both.where(F.col("posterior_error_prob") < below), features)


def labelled_table(filtered: DataFrame, controls: list[str], least: float = 2.0, most: float = 0.01) -> DataFrame:
    """The feature table of labelled matches over all samples, to be scored again: accepted targets whose
    enrichment reaches ``least``; those of control samples count as decoys. The sample is what stands before
    the first point of PSMId."""
    kept = reports.labelled_only(filtered, least=least, most=most).withColumnRenamed("PSMId", "SpecId")
    label = F.when(peptides.sample_name(F.col("SpecId")).isin(*controls), -1).otherwise(F.col("Label"))
    return kept.withColumn("Label", label).drop("score", "q-value", "posterior_error_prob")


def labelled_psms(targets: DataFrame, decoys: DataFrame, table: DataFrame, most: float = 0.01) -> DataFrame:
    """Accepted labelled matches with their features and SampleName; abundances are kept within 0 and 100."""
    out = filtered_psms(targets, decoys, table, most).withColumn("SampleName", peptides.sample_name(F.col("PSMId")))
    return out.withColumn("MS1IsotopicAbundances", peptides.clamp(F.col("MS1IsotopicAbundances")))


def with_matches(proteins: DataFrame, psms: DataFrame, samples: list[str], prefix: str = "", sample: str = "SampleName") -> DataFrame:
    """proteins (Protein, ...) with four columns for each sample: the peptides, abundances and intensities of
    the protein's target matches there, joined by commas in the order of scan and id; null without any.
    Proteins of a match are {a,b}."""
    target = psms.where((F.col("Label") == 1) & F.col(sample).isin(*samples))
    sequence = F.regexp_extract("Peptide", r"\[([^\]]+)\]", 1)
    rows = target.withColumn("PeptideSequence", sequence).select(F.explode(peptides.names(F.col("Proteins"))).alias("Protein"), sample, "ScanNr", "PSMId", *SHOWN)
    listed = F.array_sort(F.collect_list(F.struct("ScanNr", "PSMId", *(F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in SHOWN))))
    packed = rows.groupBy("Protein", sample).agg(listed.alias("_m"))
    joined = lambda c: F.array_join(F.col("_m")[c], ",")
    wide = packed.groupBy("Protein").pivot(sample, samples).agg(*(F.first(joined(c)).alias(name) for c, name in SHOWN.items()))
    names = [f"{s}_{name}" for s in samples for name in SHOWN.values()]
    return proteins.join(wide.select("Protein", *(F.col(f"`{n}`").alias(f"{prefix}{n}") for n in names)), "Protein", "left")
