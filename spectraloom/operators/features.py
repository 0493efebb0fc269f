"""The features of matches that a re-scoring sees: from search results and survey scans to one row
for each match, with the columns that ``sinks.pin_table`` takes.

Ranks and the lead of the best match are windows over a spectrum; envelopes come from the survey
scans by a join on (file, scan), through which a scan's peaks travel once for all matches that look
into it. All other features are column functions of the match itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions import peptides
from spectraloom.functions.chemistry import REGULAR, Chemistry
from spectraloom.functions.peptides import PROTON
from spectraloom.operators import envelopes, merging
from spectraloom.operators.ranking import delta_to_top


def run_name(file: Column) -> Column:
    """A file's name without its folder and its last ending: what scans and results of a run share."""
    return F.regexp_replace(F.regexp_replace(file, r"^.*[/\\]", ""), r"\.[^.]*$", "")


def missed_inside(bracketed: Column, after: str = "KR") -> Column:
    """Cleavage residues between [ and ], but for those at either end."""
    return peptides.missed_sites(peptides.naked(bracketed), after)


def column_features(matches: DataFrame, chemistry: Chemistry = REGULAR, after: str = "KR") -> DataFrame:
    """Adds what a match tells by itself: naked, peptide_length (of the original peptide, so symbols do
    not count), missed, ptms, mass_error_ppm, window_shift, mz_shift and ms2_abundance."""
    c, spacing = F.col, chemistry.spacing
    naked = peptides.naked(c("identified"))
    return matches.withColumns(
        {
            "naked": naked,
            "peptide_length": F.length(peptides.naked(c("original"))),
            "missed": missed_inside(c("original"), after),
            "ptms": peptides.ptm_count(naked),
            "mass_error_ppm": peptides.ppm_error(c("measured_mass"), c("calculated_mass"), spacing),
            "window_shift": peptides.window_shift(c("measured_mass"), c("calculated_mass"), spacing),
            "mz_shift": F.abs(c("window_mz") - c("measured_mass") / c("measured_charge") - PROTON),
            "ms2_abundance": peptides.abundance(c("search_name")),
        }
    )


def top_matches(targets: DataFrame, decoys: DataFrame | None, n: int = 8) -> DataFrame:
    """The n best matches of each spectrum over all searches by the first score (wdp), one for each
    identified peptide, with the decoys that no target of their run resembles, ranked together."""
    group, ties = ["filename", "scan"], ("calculated_mass", "search_name", "measured_charge")
    best = merging.top_across(targets, group, "identified", "wdp", n, ties).withColumn("naked", peptides.naked(F.col("identified")))
    if decoys is None:
        return best.withColumn("is_decoy", F.lit(False))
    others = merging.top_across(decoys, group, "identified", "wdp", n, ties).withColumn("naked", peptides.naked(F.col("identified")))
    return merging.with_decoys(best, others.select(*best.columns), "filename", group, "naked", "wdp", ("identified",))


def features(matches: DataFrame, surveys: DataFrame, chemistry: Chemistry = REGULAR, after: str = "KR") -> DataFrame:
    """matches: columns of ``readers.spe2pep_rows`` with is_decoy and rank from 1 in each (filename, scan);
    surveys: file, scan, peaks. Files are matched by their names without folder and ending.

    A match without parent scan, or whose parent scan is not there, has no isotopic peaks and intensity
    and abundance 0; one without charge or mass has null in what depends on them."""
    c = F.col
    rows = column_features(matches, chemistry, after).withColumn("delta_score", delta_to_top(matches, ["filename", "scan"], "wdp"))
    rows = rows.withColumn("spec_id", F.concat_ws(".", "filename", c("scan").cast("string"), c("rank").cast("string")))
    own = [x for x in rows.columns if x not in ("charge", "rt")]
    rows = rows.select(*own, c("rt").try_cast("double").alias("rt"), run_name(c("filename")).alias("file"), c("measured_charge").alias("charge"), c("measured_mass").alias("observed_mass"))
    named = surveys.select(run_name(c("file")).alias("file"), "scan", "peaks")
    return envelopes.precursor_envelopes(rows, named, "spec_id", chemistry).withColumn("peptide", c("identified")).drop("file", "observed_mass")
