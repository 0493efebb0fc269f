"""Whole jobs by a configuration: from proteins and scans to search results, and from search results
and survey scans to the feature table that is re-scored. Each is one plan over DataFrames; files are
read and written only by the functions that take paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.functions import elements, peptides, scoring, variants
from spectraloom.functions.chemistry import Chemistry, numbers
from spectraloom.operators import features, joins
from spectraloom.sources import readers, sinks


@dataclass(frozen=True)
class Settings:
    """What a configuration says about a search."""

    chemistry: Chemistry
    name: str
    labelled: bool
    mutated: bool
    windows: list[tuple[float, float]]
    fragment_tolerance: float
    parent_tolerance: float
    least: int
    most: int
    missed: int
    after: str
    before: str
    drop_first_m: bool
    symbols: dict[str, str]
    most_symbols: int
    losses: dict[str, str]

    @classmethod
    def from_config(cls, text: str) -> Settings:
        """Search_Type is Regular, Mutation or SIP; modifications are searched in Regular only."""
        config = readers.config(text)

        def value(key: str, default: str) -> str:
            return config.get(f"[Peptide_Identification]{key}", default)

        kind = value("Search_Type", "Regular")
        if kind not in ("Regular", "Mutation", "SIP"):
            raise ValueError(f"no search of type {kind}")
        chemistry, parent = Chemistry.from_config(config), float(value("Search_Mass_Tolerance_Parent_Ion", "0.01"))
        windows = [int(w) for w in numbers(value("Parent_Mass_Windows", "0"))]
        return cls(
            chemistry, value("Search_Name", "SE"), kind == "SIP", kind == "Mutation", joins.mass_windows(windows, parent, chemistry.spacing),
            float(value("Mass_Tolerance_Fragment_Ions", "0.01")), parent, int(value("Minimum_Peptide_Length", "7")), int(value("Maximum_Peptide_Length", "60")),
            int(value("Maximum_Missed_Cleavages", "2")), value("Cleave_After_Residues", "KR"), value("Cleave_Before_Residues", "ACDEFGHIJKLMNPQRSTVWY"),
            value("Try_First_Methionine", "true") in ("TRUE", "True", "true", "T"), chemistry.symbols(config) if kind == "Regular" else {}, int(value("Max_PTM_Count", "0")) if kind == "Regular" else 0, elements.losses(config),
        )


def candidates(proteins: DataFrame, settings: Settings) -> DataFrame:
    """The peptides of a digest in all of their forms: peptide ([..] with symbols), original ([..]),
    prefix and suffix (of the first protein by name), text (what is scored), mass, proteins (sorted). A
    search for mutations adds all peptides of single substitutions that are in no protein as they are.
    Residues that the configuration does not name are left out of a sequence."""
    clean = proteins.select("protein_id", peptides.clean(F.col("sequence"), settings.chemistry.letters).alias("sequence"))
    cut = peptides.digest(clean, "sequence", settings.missed, settings.least, settings.most, flanked=True, after=settings.after, before=settings.before, drop_first_m=settings.drop_first_m)
    first = F.min(F.struct("protein_id", "first_piece", "prefix", "suffix"))
    names = F.array_sort(F.collect_set("protein_id")).alias("proteins")
    boxed = lambda x: F.concat(F.lit("["), x, F.lit("]"))
    merged = cut.groupBy("peptide").agg(first.alias("_f"), names)
    merged = merged.select(boxed("peptide").alias("original"), "_f.prefix", "_f.suffix", "proteins")
    forms = variants.modified(F.col("original"), settings.symbols, settings.most_symbols) if settings.symbols and settings.most_symbols else F.array("original")
    rows = merged.withColumn("peptide", F.explode(forms)).select("peptide", "original", "prefix", "suffix", "proteins")
    if settings.mutated:
        alphabet = "".join(r for r in settings.chemistry.letters if r != "J")
        changed = variants.mutants(clean, "sequence", alphabet, settings.after, settings.before, settings.missed, settings.least, settings.most, settings.drop_first_m)
        best = F.min(F.struct("protein_id", "position", "original", "prefix", "suffix")).alias("_f")
        changed = changed.groupBy("peptide").agg(best, names).join(cut.select("peptide").distinct(), "peptide", "left_anti")
        rows = rows.union(changed.select(boxed("peptide"), boxed("_f.original"), "_f.prefix", "_f.suffix", "proteins"))
    bare = F.translate("peptide", "[]", "")
    return rows.withColumns({"text": variants.neutral_loss(bare, settings.losses), "mass": elements.peptide_mass(bare, settings.chemistry)})


def beside(peptide: Column) -> Column:
    """A peptide with the residues beside it; the ends of a protein are not written."""
    shown = lambda x: F.when(F.col(x) == "-", "").otherwise(F.col(x))
    return F.concat(shown("prefix"), peptide, shown("suffix"))


def search(scans: DataFrame, proteins: DataFrame, settings: Settings) -> DataFrame:
    """Search results with the columns of ``readers.spe2pep_rows`` and the ranks by each score. scans: as
    ``readers.scans`` gives them (file, scan, parent_mz, charge, precursors, info, peaks)."""
    c = F.col
    found = candidates(proteins, settings)
    asked = variants.precursors(scans).select("file", "scan", "z", c("precursor_mz").alias("parent_mz"), "peaks")
    scored = scoring.search(asked, found.select("peptide", "mass", "text"), settings.windows, settings.fragment_tolerance, settings.parent_tolerance, chemistry=settings.chemistry, labelled=settings.labelled, run="file")
    said = lambda *keys: F.coalesce(*(F.try_element_at("info", F.lit(k)) for k in keys))
    about = scans.select(
        "file", "scan", c("charge").alias("charge"), c("parent_mz").alias("window_mz"), said("ScanType").alias("scan_type"),
        said("RetentionTime", "RTime").alias("rt"), said("ParentScanNumber").try_cast("int").alias("parent_scan"),
    )
    rows = scored.join(found, "peptide").join(about, ["file", "scan"])
    return rows.select(
        F.regexp_replace("file", r"^.*/", "").alias("filename"), "scan", "charge", "window_mz", "scan_type", F.lit(settings.name).alias("search_name"), "rt", "parent_scan",
        beside(c("peptide")).alias("identified"), beside(c("original")).alias("original"), c("mass").alias("calculated_mass"), "wdp", "xcorr", "mvh", "proteins",
        c("z").alias("measured_charge"), c("parent_mass").alias("measured_mass"), "rank_mvh", "rank_xcorr", "rank_wdp",
    )


def write_search(spark: SparkSession, fasta: str, scans: str, config: str, out: str) -> None:
    """The search that a configuration (its text) describes, from FASTA and scan files to search results."""
    settings = Settings.from_config(config)
    got = search(readers.scans(spark, scans), readers.fasta(spark, fasta), settings)
    sinks.write_spe2pep(got, out, config, ranks=("rank_mvh", "rank_xcorr", "rank_wdp"))


def feature_rows(targets: DataFrame, decoys: DataFrame | None, surveys: DataFrame, settings: Settings, n: int = 8) -> DataFrame:
    """The n best matches of each spectrum, targets and decoys, with their features."""
    return features.features(features.top_matches(targets, decoys, n), surveys, settings.chemistry, settings.after)


def write_features(spark: SparkSession, targets: str, decoys: str | None, surveys: str, config: str, out: str, n: int = 8, inference: bool = False) -> None:
    """The feature table of all searches of some runs, from search results and survey scan files."""
    read = lambda path: readers.spe2pep(spark, path).drop("rank")
    rows = feature_rows(read(targets), read(decoys) if decoys else None, readers.scans(spark, surveys), Settings.from_config(config), n)
    sinks.write_pin_table(rows, out, inference)
