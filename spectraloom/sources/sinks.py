"""Text sinks of search, feature and protein tables, and of configurations and spectra.

Each builds a DataFrame of lines with the order that they have in the file; ``write_lines`` writes them
in that order, over as many part files as there are ranges, so no file passes through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.functions.peptides import listed, log10_or_zero
from spectraloom.sources.spectra import pepxml

#: The columns of a feature table.
PIN = (
    "SpecId Label ScanNr ExpMass retentiontime ranks parentCharges massErrors isotopicMassWindowShifts "
    "mzShiftFromisolationWindowCenters peptideLengths missCleavageSiteNumbers PTMnumbers isotopicPeakNumbers "
    "MS1IsotopicAbundances MS2IsotopicAbundances isotopicAbundanceDiffs WDPscores XcorrScores MVHscores diffScores "
    "log10_precursorIntensities Peptide Proteins"
).split()
#: The columns of the older table of matches.
TAB = (
    "FileName ScanNumber ParentCharge MeasuredParentMass ScanType SearchName IdentifiedPeptide OriginalPeptide "
    "CalculatedParentMass MVH Xcorr WDP ProteinNames Diff_MVH Diff_Xcorr Diff_WDP RetentionTime DeltaP"
).split()
#: The header lines of a table of search results.
SPECTRUM_HEAD = "+\tFilename\tScanNumber\tParentCharge\tIsolationWindowCenterMZ\tScanType\tSearchName\tRetentionTime\tPrecursorScanNumber"
MATCH_HEAD = "*\tIdentifiedPeptide\tOriginalPeptide\tCalculatedParentMass\tWDP\tXcorr\tMVH\tProteinNames\tmeasuredCharge\tMeasuredMass"


def write_lines(lines: DataFrame, path: str, order: list[str], head: list[str] | None = None, foot: list[str] | None = None) -> None:
    """``line`` in order, after the lines of the head and before those of the foot."""
    spark = lines.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("line")
    for name, extra in (("head", head), ("foot", foot)):
        if extra:
            more = spark.createDataFrame([(x,) for x in extra], "line string").coalesce(1)
            dealt = more.union(dealt) if name == "head" else dealt.union(more)
    dealt.write.mode("overwrite").text(path)


def fixed(column, places: int):
    return F.format_string(f"%.{places}f", F.col(column).cast("double"))


def spe2pep_lines(matches: DataFrame, ranks: tuple[str, ...] = (), keep: int = 10) -> DataFrame:
    """file, scan, line of search results: a + line for each spectrum, then its matches by descending first
    score, those with any of the ranks up to ``keep``. Columns as the reader gives them."""
    if ranks:
        least = F.least(*ranks) if len(ranks) > 1 else F.col(ranks[0])
        matches = matches.where(least <= keep)
    head = ["filename", "scan", "charge", "window_mz", "scan_type", "search_name", "rt", "parent_scan"]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    plus = F.concat_ws("\t", F.lit("+"), *(F.coalesce(fixed(c, 5), F.lit("")) if c == "window_mz" else text(c) for c in head))
    star = F.concat_ws("\t", F.lit("*"), "identified", "original", fixed("calculated_mass", 4), *(fixed(c, 4) for c in ("wdp", "xcorr", "mvh")), listed(F.col("proteins")), text("measured_charge"), fixed("measured_mass", 4))
    rows = matches.withColumn("_l", F.struct((-F.col("wdp")).alias("s"), F.col("identified").alias("p"), star.alias("l")))
    spectra = rows.groupBy("filename", "scan", "charge", plus.alias("_h")).agg(F.array_sort(F.collect_list("_l")).alias("_m"))
    line = F.concat_ws("\n", F.col("_h"), F.transform("_m", lambda m: m["l"]))
    return spectra.select("filename", "scan", "charge", line.alias("line"))


def write_spe2pep(matches: DataFrame, path: str, config: str = "", **settings) -> None:
    """Search results with the configuration as # lines."""
    head = [f"#\t{x}" for x in config.splitlines()] + [SPECTRUM_HEAD, MATCH_HEAD]
    write_lines(spe2pep_lines(matches, **settings), path, ["filename", "scan", "charge"], head)


def pin_table(psms: DataFrame, inference: bool = True) -> DataFrame:
    """The feature table (PIN columns): from filename, scan, rank, is_decoy, calculated_mass, rt, charge,
    mass_error_ppm, window_shift, mz_shift, peptide_length, missed, ptms, isotopic_peaks (array),
    ms1_abundance, ms2_abundance, wdp, xcorr, mvh, delta_score, precursor_intensity, peptide and proteins
    (array). ExpMass holds the calculated mass; abundances, and how far they are apart with its sign, are
    as they were measured. Proteins are tab-separated, as protein inference reads them, or {a,b}."""
    c = F.col
    one, two = c("ms1_abundance"), c("ms2_abundance")
    values = [
        F.concat_ws(".", "filename", c("scan").cast("string"), c("rank").cast("string")), F.when(c("is_decoy"), -1).otherwise(1), c("scan"), c("calculated_mass"), c("rt"), c("rank"), c("charge"),
        c("mass_error_ppm"), c("window_shift"), c("mz_shift"), c("peptide_length"), c("missed"), c("ptms"), F.size("isotopic_peaks"), one, two, one - two,
        c("wdp"), c("xcorr"), c("mvh"), c("delta_score"), log10_or_zero(c("precursor_intensity")), c("peptide"), F.array_join("proteins", "\t") if inference else listed(c("proteins")),
    ]
    return psms.select(*(v.alias(n) for v, n in zip(values, PIN)))


def write_pin_table(psms: DataFrame, path: str, inference: bool = True) -> None:
    """One row a line; for ``inference`` proteins are further tab-separated fields."""
    table = pin_table(psms, inference)
    lines = table.select("ScanNr", "SpecId", F.concat_ws("\t", *(F.coalesce(F.col(n).cast("string"), F.lit("")) for n in PIN)).alias("line"))
    write_lines(lines, path, ["ScanNr", "SpecId"], ["\t".join(PIN)])


def write_tab(df: DataFrame, path: str) -> None:
    """The older table of matches, its proteins (array) as {a,b}."""
    kinds = dict(df.dtypes)
    row = [listed(F.col(c)) if kinds[c].startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in TAB]
    write_lines(df.select("FileName", "ScanNumber", F.concat_ws("\t", *row).alias("line")), path, ["FileName", "ScanNumber", "line"], ["\t".join(TAB)])


def write_report(df: DataFrame, path: str, order: list[str], notes: dict[str, object] | None = None, places: int = 3) -> None:
    """A table under # lines of statistics: doubles with ``places``, booleans as T or F, arrays as {a,b}."""
    def cell(name, kind):
        if kind.startswith("array"):
            return listed(F.col(name))
        if kind in ("double", "float"):
            return F.coalesce(fixed(name, places), F.lit("NA"))
        if kind == "boolean":
            return F.when(F.col(name), "T").otherwise("F")
        return F.coalesce(F.col(name).cast("string"), F.lit("NA"))

    head = [f"#\t{k} = {v}" for k, v in (notes or {}).items()] + ["\t".join(df.columns)]
    line = F.concat_ws("\t", *(cell(n, k) for n, k in df.dtypes))
    write_lines(df.withColumn("line", line).select(*order, "line"), path, order, head)


def write_nested(df: DataFrame, path: str, protein: str) -> None:
    """A + line for each protein with its columns, then a * line for each of the structs in ``rows``."""
    own = [c for c in df.columns if c != "rows"]
    fields = [f.name for f in df.schema["rows"].dataType.elementType.fields]
    text = lambda c: F.coalesce(c.cast("string"), F.lit("NA"))
    plus = F.concat_ws("\t", F.lit("+"), *(text(F.col(c)) for c in own))
    stars = F.transform(F.coalesce("rows", F.expr("slice(rows, 1, 0)")), lambda r: F.concat_ws("\t", F.lit("*"), *(text(r[f]) for f in fields)))
    head = ["\t".join(["+", *own]), "\t".join(["*", *fields])]
    write_lines(df.select(protein, F.concat_ws("\n", plus, stars).alias("line")), path, [protein], head)


def write_pepxml(df: DataFrame, path: str, scores: list[str], database: str = "", modifications: dict[str, float] | None = None) -> None:
    """A whole document: its head with the search settings, the elements of ``pepxml`` by file and scan."""
    from xml.sax.saxutils import quoteattr

    found = "".join(f'<aminoacid_modification aminoacid={quoteattr(k[:1])} massdiff="{v}" variable="Y" symbol={quoteattr(k[1:])}/>' for k, v in (modifications or {}).items())
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<msms_pipeline_analysis xmlns="http://regis-web.systemsbiology.net/pepXML">', '<msms_run_summary>', f'<search_summary search_engine="spectraloom"><search_database local_path={quoteattr(database)} type="AA"/>{found}</search_summary>']
    lines = pepxml(df, scores).select("file", "scan", F.col("xml").alias("line"))
    write_lines(lines, path, ["file", "scan", "line"], head, ["</msms_run_summary>", "</msms_pipeline_analysis>"])


def write_scans(df: DataFrame, path: str, level: int = 2) -> None:
    """MS1 or MS2 text: S, I, Z lines and peaks. Columns scan, parent_mz (level 2), charge, rt, peaks."""
    c = F.col
    peaks = F.array_join(F.transform("peaks", lambda p: F.concat_ws(" ", F.format_string("%.5f", p["mz"]), F.format_string("%.4f", p["intensity"]))), "\n")
    number = F.format_string("%06d", c("scan"))
    first = F.concat_ws("\t", F.lit("S"), number, number, *([fixed("parent_mz", 5)] if level == 2 else []))
    time = F.when(c("rt").isNotNull(), F.concat(F.lit("I\tRTime\t"), c("rt").cast("string")))
    mass = F.format_string("%.5f", c("parent_mz") * c("charge") - (c("charge") - 1) * 1.00727646688) if level == 2 else F.lit(None).cast("string")
    z = F.when(c("charge") > 0, F.concat_ws("\t", F.lit("Z"), c("charge").cast("string"), mass)) if level == 2 else F.lit(None).cast("string")
    write_lines(df.select("scan", F.concat_ws("\n", first, time, z, peaks).alias("line")), path, ["scan"], [f"H\tExtractor\tspectraloom\tMS{level}"])


def write_split_fasta(df: DataFrame, path: str, parts: int, name: str = "protein_id", seq: str = "sequence") -> None:
    """Proteins dealt to ``parts`` folders by a hash of their name."""
    text = F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq))
    part = F.pmod(F.xxhash64(name), F.lit(parts)).alias("part")
    df.select(text.alias("value"), part).write.mode("overwrite").partitionBy("part").text(path)


def config_text(template: str, values: dict[str, str]) -> str:
    """A configuration with the values of some keys ([Section]Key) replaced; lines keep their place and
    their comments. A key that is not there is an error."""
    out, section, left = [], "", dict(values)
    for line in template.splitlines():
        body, mark, note = line.partition("#")
        name = body.split("=", 1)[0].strip()
        if body.strip().startswith("[") and body.strip().endswith("]"):
            section = body.strip()
        elif "=" in body and section + name in values:
            left.pop(section + name, None)
            line = f"{name} = {values[section + name]}" + (f"\t{mark}{note}" if mark else "")
        out.append(line)
    if left:
        raise KeyError(", ".join(left))
    return "\n".join(out) + "\n"


def grid(low: float, high: float, step: float) -> list[float]:
    """low, low + step ... and high itself."""
    out, k = [], 0
    while low + k * step < high - 1e-9:
        out.append(round(low + k * step, 9))
        k += 1
    return [*out, high]


def half_width(share: float) -> int:
    """How many neutrons to either side the mass windows of an enrichment reach."""
    from math import floor

    return max(2, floor(5 * (1 - 2 * (share - 0.5) ** 2) + 0.5))


def grid_table(spark: SparkSession, element: str = "C13", low: float = 0.0, high: float = 100.0, step: float = 1.0) -> DataFrame:
    """percentage, search_name, half_width and mass windows of each search of a labelled experiment."""
    rows = [(p, f"{element}_{p:07.3f}Pct", half_width(p / 100), list(range(-half_width(p / 100), half_width(p / 100) + 1))) for p in grid(low, high, step)]
    return spark.createDataFrame(rows, "percentage double, search_name string, half_width int, windows array<int>")


def old_search_name(element: str, share: float) -> str:
    """The name of a labelled search in older reports, with a share of 1 as 100 per cent."""
    return f"{element}_{share * 100:g}Pct"


def labelled_configs(template: str, element: str, low: float, high: float, step: float, set_key: str, name_key: str = "[Peptide_Identification]Search_Name", windows_key: str = "[Peptide_Identification]Parent_Mass_Windows") -> dict[str, str]:
    """A configuration for each percentage: its text by its search name. ``set_key`` holds the element's
    isotope percentages, of which the last is set and the first takes the remainder."""
    from spectraloom.sources.readers import config

    old = [float(x) for x in config(template)[set_key].split(",")]
    out = {}
    for p in grid(low, high, step):
        first = 1 - p / 100 - sum(old[1:-1])
        if first < -1e-12:
            raise ValueError(f"no share is left for the lightest isotope at {p} per cent")
        name, half = f"{element}_{p:07.3f}Pct", half_width(p / 100)
        shares = [max(first, 0.0), *old[1:-1], p / 100]
        out[name] = config_text(template, {set_key: ",".join(f"{x:.6g}" for x in shares), name_key: name, windows_key: ",".join(map(str, range(-half, half + 1)))})
    return out
