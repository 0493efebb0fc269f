"""Text sources as DataFrames, each read by Spark's own splitting of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.functions.peptides import PROTON


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """protein_id (header up to white space), description, sequence; empty sequences are skipped."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace("value", "^>", "")
    head = F.regexp_extract(body, r"^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace(body, r"^[^\n]*(\n|$)", ""), r"\s", "")
    out = raw.select(F.regexp_extract(head, r"^(\S*)", 1).alias("protein_id"), head.alias("description"), seq.alias("sequence"))
    return out.where("sequence <> ''")


def scans(spark: SparkSession, path: str, layout: str = "ft", first: int | None = None, last: int | None = None, numbers: list[int] | None = None) -> DataFrame:
    """FT1 / FT2 text, or MS1 / MS2 text with layout="ms": a row for each S record with its peaks; scans
    without peaks are dropped. See ``scan_rows``. first, last and numbers choose scans."""
    raw = spark.read.option("lineSep", "\nS\t").text(path).select("value", F.input_file_name().alias("file"))
    out = scan_rows(raw, layout)
    if first is not None:
        out = out.where(F.col("scan") >= first)
    if last is not None:
        out = out.where(F.col("scan") <= last)
    return out if numbers is None else out.where(F.col("scan").isin(*numbers))


def scan_rows(raw: DataFrame, layout: str = "ft") -> DataFrame:
    """From (value: the text from one S to the next, file). In FT text the S line has number and m/z, and one Z
    line the charge, the mass and then (charge, m/z) pairs, which are the precursors; in MS text the S line
    has first and last number and, at level 2, the m/z, and each of several Z lines a charge and a mass
    with one proton: the first gives the charge, all are precursors. I and D lines are a map; of equal keys
    the first holds."""
    lines = raw.select("file", F.regexp_replace("value", r"(?s)^(.*\n)?S\t", "").alias("v")).where(r"v RLIKE '^\\d'").withColumn("l", F.split("v", r"\r?\n"))
    head = F.split(F.trim(F.col("l")[0]), r"\s+")
    tagged = lambda c: F.filter("l", lambda x: x.startswith(c))
    words = lambda x: F.split(F.trim(x), r"\s+")
    peaks = F.transform(F.filter(F.slice("l", 2, F.size("l")), lambda x: x.rlike(r"^[0-9][0-9.]*([eE][-+]?[0-9]+)?[ \t]")), words)
    at = lambda p, i, kind: F.get(p, F.lit(i)).try_cast(kind)
    z = words(F.get(tagged("Z\t"), F.lit(0)))
    if layout == "ms":
        each = F.transform(tagged("Z\t"), words)
        charge_of = lambda w: at(w, 1, "int")
        listed = F.transform(each, lambda w: F.struct(charge_of(w).alias("z"), ((at(w, 2, "double") + (charge_of(w) - 1) * PROTON) / charge_of(w)).alias("mz")))
        parent = F.when(F.size(head) >= 3, F.element_at(head, -1).try_cast("double"))
    else:
        pairs = F.slice(z, 4, F.size(z))
        listed = F.when(F.size(pairs) > 1, F.transform(F.sequence(F.lit(0), F.floor(F.size(pairs) / 2).cast("int") - 1), lambda i: F.struct(pairs[i * 2].try_cast("int").alias("z"), pairs[i * 2 + 1].try_cast("double").alias("mz"))))
        parent = at(head, 1, "double")
    notes = F.transform(F.filter("l", lambda x: x.rlike(r"^[ID]\t")), lambda x: F.split(x, r"\t"))
    keys = F.array_distinct(F.transform(notes, lambda n: n[1]))
    info = F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("k"), F.get(F.get(F.filter(notes, lambda n: n[1] == k), F.lit(0)), F.lit(2)).alias("v"))))
    out = lines.select(
        "file",
        head[0].try_cast("int").alias("scan"),
        parent.alias("parent_mz"),
        F.coalesce(at(z, 1, "int"), F.lit(0)).alias("charge"),
        listed.alias("precursors"),
        info.alias("info"),
        F.transform(peaks, lambda p: F.struct(at(p, 0, "double").alias("mz"), at(p, 1, "double").alias("intensity"), F.coalesce(at(p, 5, "int"), F.lit(0)).alias("z"))).alias("peaks"),
    )
    return out.where(F.size("peaks") > 0)


def mz_bounds(scans: DataFrame) -> DataFrame:
    """The least and largest m/z of each file: file, lo, hi."""
    return scans.groupBy("file").agg(F.min(F.array_min("peaks.mz")).alias("lo"), F.max(F.array_max("peaks.mz")).alias("hi"))


def sorted_peaks(peaks: Column, by: str = "mz") -> Column:
    """Peaks by m/z, or from the highest down."""
    if by == "mz":
        return F.array_sort(peaks)
    return F.array_sort(peaks, lambda a, b: F.when(a["intensity"] > b["intensity"], -1).when(a["intensity"] < b["intensity"], 1).when(a["mz"] < b["mz"], -1).when(a["mz"] > b["mz"], 1).otherwise(0))


def charge_estimate(peaks: Column, parent_mz: Column, share: float = 0.05) -> Column:
    """1 where no more than a share of the intensity lies above the parent, else 0 (2 or 3)."""
    sums = lambda some: F.aggregate(F.transform(some, lambda p: p["intensity"]), F.lit(0.0), lambda s, x: s + x)
    return F.when(sums(F.filter(peaks, lambda p: p["mz"] > parent_mz)) <= share * sums(peaks), 1).otherwise(0)


def spe2pep(spark: SparkSession, path: str) -> DataFrame:
    """Search results with their spectrum: see ``spe2pep_rows``."""
    return spe2pep_rows(spark.read.option("lineSep", "\n+\t").text(path))


def spe2pep_rows(raw: DataFrame) -> DataFrame:
    """From (value: the text from one + line to the next): a row for each * line, with its place in the
    spectrum as rank and what its + line says."""
    lines = raw.select(F.split(F.regexp_replace("value", r"^(#[^\n]*\n)*(\+\t)?", ""), r"\r?\n").alias("l"))
    s = F.split(F.col("l")[0], "\t")
    rows = lines.select(s.alias("s"), F.posexplode(F.filter("l", lambda x: x.startswith("*\t"))).alias("n", "m")).withColumn("m", F.split("m", "\t"))
    rows = rows.where(F.get("s", F.lit(1)).try_cast("int").isNotNull())
    text, number = (lambda c, i: F.get(F.col(c), F.lit(i))), (lambda c, i: F.get(F.col(c), F.lit(i)).try_cast("double"))
    return rows.select(
        text("s", 0).alias("filename"), number("s", 1).cast("int").alias("scan"), number("s", 2).cast("int").alias("charge"), number("s", 3).alias("window_mz"), text("s", 4).alias("scan_type"), text("s", 5).alias("search_name"), text("s", 6).alias("rt"), number("s", 7).cast("int").alias("parent_scan"),
        text("m", 1).alias("identified"), text("m", 2).alias("original"), number("m", 3).alias("calculated_mass"), number("m", 4).alias("wdp"), number("m", 5).alias("xcorr"), number("m", 6).alias("mvh"), F.split(F.regexp_replace(text("m", 7), "[{}]", ""), ",").alias("proteins"),
        number("m", 8).cast("int").alias("measured_charge"), number("m", 9).alias("measured_mass"), (F.col("n") + 1).alias("rank"),
    )


def tab(spark: SparkSession, path: str) -> DataFrame:
    """The older table of matches, with numbers as such, null for NA, and proteins as an array."""
    from spectraloom.sources.sinks import TAB

    numbers = dict.fromkeys("MeasuredParentMass CalculatedParentMass MVH Xcorr WDP Diff_MVH Diff_Xcorr Diff_WDP DeltaP".split(), "double") | dict.fromkeys(("ScanNumber", "ParentCharge"), "int")
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("nullValue", "NA").schema(", ".join(f"`{c}` string" for c in TAB)).csv(path)
    out = raw.select(*(F.col(c).try_cast(numbers[c]).alias(c) if c in numbers else F.col(c) for c in TAB))
    return out.withColumn("ProteinNames", F.split(F.regexp_replace("ProteinNames", "[{}]", ""), ","))


#: Endings of the files of a folder, by kind.
KINDS = {"scans": (".ft2", ".mzml"), "configs": (".cfg",), "results": (".spe2pep.txt",)}


def discover(spark: SparkSession, folder: str, kind: str) -> list[str]:
    """The paths of a folder's files of a kind, sorted; upper and lower case do not matter."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(str(f.getPath().toString()) for f in found if f.getPath().getName().lower().endswith(KINDS[kind]))


def config(text: str) -> dict[str, str]:
    """[Section] and Key = value lines as {'[Section]Key': value}; # starts a comment, the first of equal keys holds."""
    out: dict[str, str] = {}
    section = ""
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if line.startswith("[") and line.endswith("]"):
            section = line
        elif "=" in line:
            key, value = (x.strip() for x in line.split("=", 1))
            out.setdefault(section + key, value)
    return out


def write_fasta(df: DataFrame, path: str, name: str = "protein_id", seq: str = "sequence") -> None:
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq))).write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Arrays become {a,b}."""
    flat = [F.concat(F.lit("{"), F.array_join(c, ","), F.lit("}")).alias(c) if k.startswith("array") else F.col(c) for c, k in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
