"""Spectra in MGF, what a spectrum of mzML, mzXML and binary scans says, and pepXML elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.sources import numpress, runs


def mgf(spark: SparkSession, path: str) -> DataFrame:
    """A row for each BEGIN IONS block. CHARGE such as 2+ (0 where there is none, the first of several); scan
    from SCANS and rt from RTINSECONDS, the first of a range; what is no number is null."""
    raw = spark.read.option("lineSep", "END IONS").text(path)
    lines = raw.where(F.contains("value", F.lit("BEGIN IONS"))).select(F.input_file_name().alias("file"), F.split(F.regexp_replace("value", r"(?s)^.*BEGIN IONS\s*", ""), r"\r?\n").alias("l"))
    entry = lambda k: F.get(F.transform(F.filter("l", lambda x: x.startswith(k + "=")), lambda x: F.substring(x, F.lit(len(k) + 2), F.length(x))), F.lit(0))
    peaks = F.transform(F.filter("l", lambda x: x.rlike(r"^\s*\d+\.?\d*([eE][-+]?\d+)?\s+\d")), lambda x: F.split(F.trim(x), r"\s+"))
    return lines.select(
        "file",
        F.regexp_extract(entry("SCANS"), r"^\s*(\d+)", 1).try_cast("long").alias("scan"),
        F.lit(2).alias("ms_level"),
        F.coalesce(F.regexp_extract(entry("CHARGE"), r"(\d+)", 1).try_cast("int"), F.lit(0)).alias("charge"),
        F.split(F.trim(entry("PEPMASS")), r"\s+")[0].try_cast("double").alias("parent_mz"),
        F.regexp_extract(entry("RTINSECONDS"), r"^\s*([0-9]+\.?[0-9]*)", 1).try_cast("double").alias("rt"),
        F.transform(peaks, lambda p: F.struct(p[0].try_cast("double").alias("mz"), p[1].try_cast("double").alias("intensity"))).alias("peaks"),
        entry("TITLE").alias("title"),
    )


def _decode(text: str | None, bits: int, packed: bool, order: str):
    import base64
    import zlib

    import numpy as np

    raw = base64.b64decode(text or "")
    return np.frombuffer(zlib.decompress(raw) if packed and raw else raw, f"{order}f{bits // 8}").astype(float)


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def mzml_spectrum(node, groups: dict[str, list] | None = None):
    """(scan, level, charge, precursor m/z, seconds, m/z, intensities) of a spectrum element, whose
    references are looked up in the groups of parameters."""

    def parameters(of):
        found = [x for x in of.iter() if _name(x.tag) == "cvParam"]
        return found + [p for x in of.iter() if _name(x.tag) == "referenceableParamGroupRef" for p in (groups or {}).get(x.get("ref"), ())]

    terms = {x.get("name"): x for x in parameters(node)}
    value = lambda k, kind, other: kind(float(terms[k].get("value"))) if k in terms else other
    rt = value("scan start time", float, None)
    if rt is not None and terms["scan start time"].get("unitName") == "minute":
        rt *= 60
    arrays = {}
    for a in (x for x in node.iter() if _name(x.tag) == "binaryDataArray"):
        kinds = {x.get("name") for x in parameters(a)}
        data = next((x.text for x in a.iter() if _name(x.tag) == "binary"), "")
        way = next((w for k in kinds if k and "numpress" in k.lower() for w in numpress.WAYS if w in k.lower()), None)
        if way:
            packed = any(k and "zlib" in k.lower() for k in kinds)
            found = numpress.decode(data, way, packed)
        else:
            found = _decode(data, 64 if "64-bit float" in kinds else 32, "zlib compression" in kinds, "<")
        arrays["mz" if "m/z array" in kinds else "intensity" if "intensity array" in kinds else "other"] = found
    scan = dict(x.split("=", 1) for x in node.get("id", "").split() if "=" in x).get("scan") or int(node.get("index", 0)) + 1
    return int(scan), value("ms level", int, 1), value("charge state", int, 0), value("selected ion m/z", float, None), rt, arrays.get("mz", ()), arrays.get("intensity", ())


def mzxml_spectrum(node):
    """As ``mzml_spectrum`` of a scan element, without the scans inside it."""
    peaks = next((x for x in node if _name(x.tag) == "peaks"), None)
    parent = next((x for x in node if _name(x.tag) == "precursorMz"), None)
    pairs = _decode((peaks.text or "").strip(), int(peaks.get("precision", 32)), peaks.get("compressionType") == "zlib", ">") if peaks is not None else ()
    rt = node.get("retentionTime", "").removeprefix("PT").removesuffix("S")
    mz = float(parent.text) if parent is not None and parent.text else None
    charge = int(parent.get("precursorCharge", 0)) if parent is not None else 0
    return int(node.get("num")), int(node.get("msLevel", 1)), charge, mz, float(rt) if rt else None, pairs[::2], pairs[1::2]


def parse_binary(stream, packed: bool, level: int = 2):
    """As ``mzml_spectrum``, for each scan of the binary form of MS1 / MS2 text, of versions up to 5: a file
    header of 2056 bytes (type, version, 16 lines of 128), then for each scan its numbers, times and counts,
    its charges, and its peaks, plain or as two packed arrays. The level is that of the file's ending."""
    import struct
    import zlib

    import numpy as np

    take = lambda form: struct.unpack("<" + form, stream.read(struct.calcsize("<" + form)))
    _, version = take("ii")
    stream.read(16 * 128)
    while len(first := stream.read(4)) == 4:
        scan = struct.unpack("<i", first)[0]
        take("i")
        mzs = take(f"{take('i')[0]}d") if version >= 5 else take("d")
        (rt,) = take("f")
        if version >= 2:
            take("f3d" + ("4d" if version >= 4 else "") + "df")
        (states,) = take("i")
        (exact,) = take("i") if version >= 3 else (0,)
        (points,) = take("i")
        charges = [take("id")[0] for _ in range(states)]
        for _ in range(exact):
            take("idff")
        if packed:
            a, b = take("ii")
            mz, height = np.frombuffer(zlib.decompress(stream.read(a)), "<f8"), np.frombuffer(zlib.decompress(stream.read(b)), "<f4")
        else:
            both = np.frombuffer(stream.read(12 * points), np.dtype([("mz", "<f8"), ("height", "<f4")]))
            mz, height = both["mz"], both["height"]
        yield scan, level, charges[0] if charges else 0, mzs[0] if level == 2 and mzs else None, rt * 60, mz, height.astype(float)


def binary_scans(spark: SparkSession, path: str, level: int | None = None, scans: list[int] | None = None) -> DataFrame:
    """Binary scans (bms1, bms2), packed ones by their ending (cms1, cms2): see ``runs``."""
    return runs.read(spark, path, level, scans)


def mzml(spark: SparkSession, path: str, level: int | None = 2, scans: list[int] | None = None) -> DataFrame:
    """A file, or a folder of them, in ranges of bytes: see ``runs``. ``scans`` chooses by number."""
    return runs.read(spark, path, level, scans)


def mzxml(spark: SparkSession, path: str, level: int | None = 2, scans: list[int] | None = None) -> DataFrame:
    """As ``mzml``. A scan inside another one is read like any other."""
    return runs.read(spark, path, level, scans)


READERS = {"mgf": mgf, "mzml": mzml, "mzxml": mzxml, **dict.fromkeys(("bms1", "bms2", "cms1", "cms2"), binary_scans)}
#: Text formats of scans, and how their S lines are laid out.
TEXTS = {"ft1": "ft", "ft2": "ft", "ms1": "ms", "ms2": "ms", "zs": "ms", "uzs": "ms"}


def read(spark: SparkSession, path: str) -> DataFrame:
    """By the ending of the name, one deeper for .gz (text formats are split only if they are not packed)."""
    from spectraloom.sources import readers

    ending = path.lower().removesuffix(".gz").rsplit(".", 1)[-1]
    if ending in TEXTS:
        return readers.scans(spark, path, TEXTS[ending])
    if ending not in READERS:
        raise ValueError(f"no reader for .{ending}")
    return READERS[ending](spark, path)


def write_mgf(df: DataFrame, path: str) -> None:
    """scan, charge, parent_mz, peaks as MGF blocks."""
    peaks = F.array_join(F.transform("peaks", lambda p: F.concat_ws(" ", p.mz.cast("string"), p.intensity.cast("string"))), "\n")
    head = F.format_string("BEGIN IONS\nSCANS=%d\nCHARGE=%d+\nPEPMASS=%s\n", "scan", "charge", F.col("parent_mz").cast("string"))
    df.select(F.concat(head, peaks, F.lit("\nEND IONS\n"))).write.mode("overwrite").text(path)


def pepxml(df: DataFrame, scores: list[str]) -> DataFrame:
    """A spectrum_query element for each match: file, scan, charge, parent_mass, peptide, mass, proteins, rank."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    each = F.concat(*(F.concat(F.lit(f'<search_score name="{s}" value="'), F.coalesce(F.col(s).cast("string"), F.lit("")), F.lit('"/>')) for s in scores))
    others = F.array_join(F.transform(F.slice("proteins", 2, F.greatest(F.size("proteins"), F.lit(0))), lambda p: F.concat(F.lit('<alternative_protein protein="'), safe(p), F.lit('"/>'))), "")
    text = F.concat(
        F.lit('<spectrum_query spectrum="'), safe(F.concat_ws(".", "file", "scan", "scan", "charge")), F.lit('" start_scan="'), F.col("scan").cast("string"), F.lit('" end_scan="'), F.col("scan").cast("string"),
        F.lit('" precursor_neutral_mass="'), F.col("parent_mass").cast("string"), F.lit('" assumed_charge="'), F.col("charge").cast("string"), F.lit('"><search_result><search_hit hit_rank="'), F.col("rank").cast("string"),
        F.lit('" peptide="'), safe(F.col("peptide")), F.lit('" calc_neutral_pep_mass="'), F.col("mass").cast("string"), F.lit('" massdiff="'), (F.col("parent_mass") - F.col("mass")).cast("string"),
        F.lit('" num_tot_proteins="'), F.size("proteins").cast("string"), F.lit('" protein="'), safe(F.coalesce(F.get("proteins", F.lit(0)), F.lit(""))), F.lit('">'), others, each, F.lit("</search_hit></search_result></spectrum_query>"),
    )
    return df.select("file", "scan", text.alias("xml"))
