"""Precursors in the survey scans: their peak, the isotope peaks beside it, the envelope, and how much
of an element is enriched.

Scans that follow one another make a block. Matches travel once, with all that they have, to the block of
their scan, and so do the peaks of a scan, the last few of a block also to the next one. There they follow
one another in order, so a match looks into its own scan and the ``STEPS - 1`` before it, which a task holds;
the first of these that has the peak counts.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from math import floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.window import Window

from spectraloom.functions.chemistry import ELEMENTS, NEUTRONS, REGULAR, Chemistry
from spectraloom.functions.peptides import NEUTRON, PROTON
from spectraloom.store import saved

STEPS, SIDE, TOLERANCE = 3, 20, 0.01
#: Peptides whose lightest masses a task remembers.
REMEMBER = 100_000


def ladder(mz, intensity, apex: int, z: int, side: int = SIDE, tol: float = TOLERANCE, spacing: float = NEUTRON) -> list[int]:
    """Indices, by m/z, of a peak and of those a whole number of neutrons from it, up to the first gap
    on either side: the highest within the tolerance (of the mass, not of m/z)."""
    out = [apex]
    for way in (-1, 1):
        for k in range(1, side + 1):
            want = mz[apex] + way * k * spacing / z
            lo, hi = bisect_right(mz, want - tol / z), bisect_left(mz, want + tol / z)
            if hi <= lo:
                break
            out.append(lo if hi == lo + 1 else max(range(lo, hi), key=intensity.__getitem__))
    return sorted(out)


def envelope(mz, intensity, at: float) -> tuple[int, int]:
    """Start and end of the hill whose top lies nearest to an m/z: from the top down both slopes, to
    where the intensity rises again. Of equally near tops the first."""
    n = len(mz)
    tops = [i for i in range(n) if (i == 0 or intensity[i] > intensity[i - 1]) and (i + 1 == n or intensity[i] > intensity[i + 1])]
    top = min(tops, key=lambda i: (abs(mz[i] - at), i)) if tops else 0
    lo, hi = top, top + 1
    while lo and intensity[lo - 1] <= intensity[lo]:
        lo -= 1
    while hi < n and intensity[hi] <= intensity[hi - 1]:
        hi += 1
    return lo, hi


def lightest(peptide: str, z: int, chemistry: Chemistry = REGULAR) -> tuple[float, float] | None:
    """m/z of a peptide's lightest mass, and the neutrons that the labelled element's atoms could have; None
    for peptides with characters that the configuration does not name."""
    if not chemistry.knows(peptide):
        return None
    counts = dict(zip(ELEMENTS, chemistry.atoms(peptide)))
    base = sum(chemistry.isotopes[e][0][0] * n for e, n in counts.items()) / z + PROTON
    return base, counts[chemistry.label] * NEUTRONS[chemistry.label]


def enrichment(peptide: str, mz, intensity, z: int, chemistry: Chemistry = REGULAR, light=None) -> float:
    """Per cent of the labelled element's atoms that are heavy: the mean number of neutrons over the
    peptide's lightest mass, by intensity, over the atoms that could have them. 0 without peaks, and for
    peptides with characters that the configuration does not name. light: ``lightest``, if at hand."""
    light = light or lightest(peptide, z, chemistry)
    if light is None:
        return 0.0
    base, most = light
    used = [k for k in range(len(mz)) if mz[k] > base - 0.5 / z]
    if not used or not most:
        return 0.0
    first, total, weighted = floor((mz[used[0]] - base) / chemistry.spacing * z + 0.5), 0.0, 0.0
    for n, k in enumerate(used, first):
        total += intensity[k]
        weighted += intensity[k] * n
    return float(weighted / total / most * 100)


FOUND = "ms1_scan int, precursor_intensity double, isotopic_peaks array<struct<mz:double,intensity:double,z:int>>, ms1_abundance double"
#: Scans that follow one another and travel together, and numbers of scans up to which these are broadcast.
BLOCK, BROADCAST = 64, 1_000_000


def precursor_envelopes(matches: DataFrame, surveys: DataFrame, key: str, chemistry: Chemistry = REGULAR) -> DataFrame:
    """matches (key: unique, file, parent_scan, charge, observed_mass, calculated_mass, naked) with
    ms1_scan, precursor_intensity, isotopic_peaks and ms1_abundance from surveys (file, scan, peaks).

    The peak of the observed mass is the highest within 0.01 / charge; the precursor's intensity is the
    sum over its isotopic peaks, those of the envelope. Matches without one in any of the scans, without a
    parent scan, or with a null charge or mass, have no peaks, intensity 0 and abundance 0. Survey scans
    of a file must have different numbers."""
    c, order = F.col, Window.partitionBy("_file").orderBy("_scan")
    numbers = saved(surveys.select(c("file").alias("_file"), c("scan").alias("_scan")).withColumn("_at", F.row_number().over(order) - 1))
    scans = numbers.count()
    near = F.broadcast(numbers) if scans <= BROADCAST else numbers
    beside = (c("_f") == c("_file")) & (c("_s") == c("_scan"))
    block = lambda at: F.floor(at / BLOCK)
    parts = int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, scans // (4 * BLOCK))

    able = F.expr("charge > 0 AND observed_mass IS NOT NULL")
    asked = matches.select(F.struct("*").alias("_m"), F.when(able, c("file")).alias("_f"), c("parent_scan").alias("_s")).join(near, beside, "left")
    anywhere = -1 - F.pmod(F.xxhash64(c("_m")[key]), F.lit(parts))
    asked = asked.select("_file", F.coalesce(block(c("_at")), anywhere).alias("_block"), "_at", F.lit(1).alias("_kind"), "_m")
    held = surveys.schema["peaks"].dataType.elementType.names
    lists = {n: c("peaks")[n].cast(f"array<{kind}>") for n, kind in (("mz", "double"), ("intensity", "double"), ("z", "int")) if n in held}
    peaks = surveys.select(c("file").alias("_f"), c("scan").alias("_s"), *(v.alias(f"_{n}") for n, v in lists.items())).join(near, beside)
    peaks = peaks.withColumn("_block", F.explode(F.sequence(block(c("_at")), block(c("_at") + STEPS - 1))))  # the last ones of a block also go to the next
    peaks = peaks.select("_file", "_block", "_at", F.lit(0).alias("_kind"), "_scan", *(f"_{n}" for n in lists))
    rows = asked.unionByName(peaks, allowMissingColumns=True).repartition(parts, "_file", "_block").sortWithinPartitions("_file", "_block", "_at", "_kind")
    kind = StructType(matches.schema.fields + _parse_datatype_string(FOUND).fields)
    at_of = {n: matches.columns.index(n) for n in ("charge", "observed_mass", "calculated_mass", "naked")}

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in kind.fields[-4:]]
        light: dict = {}
        last, recent = None, {}  # scans of a block: the last STEPS

        def scan_of(batch, at):
            mz, height = (np.array(batch.column(n)[at].values or [], float) if n in batch.schema.names else np.empty(0) for n in ("_mz", "_intensity"))
            by = np.argsort(mz, kind="stable")
            zs = batch.column("_z")[at].as_py() if "_z" in batch.schema.names else None
            charges = [zs[k] or 0 for k in by.tolist()] if zs else [0] * len(mz)
            mz, height = mz[by], height[by]
            return batch.column("_scan")[at].as_py(), mz, mz.tolist(), height.tolist(), charges

        def look(scan, z, observed, calculated, naked, left, found):
            """What a scan has of the matches ``left``; those that are still left."""
            number, sorted_mz, mz, height, charges = scan
            want = observed[left] / z[left] + PROTON
            los, his = np.searchsorted(sorted_mz, want - TOLERANCE / z[left]), np.searchsorted(sorted_mz, want + TOLERANCE / z[left], "right")
            hit = his > los
            for k, lo, hi in zip(left[hit].tolist(), los[hit].tolist(), his[hit].tolist()):
                charge, peptide = int(z[k]), naked[k] or ""
                apex = max(range(lo, hi), key=height.__getitem__)
                held = ladder(mz, height, apex, charge, spacing=chemistry.spacing)
                if len(held) > 2:
                    target = (calculated[k] or float(observed[k])) / charge + PROTON
                    a, b = envelope([mz[i] for i in held], [height[i] for i in held], target)
                    held = held[a:b]
                tall, places = [height[i] for i in held], [mz[i] for i in held]
                if (peptide, charge) not in light:
                    if len(light) > REMEMBER:
                        light.clear()
                    light[peptide, charge] = lightest(peptide, charge, chemistry)
                share = enrichment(peptide, places, tall, charge, chemistry, light[peptide, charge]) if light[peptide, charge] else 0.0
                found[k] = number, float(sum(tall)), [{"mz": m, "intensity": t, "z": int(charges[i])} for i, m, t in zip(held, places, tall)], share
            return left[~hit]

        for batch in batches:
            turns = batch.column("_kind").to_numpy()
            at, blocks = (batch.column(n).to_pylist() for n in ("_at", "_block"))
            files = batch.column("_file").to_pylist()
            some = np.flatnonzero(turns == 1)
            own = batch.column("_m").take(pa.array(some)).flatten()
            found = [(None, 0.0, [], 0.0)] * len(some)
            z, observed = (own[at_of[n]].cast(pa.float64()).to_numpy(zero_copy_only=False) for n in ("charge", "observed_mass"))
            calculated, naked = (own[at_of[n]].to_pylist() for n in ("calculated_mass", "naked"))
            k = done = 0
            while k < len(turns):
                if at[k] is None:
                    k, done = k + 1, done + 1
                    continue
                if (files[k], blocks[k]) != last:
                    last, recent = (files[k], blocks[k]), {}
                if turns[k] == 0:
                    recent[at[k]] = scan_of(batch, k)
                    recent = {n: v for n, v in recent.items() if n > at[k] - STEPS}
                    k += 1
                    continue
                end = k
                while end < len(turns) and turns[end] == 1 and at[end] == at[k] and (files[end], blocks[end]) == last:
                    end += 1
                left = np.arange(done, done + end - k)
                for step in range(STEPS):
                    if len(left) and at[k] - step in recent:
                        left = look(recent[at[k] - step], z, observed, calculated, naked, left, found)
                k, done = end, done + end - k
            if len(some):
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(v, t) for v, t in zip(zip(*found), types))], names=kind.names)

    return rows.mapInArrow(run, kind)
