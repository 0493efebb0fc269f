"""Three scores of a peptide against a spectrum, and the search that applies them.

The kernels work on numpy arrays. ``search`` joins peptides to precursors by mass band, gathers the
candidates of each (scan, block) and scores a block in one Arrow pass: a spectrum is prepared once
for all candidates of its block, the first score is taken of all of them at once, and fragments are
kept by peptide, as one meets many scans. Blocks are dealt by a hash of the peptide, so no task holds
all candidates of a scan; the best of a scan are the best among the best of its blocks.

What residues and symbols weigh comes from a ``Chemistry``; peptides with characters that it does not
name match nothing.
"""

from __future__ import annotations

from math import erf, erfc, floor, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.window import Window

from spectraloom.functions.chemistry import REGULAR, Chemistry
from spectraloom.functions.isotopes import convolve_peaks
from spectraloom.functions.peptides import PROTON
from spectraloom.operators.joins import band_join
from spectraloom.store import saved

WATER = 18.0105647
#: Isotopic peaks less likely than this are no part of an envelope.
CUTOFF = 0.01
#: Peptides whose fragments a task remembers.
REMEMBER = 20_000


def monoisotopic(chemistry: Chemistry = REGULAR) -> dict[str, float]:
    """Mass of each residue and symbol: see ``Chemistry.masses``."""
    return chemistry.masses()


def residues(peptide: str) -> list[str]:
    """One entry for each residue, with the symbols that follow it; symbols before the first belong to it."""
    out, lead = [], ""
    for ch in peptide:
        if ch.isalpha():
            out.append(ch + lead)
            lead = ""
        elif out:
            out[-1] += ch
        else:
            lead += ch
    return out


def prefix_masses(peptide: str, masses: dict[str, float]):
    """Neutral masses of prefixes and of suffixes with water, each of 1 .. all residues. Characters
    without a mass are an error."""
    import numpy as np

    each = np.array([sum(masses[ch] for ch in r) for r in residues(peptide)])
    return np.cumsum(each), np.cumsum(each[::-1]) + WATER


def envelopes(peptide: str, chemistry: Chemistry = REGULAR, cutoff: float = CUTOFF):
    """Isotopic peaks (neutral mass, probability) of the b and of the y ions of 1 .. n - 1 residues: an
    end and the residues, of which a b ion gives up a proton and a y ion takes one."""

    def series(parts, start, proton):
        out, total = [], start
        for r in parts[:-1]:
            total = convolve_peaks(*total, *chemistry.token(r))
            keep = total[1] >= min(cutoff, total[1].max())
            out.append((total[0][keep] + proton, total[1][keep]))
        return out

    parts = residues(peptide)
    return series(parts, chemistry.token("Nterm"), -PROTON), series(parts[::-1], chemistry.token("Cterm"), PROTON)


def tallest(series, n: int = 2):
    """Of each ion the ``n`` most likely peaks (the lighter of equals), the likeliest first, as shares of
    their sum: what the labelled search keeps of a match for its other two scores."""

    def one(mass, prob):
        at = (-prob).argsort(kind="stable")[:n]
        return mass[at], prob[at] / prob[at].sum()

    return tuple([one(*ion) for ion in ions] for ions in series)


# --- hypergeometric score


def log_factorials(n: int):
    """ln of 0! .. n!"""
    import numpy as np

    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])


def log_choose(logs, n, k):
    """ln of n over k, 0 where there is no such choice."""
    import numpy as np

    n, k = np.broadcast_arrays(n, k)
    ok = (k >= 0) & (k <= n)
    n, k = np.where(ok, n, 0), np.where(ok, k, 0)
    return np.where(ok, logs[n] - logs[k] - logs[n - k], 0.0)


def half_up(x: float) -> int:
    return floor(x + 0.5)


def mvh_prepare(mz, intensity, parent_mass, parent_mz, z, parent_tol, classes=3, tic=0.98, most=300):
    """Peaks by m/z with their intensity class (1 the strongest, 0 none); None below seven peaks."""
    import numpy as np

    if len(mz) < 7:
        return None
    inside = mz <= parent_mass
    mz, intensity = mz[inside], intensity[inside]
    order = np.lexsort((mz, -intensity))
    mz, intensity = mz[order], intensity[order]
    if not len(mz):
        return None
    reach = int(np.searchsorted(np.cumsum(intensity) / intensity.sum(), tic)) + 1
    floor_at = intensity[min(reach, len(mz) - 1)]
    n = min(int((intensity >= floor_at).sum()), most)
    mz, intensity = mz[:n], intensity[:n]
    for k in (1, 2):
        lost = np.flatnonzero(np.abs(mz - (parent_mz - k * WATER / z)) < parent_tol)
        if len(lost):
            mz, intensity = np.delete(mz, lost[0]), np.delete(intensity, lost[0])
    ends = np.cumsum([half_up(2**i * len(mz) / (2**classes - 1)) for i in range(classes)])
    level = np.searchsorted(ends, np.arange(len(mz)), "right") + 1
    level[level > classes] = 0
    # Equal m/z: the weakest peak's class holds.
    at, last = np.unique(mz[::-1], return_index=True)
    return at, level[::-1][last]


def bond_charges(peptide: str, z: int):
    """The charges of b and y at each of the 0 .. n places between residues: they share those of the
    precursor by the basicity of what lies on either side."""
    import numpy as np

    base = [4 if r[0] in "RKH" else 2 if r[0] in "QN" else 0 for r in residues(peptide)]
    n = len(base)
    ratio = (np.concatenate([[0], np.cumsum(base)]) + np.arange(n + 1)) / max(sum(base) + n - 2, 1)
    zb = np.searchsorted(np.arange(1, z - 1) / (z - 1), ratio, "right") + 1
    return zb, z - zb


def mvh_ions(peptide: str, z: int, masses: dict[str, float]):
    """m/z of the predicted ions. Up to charge 2 all are single; above, each bond's charges are
    shared between its b and y ion."""
    import numpy as np

    b, y = prefix_masses(peptide, masses)
    if z <= 2:
        return np.concatenate([b[:-1], y]) + PROTON
    zb, zy = bond_charges(peptide, z)
    return np.concatenate([b / zb[1:] + PROTON, y[::-1] / zy[:-1] + PROTON])


def mvh_envelope_ions(peptide: str, z: int, series, cutoff: float = CUTOFF):
    """As ``mvh_ions`` over the isotopic peaks of the b and y ions of 1 .. n - 1 residues."""
    import numpy as np

    n = len(series[0])
    zb, zy = bond_charges(peptide, z) if z > 2 else (np.ones(n + 2, int),) * 2
    out = [mass[prob >= cutoff] / zb[k] + PROTON for k, (mass, prob) in enumerate(series[0], 1)]
    out += [mass[prob >= cutoff] / zy[n + 1 - k] + PROTON for k, (mass, prob) in enumerate(series[1], 1)]
    return np.concatenate(out) if out else np.zeros(0)


def mvh_block(ions: list, peaks, lo: float, hi: float, tol: float, classes: int = 3, least: int = 5, logs=None):
    """-ln of the hypergeometric probability of each candidate's matches, from the predicted ions of
    each; nan with fewer than ``least`` matches."""
    import numpy as np

    mz, level = peaks
    out = np.full(len(ions), np.nan)
    if not len(ions) or not len(mz):
        return out
    owner, ions = np.repeat(np.arange(len(ions)), [len(x) for x in ions]), np.concatenate(ions)
    inside = (ions >= lo) & (ions <= hi)
    owner, ions = owner[inside], ions[inside]
    right = np.clip(np.searchsorted(mz, ions), 0, len(mz) - 1)
    left = np.maximum(right - 1, 0)
    near = np.where(np.abs(mz[left] - ions) <= np.abs(mz[right] - ions), left, right)
    hit = np.where(np.abs(mz[near] - ions) < tol, level[near], 0)
    matched = np.bincount(owner * (classes + 1) + hit, minlength=len(out) * (classes + 1)).reshape(len(out), -1)
    bins, have = half_up((hi - lo) / (2 * tol)), np.bincount(level, minlength=classes + 1)
    if logs is None or len(logs) <= max(bins, len(mz)):
        logs = log_factorials(max(bins, len(mz)))
    total = log_choose(logs, bins - len(mz), matched[:, 0])
    for i in range(1, classes + 1):
        total = total + log_choose(logs, have[i], matched[:, i])
    enough = matched[:, 1:].sum(axis=1) >= least
    out[enough] = (log_choose(logs, bins, matched.sum(axis=1)) - total)[enough]
    return out


def mvh(ions, peaks, lo: float, hi: float, tol: float, classes: int = 3, least: int = 5) -> float | None:
    """The score of one candidate; None with fewer than ``least`` matches."""
    got = float(mvh_block([ions], peaks, lo, hi, tol, classes, least)[0])
    return None if got != got else got


# --- cross correlation


def xcorr_bin(mz, high: bool = True):
    import numpy as np

    return np.asarray(mz / 0.02 + 1 if high else mz / 1.0005 + 0.6).astype(int)


def xcorr_prepare(mz, intensity, parent_mass: float, high: bool = True):
    """Square roots in bins, ten windows scaled to 50, less the mean of the 150 neighbours."""
    import numpy as np

    inside = mz < parent_mass + 50
    bins = xcorr_bin(mz[inside], high)
    a = np.zeros(int(xcorr_bin(np.float64(parent_mass + 50), high)) + 2)
    if len(bins):
        np.maximum.at(a, bins, np.sqrt(intensity[inside]))
        least, width = 0.05 * a.max(), int(bins.max()) // 10 + 1
        for at in range(0, 10 * width, width):
            part = a[at : at + width]
            top = part.max() if len(part) else 0
            if top > 0:
                part[:] = np.where(part > least, part * 50 / top, 0)
    sums = np.concatenate([[0], np.cumsum(a)])
    i = np.arange(len(a))
    around = sums[np.minimum(i + 76, len(a))] - sums[np.maximum(i - 75, 0)] - a
    a = a - around / 150
    if high:
        padded = np.pad(a, 1)
        a = a + 0.5 * (padded[:-2] + padded[2:])
    return a


def xcorr(peptide: str, z: int, prepared, masses: dict[str, float], high: bool = True) -> float:
    """Sum over distinct predicted bins of b and y ions of charge 1 .. max(1, z - 1)."""
    import numpy as np

    b, y = prefix_masses(peptide, masses)
    ions = np.concatenate([np.concatenate([b[:-1], y[:-1]]) / k + PROTON for k in range(1, max(1, z - 1) + 1)])
    bins = np.unique(xcorr_bin(ions, high))
    return max(float(prepared[bins[bins < len(prepared)]].sum()) * 0.005, 1e-8)


def xcorr_envelopes(series, z: int, prepared, high: bool = True) -> float:
    """As ``xcorr`` over isotopic peaks, each bin weighted by its probability (the largest of equal bins)."""
    import numpy as np

    weight = np.zeros(len(prepared))
    for mass, prob in series[0] + series[1]:
        mass, prob = mass[prob >= CUTOFF], prob[prob >= CUTOFF]
        for k in range(1, max(1, z - 1) + 1):
            bins = xcorr_bin(mass / k + PROTON, high)
            ok = bins < len(weight)
            np.maximum.at(weight, bins[ok], prob[ok])
    return max(float(weight @ prepared) * 0.005, 1e-8)


# --- weighted sum of matched isotope envelopes


def score_error(x: float, tol: float) -> float:
    """Twice the tail of a normal distribution with deviation tol / 2."""
    return erfc(abs(x) / (tol / 2) / sqrt(2))


def strongest(mz, intensity, at: float, tol: float) -> int | None:
    import numpy as np

    lo, hi = np.searchsorted(mz, [at - tol, at + tol])
    return int(lo + intensity[lo:hi].argmax()) if hi > lo else None


def match_regular(mass, prob, z, mz, intensity, charge, tol):
    """(error, weight) of an envelope, or None: weight 1 + cosine of expected and observed."""
    import numpy as np

    apex = int(prob.argmax())
    want, share = mass / z + PROTON, prob / prob[apex]
    top = strongest(mz, intensity, want[apex], tol)
    if top is None or charge[top] not in (0, z):
        return None
    error, seen = mz[top] - want[apex], np.zeros(len(mass))
    errors = np.zeros(len(mass))
    seen[apex], errors[apex] = 1.0, error
    for i in range(len(mass)):
        at = strongest(mz, intensity, want[i] + error, tol / 2) if i != apex else None
        if at is not None:
            seen[i], errors[i] = intensity[at] / intensity[top], mz[at] - want[i]
    weight = 1.0 if len(mass) == 1 else 1 + float(share @ seen) / sqrt(float(share @ share) * float(seen @ seen))
    on = seen > 0
    return float(errors[on] @ share[on] / share[on].sum()), weight


def match_labelled(mass, prob, z, mz, intensity, charge, tol):
    """As ``match_regular``: from the apex outwards until the first gap; peaks of the same charge
    add the likeness of their height."""
    apex = int(prob.argmax())
    want, share = mass / z + PROTON, prob / prob[apex]
    top = strongest(mz, intensity, want[apex], tol)
    if top is None:
        return None
    error = mz[top] - want[apex]
    total, part, weight = error, 1.0, 1.0
    for way in (range(apex + 1, len(mass)), range(apex - 1, -1, -1)):
        for i in way:
            at = strongest(mz, intensity, want[i] + error, tol / 2)
            seen = intensity[at] / intensity[top] if at is not None else 0.0
            if at is None or abs(seen - share[i]) >= 1.5 * share[i]:
                break
            total, part = total + (mz[at] - want[i]) * share[i], part + share[i]
            if charge[at] == z:
                weight += 0.5 * (1 - erf(abs(seen - share[i]) / sqrt((seen**2 + share[i] ** 2) / 2)))
    if charge[top] not in (0, z):
        weight /= 2
    return (float(total / part), weight) if weight > 0 else None


def wdp(series, z: int, mz, intensity, charge, tol: float, labelled: bool = False, tops=None) -> float:
    """Sum over found ions of error score x weight, doubled where b and y of one bond are both found.
    ``labelled`` measures errors from their mean. tops: ``apexes(series)``, if at hand."""
    import numpy as np

    match = match_labelled if labelled else match_regular
    tops, found = apexes(series) if tops is None else tops, []
    charges = range(1, min(2, z) + 1)
    want = np.concatenate([tops / k + PROTON for k in charges])
    hits = np.flatnonzero(np.searchsorted(mz, want + tol) > np.searchsorted(mz, want - tol))
    length, many = len(series[0]) + 1, len(tops)
    for at in hits.tolist():
        k, at = divmod(at, many)
        kind, n = divmod(at, length - 1)
        got = match(*series[kind][n], k + 1, mz, intensity, charge, tol)
        if got:
            found.append((kind, n + 1, *got))
    have = {(kind, n) for kind, n, _, _ in found}
    centre = sum(f[2] for f in found) / len(found) if labelled and found else 0.0
    return sum(score_error(e - centre, tol) * w * (2 if (1 - kind, length - n) in have else 1) for kind, n, e, w in found)


def apexes(series):
    """The mass of the likeliest peak of each ion, of b and then of y."""
    import numpy as np

    return np.array([mass[prob.argmax()] for ions in series for mass, prob in ions])


# --- the search

SCORED = "run string, scan long, z int, parent_mass double, peptide string, mvh double, xcorr double, wdp double"


class Fragments:
    """Fragments by peptide, forgotten when there are too many."""

    def __init__(self, chemistry: Chemistry):
        self.chemistry, self.masses, self.envelopes, self.ions = chemistry, chemistry.masses(), {}, {}

    def envelope(self, peptide: str):
        if len(self.envelopes) > REMEMBER // 10:
            self.envelopes.clear()
        if peptide not in self.envelopes:
            series = envelopes(peptide, self.chemistry)
            self.envelopes[peptide] = series, apexes(series)
        return self.envelopes[peptide]

    def predicted(self, peptide: str, z: int):
        if len(self.ions) > REMEMBER:
            self.ions.clear()
        key = peptide, max(z, 2)
        if key not in self.ions:
            self.ions[key] = mvh_ions(peptide, z, self.masses)
        return self.ions[key]


def score_blocks(blocks: DataFrame, tol: float, parent_tol: float, chemistry: Chemistry = REGULAR, labelled: bool = False, keep: int | None = None) -> DataFrame:
    """blocks: run, scan, z, parent_mass, parent_mz, lo, hi (m/z bounds of the run), mz / intensity /
    charge arrays, peptides (array of peptide and the text that is scored for it). Regular: the ``keep`` (50) best by MVH get the other scores and a zero
    score drops the match; labelled: the 10 best by WDP, whose other scores see the two tallest peaks of
    each ion."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind: StructType = _parse_datatype_string(SCORED)
    schema = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in kind.fields])
    keep = keep or (10 if labelled else 50)

    def run(batches):
        import numpy as np

        fragments, logs = Fragments(chemistry), log_factorials(200_000)

        def block(name, scan, z, parent, parent_mz, lo, hi, mz, intensity, charge, names):
            mz, intensity, charge = (np.array(x, float) for x in (mz, intensity, charge))
            order = np.argsort(mz, kind="stable")
            mz, intensity, charge = mz[order], intensity[order], charge[order]
            peaks = mvh_prepare(mz, intensity, parent, parent_mz, z, parent_tol)
            cross = xcorr_prepare(mz, intensity, parent)
            names = sorted({(x["peptide"], x["text"]) for x in names if fragments.chemistry.knows(x["text"])})

            def hypergeometric(ions):
                return np.nan_to_num(mvh_block(ions, peaks, lo, hi, tol, logs=logs), nan=0.0) if peaks else np.zeros(len(ions))

            def spectral(p):
                series, tops = fragments.envelope(p)
                return wdp(series, z, mz, intensity, charge, tol, labelled, tops)

            first = [spectral(p) for _, p in names] if labelled else hypergeometric([fragments.predicted(p, z) for _, p in names]).tolist()
            best = sorted((-score, *p) for score, p in zip(first, names))[:keep]
            if labelled:
                tops = [tallest(fragments.envelope(p)[0]) for *_, p in best]
                second = hypergeometric([mvh_envelope_ions(p, z, t) for (*_, p), t in zip(best, tops)])
                for (minus, peptide, _), t, score in zip(best, tops, second.tolist()):
                    yield (name, scan, z, parent, peptide, score, xcorr_envelopes(t, z, cross), -minus)
                return
            for minus, peptide, p in best:
                row = (-minus, xcorr(p, z, cross, fragments.masses), spectral(p)) if minus else (0.0,)
                if 0.0 not in row:
                    yield (name, scan, z, parent, peptide, *row)

        for batch in batches:
            for at in range(batch.num_rows):
                rows = list(block(*(c[at].as_py() for c in batch.columns)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

    return blocks.select("run", "scan", "z", "parent_mass", "parent_mz", "lo", "hi", "mz", "intensity", "charge", "peptides").mapInArrow(run, kind)


def search(scans: DataFrame, peptides: DataFrame, windows, tol: float = 0.01, parent_tol: float = 0.05, block: int = 2000, chemistry: Chemistry = REGULAR, labelled: bool = False, keep: int | None = None, run: str | None = None) -> DataFrame:
    """scans: scan, z, parent_mz, peaks (mz, intensity, z) and, if named, the run (file) that scans are
    numbered in and that m/z bounds hold for; peptides: peptide, mass and, if it has one, the text that is
    scored for the peptide. The matches of each (run, scan) over
    all of its precursors, with three scores and their ranks, those with any rank up to 10. Scans without
    peaks or m/z, and peptides without mass or with unknown characters, match nothing; repeated peptides
    count once. The candidates of a scan are counted and dealt to blocks of about ``block``, so no list
    grows with the database. Spectra that a run repeats (peaks, charge and m/z; told by 128 bits of hash) are
    scored once, and their matches go to all scans that have them."""
    keep, own = keep or (10 if labelled else 50), ["run", "scan", "z"]
    s = scans.withColumn("run", F.col(run).cast("string") if run else F.lit(""))
    s = s.where(F.col("parent_mz").isNotNull() & (F.size("peaks") > 0)).withColumn("parent_mass", F.col("parent_mz") * F.col("z") - F.col("z") * PROTON)
    same = ["run", "z", "parent_mz", "_a", "_b"]
    s = s.withColumns({"_a": F.xxhash64(F.lit(1), "peaks"), "_b": F.xxhash64(F.lit(2), "peaks")})
    who = saved(s.select("scan", *same))
    # each distinct spectrum with a number in place of its scan
    s = saved(s.drop("scan").dropDuplicates(same).withColumn("scan", F.monotonically_increasing_id()))
    who = who.join(s.select(*same, F.col("scan").alias("_id")), same).select("_id", F.col("scan").alias("_scan"))
    ends = s.groupBy("run").agg(F.min(F.array_min("peaks.mz")).alias("lo"), F.max(F.array_max("peaks.mz")).alias("hi"))
    named = peptides.select("peptide", "mass", F.col("text" if "text" in peptides.columns else "peptide").alias("text"))
    pairs = band_join(named, s.select(*own, "parent_mz", "parent_mass"), "mass", "parent_mass", windows).select(*own, "parent_mz", "peptide", "text").distinct()
    own = [*own, "parent_mz"]
    counts = pairs.groupBy(*own).agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    dealt = pairs.join(counts, own).withColumn("block", F.pmod(F.xxhash64("peptide"), F.col("blocks")))
    grouped = dealt.groupBy(*own, "block").agg(F.collect_list(F.struct("peptide", "text")).alias("peptides"))
    spectra = s.join(ends, "run").select(*own, "parent_mass", "lo", "hi", F.col("peaks.mz").alias("mz"), F.col("peaks.intensity").alias("intensity"), F.col("peaks.z").alias("charge"))
    # dealt by block and in a stated number of partitions: few bytes would be joined to one task, and they are slow to score
    parts = int(scans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scored = score_blocks(grouped.join(spectra, own).repartition(parts, *own, "block"), tol, parent_tol, chemistry, labelled, keep)
    scored = scored.join(who, F.col("scan") == F.col("_id")).withColumn("scan", F.col("_scan")).drop("_id", "_scan")
    by = lambda c: Window.partitionBy("run", "scan").orderBy(F.desc(c), "peptide", "z", "parent_mass")
    best = scored.withColumn("_n", F.row_number().over(by("wdp" if labelled else "mvh"))).where(F.col("_n") <= keep).drop("_n")
    for score in ("mvh", "xcorr", "wdp"):
        best = best.withColumn(f"rank_{score}", F.row_number().over(by(score)))
    best = best.where(F.least("rank_mvh", "rank_xcorr", "rank_wdp") <= 10)
    return best.withColumnRenamed("run", run) if run else best.drop("run")
