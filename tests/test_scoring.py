import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.functions import chemistry, elements, scoring, variants
from spectraloom.plans.catalogue import LABELLED_CONFIG
from spectraloom.sources.readers import config

MASSES = scoring.monoisotopic()


def spectrum(peptide, noise=40, seed=1):
    b, y = scoring.prefix_masses(peptide, MASSES)
    ions = np.concatenate([b[:-1], y[:-1]]) + scoring.PROTON
    r = np.random.default_rng(seed)
    extra = r.uniform(100, 900, noise)
    peaks = [(float(m), 100.0 + i, 1) for i, m in enumerate(ions)] + [(float(m), float(v), 0) for m, v in zip(extra, r.uniform(1, 20, noise))]
    return peaks, float(y[-1])


def test_modified_counts(spark):
    df = spark.createDataFrame([("AMNM",), ("A",), ("",)], "p string")
    got = {r.p: r.x for r in df.select("p", variants.modified(F.col("p"), {"~": "M", "!": "N"}).alias("x")).collect()}
    assert sorted(got["AMNM"]) == sorted(["AMNM", "AM~NM", "AMN!M", "AMNM~", "AM~N!M", "AM~NM~", "AMN!M~"])
    assert got["A"] == ["A"] and got[""] == [""]


def test_substitutions(spark):
    rows = variants.substituted(spark.createDataFrame([("AG",)], "p string"), "p", "AGK").collect()
    assert {(r.mutant, r.piece) for r in rows} == {("GG", "GG"), ("KG", "K"), ("KG", "G"), ("AA", "AA"), ("AK", "AK")}


def test_masses_and_ions():
    assert MASSES["G"] == pytest.approx(57.02146, abs=1e-4)
    b, y = scoring.prefix_masses("GAK", MASSES)
    assert b[-1] + scoring.WATER == pytest.approx(y[-1])
    assert len(scoring.mvh_ions("GAKLR", 2, MASSES)) == 9
    assert len(scoring.mvh_ions("GAKLR", 4, MASSES)) == 10


def test_mvh_is_hypergeometric():
    mz = np.array([100.0, 200, 300, 400, 500, 600, 700])
    peaks = (mz, np.array([1, 2, 2, 3, 3, 3, 3]))
    ions = np.append(mz[:5], 150.5)
    from math import comb, log

    bins = 3000 - 0
    want = log(comb(bins, 6)) - log(comb(1, 1) * comb(2, 2) * comb(4, 2) * comb(bins - 7, 1))
    assert scoring.mvh(ions, peaks, 100.0, 700.0, 0.1) == pytest.approx(want)
    assert scoring.mvh(ions[:4], peaks, 100.0, 700.0, 0.1) is None


def test_xcorr_background():
    a = scoring.xcorr_prepare(np.array([100.0]), np.array([4.0]), 300.0, high=False)
    at = int(scoring.xcorr_bin(np.float64(100.0), False))
    assert a[at] == pytest.approx(50) and a[at + 75] == pytest.approx(-50 / 150) and a[at + 76] == pytest.approx(0)


@pytest.mark.parametrize("labelled", [False, True])
def test_search_finds_the_peptide(spark, labelled):
    right, wrong = ["SAMPLEPEPTIDEK", "GREATDAYFRR", "CAPEPN!TIDEK", "ACCESM~PLECK"], ["SAMPLEPETPIDEK", "EMASLPEDITPEPK", "GERATDAYFRR", "RFYADTAERGR", "CAPEPDTINEK", "CASECM~PLECK"]
    scans, peptides = [], []
    for i, p in enumerate(right):
        peaks, mass = spectrum(p)
        scans.append((i, 2, mass / 2 + scoring.PROTON, peaks))
    for p in right + wrong + right:
        peptides.append((p, float(scoring.prefix_masses(p, MASSES)[1][-1])))
    s = spark.createDataFrame(scans, "scan long, z int, parent_mz double, peaks array<struct<mz:double,intensity:double,z:int>>")
    peptides += [("SAMPLEPEPTIDEX", peptides[0][1]), ("SAMPLE?EPTIDEK", peptides[0][1])]
    got = scoring.search(s, spark.createDataFrame(peptides, "peptide string, mass double"), [(-0.05, 0.05)], labelled=labelled).collect()
    best = {r.scan: r.peptide for r in got if r.rank_wdp == 1}
    assert best == dict(enumerate(right))
    assert len({(r.scan, r.peptide) for r in got}) == len(got)
    assert scoring.search(s.limit(0), spark.createDataFrame(peptides, "peptide string, mass double"), [(-0.05, 0.05)]).count() == 0


def test_masses_by_hand():
    """Blocked cysteine is 103.009185 + 57.021464, a deamidation 15.994915 - 14.003074 - 1.007825."""
    assert MASSES["C"] == pytest.approx(160.030649, abs=1e-4) and MASSES["!"] == pytest.approx(0.984016) and MASSES["~"] == pytest.approx(15.994915)
    b, y = scoring.prefix_masses("PEPN!TIDEC", MASSES)
    plain = 97.052764 + 129.042593 + 97.052764 + 114.042927 + 0.984016 + 101.047679 + 113.084064 + 115.026943 + 129.042593 + 160.030649
    assert b[-1] == pytest.approx(plain, abs=1e-3) and y[-1] == pytest.approx(plain + 18.0105647, abs=1e-3)
    assert b[3] == pytest.approx(97.052764 + 129.042593 + 97.052764 + 115.026943, abs=1e-3)
    with pytest.raises(KeyError):
        scoring.prefix_masses("PEPX", MASSES)
    assert scoring.residues("~AM!~K") == ["A~", "M!~", "K"]


def test_configuration():
    text = config(LABELLED_CONFIG)
    own = chemistry.Chemistry.from_config(text)
    assert own.residues["C"] == (3, 8, 2, 2, 2, 1) and own.residues["!"] == (0, -1, 1, -1, 0, 0) and own.symbols(text) == {"~": "M", "!": "NQ", "@": "STY"}
    assert own.isotopes["S"][0][-1] == 35.967081 and own.isotopes["P"][1] == (0.9893, 0.0107)
    masses, probs = own.token("C")
    at = probs.argmax()  # 3 carbons at one half: 1 or 2 heavy, of which the sum over the others decides
    assert masses[0] == pytest.approx(5 * 12 + 8 * 1.007825 + 2 * 15.994915 + 2 * 14.003074 + 31.972071) and at in (1, 2)
    assert own.masses()["C"] == pytest.approx(float(masses[at]))
    # the blocking agent's carbon stays natural: two carbons less are heavy than if C were five carbons
    plain = chemistry.REGULAR.labelled("C", 0.5).token("C")
    mean = lambda t: float(t[0] @ t[1] / t[1].sum())
    assert mean(plain) - mean(own.token("C")) == pytest.approx(2 * (0.5 - 0.0107) * 1.003355, abs=1e-3)
    n15 = chemistry.REGULAR.labelled("N", 0.98)
    assert n15.spacing == 0.9991403 and n15.masses()["G"] == pytest.approx(MASSES["G"] + 0.997035) and chemistry.REGULAR.isotopes["N"][1][1] == 0.00368
    assert elements.symbol_table(text)["!"] == ("NQ", pytest.approx(0.984016)) and elements.losses(text | {"[A]PTM{>to1}": "ST", "[A]PTM{<to}": "S"}) == {">": "1", "<": ""}
    for bad in ({"[A]Element_Masses{C}": "12,13,14"}, {"[A]Residue{Nterm}": "0,1"}, {"[A]Element_List": "C, X"}):
        with pytest.raises(ValueError):
            chemistry.Chemistry.from_config({k: v for k, v in text.items() if k.split("]")[1] not in {b.split("]")[1] for b in bad}} | bad)
    with pytest.raises(ValueError):
        chemistry.REGULAR.token("!")


def test_envelopes_by_enumeration():
    """The b2 and y1 ions of a small peptide from all ways to place heavy atoms."""
    own = chemistry.REGULAR.labelled("C", 0.5)
    (b, y) = scoring.envelopes("GN!C", own)
    atoms = {"C": 2 + 4, "H": 3 + 6 - 1 + 1, "O": 1 + 2 + 1, "N": 1 + 2 - 1}
    base = sum(own.isotopes[e][0][0] * n for e, n in atoms.items())
    shares = [1.0]
    for e, n in atoms.items():
        steps = np.zeros(3)
        for m, q in zip(*own.isotopes[e]):
            steps[round(m - own.isotopes[e][0][0])] = q
        for _ in range(n):
            shares = np.convolve(shares, steps)
    keep = shares >= 0.01
    assert len(b) == len(y) == 2 and b[1][1] == pytest.approx(shares[keep], abs=1e-5)
    assert b[1][0][0] == pytest.approx(base + 1.003355 * np.flatnonzero(keep)[0] - scoring.PROTON, abs=0.01)
    assert y[0][0][0] > 160 + 17 and scoring.envelopes("PEPN!TIDEK") and scoring.envelopes("~PEPTIDEC!")


def test_two_tallest_peaks():
    series = ([(np.array([100.0, 101.0, 102.0]), np.array([0.2, 0.5, 0.3])), (np.array([200.0, 201.0]), np.array([0.5, 0.5]))], [(np.array([300.0]), np.array([0.7])), (np.array([400.0, 401.0, 402.0, 403.0]), np.array([0.1, 0.4, 0.3, 0.2]))])
    b, y = scoring.tallest(series)
    assert b[0][0].tolist() == [101, 102] and b[0][1] == pytest.approx([0.625, 0.375]) and b[1][0].tolist() == [200, 201] and b[1][1].tolist() == [0.5, 0.5]
    assert y[0][1].tolist() == [1] and y[1][0].tolist() == [401, 402] and y[1][1] == pytest.approx([4 / 7, 3 / 7])
    ions = scoring.mvh_envelope_ions("AAA", 2, (b, y))
    assert sorted(ions - scoring.PROTON) == pytest.approx([101, 102, 200, 201, 300, 401, 402])
    # above charge 2 the charges of a bond are shared: in a bare peptide of three the first third of
    # the way gives b one charge, the second two
    zb, zy = scoring.bond_charges("AAA", 3)
    want = [m / zb[k + 1] for k, (ms, _) in enumerate(b) for m in ms] + [m / zy[2 - k] for k, (ms, _) in enumerate(y) for m in ms]
    assert sorted(scoring.mvh_envelope_ions("AAA", 3, (b, y)) - scoring.PROTON) == pytest.approx(sorted(want))
    prepared = np.zeros(30000)
    prepared[scoring.xcorr_bin(np.array([101.0, 102.0, 401.0]) + scoring.PROTON)] = [10.0, 20.0, 30.0]
    assert scoring.xcorr_envelopes((b, y), 2, prepared) == pytest.approx((0.625 * 10 + 0.375 * 20 + 4 / 7 * 30) * 0.005)


def test_block_equals_single_scores():
    r = np.random.default_rng(4)
    mz = np.sort(r.uniform(100, 900, 80))
    level = r.integers(0, 4, 80)
    ions = [np.sort(r.choice(mz, k, replace=False)) + r.normal(0, 0.004, k) for k in (0, 3, 12, 40, 60)] + [np.array([50.0, 5000.0])]

    def plain(own):
        own = [x for x in own if 100 <= x <= 900]
        matched = [0] * 4
        for x in own:
            near = min(range(80), key=lambda i: (abs(mz[i] - x), mz[i]))
            matched[level[near] if abs(mz[near] - x) < 0.01 else 0] += 1
        if sum(matched[1:]) < 5:
            return None
        choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) if 0 <= k <= n else 0
        bins = scoring.half_up(800 / 0.02)
        return choose(bins, len(own)) - choose(bins - 80, matched[0]) - sum(choose(int((level == i).sum()), matched[i]) for i in (1, 2, 3))

    got = scoring.mvh_block(ions, (mz, level), 100.0, 900.0, 0.01)
    for x, own in zip(got, ions):
        want = plain(own)
        assert math.isnan(x) if want is None else x == pytest.approx(want)


def test_ranks_over_all_precursors_of_a_scan(spark):
    peaks, mass = spectrum("SAMPLEPEPTIDEK")
    s = spark.createDataFrame([(1, z, mass / z + scoring.PROTON, peaks) for z in (2, 3)], "scan long, z int, parent_mz double, peaks array<struct<mz:double,intensity:double,z:int>>")
    known = spark.createDataFrame([("SAMPLEPEPTIDEK", mass), ("SAMPLEPETPIDEK", mass)], "peptide string, mass double")
    got = scoring.search(s, known, [(-0.05, 0.05)]).collect()
    assert sorted(r.rank_wdp for r in got) == [1, 2, 3, 4] and {r.z for r in got} == {2, 3}


def cut_places(text, after, before):
    return [0, *(k + 1 for k in range(len(text) - 1) if text[k] in after and text[k + 1] in before), len(text)]


def brute_mutants(seq, alphabet, after, before, missed, least, most):
    """Every substitution, the whole sequence digested anew: peptides that hold the residue or stand beside
    a cut that was not there."""
    out = []
    old = set(cut_places(seq, after, before))
    for p in range(len(seq)):
        for r in alphabet:
            if r == seq[p]:
                continue
            text = seq[:p] + r + seq[p + 1 :]
            cuts = cut_places(text, after, before)
            for i in range(len(cuts) - 1):
                for j in range(i + 1, min(i + missed + 2, len(cuts))):
                    a, b = cuts[i], cuts[j]
                    beside = a == p + 1 and p + 1 not in old or b == p and p not in old
                    if least <= b - a <= most and (a <= p < b or beside):
                        out.append((p + 1, r, text[a:b], seq[a:b], text[a - 1] if a else "-", text[b] if b < len(text) else "-"))
    return sorted(out)


@pytest.mark.parametrize("before,missed", [("ACDEFGHIJKLMNPQRSTVWY", 2), ("ACDEFGHIKLMNQRSTVWY", 1)])
def test_mutants_equal_brute_force(spark, before, missed):
    r = random.Random(5)
    sequences = ["".join(r.choice("AAGGPPLKRKM") for _ in range(r.randint(1, 45))) for _ in range(20)] + ["K", "PEPTIDE", "KKKKRRR"]
    df = spark.createDataFrame(list(enumerate(sequences)) + [(99, ""), (98, None)], "id int, seq string")
    got = variants.mutants(df, "seq", "AGKPR", "KR", before, missed, 3, 20, False).collect()
    for i, s in enumerate(sequences):
        own = sorted((x.position, x.residue, x.peptide, x.original, x.prefix, x.suffix) for x in got if x.id == i)
        assert own == brute_mutants(s, "AGKPR", "KR", before, missed, 3, 20), s
    assert not [x for x in got if x.id > 90]
