"""Whole jobs over files: proteins and scans to search results, results and survey scans to features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.functions import chemistry, scoring
from spectraloom.operators import features
from spectraloom.plans import workflow
from spectraloom.sources import readers

PROTON = scoring.PROTON
BASE = "\n".join(f"Residue{{{r}}} = {', '.join(map(str, n))}" for r, n in chemistry.RESIDUES.items())
BASE += "\nElement_List = C, H, O, N, P, S\n" + "\n".join(f"Element_Masses{{{e}}} = {', '.join(map(str, m))}\nElement_Percent{{{e}}} = {', '.join(map(str, p))}" for e, (m, p) in chemistry.ISOTOPES.items())
REGULAR = f"""[Peptide_Identification]
Search_Name = SE
Search_Type = Regular
Parent_Mass_Windows = -1, 0, 1
Search_Mass_Tolerance_Parent_Ion = 0.02
Mass_Tolerance_Fragment_Ions = 0.01
Minimum_Peptide_Length = 7
Maximum_Peptide_Length = 60
Cleave_After_Residues = KR
Cleave_Before_Residues = ACDEFGHIJKLMNPQRSTVWY
Maximum_Missed_Cleavages = 1
Try_First_Methionine = true
Max_PTM_Count = 2
PTM{{~}} = M # oxidation
PTM{{!}} = NQ
{BASE}
"""
PROTEINS = {"one": "MAAACDEFGKLMNPESTIDEKGGGWYTVASR", "two": "GGGWYTVASRPEPTIDESAMPLERWW", "Rev_one": "RSAVTYWGGGKEDITSEPNMLKGFEDCAAA"}


def ft2(number, peptide, z, config, shift=0, names=("RetentionTime", "ScanType", "ParentScanNumber")):
    """A scan of a peptide's own ions, its parent so many neutrons off."""
    own = chemistry.Chemistry.from_config(readers.config(config))
    b, y = scoring.prefix_masses(peptide, own.masses())
    r = np.random.default_rng(number)
    peaks = [(m + PROTON, 200.0 + 5 * i) for i, m in enumerate(np.concatenate([b[:-1], y[:-1]]))] + [(float(m), float(h)) for m, h in zip(r.uniform(120, 1100, 40), r.uniform(1, 20, 40))]
    mass = y[-1] + shift * 1.003355
    lines = [f"S\t{number}\t{mass / z + PROTON:.6f}", f"Z\t{z}\t{mass:.6f}", f"I\t{names[0]}\t{number / 10}", f"I\t{names[1]}\tMS2", f"D\t{names[2]}\t{number - 1}"]
    return "\n".join(lines + [f"{m:.5f}\t{h:.2f}\t1000\t0\t0\t1" for m, h in sorted(peaks)]), mass


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("flow")
    (at / "db.fasta").write_text("".join(f">{n} about {n}\n{s[:9]}\n{s[9:]}\n" for n, s in PROTEINS.items()))
    scans = [ft2(11, "AAACDEFGK", 2, REGULAR), ft2(21, "LM~N!PESTIDEK", 2, REGULAR, shift=1), ft2(31, "GGGWYTVASR", 2, REGULAR), ft2(41, "PEPTIDESAMPLER", 3, REGULAR)]
    (at / "run.FT2").write_text("H\tExtractor\tnone\n" + "\n".join(text for text, _ in scans) + "\n")
    workflow_in = [(n, m) for n, (_, m) in zip((11, 21, 31, 41), scans)]
    return at, dict(workflow_in)


def test_search_from_files(spark, folder):
    at, masses = folder
    workflow.write_search(spark, f"{at}/db.fasta", f"{at}/run.FT2", REGULAR, f"{at}/found/run.SE.Spe2Pep.txt")
    got = readers.spe2pep(spark, f"{at}/found/run.SE.Spe2Pep.txt").collect()
    best = {r.scan: r for r in got if r.rank == 1}
    assert {s: r.identified for s, r in best.items()} == {11: "[AAACDEFGK]L", 21: "K[LM~N!PESTIDEK]G", 31: "K[GGGWYTVASR]", 41: "R[PEPTIDESAMPLER]W"}
    assert best[21].original == "K[LMNPESTIDEK]G" and best[21].proteins == ["one"] and best[31].proteins == ["one", "two"]
    assert best[31].filename == "run.FT2" and (best[31].charge, best[31].parent_scan, best[31].rt, best[31].scan_type, best[31].search_name) == (2, 30, "3.1", "MS2", "SE")
    assert all(best[s].measured_mass == pytest.approx(m, abs=1e-3) for s, m in masses.items())
    # one neutron is the most likely number for 53 carbons (0.567), and none for 40 (0.428)
    assert best[21].measured_mass - best[21].calculated_mass == pytest.approx(0, abs=2e-3)
    assert best[11].measured_mass - best[11].calculated_mass == pytest.approx(0, abs=2e-3)
    assert len([r for r in got if r.scan == 21]) >= 2  # other places of the two symbols


def test_labelled_search_and_settings(spark, folder):
    at, _ = folder
    half = REGULAR.replace("Search_Type = Regular", "Search_Type = SIP").replace("Search_Name = SE", "Search_Name = C13_050.000Pct").replace("Element_Percent{C} = 0.9893, 0.0107", "Element_Percent{C} = 0.5, 0.5")
    settings = workflow.Settings.from_config(half)
    assert settings.labelled and settings.symbols == {} and settings.chemistry.isotopes["C"][1] == (0.5, 0.5) and len(settings.windows) == 3
    found = workflow.candidates(readers.fasta(spark, f"{at}/db.fasta"), settings)
    own = settings.chemistry
    peptide = "GGGWYTVASR"
    b, y = scoring.envelopes(peptide, own)
    peaks = [(float(m + PROTON), float(1000 * p), 1) for mass, prob in b + y for m, p in zip(mass, prob)]
    mass = found.where(F.col("original") == f"[{peptide}]").first().mass
    scan = spark.createDataFrame([("run.FT2", 5, mass / 2 + PROTON, 2, [], {"ScanType": "MS2"}, peaks)], "file string, scan int, parent_mz double, charge int, precursors array<struct<z:int,mz:double>>, info map<string,string>, peaks array<struct<mz:double,intensity:double,z:int>>")
    row = workflow.search(scan, readers.fasta(spark, f"{at}/db.fasta"), settings).where("rank_wdp = 1").collect()
    assert [r.identified for r in row] == [f"K[{peptide}]"] and row[0].mvh > 50 and row[0].xcorr > 0.5 and row[0].calculated_mass == mass
    with pytest.raises(ValueError):
        workflow.Settings.from_config(REGULAR.replace("= Regular", "= Other"))


def test_search_for_mutations(spark, tmp_path):
    config = REGULAR.replace("= Regular", "= Mutation")
    text, _ = ft2(7, "GGGWYEVASR", 2, config)
    (tmp_path / "run.FT2").write_text("H\tx\n" + text + "\n")
    (tmp_path / "db.fasta").write_text("".join(f">{n}\n{s}\n" for n, s in list(PROTEINS.items())[:2]))
    settings = workflow.Settings.from_config(config)
    got = workflow.search(readers.scans(spark, f"{tmp_path}/run.FT2"), readers.fasta(spark, f"{tmp_path}/db.fasta"), settings).where("rank_wdp = 1").collect()
    assert settings.symbols == {} and [(r.identified, r.original, r.proteins) for r in got] == [("K[GGGWYEVASR]", "K[GGGWYTVASR]", ["one", "two"])]


def test_features_from_files(spark, folder):
    at, masses = folder
    mass, step = masses[31], 1.003355 / 2
    base = mass / 2 + PROTON
    heights = [4.0, 9.0, 6.0, 2.0]
    survey = "\n".join(["S\t30", "I\tRetentionTime\t3.0", *(f"{base + k * step:.6f}\t{h}\t1000\t0\t0\t2" for k, h in enumerate(heights)), f"{base + 9 * step:.6f}\t99\t1000\t0\t0\t2"])
    (at / "run.FT1").write_text("H\tx\n" + "\n".join(["S\t10", "I\tRetentionTime\t1.0", "300.0\t5.0\t1000\t0\t0\t1", survey]) + "\n")

    def results(name, rows):
        (at / name).mkdir()
        lines = ["#\tconfig", "+\tFilename\tScanNumber\tParentCharge\tIsolationWindowCenterMZ\tScanType\tSearchName\tRetentionTime\tPrecursorScanNumber", "*\tIdentifiedPeptide\tOriginalPeptide\tCalculatedParentMass\tWDP\tXcorr\tMVH\tProteinNames\tmeasuredCharge\tMeasuredMass"]
        for scan, parent, found in rows:
            lines.append(f"+\trun.FT2\t{scan}\t2\t{base + 0.25:.5f}\tMS2\tC13_002.000Pct\t3.1\t{parent}")
            lines += ["*\t" + "\t".join(map(str, x)) for x in found]
        (at / name / "run.C13_002.000Pct.Spe2Pep.txt").write_text("\n".join(lines) + "\n")

    off = mass + 1.003355 + 0.002
    results("target", [(31, 30, [("K[GGGWYTVASR]P", "K[GGGWYTVASR]P", mass, 40.5, 2.0, 90.0, "{one,two}", 2, off), ("[KGM~KR]", "[KGMKR]", mass, 10.5, 1.0, 30.0, "{two}", 2, mass)]), (12, 10, [("[GGGWYTVASR]", "[GGGWYTVASR]", mass, 7.0, 1.0, 1.0, "{one}", 2, mass)])])
    results("decoy", [(31, 30, [("[RSAVTYWGGG]", "[RSAVTYWGGG]", mass, 20.5, 1.5, 50.0, "{Rev_one}", 2, mass), ("[GGGWYTVASR]", "[GGGWYTVASR]", mass, 30.0, 1.5, 50.0, "{Rev_x}", 2, mass)])])
    config = REGULAR.replace("Search_Type = Regular", "Search_Type = SIP")
    workflow.write_features(spark, f"{at}/target", f"{at}/decoy", f"{at}/run.FT1", config, f"{at}/run.pin")
    lines = [r.value.split("\t") for r in spark.read.text(f"{at}/run.pin").collect()]
    rows = {x[0]: dict(zip(lines[0], x)) for x in lines[1:]}
    assert len(lines[0]) == 24 and set(rows) == {"run.FT2.31.1", "run.FT2.31.2", "run.FT2.31.3", "run.FT2.12.1"}
    one, two, three = (rows[f"run.FT2.31.{k}"] for k in (1, 2, 3))
    assert one["Peptide"] == "K[GGGWYTVASR]P" and one["Proteins"] == "{one,two}" and one["Label"] == "1" and two["Label"] == "-1" and two["Peptide"] == "[RSAVTYWGGG]"
    number = {k: float(v) for k, v in one.items() if k not in ("SpecId", "Peptide", "Proteins")}
    assert number["isotopicMassWindowShifts"] == 1 and number["massErrors"] == pytest.approx(0.002 / mass * 1e6, rel=1e-4)
    assert number["mzShiftFromisolationWindowCenters"] == pytest.approx(abs(base + 0.25 - off / 2 - PROTON), abs=1e-4)
    assert (number["peptideLengths"], number["missCleavageSiteNumbers"], number["PTMnumbers"], number["isotopicPeakNumbers"]) == (10, 0, 0, 4)
    # the peak one neutron up is the highest near the observed mass; the envelope is what falls from it
    assert number["log10_precursorIntensities"] == pytest.approx(np.log10(sum(heights)), abs=1e-6)
    light = sum(n * chemistry.ISOTOPES[e][0][0] for e, n in zip("CHONPS", chemistry.REGULAR.atoms("GGGWYTVASR")))
    first = round((base - light / 2 - PROTON) * 2 / 1.003355)
    per_cent = sum(h * (k + first) for k, h in enumerate(heights)) / sum(heights) / chemistry.REGULAR.atoms("GGGWYTVASR")[0] * 100
    assert number["MS1IsotopicAbundances"] == pytest.approx(per_cent) and number["MS2IsotopicAbundances"] == 2
    assert number["isotopicAbundanceDiffs"] == pytest.approx(per_cent - 2)
    assert float(two["diffScores"]) == 20 and float(three["diffScores"]) == 30 and number["diffScores"] == 0
    assert (three["peptideLengths"], three["missCleavageSiteNumbers"], three["PTMnumbers"]) == ("5", "1", "1")
    none = rows["run.FT2.12.1"]
    assert none["isotopicPeakNumbers"] == "0" and float(none["log10_precursorIntensities"]) == 0 and float(none["isotopicAbundanceDiffs"]) == -2


def test_negative_differences_and_null_columns(spark):
    df = spark.createDataFrame([("f.FT2", 1, 2, 500.0, "MS2", "N15_098.000Pct", None, None, "[AAK]", "[AAK]", 900.0, 1.0, 1.0, 1.0, ["p"], None, None, 1, False)], "filename string, scan int, charge int, window_mz double, scan_type string, search_name string, rt string, parent_scan int, identified string, original string, calculated_mass double, wdp double, xcorr double, mvh double, proteins array<string>, measured_charge int, measured_mass double, rank int, is_decoy boolean")
    surveys = spark.createDataFrame([], "file string, scan int, peaks array<struct<mz:double,intensity:double,z:int>>")
    row = features.features(df, surveys, chemistry.REGULAR.labelled("N", 0.98)).first()
    assert row.ms2_abundance == 98 and row.ms1_abundance == 0 and row.mz_shift is None and row.mass_error_ppm is None and row.isotopic_peaks == []
    assert features.features(df.limit(0), surveys).count() == 0
