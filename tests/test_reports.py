"""Merging, reports, envelopes, elements, readers and sinks against values worked out by hand or brute force."""

import base64
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.functions import chemistry, elements, isotopes, lowres, peptides, scoring, variants
from spectraloom.operators import envelopes, merging, proteins, reports
from spectraloom.sources import numpress, readers, sinks, spectra


def test_digest_of_one_long_sequence(spark):
    seq = "ACDEFGHIK" * 20_000
    df = spark.createDataFrame([("p", seq, 1), ("e", "", 2), ("n", None, 3)], "id string, seq string, PEPTIDES int")
    got = peptides.digest(df, "seq", missed=1)
    assert got.groupBy("missed").count().orderBy("missed").collect() == [(0, 20_000), (1, 19_999)]
    assert got.columns == ["id", "seq", "PEPTIDES", "first_piece", "missed", "peptide"]


def test_names_and_classes(spark):
    df = spark.createDataFrame([("SE", ["R_a", "T_b"]), ("C13_001.020Pct", ["T_a"]), ("N15_50Pct", ["R_a"]), ("x", ["V_a", "T_q"]), (None, ["c", "T_q"])], "name string, p array<string>")
    rows = df.select(peptides.abundance(F.col("name")), peptides.protein_class(F.col("p"), "R_", "T_", "V_"), peptides.protein_class(F.col("p"))).collect()
    assert [r[0] for r in rows] == [1.07, 1.02, 50.0, None, None]
    assert [r[1] for r in rows] == ["train", "train", "reserve", "test", "target"] and {r[2] for r in rows} == {"target"}
    assert peptides.common_prefix(["/a/run_12.tab", "/a/run_13.tab"], "out") == "run_1"
    assert peptides.common_prefix(["/a/x.tab", "/a/y.tab"], "out") == "out"


def test_modification_positions(spark):
    got = spark.range(1).select(peptides.modifications(F.lit("AM~CK!~"), {"~": 16.0, "!": 1.0}, {"M": 131.0, "K": 128.0}).alias("m")).first().m
    assert [(x.position, x.mass) for x in got] == [(2, 147.0), (4, 145.0)]


def test_decoy_split_is_the_same_everywhere(spark):
    df = spark.createDataFrame([(f"p{i}", "ABC") for i in range(300)], "n string, s string")
    one = {r.n for r in peptides.decoy_split(df.repartition(5), "n", "s", {"T_": 0.5, "V_": 0.5}).collect()}
    two = {r.n for r in peptides.decoy_split(df.repartition(2), "n", "s", {"T_": 0.5, "V_": 0.5}).collect()}
    assert one == two and 100 < sum(x.startswith("T_") for x in one) < 200


def test_elements(spark):
    light = scoring.monoisotopic()
    p = "GAMKC"
    row = spark.createDataFrame([(p,)], "p string").select(elements.atom_counts(F.col("p")).alias("a")).select("a.*", elements.base_mass(F.col("a")).alias("m")).first()
    assert row.m == pytest.approx(sum(light[c] for c in p) + scoring.WATER, abs=1e-4)
    whole = elements.distribution({"C": 5, "H": 8})
    less = elements.distribution({"C": 6, "H": 8, "O": 0} | {"C": 5})
    assert less[1] == pytest.approx(whole[1])
    back = elements.apart(*elements.distribution({"C": 6, "H": 8}), *isotopes_of("C"))
    assert back[1][:3] == pytest.approx(whole[1][:3], abs=1e-4)
    m, q = elements.averagine(20)
    letters = [chemistry.RESIDUES[r] for r in "ACDEFGHIKLMNPQRSTVWY"]
    mean = [round(sum(c[k] for c in letters) / len(letters)) for k in range(6)]
    each = sum(n * chemistry.ISOTOPES[e][0][0] for e, n in zip("CHONPS", mean))
    assert q.sum() == pytest.approx(1, abs=1e-3) and m[0] == pytest.approx(20 * each + scoring.WATER, abs=1e-3)


def isotopes_of(e):
    return chemistry.ISOTOPES[e]


def test_most_abundant(spark):
    row = spark.range(1).select(elements.most_abundant(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4))).alias("m")).first()
    assert row.m == 2.0


def test_low_resolution():
    r = np.random.default_rng(2)
    mz, height = np.sort(r.uniform(100, 400, 200)), r.uniform(1, 50, 200)
    kept, share = lowres.local_filter(mz, height)
    units = {}
    for m, h in zip(mz, height):
        units[int(m)] = max(units.get(int(m), 0), h)
    want = [m for m, h in zip(mz, height) if h >= sorted((units.get(u, 0) for u in range(int(m) - 50, int(m) + 50)), reverse=True)[19]]
    assert kept.tolist() == want and share.max() == pytest.approx(1)
    masses = scoring.monoisotopic()
    right, wrong = "SAMPLEPEPTIDEK", "SAMPLEPETPIDEK"
    b, y = scoring.prefix_masses(right, masses)
    ions = np.sort(np.concatenate([b[:-1], y[:-1]]) + scoring.PROTON)
    for z in (2, 3):
        assert lowres.weighted_sum(right, z, ions, np.ones(len(ions)), masses, 0.5) > lowres.weighted_sum(wrong, z, ions, np.ones(len(ions)), masses, 0.5)


def test_envelopes(spark):
    step = 1.003355 / 2
    base = 500.0
    peaks = [(base + k * step, h, 2) for k, h in enumerate([10.0, 30.0, 20.0, 5.0, 9.0])] + [(base + 9 * step, 99.0, 2)]
    surveys = spark.createDataFrame([("f", 1, peaks), ("f", 5, [(100.0, 1.0, 1)]), ("f", 9, [(100.0, 1.0, 1)]), ("f", 12, [(100.0, 1.0, 1)])], "file string, scan int, peaks array<struct<mz:double,intensity:double,z:int>>")
    mass = (base + step - peptides.PROTON) * 2
    ask = [(1, "f", 1, 2, mass), (2, "f", 9, 2, mass), (3, "f", 12, 2, mass), (4, "f", 1, None, mass), (5, "f", 2, 2, mass)]
    df = spark.createDataFrame([(*a, mass, "PEPTIDEK") for a in ask], "id long, file string, parent_scan int, charge int, observed_mass double, calculated_mass double, naked string")
    got = {r.id: r for r in envelopes.precursor_envelopes(df, surveys, "id").collect()}
    assert [p.intensity for p in got[1].isotopic_peaks] == [10, 30, 20, 5] and got[1].precursor_intensity == 65
    assert (got[2].ms1_scan, len(got[2].isotopic_peaks)) == (1, 4)  # two scans before
    assert got[3].ms1_scan is None and got[3].precursor_intensity == 0 and got[4].isotopic_peaks == [] and got[5].ms1_scan is None
    assert envelopes.envelope([1, 2, 3, 4, 5], [5, 1, 4, 4, 2], 1.0) == (0, 2)


def test_enrichment_of_known_atoms():
    p = "PEPTIDEK"
    half = chemistry.REGULAR.labelled("C", 0.5)
    m, q = elements.distribution(dict(zip("CHON", half.atoms(p))), half)
    whole = np.round(m - m[0]).astype(int)
    top = np.zeros(whole.max() + 1)
    np.add.at(top, whole, q)
    mz = (m[0] + np.arange(len(top)) * 1.003355) / 2 + peptides.PROTON
    assert envelopes.enrichment(p, mz, top, 2) == pytest.approx(50, abs=1.5)


def test_delta_p(spark):
    rows = [(1, "AM~MK", "AMMK", 500.0, 9.0, 5.0), (1, "AMM~K", "AMMK", 500.0, 6.0, 5.0), (1, "AMMK", "AMMK", 484.0, 5.0, 1.0), (2, "CK~", "CK", 300.0, 4.0, 4.0), (3, "CK", "CK", 300.0, 4.0, 4.0)]
    df = spark.createDataFrame([(*r[:4], 500.001, *r[4:]) for r in rows], "scan int, identified string, original string, mass double, measured double, a double, b double")
    got = {(r.scan, r.identified): r.delta_p for r in merging.delta_p(df, ["scan"], ["a", "b"], "identified", "original", "mass", "measured").collect()}
    assert got[1, "AMMK"] is None and got[3, "CK"] is None and got[2, "CK~"] == 1.0
    # AM~MK is second by b (equal scores, by text), so it leads by a only; AMM~K leads by b.
    assert got[1, "AM~MK"] == pytest.approx((3 / 9 + 0) / 2) and got[1, "AMM~K"] == pytest.approx((-3 / 9 + 0) / 2)


def test_nested_and_described(spark):
    table = spark.createDataFrame([("{a,b}",), ("c",)], "protein string")
    rows = spark.createDataFrame([("c", 2, "y"), ("c", 1, "x")], "protein string, scan int, peptide string")
    known = spark.createDataFrame([("a", "first"), ("c", "third")], "protein_id string, description string")
    got = {r.protein: r for r in reports.nested_report(reports.described(table, known, "protein"), rows, "protein", ["scan"]).collect()}
    assert got["{a,b}"].description == "{first,N/A}" and got["c"].description == "third"
    assert [x.peptide for x in got["c"].rows] == ["x", "y"] and got["{a,b}"].rows is None


def test_containing_against_brute_force(spark):
    seqs = {f"p{i}": "ABCDE" * i + "FGH" for i in range(5)} | {"e": ""}
    peps = ["A", "AB", "EA", "CDEFG", "ABCDEABCDE", "H", "Z", "", "FGHA"]
    got = {(r.pep, r.id) for r in reports.containing(spark.createDataFrame([(p,) for p in peps], "pep string"), spark.createDataFrame(list(seqs.items()), "id string, s string"), "pep", "s").collect()}
    assert got == {(p, i) for p in peps for i, s in seqs.items() if p and p in s}


def test_error_probabilities_fall_with_the_score(spark):
    r = np.random.default_rng(1)
    rows = [(float(r.normal(3 if i % 3 == 0 else 0)), i % 3 == 1) for i in range(3000)] + [(None, True)]
    df = reports.error_probabilities(spark.createDataFrame(rows, "s double, d boolean"), "s", "d").where("s is not null").orderBy("s").collect()
    p = [x.posterior_error_prob for x in df]
    assert len(df) == 3000 and all(a >= b for a, b in zip(p, p[1:])) and p[-1] < 0.05 < 0.5 < p[0]
    assert reports.error_probabilities(spark.createDataFrame([], "s double, d boolean"), "s", "d").count() == 0


def test_parsimony_subset_of_one_protein(spark):
    # C's peptides lie in A and B together, in neither alone: it stays for the second part, where it shares peptides with nobody left.
    edges = [("A", 1), ("A", 2), ("B", 3), ("B", 4), ("C", 2), ("C", 3)]
    got = {r.protein_group for r in proteins.parsimony(spark.createDataFrame(edges, "p string, q int"), "p", "q").collect()}
    assert got == {"A", "B", "C"}


def test_ms2_text_and_repeated_keys(spark, tmp_path):
    (tmp_path / "a.ms2").write_text("H\tx\nS\t000007\t000007\t500.5\nI\tRTime\t1.5\nI\tRTime\t2.5\nI\tEmpty\nZ\t2\t999.99272\nZ\t3\t1499.48545\n100.1 5.0\n200.2 6.5\nS\t8\t8\t300.0\nZ\t1\t300.0\n")
    rows = spectra.read(spark, str(tmp_path / "a.ms2")).collect()
    assert [(r.scan, r.parent_mz, r.charge, len(r.peaks), r.info["RTime"]) for r in rows] == [(7, 500.5, 2, 2, "1.5")]
    assert [(x.z, round(x.mz, 3)) for x in rows[0].precursors] == [(2, 500.5), (3, 500.5)]
    (tmp_path / "b.ms1").write_text("S\t1\t1\n100.1 5.0\n")
    assert spectra.read(spark, str(tmp_path / "b.ms1")).first().parent_mz is None
    back = tmp_path / "out"
    sinks.write_scans(spark.createDataFrame([(3, 400.25, 2, "1.0", [(100.5, 2.0)])], "scan int, parent_mz double, charge int, rt string, peaks array<struct<mz:double,intensity:double>>"), str(back))
    again = readers.scans(spark, str(back), "ms").first()
    assert (again.scan, again.parent_mz, again.charge, again.peaks[0].mz) == (3, 400.25, 2, 100.5)


def test_results_round_trip(spark, tmp_path):
    rows = [("f.FT2", s, 2, 500.5, "MS2", "SE", "1.5", s - 1, f"[PEP{k}K]", f"[PEP{k}K]", 999.1234, 9.0 - k, 1.0, 2.0, ["a", "Decoy_b"], 3, 998.5) for s in (12, 7) for k in (0, 1)]
    df = spark.createDataFrame(rows, "filename string, scan int, charge int, window_mz double, scan_type string, search_name string, rt string, parent_scan int, identified string, original string, calculated_mass double, wdp double, xcorr double, mvh double, proteins array<string>, measured_charge int, measured_mass double")
    sinks.write_spe2pep(df, str(tmp_path / "r"), "[A]\nx = 1")
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*.txt")))
    assert text.startswith("#\t[A]\n#\tx = 1\n+\tFilename") and [x.split("\t")[2] for x in text.splitlines() if x.startswith("+\tf")] == ["7", "12"]
    (tmp_path / "one.txt").write_text(text)
    got = readers.spe2pep(spark, str(tmp_path / "one.txt")).drop("rank").orderBy("scan", "identified").collect()
    assert [tuple(r) for r in got] == sorted(rows, key=lambda r: (r[1], r[8]))


def test_tab_and_reports(spark, tmp_path):
    values = dict(FileName="f", ScanNumber=1, ParentCharge=2, MeasuredParentMass=1.5, ScanType="HCD", SearchName="SE", IdentifiedPeptide="A", OriginalPeptide="A", CalculatedParentMass=1.5, MVH=1.0, Xcorr=2.0, WDP=3.0, ProteinNames=["a", "b"], Diff_MVH=0.5, Diff_Xcorr=0.5, Diff_WDP=0.5, RetentionTime="7", DeltaP=None)
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string' if isinstance(v, str) else 'double'}" for k, v in values.items())
    df = spark.createDataFrame([tuple(values.values())], kinds)
    sinks.write_tab(df, str(tmp_path / "t"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*.txt")))
    (tmp_path / "x.tab").write_text(text)
    assert readers.tab(spark, str(tmp_path / "x.tab")).select(*values).first() == tuple(values.values())
    sinks.write_report(df.select("FileName", "MVH", "ProteinNames"), str(tmp_path / "p"), ["FileName"], {"decoys": 3})
    text = "".join(p.read_text() for p in sorted((tmp_path / "p").glob("part-*.txt")))
    assert text == "#\tdecoys = 3\nFileName\tMVH\tProteinNames\nf\t1.000\t{a,b}\n"


def test_pepxml_document(spark, tmp_path):
    import xml.etree.ElementTree as ET

    df = spark.createDataFrame([("f", k, 2, 1, 900.1, "AK", ["P&1"], 900.0, 4.5) for k in (2, 1)], "file string, scan int, charge int, rank int, parent_mass double, peptide string, proteins array<string>, mass double, wdp double")
    sinks.write_pepxml(df, str(tmp_path / "x"), ["wdp"], "a.fasta", {"M~": 15.99})
    node = ET.fromstring("".join(p.read_text() for p in sorted((tmp_path / "x").glob("part-*.txt"))))
    assert [q.get("start_scan") for q in node.iter() if q.tag.endswith("spectrum_query")] == ["1", "2"]
    assert [q.get("symbol") for q in node.iter() if q.tag.endswith("aminoacid_modification")] == ["~"]


def test_configs():
    template = "[S]\nName = x # n\nWindows = 0\n[E]\nC = 0.99,0.01\nO = 1\n"
    got = sinks.labelled_configs(template, "C13", 0, 100, 50, "[E]C", "[S]Name", "[S]Windows")
    assert list(got) == ["C13_000.000Pct", "C13_050.000Pct", "C13_100.000Pct"]
    half = readers.config(got["C13_050.000Pct"])
    assert half["[E]C"] == "0.5,0.5" and half["[S]Windows"] == "-5,-4,-3,-2,-1,0,1,2,3,4,5" and half["[E]O"] == "1"
    with pytest.raises(KeyError):
        sinks.config_text(template, {"[S]None": "1"})
    assert sinks.grid(0, 10, 4) == [0, 4, 8, 10] and sinks.half_width(0.0) == 3 and sinks.old_search_name("C13", 0.5) == "C13_50Pct"


def packed_halves(values):
    halves = []
    for v in values:
        u = v & 0xFFFFFFFF
        digits = [u >> 4 * k & 15 for k in range(8)]
        fill = 15 if v < 0 else 0
        n = 0
        while n < (7 if v < 0 else 8) and digits[7 - n] == fill:
            n += 1
        halves += [n if v >= 0 or n == 0 else 8 + n, *digits[: 8 - n]]
    if len(halves) % 2:
        halves.append(0)
    return bytes(a << 4 | b for a, b in zip(halves[::2], halves[1::2]))


def test_packed_numbers():
    values = [0, 1, -1, 255, -4096, 123456, -(2**31), 2**31 - 1, 7]
    assert numpress.whole_numbers(packed_halves(values)) == values
    counts = [3, 0, 70000, 12]
    assert numpress.unpack(packed_halves(counts), "pic").tolist() == counts
    scale, mz = 1000.0, [100.5, 101.25, 140.0, 141.125]
    whole = [round(m * scale) for m in mz]
    offs = [whole[k] - (2 * whole[k - 1] - whole[k - 2]) for k in range(2, 4)]
    data = struct.pack(">d", scale) + struct.pack("<II", *whole[:2]) + packed_halves(offs)
    assert numpress.decode(base64.b64encode(zlib.compress(data)).decode(), "linear", True).tolist() == mz
    logs = struct.pack(">d", 3000.0) + struct.pack("<2H", *(round(np.log(h + 1) * 3000) for h in (9.0, 1000.0)))
    assert numpress.unpack(logs, "slof") == pytest.approx([9.0, 1000.0], rel=1e-3)


@pytest.mark.parametrize("packed", [False, True])
def test_binary_scans(spark, tmp_path, packed):
    mz, height = np.array([100.5, 200.25]), np.array([1.5, 2.5], "<f4")
    body = struct.pack("<ii", 7, 7) + struct.pack("<i", 1) + struct.pack("<d", 500.5) + struct.pack("<f", 1.5) + struct.pack("<f3d4ddf", *([0] * 10)) + struct.pack("<iii", 1, 0, 2) + struct.pack("<id", 2, 1000.0)
    if packed:
        a, b = zlib.compress(mz.tobytes()), zlib.compress(height.tobytes())
        body += struct.pack("<ii", len(a), len(b)) + a + b
    else:
        body += b"".join(struct.pack("<df", m, h) for m, h in zip(mz, height))
    name = tmp_path / ("a.cms2" if packed else "a.bms2")
    name.write_bytes(struct.pack("<ii", 6 if packed else 4, 5) + bytes(2048) + body)
    r = spectra.read(spark, str(name)).first()
    assert (r.scan, r.ms_level, r.charge, r.parent_mz, r.rt, [(p.mz, p.intensity) for p in r.peaks]) == (7, 2, 2, 500.5, 90.0, [(100.5, 1.5), (200.25, 2.5)])


def test_small_readers(spark, tmp_path):
    for n in ("a.FT2", "b.mzML", "c.cfg", "d.Spe2Pep.txt", "e.txt"):
        (tmp_path / n).write_text("")
    names = lambda k: [p.rsplit("/", 1)[-1] for p in readers.discover(spark, f"file://{tmp_path}", k)]
    assert (names("scans"), names("configs"), names("results")) == (["a.FT2", "b.mzML"], ["c.cfg"], ["d.Spe2Pep.txt"])
    df = spark.createDataFrame([("f", [(200.0, 1.0), (100.0, 5.0)], 150.0)], "file string, peaks array<struct<mz:double,intensity:double>>, p double")
    row = df.select(readers.sorted_peaks(F.col("peaks")).alias("a"), readers.sorted_peaks(F.col("peaks"), "intensity").alias("b"), readers.charge_estimate(F.col("peaks"), F.col("p")).alias("z")).first()
    assert [p.mz for p in row.a] == [100, 200] and [p.intensity for p in row.b] == [5, 1] and row.z == 0
    assert tuple(readers.mz_bounds(df).first()) == ("f", 100.0, 200.0)


def test_guessed_charges(spark):
    df = spark.createDataFrame([(1, 2, [(100.0, 1.0)], 50.0), (2, 0, [(100.0, 1.0)], 500.0), (3, None, [(900.0, 1.0)], 500.0)], "id int, charge int, peaks array<struct<mz:double,intensity:double>>, mz double")
    got = {(r.id, r.charge) for r in variants.with_guessed_charges(df, "charge", "peaks", "mz").collect()}
    assert got == {(1, 2), (2, 1), (3, 2), (3, 3)}


def test_streams_yield_the_same_rows(spark, tmp_path):
    from spectraloom.streaming import arrivals

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.ft2").write_text("H\tx\nS\t7\t500.5\t99\nZ\t2\t999.9\nI\tRetentionTime\t1.5\n100.1\t5.0\nS\t8\t300.0\t9\nZ\t0\t0\n")
    query = arrivals.arriving_scans(spark, f"file://{folder}").writeStream.format("memory").queryName("seen").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.scan for r in spark.table("seen").collect()] == [7]
    results = tmp_path / "results"
    results.mkdir()
    line = "+\tf\t1\t2\t500.5\tMS2\tSE\t1.0\t0\n*\tA\tA\t1.0\t{}\t1\t1\t{{p}}\t2\t1.0\n"
    (results / "a.txt").write_text(line.format(3))
    (results / "b.txt").write_text(line.format(9))
    best = arrivals.best_so_far(arrivals.arriving_results(spark, f"file://{results}"))
    query = best.writeStream.outputMode("complete").format("memory").queryName("best").option("checkpointLocation", f"file://{tmp_path}/ck2").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.scan, r.wdp) for r in spark.table("best").collect()] == [(1, 9.0)]


@pytest.mark.parametrize("few", [0, 50_000])
def test_running_rates_equal_brute_force(spark, monkeypatch, few):
    """In one range, and in several, between which ties are split."""
    from spectraloom.operators import ranking

    monkeypatch.setattr(ranking, "FEW", few)
    r = np.random.default_rng(8)
    rows = [(int(i), int(r.integers(3)), float(r.integers(0, 200)), bool(r.random() < 0.3)) for i in range(1500)] + [(9000, 1, None, False)]
    df = spark.createDataFrame(rows, "id int, g int, s double, d boolean")
    for group in ([], ["g"]):
        got = {x.id: x.q_value for x in ranking.q_values(df, "s", "d", group or None).collect()}
        kept = {x.id for x in ranking.fdr_cutoff(df, "s", "d", 0.3, ["id"], group or None).collect()}
        for value in {x[1] for x in rows} if group else {None}:
            own = sorted((x for x in rows if x[2] is not None and (value is None or x[1] == value)), key=lambda x: (-x[2], x[0]))
            best, cut, t, d = {}, None, 0, 0
            for x in own:
                t, d = t + (not x[3]), d + x[3]
                best[x[2]] = d / max(t, 1)  # after the last row of a score
                if t and d <= 0.3 * t:
                    cut = x[2]
            least, q = float("inf"), {}
            for s in sorted(best):
                least = min(least, best[s])
                q[s] = least
            assert all(got[x[0]] == pytest.approx(q[x[2]]) for x in own)
            assert all((x[0] in kept) == (cut is not None and x[2] >= cut) for x in own)
        assert 9000 not in got
