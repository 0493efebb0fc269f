"""Tests of the findings of round 4."""

from spectraloom.functions.peptides import PROTON
from spectraloom.operators import envelopes
from tests.test_findings_r03 import planned


def test_matches_travel_once_to_their_scans(spark, monkeypatch):  # F2
    """A match sees its scan and the two before it, also of the block before, in its own file alone; one without
    charge, mass or scan has nothing; rows that repeat a key keep what is theirs."""
    monkeypatch.setattr(envelopes, "BLOCK", 2)
    peaks = lambda *mz: [(m, 10.0, 0) for m in mz]
    surveys = [("a", scan, peaks(100.0 + scan)) for scan in range(10, 80, 10)] + [("b", 10, peaks(300.0)), ("b", 20, None)]
    surveys = spark.createDataFrame(surveys, "file string, scan int, peaks array<struct<mz:double,intensity:double,z:int>>")
    rows, want = [], {}

    def ask(key, file, scan, charge, mz, found):
        mass = None if mz is None else (mz - PROTON) * (charge or 1)
        rows.append((key, file, scan, charge, mass, mass, "PEPTIDEK"))
        want.setdefault(key, []).append(found)

    for scan in range(10, 80, 10):
        for back in range(5):
            ask(f"{scan}-{back}", "a", scan, 2, 100.0 + scan - 10 * back, scan - 10 * back if back < 3 and scan > 10 * back else None)
    ask("same", "a", 30, 1, 130.0, 30)
    ask("same", "a", 50, 1, 150.0, 50)
    ask("other", "b", 20, 1, 300.0, 10)
    for key, row in {"file": ("c", 10, 1, 110.0), "none": (None, 10, 1, 110.0), "scan": ("a", 15, 1, 110.0), "no scan": ("a", None, 1, 110.0), "charge": ("a", 10, None, 110.0), "zero": ("a", 10, 0, 110.0), "mass": ("a", 10, 1, None)}.items():
        ask(key, *row, None)
    matches = spark.createDataFrame(rows, "key string, file string, parent_scan int, charge int, observed_mass double, calculated_mass double, naked string")
    got = envelopes.precursor_envelopes(matches, surveys, "key")
    assert got.columns == [*matches.columns, "ms1_scan", "precursor_intensity", "isotopic_peaks", "ms1_abundance"]
    seen: dict = {}
    for r in got.collect():
        seen.setdefault(r["key"], []).append(r["ms1_scan"])
        assert (r["precursor_intensity"], len(r["isotopic_peaks"])) == ((0.0, 0) if r["ms1_scan"] is None else (10.0, 1))
    assert {k: sorted(v, key=str) for k, v in seen.items()} == want
    assert planned(got).split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
