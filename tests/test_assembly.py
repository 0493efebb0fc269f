"""The tables at the end of a workflow, by hand."""

import pytest

from spectraloom.operators import assembly

SCORED = "PSMId string, score double, `q-value` double, posterior_error_prob double"
PIN = "SpecId string, Label int, ScanNr int, Peptide string, Proteins string, MS1IsotopicAbundances double, MS2IsotopicAbundances double, log10_precursorIntensities double"


@pytest.fixture(scope="module")
def tables(spark):
    pin = [("s1.7.1", 1, 7, "K[AAK]R", "{p1,p2}", 101.5, 50.0, 5.5), ("s1.3.1", 1, 3, "[CC~K]R", "{p1}", 2.0, 1.07, 4.0), ("s2.9.1", 1, 9, "[DDK]", "{p2}", -3.0, 30.0, 0.0), ("s2.4.1", -1, 4, "[KDD]", "{Rev_p2}", 1.0, 2.0, 1.0), ("s1.8.2", 1, 8, "[EEK]", "{p3}", 5.0, 60.0, 2.0)]
    targets = [("s1.7.1", 3.0, 0.001, 0.1), ("s1.3.1", 2.0, 0.01, 0.6), ("s2.9.1", 2.5, 0.005, 0.2), ("s1.8.2", 0.5, 0.2, 0.4)]
    return spark.createDataFrame(targets, SCORED), spark.createDataFrame([("s2.4.1", 1.0, 0.008, 0.7)], SCORED), spark.createDataFrame(pin, PIN)


def test_filtered_and_probable(tables):
    targets, decoys, pin = tables
    got = assembly.filtered_psms(targets, decoys, pin)
    assert {(r.PSMId, r.Label, r.ScanNr) for r in got.collect()} == {("s1.7.1", 1, 7), ("s1.3.1", 1, 3), ("s2.9.1", 1, 9), ("s2.4.1", -1, 4)} and "SpecId" not in got.columns
    assert {r.PSMId for r in assembly.probable_psms(targets, decoys, pin).collect()} == {"s1.7.1", "s2.9.1", "s1.8.2"}


def test_labelled_matches(tables):
    targets, decoys, pin = tables
    again = assembly.labelled_table(assembly.filtered_psms(targets, decoys, pin), ["s2"])
    assert {(r.SpecId, r.Label) for r in again.collect()} == {("s1.7.1", 1), ("s2.9.1", -1)} and "q-value" not in again.columns
    got = {r.PSMId: r for r in assembly.labelled_psms(targets, decoys, again).where("Label is not null").collect()}
    assert got["s1.7.1"].MS1IsotopicAbundances == 100 and got["s2.9.1"].MS1IsotopicAbundances == 0 and got["s2.9.1"].SampleName == "s2"


def test_proteins_with_matches(spark, tables):
    targets, decoys, pin = tables
    from spectraloom.functions.peptides import sample_name

    psms = assembly.filtered_psms(targets, decoys, pin)
    psms = psms.withColumn("SampleName", sample_name(psms["PSMId"]))
    known = spark.createDataFrame([("p1", 5), ("p2", 6), ("p9", 7)], "Protein string, length int")
    got = {r.Protein: r for r in assembly.with_matches(known, psms, ["s1", "s2"], "SIP_").collect()}
    assert len(got) == 3 and got["p1"].length == 5
    assert (got["p1"].SIP_s1_PeptideSequences, got["p1"].SIP_s1_MS1IsotopicAbundances, got["p1"].SIP_s2_PeptideSequences) == ("CC~K,AAK", "2.0,101.5", None)
    assert (got["p2"].SIP_s1_PeptideSequences, got["p2"].SIP_s2_PeptideSequences, got["p2"].SIP_s2_log10_precursorIntensities) == ("AAK", "DDK", "0.0") and got["p9"].SIP_s1_PeptideSequences is None
    assert assembly.with_matches(known, psms.limit(0), ["s1"]).count() == 3
