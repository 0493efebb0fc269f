import math
import random

import pytest
from pyspark.sql import functions as F

from spectraloom.functions import isotopes, peptides
from spectraloom.operators import joins, proteins, ranking
from spectraloom.sources import readers


def test_windows_merge():
    assert len(joins.mass_windows([-1, 0, 1], 0.01)) == 3
    assert len(joins.mass_windows([-1, 0, 1], 0.6)) == 1


def test_digest_missed_cleavages(spark):
    df = spark.createDataFrame([("p", "MKRPAKLR")], "id string, seq string")
    kept = df.select(peptides.pieces(F.col("seq"), drop_first_m=False).alias("x"), peptides.pieces(F.col("seq")).alias("y")).first()
    assert kept.x == ["MK", "R", "PAK", "LR"] and kept.y == ["K", "R", "PAK", "LR"]
    got = {r.peptide for r in peptides.digest(df, "seq", missed=1, least=3, most=10).collect()}
    assert got == {"PAK", "RPAK", "PAKLR"}


def test_isotopes(spark):
    p = spark.sql("SELECT array(0.9893D, 0.0107D) AS a").select(isotopes.convolve(F.col("a"), F.col("a")).alias("x")).first().x
    assert p == pytest.approx([0.97871449, 0.02117102, 0.00011449])
    m, q = isotopes.power([12.0, 13.003355], [0.9893, 0.0107], 5, 0.0)
    assert sum(q) == pytest.approx(1) and m[1] == pytest.approx(61.003355)


def test_fasta_and_scans(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">P1 first one\nMKR\nPAK\n>P2\n\n>P3 x\nAAA\n")
    got = {r.protein_id: r.sequence for r in readers.fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert got == {"P1": "MKRPAK", "P3": "AAA"}
    (tmp_path / "a.ft2").write_text("H\tx\nS\t7\t500.5\t99\nZ\t2\t999.9\t2\t500.5\t3\t400.1\nI\tRetentionTime\t1.5\nD\tParentScanNumber\t6\n100.1\t5.0\t1\t0\t0\t1\n200.2\t6.5\t1\t0\t0\t2\nS\t8\t300.0\t9\nZ\t0\t0\n")
    rows = readers.scans(spark, str(tmp_path / "a.ft2")).collect()
    assert [(r.scan, r.charge, len(r.peaks), r.peaks[1].z, r.info["ParentScanNumber"]) for r in rows] == [(7, 2, 2, 2, "6")]
    assert [(x.z, x.mz) for x in rows[0].precursors] == [(2, 500.5), (3, 400.1)]


def test_parsimony(spark):
    edges = [("A", 1), ("A", 2), ("B", 1), ("B", 2), ("C", 2), ("D", 3), ("E", 3), ("E", 4), ("F", 5)]
    got = {r.protein_group for r in proteins.parsimony(spark.createDataFrame(edges, "p string, q int"), "p", "q").collect()}
    assert got == {"{A,B}", "E", "F"}


def in_sequence(groups, least, unique):
    """Greedy cover, one protein after the other: first proteins with enough peptides of their own, each of which
    takes away those that have no peptide but its own; then, again and again, the one with the most
    peptides that remains, which takes away all that share a peptide with it; ties by name."""
    chosen, left = [], dict(groups)
    owners: dict = {}
    for p, s in groups:
        for q in s:
            owners.setdefault(q, set()).add(p)
    for p, s in sorted(groups):
        if len(s) >= least and sum(len(owners[q]) == 1 for q in s) >= max(unique, 1):
            chosen.append(p)
            for o in {o for q in s for o in owners[q]}:
                if o == p or o in left and left[o] <= s:
                    left.pop(o, None)
    for p, s in sorted(left.items(), key=lambda x: (-len(x[1]), x[0])):
        if p not in left or sum(len(owners[q]) == 1 for q in s) < unique:
            continue
        if len(s) < least:
            break
        chosen.append(p)
        for o in {o for q in s for o in owners[q]}:
            left.pop(o, None)
    return sorted(chosen)


@pytest.mark.parametrize("at_once", [0, 200_000])
def test_parsimony_equals_the_sequence(spark, monkeypatch, at_once):
    monkeypatch.setattr(proteins, "IN_ORDER", at_once)
    r = random.Random(7)
    for n, m, most, least, unique in ((150, 120, 4, 1, 0), (80, 300, 9, 2, 0), (120, 150, 5, 2, 1), (60, 40, 3, 1, 2)):
        sets = {}
        for k in range(n):
            sets.setdefault(frozenset(min(int(r.expovariate(0.03)), m) for _ in range(r.randint(1, most))), f"p{k:03}")
        edges = [(p, f"q{q}") for s, p in sets.items() for q in s]
        got = proteins.parsimony(spark.createDataFrame(edges * 2, "p string, q string"), "p", "q", least, unique).collect()
        assert sorted(x.protein_group for x in got) == in_sequence([(p, s) for s, p in sets.items()], least, unique)
    chain = [(f"p{k:03}", frozenset(f"q{x}" for x in (k - 1, k) if 0 <= x < 9)) for k in range(10)]
    edges = spark.createDataFrame([(p, q) for p, s in chain for q in s], "p string, q string")
    assert sorted(x.protein_group for x in proteins.parsimony(edges, "p", "q").collect()) == in_sequence(chain, 1, 0)
    assert proteins.parsimony(edges.limit(0), "p", "q").collect() == []


def brute_probabilities(edges, tolerance):
    p = {}
    for a, b, x in edges:
        if None not in (a, b, x):
            p[a, b] = max(p.get((a, b), 0), x)
    owners, parts = {}, {}
    for a, b in p:
        owners.setdefault(b, []).append(a)
        parts.setdefault(a, []).append(b)
    w, old = {(a, b): 1 / len(owners[b]) for a, b in p}, {}
    while True:
        new = {a: 1 - math.prod(1 - w[a, b] * p[a, b] for b in bs) for a, bs in parts.items()}
        for b, others in owners.items():
            total = sum(new[a] for a in others)
            for a in others:
                w[a, b] = new[a] / total if total else 1 / len(others)
        if all(abs(new[a] - old.get(a, -1)) < tolerance for a in new):
            razor = {b: min(others, key=lambda a: (-round(new[a], 6), -len(parts[a]), a)) for b, others in owners.items()}
            return new, w, razor
        old = new


def test_protein_probabilities(spark):
    r = random.Random(3)
    edges = [(f"P{r.randint(0, 199):03}", f"q{min(int(r.expovariate(0.01)), 500)}", round(r.random(), 3)) for _ in range(1500)]
    edges += [("P900", "q900", 0.0), ("P901", "q901", 1.0), ("P901", "q0", 0.5), (None, "q1", 0.9), ("P1", None, 0.9), ("P902", "q902", None)]
    df = spark.createDataFrame(edges, "protein string, peptide string, probability double").repartition(6)
    got = proteins.probabilities(df, "protein", "peptide", "probability", 0.02).collect()
    new, w, razor = brute_probabilities(edges, 0.02)
    assert {(x.protein, x.peptide) for x in got} == set(w) and len(got) == len(w)
    for x in got:
        assert x.protein_probability == pytest.approx(new[x.protein], abs=1e-9) and x.weight == pytest.approx(w[x.protein, x.peptide], abs=1e-9)
        assert x.razor == (razor[x.peptide] == x.protein)
    table = {x.protein: x for x in proteins.protein_probabilities(spark.createDataFrame(got), "protein").collect()}
    assert sum(x.razor_peptides for x in table.values()) == len({b for _, b in w}) and table["P900"].protein_probability == 0
    assert proteins.probabilities(df.limit(0), "protein", "peptide", "probability").collect() == []


def test_fdr_within_ties(spark):
    df = spark.createDataFrame([(1, 9.0, False), (2, 8.0, False), (3, 8.0, True), (4, 7.0, True)], "id int, s double, d boolean")
    assert {r.id for r in ranking.fdr_cutoff(df, "s", "d", 0.1, ["id"]).collect()} == {1, 2, 3}


def test_small_functions(spark):
    r = spark.sql("SELECT '[M~AK]R' AS p").select(peptides.naked(F.col("p")).alias("n"), peptides.ptm_count(peptides.naked(F.col("p"))).alias("k"), peptides.missed_sites(F.lit("AKRCK")).alias("m"), peptides.abundance(F.lit("x_C13_001.020Pct")).alias("a"), peptides.mass_error(F.lit(101.0), F.lit(100.0)).alias("e")).first()
    assert (r.n, r.k, r.m, r.a) == ("M~AK", 1, 2, 1.02) and r.e == pytest.approx(1 - 1.003355)
    assert readers.config("[A]\nx = 1 # c\nx = 2\n[B]\ny{s} = 3") == {"[A]x": "1", "[B]y{s}": "3"}
