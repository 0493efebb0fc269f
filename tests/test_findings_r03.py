"""What the findings of round 3 named, each by a case that failed before."""

import builtins

import pytest

from spectraloom.plans import catalogue


def by_sql(name, folder, *tables):
    """The rows of a query's SQL over the tables of a folder."""
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return con.execute(catalogue.SQL[name]).fetchall()


def test_small_negative_values_round_to_negative_zero(spark, tmp_path):
    spark.createDataFrame([(1, [1e-4, -1e-3]), (2, [0.5, 0.25])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = sorted(by_sql("isotope_convolution", tmp_path, "embeddings"))
    got = sorted((r[0], r[1]) for r in catalogue.isotope_convolution(spark, str(tmp_path)).collect())
    assert repr(got) == repr(want) and "-0.0" in repr(got)


def test_missing_vocabularies_are_an_error(monkeypatch):
    from spectraloom.llm import secrets

    real = builtins.__import__

    def none(name, *args, **kwargs):
        if name == "public_tokenizers":
            raise ModuleNotFoundError(name=name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", none)
    with pytest.raises(ModuleNotFoundError):
        secrets.default_vocabularies()
    assert secrets.dictionary(()) == secrets.RANK


def test_best_in_band_pairs_values_not_rows(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from spectraloom.operators import joins

    deal = random.Random(3)
    left = [(k, k % 7 * 1.5) for k in range(210)] + [(900, None), (901, 50.0)]
    right = [(k, float(deal.randrange(0, 40)) / 4, deal.randrange(5)) for k in range(400)] + [(900, None, 9)]
    a, b = spark.createDataFrame(left, "l long, v double"), spark.createDataFrame(right, "r long, w double, o long")
    pairs, real = [], joins.band_join

    def counted(*args, **kwargs):
        found = real(*args, **kwargs)
        pairs.append(found.count())
        return found

    monkeypatch.setattr(joins, "band_join", counted)
    order = F.col("o") * 1000 + F.col("r")
    met = lambda v: [(abs(w - v), w, o * 1000 + r, r) for r, w, o in right if v is not None and w is not None and abs(w - v) < 1.0]
    for kind, key in (("nearest", lambda x: x[:3]), ("largest", lambda x: (-x[2], x[1]))):
        got = {r[0]: r[1] for r in joins.nearest_join(a, b, "l", "v", "w", 1.0, order, kind).select("l", "r").collect()}
        assert got == {k: min(met(v), key=key)[3] for k, v in left if met(v)}
    assert pairs and max(pairs) <= 7 * 40
    assert joins.nearest_join(a.where("l < 0"), b, "l", "v", "w", 1.0, order).count() == 0


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_containing_reads_no_strings_of_sequences_again(spark):
    from spectraloom.operators import reports

    words = spark.createDataFrame([("ab",), ("bcdefg",), ("zz",), ("",)], "w string")
    rows = [(k, s) for k, s in enumerate(["xabcdefgh", "xabcdefgh", "ab", "azz", None, "xabcdefgh"])]
    got = reports.containing(words, spark.createDataFrame(rows, "k long, s string"), "w", "s")
    assert sorted((r[0], r[1]) for r in got.select("w", "k").collect()) == sorted((w, k) for w in ("ab", "bcdefg", "zz") for k, s in rows if s and w in s)
    assert "Generate" not in planned(got)  # which was broadcast for all proteins, by the size of their file


def test_repeated_spectra_are_scored_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from spectraloom.functions import scoring

    light = scoring.monoisotopic()
    names = ["PEPTIDEK", "SAMPLERK", "PEPTIDEK", "PEPTIDEK"]
    scans = []
    for k, p in enumerate(names):
        b, y = scoring.prefix_masses(p, light)
        ions = sorted(float(m) + scoring.PROTON for m in [*b[:-1], *y[:-1]])
        scans.append((k, 2, float(y[-1]) / 2 + scoring.PROTON, [(m, 100.0 + i, 1) for i, m in enumerate(ions)]))
    found = spark.createDataFrame(scans, "scan long, z int, parent_mz double, peaks array<struct<mz:double,intensity:double,z:int>>")
    masses = spark.createDataFrame([(p, float(scoring.prefix_masses(p, light)[1][-1])) for p in set(names)], "peptide string, mass double")
    blocks, real = [], scoring.score_blocks

    def counted(df, *args, **kwargs):
        blocks.append(df.count())
        return real(df, *args, **kwargs)

    monkeypatch.setattr(scoring, "score_blocks", counted)
    got = scoring.search(found, masses, [(-0.05, 0.05)]).where("rank_wdp = 1").orderBy("scan").collect()
    assert [(r["scan"], r["peptide"]) for r in got] == list(enumerate(names)) and blocks == [2]
    assert len({(r["mvh"], r["xcorr"], r["wdp"]) for r in got if r["peptide"] == "PEPTIDEK"}) == 1


def test_partitions_of_purged_follow_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    from spectraloom.operators import merging

    monkeypatch.setattr(merging, "ROWS", 100, raising=False)
    d = spark.range(1000).select((F.col("id") % 20).alias("g"), (F.col("id") * 7 % 1000).alias("s"), "id")
    got = merging.purged(d, ["g"], ["s"], ["id"], 10, 5)
    assert got.count() == 100 and "REPARTITION_BY_NUM" in planned(got) and ", 10), REPARTITION" in planned(got)


def test_result_lines_deal_numbers(spark):
    plan = planned(catalogue.result_lines(spark, "/root/testdata/sf0.001"))
    assert plan.count("Exchange") == 1 and "hashpartitioning(l_orderkey" in plan


def test_long_stretches_are_not_held():
    import random

    from spectraloom.operators.rescoring import Merger

    deal = random.Random(5)

    def plain(values, threshold):
        held = [[v] for v in values]
        mean = lambda x: sum(x) / len(x)
        while len(held) > 1:
            gap, at = min((mean(b) - mean(a), i) for i, (a, b) in enumerate(zip(held, held[1:])))
            if gap > threshold:
                break
            held[at : at + 2] = [held[at] + held[at + 1]]
        return [(len(x), round(mean(x), 9)) for x in held]

    for _ in range(300):
        values = sorted({deal.random() * 20 for _ in range(deal.randrange(1, 40))})
        merger, got = Merger(1.0), []
        for v in values:
            got += merger.add(v, 1)
        assert [(n, round(m, 9)) for n, m, _ in got + merger.settle()] == plain(values, 1.0)
    merger, most, n = Merger(5.0), 0, 0
    for v in sorted({deal.randrange(2_000_000) / 100 for _ in range(20_000)}):
        n += len(merger.add(v, 1))
        most = max(most, len(merger.held))
    assert most < 50 and n > 1000


def test_ladders_and_shares_of_lists():
    from spectraloom.operators import envelopes

    mz = [500.0 + k * 1.003355 / 2 for k in range(4)]
    assert envelopes.ladder(mz, [4.0, 3.0, 2.0, 1.0], 0, 2) == [0, 1, 2, 3]
    light = envelopes.lightest("PEPTIDEK", 2)
    assert envelopes.enrichment("PEPTIDEK", mz, [4.0, 3.0, 2.0, 1.0], 2, light=light) == envelopes.enrichment("PEPTIDEK", mz, [4.0, 3.0, 2.0, 1.0], 2)


def test_substitutions_split_only_residues_that_cut(spark):
    from spectraloom.functions import variants

    d = spark.createDataFrame([(1, "AKC"), (2, ""), (3, None)], "k long, p string")
    got = variants.substituted(d, "p", "CK")
    assert sorted(tuple(r) for r in got.drop("p").collect()) == [(1, 1, "C", "CKC", "CKC"), (1, 1, "K", "KKC", "C"), (1, 1, "K", "KKC", "K"), (1, 1, "K", "KKC", "K"), (1, 2, "C", "ACC", "ACC"), (1, 3, "K", "AKK", "AKK")]
    assert planned(got).count("split(") == 1 and "Union" in planned(got)


def test_parsimony_rounds_move_numbers(spark, monkeypatch):
    """Names are saved once, a row for each group; what the rounds save are numbers and peptides."""
    import random

    from spectraloom.operators import proteins

    deal, kept, real = random.Random(5), [], proteins.saved

    def noted(df):
        out = real(df)
        kept.append((out.dtypes, out.count()))
        return out

    monkeypatch.setattr(proteins, "saved", noted)
    monkeypatch.setattr(proteins, "IN_ORDER", 0)
    edges = [(f"p{k}", q) for k in range(300) for q in deal.sample(range(40), 4)]
    sets = {frozenset(q for p, q in edges if p == name) for name in {p for p, _ in edges}}
    proteins.parsimony(spark.createDataFrame(edges, "p string, q int"), "p", "q", 2, 0).collect()
    assert [n for types, n in kept if "string" in dict(types).values()] == [len(sets)]


def test_all_documents_of_a_hot_seed_meet(spark, monkeypatch):
    """Passages whose every seed stands in many documents, or twice in one, are found wherever they are."""
    import random

    from spectraloom.llm import chaining

    r = random.Random(6)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    lines = [fresh(5) for _ in range(8)]
    joined = lambda of: [w for line in of for w in line + fresh(1)]
    apart = lambda of: [w for line in r.sample(of, len(of)) for w in line + fresh(40)]
    texts = {i: fresh(9) + (joined(lines) if i in (20, 30) else apart(lines)) + fresh(9) for i in range(40)}
    common = fresh(40)
    texts |= {i: fresh(20) + common + fresh(20) for i in range(100, 112)}
    twice = [fresh(5) for _ in range(8)]
    texts |= {200: apart(twice) + joined(twice), 201: fresh(9) + joined(twice)}
    want = {(30, 20), (201, 200)} | {(i, k) for i in range(100, 112) for k in range(100, i)}
    for held in (chaining.BUFFER, 100):
        monkeypatch.setattr(chaining, "BUFFER", held)
        df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(3)
        assert {(x.doc_id, x.other_id) for x in chaining.passages(df).collect()} == want
