import base64
import random
import zlib

import numpy as np
import pytest

from spectraloom.operators import rescoring
from spectraloom.sources import spectra
from spectraloom.store import checkpointed

MZ, HEIGHT = [100.5, 200.25, 300.125], [1.0, 2.5, 7.0]


def check(rows):
    assert [(r.scan, r.charge, r.parent_mz, r.rt) for r in rows] == [(7, 2, 500.5, 90.0)]
    assert [(p.mz, p.intensity) for p in rows[0].peaks] == list(zip(MZ, HEIGHT))


def test_mgf(spark, tmp_path):
    body = "\n".join(f"{m} {h}" for m, h in zip(MZ, HEIGHT))
    (tmp_path / "a.mgf").write_text(f"COM=x\nBEGIN IONS\nTITLE=a=b\nSCANS=7\nCHARGE=2+\nRTINSECONDS=90\nPEPMASS=500.5 11\n{body}\nEND IONS\n\n")
    rows = spectra.read(spark, str(tmp_path / "a.mgf")).collect()
    check(rows)
    assert rows[0].title == "a=b"
    spectra.write_mgf(spectra.mgf(spark, str(tmp_path / "a.mgf")), str(tmp_path / "out"))
    assert [p.mz for p in spectra.mgf(spark, str(tmp_path / "out")).first().peaks] == MZ


def test_mzml(spark, tmp_path):
    def array(values, kind):
        text = base64.b64encode(zlib.compress(np.array(values, "<f8").tobytes())).decode()
        return f'<binaryDataArray><cvParam name="64-bit float"/><cvParam name="zlib compression"/><cvParam name="{kind}"/><binary>{text}</binary></binaryDataArray>'

    one = lambda n, level: f'<spectrum index="{n}" id="controllerType=0 scan={n}"><cvParam name="ms level" value="{level}"/><cvParam name="scan start time" value="1.5" unitName="minute"/><cvParam name="selected ion m/z" value="500.5"/><cvParam name="charge state" value="2"/>{array(MZ, "m/z array")}{array(HEIGHT, "intensity array")}</spectrum>'
    (tmp_path / "a.mzML").write_text(f'<mzML xmlns="http://psi.hupo.org/ms/mzml"><run><spectrumList>{one(6, 1)}{one(7, 2)}</spectrumList></run></mzML>')
    check(spectra.read(spark, str(tmp_path / "a.mzML")).collect())
    assert spectra.mzml(spark, str(tmp_path / "a.mzML"), None).count() == 2


def test_mzxml(spark, tmp_path):
    text = base64.b64encode(np.array(list(zip(MZ, HEIGHT)), ">f4").tobytes()).decode()
    (tmp_path / "a.mzXML").write_text(f'<mzXML><msRun><scan num="6" msLevel="1"><peaks precision="32"></peaks><scan num="7" msLevel="2" retentionTime="PT90S"><precursorMz precursorCharge="2">500.5</precursorMz><peaks precision="32">{text}</peaks></scan></scan></msRun></mzXML>')
    check(spectra.read(spark, str(tmp_path / "a.mzXML")).collect())


def brute(values, threshold):
    parts = [[v] for v in sorted(values)]
    while len(parts) > 1:
        means = [sum(p) / len(p) for p in parts]
        gap, i = min((means[i + 1] - means[i], i) for i in range(len(parts) - 1))
        if gap > threshold:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [(len(p), round(sum(p) / len(p), 6)) for p in parts]


def test_clusters(spark):
    r = random.Random(3)
    data = {g: [r.uniform(0, 100) for _ in range(n)] for g, n in (("a", 60), ("b", 1), ("c", 25))}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs] + [("a", None)], "g string, v double")
    rows = rescoring.clusters(df, "g", "v", 5.0).orderBy("g", "cluster").collect()
    for g, vs in data.items():
        assert [(x.n, round(x.mean, 6)) for x in rows if x.g == g] == brute(vs, 5.0)
    assert rescoring.clusters(df.limit(0), "g", "v", 5.0).count() == 0


def test_semi_supervised(spark):
    r = np.random.default_rng(5)
    rows = []
    for i in range(600):
        decoy, right = i % 2 == 1, i % 4 == 0
        # One feature alone leaves many right rows among the decoys.
        a, b = r.normal(2 if right else 0), r.normal(2 if right else 0)
        rows.append((i, decoy, float(a), float(b)))
    df = spark.createDataFrame(rows, "id long, is_decoy boolean, a double, b double")
    before = rescoring.ranking.q_values(df, "a", "is_decoy").where("not is_decoy and q_value <= 0.05").count()
    got = rescoring.semi_supervised(df, ["a", "b"], "a", ["id"], rounds=1, at=0.05)
    assert got.count() == 600
    assert got.where("not is_decoy and q_value <= 0.05").count() > before


def test_folds_rank_as_one_model(spark):
    """Folds whose models differ in scale (one of them trains on few rows) rank, levelled, nearly as one
    model does that sees all rows: as many targets are found to within a tenth."""
    r = np.random.default_rng(8)
    rows = [(i, i % 2 == 1, float(r.normal(3 if i % 4 == 0 else 0)), float(r.normal(3 if i % 4 == 0 else 0)), float(r.normal())) for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, is_decoy boolean, a double, b double, c double")
    found = lambda x: x.where("not is_decoy and q_value <= 0.05").count()
    got = checkpointed(rescoring.semi_supervised(df, ["a", "b", "c"], "a", ["id"], rounds=1, folds=2, at=0.05))
    one = rescoring.trained(df, "a", "is_decoy", 0.05)
    whole = rescoring.ranking.q_values(rescoring.logistic(one, df, ["a", "b", "c"], "_label", name="s", margin=True), "s", "is_decoy")
    assert got.count() == 1200 and abs(found(got) - found(whole)) <= 0.1 * found(whole) and found(got) > 200
    # the same scores in other units rank as before once they are levelled
    parts = [got.where("id % 3 = 0"), got.where("id % 3 <> 0").withColumn("rescored", 7 * got["rescored"] + 100)]
    apart = found(rescoring.ranking.q_values(parts[0].unionByName(parts[1]).drop("q_value"), "rescored", "is_decoy"))
    even = [rescoring.levelled(p.drop("q_value"), "rescored", "is_decoy", 0.05) for p in parts]
    level = found(rescoring.ranking.q_values(even[0].unionByName(even[1]), "rescored", "is_decoy"))
    assert abs(level - found(got)) <= 0.1 * found(got) and level > apart
    # nearly no weight is left at the smallest cost, so the other is taken
    train = rescoring.trained(df.withColumn("_fold", df["id"] % 3), "a", "is_decoy", 0.05).where("_fold <> 0")
    assert rescoring.best_cost(train, ["a", "b"], "is_decoy", 0, 3, 0.05, (1.0,)) == 1.0 and rescoring.best_cost(train, ["c"], "is_decoy", 0, 3, 0.05, (2.0, 1.0)) in (1.0, 2.0)


def test_pepxml(spark):
    import xml.etree.ElementTree as ET

    df = spark.createDataFrame([("f", 3, 2, 1, False, 900.0, 900.1, "A<K", ["P&1", "P2"], 4.5)], "file string, scan int, charge int, rank int, is_decoy boolean, calculated_mass double, parent_mass double, peptide string, proteins array<string>, wdp double")
    node = ET.fromstring(spectra.pepxml(df.withColumnRenamed("calculated_mass", "mass"), ["wdp"]).first().xml)
    assert node.find(".//search_hit").get("protein") == "P&1" and node.find(".//search_score").get("value") == "4.5"
