"""Runs read in ranges, by index and as streams, against the spectra that were written."""

import base64
import gzip
import random
import zlib

import numpy as np
import pytest

from spectraloom.sources import runs, spectra

PLAIN = "scan long, charge int, parent_mz double, rt double, peaks array<struct<mz:double,intensity:double>>"


def made(n, seed=1):
    r = random.Random(seed)
    out = []
    for k in range(n):
        peaks = sorted((round(r.uniform(100, 900), 4), round(r.uniform(1, 99), 3)) for _ in range(r.choice([0, 1, 30, 200])))
        level = 1 if k % 4 == 0 else 2
        out.append((3 * k + 5, level, 0 if level == 1 else r.randint(1, 4), None if level == 1 else round(r.uniform(300, 900), 4), round(k * 1.5, 3), peaks))
    return out


def encoded(values, kind):
    return base64.b64encode(zlib.compress(np.array(values, kind).tobytes())).decode()


def mzml_text(found, index=True):
    text, places = '<indexedmzML xmlns="http://psi.hupo.org/ms/mzml"><mzML><referenceableParamGroupList><referenceableParamGroup id="two"><cvParam name="ms level" value="2"/></referenceableParamGroup><referenceableParamGroup id="packed"><cvParam name="zlib compression"/></referenceableParamGroup></referenceableParamGroupList><run><spectrumList count="9">\n', []
    for k, (scan, level, z, mz, rt, peaks) in enumerate(found):
        places.append((scan, len(text.encode())))
        ion = f'<cvParam name="selected ion m/z" value="{mz}"/><cvParam name="charge state" value="{z}"/>' if mz else ""
        of = '<referenceableParamGroupRef ref="two"/>' if level == 2 else '<cvParam name="ms level" value="1"/>'
        arrays = "".join(f'<binaryDataArray><referenceableParamGroupRef ref="packed"/><cvParam name="64-bit float"/><cvParam name="{name}"/><binary>{encoded([p[i] for p in peaks], "<f8")}</binary></binaryDataArray>' for i, name in enumerate(("m/z array", "intensity array")))
        text += f'<spectrum index="{k}" id="controllerType=0 controllerNumber=1 scan={scan}">{of}<cvParam name="scan start time" value="{rt / 60}" unitName="minute"/>{ion}é{arrays}</spectrum>\n'
    text += "</spectrumList></run></mzML>"
    if index:
        at = len(text.encode())
        text += '<indexList count="2"><index name="spectrum">' + "".join(f'<offset idRef="controllerType=0 controllerNumber=1 scan={s}">{p}</offset>' for s, p in places) + f'</index><index name="chromatogram"><offset idRef="TIC">77</offset></index></indexList><indexListOffset>{at}</indexListOffset>'
    return text + "</indexedmzML>"


def mzxml_text(found, index=True):
    """Scans of level 2 stand inside the one of level 1 before them."""
    text, places, open_ = '<mzXML><msRun scanCount="9">\n', [], False
    for scan, level, z, mz, rt, peaks in found:
        if level == 1 and open_:
            text, open_ = text + "</scan>\n", False
        places.append((scan, len(text.encode())))
        pairs = base64.b64encode(np.array(peaks, ">f8").tobytes()).decode()
        parent = f'<precursorMz precursorCharge="{z}">{mz}</precursorMz>' if mz else ""
        text += f'<scan num="{scan}" msLevel="{level}" retentionTime="PT{rt}S">{parent}<peaks precision="64" compressionType="none">{pairs}</peaks>' + ("\n" if level == 1 else "</scan>\n")
        open_ = open_ or level == 1
    text += "</scan></msRun>"
    if index:
        at = len(text.encode())
        text += '<index name="scan">' + "".join(f'<offset id="{s}">{p}</offset>' for s, p in places) + f"</index><indexOffset>{at}</indexOffset>"
    return text + "</mzXML>"


def rows_of(df):
    return sorted((r.scan, r.ms_level, r.charge, r.parent_mz, round(r.rt, 3), [(p.mz, p.intensity) for p in r.peaks]) for r in df.collect())


@pytest.mark.parametrize("kind,text", [("mzML", mzml_text), ("mzXML", mzxml_text)])
def test_ranges_equal_the_whole(spark, tmp_path, kind, text):
    found = made(120)
    path = tmp_path / f"run.{kind}"
    path.write_text(text(found))
    size = path.stat().st_size
    whole = runs.read(spark, str(path))
    assert rows_of(whole) == found and whole.rdd.getNumPartitions() == 1
    four = runs.read(spark, f"file://{path}", range_bytes=-(-size // 4))
    assert four.rdd.getNumPartitions() == 4 and rows_of(four) == found
    assert all(n > 5 for n in four.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect())
    for bytes_ in (997, 4096):
        assert rows_of(runs.read(spark, str(path), range_bytes=bytes_)) == found
    reader = spectra.mzml if kind == "mzML" else spectra.mzxml
    assert rows_of(reader(spark, str(path))) == [x for x in found if x[1] == 2]


@pytest.mark.parametrize("kind,text", [("mzML", mzml_text), ("mzXML", mzxml_text)])
def test_chosen_scans(spark, tmp_path, kind, text):
    found = made(60, 2)
    path = tmp_path / f"run.{kind}"
    path.write_text(text(found))
    some = [found[0][0], found[17][0], found[59][0], 999_999]
    want = [x for x in found if x[0] in some]
    assert rows_of(runs.read(spark, str(path), scans=some)) == want
    places = runs.index_of(str(path), kind.lower(), path.stat().st_size)
    assert len(places) == 60 and runs.RunReader({"path": str(path), "scans": "5,8"}).partitions()[0].places == (places[5], places[8])
    # without an index, or with one that points elsewhere, by reading all
    path.write_text(text(found, index=False))
    assert runs.index_of(str(path), kind.lower(), path.stat().st_size) is None and rows_of(runs.read(spark, str(path), scans=some)) == want
    path.write_text("\n\n" + text(found))
    assert runs.index_of(str(path), kind.lower(), path.stat().st_size) is None and rows_of(runs.read(spark, str(path), scans=some)) == want
    assert runs.read(spark, str(path), scans=[]).collect() == []


def test_packed_files_folders_and_cut_files(spark, tmp_path):
    found = made(30, 3)
    with gzip.open(tmp_path / "b.mzML.gz", "wb") as f:
        f.write(mzml_text(found).encode())
    (tmp_path / "a.mzXML").write_text(mzxml_text(found))
    (tmp_path / "notes.txt").write_text("<spectrum>")
    both = runs.read(spark, str(tmp_path))
    assert rows_of(both) == sorted(found * 2) and {r.file.rsplit("/", 1)[-1] for r in both.select("file").distinct().collect()} == {"a.mzXML", "b.mzML.gz"}
    (tmp_path / "c").mkdir()
    text = mzml_text(found)
    (tmp_path / "c" / "cut.mzML").write_text(text[: text.index(f"scan={found[20][0]}") + 200])
    assert rows_of(runs.read(spark, str(tmp_path / "c"))) == found[:20]
    (tmp_path / "empty").mkdir()
    assert runs.read(spark, str(tmp_path / "empty")).collect() == []
    with pytest.raises(Exception, match="nowhere"):
        runs.read(spark, str(tmp_path / "nowhere.mzML")).collect()


@pytest.mark.parametrize("ending", ["bms1", "bms2", "cms1", "cms2"])
def test_binary_round_trip(spark, tmp_path, ending):
    level = int(ending[-1])
    found = [x for x in made(80, 4) if x[1] == level]
    rows = [(f"/data/{'one' if k % 3 else 'two'}.mzML", s, z, mz, rt, [(a, float(np.float32(b))) for a, b in peaks]) for k, (s, _, z, mz, rt, peaks) in enumerate(found)]
    df = spark.createDataFrame(rows, "file string, " + PLAIN).repartition(5)
    out = str(tmp_path / "out")
    runs.write_binary(df, out, ending)
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == [f"one.{ending}", f"two.{ending}"]
    got = {(r.file.rsplit("/", 1)[-1], r.scan): r for r in spectra.binary_scans(spark, out).collect()}
    assert len(got) == len(rows)
    for file, scan, z, mz, rt, peaks in rows:
        r = got[f"{file[6:9]}.{ending}", scan]
        assert (r.ms_level, r.charge, r.parent_mz) == (level, z, mz if level == 2 else None) and r.rt == pytest.approx(rt, rel=1e-6)
        assert [(p.mz, p.intensity) for p in r.peaks] == peaks
    assert [r.scan for r in spectra.binary_scans(spark, f"{out}/one.{ending}").collect()] == sorted(s for f, s, *_ in rows if "one" in f)
    assert [r.scan for r in spectra.binary_scans(spark, out, scans=[rows[0][1]]).collect()] == [rows[0][1]]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", 1, 2, 500.0, 1.0, [(1.0, 2.0)]), ("b", 2, 2, 500.0, 1.0, [(1.0, 2.0)])], "file string, " + PLAIN)
    with pytest.raises(Exception):
        runs.write_binary(df.withColumn("scan", F.when(F.col("scan") == 2, F.raise_error(F.lit("stop"))).otherwise(F.col("scan")).cast("long")), str(tmp_path / "out"), "bms2")
    assert not (tmp_path / "out").exists() or list((tmp_path / "out").iterdir()) == []
    with pytest.raises(ValueError):
        runs.write_binary(df, str(tmp_path / "out"), "mzML")


def test_mgf_with_ranges_charges_and_odd_times(spark, tmp_path):
    (tmp_path / "a.mgf").write_text("BEGIN IONS\nSCANS=12-15\nCHARGE=2+ and 3+\nRTINSECONDS=90.5-95\nPEPMASS=500.5 11\n100 1\nEND IONS\nBEGIN IONS\nSCANS=F1:x\nRTINSECONDS=late\nPEPMASS=none\n100.5 2e3\nEND IONS\nBEGIN IONS\nEND IONS\n")
    rows = spectra.read(spark, str(tmp_path / "a.mgf")).collect()
    assert [(r.scan, r.charge, r.parent_mz, r.rt, len(r.peaks)) for r in rows] == [(12, 2, 500.5, 90.5, 1), (None, 0, None, None, 1), (None, 0, None, None, 0)]
