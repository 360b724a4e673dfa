import base64
import sqlite3
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold import api
from spectrafold.plans import convert
from spectrafold.sources import container, fastq, imzml, tdf


def write_reads(path, n, end="\n", last=True):
    lines = []
    for k in range(n):
        s = "ATGCN"[: k % 5 + 1] * (k % 7 + 1)
        lines += [f"@A00:12:{k}:{k % 3} 1:N", s, "+", ("F:,#"[k % 4]) * len(s)]
    path.write_bytes((end.join(lines) + (end if last else "")).encode())
    return [(k, *lines[4 * k : 4 * k + 2], lines[4 * k + 3]) for k in range(n)]


@pytest.mark.parametrize("n, end, last", [(1, "\n", True), (512, "\n", True), (1025, "\r\n", True), (513, "\n", False)])
def test_fastq(spark, tmp_path, n, end, last):
    want = write_reads(tmp_path / "a.fastq", n, end, last)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = fastq.read_fastq(spark, f"{tmp_path}/a.fastq").select("read_id", "identifier", "sequence", "quality")
        assert sorted(tuple(r) for r in got.collect()) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fastq_incomplete(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@a\nAT\n+\n")
    with pytest.raises(Exception, match="incomplete read"):
        fastq.read_fastq(spark, f"{tmp_path}/a.fastq").collect()


@pytest.mark.parametrize("mode", ["binary", "json", "yaml"])
def test_fastq_container_round_trip(spark, tmp_path, mode):
    want = write_reads(tmp_path / "x.y.fastq", 1100)
    done = api.convert_files(spark, f"{tmp_path}/x.y.fastq", f"{tmp_path}/out", write_mode=mode).collect()
    assert [r["status"] for r in done] == ["ok"] and done[0]["output"].endswith("/x.y.omg")
    back = api.parse_omg_file(spark, done[0]["output"])
    assert sorted(tuple(r) for r in back.collect()) == want
    assert api.get_entry_number(done[0]["output"]) == 3
    assert api.get_basic_info(done[0]["output"])["omics"] == "Genomics"
    assert sorted(r["read_id"] for r in api.get_entry(spark, done[0]["output"], 1).collect()) == list(range(512, 1024))
    fastq.write_fastq(back.withColumn("file", F.lit("f")), f"{tmp_path}/back")
    assert sorted(tuple(r)[1:] for r in fastq.read_fastq(spark, f"{tmp_path}/back").select("read_id", "identifier", "sequence", "quality").collect()) == sorted(w[1:] for w in want)


def test_api_errors(spark, tmp_path):
    for bad in ([], [f"{tmp_path}/none.fastq"], [str(tmp_path / "a.txt")]):
        with pytest.raises(ValueError):
            api.convert_files(spark, bad, str(tmp_path))
    (tmp_path / "bad.fastq").write_text("@a\nAT\n+\n")
    write_reads(tmp_path / "good.FASTQ", 3)
    done = {r["input"].rsplit("/")[-1]: r for r in api.convert_to_omg(spark, [f"{tmp_path}/bad.fastq", f"{tmp_path}/good.FASTQ"], f"{tmp_path}/o").collect()}
    assert done["bad.fastq"]["status"] == "failed" and done["bad.fastq"]["message"] and done["good.FASTQ"]["status"] == "ok"
    info = api.get_file_info(spark, f"{tmp_path}/good.FASTQ").head()
    assert info["size_bytes"] > 0 and info["size_mb"] == 0.0
    with pytest.raises(ValueError):
        api.parse_omg(spark, done["good.FASTQ"]["output"], read_mode="tape")
    assert api.parse_omg(spark, done["good.FASTQ"]["output"], read_mode="memory").count() == 3
    assert api.get_supported_formats()[".fastq"] == "genomics"


def make_scans(spark, n=40):
    rows = [(k * 3, float(k), 1 if k % 4 == 0 else 2, None, None if k % 4 == 0 else 500.5 + k, 25.0, [100.0 + j + k / 10 for j in range(12)], [float(j * k) for j in range(12)]) for k in range(n)]
    return spark.createDataFrame(rows, "scan_index long, rt float, ms_level int, charge int, precursor_mz float, collision_energy float, mz array<double>, intensity array<double>")


def test_scan_filters(spark):
    rows = [(0, 1, [1.0] * 9, [5.0] * 9), (1, 1, [1.0] * 10, [0.0] * 9 + [0.01]), (2, 1, [1.0] * 10, [0.0099] * 10), (3, -1, [1.0] * 10, [5.0] * 10), (4, None, [1.0] * 10, [5.0] * 10), (5, 3, [1.0] * 10, [float("nan")] * 10)]
    scans = spark.createDataFrame(rows, "scan_index long, ms_level int, mz array<double>, intensity array<double>")
    assert {r["scan_index"]: len(r["mz"]) for r in convert.filter_scans(scans).collect()} == {1: 1, 5: 10}
    assert {r["scan_index"] for r in convert.filter_scans(scans, skip_zero=False).collect()} == {1, 2, 5}


@pytest.mark.parametrize("mode", ["binary", "json", "yaml"])
def test_scan_container(spark, tmp_path, mode):
    make_scans(spark).write.parquet(f"{tmp_path}/run.parquet")
    out = api.convert_files(spark, f"{tmp_path}/run.parquet", f"{tmp_path}/o", mode, precision=0.0001).head()["output"]
    got = {r["block_id"]: r for r in api.parse_omg_file(spark, out).collect()}
    want = {r["scan_index"]: r for r in convert.filter_scans(make_scans(spark)).collect()}
    assert sorted(r["scan_index"] for r in got.values()) == sorted(want)
    for r in got.values():
        w = want[r["scan_index"]]
        assert np.abs(np.array(r["mz"]) - w["mz"]).max() <= 0.000051 and r["ms_level"] == w["ms_level"]
        assert np.abs(np.sqrt(r["intensity"]) - np.sqrt(w["intensity"])).max() <= 0.5
    blocks = spark.read.format("omicsblocks").load(out)
    assert blocks.filter("block_id between 5 and 7").count() == 3
    assert api.get_entry(spark, out, 5).head()["scan_index"] == sorted(want)[5]


def test_empty_and_broken_containers(spark, tmp_path):
    container.register(spark)
    empty = spark.createDataFrame([], "block_id long, payload binary")
    convert.write_container(empty, f"{tmp_path}/e.omg", "Genomics")
    assert api.get_entry_number(f"{tmp_path}/e.omg") == 0 and api.parse_omg_file(spark, f"{tmp_path}/e.omg").count() == 0
    many = spark.range(20000).select(F.col("id").alias("block_id"), F.lit(b"x").alias("payload"))
    convert.write_container(many, f"{tmp_path}/m.omg", "Genomics")
    assert api.get_entry_number(f"{tmp_path}/m.omg") == 20000
    data = (tmp_path / "m.omg").read_bytes()
    for broken in (data[:-1], data[:30], data[:-64] + b"offsetLen:zz".ljust(63) + b"\n", b"x" + data):
        (tmp_path / "b.omg").write_bytes(broken)
        with pytest.raises(ValueError):
            container.block_count(f"{tmp_path}/b.omg")


def write_imzml(folder, storage, kind, compressed, places):
    dtype = {"f32": "<f4", "f64": "<f8", "i32": "<i4", "i64": "<i8"}[kind]
    accession = {v: k for k, v in imzml.TYPES.items()}[kind]
    ibd, spectra, rng = bytearray(b"\0" * 16), [], np.random.default_rng(1)
    want, axis_at = [], None

    def put(x):
        raw = np.asarray(x, dtype).tobytes()
        raw = zlib.compress(raw) if compressed else raw
        at = len(ibd)
        ibd.extend(raw)
        return at, len(raw)

    axis = np.arange(100, 112)
    for k, (x, y, three) in enumerate(places):
        inten = rng.integers(0, 50, 12)
        if storage == "continuous":
            axis_at = axis_at or put(axis)
        mz_at = axis_at if storage == "continuous" else put(axis + k)
        array = lambda ref, at: f'<binaryDataArray encodedLength="0"><referenceableParamGroupRef ref="{ref}"/><cvParam accession="IMS:1000102" value="{at[0]}"/><cvParam accession="IMS:1000103" value="12"/><cvParam accession="IMS:1000104" value="{at[1]}"/><binary /></binaryDataArray>'
        user = "".join(f'<userParam name="3DPosition{c}" value="{v}"/>' for c, v in zip("XYZ", three)) if three else ""
        spectra.append(f'<spectrum id="Scan={k}" index="{k}"><scanList count="1"><scan><cvParam accession="IMS:1000050" value="{x}"/><cvParam accession="IMS:1000051" value="{y}"/>{user}</scan></scanList><binaryDataArrayList count="2">{array("mzArray", mz_at)}{array("intensityArray", put(inten))}</binaryDataArrayList></spectrum>')
        want.append((k, float(x), float(y), tuple(map(float, three)) if three else (None,) * 3, (axis + (0 if storage == "continuous" else k)).astype(float).tolist(), inten.astype(float).tolist()))
    zipped = '<cvParam accession="MS:1000574" name="zlib compression"/>' if compressed else '<cvParam accession="MS:1000576" name="no compression"/>'
    mode = {v: k for k, v in imzml.STORAGE.items()}[storage]
    group = lambda ref: f'<referenceableParamGroup id="{ref}"><cvParam accession="{accession}" name="t"/>{zipped}</referenceableParamGroup>'
    xml = f'<?xml version="1.0"?>\n<mzML><fileDescription><fileContent><cvParam accession="{mode}" name="{storage}"/></fileContent></fileDescription><referenceableParamGroupList>{group("mzArray")}{group("intensityArray")}</referenceableParamGroupList><scanSettingsList><scanSettings><cvParam accession="IMS:1000042" name="max x" value="3"/></scanSettings></scanSettingsList><instrumentConfigurationList><instrumentConfiguration id="i"><cvParam accession="MS:1" name="model"/></instrumentConfiguration></instrumentConfigurationList><run><spectrumList count="{len(places)}">' + "\n".join(spectra) + "</spectrumList></run></mzML>"
    (folder / "img.imzML").write_text(xml)
    (folder / "img.ibd").write_bytes(bytes(ibd))
    return want


@pytest.mark.parametrize("storage", ["continuous", "processed"])
@pytest.mark.parametrize("kind, compressed", [("f32", False), ("f64", True), ("i32", False), ("i64", True)])
def test_imzml(spark, tmp_path, storage, kind, compressed):
    want = write_imzml(tmp_path, storage, kind, compressed, [(1, 1, (0.5, 1.5, 2.5)), (1, 2, None), (2, 1, None)])
    path = f"{tmp_path}/img.imzML"
    info = imzml.header(spark, path)
    assert (info["storage"], info["spectrumCount"], info["maxX"], info["msModel"]) == (storage, 3, "3", "model")
    got = sorted((r["spectrum_id"], r["pos_x"], r["pos_y"], (r["pos_3dx"], r["pos_3dy"], r["pos_3dz"]), r["mz"], r["intensity"]) for r in imzml.read_imzml(spark, path).collect())
    assert got == want
    done = api.convert_files(spark, path, f"{tmp_path}/o").head()
    assert done["status"] == "ok", done["message"]
    back = {r["spectrum_id"]: r for r in api.parse_omg_file(spark, done["output"]).collect()}
    for k, x, y, three, mz, inten in want:
        assert back[k]["pos_x"] == x and (back[k]["pos_3dx"], back[k]["pos_3dy"], back[k]["pos_3dz"]) == three
        assert np.abs(np.array(back[k]["mz"]) - mz).max() <= 0.0006
        assert np.abs(np.array(back[k]["intensity"]) - inten).max() <= (0.08 if storage == "continuous" else 1e-4)


def write_tdf(folder, frames, plain=(), pasef=(), windows=(), info=(), peaks=()):
    folder.mkdir()
    db = sqlite3.connect(folder / "analysis.tdf")
    rows = {"GlobalMetadata": [("SchemaType", "TDF"), ("Other", "x"), ("InstrumentName", "timsTOF")], "Frames": frames, "FrameMsMsInfo": plain, "PasefFrameMsMsInfo": pasef, "DiaFrameMsMsWindows": windows, "DiaFrameMsMsInfo": info}
    for table, schema in tdf.TABLES.items():
        names = [c.split()[0] for c in schema.split(", ") if c != "Row long"]
        db.execute(f"CREATE TABLE {table} ({', '.join(names)})")
        db.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(names))})", rows[table])
    db.commit()
    db.close()


def test_tdf_scans(spark, tmp_path):
    frames = [(1, 4, 0.5, 8), (2, 4, 1.0, 0), (3, 4, 1.5, 8), (4, 4, 2.0, 9), (5, 4, 2.5, 2), (6, 4, 3.0, 9)]
    pasef = [(1, 400.0, 1.0, 0, 3, 20.0), (3, 600.0, 1.0, 2, 4, 21.0), (3, 500.0, 1.0, 0, 1, 22.0)]
    windows, info = [(7, 700.0, 2.0, 1, 2, 30.0), (7, 800.0, 2.0, 3, 3, 31.0)], [(4, 7)]
    write_tdf(tmp_path / "run.d", frames, [(5, 555.0, 3.0, 40.0)], pasef, windows, info)
    tables = tdf.read_tables(spark, f"{tmp_path}/run.d/analysis.tdf")
    facts = tdf.file_info(tables).head()
    assert (facts["SchemaType"], facts["InstrumentName"], facts["frames"], facts["start_time"], facts["end_time"], facts["max_type"]) == ("TDF", "timsTOF", 6, 0.5, 3.0, 9)
    peaks = spark.createDataFrame([(f, s, 100.0 + s, float(f * 10 + s)) for f, *_ in frames for s in range(4)], "frame long, scan_no long, mz double, intensity double")
    got = {(r["frame"], r["isolation_mz"]): (r["ms_level"], r["precursor_mz"], r["mobility_index"]) for r in tdf.scans(tables, peaks).collect()}
    assert got == {(2, -1.0): (1, None, [0, 1, 2, 3]), (3, 500.0): (2, 500.0, [0, 1]), (3, 600.0): (2, 600.0, [2, 3]), (4, 700.0): (2, 700.0, [1, 2]), (4, 800.0): (2, 800.0, [3]), (5, 555.0): (2, 555.0, [0, 1, 2, 3])}
    many = peaks.crossJoin(spark.range(10)).select("frame", "scan_no", (F.col("mz") + F.col("id")).alias("mz"), "intensity")
    many.write.parquet(f"{tmp_path}/run.d/peaks.parquet")
    out = api.convert_files(spark, f"{tmp_path}/run.d", f"{tmp_path}/o").head()
    assert out["status"] == "ok", out["message"]
    back = api.parse_omg_file(spark, out["output"]).orderBy("block_id").collect()
    assert [r["scan_index"] for r in back] == list(range(6)) and [r["precursor_mz"] for r in back] == [None, 500.0, 600.0, 700.0, 800.0, 555.0]
    assert back[0]["mobility_index"][:2] == [0, 0] or len(back[0]["mobility_index"]) == 40


def test_tdf_windows_stay_apart(spark, tmp_path):
    """Windows of equal m/z and energy, and equal windows, are scans of their own."""
    pasef = [(2, 500.0, 1.0, 0, 3, 20.0), (2, 500.0, 1.0, 5, 8, 20.0), (2, 500.0, 1.0, 5, 8, 20.0)]
    write_tdf(tmp_path / "run.d", [(1, 10, 0.5, 0), (2, 10, 1.0, 8)], pasef=pasef)
    tables = tdf.read_tables(spark, f"{tmp_path}/run.d/analysis.tdf")
    peaks = spark.createDataFrame([(2, s, 100.0 + s, 5.0) for s in range(10)], "frame long, scan_no long, mz double, intensity double")
    got = {r["window"]: r["mobility_index"] for r in tdf.scans(tables, peaks).collect()}
    assert got == {1: [0, 1, 2, 3], 2: [5, 6, 7, 8], 3: [5, 6, 7, 8]}


def test_tdf_unknown_type(spark, tmp_path):
    write_tdf(tmp_path / "bad.d", [(1, 2, 0.1, 0), (2, 2, 0.2, 5)])
    tables = tdf.read_tables(spark, f"{tmp_path}/bad.d/analysis.tdf")
    peaks = spark.createDataFrame([(1, 0, 1.0, 1.0)], "frame long, scan_no long, mz double, intensity double")
    with pytest.raises(Exception, match="unsupported frame type"):
        tdf.scans(tables, peaks).collect()


def write_run(spark, folder, axis):
    write_tdf(folder, [(1, 4, 0.5, 0), (2, 4, 61.256, 0)])
    spark.createDataFrame([(f, s, 100.0 + s + k, 5.0) for f in (1, 2) for s in range(4) for k in range(3)], "frame long, scan_no long, mz double, intensity double").write.parquet(f"{folder}/peaks.parquet")
    if axis is not None:
        spark.createDataFrame(axis, "frame long, scan_no long, ook0 double").write.parquet(f"{folder}/axis.parquet")
    return spark


AXIS = [(f, s, 1.5 - s / 8 + f * 1e-8) for f in (1, 2) for s in range(4)]


@pytest.mark.parametrize("mode", ["binary", "json", "yaml"])
def test_tdf_header_and_mobility(spark, tmp_path, mode):
    write_run(spark, tmp_path / "run.d", AXIS)
    done = api.convert_files(spark, f"{tmp_path}/run.d", f"{tmp_path}/o", mode).head()
    assert done["status"] == "ok", done["message"]
    info = api.get_basic_info(done["output"])
    assert (info["scanCount"], info["startTime"], info["endTime"], info["msModel"], info["msDetector"], info["schemaType"]) == ("2", "PT0.50S", "PT61.26S", "timsTOF", "UnKnown", "TDF")
    want = np.array([1.5, 1.375, 1.25, 1.125])
    assert np.allclose(info["mobilityValue"], want, atol=1e-6)
    rows = [*api.parse_omg_file(spark, done["output"]).collect(), *api.get_entry(spark, done["output"], 1).collect()]
    assert len(rows) == 3 and all(np.allclose(r["mobility"], want[r["mobility_index"]], atol=1e-6) and len(r["mobility"]) == 12 for r in rows)


@pytest.mark.parametrize("axis, reason", [([*AXIS[:-1], (2, 3, 1.1250025)], "differ at scan number 3"), (AXIS[1:4], "aren't 0, 1"), (AXIS[:3], "don't fit"), ([*AXIS[:3], (1, 3, None)], "finite"), ([*AXIS[:3], (1, 3, float("inf"))], "finite")])
def test_tdf_bad_axis(spark, tmp_path, axis, reason):
    write_run(spark, tmp_path / "run.d", axis)
    done = api.convert_files(spark, f"{tmp_path}/run.d", f"{tmp_path}/o").head()
    assert done["status"] == "failed" and reason in done["message"]


def test_headers_without_axis(spark, tmp_path):
    write_run(spark, tmp_path / "run.d", None)
    make_scans(spark).write.parquet(f"{tmp_path}/p.parquet")
    write_reads(tmp_path / "r.fastq", 7)
    write_imzml(tmp_path, "continuous", "f32", False, [(1, 1, None), (1, 2, None)])
    text = (tmp_path / "img.imzML").read_text()
    settings = '<cvParam accession="IMS:1000046" name="pixel size" value="50" unitName="micrometer"/></scanSettings>'
    parts = "".join(f'<{t} order="1"><cvParam accession="MS:2" name="{n}"/></{t}>' for t, n in (("source", "MALDI"), ("analyzer", "TOF"), ("detector", "MCP")))
    (tmp_path / "img.imzML").write_text(text.replace("</scanSettings>", settings, 1).replace("</instrumentConfiguration>", f"<componentList>{parts}</componentList></instrumentConfiguration>", 1))
    files = [f"{tmp_path}/{f}" for f in ("run.d", "p.parquet", "r.fastq", "img.imzML")]
    run, scans, reads, image = (r["output"] for r in api.convert_files(spark, files, f"{tmp_path}/o").collect())
    assert api.get_basic_info(run)["mobilityValue"] == "None" and {r["mobility"] for r in api.parse_omg_file(spark, run).collect()} == {None}
    info = api.get_basic_info(scans)
    assert (info["scanCount"], info["startTime"], info["endTime"], info["msModel"]) == (str(api.get_entry_number(scans)), "PT0.00S", "PT39.00S", "UnKnown")
    info = api.get_basic_info(reads)
    assert (info["readCount"], info["readLength"]) == ("7", "1") and info["date"]
    info = api.get_basic_info(image)
    assert (info["scanCount"], info["maxCountofPixel_X"], info["pixelSize_X"], info["pixelSize_Y"], info["maxDimension_X"]) == ("2", "3", "50 micrometer", "", "")
    assert (info["msModel"], info["msIonisation"], info["msMassAnalyzer"], info["msDetector"]) == ("model", "MALDI", "TOF", "MCP") and info["continuousMzCode"] == [float(k) for k in range(100, 112)]


def test_values_without_a_code(spark, tmp_path):
    """A kept NaN has no code in whole numbers: the file fails, and nothing false is written."""
    rows = [(k, float(k), 1, None, None, None, [100.0 + j for j in range(12)], [float("nan") if k == 3 and j == 5 else 4.0 for j in range(12)]) for k in range(5)]
    spark.createDataFrame(rows, make_scans(spark).schema).write.parquet(f"{tmp_path}/nan.parquet")
    done = api.convert_files(spark, f"{tmp_path}/nan.parquet", f"{tmp_path}/o").head()
    assert done["status"] == "failed" and "finite" in done["message"]


@pytest.mark.parametrize("precision", [0.003, 0.5, 2.0])
def test_any_precision(spark, tmp_path, precision):
    make_scans(spark).write.parquet(f"{tmp_path}/run.parquet")
    out = api.convert_files(spark, f"{tmp_path}/run.parquet", f"{tmp_path}/o", precision=precision).head()
    want = {r["scan_index"]: r["mz"] for r in convert.filter_scans(make_scans(spark)).collect()}
    for r in api.parse_omg_file(spark, out["output"]).collect():
        assert np.abs(np.array(r["mz"]) - want[r["scan_index"]]).max() <= precision * 0.5000001


def test_inputs_that_clash(spark, tmp_path):
    write_reads(tmp_path / "x.fastq", 2)
    make_scans(spark).write.parquet(f"{tmp_path}/x.parquet")
    with pytest.raises(ValueError, match="several inputs"):
        api.convert_files(spark, [f"{tmp_path}/x.fastq", f"{tmp_path}/x.parquet"], f"{tmp_path}/o")
    for bad in (0, -1, float("nan")):
        with pytest.raises(ValueError, match="precision"):
            api.convert_files(spark, f"{tmp_path}/x.parquet", f"{tmp_path}/o", precision=bad)


def test_long_imaging_header_and_one_entry(spark, tmp_path):
    want = write_imzml(tmp_path, "continuous", "f32", False, [(1, 1, None), (1, 2, None)])
    text = (tmp_path / "img.imzML").read_text()
    (tmp_path / "img.imzML").write_text(text.replace("<fileDescription>", "<!--" + "x" * (5 << 20) + "--><fileDescription>", 1))
    info = imzml.header(spark, f"{tmp_path}/img.imzML")
    assert (info["storage"], info["spectrumCount"], info["msModel"]) == ("continuous", 2, "model")
    out = api.convert_files(spark, f"{tmp_path}/img.imzML", f"{tmp_path}/o").head()["output"]
    one = api.get_entry(spark, out, 1).collect()
    assert len(one) == 1 and one[0]["mz"] == want[1][4] and len(one[0]["intensity"]) == 12
