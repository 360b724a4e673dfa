"""Queries that go through the sources, the container and the API: files made from the driver's tables, read back, beside SQL over the tables."""

from __future__ import annotations

import os
import sqlite3

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..functions import columns as C
from ..operators import peaks as P
from ..sources import container, fastq, imzml, tdf
from ..workspace import Workspace
from . import convert
from .queries import _BACK, _scans, peaks, query, table


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder of files, on storage that driver and executors mount."""
    work = Workspace(spark, name)
    path = container.mounted(work.root)
    os.makedirs(path)
    work.expire()
    return path


# Sequencing reads: turns of conversations, a read each.


def _turns(spark, d) -> DataFrame:
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x1f]", " ")
    return table(spark, d, "conversations").select(F.lit("f").alias("file"), (F.col("conv_id") * 1000 + F.col("turn")).alias("read_id"), F.concat(F.lit("@c:"), "conv_id", F.lit(":"), "turn").alias("identifier"), text.alias("sequence"), F.repeat(F.lit("F"), F.length(text)).alias("quality"))


_READS = "SELECT '@c:' || conv_id || ':' || turn AS identifier, regexp_replace(coalesce(text, ''), '[\\x00-\\x1f]', ' ', 'g') AS sequence, repeat('F', length(coalesce(text, ''))) AS quality FROM conversations"


@query(_READS)
def fastq_roundtrip(spark, d):
    """Written as FASTQ text and read in splits."""
    path = f"{Workspace(spark, 'fastq').root}/reads.fastq"
    fastq.write_fastq(_turns(spark, d), path)
    return fastq.read_fastq(spark, path).select("identifier", "sequence", "quality")


@query(_READS)
def reads_container(spark, d):
    """FASTQ text, converted to a container by the API and parsed."""
    folder = _folder(spark, "reads")
    fastq.write_fastq(_turns(spark, d), f"file://{folder}/reads.fastq")
    done = api.convert_files(spark, f"{folder}/reads.fastq", f"{folder}/out").head()
    return api.parse_omg_file(spark, done["output"]).select("identifier", "sequence", "quality")


# Scans of peaks, in containers.


def _run(spark, d, folder: str, mode: str = "binary") -> str:
    """The scans as a Parquet table, converted by the API."""
    _scans(spark, d).write.parquet(f"file://{folder}/run.parquet")
    return api.convert_files(spark, f"{folder}/run.parquet", f"{folder}/out", mode).head()["output"]


def _flat(scans: DataFrame) -> DataFrame:
    flat = scans.select(F.col("scan_index").cast("long").alias("block"), F.posexplode(F.arrays_zip("mz", "intensity")).alias("i", "p"))
    return flat.select("block", F.col("i").cast("long").alias("i"), C.mz_quantize(F.col("p.mz")).alias("q"), F.col("p.intensity").cast("long").alias("x"))


@query(_BACK)
def container_roundtrip(spark, d):
    """Converted to one container file and parsed in memory mode."""
    return _flat(api.parse_omg_file(spark, _run(spark, d, _folder(spark, "run")), read_mode="memory"))


@query(_BACK)
def container_folder_roundtrip(spark, d):
    """Container files written by tasks, block ids running through them."""
    path = f"{_folder(spark, 'run')}/blocks.omg"
    container.register(spark)
    convert.write_container(convert.encode_scans(convert.filter_scans(_scans(spark, d))), path, "Proteomics", folder=True)
    return _flat(api.parse_omg_file(spark, path))


@query(f"SELECT block AS scan_index, count(*) AS n, min(CAST(round(mz * 1000) AS BIGINT)) AS least FROM {_BACK.partition('FROM ')[2]} GROUP BY block")
def pruned_decode(spark, d):
    """Only the m/z arrays are decoded."""
    scans = api.parse_omg_file(spark, _run(spark, d, _folder(spark, "run"), "json"), columns=["scan_index", "mz"])
    return scans.select(F.col("scan_index").cast("long").alias("scan_index"), F.size("mz").cast("long").alias("n"), F.round(F.array_min("mz") * 1000).cast("long").alias("least"))


_ENTRY = _BACK.partition("FROM ")[2]


@query(f"SELECT block, q, count(*) AS n FROM (SELECT block, CAST(round(mz * 1000) AS BIGINT) AS q FROM {_ENTRY} WHERE block = (SELECT l_suppkey FROM (SELECT DISTINCT l_suppkey FROM lineitem) ORDER BY l_suppkey LIMIT 1 OFFSET 4)) GROUP BY ALL")
def entry_of_container(spark, d):
    """The fifth entry, whose block alone is read."""
    # entries are numbered in order of the scans' numbers
    one = api.get_entry(spark, _run(spark, d, _folder(spark, "run"), "yaml"), 4)
    flat = one.select(F.col("scan_index").cast("long").alias("block"), F.explode("mz").alias("mz"))
    return flat.groupBy("block", F.round(F.col("mz") * 1000).cast("long").alias("q")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT l_suppkey) AS entries FROM lineitem")
def entry_count(spark, d):
    """From the trailer alone."""
    n = api.get_entry_number(_run(spark, d, _folder(spark, "run")))
    return spark.range(1).select(F.lit(n).cast("long").alias("entries"))


@query("""SELECT key, value FROM (SELECT unnest(['omics', 'scanCount', 'startTime', 'endTime', 'msModel', 'msDetector', 'msIonisation', 'msMassAnalyzer', 'mobilityValue', 'parentFormat', 'precision', 'writeFormat']) AS key,
 unnest(['Proteomics', CAST(count(DISTINCT l_suppkey) AS VARCHAR), 'PT1.50S', 'PT1.50S', 'UnKnown', 'UnKnown', 'UnKnown', 'UnKnown', 'None', 'parquet', '0.001', 'binary']) AS value FROM lineitem)""")
def basic_info(spark, d):
    """The header of a converted run, without the date and the path."""
    info = api.get_basic_info(_run(spark, d, _folder(spark, "run")))
    rows = [(k, str(v)) for k, v in info.items() if k in ("omics", "scanCount", "startTime", "endTime", "msModel", "msDetector", "msIonisation", "msMassAnalyzer", "mobilityValue", "parentFormat", "precision", "writeFormat")]
    return spark.createDataFrame(rows, "key string, value string")


@query("SELECT 1 - count(*) // 1000000000 AS files, true AS sized FROM region")
def file_info(spark, d):
    """Size and time of a file that the API reports."""
    got = api.get_file_info(spark, f"{d}/region.parquet")
    return got.agg(F.count(F.lit(1)).alias("files"), F.bool_and((F.col("size_bytes") > 0) & (F.col("size_mb") >= 0) & F.col("modified").isNotNull()).alias("sized"))


# Frames: one for each nation; peaks are line items, dealt by supplier.

_FRAMES = 25
#: Window rows of every fragment frame: m/z, first and last scan number; two of equal m/z, two equal ones.
_WINDOWS = [(500.0, 0, 1), (500.0, 2, 3), (600.0, 2, 3), (600.0, 2, 3), (700.0, 4, 7)]


def _tdf(spark, d, kinds) -> tuple[str, DataFrame]:
    """A run's folder whose frame n (from 1) has the kind ``kinds(n)``, and its peaks."""
    folder = f"{_folder(spark, 'tdf')}/run.d"
    os.makedirs(folder)
    with sqlite3.connect(f"{folder}/analysis.tdf") as db:
        for name, schema in tdf.TABLES.items():
            db.execute(f"CREATE TABLE {name} ({', '.join(c.split()[0] for c in schema.split(', ') if c != 'Row long')})")
        frames = [(n, 8, (n - 1) * 0.5, kinds(n)) for n in range(1, _FRAMES + 1)]
        db.executemany("INSERT INTO GlobalMetadata VALUES (?, ?)", [("SchemaType", "TDF"), ("InstrumentName", "maker"), ("Other", "x")])
        db.executemany("INSERT INTO Frames VALUES (?, ?, ?, ?)", frames)
        db.executemany("INSERT INTO PasefFrameMsMsInfo VALUES (?, ?, ?, ?, ?, ?)", [(n, mz, 1.0, lo, hi, 20.0) for n, _, _, kind in frames if kind == 8 for mz, lo, hi in _WINDOWS])
        db.executemany("INSERT INTO FrameMsMsInfo VALUES (?, ?, ?, ?)", [(n, 450.0, 1.0, 21.0) for n, _, _, kind in frames if kind == 2])
        db.executemany("INSERT INTO DiaFrameMsMsInfo VALUES (?, ?)", [(n, 7) for n, _, _, kind in frames if kind == 9])
        db.execute("INSERT INTO DiaFrameMsMsWindows VALUES (7, 800.0, 2.0, 1, 8, 22.0)")
    rows = peaks(spark, d).select((F.col("block") % _FRAMES + 1).cast("long").alias("frame"), (F.col("l") - 1).alias("scan_no"), "mz", "intensity")
    return folder, rows


def _kinds(n: int) -> int:
    return (8, 0, 8, 9, 2)[n % 5]


_MADE = f"""frames AS (SELECT unnest(range(1, {_FRAMES + 1})) AS frame),
 kinds AS (SELECT frame, [8, 0, 8, 9, 2][CAST(frame % 5 + 1 AS INT)] AS kind FROM frames),
 peaks AS (SELECT CAST(l_suppkey % {_FRAMES} + 1 AS BIGINT) AS frame, CAST(l_linenumber - 1 AS BIGINT) AS scan_no, l_extendedprice AS mz FROM lineitem),
 windows AS (SELECT 8 AS kind, unnest([500.0, 500.0, 600.0, 600.0, 700.0]) AS iso, unnest([0, 2, 2, 2, 4]) AS lo, unnest([1, 3, 3, 3, 7]) AS hi
  UNION ALL VALUES (9, 800.0, 1, 7), (2, 450.0, 0, 7), (0, -1.0, 0, 7))"""


@query(f"""WITH {_MADE} SELECT frame, ms_level, isolation_mz, n, scans, copies, count(*) AS times FROM
 (SELECT k.frame, CASE WHEN k.kind = 0 THEN 1 ELSE 2 END AS ms_level, CAST(w.iso AS DOUBLE) AS isolation_mz, w.lo, count(*) AS n, CAST(sum(p.scan_no) AS BIGINT) AS scans, 1 AS copies
  FROM kinds k JOIN windows w ON k.kind = w.kind JOIN peaks p ON p.frame = k.frame AND p.scan_no BETWEEN w.lo AND w.hi WHERE NOT (k.kind = 8 AND w.iso = 600.0) GROUP BY ALL
  UNION ALL SELECT k.frame, 2, 600.0, 2, count(*), CAST(sum(p.scan_no) AS BIGINT), 1 FROM kinds k JOIN peaks p ON p.frame = k.frame AND p.scan_no BETWEEN 2 AND 3 WHERE k.kind = 8 GROUP BY ALL
  UNION ALL SELECT k.frame, 2, 600.0, 2, count(*), CAST(sum(p.scan_no) AS BIGINT), 1 FROM kinds k JOIN peaks p ON p.frame = k.frame AND p.scan_no BETWEEN 2 AND 3 WHERE k.kind = 8 GROUP BY ALL)
 GROUP BY ALL""")
def tdf_scans(spark, d):
    """Scans of frames of all kinds; windows of equal m/z, and equal windows, are scans of their own."""
    folder, rows = _tdf(spark, d, _kinds)
    made = tdf.scans(tdf.read_tables(spark, f"{folder}/analysis.tdf"), rows)
    each = made.select("frame", "ms_level", "isolation_mz", F.size("mz").cast("long").alias("n"), F.aggregate("mobility_index", F.lit(0).cast("long"), lambda s, x: s + x).alias("scans"), F.lit(1).alias("copies"))
    return each.groupBy("frame", "ms_level", "isolation_mz", "n", "scans", "copies").agg(F.count(F.lit(1)).alias("times"))


@query(f"SELECT 'TDF' AS schema_type, 'maker' AS instrument, {_FRAMES} AS frames, 0.0::DOUBLE AS start_time, {(_FRAMES - 1) * 0.5}::DOUBLE AS end_time, 9 AS max_type")
def tdf_file_info(spark, d):
    folder, _ = _tdf(spark, d, _kinds)
    got = tdf.file_info(tdf.read_tables(spark, f"{folder}/analysis.tdf"))
    return got.select(F.col("SchemaType").alias("schema_type"), F.col("InstrumentName").alias("instrument"), F.col("frames").cast("int").alias("frames"), "start_time", "end_time", F.col("max_type").cast("int").alias("max_type"))


_AXIS = [1.5 - k / 8 for k in range(8)]


@query(f"WITH {_MADE} SELECT frame, scan_no, CAST(1.5 - scan_no / 8.0 AS DOUBLE) AS mobility, count(*) AS n FROM peaks GROUP BY ALL")
def mobility_decode(spark, d):
    """A run with a mobility axis, converted and parsed: 1/K0 of every peak by the header's axis."""
    folder, rows = _tdf(spark, d, lambda n: 0)
    rows.write.parquet(f"file://{folder}/peaks.parquet")
    axis = spark.range(_FRAMES * len(_AXIS)).select((F.floor(F.col("id") / len(_AXIS)) + 1).alias("frame"), (F.col("id") % len(_AXIS)).alias("scan_no"))
    axis.withColumn("ook0", F.lit(1.5) - F.col("scan_no") / 8).write.parquet(f"file://{folder}/axis.parquet")
    done = api.convert_files(spark, folder, f"{os.path.dirname(folder)}/out").head()
    back = api.parse_omg_file(spark, done["output"], columns=["scan_index", "mobility_index", "mobility"])
    each = back.select((F.col("scan_index") + 1).cast("long").alias("frame"), F.explode(F.arrays_zip("mobility_index", "mobility")).alias("p"))
    return each.select("frame", F.col("p.mobility_index").alias("scan_no"), F.col("p.mobility").cast("double").alias("mobility")).groupBy("frame", "scan_no", "mobility").agg(F.count(F.lit(1)).alias("n"))


_OOK0 = f"(1.5 - (l_linenumber - 1) / 8.0 + CASE WHEN l_suppkey % {_FRAMES} = 3 AND l_linenumber = 3 THEN 0.01 ELSE 0 END)"


@query(f"SELECT CAST(l_linenumber - 1 AS BIGINT) AS scan_no, count(DISTINCT floor({_OOK0} * 1000000)) AS kinds FROM lineitem GROUP BY ALL HAVING count(DISTINCT floor({_OOK0} * 1000000)) > 1")
def axis_check_tdf(spark, d):
    """Scan numbers at which the frames' mobility axes differ, by the check that a conversion makes."""
    li = table(spark, d, "lineitem")
    bump = F.when((F.col("l_suppkey") % _FRAMES == 3) & (F.col("l_linenumber") == 3), 0.01).otherwise(0.0)
    axis = li.select((F.col("l_linenumber") - 1).cast("long").alias("scan_no"), (F.lit(1.5) - (F.col("l_linenumber") - 1) / 8 + bump).alias("ook0"))
    return P.axes_agree(axis, "scan_no", "ook0")


# Imaging spectra: one for each nation.


def _imaging(spark, d, continuous: bool) -> str:
    """An imzML file and its arrays; a spectrum's intensities come from its nation's key."""
    folder = _folder(spark, "imaging")
    keys = sorted(r[0] for r in table(spark, d, "nation").select("n_nationkey").collect())  # 25 rows
    ibd, spectra, mode = bytearray(16), [], {v: k for k, v in imzml.STORAGE.items()}["continuous" if continuous else "processed"]

    def put(x) -> str:
        raw, at = np.asarray(x, "<f8").tobytes(), len(ibd)
        ibd.extend(raw)
        return f'<cvParam accession="{imzml.OFFSET}" value="{at}"/><cvParam accession="{imzml.LENGTH}" value="{len(x)}"/><cvParam accession="{imzml.ENCODED}" value="{len(raw)}"/>'

    shared = put(np.arange(100.0, 112.0))
    for place, k in enumerate(keys):
        arrays = [("mzArray", shared if continuous else put(np.arange(100.0, 112.0) + k)), ("intensityArray", put(np.arange(12.0) * (k + 1)))]
        listed = "".join(f'<binaryDataArray><referenceableParamGroupRef ref="{ref}"/>{at}<binary/></binaryDataArray>' for ref, at in arrays)
        scan = f'<scan><cvParam accession="IMS:1000050" value="{place % 5 + 1}"/><cvParam accession="IMS:1000051" value="{place // 5 + 1}"/></scan>'
        spectra.append(f'<spectrum id="s{place}" index="{place}"><scanList>{scan}</scanList><binaryDataArrayList>{listed}</binaryDataArrayList></spectrum>')
    groups = "".join(f'<referenceableParamGroup id="{ref}"><cvParam accession="MS:1000523" name="64-bit float"/></referenceableParamGroup>' for ref in ("mzArray", "intensityArray"))
    parts = "".join(f'<{t}><cvParam accession="MS:1" name="{n}"/></{t}>' for t, n in (("source", "laser"), ("analyzer", "tube"), ("detector", "plate")))
    settings = "".join(f'<cvParam accession="{a}" value="5" unitName="micrometer"/>' for a in imzml.SETTINGS)
    head = f'<mzML><fileDescription><cvParam accession="{mode}"/></fileDescription>{groups}<scanSettings>{settings}</scanSettings><instrumentConfiguration id="i"><cvParam accession="MS:1" name="maker"/>{parts}</instrumentConfiguration>'
    with open(f"{folder}/image.imzML", "w") as f:
        f.write(f'<?xml version="1.0"?>\n{head}<run><spectrumList count="{len(keys)}">' + "\n".join(spectra) + "</spectrumList></run></mzML>")
    with open(f"{folder}/image.ibd", "wb") as f:
        f.write(ibd)
    return f"{folder}/image.imzML"


_PLACED = f"SELECT spectrum_id, CAST(spectrum_id % 5 + 1 AS DOUBLE) AS pos_x, CAST(spectrum_id // 5 + 1 AS DOUBLE) AS pos_y, i, CAST(100 + i + {{}} AS BIGINT) AS mz, CAST(i * (k + 1) AS BIGINT) AS intensity FROM (SELECT r AS spectrum_id, k, unnest(range(0, 12)) AS i FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS r, n_nationkey AS k FROM nation))"


def _image_rows(spectra: DataFrame) -> DataFrame:
    each = spectra.select("spectrum_id", F.col("pos_x").cast("double").alias("pos_x"), F.col("pos_y").cast("double").alias("pos_y"), F.posexplode(F.arrays_zip("mz", "intensity")).alias("i", "p"))
    return each.select("spectrum_id", "pos_x", "pos_y", F.col("i").cast("long").alias("i"), F.round("p.mz").cast("long").alias("mz"), F.round("p.intensity").cast("long").alias("intensity"))


@query(_PLACED.format("k"))
def imzml_spectra(spark, d):
    """Spectra of a processed file, arrays from the external file."""
    return _image_rows(imzml.read_imzml(spark, _imaging(spark, d, False)))


@query(_PLACED.format("k"))
def imaging_container(spark, d):
    """A processed file, converted and parsed; values are rounded to whole numbers."""
    done = api.convert_files(spark, path := _imaging(spark, d, False), f"{os.path.dirname(path)}/out").head()
    return _image_rows(api.parse_omg_file(spark, done["output"]))


@query(_PLACED.format("0"))
def imaging_container_continuous(spark, d):
    """A continuous file, whose axis comes from the header."""
    done = api.convert_files(spark, path := _imaging(spark, d, True), f"{os.path.dirname(path)}/out", "json").head()
    return _image_rows(api.parse_omg_file(spark, done["output"]))


@query("""SELECT unnest(['storage', 'scanCount', 'msModel', 'msIonisation', 'msMassAnalyzer', 'msDetector', 'pixelSize_X', 'maxDimension_Y', 'maxCountofPixel_X']) AS key,
 unnest(['processed', CAST(count(*) AS VARCHAR), 'maker', 'laser', 'tube', 'plate', '5 micrometer', '5 micrometer', '5 micrometer']) AS value FROM nation""")
def imzml_header(spark, d):
    """Facts of an imaging file that its container's header keeps."""
    done = api.convert_files(spark, path := _imaging(spark, d, False), f"{os.path.dirname(path)}/out").head()
    info = api.get_basic_info(done["output"])
    return spark.createDataFrame([(k, info[k]) for k in ("storage", "scanCount", "msModel", "msIonisation", "msMassAnalyzer", "msDetector", "pixelSize_X", "maxDimension_Y", "maxCountofPixel_X")], "key string, value string")


# Streams.


@query("SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, d):
    """Counts in tumbling windows of a stream of files, once all files are done."""
    from ..streaming.ingest import scan_counts

    where = f"{d}/events.parquet"
    schema = spark.read.parquet(where).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    counts = scan_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    work = Workspace(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.select("event_type", F.col("window.start").alias("hour"), "n").write.mode("overwrite").parquet(work.path("counts"))

    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", work.path("checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(work.path("counts"))


@query(_BACK)
def stream_ingest(spark, d):
    """Scans that arrive as files leave as blocks, decoded here."""
    from ..streaming.ingest import ingest_scans

    work = Workspace(spark, "stream")
    scans = _scans(spark, d)
    work.save(scans, "in")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scans.schema)
    ingest_scans(spark, work.path("in"), schema, work.path("out"), work.path("checkpoint"), files_per_trigger=100).awaitTermination()
    return _flat(convert.decode_scans(spark.read.parquet(work.path("out"))))


# Filters of conversions.


@query("SELECT block AS scan_index, count(*) AS n FROM (SELECT l_suppkey AS block, l_quantity AS x FROM lineitem) WHERE block IN (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 590) AND x >= 2 GROUP BY block")
def filter_scans(spark, d):
    """Scans with enough raw peaks, without their weak peaks; scans left empty go."""
    scans = _scans(spark, d).withColumn("intensity", F.transform("intensity", lambda x: x / 200))
    return convert.filter_scans(scans, least=590).select(F.col("scan_index").cast("long").alias("scan_index"), F.size("mz").cast("long").alias("n"))


@query("SELECT user_id, max(value) AS value FROM events WHERE user_id < 0 GROUP BY user_id")
def empty_batch(spark, d):
    """Blocks of empty arrays and of an empty table."""
    none = table(spark, d, "events").filter("user_id < 0")
    scans = none.select(F.col("event_id").alias("scan_index"), F.lit(1.0).cast("float").alias("rt"), F.lit(1).alias("ms_level"), F.lit(None).cast("int").alias("charge"), F.lit(None).cast("float").alias("precursor_mz"), F.lit(None).cast("float").alias("collision_energy"), F.array(F.col("value")).alias("mz"), F.array(F.col("value")).alias("intensity"), "user_id", "value")
    back = convert.decode_scans(convert.encode_scans(scans.drop("user_id", "value")))
    return back.select(F.col("block_id").alias("user_id"), F.get("mz", F.lit(0)).alias("value"))
