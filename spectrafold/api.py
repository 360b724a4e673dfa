"""The API of the engine: ingest files, read containers, file facts."""

from __future__ import annotations

import os
import re
import time
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.codecs import base64_to_floats, floats_to_base64
from .functions.columns import duration_text, mz_steps
from .operators.peaks import gather
from .plans import convert
from .sources import container, fastq, imzml, tdf
from .workspace import Workspace

#: Instrument terms of the header that a source may lack.
_TERMS = ("msModel", "msDetector", "msIonisation", "msMassAnalyzer")
FORMATS = {".fastq": "genomics", ".imzml": "metabolomics", ".d": "proteomics", ".parquet": "proteomics"}


def get_supported_formats() -> dict[str, str]:
    """Suffix (any case) to kind of data; vendor formats come as Parquet tables of scans."""
    return dict(FORMATS)


def _register(spark: SparkSession) -> None:
    container.register(spark)


def convert_files(spark: SparkSession, input_files: str | list[str], output_dir: str, write_mode: str = "binary", precision: float = 0.001, skip_zero: bool = True) -> DataFrame:
    """Converts each file to ``<stem>.omg`` in ``output_dir``: input, output, status, message.

    A missing or unsupported file, two inputs of one stem and a precision that isn't
    positive raise ValueError before any work; a file that fails while it is converted gets the status "failed" and the reason.
    """
    _register(spark)
    files = [input_files] if isinstance(input_files, str) else list(input_files)
    if not files:
        raise ValueError("no input files")
    kinds = {}
    for f in files:
        suffix = os.path.splitext(f.rstrip("/"))[1].lower()
        if suffix not in FORMATS:
            raise ValueError(f"unsupported format: {f}")
        if not os.path.exists(container.mounted(f)):
            raise ValueError(f"no such file: {f}")
        kinds[f] = suffix
    mz_steps(precision)
    outputs = {f: os.path.join(output_dir, os.path.splitext(os.path.basename(f.rstrip("/")))[0] + ".omg") for f in kinds}
    if same := [o for o, n in Counter(outputs.values()).items() if n > 1]:
        raise ValueError(f"several inputs would be written to {same[0]}")
    os.makedirs(container.mounted(output_dir), exist_ok=True)
    rows = []
    for f, suffix in kinds.items():
        out = outputs[f]
        try:
            _convert(spark, f, suffix, out, write_mode, precision, skip_zero)
            rows.append((f, out, "ok", None))
        except Exception as e:  # one file's failure is that file's result
            rows.append((f, None, "failed", _reason(e)))
    return spark.createDataFrame(rows, "input string, output string, status string, message string")


def _reason(e: Exception) -> str:
    """The error that a task raised, without the frames that led to it."""
    raised = re.findall(r"^\w*(?:Error|Exception): .+", str(e), re.M)
    return (raised[-1] if raised else str(e))[:500]


def _text(value) -> str:
    """A header value, which is one line."""
    return " ".join(str(value).split())


def _scan_facts(facts: DataFrame, count: int | None = None) -> dict[str, str]:
    """Header facts of scans from one row with start_time and end_time, and with frames and the names of a TDF file where it is one."""
    row = facts.withColumns({c: duration_text(F.col(c)) for c in ("start_time", "end_time")}).head().asDict()
    spans = {k: "UnKnown" if row[c] is None or "null" in row[c] else row[c] for k, c in (("startTime", "start_time"), ("endTime", "end_time"))}
    found = {"msModel": row.get("InstrumentName"), "schemaType": row.get("SchemaType")}
    terms = dict.fromkeys((*_TERMS, "msManufacturer"), "UnKnown") | {"schemaType": "None"}
    return {"scanCount": str(row["frames"] if count is None else count), **spans, **terms, **{k: _text(v) for k, v in found.items() if v}}


def _imaging_facts(info: dict) -> dict[str, str]:
    """Header facts of an imaging file; sizes with their units."""
    size = lambda key: _text(f"{info.get(key, '')} {info['units'].get(key, '')}")
    names = {"pixelSize": "pixel", "maxDimension": "dim", "maxCountofPixel": "max"}
    sizes = {f"{name}_{c}": size(f"{key}{c}") for name, key in names.items() for c in "XY"}
    count = info["spectrumCount"]
    return {"scanCount": "" if count is None else str(count), **sizes, **{k: _text(info.get(k) or "UnKnown") for k in _TERMS}}


def _convert(spark: SparkSession, path: str, suffix: str, out: str, mode: str, precision: float, skip_zero: bool) -> None:
    facts = {"date": time.strftime("%Y-%m-%dT%H:%M:%S"), "parentFile": path, "parentFormat": suffix[1:]}
    if suffix == ".fastq":
        reads = fastq.read_fastq(spark, path, continuous=True)
        count, length = reads.agg(F.count("sequence"), F.max(F.when(F.col("read_id") == 0, F.length("sequence")))).head()
        facts |= {"readLength": "" if length is None else str(length), "readCount": str(count)}
        convert.write_container(convert.encode_reads(reads, mode), out, "Genomics", mode, **facts)
        return
    if suffix == ".imzml":
        info = imzml.header(spark, path)
        spectra, continuous = imzml.read_imzml(spark, path), info["storage"] == "continuous"
        facts |= {"storage": info["storage"], "precision": str(precision), **_imaging_facts(info)}
        if continuous:
            axis = spectra.select("mz").head()
            facts |= {"continuousMzCode": floats_to_base64(axis[0] if axis else [], "f64"), "continuousMzEncoding": "f64"}
        convert.write_container(convert.encode_spectra(spectra, mode, continuous, precision), out, "Metabolomics", mode, **facts)
        return
    if suffix == ".d":
        tables = tdf.read_tables(spark, os.path.join(path, "analysis.tdf"))
        peaks, axis = spark.read.parquet(os.path.join(path, "peaks.parquet")), os.path.join(path, "axis.parquet")
        mobility = tdf.mobility_axis(spark.read.parquet(axis), peaks) if os.path.exists(container.mounted(axis)) else None
        facts |= _scan_facts(tdf.file_info(tables)) | {"mobilityValue": "None" if mobility is None else floats_to_base64(mobility)}
        made = tdf.scans(tables, peaks)
        from .operators.ordered import dense_index

        # written once, as numbering its rows reads them twice
        work = Workspace(spark, "scans")
        kept = work.save(convert.filter_scans(made, skip_zero), "kept")
        scans = dense_index(kept, "frame", "scan_index", ("isolation_mz", "window"))
    else:
        source = spark.read.parquet(path)
        scans = convert.filter_scans(source, skip_zero)
        ends = source.agg(F.min_by("rt", "scan_index").alias("start_time"), F.max_by("rt", "scan_index").alias("end_time"))
        facts |= _scan_facts(ends, scans.count()) | {"mobilityValue": "None"}
    facts["precision"] = str(precision)
    convert.write_container(convert.encode_scans(scans, mode, precision), out, "Proteomics", mode, **facts)
    if suffix == ".d":
        work.drop()


def parse_omg_file(spark: SparkSession, omg_file: str, read_mode: str = "disk", columns: list[str] | None = None) -> DataFrame:
    """Decoded entries of a container: scans, spectra or reads, by its header; ``memory`` keeps the blocks cached.

    Scans get a column ``mobility``, the 1/K0 of each peak by the file's axis; null where the file has none.
    Only the arrays among ``columns`` are decoded.
    """
    _register(spark)
    if read_mode not in ("disk", "memory"):
        raise ValueError(f"unknown read mode {read_mode}")
    info = container.file_header(omg_file)
    blocks = spark.read.format("omicsblocks").load(omg_file)
    if read_mode == "memory":
        blocks = blocks.persist()
    return _decoded(spark, blocks, info, columns)


def _decoded(spark: SparkSession, blocks: DataFrame, info: dict, columns: list[str] | None = None) -> DataFrame:
    """Entries of blocks by the header: reads; spectra, with the shared m/z axis of a continuous file; scans, with their mobility."""
    mode, precision = info["writeFormat"], float(info.get("precision", "0.001"))
    chosen = (lambda df: df.select(*columns)) if columns else (lambda df: df)
    if info["omics"] == "Genomics":
        return chosen(convert.decode_reads(blocks, mode))
    if info["omics"] == "Metabolomics":
        continuous = info.get("storage") == "continuous"
        out = convert.decode_spectra(blocks, mode, continuous, precision, columns)
        if continuous:
            axis = base64_to_floats(info["continuousMzCode"], info.get("continuousMzEncoding", "f32")).tolist()
            out = out.drop("mz").crossJoin(F.broadcast(spark.createDataFrame([(axis,)], "mz array<double>")))  # one row
        return chosen(out)
    needed = columns and [*columns, *["mobility_index"] * ("mobility" in columns)]
    return chosen(_with_mobility(spark, convert.decode_scans(blocks, mode, precision, needed), info))


def _mobility(info: dict):
    """1/K0 by scan number, or None."""
    code = info.get("mobilityValue", "None")
    return None if code in ("", "None") else base64_to_floats(code).tolist()


def _with_mobility(spark: SparkSession, scans: DataFrame, info: dict) -> DataFrame:
    axis = _mobility(info)
    if axis is None:
        return scans.withColumn("mobility", F.lit(None).cast("array<float>"))
    held = F.broadcast(spark.createDataFrame([(axis,)], "__axis array<float>"))  # one row
    return scans.crossJoin(held).withColumn("mobility", gather(F.col("__axis"), F.col("mobility_index"))).drop("__axis")


def get_entry(spark: SparkSession, omg_file: str, entry: int) -> DataFrame:
    """One entry; only its block is read."""
    _register(spark)
    info = container.file_header(omg_file)
    return _decoded(spark, spark.read.format("omicsblocks").load(omg_file).filter(F.col("block_id") == entry), info)


def get_basic_info(omg_file: str) -> dict:
    """The header; its mobility and m/z axes as lists of numbers."""
    info = container.file_header(omg_file)
    if (axis := _mobility(info)) is not None:
        info["mobilityValue"] = axis
    if code := info.get("continuousMzCode"):
        info["continuousMzCode"] = base64_to_floats(code, info.get("continuousMzEncoding", "f32")).tolist()
    return info


def get_entry_number(omg_file: str) -> int:
    return container.block_count(omg_file)


def get_file_info(spark: SparkSession, path: str) -> DataFrame:
    """path, size_bytes, size_mb (two decimals), modified."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.round(F.col("length") / 1048576, 2).alias("size_mb"), F.col("modificationTime").alias("modified"))


def convert_to_omg(spark: SparkSession, input_files: str | list[str], output_dir: str, **options) -> DataFrame:
    return convert_files(spark, input_files, output_dir, **options)


def parse_omg(spark: SparkSession, omg_file: str, **options) -> DataFrame:
    return parse_omg_file(spark, omg_file, **options)
