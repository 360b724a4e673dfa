"""Imaging spectra: the XML side with Spark's XML reader, arrays from the external binary file."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.codecs import ENCODINGS

# Fixed values of the controlled vocabulary.
STORAGE = {"IMS:1000030": "continuous", "IMS:1000031": "processed"}
TYPES = {"MS:1000519": "i32", "MS:1000521": "f32", "MS:1000522": "i64", "MS:1000523": "f64"}
COMPRESSION = {"MS:1000574": "zlib", "MS:1000576": "none"}
OFFSET, LENGTH, ENCODED = "IMS:1000102", "IMS:1000103", "IMS:1000104"
SETTINGS = {"IMS:1000042": "maxX", "IMS:1000043": "maxY", "IMS:1000044": "dimX", "IMS:1000045": "dimY", "IMS:1000046": "pixelX", "IMS:1000047": "pixelY"}
COMPONENTS = {"msIonisation": "source", "msMassAnalyzer": "analyzer", "msDetector": "detector"}

_SPECTRUM = "_id string, _index long, cvParam array<struct<_accession string, _value string>>, scanList struct<scan: struct<cvParam: array<struct<_accession: string, _value: string>>, userParam: array<struct<_name: string, _value: string>>>>, binaryDataArrayList struct<binaryDataArray: array<struct<cvParam: array<struct<_accession: string, _value: string>>, referenceableParamGroupRef: struct<_ref: string>>>>"
SPECTRA = "file string, spectrum_id long, pos_x float, pos_y float, pos_3dx float, pos_3dy float, pos_3dz float, array_length long, mz array<double>, intensity array<double>"


def _head(spark: SparkSession, path: str, step: int = 1 << 20) -> str:
    """The text before the first spectrum, however long, by Spark's file systems."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    data, found = bytearray(), None
    try:
        while not found:
            more = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, step)))
            from_ = max(0, len(data) - 16)
            data += more
            found = re.compile(rb"<spectrum\s").search(data, from_)
            if len(more) < step:
                break
    finally:
        stream.close()
    return bytes(data[: found.start()] if found else data).decode("utf-8", "replace")


def header(spark: SparkSession, path: str) -> dict:
    """Storage mode, array encodings, scan settings, instrument terms and spectrum count."""
    return parse_header(_head(spark, path))


def parse_header(text: str) -> dict:
    def params(part: str) -> dict[str, tuple[str, str]]:
        return {a: (re.search(r'name="([^"]*)"', t)[1] if 'name="' in t else "", (re.search(r'value="([^"]*)"', t) or [0, ""])[1]) for t in re.findall(r"<cvParam\b[^>]*>", part) for a in re.findall(r'\baccession="([^"]*)"', t)}

    info: dict = {"omics": "Metabolomics", "arrays": {}}
    found = params(text)
    info["storage"] = next((STORAGE[a] for a in found if a in STORAGE), "processed")
    for group in re.findall(r"<referenceableParamGroup\b.*?</referenceableParamGroup>", text, re.S):
        name = re.search(r'\bid="([^"]*)"', group)[1]
        kind = "mz" if "mz" in name.lower() else "intensity" if "inten" in name.lower() else None
        if kind:
            own = params(group)
            info["arrays"][kind] = {"ref": name, "encoding": next((TYPES[a] for a in own if a in TYPES), "f32"), "compressed": any(COMPRESSION.get(a) == "zlib" for a in own)}
    info |= {key: found[a][1] for a, key in SETTINGS.items() if a in found}
    info["units"] = {key: u[1] for a, key in SETTINGS.items() for t in re.findall(rf'<cvParam\b[^>]*accession="{a}"[^>]*>', text) if (u := re.search(r'\bunitName="([^"]*)"', t))}
    instrument = re.search(r"<instrumentConfiguration\b.*?</instrumentConfiguration>", text, re.S)
    if instrument:
        parts = {"msModel": instrument[0]} | {key: (re.search(rf"<{t}\b.*?</{t}>", instrument[0], re.S) or [""])[0] for key, t in COMPONENTS.items()}
        for key, part in parts.items():
            first = re.search(r"<cvParam\b[^>]*>", part)
            info[key] = (re.search(r'\bname="([^"]*)"', first[0]) or [0, ""])[1] if first else ""
    count = re.search(r'<spectrumList\b[^>]*\bcount="(\d+)"', text)
    info["spectrumCount"] = int(count[1]) if count else None
    return info


def read_imzml(spark: SparkSession, path: str, ibd: str | None = None) -> DataFrame:
    """Spectra of one file with the columns of SPECTRA.

    ``ibd`` defaults to the file's name with that suffix; every task opens it on its
    own, so it must lie on storage that all executors mount.  Positions that a file
    lacks are null.  Arrays are cut by offset and encoded length; tasks get stretches
    of spectra, which the file keeps in order.
    """
    info = header(spark, path)
    ibd = ibd or re.sub(r"\.imzml$", ".ibd", path, flags=re.I)
    local = re.sub(r"^file:/*", "/", ibd)
    arrays = {v["ref"]: (k, ENCODINGS[v["encoding"]], v["compressed"]) for k, v in info["arrays"].items()}

    def value(params, accession):
        return next((p["_value"] for p in (() if params is None else params) if p and p["_accession"] == accession), None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(local, "rb") as f:
            for b in batches:
                rows = []
                for k in b.to_dict("records"):
                    scan = (k["scanList"] or {}).get("scan") or {}
                    users = {u["_name"]: u["_value"] for u in (scan.get("userParam") if scan.get("userParam") is not None else ())}
                    got, length = {"mz": [], "intensity": []}, 0
                    for a in k["binaryDataArrayList"]["binaryDataArray"]:
                        kind, dtype, compressed = arrays[a["referenceableParamGroupRef"]["_ref"]]
                        n, size = int(value(a["cvParam"], LENGTH)), np.dtype(dtype).itemsize
                        f.seek(int(value(a["cvParam"], OFFSET)))
                        raw = f.read(int(value(a["cvParam"], ENCODED) or n * size))
                        got[kind] = np.frombuffer(zlib.decompress(raw) if compressed else raw, dtype).astype(float)
                        length = n
                    number = lambda v: None if v in (None, "", "NA") else float(v)
                    place = [number(value(scan.get("cvParam"), a)) for a in ("IMS:1000050", "IMS:1000051")] + [number(users.get(f"3DPosition{c}")) for c in "XYZ"]
                    rows.append((path, int(k["_index"]), *place, length, got["mz"], got["intensity"]))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SPECTRA.split(", ")])

    spectra = spark.read.format("xml").option("rowTag", "spectrum").schema(_SPECTRUM).load(path)
    return spectra.mapInPandas(run, SPECTRA)
