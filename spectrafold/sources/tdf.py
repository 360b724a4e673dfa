"""Frames and isolation windows of a TDF-shaped SQLite file, and scans built from them."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.peaks import axes_agree

# Fixed table layouts; Row is the number of a window's row in its table.
TABLES = {
    "GlobalMetadata": "Key string, Value string",
    "Frames": "Id long, NumScans long, Time double, MsMsType long",
    "FrameMsMsInfo": "Row long, Frame long, TriggerMass double, IsolationWidth double, CollisionEnergy double",
    "PasefFrameMsMsInfo": "Row long, Frame long, IsolationMz double, IsolationWidth double, ScanNumBegin long, ScanNumEnd long, CollisionEnergy double",
    "DiaFrameMsMsWindows": "Row long, WindowGroup long, IsolationMz double, IsolationWidth double, ScanNumBegin long, ScanNumEnd long, CollisionEnergy double",
    "DiaFrameMsMsInfo": "Frame long, WindowGroup long",
}


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class TdfReader(DataSourceReader):
    """Row ranges of one table; each task opens the file on its own."""

    def __init__(self, path: str, table: str, parts: int):
        self.path, self.table, self.parts = path, table, parts

    def _open(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        with self._open() as db:
            high = db.execute(f"SELECT coalesce(max(rowid), 0) FROM {self.table}").fetchone()[0]
        step = max(1, -(-high // self.parts))
        return [_Rows(k, k + step) for k in range(1, high + 1, step)] or [_Rows(1, 1)]

    def read(self, part):
        columns = ", ".join("rowid" if c == "Row long" else c.split()[0] for c in TABLES[self.table].split(", "))
        with self._open() as db:
            yield from db.execute(f"SELECT {columns} FROM {self.table} WHERE rowid >= ? AND rowid < ?", (part.low, part.high))


class TdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tdf"

    def schema(self) -> str:
        return TABLES[self.options["table"]]

    def reader(self, schema) -> TdfReader:
        return TdfReader(re.sub(r"^file:/*", "/", self.options["path"]), self.options["table"], int(self.options.get("parts", "8")))


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    spark.dataSource.register(TdfSource)
    return {t: spark.read.format("tdf").option("table", t).load(path) for t in TABLES}


def file_info(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: schema and instrument names, number of frames, first and last time in seconds."""
    keys = tables["GlobalMetadata"].filter(F.col("Key").isin("SchemaType", "InstrumentName"))
    named = keys.agg(*[F.max(F.when(F.col("Key") == k, F.col("Value"))).alias(k) for k in ("SchemaType", "InstrumentName")])
    frames = tables["Frames"].agg(F.count(F.lit(1)).alias("frames"), F.min_by("Time", "Id").alias("start_time"), F.max_by("Time", "Id").alias("end_time"), F.max("MsMsType").alias("max_type"))
    return named.crossJoin(frames)  # one row each


def windows(tables: dict[str, DataFrame]) -> DataFrame:
    """Isolation windows of MS2 frames of all kinds: frame, window (number of its row), isolation_mz, isolation_width, scan_begin, scan_end, collision_energy.

    Type 2 frames have whole-frame windows (open scan ranges), types 8 and 9 name
    their ranges; each kind joins its own table.
    """
    wide = "IsolationMz isolation_mz, IsolationWidth isolation_width, ScanNumBegin scan_begin, ScanNumEnd scan_end, CollisionEnergy collision_energy"
    cols = [F.col(a).alias(b) for a, b in (c.split() for c in wide.split(", "))]
    pasef = tables["PasefFrameMsMsInfo"].select(F.col("Frame").alias("frame"), F.lit(8).alias("kind"), F.col("Row").alias("window"), *cols)
    dia = tables["DiaFrameMsMsWindows"].join(tables["DiaFrameMsMsInfo"], "WindowGroup").select(F.col("Frame").alias("frame"), F.lit(9).alias("kind"), F.col("Row").alias("window"), *cols)
    plain = tables["FrameMsMsInfo"].select(F.col("Frame").alias("frame"), F.lit(2).alias("kind"), F.col("Row").alias("window"), F.col("TriggerMass").alias("isolation_mz"), F.col("IsolationWidth").alias("isolation_width"), F.lit(None).cast("long").alias("scan_begin"), F.lit(None).cast("long").alias("scan_end"), F.col("CollisionEnergy").alias("collision_energy"))
    return plain.unionByName(pasef).unionByName(dia)


def scans(tables: dict[str, DataFrame], peaks: DataFrame) -> DataFrame:
    """Scans (frame, window, isolation_mz, rt, ms_level, precursor_mz, collision_energy, mz, intensity, mobility_index) from frames and peaks (frame, scan_no, mz, intensity).

    A frame of type 0 is one MS1 scan; an MS2 frame makes a scan for each of its
    windows, equal ones included, of the peaks whose scan number lies in the window, ends included (an
    end equal to the frame's scan count means its last scan).  Frames before the
    first MS1 frame, windows without peaks and frames without windows make none.
    An unknown type is an error.
    """
    frames = tables["Frames"]
    known = F.when(F.col("MsMsType").isin(0, 2, 8, 9), F.col("MsMsType")).otherwise(F.raise_error(F.concat(F.lit("unsupported frame type "), F.col("MsMsType").cast("string"))).cast("long"))
    frames = frames.select(F.col("Id").alias("f"), "NumScans", F.col("Time").alias("rt"), known.alias("type"))
    first = frames.filter("type = 0").agg(F.min("f").alias("first_ms1"))
    frames = frames.join(F.broadcast(first), F.col("f") >= F.col("first_ms1"))  # one row
    ms1 = frames.filter("type = 0").join(peaks, F.col("f") == F.col("frame")).withColumns({"window": F.lit(0).cast("long"), "isolation_mz": F.lit(-1.0), "collision_energy": F.lit(None).cast("double")})
    named = windows(tables).withColumnRenamed("frame", "w")
    cut = frames.filter("type <> 0").join(named, (F.col("f") == F.col("w")) & (F.col("type") == F.col("kind")))
    end = F.when(F.col("scan_end") == F.col("NumScans"), F.col("NumScans") - 1).otherwise(F.col("scan_end"))
    inside = F.col("scan_begin").isNull() | F.col("scan_no").between(F.col("scan_begin"), end)
    ms2 = cut.join(peaks, (F.col("f") == F.col("frame")) & inside)
    columns = ["frame", "window", "isolation_mz", "rt", "type", "collision_energy", "scan_no", "mz", "intensity"]
    each = ms1.select(columns).unionByName(ms2.select(columns))
    packed = each.groupBy("frame", "window", "isolation_mz", "rt", "type", "collision_energy").agg(F.sort_array(F.collect_list(F.struct("mz", "scan_no", "intensity"))).alias("p"))
    level = F.when(F.col("type") == 0, 1).otherwise(2)
    return packed.select("frame", "window", "isolation_mz", F.col("rt").cast("float").alias("rt"), level.alias("ms_level"), F.when(level == 2, F.col("isolation_mz")).cast("float").alias("precursor_mz"), F.col("collision_energy").cast("float").alias("collision_energy"), F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"), F.col("p.scan_no").alias("mobility_index"))


def mobility_axis(axis: DataFrame, peaks: DataFrame) -> list[float]:
    """1/K0 of the scan numbers 0, 1, ... from the table axis (scan_no, ook0, and frame where each frame has its own).

    Frames that differ at a scan number (cut to six decimals) are an error, and so are
    gaps, values that aren't finite, and peaks beyond the axis; the first frame's values count.
    """
    if differing := axes_agree(axis, "scan_no", "ook0").orderBy("scan_no").head():
        raise ValueError(f"the mobility axes of the frames differ at scan number {differing['scan_no']}")
    value = F.min_by("ook0", "frame") if "frame" in axis.columns else F.min("ook0")
    rows = axis.groupBy("scan_no").agg(value.alias("ook0"), F.count_if(F.col("ook0").isNull() | F.isnan("ook0")).alias("bad")).orderBy("scan_no").collect()
    if [r["scan_no"] for r in rows] != list(range(len(rows))):
        raise ValueError("the scan numbers of the mobility axis aren't 0, 1, ...")
    if any(r["bad"] or not np.isfinite(r["ook0"]) for r in rows):
        raise ValueError("the mobility axis holds values that aren't finite")
    low, high = peaks.agg(F.min("scan_no"), F.max("scan_no")).head()
    if low is not None and (low < 0 or high >= len(rows)):
        raise ValueError(f"peaks of the scan numbers {low} to {high} don't fit a mobility axis of {len(rows)}")
    return [r["ook0"] for r in rows]
