"""Plans from records to container blocks and back."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..batches import bounded_batches, pieces
from ..functions import blocks as B
from ..functions.columns import MIN_PEAKS, PEAK_FLOOR, READS_PER_BATCH

BLOCK = "block_id long, payload binary"
SCAN = "block_id long, scan_index long, rt float, ms_level int, charge int, precursor_mz float, collision_energy float, mz array<double>, intensity array<double>, mobility_index array<long>"
SPECTRUM = "block_id long, spectrum_id long, pos_x float, pos_y float, pos_3dx float, pos_3dy float, pos_3dz float, mz array<double>, intensity array<double>"
READ = "read_id long, identifier string, sequence string, quality string"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def filter_scans(scans: DataFrame, skip_zero: bool = True, least: int = MIN_PEAKS) -> DataFrame:
    """Scans with enough raw peaks and a level, without their zero peaks; scans left empty go."""
    kept = scans.filter((F.size("mz") >= least) & (F.coalesce("ms_level", F.lit(-1)) != -1))
    if not skip_zero:
        return kept
    columns = [c for c in ("mz", "intensity", "mobility_index") if c in scans.columns]
    keeps = lambda x: F.coalesce((x >= PEAK_FLOOR) | F.isnan(x), F.lit(False))
    good = F.filter(F.arrays_zip(*columns), lambda p: keeps(p["intensity"]))
    # a scan whose arrays are of one length and have no zero peak stays as it is, without a row for each of its peaks
    even = (F.size("mz") == F.size("intensity")) & F.forall("intensity", keeps)
    if "mobility_index" in columns:
        even &= F.col("mobility_index").isNotNull() & ((F.size("mobility_index") == 0) | (F.size("mobility_index") == F.size("mz")))
    out = kept.withColumn("__cut", ~F.coalesce(even, F.lit(False))).withColumn("__p", F.when(F.col("__cut"), good))
    for c in columns:
        picked = F.col("__cut") & (F.size(c) > 0) if c == "mobility_index" else F.col("__cut")
        out = out.withColumn(c, F.when(picked, _pick(c)).otherwise(F.col(c)))
    return out.drop("__p", "__cut").filter(F.size("mz") > 0)


def _pick(name: str):
    return F.transform("__p", lambda p: p[name])


def encode_scans(scans: DataFrame, mode: str = "binary", precision: float = 0.001) -> DataFrame:
    """One block for each scan; block_id is the column of that name, or scan_index."""
    if mode not in B.MODES:
        raise ValueError(f"unknown write mode {mode}")
    rows = scans if "block_id" in scans.columns else scans.withColumn("block_id", F.col("scan_index").cast("long"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            clean = b.astype(object).where(b.notna(), None).to_dict("records")
            yield pd.DataFrame({"block_id": b["block_id"], "payload": [B.encode_scan(r, mode, precision) for r in clean]})

    bounded_batches(scans.sparkSession)
    return rows.mapInPandas(run, BLOCK)


def decoded(blocks: pd.DataFrame, decode) -> Iterator[list[dict]]:
    """Rows of decoded blocks, in lists whose arrays are of bounded size however small their codes are."""
    rows = ({"block_id": i} | decode(p) for i, p in zip(blocks["block_id"], blocks["payload"]))
    return pieces(rows, lambda r: sum(v.nbytes for v in r.values() if isinstance(v, np.ndarray)))


def decode_scans(blocks: DataFrame, mode: str = "binary", precision: float = 0.001, columns: list[str] | None = None) -> DataFrame:
    """All columns of SCAN; arrays that aren't among ``columns`` are null and not decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rows in decoded(b, lambda p: B.scan_arrays(p, mode, precision, columns)):
                yield pd.DataFrame(rows, columns=_names(SCAN)).astype({"charge": "Int32"})

    bounded_batches(blocks.sparkSession)
    return blocks.select("block_id", "payload").mapInPandas(run, SCAN)


def encode_spectra(spectra: DataFrame, mode: str = "binary", continuous: bool = False, precision: float = 0.001) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            clean = b.astype(object).where(b.notna(), None).to_dict("records")
            yield pd.DataFrame({"block_id": b["spectrum_id"], "payload": [B.encode_spectrum(r, mode, continuous, precision) for r in clean]})

    bounded_batches(spectra.sparkSession)
    return spectra.mapInPandas(run, BLOCK)


def decode_spectra(blocks: DataFrame, mode: str = "binary", continuous: bool = False, precision: float = 0.001, columns: list[str] | None = None) -> DataFrame:
    """All columns of SPECTRUM; arrays that aren't among ``columns`` are null and not decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rows in decoded(b, lambda p: B.spectrum_arrays(p, mode, continuous, precision, columns)):
                yield pd.DataFrame(rows, columns=_names(SPECTRUM))

    bounded_batches(blocks.sparkSession)
    return blocks.select("block_id", "payload").mapInPandas(run, SPECTRUM)


def encode_reads(reads: DataFrame, mode: str = "binary", per_batch: int = READS_PER_BATCH) -> DataFrame:
    """One block for each batch of consecutive reads."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("read_id")
        first = int(b["read_id"].iloc[0])
        payload = B.encode_reads(first, b["identifier"].tolist(), b["sequence"].tolist(), b["quality"].tolist(), mode)
        return pd.DataFrame({"block_id": [first // per_batch], "payload": [payload]})

    bounded_batches(reads.sparkSession)
    keyed = reads.select("read_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("identifier", "sequence", "quality")])
    return keyed.withColumn("batch", F.floor(F.col("read_id") / per_batch)).groupBy("batch").applyInPandas(lambda b: run(b.drop(columns="batch")), BLOCK)


def decode_reads(blocks: DataFrame, mode: str = "binary") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["payload"]:
                yield pd.DataFrame(B.decode_reads(p, mode), columns=_names(READ))

    bounded_batches(blocks.sparkSession)
    return blocks.select("payload").mapInPandas(run, READ)


def write_container(blocks: DataFrame, path: str, omics: str, mode: str = "binary", folder: bool = False, **info) -> None:
    """Blocks in order of block_id: in one container file, which the driver joins, or in a ``folder`` of container files, each written by its task."""
    if folder:
        n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = blocks.repartitionByRange(n, "block_id").sortWithinPartitions("block_id")
    header = json.dumps({"omics": omics, **info})
    blocks.write.format("omicsblocks").mode("overwrite").option("mode", mode).option("folder", str(folder)).option("info", header).save(path)
