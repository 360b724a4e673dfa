"""Sizes of what a Python worker holds at once."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from spectrafold.batches import BATCH_BYTES, BATCH_ROWS, pieces
from spectrafold.functions import blocks as B
from spectrafold.functions import codecs as K
from spectrafold.operators import ordered
from spectrafold.plans import convert
from spectrafold.sources import container

KEYS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


@pytest.fixture
def wide(spark):
    """Spark's own sizes of batches at first."""
    before = {k: spark.conf.get(k) for k in KEYS}
    for k in KEYS:
        spark.conf.unset(k)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def batches(spark):
    """Rows and bytes of the largest batches that a Python stage gets now, of many short rows and of long ones."""
    sizes = lambda bs: (pd.DataFrame({"n": [len(b)], "size": [int(b["t"].str.len().sum())]}) for b in bs)
    got = lambda n, text: spark.range(0, n, 1, 1).selectExpr(f"repeat('x', {text}) AS t").mapInPandas(sizes, "n long, size long").groupBy().max().head()
    return got(9000, 1)[0], got(60, 1_000_000)[1]


QUERIES = ["json_block", "binary_block", "yaml_block", "reads_block", "container_folder_roundtrip", "reads_container", "zstd_roundtrip_documents", "ef32_bytes_roundtrip", "compression_report"]


@pytest.mark.parametrize("name", QUERIES)
def test_query_bounds_its_batches(wide, sf, name):
    entry.queries()[name](wide, sf)
    rows, size = batches(wide)
    assert rows <= BATCH_ROWS and size <= BATCH_BYTES + 1_000_000


def test_pieces_end_by_size():
    assert list(pieces([3, 4, 9, 1], lambda n: n, 6)) == [[3, 4], [9], [1]] and list(pieces([], len)) == []


@pytest.mark.parametrize("mode", B.MODES)
def test_decoded_scans_come_in_pieces(mode):
    """Scans of equal peaks take few bytes as blocks and many decoded."""
    block = B.encode_scan({"scan_index": 1, "mz": np.full(100_000, 5.0), "intensity": np.full(100_000, 4.0)}, mode)
    stored = pd.DataFrame({"block_id": range(40), "payload": [block] * 40})
    got = list(convert.decoded(stored, lambda p: B.scan_arrays(p, mode)))
    assert [r["block_id"] for rows in got for r in rows] == list(range(40))
    assert max(sum(r["mz"].nbytes + r["intensity"].nbytes for r in rows) for rows in got) <= BATCH_BYTES + 1_600_000


def test_frames_are_gathered_once(spark, sf, monkeypatch):
    """Numbering a run's scans reads them twice, so they are written first."""
    plans, index = [], ordered.dense_index

    def seen(df, *a):
        plans.append(df._jdf.queryExecution().toString())
        return index(df, *a)

    monkeypatch.setattr(ordered, "dense_index", seen)
    assert entry.queries()["mobility_decode"](spark, sf).count() and len(plans) == 1
    assert "Aggregate" not in plans[0] and "parquet" in plans[0]


def test_tasks_read_a_bounded_number_of_bytes():
    most = container.TASK_BYTES
    lengths = [10, most, 10, 10, most - 20, most + 1, 5, 5, 5]
    assert list(container._stretches(lengths, 0, 9, 256)) == [(0, 1), (1, 2), (2, 5), (5, 6), (6, 9)]
    assert list(container._stretches(lengths, 6, 9, 2)) == [(6, 8), (8, 9)] and not list(container._stretches(lengths, 4, 4, 2))


def test_zero_peaks_go_from_uneven_scans(spark):
    """A scan without zero peaks stays as it is; others lose them, with null and missing intensities."""
    array = lambda *x: [float(v) if v is not None else None for v in x]
    rows = [(1, 1, array(1, 2), array(5, 6), [3, 4]), (2, 1, array(1, 2), array(0, 6), [3, 4]), (3, 1, array(1, 2), array(5, None), []), (4, 1, array(1, 2), array(5), None), (5, 1, array(1), array(5, 6), [7]), (6, 1, array(1, 2), array("nan", 0), [3, 4]), (7, 1, array(1), array(5), [3, 4])]
    scans = spark.createDataFrame(rows, "k long, ms_level int, mz array<double>, intensity array<double>, mobility_index array<long>")
    got = {r["k"]: (r["mz"], [str(x) for x in r["intensity"]], r["mobility_index"]) for r in convert.filter_scans(scans, least=1).collect()}
    assert got == {1: ([1, 2], ["5.0", "6.0"], [3, 4]), 2: ([2], ["6.0"], [4]), 3: ([1], ["5.0"], []), 5: ([1, None], ["5.0", "6.0"], [7, None]), 6: ([1], ["nan"], [3]), 7: ([1], ["5.0"], [3])}


def test_elias_fano_holds_no_word_for_each_bit():
    x = np.arange(200_000, dtype=np.uint64) * np.uint64(10_000)
    tracemalloc.start()
    back = K.ef_decode(K.ef_encode(x))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (back == x).all() and most < 12 * x.nbytes
