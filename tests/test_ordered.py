import random

import pytest
from pyspark.sql import functions as F

from spectrafold.operators import ordered as O
from spectrafold.streaming.ingest import ingest_scans, scan_counts

from .test_sources import make_scans


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_running_sum_and_offsets(spark, ranges):
    rng = random.Random(ranges)
    rows = [(k * rng.randint(1, 3) * 1000 + k, rng.randint(0, 9)) for k in range(300)]
    df = spark.createDataFrame(rows, "k long, v long")
    total, want = 0, {}
    for k, v in sorted(rows):
        want[k] = total
        total += v
    got = {r["k"]: (r["s"], r["v"]) for r in O.running_sum(df, "k", F.col("v"), "s", ranges=ranges).collect()}
    assert got == {k: (want[k] + v, v) for k, v in rows}
    assert {r["k"]: r["offset"] for r in O.offsets(df, "k", F.col("v")).collect()} == want


def test_runs_previous_cycles_and_index(spark):
    rng = random.Random(7)
    rows = [(k * 2, rng.choice(["a", "b", None])) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, s string").repartition(5)
    runs, last = [], object()
    for k, s in rows:
        if s != last:
            runs.append([s, k, 0])
        runs[-1][2] += 1
        last = s
    got = [(r["symbol"], r["start"], r["run"]) for r in O.runs(df, "k", "s").orderBy("run_id").collect()]
    first = got[0]
    assert [tuple(r) for r in runs] == got or (first[0] is None and [tuple(r) for r in runs[1:]] == got[1:])
    prev = {r["k"]: r["prev_s"] for r in O.with_previous(df, "k", ["s"]).collect()}
    assert prev == {k: rows[i - 1][1] if i else None for i, (k, _) in enumerate(rows)}
    cycle, want = -1, {}
    for k, s in rows:
        cycle += s == "a"
        want[k] = cycle
    assert {r["k"]: r["cycle_id"] for r in O.cycle_ids(df, "k", F.coalesce(F.col("s") == "a", F.lit(False))).collect()} == want
    assert sorted(r["i"] for r in O.dense_index(df, "k", "i").collect()) == list(range(200))


def test_empty(spark):
    df = spark.createDataFrame([], "k long, v long")
    assert O.running_sum(df, "k", F.col("v"), "s").count() == 0 and O.runs(df, "k", "v").count() == 0


def test_streaming_ingest(spark, tmp_path):
    scans = make_scans(spark)
    for k in range(3):
        scans.filter(F.col("scan_index") % 3 == 0).filter(F.col("scan_index") / 3 % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = "scan_index long, rt float, ms_level int, charge int, precursor_mz float, collision_energy float, mz array<double>, intensity array<double>"
    ingest_scans(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/cp", files_per_trigger=1).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 39 and got.select("batch").distinct().count() >= 3  # one scan has zero peaks only


def test_streaming_windows(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e").withColumn("ts", F.col("ts").cast("timestamp"))
    scan_counts(stream, "ts", "event_type").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).head()[0] == events.count()
