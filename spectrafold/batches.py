"""Sizes of the Arrow batches of Python stages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession

#: Rows, and bytes.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small enough that a Python worker's copies of a batch stay within tens of MB; a long text is a batch of its own.

    The session's settings stay so, as results are computed after the call that made them.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = int(re.sub(r"\D", "", spark.conf.get(name)) or 0)
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def pieces(rows: Iterable, size: Callable, most: int = BATCH_BYTES) -> Iterator[list]:
    """Lists of consecutive rows that end as soon as they reach ``most`` bytes by ``size``."""
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += size(r)
        if total >= most:
            yield held
            held, total = [], 0
    if held:
        yield held
