"""Container files as a data source: block ranges are read in parallel, blocks are written in parts and joined at commit."""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..batches import bounded_batches
from ..functions import container as C

BLOCKS = "file string, block_id long, offset long, length long, payload binary"


#: Bytes of blocks that one task reads, a larger block being a task of its own.
TASK_BYTES = 4 << 20


def mounted(path: str) -> str:
    return re.sub(r"^file:/*", "/", path)


@dataclass
class Range(InputPartition):
    file: str
    first: int
    starts: list
    lengths: list


class BlockReader(DataSourceReader):
    """The driver reads trailers only; a task seeks to its own stretch of blocks.  Filters on block_id drop blocks before they are read."""

    def __init__(self, path: str, per_task: int):
        self.files = _files(path)
        self.per_task, self.low, self.high = per_task, 0, 1 << 62

    def pushFilters(self, filters):
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("block_id",) and isinstance(value, int):
                if isinstance(f, EqualTo):
                    self.low, self.high = max(self.low, value), min(self.high, value)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high = min(self.high, value - isinstance(f, LessThan))
            yield f  # Spark checks them again

    def partitions(self):
        out, before = [], 0  # the blocks of a folder's files are numbered one file after another
        for file in self.files:
            with open(file, "rb") as f:
                _, starts, lengths = C.read_index(f)
            lo, hi = (min(max(0, x - before), len(starts)) for x in (self.low, self.high + 1))
            for k, e in _stretches(lengths, lo, hi, self.per_task):
                out.append(Range(file, before + k, starts[k:e].tolist(), lengths[k:e].tolist()))
            before += len(starts)
        return out or [Range("", 0, [], [])]

    def read(self, part):
        if not part.starts:
            return
        with open(part.file, "rb") as f:
            for k, (start, length) in enumerate(zip(part.starts, part.lengths)):
                f.seek(start)
                yield part.file, part.first + k, start, length, f.read(length)


def _stretches(lengths, lo: int, hi: int, most: int):
    """First and last (exclusive) of stretches of at most ``most`` blocks and TASK_BYTES, one block at least."""
    size = 0
    for k in range(lo, hi):
        if k > lo and (k - lo == most or size + lengths[k] > TASK_BYTES):
            yield lo, k
            lo, size = k, 0
        size += lengths[k]
    if hi > lo:
        yield lo, hi


@dataclass
class Part(WriterCommitMessage):
    path: str
    ids: list
    lengths: list


class BlockWriter(DataSourceWriter):
    """Rows (block_id, payload, ...) become one file; its folder is shared, as for any Spark output."""

    def __init__(self, path: str, mode: str, info: dict, overwrite: bool, names: list[str]):
        self.path, self.mode, self.info, self.overwrite = mounted(path), mode, info, overwrite
        self.parts = f"{os.path.dirname(self.path)}/._{os.path.basename(self.path)}-{uuid.uuid4().hex}"
        self.at = names.index("block_id"), names.index("payload")

    def write(self, rows):
        os.makedirs(self.parts, exist_ok=True)
        path = f"{self.parts}/{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"
        ids, lengths = [], []
        with open(path, "wb") as f:
            for r in rows:
                ids.append(r[self.at[0]])
                lengths.append(f.write(r[self.at[1]]))
        return Part(path, ids, lengths)

    def commit(self, messages):
        if os.path.exists(self.path) and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.path)
        found = self._directory(messages)
        head = C.header(self.info, self.mode)
        with open(f"{self.path}.tmp", "wb") as out:
            out.write(head)
            handle, name = None, None
            for _, path, start, length in found:
                if path != name:
                    if handle:
                        handle.close()
                    handle, name = open(path, "rb"), path
                handle.seek(start)
                out.write(handle.read(length))
            if handle:
                handle.close()
            out.write(C.trailer([len(head), *(x[3] for x in found)], self.mode))
        os.replace(f"{self.path}.tmp", self.path)
        shutil.rmtree(self.parts, ignore_errors=True)

    @staticmethod
    def _directory(messages):
        found = []
        for m in messages:
            at = 0
            for i, n in zip(m.ids, m.lengths) if m else ():
                found.append((i, m.path, at, n))
                at += n
        return sorted(found)

    def abort(self, messages):
        shutil.rmtree(self.parts, ignore_errors=True)


class FolderWriter(BlockWriter):
    """Each task's rows, which come in order of block_id, become a container file of their own; the commit renames the files' folder."""

    def write(self, rows):
        os.makedirs(self.parts, exist_ok=True)
        task = TaskContext.get()
        path = f"{self.parts}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        head = C.header(self.info, self.mode)
        lengths = [len(head)]
        with open(path, "wb") as f:
            f.write(head)
            for r in rows:
                lengths.append(f.write(r[self.at[1]]))
            f.write(C.trailer(lengths, self.mode))
        return Part(path, [], [])

    def commit(self, messages):
        if os.path.exists(self.path) and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.path)
        kept = {m.path for m in messages if m}
        for name in os.listdir(self.parts):  # attempts that were lost or repeated
            if f"{self.parts}/{name}" not in kept:
                os.remove(f"{self.parts}/{name}")
        if os.path.isdir(self.path):
            shutil.rmtree(self.path)
        elif os.path.exists(self.path):
            os.remove(self.path)
        os.replace(self.parts, self.path)


class BlockSource(DataSource):
    """``spark.read.format("omicsblocks").load(path)`` and ``blocks.write.format("omicsblocks").option("info", <header as JSON>).save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "omicsblocks"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options["path"], int(self.options.get("blocksPerTask", "256")))

    def writer(self, schema, overwrite: bool) -> BlockWriter:
        info = json.loads(self.options.get("info", '{"omics": "Proteomics"}'))
        kind = FolderWriter if self.options.get("folder", "false").lower() == "true" else BlockWriter
        return kind(self.options["path"], self.options.get("mode", "binary"), info, overwrite, schema.names)


def register(spark: SparkSession) -> None:
    """Makes the format known, with filters on block_id pushed to its reader and bounded batches for its writer."""
    bounded_batches(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BlockSource)


def _files(path: str) -> list[str]:
    where = mounted(path)
    return sorted(os.path.join(where, f) for f in os.listdir(where) if not f.startswith((".", "_"))) if os.path.isdir(where) else [where]


def file_header(path: str) -> dict:
    """The header; that of the first file where ``path`` is a folder."""
    with open(_files(path)[0], "rb") as f:
        return C.read_index(f)[0]


def block_count(path: str) -> int:
    """Number of blocks, from the trailers alone."""
    total = 0
    for file in _files(path):
        with open(file, "rb") as f:
            total += len(C.read_index(f)[1])
    return total
