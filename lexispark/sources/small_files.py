"""Very many small files on a local path that all executors share: tasks write, list and read them themselves, one after the other, so
that the driver knows neither their names nor their number."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.sources.staging import staged

#: Characters that Spark's writers escape in the names of partition folders.
ESCAPED = {*map(chr, range(1, 32)), *"\"#%'*/:=?\\{[]^\x7f"}


def folder_name(column: str, value: str | None) -> str:
    """The folder of a partition value, as Spark's writers name it."""
    if not value:
        return f"{column}=__HIVE_DEFAULT_PARTITION__"
    return f"{column}={''.join(f'%{ord(c):02X}' if c in ESCAPED else c for c in value)}"


def files_udf(root: str, by: tuple[str, ...]):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out, n = None, None, 0
        try:
            for batch in batches:
                for *place, value in zip(*(batch.column(c).to_pylist() for c in (*by, "value")), strict=True):
                    if place != last:
                        if out is not None:
                            out.close()
                        folder = os.path.join(root, *map(folder_name, by, place))
                        os.makedirs(folder, exist_ok=True)
                        out, last, n = open(f"{folder}/part-00000.txt", "wb"), place, n + 1
                    out.write((value or "").encode() + b"\n")
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return write


def write_files(rows: DataFrame, root: str, by: tuple[str, ...]) -> None:
    """rows (columns of by, value), dealt and sorted by these -> a file for each of their values, its rows as lines, laid out as a text
    table partitioned by them. root is a folder that all executors share; a task that runs again writes its files again."""
    os.makedirs(root, exist_ok=True)
    rows.select(*(F.col(c).cast("string").alias(c) for c in by), "value").mapInArrow(files_udf(root, by), "n bigint").agg(F.sum("n")).collect()


#: Rows and bytes of files that a task hands on together.
ROWS, BYTES = 2_000, 8_000_000
#: What a file costs beside its bytes, and the cost of the files that one task reads.
OPEN_BYTES, TASK_BYTES = 64 << 10, 64 << 20


def hidden(name: str) -> bool:
    """Names that Spark's readers leave out."""
    left_out = name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")
    return left_out and not name.startswith(("_metadata", "_common_metadata"))


def entries_udf(names: tuple[str, ...]):
    """Folders (at) -> what lies in each: its path, whether it is a folder, the size of a file. Of files those of these names and parts."""
    schema = pa.schema([("at", pa.binary()), ("is_folder", pa.bool_()), ("length", pa.int64())])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for at in batch.column("at").to_pylist():
                with os.scandir(at) as found:
                    for x in found:
                        name = x.name.decode(errors="replace")
                        if not hidden(name) and ((folder := x.is_dir()) or name in names or name.startswith("part-")):
                            rows.append((x.path, folder, 0 if folder else x.stat().st_size))
                        if len(rows) >= ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return entries


def list_files(spark: SparkSession, root: str, *names: str) -> DataFrame:
    """at (bytes of the path) and length of the files below root that have one of these names or are parts. Folders are listed level by level,
    those of a level in parallel; what is found is written, so that it is nobody's memory that grows with it."""
    folders, files = spark.createDataFrame([(bytearray(os.fsencode(root)),)], "at binary"), []
    n = 1
    while n:
        dealt = folders if n == 1 else folders.repartition(min(n, 4 * spark.sparkContext.defaultParallelism), F.xxhash64("at"))
        found = staged(dealt.mapInArrow(entries_udf(names), "at binary, is_folder boolean, length bigint"), "listed")
        files.append(found.where("NOT is_folder").select("at", "length"))
        folders = found.where("is_folder").select("at")
        n = folders.count()
    return reduce(DataFrame.unionByName, files)


def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files (at) -> path and content of each."""
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])
    rows, size = [], 0
    for batch in batches:
        for at in batch.column("at").to_pylist():
            with open(at, "rb") as f:
                content = f.read()
            rows.append({"path": at.decode(errors="replace"), "content": content})
            size += len(content)
            if len(rows) >= ROWS or size >= BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def read_files(files: DataFrame) -> DataFrame:
    """list_files -> path, content: files are dealt to tasks by their number and bytes."""
    cost = files.agg(F.sum(F.col("length") + OPEN_BYTES)).first()[0] or 0
    return files.repartition(max(1, -(-cost // TASK_BYTES)), F.xxhash64("at")).mapInArrow(contents, "path string, content binary")
