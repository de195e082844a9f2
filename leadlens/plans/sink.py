"""Append-only tables written exactly once, as a data source: ``df.write.format("leadlens_append")``.

A task writes one Parquet file under a name of its own and tells the driver; the driver's commit writes a manifest that names
the files of the tasks that succeeded, and only files that a manifest names are read.  So the files of lost, killed or
repeated tasks, and of failed jobs, leave no row; an abort removes those that it knows of.  A stream's manifest is named
after its batch, so that a repeated batch replaces its own manifest and counts once; a batch job names its manifest by the
option ``commit`` (a run's name), or gets a new one.

Register with :func:`register`, read with :func:`read_appended`.  ``path`` is a URI that ``pyarrow.fs`` reads, or a folder
that driver and executors share.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

# Ship this module inside the pickled writers, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "leadlens_append"
DATA, MANIFESTS = "data", "manifests"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


def _write_file(path: str, batches: Iterator[pa.RecordBatch]) -> Written:
    """One file for a task that has rows."""
    system, base = _open(path)
    name, rows, writer, stream = f"{DATA}/{uuid.uuid4().hex}.parquet", 0, None, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if writer is None:
            system.create_dir(f"{base}/{DATA}", recursive=True)
            stream = system.open_output_stream(f"{base}/{name}")
            writer = pq.ParquetWriter(stream, batch.schema)
        writer.write_batch(batch)
        rows += batch.num_rows
    if writer is None:
        return Written(None, 0)
    writer.close()
    stream.close()
    return Written(name, rows)


def _write_manifest(path: str, name: str, messages: list[Written | None]) -> None:
    """Whole or not at all: written aside and moved to its name."""
    from pyarrow import fs

    system, base = _open(path)
    files = [{"file": m.file, "rows": m.rows} for m in messages if m is not None and m.file is not None]
    system.create_dir(f"{base}/{MANIFESTS}", recursive=True)
    aside = f"{base}/{MANIFESTS}/.{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as out:
        out.write(json.dumps(files).encode())
    target = f"{base}/{MANIFESTS}/{name}.json"
    if not isinstance(system, fs.LocalFileSystem) and system.get_file_info(target).type != fs.FileType.NotFound:
        system.delete_file(target)  # of a repeated commit, where a move does not replace
    system.move(aside, target)


def _remove_files(path: str, messages: list[Written | None]) -> None:
    system, base = _open(path)
    for message in messages:
        if message is not None and message.file is not None:
            system.delete_file(f"{base}/{message.file}")


class _Batch(DataSourceArrowWriter):
    def __init__(self, path: str, name: str):
        self.path, self.name = path, name

    def write(self, iterator):
        return _write_file(self.path, iterator)

    def commit(self, messages) -> None:
        _write_manifest(self.path, self.name, messages)

    def abort(self, messages) -> None:
        _remove_files(self.path, messages)


class _Stream(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        return _write_file(self.path, iterator)

    def commit(self, messages, batchId) -> None:
        _write_manifest(self.path, f"batch-{batchId:012d}", messages)

    def abort(self, messages, batchId) -> None:
        _remove_files(self.path, messages)


class AppendSource(DataSource):
    """Options: ``path``; ``commit``, the name of a batch job's manifest."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("this table only grows: write in mode append")
        return _Batch(self.options["path"], self.options.get("commit") or f"run-{uuid.uuid4().hex}")

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _Stream(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AppendSource)


def append(df: DataFrame, path: str, commit: str | None = None) -> None:
    """Append the rows of a frame; a run that is repeated under one ``commit`` counts once."""
    register(df.sparkSession)
    writer = df.write.format(NAME).mode("append").option("path", path)
    (writer.option("commit", commit) if commit else writer).save()


def committed_files(path: str) -> list[str]:
    """Files that a manifest names."""
    from pyarrow import fs

    system, base = _open(path)
    selector = fs.FileSelector(f"{base}/{MANIFESTS}", allow_not_found=True)
    out = []
    for info in sorted(system.get_file_info(selector), key=lambda i: i.path):
        if info.path.endswith(".json"):
            with system.open_input_stream(info.path) as file:
                out += [f"{path}/{entry['file']}" for entry in json.loads(file.read())]
    return out


def read_appended(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows that were committed."""
    files = committed_files(path)
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
