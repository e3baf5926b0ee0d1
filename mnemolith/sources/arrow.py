"""Arrow IPC streams as a Spark source and sink.

``spark.dataSource.register(ArrowStreams)`` and ``spark.read.format("arrow_streams")
.option("columns", "a,b").load(folder)``: one partition for each file, record
batches handed on as they are, only the wanted columns read. ``readStream`` and
``writeStream`` of the same format follow a folder's files and add to one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.streaming import StreamingQueryListener


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def stream_files(path: str) -> list[str]:
    """The Arrow files of a folder (or the file itself), sorted."""
    fs, root = file_system(path)
    info = fs.get_file_info(root)
    if info.type == pyarrow.fs.FileType.File:
        return [root]
    return sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)) if f.path.endswith(".arrow"))


class ArrowStreams(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_streams"

    def _columns(self) -> list[str]:
        return [c for c in self.options.get("columns", "").split(",") if c]

    def schema(self):
        fs, _ = file_system(self.options["path"])
        first = stream_files(self.options["path"])[0]
        with fs.open_input_stream(first) as f:
            every = pyarrow.ipc.open_stream(f).schema
        wanted = self._columns() or every.names
        return from_arrow_schema(pa.schema([every.field(c) for c in wanted]))

    def reader(self, schema) -> DataSourceReader:
        return ArrowStreamReader(self.options["path"], [f.name for f in schema.fields])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ArrowTail(self.options["path"], [f.name for f in schema.fields])

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return ArrowSink(self.options["path"], to_arrow_schema(schema))


class ArrowStreamReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in stream_files(self.path)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        with fs.open_input_stream(partition.value) as f:
            for batch in pyarrow.ipc.open_stream(f):
                yield batch.select(self.columns)


def write_streams(df: DataFrame, folder: str) -> int:
    """Each task writes one stream; a file gets its name only once it is whole, so a task run again leaves no half of one. Returns the rows written."""
    schema = to_arrow_schema(df.schema)
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = file_system(folder)
        part, n = f"{root}/part-{TaskContext.get().partitionId():05d}.arrow", 0
        half = f"{part}.{uuid.uuid4().hex}"
        with fs.open_output_stream(half) as f, pyarrow.ipc.new_stream(f, schema) as out:
            for b in batches:
                n += b.num_rows
                out.write_batch(pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(b.columns, schema.types)], schema=schema))
        fs.move(half, part)
        yield pa.record_batch([pa.array([n], pa.int64())], names=["rows"])

    return sum(r.rows for r in df.mapInArrow(write, "rows long").collect())  # one row for each task


# --- streaming ------------------------------------------------------------------------------------------------------------------


class Written(WriterCommitMessage):
    def __init__(self, half: str | None, rows: int):
        self.half, self.rows = half, rows


class ArrowTail(DataSourceStreamReader):
    """The files of a folder as they come, each micro-batch those after the last one's by name; a file for each task. Files are whole when they get their name, and later ones have larger names."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        names = [f.rsplit("/", 1)[-1] for f in stream_files(self.path)]
        return {"after": max(names, default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(f) for f in stream_files(self.path) if start["after"] < f.rsplit("/", 1)[-1] <= end["after"]]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return ArrowStreamReader(self.path, self.columns).read(partition)

    def commit(self, end: dict) -> None:
        pass


class ArrowSink(DataSourceStreamArrowWriter):
    """Tasks write files without their names; a micro-batch's commit names them all and then leaves a note with its number.

    A batch that is committed again after a loss finds its note and drops what it wrote, so no row comes twice; one that was cut
    off while it named its files names the rest the same way, and removes what the lost run had named.
    """

    def __init__(self, folder: str, schema: pa.Schema):
        self.folder, self.fields = folder, schema

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = file_system(self.folder)
        fs.create_dir(f"{root}/_tasks", recursive=True)
        half, n = f"{root}/_tasks/{uuid.uuid4().hex}", 0
        with fs.open_output_stream(half) as f, pyarrow.ipc.new_stream(f, self.fields) as out:
            for b in batches:
                n += b.num_rows
                out.write_batch(pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(b.columns, self.fields.types)], schema=self.fields))
        return Written(half, n)

    def _named(self, batch: int) -> list[str]:
        fs, root = file_system(self.folder)
        return [f for f in stream_files(self.folder) if f.rsplit("/", 1)[-1].startswith(f"batch-{batch:08d}-")]

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        fs, root = file_system(self.folder)
        note = f"{root}/_done/{batchId:08d}"
        fs.create_dir(f"{root}/_done", recursive=True)
        whole = [m for m in messages if m is not None]
        if fs.get_file_info(note).type == pyarrow.fs.FileType.File:
            self.abort(messages, batchId)
            return
        for left in self._named(batchId):
            fs.delete_file(left)
        for k, m in enumerate(whole):
            if m.rows:
                fs.move(m.half, f"{root}/batch-{batchId:08d}-{k:05d}.arrow")
            else:
                fs.delete_file(m.half)
        with fs.open_output_stream(note) as f:
            f.write(str(sum(m.rows for m in whole)).encode())

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        fs, _ = file_system(self.folder)
        for m in messages:
            if m is not None and fs.get_file_info(m.half).type == pyarrow.fs.FileType.File:
                fs.delete_file(m.half)


class EventLog(StreamingQueryListener):
    """What streaming queries report, as lines of JSON in a folder: a file for each event, so that an event is there whole or not at all."""

    def __init__(self, folder: str):
        self.folder, self.count = folder, 0

    def _note(self, kind: str, body: dict) -> None:
        fs, root = file_system(self.folder)
        fs.create_dir(root, recursive=True)
        half = f"{root}/_{uuid.uuid4().hex}"
        with fs.open_output_stream(half) as f:
            f.write((json.dumps({"number": self.count, "kind": kind, **body}) + "\n").encode())
        fs.move(half, f"{root}/{self.count:08d}-{kind}.json")
        self.count += 1

    def onQueryStarted(self, event) -> None:
        self._note("started", {"query": str(event.id), "name": event.name})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._note("progress", {"query": str(p.id), "name": p.name, "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._note("ended", {"query": str(event.id), "error": event.exception})


EVENT = "number long, kind string, query string, name string, batch long, rows long, error string"


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The events of a log as a table."""
    return spark.read.schema(EVENT).json(folder)
