"""Lines of text files as a source of batches and streams, and a sink of predictions whose failed tasks leave no line.

The source cuts files into ranges of bytes, a task for each; a line belongs to the range in which it begins. As a stream it
goes by how far each file has been read, up to its last line end, so that files may grow and new ones may come. The sink's
tasks write to a hidden folder beside the files; only what a whole batch has written is moved there, under names by which a batch that
is repeated replaces itself. Paths are those that pyarrow's file systems open: local and shared folders, HDFS and object stores.

The module imports nothing of this library and is sent to workers as it is.
"""

from __future__ import annotations

import io
import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

SOURCE, SINK = "text_line_ranges", "prediction_lines"
RANGE_BYTES = 64 << 20


def opened(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


def files_of(path: str) -> dict[str, int]:
    """Sizes of a file, or of the files in a folder; hidden ones and those whose names begin with _ are none of them."""
    from pyarrow import fs

    at, inner = opened(path)
    info = at.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else at.get_file_info(fs.FileSelector(inner, allow_not_found=True, recursive=True))
    hidden = lambda f: any(p[:1] in "._" for p in f.path[len(inner) :].split("/") if p)
    return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and not hidden(f)}


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


def ranges(path: str, begin: int, end: int, wide: int) -> list[Range]:
    return [Range(path, b, min(b + wide, end)) for b in range(begin, end, wide)]


def lines_in(where: str, r: Range) -> Iterator[tuple[str, int, str]]:
    """(file, offset, text) of the lines that begin in a range, stripped; blank ones are left out."""
    at, _ = opened(where)
    with io.BufferedReader(at.open_input_file(r.path), 1 << 20) as f:
        place = r.begin
        if place:  # unless the range begins with a line, its first one is the range's before
            f.seek(place - 1)
            place += len(f.readline()) - 1
        f.seek(place)
        while place < r.end and (line := f.readline()):
            text = line.decode("utf-8", "replace").strip()
            if text:
                yield r.path, place, text
            place += len(line)


class _Lines(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.wide = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        return [r for f, size in files_of(self.path).items() for r in ranges(f, 0, size, self.wide)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return lines_in(self.path, partition) if partition.path else iter(())


class _LineStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.wide = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def initialOffset(self) -> dict:
        return {"read": "{}"}

    def latestOffset(self) -> dict:
        return {"read": json.dumps({f: end for f, size in files_of(self.path).items() if (end := self._whole(f, size))}, sort_keys=True)}

    def _whole(self, path: str, size: int) -> int:
        """Bytes up to the last line end; what follows may still grow."""
        at, _ = opened(self.path)
        with at.open_input_file(path) as f:
            end, step = size, 1 << 16
            while end > 0:
                begin = max(0, end - step)
                f.seek(begin)
                cut = f.read(end - begin).rfind(b"\n")
                if cut >= 0:
                    return begin + cut + 1
                end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, now = json.loads(start["read"]), json.loads(end["read"])
        return [r for f, size in now.items() for r in ranges(f, before.get(f, 0), size, self.wide)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return lines_in(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return "file string, offset long, text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Lines(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _LineStream(self.options)


@dataclass
class Written(WriterCommitMessage):
    path: str
    lines: int


def prediction(row: Row, threshold: float) -> bytes:
    """Probability, flag and text, parted by tabs; line ends in a text become spaces."""
    text = " ".join((row["text"] or "").replace("\r", "\n").split("\n"))
    return f"{row['score']:.4f}\t{int(row['score'] >= threshold)}\t{text}\n".encode()


class _Sink:
    """What the batch and the stream writer share."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.threshold, self.overwrite = options["path"], float(options.get("threshold", 0.5)), overwrite
        self.pending = f"_pending-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        at, inner = opened(self.path)
        at.create_dir(f"{inner}/{self.pending}", recursive=True)
        name, n = f"{inner}/{self.pending}/{uuid.uuid4().hex}", 0
        with at.open_output_stream(name) as f:
            for row in rows:
                f.write(prediction(row, self.threshold))
                n += 1
        return Written(name, n)

    def _commit(self, messages: list, prefix: str) -> None:
        from pyarrow import fs

        at, inner = opened(self.path)
        old = [f for f in files_of(self.path) if self.overwrite or f.rsplit("/", 1)[1].startswith(prefix + "-")]
        for k, m in enumerate(m for m in messages if m is not None and m.lines):
            at.move(m.path, f"{inner}/{prefix}-{k:05d}.tsv")
        kept = {f"{inner}/{prefix}-{k:05d}.tsv" for k in range(sum(1 for m in messages if m is not None and m.lines))}
        for f in old:
            if f not in kept:
                at.delete_file(f)
        self._clear(at, inner, fs)

    def _clear(self, at, inner: str, fs) -> None:
        if at.get_file_info(f"{inner}/{self.pending}").type == fs.FileType.Directory:
            at.delete_dir(f"{inner}/{self.pending}")

    def abort(self, messages: list, *batch) -> None:
        from pyarrow import fs

        self._clear(*opened(self.path), fs)


class _BatchSink(_Sink, DataSourceWriter):
    def commit(self, messages: list) -> None:
        self._commit(messages, uuid.uuid4().hex)


class _StreamSink(_Sink, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self._commit(messages, f"batch-{batchId:09d}")


class PredictionSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return SINK

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _BatchSink(self.options, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamSink(self.options, False)


def register(spark: SparkSession) -> None:
    """Make the source and the sink known to a session by SOURCE and SINK."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(LineSource)
    spark.dataSource.register(PredictionSink)
