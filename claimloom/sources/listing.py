"""Files by their literal names as a Spark data source: hidden ones, names with glob characters, and long files in ranges.

Spark's own readers take no file whose name begins with ``_`` or ``.`` and read ``[1]`` in a path as a pattern.  This
source lists what lies below its inputs with a file system of Arrow's, makes a partition for about ``TASK_BYTES`` of
names and byte ranges, and opens each of them in the task; a file that can't be read is a row with its reason.
"""

from __future__ import annotations

import json
import os
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of files that one task opens one by one, and of a row where files are cut into ranges.
TASK_BYTES, RANGE_BYTES = 64 << 20, 4 << 20
ROWS = "path string, part bigint, parts bigint, content binary, error string"
_ARROW = pa.schema([("path", pa.string()), ("part", pa.int64()), ("parts", pa.int64()), ("content", pa.large_binary()), ("error", pa.string())])

Piece = tuple[str, int, int, int, int]  # path, part, parts, first byte, bytes


class Pieces(InputPartition):
    def __init__(self, pieces: list[Piece]):
        self.pieces = pieces


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and its name there; raises for stores that Arrow does not know."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)


def known(path: str) -> bool:
    try:
        return opened(path) is not None
    except (OSError, ValueError, NotImplementedError):
        return False


def present(inputs: list[str]) -> list[str]:
    """Inputs that exist; others are left out with a warning."""
    out = []
    for given in inputs:
        system, name = opened(given)
        if system.get_file_info(name).type == fs.FileType.NotFound:
            warnings.warn(f"no such input: {given}", stacklevel=3)
        else:
            out.append(given)
    return out


def listed(inputs: list[str]) -> Iterator[tuple[str, int]]:
    """(address, bytes) of all files that inputs name or that lie below them, each once, in order of their names."""
    found: dict[str, tuple[str, int]] = {}
    for given in inputs:
        system, name = opened(given)
        local = isinstance(system, fs.LocalFileSystem)
        info = system.get_file_info(name)
        if info.type == fs.FileType.NotFound:
            continue
        below = [info] if info.type != fs.FileType.Directory else system.get_file_info(fs.FileSelector(name, recursive=True))
        for file in below:
            if file.type not in (fs.FileType.File, fs.FileType.Unknown):
                continue
            true = os.path.realpath(file.path) if local else file.path
            address = f"file:{file.path}" if local else f"{given.split(':')[0]}://{file.path}"
            found.setdefault(true, (address, file.size or 0))
    return iter(sorted(found.values()))


class Files(DataSource):
    """``spark.read.format("named_files").option("inputs", json)``; ``only``/``never``: patterns of names; ``range_bytes``: 0 for whole files."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.inputs = json.loads(options["inputs"])
        self.only, self.never = options.get("only"), options.get("never")
        self.range_bytes = int(options.get("range_bytes", 0))

    def partitions(self) -> list[Pieces]:
        out: list[list[Piece]] = [[]]
        room = TASK_BYTES
        for path, size in listed(self.inputs):
            if self.only and not re.search(self.only, path) or self.never and re.search(self.never, path):
                continue
            step = self.range_bytes or max(size, 1)
            parts = max(1, -(-size // step))
            for part in range(parts):
                length = min(step, size - part * step)
                if room < length and out[-1]:
                    out.append([])
                    room = TASK_BYTES
                out[-1].append((path, part, parts, part * step, length))
                room -= length
        return [Pieces(p) for p in out]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        for path, part, parts, start, length in partition.pieces:
            content, error = None, None
            try:
                system, name = opened(path)
                with system.open_input_file(name) as file:
                    content = file.read_at(length, start)
            except OSError as e:  # one file must not stop the others; the reason is kept
                error = f"{type(e).__name__}: {e}"
            yield pa.record_batch([[path], [part], [parts], pa.array([content], pa.large_binary()), [error]], schema=_ARROW)


def pieces_of(spark: SparkSession, inputs: list[str], only: str | None = None, never: str | None = None, range_bytes: int = 0) -> DataFrame:
    """``path``, ``part`` of ``parts``, ``content``, ``error`` of the files below ``inputs`` whose names fit."""
    spark.dataSource.register(Files)
    read = spark.read.format("named_files").option("inputs", json.dumps(inputs)).option("range_bytes", range_bytes)
    for key, value in (("only", only), ("never", never)):
        read = read.option(key, value) if value else read
    return read.load()


def through_spark(spark: SparkSession, inputs: list[str]) -> DataFrame:
    """The same rows of whole files from stores that only Spark's readers open.  Hidden names are left out there, with a warning."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    plain = []
    for given in inputs:
        path = jvm.org.apache.hadoop.fs.Path(given)
        if not path.getFileSystem(conf).exists(path):
            warnings.warn(f"no such input: {given}", stacklevel=3)
        elif path.getName().startswith(("_", ".")):
            warnings.warn(f"hidden names can't be read from this store: {given}", stacklevel=3)
        else:
            plain.append(re.sub(r"([\[\]{}*?\\])", r"\\\1", given))
    if not plain:
        return spark.createDataFrame([], ROWS)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(plain).dropDuplicates(["path"])
    return raw.select("path", F.lit(0).cast("bigint").alias("part"), F.lit(1).cast("bigint").alias("parts"), "content", F.lit(None).cast("string").alias("error"))


def write_named(files: DataFrame, folder: str) -> None:
    """Write rows (``name``, ``content`` binary) as files of these names below ``folder``, each by the task that holds it.

    A task that runs again writes the same bytes under the same name.  The folder must be shared, and one that Arrow opens.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = opened(folder)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = f"{at}/{name}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(target) as out:
                    out.write(content)
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    files.select("name", "content").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
