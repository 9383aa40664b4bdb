"""Rows written as one file each, and read back by name: a Python data source for asset folders.

A writer can announce its files: tables of names in ``ANNOUNCED`` below the folder, which file sources leave out as
hidden. A stream of these needs no list of the files themselves, which Spark would hold in the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from pixelyard.sources.publish import publish

SCHEMA = "name string, content binary"
BINARY_FILE = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
ANNOUNCED = "_announced"
#: Bytes of content, and files, that a reading task holds at a time.
BATCH_BYTES, BATCH_FILES = 8 << 20, 1000


@dataclass
class _Written(WriterCommitMessage):
    files: int
    announced: tuple[str, ...] = ()


def _at(path: str) -> tuple:
    """The file system of a path, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _FileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, announce: int = 0):
        self.path, self.announce = path, announce

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        import uuid

        files, root = _at(self.path)
        made: set[str] = set()
        n, names, announced = 0, [], []
        for batch in iterator:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                target = f"{root}/{name.as_py()}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                # Hidden until it is whole; a repeated task writes the same file again.
                staged = f"{folder}/.{uuid.uuid4().hex}"
                with files.open_output_stream(staged) as out:
                    if content.is_valid:
                        out.write(content.as_buffer())
                files.move(staged, target)
                n += 1
                if self.announce:
                    names.append(name.as_py())
                    if len(names) == self.announce:
                        announced.append(self._stage(files, root, names))
                        names = []
        if names:
            announced.append(self._stage(files, root, names))
        return _Written(n, tuple(announced))

    def _stage(self, files, root: str, names: list[str]) -> str:
        """Hidden until all tasks are done: a task that is repeated announces nothing twice."""
        import uuid

        import pyarrow as pa
        from pyarrow import parquet

        files.create_dir(f"{root}/{ANNOUNCED}", recursive=True)
        name = f"{uuid.uuid4().hex}.parquet"
        with files.open_output_stream(f"{root}/{ANNOUNCED}/.{name}") as out:
            parquet.write_table(pa.table({"name": pa.array(names, pa.string())}), out)
        return name

    def commit(self, messages: list) -> None:
        files, root = _at(self.path)
        if self.announce:
            files.create_dir(f"{root}/{ANNOUNCED}", recursive=True)
        for message in messages:
            for name in message.announced:
                files.move(f"{root}/{ANNOUNCED}/.{name}", f"{root}/{ANNOUNCED}/{name}")

    def abort(self, messages: list) -> None:
        files, root = _at(self.path)
        for message in messages:
            for name in message.announced if message is not None else ():
                files.delete_file(f"{root}/{ANNOUNCED}/.{name}")


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "one_file_per_row"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool):
        return _FileWriter(self.options["path"], int(self.options.get("announce", 0)))


def append_files(df: DataFrame, folder: str, name: str = "name", content: str = "content", announce: int = 0) -> None:
    """Writes each row as a file below ``folder``, beside those that are there.

    ``name`` is a relative path and must be unique (of two rows of a name one stays); a null content is an
    empty file, and rows without a name are left out. Files appear by a rename, so a lost task
    leaves no half file under a final name, and its repetition writes the same files. The
    folder needs a scheme that ``pyarrow.fs`` knows.

    With ``announce`` the names of the files, up to so many to a table, are announced when all files of this call
    are there; a name that is given twice is announced twice.
    """
    df.sparkSession.dataSource.register(FileSink)
    rows = df.where(F.col(name).isNotNull()).select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content"))
    rows.write.format(FileSink.name()).option("announce", announce).mode("append").save(folder)


def read_named(names: DataFrame, folder: str, max_file_bytes: int) -> DataFrame:
    """The files of the column ``name`` below ``folder``, read where their names are: ``BINARY_FILE`` rows. Files above
    ``max_file_bytes`` come without their content, which is not read; files without bytes are left out, as by Spark's source."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("content", pa.binary())])
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        files, root = _at(folder)
        rows, held = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_FILES):
                part = batch.column(0).slice(start, BATCH_FILES).to_pylist()
                for name, info in zip(part, files.get_file_info([f"{root}/{n}" for n in part]), strict=True):
                    if info.size is None:
                        raise FileNotFoundError(f"{folder}/{name} was announced and is not there")
                    if info.size == 0:
                        continue
                    content = None
                    if info.size <= max_file_bytes:
                        with files.open_input_stream(info.path) as source:
                            content = source.read()
                        held += len(content)
                    rows.append((f"{folder}/{name}", info.mtime, info.size, content))
                    if held >= BATCH_BYTES or len(rows) >= BATCH_FILES:
                        yield batch_of(rows)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return names.select("name").mapInArrow(read, BINARY_FILE)


def write_files(df: DataFrame, path: str, name: str = "name", content: str = "content") -> str:
    """``append_files`` into a version of its own below ``path``, which becomes the current one when all
    files are there; returns its folder."""
    return publish(df.sparkSession, path, lambda folder: append_files(df, folder, name, content))
