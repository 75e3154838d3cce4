"""A committing sink: one named file a document, written piece by piece.

The rows of a file stand together and in order in one partition, which Spark sorts and spills; they are never gathered.  Each
task attempt writes to a folder of its own below the target, with the list of its names.  Only when all tasks are done does
the driver move the files of the attempts that count to their names; else the folders go, and the target is as it was.

Modes: ``error`` (the default of ``save``) fails before anything is moved if a name is taken; ``replace`` puts files in place
of those with the same name; ``overwrite`` also removes the target's other files, for which the driver holds the names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..sources.rows import map_rows
from ..sources.stores import store_of

FORMAT = "named-files"
NAMES, DONE, STAGING = "_names", "_SUCCESS", "_staging"
#: Bytes of a file that are read at a time.
CHUNK = 1 << 20
#: Files that are moved at a time.
MOVERS = 16
#: Bytes of an encoded id beyond which a file's name has a hash instead of its end: names are bounded.
LONGEST = 180


@dataclass
class Staged(WriterCommitMessage):
    """What a task has written: its folder, and how many files."""

    folder: str
    files: int


class NamedFiles(DataSource):
    """Writes rows (name, piece)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, piece string"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        if schema.fieldNames() != ["name", "piece"]:
            raise ValueError(f"rows must be (name, piece), not {schema.simpleString()}")
        mode = "overwrite" if overwrite else self.options.get("existing", "error")
        if mode not in ("error", "replace", "overwrite"):
            raise ValueError(f"no such mode: {mode}")
        return NamedFilesWriter(self.options["path"], mode, self.options.get("separator", ""), self.options.get("trim", "false").lower() == "true")


class OpenFile:
    """A file that pieces are added to: with a separator between them; trimmed, it ends with one line feed and no other white space."""

    def __init__(self, stream: Any, separator: str, trim: bool) -> None:
        self.stream, self.separator, self.trim = stream, separator, trim
        self.held, self.pieces = "", 0

    def add(self, piece: str) -> None:
        text = self.held + (self.separator if self.pieces else "") + piece
        self.pieces += 1
        solid = text.rstrip() if self.trim else text
        if solid:
            self.held = text[len(solid) :]
            self.stream.write(solid.encode())
        else:
            self.held = text

    def close(self) -> None:
        if self.trim:
            self.stream.write(b"\n")
        self.stream.close()


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, mode: str, separator: str = "", trim: bool = False) -> None:
        self.path, self.mode, self.separator, self.trim = path, mode, separator, trim
        self.job = f"{STAGING}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, root = store_of(self.path)
        folder = f"{root}/{self.job}/{uuid.uuid4().hex}"
        now: str | None = None
        held: OpenFile | None = None
        names: dict[str, None] = {}
        try:
            for batch in iterator:
                for name, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if name != now:
                        if held:
                            held.close()
                        if not name or name[0] in "._" or "/" in name or "\n" in name:
                            raise ValueError(f"not a file name: {name!r}")
                        if name in names:
                            raise ValueError(f"the rows of {name!r} don't stand together")
                        if not names:
                            store.create_dir(folder)
                        now, names[name] = name, None
                        held = OpenFile(store.open_output_stream(f"{folder}/{name}"), self.separator, self.trim)
                    held.add(piece or "")
            if held:
                held.close()
                with store.open_output_stream(f"{folder}/{NAMES}") as out:
                    for name in names:
                        out.write(f"{name}\n".encode())
        except BaseException:
            if store.get_file_info(folder).type != fs.FileType.NotFound:
                store.delete_dir(folder)
            raise
        return Staged(folder, len(names))

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = store_of(self.path)
        store.create_dir(root)
        folders = [m.folder for m in messages if m and m.files]
        try:
            if self.mode == "error":
                for _, name in staged(store, folders):
                    if store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                        raise FileExistsError(f"{self.path} has a file {name!r} already")
            stale: list[str] = []
            if self.mode == "overwrite":
                new = {name for _, name in staged(store, folders)}
                stale = [f.path for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and f.base_name not in new]
            with ThreadPoolExecutor(MOVERS) as movers:
                for _ in movers.map(lambda x: store.move(f"{x[0]}/{x[1]}", f"{root}/{x[1]}"), staged(store, folders)):
                    pass
                list(movers.map(store.delete_file, stale))
        finally:
            self.abort([])
        with store.open_output_stream(f"{root}/{DONE}"):
            pass

    def abort(self, messages: list[Staged | None]) -> None:
        """Everything that has been staged goes, also what lost attempts have left."""
        store, root = store_of(self.path)
        if store.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.job}")


def staged(store: fs.FileSystem, folders: Sequence[str]) -> Iterator[tuple[str, str]]:
    """(folder, name) of the files, a folder's list at a time."""
    for folder in folders:
        with store.open_input_stream(f"{folder}/{NAMES}") as names:
            for name in names.read().decode().splitlines():
                yield folder, name


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NamedFiles)


def file_name(key: Column, ending: str) -> Column:
    """A name that stands for an id in any store: percent signs for all but letters, digits and a few marks."""
    plain = F.regexp_replace(F.replace(F.url_encode(key), F.lit("+"), F.lit("%20")), r"^([._])", r"%$1")
    plain = F.replace(F.replace(plain, F.lit("%."), F.lit("%2E")), F.lit("%_"), F.lit("%5F"))
    short = F.when(F.length(plain) > LONGEST, F.concat(F.left(plain, F.lit(LONGEST - 65)), F.lit("~"), F.sha2(key, 256))).otherwise(plain)
    return F.concat(short, F.lit(ending))


def key_of(name: Column, ending: str) -> Column:
    """The id that a name of ``file_name`` stands for, if it was not too long."""
    return F.url_decode(F.regexp_replace(name, f"{ending.replace('.', chr(92) + '.')}$", ""))


def save(pieces: DataFrame, folder: str, *, name: Column, order: Sequence[str], mode: str = "error", separator: str = "", trim: bool = False) -> None:
    """Writes a file for each name, of the column ``piece`` of its rows in this order."""
    spark = pieces.sparkSession
    register(spark)
    rows = pieces.select(name.alias("name"), *order, "piece").repartition("name").sortWithinPartitions("name", *order).select("name", "piece")
    writer = rows.write.format(FORMAT).option("separator", separator).option("trim", str(trim).lower()).option("existing", mode)
    writer.mode("overwrite" if mode == "overwrite" else "append").option("path", folder).save()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of a folder's files."""
    return named(spark, folder).select("name", F.col("content").cast("string").alias("content"))


def named(spark: SparkSession, folder: str) -> DataFrame:
    """A folder's files with their names."""
    return spark.read.format("binaryFile").load(folder).withColumn("name", F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "^.*/", ""))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(name, n, digest) of a folder's files: characters and MD5.  A file of any size is read a chunk at a time."""

    def rows(name: str) -> list[dict]:
        store, root = store_of(folder)
        digest, n = hashlib.md5(), 0
        with store.open_input_stream(f"{root}/{name}") as stream:
            while chunk := stream.read(CHUNK):
                digest.update(chunk)
                # bytes that don't continue a character
                n += int(np.count_nonzero(np.frombuffer(chunk, np.uint8) & 0xC0 != 0x80))
        return [{"name": name, "n": n, "digest": digest.hexdigest()}]

    return map_rows(named(spark, folder).select("name"), rows, "name string, n long, digest string")


def text_of(pieces: DataFrame, order: Sequence[str], *, separator: str = "", trim: bool = False, show: Callable[[str], Any] | None = None) -> str:
    """The text of one document's pieces, which come to the driver a partition at a time: for what a command line prints."""
    text = separator.join(r.piece or "" for r in pieces.select(*order, "piece").orderBy(*order).toLocalIterator())
    text = text.rstrip() + "\n" if trim else text
    if show:
        show(text)
    return text
