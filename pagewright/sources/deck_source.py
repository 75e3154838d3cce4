"""Question decks as a Spark data source: ``spark.read.format("question-decks").load(folder)``; ``load`` completes its rows.

Files are planned by their bytes: a partition is a run of files of some megabytes, or one larger file.  Filters on deck_id
choose files, so a selection of decks lists the folder but opens only its own files; filters on the card's number choose the
cards that are worked out.  With a schema of fewer columns (``spark.read.schema(...)``), only these are.

Options: ``path`` (a file or a folder), ``glob`` (names to read), ``ids`` (``path``, or ``name`` for the decoded file name
without its ending), ``partitionBytes``.  Paths go to Arrow's stores; ``sources.decks.read_decks`` with ``parse_decks`` reads
what only Spark's own readers reach.
"""

from __future__ import annotations

import fnmatch
import urllib.parse
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as S
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .decks import RAW, completed, deck_rows
from .stores import store_of

FORMAT = "question-decks"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
PARTITION_BYTES = 32 << 20
#: What opening a file costs, in bytes read.
OPENING = 1 << 20
ROWS = 2000
COLUMNS = ("deck_id", "format", "notes", "error", "number", "py_type", "label", "keys", "question", "answer", "explanation", "options")


@dataclass
class Files(S.InputPartition):
    """Files of a partition: (id, path)."""

    files: tuple[tuple[str, str], ...]

    def __init__(self, files: Iterable[tuple[str, str]]) -> None:
        self.files = tuple(files)
        super().__init__(len(self.files))


COMPARE: dict[type, Callable[[Any, Any], bool]] = {
    S.EqualTo: lambda a, b: a == b, S.EqualNullSafe: lambda a, b: a == b, S.In: lambda a, b: a in b, S.GreaterThan: lambda a, b: a > b,
    S.GreaterThanOrEqual: lambda a, b: a >= b, S.LessThan: lambda a, b: a < b, S.LessThanOrEqual: lambda a, b: a <= b, S.StringStartsWith: lambda a, b: a.startswith(b), S.IsNotNull: lambda a, _: a is not None,
}


def holds(conditions: Sequence[tuple[type, Any]], value: Any) -> bool:
    """Whether a value passes all conditions; null passes none."""
    return all(value is not None and COMPARE[kind](value, wanted) for kind, wanted in conditions)


class DeckReader(S.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.ids, self.most = options.get("ids", "path"), int(options.get("partitionBytes", PARTITION_BYTES))
        if self.ids not in ("path", "name"):
            raise ValueError("ids must be path or name")
        self.fields = schema
        self.where: dict[str, list[tuple[type, Any]]] = {"deck_id": [], "number": []}

    def pushFilters(self, filters: list[S.Filter]) -> Iterable[S.Filter]:  # noqa: N802
        for f in filters:
            conditions = self.where.get(".".join(f.attribute)) if type(f) in COMPARE else None
            wanted = getattr(f, "value", None)
            if conditions is None or (wanted is None and not isinstance(f, S.IsNotNull)):
                yield f
            else:
                conditions.append((type(f), wanted))

    def listed(self) -> Iterator[tuple[str, str, int]]:
        """(id, path, bytes) of the files that may have cards that pass."""
        store, root = store_of(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        for f in sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path):
            inner = f.path[len(root) :].strip("/") or f.base_name
            if any(part[0] in "._" for part in inner.split("/")) or not fnmatch.fnmatchcase(f.base_name, self.glob):
                continue
            key = f.path if self.ids == "path" else urllib.parse.unquote(f.base_name.rpartition(".")[0] or f.base_name)
            if holds(self.where["deck_id"], key):
                yield key, f.path, f.size or 0

    def partitions(self) -> Sequence[S.InputPartition]:
        out, held, size = [], [], 0
        for key, path, n in self.listed():
            if held and size + n + OPENING > self.most:
                out.append(Files(held))
                held, size = [], 0
            held.append((key, path))
            size += n + OPENING
        return [*out, Files(held)] if held or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        arrow, wanted = to_arrow_schema(self.fields), frozenset(self.fields.fieldNames())
        chosen = (lambda n: holds(self.where["number"], n)) if self.where["number"] else None
        rows: list[dict] = []
        for key, path in partition.files:
            with store.open_input_file(path) as file:
                rows += deck_rows(key, file.read(), wanted=wanted, chosen=chosen)
            if len(rows) >= ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)


class QuestionDecks(S.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return RAW

    def reader(self, schema: StructType) -> DeckReader:
        if odd := [c for c in schema.fieldNames() if c not in COLUMNS]:
            raise ValueError(f"decks have no such columns: {', '.join(odd)}")
        return DeckReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed to Python sources."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(QuestionDecks)


def load(spark: SparkSession, path: str, *, columns: Sequence[str] = (), **options: str) -> DataFrame:
    """Parsed cards of the decks in a folder: all columns, or some."""
    register(spark)
    reader = spark.read.format(FORMAT).options(**options)
    if columns:
        reader = reader.schema(StructType([f for f in StructType.fromDDL(RAW) if f.name in columns]))
    return completed(reader.load(path))
