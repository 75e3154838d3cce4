"""File-stream ingest of decks, an extension: each new file is parsed and validated once, as a batch of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cards import export_rows, validate
from ..sinks.decks import tsv_line
from ..sources.decks import parse_decks

FILES = "path string, modificationTime timestamp, length long, content binary"


def deck_stream(spark: SparkSession, folder: str, *, files_a_batch: int = 1000) -> DataFrame:
    """(deck_id, content) of the files that come into a folder."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_a_batch).load(folder)
    return stream.select(F.col("path").alias("deck_id"), "content")


def export_stream(decks: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the export rows of each batch's decks; a batch that is run again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        rows = export_rows(validate(parse_decks(batch)))
        rows.select("deck_id", "number", tsv_line().alias("line")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return decks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
