"""The deck plan: parse, validate, measure answers, shuffle, report, export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cards as ops
from ..sinks import decks as sinks


@dataclass
class DeckRun:
    """What comes of a set of decks; every table has deck_id."""

    decks: DataFrame  # format, notes, error
    cards: DataFrame  # validated, with their texts
    rows: DataFrame  # to export
    report: DataFrame  # the pieces of the reports
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


#: Whether what is persisted may have as many partitions as its size asks for; else even a row a deck has those of a shuffle.
SIZED = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"


def held(df: DataFrame) -> DataFrame:
    """Persists rows in partitions by their size; Spark settles that here, so the session is left as it was."""
    conf = df.sparkSession.conf
    before = conf.get(SIZED)
    conf.set(SIZED, "true")
    try:
        return df.persist()
    finally:
        conf.set(SIZED, before)


def run(parsed: DataFrame, *, seed: int | None = None, drawn: bool = False) -> DeckRun:
    """From parsed decks to rows and the pieces of reports; options are shuffled by a seed, see ``export_rows``.

    The checked cards, with the rows of decks that have none, and the distributions are persisted, as each section of a report
    reads them; ``release`` drops them.  Of a card's fields only the texts are held.
    """
    whole = held(ops.texts_only(ops.checked(parsed)))
    decks = whole.groupBy("deck_id").agg(F.first("format").alias("format"), F.first("notes").alias("notes"), F.max("error").alias("error"))
    cards = whole.where(F.col("number").isNotNull())
    plain = ops.export_rows(cards)
    before = held(ops.distribution_warnings(ops.distribution(plain)))  # a row a deck
    rows = plain if seed is None else ops.export_rows(cards, seed=seed, drawn=drawn)
    after = None if seed is None else held(ops.distribution_warnings(ops.distribution(rows)))
    return DeckRun(decks, cards, rows, sinks.report_pieces(cards, decks.where(F.col("error").isNull()), before, after, seed=seed), (whole, before, *([] if after is None else [after])))
