"""Shuffles that follow one seeded generator through the cards of a deck, in their order.

The generator's n-th shuffle depends on the seed and n alone, so cards need their rank among those that are shuffled, and
each worker makes the orders up to the largest rank that it meets, once a seed: a byte a card of the longest deck, which
is a file that one task has parsed.
"""

from __future__ import annotations

import functools
import itertools
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .. import config as C

#: Cards that are ranked together; ranks go on from the counts of the blocks before.
BLOCK = 4096
ORDERS = tuple(itertools.permutations(range(len(C.LETTERS))))


class Draws:
    """The orders of one seed as far as they were asked for, each by its number in ``ORDERS``."""

    def __init__(self, seed: int) -> None:
        self.generator, self.made = random.Random(seed), bytearray()
        self.number = {order: n for n, order in enumerate(ORDERS)}

    def upto(self, rank: int) -> bytearray:
        for _ in range(rank - len(self.made)):
            order = [*range(len(C.LETTERS))]
            self.generator.shuffle(order)
            self.made.append(self.number[tuple(order)])
        return self.made


@functools.lru_cache(maxsize=1)
def draws_of(seed: int) -> Draws:
    return Draws(seed)


def order_number(seed: int, rank: Column) -> Column:
    """The number of the order that the generator draws at a rank from 1."""

    @pandas_udf(T.IntegerType())
    def drawn(ranks: pd.Series) -> pd.Series:
        made = draws_of(seed).upto(int(ranks.max())) if len(ranks) else bytearray()
        return pd.Series(np.array(made, np.int32)[ranks.to_numpy() - 1])

    return drawn(rank)


def ranked(cards: DataFrame) -> DataFrame:
    """Adds rank: the place from 1 of a card among the deck's cards, by number.

    No task sorts more than a block of a deck; the counts of its blocks are a row each.
    """
    held = cards.withColumn("_block", F.floor(F.col("number") / BLOCK))
    counts = held.groupBy("deck_id", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("deck_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("deck_id").alias("_deck"), F.col("_block").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = F.row_number().over(Window.partitionBy("deck_id", "_block").orderBy("number"))
    placed = held.withColumn("_inner", inner).join(starts, F.col("deck_id").eqNullSafe(F.col("_deck")) & F.col("_block").eqNullSafe(F.col("_of")))
    return placed.withColumn("rank", (F.col("_start") + F.col("_inner")).cast("long")).drop("_block", "_deck", "_of", "_start", "_inner")


def drawn_options(cards: DataFrame, options: str, seed: int) -> DataFrame:
    """The cards with their options in the order that the seed's generator gives them, deck by deck."""
    places = F.get(F.array(*(F.array(*map(F.lit, order)) for order in ORDERS)), F.col("_order"))
    drawn = ranked(cards).withColumn("_order", order_number(seed, F.col("rank")))
    return drawn.withColumn(options, F.transform(places, lambda p: F.get(options, p))).drop("_order", "rank")
