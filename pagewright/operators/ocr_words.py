"""Recognised words to text: lines by runs of equal keys, an empty line between paragraphs, mean confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD_LEVEL = 5


def regroup(words: DataFrame, page: list[str]) -> DataFrame:
    """(page, text, confidence) from rows (page, word_idx, level, block_num, par_num, line_num, text, conf).

    A line ends where the key of the next word differs, even if the key comes back later.
    """
    kept = words.where((F.col("level") == WORD_LEVEL) & (F.regexp_replace("text", r"[\s\x1c-\x1f\x85\p{Z}]", "") != ""))
    order = Window.partitionBy(*page).orderBy("word_idx")
    line, paragraph = F.struct("block_num", "par_num", "line_num"), F.struct("block_num", "par_num")
    changed = lambda key: F.coalesce((~F.lag(key).over(order).eqNullSafe(key)).cast("int"), F.lit(1))
    first = F.row_number().over(order) == 1
    marked = kept.select(*page, "word_idx", "text", "conf", F.when(first, 0).otherwise(changed(line)).alias("new_line"), F.when(first, 0).otherwise(changed(paragraph)).alias("new_paragraph"))
    numbered = marked.withColumn("run", F.sum("new_line").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lines = numbered.groupBy(*page, "run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda w: w["text"]), " ").alias("line"), F.max("new_paragraph").alias("gap"),
        F.sum(F.when(F.col("conf") >= 0, F.col("conf"))).alias("conf_sum"), F.count(F.when(F.col("conf") >= 0, F.lit(1))).alias("conf_n"),
    )
    written = F.transform(F.array_sort(F.collect_list(F.struct("run", "line", "gap"))), lambda r: F.concat(F.when(r["gap"] == 1, F.lit("\n")).otherwise(F.lit("")), r["line"]))
    return lines.groupBy(*page).agg(F.array_join(written, "\n").alias("text"), F.when(F.sum("conf_n") > 0, F.sum("conf_sum") / F.sum("conf_n")).alias("confidence"))
