"""Layout of a page: columns, reading order, images, block sizes, ink.

Blocks are an array of structs (seq, x0, y0, x1, y1, text, type) in output order; images an array of (x0, y0, x1, y1).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..config import ANALYSIS_DPI, BOX_PADDING, COLUMN_CHARS, COLUMN_MARGIN, INK_DELTA, JUMP_LEFT, JUMP_UP, SIGNIFICANT_IMAGE
from ..functions.text import count_chars, let, without_space


def text_blocks(blocks: Column, by_position: bool = False) -> Column:
    """Blocks of text that is not blank, in output order, or from top to bottom and left to right."""
    kept = F.filter(blocks, lambda b: (b["type"] == 0) & (without_space(b["text"]) != ""))
    if by_position:
        keyed = F.array_sort(F.transform(kept, lambda b: F.struct(b["y0"].alias("y"), b["x0"].alias("x"), b["seq"].alias("s"), b.alias("b"))))
        return F.transform(keyed, lambda k: k["b"])
    return F.transform(F.array_sort(F.transform(kept, lambda b: F.struct(b["seq"].alias("s"), b.alias("b")))), lambda k: k["b"])


def joined_text(blocks: Column) -> Column:
    """The blocks' texts with an empty line between them."""
    return F.array_join(F.transform(blocks, lambda b: F.btrim(b["text"], F.lit("\n"))), "\n\n")


def beside(left: Column, right: Column) -> Column:
    """Whether a block of one side overlaps in height with one of the other: one sweep down the page.

    Blocks of the left come by their upper edges, those of the right by their lower edges.  When one of the right comes, the
    blocks of the left so far all start above its end, and one overlaps if the lowest end among them is below its start.
    """
    event = lambda y, kind, other: F.struct(y.cast("double").alias("y"), F.lit(kind).alias("kind"), other.cast("double").alias("other"))
    events = F.array_sort(F.concat(F.transform(left, lambda b: event(b["y0"], 1, b["y1"])), F.transform(right, lambda b: event(b["y1"], 0, b["y0"]))))
    start = F.struct(F.lit(float("-inf")).alias("low"), F.lit(False).alias("found"))
    step = lambda a, e: F.struct(F.when(e["kind"] == 1, F.greatest(a["low"], e["other"])).otherwise(a["low"]).alias("low"), (a["found"] | ((e["kind"] == 0) & (a["low"] > e["other"]))).alias("found"))
    return F.aggregate(events, start, step, lambda a: a["found"])


def multi_column(blocks: Column, left_edge: Column, width: Column) -> Column:
    """Two or more large blocks on either half of the page, with a pair side by side."""
    middle, margin = left_edge + width / 2, width * COLUMN_MARGIN
    large = F.filter(blocks, lambda b: count_chars(b["text"]) >= COLUMN_CHARS)
    sides = let(large, lambda held: F.struct(F.filter(held, lambda b: b["x1"] <= middle + margin).alias("left"), F.filter(held, lambda b: b["x0"] >= middle - margin).alias("right")))
    return let(sides, lambda s: (F.size(s["left"]) >= 2) & (F.size(s["right"]) >= 2) & beside(s["left"], s["right"]))


def order_jumps(blocks: Column) -> Column:
    """Times that the next block starts well above the one before without being to its right."""
    n = F.greatest(F.size(blocks) - 1, F.lit(0))
    steps = F.zip_with(F.slice(blocks, F.lit(1), n), F.slice(blocks, F.lit(2), n), lambda a, b: (b["y0"] < a["y0"] - JUMP_UP) & (b["x0"] < a["x1"] - JUMP_LEFT))
    return F.size(F.filter(steps, lambda s: s))


def order_jumps_rows(blocks: DataFrame, page: list[str]) -> DataFrame:
    """The same from rows of blocks: (page, order_jumps)."""
    order = Window.partitionBy(*page).orderBy("seq")
    jump = (F.col("y0") < F.lag("y0").over(order) - JUMP_UP) & (F.col("x0") < F.lag("x1").over(order) - JUMP_LEFT)
    return blocks.select(*page, jump.alias("jump")).groupBy(*page).agg(F.count_if("jump").alias("order_jumps"))


def multi_column_rows(blocks: DataFrame, pages: DataFrame, page: list[str]) -> DataFrame:
    """The same from rows of blocks and of pages (x0, width): (page, multi_column), by a window that Spark sorts and spills."""
    middle, margin = F.col("_x") + F.col("width") / 2, F.col("width") * COLUMN_MARGIN
    held = pages.select(*page, F.col("x0").alias("_x"), "width").join(blocks.where(count_chars(F.col("text")) >= COLUMN_CHARS), page)
    event = lambda on, y, kind, other: F.when(on, F.struct(F.col(y).alias("y"), F.lit(kind).alias("kind"), F.col(other).alias("other")))
    events = F.array_compact(F.array(event(F.col("x1") <= middle + margin, "y0", 1, "y1"), event(F.col("x0") >= middle - margin, "y1", 0, "y0")))
    swept = held.select(*page, F.explode(events).alias("e")).select(*page, "e.*")
    low = F.max(F.when(F.col("kind") == 1, F.col("other"))).over(Window.partitionBy(*page).orderBy("y", "kind"))
    found = swept.withColumn("found", (F.col("kind") == 0) & F.coalesce(low > F.col("other"), F.lit(False)))
    counts = found.groupBy(*page).agg(((F.count_if(F.col("kind") == 1) >= 2) & (F.count_if(F.col("kind") == 0) >= 2) & F.bool_or("found")).alias("multi_column"))
    return pages.select(*page).join(counts, page, "left").select(*page, F.coalesce("multi_column", F.lit(False)).alias("multi_column"))


def median_chars(blocks: Column) -> Column:
    """Median of the blocks' characters; 0 without blocks."""
    sizes = F.array_sort(F.transform(blocks, lambda b: count_chars(b["text"])))
    n = F.size(sizes)
    middle = (F.get(sizes, F.floor((n - 1) / 2).cast("int")) + F.get(sizes, F.floor(n / 2).cast("int"))) / 2.0
    return F.when(n > 0, middle).otherwise(F.lit(0.0))


def image_shares(images: Column, x0: Column, y0: Column, width: Column, height: Column) -> Column:
    """The share of the page that each image covers, for images that meet the page."""
    area = F.greatest(width * height, F.lit(1.0))
    clip = lambda i: (F.least(i["x1"], x0 + width) - F.greatest(i["x0"], x0), F.least(i["y1"], y0 + height) - F.greatest(i["y0"], y0))
    shares = F.transform(images, lambda i: F.when((clip(i)[0] > 0) & (clip(i)[1] > 0), clip(i)[0] * clip(i)[1] / area))
    return F.filter(shares, lambda s: s.isNotNull())


def image_coverage(shares: Column) -> Column:
    """Sum of the shares, counting overlaps twice, and 1 at most."""
    return F.least(F.aggregate(shares, F.lit(0.0), lambda a, s: a + s), F.lit(1.0))


def image_count(shares: Column) -> Column:
    return F.size(F.filter(shares, lambda s: s >= SIGNIFICANT_IMAGE))


def ink(samples: bytes, width: int, height: int, stride: int, boxes: list[tuple[float, float, float, float]], x0: float, y0: float) -> tuple[float, float]:
    """Shares of pixels off the background, and of those outside all padded text boxes.

    The background is the most frequent grey level, the darkest of equally frequent ones.
    """
    if not width or not height:
        return 0.0, 0.0
    grey = np.frombuffer(samples, np.uint8)
    grey = np.lib.stride_tricks.as_strided(grey, (height, width), (stride, 1))
    background = int(np.bincount(grey.ravel(), minlength=256).argmax())
    marked = np.abs(grey.astype(np.int16) - background) > INK_DELTA
    total = int(marked.sum())
    zoom = ANALYSIS_DPI / 72
    outside = np.ones((height, width), bool)
    for left, top, right, bottom in boxes:
        # to the pixel that holds the edge; truncated toward zero
        columns = max(0, int((left - x0 - BOX_PADDING) * zoom)), min(width, int((right - x0 + BOX_PADDING) * zoom) + 1)
        rows = max(0, int((top - y0 - BOX_PADDING) * zoom)), min(height, int((bottom - y0 + BOX_PADDING) * zoom) + 1)
        if columns[0] < columns[1] and rows[0] < rows[1]:
            outside[rows[0] : rows[1], columns[0] : columns[1]] = False
    return total / (width * height), int((marked & outside).sum()) / (width * height)


@pandas_udf(T.StructType([T.StructField("ink_ratio", T.DoubleType()), T.StructField("nontext_ink_ratio", T.DoubleType())]))
def ink_udf(raster: pd.DataFrame, blocks: pd.Series, x0: pd.Series, y0: pd.Series) -> pd.DataFrame:
    rows = []
    for (w, h, stride, samples), held, a, b in zip(raster[["w", "h", "stride", "samples"]].itertuples(index=False), blocks, x0, y0, strict=True):
        boxes = [(k["x0"], k["y0"], k["x1"], k["y1"]) for k in held] if held is not None else []
        rows.append(ink(samples, int(w), int(h), int(stride), boxes, a, b) if samples is not None else (0.0, 0.0))
    return pd.DataFrame(rows, columns=["ink_ratio", "nontext_ink_ratio"])


#: Rows that go to Python at a time: rasters are large.
RASTERS = 256


def with_ink(rows: DataFrame, name: str, raster: Column | str, blocks: Column | str, x0: Column | str, y0: Column | str) -> DataFrame:
    """Adds the ink of each raster, in Arrow batches whose rows are bounded, so a worker's memory does not grow with the partition."""
    conf = rows.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= RASTERS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(RASTERS))
    return rows.withColumn(name, ink_udf(raster, blocks, x0, y0))


def background_rows(pixels: DataFrame, page: list[str], grey: str = "grey") -> DataFrame:
    """The most frequent grey level of each page, the lowest of equally frequent ones, from rows of pixels."""
    counts = pixels.groupBy(*page, grey).agg(F.count("*").alias("n"))
    return counts.groupBy(*page).agg(F.max_by(grey, F.struct("n", -F.col(grey))).alias("background"), F.sum("n").alias("pixels"))
