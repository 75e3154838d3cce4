"""Quality rules: base counts, and importance weights of hashed n-grams.

Runs of ``ORDER`` bytes are hashed into ``BUCKETS`` bins.  Two multinomials over the bins are counted, one over all
documents (raw) and one over the trusted ones (target), both smoothed.  A document's score is the log-likelihood ratio
of its n-grams under the two, over their number.  It is kept if it passes the base rules and its score is at least
``THRESHOLD``: the same fixed number for every document, so a verdict depends on nothing but the text and the counts.

The counts come from every document.  Each task adds up its own bins before the shuffle, and the driver gets one row a
bin, whatever the input.

Defined cases: a null text has no words and fails the base; without trusted documents the score of every document is 0;
a score equal to the threshold is kept; repeated rows count as often as they occur and get equal rows; rows without
id count too and are never trusted; long texts are read whole; an empty table gives an empty result; other columns are
left alone, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, prepare, row_chunks, string_parts, text_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
ORDER = 4
#: A power of two.
BUCKETS = 1 << 16
MIN_WORDS, MOST_REPEATED = 50, 50
THRESHOLD = -1.0
SMOOTHING = 1.0
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double"


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, duplicate lines and words in repeated three-word windows."""
    words = WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return n, sum(map(len, words)), len(SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated


def bins_of(data: np.ndarray, offsets: np.ndarray, buckets: int, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the n-grams of UTF-8 bytes of each row, and the row of each; a shorter row has none."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = np.zeros(n, np.uint64)
    for i in range(order):
        grams = grams << np.uint64(8) | data[i : i + n]
    lengths = np.diff(offsets)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    within = rows[:n] == rows[order - 1 :]
    bins = (grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)
    return bins[within], rows[:n][within]


def _counter(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, trusted = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = string_parts(batch.column(1))
            mark = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for low, high in row_chunks(offsets):
                bins, rows = bins_of(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], buckets)
                raw += np.bincount(bins, minlength=buckets)
                trusted += np.bincount(bins[mark[low:high][rows]], minlength=buckets)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(raw[seen]), pa.array(trusted[seen])], ["bin", "raw", "trusted"])

    return run


def ratios(documents: DataFrame, trusted: DataFrame, *, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of the smoothed target and raw frequencies of each bin; ``trusted`` names the trusted documents."""
    prepare(documents.sparkSession)
    ids = trusted.select(F.col(key).cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("t", F.lit(True))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    marked = documents.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text")).join(ids, "doc_id", "left").select(F.coalesce("t", F.lit(False)).alias("t"), "text")
    sums = marked.mapInArrow(_counter(buckets), "bin int, raw long, trusted long").groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in sums.collect():  # a row a bin at most
        raw[r["bin"]], target[r["bin"]] = r["raw"], r["trusted"]
    if not target.sum():
        return np.zeros(buckets)
    share = raw.sum() / target.sum()
    # smoothed toward the raw frequencies, so a bin of which little is known says little
    p = (target * share + SMOOTHING * share * (raw + 1) / (raw.sum() + buckets) * buckets / 64) / (raw.sum() + SMOOTHING * share * buckets / 64)
    return np.log(p) - np.log((raw + 1) / (raw.sum() + buckets))


def measured(texts: pa.Array, weights: np.ndarray) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray]:
    """The base counts and the mean weight of the n-grams of each text."""
    data, offsets = string_parts(texts)
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for low, high in row_chunks(offsets):
        bins, rows = bins_of(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], len(weights))
        total[low:high] = np.bincount(rows, weights[bins], minlength=high - low)
        n[low:high] = np.bincount(rows, minlength=high - low)
    return [base_counts(x.as_py()) for x in texts], total / np.maximum(n, 1)


def score(documents: DataFrame, weights: np.ndarray, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The base counts and the length-normalised log-likelihood ratio of every document."""
    spark = documents.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))  # one number a bin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value.astype(np.float64)
        for batch in batches:
            counts, llr = measured(batch.column(1), held)
            columns = list(zip(*counts, strict=True)) if counts else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(llr)], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr"])

    return documents.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, SCHEMA)


def verdicts(documents: DataFrame, trusted: DataFrame, *, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Every document's counts, score and verdict."""
    scored = score(documents, ratios(documents, trusted, buckets=buckets))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def kept_documents(documents: DataFrame, trusted: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``documents`` whose verdict is to keep them, unchanged and without a shuffle of texts."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(ratios(documents, trusted, key=key, text=text, buckets=buckets).astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value.astype(np.float64)
        for batch in batches:
            texts = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "")
            counts, llr = measured(texts, held)
            keep = [n >= MIN_WORDS and 100 * again <= MOST_REPEATED * n and r >= threshold for (n, _, _, _, again), r in zip(counts, llr.tolist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def trusted_of(labels: DataFrame) -> DataFrame:
    """The documents that are labelled good and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def report(found: DataFrame) -> DataFrame:
    """The digest columns of the query, and the score."""
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
