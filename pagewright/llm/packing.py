"""Pattern packing of documents into sequences, by non-negative least squares on the histogram of lengths.

Each document becomes its token ids and one end id.  Longer ones are cut into pieces of full capacity, the first piece
being the shorter one.  Only the histogram of piece lengths, which has no more entries than the capacity, reaches the
driver.  There:

1. patterns of one to four lengths that fill a sequence exactly are enumerated from the lengths that occur,
2. non-negative repeat counts are fitted so that the patterns' pieces come close to the histogram,
3. the counts are rounded down to what the histogram still has,
4. the residual is packed by best fit, longest first, on counts of equal lengths.

Pieces are put in order of length and get a running number; a pattern's share of a length is a range of those numbers,
so every piece finds its sequence and offset by itself.

Tokens are those of the ``tokenizers`` file given by path.  The same vocabulary runs in ``tiktoken``, which is faster
and gives the same ids; texts with a special token's string, and any it can't take, go to ``tokenizers`` itself.

Defined cases: a null text is empty and gives the end id alone; repeated rows are packed as often as they occur, and
rows without id like others; long texts are read whole; an empty table gives an empty result; other columns are left
aside, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, prepare, text_of

CAPACITY = 2048
END_ID = 0
#: Split pattern of byte-level BPE, a fixed value of the public tokenizer files.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in plain}
    others = [b for b in range(256) if b not in set(plain)]
    return signs | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids of a text; made from the JSON text of a ``tokenizers`` file."""

    def __init__(self, spec: str) -> None:
        import tiktoken

        self.spec, self.exact, self.panics = spec, None, 0
        parsed = json.loads(spec)
        self.special = [t["content"] for t in parsed.get("added_tokens", [])]
        signs = byte_alphabet()
        ranks = {bytes(signs[c] for c in token): i for token, i in parsed["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if not any(s in text for s in self.special):
            try:
                return np.array(self.fast.encode_ordinary(text), "<u4")
            except BaseException as error:  # the library's panic is no Exception
                if type(error).__name__ != "PanicException":
                    raise
                self.panics += 1
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_str(self.spec)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one if they fit, else a shorter one (if any) and full ones."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * bool(first) + [(at, capacity) for at in range(first, n, capacity)]


def pieces(documents: DataFrame, tokenizer_path: str, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length and the CRC-32 of its ids."""
    spark = documents.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(shared.value)
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(value.as_py()), np.uint32(end_id)).astype("<u4")
                rows += [(doc_id, i, at, n, zlib.crc32(ids[at : at + n])) for i, (at, n) in enumerate(cut(len(ids), capacity))]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, PIECES)


def exact_patterns(lengths: list[int], capacity: int, choices: int = 24) -> list[tuple[int, ...]]:
    """Patterns of one to four of the lengths that add up to the capacity, each from the longest down.

    For each longest length, pairs are complete; for three and four the middle ones are ``choices`` lengths spread
    evenly over those that fit.
    """
    have, found = set(lengths), set()
    ordered = sorted(have)
    for a in ordered:
        rest = capacity - a
        if rest == 0:
            found.add((a,))
        elif rest in have and rest <= a:
            found.add((a, rest))
        fit = ordered[: bisect_left(ordered, min(a, rest) + 1)]
        for b in fit[:: max(1, len(fit) // choices)]:
            last = rest - b
            if 0 < last <= b and last in have:
                found.add((a, b, last))
            inner = ordered[: bisect_left(ordered, min(b, last) + 1)] if last > 0 else []
            for c in inner[:: max(1, len(inner) // 6)]:
                if 0 < last - c <= c and last - c in have:
                    found.add((a, b, c, last - c))
    return sorted(found, reverse=True)


def fitted(patterns: list[tuple[int, ...]], histogram: np.ndarray, sweeps: int = 6) -> np.ndarray:
    """Non-negative repeat counts, by coordinate descent on the squared distance to the histogram."""
    columns = []
    for p in patterns:
        times: dict[int, int] = {}
        for x in p:
            times[x] = times.get(x, 0) + 1
        columns.append((list(times.items()), sum(m * m for m in times.values())))
    left, counts = histogram.astype(float).tolist(), [0.0] * len(patterns)
    for _ in range(sweeps):
        for j, (entries, norm) in enumerate(columns):
            step = max(-counts[j], sum(m * left[x] for x, m in entries) / norm)
            if step:
                counts[j] += step
                for x, m in entries:
                    left[x] -= m * step
    return np.array(counts)


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, with equal lengths taken together: (lengths of a sequence, how many such)."""
    open_by: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    spaces: list[int] = []

    def put(space: int, held: tuple[int, ...], n: int) -> None:
        if not open_by.get(space):
            open_by[space] = []
            insort(spaces, space)
        open_by[space].append((held, n))

    for x in np.flatnonzero(histogram)[::-1].tolist():
        left = int(histogram[x])
        while left:
            at = bisect_left(spaces, x)
            if at == len(spaces):
                each = capacity // x
                if n := left // each:
                    put(capacity - each * x, (x,) * each, n)
                if more := left % each:
                    put(capacity - more * x, (x,) * more, 1)
                break
            space = spaces[at]
            held, n = open_by[space].pop()
            if not open_by[space]:
                spaces.pop(at)
            used = min(n, left)
            if n > used:
                put(space, held, n - used)
            put(space - x, (*held, x), used)
            left -= used
    return [group for space in spaces for group in open_by[space]]


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such), using each length as often as the histogram has it."""
    left = histogram.astype(np.int64).copy()
    patterns = exact_patterns(np.flatnonzero(left).tolist(), capacity)
    out = []
    for p, n in zip(patterns, np.floor(fitted(patterns, left) + 1e-9).astype(int).tolist(), strict=True):
        n = min([n, *(int(left[x]) // p.count(x) for x in p)])
        if n > 0:
            out.append((p, n))
            for x in p:
                left[x] -= n
    return out + best_fit(left, capacity)


def shares(groups: list[tuple[tuple[int, ...], int]], histogram: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of running numbers in order of length: first number, first sequence, pieces a sequence, first offset, length."""
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for held, n in groups:
        offset = 0
        for x in sorted(set(held), reverse=True):
            times = held.count(x)
            by_length.setdefault(x, []).append((n * times, sequence, times, offset))
            offset += times * x
        sequence += n
    rows, number = [], 0
    for x in sorted(by_length):
        for count, first, times, offset in by_length[x]:
            rows.append((number, first, times, offset, x))
            number += count
    assert number == histogram.sum()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5


def pack(documents: DataFrame, tokenizer_path: str, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    spark = documents.sparkSession
    made = pieces(documents, tokenizer_path, key=key, text=text, capacity=capacity, end_id=end_id).checkpoint()
    order = ["length", "doc_id", "piece", "ids_crc32"]
    ranged = made.repartitionByRange(partitions(documents), *order).sortWithinPartitions(*order).checkpoint()
    histogram = np.zeros(capacity + 1, np.int64)
    for r in ranged.groupBy("length").count().collect():  # a row a length
        histogram[r["length"]] = r["count"]
    sizes = {r["p"]: r["count"] for r in ranged.groupBy(F.spark_partition_id().alias("p")).count().collect()}  # a row a partition
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    table = spark.sparkContext.broadcast((before, shares(plan(histogram, capacity), histogram)))  # by lengths, not by documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_of, (numbers, sequences, times, offsets, lengths) = table.value
        done = None
        for batch in batches:
            if not len(batch):
                continue
            if done is None:
                done = first_of[batch.column("p")[0].as_py()]
            number = done + np.arange(len(batch))
            done += len(batch)
            at = np.searchsorted(numbers, number, "right") - 1
            inside = number - numbers[at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequences[at] + inside // times[at]), pa.array(offsets[at] + inside % times[at] * lengths[at])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranged.withColumn("p", F.spark_partition_id()).mapInArrow(run, f"{PIECES}, sequence_id long, offset long")
