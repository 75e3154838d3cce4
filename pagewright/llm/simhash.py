"""Near-duplicate detection: 64-bit SimHash and fuzzy hashing by the binary Golay code.

The 64 bits are cut into three segments of 22, 21 and 21 bits.  Two fingerprints that differ in at most two bits have
no error in one of the three, and at most two errors in the segment after it.  The perfect Golay code of 23 bits
turns a segment into the codewords nearest to it and to its one-bit neighbours: one or six of them, and two segments
with at most two errors between them share one.  So the keys (segment number, exact segment, codeword of the next
segment) bring every such pair together; the pairs of a key are then compared.

Equal fingerprints are one class before any key is made.  A key that more than ``CROWD`` classes share is not paired
up: its classes are spread over the values one bit away from each of them.  Two fingerprints at most two bits apart
share such a value, any that share one are at most two bits apart, and a value has no more than 65 of them, so chains
along it keep the components whole at a cost that grows with the number of classes, not with its square.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; repeated doc_ids and rows
give a row each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_of, written
from .components import connected_components

SEED, SHINGLE, DISTANCE = 42, 3, 2
#: Most classes of a key that are compared pair by pair.
CROWD = 48
#: First bit and width of each segment, from the lowest bit.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def shingle_fingerprint(text: bytes, size: int, seed: int) -> int:
    """SimHash of the word runs of a text in UTF-8; ASCII letters count as lower case."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    counts = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint of each document, as the signed long of its 64 bits."""
    prepare(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [shingle_fingerprint(x.as_buffer().to_pybytes(), size, seed) for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return documents.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each 23-bit unit vector, and the lightest error of each of the 2048 syndromes."""
    generator = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
    units = []
    for i in range(23):
        rest = 1 << i
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= generator << (bit - 11)
        units.append(rest)
    leaders = np.zeros(2048, np.int64)
    for a in range(23):
        for b in range(a, 23):
            for c in range(b, 23):
                error = (1 << a) | (1 << b) | (1 << c)
                syndrome = 0
                for bit in range(23):
                    if error >> bit & 1:
                        syndrome ^= units[bit]
                leaders[syndrome] = error
    return np.array(units, np.int64), leaders


def golay_keys(values: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The codewords nearest to each 23-bit value and its one-bit neighbours: (row, 12-bit codeword number) pairs."""
    units, leaders = tables
    syndromes = np.zeros(len(values), np.int64)
    for bit in range(23):
        syndromes ^= np.where(values >> bit & 1, units[bit], 0)
    flips = np.concatenate([[0], 1 << np.arange(23, dtype=np.int64)])
    moved = np.concatenate([[0], units])
    words = (values[:, None] ^ flips[None, :]) ^ leaders[syndromes[:, None] ^ moved[None, :]]
    numbers = np.sort(words >> 11, axis=1)
    new = np.ones(numbers.shape, bool)
    new[:, 1:] = numbers[:, 1:] != numbers[:, :-1]
    rows, columns = np.nonzero(new)
    return rows, numbers[rows, columns]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = golay_tables()
    for batch in batches:
        values = batch.column("fp").to_numpy().view(np.uint64)
        parts = [(values >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
        for i in range(3):
            rows, codes = golay_keys(parts[(i + 1) % 3], tables)
            keys = (np.int64(i) << np.int64(40)) | (parts[i][rows] << np.int64(12)) | codes
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values[rows].view(np.int64))], ["bucket", "fp"])


def links(classes: DataFrame, *, crowd: int = CROWD) -> DataFrame:
    """Links (src, dst) between distinct fingerprints (fp) that keep every component of distance two whole."""
    keyed = written(classes.select("fp").mapInArrow(_keyed, "bucket long, fp long"))
    full = keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high")).where("n > 1")
    few, many = full.where(F.col("n") <= crowd), full.where(F.col("n") > crowd)
    held = keyed.join(few.select("bucket"), "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list("fp")).alias("fps"))  # crowd at most
    apart = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= DISTANCE
    # the later partners of the i-th fingerprint of a key, nearest first in sort order
    pairs = held.select(F.explode(F.transform(F.col("fps"), lambda x, i: F.struct(x.alias("src"), F.filter(F.slice(F.col("fps"), i + 2, crowd), lambda y: apart(x, y)).alias("near")))).alias("p"))
    close = pairs.where(F.size("p.near") > 0).select(F.col("p.src").alias("src"), F.explode("p.near").alias("dst"))
    spread = keyed.join(many.select("bucket"), "bucket").select("fp").distinct()
    ball = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    star = spread.select("fp", F.explode(ball).alias("middle")).groupBy("middle").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    hub = star.select(F.array_min("fps").alias("src"), F.explode("fps").alias("dst")).where("src <> dst")
    return close.unionAll(hub).distinct()


def near_duplicates(documents: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SHINGLE, seed: int = SEED, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id that links lead to."""
    return fingerprint_groups(written(fingerprints(documents, key=key, text=text, size=size, seed=seed)), crowd=crowd)


def fingerprint_groups(marked: DataFrame, *, crowd: int = CROWD) -> DataFrame:
    """The same for rows (doc_id, fp), which are read twice."""
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    parts = connected_components(links(classes, crowd=crowd))
    named = classes.join(parts.withColumnRenamed("node", "fp"), "fp")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    known = named.join(least, "component").select("fp", "component_id")
    whole = written(classes.join(known, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")))
    return marked.join(whole, "fp").select("doc_id", "fp", "component_id")


def report(found: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
