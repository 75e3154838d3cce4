"""Benchmark decontamination by winnowing.

Every run of ``window`` words holds ``window - GRAM + 1`` word grams; the least hash among them is its
fingerprint.  A document and a benchmark item that share the run share that fingerprint, so every shared run of
``window`` words or more is found.  A shared fingerprint is extended to the windows that hold it, and each window is
compared word by word before it counts.  Items shorter than a window are looked up as one run of their own length.

The benchmark is the small side.  It is indexed in blocks of at most ``block_words`` words, or one item, so what is
broadcast has a bound.  One block needs one pass without a shuffle; a larger benchmark takes more passes, each of which
takes up the rows that the pass before has written, so the result is the same for blocks of any size.

Defined cases: a null text has no words; an item without words matches nothing; an item without id makes hit words but
is not among the items met; equal items all count; a document of fewer words than an item's window matches nothing;
rows that repeat a doc_id, or have none, are rows of their own; long texts are read whole; empty tables give empty
results; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowered, mixed, prepare, row_chunks, sliding_min, span_hashes, string_parts, text_of, winnowed, word_spans, written

#: Bytes of words, in lower case.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
WINDOW, GRAM = 10, 5
#: Words of benchmark text that one pass indexes and broadcasts.
BLOCK_WORDS = 1_000_000
STEP = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<array<int>>"


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive word hashes."""
    n = max(0, len(words) - size + 1)
    out, factor = np.zeros(n, np.uint64), 1
    for i in range(size):
        out += words[i : i + n] * np.uint64(factor)
        factor = factor * int(STEP) % 2**64
    return mixed(out)


class Known:
    """A set of 64-bit hashes."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.values = np.unique(hashes)
        self.flags = np.zeros(1 << 20, bool)
        self.flags[(self.values & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def among(self, hashes: np.ndarray) -> np.ndarray:
        """Marks the hashes that are known."""
        out = self.flags[(hashes & np.uint64(0xFFFFF)).astype(np.int64)]
        at = np.flatnonzero(out)
        place = np.minimum(np.searchsorted(self.values, hashes[at]), len(self.values) - 1)
        out[at] = self.values[place] == hashes[at]
        return out


class Index:
    """What a pass needs of its benchmark items, by length of window."""

    def __init__(self, names: list[str | None], texts: pa.Array, window: int = WINDOW, gram: int = GRAM) -> None:
        self.window, self.gram, self.names = window, gram, names
        data, offsets = string_parts(texts)
        self.data = lowered(data)
        parts, self.starts, self.ends, firsts, before = [], [], [], [np.zeros(1, np.int64)], 0
        for low, high in row_chunks(offsets):
            part = self.data[offsets[low] : offsets[high]]
            starts, ends, first = word_spans(part, offsets[low : high + 1] - offsets[low], WORD_BYTES)
            parts.append(span_hashes(part, starts, ends))
            self.starts.append(starts + offsets[low])
            self.ends.append(ends + offsets[low])
            firsts.append(first[1:] + before)
            before += len(starts)
        joined = lambda arrays, kind: np.concatenate([np.zeros(0, kind), *arrays])
        hashes, self.starts, self.ends, first = joined(parts, np.uint64), joined(self.starts, np.int64), joined(self.ends, np.int64), np.concatenate(firsts)
        counts = np.diff(first)
        self.item = np.repeat(np.arange(len(counts)), counts)
        self.tables: dict[int, tuple[Known, Known]] = {}
        self.runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.met: dict[tuple[int, int], dict[tuple[bytes, ...], set[str]]] = {}
        for size in np.unique(np.minimum(counts[counts > 0], window)).tolist():
            at = np.arange(len(hashes) - size + 1) if size == window else first[:-1][counts == size]
            at = at[self.item[at] == self.item[at + size - 1]]
            whole = gram_hashes(hashes, size)[at]
            marks = sliding_min(gram_hashes(hashes, gram), window - gram + 1)[at] if size == window else whole
            self.tables[size] = (Known(marks), Known(whole))
            order = np.argsort(whole, kind="stable")
            self.runs[size] = (whole[order], at[order])

    def candidates(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of runs of ``size`` words that a benchmark window may equal, and their hashes."""
        marks, whole = self.tables[size]
        if size < self.window:
            runs = gram_hashes(hashes, size)
            starts = np.flatnonzero(whole.among(runs))
            return starts, runs[starts]
        grams = gram_hashes(hashes, self.gram)
        picked = np.flatnonzero(winnowed(grams, self.window - self.gram + 1))
        seeds = picked[marks.among(grams[picked])]
        reach = np.arange(self.gram - self.window, 1)
        starts = np.unique((seeds[:, None] + reach[None, :]).ravel())
        starts = starts[(starts >= 0) & (starts + size <= len(hashes))]
        runs = np.zeros(len(starts), np.uint64)
        factor = 1
        for i in range(size if len(starts) else 0):
            runs += hashes[starts + i] * np.uint64(factor)
            factor = factor * int(STEP) % 2**64
        runs = mixed(runs)
        kept = whole.among(runs)
        return starts[kept], runs[kept]

    def items_of(self, size: int, hashed: int, run: tuple[bytes, ...]) -> set[str | None] | None:
        """The items with exactly this run of words, whose hash is given."""
        held = self.met.get((size, hashed))
        if held is None:
            held = self.met[size, hashed] = {}
            hashes, at = self.runs[size]
            low, high = np.searchsorted(hashes, np.uint64(hashed)), np.searchsorted(hashes, np.uint64(hashed), "right")
            for start in at[low:high].tolist():
                words = tuple(self.data[a:b].tobytes() for a, b in zip(self.starts[start : start + size], self.ends[start : start + size], strict=True))
                held.setdefault(words, set()).add(self.names[self.item[start]])
        return held.get(run)

    def matches(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, dict[int, tuple[set[str], np.ndarray]]]]:
        """For each range of rows: its first row, words in each row, and by row with a hit the items and hit words."""
        data, offsets = string_parts(texts)
        for low, high in row_chunks(offsets):
            part = lowered(data[offsets[low] : offsets[high]])
            starts, ends, first = word_spans(part, offsets[low : high + 1] - offsets[low], WORD_BYTES)
            hashes = span_hashes(part, starts, ends)
            hits: dict[int, tuple[set[str], np.ndarray]] = {}
            for size in self.tables:
                at, runs = self.candidates(hashes, size)
                rows = np.searchsorted(first, at, "right") - 1
                for start, hashed, row in zip(at.tolist(), runs.tolist(), rows.tolist(), strict=True):
                    if start + size > first[row + 1]:
                        continue
                    run = tuple(part[starts[i] : ends[i]].tobytes() for i in range(start, start + size))
                    if items := self.items_of(size, hashed, run):
                        if row not in hits:
                            hits[row] = (set(), np.zeros(first[row + 1] - first[row], bool))
                        hits[row][0].update(items)
                        hits[row][1][start - first[row] : start - first[row] + size] = True
            yield low, np.diff(first), hits


#: The index that a worker has built last: its tasks share it.
_BUILT: dict[int, Index] = {}


def index_of(shared, window: int, gram: int) -> Index:
    number, names, texts = shared.value
    if number not in _BUILT:
        _BUILT.clear()
        _BUILT[number] = Index(names, texts, window, gram)
    return _BUILT[number]


def spans_of(mask: np.ndarray) -> list[list[int]]:
    """Maximal true runs as pairs of start and end."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edges.reshape(-1, 2).tolist()


def _blocks(benchmark: DataFrame, item: str, text: str, block_words: int) -> Iterator[tuple[bool, tuple[int, list[str | None], pa.Array]]]:
    """The items in blocks of bounded size, one after another, and whether a block is the last.  Many come by ranges of a hash."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), text_of(text).alias("text"))
    total = rows.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0  # no text has more words
    n = max(1, -(-int(total) // block_words))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for k in range(n):
        held = rows.where(block == k).toArrow()
        yield k == n - 1, (uuid.uuid4().int, held.column("item").to_pylist(), held.column("text").combine_chunks())


def contaminated_spans(
    documents: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, gram: int = GRAM, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Per document: its words, the hit words, the items met and the hit spans (word numbers, end exclusive)."""
    spark = documents.sparkSession
    prepare(spark)
    nothing = F.array().cast("array<string>").alias("items"), F.array().cast("array<array<int>>").alias("spans")
    state = documents.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"), *nothing)
    for last, block in _blocks(benchmark, item, item_text, block_words):
        shared = spark.sparkContext.broadcast(block)
        if last:
            return state.mapInArrow(_searcher(shared, window, gram, with_text=False), SCHEMA)
        state = written(state.mapInArrow(_searcher(shared, window, gram, with_text=True), f"{SCHEMA}, text string")).select("doc_id", "text", "items", "spans")
        shared.destroy()
    raise AssertionError("there is a last block")


def _searcher(shared, window: int, gram: int, *, with_text: bool):
    """Adds a block's hits to those that rows (doc_id, text, items, spans) have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(shared, window, gram)
        for batch in batches:
            for low, counts, hits in index.matches(batch.column("text")):
                part = batch.slice(low, len(counts))
                items, spans, totals = part.column("items").to_pylist(), part.column("spans").to_pylist(), []
                for i, (met, own) in enumerate(zip(items, spans, strict=True)):
                    if i in hits:
                        more, mask = hits[i]
                        for a, b in own:
                            mask[a:b] = True
                        items[i], spans[i] = sorted({*met, *more} - {None}), spans_of(mask)
                    totals.append(sum(b - a for a, b in spans[i]))
                columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(totals, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int32())))]
                names = ["doc_id", "n_words", "n_hit", "items", "spans"]
                yield pa.RecordBatch.from_arrays(*((columns + [part.column("text")], names + ["text"]) if with_text else (columns, names)))

    return run


def clean_documents(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``documents`` without a hit, unchanged and without a shuffle; a pass follows another's result."""
    spark = documents.sparkSession
    prepare(spark)

    def without(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = index_of(shared, window, gram)
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for low, _, hits in index.matches(pc.fill_null(batch.column(batch.schema.get_field_index(text)), "")):
                    keep[[low + i for i in hits]] = False
                yield batch.filter(pa.array(keep))

        return run

    for last, block in _blocks(benchmark, item, item_text, block_words):
        shared = spark.sparkContext.broadcast(block)
        documents = documents.mapInArrow(without(shared), documents.schema)
        if not last:
            documents = written(documents)
            shared.destroy()
    return documents


def report(spans: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    return spans.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10ffff}]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents), b AS (SELECT item_id::VARCHAR AS item, {_SQL_WORDS} AS w FROM benchmark),
sized AS (SELECT item, w, least({WINDOW}, len(w)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM sized, range(1, len(w) - k + 2) AS t(i)),
ks AS (SELECT DISTINCT k FROM bw), pairs AS (SELECT doc_id, w, k FROM d, ks),
dw AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM pairs, range(1, len(w) - k + 2) AS t(i)),
hits AS (SELECT doc_id, i, k, item FROM dw JOIN bw USING (k, s)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, p FROM hits, range(i, i + k) AS t(p)) GROUP BY doc_id),
met AS (SELECT doc_id, count(item) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN met USING (doc_id)
"""
