"""Groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, exactly.

The pipeline's near-duplicate stage.  It starts from the groups of 64-bit SimHash fingerprints; as two bits don't reach that
similarity, what these leave apart is found by shared shingles.

1. Each text has a class (equal words in equal order), a sketch and its prefix.  The sketch tells for each of some
   four to eight bits a shingle whether an odd number of shingles falls on it; the bits in which two sketches differ
   are at most the shingles that one set has and the other lacks, so a sketch never denies a similar pair.  The prefix
   holds the rarest fifth of the shingles: any similar text shares one of them.
2. Texts with SimHash fingerprints that links of two bits at most lead to (operator 2) are groups; each is compared with
   the least of its group, and hangs on it if they are similar.  Of each shared shingle two texts lead: the one whose
   shingles most texts have, which stands amid its copies, and the least.  Each text that hangs on none yet is compared
   with the leader that its sketch is nearest to, and hangs on it if they are similar.
3. Texts that share a shingle and are in different groups yet are compared by their leaders first.  Jaccard distance
   is a metric: where the leaders are further apart than a link and both reaches together, no two texts can be linked.
   Leaders that are similar join their groups.
4. Of the leaders that are left, near enough but in different groups, all pairs of texts that share a shingle are
   compared, so no link between different groups is lost.

Pairs are told by their sketches first; those that may be similar are verified by their whole sets.  Nothing is
gathered by shingle or group: all steps are sums and joins whose small side is written first, so that Spark can split
a shingle that very many texts have.

Defined cases: null and empty texts are one class; a text of fewer words than a shingle is one shingle; rows without
doc_id are in no group; rows that repeat a doc_id with another text are texts of their own; equal rows go together; an
empty table gives an empty result; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lowered, mixed, prepare, row_chunks, some_of, span_hashes, string_parts, text_of, unused, word_spans, written
from .components import connected_components
from .simhash import SEED, SHINGLE, fingerprint_groups, shingle_fingerprint

#: Words of a shingle, and the least Jaccard similarity of the sets of shingles, of near duplicates.
WORDS, SIMILARITY = 5, 0.8
#: Shingles are ordered by their counts: tasks count so many at a time and report what has so many; so many are broadcast.
COUNTED, COUNT_LEAST, RANKS = 2_000_000, 3, 500_000
#: Words of more bytes have a hash of their own.
LONG_WORD = 256
STEP = np.uint64(0x9E3779B97F4A7C15)
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[list(b" \t\n\v\f\r")] = False


# ---- shingles, sketches, prefixes


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` word hashes."""
    n = len(hashes) - size + 1
    out = np.full(max(n, 0), size, np.uint64)
    for i in range(size if n > 0 else 0):
        out = mixed(out * STEP + hashes[i : n + i])
    return out


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """For each text, its sorted distinct shingle hashes, and a digest of its words in order."""
    data, offsets = string_parts(texts)
    for low, high in row_chunks(offsets):
        part = lowered(data[offsets[low] : offsets[high]])
        starts, ends, first = word_spans(part, offsets[low : high + 1] - offsets[low], NOT_SPACE)
        hashes = span_hashes(part, starts, ends)
        for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            hashes[i] = xxhash.xxh3_64_intdigest(part[starts[i] : ends[i]].tobytes())
        runs = rolled(hashes, size)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            own = runs[a : b - size + 1] if b - a >= size else rolled(hashes[a:b], b - a) if b > a else hashes[:0]
            yield np.unique(own), xxhash.xxh3_128_digest(hashes[a:b].tobytes())


def sketch(shingles: np.ndarray) -> bytes:
    """Parities of the shingles by their lowest bits."""
    size = max(64, 1 << (4 * len(shingles) - 1).bit_length()) if len(shingles) else 64
    counts = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits(counts & 1, bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The sketch at a smaller size."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def most_similarity(a: bytes, n: int, b: bytes, m: int) -> float:
    """No less than the similarity of two sets of n and m shingles with these sketches."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(len(x), len(y))
    apart = max(int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()), abs(n - m))
    return (n + m - apart) / (n + m + apart)


def prefix(shingles: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles of a set that any similar set must share one of, rarest first.

    All sets order their shingles alike, by rank and hash.  Of two sets with a similarity of at least s, one of n
    shingles has at least s * n in common with the other, so the first common one in this order is among its first
    n - ceil(s * n) + 1.  That holds whatever the ranks are; they only keep the texts of a shingle few.
    """
    n = len(shingles)
    return shingles[np.argsort(rank, kind="stable")[: n - math.ceil(similarity * n - 1e-9) + 1]] if n else shingles


def _counted(size: int):
    """Shingles that several texts of a portion have, and how many."""

    def told(held: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(held), return_counts=True)
        many = counts >= COUNT_LEAST
        return pa.RecordBatch.from_arrays([pa.array(found[many].view(np.int64)), pa.array(counts[many])], ["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for shingles, _ in shingle_sets(batch.column(0), size):
                held.append(shingles)
                n += len(shingles)
                if n >= COUNTED:
                    yield told(held)
                    held, n = [], 0
        if held:
            yield told(held)

    return run


def ranks_of(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most texts have, sorted, and their counts as far as they have been noticed."""
    counted = written(texts.select("text").mapInArrow(_counted(size), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    # from the largest counts down, by eighths of a doubling, as many as are to be broadcast; nothing is sorted
    step = F.floor(F.log2("n") * 8)
    least, held = None, 0
    for r in counted.groupBy(step.alias("step")).agg(F.count("*").alias("keys")).orderBy(F.desc("step")).collect():  # some hundred rows at most
        held += r["keys"]
        if held > RANKS:
            break
        least = r["step"]
    if least is None:
        return np.zeros(1, np.uint64), np.zeros(1, np.int64)
    top = counted.where(step >= least).toArrow()
    known, counts = top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(known)
    return known[order], counts[order]


MARKED = "doc_id long, h long, node long, fp long, size int, bits binary, keys array<long>"


def _marked(size: int, similarity: float, ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = ranks.value
        for batch in batches:
            nodes, sizes, bits, keys = [], [], [], []
            for shingles, digest in shingle_sets(batch.column(2), size):
                at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
                nodes.append(int.from_bytes(digest[:8], "little", signed=True))
                sizes.append(len(shingles))
                bits.append(sketch(shingles))
                keys.append(prefix(shingles, np.where(known[at] == shingles, counts[at], 0), similarity).view(np.int64))
            ends = np.cumsum([0, *map(len, keys)])
            prints = np.array([shingle_fingerprint(x.as_buffer().to_pybytes(), SHINGLE, SEED) for x in batch.column(2).cast(pa.binary())], np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            columns = {"doc_id": batch.column(0), "h": batch.column(1), "node": pa.array(nodes, pa.int64()), "fp": pa.array(prints.view(np.int64)), "size": pa.array(sizes, pa.int32()), "bits": pa.array(bits, pa.binary()), "keys": lists}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


# ---- pairs


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c) for c in ("a_bits", "a_size", "b_bits", "b_size")]
        most = [most_similarity(a.as_buffer(), n, b.as_buffer(), m) for a, n, b, m in zip(columns[0], columns[1].to_pylist(), columns[2], columns[3].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("src"), batch.column("dst"), pa.array(most, pa.float64())], ["src", "dst", "most"])


def estimated(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(src, dst, most): no less than the similarity of each pair, by the sketches."""
    side = lambda own, x: sketches.select(F.col("node").alias(own), F.col("bits").alias(f"{x}_bits"), F.col("size").alias(f"{x}_size"))
    return pairs.join(side("src", "a"), "src").join(side("dst", "b"), "dst").select("src", "dst", "a_bits", "a_size", "b_bits", "b_size").mapInArrow(_estimated, "src long, dst long, most double")


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(batch.column(0), size))
            yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(d[:8], "little", signed=True) for _, d in found], pa.int64()), pa.array([s.tobytes() for s, _ in found], pa.binary())], ["node", "shingles"])

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            found.append(both / (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("src"), batch.column("dst"), pa.array(found, pa.float64())], ["src", "dst", "alike"])


class Texts:
    """What pairs are verified by: the texts, and where to find each node's."""

    def __init__(self, source: DataFrame, places: DataFrame, size: int, similarity: float) -> None:
        self.source, self.places, self.size, self.similarity = source, places, size, similarity

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, shingles) of the wanted nodes."""
        wanted = written(self.places.join(nodes, "node", "left_semi").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")))
        texts = some_of(self.source, wanted, (F.col("doc_id") == F.col("__id")) & (F.col("h") == F.col("__h")), "left_semi")
        return texts.select("text").mapInArrow(_sets(self.size), "node long, shingles binary").dropDuplicates(["node"])

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(src, dst, alike): the pairs that are similar, and how much; only their texts are made into sets."""
        pairs = written(pairs.select("src", "dst"))
        sets = self.sets(pairs.select(F.col("src").alias("node")).unionAll(pairs.select("dst")).distinct())
        side = lambda own, name: sets.select(F.col("node").alias(own), F.col("shingles").alias(name))
        both = pairs.join(side("src", "a"), "src").join(side("dst", "b"), "dst")
        return written(both.select("src", "dst", "a", "b").mapInArrow(_compared, "src long, dst long, alike double").where(F.col("alike") >= self.similarity - 1e-12))


# ---- groups


def fits(a: Column, b: Column, similarity: float) -> Column:
    """Whether two texts whose first common shingle this is can be similar; a and b have size and left.

    ``left`` is how many shingles a text has from this one on: the two have no more in common.
    """
    return F.least(a["left"], b["left"]) >= (a["size"] + b["size"]) * (similarity / (1 + similarity)) - 1e-6


def printed_pairs(firsts: DataFrame) -> DataFrame:
    """Pairs (src, dst) of texts and the least of their group by fingerprints; rows have node and fp."""
    groups = fingerprint_groups(firsts.select(F.col("node").alias("doc_id"), "fp"))
    return groups.where("doc_id <> component_id").select(F.col("doc_id").alias("src"), F.col("component_id").alias("dst"))


def led_pairs(shared: DataFrame, similarity: float) -> DataFrame:
    """Pairs (src, dst) of texts and the leaders of their shingles; rows are (node, key, size, left, n), n being the texts of a key."""
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    top, low = F.max(F.struct("weight", "node", "size", "left")).alias("l0"), F.min(F.struct("node", "size", "left")).alias("l1")
    leaders = written(shared.join(weight, "node").groupBy("key").agg(top, low))
    led = shared.join(leaders, "key").select(F.col("node").alias("src"), F.struct("size", "left").alias("own"), F.explode(F.array(F.struct("l0.node", "l0.size", "l0.left"), "l1")).alias("l"))
    return led.where((F.col("src") != F.col("l.node")) & fits(F.col("own"), F.col("l"), similarity)).select("src", F.col("l.node").alias("dst")).distinct()


def joined_groups(shared: DataFrame, stars: DataFrame, sketches: DataFrame, texts: Texts) -> DataFrame:
    """(node, component): the groups that ``stars`` (src, dst, alike) make, joined by all links between them."""
    similarity = texts.similarity
    edges = stars.select("src", "dst")
    parts = connected_components(edges)
    # where each text hangs, and its group
    who = stars.select(F.col("src").alias("node"), F.col("dst").alias("centre")).join(parts, "node", "full").select("node", F.coalesce("centre", "node").alias("centre"), F.col("component").alias("part"))
    named = shared.join(who, "node", "left").select("key", "node", "size", "left", F.coalesce("centre", "node").alias("centre"), F.coalesce("part", "node").alias("part"))
    several = written(named.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key"))
    active = written(named.join(several, "key"))
    hubs = active.groupBy("key", "centre", "part").agg(F.min("size").alias("size"), F.max("left").alias("left"))
    one, two = (hubs.select("key", F.col("centre").alias(c), F.col("part").alias(f"{c}_part"), F.struct("size", "left").alias(f"{c}_fit")) for c in ("src", "dst"))
    met = written(one.join(two, "key").where((F.col("src_part") < F.col("dst_part")) & fits(F.col("src_fit"), F.col("dst_fit"), similarity)).select("key", "src", "dst", "src_fit"))
    reach = stars.groupBy(F.col("dst").alias("node")).agg((1 - F.min("alike")).alias("reach"))
    reached = lambda own: reach.select(F.col("node").alias(own), F.col("reach").alias(f"{own}_reach"))
    known = estimated(met.select("src", "dst").distinct(), sketches).join(reached("src"), "src", "left").join(reached("dst"), "dst", "left")
    known = known.withColumn("reach", F.coalesce("src_reach", F.lit(0.0)) + F.coalesce("dst_reach", F.lit(0.0))).select("src", "dst", "most", "reach")
    near = written(known.where(F.col("most") >= similarity - F.col("reach") - 1e-9))
    if near.isEmpty():
        return parts
    links = texts.verified(near.where(F.col("most") >= similarity - 1e-9)).select("src", "dst")
    if not links.isEmpty():
        edges = edges.unionAll(links)
        parts = connected_components(edges)
    # of the groups that are still apart, text by text
    now = lambda own: parts.select(F.col("node").alias(own), F.col("component").alias(f"{own}_part"))
    apart = near.where("reach > 0").join(now("src"), "src", "left").join(now("dst"), "dst", "left").where(F.coalesce("src_part", "src") != F.coalesce("dst_part", "dst"))
    apart = written(apart.select("src", "dst"))
    if apart.isEmpty():
        return parts
    # where the groups meet; then one's texts as they fit the other as a whole, then the other's as they fit those
    left, right = (active.select("key", F.col("centre").alias(c), F.struct("node", "size", "left").alias(f"{c}_own")) for c in ("src", "dst"))
    half = met.join(apart, ["src", "dst"]).join(right, ["key", "dst"]).where(fits(F.col("dst_own"), F.col("src_fit"), similarity)).select("key", "src", "dst_own")
    both = half.join(left, ["key", "src"]).where(fits(F.col("src_own"), F.col("dst_own"), similarity))
    pairs = both.select(F.col("src_own.node").alias("src"), F.col("dst_own.node").alias("dst")).distinct()
    more = texts.verified(estimated(pairs, sketches).where(F.col("most") >= similarity - 1e-9)).select("src", "dst")
    return parts if more.isEmpty() else connected_components(edges.unionAll(more))


def similar_groups(documents: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, h, component_id): the least doc_id of the group of each text; ``h`` is the text's own xxhash64.

    The groups are those of comparing every pair.  Rows without doc_id are left out.
    """
    prepare(documents.sparkSession)
    source = documents.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text_of(text)).alias("h"), text_of(text).alias("text")).where("doc_id is not null")
    ranks = documents.sparkSession.sparkContext.broadcast(ranks_of(source, size))
    marked = written(source.mapInArrow(_marked(size, similarity, ranks), MARKED).withColumn("row", F.monotonically_increasing_id()))
    classes = written(marked.groupBy("node").agg(F.min(F.struct("doc_id", "row", "h")).alias("m")).select("node", "m.*"))
    places = classes.select("node", "doc_id", "h")
    later = marked.select("node", "row").join(classes.select("node", F.col("row").alias("first")), "node").where("row <> first").select(F.col("row").alias("__row"))
    firsts = some_of(marked, written(later), F.col("row") == F.col("__row"), "left_anti")
    sketches = firsts.select("node", "size", "bits")
    # size and left in one number: the rows of all prefixes are what is shuffled most
    keyed = firsts.select("node", "size", F.posexplode("keys").alias("pos", "key")).select("key", "node", (F.col("size").cast("long") * (1 << 32) + F.col("size") - F.col("pos")).alias("fit"))
    counts = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = written(keyed.join(counts, "key").select("key", "node", F.shiftright("fit", 32).cast("int").alias("size"), F.col("fit").bitwiseAND((1 << 32) - 1).cast("int").alias("left"), "n"))
    near = estimated(led_pairs(shared, similarity), sketches).where(F.col("most") >= similarity - 1e-9)
    texts = Texts(source, places, size, similarity)
    printed = texts.verified(printed_pairs(firsts))
    best = near.join(printed.select("src"), "src", "left_anti").groupBy("src").agg(F.max_by("dst", F.struct("most", "dst")).alias("dst"))
    stars = printed.unionAll(texts.verified(best))
    parts = joined_groups(shared, stars, sketches, texts)
    named = places.join(parts, "node")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    whole = places.join(named.join(least, "component").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"))
    return marked.select("doc_id", "h", "node").join(written(whole), "node").select("doc_id", "h", "component_id")


def keep_first(documents: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without all but the least doc_id of each group of similar texts; rows without doc_id stay."""
    own, hashed = unused(documents, "__id", "__h")
    gone = similar_groups(documents, key=key, text=text, size=size, similarity=similarity).where("doc_id > component_id").select(F.col("doc_id").alias(own), F.col("h").alias(hashed))
    return some_of(documents, written(gone.distinct()), (F.col(key).cast("long") == F.col(own)) & (F.xxhash64(text_of(text)) == F.col(hashed)), "left_anti")
