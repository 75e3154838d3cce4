"""The trie of the prefixes of conversations: which turns many conversations share from their start on.

A conversation is a sequence of turns (role, text).  A node of depth d is a distinct sequence of d first turns, and its
members are the conversations that start with it.  In steps:

1. **Contents.**  A turn's role and text are told by a 64-bit hash.  All turns of a hash are compared with the least and
   the greatest of them (summed up before the shuffle); hashes that hold different turns are drawn again.
2. **Order.**  Turns, by now a few numbers each, are range-partitioned and sorted.  A row a partition tells the driver
   where its last conversation stands, so conversations of any length may span partitions.
3. **Fingerprints.**  Numpy scans over the sorted turns give the polynomial fingerprint of each prefix, and the rebuilt
   conversations (see ``rebuilt_prefixes``) from the base's first turns, which come before.
4. **Nodes.**  Prefixes with equal depth and fingerprint are candidates.  A candidate's variants are the pairs of the
   parent's fingerprint and the last turn in it.  Its representative is the variant of the smallest member; a candidate
   with any other is a collision, and the others' turns are drawn again (and everything after them), until none is left.
   From the root down, all members of a candidate then agree turn by turn.
5. **Roll-up.**  The smallest member of a node is also that of one child at most, so nodes form chains by smallest
   member, each down to where that conversation ends.  A node's subtree is the rest of its own chain and the whole chains of
   its other members.  So sums over subtrees take one scan along chains and one grouping of prefixes, not a pass a depth.

Groups are summed up before they are shuffled; joins on conversations and parents are on keys that Spark can split.  The
ids that end at a node are put in order by ranges and hashed from chunks, one after the other.

Defined cases: rows without conv_id are left out; null turns come first, a null role or text is empty; turns with the same
number come in order of role, then of the hash of role and text; repeated rows are turns of their own; an empty table has
no node, not even a root; other columns are left aside, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, mixed, partitions, prepare, written

#: Conversations that may start with turns of the same base, and one more than the most turns taken from it.
SHARE, MOST = 5, 9
#: Ids in one chunk of those that end at a node.
CHUNK_IDS = 4096
MASK = (1 << 64) - 1
PREFIX = "conv_id long, depth long, turn long, size long, fp long, parent long, last boolean"
Row = tuple[int, int]  # a turn's hash and the bytes of its text


def power(exponents: np.ndarray) -> np.ndarray:
    """BASE to these powers modulo 2 ** 64, by squaring."""
    left, square = exponents.astype(np.uint64), BASE
    out = np.ones(len(left), np.uint64)
    while left.any():
        out[(left & np.uint64(1)) == 1] *= np.uint64(square)
        left, square = left >> np.uint64(1), square * square & MASK
    return out


# ---- contents


def hashed_turns(conversations: DataFrame, bits: int = 64) -> DataFrame:
    """(conv_id, turn_no, role, h, size): h is the same for equal turns only."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn_no"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))).where("conv_id is not null")
    kept = -1 if bits == 64 else (1 << bits) - 1
    hash_of: Column = F.xxhash64("role", "text").bitwiseAND(F.lit(kept))
    for again in range(1, 1000):
        known = turns.withColumn("h", hash_of)
        least, most = ([f(c).alias(f"{f.__name__}_{c}") for c in ("role", "text")] for f in (F.min, F.max))
        mixed_up = known.groupBy("h").agg(*least, *most).where("min_role < max_role or min_text < max_text").select("h")
        found = [r.h for r in mixed_up.take(10_000)]  # some at a time; next to none with 64 bits
        if not found:
            return known.select("conv_id", "turn_no", "role", "h", F.octet_length("text").cast("long").alias("size"))
        hash_of = F.when(hash_of.isin(found), F.xxhash64("role", "text", F.lit(again)).bitwiseAND(F.lit(kept))).otherwise(hash_of)
    raise AssertionError("hashes are too short")


# ---- order, and what partitions tell each other


@dataclass
class Run:
    """Some turns of a conversation in a row: how many, their polynomial, and the first of them."""

    conv: int
    n: int = 0
    poly: int = 0
    head: list[Row] = field(default_factory=list)

    def and_then(self, later: Run) -> Run:
        shift = pow(BASE, self.n, 1 << 64)
        return Run(self.conv, self.n + later.n, (self.poly + shift * later.poly) & MASK, (self.head + later.head)[: MOST - 1])


def base_of(conv: int, share: int = SHARE) -> int:
    return conv - int(np.fmod(conv, share))  # the remainder has the sign of the id, as in SQL


@dataclass
class Place:
    """Where a scan stands: the conversation that it is in, and the base's run if that came before."""

    run: Run | None = None
    base: Run | None = None

    def take(self, part: Run, share: int = SHARE) -> None:
        """Goes on with a run of turns, of the same conversation or of the next one."""
        same = self.run is not None and self.run.conv == part.conv
        self.run = self.run.and_then(part) if same else part
        base = base_of(part.conv, share)
        if part.conv == base:
            self.base = self.run
        elif self.base is not None and self.base.conv != base:
            self.base = None


def run_of(conv: int, h: np.ndarray, sizes: np.ndarray) -> Run:
    poly = int((mixed(h) * power(np.arange(len(h)))).sum(dtype=np.uint64)) if len(h) else 0
    return Run(conv, len(h), poly, [(int(a), int(b)) for a, b in zip(h[: MOST - 1], sizes[: MOST - 1], strict=True)])


def stretches(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(conversation, hashes, sizes) of each stretch of rows with the same conversation."""
    conv = batch.column("conv_id").to_numpy()
    h, sizes = batch.column("h").to_numpy().view(np.uint64), batch.column("size").to_numpy()
    cuts = [0, *(np.flatnonzero(conv[1:] != conv[:-1]) + 1).tolist(), len(conv)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            yield int(conv[a]), h[a:b], sizes[a:b]


SUMMARY = "p int, first boolean, conv long, n long, poly string, head array<struct<h:string,size:long>>"


def summaries(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
    """Of a partition: its first run, the base's run of the last conversation if that is another, and the last run, in order."""
    first: Run | None = None
    place, runs = Place(), 0
    for batch in batches:
        for conv, h, sizes in stretches(batch):
            runs += place.run is None or place.run.conv != conv
            place.take(run_of(conv, h, sizes), share)
            if runs == 1:
                first = place.run
    told = [] if first is None else [first]
    if runs > 1:
        told += [r for r in (place.base,) if r is not None and r.conv not in (first.conv, place.run.conv)] + [place.run]
    p = TaskContext.get().partitionId()
    rows = [{"p": p, "first": r is first, "conv": r.conv, "n": r.n, "poly": str(r.poly), "head": [{"h": str(a), "size": b} for a, b in r.head]} for r in told]
    kind = pa.schema([("p", pa.int32()), ("first", pa.bool_()), ("conv", pa.int64()), ("n", pa.int64()), ("poly", pa.string()), ("head", pa.list_(pa.struct([("h", pa.string()), ("size", pa.int64())])))])
    yield pa.RecordBatch.from_pylist(rows, kind)


def places(ranged: DataFrame, share: int) -> tuple[dict[int, Place], dict[int, tuple[int, int]]]:
    """Where each partition's scan starts, and (conversation, its turns) that come after it: from a few rows a partition."""
    rows = ranged.mapInArrow(lambda batches: summaries(batches, share), SUMMARY).collect()
    n = ranged.rdd.getNumPartitions()
    by: dict[int, list[Run]] = {p: [] for p in range(n)}
    for r in sorted(rows, key=lambda r: r.p):
        by[r.p].append(Run(r.conv, r.n, int(r.poly), [(int(x.h), x.size) for x in r.head]))
    starts, place = {}, Place()
    for p in range(n):
        starts[p] = replace(place)
        for run in by[p]:
            place.take(run, share)
    following: dict[int, tuple[int, int]] = {}
    after: tuple[int, int] | None = None
    for p in reversed(range(n)):
        following[p] = after
        if by[p]:
            first, more = by[p][0], after is not None and len(by[p]) == 1 and after[0] == by[p][0].conv
            after = first.conv, first.n + (after[1] if more else 0)
    return starts, following


def turns_from_base(conv: int, most: int = MOST) -> int:
    return zlib.crc32(str(conv).encode()) % most


def rebuilt_prefixes(turns: DataFrame, *, share: int = SHARE, most: int = MOST, bits: int = 64) -> DataFrame:
    """(conv_id, depth, turn, size, fp, parent, last): all prefixes of the rebuilt conversations, the empty ones included.

    A conversation c becomes the first k turns of conversation c - c % ``share``, k from the CRC-32 of c, and its own turns
    after its first k.  ``last`` marks the whole conversation.  Fingerprints are cut to ``bits``.
    """
    base = F.col("conv_id") - F.col("conv_id") % share
    order = [F.col("base"), F.col("other"), F.col("conv_id"), F.col("turn_no").asc_nulls_first(), F.col("role"), F.col("h")]
    keyed = turns.select(base.alias("base"), (F.col("conv_id") != base).alias("other"), "conv_id", "turn_no", "role", "h", "size")
    bounds = [F.substring(F.col("role"), 1, 32) if i == 4 else c for i, c in enumerate(order)]  # Spark brings bounds to the driver
    ranged = keyed.repartitionByRange(partitions(turns), *bounds).sortWithinPartitions(*order).select("conv_id", "h", "size").checkpoint()
    starts, following = places(ranged, share)
    shared = turns.sparkSession.sparkContext.broadcast((starts, following))  # some numbers a partition
    keep = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        place, after = shared.value[0][p], shared.value[1][p]
        waiting: tuple[np.ndarray, ...] | None = None  # the last rows so far: is the conversation over?

        def skipped(conv: int) -> int:
            return 0 if conv == base_of(conv, share) else turns_from_base(conv, most)

        def made(conv: int, h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
            """The prefixes that end in these turns, which come after ``place``, and those in the base's."""
            n0 = place.run.n if place.run is not None and place.run.conv == conv else 0
            skip, held = skipped(conv), place.run.head if n0 else []
            has_base = place.base is not None and place.base.conv == base_of(conv, share)
            head = place.base.head[:skip] if has_base else []
            head_h = np.array([x[0] for x in head], np.uint64)
            early = run_of(conv, np.array([x[0] for x in held[:skip]], np.uint64), np.zeros(min(len(held), skip), np.int64))
            # the polynomial of own turns from ``skip`` on, so far
            before = (place.run.poly - early.poly) & MASK if n0 > skip else 0
            ranks = n0 + np.arange(len(h))
            fits = ranks >= skip
            terms = mixed(h[fits]) * power(ranks[fits])
            sums = np.uint64(before) + np.cumsum(terms, dtype=np.uint64)
            shift = pow(pow(BASE, -1, 1 << 64), skip, 1 << 64) * pow(BASE, len(head), 1 << 64) & MASK
            base_sums = np.cumsum(mixed(head_h) * power(np.arange(len(head))), dtype=np.uint64)
            start = int(base_sums[-1]) if len(head) else 0
            fps = np.uint64(start) + sums * np.uint64(shift)
            depths = len(head) + ranks[fits] - skip + 1
            fps_before = np.concatenate([[np.uint64((start + before * shift) & MASK)], fps[:-1]]) if len(fps) else fps
            turn, size = h[fits], sizes[fits]
            if n0 == 0:  # the empty prefix and those in the base's turns
                base_fps = np.concatenate([np.zeros(1, np.uint64), base_sums])
                depths = np.concatenate([np.arange(len(head) + 1), depths])
                fps, fps_before = np.concatenate([base_fps, fps]), np.concatenate([[np.uint64(0)], base_fps[:-1], fps_before])
                turn, size = np.concatenate([[np.uint64(0)], head_h, turn]), np.concatenate([[0], [x[1] for x in head], size]).astype(np.int64)
            return np.full(len(fps), conv, np.int64), depths, turn, size, fps & keep, fps_before & keep

        def batch_of(columns: tuple[np.ndarray, ...], over: bool) -> pa.RecordBatch:
            conv, depths, turn, size, fps, parents = columns
            last = np.zeros(len(conv), bool)
            last[:-1], last[-1] = conv[1:] != conv[:-1], over
            signed = lambda x: x.astype(np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (conv, depths.astype(np.int64), signed(turn), size, signed(fps), signed(parents), last)], ["conv_id", "depth", "turn", "size", "fp", "parent", "last"])

        for batch in batches:
            parts = []
            for conv, h, sizes in stretches(batch):
                parts.append(made(conv, h, sizes))
                place.take(run_of(conv, h, sizes), share)
            columns = tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else None
            if columns is not None and len(columns[0]):
                if waiting is not None:
                    yield batch_of(waiting, bool(waiting[0][-1] != columns[0][0]))
                waiting = columns
        if waiting is not None:
            conv = int(waiting[0][-1])
            more = after is not None and after[0] == conv and place.run.n + after[1] > skipped(conv)
            yield batch_of(waiting, not more)

    return ranged.mapInArrow(run, PREFIX)


# ---- sums along rows of a key of any size


def running_sums(rows: DataFrame, key: str, order: Column, values: dict[str, str]) -> DataFrame:
    """The rows with the sums of whole-number columns from a key's first row up to each row; ``values`` gives the sums' names."""
    ranged = rows.repartitionByRange(partitions(rows), F.col(key), order).sortWithinPartitions(F.col(key), order).checkpoint()
    at, names = rows.columns.index(key), list(values)
    where, columns = [rows.columns.index(c) for c in names], [*rows.columns, *values.values()]

    def sums_of(batch: pa.RecordBatch, carried: tuple[int, np.ndarray] | None) -> tuple[list[np.ndarray], tuple[int, np.ndarray], bool]:
        keys = batch.column(at).to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        which = np.searchsorted(starts, np.arange(len(keys)), "right") - 1
        out = []
        for j, w in enumerate(where):
            value = batch.column(w).to_numpy()
            sums = np.cumsum(value)
            sums -= (sums[starts] - value[starts])[which]
            if carried is not None and carried[0] == keys[0]:
                sums[which == 0] += carried[1][j]
            out.append(sums)
        return out, (int(keys[-1]), np.array([x[-1] for x in out])), len(starts) == 1

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, single = None, True
        for batch in batches:
            if len(batch):
                before = carried
                _, carried, alone = sums_of(batch, carried)
                single = single and alone and (before is None or before[0] == carried[0])
        if carried is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([carried[0]], pa.int64()), pa.array([carried[1].tolist()], pa.list_(pa.int64())), pa.array([single])], ["p", "key", "sums", "single"])

    carry: dict[int, tuple[int, np.ndarray]] = {}
    now: tuple[int, np.ndarray] | None = None
    told = {r.p: r for r in ranged.mapInArrow(ends, "p int, key long, sums array<long>, single boolean").collect()}  # a row a partition
    for p in range(max(told, default=-1) + 1):
        if now is not None:
            carry[p] = now
        if r := told.get(p):
            sums = np.array(r.sums, np.int64)
            now = r.key, sums + now[1] if r.single and now is not None and now[0] == r.key else sums
    shared = rows.sparkSession.sparkContext.broadcast(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = shared.value.get(TaskContext.get().partitionId())
        for batch in batches:
            if len(batch):
                sums, carried, _ = sums_of(batch, carried)
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, sums)], columns)

    made = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), *(f"{c} long" for c in values.values())])
    return ranged.mapInArrow(run, made)


# ---- nodes


def verified(prefixes: DataFrame, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The prefixes with fingerprints that only equal prefixes share, and their nodes.

    Nodes: depth, fp, parent, conv_id (smallest member), n_convs, size.
    """
    for again in range(1, 1000):
        variants = written(prefixes.groupBy("depth", "fp", "parent", "turn").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size")))
        several = variants.groupBy("depth", "fp").agg(F.min("conv_id").alias("representative"), F.count("*").alias("n")).where("n > 1")
        wrong = written(variants.join(several, ["depth", "fp"]).where("conv_id > representative").select("depth", "fp", "parent", "turn"))
        if wrong.isEmpty():
            return prefixes, variants.drop("turn")
        keys = ["depth", "fp", "parent", "turn"]
        step = F.when(F.col("wrong"), F.xxhash64(*keys, F.lit(again)).bitwiseAND(F.lit((1 << 40) - 1))).otherwise(F.lit(0).cast("long"))
        told = prefixes.join(wrong.withColumn("wrong", F.lit(True)), keys, "left").withColumn("step", step).drop("wrong")
        moved = running_sums(told, "conv_id", F.col("depth"), {"step": "moved"})
        kept = F.lit(-1 if bits == 64 else (1 << bits) - 1).cast("long")
        new = {"fp": F.col("fp").bitwiseXOR(F.col("moved")).bitwiseAND(kept), "parent": F.col("parent").bitwiseXOR(F.col("moved") - F.col("step")).bitwiseAND(kept)}
        prefixes = written(moved.withColumns(new).drop("step", "moved"))
    raise AssertionError("fingerprints are too short")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, fp, ends_sha256): SHA-256 of the ids at a node, ascending, with commas between them."""
    n, order = partitions(ends), ["depth", "fp", "conv_id"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ids of each stretch of rows with the same node as one text."""
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in order]
            fresh = np.flatnonzero((columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])) + 1
            cuts = sorted({0, *fresh.tolist(), *range(0, len(batch), CHUNK_IDS), len(batch)})
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            ids = columns[2].tolist()
            texts = [",".join(map(str, ids[a:b])) for a, b in spans]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[[a for a, _ in spans]]) for c in columns), pa.array(texts, pa.string())], [*order, "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, rows = None, None, []
        for batch in batches:
            for d, f, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "fp", "ids")), strict=True):
                if (d, f) == node:
                    sha.update(b"," + ids.encode())
                    continue
                if node is not None:
                    rows.append((*node, sha.hexdigest()))
                node, sha = (d, f), hashlib.sha256(ids.encode())
            if len(rows) >= CHUNK_IDS:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["depth", "fp", "ends_sha256"])
                rows = []
        if node is not None:
            rows.append((*node, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["depth", "fp", "ends_sha256"])

    ranged = ends.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(chunks, "depth long, fp long, conv_id long, ids string")
    return ranged.repartition(n, "depth", "fp").sortWithinPartitions(*order).select("depth", "fp", "ids").mapInArrow(digests, "depth long, fp long, ends_sha256 string")


def trie(conversations: DataFrame, *, share: int = SHARE, most: int = MOST, bits: int = 64) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``bits`` cuts hashes and fingerprints, which makes collisions but no difference to the result.
    """
    prepare(conversations.sparkSession)
    turns = written(hashed_turns(conversations, bits))
    prefixes, nodes = verified(written(rebuilt_prefixes(turns, share=share, most=most, bits=bits)), bits)
    node = ["depth", "fp"]
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("fp")).agg(F.count("*").alias("n_children"))
    full = nodes.join(children, node, "left").na.fill(0, ["n_children"]).withColumns({"saved": (F.col("n_convs") - 1) * F.col("size"), "leaf": (F.col("n_children") == 0).cast("long")}).drop("size")
    own = written(running_sums(full, "conv_id", F.col("depth").desc(), {"saved": "own_saved", "leaf": "own_leaves"}).drop("saved", "leaf"))
    # whole chains, for the nodes above them that their conversation belongs to
    chains = own.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("own_saved").alias("chain_saved"), F.max("own_leaves").alias("chain_leaves")).where("top > 0 and (chain_saved > 0 or chain_leaves > 0)")
    above = prefixes.select("conv_id", *node).join(chains, "conv_id").where("depth < top").groupBy(*node).agg(F.sum("chain_saved").alias("more_saved"), F.sum("chain_leaves").alias("more_leaves"))
    ends = ends_digests(prefixes.where("last").select(*node, "conv_id"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    made = own.join(above, node, "left").join(ends, node, "left").join(parents, ["depth", "parent"], "left")
    return made.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("own_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("own_saved") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


ORACLE = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said
  FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
  SELECT conv_id, xor(list_reduce(flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
    lambda c, b: xor(xor(c, b) >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295::BIGINT), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, i, said FROM conv c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 WHERE i < h
  UNION ALL SELECT c.conv_id, 1, i, said FROM conv c JOIN turns t ON t.conv_id = c.conv_id WHERE i >= h
), whole AS (
  SELECT conv_id, coalesce(s, []) AS s FROM conv LEFT JOIN (SELECT conv_id, list(said ORDER BY part, i) AS s FROM rebuilt GROUP BY conv_id) USING (conv_id)
), prefix AS (
  SELECT conv_id, d, s[1:d] AS p, len(s) = d AS ends FROM whole, range(0, len(s) + 1) AS r(d)
), node AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ended FROM prefix GROUP BY p, d
), children AS (
  SELECT p[1:d - 1] AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1
), full_node AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * strlen(n.p[d].text) ELSE 0 END AS saved FROM node n LEFT JOIN children c ON n.p = c.p
), below AS (
  SELECT b.p[1:k] AS p, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM full_node b, range(0, b.d + 1) AS r(k) GROUP BY 1
)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens, sha256(n.ended) AS ends_sha256
FROM full_node n JOIN below b ON n.p = b.p LEFT JOIN node u ON n.d > 0 AND u.p = n.p[1:n.d - 1]
"""
