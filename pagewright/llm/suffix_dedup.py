"""Exact substring removal with suffix arrays built by two-stage sorting.

A byte of a document goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller
doc_id.  Strings are judged on the input, and matches never cross documents.

No suffix array of a whole corpus fits one machine, so suffixes that may match are brought together first:

1. Documents are dealt into blocks.  In every run of ``LENGTH`` bytes the gram of ``GRAM`` bytes with the least hash is
   an anchor, so equal runs have equal anchors.  Each block sends the hashes of its anchors, each once, to buckets, which
   tell the block the ones that other blocks have too.
2. Blocks cut the bytes around each anchor that two documents share, as far as a run over the anchor can reach.  Of
   equal cuttings in a block only that of the smallest doc_id goes on; the others are settled there.
3. Each bucket joins its cuttings into one text and builds its suffix array: suffixes smaller than their successors
   are sorted directly, the rest are induced by scanning the buckets of first bytes, and neighbours' common prefixes are
   computed.  Suffixes that share ``LENGTH`` bytes are one class, and its least doc_id keeps them.
4. Blocks take the runs found in their documents out of the texts.

An anchor that more than ``HOT`` documents share sends its runs one by one under their own hashes instead of the
cutting, so a passage found in a large share of all documents is spread over buckets, and each bucket has it once a
block.  Cuttings of equal length are told apart by two 64-bit hashes.

Blocks and buckets are as many as the bytes of all texts need, so each fits a task's memory; a block sends a bucket one
row with all it has for it, some KB of hashes, as there are fewer rows that way than anchors at any size.

Defined cases: a null text is empty; documents shorter than ``LENGTH`` lose nothing; rows that repeat a doc_id don't
affect each other, whether their texts are equal or not; a null doc_id counts as larger than any other, and such rows
don't affect each other; equal rows lose the same; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, partitions, prepare, row_chunks, string_parts, text_of, winnowed

LENGTH, GRAM = 50, 20
#: Documents that share an anchor before its runs go one by one.
HOT = 4096
#: Blocks for each shuffle partition, and a bucket for each; but no block gets more bytes of text than this on average.
BLOCKS, BLOCK_BYTES = 4, 32_000_000
#: Bytes of cuttings that a bucket compares at a time.
PART = 1_500_000
LAST = np.int64(2**63 - 1)
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
CUT = LENGTH + LENGTH - GRAM  # bytes of a whole cutting
LEFT = LENGTH - GRAM  # of them before the anchor


# ---- suffix arrays ----


def words_at(text: np.ndarray, at: np.ndarray, shift: int = 0) -> np.ndarray:
    """The eight bytes from each place as a big-endian number; the text ends with spare bytes."""
    view = np.ndarray((len(text) - 7,), "<u8", text.data, 0, (1,))
    return view[at + shift].byteswap()


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Marks the suffixes that are smaller than their successors; the empty suffix is the smallest."""
    n = len(text)
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    rises = np.zeros(len(ends), bool)
    rises[:-1] = text[ends[:-1]] < text[ends[:-1] + 1]
    return np.repeat(rises, np.diff(ends, prepend=-1))


def sorted_directly(padded: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Places in order of the ``depth`` bytes from them: by the first eight, then ties by the next eight."""
    keys = words_at(padded, at)
    order = np.argsort(keys, kind="stable")
    at, keys = at[order], keys[order]
    fresh = np.append(True, keys[1:] != keys[:-1])
    for shift in range(8, depth, 8):
        group = np.cumsum(fresh) - 1
        tied = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(tied):
            break
        keys = words_at(padded, at[tied], shift)
        order = np.lexsort((keys, group[tied]))
        at[tied] = at[tied[order]]
        keys, own = keys[order], group[tied]
        fresh[tied[1:]] |= (keys[1:] != keys[:-1]) & (own[1:] == own[:-1])
    return at


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """All suffixes in order of at least ``depth`` bytes."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    padded = np.concatenate([text, np.zeros(depth + 24, np.uint8)])
    direct = sorted_directly(padded, np.flatnonzero(smaller_than_next(text)), depth)
    first = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in np.flatnonzero(np.bincount(text, minlength=256)).tolist():
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        held = []
        while len(wave):
            held.append(wave)
            before = wave[wave > 0] - 1
            wave = before[text[before] == c]
        held.append(direct[first[c] : first[c + 1]])
        scanned = np.concatenate(held)
        out.append(scanned)
        before = scanned[scanned > 0] - 1
        heads = text[before]
        before, heads = before[heads > c], heads[heads > c]
        order = np.argsort(heads, kind="stable")
        before, heads = before[order], heads[order]
        edges = np.flatnonzero(np.diff(heads)) + 1
        for part in np.split(before, edges) if len(before) else []:
            waiting[text[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Bytes that each place of ``order`` shares with the one after it, ``most`` at most; zero bytes follow the text."""
    padded = np.concatenate([text, np.zeros(most + 24, np.uint8)])
    out = np.zeros(max(0, len(order) - 1), np.int64)
    live = np.arange(len(out))
    for shift in range(0, most, 8):
        differ = words_at(padded, order[live], shift) ^ words_at(padded, order[live + 1], shift)
        same = differ == 0
        out[live[same]] += 8
        rest, at = differ[~same], live[~same]
        for byte in range(1, 8):
            out[at] += rest >> np.uint64(64 - 8 * byte) == 0
        live = live[same]
    return np.minimum(out, most)


# ---- anchors ----


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and hash of each anchor; rows shorter than LENGTH have none."""
    rows, places, hashes = [], [], []
    for low, high in row_chunks(offsets):
        part, own = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        n = len(part) - GRAM + 1
        if n < LEFT + 1:
            continue
        padded = np.concatenate([part, np.zeros(8, np.uint8)])
        word = lambda shift: np.ndarray((n,), "<u8", padded.data, shift, (1,))  # noqa: B023, E731
        hashed = mixed(word(0) * C1 + mixed(word(8) * C2 + word(GRAM - 8) * C3))
        row = np.repeat(np.arange(low, high), np.diff(own))
        inside = row[:n] == row[GRAM - 1 :]
        picked = np.flatnonzero(winnowed(np.where(inside, hashed, np.uint64(2**64 - 1)), LEFT + 1) & inside)
        rows.append(row[picked])
        places.append(picked + offsets[low])
        hashes.append(hashed[picked])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, place, found = np.concatenate(rows), np.concatenate(places), np.concatenate(hashes)
    long_enough = np.diff(offsets)[row] >= LENGTH
    return row[long_enough], place[long_enough], found[long_enough]


def block_rows(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The block's doc_ids in order (a null as LAST), their texts' bytes and offsets; equal ids in order of text."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    column = table.column("doc_id").combine_chunks()
    ids = column.fill_null(int(LAST)).to_numpy()
    return column, ids, *string_parts(table.column("text"))


def whole_copies(copies: pa.Table, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks the rows that are copies of an earlier document: their doc_id and the digest of their text are told."""
    told = {x for x in zip(copies.column("copy_id").to_pylist(), copies.column("digest").to_pylist(), strict=True) if x[0] is not None}
    out = np.zeros(len(ids), bool)
    for i in np.flatnonzero(np.isin(ids, np.array([x for x, _ in told], np.int64))).tolist():
        out[i] = (int(ids[i]), hashlib.sha256(data[offsets[i] : offsets[i + 1]]).digest()) in told
    return out


def ask(buckets: int):
    """Step 1 in a block: its anchors' hashes, each once, and how many documents have it, by bucket."""

    def run(key, left: pa.Table, copies: pa.Table) -> pa.Table:
        _, ids, data, offsets = block_rows(left)
        row, _, hashes = anchors(data, offsets)
        live = ~whole_copies(copies, ids, data, offsets)[row]
        hashes, row = hashes[live], row[live]  # rows in order
        order = np.argsort(hashes, kind="stable")
        hashes, row = hashes[order], row[order]
        other = np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1]))[: len(row)]
        found, counts = np.unique(hashes[other], return_counts=True)
        where = (found % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        found, counts, where = found[order], np.minimum(counts[order], 65535).astype("<u2"), where[order]
        names, starts = np.unique(where, return_index=True)
        ends = np.append(starts, len(where))[1:]
        return pa.table({
            "bucket": pa.array(names, pa.int64()), "block": pa.array(np.full(len(names), key[0].as_py()), pa.int64()),
            "hashes": pa.array([found[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()), "counts": pa.array([counts[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
        })

    return run


def answer(table: pa.Table) -> pa.Table:
    """Step 1 in a bucket: to each block, its hashes that other blocks have, and those that very many documents have."""
    blocks = table.column("block").to_pylist()
    lists = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("hashes")]
    counts = np.concatenate([np.frombuffer(x.as_buffer(), "<u2") for x in table.column("counts")]).astype(np.int64)
    hashes = np.concatenate(lists)
    _, group = np.unique(hashes, return_inverse=True)
    shared, many = np.bincount(group)[group] > 1, np.bincount(group, counts)[group] > HOT
    ends = np.cumsum([len(x) for x in lists])
    out: dict[str, list] = {"home": [], "shared": [], "hot": []}
    for block, low, high in zip(blocks, ends - [len(x) for x in lists], ends, strict=True):
        if shared[low:high].any() or many[low:high].any():
            out["home"].append(block)
            out["shared"].append(hashes[low:high][shared[low:high]].tobytes())
            out["hot"].append(hashes[low:high][many[low:high]].tobytes())
    return pa.table({"home": pa.array(out["home"], pa.int64()), "shared": pa.array(out["shared"], pa.binary()), "hot": pa.array(out["hot"], pa.binary())})


# ---- cuttings ----

CUTTING = [("bytes", "u1", (CUT,)), ("id", "<i8"), ("row", "<u4"), ("start", "<u4"), ("size", "u1"), ("anchor", "u1")]
#: Instead of the anchor's place: the cutting is one run.
ALONE = 255
#: Cuttings that are made in one go.
CHUNK = 10_000


def fingerprints(cut: np.ndarray, size: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each padded cutting."""
    words = np.ascontiguousarray(cut).view("<u8").reshape(len(cut), CUT // 8)
    tail = size.astype(np.uint64) << np.uint64(8) | anchor.astype(np.uint64)
    a, b = mixed(tail * C1 + C2), mixed(tail * C3 + C1)
    for i in range(words.shape[1]):
        a, b = mixed((a ^ words[:, i]) * C1), mixed((b + words[:, i]) * C3 ^ C2)
    return a, b


def cut_bytes(padded: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The cuttings' bytes, zero beyond their ends."""
    reach = np.arange(CUT)[None, :]
    out = padded[low[:, None] + reach]
    out[reach >= (high - low)[:, None]] = 0
    return out


def leads(padded: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which cuttings have the smallest doc_id among equal ones, and which have a larger one."""
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = [fingerprints(cut_bytes(padded, low[s], high[s]), (high - low)[s], anchor[s]) for s in (slice(at, at + CHUNK) for at in range(0, len(low), CHUNK))]
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ids, b, a))
    fresh = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
    least = ids[order][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    behind = ids[order] > least
    return np.sort(order[~behind]), order[behind]


def group_keys(cuttings: np.ndarray) -> np.ndarray:
    """What cuttings that may share a run have in common: the hash of the anchor, or of a run sent alone."""
    raw = np.ascontiguousarray(cuttings["bytes"])
    alone = cuttings["anchor"] == ALONE
    at = np.where(alone, 0, cuttings["anchor"]).astype(np.int64)
    gram = np.take_along_axis(raw, at[:, None] + np.arange(GRAM)[None, :], axis=1)
    word = lambda shift: np.ascontiguousarray(gram[:, shift : shift + 8]).view("<u8")[:, 0]
    keys = mixed(word(0) * C1 + mixed(word(8) * C2 + word(GRAM - 8) * C3))
    if alone.any():
        keys[alone] = fingerprints(raw[alone], cuttings["size"][alone], cuttings["anchor"][alone])[0]
    return keys


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each row with touching and overlapping ones joined, in order."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    wide = np.int64(1) << 33  # rows apart by more than any text
    reach = np.maximum.accumulate(row.astype(np.int64) * wide + end) - row.astype(np.int64) * wide
    fresh = np.append(True, (row[1:] != row[:-1]) | (start[1:] > reach[:-1]))
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(row)) - 1
    return row[first], start[first], reach[last]


def range_rows(block: int, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict:
    return {"block": block, "ranges": np.stack([row, start, end]).astype("<u4").tobytes()}


def cut_out(buckets: int):
    """Step 2: the cuttings of a block by bucket, and what is settled in the block (bucket by block, no cuttings)."""

    def run(key, left: pa.Table, told: pa.Table) -> pa.Table:
        block = key[0].as_py()
        _, ids, data, offsets = block_rows(left)
        row, place, hashes = anchors(data, offsets)
        given = told.filter(pa.compute.is_null(told.column("copy_id")))
        live = ~whole_copies(told, ids, data, offsets)[row]
        row, place, hashes = row[live], place[live], hashes[live]
        joined = lambda name: np.unique(np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(x.as_buffer(), "<u8") for x in given.column(name))]))
        shared, hot = joined("shared"), joined("hot")
        order = np.argsort(hashes, kind="stable")
        row, place, hashes = row[order], place[order], hashes[order]
        fresh = np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)]
        group = np.cumsum(fresh) - 1
        here = np.zeros(0, bool)
        if len(hashes):
            firsts = np.flatnonzero(fresh)
            here = (np.minimum.reduceat(ids[row], firsts) != np.maximum.reduceat(ids[row], firsts))[group]
        keep = here | np.isin(hashes, shared)
        row, place, hashes = row[keep], place[keep], hashes[keep]
        many = np.isin(hashes, hot)
        low, high = np.maximum(offsets[row], place - LEFT), np.minimum(offsets[row + 1], place + LENGTH)
        padded = np.concatenate([data, np.zeros(CUT, np.uint8)])
        first, later = leads(padded, ids[row], low, high, place - low)
        settled = [(row[later], low[later], high[later])]
        anchor = place - low
        if many[first].any():  # these go run by run
            own = first[many[first]]
            times = (high - low - LENGTH + 1)[own]
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            runs, of = np.repeat(low[own], times) + nth, np.repeat(row[own], times)
            alone = np.full(len(runs), ALONE)
            one, more = leads(padded, ids[of], runs, runs + LENGTH, alone)
            settled.append((of[more], runs[more], runs[more] + LENGTH))
            rest = first[~many[first]]
            row, low, high, anchor = (np.concatenate([x[rest], y[one]]) for x, y in ((row, of), (low, runs), (high, runs + LENGTH), (anchor, alone)))
        else:
            row, low, high, anchor = row[first], low[first], high[first], anchor[first]
        cuttings = np.zeros(len(row), CUTTING)
        cuttings["id"], cuttings["row"], cuttings["start"] = ids[row], row, low - offsets[row]
        cuttings["size"], cuttings["anchor"] = high - low, anchor
        for at in range(0, len(row), CHUNK):
            cuttings["bytes"][at : at + CHUNK] = cut_bytes(padded, low[at : at + CHUNK], high[at : at + CHUNK])
        gone_row, gone_low, gone_high = (np.concatenate(x) for x in zip(*settled, strict=True))
        out: dict[str, list] = {"bucket": [], "block": [], "cuttings": [], "ranges": []}
        if len(gone_row):
            done = range_rows(block, *merged(gone_row, gone_low - offsets[gone_row], gone_high - offsets[gone_row]))
            out = {"bucket": [block % buckets], "block": [block], "cuttings": [None], "ranges": [done["ranges"]]}
        if len(cuttings):
            where = (group_keys(cuttings) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            names, starts = np.unique(where[order], return_index=True)
            for name, part in zip(names.tolist(), np.split(order, starts[1:]), strict=True):
                out["bucket"].append(name)
                out["block"].append(block)
                out["cuttings"].append(pa.compress(cuttings[part].tobytes(), codec="zstd", asbytes=True))
                out["ranges"].append(len(part).to_bytes(4, "little"))
        return pa.table({"bucket": pa.array(out["bucket"], pa.int64()), "block": pa.array(out["block"], pa.int64()), "cuttings": pa.array(out["cuttings"], pa.binary()), "ranges": pa.array(out["ranges"], pa.binary())})

    return run


def shared_runs(cuttings: np.ndarray) -> np.ndarray:
    """Step 3: for each cutting, a row of marks of the runs (by start) that a smaller doc_id has too."""
    raw = np.ascontiguousarray(cuttings["bytes"])
    marks = np.zeros((len(cuttings), LEFT + 1), bool)
    keys = group_keys(cuttings)
    a, b = fingerprints(raw, cuttings["size"], cuttings["anchor"])
    order = np.lexsort((cuttings["id"], b, a, keys))
    k, a, b, ids = keys[order], a[order], b[order], cuttings["id"][order]
    other = (k[1:] != k[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    fresh = np.append(True, other)
    of = np.cumsum(fresh) - 1  # class of equal cuttings
    heads = np.flatnonzero(fresh)
    least = ids[heads]
    marks[order[ids > least[of]]] = True
    groups = np.cumsum(np.append(True, k[1:] != k[:-1])) - 1
    several = np.bincount(groups[heads])[groups[heads]] > 1
    if several.any():
        chosen = np.flatnonzero(several)  # classes that have others to be compared with
        leads = order[heads[chosen]]
        size = cuttings["size"][leads].astype(np.int64)
        ends = np.cumsum(size)
        text = raw[leads][np.arange(CUT)[None, :] < size[:, None]]
        owner = np.repeat(np.arange(len(leads)), size)
        place = np.arange(len(text)) - (ends - size)[owner]
        starts = place <= (size - LENGTH)[owner]
        sorted_all = suffix_array(text)
        sorted_starts = sorted_all[starts[sorted_all]]
        apart = np.append(True, common_prefixes(text, sorted_starts) < LENGTH)
        firsts = np.flatnonzero(apart)
        doc = least[chosen][owner[sorted_starts]]
        smallest = np.minimum.reduceat(doc, firsts)[np.cumsum(apart) - 1]
        found = sorted_starts[doc > smallest]
        lead_marks = np.zeros((len(leads), LEFT + 1), bool)
        lead_marks[owner[found], place[found]] = True
        position = np.full(len(heads), -1)
        position[chosen] = np.arange(len(chosen))
        mine = np.flatnonzero((position[of] >= 0) & (ids == least[of]))  # every row of the class's smallest doc_id
        marks[order[mine]] |= lead_marks[position[of[mine]]]
    return marks & (np.arange(LEFT + 1)[None, :] <= cuttings["size"].astype(np.int64)[:, None] - LENGTH)


def shared_in_parts(cuttings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuttings and starts of the shared runs; what may share a run is in the same part."""
    n = -(-cuttings.nbytes // PART)
    parts = np.concatenate([group_keys(cuttings[at : at + CHUNK]) >> np.uint64(20) for at in range(0, len(cuttings), CHUNK)]) % np.uint64(n)
    order = np.argsort(parts, kind="stable")
    held, starts = [], []
    for own in np.split(order, np.flatnonzero(np.diff(parts[order])) + 1):
        row, at = np.nonzero(shared_runs(cuttings[own]))
        held.append(own[row])
        starts.append(at)
    return np.concatenate(held), np.concatenate(starts)


def compare(table: pa.Table) -> pa.Table:
    """Step 3 in a bucket: the ranges of bytes to take out, by block."""
    out: dict[str, list] = {"home": [], "ranges": []}
    blocks, parts = [], []
    for block, packed, ranges in zip(table.column("block").to_pylist(), table.column("cuttings").to_pylist(), table.column("ranges").to_pylist(), strict=True):
        if packed is None:
            out["home"].append(block)
            out["ranges"].append(ranges)
        else:
            n = int.from_bytes(ranges, "little")
            raw = pa.decompress(packed, n * np.dtype(CUTTING).itemsize, codec="zstd", asbytes=True)
            parts.append(np.frombuffer(raw, CUTTING))
            blocks.append(np.full(n, block))
    if parts:
        cuttings, of = np.concatenate(parts), np.concatenate(blocks)
        held, at = shared_in_parts(cuttings)
        start = cuttings["start"][held].astype(np.int64) + at
        order = np.argsort(of[held], kind="stable")
        names, starts = np.unique(of[held][order], return_index=True)
        for name, part in zip(names.tolist(), np.split(order, starts[1:]) if len(order) else [], strict=True):
            found = range_rows(name, *merged(cuttings["row"][held[part]].astype(np.int64), start[part], start[part] + LENGTH))
            out["home"].append(found["block"])
            out["ranges"].append(found["ranges"])
    return pa.table({"home": pa.array(out["home"], pa.int64()), "ranges": pa.array(out["ranges"], pa.binary())})


def take_out(with_text: bool):
    """Step 4: each document's counts and what is left of it."""

    def run(key, left: pa.Table, told: pa.Table) -> pa.Table:
        column, ids, data, offsets = block_rows(left)
        lengths = np.diff(offsets)
        lists = [np.frombuffer(x.as_buffer(), "<u4").reshape(3, -1) for x in told.column("ranges") if x.is_valid]
        row, start, end = np.concatenate(lists, axis=1).astype(np.int64) if lists else np.zeros((3, 0), np.int64)
        copies = np.flatnonzero(whole_copies(told, ids, data, offsets) & (lengths >= LENGTH))
        row, start, end = merged(np.concatenate([row, copies]), np.concatenate([start, np.zeros(len(copies), np.int64)]), np.concatenate([end, lengths[copies]]))
        change = np.zeros(len(data) + 1, np.int32)
        np.add.at(change, offsets[row] + start, 1)
        np.add.at(change, offsets[row] + end, -1)
        kept = np.cumsum(change[:-1], dtype=np.int32) == 0
        left_over = data[kept]
        bounds = np.searchsorted(np.flatnonzero(kept), offsets)
        texts = [left_over[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        n = len(ids)
        columns = {
            "doc_id": column, "n_bytes": pa.array(lengths, pa.int64()), "n_removed": pa.array(lengths - np.diff(bounds), pa.int64()),
            "n_spans": pa.array(np.bincount(row, minlength=n), pa.int64()), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
        }
        if with_text:
            columns["kept"] = pa.array(texts, pa.binary())
        return pa.table(columns)

    return run


def remove_repeats(documents: DataFrame, *, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Per document: bytes, bytes and runs removed, and the SHA-256 of the rest (``with_text``: also the bytes)."""
    prepare(documents.sparkSession)
    texts = documents.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    needed = -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)
    n = partitions(documents)
    blocks, buckets = max(n * BLOCKS, needed), max(n, needed)
    source = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    named = source.select(F.coalesce("doc_id", F.lit(int(LAST))).alias("copy_id"), F.col("block").alias("home"), F.unhex(F.sha2("text", 256)).alias("digest"))
    first = named.groupBy("digest").agg(F.min("copy_id").alias("first"), F.max("copy_id").alias("last")).where("first < last").select("digest", "first").checkpoint()
    copies = named.join(first, "digest").where("copy_id > first").select("home", "copy_id", "digest").distinct().checkpoint()
    same = lambda a, b: a.groupBy("block").cogroup(b.groupBy("home"))
    with_copies = lambda found: found.unionByName(copies, allowMissingColumns=True)

    asked = same(source, copies).applyInArrow(ask(buckets), "bucket long, block long, hashes binary, counts binary")
    told = asked.groupBy("bucket").applyInArrow(answer, "home long, shared binary, hot binary")
    cuttings = same(source, with_copies(told)).applyInArrow(cut_out(buckets), "bucket long, block long, cuttings binary, ranges binary")
    found = cuttings.groupBy("bucket").applyInArrow(compare, "home long, ranges binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return same(source, with_copies(found)).applyInArrow(take_out(with_text), schema)


ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
runs AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) AS s FROM d, range(0, n - {LENGTH} + 1) AS t(i)),
first AS (SELECT s, min(doc_id) AS f FROM runs GROUP BY s),
found AS (SELECT doc_id, i FROM runs JOIN first USING (s) WHERE f < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM found, range(i, i + {LENGTH}) AS t(p)),
spans AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE fresh) AS n_spans FROM (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 1, true) AS fresh FROM gone) GROUP BY doc_id),
bytes AS (SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS b FROM d, range(0, n) AS t(p)),
kept AS (SELECT doc_id, string_agg(b, '' ORDER BY p) AS k FROM bytes ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM d LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
