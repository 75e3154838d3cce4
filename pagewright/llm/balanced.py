"""Cost-balanced packing of documents into sequences of tokens.

A document is its token ids and one end id.  The cost of a piece of n ids is estimated as n + n * n / (6 * width): the
linear part stands for the layers' matrices, the quadratic one for attention within the piece, for a model so wide.

Each task packs the documents of its own partition, ``group`` full sequences at a time, so nothing is shuffled and no more
than a group's ids is held (or one document's, if that is longer).  In a group:

1. documents longer than a sequence (or than ``longest``, which evens out costs further) are cut to pieces so long and
   a rest,
2. pieces are taken in descending order of cost, and each goes to the sequence of least cost so far that has room for it,
3. a piece that fits nowhere is cut: it fills up the sequence of least cost that has room, and the rest is dealt likewise.

Room and tokens are equal, so full sequences have no padding at all.  The ids beyond the last full one stay for the next
group.  What is left at a partition's end goes to sequences whose room is a power of two each, from 2,048 down as far as
needed, which need no padding either.

Tokens are those of the ``tokenizers`` file given by path, one that drops white space, lower-cases and marks words' ends.  Its
splitting never looks beyond white space; ``Words`` tells how texts are encoded faster than by the library, to the same ids.

Defined cases: a null text is an empty one and gives the end id alone; repeated rows are packed as often as they occur, and
rows without id like others; long texts are read whole; an empty table gives an empty result; other columns are left
aside, whatever their names.  Which documents meet in a sequence depends on the partitions; a task that is run again packs
the same rows alike.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, row_chunks, text_of
from .packing import byte_alphabet

CAPACITY = 4096
END_ID = 2
#: Sequences that are packed together.
GROUP = 512
#: Width of the model that costs are estimated for.
WIDTH = 1024
#: Words whose ids a worker keeps; beyond, it starts anew.
KEPT = 400_000
ROWS = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"

#: ASCII, composed Latin and Cyrillic letters, dashes and quotes: these are the same in composed form, and lower-cased sign by sign.
PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-įı-ſЀ-џ‐-‧‰-⁞]*")
#: Split pattern of the public tokenizer file (a fixed value), for lower-cased texts of such signs.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")
WORD = re.compile("[^\t-\r ]+")
#: A byte that no plain text has, and what stands in the vocabulary for a word's end.
END, WORD_END = 1, "</w>"
#: Bytes of a piece beyond which merging by ranks, which takes the square of them, is left to the library.
LONG = 400
SPACE, LETTER, DIGIT, SIGN, INNER = range(5)


def kinds_of_bytes() -> np.ndarray:
    """What each byte of a plain text begins, or that it goes on with a character."""
    kinds = np.full(256, SIGN, np.uint8)
    kinds[[*range(9, 14), 32]] = SPACE
    kinds[[*range(97, 123), 0xC3, 0xC4, 0xC5, 0xD0, 0xD1]] = LETTER
    kinds[48:58] = DIGIT
    kinds[128:192] = INNER
    return kinds


KINDS = kinds_of_bytes()


def piece_ends(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a plain lower-cased text: which bytes are white space, and which end a piece of ``PIECE``."""
    kind = KINDS[data]
    inner = kind == INNER
    for _ in range(2):  # characters have three bytes at most
        kind[1:] = np.where(kind[1:] == INNER, kind[:-1], kind[1:])
    following = np.append(kind[1:], np.uint8(SPACE))
    ends = (kind != SPACE) & np.append(~inner[1:], True) & ((kind != following) | (kind == DIGIT))
    marks = np.flatnonzero((data == 39) & (np.append(np.uint8(SPACE), kind[:-1]) != SIGN))  # an apostrophe that a piece begins with
    first, second = np.append(data, [0, 0])[marks + 1], np.append(data, [0, 0])[marks + 2]
    one = np.isin(first, list(b"stmd"))
    two = (second == ord("e")) & np.isin(first, list(b"rv")) | (second == ord("l")) & (first == ord("l"))
    ends[marks[one | two]] = False
    ends[marks[one] + 1] = True
    ends[marks[two] + 2] = True
    return kind == SPACE, ends


class Words(dict):
    """Ids of texts as the library gives them.  As a dict: numbers of words and pieces of words by their text.

    Plain texts are cut to pieces with a byte behind each that stands for the word's end, and merged by ``tiktoken``: there, two
    neighbours merge if their join is a token, here, if they are a listed pair.  That is the same for vocabularies in which
    merging a token's own text ends with its own pair, as it does in the public file (tests go through all).  Other texts
    go word by word: each word or piece is encoded once by the library and kept, ``KEPT`` of them at most.
    """

    def __init__(self, spec: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        parsed = json.loads(spec)
        self.library = Tokenizer.from_str(spec)
        self.special = [t["content"] for t in parsed.get("added_tokens", [])]
        signs, ranks = byte_alphabet(), {}
        for token, i in parsed["model"]["vocab"].items():
            if token not in self.special:
                ranks[bytes(signs[c] for c in token.removesuffix(WORD_END)) + bytes([END]) * token.endswith(WORD_END)] = i
        self.fast = tiktoken.Encoding("words", pat_str="[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})
        self.last = np.zeros(max(ranks.values()) + 1, bool)
        self.last[[i for token, i in ranks.items() if token[-1] == END]] = True
        self.starts, self.ids, self.fresh = np.zeros(1, np.int64), np.zeros(0, np.uint32), []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = number = len(self)
        return number

    def numbers(self, text: str) -> np.ndarray:
        """The text as numbers of its pieces; words that hold other signs or special tokens are left to the library."""
        of = self.__getitem__
        special = any(s in text for s in self.special)
        out: list[int] = []
        for word in WORD.findall(text):
            if PLAIN.fullmatch(word) and not (special and any(s in word for s in self.special)):
                out += map(of, PIECE.findall(word.lower()))
            else:
                out.append(of(f" {word}"))  # as it is, so told from a piece by a blank that no piece has
        return np.array(out, np.int64)

    def by_word(self, texts: list[str]) -> list[np.ndarray]:
        numbers = [self.numbers(t) for t in texts]
        if self.fresh:
            new = [np.array(e.ids, np.uint32) for e in self.library.encode_batch(self.fresh, add_special_tokens=False)]
            self.ids = np.concatenate([self.ids, *new])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(x) for x in new])])
            self.fresh = []
        out = []
        for held in numbers:
            starts, sizes = self.starts[held], self.starts[held + 1] - self.starts[held]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)
            out.append(self.ids[at])
        if len(self) > KEPT:
            self.clear()
            self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        return out

    def by_rank(self, texts: list[str]) -> list[np.ndarray | None]:
        """The ids of plain texts; none of those with a very long piece."""
        raw = [t.lower().encode() for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        stops = np.cumsum([len(r) + 1 for r in raw])
        space, ends = piece_ends(data)
        copies = (~space).astype(np.int64) + ends
        last = np.cumsum(copies)
        signs = np.repeat(data, copies)
        signs[last[ends] - 1] = END
        sizes = np.diff(last[ends], prepend=0)
        before = np.concatenate([[0], np.cumsum(ends)[stops - 1]])
        long = sizes > LONG
        if long.any():
            odd = [bool(long[a:b].any()) for a, b in zip(before[:-1], before[1:], strict=True)]
            rest = iter(self.by_rank([t for t, o in zip(texts, odd, strict=True) if not o]) if not all(odd) else [])
            return [None if o else next(rest) for o in odd]
        ids = self.fast.encode_to_numpy(signs.tobytes().decode(), disallowed_special=())
        after = np.concatenate([[0], np.flatnonzero(self.last[ids]) + 1])  # where the ids of so many pieces end
        at = after[before]
        return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def encoded(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        """The ids of each text and the end id."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if PLAIN.fullmatch(t) and not any(s in t for s in self.special)]
        sizes = np.concatenate([[0], np.cumsum([len(texts[i]) for i in plain])]).astype(np.int64)
        for a, b in row_chunks(sizes):
            for i, ids in zip(plain[a:b], self.by_rank([texts[i] for i in plain[a:b]]), strict=True):
                out[i] = ids
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self.by_word([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return [np.append(ids, np.uint32(end_id)).astype("<u4") for ids in out]


_WORDS: dict[int, Words] = {}


def words_of(spec: str) -> Words:
    """One encoder for all tasks of a worker."""
    if hash(spec) not in _WORDS:
        _WORDS.clear()
        _WORDS[hash(spec)] = Words(spec)
    return _WORDS[hash(spec)]


def cost(n: np.ndarray | int, width: int = WIDTH) -> np.ndarray | int:
    """The estimated cost of a piece, times six widths: a whole number."""
    return 6 * width * n + n * n


def powers_of_two(n: int) -> list[int]:
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


def dealt(lengths: list[int], rooms: list[int], width: int = WIDTH, longest: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of pieces that fill all rooms; lengths and rooms have the same sum."""
    most = min(max(rooms, default=0), longest or max(rooms, default=0))
    room, spent = np.array(rooms, np.int64), np.zeros(len(rooms), np.int64)
    size, never = room.copy(), np.iinfo(np.int64).max
    pieces = [(min(most, n - at), i, at) for i, n in enumerate(lengths) for at in range(0, n, most or 1)]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    out = []
    for n, i, at in pieces:
        while n:
            to = int(np.where(room >= n, spent, never).argmin())
            if room[to] < n:  # fits nowhere
                to = int(np.where(room > 0, spent, never).argmin())
            part = min(n, int(room[to]))
            out.append((i, at, part, to, int(size[to] - room[to])))
            room[to] -= part
            spent[to] += cost(part, width)
            at, n = at + part, n - part
    return out


def packed(documents: Iterator[tuple[int | None, np.ndarray]], *, capacity: int = CAPACITY, group: int = GROUP, width: int = WIDTH, longest: int | None = None) -> Iterator[tuple]:
    """(doc_id, start, ids, doc_tokens, sequence, offset) of the pieces of some documents."""
    held: list[tuple[int | None, np.ndarray, int]] = []  # with the number of ids that are packed already
    tokens = done = 0

    def flush(rooms: list[int]) -> Iterator[tuple]:
        nonlocal held, tokens, done
        left, lengths = sum(rooms), []
        for _, ids, start in held:
            lengths.append(min(left, len(ids) - start))
            left -= lengths[-1]
        for i, at, n, to, offset in dealt(lengths, rooms, width, longest):
            doc_id, ids, start = held[i]
            yield doc_id, start + at, ids[start + at : start + at + n], len(ids), done + to, offset
        held = [(d, ids, start + n) for (d, ids, start), n in zip(held, lengths, strict=True) if start + n < len(ids)]
        tokens, done = tokens - sum(rooms), done + len(rooms)

    for doc_id, ids in documents:
        held.append((doc_id, ids, 0))
        tokens += len(ids)
        if tokens >= group * capacity:
            yield from flush([capacity] * (tokens // capacity))
    if tokens:
        yield from flush([capacity] * (tokens // capacity) + powers_of_two(tokens % capacity))


def pack(documents: DataFrame, tokenizer_path: str, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP, width: int = WIDTH, longest: int | None = None) -> DataFrame:
    """Every piece with its ids (little-endian, 32 bits each), its place in the document, its sequence and its place there."""
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    spark = documents.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, first = words_of(shared.value), TaskContext.get().partitionId() << 40

        def encoded() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), words.encoded(batch.column(1).to_pylist(), end_id), strict=True)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            doc_id, start, ids, tokens, sequence, offset = zip(*rows, strict=True)
            long = lambda x: pa.array(x, pa.int64())
            return pa.RecordBatch.from_arrays([long(doc_id), long(start), pa.array([x.tobytes() for x in ids], pa.binary()), long(tokens), long([first + s for s in sequence]), long(offset)], ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"])

        rows: list[tuple] = []
        size = 0
        for row in packed(encoded(), capacity=capacity, group=group, width=width, longest=longest):
            rows.append(row)
            size += len(row[2])
            if size >= 64 * CAPACITY:
                yield batch_of(rows)
                rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return documents.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, ROWS)


def report(pieces: DataFrame) -> DataFrame:
    length: Column = (F.octet_length("ids") / 4).cast("long")
    return pieces.select("doc_id", "start", length.alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
