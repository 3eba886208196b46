"""Best-fit decreasing packing of token sequences into windows.

Documents are tokenised where they are read; what exceeds a window is cut into full windows. The pieces are packed where they
are, in blocks of bounded size, so ids never move: a partition of a table gives a few sequences that aren't full, whatever
the table's size. In a block the longest piece goes first, into the open window with the least room that still holds it. A
segment tree over the possible remaining capacities, from 1 to the window, finds that window in as many steps as the window
has bits.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from itertools import groupby, islice

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import workers

#: Pieces that are packed together; more go to a next block, so a task holds no more than these.
BLOCK = 8192
#: A line break or a space between visible ASCII characters, letters or digits. Byte-level pre-tokenisation parts a text before
#: and after such breaks, and before such spaces, whatever its tables of characters, so what lies between can be encoded by
#: itself.
BREAK, BEFORE_WORD, EDGE = re.compile(r"(?<=[!-~\w])\n(?=[!-~\w])"), re.compile(r"(?<=[!-~\w]) (?=[!-~\w])"), re.compile(r"[!-~\w]")
#: Words of letters, which are one pre-token, and the one mark that may follow, which is another; words that are remembered (up
#: to twice as many), and their length.
WORD, WORDS, WORD_CHARS = re.compile("([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?]?)"), 1 << 19, 32


class OtherEdge(ValueError):
    """A word doesn't begin and end as those between the spaces of BEFORE_WORD do."""


class Words(dict):
    """The ids of words after a given string, each found by the tokenizer once while it is remembered. When there are too many,
    those that aren't asked for again before there are as many once more are forgotten."""

    def __init__(self, after: str, encode: Callable[[str], bytes], model: Callable[[str], list]):
        self.after, self.encode, self.model, self.old = after, encode, model, {}
        # Byte-level vocabularies write each byte as a printable character: printable Latin-1 as itself, the rest from 256 up.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.marks, self.shown_after = {m: encode(m) for m in ".,;:!?"}, after.translate(self.shown)

    def __missing__(self, word: str) -> bytes:
        if ids := self.old.get(word):
            pass
        elif m := WORD.fullmatch(word):
            letters, mark = m.groups()
            if mark:
                return self[letters] + self.marks[mark]
            ids = array("I", [t.id for t in self.model(self.shown_after + (word if word.isascii() else word.encode().decode("latin-1").translate(self.shown)))]).tobytes()
        elif word and EDGE.match(word[0]) and EDGE.match(word[-1]):
            ids = self.encode(self.after + word)
        else:
            raise OtherEdge
        if len(word) <= WORD_CHARS:
            if len(self) >= WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


@cache
def tokenizer(path: str) -> Callable[[str], bytes]:
    """Text to ids as little-endian unsigned 32-bit numbers, as the tokenizer file gives them without special tokens added.

    With byte-level vocabularies a text is parted at BREAK and BEFORE_WORD, and the same library encodes each different word
    once, words of letters by its model alone. Other files encode whole texts.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    spec = json.loads(whole.to_str())
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]

    def library(text: str) -> bytes:
        return array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()

    plain = not any(spec.get(k) for k in ("normalizer", "truncation", "padding")) and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    # A special token must not reach over a space nor be a word of letters.
    apart = all(not re.search(r"\s", t["content"]) and not WORD.fullmatch(t["content"]) and not any(t.get(k) for k in ("lstrip", "rstrip", "single_word")) for t in spec.get("added_tokens", []))
    if not (plain and level and apart):
        return library
    firsts, words, line_end = Words("", library, whole.model.tokenize), Words(" ", library, whole.model.tokenize), library("\n")

    def by_line(line: str) -> bytes:
        try:
            first, *rest = line.split(" ")
            return firsts[first] + b"".join(map(words.__getitem__, rest))
        except OtherEdge:  # some space isn't one to part at
            first, *rest = BEFORE_WORD.split(line)
            return library(first) + b"".join(words[w] if EDGE.match(w[-1]) else library(" " + w) for w in rest)

    def by_word(text: str) -> bytes:
        return line_end.join(map(by_line, BREAK.split(text)))

    return by_word


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = [c.split()[0] for c in PIECE.split(", ")]
#: Windows of an Arrow batch.
BATCH = 1000


def token_pieces(docs: DataFrame, path: str, window: int = 1024, end_id: int | None = 0, key: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """Rows PIECE and, with ids, ids binary (little-endian unsigned 32-bit): each document's ids and then end_id, in full
    windows and a rest. A null text is an empty one, which has the end id alone (without end ids it has no piece). Null and
    repeated doc_ids are kept as they are, other columns ignored."""
    workers(docs.sparkSession)
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(d, s, n, zlib.crc32(i), t, *((i,) if ids else ())) for d, s, n, t, i in tokenised(iter([batch]), tokenizer(path), window, end)]
            arrays = [pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, [pa.int64()] * 5 + [pa.binary()] * ids)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*PLACED, *(["ids"] if ids else [])])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECE + (", ids binary" if ids else ""))


def tokenised(batches: Iterator[pa.RecordBatch], encode: Callable[[str], bytes], window: int, end: bytes) -> Iterator[tuple]:
    """(doc_id, start, length, doc_tokens, ids) of the pieces of batches of (doc_id, text)."""
    for batch in batches:
        for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            made = encode(body or "") + end
            n = len(made) // 4
            for at in range(0, n, window):
                piece = made[4 * at : 4 * (at + window)]
                yield doc_id, at, len(piece) // 4, n, piece


class Room:
    """A segment tree whose leaves are remaining capacities; a node is set while a window below it is open."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.full = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, one: int) -> None:
        if not capacity:
            return
        self.open[capacity].append(one)
        at = capacity + self.leaves
        while at and not self.full[at]:
            self.full[at] = 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """A window with the least capacity of at least this, and that capacity."""
        full, at = self.full, least + self.leaves
        if not full[at]:
            while at > 1 and (at & 1 or not full[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if full[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        one = self.open[capacity].pop()
        if not self.open[capacity]:
            while at and full[at]:
                full[at] = at < self.leaves and (full[2 * at] or full[2 * at + 1])
                if full[at]:
                    break
                at >>= 1
        return one, capacity


def best_fit(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """For each piece its window's number and its offset there; the longest pieces first, ties in their order."""
    room, n, out = Room(window), 0, [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        length = lengths[i]
        if (found := room.take(length)) is None:
            found, n = (n, window), n + 1
        one, capacity = found
        out[i] = one, window - capacity
        room.put(capacity - length, one)
    return out


def pack(pieces: DataFrame, window: int = 1024, block: int = BLOCK) -> DataFrame:
    """pieces (doc_id, start, length up to window, ids_crc32, doc_tokens and, if there, ids) with sequence_id and offset.

    Blocks are the next block pieces of a partition, so memory is bounded and nothing moves; a partition that is read alike is
    packed alike. Pieces of one document may part. Repeated rows are packed each; an empty table gives an empty result; other
    columns are left out. Each partition leaves a few sequences that aren't full, so many tiny ones want coalesce first.
    """
    workers(pieces.sparkSession)
    ids = "ids" in pieces.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, held, n = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= block:
                whole = pd.concat(held, ignore_index=True)
                for at in range(0, n - n % block, block):
                    part, used = packed(whole.iloc[at : at + block], first)
                    first += used
                    yield part
                held, n = [whole.iloc[n - n % block :]], n % block
        if n:
            yield packed(pd.concat(held, ignore_index=True), first)[0]

    def packed(rows: pd.DataFrame, first: int) -> tuple[pd.DataFrame, int]:
        places = best_fit(rows["length"].tolist(), window)
        out = rows.assign(sequence_id=[first + s for s, _ in places], offset=[o for _, o in places]).astype({"doc_id": "Int64"})
        return out, 1 + max(s for s, _ in places)

    return pieces.select(*PLACED, *(["ids"] if ids else [])).mapInPandas(run, PIECE + (", ids binary" if ids else "") + ", sequence_id long, offset long")


LAID = "sequence_id long, ids binary, used long, pieces array<struct<doc_id: long, start: long, length: long, doc_tokens: long, offset: long>>"
_PARTS = pa.list_(pa.struct([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "offset")]))


def _laid(pieces: Iterator[tuple], window: int, block: int, pad: bytes) -> Iterator[pa.RecordBatch]:
    """LAID rows of (doc_id, start, length, doc_tokens, ids), block pieces at a time."""
    first = TaskContext.get().partitionId() << 40
    while held := list(islice(pieces, block)):
        places, out, number = best_fit([p[2] for p in held], window), [], -1
        for number, run in groupby(sorted(range(len(places)), key=places.__getitem__), lambda i: places[i][0]):
            here = list(run)
            made = b"".join(held[i][4] for i in here)
            used = len(made) // 4
            out.append((first + number, made + pad * (window - used), used, [dict(zip(("doc_id", "start", "length", "doc_tokens"), held[i]), offset=places[i][1]) for i in here]))
            if len(out) >= BATCH:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)
        first += number + 1


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    arrays = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int64(), _PARTS))]
    return pa.RecordBatch.from_arrays(arrays, names=["sequence_id", "ids", "used", "pieces"])


def sequences(pieces: DataFrame, window: int = 1024, block: int = BLOCK, pad_id: int = 0) -> DataFrame:
    """pieces with ids to LAID rows: the ids of each window, little-endian unsigned 32-bit and padded to its whole length, how many
    of them are no padding, and what lies where. Blocks are those of pack."""
    workers(pieces.sparkSession)
    pad = pad_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _laid((row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))), window, block, pad)

    return pieces.select("doc_id", "start", "length", "doc_tokens", "ids").mapInArrow(run, LAID)


def sequences_of(docs: DataFrame, path: str, window: int = 1024, end_id: int | None = 0, block: int = BLOCK, pad_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """sequences of token_pieces of docs, both made by one worker, so that ids don't go to and fro between them."""
    workers(docs.sparkSession)
    end, pad = b"" if end_id is None else end_id.to_bytes(4, "little"), pad_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _laid(tokenised(batches, tokenizer(path), window, end), window, block, pad)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, LAID)


def digests(laid: DataFrame) -> DataFrame:
    """Rows of pack without ids from the windows of sequences: each piece's checksum is that of the ids at its place there."""
    rows = laid.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    crc = F.expr("crc32(substring(ids, cast(4 * p.offset + 1 as int), cast(4 * p.length as int)))").alias("ids_crc32")
    return rows.select("p.doc_id", "p.start", "p.length", crc, "p.doc_tokens", "sequence_id", "p.offset")
