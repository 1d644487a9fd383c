"""Harmonic packing: lengths fall into classes (C / (k + 1), C / k] and a bin of class k takes k documents.

A document is first cut into full sequences of C ids; what is left, shorter than C, belongs to the class k = C // length.
Every task fills bins of its own: the k-th document closes a bin of class k, and the room that the k lengths leave is
filled from the next document, which is the only place where a document is cut once more. At the end of a task the
documents of its open bins (one bin of each class at most) are laid end to end, cut at full sequences, and the last ids
go into sequences that are powers of two long. So sequences have no padding but for rooms under ``LEAST`` ids.

A task holds the ids of its open bins alone, about two for each of the square root of C classes. Between tasks only the
number of sequences of each is gathered, so no document, source or copy is ever a hot group and no id is shuffled.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import materialise, rows_of, small_batches

#: Distinct words, and parts of words, whose ids a task remembers; then it starts anew.
WORDS_HELD = 400_000
#: Room of fewer ids is padded; a piece of a document would be too short to be of use there.
LEAST = 16
#: Words of these characters take the short way; the tokenizer does not change them but for their case.
PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u02af]+")
#: Marks that end a word and are a part of their own.
MARKS = set(".,;:!?")
#: Fixed value: how the tokenizer cuts lower-case text into parts.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_letters() -> dict[int, str]:
    """The letters of byte-level models: printable bytes are themselves, the others follow from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


class Remembered(dict):
    """Values by key, made when they are first asked for."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        self[key] = value = self.make(key)
        return value


class WordTokenizer:
    """Ids of texts by a lower-casing byte-level tokenizer that never joins across a space or a line end.

    The ids of words and of their parts are remembered. Words of Latin letters are cut into parts here and only new
    parts go to the model; all other words, and those that may hold a special token, go through the whole tokenizer.
    With ``literal`` the names of special tokens are text like other text; without, they are those tokens.
    """

    def __init__(self, path: str, literal: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.model = self.tokenizer.model
        special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.special = None if literal or not special else re.compile(special)
        self.table = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.words, self.parts = Remembered(self._word), Remembered(self._part)

    def _part(self, part: str) -> bytes:
        letters = part if part.isascii() else part.encode().decode("latin-1").translate(self.table)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii():  # most words are letters, or letters and a mark
            if word.isalpha():
                return self.parts[word.lower()]
            if word[-1:] in MARKS and word[:-1].isalpha():
                return self.parts[word[:-1].lower()] + self.parts[word[-1]]
        if PLAIN.fullmatch(word) and not (self.special and self.special.search(word)):
            return b"".join(map(self.parts.__getitem__, PARTS.findall(word.lower())))
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        for held in (self.words, self.parts):
            if len(held) > WORDS_HELD:
                held.clear()
        known = self.words.__getitem__
        return [np.frombuffer(b"".join(map(known, text.replace("\n", " ").split(" "))), np.uint32) for text in texts]


def token_rows(batches, path: str, end: int | None, literal: bool = False) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each row of Arrow batches, in order; ``end`` closes each document."""
    tokenizer, held, size = WordTokenizer(path, literal), [], 0

    def flush():
        for (doc, _), ids in zip(held, tokenizer.ids([t for _, t in held]), strict=True):
            yield doc, (ids if end is None else np.append(ids, np.uint32(end)))

    for doc, data in rows_of(batches, "doc_id", "text"):
        held.append((doc, (data or b"").decode("utf-8", "replace")))
        size += len(data or b"")
        if size > 1 << 20:
            yield from flush()
            held, size = [], 0
    yield from flush()


class Bins:
    """The bins of one task. ``rows`` collects (doc_id, start, length, crc32, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int, least: int = LEAST):
        self.capacity, self.least = capacity, least
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []
        self.sequences = 0
        #: The closed bin that has room: its sequence, the ids in it and its room.
        self.room = (0, 0, 0)

    def put(self, piece: tuple, n: int, sequence: int, offset: int) -> tuple:
        """Places the first ``n`` ids of a piece (doc_id, start, ids, doc_tokens); what is left of it."""
        doc, start, ids, total = piece
        self.rows.append((doc, start, n, zlib.crc32(ids[:n]), total, sequence, offset))
        return doc, start + n, ids[n:], total

    def new(self) -> int:
        self.sequences += 1
        return self.sequences - 1

    def fill(self, piece: tuple) -> tuple:
        """Fills the room of the last closed bin with the start of a piece."""
        sequence, offset, room = self.room
        n = min(room, len(piece[2]))
        if n:
            piece = self.put(piece, n, sequence, offset)
            self.room = (sequence, offset + n, room - n if room - n >= self.least else 0)
        return piece

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        piece = (doc, 0, ids.astype("<u4", copy=False), len(ids))
        while len(piece[2]) >= self.capacity:
            piece = self.put(piece, self.capacity, self.new(), 0)
        piece = self.fill(piece)
        if not len(piece[2]):
            return
        k = self.capacity // len(piece[2])
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            del self.open[k]
            sequence, offset = self.new(), 0
            for x in held:
                self.put(x, len(x[2]), sequence, offset)
                offset += len(x[2])
            if self.capacity - offset >= self.least:
                self.room = (sequence, offset, self.capacity - offset)

    def finish(self) -> None:
        """Lays the documents of the open bins end to end."""
        pieces = [self.fill(x) for k in sorted(self.open) for x in self.open[k]]
        self.open.clear()
        left = sum(len(x[2]) for x in pieces)
        sequence = offset = size = 0
        for piece in pieces:
            while len(piece[2]):
                if offset == size:  # a full sequence, or in the end the powers of two that make up the rest
                    size = self.capacity if left >= self.capacity else 1 << left.bit_length() - 1
                    sequence, offset = self.new(), 0
                n = min(size - offset, len(piece[2]))
                piece = self.put(piece, n, sequence, offset)
                offset, left = offset + n, left - n


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 4096, end: int = 2) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece of each row of ``docs``.

    The ids are those of the plain tokenizer: the name of a special token in a text is that token. A null or empty text
    is the end id alone. Every id lies in one piece; sequences are numbered from 0 and hold their pieces without gaps.
    A sequence is full but for rooms under LEAST ids, or a power of two long. Repeated rows and null keys are packed
    like others; other columns are not read; an empty table gives no pieces.
    """
    small_batches(docs.sparkSession)
    if capacity < 1:
        raise ValueError("capacity must be positive")
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence", "offset")
    schema = pa.schema([(x, pa.int64()) for x in names])

    def run(batches):
        bins = Bins(capacity)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*bins.rows, strict=True)], schema=schema)

        for doc, ids in token_rows(batches, tokenizer, end):
            bins.add(doc, ids)
            if len(bins.rows) > 20_000:
                yield out()
                bins.rows.clear()
        bins.finish()
        if bins.rows:
            yield out()

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = materialise(source.mapInArrow(run, ", ".join(f"{x} long" for x in names)).withColumn("part", F.spark_partition_id()))
    # one row for each task: the sequences before its own
    counts = pieces.groupBy("part").agg((F.max("sequence") + 1).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    sequence = (F.col("first") + F.col("sequence")).alias("sequence_id")
    return pieces.join(first, "part").select(F.col("doc_id").alias(key), "start", "length", "ids_crc32", "doc_tokens", sequence, "offset")
