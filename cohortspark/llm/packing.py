"""Cost-balanced packing of tokenised documents into sequences of fixed length.

Every Arrow task tokenises its documents and packs them in groups of about
``group_tokens`` ids, so nothing is shuffled and a task holds one group of ids at a
time. A group gets as many slots as its ids fill exactly: slots of ``capacity`` ids
and, for the ids left over, slots of falling powers of two, which need no padding.

* A document is its ids followed by one end id. Runs of ``capacity`` ids fill a slot of
  their own; what remains of each document is a piece.
* Pieces go, longest first, to the slot of lowest estimated attention cost
  (``linear * ids + quadratic * ids^2``, summed over the slot's pieces) that has room.
* A piece that fits nowhere is cut to fill the rooms left, the largest room first.
"""

from __future__ import annotations

import base64
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import by_value, inputs, tidy

by_value(__name__)

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_length long"
)
END = np.zeros(1, "<u4").tobytes()
SPECIAL = "<|endoftext|>"
CACHED_WORDS = 400_000


class Irregular(Exception):
    """A blank next to white space: the tokenizer may not split there."""


class WordIds(dict):
    """Ids of a word and the blank before it, kept while the table is small."""

    def __init__(self, tokenizer, ranks):
        super().__init__()
        self.tokenizer, self.ranks = tokenizer, ranks

    def __missing__(self, word):
        if not word or word[0].isspace() or word[-1].isspace():
            raise Irregular
        self[word] = out = self.encode(" " + word)
        return out

    def encode(self, word):
        if word.isascii() or max(word) < "ƀ":
            return array("I", self.ranks.encode_ordinary(word)).tobytes()
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()


class Encoder:
    """The tokenizer's ids of whole texts, as unsigned 32-bit bytes.

    Splits at single blanks, where the tokenizer always splits too, and looks each word up;
    the same vocabulary as byte ranks encodes words of Latin letters not seen yet. Texts with
    irregular white space or the special token go to the tokenizer whole.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.words = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.words = WordIds(
                self.tokenizer,
                tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}),
            )

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        words = self.words
        if words is not None and SPECIAL not in text:
            if len(words) > CACHED_WORDS:
                words.clear()
            first, *rest = text.split(" ")
            try:
                if not first or first[0].isspace() or first[-1].isspace():
                    raise Irregular
                return words.encode(first) + b"".join(map(words.__getitem__, rest))
            except Irregular:
                pass
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def slots_for(ids: int, capacity: int) -> list[int]:
    """Room of each slot so that ``ids`` fill them all: full ones, then powers of two."""
    left = ids % capacity
    return [capacity] * (ids // capacity) + [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


def place(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """(piece, start in the piece, length, slot) for pieces of at most ``capacity`` ids."""
    room = np.array(slots_for(sum(lengths), capacity), dtype=np.int64)
    cost = np.zeros(len(room))
    placed, homeless = [], []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        length = lengths[piece]
        slot = int(np.where(room >= length, cost, np.inf).argmin()) if len(room) else 0
        if room[slot] < length:
            homeless.append(piece)
            continue
        placed.append((piece, 0, length, slot))
        room[slot] -= length
        cost[slot] += linear * length + quadratic * length * length
    rooms = sorted(np.flatnonzero(room).tolist(), key=lambda s: (room[s], -s))
    for piece in homeless:
        start = 0
        while start < lengths[piece]:
            slot = rooms[-1]
            length = int(min(room[slot], lengths[piece] - start))
            placed.append((piece, start, length, slot))
            room[slot] -= length
            start += length
            if not room[slot]:
                rooms.pop()
    return placed


def pack_group(docs: list[tuple], capacity: int, linear: float, quadratic: float, first: int):
    """Rows of SCHEMA for (doc_id, id bytes) and the number of sequences used."""
    spans, pieces, rows = [], [], []
    for doc, (_, data) in enumerate(docs):
        count = len(data) // 4
        cut = count - count % capacity
        spans += [(doc, start, capacity, None) for start in range(0, cut, capacity)]
        if count > cut:
            pieces.append((doc, cut, count - cut))
    placed = place([p[2] for p in pieces], capacity, linear, quadratic)
    slots = len(slots_for(sum(p[2] for p in pieces), capacity))
    spans += [(pieces[p][0], pieces[p][1] + start, length, slot) for p, start, length, slot in placed]
    filled = [0] * slots
    for _, _, length, slot in spans:
        if slot is not None:
            filled[slot] += length
    offsets, alone = [0] * slots, slots
    for doc, start, length, slot in spans:
        doc_id, data = docs[doc]
        if slot is None:
            sequence, offset, total = alone, 0, capacity
            alone += 1
        else:
            sequence, offset, total = slot, offsets[slot], filled[slot]
            offsets[slot] += length
        crc = zlib.crc32(data[4 * start : 4 * (start + length)])
        rows.append((doc_id, start, length, crc, len(data) // 4, first + sequence, offset, total))
    return rows, alone


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    ranks_path: str | None = None,
    pattern: str | None = None,
    capacity: int = 1024,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
    group_tokens: int = 1 << 20,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of every document and the sequence and offset they lie at.

    ``ranks_path`` and ``pattern`` name the same vocabulary as byte ranks and only make it
    faster. A null or empty text is its end id alone; a null id stays null. Rows repeated in
    the input are packed each for itself. An empty table gives no rows. ``sequence_id`` is
    made of the task's number and a counter, so a rerun over the same splits agrees.
    """
    docs = inputs(docs, "documents", doc_id=doc_id, text=text)

    def run(batches):
        encoder, first = None, TaskContext.get().partitionId() << 32
        held, held_bytes = [], 0

        def flush():
            nonlocal held, held_bytes, first
            rows, used = pack_group(held, capacity, linear, quadratic, first)
            first, held, held_bytes = first + used, [], 0
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            columns = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            encoder = encoder or Encoder(tokenizer_path, ranks_path, pattern)
            for key, value in zip(batch.column(0), batch.column(1)):
                held.append((key.as_py(), encoder.ids(value.as_py() or "") + END))
                held_bytes += len(held[-1][1])
                if held_bytes >= 4 * group_tokens:
                    yield flush()
        if held:
            yield flush()

    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), SCHEMA)
