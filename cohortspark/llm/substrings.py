"""Removal of repeated passages with suffix arrays per shard.

A byte goes if it lies in a string of ``least`` bytes that also starts in a document of smaller id.
Texts are packed once into compressed blocks of bounded size, one row each, in a written table. Then:

1. *Which strings can repeat?* Of every ``least`` bytes in a row, the first piece of ``GRAM`` bytes with the least hash is
   the anchor; equal strings have equal anchors. A string reaches half of the rest or more to one side of
   its anchor. So a block asks, in one compressed message for each shard of anchors, of each different anchor by its hash
   and those of the bytes on its sides; the shard answers with a bit for each: whether another document has the anchor with
   the same bytes on one side. That is some six bytes an anchor, however often short pieces occur elsewhere. Of an anchor
   with more than ``SIDES`` surroundings in a block only the number is sent.
2. *Which do?* For such an anchor a block sends the bytes around it, as far as strings with this
   anchor reach, in one compressed message for each shard of anchors. The shard combines equal ones byte by
   byte. Bytes that are like no others on either side repeat nothing else and need no order. The shard joins
   what remains to one text and sorts its suffixes by Larsson-Sadakane refinement, as deep as ``least``
   bytes; common prefixes of neighbours in that order give the runs of equal strings, and each
   run its smallest id. A block meets at most ``FAN`` shards until there are ``FAN * REACH`` blocks, and
   beyond that one for every ``REACH`` blocks, so messages stay large.

An anchor met more than ``crowd`` times has no single shard. Its strings stay in their blocks, sorted;
every block sends each different one once, with its smallest id in the block, and shards by ranges of
the strings' hashes merge the blocks' lists by binary search. So no task holds more
than a block, a bounded shard, or one row per block of the same string.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, inputs, stage

by_value(__name__)

GRAM = 16
NO_ID = -(1 << 63)
# Shards that any block may meet, and the blocks for each shard beyond that.
FAN, REACH = 512, 16
# Surroundings of an anchor that a block tells apart, and the hashes of a side: unknown, or none.
SIDES, WILD, VOID = 64, 0xFFFF, 0
# Bytes whose hashes are made at once; arrays of this many stay in a processor's cache.
PIECE = 1 << 15
MESSAGE = "shard long, block long, kind int, payload binary"
ANSWER = "block long, shard long, kind int, payload binary"
CONTEXTS, STRINGS, MEMO, ASKED = 0, 1, 2, 3


def packed(*arrays: np.ndarray, level: int = 3) -> bytes:
    """Arrays as one compressed message; bytes of equal weight stand together."""
    import zstandard

    head = np.array([len(arrays)] + [x for a in arrays for x in (a.dtype.itemsize, a.size)], "<i8").tobytes()
    body = b"".join(np.ascontiguousarray(a).reshape(-1).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=level).compress(head + body)


def unpacked(message: bytes, *types) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(message)
    count = int(np.frombuffer(data, "<i8", 1)[0])
    sizes = np.frombuffer(data, "<i8", 2 * count, 8).reshape(-1, 2).tolist()
    at, out = 8 + 16 * count, []
    for (width, size), kind in zip(sizes, types):
        flat = np.frombuffer(data, np.uint8, width * size, at).reshape(width, size).T
        out.append(np.ascontiguousarray(flat).reshape(-1).view(kind))
        at += width * size
    return out


class Block:
    """Documents of a block: ids, where each begins and ends, and all bytes."""

    def __init__(self, message: bytes):
        self.ids, lengths, self.data = unpacked(message, np.int64, np.int64, np.uint8)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths

    def document_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, positions, side="right")


def rolling(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every ``length`` bytes, from hashes of powers of two."""
    out_size = len(data) - length + 1
    if out_size <= 0:
        return np.zeros(0, np.uint64)
    have, current, total, offset = 1, (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), None, 0
    current ^= current >> np.uint64(29)
    while True:
        if length & have:
            part = current[offset : offset + out_size]
            if total is None:
                total = part.copy()
            else:
                total *= np.uint64(0x94D049BB133111EB)
                total += part
                total ^= total >> np.uint64(27)
            offset += have
        if have * 2 > length:
            return total
        size = len(current) - have
        nxt = current[:size] * np.uint64(0xBF58476D1CE4E5B9)
        nxt += current[have:]
        nxt ^= nxt >> np.uint64(31)
        current, have = nxt, have * 2


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest of every ``width`` values in a row."""
    pick, span = (np.minimum if least else np.maximum), 1
    while span * 2 <= width:
        values, span = pick(values[:-span], values[span:]), span * 2
    rest = width - span
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(block: Block, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all strings of ``least`` bytes."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    margin = least - GRAM
    for begin in range(0, len(block.data), PIECE):
        low, high = max(0, begin - margin), min(len(block.data), begin + PIECE + least - 1)
        ends = block.ends[np.searchsorted(block.ends, low, side="right") : np.searchsorted(block.ends, high)]
        at, hashes = anchors_of_piece(block.data[low:high], ends - low, least)
        own = slice(*np.searchsorted(at, [begin - low, begin - low + PIECE]))
        found.append((at[own] + low, hashes[own]))
    return np.concatenate([at for at, _ in found]), np.concatenate([hashes for _, hashes in found])


def anchors_of_piece(data: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of the strings that lie in ``data``; ``ends`` are the ends of documents inside it."""
    width = least - GRAM + 1
    hashes = rolling(data, GRAM)
    if len(hashes) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes |= np.uint64(1)
    lowest = sliding(hashes, width, True)
    for end in ends.tolist():
        # Strings over the end of a document are none.
        lowest[max(0, end - least + 1) : end] = 0
    edge = np.zeros(width - 1, np.uint64)
    reached = sliding(np.concatenate([edge, lowest, edge]), width, False)
    at = np.flatnonzero(reached[: len(hashes)] >= hashes)
    return at, hashes[at]


def starts_of(block: Block, at: np.ndarray, hashes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the strings that have each of these anchors as their first piece of least hash.

    ``at`` are all anchors in order. Every string belongs to one anchor; one that has none gets a last start before the first.
    """
    span, document = least - GRAM, block.document_of(at)
    first = np.maximum(at - span, block.starts[document])
    last = np.minimum(at, block.ends[document] - least)
    for step in (-1, 1):
        open_, away = np.arange(len(at)), 0
        while len(open_):
            away += step
            open_ = open_[(open_ + away >= 0) & (open_ + away < len(at))]
            other = open_ + away
            near = np.abs(at[other] - at[open_]) <= span
            open_, other = open_[near], other[near]
            # Of equal pieces the first counts.
            beaten = hashes[other] <= hashes[open_] if step < 0 else hashes[other] < hashes[open_]
            if step < 0:
                first[open_[beaten]] = np.maximum(first[open_[beaten]], at[other[beaten]] + 1)
            else:
                last[open_[beaten]] = np.minimum(last[open_[beaten]], at[other[beaten]] - span - 1)
            open_ = open_[~beaten]
    return first, last


def side_hashes(data: np.ndarray, begin: np.ndarray, size: int, inside: np.ndarray) -> np.ndarray:
    """16 bits for the ``size`` bytes from each of ``begin``: ``VOID`` where they are not ``inside``, never ``WILD``."""
    rows = np.lib.stride_tricks.sliding_window_view(data, size)[np.clip(begin, 0, len(data) - size)]
    return np.where(inside, 1 + (row_hash(rows) >> np.uint64(48)) % np.uint64(WILD - 1), np.uint64(VOID))


def questions(block: Block, least: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors in order of what is asked of them: positions, first and last starts, and the questions.

    A question is ``bits`` bits of the anchor's hash, 16 of the bytes before it, and 16 of those behind it. Least hashes fill no range
    evenly, so they are mixed anew.
    """
    at, hashes = anchors(block, least)
    first, last = starts_of(block, at, hashes, least)
    own = np.flatnonzero(last >= first)
    at, first, last, mixed = at[own], first[own], last[own], hashes[own] * np.uint64(0xD6E8FEB86659FD93)
    if not len(at):
        return at, first, last, mixed
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    half = -(-(least - GRAM) // 2)
    left = side_hashes(block.data, at - half, half, at - half >= first)
    right = side_hashes(block.data, at + GRAM, half, at + GRAM + half <= last + least)
    asked = (mixed >> np.uint64(64 - bits) << np.uint64(32)) | (left << np.uint64(16)) | right
    by = np.argsort(asked, kind="stable")
    asked = asked[by]
    different = np.concatenate([[True], asked[1:] != asked[:-1]])
    new_key = np.flatnonzero(np.diff(asked >> np.uint64(32), prepend=np.uint64(1 << 63)))
    many = np.repeat(np.add.reduceat(different, new_key, dtype=np.int64) > SIDES, np.diff(np.append(new_key, len(asked))))
    asked[many] |= np.uint64(WILD << 16 | WILD)
    return at[by], first[by], last[by], asked


def of_several(group: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which rows are in a group whose least ``low`` is not its greatest ``high``."""
    by = np.argsort(group, kind="stable")
    sorted_group = group[by]
    begin = np.flatnonzero(np.concatenate([[True], sorted_group[1:] != sorted_group[:-1]]))
    several = np.minimum.reduceat(low[by], begin) != np.maximum.reduceat(high[by], begin)
    out = np.zeros(len(group), bool)
    out[by] = np.repeat(several, np.diff(np.append(begin, len(group))))
    return out


def on_sides(asked: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """For the bytes before and behind an anchor: a number for equal ones, and where there are any."""
    key, side = asked >> np.uint64(32) << np.uint64(16), np.uint64(WILD)
    left, right = (asked >> np.uint64(16)) & side, asked & side
    return ((key | left, left != VOID), (key | right, right != VOID))


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``size`` numbers from each of ``begin``, one range after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def refine(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Larsson-Sadakane: a rank for every position; equal ranks, equal first ``depth`` symbols.

    ``symbols`` are 0 (the end of a part) to 256. Ranks begin with seven symbols; each round
    doubles the depth, and only positions whose rank is shared are sorted again, by the rank
    ``h`` further on. A rank is the place of the last of its group in suffix order, so ranks of
    positions that are alone stay as they are.
    """
    n, have = len(symbols), min(7, depth)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(depth + 8, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(have):
        key = key * 512 + padded[i : i + n]
    del padded
    order = np.argsort(key).astype(np.int32)
    sorted_key = key[order]
    last = np.flatnonzero(np.concatenate([sorted_key[1:] != sorted_key[:-1], [True]])).astype(np.int32)
    del key, sorted_key
    sizes = np.diff(np.concatenate([[-1], last]))
    rank = np.full(n + depth + 8, -1, np.int32)
    rank[order] = np.repeat(last, sizes)
    open_ = order[np.repeat(sizes > 1, sizes)]
    while have < depth and len(open_):
        step = min(have, depth - have)
        first, second = rank[open_], rank[open_ + step]
        by = np.lexsort((second, first))
        open_, first, second = open_[by], first[by], second[by]
        new_group = np.concatenate([first[1:] != first[:-1], [True]])
        ends = np.concatenate([(first[1:] != first[:-1]) | (second[1:] != second[:-1]), [True]])
        at = np.flatnonzero(ends)
        sizes = np.diff(np.concatenate([[-1], at]))
        # The last of an old group keeps its rank; earlier ones count back from it.
        group_end = np.flatnonzero(new_group)
        behind = group_end[np.searchsorted(group_end, at)] - at
        rank[open_] = np.repeat(first[at] - behind, sizes)
        have += step
        open_ = open_[np.repeat(sizes > 1, sizes)]
    return rank[:n].astype(np.int64)


def common_prefixes(symbols: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common symbols of each position in ``order`` with the one before it, up to ``most``.

    These are Kasai's values with a cap, taken for all neighbours at once.
    """
    padded = np.concatenate([symbols, np.zeros(most + 8, symbols.dtype)])
    length = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for i in range(most):
        if not len(alive):
            break
        a, b = padded[order[alive] + i], padded[order[alive - 1] + i]
        alive = alive[(a == b) & (a != 0)]
        length[alive] += 1
    return length


def smallest_of_equal(rows: np.ndarray, docs: np.ndarray, least: int) -> np.ndarray:
    """For every start in every row of symbols the smallest id with an equal string there.

    ``rows`` hold symbols (0: none), ``docs`` the smallest id of each row; starts that have no
    ``least`` symbols keep the greatest number.
    """
    count, width = rows.shape
    starts = width - least + 1
    text = np.concatenate([rows, np.zeros((count, 1), rows.dtype)], axis=1).reshape(-1)
    rank = refine(text, least).reshape(count, width + 1)[:, :starts]
    filled = np.cumsum(np.pad(rows != 0, ((0, 0), (1, 0))), axis=1)
    valid = (filled[:, least:] - filled[:, :starts]) == least
    out = np.full((count, starts), np.iinfo(np.int64).max)
    where = np.flatnonzero(valid.reshape(-1))
    if not len(where):
        return out
    ranks = rank.reshape(-1)[where]
    by = np.argsort(ranks, kind="stable")
    place = (where // starts) * (width + 1) + where % starts
    begins = common_prefixes(text, place[by], least) < least
    begins[0] = True
    first = np.flatnonzero(begins)
    owners = docs[where // starts][by]
    lowest = np.minimum.reduceat(owners, first)
    out.reshape(-1)[where[by]] = np.repeat(lowest, np.diff(np.concatenate([first, [len(by)]])))
    return out


def as_words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes or 16-bit symbols as rows of 64-bit numbers, filled up with zeros."""
    return np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -rows.shape[1] % (8 // rows.itemsize))))).view(np.uint64)


def row_hash(rows: np.ndarray) -> np.ndarray:
    words = as_words(rows)
    out = np.zeros(len(words), np.uint64)
    for i in range(words.shape[1]):
        out = (out ^ words[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each different row, and for every row the number of its like.

    Rows are grouped by a hash and compared in full; should two of one hash differ, all are sorted.
    """
    _, chosen, inverse = np.unique(row_hash(rows), return_index=True, return_inverse=True)
    if not np.array_equal(rows[chosen][inverse], rows):
        _, chosen, inverse = np.unique(as_words(rows), axis=0, return_index=True, return_inverse=True)
    return chosen, inverse.reshape(-1)


def with_rivals(contexts: np.ndarray, least: int) -> np.ndarray:
    """Which of these different contexts may share a string of ``least`` bytes with another.

    Such a string holds the anchor and, to its left or right, at least half of the bytes besides; so
    the others are like no context in either half.
    """
    before = least - GRAM
    half = -(-before // 2)
    out = np.zeros(len(contexts), bool)
    for part in (contexts[:, before - half : before + GRAM], contexts[:, before : before + GRAM + half]):
        _, inverse, times = np.unique(row_hash(part), return_inverse=True, return_counts=True)
        out |= times[inverse] > 1
    return out


def pack_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, message, bytes): documents in rows of about ``block_bytes``."""

    def run(batches):
        number = TaskContext.get().partitionId() << 24
        ids, texts, size = [], [], 0

        def flush():
            lengths = np.array([len(t) for t in texts], np.int64)
            message = packed(np.array(ids, np.int64), lengths, np.frombuffer(b"".join(texts), np.uint8), level=9)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([message], pa.binary()), pa.array([size], pa.int64())],
                ["block", "message", "bytes"],
            )

        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1)):
                text = (value.as_py() or "").encode()
                if ids and size + len(text) > block_bytes:
                    yield flush()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(NO_ID if key.as_py() is None else key.as_py())
                texts.append(text)
                size += len(text)
        if ids:
            yield flush()

    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(run, "block long, message binary, bytes long")


def slices(values: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Where each shard's range begins in sorted values of ``bits`` bits."""
    edges = [(s << bits) // shards for s in range(1, shards)]
    return np.concatenate([[0], np.searchsorted(values, np.array(edges, values.dtype)), [len(values)]]).astype(np.int64)


def shard_count(blocks: int) -> int:
    """Shards of anchors: as many as blocks, but so few that a block's messages stay large."""
    return max(1, min(blocks, max(FAN, blocks // REACH)))


def asking_count(blocks: int) -> int:
    """Shards of questions: each takes those of ``REACH`` blocks, or fewer."""
    return max(1, min(blocks, 64), blocks // REACH)


def table_of(rows, names) -> pa.Table:
    columns = list(zip(*rows)) or [()] * 4
    types = [pa.binary() if n == "payload" else pa.int32() if n == "kind" else pa.int64() for n in names]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)


OUT, BACK = ["shard", "block", "kind", "payload"], ["block", "shard", "kind", "payload"]


def remove_repeats(
    docs: DataFrame,
    least: int = 50,
    block_bytes: int = 1 << 21,
    crowd: int = 1 << 14,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; ``kept`` are the bytes left.

    Strings are judged on the input, never over the end of a document. Null texts are empty. A
    null id is one id below all others; rows of one id never remove each other's bytes.
    An empty table gives no rows. ``least`` is more than the anchor's 16 bytes.
    """
    blocks = stage(pack_blocks(inputs(docs, "documents", doc_id=doc_id, text=text), block_bytes))
    total, count = blocks.agg(F.sum("bytes"), F.count("*")).first()
    # As many hashes as there may be anchors; those that share one are told apart by their sides, or cost a look.
    bits = min(32, max(16, int(total or 0).bit_length() - 3))
    shards, asking = shard_count(count), asking_count(count)
    before, width = least - GRAM, 2 * least - GRAM

    def ask(batches):
        for batch in batches:
            for number, message in zip(batch.column(0), batch.column(1)):
                block = Block(message.as_py())
                at, _, _, asked = questions(block, least, bits)
                if not len(asked):
                    continue
                owner = block.ids[block.document_of(at)]
                several = [of_several(group, owner, owner) & real for group, real in on_sides(asked)]
                begin = np.flatnonzero(np.concatenate([[True], asked[1:] != asked[:-1]]))
                times = np.diff(np.append(begin, len(asked))).astype(np.uint32)
                flags = (several[0][begin] + 2 * several[1][begin]).astype(np.uint8)
                asked, rows = asked[begin], []
                cut = slices(asked >> np.uint64(32), bits, asking)
                for s in np.flatnonzero(np.diff(cut)).tolist():
                    part = slice(cut[s], cut[s + 1])
                    rows.append((s, number.as_py(), ASKED, packed(np.diff(asked[part], prepend=np.uint64(0)), times[part], flags[part])))
                yield from table_of(rows, OUT).to_batches()

    def answer(table):
        """For each question a bit whether another document may have the string, and one whether the anchor is crowded."""
        messages, numbers, shard = table.column("payload"), table.column("block").to_pylist(), table.column("shard")[0].as_py()
        parts = [unpacked(m.as_py(), np.uint64, np.uint32, np.uint8) for m in messages]
        asked = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        flags = np.concatenate([p[2] for p in parts])
        sizes = np.array([len(p[0]) for p in parts])
        sender = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
        keys, inverse = np.unique(asked >> np.uint64(32), return_inverse=True)
        times = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(keys))
        wild = np.zeros(len(keys), bool)
        wild[inverse[asked & np.uint64(WILD << 16 | WILD) == WILD << 16 | WILD]] = True
        several = wild[inverse]
        for bit, (group, real) in zip((1, 2), on_sides(asked)):
            several |= of_several(group, np.where(flags & bit, np.int32(-1), sender), sender) & real
        crowded = (times > crowd)[inverse]
        rows, end = [], np.cumsum(sizes)
        for number, low, high in zip(numbers, (end - sizes).tolist(), end.tolist()):
            rows.append((number, shard, ASKED, packed(np.packbits(several[low:high]), np.packbits(crowded[low:high]))))
        return table_of(rows, BACK)

    def send(own, answers):
        if not own.num_rows or not answers.num_rows:
            return table_of([], OUT)
        number, block = own.column("block")[0].as_py(), Block(own.column("message")[0].as_py())
        at, first, last, asked = questions(block, least, bits)
        new = np.concatenate([[True], asked[1:] != asked[:-1]])
        cut = slices(asked[new] >> np.uint64(32), bits, asking)
        verdicts = np.zeros((2, cut[-1]), bool)
        for s, message in zip(answers.column("shard").to_pylist(), answers.column("payload").to_pylist()):
            for verdict, told in zip(verdicts, unpacked(message, np.uint8, np.uint8)):
                verdict[cut[s] : cut[s + 1]] = np.unpackbits(told, count=cut[s + 1] - cut[s])
        several, crowded = verdicts[:, np.cumsum(new) - 1]
        rows = []
        near = np.flatnonzero(several & ~crowded)
        if len(near):
            cut = slices(asked[near] >> np.uint64(32), bits, shards)
            near = near[np.lexsort((at[near], np.repeat(np.arange(shards), np.diff(cut))))]
            place, begin, size = at[near], first[near], last[near] + least - first[near]
            lead, ids = (begin - place + before).astype(np.uint16), block.ids[block.document_of(place)]
            for s in np.flatnonzero(np.diff(cut)).tolist():
                part = slice(cut[s], cut[s + 1])
                around = block.data[ranges(begin[part], size[part])]
                rows.append((s, number, CONTEXTS, packed(
                    around, lead[part], size[part].astype(np.uint16), np.diff(ids[part], prepend=0), np.diff(place[part], prepend=0).astype(np.uint32)
                )))
        near = np.flatnonzero(several & crowded)
        if len(near):
            begin = np.sort(first[near])
            size = (last - first + 1)[near][np.argsort(first[near])]
            strings, lowest, _ = crowded_strings(block, begin, size)
            cut = slices(strings, 64, shards)
            for s in np.flatnonzero(np.diff(cut)).tolist():
                part = slice(cut[s], cut[s + 1])
                rows.append((s, number, STRINGS, packed(np.diff(strings[part], prepend=np.uint64(0)), lowest[part])))
            # The block's own note comes back with the answers.
            rows.append((number % shards, number, MEMO, packed(np.diff(begin, prepend=0), size)))
        return table_of(rows, OUT)

    def crowded_strings(block, begin, size):
        """Sorted hashes of the strings that start in these ranges, their smallest ids, and (string, start)."""
        starts = ranges(begin, size)
        hashes = rolling(block.data, least)[starts]
        strings, inverse = np.unique(hashes, return_inverse=True)
        lowest = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(lowest, inverse, block.ids[block.document_of(starts)])
        return strings, lowest, (inverse, starts)

    def judge(table):
        kinds = np.array(table.column("kind").to_pylist())
        messages, numbers, shard = table.column("payload"), table.column("block"), table.column("shard")[0].as_py()
        rows = [(numbers[i].as_py(), shard, MEMO, messages[i].as_py()) for i in np.flatnonzero(kinds == MEMO).tolist()]
        own = np.flatnonzero(kinds == CONTEXTS).tolist()
        if own:
            parts = [unpacked(messages[i].as_py(), np.uint8, np.uint16, np.uint16, np.int64, np.uint32) for i in own]
            ends = np.cumsum([len(p[3]) for p in parts])
            contexts = np.zeros((ends[-1], width), np.uint16)
            for end, (around, lead, size, *_) in zip(ends, parts):
                filled = ranges((end - len(size) + np.arange(len(size))) * width + lead, size.astype(np.int64))
                contexts.reshape(-1)[filled] = around + np.uint16(1)
            ids, places = (np.concatenate([np.cumsum(p[n], dtype=np.int64) for p in parts]) for n in (3, 4))
            chosen, inverse = distinct_rows(contexts)
            lowest = np.full(len(chosen), np.iinfo(np.int64).max)
            np.minimum.at(lowest, inverse, ids)
            texts = contexts[chosen]
            filled = np.cumsum(np.pad(texts != 0, ((0, 0), (1, 0))), axis=1, dtype=np.int16)
            whole_string = filled[:, least:] - filled[:, : width - least + 1] == least
            smallest = np.where(whole_string, lowest[:, None], np.iinfo(np.int64).max)
            rivals = np.flatnonzero(with_rivals(texts, least))
            if len(rivals):
                smallest[rivals] = smallest_of_equal(texts[rivals], lowest[rivals], least)
            least_id = smallest.min(axis=1)
            for i, end, p in zip(own, ends, parts):
                mine = slice(end - len(p[3]), end)
                hit = np.flatnonzero(least_id[inverse[mine]] < ids[mine])
                if len(hit):
                    gone = smallest[inverse[mine][hit]] < ids[mine][hit][:, None]
                    place = places[mine][hit] - before
                    begin = place + gone.argmax(axis=1)
                    end_ = place + gone.shape[1] - 1 - gone[:, ::-1].argmax(axis=1) + least
                    by = np.argsort(begin, kind="stable")
                    rows.append((numbers[i].as_py(), shard, CONTEXTS, packed(np.diff(begin[by], prepend=0), (end_ - begin)[by].astype(np.uint16))))
        own = np.flatnonzero(kinds == STRINGS).tolist()
        if own:
            lists = []
            for i in own:
                gaps, lowest = unpacked(messages[i].as_py(), np.uint64, np.int64)
                lists.append((np.cumsum(gaps), lowest))
            # Each list is merged into the union by binary search.
            union = np.unique(np.concatenate([strings for strings, _ in lists]))
            best = np.full(len(union), np.iinfo(np.int64).max)
            found = [np.searchsorted(union, strings) for strings, _ in lists]
            for where, (_, lowest) in zip(found, lists):
                best[where] = np.minimum(best[where], lowest)
            for i, where in zip(own, found):
                rows.append((numbers[i].as_py(), shard, STRINGS, packed(best[where])))
        return table_of(rows, BACK)

    def finish(own, answers):
        if not own.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "n_spans": pa.array([], pa.int64()), "kept": pa.array([], pa.binary())})
        block = Block(own.column("message")[0].as_py())
        change = np.zeros(len(block.data) + 1, np.int32)
        kinds = answers.column("kind").to_pylist() if answers.num_rows else []
        shards_, messages = (answers.column("shard").to_pylist(), answers.column("payload").to_pylist()) if kinds else ([], [])
        best, memo = [], None
        for s, kind, message in sorted(zip(shards_, kinds, messages)):
            if kind == CONTEXTS:
                gaps, lengths = unpacked(message, np.int64, np.uint16)
                begin = np.cumsum(gaps)
                np.add.at(change, begin, 1)
                np.add.at(change, begin + lengths.astype(np.int64), -1)
            elif kind == STRINGS:
                best.append(unpacked(message, np.int64)[0])
            else:
                memo = unpacked(message, np.int64, np.int64)
        if memo is not None:
            _, _, (inverse, starts) = crowded_strings(block, np.cumsum(memo[0]), memo[1])
            gone = starts[np.concatenate(best)[inverse] < block.ids[block.document_of(starts)]]
            np.add.at(change, gone, 1)
            np.add.at(change, gone + least, -1)
        covered = np.cumsum(change[:-1]) > 0
        rows = []
        for key, start, end in zip(block.ids.tolist(), block.starts.tolist(), block.ends.tolist()):
            mask, data = covered[start:end], block.data[start:end]
            removed = int(mask.sum())
            spans = int((np.diff(mask.astype(np.int8), prepend=0) == 1).sum()) if removed else 0
            kept = data[~mask].tobytes() if removed else data.tobytes()
            rows.append((None if key == NO_ID else key, end - start, removed, spans, kept))
        columns = zip(*rows)
        types = (pa.int64(),) * 4 + (pa.binary(),)
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    whole = blocks.select("block", "message")
    answers = whole.mapInArrow(ask, MESSAGE).groupBy("shard").applyInArrow(answer, ANSWER)
    sent = whole.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(send, MESSAGE)
    judged = sent.groupBy("shard").applyInArrow(judge, ANSWER)
    return (
        whole.groupBy("block").cogroup(judged.groupBy("block"))
        .applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    )

