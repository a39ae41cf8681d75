"""Token-ID files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

Tokenizing: distinct words of a task go through the tokenizers library once. A word is a run without ASCII white space, cut
where one of .,;:!? follows an ASCII letter or digit; no pre-token of the library reaches over these borders, so
a text's ids are its words' ids in order. END is appended to every document.

Coding: every id is coded by the range coder, from predictions of three orders. A segment's ids are numbered by falling frequency.
  order 2   the id that last followed the two ids before (hashed slots with a confidence);
  order 1   the ids that follow the id before at least LEAST_COUNT times in the segment, by how often they do;
  order 0   all ids, by how often no pair of order 1 foretells them.
Order 2's share is mixed, by an adaptive weight, from the adaptive hit rates of its candidates by confidence and by order-0 frequency;
order 1's share of what is left from the part of an id's successors that the segment knows and an adaptive hit rate by how often
it knows them. What both leave is shared out by order 0. Rates, weights and slots adapt within a block. All is integer arithmetic (divisions
in double precision are exact here), so any machine decodes alike. A block starts from the segment's starting state (counts and
pairs), with its own coder, and the blocks of a segment advance together as lanes of numpy arrays.

Format: a segment is one binary value, whole documents in ascending doc_id order:
  "QTB3", then little-endian uint64 documents, ids, blocks, ids of a block, END; zlib parts, each behind its uint64 length and
  its uint32 crc32: int64 doc_ids, uint8 null flags, int64 ids per document, and the starting state, as uint32 in planes of bytes: ids by
  falling frequency, order-0 counts, numbers of successors, successors as steps from the one before, counts of the pairs; per
  block uint32 bytes, crc32 of the bytes, crc32 of the ids; the blocks' bytes: the coder's 16-bit words.
Segments lie in Parquet with (shard, segment) as their order. A reader checks all checksums.

Cases: null and empty texts are END alone. Null ids come first. Rows that repeat an id follow each other in order of their text.
A document may be longer than a segment's aim; it is never cut. An empty table writes no segment and gives no rows. Ids may have
32 bits; a segment of more than MOST_IDS distinct ids raises ValueError. Other columns take no part.
"""

from __future__ import annotations

import functools
import json
import math
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm import bytewise as bw
from quernel.llm.pieces import Remembered, ragged
from quernel.session import Scratch

END = 1
SEGMENT = 1 << 23
#: Ids of a block: a power of two that makes about LANES blocks, within these limits.
BLOCKS, LANES = (1024, 4096), 4096
#: Hashed slots of order 2 in a block, the least count of a pair of ids that order 1 knows, and the most successors of an id.
SLOTS, LEAST_COUNT = 1024, 4
#: Slots of order 2 that are held at once; more blocks are coded in turns.
CELLS = 1 << 22
#: The coder's intervals are parts of 1 << WHOLE; the orders share 1 << PARTS of them, order 1 has 1 << ROW and order 0 1 << SCALE.
WHOLE, PARTS, ROW, SCALE = 24, 10, 14, 18
#: A number is packed with its frequency class in a tag, a tag with a confidence in a slot, a pair's width with its begin in a spot.
NUMBER, TAG, WIDTH = (1 << 18) - 1, (1 << 24) - 1, (1 << 16) - 1
LOW, HIGH2, HIGH = np.int32(64), np.int32(63488), np.int32(65472)
MOST_IDS = 1 << (SCALE - 1)
MOST_NEXT = 1 << (ROW - 1)
#: Pairs of so few ids are found in a table, others by a search.
DENSE = 1 << 25
TIGHT = 1 << 32
MAGIC = b"QTB3"
#: Joins distinct words for the library; a special token, whose id then marks the borders.
GLUE = "<|startoftext|>"


def shared_out(counts: np.ndarray, first: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, width) of entries in their row's 1 << scale, by counts but one at least; first: each entry's row's first entry."""
    ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    rows = np.append(np.flatnonzero(first == np.arange(len(first))), len(first))
    sizes = np.diff(rows)
    total, extra = np.repeat(ends[rows[1:]] - ends[rows[:-1]], sizes), np.repeat((1 << scale) - sizes, sizes)
    place = np.arange(len(first)) - first
    begin, end = ((n + (ends[at] - ends[first]) * extra // np.maximum(total, 1)) for n, at in ((place, first + place), (place + 1, first + place + 1)))
    return begin.astype(np.int32), (end - begin).astype(np.int32)


class Start:
    """A segment's starting state: ids by falling frequency, counts for order 0, and the pairs of order 1.

    `ahead` has a column for each pair, by id and successor: id * distinct ids + successor, and how often it was seen.
    `counts` are of ids that no pair foretells.
    """

    def __init__(self, symbols: np.ndarray, counts: np.ndarray, ahead: np.ndarray):
        if len(symbols) > MOST_IDS:
            raise ValueError(f"more than {MOST_IDS} distinct ids in a segment")
        self.symbols, self.counts, self.d = symbols, counts.astype(np.int64), len(symbols)
        self.pairs, seen = ahead.astype(np.int64)
        self.ahead = np.concatenate([ahead, np.full((2, 1), -1)], axis=1).astype(np.int64)  # a block's first id has no pair
        self.begin0, self.width0 = shared_out(self.counts, np.zeros(self.d, np.int64), SCALE)
        row, none = self.pairs // self.d, np.int32(self.d)
        self.tags = np.arange(self.d + 1, dtype=np.int32)
        self.tags |= np.append(np.minimum(np.log2(self.tags[:-1] + 1.0).astype(np.int32), 15), np.int32(16)) << 18
        self.next = self.tags.take(np.append(self.pairs % self.d, none))
        begin, width = shared_out(seen, np.searchsorted(row, row, "left"), ROW)
        self.ends = np.append(begin + width, np.int32(1 << ROW))
        self.spots = np.append(begin << 16 | width, np.int32(1 << ROW + 16))  # last: what no pair foretells
        known = np.bincount(row, seen, self.d).astype(np.int64)
        missed = self.counts * known.sum() // max(1, int(self.counts.sum()))
        mass = np.append(np.clip(65535 * known // (known + missed // 8 + 1), LOW, HIGH), LOW)
        level = np.append(np.minimum(np.log2(known + 1.0).astype(np.int32), 15), 0)
        self.mass = (mass << 4 | level).astype(np.int32)
        self.guide(row, begin)

    def guide(self, row: np.ndarray, begin: np.ndarray) -> None:
        """For each id 1, 2, 4... cells, two for a pair at least, that name the pair at their begin."""
        size = np.bincount(row, minlength=self.d + 1)
        bits = np.minimum(np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64) + 1, ROW)
        cells = np.where(size > 0, 1 << bits, 1)
        self.shift = np.where(size > 0, ROW - bits, ROW).astype(np.int32)
        self.cell = np.cumsum(cells) - cells
        owner = np.repeat(np.arange(self.d + 1), cells)
        at = (owner << ROW) + (np.arange(len(owner)) - self.cell[owner] << self.shift[owner].astype(np.int64))
        self.cells = np.searchsorted((row << ROW) + begin, at, "right") - 1

    def pair_at(self, x1: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """The pairs of the ids x1 that hold these parts of 1 << ROW."""
        pair = self.cells.take(self.cell.take(x1) + (inside >> self.shift.take(x1)))
        more = np.flatnonzero(self.ends.take(pair) <= inside)
        while len(more):
            pair[more] = at = pair.take(more) + 1
            more = more[self.ends.take(at) <= inside.take(more)]
        return pair

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[Start, np.ndarray]:
        """(the state, the ids' numbers)."""
        if len(ids) and int(ids.max()) < DENSE:
            all_counts = np.bincount(ids)
            found = np.flatnonzero(all_counts)
            counts, place = all_counts[found], np.zeros(len(all_counts), np.int32)
            place[found] = np.arange(len(found))
            back = place[ids]
        else:
            found, back, counts = np.unique(ids, return_inverse=True, return_counts=True)
        if len(found) > MOST_IDS:
            raise ValueError(f"more than {MOST_IDS} distinct ids in a segment")
        order = np.argsort(-counts, kind="stable")
        number = np.empty(len(found), np.int32)
        number[order] = np.arange(len(found))
        x, d = number[back], len(found)
        if d * d <= DENSE:
            both = x[:-1] * np.int32(d) + x[1:]
            table = np.bincount(both, minlength=1)
            pair = np.flatnonzero(table >= LEAST_COUNT)
            seen = table[pair]
        else:
            pair, seen = np.unique(x[:-1].astype(np.int64) * d + x[1:], return_counts=True)
            pair, seen = pair[seen >= LEAST_COUNT], seen[seen >= LEAST_COUNT]
        row = pair // d
        by = np.lexsort((pair, -seen, row))
        keep = np.sort(by[np.arange(len(pair)) - np.searchsorted(row, row, "left") < MOST_NEXT])
        pair, seen = pair[keep], seen[keep]
        foretold = np.bincount(pair % d, seen, d).astype(np.int64)
        return cls(found[order], counts[order] - foretold, np.stack([pair, seen])), x

    @classmethod
    def from_parts(cls, symbols: np.ndarray, counts: np.ndarray, sizes: np.ndarray, steps: np.ndarray, seen: np.ndarray) -> Start:
        d, at = len(symbols), np.cumsum(sizes) - sizes
        steps = steps.astype(np.int64)
        ends = np.cumsum(steps)
        before = np.concatenate([[0], ends])[at]
        row = np.repeat(np.arange(d), sizes)
        return cls(symbols, counts, np.stack([row * d + ends - before[row], seen.astype(np.int64)]))

    def parts(self) -> list[np.ndarray]:
        row = self.pairs // self.d
        after = self.pairs % self.d
        steps = np.diff(after, prepend=0)
        fresh = np.diff(row, prepend=-1) > 0
        steps[fresh] = after[fresh]
        return [self.symbols, self.counts, np.bincount(row, minlength=self.d), steps, self.ahead[1, :-1]]

    def spots_of(self, x1: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The spots of pairs; the last one if order 1 does not know them."""
        d, none = self.d, self.spots[-1]
        if (d + 1) * d <= DENSE:
            table = np.full((d + 1) * d, none, np.int32)
            table[self.pairs] = self.spots[:-1]
            return table[x1 * np.int32(d) + x]
        both = x1.astype(np.int64) * d + x
        at = np.searchsorted(self.pairs, both)
        return np.where(np.append(self.pairs, -1)[at] == both, self.spots[at], none)


class Model:
    """Shares of the orders for all lanes, in flat tables; every method works on the first n lanes.

    Of 1 << PARTS parts, the candidate of order 2 has `a` and order 1 has `b`; order 0 has the rest. A slot of order 2 packs an
    id with a confidence from 1 to 8; an empty one holds no id, at 0. Rates stay between LOW and HIGH, so that no share is empty.
    """

    def __init__(self, lanes: int, start: Start):
        self.start, self.lanes = start, np.int32(lanes)
        self.lane = lane = np.arange(lanes)
        self.slot = lane * SLOTS
        self.next2 = np.full(lanes * SLOTS, start.tags[-1], np.int32)
        self.rate = np.repeat(np.array([LOW, 6000, 14000, 24000, 32000, 40000, 46000, 52000, 56000], np.int32), lanes)
        self.rate0, self.rate1 = (np.full(17 * lanes, r, np.int32) for r in (10000, 60000))
        self.rate0[16 * lanes :] = self.rate1[:lanes] = LOW  # no id, and ids without successors
        self.weight, self.weight1 = np.full(lanes, 49152, np.int32), np.full(lanes, 32768, np.int32)
        self.x1, self.x2 = (np.full(lanes, start.tags[-1], np.int32) for _ in range(2))

    def predict(self, n: int) -> None:
        x1, lane, start = self.x1[:n], self.lane[:n], self.start
        self.at = ((x1 * np.int32(31153) ^ self.x2[:n] * np.int32(58789)) >> 4 & SLOTS - 1) + self.slot[:n]
        packed = self.next2.take(self.at)
        self.c, self.k = c, k = packed & TAG, packed >> 24
        self.i, self.i0 = k * self.lanes + lane, (c >> 18) * self.lanes + lane
        self.q, self.q0 = q, q0 = self.rate.take(self.i), self.rate0.take(self.i0)
        share = q0 + ((self.weight[:n] >> 2) * (q - q0 >> 2) >> 12)
        self.a = np.maximum(share >> 6, 1)
        packed = start.mass.take(x1 & NUMBER)
        self.m, self.i1 = m, i1 = packed >> 4, (packed & 15) * self.lanes + lane
        self.q1 = q1 = self.rate1.take(i1)
        share = m + ((self.weight1[:n] >> 2) * (q1 - m >> 2) >> 12)
        self.b = np.maximum(((1 << PARTS) - self.a) * (share >> 6) >> PARTS, 1)

    def interval(self, hit: np.ndarray, spot: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, width) of the candidate where it hits, of all that order 0 shares out in lanes `rest`, else of the spots."""
        first = self.a << ROW
        width = np.where(hit, first, (spot & WIDTH) * self.b)
        width[rest] = (1 << PARTS) - self.a[rest] - self.b[rest] << ROW
        return (first + (spot >> 16) * self.b) * ~hit, width

    def found(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tags, hits of the candidate, spots, lanes of order 0, whose tags are still to be found) by values in the intervals."""
        a, b, start = self.a, self.b, self.start
        part = value >> ROW
        hit, rest = part < a, np.flatnonzero(part >= a + b)
        inside = ((value - (a << ROW)) / b).astype(np.int32)  # exact: numbers under 1 << 24
        np.minimum(np.maximum(inside, 0, out=inside), (1 << ROW) - 1, out=inside)
        pair = start.pair_at(self.x1[: len(a)] & NUMBER, inside)
        pair[rest] = len(start.pairs)
        return np.where(hit, self.c, start.next.take(pair)), hit, start.spots.take(pair), rest

    def update(self, x: np.ndarray, hit: np.ndarray, rest: np.ndarray) -> None:
        n, k, q, q0, q1 = len(x), self.k, self.q, self.q0, self.q1
        goal = hit * (HIGH2 - LOW) + LOW
        off, off0 = goal - q, goal - q0
        self.rate[self.i] = q + (off >> 5)
        self.rate0[self.i0] = q0 + (off0 >> 6)
        weight = self.weight[:n]
        weight += np.abs(off0) - np.abs(off) >> 6
        np.minimum(np.maximum(weight, 8192, out=weight), 61440, out=weight)
        k += 1
        self.next2[self.at] = np.where(k > 2, self.c, x) | np.where(hit, np.minimum(k, 8), np.maximum(k >> 1, 1)) << 24
        goal = np.full(n, HIGH, np.int32)
        goal[rest] = LOW
        off, off0 = goal - q1, goal - self.m
        self.rate1[self.i1] = q1 + (off >> 5)
        weight = self.weight1[:n]
        weight += np.abs(off0) - np.abs(off) >> 6
        np.minimum(np.maximum(weight, 8192, out=weight), 61440, out=weight)
        self.x2[:n] = self.x1[:n]
        self.x1[:n] = x


class Writer:
    """48-bit range coders, one for each lane, that write 16-bit words; carries are added at the end."""

    def __init__(self, lanes: int, room: int):
        self.lanes, self.low, self.range = lanes, np.zeros(lanes, np.int64), np.full(lanes, (1 << 48) - 1, np.int64)
        self.out, self.at = np.zeros(lanes * room, np.uint32), np.arange(lanes)

    def narrow(self, n: int, start: np.ndarray, width: np.ndarray) -> None:
        """The first n lanes go on to [start, start + width) of 1 << WHOLE."""
        unit = self.range[:n] >> WHOLE
        self.low[:n] += unit * start
        np.multiply(unit, width, out=self.range[:n])
        self.renew(np.flatnonzero(self.range[:n] < TIGHT))

    def narrow_some(self, lanes: np.ndarray, start: np.ndarray, width: np.ndarray) -> None:
        """The given lanes go on to [start, start + width) of 1 << SCALE."""
        unit = self.range[lanes] >> SCALE
        self.low[lanes] += unit * start
        size = self.range[lanes] = unit * width
        self.renew(lanes[size < TIGHT])

    def renew(self, lanes: np.ndarray) -> None:
        while len(lanes):
            low, at = self.low.take(lanes), self.at.take(lanes)
            self.out[at] = low >> 32
            self.at[lanes] = at + self.lanes
            self.low[lanes] = (low & TIGHT - 1) << 16
            size = self.range[lanes] = self.range.take(lanes) << 16
            lanes = lanes[size < TIGHT]

    def finish(self) -> list[bytes]:
        """One more word, such that any words may follow."""
        self.out[self.at] = (self.low + TIGHT - 1) >> 32
        words = self.at // self.lanes + 1
        table = self.out.reshape(-1, self.lanes)[: int(words.max())]
        for j in range(len(table) - 1, 0, -1):
            table[j - 1] += table[j] >> 16
        rows = np.ascontiguousarray(table.T.astype("<u2"))
        return [rows[k, :n].tobytes() for k, n in enumerate(words.tolist())]


class Reader:
    def __init__(self, blocks: list[bytes]):
        self.lanes = lanes = len(blocks)
        words = np.zeros((lanes, max(len(b) for b in blocks) // 2 + 8), "<u2")
        for k, b in enumerate(blocks):
            words[k, : len(b) // 2] = np.frombuffer(b, "<u2")
        self.words = np.ascontiguousarray(words.T).astype(np.uint16).reshape(-1)
        first = self.words[: 3 * lanes].reshape(3, lanes).astype(np.int64)
        self.code, self.range = first[0] << 32 | first[1] << 16 | first[2], np.full(lanes, (1 << 48) - 1, np.int64)
        self.at = np.arange(lanes) + 3 * lanes

    def value(self, n: int) -> np.ndarray:
        self.unit = self.range[:n] >> WHOLE
        return np.minimum((self.code[:n] / self.unit).astype(np.int32), (1 << WHOLE) - 1)  # exact: a part of a unit is over 2 ** -53 of it

    def value_some(self, lanes: np.ndarray) -> np.ndarray:
        return np.minimum(self.code[lanes] // (self.range[lanes] >> SCALE), (1 << SCALE) - 1)

    def narrow(self, n: int, start: np.ndarray, width: np.ndarray) -> None:
        self.code[:n] -= self.unit * start
        np.multiply(self.unit, width, out=self.range[:n])
        self.renew(np.flatnonzero(self.range[:n] < TIGHT))

    def narrow_some(self, lanes: np.ndarray, start: np.ndarray, width: np.ndarray) -> None:
        unit = self.range[lanes] >> SCALE
        self.code[lanes] -= unit * start
        size = self.range[lanes] = unit * width
        self.renew(lanes[size < TIGHT])

    def renew(self, lanes: np.ndarray) -> None:
        while len(lanes):
            at = self.at.take(lanes)
            self.code[lanes] = self.code.take(lanes) << 16 | self.words.take(at)
            self.at[lanes] = at + self.lanes
            size = self.range[lanes] = self.range.take(lanes) << 16
            lanes = lanes[size < TIGHT]


def block_size(n_ids: int) -> int:
    return int(np.clip(1 << round(math.log2(max(1, n_ids / LANES))), *BLOCKS))


def turns(lanes: int) -> Iterator[tuple[int, int]]:
    """Blocks that are coded together."""
    step = max(1, CELLS // SLOTS)
    for first in range(0, lanes, step):
        yield first, min(first + step, lanes)


def encode_blocks(x: np.ndarray, start: Start, block: int) -> list[bytes]:
    """The bytes of the blocks of a segment's numbers."""
    lanes, out = -(-len(x) // block), []
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[::block] = start.d
    spots = start.spots_of(before, x)
    del before
    for first, last in turns(lanes):
        size, n_lanes = min(len(x), last * block) - first * block, last - first
        tags, at = (np.zeros(n_lanes * block, np.int32) for _ in range(2))
        tags[:size], at[:size] = start.tags.take(x[first * block : first * block + size]), spots[first * block : first * block + size]
        tags, at = (np.ascontiguousarray(p.reshape(n_lanes, block).T) for p in (tags, at))
        model, coder = Model(n_lanes, start), Writer(n_lanes, 3 * block + 16)
        for t in range(min(block, size)):
            n = n_lanes if (n_lanes - 1) * block + t < size else n_lanes - 1
            now, spot = tags[t, :n], at[t, :n]
            model.predict(n)
            hit = model.c == now
            rest = np.flatnonzero((spot == start.spots[-1]) & ~hit)
            coder.narrow(n, *model.interval(hit, spot, rest))
            if len(rest):
                some = now.take(rest) & NUMBER
                coder.narrow_some(rest, start.begin0.take(some), start.width0.take(some))
            model.update(now, hit, rest)
        out += coder.finish()
    return out


def decode_blocks(blocks: list[bytes], n_ids: int, start: Start, block: int) -> np.ndarray:
    """The numbers of a segment."""
    out = [np.zeros(0, np.int32)]
    for first, last in turns(len(blocks)):
        n_lanes, size = last - first, min(n_ids, last * block) - first * block
        columns = np.zeros((block, n_lanes), np.int32)
        model, coder = Model(n_lanes, start), Reader(blocks[first:last])
        for t in range(min(block, size)):
            n = n_lanes if (n_lanes - 1) * block + t < size else n_lanes - 1
            model.predict(n)
            x, hit, spot, rest = model.found(coder.value(n))
            coder.narrow(n, *model.interval(hit, spot, rest))
            if len(rest):
                some = start.begin0.searchsorted(coder.value_some(rest), "right") - 1
                x[rest] = start.tags.take(some)
                coder.narrow_some(rest, start.begin0.take(some), start.width0.take(some))
            model.update(x, hit, rest)
            columns[t, :n] = x
        columns &= NUMBER
        out.append(np.ascontiguousarray(columns.T).reshape(-1)[:size])
    return np.concatenate(out)


def planes(x: np.ndarray) -> np.ndarray:
    """Bytes of 32-bit numbers, all lowest ones first: they compress better so."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def segment_bytes(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment of whole documents."""
    start, x = Start.of(ids)
    block = block_size(len(ids))
    blocks = encode_blocks(x, start, block)
    head = [np.array([0 if d is None else d for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], np.uint8), sizes.astype("<i8"), *(planes(p) for p in start.parts())]
    out = [MAGIC, struct.pack("<5Q", len(doc_ids), len(ids), len(blocks), block, END)]
    for part in head:
        body = zlib.compress(part.tobytes(), 6)
        out += [struct.pack("<QI", len(body), zlib.crc32(body)), body]
    raw = ids.astype("<u4")
    table = [(len(b), zlib.crc32(b), zlib.crc32(raw[k * block : (k + 1) * block].tobytes())) for k, b in enumerate(blocks)]
    return b"".join([*out, np.array(table, "<u4").tobytes(), *blocks])


def read_segment(body: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, ids per document, all ids), checked against the checksums."""
    if body[:4] != MAGIC:
        raise ValueError("not a token segment")
    n_docs, n_ids, n_blocks, block, _ = struct.unpack_from("<5Q", body, 4)
    at, head = 44, []
    for kind in ("<i8", np.uint8, "<i8", *[None] * 5):
        size, crc = struct.unpack_from("<QI", body, at)
        part = body[at + 12 : at + 12 + size]
        if zlib.crc32(part) != crc:
            raise ValueError("the head of the segment is damaged")
        raw = zlib.decompress(part)
        head.append(from_planes(raw) if kind is None else np.frombuffer(raw, kind))
        at += 12 + size
    table = np.frombuffer(body, "<u4", 3 * n_blocks, at).reshape(-1, 3)
    at += 12 * n_blocks
    ends = at + np.cumsum(table[:, 0].astype(np.int64))
    blocks = [body[e - int(s) : e] for e, s in zip(ends.tolist(), table[:, 0], strict=True)]
    for k, b in enumerate(blocks):
        if zlib.crc32(b) != table[k, 1]:
            raise ValueError(f"block {k} is damaged")
    start = Start.from_parts(*head[3:])
    x = decode_blocks(blocks, n_ids, start, block)
    ids = start.symbols[x].astype(np.int64)
    raw = ids.astype("<u4")
    for k in range(n_blocks):
        if zlib.crc32(raw[k * block : (k + 1) * block].tobytes()) != table[k, 2]:
            raise ValueError(f"block {k} decodes wrongly")
    if len(head[0]) != n_docs or int(head[2].sum()) != n_ids:
        raise ValueError("the document table does not fit the ids")
    return [None if gone else int(d) for d, gone in zip(head[0], head[1], strict=True)], head[2].astype(np.int64), ids


#: Bits of a byte: 1 outside white space, 2 an ASCII letter or digit, 4 a stop.
KIND = np.where(bw.IS_SPACE, 0, 1).astype(np.uint8)
KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] |= 2
KIND[list(b".,;:!?")] |= 4
#: What the short way of `WordIds` takes for granted, and which words go it.
SHORT = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    "model": {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>"},
}
SMALL, TRAIL = np.zeros(256, bool), np.zeros(256, bool)
SMALL[97:123], TRAIL[0x9F:0xC0], TRAIL[0xB7] = True, True, False  # a to z; after 0xC3: from sharp s to y with diaeresis, no division sign


def of_letters(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Which words hold nothing but small letters of a to z and U+00DF to U+00FF."""
    good = SMALL[data]
    pair = np.flatnonzero((data[:-1] == 0xC3) & TRAIL[data[1:]])
    good[pair] = good[pair + 1] = True
    bad = np.concatenate([[0], np.cumsum(~good)])
    return bad[borders[1:]] == bad[borders[:-1]]


def units_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(words, each document's first), cut between an ASCII letter or digit and a stop."""
    kind = KIND.take(data)
    solid = (kind & 1).view(bool)
    opens = solid.copy()
    opens[1:] &= ~solid[:-1] | (kind[:-1] << 1 & kind[1:] & 4).astype(bool)
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    opens[inner] = solid[inner]
    first = np.searchsorted(np.flatnonzero(opens), offsets)
    text = data[solid]
    ends = np.append(np.flatnonzero(opens[solid]), len(text))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(text)]), first


@functools.lru_cache(maxsize=1)
def tokenizers_of(definition: str):  # noqa: ANN201
    """(the tokenizer, that of the short way or None, which of its ids end a word), kept for a worker's next tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    parts, whole = json.loads(definition), Tokenizer.from_str(definition)
    levels = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
    same = parts["normalizer"] == SHORT["normalizer"] and all(parts["model"].get(k) == v for k, v in SHORT["model"].items())
    if not (same and len(levels) == 2 and levels[0] == SHORT["split"] and levels[1]["type"] == "ByteLevel" and not levels[1]["add_prefix_space"] and not levels[1]["use_regex"]):
        return whole, None, None
    parts |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, levels[1]]}}
    vocabulary = parts["model"]["vocab"]
    closes = np.zeros(max(vocabulary.values()) + 1, bool)
    closes[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
    return whole, Tokenizer.from_str(json.dumps(parts)), closes


class WordIds:
    """Ids of words by the tokenizers library, remembered.

    Words of letters alone are one pre-token that normalising leaves alone: a tokenizer of the same model that splits at spaces gives
    their ids without the search for pre-tokens, which takes most of the library's time. All others go the whole way.
    """

    def __init__(self, definition: str):
        self.tokenizer, self.letters, self.closes = tokenizers_of(definition)
        self.glue = self.tokenizer.token_to_id(GLUE)
        self.known = Remembered()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the documents of a buffer, each with END."""
        if not ((data[:-1] == 60) & (data[1:] == 124)).any():  # the library lower-cases; its special tokens, <|...|>, are matched before that
            data = bw.LOWER.take(data)
        units, first = units_of(data, offsets)
        coded = units.dictionary_encode()
        words, place = coded.dictionary, coded.indices.to_numpy()
        raw, borders = bw.text_buffer(words)
        keys = bw.range_hash(bw.prefix_hash(raw), borders[:-1], borders[1:])
        order = np.argsort(keys)  # sorted keys are found faster
        keys, rank = keys[order], np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        if len(self.known.keys) > self.known.limit:
            self.known.clear()
        new = self.known.missing(keys)
        if new.any():
            which = order[new]
            self.known.add(keys[new], *self.look_up(raw, borders[which], borders[which + 1]))
        begin, size = self.known.look_up(keys)
        place = rank[place]
        sizes = size[place]
        before = np.concatenate([[0], np.cumsum(sizes)])
        at = before[first] + np.arange(len(offsets))
        out = np.full(at[-1], END, np.int32)
        inner = np.ones(at[-1], bool)
        inner[at[1:] - 1] = False
        out[inner] = self.known.ids[ragged(begin[place], sizes)]
        return out, at

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of words: those of letters by the short way, others joined by the special token, or alone where they hold it."""
        n, sizes = len(starts), ends - starts + 1
        borders = np.concatenate([[0], np.cumsum(sizes)])
        text = np.append(data, np.uint8(32))[ragged(starts, sizes)]
        text[borders[1:] - 1] = 32
        short = of_letters(np.where(text == 32, 97, text).astype(np.uint8), borders) if self.letters else np.zeros(n, bool)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        which = np.flatnonzero(short)
        if len(which):
            body, ends = text[np.repeat(short, sizes)].tobytes(), np.cumsum(sizes[which])
            groups = [which[k : k + 256] for k in range(0, len(which), 256)]
            edges = [0, *ends[[min(k + 255, len(which) - 1) for k in range(0, len(which), 256)]].tolist()]
            for group, ids in self.run(self.letters, groups, [body[a : b - 1].decode() for a, b in zip(edges[:-1], edges[1:], strict=True)]):
                closes = self.closes[ids]
                if closes.sum() == len(group):
                    parts.append((group[np.cumsum(closes) - closes], ids))
                else:  # a byte is not in the vocabulary
                    short[group] = False
        whole, edges = text.tobytes(), borders.tolist()
        words = {k: whole[edges[k] : edges[k + 1] - 1].decode() for k in np.flatnonzero(~short).tolist()}
        plain, odd = [k for k, w in words.items() if GLUE not in w], [k for k, w in words.items() if GLUE in w]
        groups = [np.array(plain[k : k + 256]) for k in range(0, len(plain), 256)]
        for group, ids in self.run(self.tokenizer, groups, [GLUE.join(words[k] for k in g.tolist()) for g in groups]):
            keep = ids != self.glue
            parts.append((group[np.cumsum(~keep)[keep]], ids[keep]))
        for k, ids in self.run(self.tokenizer, odd, [words[k] for k in odd]):
            parts.append((np.full(len(ids), k), ids))
        if not parts:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        owner, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(owner, kind="stable")
        return ids[order], np.concatenate([[0], np.cumsum(bw.counts_of(owner, n))])

    @staticmethod
    def run(tokenizer, groups: list, texts: list[str]) -> Iterator[tuple]:  # noqa: ANN001
        if texts:
            encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
            for group, coded in zip(groups, encode(texts, add_special_tokens=False), strict=True):
                yield group, np.array(coded.ids, np.int32)


def _segments(definition, aim: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(definition.value)
        shard, segment = TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            body = segment_bytes([d for h in held for d in h[0]], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "segment": pa.array([segment], pa.int32()), "body": pa.array([body], pa.binary())})

        for rows, data, offsets in bw.chunks(batches, "text"):
            ids, at = words.encode(data, offsets)
            docs = rows.column(rows.schema.get_field_index("doc_id")).to_pylist()
            first = 0
            while first < len(docs):  # up to the document that fills the segment
                full = int(np.searchsorted(at, at[first] + max(1, aim - sum(len(h[2]) for h in held)), "left"))
                last = min(full, len(docs))
                held.append((docs[first:last], np.diff(at[first : last + 1]), ids[at[first] : at[last]]))
                if full <= len(docs):
                    yield flush()
                    segment, held = segment + 1, []
                first = last
        if held:
            yield flush()

    return run


def write(docs: DataFrame, tokenizer_path: str, path: str, segment: int = SEGMENT) -> None:
    """Encode docs (doc_id, text) and write segments of about so many ids, in ascending doc_id order by (shard, segment)."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:  # a driver-side parameter; executors get the definition
        definition = spark.sparkContext.broadcast(f.read())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_segments(definition, segment), "shard int, segment int, body binary").write.mode("overwrite").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, segment, body in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            docs, sizes, ids = read_segment(body)
            ends = np.cumsum(sizes)
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
            n = len(docs)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard] * n, pa.int32()), "segment": pa.array([segment] * n, pa.int32()), "doc_id": pa.array(docs, pa.int64()), "begin": ends - sizes, "n_tokens": sizes, "ids_crc32": pa.array(crc, pa.int64())})


def read(spark, path: str) -> DataFrame:  # noqa: ANN001
    """(doc_id, start, n_tokens, ids_crc32) from the files alone."""
    stored = spark.read.schema("shard int, segment int, body binary").parquet(path)
    scratch = Scratch(spark, "token-file")
    docs = scratch.stash(stored.mapInArrow(_documents, "shard int, segment int, doc_id long, begin long, n_tokens long, ids_crc32 long"), "documents")
    sizes = docs.groupBy("shard", "segment").agg(F.sum("n_tokens").alias("n"))
    inside = F.sum("n").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n")
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("all"))  # as many rows as shuffle partitions
    before = shards.select("shard", (F.sum("all").over(Window.orderBy("shard")) - F.col("all")).alias("before"))
    base = sizes.withColumn("inside", inside).join(before, "shard").select("shard", "segment", (F.col("before") + F.col("inside")).alias("base"))
    return docs.join(base, ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def digest(docs: DataFrame, tokenizer_path: str, segment: int = SEGMENT) -> DataFrame:
    """Write docs' ids to the shared folder and read them back."""
    spark = docs.sparkSession
    path = Scratch(spark, "token-ids").path("segments")
    write(docs, tokenizer_path, path, segment)
    return read(spark, path)
