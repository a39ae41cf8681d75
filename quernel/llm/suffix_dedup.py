"""Suffix-array dedup: bytes covered by a string of SPAN bytes that also starts in a document with a smaller id.

Every string of SPAN bytes holds an anchor: the leftmost smallest, by hash, of its GRAM-byte grams. Neighbouring
strings with one anchor are one run of text, and equal strings of any documents have equal anchors, so
runs meet by anchor and nothing else needs to meet.
  0. Texts are compressed and dealt out by document once, into a bucketed table, so that they meet what is found without moving
     again. A document with the same bytes as one with a smaller id is left out: all of it goes if it has SPAN bytes.
  1. KEY bits of each anchor, its document and its place there are dealt out by anchor, packed by columns. Anchors of one document only end here.
  2. Texts meet the places of their document's shared anchors; the runs of those anchors are dealt out by anchor.
  3. Each task builds the Burrows-Wheeler transform and the common prefixes of the collection of its distinct runs by
     column-wise multi-document construction (`construct`): a round inserts one symbol in front of every run at once
     and updates both. After the last round, neighbouring suffixes whose common prefixes are SPAN or more
     are one string, and nothing else decides that; its smallest document keeps it. Strings of different anchors never
     meet, so a collection is cut between anchors, where SLICE runs are reached. The method's sequential external
     files are streams here that are read and written front to back once a round, held in a task's memory,
     which the cut bounds; a machine-local file would be lost with its executor.
  4. The removed strings of a document become maximal spans, and texts that lose something are cut.

Cases: null text counts as empty; texts shorter than SPAN lose nothing. Rows that repeat an id are not smaller than
each other, so they do not remove each other. A null doc_id takes no part and keeps its text. An empty table gives
an empty table. Internal columns have the prefix `_sd_`.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm import bytewise as bw
from quernel.session import Scratch

SPAN, GRAM = 50, 20
WINDOWS = SPAN - GRAM + 1
#: Runs packed together before they are dealt out, and distinct runs after which a collection is cut.
FLUSH, SLICE = 1 << 19, 2048
PLACE = 24
#: Bits of an anchor by which documents are told to share it; two anchors with the same bits only cost work.
KEY = 40
#: Strings, and runs, that are worked on at once; more only takes more memory.
ROWS_PER_PIECE, RUNS_PER_PIECE = 1 << 19, 1 << 15


def runs_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first string, number of strings, document) of the runs of a buffer, in order."""
    return placed_runs(data, offsets)[:4]


def placed_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """runs_of and the places of the anchors in their documents, which do not depend on how the buffer is cut."""
    if len(data) < SPAN:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty, empty, empty
    found = [_runs(data, offsets, k, min(k + ROWS_PER_PIECE, len(data) - SPAN + 1)) for k in range(0, len(data) - SPAN + 1, ROWS_PER_PIECE)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _runs(data: np.ndarray, offsets: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, ...]:
    """Runs among the strings that start in [begin, end)."""
    part = data[begin : end + SPAN - 1]
    prefix = bw.prefix_hash(part)
    at = np.arange(len(part) - GRAM + 1)
    grams = bw.range_hash(prefix, at, at + GRAM)
    # the hash's high bits, then the place: the smallest is the leftmost of the smallest
    keyed = ((grams >> np.uint64(PLACE)) << np.uint64(PLACE)) | at.astype(np.uint64)
    padded = np.full(-(-len(keyed) // WINDOWS) * WINDOWS, np.uint64((1 << 64) - 1))
    padded[: len(keyed)] = keyed
    tiles = padded.reshape(-1, WINDOWS)
    ahead = np.minimum.accumulate(tiles, axis=1).ravel()
    behind = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    n = end - begin
    place = (np.minimum(behind[:n], ahead[WINDOWS - 1 : WINDOWS - 1 + n]) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    start = np.arange(begin, end)
    doc = np.searchsorted(offsets, start, "right") - 1
    live = start + SPAN <= offsets[doc + 1]
    start, place, doc = start[live], place[live], doc[live]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(fresh)
    return grams[place[first]], start[first], np.diff(np.append(first, len(start))), doc[first], place[first] + begin - offsets[doc[first]]


def packed(*columns: np.ndarray) -> bytes:
    """Columns as zstandard-compressed byte planes."""
    squeeze = zstandard.ZstdCompressor(level=1)
    out = []
    for column in columns:
        body = squeeze.compress(column.view(np.uint8).reshape(-1, column.dtype.itemsize).T.tobytes())
        out.append(struct.pack("<cBQQ", column.dtype.kind.encode(), column.dtype.itemsize, len(column), len(body)) + body)
    return b"".join(out)


def unpacked(blob: bytes) -> list[np.ndarray]:
    out, at, squeeze = [], 0, zstandard.ZstdDecompressor()
    while at < len(blob):
        kind, size, n, length = struct.unpack_from("<cBQQ", blob, at)
        at += 18
        raw = squeeze.decompress(blob[at : at + length], max_output_size=max(1, n * size)) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).reshape(-1).view(np.dtype(f"<{kind.decode()}{size}")))
        at += length
    return out


def _dealt(anchors: np.ndarray, homes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows by home and anchor, where each home's begin)."""
    home = (anchors % np.uint64(len(homes))).astype(np.int64)
    order = np.lexsort((anchors, home))
    return order, np.searchsorted(home[order], np.arange(len(homes) + 1))


def _anchors(homes):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = np.uint64(len(homes))

        def flush() -> pa.RecordBatch:
            keys, ids, places = (np.concatenate(x) for x in zip(*held, strict=True))
            home = (keys % n).astype(np.int64)
            order = np.lexsort((places, ids, home))
            keys, ids, places = keys[order], ids[order], places[order]
            cuts = np.searchsorted(home[order], np.arange(len(homes) + 1))
            some = np.flatnonzero(np.diff(cuts))
            blobs = []
            for k in some.tolist():
                part = slice(cuts[k], cuts[k + 1])
                blobs.append(packed(keys[part] // n, np.diff(ids[part], prepend=0), places[part]))
            return pa.RecordBatch.from_pydict({"home": pa.array(homes[some]), "blob": pa.array(blobs, pa.binary())})

        for batch in batches:
            for rows, texts in _texts(batch):
                ids = rows.column(0).to_numpy(zero_copy_only=False)
                anchors, _, _, doc, place = placed_runs(np.frombuffer(b"".join(texts), np.uint8), _offsets(texts))
                held.append((anchors & np.uint64((1 << KEY) - 1), ids[doc].astype(np.int64), place.astype(np.int32)))
                if sum(len(h[0]) for h in held) >= FLUSH:
                    yield flush()
                    held = []
        if held:
            yield flush()

    return run


def _shared(homes):  # noqa: ANN001, ANN202
    """(document, place) pairs of anchors that two documents have, dealt out by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.uint64(len(homes))
        got = [(int(np.searchsorted(homes, home)), *unpacked(blob)) for batch in batches for home, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if not got:
            return
        keys = np.concatenate([k * n + np.uint64(home) for home, k, _, _ in got])
        ids = np.concatenate([np.cumsum(d) for _, _, d, _ in got])
        places = np.concatenate([p for _, _, _, p in got])
        del got
        order = np.argsort(keys, kind="stable")
        keys, ids, places = keys[order], ids[order], places[order]
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        if not len(begin):
            return
        size = np.diff(np.append(begin, len(keys)))
        many = np.repeat(np.minimum.reduceat(ids, begin) < np.maximum.reduceat(ids, begin), size)
        ids, places = ids[many], places[many]
        home = (bw.mix(ids.view(np.uint64)) % n).astype(np.int64)
        order = np.lexsort((places, ids, home))
        ids, places = ids[order], places[order]
        cuts = np.searchsorted(home[order], np.arange(len(homes) + 1))
        some = np.flatnonzero(np.diff(cuts))
        blobs = [packed(np.diff(ids[cuts[k] : cuts[k + 1]], prepend=0), places[cuts[k] : cuts[k + 1]]) for k in some.tolist()]
        yield pa.RecordBatch.from_pydict({"home": pa.array(homes[some]), "blob": pa.array(blobs, pa.binary())})

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document, with the places of all its shared anchors."""
    got = [unpacked(blob) for batch in batches for blob in batch.column(1).to_pylist()]
    if not got:
        return
    ids, places = np.concatenate([np.cumsum(d) for d, _ in got]), np.concatenate([p for _, p in got])
    del got
    order = np.lexsort((places, ids))
    ids, places = ids[order], places[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    ends = np.append(first[1:], len(ids))
    for k in range(0, len(first), 4096):
        part = range(k, min(k + 4096, len(first)))
        lists = [packed(np.diff(np.unique(places[first[j] : ends[j]]), prepend=np.int32(0))) for j in part]
        yield pa.RecordBatch.from_pydict({"doc_id": ids[first[k : k + 4096]], "places": pa.array(lists, pa.binary())})


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for rows, data, offsets in bw.chunks(batches, "text"):
        bodies = [squeeze.compress(data[offsets[k] : offsets[k + 1]].tobytes()) for k in range(len(rows))]
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(bodies, pa.binary())], names=["doc_id", "row_hash", "body"])


def _offsets(texts: list[bytes]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    squeeze = zstandard.ZstdDecompressor()
    column = batch.schema.get_field_index("body")
    begin, texts, total = 0, [], 0
    for k, body in enumerate(batch.column(column).to_pylist()):
        texts.append(squeeze.decompress(body))
        total += len(texts[-1])
        if total >= bw.CHUNK_BYTES or k + 1 == len(batch):
            yield batch.slice(begin, len(texts)), texts
            begin, texts, total = k + 1, [], 0


def _run_texts(homes):  # noqa: ANN001, ANN202
    """Runs of shared anchors, each distinct text once a blob."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            anchors, ids, row, start, n, seen = (np.concatenate([h[k] for h in held]) for k in range(6))
            body = [h[6] for h in held]
            source = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])
            at = np.concatenate([h[7] for h in held])
            order, cuts = _dealt(anchors, homes)
            some = np.flatnonzero(np.diff(cuts))
            blobs = []
            for k in some.tolist():
                part = order[cuts[k] : cuts[k + 1]]
                _, first, which = np.unique(seen[part], return_index=True, return_inverse=True)
                one = part[first]
                text = b"".join(body[source[j]][at[j] : at[j] + n[j] + SPAN - 1] for j in one.tolist())
                blobs.append(packed(anchors[one], n[one].astype(np.uint8), np.frombuffer(text, np.uint8), which.astype(np.uint32), ids[part], row[part], start[part]))
            return pa.RecordBatch.from_pydict({"home": pa.array(homes[some]), "blob": pa.array(blobs, pa.binary())})

        for batch in batches:
            for rows, texts in _texts(batch):
                offsets = _offsets(texts)
                joined = b"".join(texts)
                data = np.frombuffer(joined, np.uint8)
                lists = rows.column(rows.schema.get_field_index("places")).to_pylist()
                wanted = np.zeros(len(data) + 1, bool)
                for k, part in enumerate(lists):
                    at = offsets[k] + np.cumsum(unpacked(part)[0])  # of another text of the same id some may be past the end
                    wanted[at[at < offsets[k + 1]]] = True
                anchors, start, n, doc, place = placed_runs(data, offsets)
                if not len(anchors):
                    continue
                keep = wanted[offsets[doc] + place]
                anchors, start, n, doc = anchors[keep], start[keep], n[keep], doc[keep]
                ids = rows.column(0).to_numpy(zero_copy_only=False)[doc]
                row = rows.column(1).to_numpy(zero_copy_only=False)[doc]
                prefix = bw.prefix_hash(data)
                held.append((anchors, ids, row, start - offsets[doc], n, bw.range_hash(prefix, start, start + n + SPAN - 1), joined, start))
                if sum(len(h[0]) for h in held) >= FLUSH // 4:
                    yield flush()
                    held = []
        if held:
            yield flush()

    return run


def put(stream: np.ndarray, old: np.ndarray, new: np.ndarray, values: np.ndarray | int) -> np.ndarray:
    """One pass over a stream: its entries go to the places `old` marks, the values to the places `new`."""
    out = np.empty(len(old), stream.dtype)
    out[old], out[new] = stream, values
    return out


def least_in(stream: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least entry of each range [low, high], from minima of doubling widths."""
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out, table = np.empty(len(low), stream.dtype), stream
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            table = np.minimum(table[: -(1 << (k - 1))], table[1 << (k - 1) :])
        part = np.flatnonzero(level == k)
        out[part] = np.minimum(table[low[part]], table[high[part] - (1 << k) + 1])
    return out


def construct(text: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, common prefixes) of all suffixes of the strings text[at : at + size], in sorted order.

    Column-wise: a round inserts one symbol in front of every string at once. Three streams are in the
    order of the suffixes known so far: the collection's transform `bwt`, the symbol in front of each suffix (0: none); `lcp`,
    the length of the prefix it shares with the suffix before it; `places`. A string's lengthened suffix c.S goes to
    the rank of its c among all c of the transform, by the LF mapping. The suffix before it is that of the
    c before, and the two share one symbol more than the least common prefix between their
    tails. Each stream is then read once, front to back, and written with the insertions.
    """
    values = np.zeros(256, bool)
    values[text] = True
    code = np.zeros(256, np.uint16 if values.all() else np.uint8)
    code[values] = np.arange(1, int(values.sum()) + 1)
    total, m = int(size.sum()), len(at)
    inner = np.cumsum(size) - size + np.arange(m) + 1  # a zero stands in front of every string
    padded = np.zeros(total + m + 1, code.dtype)
    within = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    index = np.repeat(inner, size) + within
    padded[index] = code[text[np.repeat(at, size) + within]]

    places = (inner + size).astype(np.int32)  # the empty suffixes, in the order of the strings
    bwt = padded[places - 1]
    lcp = np.zeros(m, np.uint8 if size.max(initial=0) < 256 else np.int32)
    spot, head = np.arange(m), places
    for _ in range(int(size.max(initial=0))):
        going = bwt[spot] != 0
        spot, head = spot[going], head[going] - 1
        by_symbol = np.argsort(bwt, kind="stable")[np.count_nonzero(bwt == 0) :]  # LF mapping, turned round
        rank = np.empty(len(bwt), np.int32)
        rank[by_symbol] = np.arange(len(by_symbol), dtype=np.int32)
        rank = rank[spot]
        changed = np.zeros(len(by_symbol) + 1, bool)  # the inserted suffixes and those behind them
        changed[rank], changed[rank + 1], changed[0] = True, True, False
        changed = np.flatnonzero(changed[:-1])
        before, here = by_symbol[changed - 1], by_symbol[changed]
        share = np.zeros(len(changed), lcp.dtype)
        same = bwt[before] == bwt[here]
        share[same] = least_in(lcp, before[same] + 1, here[same]) + 1
        spot = rank + m
        old = np.ones(len(bwt) + len(spot), bool)
        old[spot] = False
        bwt, places, lcp = put(bwt, old, spot, padded[head - 1]), put(places, old, spot, head), put(lcp, old, spot, 0)
        lcp[m + changed] = share
    back = np.zeros(len(padded), np.int64)
    back[index] = np.arange(total)
    return back[places[m:]], lcp[m:]


def first_documents(text: np.ndarray, at: np.ndarray, size: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The smallest document that has each string of SPAN bytes of the runs, run after run."""
    owner = np.repeat(np.arange(len(at)), size)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    body = text[np.repeat(at, size) + place]
    whole = place + SPAN <= size[owner]
    order, lcp = construct(body, np.cumsum(size) - size, size)
    long = whole[order]
    order, lcp = order[long], lcp[long]  # a suffix between two that share SPAN bytes has them too
    fresh = np.flatnonzero(np.concatenate([[True], lcp[1:] < SPAN])) if len(order) else order
    out = np.zeros(len(body), np.int64)
    if len(order):
        out[order] = np.repeat(np.minimum.reduceat(least[owner[order]], fresh), np.diff(np.append(fresh, len(order))))
    return out[whole]


def _removed(homes):  # noqa: ANN001, ANN202
    """Byte spans of strings that an earlier document has, dealt out by document: one blob for each home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(_found(batches))
        if not found:
            return
        ids, row, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        home = (bw.mix(ids.view(np.uint64)) % np.uint64(len(homes))).astype(np.int64)
        order = np.lexsort((low, row, ids, home))
        cuts = np.searchsorted(home[order], np.arange(len(homes) + 1))
        some = np.flatnonzero(np.diff(cuts))
        blobs = []
        for k in some.tolist():
            part = order[cuts[k] : cuts[k + 1]]
            blobs.append(packed(np.diff(ids[part], prepend=0), row[part], np.diff(low[part], prepend=0), high[part] - low[part]))
        yield pa.RecordBatch.from_pydict({"home": pa.array(homes[some]), "blob": pa.array(blobs, pa.binary())})

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document that loses something, with its maximal spans as bytes."""
    got = [unpacked(blob) for batch in batches for blob in batch.column(1).to_pylist()]
    if not got:
        return
    ids = np.concatenate([np.cumsum(g[0]) for g in got])
    row = np.concatenate([g[1] for g in got])
    low = np.concatenate([np.cumsum(g[2]) for g in got])
    high = low + np.concatenate([g[3] for g in got])
    del got
    order = np.lexsort((low, row, ids))
    ids, row, low, high = ids[order], row[order], low[order], high[order]
    first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (row[1:] != row[:-1])]))
    ends = np.append(first[1:], len(ids))
    for k in range(0, len(first), 4096):
        part = range(k, min(k + 4096, len(first)))
        spans = [merged(low[first[j] : ends[j]], high[first[j] : ends[j]]).astype("<i8").tobytes() for j in part]
        yield pa.RecordBatch.from_pydict({"doc_id": ids[first[k : k + 4096]], "row_hash": row[first[k : k + 4096]], "spans": pa.array(spans, pa.binary())})


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(doc_id, row_hash, begin, end) of spans of strings that an earlier document has."""
    blobs = [unpacked(blob) for batch in batches for blob in batch.column(1).to_pylist()]
    if not blobs:
        return
    anchors = np.concatenate([b[0] for b in blobs])
    n = np.concatenate([b[1] for b in blobs]).astype(np.int64)
    text = np.concatenate([b[2] for b in blobs])
    base = np.cumsum([0] + [len(b[0]) for b in blobs[:-1]])
    which = np.concatenate([b[3].astype(np.int64) + k for b, k in zip(blobs, base, strict=True)])
    ids, row, start = (np.concatenate([b[k] for b in blobs]) for k in (4, 5, 6))
    del blobs
    size = n + SPAN - 1
    at = np.cumsum(size) - size
    hashes = bw.range_hash(bw.prefix_hash(text), at, at + size)
    order = np.lexsort((hashes, anchors))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (anchors[order][1:] != anchors[order][:-1])
    distinct = np.zeros(len(order), np.int64)
    distinct[order] = np.cumsum(fresh) - 1
    first = order[fresh]
    anchors, n, size, at = anchors[first], n[first], size[first], at[first]
    which = distinct[which]
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, which, ids)

    begin = np.cumsum(n) - n
    earliest = np.repeat(least, n)  # an anchor's only text has nothing to meet
    alone = np.ones(len(anchors), bool)
    alone[1:] &= anchors[1:] != anchors[:-1]
    alone[:-1] &= anchors[1:] != anchors[:-1]
    met = np.flatnonzero(~alone)
    cut = 0
    while cut < len(met):
        end = min(cut + SLICE, len(met))
        while end < len(met) and anchors[met[end]] == anchors[met[end - 1]]:
            end += 1
        part = met[cut:end]
        earliest[np.repeat(begin[part] - np.cumsum(n[part]) + n[part], n[part]) + np.arange(int(n[part].sum()))] = first_documents(text, at[part], size[part], least[part])
        cut = end

    order = np.lexsort((start, row, ids))
    for k in range(0, len(order), RUNS_PER_PIECE):
        yield from _spans(order[k : k + RUNS_PER_PIECE], ids, row, start, which, n, begin, earliest)


def _spans(part, ids, row, start, which, n, begin, earliest):  # noqa: ANN001, ANN202
    ids, row, start, which = ids[part], row[part], start[part], which[part]
    count = n[which]
    index = np.repeat(begin[which] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    owner = np.repeat(np.arange(len(which)), count)
    gone = earliest[index] < ids[owner]
    place = (start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))[gone]
    owner = owner[gone]
    if not len(owner):
        return
    same = (ids[owner][1:] == ids[owner][:-1]) & (row[owner][1:] == row[owner][:-1])
    fresh = np.concatenate([[True], ~(same & (place[1:] <= place[:-1] + SPAN) & (place[1:] >= place[:-1]))])
    head = np.flatnonzero(fresh)
    low, high = place[head], place[np.append(head[1:], len(place)) - 1] + SPAN
    yield ids[owner[head]], row[owner[head]], low, high


def merged(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Maximal spans (begin, end) of spans sorted by their begin."""
    top = np.maximum.accumulate(high)
    head = np.flatnonzero(np.concatenate([[True], low[1:] > top[:-1]]))
    return np.stack([low[head], top[np.append(head[1:], len(low)) - 1]], axis=1)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in _texts(batch):
            found = rows.column(rows.schema.get_field_index("spans")).to_pylist()
            out: dict[str, list] = {"n_removed": [], "n_spans": [], "kept": [], "spans": []}
            for text, blob in zip(texts, found, strict=True):
                spans = np.frombuffer(blob, "<i8").reshape(-1, 2).tolist()
                edges = [0, *(x for pair in spans for x in pair), len(text)]
                out["kept"].append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                out["n_removed"].append(len(text) - len(out["kept"][-1]))
                out["n_spans"].append(len(spans))
                out["spans"].append([{"begin": a, "end": b} for a, b in spans])
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in out["kept"]]), pa.array(out["kept"], pa.binary()), pa.array(out["spans"], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "row_hash", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])


def _homes(df: DataFrame) -> np.ndarray:
    """A number for each shuffle partition that hash partitioning sends there."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = spark.range(0, 40 * n + 400).select(F.col("id"), F.pmod(F.hash("id"), F.lit(n)).alias("home")).groupBy("home").agg(F.min("id").alias("id"))
    return np.array(sorted(r["id"] for r in ids.collect()), np.int64)


def bucketed(df: DataFrame, n: int, key: list[str], path: str) -> DataFrame:
    """df as a table of n buckets by key in the shared folder, which joins by key without another shuffle."""
    name = f"quernel_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "none").option("path", path).bucketBy(n, *key).saveAsTable(name)
    let_go(df)
    return df.sparkSession.table(name)


def let_go(df: DataFrame) -> None:
    """Have the driver collect its garbage: only then do shuffle files that nothing reads any more leave the disks."""
    df.sparkSession._jvm.System.gc()


def cut(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all rows: doc_id, row_hash, n_bytes, sha256, copy; changed rows: doc_id, row_hash, n_removed, n_spans, kept_sha256, kept, spans).

    A copy's row has no spans of its own: all its bytes go.
    """
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row_hash"), text.alias("text"))
    facts = scratch.stash(rows.select("doc_id", "row_hash", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256")), "facts")
    firsts = facts.groupBy("sha256").agg(F.min("doc_id").alias("first"))
    marks = facts.join(firsts, "sha256").select("doc_id", "row_hash", "n_bytes", "sha256", F.coalesce((F.col("first") < F.col("doc_id")) & (F.col("n_bytes") >= SPAN), F.lit(False)).alias("copy"))
    marks = scratch.stash(marks, "marks")
    scratch.drop("facts")

    homes = _homes(docs)
    n = len(homes)
    key = ["doc_id", "row_hash"]
    searched = marks.filter(f"not copy and n_bytes >= {SPAN}").select(*key).distinct()
    squeezed = rows.filter("doc_id is not null").mapInArrow(_squeezed, "doc_id long, row_hash long, body binary").repartition(n, *key)
    bodies = bucketed(squeezed.join(searched, key, "left_semi"), n, key, scratch.path("bodies"))
    pairs = bodies.mapInArrow(_anchors(homes), "home long, blob binary").repartition(n, "home")
    shared = pairs.mapInArrow(_shared(homes), "home long, blob binary").repartition(n, "home")
    shared = scratch.stash(shared.mapInArrow(_lists, "doc_id long, places binary").join(searched, "doc_id").select(*key, "places"), "shared")
    let_go(docs)
    runs = bodies.join(shared, key).select(*key, "body", "places").mapInArrow(_run_texts(homes), "home long, blob binary")
    spans = runs.repartition(n, "home").mapInArrow(_removed(homes), "home long, blob binary").repartition(n, "home")
    spans = scratch.stash(spans.mapInArrow(_merged, "doc_id long, row_hash long, spans binary"), "spans")
    scratch.drop("shared")
    let_go(docs)
    changed = bodies.join(spans, key).select(*key, "body", "spans").mapInArrow(_cut, "doc_id long, row_hash long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<begin:long,end:long>>")
    return marks, changed


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row for each row of docs."""
    marks, changed = cut(docs)
    slim = changed.select("doc_id", "row_hash", "n_removed", "n_spans", "kept_sha256").dropDuplicates(["doc_id", "row_hash"])
    rows = marks.join(slim, ["doc_id", "row_hash"], "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), nothing).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )
