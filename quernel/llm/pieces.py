"""SentencePiece encoding and decoding with a batched numpy Viterbi search.

The vocabulary is read from a model file (pieces, kinds, scores). Text gets the dummy prefix, a space
stands for the piece mark, and nothing else is normalised. Units between spaces are segmented
alone, as no piece holds a mark after its beginning except runs of marks. The distinct units of
a batch that have one byte length advance together: for each end and each piece length the
substring hash is probed in the sorted piece keys, and vectorised maxima keep the best score and
its backpointer. Ties go to the longer last piece. A byte that no piece covers costs a byte piece.

Scores: a unigram model's are log-probabilities and are summed. A merge model's (BPE) are ranks; there the search
is over valid paths only: a piece may follow another if merging their two texts leaves exactly these
two pieces. Every prefix of a unit has one valid path, which is the merge procedure's result, so the
ids are those of the library. Whether two pieces may meet is found by undoing the later of their
last merges, again and again, while no merge across their border has an earlier rank.

Decoding joins the pieces' bytes and drops the dummy prefix, so decode(encode(text)) is text, byte for byte
(a literal U+2581 is spelled in byte pieces, so it comes back too).

Cases: null and empty texts have no ids and decode to the empty text. A unit of more than LONG bytes is
searched by itself, by a loop over its ends. Substrings are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quernel.llm import bytewise as bw

MARK = "▁"
LONG = 96
BYTE_COST = 1e4
NEVER = 1 << 40
#: Distinct units remembered between batches of a task; beyond that the memory starts anew.
REMEMBERED = 400_000


class Vocabulary:
    """Piece bytes and costs, with keys sorted by substring hash."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], special: set[int], merges: bool):
        usable = [i for i, p in enumerate(pieces) if i not in special and i not in byte_ids.values() and p and (MARK not in p[1:] or not p.strip(MARK))]
        body = {i: pieces[i].replace(MARK, " ").encode() for i in usable}
        spell = [body.get(i, b"") for i in range(len(pieces))]
        for value, i in byte_ids.items():
            spell[i] = bytes([value])
        self.at = np.concatenate([[0], np.cumsum([len(s) for s in spell])])
        self.bytes = np.frombuffer(b"".join(spell), np.uint8)
        self.byte_ids = np.array([byte_ids.get(b, 0) for b in range(256)])
        self.merges = merges
        self.gains = np.array(scores, float)
        if merges:
            usable = self._merge_tables(usable, body, scores)
        end = np.cumsum([len(body[i]) for i in usable])
        start = end - np.array([len(body[i]) for i in usable])
        data = np.frombuffer(b"".join(body[i] for i in usable), np.uint8)
        keys = bw.range_hash(bw.prefix_hash(data), start, end)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(usable)[order]
        self.lengths = sorted({len(body[i]) for i in usable})

    def _merge_tables(self, usable: list[int], body: dict[int, bytes], scores: list[float]) -> list[int]:
        """Merge ranks, the two parts of each piece's last merge, and what pairs make; the pieces that merging can reach."""
        n = len(self.gains)
        by_text = {body[i]: i for i in usable}
        texts = {i: body[i].decode() for i in usable}
        self.rank = np.full(n, -1)  # single characters are never merged
        long = [i for i in usable if len(texts[i]) > 1]
        self.rank[long] = np.unique([-scores[i] for i in long], return_inverse=True)[1]
        self.left, self.right = np.arange(n), np.arange(n)
        splits = [(len(texts[i]), i, by_text[a], by_text[b]) for i in long for k in range(1, len(texts[i])) if (a := texts[i][:k].encode()) in by_text and (b := texts[i][k:].encode()) in by_text]
        table = np.array(sorted(splits)).reshape(-1, 4)
        keys = table[:, 2] * n + table[:, 3]
        order = np.argsort(keys)
        self.pairs, self.pair_rank = keys[order], self.rank[table[order, 1]]
        reached = np.zeros(n, bool)
        reached[[i for i in usable if len(texts[i]) == 1]] = True
        for size in np.unique(table[:, 0]):  # the parts of a piece are shorter, so they are known
            part = table[table[:, 0] == size]
            part = part[reached[part[:, 2]] & reached[part[:, 3]]]
            part = part[self.may_meet(part[:, 2], part[:, 3], self.rank[part[:, 1]])]
            self.left[part[:, 1]], self.right[part[:, 1]] = part[:, 2], part[:, 3]
            reached[part[:, 1]] = True
        return [i for i in usable if reached[i]]

    def may_meet(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Does merging leave a border between pieces a and b? Ties between merges go to the left one."""
        n = len(self.gains)
        out = np.ones(len(a), bool)
        rows = np.arange(len(a))
        limit = np.full(len(a), NEVER) if limit is None else limit.astype(np.int64)
        a, b = a.astype(np.int64), b.astype(np.int64)
        while len(rows):
            key = a * n + b
            at = np.minimum(np.searchsorted(self.pairs, key), max(len(self.pairs) - 1, 0))
            across = np.where(self.pairs[at] == key, self.pair_rank[at], NEVER) if len(self.pairs) else np.full(len(a), NEVER)
            across = np.where(across < limit, -2, across)
            out[rows[across == -2]] = False
            x, y = self.rank[a], self.rank[b]
            go = (across != -2) & ((x >= 0) | (y >= 0))
            undo_left = x > y
            limit = np.where(undo_left, x, y + 1)[go]
            a, b, rows = np.where(undo_left, self.right[a], a)[go], np.where(undo_left, b, self.left[b])[go], rows[go]
        return out

    @classmethod
    def from_model(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        scores = [model.get_score(i) for i in range(n)]
        byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        plain = [scores[i] for i in range(n) if i not in special and i not in byte_ids.values()]
        merges = all(s == int(s) for s in plain)  # ranks are whole numbers, log-probabilities are not
        return cls(pieces, scores, byte_ids, special, merges)

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes; -1 where there is none."""
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == hashes, self.ids[at], -1)

    def gain(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """What a piece adds to the score of a path that ends in another (-1: in nothing that merges)."""
        if not self.merges:
            return self.gains[piece]
        out = np.zeros(len(piece))
        inner = np.flatnonzero(before >= 0)
        out[inner[~self.may_meet(before[inner], piece[inner])]] = -np.inf
        return out

    def same_length(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids padded with -1 at the left, count) of units given as a byte matrix."""
        m, n = units.shape
        up, down = bw._power_table(n + 1)
        prefix = np.zeros((m, n + 1), np.uint64)
        np.cumsum((units.astype(np.uint64) + np.uint64(1)) * up[:n], axis=1, out=prefix[:, 1:])
        best = np.full((m, n + 1), -np.inf)
        best[:, 0] = 0
        back, via = np.zeros((m, n + 1), np.int16), np.full((m, n + 1), -1, np.int32)
        byte = np.zeros((m, n + 1), bool)  # the path ends in a byte piece
        for end in range(1, n + 1):
            rows, sizes, found = [], [], []
            for size in self.lengths:
                if size > end:
                    break
                start = end - size
                ids = self.probe(bw.mix((prefix[:, end] - prefix[:, start]) * down[start] + np.uint64(size * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)))
                hit = np.flatnonzero(ids >= 0)
                rows.append(hit)
                sizes.append(np.full(len(hit), size))
                found.append(ids[hit])
            best[:, end], back[:, end], via[:, end], byte[:, end] = best[:, end - 1] - BYTE_COST, 1, self.byte_ids[units[:, end - 1]], True
            if not rows:
                continue
            row, size, ids = np.concatenate(rows), np.concatenate(sizes), np.concatenate(found)
            start = end - size
            score = best[row, start] + self.gain(np.where(byte[row, start] | (start == 0), -1, via[row, start]), ids)
            order = np.lexsort((size, score, row))  # the best of each row comes last
            last = order[np.append(row[order][1:] != row[order][:-1], True)] if len(order) else order
            last = last[score[last] >= best[row[last], end]]
            row = row[last]
            best[row, end], back[row, end], via[row, end], byte[row, end] = score[last], size[last], ids[last], False
        out = np.full((m, n), -1, np.int32)
        place, at, rows = np.full(m, n), np.full(m, n), np.arange(m)
        while len(rows):
            place[rows] -= 1
            out[rows, place[rows]] = via[rows, at[rows]]
            at[rows] -= back[rows, at[rows]]
            rows = rows[at[rows] > 0]
        return out, n - place

    def long(self, unit: np.ndarray) -> np.ndarray:
        """Ids of one long unit: all probes at once, then end by end."""
        n = len(unit)
        prefix = bw.prefix_hash(unit)
        found: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for size in self.lengths:
            start = np.arange(max(n - size + 1, 0))
            ids = self.probe(bw.range_hash(prefix, start, start + size))
            for k in np.flatnonzero(ids >= 0).tolist():
                found[k + size].append((size, int(ids[k])))
        best, back, via = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        seen: dict[tuple[int, int], float] = {}
        for end in range(1, n + 1):
            best[end], back[end], via[end] = best[end - 1] - BYTE_COST, 0, -1
            for size, piece in found[end]:
                before = via[end - size]
                if (before, piece) not in seen:
                    seen[before, piece] = float(self.gain(np.array([before]), np.array([piece]))[0])
                score = best[end - size] + seen[before, piece]
                if score >= best[end]:
                    best[end], back[end], via[end] = score, size, piece
        out, end = [], n
        while end:
            out.append(via[end] if back[end] else int(self.byte_ids[unit[end - 1]]))
            end -= back[end] or 1
        return np.array(out[::-1], np.int32)

    def segment(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, one unit's after another's; where each begins) of byte ranges."""
        size = ends - starts
        count = np.zeros(len(size), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for n in np.unique(size).tolist():
            which = np.flatnonzero(size == n)
            if n > LONG:
                for k in which.tolist():
                    ids = self.long(data[starts[k] : ends[k]])
                    count[k] = len(ids)
                    parts.append((np.full(len(ids), k), ids))
                continue
            for part in np.array_split(which, -(-len(which) // 16384)):
                out, count[part] = self.same_length(data[starts[part][:, None] + np.arange(n)])
                row, col = np.nonzero(out >= 0)
                parts.append((part[row], out[row, col]))
        at = np.concatenate([[0], np.cumsum(count)])
        ids = np.zeros(at[-1], np.int32)
        for owner, values in parts:
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else owner
            run = np.diff(np.append(first, len(owner)))
            ids[at[owner] + np.arange(len(owner)) - np.repeat(first, run)] = values
        return ids, at


def units_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with dummy prefixes, start, end, document) of the units: a run of spaces and what follows it, cut at line ends."""
    n = len(offsets) - 1
    live = np.diff(offsets) > 0
    out = np.full(len(data) + int(live.sum()), 32, np.uint8)
    shift = np.cumsum(live)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    out[np.arange(len(data)) + shift[doc]] = data
    moved = offsets + np.concatenate([[0], shift])
    if not len(out):
        empty = np.zeros(0, np.int64)
        return out, empty, empty, empty
    space, line = out == 32, out == 10
    opens = space.copy()
    opens[1:] &= ~space[:-1]
    opens |= line
    opens[1:] |= line[:-1]
    opens[moved[:-1][live]] = True
    starts = np.flatnonzero(opens)
    return out, starts, np.append(starts[1:], len(out)), np.searchsorted(moved, starts, "right") - 1


class Remembered:
    """Ids of distinct units by hash, kept from batch to batch of a task."""

    def __init__(self, limit: int = REMEMBERED):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.ids, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def missing(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.ones(len(keys), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] != keys

    def add(self, keys: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        all_keys = np.concatenate([self.keys, keys])
        starts = np.concatenate([self.at[:-1], at[:-1] + len(self.ids)])
        sizes = np.concatenate([np.diff(self.at), np.diff(at)])
        body = np.concatenate([self.ids, ids])
        order = np.argsort(all_keys)
        self.keys = all_keys[order]
        self.at = np.concatenate([[0], np.cumsum(sizes[order])])
        self.ids = body[ragged(starts[order], sizes[order])]

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) in ids of known keys."""
        at = np.searchsorted(self.keys, keys)
        return self.at[at], self.at[at + 1] - self.at[at]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + size), one after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def encode_buffer(vocabulary: Vocabulary, known: Remembered, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the documents of a buffer."""
    text, starts, ends, doc = units_of(data, offsets)
    keys = bw.range_hash(bw.prefix_hash(text), starts, ends)
    distinct, first, place = np.unique(keys, return_index=True, return_inverse=True)
    if len(known.keys) > known.limit:
        known.clear()
    new = known.missing(distinct)
    if new.any():
        which = first[new]
        known.add(distinct[new], *vocabulary.segment(text, starts[which], ends[which]))
    begin, size = known.look_up(distinct)
    per = np.zeros(len(offsets) - 1, np.int64)
    np.add.at(per, doc, size[place])
    return known.ids[ragged(begin[place], size[place])], np.concatenate([[0], np.cumsum(per)])


def decode_buffer(vocabulary: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the documents with these ids."""
    size = vocabulary.at[ids + 1] - vocabulary.at[ids]
    body = vocabulary.bytes[ragged(vocabulary.at[ids], size)]
    ends = np.concatenate([[0], np.cumsum(size)])[offsets]
    keep = np.ones(len(body), bool)
    keep[ends[:-1][np.diff(ends) > 0]] = False  # the dummy prefix
    return body[keep], ends - np.concatenate([[0], np.cumsum(np.diff(ends) > 0)])


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs' columns and the text's ids (a column of that name makes way)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rest = [c for c in docs.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered()
        for rows, data, offsets in bw.chunks(batches, text):
            values, at = encode_buffer(shared.value, known, data, offsets)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))], names=[*rest, ids])

    return docs.select(*rest).mapInArrow(run, bw.extended(docs.select(*rest), f"`{ids}` array<int>"))


def encode_checked(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", size: str = "n_bytes", same: str = "round_trip") -> DataFrame:
    """docs' columns, the text's ids, the bytes of what the ids decode to, and whether that is the text, in one pass.

    Columns named as a result make way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rest = [c for c in docs.columns if c not in (ids, size, same)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered()
        for rows, data, offsets in bw.chunks(batches, text):
            values, at = encode_buffer(shared.value, known, data, offsets)
            body, ends = decode_buffer(shared.value, values, at)
            equal = np.diff(ends) == np.diff(offsets)
            if equal.all():
                wrong = np.flatnonzero(body != data)
                equal[np.searchsorted(offsets, wrong, "right") - 1] = False
            else:
                equal &= [body[ends[k] : ends[k + 1]].tobytes() == data[offsets[k] : offsets[k + 1]].tobytes() for k in range(len(rows))]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32())), pa.array(np.diff(ends), pa.int64()), pa.array(equal)], names=[*rest, ids, size, same])

    return docs.select(*rest).mapInArrow(run, bw.extended(docs.select(*rest), f"`{ids}` array<int>, `{size}` long, `{same}` boolean"))


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "text") -> DataFrame:
    """rows' columns and the ids' text (a column of that name makes way); null ids give an empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    rest = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                column = part.column(part.schema.get_field_index(ids))
                size = column.value_lengths().fill_null(0).to_numpy()
                body, at = decode_buffer(shared.value, column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(size)]))
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(body.tobytes())])
                yield pa.RecordBatch.from_arrays([*part.columns, texts.cast(pa.large_string()).cast(pa.string())], names=[*rest, text])

    return rows.select(*rest).mapInArrow(run, bw.extended(rows.select(*rest), f"`{text}` string"))
