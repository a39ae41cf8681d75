"""Vectorised byte-level text primitives over Arrow string columns.

A batch of documents is one uint8 buffer plus int64 offsets. Words are the runs
of bytes outside 0x20 and 0x09-0x0D, hashed by differences of a polynomial
prefix hash (mod 2**64, odd base), finished by a 64-bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: A sub-batch holds about this much text, so that the uint64 work arrays stay within tens of megabytes.
CHUNK_BYTES = 1 << 21

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = len(_powers.get("up", ()))
    if have < n:
        size = max(n, CHUNK_BYTES * 5 // 4)
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def extended(df: DataFrame, ddl: str) -> StructType:
    """df's schema followed by the given columns."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) in pieces of about CHUNK_BYTES; a longer text is a piece by itself."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
        begin = 0
        while begin < len(batch):
            end = int(np.searchsorted(offsets, offsets[begin] + CHUNK_BYTES, "right")) - 1
            end = min(max(end, begin + 1), len(batch), begin + 4096)
            yield batch.slice(begin, end - begin), data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
            begin = end


def prefix_hash(data: np.ndarray) -> np.ndarray:
    up, _ = _power_table(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hashes of the byte ranges [start, end)."""
    _, down = _power_table(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word."""
    solid = ~IS_SPACE[data]
    if not len(solid):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens = solid.copy()
    opens[1:] &= ~solid[:-1] | edge[1:-1]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(offsets, starts, "right") - 1


def counts_of(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n).astype(np.int64)


def shingle_hashes(words: np.ndarray, doc: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every `size`-word shingle; a shorter document's whole sequence is its one shingle."""
    per = counts_of(doc, n)
    first = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros(len(words), np.uint64)
    width = np.minimum(per, size)[doc]
    at = np.arange(len(words))
    whole = at + width <= first[doc + 1]
    for k in range(size):
        live = whole & (k < width)
        out[live] = mix(out[live] * np.uint64(BASE) + words[at[live] + k] + np.uint64(k + 1))
    return out[whole], doc[whole]


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, from batches in which equal keys are adjacent; holds one key's rows and a batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        if not len(values):
            continue
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        for begin, end in zip([0, *cuts], [*cuts, len(values)], strict=True):
            if held and values[begin] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last = values[begin]
    if held:
        yield pa.Table.from_batches(held)
