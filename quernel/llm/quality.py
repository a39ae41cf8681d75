"""Quality rules with zstandard compression bands.

Base rules are counted per document over its words (`[^\\x20\\x09-\\x0D]+`), then the method's
verdict: the zstandard ratio (compressed / raw bytes) of the whole document must lie in
the band of its length class, and most of its fixed-size chunks must lie in the chunk
band. A ratio below a band means repetitive text, one above it incompressible text.
The chunks cover the whole text; one shorter than a chunk is judged by its own class alone.
Shorter texts compress worse (frame overhead, no history), so each length class has
its own limits; they fall up to 4 MiB, beyond the compressor's window of 2 MiB. Ratios
and lengths are of letters, not of UTF-8 bytes: what is compressed has one byte for a
letter of any alphabet, so a text's verdict does not depend on its script.

Cases: null text counts as empty; an empty text has no words and fails the base rule.
Very long texts are read whole, chunk by chunk. Rows are judged one by one, so
repeated rows repeat their result. Other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from quernel.llm import bytewise as bw

LEVEL = 3
CHUNK = 4096
WINDOW = 8
#: (shorter than so many bytes, lowest ratio, highest ratio) of a whole document.
BANDS = (
    (128, 0.60, 1.15), (256, 0.50, 1.00), (512, 0.47, 0.85), (1024, 0.46, 0.78), (2048, 0.445, 0.70),
    (4096, 0.43, 0.65), (8192, 0.415, 0.60), (16384, 0.405, 0.58), (1 << 16, 0.375, 0.58),
    (1 << 18, 0.36, 0.58), (1 << 20, 0.33, 0.58), (1 << 22, 0.30, 0.58), (1 << 62, 0.28, 0.58),
)
#: Band of a chunk, and the share of chunks that may lie outside.
CHUNK_BAND = (0.38, 0.65)
CHUNKS_OUTSIDE = 0.5
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("ratio", pa.float64()), ("bad_chunks", pa.int64()), ("n_chunks", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, bad_chunks long, n_chunks long, base_failed boolean, kept boolean"


def repeated(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows keyed by (group, value): is the key found twice or more; is the row not the first of its key."""
    order = np.lexsort((np.arange(len(value)), value, group))
    g, v = group[order], value[order]
    same = np.zeros(len(g) + 1, bool)
    same[1:-1] = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
    many, later = np.zeros(len(g), bool), np.zeros(len(g), bool)
    many[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return many, later


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The five base counts of each document of a buffer."""
    n = len(offsets) - 1
    prefix = bw.prefix_hash(data)
    starts, ends, doc = bw.word_spans(data, offsets)
    n_words = bw.counts_of(doc, n)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    out = {"n_words": n_words, "word_chars": total(~bw.IS_SPACE[data] & ((data & 0xC0) != 0x80)), "n_symbols": total(SYMBOL[data])}

    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    line_doc = np.sort(np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1]), kind="stable")
    line_end = np.empty_like(line_start)
    line_end[:-1] = line_start[1:] - (line_doc[1:] == line_doc[:-1])
    line_end[-1:] = len(data)
    wordy = np.searchsorted(starts, line_end, "left") > np.searchsorted(starts, line_start, "left")
    line_start, line_end, line_doc = line_start[wordy], line_end[wordy], line_doc[wordy]
    _, later = repeated(line_doc, bw.range_hash(prefix, line_start, line_end))
    out["n_dup_lines"] = bw.counts_of(line_doc[later], n)

    words = bw.range_hash(prefix, starts, ends)
    full = (n_words >= WINDOW)[doc]
    begin = np.flatnonzero(full)
    grams, gram_doc = bw.shingle_hashes(words[begin], doc[begin], n, WINDOW)
    first = np.concatenate([[0], np.cumsum(n_words)])
    inside = begin[begin + WINDOW <= first[doc[begin] + 1]]
    many, _ = repeated(gram_doc, grams)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, inside[many], 1)
    np.add.at(cover, inside[many] + WINDOW, -1)
    out["n_repeat_words"] = bw.counts_of(doc[np.cumsum(cover[:-1]) > 0], n)
    return out


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) with one byte for each code point from U+0080 to U+1FFF: its place in its block of 128.

    Ideographs and syllable blocks, which say as much as two or three letters, keep their three bytes.
    """
    one, two = np.append(data[1:], 0), np.append(data[2:], [0, 0])
    cont, cont2 = (one & 0xC0) == 0x80, (two & 0xC0) == 0x80
    pair = np.flatnonzero((data >= 0xC2) & (data <= 0xDF) & cont)
    triple = np.flatnonzero((data >= 0xE0) & (data <= 0xE1) & cont & cont2)
    out, stay = data.copy(), np.ones(len(data), bool)
    out[pair + 1] = 0x80 | (data[pair] & 1) << 6 | data[pair + 1] & 0x3F
    out[triple + 2] = 0x80 | (data[triple + 1] & 1) << 6 | data[triple + 2] & 0x3F
    stay[pair] = stay[triple] = stay[triple + 1] = False
    return out[stay], np.concatenate([[0], np.cumsum(stay)])[offsets]


def compression(text: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, int, int]:
    """(whole-document ratio, chunks outside the band, chunks); a text that does not end with a chunk has its last CHUNK bytes as one more."""
    if not text:
        return 0.0, 0, 0
    low, high = CHUNK_BAND
    starts = list(range(0, len(text) - CHUNK + 1, CHUNK))
    if starts and len(text) % CHUNK:
        starts.append(len(text) - CHUNK)
    bad = 0
    for k in starts:
        ratio = len(packer.compress(text[k : k + CHUNK])) / CHUNK
        bad += not low <= ratio <= high
    return len(packer.compress(text)) / len(text), bad, len(starts)


def in_band(n_bytes: int, ratio: float, bad: int, full: int) -> bool:
    low, high = next((lo, hi) for limit, lo, hi in BANDS if n_bytes < limit)
    return low <= ratio <= high and bad <= CHUNKS_OUTSIDE * full


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    for rows, data, offsets in bw.chunks(batches, "text"):
        out = base_counts(data, offsets)
        body, at = letters(data, offsets)
        sizes = np.diff(at)
        packed = [compression(body[at[k] : at[k + 1]].tobytes(), packer) for k in range(len(sizes))]
        out["ratio"], out["bad_chunks"], out["n_chunks"] = (np.array(x) for x in zip(*packed, strict=True))
        out["base_failed"] = (out["n_words"] < 20) | (100 * out["n_repeat_words"] > 30 * out["n_words"])
        out["kept"] = ~out["base_failed"] & np.array([in_band(int(size), *x) for size, x in zip(sizes, packed, strict=True)])
        yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(out[name], kind) for name, kind in FIELDS)], names=[*rows.schema.names, *(name for name, _ in FIELDS)])


def judge(docs: DataFrame) -> DataFrame:
    """docs' columns (those named as a result make way) with counts, ratios, base_failed and kept."""
    names = {name for name, _ in FIELDS}
    docs = docs.select(*(c for c in docs.columns if c not in names))
    return docs.mapInArrow(_judge, bw.extended(docs, SCHEMA))
