"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word (letters, digits and bytes over 127, A-Z lower-cased) enters as two learned vectors: a word embedding (hashed into WORD_ROWS)
and the sum of the embeddings of its 3- to 6-byte character n-grams, those at its borders marked (hashed into GRAM_ROWS), divided by the root
of their number. The network knows nothing else of a word; all vectors start at random and are learned with the rest. It reads overlapping
windows of WINDOW words, STRIDE apart, both ways; attention pools the states; a window's logit follows. A document's score is
the calibrated sigmoid of its highest window logit, over all windows of its whole text.

Only documents are labelled, not windows. Training goes from all windows to the telling ones: in the first rounds every document gives windows
at random, later the window that scores highest now (for toxic ones, what makes them so; for clean ones, the worst
mistake) and one at random. Words are left out at random while training, so that n-grams learn too. Every sixth document of
either label is kept out of training; the logistic calibration is fitted on these.

The model is fitted on at most MAX_TOXIC + MAX_CLEAN labelled rows, chosen by hash among the rows allowed for training; a text of more than
MAX_WORDS words takes part in training with as many, in passages of WINDOW words spread evenly. Every row is scored. Inputs are the text alone.

Cases: null, empty or wordless texts get the score of a document without windows (the output's bias). Labels that are null or without
a document are ignored; repeated labels count as toxic if any is. With fewer than two positive or two negative labels to learn
from, every document gets the share of positives. Very long texts are scored whole, window by window. Repeated rows repeat their score. Other columns stay,
but for one named as the result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm import bytewise as bw

WINDOW, STRIDE = 48, 32
HIDDEN, EMBED = 12, 12
WORD_ROWS, GRAM_ROWS = 1 << 15, 1 << 15
MAX_TOXIC, MAX_CLEAN = 1200, 2400
MAX_WORDS = 2048
ROUNDS, FIRST, BATCH, RATE, DECAY, LEFT_OUT = 16, 4, 192, 0.01, 3e-4, 0.3
GRAMS = (3, 4, 5, 6)
THRESHOLD = 0.3

SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Bytes that separate words become spaces, so that the word scanner of bytewise applies.
PLAIN = np.where(SEPARATOR, 32, bw.LOWER).astype(np.uint8)


class Words:
    """The words of a buffer: distinct ones with their n-grams, and which one stands where."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = PLAIN[data]
        starts, ends, self.doc = bw.word_spans(data, offsets)
        prefix = bw.prefix_hash(data)
        hashes = bw.range_hash(prefix, starts, ends)
        self.distinct, first, self.at = np.unique(hashes, return_index=True, return_inverse=True)
        begin, end = starts[first], ends[first]
        rows, grams = [], []
        for size in GRAMS:
            count = np.maximum(end - begin - size + 1, 0)
            owner = np.repeat(np.arange(len(begin)), count)
            at = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            found = bw.range_hash(prefix, at, at + size)
            found ^= (at == begin[owner]).astype(np.uint64) * np.uint64(0x5555) ^ (at + size == end[owner]).astype(np.uint64) * np.uint64(0x3333)
            rows.append(owner)
            grams.append((found % np.uint64(GRAM_ROWS)).astype(np.int64))
        # a word too short for any n-gram is its own
        short = np.flatnonzero(end - begin < GRAMS[0])
        rows.append(short)
        grams.append((self.distinct[short] % np.uint64(GRAM_ROWS)).astype(np.int64))
        owner, gram = np.concatenate(rows), np.concatenate(grams)
        order = np.argsort(owner, kind="stable")
        self.gram_owner, self.gram = owner[order], gram[order]
        self.gram_at = np.searchsorted(self.gram_owner, np.arange(len(begin)))
        self.word = (self.distinct % np.uint64(WORD_ROWS)).astype(np.int64)

    def take(self, which: np.ndarray) -> Words:
        """The given distinct words only, without places."""
        out = object.__new__(Words)
        size = np.diff(np.append(self.gram_at, len(self.gram)))[which]
        out.gram_at = np.cumsum(size) - size
        out.gram_owner = np.repeat(np.arange(len(which)), size)
        out.gram = self.gram[np.repeat(self.gram_at[which] - out.gram_at, size) + np.arange(size.sum())]
        out.word = self.word[which]
        return out

    def roots(self) -> np.ndarray:
        """The root of the number of each word's n-grams."""
        return np.sqrt(np.diff(np.append(self.gram_at, len(self.gram)))).astype(np.float32)

    def pooled(self, table: np.ndarray) -> np.ndarray:
        """The words' n-gram vectors, summed and divided by the root of their number."""
        if not len(self.word):
            return np.zeros((0, table.shape[1]), np.float32)
        out, step = np.empty((len(self.word), table.shape[1]), table.dtype), 1 << 15
        for k in range(0, len(self.word), step):  # a long text's n-grams are many
            at = self.gram_at[k : k + step]
            end = self.gram_at[k + step] if k + step < len(self.gram_at) else len(self.gram)
            out[k : k + step] = np.add.reduceat(table[self.gram[at[0] : end]], at - at[0], axis=0)
        return out / self.roots()[:, None]


def windows(doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each window, its document); words of a document are adjacent. Wordless documents have none."""
    per = bw.counts_of(doc, n)
    begin = np.cumsum(per) - per
    many = np.where(per > 0, 1 + np.maximum(-(-(per - WINDOW) // STRIDE), 0), 0)
    owner = np.repeat(np.arange(n), many)
    return begin[owner] + STRIDE * (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)), owner


def passages(text: bytes) -> bytes:
    """The text, or MAX_WORDS of its words in passages of WINDOW words, spread evenly from the first to the last."""
    raw = np.frombuffer(text, np.uint8)
    starts, ends, _ = bw.word_spans(PLAIN[raw], np.array([0, len(raw)]))
    if len(starts) <= MAX_WORDS:
        return text
    first = np.linspace(0, len(starts) - WINDOW, MAX_WORDS // WINDOW).astype(np.int64)
    return b" ".join(text[a:b] for a, b in zip(starts[first].tolist(), ends[first + WINDOW - 1].tolist(), strict=True))


def window_words(starts: np.ndarray, owner: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word positions, mask) of windows, one row each."""
    end = np.cumsum(bw.counts_of(doc, n))[owner]
    at = starts[:, None] + np.arange(WINDOW)
    mask = at < end[:, None]
    return np.where(mask, at, 0), mask


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters in float32: embeddings, W, U and c of both directions, attention, output."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"word": draw(WORD_ROWS, EMBED, scale=0.1), "gram": draw(GRAM_ROWS, EMBED, scale=0.1), "att": draw(2 * HIDDEN, scale=0.3), "out": draw(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"W{side}": draw(2 * EMBED, 3 * HIDDEN, scale=0.3), f"U{side}": draw(HIDDEN, 3 * HIDDEN, scale=0.3), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}

    def inputs(self, words: Words) -> np.ndarray:
        return np.concatenate([self.p["word"][words.word], words.pooled(self.p["gram"])], axis=1)

    def run(self, side: str, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each step (window, step, hidden); x holds projected inputs of distinct words."""
        h = np.zeros((len(ids), HIDDEN), np.float32)
        out = np.empty((len(ids), WINDOW, HIDDEN), np.float32)
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            a, b = x[ids[:, t]], h @ self.p[f"U{side}"]
            gates = sigmoid(a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(a[:, 2 * HIDDEN :] + r * b[:, 2 * HIDDEN :])
            z = z * mask[:, t, None]
            if keep is not None:
                keep.append((t, h, z, r, c, b[:, 2 * HIDDEN :]))
            h = h + z * (c - h)
            out[:, t] = h
        return out

    def logits(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        live = mask.astype(np.float32)
        kept: dict[str, list | None] = {s: [] if keep is not None else None for s in "fb"}
        states = np.concatenate([self.run(s, x @ self.p[f"W{s}"] + self.p[f"c{s}"], ids, live, kept[s]) for s in "fb"], axis=2)
        weight = np.where(mask, states @ self.p["att"], np.float32(-1e9))
        weight = np.exp(weight - weight.max(axis=1, keepdims=True)) * live
        weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1e-9)
        pooled = (weight[:, None, :] @ states)[:, 0]
        if keep is not None:
            keep |= {"kept": kept, "states": states, "weight": weight, "pooled": pooled, "live": live}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gradient(self, words: Words, ids: np.ndarray, mask: np.ndarray, target: np.ndarray, left_out: np.ndarray | None = None) -> dict[str, np.ndarray | tuple[np.ndarray, np.ndarray]]:
        """Of the mean logistic loss over the windows; an embedding's is (rows, gradients). left_out marks words without their word vector."""
        p, keep, n = self.p, {}, len(ids)
        x = self.inputs(words)
        if left_out is not None:
            x[left_out, :EMBED] = 0
        delta = ((sigmoid(self.logits(x, ids, mask, keep)) - target) / n).astype(x.dtype)
        states, weight, pooled = keep["states"], keep["weight"], keep["pooled"]
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "gram")}
        g["out"], g["bias"] = pooled.T @ delta, np.array([delta.sum()], x.dtype)
        d_pooled = delta[:, None] * p["out"]
        d_score = weight * ((states - pooled[:, None]) @ d_pooled[:, :, None])[:, :, 0]
        g["att"] = d_score.reshape(-1) @ states.reshape(-1, 2 * HIDDEN)
        d_states = weight[:, :, None] * d_pooled[:, None] + d_score[:, :, None] * p["att"]
        d_x = np.zeros_like(x)
        order = np.argsort(ids.T.ravel(), kind="stable")  # the windows' words, step after step
        which = ids.T.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        for k, side in enumerate("fb"):
            d_out = d_states[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            d_h, u, d_in = np.zeros((n, HIDDEN), x.dtype), p[f"U{side}"], np.zeros((WINDOW, n, 3 * HIDDEN), x.dtype)
            for t, h, z, r, c, hu in reversed(keep["kept"][side]):
                d_h = d_h + d_out[:, t]
                live = keep["live"][:, t, None]
                raw = np.where(live > 0, z, 0)
                d_z, d_c = d_h * (c - h) * raw * (1 - raw), d_h * z * (1 - c * c)
                d_r = d_c * hu * r * (1 - r)
                d_in[t] = np.concatenate([d_z, d_r, d_c], axis=1)
                d_hu = np.concatenate([d_z, d_r, d_c * r], axis=1)
                g[f"U{side}"] += h.T @ d_hu
                d_h = d_h * (1 - z) + d_hu @ u.T
            d_proj = np.zeros((len(x), 3 * HIDDEN), x.dtype)
            d_proj[which[first]] = np.add.reduceat(d_in.reshape(-1, 3 * HIDDEN)[order], first, axis=0)
            g[f"W{side}"], g[f"c{side}"] = x.T @ d_proj, d_proj.sum(axis=0)
            d_x += d_proj @ p[f"W{side}"].T
        if left_out is not None:
            d_x[left_out, :EMBED] = 0
        g["word"] = by_row(words.word, d_x[:, :EMBED])
        g["gram"] = by_row(words.gram, (d_x[:, EMBED:] / words.roots()[:, None])[words.gram_owner])
        return g


def by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, sums of their values)."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else rows
    return rows[first], np.add.reduceat(values[order], first, axis=0) if len(rows) else values


class Adam:
    """All parameters at the same rate; of the embeddings only the rows that a step touches, which also decay a little."""

    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict) -> None:
        self.t += 1
        high, wide = 1 - 0.9**self.t, 1 - 0.99**self.t
        for k, x in self.p.items():
            at, change = g[k] if isinstance(g[k], tuple) else (slice(None), g[k])
            m = self.m[k][at] * 0.9 + 0.1 * change
            v = self.v[k][at] * 0.99 + 0.01 * change * change
            self.m[k][at], self.v[k][at] = m, v
            now = x[at] - self.rate * (m / high) / (np.sqrt(v / wide) + 1e-6)
            x[at] = now * (1 - DECAY) if isinstance(g[k], tuple) else now


class Model:
    """A fitted network with its calibration."""

    def __init__(self, texts: list[bytes], toxic: np.ndarray, seed: int = 7):
        toxic = np.asarray(toxic, np.int64)
        self.share = float(toxic.mean()) if len(toxic) else 0.0
        self.fitted = 2 <= toxic.sum() <= len(toxic) - 2
        if not self.fitted:
            return
        rng = np.random.default_rng(seed)
        words = Words(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
        starts, owner = windows(words.doc, len(texts))
        at, mask = window_words(starts, owner, words.doc, len(texts))
        ids = words.at[at] if len(words.at) else np.zeros_like(at)
        aside = np.zeros(len(texts), bool)
        for label in (0, 1):
            aside[np.flatnonzero(toxic == label)[1::6]] = True

        self.net = Network(seed)
        adam = Adam(self.net.p, RATE)
        learn = np.flatnonzero(~aside[owner])
        weigh = max(1, min(6, round(float((toxic[~aside] == 0).sum() / max(1, (toxic[~aside] == 1).sum())))))
        rounds = ROUNDS * max(1, min(6, 1500 // max(1, len(texts))))  # a small sample is read more often
        for turn in range(rounds):
            lot = rng.random(len(learn))
            if turn >= FIRST * rounds // ROUNDS:
                lot[:] += 1
                score = self._score(self.net.inputs(words), ids[learn], mask[learn])
                best = np.lexsort((score, owner[learn]))
                last = best[np.append(owner[learn][best][1:] != owner[learn][best][:-1], True)]
                lot[last] = 0
            order = np.lexsort((lot, owner[learn]))
            rank = np.empty(len(learn), np.int64)
            rank[order] = np.arange(len(learn)) - np.searchsorted(owner[learn][order], owner[learn][order], "left")
            sure = turn >= FIRST * rounds // ROUNDS
            positive = toxic[owner[learn]] == 1
            rows = np.concatenate([learn[~positive & (rank < 2)], np.repeat(learn[positive & (rank < (1 if sure else 3))], weigh if sure else max(1, weigh // 2))])
            rows = rng.permutation(rows)
            adam.rate = RATE * min(1.0, 2.0 * (1 - turn / rounds))
            for part in np.array_split(rows, max(1, len(rows) // BATCH)):
                which, local = np.unique(ids[part], return_inverse=True)
                adam.step(self.net.gradient(words.take(which), local.reshape(ids[part].shape), mask[part], toxic[owner[part]].astype(np.float32), rng.random(len(which)) < LEFT_OUT))
        rows = np.flatnonzero(aside[owner])
        top = np.full(len(texts), -np.inf, np.float32)
        np.maximum.at(top, owner[rows], self._score(self.net.inputs(words), ids[rows], mask[rows]))
        top = np.where(np.isfinite(top), top, self.net.p["bias"][0])
        self.scale, self.shift = calibrate(top[aside], toxic[aside])

    def _score(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, size: int = 2048) -> np.ndarray:
        out = [self.net.logits(x, ids[k : k + size], mask[k : k + size]) for k in range(0, len(ids), size)]
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not self.fitted:
            return np.full(n, self.share)
        words = Words(data, offsets)
        top = np.full(n, self.net.p["bias"][0], np.float32)
        starts, owner = windows(words.doc, n)
        if len(starts):
            x = self.net.inputs(words)
            proj = {s: x @ self.net.p[f"W{s}"] + self.net.p[f"c{s}"] for s in "fb"}
            peak = np.full(n, -np.inf, np.float32)
            for k in range(0, len(starts), 2048):
                at, mask = window_words(starts[k : k + 2048], owner[k : k + 2048], words.doc, n)
                np.maximum.at(peak, owner[k : k + 2048], self._projected(proj, words.at[at], mask))
            top = np.where(np.isfinite(peak), peak, top)
        return sigmoid(self.scale * top.astype(np.float64) + self.shift)

    def _projected(self, proj: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        live = mask.astype(np.float32)
        p = self.net.p
        states = np.concatenate([self.net.run(s, proj[s], ids, live) for s in "fb"], axis=2)
        weight = np.where(mask, states @ p["att"], np.float32(-1e9))
        weight = np.exp(weight - weight.max(axis=1, keepdims=True)) * live
        weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1e-9)
        return (weight[:, None, :] @ states)[:, 0] @ p["out"] + p["bias"][0]


def calibrate(top: np.ndarray, toxic: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and shift of a logistic fit of labels on logits, by damped Newton steps with a ridge."""
    x = np.stack([top.astype(np.float64), np.ones(len(top))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        q = sigmoid(x @ w)
        grad = x.T @ (q - toxic) + 0.5 * (w - [1.0, 0.0])
        hess = (x * (q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        w -= move * min(1.0, 2.0 / (np.abs(move).max() + 1e-12))
    return float(max(w[0], 1e-3)), float(w[1])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int) -> DataFrame:
    """(doc_id, text, toxic): a bounded, hash-chosen sample of labelled documents."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = docs.filter("text is not null").select("doc_id", "text")
    known = known.join(usable.select("doc_id"), "doc_id", "left_semi")  # before the limit, which only usable rows fill
    part = lambda label, most: known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = part(1, max_toxic).unionByName(part(0, max_clean)).select(F.col("doc_id").alias("_tx_id"), F.col("toxic").alias("_tx_toxic"))
    rows = usable.join(F.broadcast(chosen), usable["doc_id"] == chosen["_tx_id"])  # at most max_toxic + max_clean ids
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_tx_toxic").cast("long").alias("toxic"))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if len(b)]
    texts = [passages(t.encode()) for b in got for t in b.column(1).to_pylist()]
    toxic = np.array([x for b in got for x in b.column(2).to_pylist()], np.int64)
    yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(Model(texts, toxic))], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Trained in one task on the bounded sample; the model is a few megabytes."""
    rows = training_rows(docs, labels, max_toxic, max_clean)
    got = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(_train, "model binary").first()
    return pickle.loads(got[0]) if got else Model([], np.zeros(0, np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns but text, and `score`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in ("text", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in bw.chunks(batches, "text"):
            values = shared.value.scores(data, offsets)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in rest), pa.array(values, pa.float64())], names=[*rest, "score"])

    slim = docs.select(*rest, "text")
    return slim.mapInArrow(run, bw.extended(docs.select(*rest), "score double"))
