"""Exact top-k inner-product search by distributed histogram selection.

Vectors become integers, floor(256 * x). For a block of queries every candidate is scored in
each pass. A pass histograms the scores that lie in each query's present range, the
histograms are summed over the cluster, and the bin that holds the kth highest score becomes
the next range, until a range is one score wide. A last pass keeps what lies above the kth value and,
of those equal to it, the smallest ids; ties are broken by id.

A task sends only the bins from its own kth highest score upwards: the cluster's kth value is at
least as high, so nothing below can matter. A block holds about `QUERY_BLOCK` queries, whatever
the table's size, so what is broadcast and collected is bounded.

Cases: vectors null, or with a null or non-finite component, take no part; a shorter vector counts as
padded with zeros. Candidates are all rows with another id than the query's; repeated rows are
candidates each. An id repeated among the queries is asked once, with its smallest vector that takes part.
Fewer than k candidates are returned whole; an empty table gives no rows. Components beyond the range
where inner products fit 62 bits raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.session import Scratch

FOUND, FOUND_TYPES = ["query_id", "rank", "vec_id", "score"], "query_id long, rank int, vec_id long, score long"
QUERY_BLOCK, ROWS, BINS, SCALE = 2048, 2048, 256, 256.0


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their components as an int matrix)."""
    lengths = np.array([-1 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    values[~np.isfinite(values)] = np.nan
    owner = np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))
    good = lengths >= 0
    good[owner[np.isnan(values)]] = False
    out = np.zeros((len(lengths), max(1, int(lengths.max(initial=0)))))
    first = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    out[owner, np.arange(len(values)) - first[owner]] = np.nan_to_num(np.floor(SCALE * values))
    return np.flatnonzero(good), out[good]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.slice(at, ROWS)
            rows, x = integers(part.column(1))
            if len(rows):
                yield part.column(0).to_numpy(zero_copy_only=False)[rows], x


def _fit(x: np.ndarray, width: int) -> np.ndarray:
    return x[:, :width] if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


class Scorer:
    """A block of queries: ids and an integer matrix."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, wide: bool):
        self.ids, self.x = ids, x.astype(np.int64) if wide else x

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Scores, a row for each query."""
        x = _fit(x, self.x.shape[1])
        return (self.x @ x.astype(self.x.dtype).T).astype(np.int64)


def _extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Largest absolute component sum and component of each task."""
    most = 0.0
    for _, x in _matrices(batches):
        most = max(most, float(np.abs(x).max(initial=0)))
    yield pa.RecordBatch.from_pydict({"most": [most]})


def _histogram(scorer, state, k: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, (low, span, width) = scorer.value, state.value
        n = len(score.ids)
        counts = np.zeros((n, BINS + 1), np.int64)
        base = np.arange(n)[:, None] * (BINS + 1)
        for ids, x in _matrices(batches):
            s = score(x) - low[:, None]
            own = score.ids[:, None] == ids[None, :]
            s[own] = -1
            bins = np.where((s < 0) | (s >= span[:, None]), 0, s // width[:, None] + 1)
            counts += np.bincount((bins + base).ravel(), minlength=n * (BINS + 1)).reshape(n, -1)
        counts = counts[:, 1:]
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        query, bin_ = np.nonzero((counts > 0) & (above < k))
        yield pa.RecordBatch.from_pydict({"query": pa.array(query, pa.int32()), "bin": pa.array(bin_, pa.int32()), "n": pa.array(counts[query, bin_])})

    return run


def _survivors(scorer, floor, k: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, least = scorer.value, floor.value
        kept: list[tuple[np.ndarray, ...]] = []
        for ids, x in _matrices(batches):
            s = score(x)
            query, at = np.nonzero((s >= least[:, None]) & (score.ids[:, None] != ids[None, :]))
            kept = [best(k, *(np.concatenate(c) for c in zip(*kept, (query, ids[at], s[query, at]), strict=True)))]
        for query, ids, s in kept:
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(score.ids[query], pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(s, pa.int64())})

    return run


def best(k: int, query: np.ndarray, ids: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
    """The first k of each query by (score falling, id rising)."""
    order = np.lexsort((ids, -s, query))
    query, ids, s = query[order], ids[order], s[order]
    place = np.arange(len(query)) - np.searchsorted(query, query, "left")
    return query[place < k], ids[place < k], s[place < k]


def search(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by `every`, against all rows."""
    spark = vectors.sparkSession
    sc = spark.sparkContext
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    rows = rows.filter("vec_id is not null and embedding is not null").filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    asked = rows.filter(F.col("vec_id") % every == 0)
    most = rows.mapInArrow(_extent, "most double").agg(F.max("most")).first()[0] or 0.0
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    scratch, written = Scratch(spark, "topk"), False
    for block in range(blocks):
        # a block is bounded by QUERY_BLOCK in expectation, not by the table
        part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).toArrow()
        if not len(part):
            continue
        good, x = integers(part.column("embedding").combine_chunks())
        ids = part.column("vec_id").to_numpy()[good]
        if not len(ids):
            continue
        reach = np.abs(x).sum(axis=1) * most
        if reach.max() >= 2.0**62:
            raise ValueError("inner products exceed 62 bits")
        scorer = sc.broadcast(Scorer(ids, x, wide=bool(reach.max() >= 2.0**52)))
        low = -np.ceil(reach).astype(np.int64) - 1
        span = 1 - 2 * low
        need = np.full(len(ids), k, np.int64)
        while (span > 1).any():
            width = -(-span // BINS)
            state = sc.broadcast((low, span, width))
            got = rows.mapInArrow(_histogram(scorer, state, k), "query int, bin int, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
            order = Window.partitionBy("query").orderBy(F.desc("bin"))
            run = got.withColumn("through", F.sum("n").over(order))
            want = spark.createDataFrame([(int(q), int(m)) for q, m in enumerate(need)], "query int, need long")
            run = run.join(F.broadcast(want), "query")  # one row a query of the block
            hit = run.filter((F.col("through") >= F.col("need")) & (F.col("through") - F.col("n") < F.col("need")))
            found = {r["query"]: r for r in hit.select("query", "bin", (F.col("through") - F.col("n")).alias("above")).collect()}
            for q in range(len(ids)):
                if q in found:
                    low[q] += found[q]["bin"] * width[q]
                    span[q] = min(width[q], span[q] - found[q]["bin"] * width[q])
                    need[q] -= found[q]["above"]
                else:  # fewer than k candidates: everything stays
                    span[q] = 1
            state.destroy()
        floor = sc.broadcast(low)
        kept = rows.mapInArrow(_survivors(scorer, floor, k), "query_id long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        kept = kept.withColumn("rank", rank).filter(F.col("rank") <= k)
        kept.select(*FOUND).write.mode("append").parquet(scratch.path("found"))  # a query is in one block
        floor.destroy()
        scorer.destroy()
        written = True
    if not written:
        return spark.createDataFrame([], FOUND_TYPES)
    return spark.read.schema(FOUND_TYPES).parquet(scratch.path("found"))
