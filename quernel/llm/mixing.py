"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. A cell's weight is its number of tokens (words
`[^\\x20\\x09-\\x0D]+`) times a factor; sweeps rescale the factors until the weights' sums by source, by
language and by topic have the target shares. Documents of a cell are expected to be drawn its factor times one
scale often, with the scale set so that the expected tokens are `keep` of all. The whole part of that number is
drawn always, the rest when the uniform hash of the id lies below it, so documents of a cell that is weighted
up beyond 1 come more than once, and the expected shares are the raked ones.

Sweeps go on until every marginal is met to TOLERANCE, or, where targets are out of reach (values without tokens, cells that do not
exist), until PATIENCE sweeps have brought them no nearer; their number has no limit. So every row
has `miss`, the largest relative distance of its source's, language's and topic's share from what was
asked, and `calibrated` where that is at most MET; `report` lists the shares.

Targets are shares by value for any of the three marginals; what is not given is the present
share to the power `temper`, normalised. Values missing from a given target get no weight.
A topic column is used where there is one. Otherwise the topic is the group, of TOPICS hashed groups, that
holds most of the text's long words (LONG_WORD bytes or more; ties to the first group), or "none".

The driver sees single rows. Up to HELD_CELLS cells are raked by a single task in one job, since each job of a sweep costs the driver memory
for its plan; more cells, as from very many sources, stay in tables and are raked by joins. Both make the same sweeps and stop alike.

Cases: null source, language or topic is a value of its own ("", not a missing row); null and empty texts have no
tokens, weigh nothing and take their cell's probability; very long texts are counted whole. A null doc_id is drawn like any id. Rows
that repeat an id are drawn together. With no tokens at all every probability is 1. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm import bytewise as bw
from quernel.session import Scratch

TOPICS, LONG_WORD = 8, 6
TEMPER, KEEP, PATIENCE, TOLERANCE, SEED = 0.8, 0.8, 3, 1e-4, 17
MET = 1e-3
#: So many cells are raked by one task, in arrays; more stay in tables, and a sweep is three joins there.
HELD_CELLS = 1 << 20
DIMS = ("source", "lang", "topic")


def _measure(own_topic: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in bw.chunks(batches, "text"):
            n = len(rows)
            starts, ends, doc = bw.word_spans(data, offsets)
            keep = ends - starts >= LONG_WORD
            group = bw.range_hash(bw.prefix_hash(bw.LOWER[data]), starts[keep], ends[keep]) % np.uint64(TOPICS)
            counts = np.bincount(doc[keep] * TOPICS + group.astype(np.int64), minlength=n * TOPICS).reshape(n, TOPICS)
            topic = np.where(counts.any(axis=1), np.char.add("t", counts.argmax(axis=1).astype(str)), "none")
            column = rows.column(rows.schema.get_field_index("topic")) if own_topic else pa.array(topic.tolist(), pa.string())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), column, pa.array(bw.counts_of(doc, n))], names=["doc_id", *DIMS, "n_tokens"])

    return run


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens)."""
    own = "topic" in docs.columns
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in docs.columns else F.lit("").alias(c)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), value("source"), value("lang"), *([value("topic")] if own else []), "text")
    return slim.mapInArrow(_measure(own), "doc_id long, source string, lang string, topic string, n_tokens long")


def target_table(cells: DataFrame, dim: str, targets: dict[str, float] | None, temper: float) -> DataFrame:
    """(dim, goal): shares that add up to 1 over the values with tokens."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("sum")).filter("sum > 0")
    if targets is not None:
        given = cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in targets.items() if v > 0] or [("", 0.0)], f"{dim} string, raw double")
        raw = sums.join(given, dim).select(dim, "raw")
    else:
        raw = sums.select(dim, F.pow("sum", F.lit(temper)).alias("raw"))
    total = raw.agg(F.sum("raw")).first()[0] or 1.0
    return raw.select(dim, (F.col("raw") / total).alias("goal"))


def _sweeps(total: float, tolerance: float):  # noqa: ANN202
    """All sweeps over cells (source, lang, topic, tokens, goal_<dim>) that one task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        cells = pa.Table.from_batches(held).combine_chunks()
        tokens = cells["tokens"].to_numpy().astype(float)
        codes = [cells[dim].combine_chunks().dictionary_encode("encode").indices.to_numpy() for dim in DIMS]
        goals = [np.zeros(code.max() + 1) for code in codes]
        for dim, code, goal in zip(DIMS, codes, goals, strict=True):
            goal[code] = cells[f"goal_{dim}"].to_numpy()
        factor, least, idle = np.full(len(tokens), 1.0 / max(total, 1)), float("inf"), 0
        while True:
            most = 0.0
            for code, goal in zip(codes, goals, strict=True):
                sums = np.bincount(code, tokens * factor)
                ratio = np.divide(goal, sums, out=np.zeros(len(goal)), where=sums > 0)
                most = max(most, np.abs(ratio - 1).max(initial=0.0, where=goal > 0))
                factor *= ratio[code]
            idle = 0 if most < 0.99 * least else idle + 1
            least = min(least, most)
            if most < tolerance or idle >= PATIENCE:
                break
        for batch in cells.select([*DIMS, "tokens"]).append_column("factor", pa.array(factor)).to_batches(max_chunksize=1 << 16):
            yield batch

    return run


def rake(cells: DataFrame, goals: dict[str, DataFrame], scratch: Scratch, tolerance: float = TOLERANCE) -> DataFrame:
    """cells with `factor`, such that tokens * factor has the goals' marginals."""
    total, n = cells.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    total = total or 0
    if n <= HELD_CELLS:
        state = cells.select(*DIMS, "tokens")
        for dim in DIMS:
            state = state.join(goals[dim].withColumnRenamed("goal", f"goal_{dim}"), dim, "left").fillna(0.0, [f"goal_{dim}"])
        state = state.select(*DIMS, "tokens", *(f"goal_{dim}" for dim in DIMS)).coalesce(1)
        return scratch.stash(state.mapInArrow(_sweeps(total, tolerance), "source string, lang string, topic string, tokens long, factor double"), "raked")
    state = cells.withColumn("factor", F.lit(1.0 / max(total, 1)))
    step, least, idle = 0, float("inf"), 0
    while True:
        state = state.withColumn("off", F.lit(0.0))
        for dim in DIMS:  # each on a table: joined to its own sums, a plan of three would read the cells eight times
            sums = state.groupBy(dim).agg(F.sum(F.col("tokens") * F.col("factor")).alias("sum"))
            goal = F.coalesce(F.col("goal"), F.lit(0.0))
            ratio = F.when(F.col("sum") > 0, goal / F.col("sum")).otherwise(0.0)
            change = sums.join(goals[dim], dim, "left").select(dim, ratio.alias("ratio"), F.when(goal > 0, F.abs(ratio - 1)).otherwise(0.0).alias("miss"))
            state = state.join(change, dim).withColumn("factor", F.col("factor") * F.col("ratio")).withColumn("off", F.greatest("off", "miss")).drop("ratio", "miss")
            state = scratch.stash(state, f"step{step}")
            if step:
                scratch.drop(f"step{step - 1}")
            step += 1
        most = state.agg(F.max("off")).first()[0] or 0.0
        state = state.drop("off")
        idle = 0 if most < 0.99 * least else idle + 1
        least = min(least, most)
        if most < tolerance or idle >= PATIENCE:
            return state


def scale_for(cells: DataFrame, keep: float) -> float | None:
    """The scale at which scale * factor is expected to draw that share of the tokens; None without tokens."""
    total, weight = cells.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("factor"))).first()
    if not total:
        return None
    return keep * total / weight if weight else 0.0


def asked_shares(cells: DataFrame, dim: str, goal: DataFrame, targets: dict[str, float] | None) -> DataFrame:
    """(dim, tokens, asked, reached) of all values, those of targets that have no documents too."""
    if targets is not None:
        total = sum(v for v in targets.values() if v > 0) or 1.0
        goal = cells.sparkSession.createDataFrame([(str(k), v / total) for k, v in targets.items() if v > 0], f"{dim} string, goal double")
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("factor")).alias("reached"))
    none = F.lit(0.0)
    return sums.join(goal, dim, "full").select(dim, F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("goal", none).alias("asked"), F.coalesce("reached", none).alias("reached"))


def with_misses(cells: DataFrame, goals: dict[str, DataFrame], targets: dict[str, dict[str, float]]) -> DataFrame:
    """cells with `miss`: the largest relative distance of their three shares from what was asked."""
    out = cells.withColumn("miss", F.lit(0.0))
    for dim in DIMS:
        off = F.when(F.col("asked") > 0, F.abs(F.col("reached") / F.col("asked") - 1)).otherwise(F.col("reached"))
        shares = asked_shares(cells, dim, goals[dim], targets.get(dim)).filter("tokens > 0").select(dim, off.alias("off"))
        out = out.join(shares, dim, "left").withColumn("miss", F.greatest("miss", F.coalesce("off", F.lit(0.0)))).drop("off")
    return out


def uniform(doc_id: Column, seed: int) -> Column:
    """In [0, 1), from the id alone."""
    return F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _fitted(docs: DataFrame, targets: dict[str, dict[str, float]], temper: float, scratch: Scratch) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Measured rows, raked cells, goals."""
    rows = scratch.stash(measured(docs), "measured")
    cells = scratch.stash(rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    goals = {dim: scratch.stash(target_table(cells, dim, targets.get(dim), temper), f"goal-{dim}") for dim in DIMS}
    return rows, rake(cells, goals, scratch), goals


def probabilities(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, keep: float = KEEP, seed: int = SEED) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, factor, expected, probability, miss, calibrated, draws, selected), a row for each row of docs.

    `expected` is the expected number of draws, `draws` the number, `probability` the chance of at least one.
    """
    targets = targets or {}
    rows, fitted, goals = _fitted(docs, targets, temper, Scratch(docs.sparkSession, "mixing"))
    scale = scale_for(fitted, keep)
    expected = F.lit(1.0) if scale is None else F.col("factor") * scale
    fitted = with_misses(fitted, goals, targets).select(*DIMS, "factor", expected.alias("expected"), "miss")
    rest = F.col("expected") - F.floor("expected")
    draws = F.floor("expected").cast("int") + (uniform(F.col("doc_id"), seed) < rest).cast("int")
    drawn = rows.join(fitted, list(DIMS), "left").withColumn("draws", draws)
    return drawn.select("doc_id", *DIMS, "n_tokens", "factor", "expected", F.least(F.lit(1.0), "expected").alias("probability"), "miss", (F.col("miss") <= MET).alias("calibrated"), "draws", (F.col("draws") > 0).alias("selected"))


def report(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER) -> DataFrame:
    """(dim, value, tokens, asked, reached): the share asked of each source, language and topic and the one that draws are expected to have."""
    targets = targets or {}
    _, fitted, goals = _fitted(docs, targets, temper, Scratch(docs.sparkSession, "mixing-report"))
    parts = [asked_shares(fitted, dim, goals[dim], targets.get(dim)).select(F.lit(dim).alias("dim"), F.col(dim).alias("value"), "tokens", "asked", "reached") for dim in DIMS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def sample(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """docs' rows whose id is drawn, each as often as its id is."""
    drawn = probabilities(docs, **options).filter("selected").groupBy(F.col("doc_id").alias("_mx_id")).agg(F.max("draws").alias("_mx_draws"))
    often = docs.join(drawn, docs["doc_id"].eqNullSafe(drawn["_mx_id"])).withColumn("_mx_draw", F.explode(F.sequence(F.lit(1), "_mx_draws")))
    return often.select(*(docs[c] for c in docs.columns))
