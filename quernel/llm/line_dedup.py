"""Line dedup with levelled sorted runs of line hashes (DataFrame functions only).

A line's key is the line stripped of `[\\x20\\x09-\\x0D]` at both ends, with A-Z
lower-cased. A key of at least `min_chars` code points found in at least
`min_docs` documents loses all its lines except in the largest doc_id that holds it.

The store is a log-structured set of runs. A run is a Parquet table sorted by
(h1, h2) that holds, for each key hash, how many documents of its batches have it
and the largest of their ids. Documents arrive in batches of falling doc_id; a batch's
keys are merge-anti-joined with the runs' settled keys (those with `min_docs`
documents already: their largest id is known and their count can no longer matter)
and what is left becomes a new run of level 0. When a level has `fanout` runs, they are
merged into one run of the next level, and after the last batch into a single run.

Cases: null or empty text is one empty line. A null doc_id belongs to no document: its
lines count nowhere and go if their key goes. Rows that repeat a doc_id count as one
document. An empty table gives an empty table. Other columns are kept as they are; internal
columns have the prefix `_ld_`. Keys are compared by 128 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.session import Scratch

STRIPPED = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 4, 2
HASH = ["_ld_h1", "_ld_h2"]


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; plain ASCII texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text hash, array of (position, h1, h2)) for the lines with long enough keys."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = lambda line: F.btrim(line, F.lit(STRIPPED))
    lines = F.transform(
        F.split(ascii_lower(text), "\n"),
        lambda line, at: F.struct(at.alias("at"), F.char_length(key(line)).alias("n"), F.xxhash64(key(line)).alias("h1"), F.xxhash64(F.lit(1), key(line)).alias("h2")),
    )
    return docs.select(
        F.col("doc_id").alias("_ld_doc"),
        F.xxhash64(text).alias("_ld_text"),
        F.transform(F.filter(lines, lambda x: x["n"] >= min_chars), lambda x: F.struct(x["at"].alias("at"), x["h1"].alias("h1"), x["h2"].alias("h2"))).alias("_ld_keys"),
    ).filter(F.size("_ld_keys") > 0)


class LineRuns:
    """Levelled sorted runs of (h1, h2, documents, largest doc_id)."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.scratch = Scratch(spark, "line-runs")
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[tuple[str, DataFrame]]] = []
        self.written = 0

    def merged(self, runs: list[DataFrame] | None = None) -> DataFrame | None:
        """One row a key over the given runs, or over all."""
        runs = [run for level in self.levels for _, run in level] if runs is None else runs
        if not runs:
            return None
        all_rows = runs[0]
        for run in runs[1:]:
            all_rows = all_rows.unionByName(run)
        return all_rows if len(runs) == 1 else all_rows.groupBy(*HASH).agg(F.sum("_ld_n").alias("_ld_n"), F.max("_ld_last").alias("_ld_last"))

    def _write(self, run: DataFrame, level: int) -> None:
        name = f"level{level}-run{self.written}"
        self.written += 1
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, self.scratch.stash(run.sortWithinPartitions(*HASH), name)))

    def add(self, batch: DataFrame) -> None:
        """Anti-join a batch's (h1, h2, doc) rows with the settled keys and add the rest as a run."""
        fresh = batch.groupBy(*HASH, "_ld_doc").agg(F.lit(1).alias("_ld_one")).groupBy(*HASH).agg(F.count("_ld_one").alias("_ld_n"), F.max("_ld_doc").alias("_ld_last"))
        known = self.merged()
        if known is not None:
            fresh = fresh.join(known.filter(F.col("_ld_n") >= self.min_docs).select(*HASH).hint("merge"), HASH, "left_anti")
        self._write(fresh, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        old = self.levels[level]
        self.levels[level] = []
        self._write(self.merged([run for _, run in old]), level + 1)
        self.scratch.drop(*(name for name, _ in old))

    def single(self) -> DataFrame | None:
        """All levels as one sorted run."""
        runs = [x for level in self.levels for x in level]
        if len(runs) > 1:
            self.levels = [[] for _ in self.levels]
            self._write(self.merged([run for _, run in runs]), len(self.levels))
            self.scratch.drop(*(name for name, _ in runs))
            runs = self.levels[-1]
        return runs[0][1] if runs else None


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """(doc, text hash, sorted array of dropped line positions)."""
    spark = docs.sparkSession
    runs = LineRuns(spark, min_docs)
    keys = runs.scratch.stash(keyed_lines(docs, min_chars), "keys")
    low, high = keys.agg(F.min("_ld_doc"), F.max("_ld_doc")).first()
    lines = keys.select("_ld_doc", "_ld_text", F.inline("_ld_keys").alias("_ld_at", *HASH))
    if high is not None:
        step = -(-(high - low + 1) // batches)
        top = high
        while top >= low:
            batch = lines.filter((F.col("_ld_doc") <= top) & (F.col("_ld_doc") > top - step))
            runs.add(batch.select(*HASH, "_ld_doc"))
            top -= step
    counted = runs.single()
    if counted is None:
        counted = lines.select(*HASH, F.lit(0).cast("long").alias("_ld_n"), F.col("_ld_doc").alias("_ld_last")).limit(0)
    common = counted.filter(F.col("_ld_n") >= min_docs)
    return (
        lines.join(common, HASH)
        .filter(~F.col("_ld_doc").eqNullSafe(F.col("_ld_last")))
        .groupBy("_ld_doc", "_ld_text")
        .agg(F.array_sort(F.collect_set("_ld_at")).alias("_ld_drop"))
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """docs with `text` rebuilt from the kept lines, plus n_lines (before dropping) and n_dropped."""
    drops = dropped_lines(docs, min_chars, min_docs, batches)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_ld_drop")  # by hash: linear, however many lines go
    parts = F.array(F.struct(lines.alias("lines"), stay.alias("stay")))  # as a lambda's variable, so that a text is split once
    joined_lines = F.transform(parts, lambda x: F.array_join(F.transform(x["stay"], lambda at: F.get(x["lines"], at)), "\n"))[0]
    kept = F.when(F.col("_ld_drop").isNotNull(), joined_lines).otherwise(text)
    rows = docs.withColumn("_ld_key", F.xxhash64(text))
    joined = rows.join(drops, rows["doc_id"].eqNullSafe(drops["_ld_doc"]) & (rows["_ld_key"] == drops["_ld_text"]), "left")
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    return joined.select(
        *rest,
        kept.alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("_ld_drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
