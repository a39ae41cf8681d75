"""A training corpus from `documents`: quality rules, line dedup, near copies, mixing, piece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents, with their own values: columns of docs that are
named as an operator's result step aside while it runs. Empty tables give empty tables at every stage. Texts are whole, however long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import line_dedup, mixing, ngram_join, pieces, quality
from quernel.llm.entry import piece_model
from quernel.session import Scratch, ship


def aside(docs: DataFrame, taken: set[str]) -> tuple[DataFrame, list[Column]]:
    """docs with the columns named in `taken` renamed, and the columns that give docs' names back."""
    name = lambda c: f"_own_{c}" if c in taken else c
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return docs.select(*(quoted(c).alias(name(c)) for c in docs.columns)), [quoted(name(c)).alias(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the compression bands reject go.

    Null and empty texts fail the base rules and go. Rows are judged one by one: a null doc_id is no reason to
    go, and repeated rows stay or go together.
    """
    ship(spark)
    rows, back = aside(docs, {name for name, _ in quality.FIELDS})
    return quality.judge(rows).filter("kept").select(*back)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common lines stay in the document with the largest id; a changed text gets its new length in n_chars, if there is one.

    A null text is an empty one. Rows that repeat an id are one document. Rows with a null id lose common lines to others,
    and are no line's last holder.
    """
    rows, back = aside(docs, {"n_lines", "n_dropped"})
    out = line_dedup.dedup_lines(rows)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*back)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links connect, the document with the smallest id stays.

    Null, empty and wordless texts link with nothing and stay. Rows with a null id stay. Rows that repeat the id that stays, stay with it.
    """
    ship(spark)
    return ngram_join.keep_first(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with raked source, language and topic weights; documents of cells that are weighted up come more than once.

    Null sources and languages are values of their own. Null and empty texts weigh nothing and share their cell's chance. Rows that repeat
    an id (or have none) are drawn together.
    """
    ship(spark)
    return mixing.sample(docs).select(*docs.columns)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' piece ids, checked by decoding them: doc_id, lang, source, n_ids, ids, round_trip, a row for each row.

    Null and empty texts have no ids. Columns of docs other than these are not carried on.
    """
    ship(spark)
    both = pieces.encode_checked(docs.select("doc_id", "lang", "source", "text"), pieces.Vocabulary.from_model(piece_model()))
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("ngram_join", near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", piece_ids),
]

#: Compression, raking and piece search are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
