"""Queries of this subpackage for __spark_entry__: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.session import ship

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm import ngram_join

    return ngram_join.join(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM d, unnest(range(1, greatest(2, len(w) - 3))) AS r(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 180 * count(*) >= 80 * (x.n + y.n)
), reach AS (
  WITH RECURSIVE r(u, v) AS (SELECT u, v FROM link UNION SELECT r.u, link.v FROM r JOIN link ON r.v = link.u) SELECT u, min(v) AS low FROM r GROUP BY u
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(reach.low, d.doc_id))::BIGINT AS component_id, coalesce(near.n, 0)::BIGINT AS n_links
FROM d LEFT JOIN (SELECT u, count(*) AS n FROM link GROUP BY u) near ON near.u = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach ON reach.u = d.doc_id
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm import quality

    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm import suffix_dedup

    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page (markup, address) and every document (its source stands for the host)."""
    from quernel.llm import langid

    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = langid.fit(docs)
    none = F.lit(None).cast("long")
    page_rows = langid.evidence_rows(pages.select(none.alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), "url", "html"), "html", langid.host_of(F.col("url")), langid.declared_language(F.col("html")))
    doc_rows = langid.evidence_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), none.alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html")), "html", F.col("url"), F.lit(""), markup=False)
    return langid.identify(page_rows.unionByName(doc_rows), model, ["doc_id", "page_id"])


def piece_model() -> str:
    """Path of the piece vocabulary; QUERNEL_PIECES names another."""
    import public_tokenizers

    return os.environ.get("QUERNEL_PIECES") or public_tokenizers.path("piece_bpe_32k.model")


def token_model() -> str:
    """Path of the tokenizer definition; QUERNEL_TOKENIZER names another."""
    import public_tokenizers

    return os.environ.get("QUERNEL_TOKENIZER") or public_tokenizers.path("word_bpe_49k.json")


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm import token_file

    return token_file.digest(table(spark, sf_dir, "documents"), token_model())


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm import pieces

    vocabulary = pieces.Vocabulary.from_model(piece_model())
    both = pieces.encode_checked(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), "n_bytes", "round_trip")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm import topk

    return topk.search(table(spark, sf_dir, "embeddings"), k=5, every=50)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s
) WHERE rank <= 5
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm import mixing

    return mixing.probabilities(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm import line_dedup

    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP9_SQL = """
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM line
), common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op7_topk": op7_topk,
        "op2_quality_rules": op2_quality_rules,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_language_id": op4_language_id,
        "op5_token_file": op5_token_file,
        "op6_sentencepiece": op6_sentencepiece,
        "op8_mixing": op8_mixing,
        "op9_line_dedup": op9_line_dedup,
        "op10_toxicity": op10_toxicity,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1_SQL, "op7_topk": OP7_SQL, "op9_line_dedup": OP9_SQL}
