"""Language identification by Bayesian evidence fusion.

The posterior of a row's language multiplies four kinds of evidence:
  text      likelihood of the text's byte trigrams (naive Bayes; where the rows are pages, tags are skipped), tempered, since trigrams overlap;
  declared  the markup's language attribute, P(declared | language);
  suffix    the address's last label, P(suffix | language);
  host      a prior smoothed in levels: all rows -> registered domain (last two labels) -> host.
The text model is fitted on at most PER_LANGUAGE labelled documents of each language, chosen by hash, whole texts; their trigrams are
counted by grouped aggregation, and the driver gets sums. The other tables are grouped sums, over all rows, of the posteriors that the text
alone gives, so that a declaration or a suffix counts for as much as it agrees with texts, and a host that
publishes in one language lends its prior to its short pages. A row's own share is taken out of its host's and its
domain's sums, so that no row is evidence for itself.

Cases: null or empty texts, and those without letters, rest on the other evidence; with none, on the prior of all
rows. Null or odd addresses have no suffix and no host of their own. Declarations of no known language are
evidence as any other value. Repeated rows count as often as they occur. With no labelled document the language is
"und"; more than MAX_LANGUAGES of them raise ValueError, none is left out. Very long texts are counted whole. A tag that its row
does not close is text. No row's result depends on the rows beside it but through the grouped sums. A key named as a result makes way for it; other names
cannot clash. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm import bytewise as bw
from quernel.session import Scratch

GRAM, ROWS = 3, 1 << 18
PER_LANGUAGE, MAX_LANGUAGES = 400, 1024
TEMPERATURE = 0.25
HOST_WEIGHT, DOMAIN_WEIGHT, VALUE_WEIGHT = 20.0, 50.0, 5.0
FLOOR = 1e-9
RESULTS = ("lang", "probability", "text_lang", "declared", "suffix", "host")


def letters(data: np.ndarray) -> np.ndarray:
    """Lower-cased letters and bytes over 127; all else, and markup between < and >, is a space."""
    lower = bw.LOWER[data]
    live = ((lower >= 97) & (lower <= 122)) | (lower >= 128)
    return np.where(live, lower, np.uint8(32))


def without_markup(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """data with spaces for tags: from a < that begins a tag to the next > of the same row."""
    out = data.copy()
    opens = np.flatnonzero(data[:-1] == 60) if len(data) else np.zeros(0, np.int64)
    after = data[opens + 1] if len(opens) else opens
    opens = opens[((after | 32) >= 97) & ((after | 32) <= 122) | (after == 47) | (after == 33)]
    closes = np.flatnonzero(data == 62)
    if not len(opens) or not len(closes):
        return out
    at = np.searchsorted(closes, opens)
    end = np.where(at < len(closes), closes[np.minimum(at, len(closes) - 1)], len(data))
    closed = end < offsets[np.searchsorted(offsets, opens, "right")]
    opens, end = opens[closed], end[closed]
    depth = np.zeros(len(data) + 1, np.int32)
    np.add.at(depth, opens, 1)
    np.add.at(depth, end + 1, -1)
    out[np.cumsum(depth[:-1]) > 0] = 32
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigram, row) of every trigram that has a letter and no two spaces together."""
    text = letters(data)
    if len(text) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, c = text[:-2], text[1:-1], text[2:]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep = (row[:-2] == row[2:]) & (b != 32)
    code = (a[keep].astype(np.uint32) << 16) | (b[keep].astype(np.uint32) << 8) | c[keep]
    return ((code * np.uint32(2654435761)) >> np.uint32(14)).astype(np.int64), row[:-2][keep]


class TextModel:
    """Smoothed log-likelihoods of hashed trigrams for each language, from their counts."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        if len(languages) > MAX_LANGUAGES:
            raise ValueError(f"{len(languages)} languages; {MAX_LANGUAGES} are the most")
        self.languages = list(languages) or ["und"]
        counts = counts if len(languages) else np.zeros((1, ROWS))
        self.table = np.log((counts + 0.05) / (counts.sum(axis=1, keepdims=True) + 0.05 * ROWS)).T.astype(np.float32).copy()

    @classmethod
    def of(cls, texts: list[bytes], langs: list[str]) -> TextModel:
        languages = sorted(set(langs))
        counts = np.zeros((len(languages), ROWS))
        for text, lang in zip(texts, langs, strict=True):
            counts[languages.index(lang)] += np.bincount(grams(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0], minlength=ROWS)
        return cls(languages, counts)

    def likelihoods(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tempered log-likelihoods (row, language), the best of each row at 0."""
        found, row = grams(data, offsets)
        n = len(offsets) - 1
        out = np.zeros((n, len(self.languages)))
        at = np.searchsorted(row, np.arange(n + 1))
        some = np.flatnonzero(at[1:] > at[:-1])
        if len(some):
            out[some] = np.add.reduceat(self.table[found].astype(np.float64), at[some], axis=0)
        out *= TEMPERATURE
        return out - out.max(axis=1, keepdims=True)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in bw.chunks(batches, "text"):
        langs, which = np.unique(np.array(rows.column(rows.schema.get_field_index("lang")).to_pylist(), object), return_inverse=True)
        found, row = grams(data, offsets)
        key, n = np.unique(which[row] * ROWS + found, return_counts=True)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(langs[key // ROWS], pa.string()), "gram": pa.array(key % ROWS, pa.int32()), "n": pa.array(n, pa.int64())})


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, text): at most per_language labelled texts of each language, one for each value of the text's hash."""
    known = docs.filter("text is not null and lang is not null and lang <> ''").select("lang", "text", F.xxhash64("text").alias("order"))
    slots = known.withColumn("slot", F.pmod("order", F.lit(per_language)))
    return slots.groupBy("lang", "slot").agg(F.min_by("text", F.struct("order", "text")).alias("text")).select("lang", "text")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> TextModel:
    """The text model from labelled documents (columns text, lang)."""
    picked = Scratch(docs.sparkSession, "langid-sample").stash(sample(docs, per_language), "sample")
    languages = [r["lang"] for r in picked.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    sums = picked.mapInArrow(_gram_counts, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # ROWS sums a language at most
    counts = np.zeros((len(languages), ROWS))
    place = {lang: k for k, lang in enumerate(languages)}
    counts[[place[x] for x in sums.column("lang").to_pylist()], sums.column("gram").to_numpy()] = sums.column("n").to_numpy()
    return TextModel(languages, counts)


def declared_language(html: Column) -> Column:
    """The primary subtag of the first lang attribute of an html tag, lower-cased; "" where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def evidence_rows(rows: DataFrame, text: str, host: Column, declared: Column, markup: bool = True) -> DataFrame:
    """rows' identifying columns with declared, host, domain and suffix; without markup, texts have no tags to skip."""
    host = F.coalesce(host, F.lit(""))
    return rows.select("*", host.alias("_li_host"), F.substring_index(host, ".", -2).alias("_li_domain"), F.when(host.contains("."), F.substring_index(host, ".", -1)).otherwise("").alias("_li_suffix"), declared.alias("_li_declared"), F.col(text).alias("_li_text"), F.lit(markup).alias("_li_markup"))


def identify(rows: DataFrame, model: TextModel, keys: list[str]) -> DataFrame:
    """keys with lang, probability, text_lang, declared, suffix and host, for rows made by evidence_rows."""
    spark = rows.sparkSession
    keys = [c for c in keys if c not in RESULTS]
    scratch = Scratch(spark, "langid")
    shared = spark.sparkContext.broadcast(model)
    k = len(model.languages)
    slots = range(k)
    carried = [*keys, "_li_host", "_li_domain", "_li_suffix", "_li_declared"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in bw.chunks(batches, "_li_text"):
            marked = part.column(part.schema.get_field_index("_li_markup")).to_numpy(zero_copy_only=False)
            plain = without_markup(data, offsets)
            if not marked.all():
                plain = np.where(np.repeat(marked, np.diff(offsets)), plain, data)
            log = shared.value.likelihoods(plain, offsets)
            share = np.exp(log)
            share /= share.sum(axis=1, keepdims=True)
            flat = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in carried), flat(log), flat(share)], names=[*carried, "_li_log", "_li_share"])

    slim = rows.select(*carried, "_li_markup", "_li_text")
    texts = scratch.stash(slim.mapInArrow(run, bw.extended(slim.select(*carried), "_li_log array<double>, _li_share array<double>")), "texts")

    def sums(*by: str) -> DataFrame:
        return texts.groupBy(*by).agg(*(F.sum(F.col("_li_share")[j]).alias(f"s{j}") for j in slots)).select(*by, F.array(*(F.col(f"s{j}") for j in slots)).alias("n"))

    every = texts.agg(*(F.sum(F.col("_li_share")[j]).alias(f"s{j}") for j in slots)).first()
    whole = np.array([every[j] or 0.0 for j in slots])
    base = (whole + 1.0) / (whole.sum() + k)
    array = lambda x: F.array(*(F.lit(float(v)) for v in x))

    def likelihood(dim: str, name: str) -> DataFrame:
        """log P(value | language), a value's overall share being worth VALUE_WEIGHT rows."""
        table = sums(dim)
        size = F.aggregate("n", F.lit(0.0), lambda s, x: s + x)
        total = float(max(whole.sum(), 1.0))
        logs = F.array(*(F.log((F.col("n")[j] + VALUE_WEIGHT * size / total + FLOOR) / F.lit(float(whole[j] + VALUE_WEIGHT))) for j in slots))
        return table.select(dim, logs.alias(name))

    host, domain = sums("_li_host", "_li_domain").withColumnRenamed("n", "_li_nh"), sums("_li_domain").withColumnRenamed("n", "_li_nd")
    levels = host.join(domain, "_li_domain").select("_li_host", "_li_nh", "_li_nd")
    joined = texts.join(levels, "_li_host").join(likelihood("_li_declared", "_li_ld"), "_li_declared").join(likelihood("_li_suffix", "_li_ls"), "_li_suffix")
    rest = lambda name, j: F.greatest(F.col(name)[j] - F.col("_li_share")[j], F.lit(0.0))
    width = lambda name: F.greatest(F.aggregate(name, F.lit(0.0), lambda s, x: s + x) - 1.0, F.lit(0.0))
    own_domain = lambda j: (rest("_li_nd", j) + DOMAIN_WEIGHT * F.lit(float(base[j]))) / (width("_li_nd") + DOMAIN_WEIGHT)
    has_host = F.col("_li_host") != ""
    prior = lambda j: F.when(has_host, (rest("_li_nh", j) + HOST_WEIGHT * own_domain(j)) / (width("_li_nh") + HOST_WEIGHT)).otherwise(F.lit(float(base[j])))
    known = lambda c, name, j: F.when(F.col(c) != "", F.col(name)[j]).otherwise(0.0)
    scores = F.array(*(F.col("_li_log")[j] + F.log(prior(j)) + known("_li_declared", "_li_ld", j) + known("_li_suffix", "_li_ls", j) for j in slots))
    scored = joined.withColumn("_li_score", scores).withColumn("_li_top", F.array_max("_li_score"))
    names = array_of(model.languages)
    pick = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    mass = F.aggregate(F.transform("_li_score", lambda x: F.exp(x - F.col("_li_top"))), F.lit(0.0), lambda s, x: s + x)
    silent = F.array_max("_li_share") - F.array_min("_li_share") < 1e-12
    return scored.select(*keys, pick(F.col("_li_score")).alias("lang"), (1.0 / mass).alias("probability"), F.when(silent & (F.lit(k) > 1), F.lit(None)).otherwise(pick(F.col("_li_share"))).alias("text_lang"), F.col("_li_declared").alias("declared"), F.col("_li_suffix").alias("suffix"), F.col("_li_host").alias("host"))


def array_of(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))
