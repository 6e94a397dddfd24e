"""A training corpus from raw documents: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import jaccard, langid, packing, quality, queries, substrings
from ferrule.llm.shared import settle

#: Share of a text's letters that its language must label.
LEAST_SHARE = 0.5
#: Near duplicates share this percentage of their shingles of this many words.
SHINGLE, PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the weak-label quality model of these documents scores 0.5 or more; null and wordless texts go."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index('text')}"
    return quality.score(plain, quality.train(plain, text), text).filter("keep").select(*plain.columns).toDF(*names)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts of a known language that labels at least half of their letters; learns from the labelled documents that are not held out."""
    learned = docs.filter(~langid.held_out()).filter("lang IS NOT NULL AND text IS NOT NULL")
    if learned.isEmpty():
        # nothing to learn from: no language is known, so nothing can be kept for having one, and nothing is rejected
        return docs
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    found = langid.predict(plain, langid.train(learned), text_col=f"c{names.index('text')}")
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(*plain.columns).toDF(*names)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of near duplicates stays, that of the smallest id; texts without words stay all."""
    return jaccard.dedup(docs, k=SHINGLE, percent=PERCENT)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated runs of sentences and repeated passages of 50 words out of all but their first place; texts that had nothing else go."""
    names = docs.columns
    plain = docs.toDF(*[c if c in ("doc_id", "text", "n_chars") else f"c{i}" for i, c in enumerate(names)])
    kept = substrings.dedup(plain, passage=substrings.PASSAGE).filter("n_removed = 0 OR trim(BOTH FROM text) <> ''")
    if "n_chars" in names:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*plain.columns).toDF(*names)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row per piece."""
    return packing.pack(docs, queries.vocabulary()).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]

#: No SQL: two stages fit models and one encodes tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), spark)
    return STAGES[-1][1](spark, docs, sf_dir)
