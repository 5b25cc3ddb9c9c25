"""The corpus pipeline: five stages over ``documents``, each on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import centroid_lid, jaccard_tree, line_dedup, packing, spaced_seed
from lodeworks.llm.queries import table, vocabulary
from lodeworks.llm.shared import MADE, forget, forget_since, stored
from lodeworks.shipping import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language learned from the labelled ones; a null lang gets the predicted one."""
    ship(spark)
    known = centroid_lid.predict(docs, centroid_lid.fit(docs)).where("not rejected")
    return known.select(*[F.coalesce("lang", "lang_pred").alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs of 50 words; documents that had nothing else go."""
    ship(spark)
    out = line_dedup.dedup(docs).where((F.size("removed_runs") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    size = F.when(F.size("removed_runs") == 0, F.col("n_chars")).otherwise(F.length("text"))
    return out.select(*[size.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 of five-word shingles: that of least doc_id."""
    ship(spark)
    return jaccard_tree.keep_one(docs, k=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return spaced_seed.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens, sources in proportion.

    Workers come here after four other stages and share what memory those left, so slices and cache are small.
    """
    ship(spark)
    return packing.pack(docs, vocabulary(), slice_bytes=1 << 20, cache_words=50_000)


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("packing", pack)]

#: SQL can express none of suffix arrays, nearest centroids or tokenization; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written as Parquet and read again, then goes."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        mark = len(MADE)
        done = stored(stage(spark, docs, sf_dir), name)
        forget_since(mark, done)  # what the stage kept for itself
        forget(docs)
        docs = done
    return docs
