"""Incremental indexing of a directory: only what changed is cut and embedded, and each commit is whole."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.embedding import Embedder, HashEmbedder, embed
from lodeworks.functions.text import content_hash, embedding_text, is_generated
from lodeworks.operators import chunking, ledger
from lodeworks.shipping import discard, scratch, ship, shuffles_freed
from lodeworks.sources.files import files
from lodeworks.sources.snapshots import Index


@dataclass
class IngestResult:
    files_read: int
    chunks_indexed: int
    elapsed_ms: int


def ingest_files(found: DataFrame, index: Index, embedder: Embedder | None = None, batch_files: int | None = None) -> IngestResult:
    """Bring an index up to date with files (path, content).

    Generated files are left out, and those indexed before are forgotten. A changed file's chunks are all replaced.
    With ``batch_files`` the work is committed in batches of about so many files, so a stopped run loses at most one.
    """
    began, spark = time.time(), found.sparkSession
    ship(spark)
    embedder = embedder or HashEmbedder()
    now = found.where(~is_generated(F.col("path"), F.col("content"))).withColumn("content_hash", content_hash(F.col("content")))
    states = ledger.diff(now.select("path", "content_hash"), index.table("ledger")).persist()
    n = {r.status: r["count"] for r in states.groupBy("status").count().collect()}
    read, made = found.count(), 0
    work = n.get("new", 0) + n.get("changed", 0)
    if not work and not n.get("vanished"):
        states.unpersist()
        return IngestResult(read, 0, int((time.time() - began) * 1000))
    batches = max(1, -(-work // batch_files)) if batch_files else 1
    for b in range(batches):
        mine = F.pmod(F.xxhash64("path"), F.lit(batches)) == b
        fresh = states.where(F.col("status").isin("new", "changed") & mine)
        # where all files are new or changed, their texts need no shuffle to be told
        todo = now.join(fresh.select("path"), "path", "left_semi") if n.get("unchanged") else now.where(F.col("path").isNotNull() & mine)
        cut = chunking.chunks(todo).withColumn("embedding", embed(embedding_text(F.col("file_path"), F.col("content")), embedder))
        place = scratch(spark, "cut")
        with shuffles_freed(spark):
            cut.write.parquet(place)
        new = spark.read.schema(cut.schema).parquet(place)
        gone = states.where((F.col("status").isin("new", "changed") & mine) | ((F.col("status") == "vanished") & F.lit(b == 0))).select("path")
        per_file = new.groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
        done = fresh.select("path", "content_hash").join(per_file, "path", "left").select("path", "content_hash", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.current_timestamp().alias("indexed_at"))
        made += new.count()
        index.replace(gone, new, done)
        discard(spark, place)
    states.unpersist()
    return IngestResult(read, made, int((time.time() - began) * 1000))


def ingest(spark: SparkSession, root: str, index_folder: str, embedder: Embedder | None = None, batch_files: int | None = None) -> IngestResult:
    """Index the source files under a directory."""
    return ingest_files(files(spark, root).select("path", "content"), Index(spark, index_folder), embedder, batch_files)
