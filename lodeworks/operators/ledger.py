"""Incremental ingestion kernels: what changed, what to replace, what to forget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """(path, status, content_hash): new, changed or unchanged for files (path, content_hash); vanished for paths that
    only the ledger has. One full outer join on the path."""
    f = files.select("path", F.col("content_hash").alias("now"))
    k = ledger.select("path", F.col("content_hash").alias("then"))
    both = f.join(k, "path", "full_outer")
    status = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "vanished").when(F.col("now") == F.col("then"), "unchanged").otherwise("changed")
    return both.select("path", status.alias("status"), F.coalesce("now", "then").alias("content_hash"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """existing with the rows of incoming put in place of those of equal key."""
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def forget(rows: DataFrame, paths: DataFrame, column: str = "file_path") -> DataFrame:
    """rows without those of the given paths."""
    return rows.join(paths.select(F.col("path").alias(column)), column, "left_anti").select(rows.columns)
