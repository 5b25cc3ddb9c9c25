"""Change history: commits parsed from log text and churn by path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "\x1f"


def parse_log(logs: DataFrame, column: str = "log", keep: list[str] | None = None) -> DataFrame:
    """(pos, author, ts, path), and the columns to keep, from log texts whose commits begin with MARK author MARK ISO date on a line of their own.

    pos counts commits from the newest. A date that can't be read is null; blank lines are skipped.
    """
    keep = keep or []
    commits = logs.select(*keep, F.posexplode(F.split(F.concat(F.lit("\n"), F.col(column)), "\n" + MARK)).alias("pos", "block")).where("pos > 0")
    lines = F.split("block", "\r?\n")
    head = F.split(F.element_at(lines, 1), MARK)
    paths = F.filter(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x: F.trim(x) != "")
    rows = commits.select(*keep, "pos", F.element_at(head, 1).alias("author"), F.try_to_timestamp(F.trim(F.get(head, F.lit(1)))).alias("ts"), paths.alias("paths"))
    return rows.select(*keep, "pos", "author", "ts", F.explode("paths").alias("path"))


def churn(commit_files: DataFrame, path: str = "path", author: str = "author", ts: str = "ts", pos: str = "pos") -> DataFrame:
    """(path, commits, authors, last_change): the newest readable date is that of the first such commit in the log."""
    newest = F.min_by(ts, F.when(F.col(ts).isNotNull(), F.col(pos)))
    return commit_files.groupBy(F.col(path).alias("path")).agg(F.count(F.lit(1)).alias("commits"), F.count_distinct(author).alias("authors"), newest.alias("last_change"))


def since(events: DataFrame, days: int, ts: str = "ts") -> DataFrame:
    """events of the last days before the newest one; the bound is one aggregated row."""
    newest = events.agg(F.max(ts).alias("_newest"))
    return events.crossJoin(F.broadcast(newest)).where(F.col(ts) >= F.col("_newest") - F.make_dt_interval(F.lit(days))).drop("_newest")
