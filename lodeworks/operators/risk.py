"""Risk ranking: normalised ranks of complexity, nesting and churn in one score, with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.text import stem

MIN_CODE_LINES, UNTESTED = 100, 1.4
W_COMPLEXITY, W_NESTING = 0.75, 0.25


def with_norm_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with the place of value among its distinct values, from 0 to 1; 0.5 for all where there is but one.

    The distinct values are ranked, not the rows, so the one-partition window holds only those; rows are joined back.
    """
    distinct = df.select(F.col(value).alias("_v")).distinct()
    place = distinct.withColumn("_p", F.row_number().over(Window.orderBy("_v")) - 1)
    n = distinct.agg((F.count(F.lit(1)) - 1).alias("_n"))
    rank = place.crossJoin(F.broadcast(n)).select("_v", F.when(F.col("_n") <= 0, 0.5).otherwise(F.col("_p") / F.col("_n")).alias(out))
    return df.join(rank, df[value].eqNullSafe(rank["_v"]), "left").drop("_v")


def candidates(metrics: DataFrame, min_code_lines: int = MIN_CODE_LINES) -> DataFrame:
    """Files worth ranking: written by hand, no tests, not tiny."""
    return metrics.where(~F.col("is_generated") & ~F.col("is_test") & (F.col("code_lines") >= min_code_lines))


def score(complexity: Column, nesting: Column, churn: Column | None, tested: Column) -> Column:
    """Rounded half to even at three places."""
    structural = W_COMPLEXITY * complexity + W_NESTING * nesting
    base = structural if churn is None else F.sqrt(structural * churn)
    return F.bround(base * F.when(tested, 1.0).otherwise(UNTESTED), 3)


def reasons(history: bool) -> Column:
    """Why a file ranks as it does, in a fixed order."""
    found = [
        F.when(F.col("worst_method_complexity") >= 20, F.concat(F.coalesce("worst_method", F.lit("a method")), F.lit(": cyclomatic complexity "), F.col("worst_method_complexity").cast("string"), F.lit(", so as many tests to cover its branches"))),
        F.when(F.col("max_nesting") >= 6, F.concat(F.lit("nested "), F.col("max_nesting").cast("string"), F.lit(" deep"))),
        F.when(F.col("commits") >= 10, F.concat(F.lit("changed in "), F.col("commits").cast("string"), F.lit(" commits"))),
        F.when((F.col("authors") == 1) & (F.col("commits") >= 5), F.lit("touched by one person only")),
        F.when(~F.col("tested"), F.lit("no test file is named after it")),
        F.lit(None if history else "ranked on structure alone: no change history"),
    ]
    return F.array_compact(F.array(*found))


def risk(metrics: DataFrame, churn: DataFrame | None, tested: DataFrame, min_code_lines: int = MIN_CODE_LINES) -> DataFrame:
    """(path, score, …, tested, reasons) of candidate files, riskiest first by score then path.

    churn is (path, commits, authors) or None where history is not available; tested is (subject), compared without
    case to file stems.
    """
    c = candidates(metrics, min_code_lines)
    if churn is not None:
        c = c.join(churn.select("path", "commits", "authors"), "path", "left")
    else:
        c = c.withColumns({"commits": F.lit(None).cast("long"), "authors": F.lit(None).cast("long")})
    c = c.withColumns({"commits": F.coalesce("commits", F.lit(0)), "authors": F.coalesce("authors", F.lit(0))})
    subjects = tested.select(F.lower("subject").alias("_s")).distinct().withColumn("_t", F.lit(True))
    c = c.join(subjects, F.lower(stem(F.col("path"))) == F.col("_s"), "left").withColumn("tested", F.coalesce("_t", F.lit(False))).drop("_s", "_t")
    c = with_norm_rank(with_norm_rank(c, "complexity", "c_rank"), "max_nesting", "n_rank")
    if churn is not None:
        c = with_norm_rank(c, "commits", "h_rank")
    value = score(F.col("c_rank"), F.col("n_rank"), F.col("h_rank") if churn is not None else None, F.col("tested"))
    out = c.withColumn("score", value).withColumn("reasons", reasons(churn is not None))
    return out.drop("c_rank", "n_rank", "h_rank").orderBy(F.desc("score"), "path")


def without_tests(entries: DataFrame, test_folders: DataFrame) -> DataFrame:
    """entries whose path is in none of the folders (column folder), without case; the root is no folder.

    Each path's own folders are exploded and joined by equality, so no pair of tables is compared row by row.
    """
    parts = F.split(F.lower("path"), "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    inside = entries.select("path", F.explode(folders).alias("f")).join(test_folders.select(F.lower("folder").alias("f")).where("f not in ('', '.')").distinct(), "f").select("path").distinct()
    return entries.join(inside, "path", "left_anti")
