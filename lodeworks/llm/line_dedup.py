"""Line dedup with a suffix array over line ids, built by distributed prefix doubling.

Every text is a sequence of line ids (blank lines left out), 128 bits of hash each. Round k ranks the suffixes by their
first 2**k lines: their distinct values are sorted over all tasks (ranges, then sums of counts within and over the
ranges), and a suffix's rank is the place in the suffix array where the interval of its value begins. Suffixes of equal
rank are thus exactly the interval whose longest common prefix is 2**k lines or more. Round k + 1 sorts pairs of the
rank and that of the suffix 2**k lines on. An interval of one suffix has no longer repeat and leaves, so the rounds work
on repeated lines only.

A run counts when it has ``min_words`` words. A run of any length is the union of its shortest stretches of that many
words from each start and to each end, so what has to be found is the interval of longest common prefix n for each
stretch of n lines: it is named by the ranks of the stretch's first and last 2**k lines, 2**k <= n, and rounds go on
until no stretch needs a longer prefix. All but an interval's first suffix (least key, then least line) are later
copies. What is deleted is thus the union of all maximal repeated runs of min_words words, without their first copies; a
blank line goes if the lines with words before and after it do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.llm.shared import forget, quoted, small, stored, unused
from lodeworks.llm.textops import BYTE_VALUES, hash_spans, pieces, tidy, word_marks

#: Byte values of the second half of a line's id.
_SECOND = BYTE_VALUES[::-1].copy()
_LINES = "uid long, key {kind}, i int, line int, h long, h2 long, ahead int, ahead_line int, back int, back_line int"


def _lines(min_words: int):
    """A row for each line with a word: its index among those, its number in the text, its id, and the shortest
    stretches of min_words words from it (ahead) and to it (back): lines, and number of the other end's line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, off in pieces(batch.column(2)):
                ws, we = word_marks(raw, off)
                if not len(ws):
                    continue
                breaks = np.flatnonzero(raw == 10)
                # the line of a word: breaks before it, and texts before it
                line_id = np.searchsorted(breaks, ws) + np.searchsorted(off[1:], ws, "right")
                first = np.flatnonzero(np.r_[True, line_id[1:] != line_id[:-1]])
                last = np.r_[first[1:], len(ws)] - 1
                h, h2 = (hash_spans(raw, ws[first], we[last], v).view(np.int64) for v in (BYTE_VALUES, _SECOND))
                doc = np.searchsorted(off[1:], ws[first], "right")
                at = np.searchsorted(doc, np.arange(b - a + 1))
                i = np.arange(len(first)) - at[doc]
                line = np.searchsorted(breaks, ws[first]) - np.searchsorted(breaks, off[:-1])[doc]
                total = np.r_[0, np.cumsum(last - first + 1)]
                rows = np.arange(len(first))
                end = np.searchsorted(total, total[:-1] + min_words)  # words up to line `end`, left out
                ahead = np.where(end <= at[doc + 1], end - rows, 0)
                start = np.searchsorted(total, total[1:] - min_words, "right") - 1
                back = np.where((total[1:] >= min_words) & (start >= at[doc]), rows - start + 1, 0)
                own = pa.array(doc + a)
                i32 = lambda x: pa.array(x.astype(np.int32))
                yield pa.record_batch(
                    [batch.column(0).take(own), batch.column(1).take(own), i32(i), i32(line), pa.array(h), pa.array(h2), i32(ahead), i32(line[np.minimum(rows + np.maximum(ahead, 1) - 1, len(rows) - 1)]), i32(back), i32(line[rows - np.maximum(back, 1) + 1])],
                    ["uid", "key", "i", "line", "h", "h2", "ahead", "ahead_line", "back", "back_line"],
                )
        tidy()

    return run


def _prefix_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted range: the sum of counts before each row within the range, and the range's number."""
    from pyspark import TaskContext

    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(batch.num_columns - 1).to_numpy()
        within = before + np.cumsum(n) - n
        before += int(n.sum())
        yield pa.record_batch([*batch.columns, pa.array(within), pa.array(np.full(len(n), part, np.int64))], [*batch.schema.names, "within", "part"])


def ranked(suffixes: DataFrame, by: list[str]) -> DataFrame:
    """(key, uid, i, r) of those suffixes (key, uid, i, and longs ``by``) that share their ``by`` with others: r is where
    their interval of the suffix array begins."""
    groups = suffixes.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kinds = ", ".join(f"{c} long" for c in [*by, "n", "within", "part"])
    sums = stored(groups.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_prefix_sums, kinds), "intervals")
    # one row for each range
    parts = sums.groupBy("part").agg(F.sum("n").alias("total"))
    before = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    begins = sums.join(F.broadcast(before), "part").select(*by, (F.col("before") + F.col("within")).alias("r"))
    out = stored(suffixes.join(small(begins, sums.count(), 48), by).select("key", "uid", "i", "r"), "rank")
    forget(sums)
    return out


def repeated_runs(docs: DataFrame, min_words: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, uid, first_line, last_line): the maximal runs to delete, lines numbered from 0 in the text. A document is a
    (key, uid) of ``identity(docs)``: rows of equal key and text are one."""
    slim = docs.select(identity(key, text).alias("uid"), F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text"))
    lines = stored(slim.mapInArrow(_lines(min_words), _LINES.format(kind=slim.schema["key"].dataType.simpleString())), "lines")
    # lines at two places or more; partially aggregated and then joined, so a very common line is no task's alone
    place = F.xxhash64("key", "uid", "i")
    alive = lines.groupBy("h", "h2").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo != hi").select("h", "h2")
    alive = stored(alive, "repeated")
    base = stored(lines.join(small(alive, alive.count(), 32), ["h", "h2"]).dropDuplicates(["key", "uid", "i"]), "alive")
    forget(alive)
    longest = base.agg(F.greatest(F.max("ahead"), F.max("back"))).first()[0] or 1
    most = int(np.log2(longest))
    ranks = [ranked(base.select("key", "uid", "i", "h", "h2"), ["h", "h2"])]
    while len(ranks) <= most:
        step = 1 << (len(ranks) - 1)
        w = Window.partitionBy("key", "uid").orderBy("i")
        pairs = ranks[-1].withColumn("r2", F.lead("r", step).over(w)).withColumn("to", F.lead("i", step).over(w)).where(F.col("to") == F.col("i") + step)
        pairs = stored(pairs.select("key", "uid", "i", "r", "r2"), "pairs")
        ranks.append(ranked(pairs.withColumnRenamed("r", "r1"), ["r1", "r2"]))
        forget(pairs)
    every = ranks[0].withColumn("k", F.lit(0))
    for k, r in enumerate(ranks[1:], 1):
        every = every.unionByName(r.withColumn("k", F.lit(k)))
    every = every.withColumnRenamed("key", "own")
    ahead = base.where("ahead > 0").select("uid", "key", F.col("i").alias("s"), F.col("ahead").alias("n"), F.col("line").alias("a"), F.col("ahead_line").alias("b"))
    back = base.where("back > 0").select("uid", "key", (F.col("i") - F.col("back") + 1).alias("s"), F.col("back").alias("n"), F.col("back_line").alias("a"), F.col("line").alias("b"))
    level = F.floor(F.log2(F.col("n").cast("double") + 0.5)).cast("int")
    stretch = ahead.unionByName(back).dropDuplicates(["key", "uid", "s", "n"]).withColumn("k", level).withColumn("t", (F.col("s") + F.col("n") - F.pow(F.lit(2), F.col("k"))).cast("int"))
    head = every.select("own", "uid", F.col("i").alias("s"), "k", F.col("r").alias("r1"))
    tail = every.select("own", "uid", F.col("i").alias("t"), "k", F.col("r").alias("r2"))
    same = F.col("key").eqNullSafe(F.col("own"))
    met = stretch.join(head, ["uid", "s", "k"]).where(same).drop("own").join(tail, ["uid", "t", "k"]).where(same)
    named = stored(met.select("uid", "key", "s", (F.col("s") + F.col("n") - 1).alias("e"), "a", "b", "n", "r1", "r2"), "stretches")
    first = stored(named.groupBy("n", "r1", "r2").agg(F.min(F.struct("key", "uid", "s")).alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1").drop("many"), "firsts")
    later = named.join(small(first, first.count(), 64), ["n", "r1", "r2"]).where(~F.struct("key", "uid", "s").eqNullSafe(F.col("first"))).select("uid", "key", "s", "e", "a", "b")
    # lines that follow each other but for blank lines are one run, and the blank lines go along
    w = Window.partitionBy("key", "uid").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = later.withColumn("new", F.coalesce((F.col("s") > reach + 1).cast("int"), F.lit(1)))
    runs = marked.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = stored(runs.groupBy("key", "uid", "run").agg(F.min("a").alias("first_line"), F.max("b").alias("last_line")).drop("run"), "runs")
    forget(lines, base, *ranks, named, first)
    return out


def identity(key: str, text: str):
    """Tells texts of one key apart."""
    return F.xxhash64(F.col(quoted(key)), F.col(quoted(text)))


def dedup(docs: DataFrame, min_words: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with text less its later copies of repeated runs, and removed_runs: array of (first_line, last_line).

    The first copy, by key and line, stays. A text without repeats is unchanged, byte for byte; a text whose every
    line goes becomes empty. Null and empty texts stay as they are. Rows of equal key and text are one document and
    share a result; null keys are equal and come first. removed_runs is an empty array where nothing goes; a column of
    that name is replaced, all others stay whatever their names.
    """
    docs = docs.drop("removed_runs")
    runs = repeated_runs(docs, min_words, key, text)
    by_doc = runs.groupBy("key", "uid").agg(F.sort_array(F.collect_list(F.struct("first_line", "last_line"))).alias("removed_runs"))
    many = runs.count()
    own, uid_, key_ = unused(docs, "own", "uid", "key")
    by_doc = by_doc.withColumnRenamed("uid", uid_).withColumnRenamed("key", key_)
    joined = docs.withColumn(own, identity(key, text)).join(small(by_doc, many, 64), (F.col(own) == F.col(uid_)) & F.col(quoted(key)).eqNullSafe(F.col(key_)), "left")
    kept = F.filter(F.split(F.col(quoted(text)), "\n", -1), lambda x, i: ~F.exists("removed_runs", lambda r: (i >= r["first_line"]) & (i <= r["last_line"])))
    shorter = F.when(F.col("removed_runs").isNull(), F.col(quoted(text))).otherwise(F.array_join(kept, "\n"))
    none = F.array().cast("array<struct<first_line:int,last_line:int>>")
    return joined.select(*[shorter.alias(c) if c == text else F.col(quoted(c)) for c in docs.columns], F.coalesce("removed_runs", none).alias("removed_runs"))
