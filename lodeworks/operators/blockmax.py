"""Full-text top lists that leave out what can't be among them: postings in blocks of chunks with the most that a block
can add to a score.

A block is a set of neighbouring chunks. For each term in it the index holds its chunks with the term, its largest count
and its shortest text, so the sum of the terms' largest parts bounds the score of every chunk of the block. Blocks are
read by falling bounds, a few at first, then more; the k-th best score so far is a threshold, and a block whose bound is
below it is never read. The list is exactly that of reading all.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.operators.retrieval import K1, B, placed, postings, stored_stats, summed
from lodeworks.shipping import kept

#: Chunks of a block as a power of two, where the caller names none; blocks of the first two rounds (the third reads all that are left).
BLOCK_BITS, ROUNDS = 8, (16, 1024)
#: Sums of the same parts in another order differ by less than this part of themselves.
SLACK = 1e-9


class Asked(NamedTuple):
    """The top list (id, score, rank), the bounds (block, bound, n) of its blocks, and how many of them were read."""

    top: DataFrame
    bounds: DataFrame
    read: int


def part(idf: Column, tf: Column, length: Column, avgdl: Column) -> Column:
    """A term's part of a BM25 score; it grows with tf and falls with the length of the text."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avgdl))


class BlockIndex:
    """Postings (term, block, id, tf, doc_len) sorted by term and block, blocks (term, block, n, tf, doc_len), and stats.

    Tables are dealt by hashes, a frequent term to some files, and sorted, so filters on terms and blocks leave few
    row groups and pages to be read.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def write(self, chunks: DataFrame, block: Column | None = None, order: list[str] | None = None) -> BlockIndex:
        """Index chunks (id, content). block: the whole number of a chunk's block, else chunks are dealt in order (id)."""
        if block is None:
            order = order or ["id"]
            dealt = chunks.select("id", "content", *[c for c in order if c not in ("id", "content")]).repartitionByRange(*order).sortWithinPartitions(*order)
            numbered = dealt.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS))
        else:
            numbered = chunks.select("id", "content", block.cast("long").alias("block"))
        pages = {"parquet.block.size": 8 << 20, "parquet.page.row.count.limit": 4096}
        rows = placed(postings(numbered, keep=["block"]), f"{self.folder}/postings", ["term", "block"], ["id"], "overwrite", **pages)
        most = rows.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("tf"), F.min("doc_len").alias("doc_len"))
        most.sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{self.folder}/blocks")
        stored_stats(chunks, rows).write.mode("overwrite").parquet(f"{self.folder}/stats")
        return self

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def weights(self, terms: list[str]) -> DataFrame:
        """(term, idf, avgdl): a row for each term of the question that some chunk has. Counts come from the blocks."""
        stats = self._table("stats").select("n", (F.col("terms") / F.nullif(F.col("texts"), F.lit(0))).alias("avgdl"))
        df = self._table("blocks").where(F.col("term").isin(terms)).groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return df.crossJoin(F.broadcast(stats)).select("term", F.when(idf <= 0, 1e-6).otherwise(idf).alias("idf"), "avgdl")

    def ask(self, terms: list[str], k: int, rounds: tuple[int, ...] = ROUNDS) -> Asked:
        """The k chunks of largest BM25 for any of the terms, ties to the smaller id; empty for no terms.

        The driver holds the k best so far and the numbers of the blocks of a round, at most the largest of ``rounds``;
        what is left after them is joined, not listed.
        """
        schema = self._table("postings").schema
        result = f"id {schema['id'].dataType.simpleString()}, score double"
        wanted = sorted(set(terms))
        known = self.weights(wanted).collect() if wanted else []  # a row a term
        none = self.spark.createDataFrame([], "block long, bound double, n long")
        if not known:
            return Asked(self.spark.createDataFrame([], result + ", rank int"), none, 0)
        weights = F.broadcast(self.spark.createDataFrame(known, "term string, idf double, avgdl double"))
        mine = F.col("term").isin(wanted)
        most = self._table("blocks").where(mine).join(weights, "term")
        bounds = most.groupBy("block").agg(F.sum(part(F.col("idf"), F.col("tf"), F.col("doc_len"), F.col("avgdl"))).alias("bound"), F.sum("n").alias("n"))
        bounds = kept(bounds, "bounds")
        scored = self._table("postings").where(mine)
        best, read, left = [], 0, bounds
        for size in (*rounds, None):
            floor = best[k - 1].score if len(best) >= k else None
            if floor is not None:
                left = left.where(F.col("bound") * (1 + SLACK) >= floor)
            if size is not None:
                taken = left.orderBy(F.desc("bound"), "block").limit(size).collect()
                if not taken:
                    break
                rows, read = scored.where(F.col("block").isin([r.block for r in taken])), read + len(taken)
                last = taken[-1]
                left = left.where((F.col("bound") < last.bound) | ((F.col("bound") == last.bound) & (F.col("block") > last.block)))
                done = len(taken) < size
            else:
                more = left.count()
                if not more:
                    break
                rows, read, done = scored.join(left.select("block"), "block", "left_semi"), read + more, True
            sums = summed(rows.join(weights, "term"), part(F.col("idf"), F.col("tf"), F.col("doc_len"), F.col("avgdl")))
            found = self.spark.createDataFrame(best, result).unionByName(sums)  # no chunk is in two blocks
            best = found.orderBy(F.desc("score"), "id").limit(k).collect()
            if done:
                break
        top = self.spark.createDataFrame(best, result).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
        return Asked(top, bounds, read)
