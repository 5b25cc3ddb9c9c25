"""Hybrid retrieval: cosine and BM25 top lists, fused by reciprocal rank, filtered and cut to the best few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.text import index_terms
from lodeworks.functions.vectors import cosine_to, rrf

FLOOR, PER_FILE, TRUSTED_RANK, RRF_K, OVERFETCH = 0.52, 3, 5, 60, 4
K1, B = 1.2, 0.75
#: Files at most that a frequent term's postings are dealt to.
SPREAD = 8
#: A term and its repeats in a string of sorted terms; possessive, so that Java's matcher does not recurse.
RUN = r"(\S+)(?: \1(?= |$))*+"


def vector_topk(chunks: DataFrame, probe: list[float], k: int) -> DataFrame:
    """(id, score, rank): the k chunks of largest cosine; ties go to the smaller id. Reads ids and vectors only."""
    scored = chunks.select("id", cosine_to(F.col("embedding"), probe).alias("score"))
    top = scored.orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def postings(chunks: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(id, term, tf, doc_len), and the columns to keep: a row for each term of each chunk.

    Terms are counted within their chunk, so nothing is shuffled: the sorted terms are one string, of which a run of one
    term is a match, and the run's length by the term's is its count. Native functions only, as a lambda is interpreted
    for each term; no row that is made carries the chunk's terms, and the outer form of explode keeps Spark from asking
    beforehand whether there are any, which would find them all once more. ``placed`` makes the sorted table.
    """
    keep = keep or []
    terms = chunks.select("id", *keep, F.sort_array(index_terms(F.col("content"))).alias("s"))
    found = terms.select("id", *keep, F.size("s").alias("doc_len"), F.regexp_extract_all(F.array_join("s", " "), F.lit(RUN), F.lit(0)).alias("runs"))
    runs = found.select("id", *keep, "doc_len", F.explode_outer("runs").alias("run")).where("run is not null").select("id", *keep, "doc_len", "run", F.substring_index("run", " ", 1).alias("term"))
    tf = ((F.octet_length("run") + 1) / (F.octet_length("term") + 1)).cast("long")
    return runs.select("id", "term", tf.alias("tf"), "doc_len", *keep)


def placed(rows: DataFrame, path: str, order: list[str], within: list[str], mode: str = "errorifexists", **options: object) -> DataFrame:
    """Postings as a table whose files are sorted by some columns and more. A term is dealt by its hash, and by one of its
    ids' to at most ``SPREAD`` files; ranges need a sample, for which all that lies before it is made once more or stored."""
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).repartition("term", "_deal").drop("_deal")
    dealt.sortWithinPartitions(*order, *within).write.mode(mode).options(**options).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def corpus_stats(chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, the chunks, texts, those with a content, and terms, theirs in all: one row, or one for each group."""
    size = F.when(F.col("content").isNotNull(), F.size(index_terms(F.col("content"))))
    return chunks.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("terms"), F.count("content").alias("texts"))


def stored_stats(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """``corpus_stats`` of chunks whose stored postings are rows: their counts add up to the terms, so no text is split."""
    counts = chunks.agg(F.count(F.lit(1)).alias("n"), F.count("content").alias("texts"))
    return counts.crossJoin(rows.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("terms"))).select("n", "terms", "texts").coalesce(1)  # one row


def summed(rows: DataFrame, part: Column) -> DataFrame:
    """(id, score): the parts of each chunk's terms, a row a term, added in the order of the terms. A plain sum adds them as
    they come, so that equal texts may differ in the last bit and their ids no longer decide."""
    parts = F.array_sort(F.collect_list(F.struct("term", part.alias("part"))))
    return rows.groupBy("id").agg(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x["part"]).alias("score"))


def indexed_topk(index: DataFrame, stats: DataFrame, terms: list[str], k: int) -> DataFrame:
    """``bm25_topk`` from stored postings and statistics (n, avgdl): only the postings of the question's terms are read."""
    if not terms:
        return index.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    mine = index.where(F.col("term").isin(sorted(set(terms)))).select("id", "term", "tf", "doc_len")
    df = mine.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row for each term of the question
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.crossJoin(F.broadcast(stats)).select("term", F.when(idf <= 0, 1e-6).otherwise(idf).alias("idf"), "avgdl")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avgdl")))
    top = summed(mine.join(F.broadcast(weights), "term"), part).orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def _equals(term: str):
    return lambda x: x == term


def bm25_topk(chunks: DataFrame, terms: list[str], k: int) -> DataFrame:
    """(id, score, rank): the k chunks of largest BM25 for any of the terms; none for no terms.

    Inverse document frequencies that aren't positive count as 1e-6. Term counts are taken within each text, so no
    posting of another term is made or shuffled; corpus counts cover every chunk.
    """
    spark = chunks.sparkSession
    if not terms:
        return spark.createDataFrame([], "id long, score double, rank int")
    wanted = sorted(set(terms))
    with_terms = chunks.select("id", index_terms(F.col("content")).alias("t"))
    tf = [F.size(F.filter("t", _equals(w))).alias(f"tf{i}") for i, w in enumerate(wanted)]
    counted = with_terms.select("id", F.size("t").alias("doc_len"), *tf)
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))])
    some = F.lit(False)
    for i in range(len(wanted)):
        some = some | (F.col(f"tf{i}") > 0)
    score = F.lit(0.0)
    for i in range(len(wanted)):
        idf = F.ln((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        f = F.col(f"tf{i}")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("doc_len") / F.col("avgdl")))
    # stats is one row
    scored = counted.where(some).crossJoin(F.broadcast(stats)).select("id", score.alias("score"))
    top = scored.orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def fuse(vector: DataFrame, text: DataFrame, k: int = RRF_K, by: list[str] | None = None) -> DataFrame:
    """(id, vector_score, vector_rank, text_rank, fused_score, fused_pos) of two ranked lists, or of two for each ``by``.

    Equal sums keep the vector list's order first, then the text list's.
    """
    by = by or []
    v = vector.select(*by, "id", F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    t = text.select(*by, "id", F.col("rank").alias("text_rank"))
    both = v.join(t, [*by, "id"], "full_outer").withColumn("fused_score", rrf(F.col("vector_rank"), k) + rrf(F.col("text_rank"), k))
    order = Window.partitionBy(*by).orderBy(F.desc("fused_score"), F.asc_nulls_last("vector_rank"), "text_rank")
    return both.withColumn("fused_pos", F.row_number().over(order))


def trust(fused: DataFrame, floor: float = FLOOR, trusted_rank: int = TRUSTED_RANK) -> DataFrame:
    """Adds source and score (0 without a vector's) and drops hits of the text list that rank low and score low."""
    source = F.when(F.col("vector_rank").isNull(), "text").when(F.col("text_rank").isNull(), "vector").otherwise("both")
    weak = (F.col("text_rank") > trusted_rank) & (F.col("vector_score").isNull() | (F.col("vector_score") < floor))
    kept = fused.where(~F.coalesce(weak, F.lit(False)))
    return kept.withColumn("source", source).withColumn("score", F.coalesce("vector_score", F.lit(0.0)))


def rank(hits: DataFrame, k: int, floor: float = FLOOR, per_file: int = PER_FILE, pos: str = "fused_pos", by: list[str] | None = None) -> DataFrame:
    """The k best hits, or those of each ``by``: vector-only ones under the floor go, each file keeps its best few, then the best overall.

    Ties keep the order of files by first appearance, then of hits.
    """
    good = hits.where((F.col("source") != "vector") | (F.col("score") >= floor))
    by = by or []
    file = Window.partitionBy(*by, "file_path")
    good = good.withColumn("file_pos", F.min(pos).over(file))
    good = good.withColumn("in_file", F.row_number().over(file.orderBy(F.desc("score"), pos))).where(F.col("in_file") <= per_file)
    order = [F.desc("score"), F.col("file_pos"), F.col(pos)]
    top = good if by else good.orderBy(*order).limit(k)
    return top.withColumn("final_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("final_rank") <= k)


def retrieve(chunks: DataFrame, probe: list[float], terms: list[str], k: int = 6, floor: float = FLOOR, per_file: int = PER_FILE, trusted_rank: int = TRUSTED_RANK, index: tuple[DataFrame, DataFrame] | None = None, text: DataFrame | None = None) -> DataFrame:
    """The k best chunks for a question, given as a vector and terms: one lazy plan from scan to result.

    Both lists are fetched ``OVERFETCH`` times wider than asked. Only the few hits are joined with their chunks. With
    an ``index`` (stored postings and corpus statistics) the texts are not read for the text list; ``text`` is that list
    itself, as an index in blocks gives it.
    """
    wide = k * OVERFETCH
    if text is None:
        text = indexed_topk(*index, terms, wide) if index else bm25_topk(chunks, terms, wide)
    hits = trust(fuse(vector_topk(chunks.where(F.col("embedding").isNotNull()), probe, wide), text), floor, trusted_rank)
    placed = F.broadcast(hits).join(chunks.select("id", "file_path"), "id")  # at most 2 * wide rows
    return rank(placed, k, floor, per_file)


def excerpt(chunks: DataFrame, path: str, line: int) -> DataFrame:
    """The chunk of a path that starts at a line: one row or none."""
    return chunks.where((F.col("file_path") == path) & (F.col("start_line") == line)).orderBy("id").limit(1)


def budgeted(hits: DataFrame, order: Column, size: Column, most: int | Column = 12_000, by: list[str] | None = None) -> DataFrame:
    """The leading hits, or those of each ``by``, whose sizes fit a budget together; the first that doesn't ends the list."""
    w = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= most)


def missing_from_index(chunks: DataFrame, indexed: DataFrame) -> DataFrame:
    """Chunks that a derived text index lacks."""
    return chunks.join(indexed.select("id"), "id", "left_anti")
