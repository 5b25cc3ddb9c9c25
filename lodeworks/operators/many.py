"""Retrieval of many questions at once.

Chunks are dealt to tiles by a hash of their id, questions to tiles of their own. A pair of tiles is one task's work: the
cosines are a matrix product, the text scores come from the tile's postings of the questions' terms, and only the best
few of each list leave it for each question. Those partial lists are merged by rank, fused, filtered and ranked by the
same rules as those of one question. Nothing has a row for each question and chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.operators.retrieval import FLOOR, K1, OVERFETCH, PER_FILE, TRUSTED_RANK, B, corpus_stats, fuse, postings, rank, trust
from lodeworks.shipping import kept, ship

#: Chunks and questions of a tile; bytes of a side that may be broadcast.
TILE_CHUNKS, TILE_QUESTIONS, BROADCAST_BYTES = 4096, 512, 48 << 20


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums by row, term after term, as the engine adds them: equal vectors have equal sums wherever they stand."""
    return np.add.accumulate(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _tile(k: int, avgdl: float):
    def run(chunks: pa.Table, questions: pa.Table) -> pa.Table:
        out: list[tuple] = []
        qid = questions.column("qid").to_pylist()

        def keep(q: int, kind: str, ids: np.ndarray, scores: np.ndarray) -> None:
            out.extend((qid[q], kind, i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True))

        asks = [i for i, p in enumerate(questions.column("probe").to_pylist()) if p]
        own = chunks.filter(pc.is_null(chunks.column("term")))
        if asks and len(own):
            probes = np.array([questions.column("probe")[i].as_py() for i in asks], np.float64)
            flat = own.column("embedding").combine_chunks()
            if set(pc.list_value_length(flat).to_pylist()) != {probes.shape[1]}:
                raise ValueError("vectors differ in length")
            x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, probes.shape[1])
            ids, norm, size = own.column("id").to_numpy(), np.sqrt(_sums(x * x)), np.sqrt(_sums(probes * probes))
            safe = np.where(norm > 0, norm, 1)
            near = (probes @ x.T) / safe
            for j, q in enumerate(asks):
                # the product finds who can be among the best, the sums in order say who is
                bound = np.partition(near[j], len(ids) - k)[len(ids) - k] - 1e-9 * max(size[j], 1e-300) if len(ids) > k else -np.inf
                some = np.flatnonzero(near[j] >= bound)
                exact = np.where((norm[some] > 0) & (size[j] > 0), _sums(x[some] * probes[j]) / (safe[some] * max(size[j], 1e-300)), 0.0)
                exact = np.clip(exact, -1.0, 1.0)
                top = _best(exact, ids[some], k)
                keep(q, "vector", ids[some][top], exact[top])
        posts = chunks.filter(pc.is_valid(chunks.column("term")))
        if len(posts):
            ids, place = np.unique(posts.column("id").to_numpy(), return_inverse=True)
            tf, size = posts.column("tf").to_numpy().astype(float), posts.column("doc_len").to_numpy().astype(float)
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / avgdl))
            coded = posts.column("term").combine_chunks().dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            edge = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
            spans = {t: order[edge[i] : edge[i + 1]] for i, t in enumerate(coded.dictionary.to_pylist())}
            for q, terms in enumerate(questions.column("terms").to_pylist()):
                score = np.zeros(len(ids))
                for t in sorted(terms or [], key=lambda t: t["term"]):
                    rows = spans.get(t["term"])
                    if rows is not None:
                        score[place[rows]] += t["idf"] * part[rows]
                some = np.flatnonzero(score > 0)
                top = _best(score[some], ids[some], k)
                keep(q, "text", ids[some][top], score[some][top])
        cols = list(zip(*out, strict=True)) or [()] * 4
        kinds = [questions.schema.field("qid").type, pa.string(), chunks.schema.field("id").type, pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["qid", "kind", "id", "score"])

    return run


def top_lists(chunks: DataFrame, questions: DataFrame, k: int, index: tuple[DataFrame, DataFrame] | None = None, tile_chunks: int = TILE_CHUNKS, tile_questions: int = TILE_QUESTIONS) -> DataFrame:
    """(qid, kind, id, score, rank): each question's ``k`` best chunks by cosine ('vector') and by BM25 ('text').

    chunks: id (a number), content, embedding; questions: qid, probe, terms (distinct). Ties go to the smaller id. Null or
    empty probes and null embeddings have no vector list, questions without terms no text list.
    """
    ship(chunks.sparkSession)
    posts, stats = index or (postings(chunks), corpus_stats(chunks).select("n", (F.col("terms") / F.nullif(F.col("texts"), F.lit(0))).alias("avgdl")))
    asked = questions.select("qid", F.explode("terms").alias("term"))
    mine = posts.join(asked.select("term").distinct(), "term", "left_semi").select("id", "term", "tf", "doc_len")
    corpus = stats.first()  # one row
    n, avgdl = corpus.n or 0, corpus.avgdl or 1.0
    idf = F.ln((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = mine.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", F.when(idf <= 0, 1e-6).otherwise(idf).alias("idf"))
    rated = asked.join(weights, "term").groupBy("qid").agg(F.collect_list(F.struct("term", "idf")).alias("terms"))  # a question's own terms
    rows, many = max(n, 1), max(questions.count(), 1)
    tiles, parts = -(-rows // tile_chunks), -(-many // tile_questions)
    every = lambda m, name: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(name)
    deal = lambda c, m, name: F.pmod(F.xxhash64(c), F.lit(m)).cast("int").alias(name)
    null = lambda t: F.lit(None).cast(t)
    vectors = chunks.where("embedding is not null").select("id", F.col("embedding").cast("array<double>").alias("embedding"), null("string").alias("term"), null("long").alias("tf"), null("int").alias("doc_len"))
    # an empty vector, as Arrow's writer goes over all nulls of a batch again at each row of a list column
    left = vectors.unionByName(mine.select("id", F.array().cast("array<double>").alias("embedding"), "term", F.col("tf").cast("long").alias("tf"), F.col("doc_len").cast("int").alias("doc_len")))
    left = left.select("*", deal("id", tiles, "tile"), every(parts, "part"))
    right = questions.select("qid", F.col("probe").cast("array<double>").alias("probe")).join(rated, "qid", "left")
    right = right.select("*", deal("qid", parts, "part")).select("*", every(tiles, "tile"))
    kinds = {c: t for c, t in (*questions.dtypes, *chunks.dtypes)}
    schema = f"qid {kinds['qid']}, kind string, id {kinds['id']}, score double"
    found = left.groupBy("tile", "part").cogroup(right.groupBy("tile", "part")).applyInArrow(_tile(k, float(avgdl)), schema)
    w = Window.partitionBy("qid", "kind").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def retrieve_many(chunks: DataFrame, questions: DataFrame, k: int = 6, floor: float = FLOOR, per_file: int = PER_FILE, trusted_rank: int = TRUSTED_RANK, index: tuple[DataFrame, DataFrame] | None = None, **tiles: int) -> DataFrame:
    """What ``retrieval.retrieve`` gives for each question (qid, probe, terms): its k best chunks, with qid."""
    wide = k * OVERFETCH
    lists = kept(top_lists(chunks, questions, wide, index, **tiles), "lists")  # both sides read them
    side = lambda kind: lists.where(F.col("kind") == kind).select("qid", "id", "score", "rank")
    hits = trust(fuse(side("vector"), side("text"), by=["qid"]), floor, trusted_rank)
    few = questions.count() * 2 * wide * 64 <= BROADCAST_BYTES  # at most two lists of each question
    placed = (F.broadcast(hits) if few else hits).join(chunks.select("id", "file_path"), "id")
    return rank(placed, k, floor, per_file, by=["qid"])
