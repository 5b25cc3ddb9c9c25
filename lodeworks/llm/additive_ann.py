"""Approximate nearest neighbours by additive quantisation.

A vector's direction is coded as a sum of one codeword from each of several full-dimensional codebooks; its norm, of any
finite size, goes to the stored scale. Codebooks are fitted one
after the other on the residuals of a bounded sample (``train_rows``, least hash first) and then refitted in turn,
given the others; encoding keeps the best ``beam`` partial sums. The index holds every vector: its codes and the norm of
the vector over the norm of the sum. A query scores codes by lookup tables of its inner products with the codewords, scaled by the
stored norms, and the ``shortlist`` best of each tile of the index are ranked again on the original vectors.

The index is dealt to lists of about ``list_rows`` vectors by nearest coarse centroid. A query goes to the lists whose
centroids it has the largest inner products with. How many lists that is, is measured: ``probe_queries`` queries, those of
least hash, go to all lists, and all others then go to as many as hold ``probe_recall`` of what those found. Where vectors
have no clusters, that is nearly all lists; where they have, the work grows far less than with the square of the rows.
There are at most an eighth as many lists as sampled vectors (1,536 by default): beyond 25 million vectors lists grow.

Lists are cut into tiles of at most ``tile_rows`` vectors and ``query_rows`` queries: a tile is what a task holds. Queries
and vectors meet there by a shuffle, so nothing that grows with the input passes through the driver or is broadcast.

Equal vectors are coded once, as a class; a class's least ``k`` + 1 ids, all that a result can hold, come back after
the search, so many copies of one vector neither fill a shortlist nor lose a place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.llm.shared import quoted, repeats, stored

_ROWS = 2048


class Codebooks:
    """Codewords (books x words x dims); the inner products among them are made where they are needed."""

    def __init__(self, words: np.ndarray):
        m, k, d = words.shape
        self.words = words
        self.flat = words.reshape(m * k, d)
        self.gram = self.flat @ self.flat.T
        self.square = np.einsum("ij,ij->i", self.flat, self.flat)

    def __reduce__(self):
        return Codebooks, (self.words,)

    def encode(self, x: np.ndarray, beam: int = 8) -> np.ndarray:
        """Codes (rows x books) by beam search: |x - sum|^2 of all extensions of the best partial sums."""
        m, k, _ = self.words.shape
        out = np.empty((len(x), m), np.uint16)
        for at in range(0, len(x), 256):
            part = x[at : at + 256]
            dot = part @ self.flat.T
            codes = np.zeros((len(part), 1, 0), np.int64)
            cost = np.zeros((len(part), 1))
            for j in range(m):
                step = self.square[j * k : (j + 1) * k] - 2 * dot[:, j * k : (j + 1) * k]
                every = cost[:, :, None] + step[:, None, :]
                for i in range(j):
                    every += 2 * self.gram[codes[:, :, i] + i * k, j * k : (j + 1) * k]
                flat = every.reshape(len(part), -1)
                b = min(beam, flat.shape[1])
                best = np.argpartition(flat, b - 1, axis=1)[:, :b]
                cost = np.take_along_axis(flat, best, 1)
                codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], 1), (best % k)[:, :, None]], 2)
            out[at : at + 256] = codes[np.arange(len(part)), cost.argmin(1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[j][codes[:, j]] for j in range(len(self.words)))


def train(x: np.ndarray, books: int = 16, words: int = 256, rounds: int = 8, refine: int = 2, seed: int = 3) -> Codebooks:
    """Residual k-means, then rounds of encoding and of refitting each codebook given the others."""
    rng, rest = np.random.default_rng(seed), x.astype(np.float32).copy()
    k, out = min(words, len(x)), []
    for _ in range(books):
        c = rest[rng.choice(len(rest), k, replace=False)]
        for _ in range(rounds):
            own = (rest @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
            n = np.bincount(own, minlength=k)
            order = np.argsort(own, kind="stable")
            used = np.flatnonzero(n)
            c[used] = np.add.reduceat(rest[order], np.r_[0, np.cumsum(n[used])[:-1]]) / n[used, None]
            if len(used) < k:
                c[n == 0] = rest[rng.choice(len(rest), k - len(used))]
        own = (rest @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        rest -= c[own]
        out.append(c)
    book = np.array(out)
    for _ in range(refine):
        codes = Codebooks(book).encode(x, 4)
        rest = x - sum(book[j][codes[:, j]] for j in range(books))
        for j in range(books):  # each codebook in turn becomes the mean of what the others leave to it
            rest += book[j][codes[:, j]]
            n = np.bincount(codes[:, j], minlength=k)
            order = np.argsort(codes[:, j], kind="stable")
            used = np.flatnonzero(n)
            book[j][used] = np.add.reduceat(rest[order], np.r_[0, np.cumsum(n[used])[:-1]]) / n[used, None]
            rest -= book[j][codes[:, j]]
    return Codebooks(book)


def usable(vector: Column, dims: int | None = None) -> Column:
    """Is this a vector that takes part: not null or empty, all components finite, not zero (and of ``dims`` dims)?"""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    ok = vector.isNotNull() & finite & some
    return F.coalesce(ok & (F.size(vector) == dims) if dims else ok, F.lit(False))


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in single precision, norms in double) of vectors that aren't zero, whatever their size."""
    most = np.abs(x).max(1, initial=0)
    part = x / np.where(most > 0, most, 1)[:, None]
    size = np.maximum(np.linalg.norm(part, axis=1), 1e-300)
    with np.errstate(over="ignore"):
        norm = np.minimum(most * size, np.finfo(np.float64).max)
    return (part / size[:, None]).astype(np.float32), norm


def coarse(x: np.ndarray, lists: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Centroids of the lists: k-means by direction on a sample."""
    rng = np.random.default_rng(seed)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    c = unit[rng.choice(len(unit), min(lists, len(unit)), replace=False)]
    for _ in range(rounds):
        own = (unit @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, unit)
        empty = np.linalg.norm(total, axis=1) < 1e-9
        total[empty] = unit[rng.choice(len(unit), int(empty.sum()))]
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def _coded(shared, beam: int, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, centres = shared.value
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                part = batch.slice(at, _ROWS)
                x = _matrix(part.column(1), dims)
                unit, norm = directions(x)
                codes = books.encode(unit, beam)
                sums = np.linalg.norm(books.decode(codes), axis=1)
                with np.errstate(over="ignore"):
                    scale = np.minimum(norm / np.maximum(sums, 1e-12), np.finfo(np.float64).max)
                own = (unit @ centres.T).argmax(1)
                yield pa.record_batch([part.column(0), part.column(1), pa.array([c.tobytes() for c in codes.astype("<u2")], pa.binary()), pa.array(scale, pa.float64()), pa.array(own.astype(np.int32))], ["id", "vector", "codes", "scale", "list"])

    return run


def _probes(shared, dims: int, probes: int):
    """A row for each query and each of its lists: probe numbers them from 0, the most promising first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, centres = shared.value
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                part = batch.slice(at, _ROWS)
                near = np.argsort(-(directions(_matrix(part.column(1), dims))[0] @ centres.T), 1, kind="stable")[:, :probes]
                own = pa.array(np.repeat(np.arange(len(part)), near.shape[1]))
                yield pa.record_batch([part.column(0).take(own), part.column(1).take(own), pa.array(near.ravel().astype(np.int32)), pa.array(np.tile(np.arange(near.shape[1], dtype=np.int32), len(part)))], ["id", "vector", "list", "probe"])

    return run


def _tile(shared, dims: int, k: int, shortlist: int, share: float):
    """The best k classes of a tile for each of its queries: table scores, then exact ones."""

    def run(tile: pa.Table) -> pa.Table:
        words = shared.value[0].words
        first = words.reshape(-1, dims).astype(np.float32)
        asks = tile.column("codes").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        rows, queries = tile.filter(pa.array(~asks)), tile.filter(pa.array(asks))
        none = pa.table({"query_id": pa.array([], pa.int64()), "class_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "probe": pa.array([], pa.int32())})
        if not len(rows) or not len(queries):
            return none
        ids, x = rows.column("id").to_numpy(), _matrix(rows.column("vector").combine_chunks(), dims)
        columns = np.ascontiguousarray(np.frombuffer(b"".join(rows.column("codes").to_pylist()), "<u2").reshape(-1, len(words)).T)
        scale = rows.column("scale").to_numpy()
        qid, q, probe = queries.column("id").to_numpy(), _matrix(queries.column("vector").combine_chunks(), dims), queries.column("probe").to_numpy()
        unit = directions(q)[0]
        few = min(max(shortlist, int(share * len(ids))), len(ids))
        found = []
        for i in range(len(q)):
            table = (first @ unit[i]).reshape(len(words), -1)
            s = table[0][columns[0]]
            for j in range(1, len(words)):
                s += table[j][columns[j]]
            s = s * scale
            near = np.argpartition(-s, few - 1)[:few] if few < len(s) else np.arange(len(s))
            exact = x[near] @ q[i]
            best = np.lexsort((ids[near], -exact))[:k]
            found.append((np.full(len(best), qid[i]), ids[near[best]], exact[best], np.full(len(best), probe[i], np.int32)))
        return pa.table(dict(zip(("query_id", "class_id", "score", "probe"), (pa.array(np.concatenate(c)) for c in zip(*found, strict=True)), strict=True)))

    return run


def search(vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", books: int = 16, words: int = 256, beam: int = 8, shortlist: int = 200, share: float = 0.02, train_rows: int = 12288, list_rows: int = 1 << 14, most_lists: int = 4096, probe_queries: int = 256, probe_recall: float = 0.98, tile_rows: int = 1 << 14, query_rows: int = 1 << 12) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each row where ``queries``.

    A query's own row is no candidate; rows that repeat its id are one row with it, that of least hash of the vector.
    Vectors that are null, empty or zero, or that hold a null or a non-finite component, take no part, nor do those of
    another length than the most common one (ties: the shorter). Null ids take no part. Equal scores go to the smaller id.

    Each tile ranks its ``shortlist`` best, or its ``share`` if that is more, on the original vectors; so what is ranked
    again grows with the data.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    slim = vectors.select(F.col(quoted(key)).cast("long").alias("id"), F.col(quoted(vector)).cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    common = slim.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], schema)
    dims = common.d
    # 128 bits of hash tell vectors apart
    slim = slim.where(F.size("vector") == dims).withColumn("same", F.struct(F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(1), "vector").alias("b")))
    rows = slim.groupBy("id").agg(F.min(F.struct("same", "vector")).alias("v"), F.max("asks").alias("asks")) if repeats(slim, "id") else slim.select("id", F.struct("same", "vector").alias("v"), "asks")
    rows = rows.select("id", "v.same", "v.vector", "asks")
    w = Window.partitionBy("same").orderBy("id")
    # the least k + 1 ids of each class; the group limit drops the rest before the shuffle
    heads = rows.select("id", "same", "vector").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    heads = stored(heads.withColumn("class_id", F.min("id").over(Window.partitionBy("same"))).drop("same"), "classes")
    classes = heads.where("r = 1").select("id", "vector")
    many = classes.count()
    drawn_share = min(1.0, 1.3 * train_rows / max(many, 1))
    drawn = classes.select(F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("h"), "id", "vector", F.array_max(F.transform("vector", F.abs)).alias("most")).where(F.col("h") <= int(drawn_share * (1 << 30)))
    drawn = drawn.select("h", "id", F.transform("vector", lambda x: x / F.col("most")).cast("array<float>").alias("v"))
    sample = sorted((r.h, r.id, r.v) for r in drawn.collect())[:train_rows]
    sample = directions(np.array([x[2] for x in sample], np.float64).reshape(len(sample), dims))[0]
    lists = max(1, min(most_lists, many // list_rows, len(sample) // 8))
    model = spark.sparkContext.broadcast((train(sample, books, words), coarse(sample, lists)))
    index = stored(classes.mapInArrow(_coded(model, beam, dims), "id long, vector array<double>, codes binary, scale double, list int"), "index")
    asked = stored(rows.where("asks").select("id", "vector"), "queries")
    parts = lambda n, most: (F.floor((F.col(n) - 1) / most) + 1).cast("int")
    sizes = index.groupBy("list").agg(F.count(F.lit(1)).alias("n")).select("list", parts("n", tile_rows).alias("parts"))

    def scan(some: DataFrame, probes: int) -> DataFrame:
        to = stored(some.mapInArrow(_probes(model, dims, probes), "id long, vector array<double>, list int, probe int"), "probes")
        plan = F.broadcast(to.groupBy("list").agg(F.count(F.lit(1)).alias("n")).select("list", parts("n", query_rows).alias("asks")).join(sizes, "list"))  # most_lists rows at most
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        left = index.join(plan, "list").select("list", mine("parts").alias("part"), every("asks").alias("ask"), "id", "vector", "codes", "scale", F.lit(None).cast("int").alias("probe"))
        right = to.join(plan, "list").select("list", every("parts").alias("part"), mine("asks").alias("ask"), "id", "vector", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("scale"), "probe")
        return left.unionByName(right).groupBy("list", "part", "ask").applyInArrow(_tile(model, dims, k + 1, shortlist, share), "query_id long, class_id long, score double, probe int")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "class_id")
    probes = lists
    if lists > 1:
        n = max(asked.count(), 1)
        test = asked.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) <= int(min(1.0, probe_queries / n) * (1 << 30)))
        top = scan(test, lists).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
        held = {r.probe: r.n for r in top.groupBy("probe").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each list at most
        if held:
            up = np.cumsum([held.get(p, 0) for p in range(lists)])
            probes = int(np.searchsorted(up, probe_recall * up[-1])) + 1
    found = scan(asked, probes)
    near = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n", "probe")
    wide = near.join(heads.select("class_id", F.col("id").alias("vec_id")), "class_id").where("vec_id != query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return wide.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
