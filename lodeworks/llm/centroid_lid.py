"""Language ID by nearest centroid.

A text becomes a TF-IDF vector of hashed letter n-grams of one to three letters, of unit length. Each language has
several centroids, found by spherical k-means on a bounded sample of its labelled rows. A text takes the language of
the centroid of largest cosine; it is rejected where that cosine is far below those of training texts of its length:
a short text shares few n-grams with any centroid, so the bar is a function of the number of n-grams, drawn through a low
quantile of the cosines of sampled rows and of excerpts of them.

Document frequencies and label counts cover every training row; only the k-means sample is bounded
(``sample_per_language`` and ``sample_rows``, least hash first). Prediction reads whole texts in one pass without a
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from lodeworks.llm.shared import quoted, small
from lodeworks.llm.textops import tidy

BUCKETS = 1 << 12
#: The bar is this part of this quantile of the cosines of training texts of equal length.
BAR_SHARE, BAR_QUANTILE = 0.7, 0.01
#: Fewest training texts of a length (a power of two of n-grams) for a quantile.
_BAND = 30
_ROWS = 128
_CHARS = 1 << 17


def _letters() -> np.ndarray:
    """For each code point: is it a letter (general category L)?"""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


_IS_LETTER: list[np.ndarray] = []


def gram_counts(texts: list[str | None]) -> np.ndarray:
    """Counts (texts x BUCKETS) of the lower-cased letter n-grams, with word ends, of whole texts."""
    if not _IS_LETTER:
        _IS_LETTER.append(_letters())
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for row, text in enumerate(texts):
        text = (text or "").lower()  # as a whole: lower case can depend on what is near, and be longer
        tail = np.zeros(0, np.int64)
        for at in range(0, len(text), _CHARS):
            c = np.frombuffer(text[at : at + _CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)
            c = np.where(_IS_LETTER[0][c], c, 0).astype(np.int64)
            before = np.r_[tail[-1] if len(tail) else 1, c[:-1]]
            c = c[(c > 0) | (before > 0)]  # a run of other characters counts as one end of word
            # the two codes before go along, so that no n-gram is lost at a cut; they were counted
            old, c = len(tail), np.concatenate([tail, c])
            tail = c[-2:]
            if len(c) == old:
                continue
            one = c[old:]
            two = c[:-1] * 1_000_003 + c[1:]
            three = two[:-1] * 1_000_003 + c[2:]
            grams = np.concatenate([one[one > 0] * 2 + 1, two[max(old - 1, 0) :] * 4 + 2, three[max(old - 2, 0) :] * 8 + 4])
            grams = (grams * -7046029254386353131) >> 52 & (BUCKETS - 1)
            out[row] += np.bincount(grams, minlength=BUCKETS)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """Fitted languages: idf by bucket and unit centroids with the index of their language."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    of: np.ndarray
    #: The bar's corners: log2 of the number of n-grams, and the cosine.
    lengths: np.ndarray = field(default_factory=lambda: np.zeros(1))
    bars: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def bar(self, grams: np.ndarray) -> np.ndarray:
        """Least cosine that is near, for texts of so many n-grams."""
        return np.interp(np.log2(np.maximum(grams, 1)), self.lengths, self.bars)

    def calibrate(self, grams: np.ndarray, cosine: np.ndarray) -> None:
        """Set the bar from texts of the languages; lengths of too few texts are left out, and a text of one n-gram is
        always near."""
        band = np.log2(np.maximum(grams, 1)).round()
        at = [b for b in np.unique(band) if (band == b).sum() >= _BAND]
        if at:
            low = [BAR_SHARE * float(np.quantile(cosine[band == b], BAR_QUANTILE)) for b in at]
            self.lengths, self.bars = np.r_[-1.0, at], np.r_[0.0, low]
        elif len(cosine):
            self.lengths, self.bars = np.array([0.0, np.log2(np.median(grams) + 2)]), np.array([0.0, BAR_SHARE * float(cosine.min())])

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def nearest(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest language, its cosine and the number of n-grams in the text."""
        if not self.languages:
            return np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts))
        counts = gram_counts(texts)
        cos = self.vectors(counts) @ self.centroids.T
        best = cos.argmax(1)
        return self.of[best], np.clip(cos[np.arange(len(texts)), best], 0, 1).astype(float), counts.sum(1)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        col = batch.column(0)
        for at in range(0, len(col), _ROWS):
            seen += (gram_counts(col.slice(at, _ROWS).to_pylist()) > 0).sum(0)
        n += len(col)
    tidy()
    if n:
        yield pa.record_batch({"bucket": np.arange(-1, BUCKETS), "df": np.r_[n, seen]})


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, others start far from those before."""
    k = min(k, len(x))
    c = [x.mean(0)]
    far = 1 - x @ (c[0] / max(np.linalg.norm(c[0]), 1e-9))
    for _ in range(1, k):
        p = np.maximum(far, 0) + 1e-9
        c.append(x[rng.choice(len(x), p=p / p.sum())])
        far = np.minimum(far, 1 - x @ c[-1])
    c = np.array(c)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        own = (x @ c.T).argmax(1)
        for j in range(k):
            if (own == j).any():
                c[j] = x[own == j].mean(0)
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def fit(train: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_per_language: int = 600, sample_rows: int = 60_000, clusters: int = 6, rounds: int = 8, seed: int = 7) -> Model:
    """Fit on rows with a label and a text; ``train`` holds nothing else that may be learned from.

    Of each language at most ``sample_per_language`` rows, and of all languages about ``sample_rows``, are gathered for
    k-means: those of least hash of key and text, each once however often it is repeated, so they are a fair sample at
    any size. The model holds ``clusters`` vectors a language. Labels without any letter in their texts are learned too
    but never predicted for such texts. An empty table gives a model without languages.
    """
    rows = train.where(F.col(quoted(text)).isNotNull() & F.col(quoted(lang)).isNotNull()).select(F.xxhash64(F.col(quoted(key)), F.col(quoted(text))).alias("k"), F.col(quoted(text)).alias("t"), F.col(quoted(lang)).cast("string").alias("l"))
    freq = {r.bucket: r.df for r in rows.select("t").mapInArrow(_frequencies, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()}
    if not freq:
        return Model([], np.zeros(BUCKETS), np.zeros((0, BUCKETS)), np.zeros(0, int))
    n = freq.pop(-1)
    df = np.array([freq[b] for b in range(BUCKETS)])
    idf = np.log((1 + n) / (1 + df)) + 0.05
    # thinned by hash to about twice the bound first, so that no language's rows meet in one task
    many = rows.groupBy("l").count()
    languages = many.count()
    most = max(1, min(sample_per_language, sample_rows // languages))
    part = F.pmod(F.col("k"), F.lit(1 << 30))
    few = rows.join(small(many, languages, 64), "l").where(part < F.lit(2.0 * most) / F.col("count") * (1 << 30)).select("k", "l").distinct()
    ids = few.select("k", "l", F.row_number().over(Window.partitionBy("l").orderBy(part, "k")).alias("r")).where(F.col("r") <= most).select("k", "l")
    # bounded: sample_rows ids
    drawn = rows.join(F.broadcast(ids), ["k", "l"]).select("l", "k", "t").mapInArrow(_vectors, "l string, k long, v binary, x binary")
    got = sorted((r.l, r.k, bytes(r.v), bytes(r.x)) for r in drawn.dropDuplicates(["l", "k"]).collect())
    model = Model([], idf.astype(np.float32), np.zeros((0, BUCKETS)), np.zeros(0, int))
    rng, cents, of, grams, near = np.random.default_rng(seed), [], [], [], []
    for j, name in enumerate(sorted({x[0] for x in got})):
        mine = [x for x in got if x[0] == name]
        counts, excerpts = (np.array([_dense(x[i]) for x in mine]) for i in (2, 3))
        c = _kmeans(model.vectors(counts), clusters, rounds, rng)
        for some in (counts, excerpts):
            grams.append(some.sum(1))
            near.append((model.vectors(some) @ c.T).max(1))
        cents.append(c)
        of += [j] * len(c)
        model.languages.append(name)
    model.centroids, model.of = np.concatenate(cents).astype(np.float32), np.array(of)
    grams, near = np.concatenate(grams), np.concatenate(near)
    model.calibrate(grams[grams > 0], near[grams > 0])
    return model


def _packed(row: np.ndarray) -> bytes:
    """Sparse counts: (uint16 bucket, float32 count) pairs."""
    on = np.flatnonzero(row)
    return on.astype("<u2").tobytes() + row[on].astype("<f4").tobytes()


def excerpt(text: str, k: int) -> str:
    """Some words in a row of a text, 1 to 64 by k, from a place by k."""
    w = text.split()
    n = 1 << (k % 7)
    at = k // 7 % max(len(w) - n + 1, 1)
    return " ".join(w[at : at + n])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse counts of the drawn rows and of excerpts of them."""
    for batch in batches:
        for at in range(0, len(batch), _ROWS):
            part = batch.slice(at, _ROWS)
            texts = part.column(2).to_pylist()
            v = [_packed(row) for row in gram_counts(texts)]
            x = [_packed(row) for row in gram_counts([excerpt(t, k % (1 << 40)) for t, k in zip(texts, part.column(1).to_pylist(), strict=True)])]
            yield pa.record_batch([part.column(0).cast(pa.string()), part.column(1), pa.array(v, pa.binary()), pa.array(x, pa.binary())], ["l", "k", "v", "x"])


def _dense(packed: bytes) -> np.ndarray:
    n = len(packed) // 6
    out = np.zeros(BUCKETS, np.float32)
    out[np.frombuffer(packed, "<u2", n)] = np.frombuffer(packed, "<f4", n, 2 * n)
    return out


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected.

    lang_pred is ``und`` with score 0 where the text is null or has no letter, or no language was learned. rejected
    is true there and where the nearest centroid is too far: its cosine is under the model's bar for the number of the
    text's n-grams. Columns of these names in docs are replaced; all others, whatever their names, stay as they are.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a in range(0, len(batch), _ROWS):
                part = batch.slice(a, _ROWS)
                texts = part.column(at).to_pylist()
                which, score, grams = m.nearest(texts)
                ok = np.array([bool(m.languages) and has_letter(t) for t in texts], bool)
                score = np.where(ok, score, 0.0)
                names = [m.languages[j] if k else "und" for j, k in zip(which, ok, strict=True)]
                yield pa.record_batch([*part.columns, pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(~ok | (score < m.bar(grams)))], [*part.schema.names, "lang_pred", "score", "rejected"])
        tidy()

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # any names can be sent, dots and all
    schema = StructType([*plain.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    return plain.mapInArrow(run, schema).toDF(*docs.columns, "lang_pred", "score", "rejected")


def held_out(key: Column) -> Column:
    """crc32 of the key as text, modulo 4, is 2; a null key is never held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
