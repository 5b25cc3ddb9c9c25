"""Phrase collocations by hierarchical pair naming.

Texts are dealt to chunks of some megabytes, each a run of word codes of the chunk's own dictionary. The chunks' words
meet by one shuffle; those that are frequent in all get an id, and the ids go back to the chunks that have them. Then
each level names the pairs of adjacent ids: a k-gram is a pair of (k-1)-grams that overlap in k-2 words, both frequent.
Only a chunk's distinct pairs with their counts are shuffled, never its positions, and a pair that all chunks have is
one row of each. A pair's id points to its two parents: their chains are all first and last parts (the cuts) and all
contiguous phrases inside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.llm.shared import forget, quoted, small, stored
from lodeworks.llm.textops import LOWER, string_bytes, tidy, word_marks

#: Bytes of text of a chunk, and those that a worker holds for all languages.
CHUNK, HELD = 24 << 20, 40 << 20
# What ends a piece, what ends a word.
PIECE_ENDS, WORD_ENDS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
IS_WORD = np.ones(256, bool)
IS_WORD[list(PIECE_ENDS + WORD_ENDS)] = False
_DICTIONARY = "chunk long, lang string, code int, {}n long, codes binary"
#: Groups into which a language's phrases are dealt before its best are taken.
DEALS = 64


def _codes_of(texts: list[pa.Array]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, their counts, codes by position with -1 between pieces) of lower-cased texts."""
    raw, off = string_bytes(pa.concat_arrays(texts))
    starts, ends = word_marks(raw, off, IS_WORD)
    data = LOWER[raw[IS_WORD[raw]]]
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
    edges = np.sort(np.concatenate([np.flatnonzero(np.isin(raw, np.frombuffer(PIECE_ENDS, np.uint8))), off[1:-1]]))
    piece = np.searchsorted(edges, starts, "right")
    new = np.r_[False, piece[1:] != piece[:-1]] if len(piece) else np.zeros(0, bool)
    codes = np.full(len(starts) + int(new.sum()), -1, np.int32)
    mine = words.indices.to_numpy(zero_copy_only=False)
    codes[np.arange(len(starts)) + np.cumsum(new)] = mine
    return words.dictionary, np.bincount(mine, minlength=len(words.dictionary)), codes


def _packed(codes: np.ndarray) -> bytes:
    """Codes as bytes, compressed: a shuffle's own codec finds little in whole numbers of four bytes."""
    return pa.compress(codes.astype("<i4").tobytes(), "zstd", asbytes=True)


def _unpacked(tokens: pa.Table) -> np.ndarray:
    """The codes of a chunk's one row of them."""
    if not len(tokens) or not (n := tokens.column("n")[0].as_py()):
        return np.zeros(0, np.int32)
    return np.frombuffer(pa.decompress(tokens.column("codes")[0].as_py(), 4 * n, "zstd"), "<i4")


def _words(chunk_bytes: int, held_bytes: int):
    """Rows of the first dictionaries: a row for each distinct word of a chunk, and one, code -1, that holds its codes, of which there are n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, held, size = TaskContext.get().partitionId() << 32, {}, {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal chunk
            words, n, codes = _codes_of(held.pop(lang))
            size.pop(lang)
            for a in range(0, len(words), 50_000):
                part = words.slice(a, 50_000).cast(pa.string())
                k = len(part)
                yield pa.record_batch([pa.array(np.full(k, chunk)), pa.array([lang] * k, pa.string()), pa.array(np.arange(a, a + k, dtype=np.int32)), part, pa.array(n[a : a + k]), pa.nulls(k, pa.binary())], ["chunk", "lang", "code", "word", "n", "codes"])
            if len(words):
                yield pa.record_batch([pa.array([chunk]), pa.array([lang], pa.string()), pa.array([-1], pa.int32()), pa.nulls(1, pa.string()), pa.array([len(codes)]), pa.array([_packed(codes)], pa.binary())], ["chunk", "lang", "code", "word", "n", "codes"])
            chunk += 1

        for batch in batches:
            langs, texts = batch.column(0).dictionary_encode(), batch.column(1)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                mine = texts.filter(pc.equal(langs.indices, k))
                held.setdefault(lang, []).append(mine)
                size[lang] = size.get(lang, 0) + pc.sum(pc.binary_length(mine)).as_py()
                if size[lang] >= chunk_bytes:
                    yield from flush(lang)
            while sum(size.values()) > held_bytes:
                yield from flush(max(size, key=size.get))
        for lang in list(held):
            yield from flush(lang)
        tidy()

    return run


def _pairs(tokens: pa.Table, names: pa.Table) -> pa.Table:
    """A chunk's next dictionary from its codes and the ids of those that are frequent: distinct pairs of neighbours."""
    codes = _unpacked(tokens)
    own, ids = names.column("code").to_numpy(), names.column("id").to_numpy()
    size = int(max(codes.max(initial=-1), own.max(initial=-1))) + 2
    known = np.full(size, -1, np.int64)  # the last is what -1 reads
    known[own] = np.arange(len(own))
    x = known[codes]
    ok = (x[:-1] >= 0) & (x[1:] >= 0)
    pairs, at, n = np.unique(x[:-1][ok] * len(own) + x[1:][ok], return_inverse=True, return_counts=True)
    new = np.full(len(ok), -1, np.int32)
    new[ok] = at
    new = new[(new >= 0) | np.r_[False, new[:-1] >= 0]] if len(new) else new  # one -1 between runs is enough
    k = len(pairs)
    rows = k + (k > 0)
    last = pa.array([None] * (rows - k), pa.int64())
    with_last = lambda v, x=last: pa.concat_arrays([pa.array(v.astype(np.int64)), x])
    chunk, lang = (tokens.column(c)[0].as_py() if len(tokens) else None for c in ("chunk", "lang"))
    left, right = (ids[pairs // max(len(own), 1)], ids[pairs % max(len(own), 1)]) if k else (np.zeros(0, np.int64),) * 2
    return pa.table(
        [pa.array(np.full(rows, chunk or 0, np.int64)), pa.array([lang] * rows, pa.string()), pa.array(np.r_[np.arange(k), np.full(rows - k, -1)].astype(np.int32)), with_last(left), with_last(right), with_last(n, pa.array([len(new)] * (rows - k), pa.int64())), pa.array([None] * k + [_packed(new)] * (rows - k), pa.binary())],
        ["chunk", "lang", "code", "left", "right", "n", "codes"],
    )


def counted(docs: DataFrame, least: int = 100, longest: int = 5, text: str = "text", lang: str = "lang", chunk_bytes: int = CHUNK) -> tuple[list[DataFrame], DataFrame]:
    """The frequent n-grams by length, and the words of each language (lang, n).

    Table 1 has (id, lang, word, a), table k (id, left, right, a): left and right are the ids of its first and its last
    k-1 words. Null texts are empty, a null language is ``und``. The tables are stored; ``forget`` deletes them.
    """
    slim = docs.select(F.coalesce(F.col(quoted(lang)).cast("string"), F.lit("und")).alias("lang"), F.col(quoted(text)).alias("text")).where(F.length("text") > 0)
    state = stored(slim.mapInArrow(_words(chunk_bytes, max(HELD, chunk_bytes)), _DICTIONARY.format("word string, ")), "words")
    totals = state.where("code >= 0").groupBy("lang").agg(F.sum("n").alias("n"))
    totals = stored(totals, "totals")
    grams: list[DataFrame] = []
    for k in range(1, longest + 1):
        key = ["lang", "word"] if k == 1 else ["left", "right"]
        rows = state.where("code >= 0")
        # a word's row keeps the chunks that have it, each once: the word itself is shuffled and compared once
        owners = [F.collect_list(F.struct(F.col("chunk").alias("owner"), "code")).alias("owners")] if k == 1 else []
        often = (rows.repartition(*key) if owners else rows).groupBy(*key).agg(F.sum("n").alias("a"), *owners).where(F.col("a") >= least)
        often = stored(often.withColumn("id", F.monotonically_increasing_id() + (k << 56)), f"grams{k}")
        grams.append(often.drop("owners"))
        many = often.count()
        if k == longest or not many:
            forget(state)
            break
        names = often.select("id", F.inline("owners")) if owners else rows.join(small(often.select(*key, "id"), many, 40), key).select(F.col("chunk").alias("owner"), "code", "id")
        tokens = state.where("code = -1").select("chunk", "lang", "n", "codes")
        new = stored(tokens.groupBy("chunk").cogroup(names.groupBy("owner")).applyInArrow(_pairs, _DICTIONARY.format("left long, right long, ")), "pairs")
        forget(state)
        state = new
    return grams, totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, share: int = 100, top: int = 2000, text: str = "text", lang: str = "lang", chunk_bytes: int = CHUNK) -> DataFrame:
    """Each language's ``top`` collocations: (lang, rank, phrase, a, l, r, n, score, cut).

    Candidates are the phrases of 2 to ``longest`` words within a piece that occur at least ``least`` times; n is the
    number of the language's words, l and r are the counts of the parts of the cut that scores least, and the score is
    floor(1000 a n / (l r)), exactly, for up to 9e15 words. A candidate inside a longer one with ``share`` percent or
    more of its occurrences goes. Order: score and a descending, then the phrase's bytes.

    Null and empty texts have no words, a null language is ``und``. Words are whatever bytes lie between separators.
    Repeated rows count as often as they occur. An empty table gives no row. Other columns are not looked at.
    """
    grams, totals = counted(docs, least, longest, text, lang, chunk_bytes)
    none = F.array().cast("array<long>")
    below = grams[0].select("id", "lang", F.array("word").alias("words"), F.array("a").alias("first"), F.array("a").alias("last"), none.alias("inside"))
    levels = []
    for k, g in enumerate(grams[1:], 2):
        side = lambda s: below.select(*[F.col(c).alias(f"{s}_{c}") for c in below.columns])  # noqa: E731, B023
        both = g.join(side("l"), F.col("left") == F.col("l_id")).join(side("r"), F.col("right") == F.col("r_id"))
        inside = F.array_distinct(F.concat(F.array("left", "right"), "l_inside", "r_inside")) if k > 2 else none
        below = stored(
            both.select(
                "id", F.col("l_lang").alias("lang"), "a", F.concat("l_words", F.slice("r_words", k - 1, 1)).alias("words"), F.concat("l_first", F.array("a")).alias("first"), F.concat("r_last", F.array("a")).alias("last"), inside.alias("inside"),
            ),
            f"phrases{k}",
        )
        levels.append(below)
    schema = "lang string, rank long, phrase string, a long, l long, r long, n long, score long, cut int"
    if not levels:
        return docs.sparkSession.createDataFrame([], schema)
    every = reduce(DataFrame.unionByName, levels)
    longer = every.select(F.explode("inside").alias("id"), F.col("a").alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
    kept = every.join(longer, "id", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).join(totals, "lang")
    # (19 + 18 digits) by (19 + 18 digits): both fit 38
    above = lambda: (F.col("a") * 1000).cast("decimal(19,0)") * F.col("n").cast("decimal(18,0)")
    kept = kept.withColumn("above", above())
    part = "(transform(sequence(1, size(words) - 1), k -> struct(above div (cast(first[k - 1] as decimal(19,0)) * cast(last[size(words) - k - 1] as decimal(18,0))) as score, k as cut)))"
    cut = kept.withColumn("c", F.array_min(F.expr(part)))
    rows = cut.select("lang", F.array_join("words", " ").alias("phrase"), "a", F.expr("first[c.cut - 1]").alias("l"), F.expr("last[size(words) - c.cut - 1]").alias("r"), "n", F.col("c.score").alias("score"), F.col("c.cut").alias("cut"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(DEALS)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "cut")
