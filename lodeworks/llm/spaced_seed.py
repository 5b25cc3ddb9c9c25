"""Benchmark decontamination by spaced-seed hashing.

A seed is a hash of the words at a mask's fixed positions in a window; words at the other positions may differ. The
distinct seeds of the benchmark's items are a table, those of the documents another, and the two are joined. Where a
document meets an item, each hit of equal seeds names a diagonal of the two; the words of both are compared along it and
the overlap is grown while at least ``match`` of its words agree. It counts from ``least`` equal words (or the whole item, if shorter: all words of
such an item must agree).

No overlap goes unseen. One of at least 13 equal words and 80 % has a stretch of at most 33 words that is one too, as
one half of a longer one would do, and every placing of unequal words in such a stretch leaves all words of one mask
equal (the tests go through all of them). For a lower ``least`` or ``match``, the run of equal words that must be there
by pigeonhole is a further mask.

Of the documents' seeds only those leave their task that a bitmap of the benchmark's seeds lets through. It has 16 bits a
seed up to a million seeds and no more after that, so a larger benchmark lets more through to the join (a fifth of all
seeds at four million, two thirds at 16 million) and nothing else changes. Items' words go to the documents that they
meet, a megabyte of them a row. A seed that repeats in a document or an item is one row of either, and windows of a
document that are equal word for word are compared once: the work is linear in texts of one word repeated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.llm.shared import quoted, small, stored, unused
from lodeworks.llm.textops import BYTE_VALUES, LOWER, pieces, powers, tidy, window_hashes, words

#: Fixed masks, as offsets of the words that must agree; together they meet every overlap of 13 equal words and 80 %.
MASKS = (
    (0, 1, 2, 3, 5, 6),
    (0, 1, 2, 4, 6, 7),
    (0, 1, 3, 7, 10, 11),
)
#: Bytes of items that meet a text in one row.
GROUP_BYTES = 1 << 20
#: Most bits of the bitmap of the benchmark's seeds, as a power of two: 2 MB.
MOST_BITS = 24

# Words for matching are runs of ASCII letters and digits and of bytes of other characters, lower-cased: punctuation
# separates, as copies often differ in it.
_WORDY = np.zeros(256, bool)
_WORDY[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_VALUES = BYTE_VALUES[LOWER]


def _unequal(n: int, match: float) -> int:
    """Words that may differ beside n equal ones."""
    return int(n * (1 - match) / match + 1e-9)


def masks_for(lengths: list[int], least: int, match: float, masks=MASKS) -> tuple[list[tuple[int, ...]], int]:
    """(masks, number of those that are for all items): the rest are whole items that are shorter than a mask."""
    if least < 13 or match < 0.8:
        reach = 2 * math.ceil(least / match) - 1  # words of the longest overlap that holds no shorter one
        masks = (*masks, tuple(range(min(-(-n // (_unequal(n, match) + 1)) for n in range(least, reach + 1)))))
    span = max(m[-1] + 1 for m in masks)
    return [*masks, *(tuple(range(n)) for n in sorted(set(lengths)) if 0 < n < span and (n > 1 or least <= 1))], len(masks)


def grown(item: np.ndarray, first: int, doc: np.ndarray, least: int, match: float) -> tuple[int, int, int] | None:
    """(equal words, first word of the item, length) of the longest stretch with at least ``match`` equal words that
    holds the most of them. ``doc`` are the document's words beside the item's words from ``first`` on."""
    same = item[first : first + len(doc)] == doc
    need = min(least, len(item))
    if same.sum() < need:
        return None
    score = np.cumsum(np.where(same, 1.0, -match / (1 - match) if match < 1 else -1e9))
    # stretches [s, e) whose score is >= 0 hold at least `match` equal words; take the one of most equal words
    prefix, equal = np.r_[0.0, score], np.r_[0, np.cumsum(same)]
    low = np.minimum.accumulate(prefix)
    e = np.flatnonzero(same) + 1
    s = np.searchsorted(-low, -prefix[e] - 1e-9)
    n = equal[e] - equal[s]
    best = int(n.argmax())
    if n[best] < need:
        return None
    s = int(s[best])
    while not same[s]:
        s += 1
    return int(n[best]), first + s, int(e[best]) - s


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items (iid, item, text) with the hashes of their words."""
    for batch in batches:
        n, packed = [], []
        for a, b, raw, off in pieces(batch.column(2)):
            h, at = words(raw, off, _VALUES, _WORDY)
            n += np.diff(at).tolist()
            packed += [h[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], ["iid", "item", "n", "words"])
    tidy()


def _item_seeds(masks: list[tuple[int, ...]], common: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for iid, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.frombuffer(packed, np.uint64)
                for j, m in enumerate(masks):
                    if j < common or len(h) == len(m):
                        seeds = np.unique(window_hashes(h, m))
                        yield pa.record_batch([pa.array(np.full(len(seeds), iid)), pa.array(np.full(len(seeds), j, np.int32)), pa.array(seeds.view(np.int64))], ["iid", "m", "seed"])

    return run


def _doc_seeds(shared, masks: list[tuple[int, ...]]):
    """Distinct seeds of whole texts that the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(shared.value, bitorder="little").view(bool)
        shift = np.uint64(64 - int(len(flags)).bit_length() + 1)
        for batch in batches:
            for a, _, raw, off in pieces(batch.column(2)):
                h, at = words(raw, off, _VALUES, _WORDY)
                for j, m in enumerate(masks):
                    every = window_hashes(h, m)
                    hit = np.flatnonzero(flags[(every >> shift).astype(np.int64)]) if len(every) else np.zeros(0, np.int64)
                    doc = np.searchsorted(at, hit, "right") - 1
                    inside = hit + m[-1] < at[doc + 1]  # windows don't go over the end of a text
                    seed, doc = every[hit[inside]], doc[inside]
                    order = np.lexsort((seed, doc))
                    seed, doc = seed[order], doc[order]
                    new = np.ones(len(seed), bool)
                    new[1:] = (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])
                    seed, doc = seed[new], doc[new]
                    for x in range(0, len(seed), 1 << 16):
                        part, own = seed[x : x + (1 << 16)], pa.array(doc[x : x + (1 << 16)] + a)
                        yield pa.record_batch([batch.column(0).take(own), batch.column(1).take(own), pa.array(np.full(len(part), j, np.int32)), pa.array(part.view(np.int64))], ["key", "uid", "m", "seed"])
        tidy()

    return run


#: Hits of a text and an item that are laid out one by one; with more, all diagonals are looked at.
MOST_HITS = 1 << 22


class _Text:
    """A text's words, and its seeds in order for each mask."""

    def __init__(self, own: np.ndarray, masks: list[tuple[int, ...]]):
        self.words = own
        self.seeds = []
        for m in masks:
            every = window_hashes(own, m)
            order = np.argsort(every, kind="stable")
            self.seeds.append((every[order], order))
        self.sums: np.ndarray | None = None

    def diagonals(self, item: np.ndarray, masks: list[tuple[int, ...]], common: int) -> np.ndarray:
        """The diagonals that hold a hit, each a place of the item's first word in the text.

        Where windows of the text as long as the item are equal word for word, the first stands for all: the others'
        overlaps are the same ones further on. So a text of one word, or of a few in turn, has few diagonals.
        """
        n, found, hits = len(item), [], 0
        for j, m in enumerate(masks):
            if j < common or n == len(m):
                seeds, order = self.seeds[j]
                own = window_hashes(item, m)
                lo, hi = np.searchsorted(seeds, own, "left"), np.searchsorted(seeds, own, "right")
                hits += int((hi - lo).sum())
                found.append((lo, hi - lo, order))
        if hits > MOST_HITS:
            d = np.arange(1 - n, len(self.words))
        else:
            d = np.unique(np.concatenate([order[np.repeat(lo - np.r_[0, np.cumsum(k)[:-1]], k) + np.arange(k.sum())] - np.repeat(np.arange(len(k)), k) for lo, k, order in found if len(k)] or [np.zeros(0, np.int64)]))
        if len(d) <= 16:
            return d
        inside = (d >= 0) & (d + n <= len(self.words))
        x = d[inside]
        up, down = powers(len(self.words) + 1)
        with np.errstate(over="ignore"):
            if self.sums is None:
                self.sums = np.zeros(len(self.words) + 1, np.uint64)
                np.cumsum(self.words * up[: len(self.words)], out=self.sums[1:])
            _, first = np.unique((self.sums[x + n] - self.sums[x]) * down[x], return_index=True)
        return np.r_[d[~inside], x[first]]


def best_overlap(text: _Text, item: np.ndarray, masks: list[tuple[int, ...]], common: int, least: int, match: float) -> tuple[int, int, int, int] | None:
    """(equal words, first word in the text, first word in the item, length) of the best overlap of a text and an item."""
    best = None
    for d in text.diagonals(item, masks, common).tolist():
        first = max(0, -d)
        if found := grown(item, first, text.words[d + first : max(d + len(item), 0)], least, match):
            mine = (found[0], -(found[1] + d), -found[1], found[2])
            best = mine if best is None or mine > best else best
    return best and (best[0], -best[1], -best[2], best[3])


def _verified(masks: list[tuple[int, ...]], common: int, least: int, match: float):
    """Of each text and each of its items (iid, words): the best overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            rows, at = [], []
            for a, b, raw, off in pieces(batch.column(2)):
                h, ends = words(raw, off, _VALUES, _WORDY)
                for i in range(b - a):
                    text = _Text(h[ends[i] : ends[i + 1]], masks)
                    for x in lists[a + i].as_py():
                        if found := best_overlap(text, np.frombuffer(x["words"], np.uint64), masks, common, least, match):
                            rows.append((x["iid"], *found))
                            at.append(a + i)
            own = pa.array(at, pa.int64())
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([batch.column(0).take(own), batch.column(1).take(own), *(pa.array(c, pa.int64()) for c in cols)], ["key", "uid", "iid", "matches", "doc_word", "item_word", "length"])
        tidy()

    return run


def _bitmap(seeds: DataFrame, count: int) -> np.ndarray:
    """Packed bits, set where a seed's first bits point; from 2**16 to 2**MOST_BITS of them, 16 for a seed."""
    bits = min(max(16, int(count * 16).bit_length()), MOST_BITS)
    at = F.shiftrightunsigned(F.col("seed"), 64 - bits)
    word = seeds.groupBy(F.shiftrightunsigned(at, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))).alias("v"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in word.collect():  # 2**(MOST_BITS - 6) rows at most
        out[r.w] = r.v
    return out.view(np.uint8)


def _overlaps(docs: DataFrame, benchmark: DataFrame, least: int, match: float, key: str, text: str, item: str, item_text: str) -> DataFrame:
    """(key, uid, item, matches, doc_word, item_word, length, rows): the best overlap of each document with each item;
    a document is a key and a hash of key and text, and is in so many rows."""
    spark = docs.sparkSession
    slim = docs.select(F.col(quoted(key)).alias("key"), F.xxhash64(F.col(quoted(key)), F.col(quoted(text))).alias("uid"), F.col(quoted(text)).alias("text"))
    kind = slim.schema["key"].dataType.simpleString()
    tests = benchmark.select(F.xxhash64(F.col(quoted(item)), F.col(quoted(item_text))).alias("iid"), F.col(quoted(item)).alias("item"), F.col(quoted(item_text)).alias("text")).where("item is not null and text is not null")
    items = stored(tests.dropDuplicates(["iid"]).mapInArrow(_hashes, f"iid long, item {tests.schema['item'].dataType.simpleString()}, n long, words binary"), "items")
    span = max(m[-1] + 1 for m in MASKS)
    short = [r.n for r in items.where(F.col("n") < max(span, least)).select("n").distinct().collect()]
    masks, common = masks_for(short, least, match)
    seeds = stored(items.select("iid", "words").mapInArrow(_item_seeds(masks, common), "iid long, m int, seed long"), "seeds")
    many, (count, width) = seeds.count(), items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("words") + 64), F.lit(0))).first()
    flags = spark.sparkContext.broadcast(_bitmap(seeds, many))
    hits = slim.mapInArrow(_doc_seeds(flags, masks), f"key {kind}, uid long, m int, seed long")
    met = stored(hits.join(small(seeds, many, 32), ["m", "seed"]).select("key", "uid", "iid").distinct(), "met")
    # a row for each megabyte of a document's items
    part = F.floor(F.sum(F.octet_length("words") + 64).over(Window.partitionBy("key", "uid").orderBy("iid")) / GROUP_BYTES)
    with_words = met.join(small(items.select("iid", "words"), 1, width), "iid").select("key", "uid", part.alias("part"), "iid", "words")
    by_doc = with_words.groupBy("key", "uid", "part").agg(F.collect_list(F.struct("iid", "words")).alias("items"))
    by_doc = by_doc.withColumn("lead", F.row_number().over(Window.partitionBy("key", "uid").orderBy("part")) == 1)
    by_doc = stored(by_doc.withColumnRenamed("key", "own").withColumnRenamed("uid", "own_uid"), "diagonals")
    few, bytes_ = by_doc.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.aggregate("items", F.lit(64).cast("long"), lambda n, x: n + 64 + F.octet_length(x["words"]))), F.lit(0))).first()
    texts = stored(slim.join(small(by_doc, 1, bytes_), (F.col("uid") == F.col("own_uid")) & F.col("key").eqNullSafe(F.col("own"))).select("key", "uid", "text", "items", "lead"), "hits")
    rows = texts.where("lead").groupBy(F.col("key").alias("own"), F.col("uid").alias("own_uid")).agg(F.count(F.lit(1)).alias("rows"))
    once = texts.select("key", "uid", "text", "items")
    found = once.mapInArrow(_verified(masks, common, least, match), f"key {kind}, uid long, iid long, matches long, doc_word long, item_word long, length long")
    found = found.join(small(items.select("iid", "item"), count, 64), "iid")
    best = found.groupBy("key", "uid", "item").agg(F.max(F.struct("matches", (-F.col("doc_word")).alias("a"), (-F.col("item_word")).alias("b"), "length")).alias("x"))
    best = best.join(small(rows, few, 48), (F.col("uid") == F.col("own_uid")) & F.col("key").eqNullSafe(F.col("own")))
    return best.select("key", "uid", "item", "x.matches", (-F.col("x.a")).alias("doc_word"), (-F.col("x.b")).alias("item_word"), "x.length", "rows")


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = 13, match: float = 0.8, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, matches, doc_word, item_word, length): each row of docs with each item it overlaps, the best
    overlap of each (of most equal words, then the first in the text, then in the item). Word positions count the
    operator's own words (letters and digits, lower-cased).

    Keys and item ids are of any type. Null and empty texts on either side overlap nothing; items without an id are
    not searched; rows that repeat an item's id are one item. Repeated rows each give their rows. An empty benchmark
    gives no rows. Other columns aren't looked at.
    """
    found = _overlaps(docs, benchmark, least, match, key, text, item, item_text)
    each = found.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select(F.col("key").alias(key), F.col("item").alias(item), "matches", "doc_word", "item_word", "length")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", least: int = 13, match: float = 0.8, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the documents that overlap a benchmark item; all columns are kept, whatever their names.

    A document is told by key and text, null keys too: another text under a contaminated one's key stays.
    """
    uid, own, other = unused(docs, "uid", "own", "other")
    bad = _overlaps(docs, benchmark, least, match, key, text, item, item_text).select(F.col("key").alias(own), F.col("uid").alias(other)).distinct()
    bad = stored(bad, "leaks")
    tagged = docs.withColumn(uid, F.xxhash64(F.col(quoted(key)), F.col(quoted(text))))
    left = tagged.join(small(bad, bad.count(), 64), (F.col(uid) == F.col(other)) & F.col(quoted(key)).eqNullSafe(F.col(own)), "left_anti")
    return left.select(*[F.col(quoted(c)) for c in docs.columns])
