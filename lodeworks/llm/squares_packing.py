"""Best-fit packing by sums of squares (Csirik, Johnson et al., 2006).

Documents are cut into pieces of a full sequence and a rest. Rests are dealt to blocks by a hash; a block places its
rests, longest first, each into the open sequence that leaves the sum over all gaps of the squared number of open
sequences with that gap smallest. A sequence is opened where no open one has room: that leaves fewer sequences than to
weigh the opening too, as nothing comes after the last rest that could use what is open. Sequences of a block that stay
open with a wide gap are dissolved, and their rests are packed again with those of all other blocks, until one block
holds them.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.packing import _STATE, CACHE_WORDS, token_ids
from lodeworks.llm.shared import quoted, stored
from lodeworks.llm.textops import slices, string_bytes, tidy

#: Rests of a block: what one task places at once, about a second and a few megabytes.
BLOCK = 1 << 16


def place(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset, gap that its sequence is left with) of pieces below or at the capacity, in their order.

    Equal sums go to the smaller gap.
    """
    n = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    bins: dict[int, list[int]] = defaultdict(list)
    seq, offset, gaps = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    for i, s in enumerate(sizes.tolist()):
        # a sequence of gap s + j gets gap j: 2 (n[j] - n[s + j]) + 2 more, and one that is filled counts no longer
        room = n[s:capacity]
        j = np.flatnonzero(room)
        if len(j):
            change = 2 * (n[j] - room[j]) + 2
            if j[0] == 0:
                change[0] = 1 - 2 * room[0]
            gap = s + int(j[change.argmin()])
            b = bins[gap].pop()
            n[gap] -= 1
        else:
            gap, b = capacity, len(gaps)
            gaps.append(0)
        seq[i], offset[i], gaps[b] = b, capacity - gap, gap - s
        if gap > s:
            n[gap - s] += 1
            bins[gap - s].append(b)
    return seq, offset, np.array(gaps, np.int64)[seq] if gaps else seq


def _placed(capacity: int, round_no: int):
    def run(key, rows):
        ids, sizes = rows.column("rid").to_numpy(), rows.column("length").to_numpy()
        order = np.lexsort((ids, -sizes))
        seq, offset, gap = place(sizes[order], capacity)
        number = (round_no << 58) + (key[0].as_py() << 24) + seq
        return pa.table([pa.array(ids[order]), pa.array(sizes[order]), pa.array(number), pa.array(offset), pa.array(gap)], ["rid", "length", "sequence_id", "offset", "gap"])

    return run


def _cut(path: str, end_id: int, capacity: int, slice_bytes: int, cache_words: int, with_ids: bool):
    """Rows (id, rid, piece, start, length, crc, own sequence of a full piece, ids): ids go where they are not asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = full = TaskContext.get().partitionId() << 33
        for batch in batches:
            _, off = string_bytes(batch.column(1))
            for a, b in slices(off, slice_bytes):
                part = batch.slice(a, b - a)
                ids, ends = token_ids(part.column(1), path, end_id, cache_words)
                n = np.diff(ends)
                many = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(doc)) - np.repeat(np.r_[0, np.cumsum(many)[:-1]], many)
                start = piece * capacity
                length = np.minimum(n[doc] - start, capacity)
                whole = length == capacity
                own = -(full + np.cumsum(whole))
                full += int(whole.sum())
                raw = memoryview(ids.astype("<u4").view(np.uint8))
                x = ((ends[doc] + start) * 4).tolist()
                y = ((ends[doc] + start + length) * 4).tolist()
                crc = [zlib.crc32(raw[i:j]) for i, j in zip(x, y, strict=True)]
                blobs = [bytes(raw[i:j]) for i, j in zip(x, y, strict=True)] if with_ids else [None] * len(x)
                yield pa.record_batch(
                    [part.column(0).take(pa.array(doc)), pa.array(at + doc), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(own, mask=~whole), pa.array(blobs, pa.binary())],
                    ["id", "rid", "piece", "start", "length", "ids_crc32", "own", "ids"],
                )
                at += len(n)
        tidy(_STATE)

    return run


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text", block: int = BLOCK, wide: int = 16, with_ids: bool = False, slice_bytes: int = 4 << 20, cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row for each piece: (key, piece, start, length, ids_crc32, sequence_id, offset), and ids where asked for.

    A document is its ids and end_id; only one longer than ``capacity`` is cut, every ``capacity`` ids. Sequences hold at
    most ``capacity`` ids, gapless from 0. Sequences left with a gap of ``wide`` or more are packed again in the next
    round, as long as that is at most half of what was packed and there is more than one block; blocks hold ``block``
    rests on the average. Hashes deal equal sizes and equal texts apart, so no block grows with a group of copies.

    A null text is empty: its document is end_id alone. Rows are packed as often as they occur, whatever their key.
    Columns beyond the two are not looked at. An empty table gives no piece.
    """
    slim = docs.select(F.col(quoted(key)).alias("id"), F.col(quoted(text)).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    pieces = stored(slim.mapInArrow(_cut(vocabulary, end_id, capacity, slice_bytes, cache_words, with_ids), f"id {kind}, rid long, piece int, start long, length long, ids_crc32 long, own long, ids binary"), "pieces")
    rest = pieces.where("own is null").select("rid", "length")
    left, done, round_no = rest.count(), [], 1
    while left:
        blocks = -(-left // block)
        dealt = rest.select("rid", "length", F.pmod(F.xxhash64("rid", F.lit(round_no)), F.lit(blocks)).alias("block"))
        placed = stored(dealt.groupBy("block").applyInArrow(_placed(capacity, round_no), "rid long, length long, sequence_id long, offset long, gap long"), "placed")
        open_ = placed.where(F.col("gap") >= wide)
        again = open_.count() if blocks > 1 else 0
        if 2 * again > left:
            again = 0
        done.append(placed.where(F.col("gap") < wide) if again else placed)
        rest, left, round_no = open_.select("rid", "length"), again, round_no + 1
    out = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]
    whole = pieces.where("own is not null").select("*", F.col("own").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).select(*out)
    if done:
        where = reduce(DataFrame.unionByName, [p.select("rid", "sequence_id", "offset") for p in done])
        whole = whole.unionByName(pieces.where("own is null").join(where, "rid").select(*out))
    return whole.withColumnRenamed("id", key)
