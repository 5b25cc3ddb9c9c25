"""Alignment of two tokenizers by an event sweep.

Each token of either tokenizer ends at a byte offset of its document: an event. Events go out in blocks, a row for the
events of one side within a fixed range of bytes; a token's length follows from its id, so a row holds ids alone. The
two sides are one table, dealt by document and sorted by offset within partitions. A sweep reads the sorted rows as a
stream and keeps what lies behind the last offset where both sides ended, a hash and some counts: no document is
gathered. Where both sides end, a group ends, and its last two tokens are a link.

Both tokenizers never join a character that is no white space to a space behind it, so texts are tokenized by the
distinct segments that such places cut; the ids, joined, are those of the text.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.shared import quoted, small, stored
from lodeworks.llm.textops import CACHES, slices, string_bytes, tidy

#: Bytes of a document whose events are one row, bytes of ids swept at once, segments that a worker remembers.
RANGE, SWEPT, CACHE_SEGMENTS = 1 << 16, 2 << 20, 200_000
_STATE: dict = {}
CACHES.append(_STATE)


def _byte_values() -> dict[str, int]:
    """The bytes that byte-level models write as characters: printable ones as themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in shown]
    return {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(rest)}


def bytes_of_a(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    from tokenizers import Tokenizer

    t, values = Tokenizer.from_file(path), _byte_values()
    names = {i: w for w, i in t.get_vocab(with_added_tokens=True).items()}
    return [bytes(values.get(c, 0) for c in names.get(i, "")) for i in range(max(names) + 1)]


def bytes_of_b(path: str) -> list[bytes]:
    """The bytes of each id of a piece vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return [bytes([int(w[3:5], 16)]) if sp.is_byte(i) else w.replace("▁", " ").encode() for i, w in enumerate(names)]


def _coder(a_path: str, b_path: str) -> dict:
    if _STATE.get("paths") != (a_path, b_path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(a_path)
        a.encode_special_tokens = True
        b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        # pieces hold a space at their start only, else a segment is no unit
        apart = all(re.fullmatch("▁*[^▁]*", b.id_to_piece(i)) for i in range(b.get_piece_size()))
        _STATE.update(paths=(a_path, b_path), a=a, b=b, a_bytes=bytes_of_a(a_path), b_bytes=bytes_of_b(b_path), space=b.piece_to_id("▁"), apart=apart, cache={})
        tidy(_STATE)
    return _STATE


def segments(raw: np.ndarray, off: np.ndarray, apart: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the texts with a space before each, starts of their segments, starts of the texts).

    A segment starts at a text's start and at each space behind a character that is no white space. What could be the
    last byte of other white space, by its first bytes, counts as such.
    """
    n = len(off) - 1
    text = off[:-1] + np.arange(n)
    s = np.empty(len(raw) + n, np.uint8)
    here = np.ones(len(s), bool)
    here[text] = False
    s[here], s[text] = raw, 0x20
    if not apart:
        return s, text, text
    at = np.flatnonzero(s == 0x20)
    at = at[at > 0]
    last = s[at - 1]
    solid = (last > 0x20) & (last < 0x7F)
    wide = np.flatnonzero(last >= 0x80)
    two, three = s[np.maximum(at[wide] - 2, 0)], s[np.maximum(at[wide] - 3, 0)]
    # letters of C3 to DF and one more byte, and of three bytes but for those from E1 9A, E1 A0, E2 and E3 80
    solid[wide] = ((two >= 0xC3) & (two <= 0xDF)) | ((three >= 0xE3) & (three <= 0xEF) & ~((three == 0xE3) & (two == 0x80)))
    cut = np.zeros(len(s), bool)
    cut[at[solid]] = True
    cut[text] = True
    return s, np.flatnonzero(cut), text


def _encoded(names: list[bytes], a_path: str, b_path: str, width: str, cache_size: int) -> list[tuple[bytes, bytes | None]]:
    """Ids of both sides of each segment as bytes; None where their bytes aren't the segment's."""
    state = _coder(a_path, b_path)
    cache, space = state["cache"], [state["space"]]
    got = list(map(cache.get, names))
    rest = [i for i, x in enumerate(got) if x is None]
    for lo in range(0, len(rest), 4096):
        part = rest[lo : lo + 4096]
        texts = [names[i].decode() for i in part]
        a = state["a"].encode_batch_fast(texts, add_special_tokens=False)
        b = state["b"].encode([t[1:] for t in texts], num_threads=1)
        for i, x, y in zip(part, a, b, strict=True):
            w = names[i]
            y = y if len(w) > 1 else space
            same = b"".join(map(state["b_bytes"].__getitem__, y)) == w == b"".join(map(state["a_bytes"].__getitem__, x.ids))
            got[i] = (np.array(x.ids, width).tobytes(), np.array(y, width).tobytes()) if same else (b"", None)
            if len(w) < 40 and len(cache) < cache_size:
                cache[w] = got[i]
    return got


def token_ids(raw: np.ndarray, off: np.ndarray, a_path: str, b_path: str, width: str = "<u4", cache_size: int = CACHE_SEGMENTS) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """((A's ids, offsets by text), (B's)) of texts that aren't empty; a text whose bytes either side changes has none."""
    apart = _coder(a_path, b_path)["apart"]
    s, starts, text = segments(raw, off, apart)
    at = np.append(starts, len(s)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(s)]).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    got = _encoded(coded.dictionary.to_pylist(), a_path, b_path, width, cache_size)
    first = np.searchsorted(starts, text)
    good = np.logical_and.reduceat(np.array([y is not None for _, y in got])[code], first)
    many = np.diff(np.append(first, len(starts)))
    taken = np.repeat(good, many)
    out = []
    for side in (0, 1):
        blobs = [x[side] or b"" for x in got]
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // np.dtype(width).itemsize
        base = np.r_[0, np.cumsum(size)[:-1]]
        flat = np.frombuffer(b"".join(blobs), width)
        n = np.where(taken, size[code], 0)
        up = np.r_[0, np.cumsum(n)]
        ids = flat[np.repeat(base[code] - up[:-1], n) + np.arange(up[-1])]
        out.append((ids, np.append(up[first], up[-1])))
    return out[0], out[1]


def _events(a_path: str, b_path: str, width: str, slice_bytes: int, range_bytes: int):
    """Rows (rid, id, block, side, at, ids): the ids of the tokens of one side that end within a block of bytes, and the
    offset at which the first of them begins. A document without tokens is one row of side 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rid = TaskContext.get().partitionId() << 33
        state = _coder(a_path, b_path)
        lengths = [np.array(list(map(len, state[x])), np.int64) for x in ("a_bytes", "b_bytes")]
        for batch in batches:
            _, every = string_bytes(batch.column(1))
            for lo, hi in slices(every, slice_bytes):
                part = batch.slice(lo, hi - lo)
                raw, off = string_bytes(part.column(1))
                full = np.flatnonzero(np.diff(off))
                rows: list[tuple] = []
                none = np.ones(len(part), bool)
                if len(full):
                    sides = token_ids(raw, np.append(off[full], off[-1]), a_path, b_path, width)
                    for side, (ids, at) in enumerate(sides):
                        ends = np.cumsum(lengths[side][ids])
                        blob, step = memoryview(np.ascontiguousarray(ids).view(np.uint8)), ids.itemsize
                        for d, x, y in zip(full.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                            if x == y:
                                continue
                            none[d] = False
                            zero = int(ends[x - 1]) if x else 0
                            size = int(ends[y - 1]) - zero
                            if size <= range_bytes:
                                rows.append((d, 0, side, 0, bytes(blob[x * step : y * step])))
                                continue
                            own = ends[x:y] - zero
                            edge = [0, *np.searchsorted(own, np.arange(range_bytes, size, range_bytes), "right").tolist(), y - x]
                            for k, (p, q) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                                if p < q:
                                    rows.append((d, k, side, int(own[p - 1]) if p else 0, bytes(blob[(x + p) * step : (x + q) * step])))
                rows += [(d, 0, 2, 0, b"") for d in np.flatnonzero(none).tolist()]
                doc, block, side, at, ids = zip(*rows, strict=True)
                yield pa.record_batch(
                    [pa.array(np.array(doc) + rid), part.column(0).take(pa.array(doc)), pa.array(block, pa.int64()), pa.array(side, pa.int32()), pa.array(at, pa.int64()), pa.array(ids, pa.binary())],
                    ["rid", "id", "block", "side", "at", "ids"],
                )
                rid += len(part)
        tidy(_STATE)

    return run


class _Digits:
    """Ids as decimal digits, each followed by what ends it."""

    def __init__(self, size: int):
        names = [str(i).encode() for i in range(size)]
        self.n = np.array(list(map(len, names)), np.int64)
        self.wide = int(self.n.max(initial=1)) + 1
        self.table = np.frombuffer(b"".join(w.ljust(self.wide, b"\0") for w in names), np.uint8).reshape(-1, self.wide)

    def text(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, where each id's begin and the end)."""
        n = self.n[ids]
        chars = self.table[ids]
        chars[np.arange(len(ids)), n] = ends
        return chars[np.arange(self.wide) <= n[:, None]], np.r_[0, np.cumsum(n + 1)]


class Sweep:
    """The state machine: what lies behind the last common end of the document at hand, and that document's results."""

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray], with_groups: bool = False):
        self.lengths, self.with_groups = lengths, with_groups
        self.digits = _Digits(max(map(len, lengths)))
        self.rid = self.id = None
        self.open: list[tuple[np.ndarray, np.ndarray]] = []
        self._begin(None, None)

    def _begin(self, rid, key) -> None:
        self.rid, self.id, self.n, self.groups, self.hash, self.behind = rid, key, [0, 0], 0, hashlib.sha256(), 0
        self.open = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2

    def _end(self, out: list) -> None:
        if self.rid is not None:
            sha = self.hash.hexdigest() if self.groups else ""
            out.append((self.rid, self.id, self.n[0], self.n[1], self.groups, sha, None, None, None))

    def take(self, rid: np.ndarray, keys: pa.Array, side: np.ndarray, at: np.ndarray, raw: np.ndarray, off: np.ndarray, groups: list) -> list:
        """Rows of (rid, id, n_a, n_b, n_groups, sha, and the links' a, b, n) for sorted rows of events."""
        out: list[tuple] = []
        heads = np.flatnonzero(np.r_[True, rid[1:] != rid[:-1]])
        doc = np.cumsum(np.r_[False, rid[1:] != rid[:-1]])
        if rid[0] != self.rid:
            self._end(out)
            self._begin(int(rid[0]), keys[0].as_py())
        ids, ends, of = [], [], []
        for s in (0, 1):
            rows = np.flatnonzero(side == s)
            n = off[rows + 1] - off[rows]
            up = np.r_[0, np.cumsum(n)]
            x = raw[np.repeat(off[rows] - up[:-1], n) + np.arange(up[-1])].astype(np.int64)
            end = np.r_[0, np.cumsum(self.lengths[s][x])]
            end = end[1:] - np.repeat(end[up[:-1]] - at[rows], n)
            o, e = self.open[s]
            ids.append(np.r_[o, x])
            ends.append(np.r_[e, end])
            of.append(np.r_[np.zeros(len(o), np.int64), np.repeat(doc[rows], n)])
        key_a, key_b = ((of[s] << 40) | ends[s] for s in (0, 1))
        where = np.searchsorted(key_b, key_a)
        both = where < len(key_b)
        both[both] = key_b[where[both]] == key_a[both]
        ea = np.flatnonzero(both)
        eb = where[ea]
        group_doc = of[0][ea]
        na, nb = np.diff(np.r_[0, ea + 1]), np.diff(np.r_[0, eb + 1])
        # ids in the order of the text: of each group A's, then B's
        base = np.r_[0, np.cumsum(na + nb)]
        seq, sep = np.empty(base[-1], np.int64), np.full(base[-1], ord(","), np.uint8)
        ka, kb = int(na.sum()), int(nb.sum())
        seq[np.arange(ka) + np.repeat(np.r_[0, np.cumsum(nb)[:-1]] if len(nb) else nb, na)] = ids[0][:ka]
        seq[np.arange(kb) + np.repeat(np.cumsum(na), nb)] = ids[1][:kb]
        sep[base[:-1] + na - 1] = ord("|")
        sep[base[1:] - 1] = ord(";")
        text, begin = self.digits.text(seq, sep)
        link = (group_doc << 40) | (ids[0][ea] << 20) | ids[1][eb]  # ids are below 2**20
        pairs, times = np.unique(link, return_counts=True)
        bounds = np.arange(len(heads) + 1)
        g = np.searchsorted(group_doc, bounds)
        p = np.searchsorted(pairs >> 40, bounds)
        a_of, b_of = np.searchsorted(of[0], bounds), np.searchsorted(of[1], bounds)
        if self.with_groups:
            self._groups(groups, rid[heads], keys, heads, g, ids, ends, ea, eb, na, nb)
        for k, h in enumerate(heads.tolist()):
            if k:
                self._end(out)
                self._begin(int(rid[h]), keys[h].as_py())
            x, y = int(begin[base[g[k]]]), int(begin[base[g[k + 1]]])
            if y > x:
                if self.groups:
                    self.hash.update(b";")
                self.hash.update(text[x : y - 1])
            self.groups += int(g[k + 1] - g[k])
            for s, o in ((0, a_of), (1, b_of)):
                self.n[s] += int(o[k + 1] - o[k]) - (len(self.open[s][0]) if k == 0 else 0)
            if p[k] < p[k + 1]:
                mine = pairs[p[k] : p[k + 1]]
                out.append((self.rid, None, None, None, None, None, (mine >> 20) & 0xFFFFF, mine & 0xFFFFF, times[p[k] : p[k + 1]]))
        if len(group_doc) and group_doc[-1] == bounds[-2]:
            self.behind = int(ends[0][ea[-1]])
        # what is open belongs to the last document: all others ended together
        self.open = [(ids[s][c:], ends[s][c:]) for s, c in ((0, ka), (1, kb))]
        return out

    def _groups(self, groups, rids, keys, heads, g, ids, ends, ea, eb, na, nb) -> None:
        end = ends[0][ea]
        for k, h in enumerate(heads.tolist()):
            for j in range(int(g[k]), int(g[k + 1])):
                first = int(end[j - 1]) if j > g[k] else (self.behind if k == 0 else 0)
                no = j - int(g[k]) + (self.groups if k == 0 else 0)
                groups.append((int(rids[k]), keys[h].as_py(), no, first, int(end[j]), ids[0][ea[j] + 1 - na[j] : ea[j] + 1], ids[1][eb[j] + 1 - nb[j] : eb[j] + 1]))


def _swept(a_path: str, b_path: str, width: str, key_type: pa.DataType, with_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _coder(a_path, b_path)
        sweep = Sweep(tuple(np.array(list(map(len, state[x])), np.int64) for x in ("a_bytes", "b_bytes")), with_groups)
        step = np.dtype(width).itemsize

        def made(rows: list, groups: list) -> Iterator[pa.RecordBatch]:
            if with_groups and groups:
                cols = list(zip(*groups, strict=True))
                kinds = [pa.int64(), key_type, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["rid", "id", "group", "begin", "end", "a", "b"])
            if not with_groups and rows:
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), key_type, pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 3]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["rid", "id", "n_a", "n_b", "n_groups", "sha", "a", "b", "n"])

        for batch in batches:
            _, every = string_bytes(batch.column(4))
            for lo, hi in slices(every, SWEPT):
                part, groups = batch.slice(lo, hi - lo), []
                raw, off = string_bytes(part.column(4))
                rows = sweep.take(part.column(0).to_numpy(), part.column(1), part.column(2).to_numpy(), part.column(3).to_numpy(), np.frombuffer(raw.tobytes(), width), off // step, groups)
                yield from made(rows, groups)
        last: list = []
        sweep._end(last)
        yield from made(last, [])
        tidy()

    return run


def _sorted_events(docs: DataFrame, a_path: str, b_path: str, key: str, text: str, slice_bytes: int, range_bytes: int) -> tuple[DataFrame, str, str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    most = max(len(bytes_of_a(a_path)), len(bytes_of_b(b_path)))
    if most > 1 << 20:
        raise ValueError("vocabularies of up to 2**20 ids")
    width = "<u2" if most <= 1 << 16 else "<u4"
    slim = docs.select(F.col(quoted(key)).alias("id"), F.col(quoted(text)).alias("text"))
    kind = slim.schema["id"].dataType
    events = slim.mapInArrow(_events(a_path, b_path, width, slice_bytes, range_bytes), f"rid long, id {kind.simpleString()}, block long, side int, at long, ids binary")
    dealt = events.repartition("rid").sortWithinPartitions("rid", "block", "side").select("rid", "id", "side", "at", "ids")
    return dealt, width, kind.simpleString(), to_arrow_type(kind)


def groups(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", slice_bytes: int = 2 << 20, range_bytes: int = RANGE) -> DataFrame:
    """One row for each group: (key, group from 0, begin, end in bytes of space and text, A's ids, B's ids); the last
    id of each side is the group's link. Texts without tokens have none."""
    dealt, width, kind, arrow = _sorted_events(docs, a_path, b_path, key, text, slice_bytes, range_bytes)
    out = dealt.mapInArrow(_swept(a_path, b_path, width, arrow, True), f"rid long, id {kind}, group long, begin long, end long, a array<int>, b array<int>")
    return out.drop("rid").withColumnRenamed("id", key)


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", slice_bytes: int = 2 << 20, range_bytes: int = RANGE) -> DataFrame:
    """One row for each document: (key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    A is a byte-level vocabulary over space and text, B a piece vocabulary that adds the space itself. Counts of id pairs
    cover all documents. Texts that are null or empty, or whose bytes a side doesn't give back, have zeros and ''.
    Special tokens' names are plain text. Rows are documents, whatever their key, so repeated ones count as often as
    they occur. An empty table gives no row. Other columns are not looked at.
    """
    dealt, width, kind, arrow = _sorted_events(docs, a_path, b_path, key, text, slice_bytes, range_bytes)
    swept = stored(dealt.mapInArrow(_swept(a_path, b_path, width, arrow, False), f"rid long, id {kind}, n_a long, n_b long, n_groups long, sha string, a array<int>, b array<int>, n array<int>"), "swept")
    links = swept.where("n is not null").select("rid", F.explode(F.arrays_zip("a", "b", "n")).alias("x")).select("rid", "x.*")
    counts = stored(links.groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    best = counts.groupBy("b").agg(F.max("count").alias("most"))
    rated = stored(counts.join(best, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("is_best")), "rated")
    n = F.col("n").cast("long")
    sums = links.join(small(rated, rated.count(), 32), ["a", "b"]).select("rid", n.alias("n_links"), F.when(F.col("is_best"), n).otherwise(0).alias("n_best"), (n * F.col("count")).alias("count_sum"))
    none = F.lit(0).cast("long")
    heads = swept.where("sha is not null").select("rid", "id", "n_a", "n_b", "n_groups", "sha", *[none.alias(c) for c in ("n_links", "n_best", "count_sum")])
    null = lambda c: F.lit(None).cast(heads.schema[c].dataType).alias(c)
    every = heads.unionByName(sums.select("rid", *[null(c) for c in ("id", "n_a", "n_b", "n_groups", "sha")], "n_links", "n_best", "count_sum"))
    out = every.groupBy("rid").agg(*[F.max(c).alias(c) for c in ("id", "n_a", "n_b", "n_groups")], *[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")], F.max("sha").alias("groups_sha256"))
    return out.select(F.col("id").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
