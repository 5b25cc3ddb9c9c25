"""N-gram Jaccard join with signature trees.

A document is its set of distinct k-word shingles, as 64-bit hashes. Two documents link when
den * intersection >= num * union.

1. One pass over the texts gives each document its set size, a digest of the set (its *node*: equal sets are one node)
   and segment keys. Hash space is cut into m segments; m is more than the largest symmetric difference that linked
   sets of that size class can have, so linked sets agree on at least one whole segment (pigeonhole). A set gives keys
   for its first D + 1 segments that hold something, where D is the largest difference that a set of its own size can
   have: of those of the set that stops first one is the other's as well. Nodes that
   share a segment key form the roots of the trees; nothing else can link.
2. The nodes of a key are a bucket. Buckets of the same least node come to one task, with their nodes' bitmaps once
   however many buckets a node is in. Each bucket is a signature tree over bitmaps: hierarchical nodes hold OR-combined
   bitmaps and size ranges. Dual traversal prunes node pairs whose greatest possible overlap is too small, and pairs whose
   leaves are already joined. What is left joins nodes to forests (connected components, in Spark).
3. The sets of a forest are gathered, and the same tree and traversal find its links, now verified on the exact sets.
   Only links that join two parts are emitted, so a group of many copies costs about one verification a copy, not a pair.
4. Links become components by least document id.

A group or forest of more than ``block_bytes`` is never one task. All its members are first compared with one of them,
the pivot, in a pass that needs no group at all; those that link to it are one part. Only the rest, in blocks, are then
compared with all, in blocks, each pair of blocks a task: near copies of one text are nearly all linked to the pivot,
so what is sent grows with the rest and not with the square of the group.

No cap, no sampling: every pair that links is found or is already connected through links that were verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.llm.shared import components, forget, quoted, small, stored, unused
from lodeworks.llm.textops import mix, pieces, tidy, window_hashes, words

#: Ratio of a size class's largest to its smallest set.
CLASS_RATIO = 1.5
#: Segments beyond the pigeonhole's need and the empty ones that are to be expected, so that those need no key of their own.
SPARE = 2
#: Segments that a set gives keys for if it has so many, where fewer would do: few keys are no load.
FEW = 8
#: Bytes of sets in one block.
BLOCK_BYTES = 16 << 20
LEAF, FAN = 16, 4


def shingle_sets(col: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes. With fewer than k words the whole sequence is one shingle."""
    for a, b, raw, off in pieces(col):
        h, at = words(raw, off)
        every = window_hashes(h, tuple(range(k)))
        for i in range(b - a):
            lo, n = int(at[i]), int(at[i + 1] - at[i])
            if n >= k:
                yield np.unique(every[lo : lo + n - k + 1])
            elif n:
                yield window_hashes(h[lo : lo + n], tuple(range(n))) + np.uint64(n)
            else:
                yield np.zeros(0, np.uint64)


def digest(s: np.ndarray) -> int:
    """A 64-bit digest of a set."""
    with np.errstate(over="ignore"):
        total = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def class_of(n: int) -> int:
    return int(np.floor(np.log(max(n, 1)) / np.log(CLASS_RATIO) + 1e-9))


@lru_cache(None)
def class_segments(c: int, num: int, den: int) -> int:
    """Segments for pairs whose larger set is in class c: more than their symmetric difference, those likely to be empty
    in the class's largest sets, and SPARE more.

    overlap >= num/(num+den) (a+b), so the difference is at most (den-num)/(den+num) (a+b) <= 2 (den-num)/(den+num) u.
    """
    most = largest(c)
    need = difference(most, most, num, den) + 1
    empty = need * np.exp(-most / need)
    return need + SPARE + int(empty + 3 * np.sqrt(empty))


def largest(c: int) -> int:
    """No set of class c is larger."""
    return int(np.ceil(CLASS_RATIO ** (c + 1)))


def difference(a: int, b: int, num: int, den: int) -> int:
    """The largest symmetric difference of linked sets of sizes up to a and b."""
    return (den - num) * (a + b) // (den + num)


def segment_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys for the set's own class and, where a linked larger set can be in the next class, for that one.

    A set of more than D segments that hold something gives a key for the first D + 1 of them, or FEW, in the order of
    hash space; any other gives one for every segment, empty ones too. Of two linked sets let A be the one whose last key
    is for the earlier segment: at most D of its D + 1 or more differ, so B holds the same in one of them, and B has a key for
    all of its segments up to there. Two sets with all keys agree on at least one of the m > D segments. Were empty
    segments given keys as a rule, all sets of a class with the same one empty would meet, and their pairs grow with the square.
    """
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    own = class_of(n)
    top = class_of(n * den // num)
    out = []
    mixed = np.concatenate([[np.uint64(0)], np.cumsum(mix(s ^ np.uint64(0x14057B7EF767814F)), dtype=np.uint64)])
    with np.errstate(over="ignore"):
        for c in range(own, top + 1):
            m = class_segments(c, num, den)
            seg = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            at = np.searchsorted(seg, np.arange(m + 1, dtype=np.uint64))
            total = mixed[at[1:]] - mixed[at[:-1]]
            need = difference(n, min(largest(c), n * den // num), num, den) + 1
            keep = np.flatnonzero(at[1:] > at[:-1])[: max(need, FEW)]
            if len(keep) < need:
                keep = np.arange(m)
            tag = np.uint64(c * 0x9E3779B1 + 1) + keep.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            out.append(mix(total[keep] + mix(tag)))
    return np.concatenate(out).view(np.int64)


def bitmap(s: np.ndarray) -> bytes:
    """One bit for each shingle, in a power of two of bits, at least twice the set's size and 256."""
    width = 256
    while width < 2 * len(s) and width < 1 << 16:
        width *= 2
    flag = np.zeros(width, np.uint8)
    flag[(mix(s) >> np.uint64(8)).astype(np.int64) & (width - 1)] = 1
    return np.packbits(flag, bitorder="little").tobytes()


def narrowed(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap in fewer words: halves are combined, which is what hashing to fewer bits gives."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def _sketch(k: int, num: int, den: int):
    """Sizes and nodes of all rows; keys and bitmap of a node only once a task, so copies add nothing to the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            n, node, keys, bits = [], [], [], []
            named = batch.column(0).is_valid().to_pylist()
            for i, s in enumerate(shingle_sets(batch.column(2), k)):
                n.append(len(s))
                node.append(digest(s))
                if len(s) and named[i] and node[-1] not in seen:
                    seen.add(node[-1])
                    keys.append(segment_keys(s, num, den))
                    bits.append(bitmap(s))
                else:
                    keys.append(np.zeros(0, np.int64))
                    bits.append(None)
            off = np.r_[0, np.cumsum([len(x) for x in keys])].astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat)), pa.array(bits, pa.binary())], ["id", "h", "n", "node", "keys", "bits"])
        tidy()

    return run


def _sets(k: int):
    """The sets of the texts, in batches of bounded bytes; g and id go along. Rows that repeat an id give one a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = [x not in seen and not seen.add(x) for x in batch.column(1).to_pylist()]
            batch = batch if all(new) else batch.filter(pa.array(new))
            done, size, part = 0, 0, []
            for s in shingle_sets(batch.column(2), k):
                part.append(s)
                size += s.nbytes
                if size > BLOCK_BYTES // 2 or done + len(part) == len(batch):
                    rest = batch.slice(done, len(part))
                    yield pa.record_batch([rest.column(0), rest.column(1), pa.array([len(x) for x in part], pa.int64()), pa.array([x.tobytes() for x in part], pa.binary())], ["g", "id", "n", "data"])
                    done, size, part = done + len(part), 0, []
        tidy()

    return run


class Tree:
    """A signature tree: leaves of LEAF sets, FAN children a node, arrays by level from the leaves up. It knows the
    sets by their sizes and bitmaps; ``near`` puts sets that are likely alike next to each other."""

    def __init__(self, size: np.ndarray, bitmaps: list[bytes], near: np.ndarray):
        band = np.floor(np.log(size) / np.log(1.1)).astype(np.int64)
        self.order = np.lexsort((size, near, band))
        self.n = size[self.order].astype(np.int64)
        words = min(len(b) for b in bitmaps) // 8
        self.bits = np.stack([narrowed(np.frombuffer(bitmaps[i], np.uint64), words) for i in self.order])
        self.ones = np.bitwise_count(self.bits).sum(1).astype(np.int64)
        #: By level: OR of bitmaps, least and largest size, most of (size - bits set), first and end row.
        at = np.arange(0, len(size), LEAF)
        self.levels = [(np.bitwise_or.reduceat(self.bits, at), np.minimum.reduceat(self.n, at), np.maximum.reduceat(self.n, at), np.maximum.reduceat(self.n - self.ones, at), at, np.r_[at[1:], len(size)])]
        while len(self.levels[-1][0]) > 1:
            o, lo, hi, extra, first, end = self.levels[-1]
            at = np.arange(0, len(o), FAN)
            self.levels.append((np.bitwise_or.reduceat(o, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(extra, at), first[at], end[np.r_[at[1:] - 1, len(o) - 1]]))


def possible(size: np.ndarray, bitmaps: list[bytes], num: int, den: int) -> bool:
    """Do two sets' bitmaps allow a link?"""
    words = min(map(len, bitmaps)) // 8
    x, y = (narrowed(np.frombuffer(b, np.uint64), words) for b in bitmaps)
    both = int(np.bitwise_count(x & y).sum())
    a, b = (int(n) - int(np.bitwise_count(v).sum()) for n, v in zip(size, (x, y), strict=True))
    return (num + den) * min(both + a, both + b, int(size.min())) >= num * int(size.sum())


def linked(size: np.ndarray, bitmaps: list[bytes], near: np.ndarray, num: int, den: int, sets: list[np.ndarray] | None = None, known: np.ndarray | None = None) -> np.ndarray:
    """The part (a row index) of each set after all its links; without the sets themselves, after all pairs that
    their bitmaps don't rule out. Rows of equal ``known`` are one part from the start."""
    m = len(size)
    part = np.arange(m)
    if m < 2:
        return part
    if m == 2 and sets is None:
        return np.zeros(2, np.int64) if possible(size, bitmaps, num, den) else part
    tree = Tree(size, bitmaps, near)
    order, n, levels = tree.order, tree.n, tree.levels
    up = np.arange(m)  # union-find over rows of the tree
    if known is not None:
        _, first, of = np.unique(known[order], return_index=True, return_inverse=True)
        up[:] = first[of]

    def find(a: int) -> int:
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def roots(a: int, b: int) -> np.ndarray:
        r = up[a:b]
        while True:
            q = up[r]
            if (q == r).all():
                up[a:b] = r
                return r
            r = q

    def verify(a: int, b: int) -> bool:
        if sets is None:
            return True
        x, y = sets[order[a]], sets[order[b]]
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
        return den * both >= num * (len(x) + len(y) - both)

    todo = [(len(levels) - 1, 0, 0)]
    while todo:
        level, i, j = todo.pop()
        bits, lo, hi, extra, first, end = levels[level]
        ra, rb = roots(first[i], end[i]), roots(first[j], end[j])
        if ra[0] == rb[0] and (ra == ra[0]).all() and (rb == rb[0]).all():
            continue
        if i != j:
            if den * hi[i] < num * lo[j] or den * hi[j] < num * lo[i]:
                continue
            # a set of n elements has at least n - extra bits; those outside the other node's bitmap are not shared
            both = int(np.bitwise_count(bits[i] & bits[j]).sum())
            most = min(both + extra[i], both + extra[j], hi[i], hi[j])
            if (num + den) * most < num * (lo[i] + lo[j]):
                continue
        if level:
            below = len(levels[level - 1][1])
            a, b = range(i * FAN, min((i + 1) * FAN, below)), range(j * FAN, min((j + 1) * FAN, below))
            pairs = [(x, y) for x in a for y in b if i != j or x < y]
            todo += [(level - 1, x, y) for x, y in pairs]
            if i == j:
                todo += [(level - 1, x, x) for x in a]
            continue
        x, y = np.arange(first[i], end[i]), np.arange(first[j], end[j])
        both = np.bitwise_count(tree.bits[x][:, None, :] & tree.bits[y][None, :, :]).sum(2).astype(np.int64)
        most = np.minimum(both + (n[x] - tree.ones[x])[:, None], both + (n[y] - tree.ones[y])[None, :])
        most = np.minimum(most, np.minimum(n[x][:, None], n[y][None, :]))
        good = (num + den) * most >= num * (n[x][:, None] + n[y][None, :])
        for p, q in zip(*np.nonzero(good), strict=True):
            a, b = x[p], y[q]
            if a < b and find(a) != find(b) and verify(a, b):
                u, v = find(a), find(b)
                up[max(u, v)] = min(u, v)
    part[order] = order[roots(0, m)]
    return part


def _as_set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _groups(num: int, den: int, exact: bool):
    """In each group g, links (a, b) to the least id of its part; ``data`` are bitmaps or, if exact, the sets. Rows marked
    as ``one`` are known to be one part."""

    def run(table: pa.Table) -> pa.Table:
        g, ids, n, one = (table.column(c).to_numpy() for c in ("g", "id", "n", "one"))
        data = table.column("data").to_pylist()
        order = np.argsort(g, kind="stable")
        cut = np.flatnonzero(np.r_[True, g[order][1:] != g[order][:-1], True])
        a, b = [], []
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            rows = order[x:y]
            known = np.where(one[rows], -1, np.arange(len(rows)))
            if exact:
                sets = [_as_set(data[r]) for r in rows]
                part = linked(n[rows], [bitmap(s) for s in sets], np.array([s[0] for s in sets]), num, den, sets, known)
            else:
                part = linked(n[rows], [data[r] for r in rows], n[rows], num, den, known=known)
            least = np.full(len(rows), np.iinfo(np.int64).max)
            np.minimum.at(least, part, ids[rows])
            to = least[part]
            off = to != ids[rows]
            a.append(ids[rows][off])
            b.append(to[off])
        tidy()
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})

    return run


def _star(num: int, den: int, exact: bool):
    """Is each row linked to its group's pivot (or, by bitmaps, not ruled out)?"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, pn = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("n", "pn"))
            one = []
            for i, (x, y) in enumerate(zip(batch.column(batch.schema.get_field_index("data")).to_pylist(), batch.column(batch.schema.get_field_index("pdata")).to_pylist(), strict=True)):
                size = np.array([n[i], pn[i]])
                if exact:
                    sets = [_as_set(x), _as_set(y)]
                    part = linked(size, [bitmap(s) for s in sets], size, num, den, sets)
                else:
                    part = linked(size, [x, y], size, num, den)
                one.append(bool(part[0] == part[1]))
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(c)) for c in ("g", "id", "n", "data", "pivot", "k")), pa.array(one, pa.bool_())], ["g", "id", "n", "data", "pivot", "k", "one"])
        tidy()

    return run


def _plausible(num: int, den: int):
    """Of buckets (key, node) and the nodes' bitmaps, each once: links that join the nodes of each bucket whose bitmaps
    and sizes allow a link. Parts are kept from bucket to bucket, and buckets of the same nodes are one."""

    def run(rows: pa.Table, about: pa.Table) -> pa.Table:
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not len(rows):
            return none
        node, n, bits = about.column("own").to_numpy(), about.column("n").to_numpy(), about.column("bits").to_pylist()
        sort = np.argsort(node)
        key, at = rows.column("key").to_numpy(), sort[np.searchsorted(node[sort], rows.column("node").to_numpy())]
        order = np.lexsort((at, key))
        cut = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1], True])
        root, seen = np.arange(len(node)), set()
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            own = at[order[x:y]]
            if (name := own.tobytes()) in seen:
                continue
            seen.add(name)
            known = root[own]
            while (root[known] != known).any():
                known = root[known]
            root[own] = known
            if (known == known[0]).all():
                continue
            part = linked(n[own], [bits[i] for i in own], n[own], num, den, known=known)
            for i in np.flatnonzero(part != np.arange(len(part))):
                u, v = known[i], known[part[i]]
                while root[u] != u:
                    u = root[u]
                while root[v] != v:
                    v = root[v]
                root[max(u, v)] = min(u, v)
        while (root[root] != root).any():
            root = root[root]
        off = root != np.arange(len(root))
        tidy()
        return pa.table({"a": node[off], "b": node[root[off]]})

    return run


def _weighed(rows: DataFrame, size: Column, block_bytes: int) -> tuple[int, DataFrame, int]:
    """(tasks to deal groups to, groups of more than a block with their least id and number of blocks, their number)."""
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    by = rows.groupBy("g").agg(F.sum(size).alias("bytes"), F.min("id").alias("pivot"))
    big = stored(by.where(F.col("bytes") > block_bytes).select("g", "pivot", (F.floor(F.col("bytes") / block_bytes) + 1).alias("k")), "big")
    return int(total // max(block_bytes // 8, 1)) + 32, big, big.count()


def _large(rows: DataFrame, big: DataFrame, many: int, num: int, den: int, exact: bool, block_bytes: int) -> DataFrame:
    """(a, b): links of the members (g, id, n, data) of large groups, by their pivots and then in pairs of blocks."""
    size = F.octet_length("data") + 32
    hot = rows.join(small(big, many, 32), "g")
    pivots = stored(hot.where("id = pivot").select("g", F.col("n").alias("pn"), F.col("data").alias("pdata")).dropDuplicates(["g"]), "pivots")
    width = pivots.agg(F.coalesce(F.sum(F.octet_length("pdata") + 32), F.lit(0))).first()[0]
    starred = stored(hot.join(small(pivots, 1, width), "g").mapInArrow(_star(num, den, exact), "g long, id long, n long, data binary, pivot long, k long, one boolean"), "starred")
    rest = starred.where("not one").groupBy("g").agg((F.floor(F.sum(size) / block_bytes) + 1).alias("kr"))
    w = starred.join(small(rest, many, 24), "g")
    block = lambda k: F.pmod(F.xxhash64("id"), F.col(k))
    every = w.select("g", "id", "n", "data", "one", F.explode(F.sequence(F.lit(0).cast("long"), F.col("kr") - 1)).alias("i"), block("k").alias("j"))
    left = w.where("not one").select("g", "id", "n", "data", "one", block("kr").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("j"))
    met = every.unionByName(left).groupBy(F.col("g").alias("group"), "i", "j").applyInArrow(_groups(num, den, exact), "a long, b long")
    return starred.where("one and id != pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).unionByName(met)


def links(rows: DataFrame, num: int, den: int, block_bytes: int) -> tuple[DataFrame, bool]:
    """(a, b) that join the linked members of each forest of a stored table of sets (g, id, n, data), and whether each
    forest's members all came to the least of their part, so that no components are left to be found."""
    deals, big, many = _weighed(rows, F.octet_length("data") + 32, block_bytes)
    calm = rows if not many else rows.join(small(big, many, 32), "g", "left_anti")
    dealt = calm.select(F.pmod(F.xxhash64("g"), F.lit(deals)).alias("deal"), "g", "id", "n", "data", F.lit(False).alias("one"))
    out = dealt.groupBy("deal").applyInArrow(_groups(num, den, True), "a long, b long")
    return (out.unionByName(_large(rows, big, many, num, den, True, block_bytes)), False) if many else (out, True)


#: Rows of buckets in a task.
TASK_ROWS = 20_000


def plausible(met: DataFrame, about: DataFrame, num: int, den: int, block_bytes: int) -> DataFrame:
    """(a, b) that join the nodes whose bitmaps allow a link, of a stored table of meetings (key, g, node) and of the
    nodes' sizes and bitmaps (node, n, bits). Buckets whose least node is the same come to one task with their nodes'
    bitmaps, each once; a bucket with too many of them is a large group."""
    pairs = met.select("g", F.col("node").alias("id")).distinct()
    width = about.select(F.col("node").alias("id"), F.col("n"), (F.octet_length("bits") + 32).alias("width"))
    sized = stored(pairs.join(width, "id"), "pairs")
    deals, big, many = _weighed(sized, F.col("width"), block_bytes)
    deals = max(deals, int(met.count() // TASK_ROWS))
    calm = met if not many else met.join(small(big, many, 32), "g", "left_anti")
    # a least node of very many buckets has them dealt to several tasks, each with the bitmaps that it needs
    wide = stored(met.groupBy("g").agg((F.floor(F.count(F.lit(1)) / TASK_ROWS) + 1).alias("s")).where("s > 1"), "wide")
    n_wide = wide.count()
    part = F.lit(0).cast("long")
    if n_wide:
        calm, part = calm.join(small(wide, n_wide, 24), "g", "left"), F.coalesce(F.pmod(F.xxhash64("key"), F.col("s")), F.lit(0))
    dealt = calm.select(F.pmod(F.xxhash64("g", part), F.lit(deals)).alias("deal"), "key", "node")
    bitmaps = dealt.select(F.col("deal").alias("to"), F.col("node").alias("own")).distinct().join(about, F.col("own") == F.col("node")).select("to", "own", "n", "bits")
    out = dealt.groupBy("deal").cogroup(bitmaps.groupBy("to")).applyInArrow(_plausible(num, den), "a long, b long")
    if many:
        rows = sized.join(small(big.select("g"), many, 16), "g", "left_semi").join(about.select(F.col("node").alias("id"), F.col("bits").alias("data")), "id").select("g", "id", "n", "data")
        out = out.unionByName(_large(rows, big, many, num, den, False, block_bytes))
    return out


#: Nodes under one key beyond which the key is hot, and the share of the nodes by which hot keys are found.
HOT_NODES, HOT_SHARE = 20_000, 64


def meetings(seg: DataFrame) -> DataFrame:
    """(key, g, node): the nodes that meet under a key, each with the least node (g) of that key, each once.

    Rows of a key are dealt to one task, but for the hot keys: their least node is found by partial aggregation. Which
    keys are hot is estimated from every 64th node; that decides the way only, and both ways give the same.
    """
    w = Window.partitionBy("key")
    counted = seg.where(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(HOT_SHARE)) == 0).groupBy("key").count()
    heavy = stored(counted.where(F.col("count") > HOT_NODES // HOT_SHARE).select("key"), "heavy")
    many = heavy.count()
    cold = seg if not many else seg.join(small(heavy, many, 16), "key", "left_anti")
    met = cold.select("key", "node", F.min("node").over(w).alias("g"), F.max("node").over(w).alias("hi")).where("g < hi").select("key", "g", "node")
    if many:
        hot = seg.join(small(heavy, many, 16), "key")
        ends = hot.groupBy("key").agg(F.min("node").alias("g"), F.max("node").alias("hi")).where("g < hi")
        met = met.unionByName(hot.join(small(ends, many, 32), "key").select("key", "g", "node"))
    return met.distinct()


def _solved(docs: DataFrame, k: int, num: int, den: int, key: str, text: str, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """A row (id, h, n, node) for each of docs, and by node (node, least (id, h) of its component)."""
    slim = docs.select(F.col(quoted(key)).cast("long").alias("id"), F.xxhash64(F.col(quoted(text))).alias("h"), F.col(quoted(text)).alias("text"))
    sketch = stored(slim.mapInArrow(_sketch(k, num, den), "id long, h long, n long, node long, keys array<long>, bits binary"), "sketch")
    keyed = sketch.where("id is not null and n > 0")
    first = keyed.where("bits is not null")
    met = stored(meetings(first.select("node", F.explode("keys").alias("key"))), "meetings")
    nodes = stored(met.select("node").distinct(), "nodes")
    about = stored(first.join(small(nodes, nodes.count(), 16), "node", "left_semi").select("node", "n", "bits").dropDuplicates(["node"]), "bitmaps")
    trees = components(plausible(met, about, num, den, block_bytes))
    forget(met, about, nodes)
    reps = keyed.groupBy("node").agg(F.min(F.struct("id", "h")).alias("r"))
    wanted = stored(trees.join(reps, "node").select("node", F.col("label").alias("g"), F.col("r.id").alias("rep"), F.col("r.h").alias("rh")), "members")
    count = wanted.count()
    texts = slim.join(small(wanted, count, 48), (F.col("id") == F.col("rep")) & (F.col("h") == F.col("rh")))
    sets = stored(texts.select("g", F.col("node").alias("id"), "text").mapInArrow(_sets(k), "g long, id long, n long, data binary"), "sets")
    found, closed = links(sets, num, den, block_bytes)
    found = stored(found, "links")
    forget(sets)
    to = found.select(F.col("a").alias("node"), F.col("b").alias("label")) if closed else components(found)
    to = to.groupBy("node").agg(F.min("label").alias("label"))
    labels = reps.join(to, "node", "left").select("node", "r", F.coalesce("label", "node").alias("label"))
    least = labels.groupBy("label").agg(F.min("r").alias("c"))
    return sketch.select("id", "h", "n", "node"), labels.join(least, "label").select("node", "c")


def join(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, n_shingles, component_id): one row for each row of docs.

    component_id is the least key reachable by links, itself included. Null and wordless texts have no shingles and
    are linked with nothing. A null key links nothing and gets a null component, as it can't be told from others.
    Repeated rows link to each other like any equal texts; rows that repeat a key with another text are rows of their
    own. Other columns of docs are not looked at.
    """
    rows, labels = _solved(docs, k, num, den, key, text, block_bytes)
    out = rows.join(labels.select("node", F.col("c.id").alias("component")), "node", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without near-duplicates: of each component the row of least key stays (of its texts, that of least hash);
    all columns are kept, whatever their names.

    Of rows that repeat both key and text one stays. Rows with a null key and rows without a word all stay.
    """
    rows, labels = _solved(docs, k, num, den, key, text, block_bytes)
    id_, h, c = unused(docs, "id", "h", "count")
    named = rows.where("id is not null and n > 0").join(labels, "node")
    counted = stored(named.groupBy("id", "h").agg(F.max(F.struct("id", "h") == F.col("c")).alias("stays"), F.count(F.lit(1)).alias("rows")), "verdicts")
    gone = counted.where("not stays").select(F.col("id").alias(id_), F.col("h").alias(h))
    twice = counted.where("stays and rows > 1").select(F.col("id").alias(id_), F.col("h").alias(h))
    n_gone, n_twice = gone.count(), twice.count()
    on = [id_, h]
    out = docs.withColumn(id_, F.col(quoted(key)).cast("long")).withColumn(h, F.xxhash64(F.col(quoted(text)))).join(small(gone, n_gone, 24), on, "left_anti")
    if n_twice:
        out = out.join(small(twice, n_twice, 24), on, "left_anti").unionByName(out.join(small(twice, n_twice, 24), on, "left_semi").dropDuplicates(on))
    return out.select(*[F.col(quoted(c)) for c in docs.columns])
