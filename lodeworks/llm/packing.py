"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens, served in quanta. Rounds go over the queues in turn; in each round a queue is owed
its target share of a sequence of tokens and gets as many whole quanta as its deficit counter allows, the rest being
carried to the next round. Targets are shares by source; without them, and among sources that have none, a source's
share is its part of the tokens. When a queue runs out, a phase ends: the others go on with their shares of what is
left, and their deficits go along.

Within a phase the counters have a closed form: all queues that are served end in its last round, so after round w of W
a queue that gives B quanta has been served floor(B w / W). So any task can say where a token goes from the queues'
lengths alone, deficits are carried across windows and partitions without any message between them, and no queue is
gathered anywhere. The smallest sources are one queue, in which they are queues by the same rule, and so on: that
bounds what a task sums over, and no source is out of control.

The stream is cut every ``length`` tokens. Only the last, short window is cut at powers of two, so nothing is padded.
Documents are cut freely; each token is in exactly one piece.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.llm.shared import quoted, small, stored
from lodeworks.llm.textops import CACHES, slices, string_bytes, tidy

#: Words kept by a worker with their ids.
CACHE_WORDS = 400_000
_STATE: dict = {}
CACHES.append(_STATE)


def muldiv(a: np.ndarray, b: int, c: int) -> np.ndarray:
    """floor(a b / c) for 0 <= a <= c without overflow, as long as the result fits, for c below 2**61."""
    return _muldivmod(a, b, c)[0]


def _muldivmod(a: np.ndarray, b: int, c: int) -> tuple[np.ndarray, np.ndarray]:
    """(quotient, rest) of a b / c by long division: a in digits that leave the rest times a digit in 63 bits."""
    a = np.asarray(a, np.int64)
    whole, part = divmod(int(b), int(c))
    bits = min(62 - int(c).bit_length(), 31)
    if bits < 1:
        raise ValueError("for c below 2**61")
    digits = -(-int(a.max(initial=0)).bit_length() // bits)
    q, r = np.zeros_like(a), np.zeros_like(a)
    for k in range(digits - 1, -1, -1):
        r = (r << bits) + part * ((a >> bits * k) & ((1 << bits) - 1))
        up, r = np.divmod(r, c)
        q = (q << bits) + up
    return a * whole + q, r


class Schedule:
    """The rounds over queues of ``tokens[s]`` tokens: which global positions a queue's tokens take."""

    def __init__(self, tokens: list[int], length: int = 2048, quantum: int = 64):
        self.tokens = np.array(tokens, np.int64)
        self.length, self.quantum, self.total = length, quantum, int(self.tokens.sum())
        self.quanta = -(-self.tokens // quantum)
        # no round is asked for more quanta than a queue has; a queue shorter than the rounds is served in some only
        self.rounds = max(1, -(-self.total // length))

    def served(self, s: int, w: np.ndarray) -> np.ndarray:
        """Tokens of queue s served before round w."""
        return np.minimum(self.quantum * muldiv(w, int(self.quanta[s]), self.rounds), self.tokens[s])

    def round_of(self, s: int, block: np.ndarray) -> np.ndarray:
        """The round that serves a quantum: the least w with floor(B (w+1) / W) > block."""
        b = int(self.quanta[s])
        down, rest = _muldivmod(block + 1, self.rounds, b)
        return down - (rest == 0)

    def place(self, s: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Global positions of tokens at ``start`` of queues s."""
        w, block = np.empty(len(s), np.int64), start // self.quantum
        for q in np.unique(s):
            own = s == q
            w[own] = self.round_of(int(q), block[own])
        rounds, at = np.unique(w, return_inverse=True)
        # neighbours are mostly served in the same rounds, so there are few rounds to sum over all queues for
        now = np.stack([self.served(q, rounds) for q in range(len(self.tokens))])
        then = np.stack([self.served(q, rounds + 1) for q in range(len(self.tokens))])
        first = now.sum(0) + np.vstack([np.zeros(len(rounds), np.int64), np.cumsum(then - now, 0)[:-1]]) - now
        return first[s, at] + start

    def sequence(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, offset in it, room after the offset) of global positions."""
        full = self.total // self.length
        seq, off = np.divmod(at, self.length)
        room = self.length - off
        tail = self.total - full * self.length
        edges = [0]
        for bit in reversed(range(tail.bit_length())):
            if tail >> bit & 1:
                edges.append(edges[-1] + (1 << bit))
        edges = np.array(edges, np.int64)
        last = seq >= full
        k = np.searchsorted(edges, off, "right") - 1
        k = np.minimum(k, len(edges) - 1)
        upper = edges[np.minimum(k + 1, len(edges) - 1)]
        return np.where(last, full + k, seq), np.where(last, off - edges[k], off), np.where(last, upper - off, room)


class Phases:
    """Queues with target shares: a phase ends when a queue runs out, and each phase is a Schedule of its own."""

    def __init__(self, tokens: list[int], shares: list[Fraction], length: int = 2048, quantum: int = 64):
        self.quantum = quantum
        # the time at which a queue ends, in tokens of all queues if all went on for ever
        ends = [Fraction(t) / p if t else Fraction(0) for t, p in zip(tokens, shares, strict=True)]
        at = np.zeros(len(tokens), np.int64)
        self.given, self.schedules, self.first = [at], [], [0]
        for end in sorted({e for e in ends if e}):
            # whole quanta until the end of the phase; a queue that ends gives all
            to = np.array([t if e <= end else max(int(a), min(t, int(p * end) // quantum * quantum)) for t, e, p, a in zip(tokens, ends, shares, at, strict=True)], np.int64)
            self.schedules.append(Schedule((to - at).tolist(), length, quantum))
            self.given.append(to)
            self.first.append(self.first[-1] + int((to - at).sum()))
            at = to

    def place(self, s: np.ndarray, start: np.ndarray) -> np.ndarray:
        out = np.empty(len(s), np.int64)
        phase = np.zeros(len(s), np.int64)
        for given in self.given[1:-1]:
            phase += start >= given[s]
        for k in np.unique(phase):
            own = phase == k
            out[own] = self.first[k] + self.schedules[k].place(s[own], start[own] - self.given[k][s[own]])
        return out


class Mixture:
    """Where the tokens of each source go.

    ``tokens`` and ``shares`` (None: none given) are by source; sources without a share have what the shares leave, in
    proportion to their tokens. The ``fan`` - 1 largest of those are queues, the others are one queue, and within it the
    same holds. Level 0 holds the phases; a source is a queue of some level.
    """

    def __init__(self, tokens: list[int], shares: list[float | None] | None = None, length: int = 2048, quantum: int = 64, fan: int = 256):
        shares = shares or [None] * len(tokens)
        self.quantum = quantum
        self.flat = Schedule([sum(tokens)], length, quantum)
        named = [i for i, p in enumerate(shares) if p is not None]
        rest = sorted((i for i, p in enumerate(shares) if p is None), key=lambda i: (-tokens[i], i))
        given = {i: Fraction(shares[i]) for i in named}
        if not rest:  # those that are there share all
            given = {i: p / sum(given.values()) for i, p in given.items()}
        left = 1 - sum(given.values())
        if any(p <= 0 for p in given.values()) or (rest and left <= 0):
            raise ValueError("shares are positive and leave something for the sources that have none")
        self.level, self.queue = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
        self.levels: list[Phases] = []
        while named or rest or not self.levels:
            own, rest = [*named, *rest[: fan - 1]], rest[fan - 1 :]
            sizes = [tokens[i] for i in own] + [sum(tokens[i] for i in rest)] * bool(rest)
            free = sum(sizes[len(named) :])
            parts = [given[i] for i in named] + [left * Fraction(t, free) if t else left for t in sizes[len(named) :]]
            self.level[own], self.queue[own] = len(self.levels), np.arange(len(own))
            self.levels.append(Phases(sizes or [0], parts or [Fraction(1)], length, quantum))
            named, left = [], Fraction(1)
        self.last = [len(x.given[0]) - 1 for x in self.levels]

    def runs(self, s: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, start in it, size, global position) of the runs that stay together of tokens first to first + n."""
        row, start, size, at = np.arange(len(s)), np.zeros(len(s), np.int64), n, first
        level, queue = self.level[s], self.queue[s]
        for k in range(len(self.levels) - 1, -1, -1):
            mine = level == k
            b0, b1 = at // self.quantum, (at + size - 1) // self.quantum
            many = np.where(mine, b1 - b0 + 1, 1)
            of = np.repeat(np.arange(len(row)), many)
            block = np.arange(len(of)) - np.repeat(np.r_[0, np.cumsum(many)][:-1], many) + b0[of]
            x = np.where(mine[of], np.maximum(at[of], block * self.quantum), at[of])
            end = np.where(mine[of], np.minimum((at + size)[of], (block + 1) * self.quantum), (at + size)[of])
            row, start, size, level, queue, mine = row[of], start[of] + x - at[of], end - x, level[of], queue[of], mine[of]
            x[mine] = self.levels[k].place(queue[mine], x[mine])
            at = x
            level = np.where(mine, k - 1, level)
            if k:
                queue[mine] = self.last[k - 1]
        return row, start, size, at

    def sequence(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.flat.sequence(at)


# The patterns of tokenizers that work on words, each on its own.
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PLAIN = re.compile("[a-zà-öø-ÿ]+").fullmatch


def _byte_chars() -> dict[int, int]:
    """The characters by which byte-level models write bytes: printable ones for themselves, others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [x for x in range(256) if x not in shown]
    return {x: x for x in shown} | {x: 256 + k for k, x in enumerate(rest)}


def works_on_words(tokenizer) -> bool:
    """Does this tokenizer lower-case, drop white space and apply a byte-level BPE to words of WORD_PATTERN?"""
    part = lambda x: json.loads(x.__getstate__()) if x is not None else {}
    norm, pre = part(tokenizer.normalizer), part(tokenizer.pre_tokenizer)
    split, level = (pre.get("pretokenizers") or [{}, {}])[:2]
    return (
        [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        and (split.get("pattern", {}).get("Regex"), split.get("behavior"), split.get("invert")) == (WORD_PATTERN, "Removed", True)
        and (level.get("type"), level.get("add_prefix_space"), level.get("use_regex")) == ("ByteLevel", False, False)
        and type(tokenizer.model).__name__ == "BPE"
        and tokenizer.post_processor is None
    )


def _encoder(path: str) -> dict:
    """The worker's tokenizer, its bare model and its cache of words."""
    if _STATE.get("path") != path:
        # a worker is one of many on its machine: threads of its own would only contend
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        _STATE.update(path=path, tokenizer=t, model=t.model, words=works_on_words(t), chars=_byte_chars(), cache={}, ends={})
        tidy(_STATE)
    return _STATE


def token_ids(col: pa.Array, path: str, end_id: int, cache_words: int = CACHE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of whole texts, each ended by end_id; null is empty.

    The tokenizer drops white space and none of its patterns looks across it; nor does one look from a letter or
    digit to the ASCII punctuation that ends a word, as long as the letter still is one when it is normalized (a few
    become a letter and a mark, and marks go with punctuation), and it lower-cases. So each text is taken as words between ASCII
    white space, each word as a stem and the punctuation at its end, and each distinct lower-cased stem is tokenized
    once for a slice; the ids, joined, are those of the text. Words with < or > are left whole for special tokens.
    A tokenizer of another kind gets whole texts.
    """
    if not _encoder(path)["words"]:
        every = [e.ids for e in _STATE["tokenizer"].encode_batch_fast([t or "" for t in col.to_pylist()], add_special_tokens=False)]
        off = np.r_[0, np.cumsum([len(x) + 1 for x in every])].astype(np.int64)
        return np.fromiter(chain.from_iterable((*x, end_id) for x in every), np.uint32, off[-1]), off
    lists = pc.ascii_split_whitespace(pc.fill_null(col, "").cast(pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary
    stem = pc.utf8_rtrim(names, characters="!\"#$%&()*+,-./:;=?@[\\]^_`{|}~")
    splits = pc.and_(_ends_in_letter(stem), pc.invert(pc.match_substring_regex(names, "[<>]")))
    stem = pc.if_else(splits, pc.ascii_lower(stem), names)
    tail = _tails(names, stem, splits)
    stems, tails = stem.dictionary_encode(), tail.dictionary_encode()
    size, base, flat = _encoded(stems.dictionary.to_pylist() + tails.dictionary.to_pylist(), path, cache_words)
    word = coded.indices.to_numpy(zero_copy_only=False)
    code = np.empty(2 * len(word), np.int64)
    code[0::2] = stems.indices.to_numpy(zero_copy_only=False)[word]
    code[1::2] = tails.indices.to_numpy(zero_copy_only=False)[word] + len(stems.dictionary)
    n = size[code]
    woff = lists.offsets.to_numpy().astype(np.int64)
    woff = woff - woff[0]
    start = np.r_[0, np.cumsum(n)]
    ids = flat[np.repeat(base[code] - start[:-1], n) + np.arange(start[-1])]
    ends = start[2 * woff]
    out = np.empty(len(ids) + len(lists), np.uint32)
    docs = np.repeat(np.arange(len(lists)), np.diff(ends))
    out[np.arange(len(ids)) + docs] = ids
    off = ends + np.arange(len(lists) + 1)
    out[off[1:] - 1] = end_id
    return out, off


def _ends_in_letter(stem: pa.Array) -> pa.Array:
    """Is the punctuation behind each stem a word of its own? Asked of the tokenizer, once for each last character."""
    last = pc.utf8_slice_codeunits(stem, -1).dictionary_encode()
    known, tokenizer = _STATE["ends"], _STATE["tokenizer"]
    for c in last.dictionary.to_pylist():
        if c not in known:
            seen = tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(f"{c}!"))
            known[c] = len(seen) > 1 and seen[-1][0] == "!"
    alone = pa.array([known[c] for c in last.dictionary.to_pylist()], pa.bool_()).take(last.indices)
    return pc.and_(alone, pc.match_substring_regex(stem, r"[\p{L}\p{N}]$"))


def _tails(names: pa.Array, stem: pa.Array, splits: pa.Array) -> pa.Array:
    """What follows the stem of each name that splits, else nothing."""
    raw, off = string_bytes(names)
    end = off[1:]
    begin = np.where(splits.to_numpy(zero_copy_only=False), off[:-1] + pc.binary_length(stem).to_numpy(zero_copy_only=False), end)
    n = end - begin
    at = np.r_[0, np.cumsum(n)]
    data = raw[np.repeat(begin - at[:-1], n) + np.arange(at[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(names), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _encoded(names: list[str], path: str, cache_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of ids, first positions, ids) of the names, from the worker's cache, the model or the tokenizer.

    A name of lower-case Latin letters is one word as it is, so the model alone gives its ids.
    """
    state = _encoder(path)
    cache, tokenizer, tokenize, chars = state["cache"], state["tokenizer"], state["model"].tokenize, state["chars"]
    got = list(map(cache.get, names))
    rest = []
    room = cache_words - len(cache)
    for i, x in enumerate(got):
        if x is None:
            w = names[i]
            if PLAIN(w):
                ids = array("I", [k.id for k in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(chars))]).tobytes()
                got[i] = ids
                if room > 0 and len(w) < 40:
                    cache[w] = ids
                    room -= 1
            else:
                rest.append(i)
    for at in range(0, len(rest), 10_000):
        part = rest[at : at + 10_000]
        for i, e in zip(part, tokenizer.encode_batch_fast([names[i] for i in part], add_special_tokens=False), strict=True):
            got[i] = array("I", e.ids).tobytes()
            if room > 0 and len(names[i]) < 40:
                cache[names[i]] = got[i]
                room -= 1
    size = np.fromiter(map(len, got), np.int64, len(got)) // 4
    return size, np.r_[0, np.cumsum(size)][:-1], np.frombuffer(b"".join(got), np.uint32)


def _tokenize(path: str, end_id: int, width: str, slice_bytes: int, cache_words: int):
    """Rows (id, queue name, chunk, tokens of the queue before it in the chunk, number of ids, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, before = TaskContext.get().partitionId(), {}
        for batch in batches:
            _, off = string_bytes(batch.column(2))
            for a, b in slices(off, slice_bytes):
                part = batch.slice(a, b - a)
                ids, at = token_ids(part.column(2), path, end_id, cache_words)
                n, start = np.diff(at), []
                for name, k in zip(part.column(1).to_pylist(), n.tolist(), strict=True):
                    start.append(before.get(name, 0))
                    before[name] = start[-1] + k
                raw = ids.astype(width)
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(np.full(len(n), chunk), pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array([raw[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                    ["id", "queue", "chunk", "start", "n", "ids"],
                )
        tidy(_STATE)

    return run


def _pieces(shared, width: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture: Mixture = shared.value
        for whole in batches:
            sizes = np.r_[0, np.cumsum(whole.column(whole.schema.get_field_index("n")).to_numpy())]
            for lo, hi in slices(sizes, 1 << 19):
                batch = whole.slice(lo, hi - lo)
                name = batch.schema.get_field_index
                keys, blobs = batch.column(name("id")), batch.column(name("ids")).to_pylist()
                q, first, n = (batch.column(name(c)).to_numpy() for c in ("q", "first", "n"))
                doc, start, size, at = mixture.runs(q, first, n)
                out = []
                while len(doc):  # cut at the ends of sequences
                    seq, off, room = mixture.sequence(at)
                    take = np.minimum(size, room)
                    out.append((doc, start, take, seq, off))
                    more = size > take
                    doc, start, size, at = doc[more], (start + take)[more], (size - take)[more], (at + take)[more]
                doc, start, take, seq, off = (np.concatenate(c) for c in zip(*out, strict=True))
                order = np.lexsort((start, doc))
                doc, start, take, seq, off = doc[order], start[order], take[order], seq[order], off[order]
                new = np.r_[True, (doc[1:] != doc[:-1]) | (seq[1:] != seq[:-1]) | (off[:-1] + take[:-1] != off[1:])]
                head = np.flatnonzero(new)
                take = np.add.reduceat(take, head)
                doc, start, seq, off = doc[head], start[head], seq[head], off[head]
                ids = [np.frombuffer(blobs[d], width)[s : s + t].astype("<u4").tobytes() for d, s, t in zip(doc.tolist(), start.tolist(), take.tolist(), strict=True)]
                cols = [keys.take(pa.array(doc)), pa.array(start), pa.array(take), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(n[doc]), pa.array(seq), pa.array(off), batch.column(name("queue")).take(pa.array(doc))]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"]
                if with_ids:
                    cols.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.record_batch(cols, names)
        tidy()

    return run


def pack(docs: DataFrame, vocabulary: str, length: int = 2048, quantum: int = 128, end_id: int = 1, key: str = "doc_id", text: str = "text", source: str = "source", targets: dict[str, float] | None = None, fan: int = 256, with_ids: bool = False, slice_bytes: int = 6 << 20, cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row for each piece of each document: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue).

    ``targets`` are shares of the tokens by source; sources that have none share what is left in proportion to their
    tokens, and so do all without targets. A source that runs out leaves its share to the others; nothing is repeated.
    Targets of sources that have no rows are as if they had run out. A window is off its targets by a few quanta at
    most: a smaller ``quantum`` follows the targets more closely and cuts documents into more pieces.

    A null text is empty: its document is end_id alone. A null source is a queue of its own. Sources are any number;
    the driver holds their names and lengths. Repeated rows are packed as often as they occur. ``slice_bytes`` of text
    are tokenized at once and a worker keeps the ids of ``cache_words`` words: less takes less memory and more time.
    Columns of docs beyond the three are not looked at. An empty table gives no piece.
    """
    from tokenizers import Tokenizer

    width = "<u2" if Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else "<u4"
    slim = docs.select(F.col(quoted(key)).alias("id"), F.col(quoted(source)).cast("string").alias("queue"), F.col(quoted(text)).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    tokens = stored(slim.mapInArrow(_tokenize(vocabulary, end_id, width, slice_bytes, cache_words), f"id {kind}, queue string, chunk long, start long, n long, ids binary"), "tokens")
    by_chunk = stored(tokens.groupBy("queue", "chunk").agg(F.sum("n").alias("tokens")), "chunks")
    named = sorted((r.queue is not None, r.queue or "", r.tokens) for r in by_chunk.groupBy("queue").agg(F.sum("tokens").alias("tokens")).collect())
    shares = [(targets or {}).get(q) if k else None for k, q, _ in named]
    mixture = docs.sparkSession.sparkContext.broadcast(Mixture([t for *_, t in named], shares, length, quantum, fan))
    number = docs.sparkSession.createDataFrame([(q if k else None, i) for i, (k, q, _) in enumerate(named)] or [(None, 0)], "queue string, q long")
    mine = by_chunk.join(small(number, len(named), 64), by_chunk["queue"].eqNullSafe(number["queue"])).select(by_chunk["queue"], "chunk", "tokens", "q")
    w = Window.partitionBy("q").orderBy("chunk")
    base = stored(mine.withColumn("base", F.sum("tokens").over(w) - F.col("tokens")).select(F.col("queue").alias("_queue"), F.col("chunk").alias("_chunk"), "q", "base"), "bases")
    placed = tokens.join(small(base, base.count(), 64), (F.col("chunk") == F.col("_chunk")) & F.col("queue").eqNullSafe(F.col("_queue"))).select("id", "queue", "q", (F.col("base") + F.col("start")).alias("first"), "n", "ids")
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string" + ", ids binary" * with_ids
    return placed.mapInArrow(_pieces(mixture, width, with_ids), schema).withColumnRenamed("id", key)


def assemble(pieces: DataFrame) -> DataFrame:
    """Sequences from ``pack(..., with_ids=True)``: (sequence_id, ids as little-endian 32-bit, n). At most ``length``
    tokens meet in a group, so groups are bounded."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
    got = pieces.groupBy("sequence_id").agg(rows.alias("r"))
    return got.select("sequence_id", F.aggregate("r", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n"))
