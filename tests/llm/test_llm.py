"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import itertools
import math
import re
import struct
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeworks.llm import additive_ann, centroid_lid, cotrain, hash_tree, jaccard_tree, license_scan, line_dedup, packing, preference, spaced_seed
from lodeworks.llm.shared import components
from lodeworks.shipping import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def prose(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(n))


def corpus(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_texts():
    """Null, empty, blank, short, repeated and long texts."""
    rng = np.random.default_rng(5)
    base = prose(rng, 120)
    edit = base.split()
    edit[40] = "changed"
    return [None, "", " \n\t ", "one", "one two", base, base, base.upper(), " ".join(edit), base + " tail", prose(rng, 30_000), prose(rng, 60), "x" * 300_000, None, ""]


def empty(spark):
    return spark.createDataFrame([], DOCS)


def odd_frame(spark):
    """All columns null in places, a repeated row, a null key, and columns whose names clash with the operators' own."""
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None if i % 3 == 0 else 5) for i, t in enumerate(odd_texts())]
    rows += [rows[5], rows[5], (None, rows[5][1], "en", "s0", 1), (None, None, None, None, None)]
    d = spark.createDataFrame(rows, DOCS)
    for c in ("score", "node", "comp", "uid", "id", "q", "n", "key", "queue", "chunk", "lang_pred", "removed_runs", "label", "rep", "_key", "keys"):
        d = d.withColumn(c, F.lit("own"))
    return d


# ---- shared


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    size = Counter(map(find, root))
    assert got == {x: find(x) for x in root if size[find(x)] > 1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 5: Jaccard join


def brute_components(texts, k, num, den):
    sets = []
    for t in texts:
        w = re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    part = list(range(len(texts)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                part[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


def near_texts(seed, groups=12):
    """Groups of near copies at many distances around the threshold, with shared passages between groups."""
    rng = np.random.default_rng(seed)
    shared = prose(rng, 25)
    out = []
    for _ in range(groups):
        base = prose(rng, int(rng.integers(3, 150))).split()
        for _ in range(int(rng.integers(1, 7))):
            w = list(base)
            for _ in range(int(rng.integers(0, 6))):
                w[int(rng.integers(len(w)))] = prose(rng, 1)
            out.append(" ".join(w) + (" " + shared if rng.random() < 0.3 else ""))
    return out


@pytest.mark.parametrize(("seed", "k", "num", "block"), [(1, 3, 90, 24 << 20), (2, 5, 80, 24 << 20), (3, 1, 50, 24 << 20), (4, 5, 80, 4000)])
def test_join_is_exact(spark, seed, k, num, block):
    texts = near_texts(seed) + odd_texts()
    got = sorted(jaccard_tree.join(corpus(spark, texts), k, num, 100, block_bytes=block).collect())
    sizes, parts = brute_components(texts, k, num, 100)
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got] == list(zip(range(len(texts)), sizes, parts, strict=True))


@pytest.mark.parametrize(("seed", "copies", "k", "num"), [(21, 2, 1, 80), (22, 4, 3, 90), (23, 2, 5, 80)])
def test_join_is_exact_with_copies_and_hot_keys(spark, monkeypatch, seed, copies, k, num):
    """Each near copy has exact copies; keys of four nodes count as hot and groups of 3000 bytes as large."""
    monkeypatch.setattr(jaccard_tree, "HOT_NODES", 4)
    monkeypatch.setattr(jaccard_tree, "HOT_SHARE", 1)
    monkeypatch.setattr(jaccard_tree, "TASK_ROWS", 20)
    texts = [t for t in near_texts(seed) for _ in range(copies)]
    got = sorted(jaccard_tree.join(corpus(spark, texts), k, num, 100, block_bytes=3000).collect())
    assert [r.component_id for r in got] == brute_components(texts, k, num, 100)[1]


def test_one_large_group_of_near_copies(spark):
    """Most members link to the pivot of their group; the rest is compared with all in blocks."""
    rng = np.random.default_rng(31)
    base = prose(rng, 90).split()
    texts = []
    for i in range(70):
        w = list(base)
        for _ in range(1 + i % 9):
            w[int(rng.integers(len(w)))] = prose(rng, 1)
        texts.append(" ".join(w))
    got = sorted(jaccard_tree.join(corpus(spark, texts), 5, 80, 100, block_bytes=4000).collect())
    parts = brute_components(texts, 5, 80, 100)[1]
    assert [r.component_id for r in got] == parts
    kept = jaccard_tree.keep_one(corpus(spark, texts), block_bytes=4000).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(parts))


def test_keep_one_with_repeated_keys_and_clashing_names(spark):
    rng = np.random.default_rng(32)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(1, a, "x"), (1, b, "y"), (1, a, "z"), (2, a, "x"), (3, b.upper(), "y"), (None, a, "n"), (4, "", "e"), (4, None, "e")]
    d = spark.createDataFrame(rows, "doc_id long, text string, _keep string").withColumn("ID", F.lit("own")).withColumn("h", F.lit(1)).withColumn("a.b", F.lit(2))
    got = jaccard_tree.keep_one(d)
    assert got.columns == d.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, a), (1, b), (None, a), (4, ""), (4, None)])
    assert {(r.ID, r.h, r["a.b"]) for r in got.collect()} == {("own", 1, 2)}


@pytest.mark.parametrize(("num", "den"), [(80, 100), (90, 100), (1, 2)])
def test_linked_sets_share_a_key(num, den):
    """Pairs with as small an overlap as links allow, of even and uneven sizes, meet under a key."""
    rng = np.random.default_rng(5)
    for _ in range(1500):
        n = int(rng.integers(1, rng.choice((12, 80, 900))))
        out = int(rng.integers(0, n * (den - num) // den + 1))  # gone from the one set
        more = (den * (n - out) - num * n) // num  # and come to the other
        pool = rng.integers(0, 1 << 64, n + more, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[out:])
        both = len(np.intersect1d(a, b))
        assert den * both >= num * (len(a) + len(b) - both)
        assert np.intersect1d(jaccard_tree.segment_keys(a, num, den), jaccard_tree.segment_keys(b, num, den)).size, (n, out, more)


@pytest.mark.parametrize(("num", "den"), [(80, 100), (90, 100)])
def test_unlike_sets_of_a_class_do_not_meet_by_empty_segments(num, den):
    """Sets without a common shingle share no key, so what is compared does not grow with the square of the documents."""
    rng = np.random.default_rng(6)
    for low, high in ((100, 150), (580, 740), (5000, 7500)):
        keys = np.concatenate([jaccard_tree.segment_keys(np.unique(rng.integers(0, 1 << 64, rng.integers(low, high), dtype=np.uint64)), num, den) for _ in range(200)])
        assert len(keys) == len(np.unique(keys)), low


def test_buckets_of_even_copies_stay_apart(spark):
    """Buckets {L, H, Z} with Z twice: L and H hold the extreme digests, and each Z meets L in its own bucket only."""
    k, num, den = 3, 90, 100
    rng = np.random.default_rng(3)

    def sketch(text):
        s = next(iter(jaccard_tree.shingle_sets(pa.array([text]), k)))
        return s, jaccard_tree.digest(s), set(jaccard_tree.segment_keys(s, num, den).tolist())

    word = lambda: prose(rng, 1, "abcdefghijklmnop")
    only: dict[int, str] = {}
    while len(only) < 4:
        base = prose(rng, 22, "abcdefghijklmnop")
        far = f"{base} {word()}"
        low, high = sketch(base), sketch(far)
        ends = sorted((low[1], high[1]))
        if len(low[0]) != 20 or len(low[2]) != 5 or len(low[2] & high[2]) != 4 or ends[1] - ends[0] < 8 << 60:
            continue
        only = {}
        for _ in range(400):
            z = f"{word()} {base} {word()}"
            s = sketch(z)
            gone = (low[2] & high[2]) - s[2]
            if ends[0] < s[1] < ends[1] and len(gone) == 1 and not (low[2] - high[2]) & s[2]:
                only.setdefault(min(gone), z)
    texts = [base, far, *(z for z in only.values() for _ in range(2))]
    got = sorted(jaccard_tree.join(corpus(spark, texts), k, num, den).collect())
    assert [r.component_id for r in got] == brute_components(texts, k, num, den)[1]


def test_tree_prunes_nothing_that_links():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, 80, dtype=np.uint64)
        sets += [np.unique(np.r_[base[: 80 - c], rng.integers(0, 2**63, c, dtype=np.uint64)]) for c in (0, 1, 5, 9)]
    size, near, bits = np.array([len(s) for s in sets]), np.array([s[0] for s in sets]), [jaccard_tree.bitmap(s) for s in sets]
    part = jaccard_tree.linked(size, bits, near, 80, 100, sets)
    loose = jaccard_tree.linked(size, bits, near, 80, 100)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert part[i] == part[j] and loose[i] == loose[j]


def test_join_and_keep_one_on_odd_rows(spark):
    d = odd_frame(spark)
    assert jaccard_tree.join(d).count() == d.count()
    assert jaccard_tree.join(empty(spark)).count() == 0
    kept = jaccard_tree.keep_one(d)
    assert kept.columns == d.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 4, 5, 10, 11, 12, 13, 14] and ids.count(None) == 2


# ---- 2: line dedup


def brute_lines(docs, min_words):
    seqs = [[(n, x.strip(" \t\n\v\f\r"), len(re.findall(WORD, x))) for n, x in enumerate((t or "").split("\n")) if re.findall(WORD, x)] for _, t in docs]
    seen, gone = set(), [set() for _ in docs]
    for i in sorted(range(len(docs)), key=lambda i: docs[i][0]):
        for a in range(len(seqs[i])):
            words, run = 0, ()
            for n, line, w in seqs[i][a:]:
                words, run = words + w, (*run, line)
                if words >= min_words:
                    if run in seen:
                        gone[i].update(range(seqs[i][a][0], n + 1))
                    seen.add(run)
    for s, g in zip(seqs, gone, strict=True):  # blank lines between two lines that go
        at = [n for n, *_ in s]
        for a, b in zip(at, at[1:], strict=False):
            if a in g and b in g:
                g.update(range(a, b))
    return gone


@pytest.mark.parametrize("min_words", [1, 7, 20])
def test_line_dedup_is_exact(spark, min_words):
    rng = np.random.default_rng(min_words)
    pool = [prose(rng, int(rng.integers(1, 9))) for _ in range(14)] + ["", "  "]
    texts = ["\n".join(rng.choice(pool, int(rng.integers(0, 16)))) for _ in range(40)] + [None, "", "\n\n"]
    got = {r.doc_id: r for r in line_dedup.dedup(corpus(spark, texts), min_words).collect()}
    for i, gone in enumerate(brute_lines(list(enumerate(texts)), min_words)):
        assert {n for a in got[i].removed_runs for n in range(a.first_line, a.last_line + 1)} == gone
        want = texts[i] if texts[i] is None else "\n".join(x for n, x in enumerate(texts[i].split("\n")) if n not in gone)
        assert got[i].text == want


def test_line_dedup_on_odd_rows(spark):
    d = odd_frame(spark)
    out = line_dedup.dedup(d)
    assert out.count() == d.count() and set(out.columns) == set(d.columns)
    texts = odd_texts()
    by = {r.doc_id: r.text for r in out.where("doc_id is not null").collect()}
    assert by[0] is None and by[2] == texts[2] and by[10] == texts[10] and by[12] == texts[12]
    # the row with a null key comes first, so all other copies of its text go
    assert by[5] == "" and by[6] == "" and by[8] == texts[8]
    assert line_dedup.dedup(empty(spark)).count() == 0


# ---- 4: packing


def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    return P.path("word_bpe_49k.json")


def gapless(parts):
    at = 0
    for a, n in sorted(parts):
        assert a == at and n > 0
        at += n
    return at


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    texts = [*near_texts(7, 30), *odd_texts(), "it's <|endoftext|> U.S.A.) don't. É!! é 5,000. ½ A<|endoftext|>."]
    rows = packing.pack(corpus(spark, texts).repartition(5), vocabulary(), length=256, quantum=16, with_ids=True).collect()
    tok = Tokenizer.from_file(vocabulary())
    want = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in texts]
    cover, seq, mix = defaultdict(list), defaultdict(list), defaultdict(Counter)
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length].tobytes()
        assert bytes(r.ids) == ids and r.ids_crc32 == zlib.crc32(ids) and r.doc_tokens == len(want[r.doc_id])
        cover[r.doc_id].append((r.start, r.length))
        seq[r.sequence_id].append((r.offset, r.length))
        mix[r.sequence_id][r.queue] += r.length
    assert [gapless(cover[i]) for i in range(len(texts))] == list(map(len, want))
    sizes = [gapless(seq[i]) for i in range(len(seq))]
    assert all(n == 256 or n & (n - 1) == 0 for n in sizes) and sum(n != 256 for n in sizes) <= 8
    total = sum(mix.values(), Counter())
    for i, n in enumerate(sizes):
        if n == 256:  # a window is off its target by a few quanta at most
            assert all(abs(mix[i][q] - 256 * t / total.total()) <= 4 * 16 for q, t in total.items())
    whole = {r.sequence_id: (bytes(r.ids), r.n) for r in packing.assemble(spark.createDataFrame(rows)).collect()}
    assert all(len(b) == 4 * n == 4 * sizes[i] for i, (b, n) in whole.items())


@pytest.mark.parametrize("tokens", [[5, 3000, 70000, 1, 64, 128], [2048], [1], [2047, 5000, 1, 1, 1]])
def test_schedule_places_each_token_once(tokens):
    s = packing.Schedule(tokens)
    at = np.concatenate([s.place(np.full(n, q), np.arange(n)) for q, n in enumerate(tokens)])
    assert sorted(at) == list(range(sum(tokens)))
    seq, off, room = s.sequence(at)
    assert all(sorted(off[seq == i]) == list(range((seq == i).sum())) for i in np.unique(seq)) and (room > 0).all()


def served_by_rounds(tokens, shares, length, quantum):
    """The queue of each token of the stream, by deficit counters that are kept round by round."""
    left, out, given = list(tokens), [], [0] * len(tokens)
    ends = [Fraction(t) / p for t, p in zip(tokens, shares, strict=True)]
    for end in sorted(set(ends)):
        to = [t if e <= end else int(p * end) // quantum * quantum for t, e, p in zip(tokens, ends, shares, strict=True)]
        owed = [b - a for a, b in zip(given, to, strict=True)]
        quanta, rounds = [-(-x // quantum) for x in owed], max(1, -(-sum(owed) // length))
        deficit, left = [0] * len(tokens), list(owed)
        for _ in range(rounds):
            for q in range(len(tokens)):
                deficit[q] += quanta[q]
                turns, deficit[q] = divmod(deficit[q], rounds)
                n = min(turns * quantum, left[q])
                out += [q] * n
                left[q] -= n
        assert not any(left)
        given = to
    return out


@pytest.mark.parametrize("shares", [None, [0.5, 0.25, 0.125, 0.125], [0.1, 0.6, 0.2, 0.1]])
def test_mixture_as_counted_round_by_round(shares):
    tokens = [3000, 9000, 700, 41]
    exact = [Fraction(x) for x in shares] if shares else [Fraction(t, sum(tokens)) for t in tokens]
    exact = [x / sum(exact) for x in exact]
    want = served_by_rounds(tokens, exact, 512, 32)
    # the queues of a mixture without shares are in order of their tokens
    mix = packing.Mixture(tokens, shares, 512, 32)
    stream = [None] * sum(tokens)
    for q, n in enumerate(tokens):
        row, start, size, at = mix.runs(np.array([q]), np.array([0]), np.array([n]))
        for a, b, c in zip(start, size, at, strict=True):
            assert stream[c : c + b] == [None] * b
            stream[c : c + b] = [(q, x) for x in range(a, a + b)]
        assert sorted(range(sum(tokens)), key=lambda i: stream[i] or (9, i))[0] is not None
    assert all(x is not None for x in stream)
    for q in range(len(tokens)):
        assert [x for s, x in stream if s == q] == list(range(tokens[q]))
    if shares:
        assert [s for s, _ in stream] == want
        run_out = min(t / p for t, p in zip(tokens, shares, strict=True))
        for w in range(int(run_out) // 512):  # until a queue runs out, every window is near its targets
            share = Counter(s for s, _ in stream[w * 512 : w * 512 + 512])
            assert all(abs(share[q] - 512 * p) <= 4 * 32 for q, p in enumerate(shares))


def test_mixture_of_more_sources_than_a_task_sums_over():
    tokens = [*range(40, 400, 3), 20_000, 7, 1]
    mix = packing.Mixture(tokens, None, 512, 16, fan=5)
    assert len(mix.levels) > 20
    q = np.repeat(np.arange(len(tokens)), 2)  # two documents a source
    n = np.ravel([(t // 2, t - t // 2) for t in tokens])
    first = np.ravel([(0, t // 2) for t in tokens])
    row, start, size, at = mix.runs(q[n > 0], first[n > 0], n[n > 0])
    seen = np.zeros(sum(tokens), int)
    for a, b in zip(at, size, strict=True):
        seen[a : a + b] += 1
    assert (seen == 1).all() and np.bincount(row, size).tolist() == n[n > 0].tolist()


def test_muldiv_beyond_64_bits():
    a = np.array([0, 1, 7 * 10**10, 15 * 10**10])
    for b, c in ((5 * 10**9, 15 * 10**10), (10**13, 15 * 10**10)):
        assert packing.muldiv(a, b, c).tolist() == [int(x) * b // c for x in a]
        assert packing._muldivmod(a, b, c)[1].tolist() == [int(x) * b % c for x in a]


def test_packing_odd_rows_and_many_queues(spark):
    d = odd_frame(spark).withColumn("source", F.when(F.col("source").isNotNull(), F.concat("source", F.col("doc_id"))))
    rows = packing.pack(d, vocabulary(), fan=3, targets={"s211": 0.5, "nowhere": 0.1}).collect()
    assert sorted((r.sequence_id, r.offset) for r in rows)[0] == (0, 0) and all(r.queue == "s211" for r in rows if r.sequence_id == 0 and r.offset == 0)
    assert Counter(r.doc_id for r in rows if r.start == 0) == Counter(r.doc_id for r in d.collect())
    assert packing.pack(empty(spark), vocabulary()).count() == 0


# ---- 6: sharding


def test_sharding(spark):
    d = corpus(spark, [prose(np.random.default_rng(i), 4) for i in range(600)] + odd_texts())
    for n in (1, 7, 40, 41):
        rows = hash_tree.shard(d, hash_tree.layout(n), hash_tree.layout(n + 1), hash_tree.layout(80) if n == 40 else None, bucket_rows=8).collect()
        texts = {r.doc_id: r.text for r in d.collect()}
        slots = defaultdict(list)
        for r in rows:
            raw = (texts[r.doc_id] or "").encode()
            assert (r["size"], r.text_crc32) == (len(raw) + 16, zlib.crc32(raw)) and r.grown_shard in (r["shard"], n) and 0 <= r["shard"] < n
            slots[r["shard"]].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def spark_hash(*parts, seed=42):
    """xxhash64 of longs and ints as Spark chains it."""
    xxhash = pytest.importorskip("xxhash")
    for value, code in parts:
        if value is not None:
            seed = xxhash.xxh64(struct.pack(code, value), seed=seed).intdigest()
    return seed


def brute_shard(key, live, places, seed=0):
    """The descent in plain Python: cumulative weights, level by level, then the least draw."""
    unit = lambda *parts: ((spark_hash((key, "<q"), *parts, (seed, "<i")) >> 12) + 0.5) / 2**52

    def choose(groups, u):
        total, below = sum(p.weight for _, g in groups for p in g), 0.0
        for name, g in groups:
            below += sum(p.weight for p in g)
            if u < below / total:
                return name
        return groups[-1][0]

    for k in range(hash_tree.ATTEMPTS):
        left = places
        for level, of in enumerate((lambda p: p.region, lambda p: p.rack, lambda p: p.shard)):
            left = [p for p in left if of(p) == choose([(n, [p for p in left if of(p) == n]) for n in dict.fromkeys(map(of, left))], unit((k, "<i"), (level, "<i")))]
        if unit((k, "<i"), (3, "<i")) < live.get(left[0].shard, 0) / left[0].weight:
            return left[0].shard
    return min((-math.log(unit((s, "<i"))) / w, s) for s, w in live.items())[1]


def test_descent_as_brute_force(spark):
    keys = [*range(-40, 400), None, 2**60]
    d = spark.createDataFrame([(k,) for k in keys], "k long")
    for n, places in ((1, hash_tree.layout(1)), (7, hash_tree.layout(30, 2, 3)), (40, hash_tree.layout(80)), (9, hash_tree.layout(5))):
        tree = [hash_tree.Node(x.shard, x.rack, x.region, 1 / (1 + x.shard % 3)) for x in hash_tree.layout(n)]
        got = [r[0] for r in d.select(hash_tree.descend(F.col("k"), tree, places)).collect()]
        assert got == [brute_shard(k, {x.shard: x.weight for x in tree}, places) for k in keys]


def test_weights_and_movement(spark):
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    even = hash_tree.layout(8, 2, 2)
    heavy = [hash_tree.Node(n.shard, n.rack, n.region, 3.0 if n.shard == 2 else 1.0) for n in even]
    places = [hash_tree.Node(n.shard, n.rack, n.region, 4.0 if n.shard == 2 else 1.0) for n in hash_tree.layout(12, 2, 2)]
    with pytest.raises(ValueError):
        hash_tree.descend(F.col("doc_id"), heavy, even)
    rows = d.select(hash_tree.descend(F.col("doc_id"), even, places).alias("a"), hash_tree.descend(F.col("doc_id"), heavy, places).alias("b")).collect()
    assert all(r.a == r.b or r.b == 2 for r in rows)
    share = Counter(r.b for r in rows)
    assert abs(share[2] / 6000 - 0.3) < 0.03 and all(abs(share[i] / 6000 - 0.1) < 0.02 for i in range(8) if i != 2)
    off = [hash_tree.Node(n.shard, n.rack, n.region, 0.0 if n.shard == 5 else 1.0) for n in even]
    assert 5 not in {r[0] for r in d.select(hash_tree.descend(F.col("doc_id"), off)).distinct().collect()}


def test_sharding_odd_rows(spark):
    d = odd_frame(spark)
    assert hash_tree.shard(d, hash_tree.layout(3)).count() == d.count() and hash_tree.shard(empty(spark), hash_tree.layout(3)).count() == 0


def test_sharding_hot_key(spark):
    texts = [(None, f"text {i}") for i in range(300)] + [(7, "same")] * 20 + [(i, "same") for i in range(600)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    rows = hash_tree.shard(d, hash_tree.layout(5), bucket_rows=16).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(k) for k, _ in texts)
    for n in range(5):
        own = sorted(r.slot for r in rows if r["shard"] == n)
        assert own == list(range(len(own)))
    assert len({r["shard"] for r in rows if r.doc_id is None}) == 1
    sevens = sorted(r.slot for r in rows if r.doc_id == 7 and r["size"] == 20)
    assert len(sevens) == 21 and sevens == list(range(sevens[0], sevens[0] + 21))


# ---- 9: language ID


LETTERS = {"aa": "abcde", "bb": "vwxyz", "cc": "éèàçü"}


def test_language_id(spark):
    rng = np.random.default_rng(3)
    rows = [(i, prose(rng, int(rng.integers(5, 60)), LETTERS[k]), k) for i in range(240) for k in [list(LETTERS)[i % 3]]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = centroid_lid.held_out(F.col("doc_id"))
    assert [r[0] for r in d.select(held).orderBy("doc_id").collect()] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(240)]
    model = centroid_lid.fit(d.where(~held), sample_per_language=40, clusters=3)
    assert len(model.centroids) == 9 and model.languages == ["aa", "bb", "cc"]
    out = centroid_lid.predict(d, model).where(held).collect()
    assert all(r.lang == r.lang_pred and 0 <= r.score <= 1 and not r.rejected for r in out) and len(out) > 30
    other = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "щжюя фыва " * 60), (5, "a")], "doc_id long, text string")
    got = {r.doc_id: r for r in centroid_lid.predict(other, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(got[i].rejected for i in (1, 2, 3, 4)) and got[5].lang_pred == "aa"


def test_short_texts_of_an_unlearned_language_are_rejected(spark):
    rng = np.random.default_rng(13)
    letters = {"aa": "aeiourst", "bb": "aeioulmn", "other": "aeiodgpk"}
    rows = [(i, prose(rng, int(rng.integers(8, 250)), letters[k]), k) for i in range(800) for k in ["aa" if i % 2 else "bb"]]
    model = centroid_lid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    short = [(i, prose(rng, int(rng.integers(8, 17)), letters[k]), k) for i in range(300) for k in [list(letters)[i % 3]]]
    out = centroid_lid.predict(spark.createDataFrame(short, "doc_id long, text string, lang string"), model).collect()
    assert all(centroid_lid.gram_counts([r.text]).sum() < 300 for r in out)
    assert sum(r.rejected for r in out if r.lang == "other") >= 95
    assert sum(r.rejected for r in out if r.lang != "other") <= 2


def test_gram_counts_are_whole():
    rng = np.random.default_rng(9)
    text = prose(rng, 5000, "abcXYéİΣς") + "  ,, 12 ΑΣ ΟΔΟΣ. end"

    def naive(t):
        runs = re.sub("[^\0]+", lambda m: "".join(c if c.isalpha() else "\0" for c in m[0]), t.lower())
        runs = re.sub("\0+", "\0", runs)
        hashed = lambda *cs: (np.array([sum_(cs)], np.int64) * -7046029254386353131 >> 52 & (centroid_lid.BUCKETS - 1))[0]

        def sum_(cs):
            x = 0
            for c in cs:
                x = x * 1_000_003 + (0 if c == "\0" else ord(c))
            return {1: x * 2 + 1, 2: x * 4 + 2, 3: x * 8 + 4}[len(cs)]

        out = np.zeros(centroid_lid.BUCKETS, np.float32)
        for n in (1, 2, 3):
            for i in range(len(runs) - n + 1):
                if n > 1 or runs[i] != "\0":
                    out[hashed(*runs[i : i + n])] += 1
        return out

    old, want = centroid_lid._CHARS, naive(text)
    for size in (1 << 30, 997, 64, 3, 1):
        centroid_lid._CHARS = size
        assert (centroid_lid.gram_counts([text, None, text])[[0, 2]] == want).all()
    centroid_lid._CHARS = old


def test_nearest_centroid_as_brute_force(spark):
    rng = np.random.default_rng(14)
    rows = [(i, prose(rng, int(rng.integers(1, 60)), LETTERS[k]), k) for i in range(300) for k in [list(LETTERS)[i % 3]]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("a.b", F.lit("own"))
    model = centroid_lid.fit(d)
    got = centroid_lid.predict(d, model).orderBy("doc_id").collect()
    counts = centroid_lid.gram_counts([t for _, t, _ in rows])
    df = (counts > 0).sum(0)  # over all rows
    assert np.allclose(model.idf, np.log(301 / (1 + df)) + 0.05)
    for r, c in zip(got, counts, strict=True):
        v = np.log1p(c) * (np.log(301 / (1 + df)) + 0.05)
        cos = [(float(v @ m) / float(np.linalg.norm(v)), model.languages[j]) for m, j in zip(model.centroids, model.of, strict=True)]
        assert max(cos)[1] == r.lang_pred and abs(max(cos)[0] - r.score) < 1e-5 and r["a.b"] == "own"


def test_repeated_rows_do_not_fill_the_sample(spark):
    rng = np.random.default_rng(15)
    rows = [(i, prose(rng, 20, LETTERS["aa"]), "aa") for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    many = d.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("n")
    a, b = centroid_lid.fit(d, clusters=2), centroid_lid.fit(many, clusters=2)
    assert len(b.centroids) == 2 and b.languages == a.languages == ["aa"]


def test_language_id_odd_rows(spark):
    d = odd_frame(spark)
    out = centroid_lid.predict(d, centroid_lid.fit(d))
    assert out.count() == d.count() and set(d.columns) <= set(out.columns)
    none = centroid_lid.predict(d, centroid_lid.fit(empty(spark)))
    assert {r.lang_pred for r in none.collect()} == {"und"} and centroid_lid.predict(empty(spark), centroid_lid.fit(d)).count() == 0


# ---- 10: decontamination


def test_decontamination(spark):
    rng = np.random.default_rng(4)
    items = [prose(rng, n) for n in (40, 25, 14, 9, 3)]
    swapped = items[0].split()
    for k in (6, 15, 24, 33):
        swapped[k] = "other"
    half = " ".join(items[0].split()[:20])
    noise = lambda n=80: prose(rng, n)
    texts = [f"{noise()} {items[0]} {noise()}", f"{noise()} {' '.join(swapped)}. {noise()}", f"{noise()} {items[1].upper().replace(' ', ', ')}", items[2], f"{noise()}\n{items[3]}\n{noise()}", noise(), f"{noise()} {half} {noise()}", f"{noise()} {' '.join(items[0].split()[:9])} {noise()}", f"{items[4]} x {noise()}", None, "", items[0] * 2]
    bench = spark.createDataFrame([*enumerate(items), (7, None), (8, ""), (None, noise())], "item_id long, text string")
    for name in (F.col("item_id"), F.concat(F.lit("i"), "item_id")):  # ids of any type
        rows = spaced_seed.overlaps(corpus(spark, texts), bench.withColumn("item_id", name)).collect()
        assert {(r.doc_id, int(str(r.item_id).strip("i"))) for r in rows} == {(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (6, 0), (8, 4), (11, 0)}
        one = next(r for r in rows if r.doc_id == 1)
        assert one.matches == 36 and one.length == 40 and one.item_word == 0
    assert sorted(r.doc_id for r in spaced_seed.clean(corpus(spark, texts), bench).collect()) == [5, 7, 9, 10]


def test_masks_meet_every_overlap():
    for words, unequal in ((16, 3), (20, 4), (25, 5), (30, 6)):  # all others hold one of these or are part of one
        gone = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(words), unequal)])
        met = np.zeros(len(gone), bool)
        for m in spaced_seed.MASKS:
            for at in range(words - m[-1]):
                met |= (gone & sum(1 << at + k for k in m)) == 0
        assert met.all()


def test_decontamination_of_edited_passages(spark):
    rng = np.random.default_rng(12)
    items = [prose(rng, n, "abcdefghijklmnop") for n in (40, 80, *range(13, 21), *rng.integers(16, 60, 40))]
    texts = []
    for i, item in enumerate(items):
        w = item.split()
        most = min(len(w) // 5, len(w) - 13)
        for k in range(4, len(w), 5) if i < 2 else rng.choice(len(w), most, replace=False):
            w[k] = "other"
        texts.append(f"{prose(rng, 30)} {' '.join(w)} {prose(rng, 30)}")
    rows = spaced_seed.overlaps(corpus(spark, texts), spark.createDataFrame([*enumerate(items)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(i, i) for i in range(len(items))}
    assert {r.doc_id: r.matches for r in rows}[0] == 32


def brute_overlaps(docs, items, least, match):
    """By diagonal, the most equal words of any stretch with at least ``match`` of them."""
    out = {}
    split = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    for i, doc in enumerate(map(split, docs)):
        for j, item in enumerate(map(split, items)):
            best = 0
            for d in range(1 - len(item), len(doc)):
                same = [doc[d + q] == item[q] for q in range(max(0, -d), min(len(item), len(doc) - d))]
                for s in range(len(same)):
                    equal = 0
                    for e in range(s, len(same)):
                        equal += same[e]
                        if equal >= match * (e - s + 1) - 1e-9 and same[s] and same[e]:
                            best = max(best, equal)
            if item and best >= min(least, len(item)) and (len(item) > 1 or least <= 1):
                out[i, j] = best
    return out


@pytest.mark.parametrize(("least", "match"), [(13, 0.8), (8, 0.7), (5, 0.5), (20, 0.9), (13, 1.0)])
def test_decontamination_as_brute_force(spark, least, match):
    rng = np.random.default_rng(least)
    pool = prose(rng, 12, "abcdefghijklmnop").split()  # few words, so that chance overlaps are many
    items = [" ".join(rng.choice(pool, int(n))) for n in (30, 24, 16, 9, 6, 2)] + ["the same the same the same the same the same", ""]
    docs = [" ".join(rng.choice(pool, int(rng.integers(0, 40)))) for _ in range(12)]
    for item in items[:5]:
        for share in (0.1, 0.25, 0.5):
            w = [x if rng.random() > share else "z" for x in item.split()]
            docs.append(" ".join([*rng.choice(pool, 8), *w, *rng.choice(pool, 5)]))
    docs += ["the same " * 12, None]
    rows = spaced_seed.overlaps(corpus(spark, docs), spark.createDataFrame([*enumerate(items)], "item_id long, text string"), least, match).collect()
    want = brute_overlaps(docs, items, least, match)
    assert len(rows) == len(want) > 2 and {(r.doc_id, r.item_id): r.matches for r in rows} == want


def test_decontamination_odd_rows(spark):
    d, bench = odd_frame(spark), spark.createDataFrame([(1, odd_texts()[5])], "item_id long, text string")
    out = spaced_seed.clean(d, bench)
    assert out.columns == d.columns
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14] and ids.count(None) == 1
    assert {r["_key"] for r in out.collect()} == {"own"}
    assert Counter(r.doc_id for r in spaced_seed.overlaps(d, bench).collect())[5] == 3  # the row and its two repeats
    assert spaced_seed.overlaps(d, bench.limit(0)).count() == 0 and spaced_seed.overlaps(empty(spark), bench).count() == 0


# ---- 3: nearest neighbours


def test_ann(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[100:160] = x[100]  # many copies of one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, []), (2040, [0.0] * 16), (2060, [float("nan")] + [1.0] * 15), (2080, [None] + [1.0] * 15), (2100, [1.0] * 3), (None, [1.0] * 16), (2120, [float("inf")] * 16), (20, x[20].tolist())]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("own"))
    out = additive_ann.search(d.repartition(3), F.col("vec_id") % 20 == 0, books=6, words=64, shortlist=100, tile_rows=300, query_rows=20).collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    wide, hits = x.astype(float), 0
    assert set(got) == set(range(0, 900, 20))
    for q, found in got.items():
        s = wide @ wide[q]
        order = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:20]
        assert len(found) == 20 and all(abs(v - s[i]) < 1e-9 for i, v in found) and found == sorted(found, key=lambda p: (-p[1], p[0]))
        hits += len({i for i, _ in found} & set(order))
    assert hits / (20 * len(got)) >= 0.9
    assert [i for i, _ in got[100]] == list(range(101, 121)) and [i for i, _ in got[120]] == list(range(100, 120))
    assert additive_ann.search(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = additive_ann.search(d.where("vec_id < 3"), F.col("vec_id") == 0)
    assert few.count() == 2


@pytest.mark.parametrize("spread", [0.3, 10.0])  # clear clusters, and none
def test_ann_with_lists(spark, spread):
    rng = np.random.default_rng(16)
    x = (rng.normal(size=(12, 16))[rng.integers(0, 12, 4000)] + spread * rng.normal(size=(4000, 16))).astype(np.float32)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "`a.id` long, embedding array<float>")
    out = additive_ann.search(d, F.col("`a.id`") % 20 == 0, key="a.id", books=6, words=64, shortlist=40, list_rows=300, tile_rows=200, query_rows=64, probe_queries=60).collect()
    wide, hits = x.astype(float), 0
    for q in range(0, 4000, 20):
        order = [i for i in np.lexsort((np.arange(4000), -(wide @ wide[q]))) if i != q][:20]
        found = sorted((r.rank, r.vec_id) for r in out if r.query_id == q)
        assert [r for r, _ in found] == list(range(1, 21))
        hits += len({i for _, i in found} & set(order))
    assert hits / (20 * 200) >= 0.9


# ---- 1: licences


def test_licenses(spark):
    rows = [
        (1, "r/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "r/a/b.txt", "plain text the license of words"), (3, "r/a/c.txt", "intro\n// Released under the MIT\n// License.\nmore"),
        (4, "r/s/COPYING.md", "This work is licensed under the GNU General Public License, version 3."), (5, "r/s/deep/x.c", "int x;"), (6, "other/y.c", None), (7, None, "All rights reserved."), (8, "r/s/z.c", ""), (9, "r/licensed.txt", "Licensed under CC BY-NC 4.0."), (1, "r/LICENSE", "Licensed under the Apache License, Version 2.0."),
    ]
    d = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("own")).withColumn("dir", F.lit("x"))
    got = {r.doc_id: (r.license, r.how, r.from_dir) for r in license_scan.scan(d).collect()}
    assert got == {1: ("Apache-2.0", "own", None), 2: ("Apache-2.0", "inherited", "r"), 3: ("MIT", "own", None), 4: ("GPL-3.0", "own", None), 5: ("GPL-3.0", "inherited", "r/s"), 6: (None, "none", None), 7: ("Proprietary", "own", None), 8: ("GPL-3.0", "inherited", "r/s"), 9: ("CC-BY-NC-4.0", "own", None)}
    assert license_scan.scan(d).count() == 10 and license_scan.scan(d.limit(0)).count() == 0


def brute_license(texts, threshold, files=()):
    n = len(texts)
    df = Counter(t for x in texts for t in set(license_scan.terms(x or "")))
    idf = defaultdict(lambda: math.log(1 + n) + 1, {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items()})
    vectors, out = license_scan.weights(idf), []
    for at, x in enumerate(texts):
        lines, best = (x or "").split("\n"), None
        parts = [(i, p) for i in range(len(lines)) for p in (lines[i], " ".join(lines[max(0, i - 1) : i + 2]))]
        full = [i for i, line in enumerate(lines) if line.strip(" \t\r")]
        if full:
            end = next((i for i in range(full[0], len(lines)) if not lines[i].strip(" \t\r")), len(lines))
            parts.append((0, " ".join(lines[full[0] : end])))
        if at in files:
            parts.append((0, " ".join(lines)))
        for i, part in parts:
            v = {t: c * idf[t] for t, c in Counter(license_scan.terms(part)).items()}
            norm = math.sqrt(sum(w * w for w in v.values()))
            for name, _, u in vectors:
                cos = round(sum(w * v.get(t, 0) for t, w in u.items()) / norm, 6) if norm else 0
                if cos >= threshold and (best is None or (-cos, name, i) < best):
                    best = (-cos, name, i)
        out.append(best and best[1])
    return out


def test_license_texts_and_headers(spark):
    """Whole licence files and source headers, wrapped and in comments, against brute force."""
    rng = np.random.default_rng(18)
    texts, want, files = [prose(rng, 40) for _ in range(40)], [None] * 40, set()
    wrap = lambda x, mark: "\n".join(f"{mark}{' '.join(x.split()[i : i + 9])}" for i in range(0, len(x.split()), 9))
    for name, notices in license_scan.TEMPLATES.items():
        for x in notices:
            if len(x) > 150:
                texts += [f"/*\n{wrap('Copyright 2020 Someone ' + x, ' * ')}\n */\n\n{prose(rng, 50)}", f"{name} thing\n\nCopyright (c) 2021 Someone Else\n\n{wrap(x, '')}\n"]
                want += [name, name]
                files.add(len(texts) - 1)
    texts.append("GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n" + prose(rng, 900))
    want.append("GPL-3.0")
    d = spark.createDataFrame([(i, f"d{i}/{'LICENSE' if i in files else 'x.c'}", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    got = [r.license for r in license_scan.scan(d).orderBy("doc_id").collect()]
    assert got == brute_license(texts, 0.75, files) and got == want


def test_licenses_as_brute_force(spark):
    rng = np.random.default_rng(8)
    notices = [x for v in license_scan.TEMPLATES.values() for x in v]
    texts = []
    for _ in range(120):
        lines = [prose(rng, 6) for _ in range(int(rng.integers(0, 5)))]
        if rng.random() < 0.7:
            w = notices[int(rng.integers(len(notices)))].split()
            w = [x for x in w if rng.random() > 0.15] + prose(rng, int(rng.integers(0, 4)) or 1).split()
            lines.insert(int(rng.integers(len(lines) + 1)), " ".join(w))
        texts.append("\n".join(lines))
    d = spark.createDataFrame([(i, f"d/{i}.txt", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    got = [r.license for r in license_scan.scan(d).orderBy("doc_id").collect()]
    want = brute_license(texts, 0.75)
    assert got == want and 20 < sum(x is not None for x in want) < 110


def test_licenses_wrapped_around_lines_that_tell_nothing(spark):
    rng = np.random.default_rng(10)
    texts = [prose(rng, 6) for _ in range(60)]
    for notices in license_scan.TEMPLATES.values():
        for x in notices:
            w = x.split()
            for at in range(1, len(w)):
                texts += [f"{prose(rng, 4)}\n\n{' '.join(w[:at])}\n{blank}\n{' '.join(w[at:])}" for blank in ("", "//")]
            texts.append("\n".join([" ".join(w[: len(w) // 3]), " ".join(w[len(w) // 3 : 2 * len(w) // 3]), " ".join(w[2 * len(w) // 3 :])]))
    texts += ["", "\n", "all\n\nrights"]
    d = spark.createDataFrame([(i, f"d/{i}.txt", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    assert [r.license for r in license_scan.scan(d).orderBy("doc_id").collect()] == brute_license(texts, 0.75)


# ---- 7: preference pairs


def test_preference_pairs(spark):
    rows = [(1, 0, "user", "hi <|end|> é"), (1, 1, "assistant", "hello"), (2, 0, "system", "s"), (2, 1, "user", None), (2, 2, "assistant", "x"), (2, 3, "user", "bye"), (3, 0, "user", "alone"), (4, 0, None, "?"), (4, None, "assistant", "hello"), (None, 0, "user", "z"), (5, 0, "user", "hi <|end|> é"), (5, 1, "assistant", "hello")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("own"))
    got = {r.pair_id: r for r in preference.format_pairs(preference.borrowed(preference.turns_of(d))).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert got[1].prompt == "<|user|>\nhi < |end|> é<|end|>\n" and got[1].rejected == "<|assistant|>\nx<|end|>\n" and got[1].prompt_turns == 1
    assert got[2].prompt == "<|system|>\ns<|end|>\n<|user|>\n<|end|>\n" and got[2].chosen == "<|assistant|>\nx<|end|>\n<|user|>\nbye<|end|>\n"
    for r in got.values():
        for text, spans in ((r.chosen, r.chosen_spans), (r.rejected, r.rejected_spans)):
            for s in spans:
                assert text[: s.begin].endswith("<|assistant|>\n") and text[s.begin : s.end].endswith("<|end|>\n")
    assert got[2].chosen[got[2].chosen_spans[0].begin : got[2].chosen_spans[0].end] == "x<|end|>\n" and len(got[2].chosen_spans) == 1
    assert got[3].chosen == "<|user|>\nalone<|end|>\n" and got[3].rejected == "" and got[3].chosen_spans == []
    assert got[4].prompt_turns == 2 and got[4].chosen == "" == got[4].rejected  # its neighbour's reply is its own
    assert preference.format_pairs(preference.borrowed(preference.turns_of(d.limit(0)))).count() == 0


def test_preference_pairs_of_a_long_conversation(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    short = spark.createDataFrame([(2, 0, "user", "q"), (2, 1, "assistant", "a")], "conv_id int, turn long, role string, text string")
    pairs = preference.borrowed(preference.turns_of(rows.unionByName(short))).where("pair_id = 1")
    other = preference.format_pairs(pairs.select("pair_id", "chosen", F.slice("chosen", 2, n).alias("rejected"))).first()  # nothing is common
    heads = {"user": "<|user|>\n", "assistant": "<|assistant|>\n"}
    at, want = 0, []
    for i in range(n):
        role = "assistant" if i % 2 else "user"
        begin = at + len(heads[role])
        at = begin + len(f"t{i}") + len("<|end|>\n")
        if i % 2:
            want.append((begin, at))
    assert other.prompt_turns == 0 and len(other.chosen) == at and [tuple(x) for x in other.chosen_spans] == want
    one = preference.format_pairs(pairs).first()
    assert one.prompt_turns == n - 1 and one.rejected == "<|assistant|>\na<|end|>\n" and one.rejected_spans[0].end == len(one.rejected)


# ---- 8: quality


def test_cotraining(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(500):
        good = bool(rng.random() < 0.7)
        text = prose(rng, 40) if good else prose(rng, 40).upper().replace(" ", "!! ")
        rows.append((i, text, "en", ("a" if good else "b") if rng.random() < 0.8 else "c", len(text)))
        if i % 3 == 0:
            labels.append((i, int(good), 0))
    truth = {r[0]: "!!" not in r[1] for r in rows}
    d, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    out = cotrain.score(d, cotrain.fit(d, lab)).collect()
    assert sum(r.keep == truth[r.doc_id] for r in out) >= 495 and all(0 <= r.score <= 1 for r in out)
    odd = odd_frame(spark)
    assert cotrain.score(odd, cotrain.fit(odd, lab)).count() == odd.count()
    prior = cotrain.fit(d, lab.where("quality = 1"))
    assert prior.text is None and {r.keep for r in cotrain.score(d, prior).collect()} == {True}
    assert cotrain.score(empty(spark), cotrain.fit(empty(spark), lab.limit(0))).count() == 0


def brute_cotraining(rows, labels, rounds=2, sure=0.95):
    """Co-training on dense rows in one process: naive Bayes by counting, pseudo-labels by looking at each document."""

    def dense(text, source, lang, n):
        raw, t, m = (text or "").encode(), np.zeros(cotrain.BUCKETS), np.zeros(cotrain.META)
        for i in range(len(raw) - 2):
            t[((raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) * 2654435761 % 2**32) >> 18] += 1
        t = np.log1p(t)
        for tag, x in (("source", source), ("lang", lang)):
            m[zlib.crc32((f"{tag}={x}" if x is not None else tag).encode()) % (cotrain.META - 80) + 80] += 1
        m[79 if n is None else int(math.log2(n + 1))] += 1
        return t / max(np.linalg.norm(t), 1e-9), m

    x = {i: dense(*r) for i, *r in rows}
    order = sorted((i for i in x if i in labels), key=lambda i: (zlib.crc32(str(i).encode()), i))
    train = [i for k, i in enumerate(order) if k % 4 != 3]
    fold = [i for k, i in enumerate(order) if k % 4 == 3]
    more = [[[], []], [[], []]]  # by view and class, the pseudo-labelled
    for k in range(rounds + 1):
        w = []
        for view, smooth in ((0, 0.01), (1, 1.0)):
            logs = []
            for c in (0, 1):
                own = [i for i in train if labels[i] == c]
                total = sum(x[i][view] for i in own)
                if more[view][c]:
                    total = total + sum(x[i][view] for i in more[view][c]) * min(1, len(own) / len(more[view][c]))
                logs.append(np.log((total + smooth) / (total + smooth).sum()))
            w.append(logs[1] - logs[0])
        z = lambda i, view: float(x[i][view] @ w[view])
        y = np.array([labels[i] for i in fold])
        scale = [cotrain.platt(np.array([z(i, v) for i in fold]), y) for v in (0, 1)]
        odds = lambda i, v: 1 / (1 + math.exp(-(scale[v][0] * z(i, v) + scale[v][1])))
        if k < rounds:
            free = [i for i in x if i not in labels]
            more = [[[i for i in free if odds(i, 1 - v) <= 1 - sure], [i for i in free if odds(i, 1 - v) >= sure]] for v in (0, 1)]
    return {i: (odds(i, 0), odds(i, 1)) for i in x}, [len(c) for v in more for c in v]


def test_cotraining_as_brute_force(spark):
    rng = np.random.default_rng(51)
    rows, labels = [], {}
    for i in range(240):
        good = bool(rng.random() < 0.6)
        text = prose(rng, 25, "abcdefgh" if good else "defghijkl")
        rows.append((i, text, ("a" if good else "b") if rng.random() < 0.9 else None, "en" if i % 7 else None, len(text) if i % 5 else None))
        if i % 2:
            labels[i] = int(good)
    want, pseudo = brute_cotraining(rows, labels)
    d = spark.createDataFrame([(i, t, la, so, n) for i, t, so, la, n in rows], DOCS).repartition(5)
    out = cotrain.score(d, cotrain.fit(d, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"))).collect()
    assert sum(n > 0 for n in pseudo) >= 3  # views did exchange
    for r in out:
        assert abs(r.text_score - want[r.doc_id][0]) < 1e-4 and abs(r.meta_score - want[r.doc_id][1]) < 1e-6


# ---- names


@pytest.mark.parametrize("case", [str.lower, str.upper, str.title])
def test_filters_keep_columns_of_any_name(spark, case):
    """Every internal name of the operators, in several cases, and a name with a dot: values stay as they were."""
    rng = np.random.default_rng(41)
    text = "\n".join(prose(rng, 20) for _ in range(4))
    names = [case(x) for x in ("id", "uid", "h", "own", "other", "key", "count", "rows", "node", "g", "c", "k", "_keep", "_key", "_uid_of_row", "a.b", "uid_", "iid", "item", "label", "rep", "text_", "c0", "score", "rejected", "lang_pred")]
    docs = spark.createDataFrame([(i, t, f"v{i}") for i, t in enumerate([text, text, f"{text} end", None, prose(rng, 30)])], "doc_id long, text string, v string")
    docs = docs.select("doc_id", "text", *[F.concat("v", F.lit(n)).alias(n) for n in names])
    bench = spark.createDataFrame([("x", prose(rng, 30))], "item_id string, text string")
    model = centroid_lid.fit(docs.select("doc_id", "text", F.lit("aa").alias("lang")))
    new = {"score", "rejected", "lang_pred", "removed_runs"}
    for out in (line_dedup.dedup(docs), jaccard_tree.keep_one(docs), spaced_seed.clean(docs, bench), centroid_lid.predict(docs, model)):
        kept = [n for n in names if out is not None and not (n.lower() in new and n not in docs.columns)]
        own = [n for n in kept if n.lower() not in {"score", "rejected", "lang_pred"}]
        assert [c for c in out.columns if c in own] == own
        for r in out.collect():
            assert all(r[n] == f"v{r.doc_id}{n}" for n in own)


def test_operators_on_long_texts_and_empty_tables(spark, tmp_path):
    """The pipeline on odd rows, and on no rows at all."""
    import corpus_pipeline as C

    for name, rows in (("odd", odd_frame(spark).select("doc_id", "text", "lang", "source", "n_chars")), ("none", empty(spark))):
        d = str(tmp_path / name)
        rows.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(0, prose(np.random.default_rng(1), 30))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        out = C.run(spark, d).collect()
        assert bool(out) == (name == "odd") and all(r.length > 0 for r in out)


# ---- the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as C

    rng = np.random.default_rng(11)
    bench = prose(rng, 30, LETTERS["aa"])
    passage = prose(rng, 55, LETTERS["aa"])
    texts = [prose(rng, int(rng.integers(20, 200)), LETTERS["aa"]) for _ in range(60)]
    near = texts[3].split()
    near[2] = "zz"
    texts += [texts[0], " ".join(near) if len(near) > 60 else texts[3], f"{texts[5]} {bench}", None, "12345", *(f"{prose(rng, 30, LETTERS['aa'])}\n{passage}" for _ in range(4))]
    docs = corpus(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, seen = docs, {}
    for name, stage in C.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, str(tmp_path)).collect(), docs.schema)
        assert kept.columns == docs.columns
        seen[name] = {r.doc_id: r.text for r in kept.collect()}
    assert 63 not in seen["language_id"] and 64 not in seen["language_id"] and len(seen["language_id"]) == 67
    held = [i for i, t in seen["line_dedup"].items() if passage in t]
    assert held == [65] and 60 not in seen["line_dedup"]
    assert 61 not in seen["near_duplicates"] and 62 not in seen["decontaminate"] and set(range(60)) <= set(seen["decontaminate"])
    pieces = C.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(seen["decontaminate"])
    sizes = Counter()
    for r in pieces:
        sizes[r.sequence_id] += r.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes.values())


def test_pipeline_as_brute_force(spark, tmp_path):
    """Each filtering stage on a corpus of copies, near copies, repeated runs and benchmark passages, by brute force."""
    import corpus_pipeline as C

    rng = np.random.default_rng(61)
    word = lambda n: prose(rng, n, LETTERS["aa"])
    items = [word(30), word(18)]
    run = "\n".join(word(14) for _ in range(5))  # 70 words
    texts = [None, "", "123 456", *(word(int(rng.integers(30, 120))) for _ in range(12))]
    for i in range(3, 9):
        w = texts[i].split()
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(len(w)))] = word(1)
        texts.append(" ".join(w))
    texts += [f"{word(20)}\n{run}\n{word(9)}", f"{run}\n{word(40)}", run, f"{word(30)}\n\n{run}", f"{word(25)} {items[0]}", f"{' '.join(items[1].split()[:15])} {word(30)}", f"{word(10)} {' '.join(items[0].split()[:9])}"]
    docs = corpus(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    want = {i: t for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    stages, kept = dict(C.STAGES), docs

    def same(name, want):
        nonlocal kept
        kept = spark.createDataFrame(stages[name](spark, kept, str(tmp_path)).collect(), docs.schema)
        got = {r.doc_id: r.text for r in kept.collect()}
        assert got == want, name
        assert all(r.n_chars == len(r.text) for r in kept.collect())

    same("language_id", want)
    gone = dict(zip(want, brute_lines(list(want.items()), 50), strict=True))
    cut = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in want.items()}
    want = {i: t for i, t in cut.items() if not gone[i] or t.strip()}
    assert sum(map(bool, gone.values())) >= 3 and len(want) < len(cut)
    same("line_dedup", want)
    ids = sorted(want)
    parts = brute_components([want[i] for i in ids], 5, 80, 100)[1]
    want = {ids[i]: want[ids[i]] for i in sorted(set(parts))}
    assert len(want) < len(ids)
    same("near_duplicates", want)
    ids = sorted(want)
    hit = {ids[i] for i, _ in brute_overlaps([want[i] for i in ids], items, 13, 0.8)}
    assert len(hit) >= 2
    want = {i: t for i, t in want.items() if i not in hit}
    same("decontaminate", want)
    pieces = stages["packing"](spark, kept, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(want)
    whole = {r.doc_id: r.doc_tokens for r in pieces}
    assert Counter({i: sum(r.length for r in pieces if r.doc_id == i) for i in whole}) == Counter(whole)
