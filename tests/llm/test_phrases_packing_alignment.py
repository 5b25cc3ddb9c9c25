"""Pair naming, packing by sums of squares and the alignment sweep against brute force and on odd rows; texts, vectors
and seeds that once went wrong."""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeworks.llm import additive_ann, alignment, packing, pair_naming, spaced_seed, squares_packing
from lodeworks.llm.queries import vocabulary
from lodeworks.shipping import ship
from tests.llm.test_llm import corpus, empty, odd_frame, odd_texts, prose

A, B, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), vocabulary()


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


# --- phrases


def phrases_by_brute_force(rows, least, share, top, longest=5):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        n, mine = total[lang], []
        some = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        for g, a in some.items():
            inside = any(100 * b >= share * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in some.items() if len(h) > len(g))
            if not inside:
                score, k = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                mine.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]], n, k))
        out += [(lang, i, p.decode(), -a, le, r, n, -s, k) for i, (s, a, p, le, r, n, k) in enumerate(sorted(mine)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("share", "chunk"), [(100, 8 << 20), (60, 500)])
def test_collocations_as_brute_force(spark, share, chunk):
    rng = random.Random(3)
    words = ["Alpha", "beta", "été", "naïve x", "b", "c", "x-y", "d"]
    rows = []
    for i in range(300):
        w = [rng.choice(words[: 3 + i % 6]) for _ in range(rng.randint(0, 30))]
        rows.append(("".join(x + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r"]) for x in w), [None, "en", "de", "und"][i % 4]))
    rows += [(None, "en"), ("", None), ("...,;", "en"), ("b b b b b b b b b b", "en"), (rows[3][0], rows[3][1])]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = pair_naming.collocations(docs, least=6, share=share, top=40, chunk_bytes=chunk)
    assert sorted(tuple(r) for r in got.collect()) == phrases_by_brute_force(rows, 6, share, 40)


def test_collocation_scores_beyond_64_bits(spark):
    # a part's counts and n are sums of rows; what the score is made of is worked out in decimals of 38 digits
    one = spark.sql("SELECT (cast(9000000000000000L * 1000 as decimal(19,0)) * cast(9000000000000001L as decimal(18,0))) div (cast(9000000000000000L as decimal(19,0)) * cast(3L as decimal(18,0))) AS s")
    assert one.first().s == 1000 * 9000000000000001 // 3


def test_codes_are_compressed_and_words_are_not_joined(spark):
    docs = spark.createDataFrame([("a b c d " * 5000, "en")], "text string, lang string")
    rows = docs.select("lang", "text").mapInArrow(pair_naming._words(1 << 20, 1 << 20), pair_naming._DICTIONARY.format("word string, "))
    one = rows.where("code = -1").toArrow()
    assert len(one.column("codes")[0].as_py()) < 4000 and pair_naming._unpacked(one).tolist() == [0, 1, 2, 3] * 5000
    grams, _ = pair_naming.counted(docs, 2)
    assert {r.word: r.a for r in grams[0].collect()} == dict.fromkeys("abcd", 5000) and "owners" not in grams[0].columns


def test_collocations_odd_rows(spark):
    assert pair_naming.collocations(empty(spark), least=2).count() == 0
    assert pair_naming.collocations(corpus(spark, [None, "", "a", "a. a"]), least=2).count() == 0
    odd = odd_frame(spark)
    rows = [(r.text, r.lang) for r in odd.select("text", "lang").collect()]
    got = sorted(tuple(r) for r in pair_naming.collocations(odd, least=3, top=50).collect())
    assert got == phrases_by_brute_force(rows, 3, 100, 50)


# --- packing by sums of squares


def check_packed(spark, docs, capacity, **options):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    pieces = squares_packing.pack(docs, WORDS, capacity=capacity, with_ids=True, **options).collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            raw = np.array(ids[k : k + capacity], "<u4").tobytes()
            want[r.doc_id, k // capacity, k, len(raw) // 4, zlib.crc32(raw), raw] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32, bytes(p.ids)) for p in pieces) == want
    held = defaultdict(list)
    for p in pieces:
        held[p.sequence_id].append((p.offset, p.length))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held), -(-sum(p.length for p in pieces) // capacity)


def test_squares_packing(spark):
    rng = np.random.default_rng(8)
    texts = [prose(rng, int(n)) for n in rng.integers(1, 90, 300)] + [prose(rng, 900)] * 3 + [None, "", " "]
    used, least = check_packed(spark, corpus(spark, texts).repartition(3), 256)
    assert used <= least + 1
    used, least = check_packed(spark, corpus(spark, texts).repartition(5), 256, block=40)  # many blocks, several rounds
    assert used <= 1.03 * least + 1


def test_squares_packing_odd_rows(spark):
    assert squares_packing.pack(empty(spark), WORDS).count() == 0
    check_packed(spark, odd_frame(spark), 64)
    check_packed(spark, odd_frame(spark), 4096, block=3)


def test_place_takes_the_least_sum_of_squares():
    rng = np.random.default_rng(2)
    for _ in range(20):
        capacity = int(rng.integers(5, 30))
        sizes = rng.integers(1, capacity + 1, 60)
        seq, offset, left = squares_packing.place(sizes, capacity)
        gaps: dict[int, int] = {}
        for s, b, o in zip(sizes.tolist(), seq.tolist(), offset.tolist(), strict=True):
            def total(g):
                return sum(n * n for gap, n in Counter(g.values()).items() if gap > 0)

            fits = {x: total(gaps | {x: g - s}) for x, g in gaps.items() if g >= s}
            if b not in gaps:
                assert not fits
                gaps[b] = capacity
            else:
                assert fits[b] == min(fits.values())
                assert gaps[b] == min(gaps[x] for x in fits if fits[x] == fits[b])
            assert o == capacity - gaps[b]
            gaps[b] -= s
        assert left.tolist() == [gaps[b] for b in seq.tolist()]


# --- alignment


def aligned_by_brute_force(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    na, nb = alignment.bytes_of_a(A), alignment.bytes_of_b(B)
    docs, count = [], Counter()
    for t in texts:
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        whole = (" " + t).encode() if t else b""
        if not (b"".join(na[i] for i in x) == whole == b"".join(nb[i] for i in y)):
            x, y = [], []
        ends_a, ends_b = np.cumsum([len(na[i]) for i in x]).tolist(), np.cumsum([len(nb[i]) for i in y]).tolist()
        both = sorted(set(ends_a) & set(ends_b))
        at = bisect.bisect_right
        groups = [(x[at(ends_a, lo) : at(ends_a, hi)], y[at(ends_b, lo) : at(ends_b, hi)]) for lo, hi in zip([0, *both], both, strict=False)]
        links = [(g[-1], h[-1]) for g, h in groups]
        count.update(links)
        docs.append((len(x), len(y), groups, links))
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    text = lambda groups: ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
    return docs, [(n, m, len(g), len(k), sum(count[x] == best[x[1]] for x in k), sum(count[x] for x in k), hashlib.sha256(text(g).encode()).hexdigest() if n else "") for n, m, g, k in docs]


def hard_texts():
    rng = random.Random(4)
    parts = ["a", "Bc", "été", "ß", "naïve", "中文", "日本", "　", " ", " ", " ", "’s", "'s", "don't", " ", "  ", "   ", "\t", "\n", "\r\n", "\x1c", "\x85", "▁", "<0x41>", "<s>", "<|endoftext|>", "<unk>", "🙂", "क़", "é", "12", "3.14", "...", "—", "​", "x" * 30]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(600)] + [" ", "  ", " a", "a ", "\n", "a  b", "　 b", "é b", "à la", "” b", "Ā b", "\x00a"]


def test_alignment_as_brute_force(spark):
    texts = hard_texts() + [None, "", *odd_texts()]
    _, want = aligned_by_brute_force([t or "" for t in texts])
    docs = corpus(spark, texts).repartition(4)
    cols = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for size in (1 << 16, 64):  # texts in many blocks of events as well
        got = {r.doc_id: tuple(r[c] for c in cols) for r in alignment.align(docs, A, B, range_bytes=size).collect()}
        assert len(got) == len(texts)
        assert [got[i] for i in range(len(texts))] == want


def test_sweep_over_any_cut_of_the_stream(spark, monkeypatch):
    texts = hard_texts()[:60]
    docs, want = aligned_by_brute_force(texts)
    monkeypatch.setattr(alignment, "SWEPT", 40)
    rows = alignment._events(A, B, "<u2", 1 << 20, 32)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("T", (), {"partitionId": lambda _: 0})())
    table = pa.Table.from_batches(rows(iter([pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])])))
    table = table.sort_by([("rid", "ascending"), ("block", "ascending"), ("side", "ascending")]).select(["rid", "id", "side", "at", "ids"])
    for batch_rows in (1, 3, 10_000):
        out = list(alignment._swept(A, B, "<u2", pa.int64(), True)(iter(table.to_batches(max_chunksize=batch_rows))))
        got = defaultdict(list)
        for b in out:
            for r in b.to_pylist():
                assert r["group"] == len(got[r["id"]])
                got[r["id"]].append((r["a"], r["b"], r["begin"], r["end"]))
        for i, (_, _, groups, _) in enumerate(docs):
            assert [(a, b) for a, b, _, _ in got[i]] == groups
            assert all(x[3] == y[2] for x, y in zip(got[i], got[i][1:], strict=False))
            assert not groups or (got[i][0][2] == 0 and got[i][-1][3] == len((" " + texts[i]).encode()))
        flat = pa.Table.from_batches(alignment._swept(A, B, "<u2", pa.int64(), False)(iter(table.to_batches(max_chunksize=batch_rows)))).to_pylist()
        assert [r["sha"] for r in flat if r["sha"] is not None] == [w[-1] for w in want]


def test_alignment_odd_rows(spark):
    assert alignment.align(empty(spark), A, B).count() == 0
    assert alignment.groups(empty(spark), A, B).count() == 0
    odd = odd_frame(spark)
    out = alignment.align(odd, A, B)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert out.count() == odd.count()
    assert alignment.groups(odd, A, B).count() == out.agg(F.sum("n_groups")).first()[0]


# --- once wrong


def test_token_ids_of_letters_that_normalize_to_marks():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    punctuation = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~'"
    rng = random.Random(6)
    odd = [chr(c) for c in (0x130, 0x958, 0x95F, 0x9DC, 0xA33, 0xB5C, 0xF43, 0xFB1D, 0x301, 0x307, 0x93C, 0x1100, 0x1161, 0x3A3, 0x2028, 0xA0, 0x85, 0x3000, 0x200B, 0x1F600, 0x10400)]
    alphabet = [*"aZéßỳ0٣½", *odd, *punctuation, *punctuation, *" \t\n\r\x0b\x0c\x1c", "<|endoftext|>", "<|startoftext|>", "'s", "</w>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14))) for _ in range(20_000)]
    texts += [f"a{chr(c)}{p}" for c in range(0x80, 0x3000) for p in "|."] + [f"({chr(c)}" for c in range(0x80, 0x3000)]
    ids, off = packing.token_ids(pa.array(texts), WORDS, 1)
    for text, x, y, e in zip(texts, off[:-1], off[1:], t.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert ids[x:y].tolist() == [*e.ids, 1], ascii(text)


def test_muldiv_up_to_its_bound():
    rng = random.Random(1)
    for c in (1, 7, 2**31, 2**40, 2**46, 2**55, 2**61 - 1):
        a, b = [rng.randint(0, c) for _ in range(300)], rng.randint(0, c)
        q, r = packing._muldivmod(np.array(a), b, c)
        assert q.tolist() == [x * b // c for x in a]
        assert r.tolist() == [x * b % c for x in a]
    with pytest.raises(ValueError, match="2\\*\\*61"):
        packing.muldiv(np.array([1]), 1, 2**61)


@pytest.mark.parametrize("scale", ["one large", "mixed", "small", "beyond float32"])
def test_ann_with_vectors_of_any_size(spark, scale):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 32))
    if scale == "one large":
        x[7] *= 1e20
    elif scale == "mixed":
        x *= 10.0 ** rng.integers(-3, 4, 1500)[:, None]
        x[::50] *= 1e20
    elif scale == "small":
        x[::2] *= 1e-30
    else:
        x[::3] *= 1e40
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in additive_ann.search(vectors, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), rel=1e-9, abs=1e-300)
        got[r.query_id].append(r.vec_id)
    hit = 0
    for q in range(0, 1500, 20):
        exact = x @ x[q]
        exact[q] = -np.inf
        hit += len(set(got[q]) & set(np.argsort(-exact, kind="stable")[:20].tolist()))
    assert hit / (75 * 20) >= 0.9


def overlaps_by_brute_force(doc, item, least, match):
    best = None
    for d in range(1 - len(item), len(doc)):
        first = max(0, -d)
        if found := spaced_seed.grown(item, first, doc[d + first : max(d + len(item), 0)], least, match):
            mine = (found[0], -(found[1] + d), -found[1], found[2])
            best = mine if best is None or mine > best else best
    return best and (best[0], -best[1], -best[2], best[3])


def test_overlaps_of_repeated_words():
    rng = np.random.default_rng(4)
    masks, common = spaced_seed.masks_for([], 13, 0.8)
    some = rng.integers(1, 2**63, 6).astype(np.uint64)
    for trial in range(60):
        periodic = lambda n: np.resize(some[: rng.integers(1, 4)], n)
        item = np.concatenate([periodic(rng.integers(0, 30)), some[rng.integers(0, 6, rng.integers(0, 5))], periodic(rng.integers(13, 40))])
        doc = np.concatenate([some[rng.integers(0, 6, 5)], periodic(rng.integers(0, 200)), some[rng.integers(0, 6, 9)], periodic(rng.integers(0, 90)), item[: rng.integers(0, len(item))]])
        text = spaced_seed._Text(doc, masks)
        assert spaced_seed.best_overlap(text, item, masks, common, 13, 0.8) == overlaps_by_brute_force(doc, item, 13, 0.8), trial


def test_all_diagonals_where_hits_are_many(monkeypatch):
    monkeypatch.setattr(spaced_seed, "MOST_HITS", 10)
    test_overlaps_of_repeated_words()


def test_decontamination_of_one_word_repeated(spark):
    rng = np.random.default_rng(1)
    plain = [prose(rng, 20_000) for _ in range(4)]
    items = spark.createDataFrame([(1, "ha " * 800), (2, prose(rng, 800))], "item_id long, text string")
    took = []
    for texts in (plain, plain, ["ha " * 20_000] * 4):
        began = time.perf_counter()
        rows = spaced_seed.overlaps(corpus(spark, texts), items).collect()
        took.append(time.perf_counter() - began)
    assert sorted(tuple(r) for r in rows) == [(i, 1, 800, 0, 0, 800) for i in range(4)]
    assert took[2] < 2 * took[1] + 2
