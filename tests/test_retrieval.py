from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeworks.functions.vectors import cosine, cosine_to
from lodeworks.operators import retrieval as R


def chunks(spark, rows):
    return spark.createDataFrame(rows, "id string, file_path string, start_line int, content string, embedding array<float>")


def cos(spark, a, b):
    return spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(cosine(F.col("a"), F.col("b"))).first()[0]


def test_cosine(spark):
    assert cos(spark, [1.0, 2.0], [1.0, 2.0]) == pytest.approx(1) and cos(spark, [1.0, 2.0], [1.0, 2.0]) <= 1
    assert cos(spark, [1.0, 0.0], [0.0, 1.0]) == 0 and cos(spark, [1.0, 0.0], [-2.0, 0.0]) == -1
    assert cos(spark, [0.0, 0.0], [1.0, 1.0]) == 0
    for n in (1, 7, 13, 255, 769):
        assert cos(spark, [0.5] * n, [1.5] * n) == pytest.approx(1)
    with pytest.raises(Exception, match="differ in length"):
        cos(spark, [1.0], [1.0, 2.0])
    d = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],), ([-3.0, -4.0],), ([4.0, -3.0],)], "v array<float>")
    got = [r[0] for r in d.select(cosine_to(F.col("v"), [3.0, 4.0])).collect()]
    assert got[0] == 0 and got[1:] == pytest.approx([1, -1, 0]) and max(got) <= 1
    with pytest.raises(Exception, match="differ in length"):
        d.select(cosine_to(F.col("v"), [1.0])).collect()


def test_text_search_finds_identifiers_and_density(spark):
    c = chunks(spark, [("a", "A.cs", 1, "void ComputePriceEngineRate() {}", None), ("b", "B.cs", 1, "Overlap Overlap Overlap", None), ("c", "C.cs", 1, "a long sentence that names Overlap only once among many other words", None), ("e", "E.cs", 1, None, None)])
    assert [r.id for r in R.bm25_topk(c, ["computepriceenginerate"], 5).collect()] == ["a"]
    assert [r.id for r in R.bm25_topk(c, ["overlap"], 5).orderBy("rank").collect()] == ["b", "c"]
    assert R.bm25_topk(c, [], 5).count() == 0


def test_hostile_questions(spark):
    from lodeworks.functions.text import query_terms

    q = spark.createDataFrame([('Where is Compute() -- the "real" one? *',), ("? * ( )",), (None,)], "q string").select(query_terms(F.col("q")).alias("t")).collect()
    assert q[0].t == ["where", "is", "compute", "the", "real", "one"] and q[1].t == [] and q[2].t is None


def lists(spark, v, t):
    return spark.createDataFrame([(i, s, k + 1) for k, (i, s) in enumerate(v)], "id string, score double, rank int"), spark.createDataFrame([(i, 1.0, k + 1) for k, i in enumerate(t)], "id string, score double, rank int")


def test_fusion(spark):
    v, t = lists(spark, [("v1", 0.9), ("agreed", 0.8)], ["t1", "agreed"])
    f = {r.id: r for r in R.fuse(v, t).collect()}
    assert f["agreed"].fused_pos == 1 and f["t1"].vector_score is None
    assert [f["v1"].fused_pos, f["t1"].fused_pos] == [2, 3]


def test_trust(spark):
    v, t = lists(spark, [("both", 0.3), ("weak", 0.2)], ["both", *[f"t{i}" for i in range(10)]])
    kept = {r.id: r for r in R.trust(R.fuse(v, t)).collect()}
    assert "both" in kept and kept["both"].source == "both"
    assert sum(k.startswith("t") for k in kept) == 4  # ranks 2 to 5
    hits = R.trust(R.fuse(v, t)).withColumn("file_path", F.col("id"))
    assert "weak" not in {r.id for r in R.rank(hits, 20).collect()}


def ranked(spark, rows, k=5):
    h = spark.createDataFrame([(i, p, float(s), "vector", n) for n, (i, p, s) in enumerate(rows)], "id string, file_path string, score double, source string, fused_pos int")
    return [r.id for r in R.rank(h, k).orderBy("final_rank").collect()]


def test_rank(spark):
    assert ranked(spark, [("a", "A", 0.65), ("b", "B", 0.91), ("c", "C", 0.72)]) == ["b", "c", "a"]
    assert len(ranked(spark, [(f"f{i}", f"F{i}", 0.9) for i in range(40)])) == 5
    assert ranked(spark, [(f"h{i}", "Huge", 0.95) for i in range(20)] + [("x", "Answer", 0.61)]) == ["h0", "h1", "h2", "x"]
    assert ranked(spark, [("1", "Huge", 0.56), ("2", "Huge", 0.93), ("3", "Huge", 0.62), ("4", "Huge", 0.88)]) == ["2", "4", "3"]


def test_excerpt(spark):
    c = chunks(spark, [("a", "A.cs", 1, "x", None)])
    assert R.excerpt(c, "A.cs", 1).count() == 1 and R.excerpt(c, "A.cs", 999).count() == 0 and R.excerpt(c, "B.cs", 1).count() == 0


@given(st.integers(1, 1000), st.integers(1, 1000))
def test_rrf_is_symmetric_and_falls(a, b):
    f = lambda x, y: 1 / (60 + x) + 1 / (60 + y)
    assert f(a, b) == f(b, a) and f(a + 1, b) < f(a, b)


def test_many_questions_as_one_by_one(spark):
    import random

    from lodeworks.operators import many, retrieval

    rng = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    vector = lambda: [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]
    rows = [(i, f"f{i % 5}", None if i % 11 == 0 else vector(), None if i % 13 == 0 else " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(120)]
    chunks = spark.createDataFrame(rows, "id long, file_path string, embedding array<double>, content string")
    asks = [(i, vector(), rng.sample([*words, "nowhere"], rng.randint(0, 4))) for i in range(9)]
    asks += [(20, None, ["w1"]), (21, [0.0] * 4, []), (22, [], ["nowhere"])]
    questions = spark.createDataFrame(asks, "qid int, probe array<double>, terms array<string>")
    cols = ["id", "file_path", "source", "score", "fused_score", "final_rank"]
    got = {}
    for r in many.retrieve_many(chunks, questions, 3, 0.3, tile_chunks=30, tile_questions=4).collect():
        got.setdefault(r.qid, []).append(tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in cols))
    for qid, probe, terms in asks:
        lone = chunks if probe else chunks.withColumn("embedding", F.lit(None).cast("array<double>"))
        want = retrieval.retrieve(lone, probe or [0.0] * 4, terms, 3, 0.3).collect()
        assert sorted(got.get(qid, [])) == sorted(tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in cols) for r in want), qid
    assert many.retrieve_many(chunks, questions.limit(0), 3).count() == 0
    assert many.retrieve_many(chunks.limit(0), questions, 3).count() == 0


def test_blocks_equal_a_scan(spark, tmp_path):
    import random

    from lodeworks.operators.blockmax import BlockIndex

    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, None if i % 97 == 5 else " ".join(rng.choices(words[: 6 + 54 * (i % 5 == 0)], k=rng.choice((1, 3, 40))))) for i in range(700)]
    rows += [(1000 + i, "w1 w2 rare rare") for i in range(9)]  # ties
    chunks = spark.createDataFrame(rows, "id long, content string")
    for name, block in (("own", None), ("named", F.floor(F.col("id") / 8))):
        index = BlockIndex(spark, f"{tmp_path}/{name}").write(chunks, block)
        for terms, k in ((["w1"], 5), (["w59", "w3", "w3"], 30), (["rare"], 4), (["rare", "w2", "none"], 20), (["rare"], 50)):
            want = [(r.id, round(r.score, 9), r["rank"]) for r in R.bm25_topk(chunks, terms, k).orderBy("rank").collect()]
            asked = index.ask(terms, k, (2, 4))
            assert [(r.id, round(r.score, 9), r["rank"]) for r in asked.top.orderBy("rank").collect()] == want
        assert asked.read == asked.bounds.count()  # fewer hits than asked for: all that have the term
        assert not index.ask([], 5).top.collect() and not index.ask(["none"], 5).top.collect()
    few = index.ask(["rare", "w2"], 4, (2, 4))
    assert few.read < few.bounds.count() / 4
    empty = BlockIndex(spark, f"{tmp_path}/empty").write(chunks.limit(0))
    assert not empty.ask(["w1"], 5).top.collect()


def test_postings_find_the_terms_once(spark):
    """No lambda a term, no filter that finds the terms once more, and a word repeated very often is one match."""
    rows = [(1, "b a b é E_e a1 b"), (2, "w " * 30_000 + "w2"), (3, ""), (4, None), (5, " ,. "), (6, "ab a abc ab")]
    made = R.postings(spark.createDataFrame(rows, "id long, content string"))
    got = {(r.id, r.term): (r.tf, r.doc_len) for r in made.collect()}
    want = {(1, "b"): (3, 8), (1, "a"): (1, 8), (1, "e"): (3, 8), (1, "a1"): (1, 8)}
    want |= {(2, "w"): (30_000, 30_001), (2, "w2"): (1, 30_001), (6, "ab"): (2, 4), (6, "a"): (1, 4), (6, "abc"): (1, 4)}
    assert got == want
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("split(") == 1


def test_an_index_reads_its_texts_twice(spark, tmp_path):
    """Once for the postings and once to count the texts: the sample of the ranges and the sum of terms read what was written."""
    from lodeworks.operators.blockmax import BlockIndex
    from lodeworks.sources.snapshots import TextIndex

    for name, kind in (("text", TextIndex), ("blocks", BlockIndex)):
        log = str(tmp_path / f"{name}.log")

        def noted(batches, log=log):
            for b in batches:
                with open(log, "a") as f:
                    f.write("read\n" * b.num_rows)
                yield b

        rows = spark.range(6).select("id", F.when(F.col("id") < 4, F.concat(F.lit("a b a w"), "id")).when(F.col("id") < 5, "").alias("content"))
        chunks = rows.coalesce(1).mapInArrow(noted, "id long, content string")
        index = kind(spark, f"{tmp_path}/{name}").write(chunks, *([F.col("id")] if kind is BlockIndex else []))
        with open(log) as f:
            assert len(f.readlines()) <= 2 * 6
        assert tuple(spark.read.parquet(f"{tmp_path}/{name}/stats").select("n", "terms", "texts").first()) == (6, 16, 5)
        found = spark.read.parquet(f"{tmp_path}/{name}/postings")
        assert found.count() == 12 and found.where("term = 'a'").agg(F.sum("tf")).first()[0] == 8
        assert index is not None


def test_no_text_has_no_mean_length(spark, tmp_path):
    from lodeworks.operators.blockmax import BlockIndex
    from lodeworks.sources.snapshots import TextIndex

    none = spark.createDataFrame([(1, None)], "id long, content string")
    assert tuple(TextIndex(spark, f"{tmp_path}/t").write(none).stats().first()) == (1, None)
    assert BlockIndex(spark, f"{tmp_path}/b").write(none.limit(0)).weights(["w"]).collect() == []


def test_tiles_run_once_and_send_no_null_lists(spark):
    """Arrow's writer goes over the nulls of a list column at each row, so postings carry an empty list."""
    import pyarrow as pa

    from lodeworks.operators import many

    lists = pa.list_(pa.float64())
    chunks = pa.table({"id": [1, 2, 1], "embedding": pa.array([[1.0, 0.0], [], []], lists), "term": [None, "a", "a"], "tf": [None, 1, 2], "doc_len": pa.array([None, 3, 3], pa.int32())})
    questions = pa.table({"qid": [7], "probe": pa.array([[1.0, 0.0]], lists), "terms": [[{"term": "a", "idf": 1.0}]]})
    got = many._tile(5, 3.0)(chunks, questions)
    assert list(zip(got["kind"].to_pylist(), got["id"].to_pylist(), strict=True)) == [("vector", 1), ("text", 1), ("text", 2)]
    rows = spark.createDataFrame([(1, "f", "a b", [1.0, 0.0]), (2, "g", "b", None)], "id long, file_path string, content string, embedding array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0], ["a"])], "qid long, probe array<double>, terms array<string>")
    assert "CoGroup" not in many.retrieve_many(rows, asked)._jdf.queryExecution().optimizedPlan().toString()


def test_postings_are_dealt_without_a_sample(spark, tmp_path):
    """Each term is in a few files, each file is sorted, and no job but the write itself makes the rows."""
    from lodeworks.sources.snapshots import TextIndex

    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        made.add(1)
        return x

    rows = spark.range(300).select("id", F.concat(F.lit("all w"), F.col("id") % 7).alias("content")).repartition(4)
    placed = R.placed(R.postings(rows).withColumn("term", counted("term")), str(tmp_path / "p"), ["term", "id"], [])
    assert made.value == 600 and placed.count() == 600 and placed.distinct().count() == 600
    for _, part in placed.withColumn("f", F.input_file_name()).withColumn("n", F.monotonically_increasing_id()).toPandas().groupby("f"):
        at = list(part.sort_values("n")[["term", "id"]].itertuples(index=False, name=None))
        assert at == sorted(at)
    index = TextIndex(spark, str(tmp_path / "t")).write(rows)
    assert index.postings().count() == 600 and index.stats().first().n == 300


def test_parts_are_added_in_the_order_of_their_terms(spark, tmp_path):
    """0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 differ: rows that come in another order must not part equal texts."""
    from lodeworks.operators.blockmax import BlockIndex

    texts = spark.createDataFrame([(i, "a b c d d d e") for i in range(40)] + [(100 + i, f"x{i} y") for i in range(400)], "id long, content string")
    index = BlockIndex(spark, f"{tmp_path}/b").write(texts, F.floor(F.col("id") / 4))
    # the stored postings turned round for every other text
    found = index._table("postings").where("id < 100")
    turned = found.where("id % 2 = 0").orderBy("id", "term").unionByName(found.where("id % 2 = 1").orderBy("id", F.desc("term"))).coalesce(1)
    stats = spark.createDataFrame([(440, 2.5)], "n long, avgdl double")
    top = R.indexed_topk(turned, stats, ["a", "b", "c", "d"], 24).orderBy("rank").collect()
    assert [r.id for r in top] == list(range(24)) and len({r.score for r in top}) == 1
    assert [r.id for r in index.ask(["d", "c", "b", "a"], 24, (2, 4)).top.orderBy("rank").collect()] == list(range(24))
    rows = [(i, t, p) for i in range(8) for t, p in sorted(zip("abc", (0.1, 0.2, 0.3), strict=True), reverse=i % 2 == 0)]
    one = spark.createDataFrame(rows, "id long, term string, part double").coalesce(1)
    assert {r.score for r in R.summed(one, F.col("part")).collect()} == {0.1 + 0.2 + 0.3}


def test_fused_places_of_equal_texts_follow_their_ids(spark):
    """The text list of postings in any order, fused with a vector list: equal texts keep the order of their ids."""
    posts = [(i, t, f, 7) for i in range(40) for t, f in sorted(zip("abcd", (1, 1, 1, 3), strict=True), reverse=i % 2 == 0)]
    text = R.indexed_topk(spark.createDataFrame(posts, "id long, term string, tf long, doc_len int").coalesce(1), spark.createDataFrame([(440, 2.5)], "n long, avgdl double"), ["d", "a", "c", "b"], 24)
    vector = spark.createDataFrame([(1000, 0.5, 1)], "id long, score double, rank int")
    assert [r.id for r in R.fuse(vector, text).orderBy("fused_pos").collect()] == [1000, *range(24)]
