from __future__ import annotations

import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeworks.functions import text as T
from lodeworks.functions.embedding import HashEmbedder
from lodeworks.operators import chunking, csharp, history, ledger
from lodeworks.plans import answer, ingest
from lodeworks.sources import files as S
from lodeworks.sources import gitlog
from lodeworks.sources.gitlog import git_log
from lodeworks.sources.snapshots import Index


@pytest.fixture
def root(tmp_path):
    for p, text in {
        "src/Service.cs": "class Service { int Compute() { return 1; } }\n", "src/app.component.ts": "export class App {}\n", "README.md": "# Read é\n", "node_modules/x/a.js": "x", "bin/B.cs": "class B {}",
        "obj/o.cs": "x", ".git/config.txt": "x", "logo.png": "x", "empty.cs": "", "big.cs": "x" * (512 * 1024 + 1), "src/G.Designer.cs": "class G {}", "with space/Ünï+%41.cs": "class U {}\n",
    }.items():
        f = tmp_path / "tree" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    return tmp_path / "tree"


def test_walk(spark, root):
    got = {r.path: r.content for r in S.files(spark, str(root)).collect()}
    assert set(got) == {"src/Service.cs", "src/app.component.ts", "README.md", "src/G.Designer.cs", "with space/Ünï+%41.cs"}
    assert got["README.md"] == "# Read é\n"
    with pytest.raises(Exception):
        S.files(spark, str(root / "missing")).count()


def test_chunks_of_a_sample():
    body = "\n".join(f"var line{i} = {i};" for i in range(400))
    out = list(chunking.split(body, 500))
    lines = body.split("\n")
    assert all("\n".join(lines[a - 1 : b]) == c for a, b, c in out)
    assert {n for a, b, _ in out for n in range(a, b + 1)} == set(range(1, 401))
    assert all(x[0] < y[0] for x, y in zip(out, out[1:], strict=False)) and all(len(c) <= 1000 for *_, c in out)
    assert list(chunking.split("")) == [] == list(chunking.split(None)) == list(chunking.split(" \n \n"))
    assert [x[:2] for x in chunking.split("y" * 5000)] == [(1, 1)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["", "{", "}", "  }", "int a = 1;", "x" * 60, "\t", "𝄞" * 20]), max_size=60).map("\n".join), st.integers(20, 200), st.integers(0, 5))
def test_chunk_invariants(body, size, overlap):
    out = list(chunking.split(body, size, overlap))
    lines = body.split("\n")
    assert all("\n".join(lines[a - 1 : b]) == c and c.strip() for a, b, c in out)
    assert len({a for a, _, _ in out}) == len(out) and [a for a, _, _ in out] == sorted(a for a, _, _ in out)
    covered = {n for a, b, _ in out for n in range(a, b + 1)}
    assert all(not lines[n - 1].strip() for n in set(range(1, len(lines) + 1)) - covered)


def test_chunk_udtf(spark):
    chunking.register(spark)
    spark.createDataFrame([("A.cs", "a\nb")], "path string, content string").createOrReplaceTempView("f")
    assert spark.sql("SELECT c.id, c.end_line FROM f, LATERAL chunk_file(path, content, 1500, 3) c").collect() == [("A.cs#1", 2)]


def test_columns(spark):
    d = spark.createDataFrame([("a/Tests/X.cs", "// <auto-generated>\nx\n"), ("Web References/Y.cs", None), ("src/OrderTests.cs", "/* a\n b */\n\ncode\n// c\n"), ("src/a_Spec.cs", "a\r\nb")], "p string, s string")
    r = d.select(T.is_generated(F.col("p"), F.col("s")), T.is_test(F.col("p")), T.tested_subject(F.col("p")), T.code_lines(F.col("s")), T.read_lines_count(F.col("s"))).collect()
    assert [tuple(x) for x in r] == [(True, True, "X", 1, 2), (True, False, "Y", None, None), (False, True, "Order", 1, 5), (False, True, "a", 2, 2)]
    n = spark.createDataFrame([(1,), (0,), (1234,)], "n long").select(T.counted(F.col("n"), "dependency")).collect()
    assert [x[0] for x in n] == ["1 dependency", "0 dependencies", "1,234 dependencies"]
    b = spark.createDataFrame([("My.Base<Foo.Bar>",), ("IThing",), ("Item",)], "b string").select(T.simple_base(F.col("b")), T.looks_like_interface(F.col("b"))).collect()
    assert [tuple(x) for x in b] == [("Base", False), ("IThing", True), ("Item", False)]


def measured(body):
    r = csharp.Recogniser(body)
    return {m.name: m.complexity for m in r.methods}, r.deepest


def test_metrics():
    in_method = lambda b: measured("class C { void M(int x) { %s } }" % b)
    assert in_method("x++;") == ({"M": 1}, 0)
    assert in_method("if (a) { if (b) { } } while (c) { }") == ({"M": 4}, 2)
    assert in_method("if (a && b) x();")[0] == {"M": 3} and in_method("return a && b;")[0] == {"M": 2}
    assert in_method("switch (x) { case 1: case 2: y(); break; default: z(); break; }")[0] == {"M": 4}
    assert in_method("for (;;) { foreach (var q in z) { do { } while (a); } }")[1] == 3
    assert in_method("int? n = null; var q = s?.Length ?? 0; var t = a ? b : c;")[0] == {"M": 3}
    assert in_method('var s = "if (a) { while"; /* if (b) */ // while\n')[0] == {"M": 1}
    assert in_method("z.Where(v => { if (v) return 1; return 2; });")[0] == {"M": 2}
    assert measured("class P { int X { get { if (a) return 1; return 2; } set { } } int Y { get; set; } P() { } }")[0] == {"X.get": 2, "X.set": 1, "P (ctor)": 1}
    assert measured("class C { void M() { if (x { y(); ")[0] == {"M": 2}
    assert csharp.Recogniser("[GeneratedCode(\"x\")] class A { [Xunit.Fact] void T() { } }").attribute_flags() == (True, True)


def test_types(spark):
    src = "namespace A.B; public abstract class Foo<T> : Bar<T>, My.IThing where T : class { public int Go() { return 1; } public string Name { get; } int q; } interface I { } enum E { A, B = 2 } record R(int X) : Base(X); struct S { }"
    d = spark.createDataFrame([("f.cs", src)], "path string, content string")
    t = {r.name: r for r in csharp.types(d).collect()}
    assert t["Foo"].base_types == ["Bar<T>", "My.IThing"] and t["Foo"].members == ["Go()", "Name"] and t["Foo"].is_abstract and t["Foo"].namespace == "A.B"
    assert [t[n]["shape"] for n in ("I", "E", "R", "S")] == ["Interface", "Enum", "Record", "Struct"] and t["E"].members == ["A", "B"] and t["R"].base_types == ["Base"]
    m = csharp.metrics(d).first()
    assert (m.types, m.methods, m.lines, m.is_test) == (4, 1, 1, False)


def test_churn(spark):
    log = "\x1fAda\x1f2024-03-02T10:00:00+00:00\nsrc/A.cs\nsrc/with space.cs\n\n\x1fGrace\x1fnot a date\nsrc/A.cs\n\n\x1fAda\x1f2024-01-01T10:00:00+00:00\n\nsrc/A.cs\n\x1fAda\x1f2024-01-01T09:00:00+00:00\n"
    c = {r.path: r for r in history.churn(history.parse_log(spark.createDataFrame([(log,)], "log string"))).collect()}
    assert set(c) == {"src/A.cs", "src/with space.cs"} and (c["src/A.cs"].commits, c["src/A.cs"].authors, c["src/A.cs"].last_change.month) == (3, 2, 3)
    assert history.churn(history.parse_log(spark.createDataFrame([("",)], "log string"))).count() == 0


def test_git_source(spark, tmp_path, monkeypatch):
    assert git_log(spark, str(tmp_path))[0] == "NotARepository"
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Ada", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.cs").write_text("x")
    git("add", "-A")
    git("commit", "-qm", "one")
    status, _, rows = git_log(spark, str(tmp_path))
    assert status == "Available" and [(r.author, r.path) for r in rows.collect()] == [("Ada", "a.cs")]
    for n in range(5):  # blocks of one commit, of which two are held
        (tmp_path / "a.cs").write_text(f"x{n}")
        (tmp_path / f"b{n}.cs").write_text("y")
        git("add", "-A")
        git("commit", "-qm", "more")
    whole = sorted((r.pos, r.path) for r in git_log(spark, str(tmp_path))[2].collect())
    monkeypatch.setattr(gitlog, "BLOCK", 1)
    monkeypatch.setattr(gitlog, "HELD", 2)
    assert sorted((r.pos, r.path) for r in git_log(spark, str(tmp_path))[2].collect()) == whole
    assert whole == sorted([(6, "a.cs"), *((5 - n, p) for n in range(5) for p in ("a.cs", f"b{n}.cs"))])


def test_ledger(spark):
    f = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "path string, content_hash string")
    k = spark.createDataFrame([("a", "1"), ("b", "0"), ("c", "3")], "path string, content_hash string")
    assert {r.path: r.status for r in ledger.diff(f, k).collect()} == {"a": "unchanged", "b": "changed", "c": "vanished", "d": "new"}


def test_ingest(spark, root, tmp_path):
    at = str(tmp_path / "index")
    one = ingest.ingest(spark, str(root), at, HashEmbedder(32), batch_files=2)
    assert one.files_read == 5 and one.chunks_indexed == 4  # the designer file is generated
    assert ingest.ingest(spark, str(root), at, HashEmbedder(32)).chunks_indexed == 0
    (root / "src/Service.cs").write_text("class Service { }\n" * 3)
    (root / "README.md").unlink()
    assert ingest.ingest(spark, str(root), at, HashEmbedder(32)).chunks_indexed == 1
    index = Index(spark, at)
    assert {r.file_path for r in index.table("chunks").collect()} == {"src/Service.cs", "src/app.component.ts", "with space/Ünï+%41.cs"}
    assert index.table("ledger").count() == 3
    hits = answer.find(index.table("chunks"), "where is the Service class", HashEmbedder(32), floor=0.0)
    assert hits[0].file_path == "src/Service.cs" and hits[0].source in ("both", "vector")
    text = index.text()
    assert answer.find(index.table("chunks"), "where is the Service class", HashEmbedder(32), floor=0.0, index=(text.postings(), text.stats())) == hits
    plan = text.postings().where("term in ('service')")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan or "PushedFilters: [IsNotNull(term), EqualTo(term" in plan or "In(term, [service])" in plan
    late, before = Index(spark, at), index._current()
    seen = iter([{**before, "version": before["version"] - 1}, before])
    late._current = lambda: next(seen)
    none = index.table("ledger").limit(0)
    with pytest.raises(RuntimeError, match="another writer"):
        late.replace(none, index.table("chunks").limit(0), none)
    index.clear()
    assert index.table("chunks").count() == 0


def index_rows(spark):
    rows = lambda names, word: spark.createDataFrame([(f"{n}#{i}", n, i, i, f"{word} {n} {n}" if n != "p3" else None, [1.0]) for n in names for i in (1, 2)], "id string, file_path string, start_line int, end_line int, content string, embedding array<float>")
    entry = lambda names: spark.createDataFrame([(n, "h", 2, None) for n in names], "path string, content_hash string, chunk_count int, indexed_at timestamp")
    gone = lambda names: spark.createDataFrame([(n,) for n in names], "path string")
    return rows, entry, gone


def same_as_scan(index):
    from lodeworks.operators.retrieval import bm25_topk, indexed_topk

    text, chunks = index.text(), index.table("chunks")
    for terms in (["new"], ["p7", "old"], ["nowhere"], []):
        mine = indexed_topk(text.postings(), text.stats(), terms, 5).orderBy("rank").collect()
        plain = bm25_topk(chunks, terms, 5).orderBy("rank").collect()
        assert [(r.id, r["rank"]) for r in mine] == [(r.id, r["rank"]) for r in plain] and all(abs(a.score - b.score) < 1e-9 for a, b in zip(mine, plain, strict=True))


def test_a_commit_writes_what_changed(spark, tmp_path):
    index, (rows, entry, gone) = Index(spark, str(tmp_path / "index")), index_rows(spark)
    names = [f"p{i}" for i in range(400)]
    index.replace(gone([]), rows(names, "old"), entry(names))
    first = {p: p.stat().st_mtime_ns for p in (tmp_path / "index/chunks").rglob("*.parquet")}
    index.replace(gone(["p5", "p6", "nowhere"]), rows(["p5"], "new"), entry(["p5"]))
    assert all(p.stat().st_mtime_ns == t for p, t in first.items())  # nothing that was there is written again
    a, b = index.commits()
    assert (a["chunks"], a["gone"], a["live"]) == (800, 0, 800) and (b["chunks"], b["gone"], b["live"], b["segments"]) == (2, 4, 798, 2)
    assert b["bytes"] < a["bytes"] / 2 and not b["merged_bytes"]
    words = {r.file_path: (r.content or "").split()[:1] for r in index.table("chunks").collect()}
    assert words == {n: ["new"] if n == "p5" else [] if n == "p3" else ["old"] for n in names if n != "p6"}
    assert index.table("ledger").count() == 399 and index.version() == 2
    same_as_scan(index)
    index.replace(gone(["p5"]), rows(["p5"], "newer"), entry(["p5"]))  # a path that has gone before
    assert [r.content for r in index.table("chunks").where("file_path = 'p5'").collect()] == ["newer p5 p5"] * 2
    assert index.commits()[-1]["gone"] == 2
    index.replace(gone(names), rows([], ""), entry([]))
    assert index.table("chunks").count() == 0 and index.text() is None and index._current()["segments"] == {} and index._current()["deletes"] == []
    index.replace(gone([]), rows(["p1"], "again"), entry(["p1"]))
    assert index.table("chunks").count() == 2 and len(list((tmp_path / "index/chunks").glob("segment=*"))) <= 2


def test_segments_are_merged_by_size(spark, tmp_path):
    import random

    rng, index, (rows, entry, gone) = random.Random(3), Index(spark, str(tmp_path / "index"), fan=3), index_rows(spark)
    held: dict[str, str] = {}
    for k in range(9):
        some = rng.sample([f"p{i}" for i in range(30)], rng.randint(1, 8))
        out = [n for n in rng.sample(sorted(held), len(held) // 4) if n not in some]
        index.replace(gone([*some, *out]), rows(some, f"w{k}"), entry(some))
        held = {n: w for n, w in held.items() if n not in out} | {n: f"w{k}" for n in some}
        got = index.table("chunks").collect()
        assert sorted((r.file_path, (r.content or "").split()[:1]) for r in got) == sorted((n, [w] if n != "p3" else []) for n, w in held.items() for _ in (1, 2))
        assert sorted(r.path for r in index.table("ledger").collect()) == sorted(held)
        assert index.commits()[-1]["live"] == len(got) and index.commits()[-1]["segments"] <= 6
    same_as_scan(index)
    assert any(c["merged_bytes"] for c in index.commits())


def test_streaming_ingest(spark, root, tmp_path):
    from lodeworks.streaming.ingest import watch

    at, check = str(tmp_path / "index"), str(tmp_path / "check")
    for expected in (4, 5):
        q = watch(spark, str(root), at, check, HashEmbedder(16))
        q.awaitTermination(120)
        assert q.exception() is None and Index(spark, at).table("ledger").count() == expected
        (root / "src/New.cs").write_text("class New { }\n")


class Chat:
    def __init__(self, fail=False):
        self.fail = fail

    def stream(self, prompt):
        yield "one "
        if self.fail:
            raise RuntimeError("gone")
        yield "two"

    def complete(self, prompt):
        return "".join(self.stream(prompt))


def test_answers(spark):
    c = spark.createDataFrame([("A.cs#1", "A.cs", 1, 2, "class Alpha", HashEmbedder(16).embed(["class Alpha"])[0].tolist())], "id string, file_path string, start_line int, end_line int, content string, embedding array<float>")
    e = HashEmbedder(16)
    events = list(answer.stream(c, "Alpha class", Chat(), e))
    assert [n for n, _ in events] == ["sources", "token", "token", "done"] and events[0][1][0]["found_by"] == "both"
    assert [n for n, _ in answer.stream(c, "Alpha class", Chat(True), e)] == ["sources", "token", "failed"]
    assert list(answer.stream(c, "zzz qqq", Chat(), e, floor=2.0))[1] == ("token", answer.NOTHING_FOUND)
    assert answer.answer(c, "Alpha class", Chat(), e)["answer"] == "one two"
    assert next(answer.sse(iter([("done", None)]))) == "event: done\ndata: null\n\n"


def test_prompt_budget():
    from pyspark.sql import Row

    hit = lambda n, size: Row(file_path=f"F{n}.cs", start_line=1, end_line=9, content="x" * size)
    p = answer.prompt("why?", [hit(1, 700), hit(2, 700), hit(3, 700)], 2000)
    assert len(p) <= 2000 and "F1.cs lines 1-9" in p and "F3.cs" not in p and "why?" in p
    assert answer.CUT in answer.prompt("q", [hit(1, 5000)], 1500) and len(answer.prompt("q", [hit(1, 5000)], 1500)) <= 1500


def test_prompts_of_many(spark):
    from lodeworks.operators import prompts as Q

    hits = [(1, 1, "a", 1, 2, "x" * 300 + "\U0001f600" * 1500), (2, 1, "a", 1, 2, "short"), (2, 2, "b", 3, 4, "y" * 3000), (2, 3, "c", 5, 6, "z"), (3, 1, "n", 1, 1, None), (5, 1, "tiny", 1, 1, "w" * 3000)]
    asked = [(1, "one"), (2, "two"), (3, None), (4, "four"), (5, "q" * 1500)]
    h = spark.createDataFrame(hits, "qid int, rank int, file_path string, start_line int, end_line int, content string")
    got = {r.qid: r for r in Q.prompts(spark.createDataFrame(asked, "qid int, question string"), h, "qid", 2000).collect()}
    wide = lambda text: len(text.encode("utf-16-le")) // 2
    assert got[1].cut and got[1].excerpts == 1 and 1998 < wide(got[1].prompt) <= 2000 and "\ufffd" not in got[1].prompt
    assert got[2].excerpts == 1 and "short" in got[2].prompt and "yyy" not in got[2].prompt and "lines 5" not in got[2].prompt  # the list ends
    assert got[3].prompt == Q.HEAD + Q.BEFORE + Q.AFTER and got[4].prompt == Q.HEAD + Q.BEFORE + "four" + Q.AFTER
    assert got[5].excerpts == 0 and not got[5].cut  # no room for a useful piece


def test_followed_directory(spark, tmp_path):
    from lodeworks.functions.embedding import HashEmbedder
    from lodeworks.sources.snapshots import Index
    from lodeworks.streaming.ingest import follow

    root = tmp_path / "tree"
    (root / "src").mkdir(parents=True)
    for name in ("a", "b", "c"):
        (root / "src" / f"{name}.cs").write_text(f"class {name} {{ }}\n")
    (root / "pic.png").write_bytes(b"\x00")

    def run():
        follow(spark, str(root), f"{tmp_path}/index", f"{tmp_path}/checkpoint", HashEmbedder(8)).awaitTermination()
        index = Index(spark, f"{tmp_path}/index")
        held = {r.path: r.content_hash for r in index.table("ledger").collect()}
        assert {r.file_path for r in index.table("chunks").collect()} == set(held)
        return index.version(), held

    version, first = run()
    assert version == 1 and set(first) == {"src/a.cs", "src/b.cs", "src/c.cs"}
    assert run() == (1, first)  # nothing changed, nothing written
    (root / "src/a.cs").write_text("class a2 { int x; }\n")  # an edit, a deletion, a new file, a file only touched
    (root / "src/b.cs").unlink()
    (root / "src/d.cs").write_text("class d { }\n")
    (root / "src/c.cs").touch()
    version, second = run()
    assert version == 2 and set(second) == {"src/a.cs", "src/c.cs", "src/d.cs"}
    assert second["src/a.cs"] != first["src/a.cs"] and second["src/c.cs"] == first["src/c.cs"]
    (root / "src/d.cs").write_bytes(b"")  # no file to index any more
    assert set(run()[1]) == {"src/a.cs", "src/c.cs"}
    for f in root.rglob("*.cs"):
        f.unlink()
    assert run()[1] == {}


def test_put_writes_files_in_place(spark, tmp_path):
    """A file a row, without Hadoop's commit: no checksum or marker beside it, and once more is the same."""
    from lodeworks.sources.files import put

    rows = [(f"source=a b/lang=é%/part={i}/part-0.txt", f"x{i}\n\né\n") for i in range(30)] + [("empty.txt", "")]
    files = spark.createDataFrame(rows, "path string, content string")
    for root in (str(tmp_path / "tree"), f"file://{tmp_path}/tree"):
        assert put(files, root) == 31
        found = {str(p.relative_to(tmp_path / "tree")): p.read_bytes().decode() for p in (tmp_path / "tree").rglob("*") if p.is_file()}
        assert found == dict(rows)
    assert put(files.limit(0), str(tmp_path / "tree")) == 0


def test_embedding_hashes_a_word_once(monkeypatch):
    """Repeats of a word are looked up; vectors are those of adding its parts one by one."""
    import zlib

    import numpy as np

    from lodeworks.functions import embedding

    texts = ["fooBar foo fooBar", "", "Foo_bar HTTPServer2 é foo", "foo " * 500]
    want = np.zeros((4, 16), np.float32)
    parts = [["foobar", "foo", "bar", "foo", "foobar", "foo", "bar"], [], ["foo_bar", "foo", "bar", "httpserver2", "http", "server", "2", "é", "foo"], ["foo"] * 500]
    for row, own in enumerate(parts):
        for part in own:
            h = zlib.crc32(part.encode())
            want[row, h % 16] += 1 if h >> 31 else -1
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    hashed, crc = [], zlib.crc32
    monkeypatch.setattr(embedding.zlib, "crc32", lambda b: hashed.append(b) or crc(b))
    assert np.array_equal(HashEmbedder(16).embed(texts), want)
    assert len(hashed) == 12
    monkeypatch.setattr(embedding, "KNOWN_WORDS", 2, raising=False)
    assert np.array_equal(HashEmbedder(16).embed(texts), want)


def test_a_commit_leaves_no_shuffles_and_places_postings_by_slices(spark, tmp_path, monkeypatch):
    """Shuffle files go with their query and no more than a slice's postings are shuffled at once; the index is the same."""
    from lodeworks.sources import snapshots

    assert snapshots.slices([(0, 5), (1, 5), (2, 1), (3, 20), (5, 9), (6, 0)], 10) == [(0, 1), (2, 2), (3, 3), (5, 6)]
    assert snapshots.slices([]) == []
    made = []
    real = snapshots.placed

    def noted(rows, *args, **options):
        made.append(rows.agg(F.sum("tf")).first()[0])
        return real(rows, *args, **options)

    monkeypatch.setattr(snapshots, "placed", noted)
    monkeypatch.setattr(snapshots, "SLICE_TERMS", 300)
    files = spark.createDataFrame([(f"d/f{i}.py", "\n".join(f"w{j} all v{i}" for j in range(40))) for i in range(24)], "path string, content string").repartition(4)
    index = Index(spark, f"{tmp_path}/index")
    kept = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(kept)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # more than one small file
    ingest.ingest_files(files, index, HashEmbedder(4))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.conf.get(kept) == before
    assert len(made) > 1 and sum(made) == 24 * 120
    text = index.text()
    assert tuple(text.stats().first()) == (24, 120.0) and text.postings().where("term = 'all'").agg(F.count(F.lit(1)), F.sum("tf")).first()[:] == (24, 960)
    assert text.postings().where("term = 'v7'").select("id", "tf").collect() == [("d/f7.py#1", 40)]


def test_followed_contents_are_kept_once(spark, tmp_path, monkeypatch):
    """A batch's contents are read, judged and hashed once: what is new is kept by path and hash, and none is shuffled
    where all that is listed has changed; files that only were touched stay."""
    import os

    from lodeworks.streaming import ingest as streaming

    tables = []
    real = streaming.kept

    def noted(df, name):
        tables.append((name, df.columns))
        return real(df, name)

    monkeypatch.setattr(streaming, "kept", noted)
    root = tmp_path / "tree"
    root.mkdir()
    for i in range(3):
        (root / f"f{i}.py").write_text(f"x = {i}\n")
    (root / "g.py").write_text("# auto-generated\n")
    run = lambda: streaming.follow(spark, str(root), f"{tmp_path}/index", f"{tmp_path}/checkpoint", HashEmbedder(4)).awaitTermination()
    run()
    assert [c for n, c in tables if n == "new"] == [["path", "content_hash"]]
    assert sum("content" in c and n != "cut" for n, c in tables) == 1
    first = {r.path: r.indexed_at for r in Index(spark, f"{tmp_path}/index").table("ledger").collect()}
    assert sorted(first) == ["f0.py", "f1.py", "f2.py"]
    os.utime(root / "f0.py", (1, 1))  # touched
    (root / "f1.py").write_text("x = 11\n")
    (root / "f2.py").write_text("# auto-generated\n")
    (root / "g.py").write_text("y = 1\n")
    run()
    index = Index(spark, f"{tmp_path}/index")
    then = {r.path: r.indexed_at for r in index.table("ledger").collect()}
    assert sorted(then) == ["f0.py", "f1.py", "g.py"] and then["f0.py"] == first["f0.py"] and then["f1.py"] > first["f1.py"]
    assert sorted(r.content for r in index.table("chunks").collect()) == ["x = 0\n", "x = 11\n", "y = 1\n"]
