"""The registered queries, each with the SQL that says the same in DuckDB.

The driver's tables stand in for a code base: documents for files, embeddings for chunk vectors, events for commits,
part for projects, lineitem for references, customer for types, pages for configuration files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions import text as T
from lodeworks.functions.embedding import HashEmbedder
from lodeworks.functions.vectors import cosine
from lodeworks.operators import assessment, blockmax, characterize, chunking, csharp, cycles, diagrams, history, ledger, lines, many, packages, projects, prompts, retrieval, risk, typegraph
from lodeworks.plans import assess, ingest
from lodeworks.shipping import kept, partitions, scratch
from lodeworks.sources import files as files_source
from lodeworks.sources import projects as project_source
from lodeworks.sources.snapshots import Index, TextIndex
from lodeworks.streaming.ingest import follow, follow_churn, watch, windowed_churn

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TERMS = ["tion", "ouan", "erthe", "leoi"]
FLOOR = 0.2


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- retrieval ------------------------------------------------------------------------------------------------

SQL_TERMS = r"list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{Nd}]+'), lambda x: x <> '')"
SQL_COS = "greatest(-1.0, least(1.0, list_cosine_similarity(embedding::DOUBLE[], p.e::DOUBLE[])))"
SQL_VECTOR = f"""vec AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (
  SELECT e.vec_id AS id, {SQL_COS} AS score FROM embeddings e, (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) p)
  ORDER BY score DESC, id LIMIT 24)"""
SQL_VECTOR_DOCS = f"""vec AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (
  SELECT e.vec_id AS id, {SQL_COS} AS score FROM embeddings e, (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) p
  WHERE e.vec_id IN (SELECT doc_id FROM documents)) ORDER BY score DESC, id LIMIT 24)"""
SQL_BM25 = f"""terms AS (SELECT doc_id AS id, {SQL_TERMS} AS t FROM documents),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM terms),
q AS (SELECT unnest({TERMS}) AS w),
tf AS (SELECT id, w, len(list_filter(t, lambda x: x = w)) AS f, len(t) AS dl FROM terms, q),
df AS (SELECT w, count(*) FILTER (f > 0) AS df FROM tf GROUP BY w),
idf AS (SELECT w, CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END AS idf FROM df, stats),
scored AS (SELECT id, sum(idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM tf JOIN idf USING (w), stats WHERE f > 0 GROUP BY id),
txt AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored ORDER BY score DESC, id LIMIT 24)"""
SQL_FUSED = """both_lists AS (SELECT coalesce(v.id, t.id) AS id, v.score AS vector_score, v.rank AS vector_rank, t.rank AS text_rank,
  coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + t.rank), 0) AS fused_score FROM vec v FULL JOIN txt t ON v.id = t.id),
fused AS (SELECT *, row_number() OVER (ORDER BY fused_score DESC, vector_rank NULLS LAST, text_rank) AS fused_pos FROM both_lists)"""
SQL_TRUSTED = f"""hits AS (SELECT *, CASE WHEN vector_rank IS NULL THEN 'text' WHEN text_rank IS NULL THEN 'vector' ELSE 'both' END AS source,
  coalesce(vector_score, 0) AS score FROM fused WHERE NOT coalesce(text_rank > 5 AND (vector_score IS NULL OR vector_score < {FLOOR}), false))"""
SQL_RANKED = f"""placed AS (SELECT h.*, d.source AS file_path FROM hits h JOIN documents d ON d.doc_id = h.id),
good AS (SELECT *, min(fused_pos) OVER (PARTITION BY file_path) AS file_pos FROM placed WHERE source <> 'vector' OR score >= {FLOOR}),
capped AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, fused_pos) AS in_file FROM good),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, file_pos, fused_pos) AS final_rank FROM capped WHERE in_file <= 3)"""


def chunk_table(spark: SparkSession, d: str) -> DataFrame:
    """documents as chunks, with the vector of equal id if there is one; a file is a source."""
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    docs = read(spark, d, "documents")
    return docs.join(e, docs["doc_id"] == e["vec_id"], "left").select(F.col("doc_id").alias("id"), F.col("source").alias("file_path"), F.lit(1).alias("start_line"), F.col("text").alias("content"), "embedding")


def probe(spark: SparkSession, d: str) -> list[float]:
    """The vector that asks: one row."""
    return read(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def texts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def text_index(spark: SparkSession, d: str) -> TextIndex:
    """The stored text index of documents, made by the first question of a session and read by all others."""
    made = spark.sparkContext.__dict__.setdefault("_lodeworks_text", {})
    source = f"{d}/documents.parquet"
    key = (source, TextIndex.stamp(spark, source))
    if key not in made:
        made[key] = TextIndex(spark, scratch(spark, "text")).write(texts(spark, d))
    return made[key]


def text_topk(spark: SparkSession, d: str) -> DataFrame:
    index = text_index(spark, d)
    return retrieval.indexed_topk(index.postings(), index.stats(), TERMS, 24)


def both(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fuse(retrieval.vector_topk(vectors(spark, d), probe(spark, d), 24), text_topk(spark, d))


@query(f"WITH {SQL_VECTOR} SELECT id, round(score, 6) AS score, rank FROM vec")
def vector_topk(spark, d):
    """The nearest chunks to a probe by cosine."""
    return retrieval.vector_topk(vectors(spark, d), probe(spark, d), 24).select("id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT vec_id AS id, 1.0::DOUBLE AS own, 0.0::DOUBLE AS zero FROM embeddings UNION ALL SELECT -1, 0.0, 0.0")
def vector_zero_and_clamp(spark, d):
    """cosine with itself is 1, with zero 0."""
    v = vectors(spark, d)
    dims = F.array_repeat(F.lit(0.0).cast("float"), 64)
    v = v.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("id"), dims.alias("embedding")))
    return v.select("id", F.round(cosine(F.col("embedding"), F.col("embedding")), 9).alias("own"), cosine(F.col("embedding"), dims).alias("zero"))


@query(r"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{Nd}]+'), lambda x: length(x) > 1))), ' ') AS terms FROM benchmark")
def tokenize_terms(spark, d):
    """a question's terms."""
    return read(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(T.query_terms(F.col("text"))), " ").alias("terms"))


@query(f"WITH t AS (SELECT doc_id AS id, {SQL_TERMS} AS t FROM documents), r AS (SELECT id, len(t)::INT AS doc_len, unnest(t) AS term FROM t) SELECT id, term, doc_len, count(*) AS tf FROM r GROUP BY ALL")
def postings_tf(spark, d):
    """The postings of a text index."""
    return retrieval.postings(texts(spark, d))


@query(f"WITH {SQL_BM25} SELECT id, round(score, 6) AS score, rank FROM txt")
def bm25_topk(spark, d):
    """Full-text top list, from the stored postings of the question's terms."""
    return text_topk(spark, d).select("id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def block_index(spark: SparkSession, d: str) -> blockmax.BlockIndex:
    """documents by blocks of 16 neighbours, made once a session as ``text_index`` is."""
    made = spark.sparkContext.__dict__.setdefault("_lodeworks_blocks", {})
    source = f"{d}/documents.parquet"
    key = (source, TextIndex.stamp(spark, source))
    if key not in made:
        made[key] = blockmax.BlockIndex(spark, scratch(spark, "blocks")).write(texts(spark, d), F.floor(F.col("id") / 16))
    return made[key]


@query(f"WITH {SQL_BM25} SELECT id, round(score, 6) AS score, rank FROM txt")
def bm25_blocks(spark, d):
    """2.10, O2: the same list from the blocks that can add to it."""
    top = block_index(spark, d).ask(TERMS, 24).top
    return top.select("id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


SQL_PART = "idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))"


@query(f"""WITH {SQL_BM25}, blk AS (SELECT id // 16 AS block, w, max(f) AS f, min(dl) AS dl, count(*) AS n FROM tf WHERE f > 0 GROUP BY ALL),
bounds AS (SELECT block, sum({SQL_PART}) AS bound, sum(blk.n) AS n FROM blk JOIN idf USING (w), stats GROUP BY block),
turns AS (SELECT *, row_number() OVER (ORDER BY bound DESC, block) AS turn FROM bounds),
early AS (SELECT s.score, row_number() OVER (ORDER BY s.score DESC, s.id) AS place, turn FROM scored s JOIN turns t ON t.block = s.id // 16 WHERE turn <= 4),
f1 AS (SELECT coalesce((SELECT score FROM early WHERE place = 3), 0) AS floor), r1 AS (SELECT *, row_number() OVER (ORDER BY turn) AS again FROM turns, f1 WHERE turn > 4 AND bound * (1 + 1e-9) >= floor),
seen AS (SELECT block FROM turns WHERE turn <= 4 UNION SELECT block FROM r1 WHERE again <= 16),
f2 AS (SELECT coalesce((SELECT score FROM scored WHERE id // 16 IN (FROM seen) ORDER BY score DESC, id LIMIT 1 OFFSET 2), 0) AS floor)
SELECT b.block, round(bound, 6) AS bound, n::BIGINT AS postings, bound * (1 + 1e-9) >= (SELECT score FROM scored ORDER BY score DESC, id LIMIT 1 OFFSET 2) AS needed,
  (SELECT count(*) FROM seen) + (SELECT count(*) FROM r1, f2 WHERE again > 16 AND bound * (1 + 1e-9) >= f2.floor) AS read, (SELECT count(*) FROM bounds) AS blocks FROM bounds b""")
def bm25_skips(spark, d):
    """2.10: what the three best hits can be in: the bounds of all blocks, those needed for the final threshold, and how
    many were read, 4 and 16 at first."""
    asked = block_index(spark, d).ask(TERMS, 3, (4, 16))
    floor = asked.top.agg(F.min("score").alias("floor"))
    blocks = asked.bounds.agg(F.count(F.lit(1)).alias("blocks"))
    rows = asked.bounds.crossJoin(F.broadcast(floor)).crossJoin(F.broadcast(blocks))  # one row each
    return rows.select("block", F.round("bound", 6).alias("bound"), F.col("n").alias("postings"), (F.col("bound") * (1 + blockmax.SLACK) >= F.col("floor")).alias("needed"), F.lit(asked.read).cast("long").alias("read"), "blocks")


@query(f"WITH {SQL_BM25} SELECT id, round(score, 6) AS score, rank FROM txt")
def bm25_scan(spark, d):
    """The same list of texts that are in no index yet."""
    return retrieval.bm25_topk(texts(spark, d), TERMS, 24).select("id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {SQL_VECTOR}, {SQL_BM25}, {SQL_FUSED} SELECT id, round(vector_score, 6) AS vector_score, vector_rank, text_rank, round(fused_score, 9) AS fused_score, fused_pos FROM fused")
def rrf_fuse(spark, d):
    """Reciprocal rank fusion."""
    return both(spark, d).select("id", F.round("vector_score", 6).alias("vector_score"), F.col("vector_rank").cast("long").alias("vector_rank"), F.col("text_rank").cast("long").alias("text_rank"), F.round("fused_score", 9).alias("fused_score"), F.col("fused_pos").cast("long").alias("fused_pos"))


@query(f"WITH {SQL_VECTOR}, {SQL_BM25}, {SQL_FUSED}, {SQL_TRUSTED} SELECT id, source, round(score, 6) AS score FROM hits")
def hybrid_trust_filter(spark, d):
    """P5: weak text hits go."""
    return retrieval.trust(both(spark, d), FLOOR).select("id", "source", F.round("score", 6).alias("score"))


@query(f"WITH {SQL_VECTOR}, {SQL_BM25}, {SQL_FUSED}, {SQL_TRUSTED}, {SQL_RANKED} SELECT id, file_path, source, round(score, 6) AS score, final_rank FROM ranked WHERE final_rank <= 12")
def retriever_rank(spark, d):
    """Floor, three for each file, the best twelve."""
    hits = retrieval.trust(both(spark, d), FLOOR)
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file_path"))
    return retrieval.rank(hits.join(docs, "id"), 12, FLOOR).select("id", "file_path", "source", F.round("score", 6).alias("score"), F.col("final_rank").cast("long").alias("final_rank"))


@query(f"WITH {SQL_VECTOR_DOCS}, {SQL_BM25}, {SQL_FUSED}, {SQL_TRUSTED}, {SQL_RANKED} SELECT id, file_path, source, round(score, 6) AS score, round(fused_score, 9) AS fused_score, final_rank FROM ranked WHERE final_rank <= 6")
def retrieve_hybrid(spark, d):
    """Question to ranked chunks in one plan (the flagship)."""
    index = text_index(spark, d)
    return retrieval.retrieve(chunk_table(spark, d), probe(spark, d), TERMS, 6, FLOOR, index=(index.postings(), index.stats())).select("id", "file_path", "source", F.round("score", 6).alias("score"), F.round("fused_score", 9).alias("fused_score"), F.col("final_rank").cast("long").alias("final_rank"))


# Text scores are summed in the order of the terms, so that equal texts have equal scores.
SQL_MANY = rf"""asked AS (SELECT item_id AS qid, embedding AS e, list_distinct(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{{L}}\p{{Nd}}]+'), lambda x: length(x) > 1)) AS words FROM benchmark LEFT JOIN embeddings ON vec_id = item_id),
vec AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT qid, vec_id AS id, greatest(-1.0, least(1.0, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]))) AS score FROM embeddings, asked WHERE e IS NOT NULL AND vec_id IN (SELECT doc_id FROM documents)) QUALIFY rank <= 24),
terms AS (SELECT doc_id AS id, {SQL_TERMS} AS t FROM documents),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM terms),
posts AS (SELECT id, w, count(*) AS f, any_value(dl) AS dl FROM (SELECT id, unnest(t) AS w, len(t) AS dl FROM terms) GROUP BY id, w),
idf AS (SELECT w, greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 0) AS x FROM (SELECT w, count(*) AS df FROM posts GROUP BY w), stats),
txt AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT qid, id, list_sum(list(CASE WHEN x <= 0 THEN 1e-6::DOUBLE ELSE x END * (f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) ORDER BY w)) AS score FROM (SELECT qid, unnest(words) AS w FROM asked) JOIN posts USING (w) JOIN idf USING (w), stats GROUP BY qid, id) QUALIFY rank <= 24),
both_lists AS (SELECT qid, id, v.score AS vector_score, v.rank AS vector_rank, t.rank AS text_rank, coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + t.rank), 0) AS fused_score FROM vec v FULL JOIN txt t USING (qid, id)),
fused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused_score DESC, vector_rank NULLS LAST, text_rank) AS fused_pos FROM both_lists),
{SQL_TRUSTED},
placed AS (SELECT h.*, d.source AS file_path FROM hits h JOIN documents d ON d.doc_id = h.id),
good AS (SELECT *, min(fused_pos) OVER (PARTITION BY qid, file_path) AS file_pos FROM placed WHERE source <> 'vector' OR score >= {FLOOR}),
capped AS (SELECT *, row_number() OVER (PARTITION BY qid, file_path ORDER BY score DESC, fused_pos) AS in_file FROM good),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, file_pos, fused_pos) AS final_rank FROM capped WHERE in_file <= 3)"""


def question_table(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item as a question: its terms, and the vector of equal id for its own."""
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("probe"))
    items = read(spark, d, "benchmark")
    return items.join(e, items["item_id"] == e["vec_id"], "left").select(F.col("item_id").alias("qid"), "probe", T.query_terms(F.col("text")).alias("terms"))


@query(f"WITH {SQL_MANY} SELECT qid, id, file_path, source, round(score, 6) AS score, round(fused_score, 9) AS fused_score, final_rank FROM ranked WHERE final_rank <= 6")
def retrieve_many(spark, d):
    """All benchmark items as questions against all chunks, in tiles."""
    index = text_index(spark, d)
    found = many.retrieve_many(chunk_table(spark, d), question_table(spark, d), 6, FLOOR, index=(index.postings(), index.stats()))
    return found.select("qid", "id", "file_path", "source", F.round("score", 6).alias("score"), F.round("fused_score", 9).alias("fused_score"), F.col("final_rank").cast("long").alias("final_rank"))


@query(rf"""WITH {SQL_MANY}, q AS (SELECT item_id AS qid, '{prompts.BEFORE}' || text || '{prompts.AFTER}' AS tail FROM benchmark), room AS (SELECT *, greatest(0, 4000 - {len(prompts.HEAD)} - length(tail)) AS room FROM q),
b AS (SELECT r.qid, final_rank, '[' || file_path || ' lines 1-1]' || chr(10) AS label, text, room FROM ranked r JOIN room USING (qid) JOIN documents ON doc_id = r.id WHERE final_rank <= 6),
run AS (SELECT *, label || text || chr(10) || chr(10) AS block, sum(length(label) + length(text) + 2) OVER (PARTITION BY qid ORDER BY final_rank) AS used FROM b),
fit AS (SELECT qid, final_rank, block, false AS cut FROM run WHERE used <= room UNION ALL
SELECT qid, final_rank, label || left(text, room - length(label) - {len(prompts.CUT)}) || '{prompts.CUT}', true FROM run WHERE final_rank = 1 AND used > room AND room - length(label) - {len(prompts.CUT)} > {prompts.LEAST_ROOM}),
body AS (SELECT qid, string_agg(block, '' ORDER BY final_rank) AS body, count(*) AS n, bool_or(cut) AS cut FROM fit GROUP BY qid)
SELECT qid, n::INT AS excerpts, coalesce(cut, false) AS cut, sha256('{prompts.HEAD}' || coalesce(body, '') || tail) AS prompt FROM (SELECT qid, tail, body, coalesce(n, 0) AS n, cut FROM room LEFT JOIN body USING (qid))""")
def question_prompts(spark, d):
    """The prompts of all benchmark items from what was found for each; answers build theirs by the same rule."""
    index = text_index(spark, d)
    found = many.retrieve_many(chunk_table(spark, d), question_table(spark, d), 6, FLOOR, index=(index.postings(), index.stats()))
    found = kept(found.select("qid", "id", F.col("final_rank").alias("rank"), "file_path"), "found")  # of known size, so texts aren't shuffled if it is small
    hits = kept(found.join(texts(spark, d), "id").withColumn("start_line", F.lit(1)).withColumn("end_line", F.lit(1)), "hits")
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return prompts.prompts(asked, hits, "qid", 4000).withColumn("prompt", F.sha2("prompt", 256))


@query("SELECT source || '/' || lang || '/' || doc_id AS file_path, 1 AS start_line, text AS content FROM documents WHERE source || '/' || lang || '/' || doc_id = 'src0/fr/0'")
def excerpt_lookup(spark, d):
    """One chunk by path and line."""
    c = file_table(spark, d).select(F.col("doc_id").alias("id"), F.col("path").alias("file_path"), F.lit(1).alias("start_line"), "content")
    return retrieval.excerpt(c, "src0/fr/0", 1).drop("id")


@query(f"WITH {SQL_BM25}, sized AS (SELECT t.id, t.rank, length(d.text) + 40 AS size FROM txt t JOIN documents d ON d.doc_id = t.id), run AS (SELECT *, sum(size) OVER (ORDER BY rank)::BIGINT AS used FROM sized) SELECT id, rank, used FROM run WHERE used <= 12000")
def prompt_budget(spark, d):
    """The leading hits that fit a prompt."""
    hits = text_topk(spark, d)
    sized = F.broadcast(hits).join(texts(spark, d), "id").withColumn("size", F.length("content") + 40)
    return retrieval.budgeted(sized, F.col("rank"), F.col("size")).select("id", F.col("rank").cast("long").alias("rank"), F.col("used").cast("long").alias("used"))


# ---- files, chunks, ledger ------------------------------------------------------------------------------------


def file_table(spark: SparkSession, d: str) -> DataFrame:
    """documents as files by path."""
    return read(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "lang", "doc_id").alias("path"), F.col("text").alias("content"), "n_chars")


FOLDERS = ["src", "node_modules", "lib", "BIN", "app", ".git", "docs", "obj", "core", "Vendor", "web"]
SUFFIXES = [".cs", ".png", ".TS", ".md", ".exe", ".py", "", ".json"]
SQL_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query(f"""WITH w AS (SELECT doc_id, {SQL_LIST(FOLDERS)}[doc_id % 11 + 1] AS folder, {SQL_LIST(SUFFIXES)}[doc_id % 8 + 1] AS ext, n_chars * (doc_id % 40) AS length FROM documents)
SELECT folder || '/f' || doc_id || ext AS path, length FROM w
WHERE NOT list_contains({SQL_LIST(files_source.SKIP_FOLDERS)}, lower(folder)) AND list_contains({SQL_LIST(files_source.EXTENSIONS)}, lower(ext)) AND length BETWEEN 1 AND 524288""")
def walk_filter(spark, d):
    """Files worth indexing, by path and size."""
    of = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % n + 1).cast("int"))
    w = read(spark, d, "documents").select(F.concat(of(FOLDERS, 11), F.lit("/f"), "doc_id", of(SUFFIXES, 8)).alias("path"), (F.col("n_chars") * (F.col("doc_id") % 40)).alias("length"))
    return w.where(files_source.walkable(F.col("path"), F.col("length")))


@query("SELECT doc_id, doc_id % 9 = 0 AS binary_file FROM documents")
def binary_sniff(spark, d):
    """A NUL byte marks a binary file; every ninth content is given one."""
    content = F.concat(F.col("text").cast("binary"), F.when(F.col("doc_id") % 9 == 0, F.lit(bytearray(b"\x00"))).otherwise(F.lit(bytearray(b"\x20"))))
    return read(spark, d, "documents").select("doc_id", files_source.looks_binary(content).alias("binary_file"))


GENERATED_PATHS = ["src/A.cs", "Web References/B.cs", "x/C.Designer.cs", "x/D.g.cs", "x/E.cs", "x/Connected Services/F.cs", "x/G.generated.cs"]


@query(f"""WITH g AS (SELECT doc_id, {SQL_LIST(GENERATED_PATHS)}[doc_id % 7 + 1] AS path, rpad(left(text, 1975 + (doc_id % 23)::INT), 1975 + (doc_id % 23)::INT, 'x') || '<Auto-Generated/>' || text AS src FROM documents)
SELECT doc_id, path, contains(lower(path), 'web references') OR contains(lower(path), 'service references') OR contains(lower(path), 'connected services')
  OR suffix(lower(path), '.designer.cs') OR suffix(lower(path), '.g.cs') OR suffix(lower(path), '.generated.cs')
  OR contains(lower(left(src, 2000)), 'auto-generated') OR contains(lower(left(src, 2000)), 'autogenerated') AS is_generated FROM g""")
def generated_filter(spark, d):
    """Generated code by folder, suffix or banner, with banners around the end of the head."""
    at = (F.lit(1975) + F.col("doc_id") % 23).cast("int")
    path = F.element_at(F.array(*map(F.lit, GENERATED_PATHS)), (F.col("doc_id") % 7 + 1).cast("int"))
    src = F.concat(F.rpad(F.left("text", at), at, F.lit("x")), F.lit("<Auto-Generated/>"), "text")
    return read(spark, d, "documents").select("doc_id", path.alias("path"), T.is_generated(path, src).alias("is_generated"))


STEMS = ["OrderTests", "order_test", "Latest", "Contest.Spec", "Plain", "UserSpecs", "Fixture"]


@query(f"""WITH g AS (SELECT doc_id, (CASE WHEN doc_id % 5 = 0 THEN 'Tests/' WHEN doc_id % 5 = 1 THEN 'src/test/' ELSE 'src/' END) || {SQL_LIST(STEMS)}[doc_id % 7 + 1] || '.cs' AS path, {SQL_LIST(STEMS)}[doc_id % 7 + 1] AS stem FROM documents)
SELECT doc_id, path, regexp_matches(lower(stem), '(tests|test|spec)$') OR contains('/' || lower(path), '/tests/') OR contains('/' || lower(path), '/test/') AS is_test,
  regexp_replace(regexp_replace(stem, '(tests|test|specs|spec|fixture)$', '', 'i'), '[_ .]+$', '') AS subject FROM g""")
def test_file_filter(spark, d):
    """Test files and what they test."""
    stem = F.element_at(F.array(*map(F.lit, STEMS)), (F.col("doc_id") % 7 + 1).cast("int"))
    folder = F.when(F.col("doc_id") % 5 == 0, "Tests/").when(F.col("doc_id") % 5 == 1, "src/test/").otherwise("src/")
    g = read(spark, d, "documents").select("doc_id", F.concat(folder, stem, F.lit(".cs")).alias("path"))
    return g.select("doc_id", "path", T.is_test(F.col("path")).alias("is_test"), T.tested_subject(F.col("path")).alias("subject"))


SQL_MARKED = """array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE (doc_id + i) % 7 WHEN 1 THEN '// ' || x WHEN 2 THEN '  /* ' || x WHEN 4 THEN x || ' */ ' WHEN 5 THEN ' ' ELSE x END), chr(10))"""


def marked(text: str = "text"):
    """The text with comment marks put on lines by number."""
    n = lambda i: (F.col("doc_id") + i + 1) % 7
    mark = lambda x, i: F.when(n(i) == 1, F.concat(F.lit("// "), x)).when(n(i) == 2, F.concat(F.lit("  /* "), x)).when(n(i) == 4, F.concat(x, F.lit(" */ "))).when(n(i) == 5, " ").otherwise(x)
    return F.array_join(F.transform(F.split(text, "\n", -1), mark), "\n")


@query(f"""WITH m AS (SELECT doc_id, string_split({SQL_MARKED}, chr(10)) AS l FROM documents),
s AS (SELECT doc_id, len(l)::INT AS lines, list_reduce(list_transform(l, lambda x: {{'n': 0, 'inside': false, 'x': trim(x)}}), lambda a, b: {{
  'n': a.n + (CASE WHEN NOT a.inside AND b.x <> '' AND NOT starts_with(b.x, '//') AND NOT starts_with(b.x, '/*') THEN 1 ELSE 0 END),
  'inside': CASE WHEN a.inside OR starts_with(b.x, '/*') THEN NOT contains(b.x, '*/') ELSE false END, 'x': ''}}, {{'n': 0, 'inside': false, 'x': ''}}) AS r FROM m)
SELECT doc_id, lines, r.n AS code_lines FROM s""")
def code_lines(spark, d):
    """lines, and lines that hold code."""
    m = read(spark, d, "documents").select("doc_id", marked().alias("src"))
    return m.select("doc_id", T.line_count(F.col("src")).alias("lines"), T.code_lines(F.col("src")).alias("code_lines"))


SQL_DEPTH = """l AS (SELECT doc_id, unnest(string_split(translate(text, 'wy', '{}'), chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
s AS (SELECT *, sum(length(line) - length(replace(line, '{', '')) - (length(line) - length(replace(line, '}', '')))) OVER (PARTITION BY doc_id ORDER BY line_no) AS s FROM l),
dep AS (SELECT doc_id, line_no, line, (s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY line_no)))::BIGINT AS depth FROM s)"""


def braced(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("path"), F.translate("text", "wy", "{}").alias("content"))
    return lines.exploded(docs)


@query(f"WITH {SQL_DEPTH} SELECT doc_id, line_no::INT AS line_no, depth FROM dep")
def brace_depth(spark, d):
    """Depth of braces after each line."""
    return lines.with_depth(braced(spark, d)).select(F.col("path").alias("doc_id"), "line_no", "depth")


@query(rf"""WITH {SQL_DEPTH} SELECT doc_id, line_no::INT AS line_no, CASE WHEN regexp_matches(line, '^\s*$') THEN (CASE depth WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 2 END) WHEN regexp_matches(line, '\}}\s*$') THEN 1 ELSE 0 END AS quality FROM dep""")
def boundary_quality(spark, d):
    """where a chunk had best end."""
    return lines.with_quality(braced(spark, d)).select(F.col("path").alias("doc_id"), "line_no", "quality")


SQL_CUT = """greatest(s + 1, len(list_filter(c, lambda x: x - coalesce(c[s], 0) <= 1500))) AS e, q[greatest(s, e - greatest(1, (e - s) // 5)) + 1:e] AS back,
  CASE WHEN e < len(l) AND list_max(back) > 0 THEN e - list_position(list_reverse(back), list_max(back)) ELSE e - 1 END AS last"""
SQL_CHUNKS = rf"""{SQL_DEPTH},
q AS (SELECT doc_id, line_no, line, CASE WHEN regexp_matches(line, '^\s*$') THEN (CASE depth WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 2 END) WHEN regexp_matches(line, '\}}\s*$') THEN 1 ELSE 0 END AS q, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS c FROM dep),
a AS (SELECT doc_id, list(line ORDER BY line_no) AS l, list(q ORDER BY line_no) AS q, list(c::BIGINT ORDER BY line_no) AS c FROM q GROUP BY doc_id HAVING bool_or(regexp_matches(line, '\S'))),
walk(doc_id, begun, ended) AS (SELECT doc_id, s, last FROM (SELECT doc_id, 0::BIGINT AS s, {SQL_CUT} FROM a)
  UNION ALL SELECT doc_id, s, last FROM (SELECT w.doc_id, greatest(begun + 1, ended - 2) AS s, {SQL_CUT} FROM walk w JOIN a ON a.doc_id = w.doc_id WHERE ended < len(l) - 1)),
cut AS (SELECT d.source || '/' || d.lang || '/' || d.doc_id AS file_path, (begun + 1)::INT AS start_line, (ended + 1)::INT AS end_line, array_to_string(l[begun + 1:ended + 1], chr(10)) AS content FROM walk JOIN a USING (doc_id) JOIN documents d USING (doc_id))"""


def braced_files(spark: SparkSession, d: str) -> DataFrame:
    return file_table(spark, d).withColumn("content", F.translate("content", "wy", "{}"))


@query(rf"WITH RECURSIVE {SQL_CHUNKS} SELECT file_path || '#' || start_line AS id, file_path, start_line, end_line, content FROM cut WHERE regexp_matches(content, '\S')")
def chunk_documents(spark, d):
    """Documents cut into chunks."""
    return chunking.chunks(braced_files(spark, d))


@query(rf"""WITH RECURSIVE {SQL_CHUNKS} SELECT d.source || '/' || d.lang || '/' || d.doc_id AS path, any_value(upper(sha256(translate(text, 'wy', '{{}}')))) AS content_hash, count_if(regexp_matches(content, '\S'))::INT AS chunk_count
FROM documents d LEFT JOIN cut ON file_path = d.source || '/' || d.lang || '/' || d.doc_id GROUP BY d.source, d.lang, d.doc_id""")
def ingest_ledger(spark, d):
    """What an index holds after a run over all files and another over the same."""
    index = Index(spark, scratch(spark, "index"))
    for _ in range(2):
        ingest.ingest_files(braced_files(spark, d).select("path", "content"), index, HashEmbedder(16))
    chunks = index.table("chunks").where(F.size("embedding") == 16).groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return index.table("ledger").join(chunks, "path", "left").where(F.coalesce("n", F.lit(0)) == F.col("chunk_count")).select("path", "content_hash", "chunk_count")


SQL_LINES = """final AS (SELECT source || '/' || lang || '/' || doc_id AS path, CASE WHEN doc_id % 10 = 3 THEN text || '!' ELSE text END AS text, doc_id FROM documents WHERE text IS NOT NULL)"""


def three_commits(spark: SparkSession, d: str) -> Index:
    """An index of documents by lines after three commits: nine tenths of them, then a tenth more and a tenth changed,
    then a tenth gone."""
    docs = read(spark, d, "documents").where("text is not null").withColumn("path", F.concat_ws("/", "source", "lang", "doc_id")).withColumn("part", F.col("doc_id") % 10)
    changed = docs.withColumn("text", F.when(F.col("part") == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    index = Index(spark, scratch(spark, "index"))
    none = F.lit(False)
    for rows, come, go in ((docs, F.col("part") != 9, none), (changed, F.col("part").isin(3, 9), F.col("part") == 3), (changed, none, F.col("part") == 7)):
        new = rows.where(come)
        cut = new.select("path", F.posexplode(F.split("text", "\n")).alias("line", "content"))
        line = (F.col("line") + 1).alias("start_line")
        chunks = cut.select(F.concat_ws("#", "path", F.col("line") + 1).alias("id"), F.col("path").alias("file_path"), line, line.alias("end_line"), "content", F.lit(None).cast("array<float>").alias("embedding"))
        entries = new.select("path", T.content_hash(F.col("text")).alias("content_hash"), F.size(F.split("text", "\n")).alias("chunk_count"), F.current_timestamp().alias("indexed_at"))
        index.replace(rows.where(go).select("path"), chunks, entries)
    return index


@query(f"""WITH {SQL_LINES} SELECT path, upper(sha256(text)) AS content_hash, len(string_split(text, chr(10)))::INT AS chunk_count, len(string_split(text, chr(10)))::BIGINT AS live, length(replace(text, chr(10), ''))::BIGINT AS chars, len(string_split(text, chr(10)))::INT AS last_line
FROM final WHERE doc_id % 10 <> 7""")
def committed_index(spark, d):
    """What segments and deletion vectors hold together after new, changed and vanished files."""
    index = three_commits(spark, d)
    lines = index.table("chunks").groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("live"), F.sum(F.length("content")).alias("chars"), F.max("end_line").alias("last_line"))
    return index.table("ledger").join(lines, "path").select("path", "content_hash", "chunk_count", "live", "chars", "last_line")


@query(f"""WITH {SQL_LINES}, l AS (SELECT doc_id % 10 AS part, len(string_split(text, chr(10)))::BIGINT AS n FROM final),
c(version, chunks, ledger, gone) AS (SELECT 1, coalesce(sum(n) FILTER (part <> 9), 0), count(*) FILTER (part <> 9), 0 FROM l UNION ALL SELECT 2, coalesce(sum(n) FILTER (part IN (3, 9)), 0), count(*) FILTER (part IN (3, 9)), coalesce(sum(n) FILTER (part = 3), 0) FROM l UNION ALL SELECT 3, 0, 0, coalesce(sum(n) FILTER (part = 7), 0) FROM l)
SELECT version::BIGINT AS version, chunks::BIGINT AS chunks, ledger::BIGINT AS ledger, gone::BIGINT AS gone, (sum(chunks - gone) OVER (ORDER BY version))::BIGINT AS live, true AS by_change FROM c""")
def commit_log(spark, d):
    """What each of the three commits wrote; by_change: its bytes are its share of the rows, not the index's."""
    log = three_commits(spark, d).commits()
    first = log[0]["bytes"] / max(log[0]["chunks"], 1)
    rows = [(c["version"], c["chunks"], c["ledger"], c["gone"], c["live"], c["bytes"] <= 2 * first * c["chunks"] + 24 * c["gone"] + (1 << 17)) for c in log]
    return spark.createDataFrame(rows, "version long, chunks long, ledger long, gone long, live long, by_change boolean")


@query("SELECT 'source=' || source || '/part' AS path, count(*) AS lines, true AS source_file FROM documents GROUP BY source")
def walked_files(spark, d):
    """Files under a folder with their paths relative to it; documents are written there as lines."""
    folder = scratch(spark, "tree")
    read(spark, d, "documents").select("source", "doc_id").write.partitionBy("source").option("maxRecordsPerFile", 10_000).json(folder)
    found = files_source.files(spark, folder).select(F.regexp_replace("path", "/part-[^/]*$", "/part").alias("path"), F.endswith("path", F.lit(".json")).alias("source_file"), T.read_lines_count(F.col("content")).alias("lines"))
    return found.groupBy("path", "source_file").agg(F.sum("lines").alias("lines"))


@query("SELECT 'source=' || source AS folder, 1 AS chunk_count FROM documents GROUP BY source")
def streamed_ledger(spark, d):
    """2.11c: a watched folder with a file for each source, indexed by a stream that ends when all is read."""
    work = scratch(spark, "watched")
    read(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.partitionBy("source").json(f"{work}/tree")
    run = watch(spark, f"{work}/tree", f"{work}/index", f"{work}/checkpoint", HashEmbedder(8))
    run.awaitTermination()
    return Index(spark, f"{work}/index").table("ledger").select(F.regexp_replace("path", "/part-[^/]*$", "").alias("folder"), "chunk_count")


@query("""WITH f AS (SELECT source, coalesce(lang, 'none') AS lang, doc_id // 20 AS part, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10) AS body FROM documents WHERE source IS NOT NULL GROUP BY ALL),
left_over AS (SELECT *, row_number() OVER (ORDER BY source, lang, part) AS turn FROM f WHERE source <> (SELECT min(source) FROM f)),
final AS (SELECT 'source=' || source || '/lang=' || lang || '/part=' || part AS folder, CASE WHEN turn = 1 THEN 'edited' || chr(10) ELSE body END AS body FROM left_over)
SELECT folder, upper(sha256(body)) AS content_hash FROM final WHERE strlen(body) BETWEEN 1 AND 512 * 1024""")
def followed_ledger(spark, d):
    """2.11c, S16, X16: a directory followed over two runs of one checkpoint. Documents lie there by twenties; between
    the runs a third of the files come, one is edited and all of a source go."""
    lang, part = F.coalesce("lang", F.lit("none")).alias("lang"), F.floor(F.col("doc_id") / 20).alias("part")
    docs = read(spark, d, "documents").where("source is not null").select("source", lang, part, "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    work = scratch(spark, "followed")
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(work).getFileSystem(spark._jsc.hadoopConfiguration())

    def put(rows: DataFrame) -> None:
        lines = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda x: F.concat(x["text"], F.lit("\n")))
        whole = rows.groupBy("source", "lang", "part").agg(F.array_join(lines, "").alias("content"))  # twenty ids a file
        path = F.concat(F.lit("source="), "source", F.lit("/lang="), "lang", F.lit("/part="), "part", F.lit("/part-0.txt"))
        files_source.put(whole.select(path.alias("path"), "content"), f"{work}/tree")

    def run() -> None:
        follow(spark, f"{work}/tree", f"{work}/index", f"{work}/checkpoint", HashEmbedder(8)).awaitTermination()

    put(docs.where("part % 3 <> 2"))
    run()
    put(docs.where("part % 3 = 2"))
    gone = docs.agg(F.min("source").alias("s")).first().s
    fs.delete(at(f"{work}/tree/source={gone}"), True)
    first = docs.where(F.col("source") != gone).select("source", "lang", "part").orderBy("source", "lang", "part").first()
    if first:
        for file in fs.listStatus(at(f"{work}/tree/source={first.source}/lang={first.lang}/part={first.part}")):
            if file.getPath().getName().endswith(".txt"):
                out = fs.create(file.getPath(), True)
                out.writeBytes("edited\n")
                out.close()
    run()
    return Index(spark, f"{work}/index").table("ledger").select(F.regexp_replace("path", "/part-[^/]*$", "").alias("folder"), "content_hash")


@query("SELECT doc_id, 'File: ' || source || '/' || lang || '/' || doc_id || chr(10) || chr(10) || text AS text FROM documents")
def embedding_texts(spark, d):
    """What is embedded for a chunk."""
    return file_table(spark, d).select("doc_id", T.embedding_text(F.col("path"), F.col("content")).alias("text"))


@query("SELECT doc_id, lang AS layer FROM documents")
def layers(spark, d):
    """the layer that a path's third part from its end names."""
    return read(spark, d, "documents").select("doc_id", T.layer(F.concat_ws("\\", "source", "lang", F.lit("Project"), "doc_id")).alias("layer"))


@query("SELECT doc_id, upper(sha256(text)) AS content_hash FROM documents")
def content_hash(spark, d):
    """F5."""
    return read(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


SQL_SNAPS = """now_files AS (SELECT source || '/' || lang || '/' || doc_id || CASE WHEN doc_id % 10 = 1 THEN '.moved' ELSE '' END AS path, sha256(CASE WHEN doc_id % 10 = 3 THEN text || '!' ELSE text END) AS h FROM documents),
then_files AS (SELECT source || '/' || lang || '/' || doc_id AS path, sha256(text) AS h FROM documents)"""


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Files now, and the ledger: some moved, which are new and gone, some changed."""
    f = file_table(spark, d)
    changed = F.when(F.col("doc_id") % 10 == 3, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    moved = F.concat("path", F.when(F.col("doc_id") % 10 == 1, ".moved").otherwise(""))
    now = f.select("doc_id", moved.alias("path"), changed.alias("content")).withColumn("content_hash", T.content_hash(F.col("content")))
    return now, f.select("doc_id", "path", "content", T.content_hash(F.col("content")).alias("content_hash"))


@query(f"WITH {SQL_SNAPS} SELECT coalesce(n.path, t.path) AS path, CASE WHEN t.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'vanished' WHEN n.h = t.h THEN 'unchanged' ELSE 'changed' END AS status, upper(coalesce(n.h, t.h)) AS content_hash FROM now_files n FULL JOIN then_files t ON n.path = t.path")
def ledger_diff(spark, d):
    """What changed since the last run."""
    return ledger.diff(*snapshots(spark, d))


@query(f"WITH {SQL_SNAPS} SELECT path, upper(h) AS content_hash FROM now_files UNION ALL SELECT path, upper(h) FROM then_files WHERE path NOT IN (SELECT path FROM now_files)")
def upsert_chunks(spark, d):
    """Rows put in place of those of equal key."""
    now, then = snapshots(spark, d)
    return ledger.upsert(then.select("path", "content_hash"), now.select("path", "content_hash"), "path")


@query(f"WITH {SQL_SNAPS} SELECT path, upper(h) AS content_hash FROM then_files WHERE path IN (SELECT path FROM now_files)")
def forget_vanished(spark, d):
    """Rows of vanished paths go."""
    now, then = snapshots(spark, d)
    gone = ledger.diff(now, then).where("status = 'vanished'")
    return ledger.forget(then.select("path", "content_hash"), gone, "path")


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def fts_backfill(spark, d):
    """Chunks that an index lacks."""
    return retrieval.missing_from_index(texts(spark, d), vectors(spark, d)).select("id")


# ---- history and risk -----------------------------------------------------------------------------------------

SQL_COMMITS = "commits AS (SELECT event_type || '/' || json_extract_string(props, '$.k') AS path, user_id AS author, ts, event_id FROM events)"


def commits(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.concat_ws("/", "event_type", F.get_json_object("props", "$.k")).alias("path"), F.col("user_id").alias("author"), "ts", F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), "event_id").alias("pos"))


@query(f"WITH {SQL_COMMITS} SELECT path, count(*) AS commits, count(DISTINCT author) AS authors, max(ts) AS last_change FROM commits GROUP BY path")
def git_churn(spark, d):
    """A1: commits, authors and last change by path."""
    return history.churn(commits(spark, d))


@query(f"WITH {SQL_COMMITS} SELECT path, count(*) AS commits FROM commits WHERE ts >= (SELECT max(ts) FROM commits) - INTERVAL 7 DAY GROUP BY path")
def git_churn_window(spark, d):
    """Churn of the last week of the data."""
    return history.since(commits(spark, d), 7).groupBy("path").agg(F.count(F.lit(1)).alias("commits"))


@query("SELECT 'u' || user_id AS author, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS pos, strftime(ts, '%Y-%m-%d %H:%M:%S') AS read_at, event_type || '/' || json_extract_string(props, '$.k') AS path FROM events")
def git_log_parse(spark, d):
    """Commits of log texts, one text for each user."""
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    path = F.concat_ws("/", "event_type", F.get_json_object("props", "$.k"))
    block = F.concat(F.lit(history.MARK), F.lit("u"), "user_id", F.lit(history.MARK), at, F.lit("\r\n\r\n"), path, F.lit("\n"))
    logs = read(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", block.alias("b")))).alias("b"))
    logs = logs.select("user_id", F.array_join(F.transform("b", lambda x: x["b"]), "").alias("log"))
    return history.parse_log(logs, keep=["user_id"]).select("author", "pos", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("read_at"), "path")


@query(f"WITH {SQL_COMMITS}, w AS (SELECT path, author, date_trunc('day', ts) - to_days(k) AS start_day FROM commits, (SELECT unnest(range(7))::INT AS k)) SELECT strftime(start_day, '%Y-%m-%d') AS since, path, count(*) AS commits, count(DISTINCT author) AS authors FROM w GROUP BY ALL")
def sliding_churn(spark, d):
    """2.11d, A1: commits and authors by path over windows of a week that slide by days."""
    c = commits(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_churn(c).select(F.date_format("window.start", "yyyy-MM-dd").alias("since"), "path", "commits", "authors")


@query(f"""WITH {SQL_COMMITS}, ends AS (SELECT min(ts) AS lo, date_trunc('day', min(ts)) + INTERVAL 21 DAY AS first, date_trunc('day', min(ts)) + INTERVAL 25 DAY AS second FROM commits),
come AS (SELECT c.*, CASE WHEN event_id % 10 = 0 THEN 3 WHEN ts < first THEN 1 WHEN ts < second THEN 2 ELSE 3 END AS step FROM commits c, ends),
mark AS (SELECT max(ts) FILTER (step <= 2) - INTERVAL 2 DAY AS over_at FROM come),
w AS (SELECT path, author, step, date_trunc('day', ts) - to_days(k) AS start_day FROM come, (SELECT unnest(range(7))::INT AS k)),
kept AS (SELECT w.* FROM w, mark WHERE NOT (step = 3 AND start_day + INTERVAL 7 DAY <= over_at))
SELECT strftime(start_day, '%Y-%m-%d') AS since, path, count(*) AS commits, count(DISTINCT author) AS authors FROM kept GROUP BY ALL""")
def streamed_churn(spark, d):
    """2.11d: the same as a stream in four runs from one checkpoint. A tenth of the commits come with the third, those of
    windows that are over by then too late; the fourth brings a commit long after all others."""
    c = commits(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    lo = c.agg(F.date_trunc("day", F.min("ts")).alias("lo")).first().lo
    if lo is None:
        return windowed_churn(c).select(F.date_format("window.start", "yyyy-MM-dd").alias("since"), "path", "commits", "authors")
    after = lambda days: F.col("ts") >= F.lit(lo) + F.make_interval(days=F.lit(days))
    step = F.when(F.col("pos.event_id") % 10 == 0, 3).when(~after(21), 1).when(~after(25), 2).otherwise(3)
    slim = c.select("path", F.col("author").cast("long").alias("author"), "ts", step.alias("step"))
    work = scratch(spark, "churn")
    for run in (1, 2, 3, 4):
        last = slim.agg((F.max("ts") + F.make_interval(days=F.lit(60))).alias("ts")).select(F.lit("").alias("path"), F.lit(None).cast("long").alias("author"), "ts")
        (slim.where(F.col("step") == run).drop("step") if run < 4 else last).write.mode("append").parquet(f"{work}/in")
        follow_churn(spark, f"{work}/in", f"{work}/out", f"{work}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{work}/out").select(F.date_format("window.start", "yyyy-MM-dd").alias("since"), "path", "commits", "authors")


@query("WITH r AS (SELECT *, dense_rank() OVER (ORDER BY p_size) - 1 AS r FROM part) SELECT p_partkey, round(CASE WHEN max(r) OVER () = 0 THEN 0.5 ELSE r::DOUBLE / max(r) OVER () END, 9) AS place FROM r")
def norm_dense_rank(spark, d):
    """Place among distinct values."""
    return risk.with_norm_rank(read(spark, d, "part"), "p_size", "place").select("p_partkey", F.round("place", 9).alias("place"))


SQL_METRICS = """m AS (SELECT 'src/' || p_partkey || '.cs' AS path, p_partkey, p_size AS complexity, (p_partkey % 9)::INT AS max_nesting, (p_size // 2)::INT AS worst, (p_retailprice)::INT AS code_lines FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0),
c AS (SELECT l_partkey AS p_partkey, count(*) AS commits, count(DISTINCT l_suppkey) AS authors FROM lineitem GROUP BY l_partkey),
t AS (SELECT DISTINCT doc_id AS p_partkey FROM labels WHERE quality = 1),
j AS (SELECT m.*, coalesce(commits, 0) AS commits, coalesce(authors, 0) AS authors, t.p_partkey IS NOT NULL AS tested FROM m LEFT JOIN c USING (p_partkey) LEFT JOIN t USING (p_partkey) WHERE code_lines >= 100),
r AS (SELECT *, dense_rank() OVER (ORDER BY complexity) - 1 AS cr, dense_rank() OVER (ORDER BY max_nesting) - 1 AS nr, dense_rank() OVER (ORDER BY commits) - 1 AS hr FROM j),
n AS (SELECT *, CASE WHEN max(cr) OVER () = 0 THEN 0.5::DOUBLE ELSE cr::DOUBLE / max(cr) OVER () END AS c01, CASE WHEN max(nr) OVER () = 0 THEN 0.5::DOUBLE ELSE nr::DOUBLE / max(nr) OVER () END AS n01, CASE WHEN max(hr) OVER () = 0 THEN 0.5::DOUBLE ELSE hr::DOUBLE / max(hr) OVER () END AS h01 FROM r),
risks AS (SELECT *, round_even(sqrt((0.75::DOUBLE * c01 + 0.25::DOUBLE * n01) * h01) * (CASE WHEN tested THEN 1.0::DOUBLE ELSE 1.4::DOUBLE END), 3) AS score FROM n)"""


def risk_table(spark: SparkSession, d: str) -> DataFrame:
    """part as file metrics, lineitem as commits, labels as tests."""
    p = read(spark, d, "part")
    key = F.col("p_partkey")
    metrics = p.select(
        F.concat(F.lit("src/"), key, F.lit(".cs")).alias("path"), "p_partkey", F.col("p_size").alias("complexity"), (key % 9).cast("int").alias("max_nesting"), F.floor(F.col("p_size") / 2).cast("int").alias("worst_method_complexity"),
        F.lit("Run").alias("worst_method"), F.rint("p_retailprice").cast("int").alias("code_lines"), (key % 11 == 0).alias("is_generated"), (key % 13 == 0).alias("is_test"),
    )
    churn = read(spark, d, "lineitem").groupBy(F.concat(F.lit("src/"), "l_partkey", F.lit(".cs")).alias("path")).agg(F.count(F.lit(1)).alias("commits"), F.count_distinct("l_suppkey").alias("authors"))
    tested = read(spark, d, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("subject"))
    return risk.risk(metrics, churn, tested)


@query(f"WITH {SQL_METRICS} SELECT path, score, complexity, max_nesting, commits, authors, tested FROM risks")
def risk_score(spark, d):
    """The risk ranking."""
    return risk_table(spark, d).select("path", "score", "complexity", "max_nesting", "commits", "authors", "tested")


@query(f"""WITH {SQL_METRICS} SELECT path, array_to_string(list_filter([
  CASE WHEN worst >= 20 THEN 'Run: cyclomatic complexity ' || worst || ', so as many tests to cover its branches' END, CASE WHEN max_nesting >= 6 THEN 'nested ' || max_nesting || ' deep' END,
  CASE WHEN commits >= 10 THEN 'changed in ' || commits || ' commits' END, CASE WHEN authors = 1 AND commits >= 5 THEN 'touched by one person only' END, CASE WHEN NOT tested THEN 'no test file is named after it' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM risks""")
def risk_reasons(spark, d):
    """why each file ranks as it does."""
    return risk_table(spark, d).select("path", F.array_join("reasons", "; ").alias("reasons"))


@query("""WITH e AS (SELECT 'Src' || p_partkey % 17 || '/' || p_partkey || '.cs' AS path, p_partkey FROM part) SELECT path FROM e WHERE p_partkey % 17 NOT IN (3, 5)""")
def risk_without_tests(spark, d):
    """Files in the folders of test projects go."""
    e = read(spark, d, "part").select(F.concat(F.lit("Src"), F.col("p_partkey") % 17, F.lit("/"), "p_partkey", F.lit(".cs")).alias("path"))
    folders = spark.createDataFrame([("src3",), ("SRC5",), (".",)], "folder string")
    return risk.without_tests(e, folders)


# ---- projects -------------------------------------------------------------------------------------------------

SQL_REFERENCES = "refs_all AS (SELECT DISTINCT 'P' || l_partkey AS a, 'P' || l_suppkey AS b FROM lineitem)"
SQL_EDGES = "edges AS (SELECT 'P' || l_partkey AS a, 'P' || (sum(l_orderkey * 7 + l_suppkey) % (SELECT count(*) FROM part))::BIGINT AS b FROM lineitem GROUP BY l_partkey)"
SQL_KIND = "CASE split_part(p_type, ' ', 1) WHEN 'STANDARD' THEN 'Library' WHEN 'ECONOMY' THEN 'Web' WHEN 'MEDIUM' THEN 'Console' WHEN 'SMALL' THEN 'Wpf' WHEN 'PROMO' THEN 'Test' ELSE 'Broken' END"
SQL_PROJECTS = f"""projects AS (SELECT 'P' || p_partkey AS name, {SQL_KIND} AS kind, p_size::BIGINT * 1000 * (p_partkey % 5 <> 4)::INT AS lines, p_size::BIGINT AS source_files, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN 'V4.5' WHEN p_partkey % 4 = 2 THEN 'v4.5' ELSE 'net' || p_size % 9 END AS target_framework,
  p_partkey FROM part)"""
SQL_FINDINGS = f"""{SQL_EDGES}, {SQL_PROJECTS},
tested AS (SELECT DISTINCT e.b FROM edges e JOIN projects p ON p.name = e.a WHERE p.kind = 'Test'),
unreadable AS (SELECT 'Unreadable' AS kind, name AS project, 'The project file is not valid XML' AS summary, 0 AS kind_ord FROM projects WHERE kind = 'Broken'),
coupled AS (SELECT 'LibraryCoupledToWeb' AS kind, name AS project, 'A library that depends on System.Web.Mvc' AS summary, 1 AS kind_ord FROM projects WHERE kind = 'Library' AND p_partkey % 3 = 0),
untested AS (SELECT 'Untested' AS kind, name AS project, 'No test project refers to it (' || format('{{:,}}', lines) || ' lines)' AS summary, 2 AS kind_ord FROM projects WHERE kind NOT IN ('Test', 'Broken') AND lines > 0 AND name NOT IN (SELECT b FROM tested)),
oversized AS (SELECT 'Oversized' AS kind, name AS project, format('{{:,}}', lines) || ' lines in one project' AS summary, 3 AS kind_ord FROM projects WHERE lines > 20000 AND kind <> 'Broken'),
orphan AS (SELECT 'Orphan' AS kind, name AS project, 'Nothing in the solution refers to it' AS summary, 4 AS kind_ord FROM projects WHERE kind = 'Library' AND lines > 0 AND name NOT IN (SELECT b FROM edges)),
walk(a, cur, path) AS (SELECT a, b, [a] FROM edges UNION ALL SELECT w.a, e.b, list_append(w.path, w.cur) FROM walk w JOIN edges e ON e.a = w.cur WHERE w.cur <> w.a AND NOT list_contains(w.path, w.cur)),
cyc AS (SELECT 'DependencyCycle' AS kind, a AS project, 'Dependency cycle: ' || array_to_string(list_append(path, a), ' -> ') AS summary, 5 AS kind_ord FROM walk WHERE cur = a AND a = list_min(path)),
findings AS (SELECT * FROM unreadable UNION ALL SELECT * FROM coupled UNION ALL SELECT * FROM untested UNION ALL SELECT * FROM oversized UNION ALL SELECT * FROM orphan UNION ALL SELECT * FROM cyc)"""


def project_table(spark: SparkSession, d: str) -> DataFrame:
    p, key, size = read(spark, d, "part"), F.col("p_partkey"), F.col("p_size").cast("long")
    kinds = F.create_map(*[F.lit(x) for kv in (("STANDARD", "Library"), ("ECONOMY", "Web"), ("MEDIUM", "Console"), ("SMALL", "Wpf"), ("PROMO", "Test")) for x in kv])
    web = F.when(key % 3 == 0, F.array(F.lit("System.Web.Mvc"), F.lit("System.Core"))).otherwise(F.array(F.lit("System.Core")))
    framework = F.when(key % 4 == 1, "V4.5").when(key % 4 == 2, "v4.5").when(key % 4 == 3, F.concat(F.lit("net"), F.col("p_size") % 9))
    return p.select(
        F.concat(F.lit("P"), key).alias("name"), F.concat_ws("/", "p_brand", key.cast("string")).alias("path"), F.coalesce(kinds[F.split("p_type", " ")[0]], F.lit("Broken")).alias("kind"),
        framework.alias("target_framework"), web.alias("assembly_references"), size.alias("source_files"), F.when(key % 5 == 4, 0).otherwise(size * 1000).alias("lines"),
    )


def reference_table(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as references, part by supplier; those to projects that are not there are among them."""
    return read(spark, d, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("from"), F.concat(F.lit("P"), "l_suppkey").alias("to"))


def edge_table(spark: SparkSession, d: str) -> DataFrame:
    """A sparse graph with cycles of any length: each part refers to one other, which a sum over its lines names."""
    n = read(spark, d, "part").agg(F.count(F.lit(1)).alias("n"))
    refs = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_orderkey") * 7 + F.col("l_suppkey")).alias("x")).crossJoin(F.broadcast(n))
    refs = refs.select(F.concat(F.lit("P"), "l_partkey").alias("from"), F.concat(F.lit("P"), F.col("x") % F.col("n")).alias("to"))
    return projects.edges(refs, read(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("name")))


def cycle_table(spark: SparkSession, d: str) -> DataFrame:
    return projects.cycles(edge_table(spark, d))


def finding_table(spark: SparkSession, d: str) -> DataFrame:
    return projects.findings(project_table(spark, d), edge_table(spark, d), cycle_table(spark, d))


@query(f"WITH {SQL_REFERENCES} SELECT a AS \"from\", b AS \"to\" FROM refs_all WHERE b IN (SELECT 'P' || p_partkey FROM part WHERE p_size > 9)")
def project_edges(spark, d):
    """References to projects that are there."""
    known = read(spark, d, "part").where("p_size > 9").select(F.concat(F.lit("p"), "p_partkey").alias("name"))
    return projects.edges(reference_table(spark, d), known)


@query(f"WITH RECURSIVE {SQL_FINDINGS} SELECT replace(summary, 'Dependency cycle: ', '') AS cycle FROM cyc")
def project_cycles(spark, d):
    """Dependency cycles of any length."""
    return cycle_table(spark, d).select(F.array_join("cycle", " -> ").alias("cycle"))


SQL_WEB = """web AS (SELECT DISTINCT 'p' || l_partkey AS a, 'p' || b AS b FROM (SELECT l_partkey, (l_partkey // 50 * 50 + sum(l_orderkey * 7 + l_suppkey) % 120)::BIGINT AS b
  FROM lineitem GROUP BY l_partkey, l_returnflag) WHERE b IN (SELECT p_partkey FROM part)),
reach(a, b) AS (SELECT a, b FROM web UNION SELECT r.a, w.b FROM reach r JOIN web w ON w.a = r.b),
parts AS (SELECT r.a AS project, min(r.b) AS component FROM reach r JOIN reach q ON q.a = r.b AND q.b = r.a GROUP BY r.a)"""


def web_table(spark: SparkSession, d: str) -> DataFrame:
    """A graph with several references a project, among its neighbours by number and to those of the next fifty."""
    key = F.col("l_partkey")
    refs = read(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.sum(F.col("l_orderkey") * 7 + F.col("l_suppkey")).alias("x"))
    refs = refs.select(F.concat(F.lit("P"), key).alias("from"), F.concat(F.lit("P"), (F.floor(key / 50) * 50 + F.col("x") % 120).cast("long")).alias("to"))
    return projects.edges(refs, read(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("name")))


@query(f"WITH RECURSIVE {SQL_WEB} SELECT project, component, count(*) OVER (PARTITION BY component) AS size FROM parts")
def project_components(spark, d):
    """Projects that depend on themselves, by strongly connected component. One task finishes a thousand edges at
    most, so blocks run from sf0.01 on; at sf0.001 all edges are fewer."""
    return projects.components(web_table(spark, d), finish=1000)


@query(f"""WITH RECURSIVE {SQL_WEB},
inner_edges AS (SELECT w.a, w.b, p.component AS root FROM web w JOIN parts p ON p.project = w.a JOIN parts q ON q.project = w.b AND q.component = p.component),
back(node, root, d) AS (SELECT DISTINCT root, root, 0 FROM inner_edges UNION SELECT e.a, e.root, k.d + 1 FROM back k JOIN inner_edges e ON e.b = k.node WHERE e.a <> e.root AND k.d < 60),
dist AS (SELECT node, root, min(d) AS d FROM back GROUP BY node, root),
steps AS (SELECT e.a, e.root, arg_min(e.b, (t.d, e.b)) AS b FROM inner_edges e JOIN dist t ON t.node = e.b GROUP BY e.a, e.root),
walk(root, path) AS (SELECT root, [root, b] FROM steps WHERE a = root UNION ALL SELECT w.root, list_append(w.path, s.b) FROM walk w JOIN steps s ON s.a = w.path[-1] AND s.a <> s.root)
SELECT root, array_to_string(path, ' -> ') AS cycle FROM walk WHERE path[-1] = root""")
def shortest_cycles(spark, d):
    """The shortest cycle through the least project of each component, of equal ones the first by names."""
    e = web_table(spark, d).select(F.lower("from").alias("a"), F.lower("to").alias("b"))
    return cycles.shortest(e).select("root", F.array_join("cycle", " -> ").alias("cycle"))


@query(f"WITH {SQL_REFERENCES} SELECT a AS \"from\", string_agg(b, ',' ORDER BY b) AS targets, count(*) AS degree FROM refs_all GROUP BY a")
def adjacency(spark, d):
    """Outgoing neighbours."""
    return projects.adjacency(reference_table(spark, d).distinct()).select("from", F.array_join("targets", ",").alias("targets"), "degree")


def _finding(name: str, table: str, kind: str) -> None:
    def run(spark, d):
        return finding_table(spark, d).where(F.col("kind") == kind).select("kind", "project", "summary")

    run.__name__, run.__doc__ = name, f"J5, X6: findings of kind {kind}."
    query(f"WITH RECURSIVE {SQL_FINDINGS} SELECT kind, project, summary FROM {table}")(run)


for _n, _t, _k in (("finding_orphan", "orphan", "Orphan"), ("finding_untested", "untested", "Untested"), ("finding_oversized", "oversized", "Oversized"), ("finding_coupled", "coupled", "LibraryCoupledToWeb")):
    _finding(_n, _t, _k)


@query(f"WITH RECURSIVE {SQL_FINDINGS} SELECT kind, project, summary, kind_ord FROM findings")
def findings_all(spark, d):
    """All detectors."""
    return finding_table(spark, d).select("kind", "project", "summary", "kind_ord")


@query(f"WITH RECURSIVE {SQL_FINDINGS} SELECT count(*) AS projects, sum(p.lines)::BIGINT AS lines FROM untested u JOIN projects p ON p.name = u.project")
def untested_lines(spark, d):
    """Lines of projects without tests."""
    f = finding_table(spark, d).where("kind = 'Untested'")
    return f.join(project_table(spark, d).select(F.col("name").alias("project"), "lines"), "project").agg(F.count(F.lit(1)).alias("projects"), F.sum("lines").alias("lines"))


@query(f"WITH {SQL_PROJECTS} SELECT coalesce(kind, 'Total') AS kind, count(*) AS projects, sum(source_files)::BIGINT AS files, sum(lines)::BIGINT AS lines FROM projects GROUP BY ROLLUP (kind)")
def kind_rollup(spark, d):
    """A4: sizes by kind, and in all."""
    return projects.kind_rollup(project_table(spark, d))


@query(f"WITH {SQL_PROJECTS} SELECT min(target_framework) AS framework, count(*) AS projects FROM projects WHERE target_framework IS NOT NULL GROUP BY lower(target_framework)")
def framework_histogram(spark, d):
    """A5: target frameworks."""
    return projects.frameworks(project_table(spark, d))


@query(f"WITH RECURSIVE {SQL_FINDINGS} SELECT kind, count(*) AS findings, min(project) AS example FROM findings GROUP BY kind")
def finding_summary(spark, d):
    """Findings by kind."""
    return projects.finding_summary(finding_table(spark, d)).drop("detail")


@query(f"WITH {SQL_PROJECTS}, {SQL_EDGES} SELECT count(*) AS projects, sum(source_files)::BIGINT AS files, sum(lines)::BIGINT AS lines, (SELECT count(*) FROM edges) AS dependencies FROM projects")
def solution_totals(spark, d):
    """A8."""
    return projects.totals(project_table(spark, d), edge_table(spark, d))


@query(f"WITH {SQL_PROJECTS}, top AS (SELECT lines FROM projects WHERE kind <> 'Test' ORDER BY lines DESC LIMIT 12) SELECT greatest(500, CASE WHEN count(*) >= 12 THEN min(lines) ELSE 500 END)::BIGINT AS threshold FROM top")
def diagram_threshold(spark, d):
    """How large a project must be to be drawn."""
    return projects.diagram_threshold(project_table(spark, d))


@query(f"WITH {SQL_PROJECTS}, {SQL_EDGES}, shown AS (SELECT name FROM projects WHERE lines >= 500 AND kind <> 'Test') SELECT a AS \"from\", b AS \"to\" FROM edges WHERE a IN (FROM shown) AND b IN (FROM shown)")
def diagram_edges(spark, d):
    """Edges that are drawn."""
    return projects.diagram_edges(project_table(spark, d), edge_table(spark, d))


@query(f"WITH {SQL_PROJECTS} SELECT name, lines FROM projects ORDER BY lines DESC, name LIMIT 10")
def biggest_projects(spark, d):
    """O6."""
    return projects.biggest(project_table(spark, d))


SQL_XML = """k AS (SELECT p_partkey AS k, p_size AS z, p_partkey % 17 = 0 AS broken, p_partkey % 2 = 1 AS sdk FROM part),
xml AS (SELECT 'P' || k AS name, k, z, broken, sdk AND NOT broken AS sdk_style, CASE WHEN broken THEN 'Broken' ELSE (CASE k % 6 WHEN 0 THEN 'Test' WHEN 1 THEN 'Wpf' WHEN 2 THEN 'WinForms' WHEN 3 THEN 'Console' ELSE 'Library' END) END AS kind,
  CASE WHEN NOT broken THEN CASE WHEN sdk THEN 'net' || z % 9 ELSE 'v' || z % 9 || '.5' END END AS target_framework FROM k)"""


def parts(spark: SparkSession, d: str) -> DataFrame:
    """part's keys and sizes, dealt before files are made of them: a small table is one scan task's."""
    return read(spark, d, "part").select("p_partkey", "p_size").repartition(partitions(spark), "p_partkey")


def xml_files(spark: SparkSession, d: str) -> DataFrame:
    """part as project files in both dialects, some of them broken, with a source file and, beside old ones, a package list."""
    k, z = F.col("p_partkey"), F.col("p_size")
    s = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    folder = s("src/P", k)
    sdk, test = k % 2 == 1, k % 6 == 0
    head = F.when(sdk, '<Project Sdk="Microsoft.NET.Sdk">').otherwise('<Project xmlns="http://schemas.microsoft.com/developer/msbuild/2003">')
    framework = F.when(sdk, s("<TargetFramework>net", z % 9, "</TargetFramework>")).otherwise(s("<TargetFrameworkVersion>v", z % 9, ".5</TargetFrameworkVersion>"))
    more = F.when(k % 6 == 1, "<UseWPF>true</UseWPF>").when(k % 6 == 2, "<UseWindowsForms>true</UseWindowsForms>").when(k % 6 == 3, "<OutputType>Exe</OutputType>").otherwise("")
    package = F.when(sdk, s('<PackageReference Include="Pack', k % 50, '" Version="', z % 7, '.0" />')).otherwise(s('<Reference Include="Lib', k % 30, ', Version=1.0.0.0" />'))
    refs = s('<ProjectReference Include="..\\P', F.floor(k / 2), "\\P", F.floor(k / 2), '.csproj" />', package, F.when(test, '<Reference Include="xunit.core" />').otherwise(""))
    end = F.when(k % 17 == 0, "</ItemGroup>").otherwise("</ItemGroup></Project>")
    project = F.struct(s(folder, "/P", k, ".csproj").alias("path"), s(head, "<PropertyGroup>", framework, more, "</PropertyGroup><ItemGroup>", refs, end).alias("content"))
    source = F.struct(s(folder, "/A.cs").alias("path"), F.repeat(F.lit("x\n"), z % 5).alias("content"))
    listed = F.struct(s(folder, "/packages.config").alias("path"), s('<packages><package id="Old', k % 40, '" version="', z % 3, '.1" /><package id="Bare" /></packages>').alias("content"))
    return parts(spark, d).select(F.inline(F.when(sdk, F.array(project, source)).otherwise(F.array(project, source, listed))))


@query(f"""WITH {SQL_XML} SELECT name, kind, target_framework, sdk_style, broken, CASE WHEN broken THEN 0 ELSE 1 END::BIGINT AS source_files, CASE WHEN broken THEN 0 ELSE z % 5 END::BIGINT AS lines,
  CASE WHEN broken THEN '' ELSE (CASE WHEN k % 2 = 1 THEN 'Pack' || k % 50 ELSE 'Lib' || k % 30 END) || (CASE WHEN k % 6 = 0 THEN ',xunit.core' ELSE '' END) END AS assemblies FROM xml""")
def project_files(spark, d):
    """Projects read from their files."""
    p = project_source.read(xml_files(spark, d))
    return p.select("name", "kind", "target_framework", "sdk_style", "broken", "source_files", "lines", F.array_join(F.array_sort("assembly_references"), ",").alias("assemblies"))


@query(f"WITH {SQL_XML} SELECT name, coalesce(regexp_matches(target_framework, '^(v3|v4|net3|net4)'), false) AS legacy FROM xml")
def legacy_frameworks(spark, d):
    """Projects on a framework of before."""
    return project_source.read(xml_files(spark, d)).select("name", T.is_legacy_framework(F.col("any_framework")).alias("legacy"))


@query(f"WITH {SQL_XML} SELECT name AS \"from\", 'P' || k // 2 AS \"to\" FROM xml WHERE NOT broken")
def project_references(spark, d):
    """References as project files write them."""
    return project_source.references(project_source.read(xml_files(spark, d)))


@query(f"""WITH {SQL_XML} SELECT name AS project, 'Pack' || k % 50 AS id, z % 7 || '.0' AS version FROM xml WHERE k % 2 = 1 AND NOT broken
UNION ALL SELECT name, 'Old' || k % 40, z % 3 || '.1' FROM xml WHERE k % 2 = 0 UNION ALL SELECT name, 'Bare', 'unknown' FROM xml WHERE k % 2 = 0""")
def package_references(spark, d):
    """Packages from lists beside project files, else from the files."""
    files = xml_files(spark, d)
    return project_source.package_refs(project_source.read(files), files.where(F.endswith("path", F.lit("packages.config"))))


SQL_PLAIN = """k // 3 AS base, 'P' || CASE k % 3 WHEN 0 THEN '.' WHEN 1 THEN '"' ELSE '-' END || k // 3"""


def spelled(name: str):
    """P1, P2 and so on, three to a number with other characters between: names that share an identifier."""
    k = F.substring(name, 2, 20).cast("long")
    return F.concat(F.lit("P"), F.when(k % 3 == 0, ".").when(k % 3 == 1, '"').otherwise("-"), F.floor(k / 3))


@query(f"""WITH {SQL_PROJECTS}, {SQL_EDGES}, top AS (SELECT lines FROM projects WHERE kind <> 'Test' ORDER BY lines DESC LIMIT 12), least AS (SELECT greatest(500, CASE WHEN count(*) >= 12 THEN min(lines) ELSE 500 END) AS n FROM top),
named AS (SELECT k, {SQL_PLAIN} AS name, lines, layer FROM (SELECT p_partkey AS k, lines, p_brand AS layer FROM projects JOIN part USING (p_partkey), least WHERE lines >= n AND kind <> 'Test')),
turns AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY layer, lines DESC, name) AS turn FROM named),
shown AS (SELECT *, 'nP_' || base || CASE WHEN turn > 1 THEN '_' || turn ELSE '' END AS id FROM turns), layers AS (SELECT DISTINCT layer FROM shown),
arrows AS (SELECT f.name AS a, t.name AS b, f.id AS f, t.id AS t FROM edges e JOIN shown f ON e.a = 'P' || f.k JOIN shown t ON e.b = 'P' || t.k),
l AS (SELECT 0 AS s, '' AS a, 0 AS part, 0::BIGINT AS z, '' AS b, 'graph LR' AS line
UNION ALL SELECT 1, layer, 0, 0, '', '    subgraph g' || regexp_replace(layer, '[^0-9A-Za-z]', '_', 'g') || '["' || layer || '"]' FROM layers UNION ALL SELECT 1, layer, 2, 0, '', '    end' FROM layers
UNION ALL SELECT 1, layer, 1, -lines, name, '        ' || id || '["' || replace(name, '"', '&quot;') || '<br/>' || format('{{:,}}', lines) || ' lines"]' FROM shown
UNION ALL SELECT 2, a, 0, 0, b, '    ' || f || ' --> ' || t FROM arrows
UNION ALL SELECT 3, '', 0, 0, '', '    %% ' || ((SELECT count(*) FROM projects) - count(*)) || ' of ' || (SELECT count(*) FROM projects) || ' projects are not drawn' FROM shown)
SELECT row_number() OVER (ORDER BY s, a, part, z, b) AS line_no, line FROM l""")
def solution_diagram(spark, d):
    """The largest projects by layer, as numbered lines; names share identifiers and hold quotes."""
    p = project_table(spark, d).withColumn("path", F.concat_ws("/", F.lit("src"), F.split("path", "/")[0], "name", F.lit("x.csproj")))
    least = projects.diagram_threshold(p).first()[0]
    edges = edge_table(spark, d).select(spelled("from").alias("from"), spelled("to").alias("to"))
    return diagrams.solution(p.withColumn("name", spelled("name")), edges, least)


@query(f"""WITH n AS (SELECT k, {SQL_PLAIN} AS name FROM (SELECT p_partkey AS k FROM part)), t AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY k) AS turn FROM n)
SELECT name, 'nP_' || base || CASE WHEN turn > 1 THEN '_' || turn ELSE '' END AS id FROM t""")
def diagram_identifiers(spark, d):
    """F16: an identifier for every part, three of which would share one."""
    parts = read(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("name"), F.col("p_partkey").alias("at"))
    return diagrams.identifiers(parts.select(spelled("name").alias("name"), "at"), "n")


SQL_NESTED = "f AS (SELECT source || '/' || lang || '/' || doc_id || '.cs' AS path, len(string_split(text, chr(10)))::BIGINT AS lines, source, lang FROM documents)"


@query(f"WITH {SQL_NESTED} SELECT source AS folder, count(*) AS source_files, sum(lines)::BIGINT AS lines FROM f GROUP BY source UNION ALL SELECT source || '/' || lang, count(*), sum(lines)::BIGINT FROM f GROUP BY ALL")
def project_measure(spark, d):
    """Files and lines under each project folder, nested ones in both."""
    f = file_table(spark, d).select(F.concat("path", F.lit(".cs")).alias("path"), T.line_count(F.col("content")).alias("lines"))
    docs = read(spark, d, "documents")
    folders = docs.select(F.col("source").alias("folder")).unionByName(docs.select(F.concat_ws("/", "source", "lang").alias("folder"))).distinct()
    return projects.source_measure(f, folders)


# ---- types and packages ---------------------------------------------------------------------------------------

SQL_TYPES = """types AS (SELECT 'T' || c_custkey AS name, CASE c_custkey % 5 WHEN 0 THEN 'Interface' WHEN 1 THEN 'Record' ELSE 'Class' END AS shape, c_custkey AS k FROM customer),
b AS (SELECT name AS a, shape, 0 AS at, 'T' || k // 2 AS b FROM types UNION ALL SELECT name, shape, 1, 'I' || chr((65 + k % 11)::INT) FROM types),
rel AS (SELECT DISTINCT b.a, b.b, CASE WHEN b.shape <> 'Interface' AND (CASE WHEN t.name IS NOT NULL THEN t.shape = 'Interface' ELSE b.at > 0 OR regexp_matches(b.b, '^I[A-Z]') END) THEN 'Implements' ELSE 'Inherits' END AS kind, t.name IS NOT NULL AS declared FROM b LEFT JOIN types t ON t.name = b.b)"""


def type_table(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    shape = F.when(k % 5 == 0, "Interface").when(k % 5 == 1, "Record").otherwise("Class")
    first = F.concat(F.lit("My.Space.T"), F.floor(k / 2), F.lit("<int>"))
    second = F.concat(F.lit("I"), F.char(65 + k % 11))
    return read(spark, d, "customer").select(F.concat(F.lit("T"), k).alias("name"), shape.alias("shape"), F.col("c_name").alias("path"), k.alias("pos"), F.array(first, second).alias("base_types"))


@query(f"WITH {SQL_TYPES} SELECT a AS \"from\", b AS \"to\", kind, declared FROM rel")
def type_relations(spark, d):
    """Who inherits and implements what."""
    return typegraph.relations(type_table(spark, d))


@query(f"WITH {SQL_TYPES} SELECT DISTINCT b AS name FROM rel WHERE NOT declared")
def unresolved_bases(spark, d):
    """Bases that no file declares."""
    return typegraph.unresolved(type_table(spark, d))


@query(f"WITH {SQL_TYPES}, near AS (SELECT a AS n FROM rel WHERE a = 'T7' OR b = 'T7' UNION SELECT b FROM rel WHERE a = 'T7' OR b = 'T7' UNION SELECT 'T7') SELECT name, shape FROM types WHERE name IN (FROM near)")
def type_neighbours(spark, d):
    """The types around one."""
    t = type_table(spark, d)
    return typegraph.around(t, typegraph.relations(t), "T7").select("name", "shape")


@query(f"""WITH {SQL_TYPES}, near AS (SELECT a AS n FROM rel WHERE a = 'T7' OR b = 'T7' UNION SELECT b FROM rel WHERE a = 'T7' OR b = 'T7' UNION SELECT 'T7'),
mine AS (SELECT * FROM rel WHERE a IN (FROM near)) SELECT a AS "from", b AS "to", b IN (FROM near) AS inside FROM mine""")
def type_selection(spark, d):
    """Relations among chosen types, and those that lead out."""
    t = type_table(spark, d)
    rels = typegraph.relations(t)
    inside, out = typegraph.split_by_selection(rels, typegraph.around(t, rels, "T7").unionByName(rels.where("`from` = 'T7' or `to` = 'T7'").select(F.col("to").alias("name")), allowMissingColumns=True))
    return inside.withColumn("inside", F.lit(True)).unionByName(out.withColumn("inside", F.lit(False))).select("from", "to", "inside")


def csharp_files(spark: SparkSession, d: str) -> DataFrame:
    """part as C# sources: a type with up to four methods of up to two branches, some of them tests or generated."""
    k, z = F.col("p_partkey"), F.col("p_size")
    s = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    method = lambda i: s("  public int M", i, "(int x) {\n", F.repeat(F.lit("    if (x > 1) { x--; } // if\n"), ((k + i) % 3).cast("int")), "    return x;\n  }\n")
    body = F.array_join(F.transform(F.sequence(F.lit(0), (z % 4).cast("int")), method), "")
    kind = F.when(k % 5 == 0, "public record").when(k % 5 == 1, "abstract class").otherwise("class")
    head = s("namespace N", k % 9, ";\n\n", F.when(k % 7 == 0, "[TestFixture]\n").otherwise(""), kind, " T", k, " : B", k % 11, "<int>, IThing\n{\n")
    return parts(spark, d).select(k.alias("k"), s("src/T", k, F.when(k % 13 == 0, ".g.cs").otherwise(".cs")).alias("path"), s(head, body, "}\n").alias("content"))


SQL_CSHARP = """cs AS (SELECT p_partkey AS k, p_size % 4 + 1 AS m, list_transform(range(p_size % 4 + 1), lambda i: 1 + (p_partkey + i) % 3) AS c, p_partkey % 7 = 0 AS test FROM part)"""


@query(f"""WITH {SQL_CSHARP} SELECT 'src/T' || k || CASE WHEN k % 13 = 0 THEN '.g.cs' ELSE '.cs' END AS path, 1 AS types, m::INT AS methods, list_sum(c)::INT AS complexity, list_max(c)::INT AS worst_method_complexity, 'M' || (list_position(c, list_max(c)) - 1) AS worst_method,
  CASE WHEN list_max(c) > 1 THEN 1 ELSE 0 END AS max_nesting, (6 + test::INT + 2 * m + list_sum(c))::INT AS lines, (4 + test::INT + 2 * m + list_sum(c))::INT AS code_lines, k % 13 = 0 AS is_generated, test AS is_test FROM cs""")
def csharp_metrics(spark, d):
    """Metrics of C# sources."""
    return csharp.metrics(csharp_files(spark, d)).select("path", "types", "methods", "complexity", "worst_method_complexity", "worst_method", "max_nesting", "lines", "code_lines", "is_generated", "is_test")


@query(f"""WITH {SQL_CSHARP} SELECT 'T' || k AS name, 'N' || k % 9 AS namespace, CASE WHEN k % 5 = 0 THEN 'Record' ELSE 'Class' END AS shape, k % 5 = 1 AS is_abstract, 'B' || k % 11 || '<int>,IThing' AS bases,
  array_to_string(list_transform(range(m), lambda i: 'M' || i || '()'), ',') AS members, (list_sum(c) - m)::INT AS complexity FROM cs""")
def csharp_types(spark, d):
    """Types that C# sources declare."""
    return csharp.types(csharp_files(spark, d)).select("name", "namespace", "shape", "is_abstract", F.array_join("base_types", ",").alias("bases"), F.array_join("members", ",").alias("members"), "complexity")


@query(f"""WITH {SQL_CSHARP}, t AS (SELECT *, 'T' || k AS name FROM cs WHERE k % 9 = 4),
l AS (SELECT 0 AS s, '' AS a, 0 AS part, 0::BIGINT AS c, 'classDiagram' AS line UNION ALL SELECT 1, name, 0, 0, '    class T' || k || ' {{' FROM t UNION ALL SELECT 1, name, 4, 0, '    }}' FROM t
UNION ALL SELECT 1, name, 1, 0, '        <<' || CASE WHEN k % 5 = 0 THEN 'record' ELSE 'abstract' END || '>>' FROM t WHERE k % 5 < 2
UNION ALL SELECT 1, name, 2, i, '        +M' || i || '()' FROM (SELECT name, unnest(range(least(m, 2))) AS i FROM t) UNION ALL SELECT 1, name, 3, 0, '        +' || (m - 2) || ' more' FROM t WHERE m > 2
UNION ALL SELECT 2, '', 0, 0, '    %% ' || 2 * count(*) || ' relations lead out of this selection' FROM t)
SELECT row_number() OVER (ORDER BY s, a, part, c) AS line_no, line FROM l""")
def class_diagram(spark, d):
    """The types of a namespace, as numbered lines."""
    t = kept(csharp.types(csharp_files(spark, d)), "types")
    return diagrams.class_diagram(t, typegraph.relations(t), namespace="N4", max_members=2)


SQL_REFS = "refs AS (SELECT 'Proj' || l_orderkey % 97 AS project, (CASE WHEN l_suppkey % 2 = 0 THEN 'Pack' ELSE 'pack' END) || l_partkey % 500 AS id, (l_suppkey % 7) || '.0' AS version FROM lineitem)"
SQL_PORT = "CASE WHEN lower(id) IN ('pack1', 'pack2', 'pack3') THEN 'TiedToSystemWeb' WHEN lower(id) IN ('pack10', 'pack11', 'pack12', 'pack13') THEN 'Portable' ELSE 'Unknown' END"
SQL_PACKAGES = f"{SQL_REFS}, packages AS (SELECT min(id) AS id, string_agg(DISTINCT version, ',' ORDER BY version) AS versions, count(*) AS projects, count(DISTINCT version) > 1 AS divergent FROM refs GROUP BY lower(id)), classed AS (SELECT *, {SQL_PORT} AS portability FROM packages)"
SQL_MODERN = f"{SQL_PACKAGES}, modern AS (SELECT project, hash_id % 3 = 0 AS sdk_style, dead FROM (SELECT project, substr(project, 5)::INT AS hash_id, count(DISTINCT CASE WHEN {SQL_PORT} = 'TiedToSystemWeb' THEN id END) AS dead FROM refs GROUP BY project))"
LISTS = {"tied": ("Pack1", "Pack2", "Pack3"), "portable": ("PACK10", "Pack11", "Pack12", "Pack13")}


def ref_table(spark: SparkSession, d: str) -> DataFrame:
    l = read(spark, d, "lineitem")
    name = F.when(F.col("l_suppkey") % 2 == 0, "Pack").otherwise("pack")
    return l.select(F.concat(F.lit("Proj"), F.col("l_orderkey") % 97).alias("project"), F.concat(name, F.col("l_partkey") % 500).alias("id"), F.concat(F.col("l_suppkey") % 7, F.lit(".0")).alias("version"))


def modern_table(spark: SparkSession, d: str) -> DataFrame:
    refs = ref_table(spark, d)
    p = refs.select("project").distinct().withColumn("sdk_style", F.substring("project", 5, 9).cast("int") % 3 == 0)
    return packages.project_modernisation(p, refs, **LISTS)


@query(f"WITH {SQL_PACKAGES} SELECT id, versions, projects, divergent FROM packages")
def package_catalogue(spark, d):
    """A2: packages, versions and uses."""
    return packages.catalogue(ref_table(spark, d), **LISTS).select("id", F.array_join("versions", ",").alias("versions"), "projects", "divergent")


@query(f"WITH {SQL_PACKAGES} SELECT portability, count(*) AS packages, sum(projects)::BIGINT AS uses FROM classed GROUP BY portability")
def package_portability(spark, d):
    """What can move."""
    return packages.catalogue(ref_table(spark, d), **LISTS).groupBy("portability").agg(F.count(F.lit(1)).alias("packages"), F.sum("projects").alias("uses"))


@query(f"WITH {SQL_PACKAGES} SELECT id, projects FROM classed WHERE portability = 'Unknown' ORDER BY projects DESC, id LIMIT 15")
def unknown_packages(spark, d):
    """O5."""
    return packages.unknown(packages.catalogue(ref_table(spark, d), **LISTS)).select("id", "projects")


@query(f"WITH {SQL_PACKAGES} SELECT id, projects FROM classed WHERE portability = 'TiedToSystemWeb' ORDER BY projects DESC, id LIMIT 10")
def dead_end_packages(spark, d):
    """Packages that no version of modern .NET runs."""
    return packages.dead_ends(packages.catalogue(ref_table(spark, d), **LISTS)).select("id", "projects")


@query(f"WITH {SQL_MODERN} SELECT project, sdk_style, dead > 0 AS blocked, NOT sdk_style AND dead = 0 AS convertible_as_is FROM modern")
def project_modernisation(spark, d):
    """P9, P10."""
    return modern_table(spark, d).select("project", "sdk_style", "blocked", "convertible_as_is")


def survey_table(spark: SparkSession, d: str) -> DataFrame:
    return packages.survey(modern_table(spark, d), packages.catalogue(ref_table(spark, d), **LISTS))


@query(f"""WITH {SQL_MODERN} SELECT m.*, k.*, 0::BIGINT AS redirects, k.divergent = 0 AS tended FROM
(SELECT count(*) AS projects, count_if(sdk_style)::BIGINT AS sdk_style, count_if(NOT sdk_style)::BIGINT AS pre_sdk, count_if(dead > 0)::BIGINT AS blocked, count_if(NOT sdk_style AND dead = 0)::BIGINT AS convertible_as_is FROM modern) m,
(SELECT count(*) AS packages, sum(projects)::BIGINT AS package_references, count_if(divergent)::BIGINT AS divergent, count_if(portability = 'TiedToSystemWeb')::BIGINT AS tied, count_if(portability = 'Portable')::BIGINT AS portable, count_if(portability = 'Unknown')::BIGINT AS unknown FROM classed) k""")
def modernisation_survey(spark, d):
    """A3, P10: the survey's counters."""
    return survey_table(spark, d)


@query("SELECT sum((length(lower(html)) - length(replace(lower(html), '<a ', ''))) // 3)::BIGINT AS redirects FROM pages")
def redirect_count(spark, d):
    """Occurrences of a text in configuration files."""
    return packages.redirects(read(spark, d, "pages"), "<A ", "html")


@query(f"""WITH RECURSIVE {SQL_FINDINGS}, {SQL_MODERN}, steps AS (
SELECT 1 AS position, 'Blocking' AS kind, count(*) AS n, 'project file' AS one, 'project files' AS many FROM unreadable
UNION ALL SELECT 2, 'Blocking', count(*), 'cycle', 'cycles' FROM cyc
UNION ALL SELECT 3, 'Prerequisite', count(*), 'package', 'packages' FROM classed WHERE portability = 'Unknown'
UNION ALL SELECT 4, 'Mechanical', count(*), 'project', 'projects' FROM modern WHERE NOT sdk_style AND dead = 0
UNION ALL SELECT 5, 'Mechanical', count(*), 'package', 'packages' FROM classed WHERE divergent
UNION ALL SELECT 6, 'Decision', count(*), 'package', 'packages' FROM classed WHERE portability = 'TiedToSystemWeb'
UNION ALL SELECT 7, 'Decision', count(*), 'library', 'libraries' FROM coupled
UNION ALL SELECT 9, 'PossiblyFree', count(*), 'project', 'projects' FROM orphan)
SELECT position, kind, format('{{:,}}', n) || ' ' || CASE WHEN n = 1 THEN one ELSE many END AS size FROM steps WHERE n > 0
UNION ALL SELECT 8, 'Continuous', (SELECT count(*) FROM (WITH {SQL_METRICS.replace(chr(10), ' ')} SELECT 1 FROM risks WHERE NOT tested AND score > 0 LIMIT 20)) || ' files'""")
def repair_steps(spark, d):
    """What to do, in order."""
    cat = packages.catalogue(ref_table(spark, d), **LISTS)
    return assessment.repair_steps(finding_table(spark, d), cat, modern_table(spark, d), survey_table(spark, d), risk_table(spark, d)).select("position", "kind", "size")


@query(f"""WITH RECURSIVE {SQL_FINDINGS}, {SQL_PACKAGES} SELECT 1 AS position, 'Only project files, source text and history were read.' AS detail UNION ALL SELECT 2, 'A file counts as tested if a test file is named after it.'
UNION ALL SELECT 3, 'The history could not be read. Files are ranked on structure alone.' UNION ALL SELECT 4, count_if(portability = 'Unknown') || ' of ' || count(*) || ' packages are in neither list.' FROM classed HAVING count_if(portability = 'Unknown') > 0
UNION ALL SELECT 5, count(*) || ' generated files are not ranked.' FROM part WHERE p_partkey % 11 = 0 HAVING count(*) > 0
UNION ALL SELECT 6, count(*) || ' project files are not valid XML.' FROM unreadable HAVING count(*) > 0""")
def limitations(spark, d):
    """What the assessment can't see."""
    generated = read(spark, d, "part").agg(F.count_if(F.col("p_partkey") % 11 == 0).alias("n"))
    return assessment.limitations(finding_table(spark, d), survey_table(spark, d), generated, project_table(spark, d), False).select("position", "detail")


@query(f"""WITH {SQL_XML}, refs AS (SELECT name, kind, 'P' || k // 2 AS other FROM xml WHERE NOT broken), size AS (SELECT name, kind, k, broken, CASE WHEN broken THEN 0 ELSE z % 5 END AS lines FROM xml)
SELECT 'Unreadable' AS kind, name AS project, 'The project file is not valid XML' AS summary FROM size WHERE broken
UNION ALL SELECT 'Untested', name, 'No test project refers to it (' || lines || ' lines)' FROM size WHERE kind NOT IN ('Test', 'Broken') AND lines > 0 AND name NOT IN (SELECT other FROM refs WHERE kind = 'Test')
UNION ALL SELECT 'Oversized', name, lines || ' lines in one project' FROM size WHERE lines > 3 UNION ALL SELECT 'Orphan', name, 'Nothing in the solution refers to it' FROM size WHERE kind = 'Library' AND lines > 0 AND name NOT IN (SELECT other FROM refs)""")
def assess_findings(spark, d):
    """The findings of an assessment of a tree of project files, sources and package lists."""
    done = assess.assess_files(xml_files(spark, d), "", ("NotARepository", "There is no history.", commits(spark, d)), oversized=3)
    return done.findings.select("kind", "project", "summary")


@query(f"""WITH {SQL_CSHARP} SELECT 'src/T' || k || CASE WHEN k % 13 = 0 THEN '.g.cs' ELSE '.cs' END AS path, list_sum(c)::INT AS complexity, CASE WHEN list_max(c) > 1 THEN 1 ELSE 0 END AS max_nesting, false AS tested
FROM cs WHERE NOT test AND k % 13 <> 0 AND 4 + 2 * m + list_sum(c) >= 10""")
def assess_risk(spark, d):
    """The files that an assessment of C# sources ranks."""
    done = assess.assess_files(csharp_files(spark, d).select("path", "content"), "", ("NotARepository", "There is no history.", commits(spark, d)), min_code_lines=10)
    return done.risk.select("path", "complexity", "max_nesting", "tested")


# ---- characterization -----------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT p_partkey AS m, p_size % 4 AS a, p_size % 3 + 1 AS b FROM part), c AS (SELECT *, unnest(range(CASE WHEN a = 0 THEN 1 ELSE least(4, greatest(a, b)) END)) AS row FROM m)
SELECT m, row::INT AS row, CASE WHEN a = 0 THEN '' ELSE (row % a) || ',' || (row % b) END AS args FROM c""")
def in_step_cases(spark, d):
    """argument rows that take each list of values in step; without values, one empty row."""
    m = read(spark, d, "part").select(F.col("p_partkey").alias("m"), (F.col("p_size") % 4).alias("a"), (F.col("p_size") % 3 + 1).alias("b"))
    return characterize.in_step(m, [F.col("a"), F.col("b")]).select("m", "row", F.array_join("picks", ",").alias("args"))


SQL_REASON = "CASE WHEN p_partkey % 3 = 0 THEN 'Generic' WHEN p_size % 4 = 0 THEN 'ReturnsNothing' WHEN p_partkey % 5 = 0 THEN 'UnsupportedParameter' WHEN p_size > 40 THEN 'CannotConstruct' END"


@query(f"SELECT reason, count(*) AS methods FROM (SELECT {SQL_REASON} AS reason FROM part) WHERE reason IS NOT NULL GROUP BY reason")
def refusal_histogram(spark, d):
    """Why methods can't be called, first reason only."""
    k, s = F.col("p_partkey"), F.col("p_size")
    reasons = [("Generic", k % 3 == 0), ("ReturnsNothing", s % 4 == 0), ("UnsupportedParameter", k % 5 == 0), ("CannotConstruct", s > 40)]
    return characterize.refusals(read(spark, d, "part"), reasons)


@query("SELECT l_orderkey AS case_id, count(DISTINCT l_returnflag || '|' || l_linestatus) = 1 AS deterministic, count(*) AS calls FROM lineitem GROUP BY l_orderkey")
def determinism_check(spark, d):
    """a case is kept if all its calls left one fingerprint."""
    return characterize.repeatable(read(spark, d, "lineitem"), F.col("l_orderkey"), F.concat_ws("|", "l_returnflag", "l_linestatus"))


@query("SELECT p_name || CASE WHEN row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) > 1 THEN '_' || (row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1) ELSE '' END AS test_name FROM part")
def unique_names(spark, d):
    """Names that repeat are numbered."""
    return characterize.numbered(read(spark, d, "part"), "p_name", "p_partkey").select("test_name")
