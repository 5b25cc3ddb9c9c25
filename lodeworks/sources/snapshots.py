"""An index that changes by commits: chunks, their text index and the ledger, which always change together.

A commit writes what is new as a segment of its own, sorted by path, and for the rows that it takes away the bits of
their positions in older segments: deletion vectors, 64 rows a number. Readers merge: they read all segments of the
version in force and leave out the rows whose bit is set. So a commit writes what the changed files hold and nothing of
the others. Segments of one size class are written together once there are ``fan`` of them, and so is one that has lost
half of its rows; a row is thus written again as often as its size class grows, the logarithm of the index.

A pointer file names the segments and vectors in force and is moved last: readers always see one version, and a crash
leaves the old one in force.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.functions.text import index_terms
from lodeworks.operators.retrieval import placed, postings, stored_stats
from lodeworks.shipping import shuffles_freed

CHUNKS = T.StructType([T.StructField("id", T.StringType()), T.StructField("file_path", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
LEDGER = T.StructType([T.StructField("path", T.StringType()), T.StructField("content_hash", T.StringType()), T.StructField("chunk_count", T.IntegerType()), T.StructField("indexed_at", T.TimestampType())])
POSTINGS = T.StructType([T.StructField("id", T.StringType()), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("doc_len", T.IntegerType())])
SCHEMAS, PATHS = {"chunks": CHUNKS, "ledger": LEDGER, "postings": POSTINGS}, {"chunks": "file_path", "ledger": "path"}
#: Segments of a size class that are merged into one; commits that the pointer file remembers; bytes of vectors that are broadcast.
FAN, LOG, VECTOR_BYTES = 4, 64, 48 << 20
#: Bits of a row's number within its file (monotonically_increasing_id); terms whose postings are shuffled at once.
FILE_BITS, SLICE_TERMS = 33, 1 << 27
ROW_GROUPS = {"parquet.block.size": 8 << 20}
DELETES = "vector string, segment string, word long, bits long, rows long, terms long, texts long"


def slices(terms: list[tuple[int, int]], most: int = 0) -> list[tuple[int, int]]:
    """(first, last) of runs of files, given as (file, terms) in order, with ``most`` (SLICE_TERMS) terms each, or one file."""
    out: list[tuple[int, int]] = []
    size = 0
    for file, n in terms:
        if out and size + n <= (most or SLICE_TERMS):
            out[-1], size = (out[-1][0], file), size + n
        else:
            out.append((file, file))
            size = n
    return out


class TextIndex:
    """Postings and corpus statistics of chunks, as Parquet tables in one or more folders.

    Postings are dealt by terms' hashes and sorted, so a question's filter on its terms leaves few row groups to be read.
    """

    def __init__(self, spark: SparkSession, *folders: str):
        self.spark, self.folders = spark, folders

    @staticmethod
    def stamp(spark: SparkSession, path: str) -> tuple:
        """Names, sizes and times of the files of a table: another stamp, another table."""
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
        return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))

    def write(self, chunks: DataFrame) -> TextIndex:
        """Index chunks (id, content) in the one folder."""
        (folder,) = self.folders
        rows = placed(postings(chunks), f"{folder}/postings", ["term", "id"], [], "overwrite", **ROW_GROUPS)
        stored_stats(chunks, rows).write.mode("overwrite").parquet(f"{folder}/stats")
        return self

    def postings(self) -> DataFrame:
        """(id, term, tf, doc_len)."""
        return self.spark.read.parquet(*[f"{f}/postings" for f in self.folders])

    def stats(self) -> DataFrame:
        """One row: n, avgdl."""
        s = self.spark.read.parquet(*[f"{f}/stats" for f in self.folders])
        return s.agg(F.sum("n").alias("n"), (F.sum("terms") / F.nullif(F.sum("texts"), F.lit(0))).alias("avgdl"))


class Index:
    """The index under a folder that Spark can write: chunks, text index and ledger, always of one version."""

    def __init__(self, spark: SparkSession, folder: str, fan: int = FAN):
        self.spark, self.folder, self.fan = spark, folder.rstrip("/"), fan
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _current(self) -> dict:
        """version; by segment the rows it was written with and those that are gone; vectors; the last commits."""
        if not self.fs.exists(self._path(f"{self.folder}/CURRENT")):
            return {"version": 0, "segments": {}, "deletes": [], "commits": []}
        return json.loads(self.spark.read.text(f"{self.folder}/CURRENT").first()[0])

    def version(self) -> int:
        """The commit in force; 0 for none."""
        return self._current()["version"]

    def commits(self) -> list[dict]:
        """The last commits, oldest first: version, chunks and ledger rows written, chunks gone, live chunks and segments
        after it, bytes written, and bytes written again by merging."""
        return self._current()["commits"]

    def _bytes(self, *folders: str) -> int:
        found = [self._path(f"{self.folder}/{f}") for f in folders]
        return sum(self.fs.getContentSummary(p).getLength() for p in found if self.fs.exists(p))

    def _live(self, name: str, current: dict, only: list[str] | None = None) -> DataFrame:
        """Rows of a table with doc, their position, and segment; without those whose bit in the vectors is set."""
        vector = "ledger" if name == "ledger" else "chunks"
        mine = [s for s, n in current["segments"].items() if n[vector] > n[f"dead_{vector}"] and (only is None or s in only)]
        at = [f"{self.folder}/{name}/segment={s}" for s in mine]
        more = [T.StructField("doc", T.LongType()), T.StructField("segment", T.StringType())]
        schema = T.StructType([*SCHEMAS[name].fields, *([T.StructField("terms", T.IntegerType())] if name == "chunks" else []), *more])
        if not at:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*at)
        held = [d for d in current["deletes"] if set(d["segments"]) & set(mine)]
        if not held:
            return rows
        bits = self.spark.read.schema(DELETES).parquet(*[f"{self.folder}/deletes/{d['folder']}" for d in held]).where((F.col("vector") == vector) & F.col("segment").isin(mine))
        bits = bits.groupBy(F.col("segment").alias("of"), "word").agg(F.bit_or("bits").alias("bits"))
        bits = F.broadcast(bits) if sum(d["words"] for d in held) * 64 <= VECTOR_BYTES else bits
        seen = rows.join(bits, (F.col("segment") == F.col("of")) & (F.shiftright("doc", 6) == F.col("word")), "left")
        return seen.where(F.col("bits").isNull() | (F.expr("shiftright(bits, cast(doc & 63 as int)) & 1") == 0)).select(rows.columns)

    def table(self, name: str) -> DataFrame:
        return self._live(name, self._current()).select(SCHEMAS[name].names)

    def _write(self, segment: str, chunks: DataFrame, ledger: DataFrame) -> dict:
        """Write a segment; what it holds. Postings are many times their texts on the way through a shuffle, so they are
        made and placed a slice of the files after another, and a slice's shuffle goes with it."""
        at = {t: f"{self.folder}/{t}/segment={segment}" for t in SCHEMAS}
        terms = F.when(F.col("content").isNotNull(), F.size(index_terms(F.col("content")))).cast("int")
        # terms are counted behind the exchange, as the sample of its ranges makes all that lies before it once more
        for table, rows, more, order in (("chunks", chunks.select(CHUNKS.names), [terms.alias("terms")], ["file_path", "start_line", "id"]), ("ledger", ledger.select(LEDGER.names), [], ["path"])):
            rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", *more, F.monotonically_increasing_id().alias("doc")).write.parquet(at[table])
        new = self.spark.read.schema(T.StructType([*CHUNKS.fields, T.StructField("terms", T.IntegerType()), T.StructField("doc", T.LongType())])).parquet(at["chunks"])
        by_file = new.groupBy(F.shiftright("doc", FILE_BITS).alias("file")).agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms"), F.count("terms").alias("texts"))
        held = by_file.orderBy("file").collect()  # a row a file
        entries = self.spark.read.schema(LEDGER).parquet(at["ledger"]).count()
        for first, last in slices([(r.file, r.terms) for r in held]):
            some = new.where((F.col("doc") >= first << FILE_BITS) & (F.col("doc") < (last + 1) << FILE_BITS))
            rows = postings(some.select("id", "content", "doc"), keep=["doc"]).select(*POSTINGS.names, "doc")
            placed(rows, at["postings"], ["term", "id"], [], "append", **ROW_GROUPS)
        n = {c: sum(r[c] for r in held) for c in ("chunks", "terms", "texts")}
        return {"chunks": n["chunks"], "ledger": entries, "terms": n["terms"], "texts": n["texts"], "dead_chunks": 0, "dead_ledger": 0, "dead_terms": 0, "dead_texts": 0}

    def _delete(self, name: str, current: dict, gone: DataFrame) -> dict | None:
        """Write the vectors of the rows of some paths (path) and count them with their segments; None for none.

        A path's chunks are in the segment of its ledger entry, so other segments' chunks aren't looked at.
        """
        paths = gone.select(F.col("path").alias("_gone")).distinct()
        entries = self._live("ledger", current).join(paths, F.col("path") == F.col("_gone"), "left_semi").select("segment", "doc").persist()
        inside = [r.segment for r in entries.select("segment").distinct().collect()]  # segments are few
        if not inside:
            entries.unpersist()
            return None
        zero = F.lit(0).cast("long")
        rows = self._live("chunks", current, inside).join(paths, F.col("file_path") == F.col("_gone"), "left_semi")
        dead = rows.select(F.lit("chunks").alias("vector"), "segment", "doc", F.coalesce(F.col("terms").cast("long"), zero).alias("terms"), F.col("terms").isNotNull().cast("long").alias("texts"))
        dead = dead.unionByName(entries.select(F.lit("ledger").alias("vector"), "segment", "doc", zero.alias("terms"), zero.alias("texts")))
        bit = F.expr("shiftleft(1L, cast(doc & 63 as int))")
        words = dead.groupBy("vector", "segment", F.shiftright("doc", 6).alias("word")).agg(F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("rows"), F.sum("terms").alias("terms"), F.sum("texts").alias("texts"))
        words.write.parquet(f"{self.folder}/deletes/{name}")
        entries.unpersist()
        made = self.spark.read.schema(DELETES).parquet(f"{self.folder}/deletes/{name}")
        sums = made.groupBy("vector", "segment").agg(F.count(F.lit(1)).alias("words"), *[F.sum(c).alias(c) for c in ("rows", "terms", "texts")]).collect()  # two rows a segment
        for r in sums:
            n = current["segments"][r.segment]
            n[f"dead_{r.vector}"] += r["rows"]
            n["dead_terms"] += r.terms
            n["dead_texts"] += r.texts
        return {"folder": name, "words": sum(r.words for r in sums), "segments": sorted({r.segment for r in sums})}

    def _worn(self, current: dict) -> list[str]:
        """The segments to be written together: those of a size class with ``fan`` of them, and those half gone."""
        live = {s: n["chunks"] + n["ledger"] - n["dead_chunks"] - n["dead_ledger"] for s, n in current["segments"].items()}
        classes: dict[int, list[str]] = {}
        for s, rows in live.items():
            size = 0
            while self.fan ** (size + 1) <= rows:
                size += 1
            classes.setdefault(size, []).append(s)
        out = {s for group in classes.values() if len(group) >= self.fan for s in group}
        return sorted(out | {s for s, n in current["segments"].items() if 2 * live[s] <= n["chunks"] + n["ledger"]})

    def replace(self, gone: DataFrame, chunks: DataFrame, ledger: DataFrame) -> int:
        """Put the next version in force: rows of the paths gone (path) go, those of chunks and ledger come.

        What is written is the new rows, their postings and the bits of those that go. A writer that finds another
        version in force than the one it began from gives up with an error, as it would undo the other's work.
        """
        with shuffles_freed(self.spark):
            return self._replace(gone, chunks, ledger)

    def _replace(self, gone: DataFrame, chunks: DataFrame, ledger: DataFrame) -> int:
        current = self._current()
        before, new = current["version"], current["version"] + 1
        name = f"{new}-{uuid.uuid4().hex[:12]}"
        kept = set(current["segments"])
        went = self._delete(name, current, gone)
        if went:
            current["deletes"].append(went)
        dead = sum(n["dead_chunks"] for n in current["segments"].values())
        added = self._write(name, chunks, ledger)
        current["segments"][name] = added
        wrote = self._bytes(*[f"{t}/segment={name}" for t in SCHEMAS], f"deletes/{name}")
        self._drop_empty(current)
        again = 0
        if worn := self._worn(current):
            merged = f"{new}-{uuid.uuid4().hex[:12]}"
            held = self._write(merged, *(self._live(t, current, worn) for t in ("chunks", "ledger")))
            current["segments"] = {s: n for s, n in current["segments"].items() if s not in worn} | {merged: held}
            self._drop_empty(current)
            again = self._bytes(*[f"{t}/segment={merged}" for t in SCHEMAS])
        old = current["commits"]
        live = sum(n["chunks"] - n["dead_chunks"] for n in current["segments"].values())
        log = {"version": new, "chunks": added["chunks"], "ledger": added["ledger"], "gone": dead - (old[-1]["dead"] if old else 0), "live": live, "segments": len(current["segments"]), "bytes": wrote, "merged_bytes": again}
        log["dead"] = sum(n["dead_chunks"] for n in current["segments"].values())
        current |= {"version": new, "commits": [*old, log][-LOG:]}
        draft, pointer = self._path(f"{self.folder}/draft-{name}"), self._path(f"{self.folder}/CURRENT")
        out = self.fs.create(draft, True)
        out.writeBytes(json.dumps(current) + "\n")
        out.close()
        if self._current()["version"] != before:
            for f in (*[f"{t}/segment={s}" for t in SCHEMAS for s in set(current["segments"]) - kept], f"deletes/{name}", f"draft-{name}"):
                self.fs.delete(self._path(f"{self.folder}/{f}"), True)
            raise RuntimeError(f"another writer has put a version after {before} in force")
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        over = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        over[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(pointer.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, pointer, over)
        self._tidy(new, {f"segment={s}" for s in {*kept, *current["segments"]}} | {d["folder"] for d in current["deletes"]})
        return new

    @staticmethod
    def _drop_empty(current: dict) -> None:
        """Forget segments of which nothing is left, and vectors of none that is there."""
        segments = {s: n for s, n in current["segments"].items() if n["chunks"] > n["dead_chunks"] or n["ledger"] > n["dead_ledger"]}
        current["segments"] = segments
        current["deletes"] = [d for d in current["deletes"] if set(d["segments"]) & set(segments)]

    def _tidy(self, version: int, used: set[str]) -> None:
        """Delete what neither this version nor the one before, which may still be read, holds."""
        for top in (*SCHEMAS, "deletes"):
            at = self._path(f"{self.folder}/{top}")
            for status in self.fs.listStatus(at) if self.fs.exists(at) else []:
                found = status.getPath().getName()
                if found not in used and int(found.removeprefix("segment=").split("-")[0]) < version - (top == "deletes"):
                    self.fs.delete(status.getPath(), True)

    def text(self) -> TextIndex | None:
        """The text index of the version in force; None for none."""
        current = self._current()
        return _Merged(self, current) if any(n["chunks"] > n["dead_chunks"] for n in current["segments"].values()) else None

    def clear(self) -> None:
        self.fs.delete(self._path(self.folder), True)


class _Merged(TextIndex):
    """The text index of all segments of a version."""

    def __init__(self, index: Index, current: dict):
        super().__init__(index.spark)
        self.index, self.current = index, current

    def postings(self) -> DataFrame:
        return self.index._live("postings", self.current).select(POSTINGS.names)

    def stats(self) -> DataFrame:
        live = {c: sum(n[c] - n[f"dead_{c}"] for n in self.current["segments"].values()) for c in ("chunks", "terms", "texts")}
        return self.spark.range(1).select(F.lit(live["chunks"]).cast("long").alias("n"), (F.lit(live["terms"]).cast("double") / F.nullif(F.lit(live["texts"]), F.lit(0))).alias("avgdl"))
