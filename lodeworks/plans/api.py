"""One function for each request a client of the engine makes, with plain dictionaries for answers."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.embedding import Embedder
from lodeworks.operators import csharp, packages, retrieval, typegraph
from lodeworks.operators import projects as P
from lodeworks.plans import answer as A
from lodeworks.plans import ingest as I
from lodeworks.plans import mermaid
from lodeworks.plans.assess import assess
from lodeworks.plans.report import render
from lodeworks.sources.files import with_suffix
from lodeworks.sources.snapshots import Index


def _timed(began: float, **found) -> dict:
    return found | {"elapsed_ms": int((time.time() - began) * 1000)}


def _rows(df, *columns: str) -> list[dict]:
    return [r.asDict(True) for r in df.select(*columns).collect()]


class Engine:
    """An index folder and the models that work on it."""

    def __init__(self, spark: SparkSession, index_folder: str, embedder: Embedder | None = None, chat: A.ChatModel | None = None):
        self.spark, self.index, self.embedder, self.chat = spark, Index(spark, index_folder), embedder, chat

    def health(self) -> dict:
        return {"status": "ok", "chunks": self.index.table("chunks").count(), "files": self.index.table("ledger").count(), "snapshot": self.index.version()}

    def ingest(self, path: str, batch_files: int | None = None) -> dict:
        return vars(I.ingest(self.spark, path, self.index.folder, self.embedder, batch_files))

    def ask(self, question: str, k: int = 6, **how) -> dict:
        return A.answer(self.index.table("chunks"), question, self.chat, self.embedder, k, index=self._text(), **how)

    def ask_stream(self, question: str, k: int = 6, **how) -> Iterator[str]:
        return A.sse(A.stream(self.index.table("chunks"), question, self.chat, self.embedder, k, index=self._text(), **how))

    def _text(self) -> tuple | None:
        text = self.index.text()
        return (text.postings(), text.stats()) if text else None

    def excerpt(self, path: str, line: int) -> dict | None:
        row = retrieval.excerpt(self.index.table("chunks"), path, line).drop("embedding").first()
        return row.asDict() if row else None

    def delete_index(self) -> None:
        self.index.clear()

    def report(self, path: str, **knobs) -> str:
        with assess(self.spark, path, **knobs) as a:
            return render(a)

    def map(self, path: str) -> dict:
        began = time.time()
        with assess(self.spark, path) as a:
            return _timed(began, totals=P.totals(a.projects, a.edges).first().asDict(), projects=_rows(a.projects.orderBy(F.desc("lines"), "name"), "name", "kind", "target_framework", "source_files", "lines"), edges=_rows(a.edges.orderBy("from", "to"), "from", "to"), cycles=[r.cycle for r in a.cycles.collect()], findings=_rows(a.findings.orderBy("kind_ord", "project"), "kind", "project", "summary", "detail"))

    def risk(self, path: str, top: int = 20, min_code_lines: int = 100) -> dict:
        began = time.time()
        with assess(self.spark, path, min_code_lines=min_code_lines) as a:
            return _timed(began, history=a.history_status, note=a.history_note, ranked=a.risk.count(), entries=[r.asDict(True) for r in a.risk.limit(top).collect()])

    def modernise(self, path: str) -> dict:
        began = time.time()
        with assess(self.spark, path) as a:
            return _timed(began, survey=a.survey.first().asDict(), dead_ends=_rows(packages.dead_ends(a.packages), "id", "versions", "projects"), unknown=_rows(packages.unknown(a.packages), "id", "versions", "projects"), blocked=[r.project for r in a.modernised.where("blocked").orderBy("project").collect()])

    def diagram(self, path: str, min_lines: int = 500, include_tests: bool = False, namespace: str | None = None, around: str | None = None) -> str:
        """The projects of a directory, or its types in a namespace or around one of them."""
        if namespace is None and around is None:
            with assess(self.spark, path) as a:
                return mermaid.solution(a.projects, a.edges, min_lines, include_tests)
        types = csharp.types(with_suffix(self.spark, path, ".cs")).persist()
        try:
            return mermaid.class_diagram(types, typegraph.relations(types), namespace, around)
        finally:
            types.unpersist()


def blocks(text: str) -> list[tuple[str, str]]:
    """An answer as (kind, text) parts: fenced code, inline code and paragraphs. A fence that is not closed runs to the end."""
    out: list[tuple[str, str]] = []
    for k, part in enumerate(re.split(r"^```[^\n]*\n?", text, flags=re.M)):
        if k % 2:
            out.append(("code", part.rstrip("\n")))
            continue
        for paragraph in re.split(r"\n\s*\n", part):
            for j, piece in enumerate(re.split(r"`([^`\n]+)`", paragraph.strip())):
                if piece:
                    out.append(("inline" if j % 2 else "text", piece))
    return out
