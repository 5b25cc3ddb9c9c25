"""Questions answered with citations: retrieval in Spark, prompt and model on the driver."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, Row, SparkSession

from lodeworks.functions.embedding import Embedder, HashEmbedder
from lodeworks.functions.text import query_terms
from lodeworks.operators import retrieval
from lodeworks.operators.prompts import CUT, MOST, prompts  # noqa: F401  CUT is what callers look for

NOTHING_FOUND = "Nothing in the index seems to be about this question. Try the words that the code itself uses."


class ChatModel(Protocol):
    def complete(self, prompt: str) -> str: ...

    def stream(self, prompt: str) -> Iterator[str]: ...


class HttpChat:
    """A model server that streams one JSON object a line: {response, done}. Lines that are no JSON are skipped."""

    def __init__(self, url: str, model: str, temperature: float = 0.1, context: int = 8192, timeout: float = 600):
        self.url, self.model, self.timeout = url, model, timeout
        self.options = {"temperature": temperature, "num_ctx": context}

    def stream(self, prompt: str) -> Iterator[str]:
        body = json.dumps({"model": self.model, "prompt": prompt, "stream": True, "options": self.options}).encode()
        with urllib.request.urlopen(urllib.request.Request(self.url, body, {"Content-Type": "application/json"}), timeout=self.timeout) as r:
            for line in r:
                try:
                    part = json.loads(line)
                except ValueError:
                    continue
                if part.get("response"):
                    yield part["response"]
                if part.get("done"):
                    return

    def complete(self, prompt: str) -> str:
        return "".join(self.stream(prompt))


def prompt(question: str, hits: list[Row], max_chars: int = MOST) -> str:
    """The prompt of one question from its few hits, best first, by the rule for many."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    rows = [(0, i, h.file_path, h.start_line, h.end_line, h.content) for i, h in enumerate(hits)]
    found = spark.createDataFrame(rows, "qid int, rank int, file_path string, start_line int, end_line int, content string")
    return prompts(spark.createDataFrame([(0, question)], "qid int, question string"), found, "qid", max_chars).first().prompt


def terms_of(spark, question: str) -> list[str]:
    from pyspark.sql import functions as F

    return spark.range(1).select(query_terms(F.lit(question))).first()[0]


def find(chunks: DataFrame, question: str, embedder: Embedder | None = None, k: int = 6, **how) -> list[Row]:
    """The k best chunks, best first: at most k rows reach the driver. ``index`` in how: stored postings and statistics."""
    embedder = embedder or HashEmbedder()
    probe = embedder.embed([question])[0].tolist()
    hits = retrieval.retrieve(chunks, probe, terms_of(chunks.sparkSession, question), k, **how)
    rows = hits.drop("file_path").join(chunks.drop("embedding"), "id").orderBy("final_rank").collect()
    return rows


def citations(hits: list[Row]) -> list[dict]:
    return [{"file_path": h.file_path, "start_line": h.start_line, "end_line": h.end_line, "score": h.score, "found_by": h.source} for h in hits]


def answer(chunks: DataFrame, question: str, chat: ChatModel, embedder: Embedder | None = None, k: int = 6, **how) -> dict:
    """{answer, citations}; without a hit a fixed sentence and no citation."""
    hits = find(chunks, question, embedder, k, **how)
    if not hits:
        return {"answer": NOTHING_FOUND, "citations": []}
    return {"answer": chat.complete(prompt(question, hits)), "citations": citations(hits)}


def stream(chunks: DataFrame, question: str, chat: ChatModel, embedder: Embedder | None = None, k: int = 6, **how) -> Iterator[tuple[str, object]]:
    """Events: sources, then tokens as they come, then done; a failure is an event and the last one."""
    try:
        hits = find(chunks, question, embedder, k, **how)
    except (OSError, RuntimeError) as e:
        yield "failed", str(e)
        return
    yield "sources", citations(hits)
    if not hits:
        yield "token", NOTHING_FOUND
        yield "done", None
        return
    try:
        for token in chat.stream(prompt(question, hits)):
            yield "token", token
    except (OSError, RuntimeError) as e:
        yield "failed", str(e)
        return
    yield "done", None


def sse(events: Iterator[tuple[str, object]]) -> Iterator[str]:
    """Events framed for a server-sent event stream."""
    for name, payload in events:
        yield f"event: {name}\ndata: {json.dumps(payload)}\n\n"


def bar_width(score: float, source: str) -> str | int:
    """A citation's bar, 0 to 100 between the scores 0.45 and 0.85; text hits have no measure."""
    return "exact" if source == "text" else round((min(max(score, 0.45), 0.85) - 0.45) / 0.4 * 100)
