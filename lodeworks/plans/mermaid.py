"""Diagrams as one text, for those who ask for a page: the numbered lines of ``operators.diagrams``, put together."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lodeworks.operators import diagrams


def _page(lines: DataFrame) -> str:
    return "".join(r.line + "\n" for r in lines.orderBy("line_no").toLocalIterator())


def solution(projects: DataFrame, edges: DataFrame, min_lines: int = 500, include_tests: bool = False) -> str:
    """A graph of projects by layer with their dependencies, and a note of how many were left out."""
    return _page(diagrams.solution(projects, edges, min_lines, include_tests))


def class_diagram(types: DataFrame, relations: DataFrame, namespace: str | None = None, around: str | None = None, max_members: int = diagrams.MAX_MEMBERS) -> str:
    """The types of a namespace, or around one type, with members and relations."""
    return _page(diagrams.class_diagram(types, relations, namespace, around, max_members))
