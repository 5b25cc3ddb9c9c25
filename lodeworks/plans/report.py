"""The assessment as a markdown document: every number is read from a table."""

from __future__ import annotations

import textwrap
from datetime import datetime, timezone

from pyspark.sql import functions as F

from lodeworks.operators import packages as K
from lodeworks.operators import projects as P
from lodeworks.plans import mermaid
from lodeworks.plans.assess import Assessment

WIDTH = 80


def cell(x: object) -> str:
    return "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")


def para(text: str) -> str:
    return "\n".join(textwrap.wrap(text, WIDTH, break_long_words=False, break_on_hyphens=False)) + "\n"


def grid(head: list[str], rows: list[list[object]]) -> str:
    if not rows:
        return ""
    return "\n".join(["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def many(n: int, unit: str) -> str:
    plural = unit[:-1] + "ies" if unit.endswith("y") and unit[-2:-1] not in "aeiou" else unit + "s"
    return f"{n:,} {unit if n == 1 else plural}"


def render(a: Assessment, generated_at: datetime | None = None, top_risks: int = 15, diagram_min_lines: int = 500, diagram_boxes: int = 12) -> str:
    """The document's sections in order; those without content are short."""
    when = (generated_at or datetime.now(timezone.utc)).strftime("%Y-%m-%d")
    total = P.totals(a.projects, a.edges).first()
    out = [f"# Assessment of {cell(a.root)}\n", f"Made on {when}.\n"]
    if not total.projects:
        out.append("## No projects\n\n" + para("There is no project file under this directory."))
    out.append("## In short\n\n" + para(f"{many(total.projects, 'project')}, {many(total['files'] or 0, 'file')} and {many(total.lines or 0, 'line')} of code, with {many(total.dependencies, 'dependency')}."))

    kinds = P.kind_rollup(a.projects).orderBy(F.col("kind") == "Total", F.desc("lines"), "kind").collect()
    out.append("## Shape\n\n" + grid(["kind", "projects", "files", "lines"], [[r.kind, f"{r.projects:,}", f"{r['files'] or 0:,}", f"{r.lines or 0:,}"] for r in kinds]))
    big = a.projects.orderBy(F.desc("lines"), "name").limit(10).collect()
    out.append(grid(["largest projects", "kind", "lines"], [[r.name, r.kind, f"{r.lines:,}"] for r in big]))
    frames = P.frameworks(a.projects).orderBy(F.desc("projects"), "framework").collect()
    out.append(grid(["framework", "projects"], [[r.framework, r.projects] for r in frames]))

    least = P.diagram_threshold(a.projects, diagram_min_lines, diagram_boxes).first().threshold
    if total.projects:
        out.append("## Diagram\n\n```mermaid\n" + mermaid.solution(a.projects, a.edges, least) + "```\n")

    found = P.finding_summary(a.findings).orderBy(F.desc("findings"), "kind").collect()
    out.append("## Findings\n\n" + (grid(["finding", "count", "for example"], [[r.kind, r.findings, r.example] for r in found]) or "None.\n"))

    risky = a.risk.limit(top_risks).collect()
    out.append("## Risk\n\n" + (para(a.history_note or "") if a.history_note else "") + (grid(["file", "score", "complexity", "commits", "why"], [[r.path, f"{r.score:.3f}", r.complexity, r.commits, "; ".join(r.reasons)] for r in risky]) or "No file is large enough to rank.\n"))

    s = a.survey.first()
    words = f"{s.sdk_style} of {many(s.projects, 'project')} have the new file format. {many(s.packages, 'package')} in {many(s.package_references, 'reference')}: {s.portable} run on modern .NET, {s.tied} do not, {s.unknown} are not classified."
    words += " No package is used in two versions and no redirect is kept by hand." if s.tended else f" {many(s.divergent, 'package')} in several versions, {many(s.redirects, 'redirect')}."
    ends = K.dead_ends(a.packages).collect()
    out.append("## Modernisation\n\n" + para(words) + grid(["tied to System.Web", "projects"], [[r.id, r.projects] for r in ends]))

    steps = a.steps.orderBy("position").collect()
    parts = [f"### {i}. {r.title}\n\n" + para(f"{r.kind}: {r.size}. {r.why}") + "".join(f"- {cell(e)}\n" for e in r.evidence) for i, r in enumerate(steps, 1)]
    out.append("## Work, in order\n\n" + ("\n".join(parts) or "Nothing found to do.\n"))

    limits = a.limits.orderBy("position").collect()
    out.append("## What this could not see\n\n" + "\n".join(para(f"**{r.title}.** {r.detail}") for r in limits))
    return "\n".join(p for p in out if p)
