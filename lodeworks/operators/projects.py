"""Project graph: kinds, edges, cycles, findings and roll-ups over tables of projects and references.

projects: name, path, kind, target_framework, references, assembly_references, source_files, lines.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.operators import cycles as strong
from lodeworks.shipping import ship

# Assemblies that tie a library to the web, and what marks test projects.
WEB_ASSEMBLIES = ("System.Web.Mvc", "System.Web.Http", "System.Web.WebPages", "Microsoft.AspNetCore")
TEST_REFERENCES = ("xunit", "nunit", "mstest", "microsoft.visualstudio.qualitytools")
OVERSIZED = 20_000


def starts_with_any(value: Column, prefixes: tuple[str, ...]) -> Column:
    """Does value start with one of the prefixes, without case?"""
    return reduce(lambda a, p: a | F.startswith(F.lower(value), F.lit(p.lower())), prefixes, F.lit(False))


def kind(refs: Column, web_files: Column, wpf_files: Column, use_wpf: Column, use_forms: Column, form_files: Column, output_type: Column) -> Column:
    """What a project is: the first of test, web, WPF, WinForms, console that its marks show, else a library."""
    test = F.exists(refs, lambda r: starts_with_any(r, TEST_REFERENCES))
    exe = F.lower(F.coalesce(output_type, F.lit(""))).isin("exe", "winexe")
    return F.when(test, "Test").when(web_files, "Web").when(wpf_files | use_wpf, "Wpf").when(use_forms | form_files, "WinForms").when(exe, "Console").otherwise("Library")


def edges(references: DataFrame, projects: DataFrame) -> DataFrame:
    """(from, to): references (from, to) to projects that are there, names compared without case, distinct as written."""
    known = projects.select(F.lower("name").alias("_n")).distinct()
    return references.join(known, F.lower("to") == F.col("_n"), "left_semi").select("from", "to").distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(from, targets, degree): outgoing neighbours, sorted. A project's targets are bounded by its file."""
    return edges.groupBy("from").agg(F.array_sort(F.collect_set("to")).alias("targets"), F.count_distinct("to").alias("degree"))


def cycles(edges: DataFrame) -> DataFrame:
    """(cycle): dependency cycles of any length, each from its least name and closed by it, distinct.

    The strongly connected components are found first, by joins. Within each a depth-first walk from its least name, over
    names in order, without case, reports the path that each edge back to it closes. So each component gives one cycle at
    least, but not all of those it has, which can be more than can be counted. A walk is linear, and a task has the edges
    of one component: ``cycles.shortest`` gives one cycle of each without any walk.
    """
    ship(edges.sparkSession)
    e = edges.select("from", "to", F.lower("from").alias("a"), F.lower("to").alias("b")).distinct()
    parts = strong.components(e.select("a", "b"))
    inside = e.join(parts.withColumnRenamed("node", "a"), "a").join(parts.withColumnsRenamed({"node": "b", "component": "other"}), "b").where("component = other")
    return inside.groupBy("component").applyInArrow(_back_edges, "cycle array<string>").distinct()


def components(edges: DataFrame, finish: int = strong.FINISH) -> DataFrame:
    """(project, component, size): projects that depend on themselves over others, by the least of those that they share
    their cycles with; names in lower case."""
    parts = strong.components(edges.select(F.lower("from").alias("a"), F.lower("to").alias("b")), finish)
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return parts.join(sizes, "component").select(F.col("node").alias("project"), "component", "size")


def _back_edges(edges: pa.Table) -> pa.Table:
    """The cycles that a depth-first walk of one component's edges (from, to; a and b in lower case) meets."""
    written: dict[str, str] = {}
    after: dict[str, list[str]] = {}
    for name, _, a, b in sorted(zip(*(edges.column(c).to_pylist() for c in ("from", "to", "a", "b")), strict=True)):
        written.setdefault(a, name)
        after.setdefault(a, []).append(b)
    first = min(after)
    out, settled, place, path, todo = [], set(), {first: 0}, [first], [iter(dict.fromkeys(after[first]))]
    while path:
        to = next(todo[-1], None)
        if to is None:
            settled.add(path[-1])
            del place[path.pop()]
            todo.pop()
        elif to in place:
            ring = path[place[to] :]
            at = ring.index(min(ring, key=written.__getitem__))
            ring = ring[at:] + ring[:at]
            out.append([written[x] for x in [*ring, ring[0]]])
        elif to not in settled:
            place[to] = len(path)
            path.append(to)
            todo.append(iter(dict.fromkeys(after[to])))
    return pa.table([pa.array(out, pa.list_(pa.string()))], ["cycle"])


def _named(name: str, df: DataFrame, ord_: int, summary: Column, detail: str) -> DataFrame:
    return df.select(F.lit(name).alias("kind"), F.col("name").alias("project"), summary.alias("summary"), F.lit(detail).alias("detail"), F.lit(ord_).alias("kind_ord"))


def unreadable(projects: DataFrame) -> DataFrame:
    return _named("Unreadable", projects.where("kind = 'Broken'"), 0, F.lit("The project file is not valid XML"), "No number of this project is in the totals.")


def coupled(projects: DataFrame) -> DataFrame:
    """Libraries that refer to the web stack."""
    p = projects.withColumn("web", F.array_distinct(F.filter("assembly_references", lambda r: starts_with_any(r, WEB_ASSEMBLIES))))
    return _named("LibraryCoupledToWeb", p.where("kind = 'Library' and size(web) > 0"), 1, F.concat(F.lit("A library that depends on "), F.array_join("web", ", ")), "Tests and other hosts need a web context to use it.")


def untested(projects: DataFrame, test_edges: DataFrame) -> DataFrame:
    """Projects with lines that no test project refers to; test_edges is (to)."""
    seen = test_edges.select(F.lower("to").alias("_t")).distinct()
    p = projects.where("kind not in ('Test', 'Broken') and lines > 0").join(seen, F.lower("name") == F.col("_t"), "left_anti")
    return _named("Untested", p, 2, F.concat(F.lit("No test project refers to it ("), F.format_number("lines", 0), F.lit(" lines)")), "Changes are checked by running the application or not at all.")


def oversized(projects: DataFrame, most: int = OVERSIZED) -> DataFrame:
    return _named("Oversized", projects.where((F.col("lines") > most) & (F.col("kind") != "Broken")), 3, F.concat(F.format_number("lines", 0), F.lit(" lines in one project")), "More than one person can keep in mind.")


def orphan(projects: DataFrame, edges: DataFrame) -> DataFrame:
    """Libraries with lines that nothing refers to."""
    seen = edges.select(F.lower("to").alias("_t")).distinct()
    p = projects.where("kind = 'Library' and lines > 0").join(seen, F.lower("name") == F.col("_t"), "left_anti")
    return _named("Orphan", p, 4, F.lit("Nothing in the solution refers to it"), "Dead, or loaded at run time by other means.")


def in_cycle(cycles: DataFrame) -> DataFrame:
    rows = cycles.select(F.element_at("cycle", 1).alias("name"), F.array_join("cycle", " -> ").alias("path"))
    return _named("DependencyCycle", rows, 5, F.concat(F.lit("Dependency cycle: "), F.col("path")), "A cycle can't be built, so the files don't show what is.")


def findings(projects: DataFrame, edges: DataFrame, cycles: DataFrame, oversized_lines: int = OVERSIZED) -> DataFrame:
    """(kind, project, summary, detail, kind_ord) of all six detectors; a broken project has no other finding."""
    tests = edges.join(projects.where("kind = 'Test'").select(F.lower("name").alias("_n")).distinct(), F.lower("from") == F.col("_n"), "left_semi").select("to")
    parts = [unreadable(projects), coupled(projects), untested(projects, tests), oversized(projects, oversized_lines), orphan(projects, edges), in_cycle(cycles)]
    return reduce(DataFrame.unionByName, parts)


def kind_rollup(projects: DataFrame) -> DataFrame:
    """(kind, projects, files, lines) by kind with a Total row."""
    return projects.rollup("kind").agg(F.count(F.lit(1)).alias("projects"), F.sum("source_files").alias("files"), F.sum("lines").alias("lines")).select(F.coalesce("kind", F.lit("Total")).alias("kind"), "projects", "files", "lines")


def frameworks(projects: DataFrame) -> DataFrame:
    """(framework, projects): counted without case, written as the least spelling."""
    return projects.where("target_framework is not null").groupBy(F.lower("target_framework").alias("_k")).agg(F.min("target_framework").alias("framework"), F.count(F.lit(1)).alias("projects")).drop("_k")


def finding_summary(findings: DataFrame) -> DataFrame:
    """(kind, findings, example, detail): the example is the least project."""
    return findings.groupBy("kind").agg(F.count(F.lit(1)).alias("findings"), F.min("project").alias("example"), F.min("detail").alias("detail"))


def totals(projects: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: projects, files, lines, dependencies."""
    n = edges.agg(F.count(F.lit(1)).alias("dependencies"))
    return projects.agg(F.count(F.lit(1)).alias("projects"), F.sum("source_files").alias("files"), F.sum("lines").alias("lines")).crossJoin(F.broadcast(n))


def biggest(projects: DataFrame, top: int = 10) -> DataFrame:
    """(name, lines) of the largest projects; ties go to the least name."""
    return projects.select("name", "lines").orderBy(F.desc("lines"), "name").limit(top)


def diagram_threshold(projects: DataFrame, least: int = 500, boxes: int = 12) -> DataFrame:
    """One row, threshold: the size of the boxes-th largest project without tests, not under least."""
    top = projects.where("kind <> 'Test'").select("lines").orderBy(F.desc("lines")).limit(boxes)
    return top.agg(F.greatest(F.lit(least), F.when(F.count(F.lit(1)) >= boxes, F.min("lines")).otherwise(F.lit(least))).cast("long").alias("threshold"))


def diagram_edges(projects: DataFrame, edges: DataFrame, min_lines: int = 500, include_tests: bool = False) -> DataFrame:
    """Edges between projects that a diagram shows."""
    shown = projects.where((F.col("lines") >= min_lines) & (F.lit(include_tests) | (F.col("kind") != "Test"))).select(F.lower("name").alias("_n")).distinct()
    return edges.join(shown, F.lower("from") == F.col("_n"), "left_semi").join(shown, F.lower("to") == F.col("_n"), "left_semi")


def source_measure(files: DataFrame, projects: DataFrame) -> DataFrame:
    """(folder, source_files, lines): a file counts for every project folder above it, as nested projects share it.

    files: path, lines; projects: folder. A file's folders are exploded, so the join is by equality.
    """
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, n), "/")))
    placed = files.where(~F.lower("path").endswith(".designer.cs")).select(F.explode(up).alias("folder"), "lines")
    counted = placed.join(projects.select("folder").distinct(), "folder").groupBy("folder").agg(F.count(F.lit(1)).alias("source_files"), F.sum("lines").alias("lines"))
    return projects.select("folder").distinct().join(counted, "folder", "left").select("folder", F.coalesce("source_files", F.lit(0)).alias("source_files"), F.coalesce("lines", F.lit(0)).alias("lines"))
