"""Repair steps and limitations of an assessment, as tables made of conditional aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.text import counted

EVIDENCE, EXPOSED = 10, 20


def _step(rows: DataFrame, evidence: Column, order: list[Column], position: int, kind: str, title: str, why: str, unit: str, cap: int | None = EVIDENCE) -> DataFrame:
    """One row if there is any in rows: what to do, why, how much of it and the first few by order. With a cap, a list of
    so many is all that is gathered; without one the report prints them all."""
    ranked = rows.select(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], evidence.alias("e")).alias("r"))
    first = ranked.orderBy("r").limit(cap) if cap else ranked
    listed = first.agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["e"]).alias("evidence"))
    one = rows.agg(F.count(F.lit(1)).alias("n")).where("n > 0").crossJoin(F.broadcast(listed))  # one row each
    return one.select(F.lit(position).alias("position"), F.lit(kind).alias("kind"), F.lit(title).alias("title"), F.lit(why).alias("why"), counted(F.col("n"), unit).alias("size"), "evidence")


def repair_steps(findings: DataFrame, packages: DataFrame, modernised: DataFrame, survey: DataFrame, risk: DataFrame, top_risks: int = EXPOSED) -> DataFrame:
    """(position, kind, title, why, size, evidence): the steps that have something in them, in their order.

    Evidence lists are gathered from tables of projects, packages and the top risks, which a report prints.
    """
    f = lambda kind: findings.where(F.col("kind") == kind)
    projects = F.concat(F.col("id"), F.lit(" ("), counted(F.col("projects"), "project"), F.lit(")"))
    big = [-F.col("projects"), F.col("id")]
    exposed = risk.where(~F.col("tested") & (F.col("score") > 0)).orderBy(F.desc("score"), "path").limit(top_risks)
    divergent = packages.where("divergent")
    only = survey.where("divergent = 0 and redirects > 0").select(
        F.lit(5).alias("position"), F.lit("Mechanical").alias("kind"), F.lit("Remove the binding redirects kept by hand").alias("title"), F.lit("Each was written for versions that disagreed; the files no longer show which.").alias("why"), counted(F.col("redirects"), "redirect").alias("size"), F.array().cast("array<string>").alias("evidence")
    )
    parts = [
        _step(f("Unreadable"), F.col("project"), [F.col("project")], 1, "Blocking", "Mend the project files that can't be read", "All other numbers leave these projects out.", "project file", None),
        _step(f("DependencyCycle"), F.col("summary"), [F.col("project"), F.col("summary")], 2, "Blocking", "Break the dependency cycles", "What is built can't be what the files say.", "cycle", None),
        _step(packages.where("portability = 'Unknown'"), projects, big, 3, "Prerequisite", "Find out about the packages nobody has checked", "Each may be nothing or a rewrite, which sets the size of what follows.", "package"),
        _step(modernised.where("convertible_as_is"), F.col("project"), [F.col("project")], 4, "Mechanical", "Convert the project files that nothing holds back", "Only their format is old, and every one done makes the rest smaller.", "project"),
        _step(divergent, F.concat(F.col("id"), F.lit(": "), F.array_join("versions", ", ")), big, 5, "Mechanical", "Settle packages used in several versions", "A conversion has to choose one of them anyway.", "package"),
        only,
        _step(packages.where("portability = 'TiedToSystemWeb'"), projects, big, 6, "Decision", "Decide about the code built on System.Web", "No version of these packages runs on modern .NET.", "package", None),
        _step(f("LibraryCoupledToWeb"), F.concat("project", F.lit(": "), "summary"), [F.col("project")], 7, "Decision", "Part the libraries from the web stack", "They can't be tested or used without a web context.", "library", None),
        _step(exposed, F.concat("path", F.lit(" (score "), F.format_number("score", 2), F.lit(")")), [-F.col("score"), F.col("path")], 8, "Continuous", "Put tests around the riskiest files", "They are complex, change often and no test is named after them.", "file"),
        _step(f("Orphan"), F.col("project"), [F.col("project")], 9, "PossiblyFree", "Ask whether unreferenced projects are dead", "If so this is the cheapest work here.", "project", None),
    ]
    # a step on System.Web counts projects held back, not packages
    return reduce(DataFrame.unionByName, parts)


def limitations(findings: DataFrame, survey: DataFrame, generated_excluded: DataFrame, projects: DataFrame, history: bool, note: str | None = None) -> DataFrame:
    """(position, title, detail): two that always hold and those that apply here; generated_excluded: one row, n."""
    spark = findings.sparkSession
    fixed = [(1, "Nothing was compiled", "Only project files, source text and history were read."), (2, "Tests are matched by name", "A file counts as tested if a test file is named after it.")]
    if not history:
        fixed.append((3, "No change history", (note or "The history could not be read.") + " Files are ranked on structure alone."))
    out = spark.createDataFrame(fixed, "position int, title string, detail string")
    row = lambda df, n, title, detail: df.select(F.lit(n).alias("position"), F.lit(title).alias("title"), detail.alias("detail"))
    number = lambda c: F.col(c).cast("string")
    unreadable = findings.where("kind = 'Unreadable'").agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    empty = projects.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    parts = [
        row(survey.where("unknown > 0"), 4, "Packages not yet classified", F.concat(number("unknown"), F.lit(" of "), number("packages"), F.lit(" packages are in neither list."))),
        row(generated_excluded.where("n > 0"), 5, "Generated code left out", F.concat(number("n"), F.lit(" generated files are not ranked."))),
        row(unreadable, 6, "Project files that could not be read", F.concat(number("n"), F.lit(" project files are not valid XML."))),
        row(empty, 7, "No projects found", F.lit("There is no project file under this directory.")),
    ]
    return reduce(DataFrame.unionByName, parts, out)
