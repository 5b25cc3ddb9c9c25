"""A directory's assessment: every analysis as a DataFrame over one scan of its files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.text import tested_subject
from lodeworks.operators import assessment, csharp, history, packages, risk
from lodeworks.operators import projects as P
from lodeworks.sources import projects as source
from lodeworks.sources.files import PROJECT_SKIP_FOLDERS, decoded, extension, outside, tree
from lodeworks.sources.gitlog import git_log


@dataclass
class Assessment:
    """The tables of one assessment; nothing runs until one of them is read. Tables that others are made of are kept once
    they were read, until ``release`` or the end of a ``with`` block."""

    root: str
    projects: DataFrame
    edges: DataFrame
    cycles: DataFrame
    findings: DataFrame
    metrics: DataFrame
    risk: DataFrame
    history_status: str
    history_note: str | None
    packages: DataFrame
    modernised: DataFrame
    survey: DataFrame
    steps: DataFrame
    limits: DataFrame
    kept: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for df in self.kept:
            df.unpersist()

    def __enter__(self) -> Assessment:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()


def analyse(files: DataFrame, churn: DataFrame | None, min_code_lines: int = risk.MIN_CODE_LINES) -> tuple[DataFrame, DataFrame]:
    """(metrics, risk) of the C# files among files (path, content)."""
    cs = files.where((extension(F.col("path")) == ".cs") & outside(F.col("path"), PROJECT_SKIP_FOLDERS))
    metrics = csharp.metrics(cs.select("path", "content")).persist(StorageLevel.MEMORY_AND_DISK)
    tested = metrics.where("is_test").select(tested_subject(F.col("path")).alias("subject")).where("subject <> ''")
    return metrics, risk.risk(metrics, churn, tested, min_code_lines)


def assess(spark: SparkSession, root: str, top_risks: int = 20, min_code_lines: int = risk.MIN_CODE_LINES, history_months: int | None = 24, oversized: int = P.OVERSIZED) -> Assessment:
    """Assess the code under a directory that driver and executors can read."""
    found = tree(spark, root).where(outside(F.col("path"), PROJECT_SKIP_FOLDERS))
    text = F.when(extension(F.col("path")).isin(".cs", ".csproj", ".config", ".xaml", ".asax"), decoded(F.col("content")))
    files = found.select("path", text.alias("content")).persist(StorageLevel.MEMORY_AND_DISK)
    done = assess_files(files, root, git_log(spark, root, history_months), top_risks, min_code_lines, oversized)
    done.kept.append(files)
    return done


def assess_files(files: DataFrame, root: str, log: tuple[str, str | None, DataFrame], top_risks: int = 20, min_code_lines: int = risk.MIN_CODE_LINES, oversized: int = P.OVERSIZED) -> Assessment:
    """Assess files (path, content) with a history (status, note, commits) as ``git_log`` gives it."""
    status, note, commits = log
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return kept[-1]

    projects = keep(source.read(files))
    edges = keep(P.edges(source.references(projects), projects))
    cycles = keep(P.cycles(edges))
    findings = keep(P.findings(projects, edges, cycles, oversized))
    churn = history.churn(commits) if status == "Available" else None
    metrics, entries = analyse(files, churn, min_code_lines)
    kept.append(metrics)
    entries = keep(risk.without_tests(entries, projects.where("kind = 'Test'").select("folder"))).orderBy(F.desc("score"), "path")
    configs = files.where(F.lower("path").rlike(r"(^|/)packages\.config$"))
    refs = source.package_refs(projects, configs)
    catalogue = keep(packages.catalogue(refs))
    modernised = keep(packages.project_modernisation(projects.select(F.col("name").alias("project"), "sdk_style", "broken"), refs))
    redirects = packages.redirects(files.where(F.lower("path").rlike(r"(^|/)(web|app)\.config$")))
    survey = keep(packages.survey(modernised, catalogue, redirects))
    steps = assessment.repair_steps(findings, catalogue, modernised, survey, entries, top_risks)
    generated = metrics.agg(F.count_if("is_generated").alias("n"))
    limits = assessment.limitations(findings, survey, generated, projects, status == "Available", note)
    return Assessment(root, projects, edges, cycles, findings, metrics, entries, status, note, catalogue, modernised, survey, steps, limits, kept)
