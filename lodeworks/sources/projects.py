"""Project and package files as rows: MSBuild XML of either dialect, read by Arrow-batched Python.

Spark's xpath fails a query on a malformed file; here such a file is a row of kind Broken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.text import read_lines_count
from lodeworks.operators import projects as P
from lodeworks.shipping import dealt, ship
from lodeworks.sources.files import extension

PROJECT = "path string, name string, folder string, broken boolean, sdk_style boolean, target_framework string, any_framework string, refs array<string>, assemblies array<string>, use_wpf boolean, use_forms boolean, form_files boolean, output_type string, packages array<struct<id:string,version:string>>"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _stem(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.replace("\\", "/").rsplit("/", 1)[-1])


def _distinct(values: Iterator[str]) -> list[str]:
    return list({v.lower(): v for v in reversed(list(values))}.values())[::-1]


def read_project(path: str, content: str) -> tuple:
    """A PROJECT row of one project file."""
    name, folder = _stem(path), path.rpartition("/")[0]
    try:
        root = ElementTree.fromstring(content.lstrip("﻿").encode())
    except (ElementTree.ParseError, ValueError):
        return (path, name, folder, True, False, None, None, [], [], False, False, False, None, [])
    all_ = [(_local(e.tag), e) for e in root.iter() if isinstance(e.tag, str)]

    def texts(tag: str) -> list[str]:
        return ["".join(e.itertext()).strip() for t, e in all_ if t == tag]

    def first(*tags: str) -> str | None:
        return next((x for t in tags for x in texts(t)[:1]), None)

    include = lambda tag: [e.get("Include") or "" for t, e in all_ if t == tag]
    refs = _distinct(_stem(x) for x in include("ProjectReference") if x.strip())
    assemblies = _distinct(a for x in include("Reference") + include("PackageReference") if (a := x.split(",")[0].strip()))
    forms = any((e.get("Include") or "").lower().endswith(".designer.cs") and any(_local(c.tag) == "SubType" and (c.text or "") == "Form" for c in e) for t, e in all_ if t == "Compile")
    packages = [(e.get("Include"), e.get("Version") or next((c.text or "" for c in e if _local(c.tag) == "Version"), None) or "unknown") for t, e in all_ if t == "PackageReference" and e.get("Include")]
    return (path, name, folder, False, root.get("Sdk") is not None, first("TargetFrameworkVersion", "TargetFramework"), first("TargetFramework", "TargetFrameworks", "TargetFrameworkVersion"), refs, assemblies, first("UseWPF") == "true", first("UseWindowsForms") == "true", forms, first("OutputType"), packages)


def read_packages_config(path: str, content: str) -> list[tuple[str, str, str]]:
    """(folder, id, version) rows of one packages.config; none if it can't be read."""
    try:
        root = ElementTree.fromstring(content.lstrip("﻿").encode())
    except (ElementTree.ParseError, ValueError):
        return []
    folder = path.rpartition("/")[0]
    return [(folder, e.get("id"), e.get("version") or "unknown") for e in root.iter() if _local(e.tag) == "package" and e.get("id")]


def parsed(files: DataFrame) -> DataFrame:
    """PROJECT rows of project files (path, content)."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [read_project(p, c or "") for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in re.split(r", (?![^<]*>)", PROJECT)])

    return dealt(files).mapInPandas(run, PROJECT)


def read(files: DataFrame) -> DataFrame:
    """projects (name, path, folder, kind, target_framework, refs, assembly_references, source_files, lines, sdk_style,
    packages) of all files (path, content) of a tree."""
    p = parsed(files.where(extension(F.col("path")) == ".csproj").select("path", "content"))
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    parent, own = F.regexp_replace(folder, r"/?[^/]*$", ""), F.regexp_extract(folder, r"([^/]*)$", 1)
    marks = files.select("path", folder.alias("folder")).groupBy("folder").agg(F.max(base.isin("web.config", "Web.config", "Global.asax")).alias("web_files"), F.max(base == "App.xaml").alias("wpf_files"))
    views = files.where(own.isin("Views", "Controllers")).select(parent.alias("folder"), own.alias("own")).distinct().groupBy("folder").agg((F.count(F.lit(1)) == 2).alias("mvc"))
    sources = files.where(extension(F.col("path")) == ".cs").select("path", read_lines_count(F.coalesce("content", F.lit(""))).alias("lines"))
    size = P.source_measure(sources, p)
    no = lambda c: F.coalesce(c, F.lit(False))
    j = p.join(marks, "folder", "left").join(views, "folder", "left").join(size, "folder", "left")
    kind = P.kind(F.col("assemblies"), no("web_files") | no("mvc"), no("wpf_files"), F.col("use_wpf"), F.col("use_forms"), F.col("form_files"), F.col("output_type"))
    whole = lambda c: F.when(F.col("broken"), 0).otherwise(F.coalesce(c, F.lit(0))).cast("long")
    return j.select(
        "name", "path", "folder", F.when(F.col("broken"), "Broken").otherwise(kind).alias("kind"), "target_framework", "any_framework", F.col("refs").alias("references"), F.col("assemblies").alias("assembly_references"),
        whole("source_files").alias("source_files"), whole("lines").alias("lines"), "sdk_style", "broken", "packages",
    )


def references(projects: DataFrame) -> DataFrame:
    """(from, to) of all project references, known or not."""
    return projects.select(F.col("name").alias("from"), F.explode("references").alias("to"))


def package_refs(projects: DataFrame, configs: DataFrame) -> DataFrame:
    """(project, id, version): a project's packages.config if there is one beside it, else its PackageReference items.

    configs: (path, content) of packages.config files.
    """
    ship(projects.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, c in zip(b["path"], b["content"], strict=True) for r in read_packages_config(p, c or "")], columns=["folder", "id", "version"])

    listed = dealt(configs).mapInPandas(run, "folder string, id string, version string")
    with_file = configs.select(F.regexp_replace("path", r"/?[^/]*$", "").alias("folder")).distinct()
    old = projects.select("name", "folder").join(listed, "folder").select(F.col("name").alias("project"), "id", "version")
    new = projects.join(with_file, "folder", "left_anti").select(F.col("name").alias("project"), F.inline("packages"))
    return old.unionByName(new)
