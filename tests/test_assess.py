from __future__ import annotations

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodeworks.operators import characterize, packages, risk, typegraph
from lodeworks.operators import projects as P
from lodeworks.plans.assess import assess
from lodeworks.plans.mermaid import class_diagram, solution
from lodeworks.plans.report import render

OLD = '<?xml version="1.0"?><Project xmlns="http://schemas.microsoft.com/developer/msbuild/2003"><PropertyGroup><TargetFrameworkVersion>v4.5.1</TargetFrameworkVersion><OutputType>Library</OutputType></PropertyGroup><ItemGroup>{}</ItemGroup></Project>'
NEW = '<Project Sdk="Microsoft.NET.Sdk"><PropertyGroup><TargetFramework>net8.0</TargetFramework></PropertyGroup><ItemGroup>{}</ItemGroup></Project>'


@pytest.fixture
def root(tmp_path):
    method = "    void M%d(int a) {{ if (a > 1) {{ while (a < 9) {{ a++; }} }} }}\n"
    big = "class {} {{\n" + "".join(method % i for i in range(120)) + "}}\n"
    for p, text in {
        "src/Core/Core.csproj": OLD.format(r'<ProjectReference Include="..\..\Old\Place\Data.csproj"/><Reference Include="System.Web.Mvc, Version=5"/>'),
        "src/Core/Engine.cs": big.format("Engine"), "src/Core/packages.config": '<packages><package id="Newtonsoft.Json" version="11.0.2"/><package id="Microsoft.AspNet.Mvc" version="5.3.0"/></packages>',
        "src/Data/Data.csproj": OLD.format(r'<ProjectReference Include="..\Core\Core.csproj"/>'), "src/Data/Store.cs": big.format("Store"),
        "src/Web/Web.csproj": OLD.format(r'<ProjectReference Include="..\Core\Core.csproj"/><PackageReference Include="Newtonsoft.Json"><Version>13.0.3</Version></PackageReference><PackageReference Include="Some.Internal.Package" Version="1.0"/>'),
        "src/Web/web.config": '<a><bindingRedirect x="1"/><BINDINGREDIRECT/></a>', "src/Web/Page.cs": "class Page { }\n",
        "tests/Core.Tests/Core.Tests.csproj": NEW.format(r'<ProjectReference Include="..\..\src\Core\Core.csproj"/><PackageReference Include="xunit" Version="2.4"/>'),
        "tests/Core.Tests/EngineTests.cs": "class EngineTests { [Fact] void A() { } }\n", "broken/Bad.csproj": "<Project><unclosed>", "src/Core/bin/Skip.cs": "class Skip { }",
    }.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text.replace("{{", "{").replace("}}", "}") if p.endswith(".cs") else text)
    return tmp_path


def test_assessment(spark, root):
    a = assess(spark, str(root))
    p = {r.name: r for r in a.projects.collect()}
    assert {n: r.kind for n, r in p.items()} == {"Core": "Library", "Data": "Library", "Web": "Web", "Core.Tests": "Test", "Bad": "Broken"}
    assert p["Core"].lines == 122 and p["Core"].target_framework == "v4.5.1" and p["Core"].source_files == 1
    assert {(e["from"], e["to"]) for e in a.edges.collect()} == {("Core", "Data"), ("Data", "Core"), ("Web", "Core"), ("Core.Tests", "Core")}
    assert [r.cycle for r in a.cycles.collect()] == [["Core", "Data", "Core"]]
    kinds = {(r.kind, r.project) for r in a.findings.collect()}
    assert kinds == {("Unreadable", "Bad"), ("LibraryCoupledToWeb", "Core"), ("Untested", "Data"), ("Untested", "Web"), ("DependencyCycle", "Core")}
    r = {x.path: x for x in a.risk.collect()}
    assert set(r) == {"src/Core/Engine.cs", "src/Data/Store.cs"} and r["src/Core/Engine.cs"].tested and not r["src/Data/Store.cs"].tested
    assert r["src/Data/Store.cs"].score > r["src/Core/Engine.cs"].score
    s = a.survey.first()
    assert (s.divergent, s.redirects, s.blocked, s.unknown, s.sdk_style) == (1, 2, 1, 1, 1)
    steps = [(x.position, x.size) for x in a.steps.orderBy("position").collect()]
    assert [n for n, _ in steps] == [1, 2, 3, 4, 5, 6, 7, 8] and steps[0][1] == "1 project file"
    text = render(a, datetime(2026, 8, 14))
    assert "2026-08-14" in text and "Newtonsoft.Json: 11.0.2, 13.0.3" in text and "graph LR" in text
    assert "1 project file" in text and "| Total | 5 |" in text


def test_empty_directory(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("x")
    text = render(assess(spark, str(tmp_path)))
    assert "No projects" in text


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, complexity int, max_nesting int, worst_method_complexity int, worst_method string, code_lines int, is_generated boolean, is_test boolean")


def test_risk(spark):
    m = frame(spark, [("Both.cs", 50, 5, 45, "Run", 200, False, False), ("Complex.cs", 50, 5, 5, "A", 200, False, False), ("Churn.cs", 2, 1, 1, "B", 200, False, False), ("Gen.cs", 99, 9, 9, "C", 900, True, False), ("Small.cs", 99, 9, 9, "C", 9, False, False)])
    c = spark.createDataFrame([("Both.cs", 20, 1), ("Churn.cs", 20, 3)], "path string, commits long, authors long")
    none = spark.createDataFrame([], "subject string")
    r = {x.path: x for x in risk.risk(m, c, none).collect()}
    assert set(r) == {"Both.cs", "Complex.cs", "Churn.cs"} and r["Both.cs"].score > max(r["Complex.cs"].score, r["Churn.cs"].score)
    assert any("45" in x for x in r["Both.cs"].reasons) and any("one person" in x for x in r["Both.cs"].reasons)
    flat = risk.risk(m.where("path = 'Both.cs'"), None, spark.createDataFrame([("BOTH",)], "subject string")).first()
    assert flat.score == 0.5 and flat.tested and "ranked on structure alone: no change history" in flat.reasons


def test_types_and_diagram(spark):
    t = spark.createDataFrame(
        [("User", "N", "Class", "a", 0, False, ["Identity", "ISomething"], ["A()"] * 10, 1), ("Identity", "N", "Class", "b", 0, True, ["SomeBase"], [], 0), ("ISomething", "M", "Interface", "c", 0, False, ["IOther"], [], 0)],
        "name string, namespace string, shape string, path string, pos int, is_abstract boolean, base_types array<string>, members array<string>, complexity int",
    )
    rel = typegraph.relations(t)
    assert {(r["from"], r["to"], r.kind) for r in rel.collect()} == {("User", "Identity", "Inherits"), ("User", "ISomething", "Implements"), ("Identity", "SomeBase", "Inherits"), ("ISomething", "IOther", "Inherits")}
    assert {r.name for r in typegraph.unresolved(t).collect()} == {"SomeBase", "IOther"}
    text = class_diagram(t, rel, namespace="N")
    assert "Identity <|-- User" in text and "+2 more" in text and "<<abstract>>" in text and "2 relations lead out" in text
    assert "ISomething <|.. User" in class_diagram(t, rel, around="User")


def test_long_cycles(spark):
    ring = lambda x, n: [(f"{x}{i:02}", f"{x}{(i + 1) % n:02}") for i in range(n)]
    tied = [("A", "B"), ("b", "A"), ("A", "R00"), ("R00", "S00")]
    e = spark.createDataFrame([*ring("R", 4), *ring("S", 30), ("S00", "S05"), *tied, *((f"T{i:02}", f"T{i + 1:02}") for i in range(11))], "from string, to string")
    whole = (*(f"S{i:02}" for i in range(30)), "S00")  # the edge S00 -> S05 leads to a name that is settled
    assert {tuple(r.cycle) for r in P.cycles(e).collect()} == {("A", "b", "A"), ("R00", "R01", "R02", "R03", "R00"), whole}
    deep = spark.createDataFrame(ring("N", 5000), "from string, to string")
    assert [len(r.cycle) for r in P.cycles(deep).collect()] == [5001]
    assert P.cycles(e.limit(0)).count() == 0


def test_cycles_and_diagram(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "A"), ("B", "C"), ("C", "C"), ("C", "D"), ("D", "B")], "from string, to string")
    assert {tuple(r.cycle) for r in P.cycles(e).collect()} == {("A", "B", "A"), ("C", "C"), ("B", "C", "D", "B")}
    p = spark.createDataFrame([("A", "x/L1/A/A.csproj", "Library", 900), ("B", "x/L2/B/B.csproj", "Library", 800), ("T", "x/L2/T/T.csproj", "Test", 800), ("a", "q", "Web", 10)], "name string, path string, kind string, lines long")
    text = solution(p, e)
    assert "nA --> nB" in text and "nT" not in text and "2 of 4 projects" in text and 'subgraph gL1["L1"]' in text


def test_identifiers_as_taken_one_by_one(spark):
    from lodeworks.operators.diagrams import identifiers

    rng, taken, want = random.Random(7), set(), {}
    names = list({"".join(rng.choices("aB.-_2", k=rng.randint(0, 5))) for _ in range(400)} | {"a", "a_2", "a-2", "a.2", "a_2_2", "é.", "é-", '"'})
    rng.shuffle(names)
    for name in names:
        base = "n" + re.sub(r"[^\w]|_", "_", name)
        tries = (base if n == 1 else f"{base}_{n}" for n in range(1, 1000))
        want[name] = next(x for x in tries if x not in taken)
        taken.add(want[name])
    rows = spark.createDataFrame([(x, i) for i, x in enumerate(names)] + [(names[0], 999)], "name string, at int")
    assert {r.name: r.id for r in identifiers(rows, "n").collect()} == want


def test_lines_in_order(spark):
    from lodeworks.operators import diagrams

    p = spark.createDataFrame([("A.b", "x/L/A/A.csproj", "Library", 900), ("A-b", "x/L/B/B.csproj", "Web", 1900), ('C"', "C.csproj", "Console", 500)], "name string, path string, kind string, lines long")
    e = spark.createDataFrame([("a-B", "A.b"), ("A.b", 'C"')], "from string, to string")
    lines = [r.line for r in diagrams.solution(p, e).orderBy("line_no").collect()]
    assert lines == ["graph LR", '    nC_["C&quot;<br/>500 lines"]', '    subgraph gL["L"]', '        nA_b["A-b<br/>1,900 lines"]', '        nA_b_2["A.b<br/>900 lines"]', "    end", "    nA_b_2 --> nC_", "    nA_b --> nA_b_2"]
    assert [r.line for r in diagrams.solution(p.limit(0), e.limit(0)).collect()] == ["graph LR"]


def test_packages(spark):
    refs = spark.createDataFrame([("A", "Newtonsoft.Json", "11.0.2"), ("B", "newtonsoft.json", "13.0.3"), ("A", "Microsoft.AspNet.Mvc", "5.3.0"), ("B", "Some.Internal.Package", "1")], "project string, id string, version string")
    c = {r.id.lower(): r for r in packages.catalogue(refs).collect()}
    assert c["newtonsoft.json"].divergent and c["newtonsoft.json"].projects == 2
    assert [c[k].portability for k in ("newtonsoft.json", "microsoft.aspnet.mvc", "some.internal.package")] == ["Portable", "TiedToSystemWeb", "Unknown"]


def test_kind(spark):
    rows = [(["XUnit.core"], True, False, "Exe"), (["System.Web.Mvc"], False, False, None), ([], True, False, None), ([], False, True, None), ([], False, False, "WinExe")]
    d = spark.createDataFrame(rows, "refs array<string>, web boolean, forms boolean, out string")
    k = P.kind(F.col("refs"), F.col("web"), F.lit(False), F.lit(False), F.col("forms"), F.lit(False), F.col("out"))
    assert [r[0] for r in d.select(k).collect()] == ["Test", "Library", "Web", "WinForms", "Console"]


def test_characterize(tmp_path, monkeypatch):
    (tmp_path / "sample_mod.py").write_text(
        "import time\nclass S:\n    def doubled(self, x: int) -> int:\n        return 2 * x\n    def shout(self, s: str) -> str:\n        return s[0].upper()\n    def ignore(self, x: int) -> None:\n        pass\n"
        "    def takes(self, x: list) -> int:\n        return 1\ndef now(x: int) -> float:\n    return time.perf_counter()\ndef pair(a: int, s: str) -> dict:\n    return {'a': a, 's': s}\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    r = characterize.run("sample_mod")
    assert {t.name for t in r.targets} == {"S.doubled", "S.shout", "now", "pair"} and not r.failed
    assert dict(r.refusals) == {"returns nothing": 1, "unsupported parameter": 1, "not repeatable": 4}
    assert characterize.verify(r.source) == [] and "IndexError" in r.source
    assert characterize.verify(r.source.replace("== '84'", "== '85'")) == ["test_s_doubled_3"]
    (tmp_path / "sample_values.py").write_text(
        "import datetime\nfrom decimal import Decimal\nfrom uuid import UUID\ndef day(d: datetime.date) -> datetime.date:\n    return d\ndef at(t: datetime.datetime, by: datetime.timedelta) -> datetime.datetime:\n    return t + by\n"
        "def twice(x: Decimal) -> Decimal:\n    return 2 * x\ndef name(u: UUID) -> UUID:\n    return u\ndef size(r: range, b: bytearray, c: complex, t: datetime.time) -> int:\n    return len(r) + len(b)\n"
    )
    v = characterize.run("sample_values")
    assert {t.name for t in v.targets} == {"day", "at", "twice", "name", "size"} and len(v.cases) == 11 and not v.failed and not v.skipped
    assert len(characterize.cases([int, str, bool], 6)) == 4 and characterize.cases([]) == [[]]


def test_files_of_one_task_are_parsed_by_several(spark):
    """A scan of one task deals its files out by path before they are parsed."""
    from lodeworks.operators import csharp

    files = spark.range(400).coalesce(1).selectExpr("concat('T', id, '.cs') AS path", "concat('class T', id, ' { int M() { return 1; } }') AS content")
    for made in (csharp.types(files), csharp.metrics(files)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.index("MapInPandas") < plan.index("hashpartitioning(path") and made.count() == 400


def test_files_are_parsed_in_the_sessions_partitions(spark):
    """A number of partitions that is given stays; adaptive execution would leave about a task for each core."""
    from lodeworks.operators import csharp
    from lodeworks.sources import projects as source

    files = spark.range(40).coalesce(1).selectExpr("concat('T', id, '.cs') AS path", "concat('class T', id, ' { }') AS content")
    for made in (csharp.types(files), csharp.metrics(files), source.parsed(files)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan


def test_tokens_in_one_pass():
    from lodeworks.operators import csharp

    assert csharp.tokens('a$$"""x "" y""" + @"p""q" ?? \'c\' // no\n/* no') == ["a", '""', "+", '""', "??", '""']
    assert csharp.tokens('x = """ open') == ["x", "=", '""'] and csharp.tokens(" ") == [] and csharp.tokens("#if A\nb") == ["b"]
    assert csharp._TOKEN.groups == 3  # one findall, whose tuples tell strings from the rest


def test_selected_relations_are_made_once(spark):
    rels = spark.createDataFrame([("A", "B"), ("A", "C"), ("D", "A")], "from string, to string")
    inside, out = typegraph.split_by_selection(rels, spark.createDataFrame([("A",), ("B",)], "name string"))
    assert [tuple(r) for r in inside.collect()] == [("A", "B")] and [tuple(r) for r in out.collect()] == [("A", "C")]
    assert inside.inputFiles() and set(inside.inputFiles()) == set(out.inputFiles())
