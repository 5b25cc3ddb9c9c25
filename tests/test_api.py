from __future__ import annotations

from lodeworks.functions.embedding import HashEmbedder
from lodeworks.plans.api import Engine, blocks


class Chat:
    def stream(self, prompt):
        yield "yes"

    def complete(self, prompt):
        return "yes"


def test_engine(spark, tmp_path):
    src = tmp_path / "src" / "Core"
    src.mkdir(parents=True)
    (src / "Core.csproj").write_text('<Project Sdk="Microsoft.NET.Sdk"><PropertyGroup><TargetFramework>net8.0</TargetFramework></PropertyGroup></Project>')
    (src / "Engine.cs").write_text("namespace N;\nclass Base { }\nclass Engine : Base { public int Go() { return 1; } }\n")
    e = Engine(spark, str(tmp_path / "index"), HashEmbedder(32), Chat())
    assert e.health()["chunks"] == 0
    assert e.ingest(str(tmp_path / "src"))["files_read"] == 1 and e.health() == {"status": "ok", "chunks": 1, "files": 1, "snapshot": 1}
    assert e.ask("Engine Go", floor=0.0)["answer"] == "yes" and list(e.ask_stream("Engine Go", floor=0.0))[-1].startswith("event: done")
    assert e.excerpt("Core/Engine.cs", 1)["end_line"] == 4 and e.excerpt("Core/Engine.cs", 9) is None
    assert "Base <|-- Engine" in e.diagram(str(tmp_path / "src"), namespace="N")
    e.delete_index()
    assert e.health()["chunks"] == 0


def test_blocks():
    assert blocks("one `x` two\n\nthree\n```cs\nvar a;\n```\nend") == [("text", "one "), ("inline", "x"), ("text", " two"), ("text", "three"), ("code", "var a;"), ("text", "end")]
    assert blocks("a\n```\nopen") == [("text", "a"), ("code", "open")] and blocks("") == []
