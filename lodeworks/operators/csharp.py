"""C# metrics and type declarations from source text, without a compiler.

A lexer and a tolerant recogniser of declarations and statements. What it can't place it skips, so broken sources are
measured too. Known to be guessed: conditional against nullable ``?``, and declarations in unusual layouts.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.text import code_lines, is_generated, is_test, line_count
from lodeworks.shipping import dealt, ship

# what is skipped, then a string (raw ones end at as many quotes) or a word, a number or an operator, or the end
_TOKEN = re.compile(
    r"""(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|^[ \t]*\#[^\n]*)*+(?:
    (\$*("{3,}).*?(?:\2|\Z)
    |(?:\$@|@\$|@)"(?:[^"]|"")*(?:"|\Z)|\$?"(?:\\.|[^"\\\n])*(?:"|\n|\Z)|'(?:\\.|[^'\\\n])*(?:'|\n|\Z))
    |(@?[^\W\d]\w*
    |\d[\w.]*
    |\?\?=|\?\?|\?\.|\?\[|&&|\|\||=>|::|->|==|!=|<=|>=|.)
    |\Z)""",
    re.X | re.S | re.M,
)
TYPE_WORDS = {"class": "Class", "interface": "Interface", "record": "Record", "struct": "Struct", "enum": "Enum"}
MODIFIERS = set("public private protected internal static abstract sealed partial readonly unsafe new virtual override async extern ref required file volatile const".split())
TEST_ATTRIBUTES = {"Fact", "Theory", "Test", "TestMethod", "TestCase", "TestFixture"}


def tokens(source: str) -> list[str]:
    """Words, numbers and operators; strings and characters are one placeholder each."""
    return [other or '""' for text, _, other in _TOKEN.findall(source) if text or other]


@dataclass
class Method:
    name: str
    complexity: int = 1


@dataclass
class Type:
    name: str
    namespace: str | None
    shape: str
    is_abstract: bool
    bases: list[str]
    members: list[str] = field(default_factory=list)
    complexity: int = 0


class Recogniser:
    """One pass over a file's tokens."""

    def __init__(self, source: str):
        self.t = [*tokens(source), "", "", "", ""]
        self.i = 0
        self.methods: list[Method] = []
        self.types: list[Type] = []
        self.open: list[Method] = []
        self.inside: list[Type] = []
        self.nesting = self.deepest = 0
        self.namespace: str | None = None
        self.attributes: list[str] = []
        while self.t[self.i]:
            self.members("")
            if self.t[self.i]:
                self.i += 1  # a brace too many

    # -- tallies

    def branch(self, n: int = 1, type_too: bool = True) -> None:
        if self.open:
            self.open[-1].complexity += n
        if type_too:
            for x in self.inside:
                x.complexity += 1

    def nested(self, work) -> None:
        self.nesting += 1
        self.deepest = max(self.deepest, self.nesting)
        work()
        self.nesting -= 1

    def member(self, name: str, work) -> None:
        m = Method(name)
        self.open.append(m)
        work()
        self.open.pop()
        self.methods.append(m)

    # -- moving on

    def skip(self, open_: str, close: str) -> None:
        """Past a bracketed part without looking inside."""
        depth = 0
        while self.t[self.i]:
            depth += (self.t[self.i] == open_) - (self.t[self.i] == close)
            self.i += 1
            if depth == 0:
                return

    def attribute_list(self) -> None:
        begin = self.i
        self.skip("[", "]")
        part = self.t[begin + 1 : self.i - 1]
        for k, w in enumerate(part):
            if (k == 0 or part[k - 1] in (",", ":", "]", "[")) and re.match(r"[^\W\d]", w):
                end = k + 1
                while end + 1 < len(part) and part[end] == ".":
                    end += 2
                self.attributes.append("".join(part[k:end]))

    # -- declarations

    def members(self, owner: str) -> None:
        """Declarations up to the closing brace, which is left in place."""
        while (w := self.t[self.i]) and w != "}":
            if w == ";":
                self.i += 1
            elif w == "[":
                self.attribute_list()
            elif w == "namespace":
                self.in_namespace()
            elif w == "{":
                self.i += 1
                self.members("")
                self.i += bool(self.t[self.i])
            else:
                self.declaration(owner)

    def in_namespace(self) -> None:
        begin = self.i + 1
        while self.t[self.i] and self.t[self.i] not in "{;":
            self.i += 1
        self.namespace = "".join(self.t[begin : self.i])
        if self.t[self.i] == "{":
            self.i += 1
            self.members("")
            self.i += bool(self.t[self.i])
        else:
            self.i += bool(self.t[self.i])

    def declaration(self, owner: str) -> None:
        begin = self.i
        mods = set()
        while self.t[self.i] in MODIFIERS:
            mods.add(self.t[self.i])
            self.i += 1
        w, after = self.t[self.i], self.t[self.i + 1] if self.t[self.i] else ""
        if w in TYPE_WORDS and re.match(r"@?[^\W\d]", after) and after not in ("where",):
            self.type_(mods)
            return
        name, args, depth = "", False, 0
        while (w := self.t[self.i]) and not (depth == 0 and w in ("{", ";", "=>", "=", "}")):
            if w == "(" and depth == 0 and not args:
                name = self.named_before(begin)
                args = True
                self.skip("(", ")")
                continue
            if w == "[" and depth == 0 and self.i > begin:
                self.skip("[", "]")
                continue
            depth += (w in "<([") - (w in ">)]")
            depth = max(depth, 0)
            self.i += 1
        last = self.named_before(begin) if not args else name
        is_delegate = "delegate" in self.t[begin : self.i]
        if "public" in mods and self.inside and last and not is_delegate and last != owner:
            if args and "operator" not in self.t[begin : self.i]:
                self.inside[-1].members.append(f"{last}()")
            elif not args and self.t[self.i] in ("{", "=>") and "event" not in self.t[begin : self.i] and "this" not in self.t[begin : self.i]:
                self.inside[-1].members.append(last)
        w = self.t[self.i]
        if args and not is_delegate and w in ("{", ";", "=>"):
            plain = "operator" not in self.t[begin : self.i] and "~" not in self.t[begin : self.i]
            title = f"{name} (ctor)" if name == owner and owner else name
            if plain:
                self.member(title, self.body)
            else:
                self.body()
        elif w == "{":
            self.i += 1
            self.accessors(last)
        elif w in ("=>", "="):
            self.i += 1
            self.expression({";"})
        self.i += bool(self.t[self.i] == ";")
        if self.i == begin:
            self.i += bool(self.t[begin])

    def named_before(self, begin: int) -> str:
        k = self.i - 1
        if k >= begin and self.t[k] == ">":
            depth = 0
            while k >= begin:
                depth += (self.t[k] == ">") - (self.t[k] == "<")
                k -= 1
                if depth == 0:
                    break
        return self.t[k] if k >= begin and re.match(r"@?[^\W\d]", self.t[k]) else ""

    def type_(self, mods: set[str]) -> None:
        shape = TYPE_WORDS[self.t[self.i]]
        self.i += 1
        if shape == "Record" and self.t[self.i] in ("class", "struct"):
            self.i += 1
        new = Type(self.t[self.i], self.namespace, shape, "abstract" in mods, [])
        self.i += 1
        base, depth, seen = [], 0, False
        while (w := self.t[self.i]) and w not in ("{", ";") and not (w == "where" and depth == 0):
            if w == "(" and depth == 0:
                self.skip("(", ")")
                continue
            depth += (w in "<[") - (w in ">]")
            if w == ":" and depth == 0:
                seen = True
            elif seen:
                if w == "," and depth == 0:
                    new.bases.append("".join(base))
                    base = []
                else:
                    base.append(w)
            self.i += 1
        if base:
            new.bases.append("".join(base))
        while self.t[self.i] and self.t[self.i] not in ("{", ";"):
            self.i += 1
        self.types.append(new)
        if self.t[self.i] == ";":
            self.i += 1
            return
        self.i += bool(self.t[self.i])
        if shape == "Enum":
            depth = 0
            while (w := self.t[self.i]) and not (w == "}" and depth == 0):
                if depth == 0 and self.t[self.i - 1] in ("{", ",", "]") and re.match(r"@?[^\W\d]", w):
                    new.members.append(w)
                depth += (w in "({[") - (w in ")}]")
                self.i += 1
        else:
            self.inside.append(new)
            self.members(new.name)
            self.inside.pop()
        self.i += bool(self.t[self.i])

    def accessors(self, name: str) -> None:
        while (w := self.t[self.i]) and w != "}":
            if w in ("get", "set", "init", "add", "remove") and self.t[self.i + 1] in ("{", "=>", ";"):
                self.i += 1
                if self.t[self.i] == ";":
                    self.i += 1
                else:
                    self.member(f"{name}.{w}", self.body)
            else:
                self.i += 1
        self.i += bool(self.t[self.i])
        if self.t[self.i] == "=":
            self.i += 1
            self.expression({";"})

    def body(self) -> None:
        if self.t[self.i] == "{":
            self.block()
        elif self.t[self.i] == "=>":
            self.i += 1
            self.expression({";"})
            self.i += bool(self.t[self.i] == ";")
        else:
            self.i += bool(self.t[self.i])

    # -- statements

    def block(self) -> None:
        self.i += 1
        while self.t[self.i] and self.t[self.i] != "}":
            self.statement()
        self.i += bool(self.t[self.i])

    def parens(self) -> None:
        if self.t[self.i] == "(":
            self.i += 1
            self.expression({")"})
            self.i += bool(self.t[self.i] == ")")

    def statement(self) -> None:
        begin, w = self.i, self.t[self.i]
        if w == "{":
            self.block()
        elif w in ("if", "while", "for", "foreach"):
            self.i += 1
            self.branch()
            self.nested(lambda: self.controlled(w == "if"))
        elif w == "do":
            self.i += 1
            self.branch(type_too=False)
            self.nested(self.do)
        elif w == "catch":
            self.i += 1
            self.branch()
            self.nested(self.catch)
        elif w == "switch" and self.t[self.i + 1] == "(":
            self.i += 1
            self.parens()
            self.sections()
        elif w in ("else", "try", "finally", "unsafe", "checked", "unchecked") and self.t[self.i + 1] != "(":
            self.i += 1
        elif w in ("lock", "using", "fixed") and self.t[self.i + 1] == "(":
            self.i += 1
            self.parens()
        else:
            self.expression({";", "}"})
            self.i += bool(self.t[self.i] == ";")
        if self.i == begin:
            self.i += bool(w)

    def controlled(self, is_if: bool) -> None:
        self.parens()
        if self.t[self.i] not in ("}", ""):
            self.statement()
        if is_if and self.t[self.i] == "else":
            self.i += 1
            if self.t[self.i] not in ("}", ""):
                self.statement()

    def do(self) -> None:
        if self.t[self.i]:
            self.statement()
        if self.t[self.i] == "while":
            self.i += 1
            self.parens()
            self.i += bool(self.t[self.i] == ";")

    def catch(self) -> None:
        if self.t[self.i] == "(":
            self.skip("(", ")")
        if self.t[self.i] == "when":
            self.i += 1
            self.parens()
        if self.t[self.i] == "{":
            self.block()

    def sections(self) -> None:
        if self.t[self.i] != "{":
            return
        self.i += 1
        while self.t[self.i] and self.t[self.i] != "}":
            labels = 0
            while self.t[self.i] in ("case", "default"):
                labels += 1
                self.i += 1
                self.expression({":"})
                self.i += bool(self.t[self.i] == ":")
            if not labels:
                self.statement()
                continue
            self.branch(labels)
            self.nested(self.section)
        self.i += bool(self.t[self.i])

    def section(self) -> None:
        while self.t[self.i] and self.t[self.i] not in ("}", "case") and not (self.t[self.i] == "default" and self.t[self.i + 1] == ":"):
            self.statement()

    # -- expressions

    def expression(self, ends: set[str]) -> None:
        """Up to one of the ends at this level, which is left in place."""
        while (w := self.t[self.i]) and w not in ends:
            if w in ("&&", "||", "??"):
                self.branch(type_too=False)
                self.i += 1
            elif w in ("(", "[", "?["):
                self.i += 1
                close = ")" if w == "(" else "]"
                self.expression({close, ";"} if w == "(" and "}" not in ends else {close})
                while self.t[self.i] == ";":  # a for's parts
                    self.i += 1
                    self.expression({close, ";"})
                self.i += bool(self.t[self.i] == close)
            elif w == "{":
                before = self.t[self.i - 1]
                if before == "switch":
                    self.arms()
                elif before in ("=>", ")") or before == "delegate":
                    self.block()
                else:
                    self.i += 1
                    self.expression({"}"})
                    self.i += bool(self.t[self.i])
            elif w in (")", "]", "}"):
                return
            elif w == "?" and self.is_conditional():
                self.branch()
                self.i += 1
            else:
                self.i += 1

    def arms(self) -> None:
        self.i += 1
        while self.t[self.i] and self.t[self.i] != "}":
            self.expression({"=>", ","})
            if self.t[self.i] == "=>":
                self.branch(type_too=False)
                self.i += 1
                self.expression({","})
            self.i += bool(self.t[self.i] == ",")
        self.i += bool(self.t[self.i])

    def is_conditional(self) -> bool:
        """Is there a colon for this question mark before the expression ends?"""
        depth, waiting = 0, 1
        for k in range(self.i + 1, len(self.t)):
            w = self.t[k]
            if w in ("(", "[", "{", "?["):
                depth += 1
            elif w in (")", "]", "}"):
                depth -= 1
                if depth < 0:
                    return False
            elif depth == 0 and w == "?":
                waiting += 1
            elif depth == 0 and w == ":":
                waiting -= 1
                if waiting == 0:
                    return True
            elif depth == 0 and (w in (";", ",", "") or (w == "=" and k == self.i + 2)):
                return False
        return False

    def attribute_flags(self) -> tuple[bool, bool]:
        generated = any("GeneratedCode" in a for a in self.attributes)
        simple = {a.split(".")[-1] for a in self.attributes}
        return generated, bool(TEST_ATTRIBUTES & (simple | {s.removesuffix("Attribute") for s in simple}))


_SCHEMA = "path string, types int, methods int, complexity int, worst_method_complexity int, worst_method string, max_nesting int, generated_attribute boolean, test_attribute boolean"


def recognised(source: str) -> Recogniser:
    """The recogniser of a source; one nested too deeply to follow counts as empty."""
    limit = sys.getrecursionlimit()
    try:
        sys.setrecursionlimit(max(limit, 20_000))
        return Recogniser(source)
    except RecursionError:
        return Recogniser("")
    finally:
        sys.setrecursionlimit(limit)


def measure(path: str, source: str) -> tuple:
    r = recognised(source)
    worst = max(r.methods, key=lambda m: m.complexity, default=None)
    return (path, sum(t.shape != "Enum" for t in r.types), len(r.methods), sum(m.complexity for m in r.methods), worst.complexity if worst else 0, worst.name if worst else None, r.deepest, *r.attribute_flags())


def metrics(files: DataFrame) -> DataFrame:
    """Metrics of files (path, content): lines, code_lines, types, methods, complexity, worst method, nesting, flags."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(*measure(p, s or ""), s) for p, s in zip(b["path"], b["content"], strict=True)], columns=[c.split()[0] for c in _SCHEMA.split(", ")] + ["content"])

    m = dealt(files).mapInPandas(run, _SCHEMA + ", content string")
    src = F.coalesce("content", F.lit(""))
    return m.select(
        "path", line_count(src).alias("lines"), code_lines(src).alias("code_lines"), "types", "methods", "complexity", "worst_method_complexity", "worst_method", "max_nesting",
        (F.col("generated_attribute") | is_generated(F.col("path"), src)).alias("is_generated"), (F.col("test_attribute") | is_test(F.col("path"))).alias("is_test"),
    )


def types(files: DataFrame) -> DataFrame:
    """(name, namespace, shape, path, pos, is_abstract, base_types, members, complexity) of files (path, content)."""
    ship(files.sparkSession)
    schema = "name string, namespace string, shape string, path string, pos int, is_abstract boolean, base_types array<string>, members array<string>, complexity int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(t.name, t.namespace, t.shape, p, k, t.is_abstract, t.bases, t.members, t.complexity) for p, s in zip(b["path"], b["content"], strict=True) for k, t in enumerate(recognised(s or "").types)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return dealt(files).mapInPandas(run, schema)
