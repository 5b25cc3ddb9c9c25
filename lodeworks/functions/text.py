"""Column functions on paths, lines and source text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks generated code, test files and test suffixes.
GENERATED_FOLDERS = ("web references", "service references", "connected services")
GENERATED_SUFFIXES = (".designer.cs", ".g.cs", ".generated.cs")
GENERATED_BANNERS = ("auto-generated", "autogenerated")
GENERATED_HEAD = 2000
TEST_STEM = "(tests|test|spec)$"
TEST_FOLDERS = ("/tests/", "/test/")
SUBJECT_SUFFIX = "(?i)(tests|test|specs|spec|fixture)$"
LEGACY_FRAMEWORK = "^(v3|v4|net3|net4)"


def _accents() -> tuple[str, str]:
    """Every lower-case Latin letter that decomposes into an ASCII letter and marks, and that letter."""
    pairs = []
    for code in range(0xC0, 0x250):
        c = chr(code)
        base = unicodedata.normalize("NFD", c)[0]
        if base != c and base.isascii() and c == c.lower():
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def fold(text: Column) -> Column:
    """Lower case, Latin accents removed; a text of ASCII alone has none to look for."""
    low = F.lower(text)
    return F.when(F.octet_length(text) == F.length(text), low).otherwise(F.translate(low, ACCENTED, PLAIN))


def index_terms(text: Column) -> Column:
    """Terms of a document for full-text search: folded runs of letters and digits."""
    return F.array_remove(F.split(fold(text), r"[^\p{L}\p{Nd}]+"), "")


def query_terms(text: Column) -> Column:
    """Distinct folded terms of a question that are longer than one character; an empty array for none."""
    return F.array_distinct(F.filter(F.split(fold(text), r"[^\p{L}\p{Nd}]+"), lambda x: F.length(x) > 1))


def content_hash(text: Column) -> Column:
    """Upper-case hexadecimal SHA-256 of the UTF-8 text without a byte order mark."""
    return F.upper(F.sha2(F.regexp_replace(text, "^﻿", ""), 256))


def chunk_id(path: Column, line: Column) -> Column:
    return F.concat(path, F.lit("#"), line.cast("string"))


def embedding_text(path: Column, content: Column) -> Column:
    return F.concat(F.lit("File: "), path, F.lit("\n\n"), content)


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def is_generated(path: Column, source: Column) -> Column:
    """Is this generated code, by folder, file suffix or a banner among the first characters?"""
    low, head = F.lower(path), F.lower(F.substring(source, 1, GENERATED_HEAD))
    found = F.lit(False)
    for x in GENERATED_FOLDERS:
        found = found | F.contains(low, F.lit(x))
    for x in GENERATED_SUFFIXES:
        found = found | F.endswith(low, F.lit(x))
    for x in GENERATED_BANNERS:
        found = found | F.coalesce(F.contains(head, F.lit(x)), F.lit(False))
    return found


def is_test(path: Column) -> Column:
    """Does the stem end like a test's, or a folder hold tests? Paths are relative; a leading slash is assumed."""
    low = F.concat(F.lit("/"), F.lower(F.translate(path, "\\", "/")))
    return stem(low).rlike(TEST_STEM) | F.contains(low, F.lit(TEST_FOLDERS[0])) | F.contains(low, F.lit(TEST_FOLDERS[1]))


def tested_subject(path: Column) -> Column:
    """The stem a test file is about; empty if nothing is left."""
    return F.regexp_replace(F.regexp_replace(stem(path), SUBJECT_SUFFIX, ""), r"[_ .]+$", "")


def is_legacy_framework(framework: Column) -> Column:
    return F.coalesce(framework.rlike(LEGACY_FRAMEWORK), F.lit(False))


def looks_like_interface(name: Column) -> Column:
    return name.rlike(r"^I\p{Lu}")


def simple_base(name: Column) -> Column:
    """A base type's name without type arguments and qualifiers."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"^(.+?)<.*$", "$1"), r"^.*\.", ""))


def line_count(source: Column) -> Column:
    """Pieces between newlines: a trailing newline counts one more."""
    return F.size(F.split(source, "\n", -1))


def read_lines_count(source: Column) -> Column:
    """Lines as a reader yields them: any of CR, LF and CR LF ends one and a trailing end adds none."""
    whole = F.regexp_replace(source, "\r\n|\r", "\n")
    return F.when(F.length(whole) == 0, 0).otherwise(F.size(F.split(F.regexp_replace(whole, "\n$", ""), "\n", -1)))


def code_lines(source: Column) -> Column:
    """Lines that hold code: not blank, no line comment, not in a block comment.

    A line that opens a block comment at its start, or that a block comment ends on, doesn't count.
    """
    zero = F.struct(F.lit(0).alias("n"), F.lit(False).alias("inside"))

    def step(a: Column, raw: Column) -> Column:
        x = F.trim(raw, F.lit(" \t\x0b\f\r"))
        opens = F.startswith(x, F.lit("/*"))
        counts = ~a["inside"] & (x != "") & ~F.startswith(x, F.lit("//")) & ~opens
        inside = F.when(a["inside"], ~F.contains(x, F.lit("*/"))).when(opens, ~F.contains(x, F.lit("*/"))).otherwise(False)
        return F.struct((a["n"] + counts.cast("int")).alias("n"), inside.alias("inside"))

    return F.aggregate(F.split(source, "\n", -1), zero, step, lambda a: a["n"])


def brace_delta(line: Column) -> Column:
    """Opening less closing braces on a line."""
    return F.length(F.regexp_replace(line, r"[^{]", "")) - F.length(F.regexp_replace(line, r"[^}]", ""))


def boundary_quality(line: Column, depth: Column) -> Column:
    """How good it is to cut after a line: blank at depth 0, 1 or deeper, then a closing brace, then anything."""
    blank = F.coalesce(line, F.lit("")).rlike(r"^\s*$")
    return F.when(blank, F.when(depth == 0, 4).when(depth == 1, 3).otherwise(2)).when(line.rlike(r"\}\s*$"), 1).otherwise(0)


def layer(path: Column) -> Column:
    """The third part of a path from its end, if it has so many."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.when(F.size(parts) >= 3, F.element_at(parts, -3))


def counted(n: Column, unit: str) -> Column:
    """A number with separators and its unit, in the plural but for one."""
    many = unit[:-1] + "ies" if unit.endswith("y") and unit[-2:-1] not in "aeiou" else unit + "s"
    return F.concat(F.format_number(n, 0), F.lit(" "), F.when(n == 1, unit).otherwise(many))
