"""Diagrams as tables of numbered lines (line_no, line): projects by layer, and types with their members.

Lines are made where their projects, types and arrows are, sorted by ranges and numbered by sums of counts, and
identifiers that collide are settled by rounds of windows. So a diagram of any size stays a table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.text import layer
from lodeworks.operators import projects as P
from lodeworks.operators import typegraph
from lodeworks.shipping import kept

MAX_MEMBERS = 8


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with line_no, their place from 1 in an order, instead of the order's columns; no task sees them all.

    The rows are written sorted by ranges of the order. A row's place is its place in its range after the counts of the
    ranges before, of which there are no more than shuffle partitions.
    """
    rest = [c for c in rows.columns if c not in order]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*rest, F.monotonically_increasing_id().alias("_at"))
    placed = kept(placed, "lines").withColumn("_range", F.shiftright("_at", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), "_range").select((F.col("_start") + inside + 1).alias("line_no"), *rest)


def identifiers(names: DataFrame, prefix: str) -> DataFrame:
    """(name, id): names (name, at) as identifiers, each another one: characters but letters and digits become _, and
    of names that would share one, the first by at keeps it and the others try _2, _3 and so on.

    The result is that of taking the names in order, one by one, each the first of its candidates that is free. Here
    all ask at once: a candidate goes to the first name that asks, who loses asks for the next, and so do the names
    behind it that began with the same characters. Rounds end when no two ask for the same, mostly after one.
    """
    rows = names.groupBy("name").agg(F.min("at").alias("at"))
    rows = rows.withColumn("base", F.concat(F.lit(prefix), F.regexp_replace("name", r"[^\p{L}\p{Nd}]", "_")))
    alike = Window.partitionBy("base").orderBy("at", "name")
    rows = rows.withColumn("turn", F.row_number().over(alike)).withColumn("try", F.col("turn"))
    while True:
        asked = F.when(F.col("try") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", "try"))
        rows = kept(rows.withColumn("id", asked).withColumn("lost", F.row_number().over(Window.partitionBy("id").orderBy("at", "name")) > 1), "names")
        if rows.where("lost").isEmpty():
            return rows.select("name", "id")
        behind = alike.rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("try", F.col("turn") + F.max(F.col("try") + F.col("lost").cast("int") - F.col("turn")).over(behind)).drop("id", "lost")


def quoted(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit("&quot;"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _line(rows: DataFrame, section: int, line: Column, **order: Column) -> DataFrame:
    """Lines of a section, with the columns that order them: a, part, size, b and c, where not given the least."""
    least = {"a": F.lit(""), "part": F.lit(0), "size": F.lit(0).cast("long"), "b": F.lit(""), "c": F.lit(0).cast("long")}
    return rows.select(F.lit(section).alias("section"), *[order.get(k, v).alias(k) for k, v in least.items()], line.alias("line"))


def _lines(parts: list[DataFrame]) -> DataFrame:
    return numbered(reduce(DataFrame.unionByName, parts), ["section", "a", "part", "size", "b", "c"]).select("line_no", "line")


def solution(projects: DataFrame, edges: DataFrame, min_lines: int = 500, include_tests: bool = False) -> DataFrame:
    """(line_no, line): a graph of projects by layer, the largest first, with their dependencies; last, how many were
    left out. A dependency written in another case than its project leads to the project."""
    spark = projects.sparkSession
    seen = projects.where((F.col("lines") >= min_lines) & (F.lit(include_tests) | (F.col("kind") != "Test")))
    seen = seen.select("name", "lines", F.coalesce(layer(F.col("path")), F.lit("")).alias("layer"))
    seen = kept(seen, "boxes")
    layers = seen.where("layer <> ''").select("layer").distinct()
    groups = identifiers(layers.select(F.col("layer").alias("name"), F.col("layer").alias("at")), "g").withColumnRenamed("name", "layer")
    at = F.struct("layer", (-F.col("lines")).alias("size"), "name")
    nodes = identifiers(seen.select("name", at.alias("at")), "n")
    drawn = kept(seen.join(nodes, "name"), "drawn")
    ends = drawn.groupBy(F.lower("name").alias("key")).agg(F.min_by("id", at).alias("id"))
    arrows = P.diagram_edges(projects, edges, min_lines, include_tests)
    arrows = arrows.join(ends.select(F.col("key").alias("_f"), F.col("id").alias("source")), F.lower("from") == F.col("_f")).join(ends.select(F.col("key").alias("_t"), F.col("id").alias("target")), F.lower("to") == F.col("_t"))
    inset = F.when(F.col("layer") == "", "    ").otherwise("        ")
    left = projects.agg(F.count(F.lit(1)).alias("total")).crossJoin(F.broadcast(seen.agg(F.count(F.lit(1)).alias("shown")))).where("total > shown")  # one row each
    name = F.col("layer")
    return _lines([
        _line(spark.range(1), 0, F.lit("graph LR")),
        _line(groups, 1, _text("    subgraph ", F.col("id"), '["', quoted(name), '"]'), a=name, part=F.lit(0)),
        _line(drawn, 1, _text(inset, F.col("id"), '["', quoted(F.col("name")), "<br/>", F.format_number("lines", 0), ' lines"]'), a=name, part=F.lit(1), size=-F.col("lines"), b=F.col("name")),
        _line(groups, 1, F.lit("    end"), a=name, part=F.lit(2)),
        _line(arrows, 2, _text("    ", F.col("source"), " --> ", F.col("target")), a=F.col("from"), b=F.col("to")),
        _line(left, 3, _text("    %% ", (F.col("total") - F.col("shown")).cast("string"), " of ", F.col("total").cast("string"), " projects are not drawn")),
    ])


def class_diagram(types: DataFrame, relations: DataFrame, namespace: str | None = None, around: str | None = None, max_members: int = MAX_MEMBERS) -> DataFrame:
    """(line_no, line): the types of a namespace, or around one type, by name with their first members, and the
    relations among them; last, how many lead out. Of types of one name the first by path and place is drawn."""
    spark = types.sparkSession
    chosen = typegraph.around(types, relations, around) if around else types.where(F.col("namespace") == namespace) if namespace is not None else types
    first = Window.partitionBy("name").orderBy("path", "pos")
    drawn = chosen.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("name", "shape", "is_abstract", "members")
    inner, outer = typegraph.split_by_selection(relations, chosen)
    ids = identifiers(drawn.select("name", F.col("name").alias("at")), "")
    drawn = kept(drawn.join(ids, "name"), "types")
    arrows = inner.join(ids.select(F.col("name").alias("from"), F.col("id").alias("child")), "from").join(ids.select(F.col("name").alias("to"), F.col("id").alias("base")), "to")
    mark = F.when(F.col("shape") == "Interface", "interface").when(F.col("shape") == "Enum", "enumeration").when(F.col("shape") == "Record", "record").when(F.col("shape") == "Struct", "struct").when(F.col("is_abstract"), "abstract")
    members = drawn.select("name", F.posexplode(F.slice("members", 1, max_members)).alias("pos", "member"))
    over = drawn.where(F.size("members") > max_members)
    shown = F.regexp_replace("member", "[{}<>~]", "")
    sign = F.when(F.col("kind") == "Implements", " <|.. ").otherwise(" <|-- ")
    name = F.col("name")
    return _lines([
        _line(spark.range(1), 0, F.lit("classDiagram")),
        _line(drawn, 1, _text("    class ", F.col("id"), " {"), a=name, part=F.lit(0)),
        _line(drawn.where(mark.isNotNull()), 1, _text("        <<", mark, ">>"), a=name, part=F.lit(1)),
        _line(members, 1, _text("        +", shown), a=name, part=F.lit(2), c=F.col("pos").cast("long")),
        _line(over, 1, _text("        +", (F.size("members") - max_members).cast("string"), " more"), a=name, part=F.lit(3)),
        _line(drawn, 1, F.lit("    }"), a=name, part=F.lit(4)),
        _line(arrows, 2, _text("    ", F.col("base"), sign, F.col("child")), a=F.col("from"), b=F.concat_ws("\n", "to", "kind")),
        _line(outer.agg(F.count(F.lit(1)).alias("n")).where("n > 0"), 3, _text("    %% ", F.col("n").cast("string"), " relations lead out of this selection")),
    ])
