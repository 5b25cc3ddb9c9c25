"""Relations between declared types, and what surrounds one.

types: name, namespace, shape (Class, Interface, Record, Struct, Enum), path, pos, base_types, members, complexity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.text import looks_like_interface, simple_base
from lodeworks.shipping import kept


def shapes(types: DataFrame) -> DataFrame:
    """(name, shape) of the first declaration of each name, by path and place."""
    w = Window.partitionBy("name").orderBy("path", "pos")
    return types.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("name", "shape")


def _bases(types: DataFrame) -> DataFrame:
    rows = types.select(F.col("name").alias("from"), F.col("shape").alias("from_shape"), F.posexplode("base_types").alias("at", "written"))
    rows = rows.withColumn("to", simple_base(F.col("written"))).where("to <> ''")
    known = shapes(types).select(F.col("name").alias("_to"), F.col("shape").alias("to_shape"))
    return rows.join(known, rows["to"] == known["_to"], "left").drop("_to")


def relations(types: DataFrame) -> DataFrame:
    """(from, to, kind, declared), distinct: Implements or Inherits.

    A declared target that is an interface is implemented, unless an interface extends it. Of an undeclared one the
    place in the list and the name decide. Interfaces and declared classes are inherited.
    """
    b = _bases(types)
    interface = F.when(F.col("to_shape").isNotNull(), F.col("to_shape") == "Interface").otherwise((F.col("at") > 0) | looks_like_interface(F.col("to")))
    kind = F.when((F.col("from_shape") != "Interface") & interface, "Implements").otherwise("Inherits")
    return b.select("from", "to", kind.alias("kind"), F.col("to_shape").isNotNull().alias("declared")).distinct()


def unresolved(types: DataFrame) -> DataFrame:
    """(name): bases that no file declares, in binary order of name."""
    return _bases(types).where("to_shape is null").select(F.col("to").alias("name")).distinct()


def around(types: DataFrame, rels: DataFrame, name: str) -> DataFrame:
    """The types one relation away from a name, in either direction, and itself."""
    near = rels.where((F.col("from") == name) | (F.col("to") == name)).select(F.explode(F.array("from", "to")).alias("name")).distinct()
    near = near.unionByName(types.where(F.col("name") == name).select("name")).distinct()
    return types.join(near, "name", "left_semi")


def split_by_selection(rels: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations with both ends among the chosen names, and those that leave it."""
    c = chosen.select("name").distinct()
    mine = kept(rels.join(c.withColumnRenamed("name", "from"), "from", "left_semi"), "relations")  # rels are made once for both
    other = c.withColumnRenamed("name", "to")
    return mine.join(other, "to", "left_semi").select(rels.columns), mine.join(other, "to", "left_anti").select(rels.columns)
