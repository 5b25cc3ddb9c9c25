"""What the operators share: tables in the shared folder, size-checked broadcasts and connected components."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.shipping import work_folder

#: Most bytes that a side may have, by its row count and width, to be broadcast.
BROADCAST_BYTES = 48 << 20


#: Tables made by ``stored`` and not yet deleted.
MADE: list[DataFrame] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table of its own in the shared folder and read it back: lineage ends here, and a lost executor
    costs a reread only. ``forget`` deletes the result; what is left when the driver ends goes then."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/lodeworks/{name}-{uuid.uuid4().hex}"
    if not MADE:
        atexit.unregister(_end)
        atexit.register(_end, spark._jvm, spark._jsc.hadoopConfiguration())
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodeworks_path = path
    MADE.append(out)
    return out


def _end(jvm, conf) -> None:
    """Delete what is left."""
    with contextlib.suppress(Py4JError, OSError):  # the JVM may have ended before
        for t in MADE:
            p = jvm.org.apache.hadoop.fs.Path(t._lodeworks_path)
            p.getFileSystem(conf).delete(p, True)
    MADE.clear()


def forget(*tables: DataFrame | None) -> None:
    """Delete tables made by ``stored`` which no later plan reads."""
    for t in tables:
        if path := getattr(t, "_lodeworks_path", None):
            jvm, spark = t.sparkSession._jvm, t.sparkSession
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
            MADE[:] = [m for m in MADE if m is not t]


def forget_since(mark: int, *keep: DataFrame) -> None:
    """Delete the tables made since ``len(MADE)`` was ``mark``, but for some; results that still read them end."""
    forget(*[t for t in MADE[mark:] if not any(t is k for k in keep)])


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted rows fit the bound, else unchanged: the join then shuffles."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def repeats(df: DataFrame, *names: str) -> bool:
    """Do any two rows of df agree in these columns?"""
    return not df.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).isEmpty()


def quoted(name: str) -> str:
    """A column's name as Spark reads it whole, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has; Spark's names know no case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: (node, label), label the least node reached.

    Large-star and small-star steps in turn (Kiveris et al., 2014). Each minimum is a partially aggregated groupBy
    joined back, so a node with very many edges is split by the adaptive skew join and never gathered.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = stored(e, "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(down, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        new = stored(star, "edges")
        after = tuple(new.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        forget(e)
        e = new
        if after == before:
            break
        before = after
    ends = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return ends.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
