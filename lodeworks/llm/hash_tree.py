"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

The tree has a place for every shard that there may ever be, with the most weight that the place can hold. A key draws
a region, in it a rack and in that a shard's place, each by a weighted hash draw with odds in proportion to what the
subtrees can hold, and stays with odds of the place's weight to the most it can hold. Otherwise it draws again, with the
number of the attempt. What a subtree can hold never changes, so when a weight does, only keys that drew this very place
are concerned: a heavier or new shard takes rows only into itself, a lighter one gives rows only out of itself (law
``key``). Shards get rows in proportion to their weights.

A key that found no place in ``ATTEMPTS`` attempts goes to the shard of least exponential draw, -ln(u) / weight: one draw
for each shard, for few keys, with the same law. A new shard whose place is beyond the tree takes of those keys only, so
the tree should be laid out for the shards to come; a larger tree is a new layout and moves rows.

Only DataFrame functions are used. The single shuffle deals slim rows by (shard, bucket of the row).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.llm.shared import quoted, stored

#: Draws through the tree before a key takes the least draw of all shards; at half full, one key in 4,096 does.
ATTEMPTS = 12


@dataclass(frozen=True)
class Node:
    """A shard's place in the tree and its weight, or the most weight the place can hold."""

    shard: int
    rack: str
    region: str
    weight: float = 1.0


def layout(shards: int, per_rack: int = 4, racks_per_region: int = 5) -> list[Node]:
    """An even tree: shards fill racks and racks fill regions in turn. A shard's place doesn't depend on the count."""
    return [Node(i, f"rack{i // per_rack}", f"region{i // per_rack // racks_per_region}") for i in range(shards)]


def _unit(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of hash; the same on any machine."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts, F.lit(seed)), 12)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def _literal(x: object) -> str:
    """A nested list of numbers as SQL: one expression, however long."""
    if isinstance(x, list):
        return f"array({', '.join(map(_literal, x))})" if x else "cast(array() as array<double>)"
    return f"{x!r}D" if isinstance(x, float) else str(x)


def least(nodes: list[Node], key: Column, seed: int) -> Column:
    """The shard of least exponential draw; ties go to the smaller shard."""
    every = F.arrays_zip(F.expr(_literal([n.shard for n in nodes])).alias("shard"), F.expr(_literal([float(n.weight) for n in nodes])).alias("weight"))
    return F.array_min(F.transform(every, lambda n: F.struct((-F.ln(_unit(seed, key, n["shard"])) / n["weight"]).alias("draw"), n["shard"].alias("shard"))))["shard"]


def _cuts(weights: list[float]) -> list[float]:
    """Where the ranges of (0, 1) end that are in proportion to weights, but for the last."""
    total, below, out = sum(weights), 0.0, []
    for w in weights[:-1]:
        below += w
        out.append(below / total)
    return out


def draw(key: Column, attempt: Column, live: dict[int, float], places: list[Node], seed: int) -> Column:
    """The shard whose place a key draws in an attempt, or null where it can't stay there."""
    tree: dict[str, dict[str, list[Node]]] = {}
    for n in places:
        tree.setdefault(n.region, {}).setdefault(n.rack, []).append(n)
    racks = [list(r.values()) for r in tree.values()]
    held = lambda nodes: sum(float(n.weight) for n in nodes)
    u = lambda level: _unit(seed, key, attempt, F.lit(level))
    pick = lambda cuts, level: F.size(F.filter(cuts, lambda x: x <= u(level)))
    region = pick(F.expr(_literal(_cuts([sum(map(held, r)) for r in racks]))), 0)
    rack = pick(F.get(F.expr(_literal([_cuts([held(nodes) for nodes in r]) for r in racks])), region), 1)
    place = pick(F.get(F.get(F.expr(_literal([[_cuts([float(n.weight) for n in nodes]) for nodes in r] for r in racks])), region), rack), 2)
    at = lambda table: F.get(F.get(F.get(F.expr(_literal(table)), region), rack), place)
    odds = at([[[float(live.get(n.shard, 0.0) / n.weight) for n in nodes] for nodes in r] for r in racks])
    return F.when(u(3) < odds, at([[[n.shard for n in nodes] for nodes in r] for r in racks]))


def descend(key: Column, tree: list[Node], places: list[Node] | None = None, seed: int = 0) -> Column:
    """The shard of a key, for shards of these weights in a tree of these places (without any: the shards' own).

    A null key is a key like any other. Nodes of weight 0 or less get nothing; a weight beyond its place is refused.
    """
    live = sorted((n for n in tree if n.weight > 0), key=lambda n: n.shard)
    if not live:
        raise ValueError("no node has a positive weight")
    places = [p for p in (places or live) if p.weight > 0]
    most = {p.shard: p.weight for p in places}
    if over := [n.shard for n in live if n.weight > most.get(n.shard, n.weight)]:
        raise ValueError(f"shards {over} are heavier than their places")
    weights = {n.shard: n.weight for n in live}
    found = F.aggregate(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), F.lit(None).cast("int"), lambda at, k: F.coalesce(at, draw(key, k, weights, places, seed)))
    return F.coalesce(found, least(live, key, seed))


def shard(docs: DataFrame, tree: list[Node], grown: list[Node] | None = None, places: list[Node] | None = None, key: str = "doc_id", text: str = "text", seed: int = 0, bucket_rows: int = 1024) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard), one row for each row of docs.

    size is the text's UTF-8 bytes plus 16; a null text has none and the checksum of no bytes, 0. slot counts a
    shard's rows from 0 without gaps, by bucket of the row and then by key; rows that are equal in key and text take
    slots next to each other. grown_shard is the shard in the tree ``grown``, null without one. ``places`` is the tree that both are
    laid out in: without it, the larger one of the two. Other columns aren't looked at.

    A shard's rows are numbered in buckets of about ``bucket_rows`` rows; a bucket's first slot is a sum of counts. Key
    and text deal the buckets, so a key (or null) that many rows share, with texts of their own, is no bucket of its own.
    """
    k, t = F.col(quoted(key)), F.col(quoted(text))
    places = places or max(tree, grown or [], key=len)
    rows = docs.count()
    buckets = max(1, -(-rows // (bucket_rows * len(tree))))
    slim = docs.select(
        k.alias("k"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"),
        descend(k, tree, places, seed).alias("shard"),
        (descend(k, grown, places, seed) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    slim = slim.withColumn("bucket", F.pmod(F.xxhash64("k", "size", "text_crc32", F.lit(seed + 1)), F.lit(buckets)))
    slim = stored(slim, "sharded")
    counts = slim.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard", "bucket").orderBy("k", "text_crc32", "size")
    placed = slim.withColumn("row", F.row_number().over(own) - 1).join(first, ["shard", "bucket"])
    return placed.select(F.col("k").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("row")).cast("long").alias("slot"), "grown_shard")
