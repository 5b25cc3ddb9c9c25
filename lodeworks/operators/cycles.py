"""Cycles and strongly connected components of a directed graph, by rounds of joins.

An edge (a, b, via) is a path from a to b through nodes that have no other edge. A round of ``_reduce`` drops edges that
begin or end nowhere and joins the two edges of nodes with one in and one out, so trees and chains are gone after a
logarithm of their depth. What is left gets two labels a node, the first that reaches it and the first that it reaches,
in an order that changes; where they are one, it is of that node's component. Distances back to a component's least node
give its shortest cycle.

Those rounds are as many as the graph is deep. So a graph of more edges than one task finishes is first cut into blocks
of nodes with neighbouring names, for as long as that makes it much smaller: a task contracts the components inside its
block and leaves of the rest which of the block's entries reach which of its exits. What the small graph's components are
goes back block by block. Any cut gives the same result; names that say nothing about edges leave the rounds alone.

Every table is written to the shared folder, which ends its lineage; the one before goes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.shipping import discard, scratch, ship

#: Most edges, nodes passed on the way counted, that one task finishes; more are taken by rounds of joins.
FINISH = 1 << 16
#: Most bytes that a block's sets of exits may have; a block with more only contracts its components.
REACH_BYTES = 1 << 27


class _Tables:
    """Tables of one search in one folder of the shared one."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder, self.n = spark, scratch(spark, name), 0

    def write(self, df: DataFrame, *before: DataFrame) -> DataFrame:
        """df, written and read again; tables that only it needed go."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lodeworks_at = path
        for old in before:
            if at := getattr(old, "_lodeworks_at", None):
                discard(self.spark, at)
        return out


def _length(via: str = "via") -> Column:
    return F.size(via) + 1


def _size(edges: DataFrame) -> tuple[int, int]:
    """(edges, edges with each node on the way counted)."""
    n, long = edges.agg(F.count(F.lit(1)), F.sum(_length())).first()
    return n, long or 0


def _reduce(t: _Tables, edges: DataFrame, finish: int) -> tuple[DataFrame, int]:
    """The edges that may lie on a cycle, chains as one edge each, and their size; ends early at a size of ``finish``."""
    n, long = _size(edges)
    turn = 0
    while long > finish:
        turn += 1
        own = F.col("a") == F.col("b")
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), own.alias("own")), F.struct(F.col("b").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), own.alias("own")))).alias("e")).select("e.*")
        nodes = ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.max("own").alias("own"))
        nodes = nodes.where("o > 0 and i > 0").select("node", F.when((F.col("o") == 1) & (F.col("i") == 1) & ~F.col("own"), F.xxhash64("node", F.lit(turn))).alias("h"))
        # inner joins: an edge with an end that leads nowhere goes
        live = edges.join(nodes.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a").join(nodes.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b")
        # each edge names the end that may go, which does if its other edge names it too
        vote = F.when(F.col("hb").isNotNull() & (F.col("ha").isNull() | (F.col("hb") < F.col("ha"))), F.col("b")).when(F.col("ha").isNotNull() & (F.col("hb").isNull() | (F.col("ha") < F.col("hb"))), F.col("a"))
        live = live.select("a", "b", "via", vote.alias("v"))
        edge = F.struct("a", "b", "via")
        pairs = live.where("v is not null").groupBy("v").agg(F.max(F.when(F.col("b") == F.col("v"), edge)).alias("x"), F.max(F.when(F.col("a") == F.col("v"), edge)).alias("y"))
        both = F.struct(F.col("x.a").alias("a"), F.col("y.b").alias("b"), F.concat("x.via", F.array("v"), "y.via").alias("via"))
        joined = pairs.select(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), both).otherwise(F.coalesce("x", "y")).alias("e")).select("e.*")
        edges = t.write(live.where("v is null").select("a", "b", "via").unionByName(joined), edges)
        before = n
        n, long = _size(edges)
        if n == before:
            break
    return edges, long


def _key(node: Column, turn: int) -> Column:
    """A node's place in the order of one turn; nodes are in another order in each."""
    return F.struct(F.xxhash64(node, F.lit(turn)).alias("h"), node.alias("n"))


def _labels(t: _Tables, edges: DataFrame, turn: int, label: str) -> DataFrame:
    """(node, label): the first in the turn's order of the nodes, on the way of edges or not, that reach a node."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    first = edges.groupBy("a", "b").agg(F.min(F.array_min(F.transform("via", lambda v: _key(v, turn)))).alias("m"))
    labels = t.write(nodes.select("node", _key(F.col("node"), turn).alias("l")))
    while True:
        come = first.join(labels, F.col("a") == F.col("node")).select(F.col("b").alias("node"), F.least("l", "m").alias("l"))
        # who reaches what reaches a node reaches it
        far = labels.join(labels.select(F.col("node").alias("n"), F.col("l").alias("next")), F.col("l.n") == F.col("n")).select("node", F.col("next").alias("l"))
        best = labels.withColumn("old", F.col("l")).unionByName(come.unionByName(far), allowMissingColumns=True).groupBy("node").agg(F.min("l").alias("l"), F.min("old").alias("old"))
        new = t.write(best.select("node", "l", (F.col("l") < F.col("old")).alias("moved")), labels)
        labels = new.select("node", "l")
        labels._lodeworks_at = new._lodeworks_at
        if new.where("moved").limit(1).isEmpty():
            out = new.select("node", F.col("l.n").alias(label))
            out._lodeworks_at = new._lodeworks_at
            return out


def _distances(t: _Tables, edges: DataFrame) -> DataFrame:
    """(node, d): length of the shortest way from a node to its root, for those that have one; edges: a, b, via, root."""
    hop = edges.where("a <> root").groupBy("a", "b").agg(F.min(_length()).alias("w"))
    dist = t.write(edges.select(F.col("root").alias("node"), F.lit(0).alias("d")).distinct())
    while True:
        come = hop.join(dist, F.col("b") == F.col("node")).select(F.col("a").alias("node"), (F.col("d") + F.col("w")).alias("d"))
        best = dist.withColumn("old", F.col("d")).unionByName(come, allowMissingColumns=True).groupBy("node").agg(F.min("d").alias("d"), F.min("old").alias("old"))
        new = t.write(best.select("node", "d", (F.col("old").isNull() | (F.col("d") < F.col("old"))).alias("moved")), dist)
        done = new.where("moved").limit(1).isEmpty()
        dist = new.select("node", "d")
        dist._lodeworks_at = new._lodeworks_at
        if done:
            return dist


def _follow(t: _Tables, inner: DataFrame, dist: DataFrame) -> DataFrame:
    """(root, cycle): the shortest way from each root back to it, of equal ones the first by its nodes."""
    to = dist.select(F.col("node").alias("b"), F.col("d").alias("rest"))
    step = F.struct((_length() + F.col("rest")).alias("all"), F.concat("via", F.array("b")).alias("way"), F.col("b"))
    # ways out of one node differ in their first node, or one is a duplicate of the other
    next_ = t.write(inner.join(to, "b").groupBy("a", "root").agg(F.min(step).alias("s")).select("a", "root", "s.way", "s.b"))
    going, found = next_.where("a = root").select("root", F.concat(F.array("root"), "way").alias("cycle"), F.col("b").alias("at")), []
    while True:
        going = t.write(going)
        found.append(going.where("at = root").select("root", "cycle"))
        left = going.where("at <> root")
        if left.limit(1).isEmpty():
            return reduce(DataFrame.unionByName, found)
        going = left.join(next_.select(F.col("a").alias("at"), "way", "b"), "at").select("root", F.concat("cycle", "way").alias("cycle"), F.col("b").alias("at"))


def _parts(t: _Tables, edges: DataFrame, finish: int) -> Iterator[tuple[bool, DataFrame]]:
    """The edges inside components, (part, a, b, via), round by round; or the last, which one task has finished, as
    (root, cycle, members). A node that is reached first of all by the one that it reaches first of all is of its part.
    The others stay with those of the same two labels, which splits them as a quicksort does: rounds are a logarithm."""
    turn = 0
    while True:
        edges, long = _reduce(t, edges, finish)
        if not long:
            return
        if long <= finish:
            yield True, t.write(edges.groupBy().applyInArrow(_finish, "root string, cycle array<string>, members array<string>"), edges)
            return
        turn += 1
        come = _labels(t, edges, turn, "come")
        go = _labels(t, edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "via"), turn, "go")
        label = come.join(go, "node")
        of = lambda s: label.select(F.col("node").alias(s), F.struct("come", "go").alias(f"l{s}"))  # noqa: E731, B023
        same = t.write(edges.join(of("a"), "a").join(of("b"), "b").where("la = lb").select("a", "b", "via", F.col("la.come").alias("part"), (F.col("la.come") == F.col("la.go")).alias("found")), edges, come, go)
        yield False, same.where("found").select("part", "a", "b", "via")
        edges = same.where("not found").select("a", "b", "via")


def _rounds(t: _Tables, edges: DataFrame, finish: int, rings: bool) -> tuple[DataFrame, DataFrame | None]:
    """(members, cycles) of edges (a, b) by rounds of joins: node and component; root and cycle, if they are asked for."""
    spark = t.spark
    e = t.write(edges.select("a", "b", F.array().cast("array<string>").alias("via")))
    inner, done = spark.createDataFrame([], "part string, a string, b string, via array<string>"), spark.createDataFrame([], "root string, cycle array<string>, members array<string>")
    for last, rows in _parts(t, e, finish):
        if last:
            done = rows
        else:
            inner = inner.unionByName(rows)
    members = inner.select("part", F.explode(F.concat(F.array("a", "b"), "via")).alias("node")).distinct()
    roots = members.groupBy("part").agg(F.min("node").alias("root"))
    every = members.join(roots, "part").select("node", F.col("root").alias("component")).unionByName(done.select(F.explode("members").alias("node"), F.col("root").alias("component")))
    if not rings:
        return every, None
    # a root on the way of an edge becomes a node
    at = F.array_position("via", F.col("root")).cast("int")
    cut = F.array(F.struct("a", F.col("root").alias("b"), F.slice("via", F.lit(1), at - 1).alias("via")), F.struct(F.col("root").alias("a"), "b", F.slice("via", at + 1, F.size("via")).alias("via")))
    inner = t.write(inner.join(roots, "part").select("root", F.explode(F.when(at > 0, cut).otherwise(F.array(F.struct("a", "b", "via")))).alias("e")).select("root", "e.*"))
    if inner.limit(1).isEmpty():
        return every, done.select("root", "cycle")
    return every, _follow(t, inner, _distances(t, inner)).unionByName(done.select("root", "cycle"))




def _by_blocks(t: _Tables, edges: DataFrame, n: int, finish: int, block: int) -> DataFrame | None:
    """(node, component) of n edges (a, b), blocks of nodes first; None where most edges lead from block to block."""
    size = max(1, block // 4)
    count = -(-n // size)
    e = edges.select(F.concat(F.lit("n"), "a").alias("a"), F.concat(F.lit("n"), "b").alias("b"))
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct().repartitionByRange(count, F.length("node"), "node")
    nodes = t.write(nodes.select("node", F.spark_partition_id().alias("block")))
    of = lambda end, name: nodes.select(F.col("node").alias(end), F.col("block").alias(name))
    e = t.write(e.join(of("a", "p"), "a").join(of("b", "q"), "b").select("a", "b", "p", "q"), nodes)
    if e.where("p = q").count() * 2 < n:
        return None
    levels: list[tuple[DataFrame, DataFrame]] = []
    while n > finish:
        name = f"h{len(levels)}:"
        # a block of far too many edges, as round a node of very many, is left as it is
        heavy = e.where("p = q").groupBy("p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("p").collect()
        keep = lambda c, heavy=[r.p for r in heavy]: F.when(~F.col(c).isin(heavy), F.col(c)) if heavy else F.col(c)
        e = e.select("a", "b", keep("p").alias("p"), keep("q").alias("q"))
        inner, outer = e.where("p = q"), e.where("p <> q or p is null or q is null")
        exits = outer.where("p is not null").select(F.col("p").alias("block"), "a", F.lit(None).cast("string").alias("b")).distinct()
        entries = outer.where("q is not null").select(F.col("q").alias("block"), F.lit(None).cast("string").alias("a"), "b").distinct()
        rows = inner.select(F.col("p").alias("block"), "a", "b").unionByName(exits).unionByName(entries)
        out = t.write(rows.groupBy("block").applyInArrow(_contracting(name), "kind string, block int, a string, b string"))
        side = lambda kind, end: out.where(F.col("kind") == kind).select(F.col("a").alias(end), F.col("b").alias(f"{end}_"))  # noqa: E731, B023
        far = outer.join(side("exit", "a"), "a", "left").join(side("entry", "b"), "b", "left").where("(p is null or a_ is not null) and (q is null or b_ is not null)")
        far = far.select(F.coalesce("a_", "a").alias("a"), F.coalesce("b_", "b").alias("b"), "p", "q")
        new = t.write(far.unionByName(out.where("kind = 'edge'").select("a", "b", F.col("block").alias("p"), F.col("block").alias("q"))).distinct())
        levels.append((inner, out))
        before, n = n, new.count()
        merge = -(-count // max(1, -(-n // size)))
        count = -(-count // merge)
        e = new.select("a", "b", F.floor(F.col("p") / merge).cast("int").alias("p"), F.floor(F.col("q") / merge).cast("int").alias("q"))
        if n > 0.7 * before:
            break
    # a block's inner edges may have become one edge of contracted nodes twice
    found = _rounds(t, e.select("a", "b").distinct(), finish, False)[0].select("node", F.col("component").alias("label"))
    for k in reversed(range(len(levels))):
        inner, out = levels[k]
        found = t.write(found)
        place = out.where("kind <> 'edge'").select(F.col("b").alias("node"), "block").distinct()
        known = found.join(place, "node").select("block", F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), "label")
        rows = inner.select(F.col("p").alias("block"), "a", "b", F.lit(None).cast("string").alias("label")).unionByName(known)
        inside = rows.groupBy("block").applyInArrow(_expand, "node string, label string")
        # nodes of blocks that were left as they are
        found = inside.unionByName(found.join(place, "node", "left_anti").where(~F.col("node").startswith(f"h{k}:")).join(out.where("kind = 'edge'").select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_anti"))
    found = t.write(found.select(F.substring("node", 2, 1 << 30).alias("node"), "label"))
    return found.join(found.groupBy("label").agg(F.min("node").alias("component")), "label").select("node", "component")


def _search(edges: DataFrame, finish: int, rings: bool, block: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(members, cycles): node and component; root and cycle, if they are asked for. A finish of 0 has no blocks either."""
    spark = edges.sparkSession
    ship(spark)
    t = _Tables(spark, "cycles")
    block = (FINISH if finish else 0) if block is None else block
    e = t.write(edges.select("a", "b").where("a is not null and b is not null").distinct())
    n = e.count()
    every = _by_blocks(t, e, n, finish, block) if block and n > finish else None
    if every is None:
        return _rounds(t, e, finish, rings)
    every = t.write(every)
    if not rings:
        return every, None
    end = lambda s: every.select(F.col("node").alias(s), F.col("component").alias(f"c{s}"))
    inside = t.write(e.join(end("a"), "a").join(end("b"), "b").where("ca = cb").select(F.col("ca").alias("component"), "a", "b"))
    sizes = inside.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    # a task takes several components, each whole; what one task may not hold goes by rounds
    deals = -(-n // max(1, block // 4))
    fits = inside.join(sizes.where(F.col("n") <= block), "component").select("a", "b", F.array().cast("array<string>").alias("via"), F.pmod(F.xxhash64("component"), F.lit(deals)).alias("deal"))
    found = t.write(fits.groupBy("deal").applyInArrow(_finish, "root string, cycle array<string>, members array<string>")).select("root", "cycle")
    large = t.write(inside.join(sizes.where(F.col("n") > block), "component").select("a", "b"))
    return every, found if large.isEmpty() else found.unionByName(_rounds(t, large, finish, True)[1])


def _contracting(name: str) -> Callable[[pa.Table], pa.Table]:
    def contract(table: pa.Table) -> pa.Table:
        return _contract(name, table)

    return contract


def _contract(name: str, table: pa.Table) -> pa.Table:
    """One block without its inside: its components as one node each, and which entries reach which exits.

    Rows with a null b are exits, with a null a entries. Out come (exit or entry, node, its component's least node) for
    those that lie on a way through the block, and edges: entries that reach the same exits share a node, and so do exits
    that are reached from the same; where the contracted edges on a way through are no more, those.
    """
    block = table.column("block")[0].as_py()
    after: dict[str, list[str]] = {}
    entries: list[str] = []
    exits: list[str] = []
    for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True):
        if a is None:
            entries.append(b)
        elif b is None:
            exits.append(a)
        else:
            after.setdefault(a, []).append(b)
    groups = _components(after, list(dict.fromkeys([*after, *entries, *exits])), True)  # those that are reached first
    rep = {x: r for g in groups for r in (min(g),) for x in g}
    into, outof = {rep[x] for x in entries}, {rep[x] for x in exits}
    next_ = {rep[g[0]]: {rep[y] for x in g for y in after.get(x, ())} - {rep[g[0]]} for g in groups}
    leads: set[str] = set()
    for r, targets in next_.items():
        if r in outof or not leads.isdisjoint(targets):
            leads.add(r)
    come = {r for r in into if r in leads}
    for r in reversed(next_):
        if r in come:
            come.update(y for y in next_[r] if y in leads)
    out = [("entry", x, rep[x]) for x in entries if rep[x] in come] + [("exit", x, rep[x]) for x in exits if rep[x] in come]
    edges = [(r, y) for r in next_ if r in come for y in next_[r] if y in come]
    last = sorted(outof & come)
    if len(last) * len(come) // 8 <= REACH_BYTES:
        edges = min(edges, _through(f"{name}{block}:", next_, sorted(into & come), last, come, len(edges)), key=len)
    out += [("edge", a, b) for a, b in edges]
    return pa.table([pa.array([o[0] for o in out], pa.string()), pa.array([block] * len(out), pa.int32()), *(pa.array([o[k] for o in out], pa.string()) for k in (1, 2))], ["kind", "block", "a", "b"])


def _through(name: str, next_: dict[str, set[str]], into: list[str], last: list[str], come: set[str], most: int) -> list[tuple[str, str]]:
    """Edges by which each entry reaches the exits that it reaches over ``next_`` (whose keys follow what they lead to),
    itself left out; or ``most`` and more of them, unfinished."""
    bit = {r: 1 << k for k, r in enumerate(last)}
    beyond: dict[str, int] = {}
    for r, targets in next_.items():
        if r in come:
            m = 0
            for y in targets:
                if y in come:
                    m |= beyond[y] | bit.get(y, 0)
            beyond[r] = m
    same: dict[int, list[str]] = {}
    for r in into:
        if beyond[r]:
            same.setdefault(beyond[r], []).append(r)
    edges: list[tuple[str, str]] = []
    reached: dict[str, list[str]] = {}
    pairs = 0
    for k, (m, members) in enumerate(same.items()):
        pairs += m.bit_count()
        if pairs > 16 * most + 1024:
            return edges + [("", "")] * most
        at = members[0] if len(members) == 1 else f"{name}e{k}"
        edges += [(r, at) for r in members if r != at]
        for j, digit in enumerate(reversed(f"{m:b}")):
            if digit == "1":
                reached.setdefault(last[j], []).append(at)
    alike: dict[tuple[str, ...], list[str]] = {}
    for r, sources in reached.items():
        alike.setdefault(tuple(sources), []).append(r)
    for k, (sources, members) in enumerate(alike.items()):
        if len(sources) * len(members) <= len(sources) + len(members):
            edges += [(s, r) for s in sources for r in members]
        else:
            edges += [(s, f"{name}x{k}") for s in sources] + [(f"{name}x{k}", r) for r in members]
    return edges


def _expand(table: pa.Table) -> pa.Table:
    """(node, label) of one block's nodes that lie on a cycle: rows are its edges and the labels found of its ends."""
    label: dict[str, str] = {}
    edges: list[tuple[str, str]] = []
    for a, b, known in zip(*(table.column(c).to_pylist() for c in ("a", "b", "label")), strict=True):
        if known is None:
            edges.append((a, b))
        else:
            label[a] = known
    # nodes of one label are one node, by a name that no other has
    one = {x: f"l{known}" for x, known in label.items()}
    stands: dict[str, list[str]] = {}
    for x, y in one.items():
        stands.setdefault(y, []).append(x)
    after: dict[str, list[str]] = {}
    for a, b in edges:
        after.setdefault(one.get(a, a), []).append(one.get(b, b))
    out = []
    for group in _components(after, list(dict.fromkeys([*after, *stands])), True):
        known = next((x[1:] for x in group if x in stands), None)
        if known is not None or len(group) > 1 or group[0] in after.get(group[0], ()):
            known = min(group) if known is None else known
            out += [(x, known) for y in group for x in stands.get(y, (y,))]
    return pa.table([pa.array([o[k] for o in out], pa.string()) for k in (0, 1)], ["node", "label"])


def _finish(table: pa.Table) -> pa.Table:
    """One task's search by the same rules, of a graph whose size was counted."""
    after: dict[str, list[str]] = {}
    for a, b, via in zip(*(table.column(c).to_pylist() for c in ("a", "b", "via")), strict=True):
        way = [a, *via, b]
        for x, y in zip(way, way[1:], strict=False):
            after.setdefault(x, []).append(y)
    out: list[tuple[str, list[str], list[str]]] = []
    for group in _components(after, list(after)):
        inside, root = set(group), min(group)
        into: dict[str, list[str]] = {}
        for x in group:
            for y in after[x]:
                if y in inside:
                    into.setdefault(y, []).append(x)
        d, layer = {root: 0}, [root]
        while layer:
            new = []
            for y in layer:
                for x in into.get(y, ()):
                    if x not in d:
                        d[x] = d[y] + 1
                        new.append(x)
            layer = new
        cycle = [root]
        while len(cycle) == 1 or cycle[-1] != root:
            cycle.append(min((y for y in after[cycle[-1]] if y in inside), key=lambda y: (d[y], y)))
        out.append((root, cycle, group))
    return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.list_(pa.string()), pa.list_(pa.string())))], ["root", "cycle", "members"])


def _components(after: dict[str, list[str]], nodes: list[str], every: bool = False) -> list[list[str]]:
    """Strongly connected components that have an edge inside, or every one, without recursion; what one leads to comes first."""
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    open_: list[str] = []
    placed: set[str] = set()
    out = []
    for first in nodes:
        if first in order:
            continue
        order[first] = low[first] = len(order)
        open_.append(first)
        walk = [(first, iter(after.get(first, ())))]
        while walk:
            x, targets = walk[-1]
            for y in targets:
                if y not in order:
                    order[y] = low[y] = len(order)
                    open_.append(y)
                    walk.append((y, iter(after.get(y, ()))))
                    break
                if y not in placed:
                    low[x] = min(low[x], order[y])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[x])
                if low[x] == order[x]:
                    group = [open_.pop()]
                    while group[-1] != x:
                        group.append(open_.pop())
                    placed.update(group)
                    if every or len(group) > 1 or x in after.get(x, ()):
                        out.append(group)
    return out


def components(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """(node, component): nodes of edges (a, b) that lie on a cycle, with the least node of their strongly connected
    component. A null end is no edge, repeated edges are one, and an empty table has no rows."""
    return _search(edges, finish, False)[0]


def shortest(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """(root, cycle): for each strongly connected component with a cycle the shortest through its least node, closed by
    it; of equal ones the first by its nodes."""
    return _search(edges, finish, True)[1]
