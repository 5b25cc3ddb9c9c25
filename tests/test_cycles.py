"""Components and cycles by rounds of joins, by one task's search, and by brute force."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from lodeworks.operators import cycles


def brute(edges):
    """(component by node, shortest cycle through each component's least node) by sets."""
    after, nodes = {}, sorted({x for e in edges for x in e})
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    reach = {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for y in after.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        reach[n] = seen
    part = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes if n in reach[n]}
    best = {}
    for root in set(part.values()):
        ways = [[root]]
        while True:
            ways = [[*w, y] for w in ways for y in after.get(w[-1], ()) if y == root or (y in part and part[y] == root and y not in w)]
            closed = [w for w in ways if w[-1] == root]
            if closed:
                best[root] = min(closed)
                break
    return part, best


def graphs():
    r = random.Random(7)
    ring = [(f"n{k:02}", f"n{(k + 1) % 40:02}") for k in range(40)]
    yield "ring", [*ring, ("x", "n03"), ("n09", "y"), ("y", "z")]
    # the least node lies on a chain that a shorter way passes by
    yield "bypass", [("p", "q"), ("p", "a"), ("a", "q"), ("q", "p"), ("q", "q"), ("loop", "loop"), ("p", "loop")]
    yield "two ways", [("a", "d"), ("d", "e"), ("e", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("a", "b")]
    for k in range(2):
        yield f"random {k}", [(f"v{r.randrange(30):02}", f"v{r.randrange(30):02}") for _ in range(42)]


@pytest.mark.parametrize("name, edges", list(graphs()), ids=[n for n, _ in graphs()])
@pytest.mark.parametrize("finish", [0, cycles.FINISH])
def test_as_brute_force(spark, name, edges, finish):
    df = spark.createDataFrame([*edges, (None, "q"), ("p", None)], "a string, b string")
    part, best = brute(edges)
    members, rings = cycles._search(df, finish, True)
    assert sorted(map(tuple, members.collect())) == sorted(part.items())
    assert {r.root: r.cycle for r in rings.collect()} == best


def test_no_cycle_and_no_rows(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "a string, b string")
    for finish in (0, 10):
        assert cycles.shortest(df, finish).count() == 0 and cycles.components(df.limit(0), finish).count() == 0


def thick(n, r):
    """A deep graph, in which every node leads to near ones and, rarely, back."""
    return [(f"t{k}", f"t{min(n - 1, max(0, k + r.randrange(-2, 9)))}") for k in range(n) for _ in range(2)]


@pytest.mark.parametrize("block", [40, 200])
def test_blocks_as_one_task(spark, block, monkeypatch):
    """A deep graph is cut into blocks until one task can finish it; labels, a round for each step down, are asked only
    where blocks are so small that most of their nodes are ends."""
    edges = thick(300, random.Random(5)) + [("hub", f"t{k}") for k in range(0, 300, 3)] + [("t7", "hub"), ("lone", "lone")]
    df = spark.createDataFrame([*edges, (None, "q"), ("p", None)], "a string, b string")
    want, rings = cycles._search(df, cycles.FINISH, True)
    want, best = sorted(map(tuple, want.collect())), sorted(map(tuple, rings.collect()))
    assert 1 < len({c for _, c in want})
    if block == 200:
        monkeypatch.setattr(cycles, "_labels", None)
    members, rings = cycles._search(df, 300, True, block)
    assert sorted(map(tuple, members.collect())) == want
    monkeypatch.undo()
    assert sorted(map(tuple, rings.collect())) == best


def test_a_block_keeps_ways_through(spark):
    """Whatever the cut and the form that a block leaves, ways between its ends stay as they were."""
    r = random.Random(9)
    for _ in range(60):
        edges = {(f"n{r.randrange(14):02}", f"n{r.randrange(14):02}") for _ in range(20)}
        ends = [(f"n{k:02}", None) for k in r.sample(range(14), 5)] + [(None, f"n{k:02}") for k in r.sample(range(14), 5)]
        rows = [*edges, *ends]
        out = cycles._contract("h0:", pa.table([pa.array([3] * len(rows), pa.int32()), *(pa.array([e[k] for e in rows], pa.string()) for k in (0, 1))], ["block", "a", "b"])).to_pylist()
        before, after = reach(edges), reach({(o["a"], o["b"]) for o in out if o["kind"] == "edge"})
        came, gone = ({o["a"]: o["b"] for o in out if o["kind"] == k} for k in ("entry", "exit"))
        for b in (e[1] for e in ends if e[0] is None):
            for a in (e[0] for e in ends if e[1] is None):
                there = a == b or a in before.get(b, ())
                assert there == (b in came and a in gone and (came[b] == gone[a] or gone[a] in after.get(came[b], ())))


def reach(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    while True:
        new = {a: bs.union(*(out.get(b, ()) for b in bs)) for a, bs in out.items()}
        if new == out:
            return out
        out = new
