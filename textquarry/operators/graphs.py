"""Strongly connected parts of directed graphs, with state linear in nodes and edges."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed

#: Steps of a propagation that one job takes; a plan has a table twice a step, so it doubles with each.
STEPS = 2
#: Edges that one task finishes; a graph of more is taken apart by joins.
FEW = 200_000


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) without those of nodes that have no way in or no way out, again and again until none is left over."""
    n = edges.count()
    while n:
        less = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        edges = checkpointed(less.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        m = edges.count()
        if m == n:
            break
        n = m
    return edges


def coloured(edges: DataFrame) -> DataFrame:
    """node, colour: the least node that reaches a node, itself included. A round hands on the least colours along all edges."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().select("node", F.col("node").alias("colour"))
    while True:
        new = nodes
        for _ in range(STEPS):
            handed = new.join(edges, F.col("node") == F.col("src")).groupBy("dst").agg(F.min("colour").alias("_c"))
            new = new.join(handed, F.col("node") == F.col("dst"), "left").select("node", F.least("colour", "_c").alias("colour"))
        new = checkpointed(new)
        if new.join(nodes, ["node", "colour"], "left_anti").isEmpty():
            return new
        nodes = new


def roots_and_what_reaches_them(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """node, colour of nodes that reach the node of their colour by edges (src, dst, colour) of that colour."""
    found = frontier = checkpointed(colours.where("node = colour"))
    while True:
        before = frontier.withColumnRenamed("node", "dst").join(edges, ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
        frontier = checkpointed(before.join(found, ["node", "colour"], "left_anti"))
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)


def components_of(edges: list[tuple]) -> dict:
    """node -> least node of its component, of few edges: nodes in order of their ends, then backwards from the last one."""
    ahead: dict = {}
    back: dict = {}
    for a, b in edges:
        ahead.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    ended: list = []
    seen: set = set()
    for start in ahead:
        stack = [(start, iter(ahead[start]))] if start not in seen else []
        seen.add(start)
        while stack:
            node, rest = stack[-1]
            step = next((x for x in rest if x not in seen), None)
            if step is None:
                ended.append(node)
                stack.pop()
            else:
                seen.add(step)
                stack.append((step, iter(ahead.get(step, ()))))
    out: dict = {}
    for start in reversed(ended):
        if start not in out:
            group, todo = {start}, [start]
            while todo:
                fresh = [x for x in back.get(todo.pop(), ()) if x not in out and x not in group]
                group.update(fresh)
                todo += fresh
            out |= dict.fromkeys(group, min(group))
    return out


def _by_one_task(edges: DataFrame) -> DataFrame:
    """node, component of a graph of at most FEW edges, components of one node left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, kind = [], None
        for b in batches:
            kind = b.schema.field(0).type
            pairs += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
        found = components_of(pairs)
        size = Counter(found.values())
        rows = [(n, c) for n, c in found.items() if size[c] > 1]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in zip(*rows, strict=True)], ["node", "component"])

    kind = edges.schema["src"].dataType.simpleString()
    return edges.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def strongly_connected(edges: DataFrame) -> DataFrame:
    """node, component: nodes that lie on a cycle of two or more nodes, with the least node of their component.

    Trimming takes what leads to no cycle or from none; each node then gets the least node that reaches it, and what
    reaches that node back is a component of it. The rest goes on within its colours. Each table that is kept between
    rounds has a row a node or a row an edge. A graph of at most FEW edges is done by one task. Self-loops, repeated edges
    and nulls change nothing.
    """
    left = checkpointed(edges.select("src", "dst").where("src <> dst").distinct())
    if left.limit(FEW + 1).count() <= FEW:
        return _by_one_task(left)
    parts: list[DataFrame] = []
    while True:
        left = trimmed(left)
        if left.isEmpty():
            break
        colours = coloured(left)
        one = left.join(colours.select(F.col("node").alias("src"), "colour"), "src")
        inner = checkpointed(one.join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("_to")), "dst").where("colour = _to").select("src", "dst", "colour"))
        found = checkpointed(roots_and_what_reaches_them(inner, colours))
        parts.append(found)
        gone = found.select("node")
        left = inner.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
        left = checkpointed(left)
    if not parts:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    several = every.groupBy("colour").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return every.join(several, "colour").select("node", F.col("colour").alias("component"))
