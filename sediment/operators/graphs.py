"""Directed links between nodes: support within a number of steps, connected components, and cycles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut

#: Steps from a node to what supports it; links of a component that one task takes.
STEPS, IN_ONE_TASK = 4, 100_000


def support_paths(links: DataFrame, steps: int = STEPS) -> DataFrame:
    """src, dst, steps, path of every node within `steps` links (src, dst) of another, by a shortest path (the first by ids).

    A node that links to itself supports nothing and is not gone through. A node is reached once from each source, so cycles
    end by themselves and hubs don't multiply paths.
    """
    links = links.select("src", "dst").filter("src is not null and dst is not null").distinct()
    loops = links.filter("src = dst").select(F.col("src").alias("node"))
    edges = links.join(loops.withColumnRenamed("node", "src"), "src", "left_anti").join(loops.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    front = edges.select("src", "dst", F.lit(1).alias("steps"), F.array("src", "dst").alias("path"))
    out = front
    for k in range(2, steps + 1):
        onward = front.join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").filter(~F.array_contains("path", F.col("next")))
        fresh = onward.select("src", F.col("next").alias("dst"), F.array_append("path", F.col("next")).alias("path")).groupBy("src", "dst").agg(F.min("path").alias("path"))
        front = fresh.join(out.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", F.lit(k).alias("steps"), "path")
        out = out.unionByName(front)
    return out


def supported_evidence(nodes: DataFrame, evidence: str, steps: int = STEPS) -> DataFrame:
    """id, supports (ids by steps, then id) and evidence (distinct, the node's own first, then in that order) of nodes (id,
    derived_from, and a list column of evidence). References to unknown ids lead nowhere; a node that names itself has none."""
    links = nodes.select(F.col("id").alias("src"), F.explode("derived_from").alias("dst")).join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    loops = links.filter("src = dst").select(F.col("src").alias("id")).distinct()
    paths = support_paths(links, steps)
    kept = nodes.join(loops, "id", "left_anti")
    every = paths.select(F.col("src").alias("id"), "steps", "dst").unionByName(kept.select("id", F.lit(0).alias("steps"), F.col("id").alias("dst")))
    held = every.join(nodes.select(F.col("id").alias("dst"), F.col(evidence).alias("held")), "dst")
    ordered = F.array_sort(F.collect_list(F.struct("steps", "dst", "held")))
    got = held.groupBy("id").agg(ordered.alias("found"))
    none = F.array().cast("array<string>")
    told = got.select("id", F.transform(F.filter("found", lambda x: x["steps"] > 0), lambda x: x["dst"]).alias("supports"), F.array_distinct(F.flatten(F.transform("found", lambda x: x["held"]))).alias("evidence"))
    return nodes.select("id").join(told, "id", "left").select("id", F.coalesce("supports", none).alias("supports"), F.coalesce("evidence", none).alias("evidence"))


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node that each linked node is connected with, whatever the links' direction.

    Each round gives a node the least label among its neighbours, then that label's own: long chains take few rounds.
    """
    both = cut(links.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(links.select(F.col("dst").alias("node"), F.col("src").alias("other"))).distinct())
    labels = cut(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("its")), "other").groupBy("node").agg(F.min("its").alias("its"))
        least = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "its").alias("least"))
        jumped = least.join(labels.select(F.col("node").alias("least"), F.col("label").alias("further")), "least")
        after = cut(jumped.select("node", "before", F.least("least", "further").alias("label")))
        labels = after.select("node", "label")
        if after.filter("label <> before").isEmpty():
            return labels


def _strong(links: list[tuple[str, str]]) -> dict[str, str]:
    """Nodes of strongly connected parts of two and more, with the least node of each; no recursion."""
    onward: dict[str, list[str]] = {}
    for a, b in links:
        onward.setdefault(a, []).append(b)
        onward.setdefault(b, [])
    low: dict[str, int] = {}
    stack, open_, out = [], set(), {}
    for root in onward:
        if root in low:
            continue
        index = {root: len(low)}
        low[root] = len(low)
        stack.append(root)
        open_.add(root)
        path = [(root, iter(onward[root]))]
        while path:
            node, rest = path[-1]
            for other in rest:
                if other not in low:
                    low[other] = index[other] = len(low)
                    stack.append(other)
                    open_.add(other)
                    path.append((other, iter(onward[other])))
                    break
                if other in open_:
                    low[node] = min(low[node], low[other])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == index[node]:
                    part = [stack.pop()]
                    while part[-1] != node:
                        part.append(stack.pop())
                    open_.difference_update(part)
                    if len(part) > 1:
                        out |= dict.fromkeys(part, min(part))
    return out


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (node, label) raised to the greatest that reaches each node over edges (src, dst)."""
    while True:
        given = edges.join(labels.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("label").alias("its"))
        after = cut(labels.join(given, "node", "left").select("node", F.col("label").alias("before"), F.greatest("label", "its").alias("label")))
        labels = after.select("node", "label")
        if after.filter("label <> before").isEmpty():
            return labels


def _strong_by_colours(edges: DataFrame) -> DataFrame:
    """node, cycle of large components: nodes without links in or out go; each other node takes the greatest node that reaches
    it as its colour; what reaches the colour's own node within the colour is one part. Again for the rest."""
    out = None
    edges = cut(edges)
    while True:
        while True:
            kept = cut(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            if kept.count() == edges.count():
                break
            edges = kept
        if edges.isEmpty():
            return out
        nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
        colours = _spread(cut(nodes.withColumn("label", F.col("node"))), edges)
        inside = edges.join(colours.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(colours.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").filter("a = b").select("src", "dst")
        back = cut(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        seen = _spread(cut(colours.select("node", F.when(F.col("node") == F.col("label"), F.col("label")).otherwise("").alias("label"))), back)
        part = seen.filter("label <> ''").select("node", F.col("label").alias("colour"))
        many = part.groupBy("colour").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("cycle")).filter("n > 1")
        found = cut(part.join(many, "colour").select("node", "cycle"))
        out = found if out is None else out.unionByName(found)
        edges = cut(edges.join(part.select(F.col("node").alias("src")), "src", "left_anti").join(part.select(F.col("node").alias("dst")), "dst", "left_anti"))


def cyclic_nodes(links: DataFrame, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """node, cycle: nodes that lie on a cycle of links (src, dst) between two nodes or more, and the least node of those that
    reach one another.

    Components with fewer links than nodes are trees and have none; others go whole to a task each up to `in_one_task` links,
    and larger ones are searched by colours over all tasks. Ids are strings that aren't empty; links to oneself don't count.
    """
    edges = cut(links.select("src", "dst").filter("src <> dst and src <> '' and dst <> ''").distinct())
    labels = components(edges)
    of = edges.join(labels.select(F.col("node").alias("src"), "label"), "src").groupBy("label").agg(F.count(F.lit(1)).alias("n_links"))
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n_nodes")).join(of, "label").filter("n_links >= n_nodes")
    open_ = cut(edges.join(labels.select(F.col("node").alias("src"), "label"), "src").join(sizes.select("label", "n_links"), "label"))

    def search(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in rows:
            got = _strong(list(zip(x["src"], x["dst"], strict=True)))
            yield pd.DataFrame({"node": list(got), "cycle": list(got.values())}, dtype=object)

    small = open_.filter(F.col("n_links") <= in_one_task).groupBy("label").applyInPandas(lambda x: next(search(iter([x]))), "node string, cycle string")
    large = open_.filter(F.col("n_links") > in_one_task).select("src", "dst")
    if large.isEmpty():
        return small
    found = _strong_by_colours(large)
    return small if found is None else small.unionByName(found)
