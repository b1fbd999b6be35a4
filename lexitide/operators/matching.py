"""Maximum bipartite matching of emerging words and controls, by connected components."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.runtime import materialize


def hopcroft_karp(edges: list[tuple[str, str]]) -> dict[str, str]:
    """A maximum-cardinality matching left -> right; the same for any order of the edges."""
    near: dict[str, list[str]] = {}
    for a, b in sorted(set(edges)):
        near.setdefault(a, []).append(b)
    left: dict[str, str] = {}
    right: dict[str, str] = {}
    while True:
        layer = {a: 0 for a in near if a not in left}
        queue, reachable = deque(layer), False
        while queue:
            a = queue.popleft()
            for b in near[a]:
                c = right.get(b)
                if c is None:
                    reachable = True
                elif c not in layer:
                    layer[c] = layer[a] + 1
                    queue.append(c)
        if not reachable:
            return left
        for root in [a for a in near if a not in left]:
            path, tried = [(root, iter(near[root]))], set()
            trail: list[str] = []
            while path:
                a, rest = path[-1]
                for b in rest:
                    if b in tried:
                        continue
                    c = right.get(b)
                    if c is None:
                        trail.append(b)
                        for (x, _), y in zip(path, trail):
                            left[x], right[y] = y, x
                        path = []
                        break
                    if layer.get(c) == layer[a] + 1:
                        tried.add(b)
                        trail.append(b)
                        path.append((c, iter(near[c])))
                        break
                else:
                    layer.pop(a, None)
                    path.pop()
                    if trail:
                        trail.pop()


def vertex_cover(edges: list[tuple[str, str]], matching: dict[str, str]) -> tuple[set[str], set[str]]:
    """(left, right) words that touch every edge, as many as a maximum matching has pairs: proof that no larger one exists.

    Koenig's construction: what can't be reached from unmatched left words over alternating paths, on the left, and what can, on the right.
    """
    near: dict[str, set[str]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    back = {b: a for a, b in matching.items()}
    seen_left, seen_right, queue = set(), set(), deque(a for a in near if a not in matching)
    while queue:
        a = queue.popleft()
        if a in seen_left:
            continue
        seen_left.add(a)
        for b in near[a] - seen_right:
            seen_right.add(b)
            if b in back:
                queue.append(back[b])
    return set(near) - seen_left, seen_right


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an edge table (a, b): labels shrink to the least node, with a jump to the label's label each round.

    Rounds go on until no label moves (labels only shrink, so they end). All state stays in tables written to the shared
    folder; the driver sees one count a round.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct()
    both = materialize(both, "links")
    labels = materialize(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("c")).withColumnRenamed("u", "node"), "labels")
    moved = 1
    while moved:
        seen = both.join(labels.select(F.col("node").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("m"))
        stepped = labels.join(seen, labels.node == seen.u, "left").select("node", F.least("c", F.coalesce("m", "c")).alias("d"), "c")
        jumped = stepped.join(labels.select(F.col("node").alias("d"), F.col("c").alias("e")), "d", "left").select("node", F.least("d", F.coalesce("e", "d")).alias("n"), "c")
        nxt = materialize(jumped, "labels")
        moved = nxt.where("n <> c").limit(1).count()
        labels = nxt.select("node", F.col("n").alias("c"))
    return labels.select("node", F.col("c").alias("component"))


def _certified(edges: DataFrame) -> DataFrame:
    """(kind, neologism, control): ``pair`` rows are a maximum matching, ``cover`` rows (one of the words null) a vertex cover of the same size."""
    clean = edges.where("neologism is not null and control is not null").select(F.col("neologism").cast("string").alias("neologism"), F.col("control").cast("string").alias("control")).distinct()
    clean = materialize(clean, "edges")
    labelled = components(clean.select(F.concat(F.lit("n:"), "neologism").alias("a"), F.concat(F.lit("c:"), "control").alias("b")))
    rows = clean.join(labelled.select(F.expr("substring(node, 3)").alias("neologism"), "component", F.col("node")).where("node like 'n:%'").drop("node"), "neologism")

    def match(part: pd.DataFrame) -> pd.DataFrame:
        links = list(zip(part["neologism"], part["control"]))
        found = hopcroft_karp(links)
        left, right = vertex_cover(links, found)
        out = [("pair", a, b) for a, b in sorted(found.items())] + [("cover", a, None) for a in sorted(left)] + [("cover", None, b) for b in sorted(right)]
        return pd.DataFrame(out, columns=["kind", "neologism", "control"])

    return rows.groupBy("component").applyInPandas(match, "kind string, neologism string, control string")


def maximum_matching(edges: DataFrame) -> DataFrame:
    """(neologism, control): a maximum matching in which every word occurs at most once.

    Each connected component is matched by one task. A component holds links between target words, of which there are at most a few thousand,
    and their controls; it can't grow with the corpus. Repeated edges count once; null ends take no part.
    """
    return _certified(edges).where("kind = 'pair'").select("neologism", "control")


def matching_faults(edges: DataFrame) -> DataFrame:
    """One row of counts, all 0 for a maximum matching of ``edges``: words used twice, pairs that are no edges, edges the cover leaves
    untouched, and the cover's size less the matching's. A cover as large as the matching proves that no matching is larger.
    """
    made = materialize(_certified(edges), "certified")
    links = edges.where("neologism is not null and control is not null").select(F.col("neologism").cast("string").alias("neologism"), F.col("control").cast("string").alias("control"))
    pairs, cover = made.where("kind = 'pair'").select("neologism", "control"), made.where("kind = 'cover'")
    once = pairs.agg(F.count(F.lit(1)), F.countDistinct("neologism"), F.countDistinct("control")).first()  # three numbers
    n, left, right = once
    strange = pairs.join(links, ["neologism", "control"], "left_anti").count()
    bare = links.join(cover.where("neologism is not null").select("neologism"), "neologism", "left_anti").join(cover.where("control is not null").select("control"), "control", "left_anti").count()
    faults = {"repeated_left": n - left, "repeated_right": n - right, "not_edges": strange, "uncovered_edges": bare, "cover_surplus": cover.count() - n}
    return edges.sparkSession.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in faults.items()])
