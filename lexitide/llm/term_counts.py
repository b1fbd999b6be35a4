"""Problem 6: how often every term occurs and in how many records, by burst-trie counting.

Records are first made distinct (a delivery that came again counts once) and added up per term and record, with map-side
partial aggregation. Workers then count terms in burst tries: a node holds a small container of suffixes with two
counters each, and bursts into child nodes when the container is full. Each worker hands on its tries as subtrees, cut at
adaptive prefixes: a prefix is lengthened until few enough terms share it, so no receiving task gets more than its part,
however uneven the first letters are. Matching subtrees are merged container by container.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.runtime import materialize, parallelism

BURST_AT = 128  # suffixes in a container before it bursts
ROUTE_DEPTH = 6  # the longest routing prefix


class Node:
    """A container of suffixes -> [occurrences, records], or, once burst, children by first sign."""

    __slots__ = ("here", "leaf", "children")

    def __init__(self):
        self.here: list[int] | None = None  # counters of the term that ends at this node
        self.leaf: dict[str, list[int]] | None = {}
        self.children: dict[str, Node] = {}

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, at = self, 0
        while node.leaf is None:
            if at == len(term):
                node.here = node.here or [0, 0]
                node.here[0] += occurrences
                node.here[1] += records
                return
            child = node.children.get(term[at])
            if child is None:
                child = node.children[term[at]] = Node()
            node, at = child, at + 1
        counters = node.leaf.get(term[at:])
        if counters is None:
            node.leaf[term[at:]] = [occurrences, records]
            if len(node.leaf) > BURST_AT:
                node.burst()
        else:
            counters[0] += occurrences
            counters[1] += records

    def burst(self) -> None:
        full, self.leaf = self.leaf, None
        for suffix, (occurrences, records) in full.items():
            if suffix:
                self.children.setdefault(suffix[0], Node()).add(suffix[1:], occurrences, records)
            else:
                self.here = [occurrences, records]

    def items(self, prefix: str = "") -> Iterator[tuple[str, int, int]]:
        stack = [(prefix, self)]
        while stack:
            at, node = stack.pop()
            if node.here:
                yield at, *node.here
            for suffix, counters in (node.leaf or {}).items():
                yield at + suffix, *counters
            stack += [(at + sign, child) for sign, child in node.children.items()]

    def subtrees(self) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
        """(prefix, suffixes with their counters): one for every container, one for a term that ends at a burst node."""
        stack = [("", self)]
        while stack:
            at, node = stack.pop()
            if node.here:
                yield at, [("", *node.here)]
            if node.leaf:
                yield at, [(suffix, *counters) for suffix, counters in node.leaf.items()]
            stack += [(at + sign, child) for sign, child in node.children.items()]


SUBTREE = "prefix string, suffixes array<string>, occurrences array<long>, records array<long>"
COLUMNS = ["prefix", "suffixes", "occurrences", "records"]


HELD = 1_000_000  # terms or prefixes a worker holds before it hands them on; what is handed on twice is added up later
FRAME = 5_000  # subtrees in one batch


def _frames(root: Node) -> Iterator[pd.DataFrame]:
    subtrees = root.subtrees()
    while some := list(islice(subtrees, FRAME)):
        yield pd.DataFrame([(prefix, *map(list, zip(*rows))) for prefix, rows in some], columns=COLUMNS)


def _worker_tries(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    root, held = Node(), 0
    for part in parts:
        for term, occurrences, records in zip(part["term"], part["occurrences"], part["records"]):
            root.add(term, int(occurrences), int(records))
        held += len(part)
        if held >= HELD:
            yield from _frames(root)
            root, held = Node(), 0
    yield from _frames(root)


def _prefix_sizes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sizes: Counter = Counter()
    for part in parts:
        for prefix, suffixes in zip(part["prefix"], part["suffixes"]):
            for suffix in suffixes:
                start = (prefix + suffix[:ROUTE_DEPTH])[:ROUTE_DEPTH]
                for k in range(len(start) + 1):
                    sizes[start[:k]] += 1
        if len(sizes) >= HELD:
            yield pd.DataFrame(list(sizes.items()), columns=["prefix", "terms"])
            sizes = Counter()
    yield pd.DataFrame(list(sizes.items()), columns=["prefix", "terms"])


def _router(split: dict[str, int], most: int):
    """Sends each container on by its adaptive prefix, whole where it lies inside one route."""

    def route_of(term: str) -> str:
        for k in range(ROUTE_DEPTH + 1):
            start = term[:k]
            if start not in split or len(start) < k:
                return start
        # the longest prefix still has too many terms: the rest of the term tells them apart
        return f"{start}\x00{zlib.crc32(term.encode()) % -(-split[start] // most)}"

    def send(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for prefix, suffixes, occurrences, records in zip(part["prefix"], part["suffixes"], part["occurrences"], part["records"]):
                if prefix not in split and len(prefix) <= ROUTE_DEPTH:
                    route = next(prefix[:k] for k in range(len(prefix) + 1) if prefix[:k] not in split)
                    out.append((route, prefix, suffixes, occurrences, records))
                    continue
                by: dict[str, list] = {}
                for suffix, n, r in zip(suffixes, occurrences, records):
                    by.setdefault(route_of(prefix + suffix), []).append((suffix, n, r))
                out += [(route, prefix, *map(list, zip(*rows))) for route, rows in by.items()]
            yield pd.DataFrame(out, columns=["route", *COLUMNS])

    return send


def _merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Matching subtrees of all workers, merged in one trie a task."""
    root = Node()
    for part in parts:
        for prefix, suffixes, occurrences, records in zip(part["prefix"], part["suffixes"], part["occurrences"], part["records"]):
            for suffix, n, r in zip(suffixes, occurrences, records):
                root.add(prefix + suffix, int(n), int(r))
    items = root.items()
    while rows := list(islice(items, 50_000)):
        yield pd.DataFrame(rows, columns=["term", "occurrences", "records"])


def trie_counts(per_record: DataFrame) -> DataFrame:
    """(term, occurrences, records) from rows (term, occurrences, records) of which a term may have any number.

    The driver sees only the prefixes that must be lengthened: those with over a task's share of the terms, so at most
    ``ROUTE_DEPTH`` + 1 times 8 a task, however many terms there are.
    """
    tasks = parallelism(per_record.sparkSession)
    tries = materialize(per_record.mapInPandas(_worker_tries, SUBTREE), "tries")
    sizes = tries.mapInPandas(_prefix_sizes, "prefix string, terms long").groupBy("prefix").agg(F.sum("terms").alias("terms"))
    sizes = materialize(sizes, "prefixes")
    every = sizes.where("prefix = ''").select("terms").first()
    if every is None:
        return per_record.select("term", "occurrences", "records").limit(0)
    most = max(BURST_AT, every["terms"] // (8 * tasks))
    split = {r["prefix"]: r["terms"] for r in sizes.where(F.col("terms") > most).collect()}
    routed = tries.mapInPandas(_router(split, most), "route string, " + SUBTREE)
    return routed.repartition(tasks, "route").drop("route").mapInPandas(_merge, "term string, occurrences long, records long")


def term_frequencies(df: DataFrame, term: str = "word", record: tuple[str, ...] = ("timestep", "shard_no"), count: str = "count", rare_below: int = 5, common_share: float = 0.01) -> DataFrame:
    """(term, occurrences, records, mark): totals of every term, trimmed and in lower case.

    Rows that agree in the term as written and the record are one row delivered again (of different counts the largest
    stays). A null count means unseen; null terms and terms of blanks are ignored; null parts of a record are a value like any
    other. ``mark`` is ``rare`` below ``rare_below`` occurrences, ``common`` from ``common_share`` of all occurrences on,
    else null; a term seen nowhere is rare with 0 of both. An empty table gives an empty result.
    """
    keys = [F.col(c).alias(f"_r{k}") for k, c in enumerate(record)]
    names = [f"_r{k}" for k in range(len(record))]
    once = df.where(F.col(term).isNotNull()).select(F.col(term).alias("_t"), *keys, F.col(count).alias("_n")).groupBy("_t", *names).agg(F.max("_n").alias("_n"))
    plain = F.lower(F.regexp_replace("_t", r"(?U)^\s+|\s+$", ""))
    spelled = once.select(plain.alias("term"), *names, F.coalesce("_n", F.lit(0)).cast("long").alias("_n")).where("term <> ''")
    per_record = spelled.groupBy("term", *names).agg(F.sum("_n").alias("occurrences")).select("term", "occurrences", (F.col("occurrences") > 0).cast("long").alias("records"))
    counts = materialize(trie_counts(per_record), "terms")
    total = counts.agg(F.sum("occurrences")).first()[0] or 0
    mark = F.when(F.col("occurrences") < rare_below, "rare").when(F.col("occurrences") >= F.lit(total * common_share), "common")
    return counts.select("term", "occurrences", "records", mark.alias("mark"))
