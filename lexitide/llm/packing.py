"""Problem 7: filling containers of a fixed capacity by Karmarkar-Karp multiway differencing.

Texts are sized in tokens of a byte-level tokenizer, one token a byte of UTF-8. A text larger than a container is divided
into full pieces and a rest; nothing else is ever divided. Items are dealt by a hash of their key into batches of about
``batch_items``, and each batch is packed on its own: differencing merges the two partial partitions of the largest
imbalance with opposing order, which gives near-equal windows, and the number of windows rises whenever the fullest
exceeds the capacity. The rest of a batch is bounded, so no task ever holds more than a batch.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexitide.runtime import parallelism

CAPACITY = 4096


def differencing(sizes: np.ndarray, windows: int) -> tuple[list[list[int]], int]:
    """``sizes`` in ``windows`` near-equal groups, and the largest group's size.

    A partial partition holds its non-empty groups by descending sum; two are merged largest with smallest, so while their
    groups together are fewer than the windows nothing needs to be added up.
    """
    left, right = [], []  # a group is an item (>= 0) or a merger (< 0: -1 - its number)

    def merged(a: tuple[np.ndarray, list[int]], b: tuple[np.ndarray, list[int]]) -> tuple[np.ndarray, list[int]]:
        over = len(a[0]) + len(b[0]) - windows
        sums = np.concatenate([a[0], b[0]])
        names = a[1] + b[1]
        if over > 0:  # the smallest groups of a meet the smallest of b, in opposing order
            la, lb = len(a[0]), len(b[0])
            ia, ib = np.arange(la - over, la), np.arange(la + lb - over, la + lb)[::-1]
            both = sums[ia] + sums[ib]
            fresh = []
            for i, j in zip(ia, ib):
                left.append(names[i])
                right.append(names[j])
                fresh.append(-len(left))
            keep = np.ones(la + lb, dtype=bool)
            keep[ia] = keep[ib] = False
            names = [n for n, k in zip(names, keep) if k] + fresh
            sums = np.concatenate([sums[keep], both])
        order = np.argsort(-sums, kind="stable")
        return sums[order], [names[i] for i in order]

    def spread(part: tuple[np.ndarray, list[int]]) -> int:
        return int(part[0][0] - (part[0][-1] if len(part[0]) == windows else 0))

    heap = [(-int(n), k, (np.array([n], dtype=np.int64), [k])) for k, n in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        part = merged(a, b)
        heapq.heappush(heap, (-spread(part), tick, part))
        tick += 1
    sums, names = heap[0][2]
    groups = []
    for name in names:
        stack, items = [name], []
        while stack:
            x = stack.pop()
            if x >= 0:
                items.append(x)
            else:
                stack += [left[-1 - x], right[-1 - x]]
        groups.append(items)
    return groups, int(sums[0])


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item; every item must fit. The window count starts at the least possible and rises until all fit."""
    sizes = np.asarray(sizes, dtype=np.int64)
    out = np.zeros(len(sizes), dtype=np.int64)
    filled = np.flatnonzero(sizes > 0)
    if not len(filled):
        return out
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        groups, largest = differencing(sizes[filled], windows)
        if largest <= capacity:
            break
        windows += max(1, windows // 200)
    for k, items in enumerate(groups):
        out[filled[items]] = k
    return out


def pieces(df: DataFrame, key: str, text: str, capacity: int) -> DataFrame:
    """(doc_id, n_pieces, piece_no, start_token, n_tokens): whole texts, and the pieces of those too large."""
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    sized = df.select(F.col(key).alias("doc_id"), size.alias("_n")).withColumn("n_pieces", F.greatest(F.lit(1), F.ceil(F.col("_n") / capacity)).cast("int"))
    cut = sized.select("*", F.explode(F.sequence(F.lit(1), F.col("n_pieces"))).alias("piece_no"))
    start = (F.col("piece_no") - 1).cast("long") * capacity
    return cut.select("doc_id", "n_pieces", "piece_no", start.alias("start_token"), F.least(F.col("_n") - start, F.lit(capacity)).cast("long").alias("n_tokens"))


PLACED = "doc_id long, n_pieces int, piece_no int, start_token long, n_tokens long, container string"


def fill_containers(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, batch_items: int = 1000) -> DataFrame:
    """One row per text or piece with its ``container`` (batch and window); a container's pieces sum to at most ``capacity``.

    Nulls and empty texts have size 0 and join a container for nothing. Repeated rows are items of their own. Other
    columns are not read. An empty table gives an empty result. Only sizes travel, never texts.
    """
    items = pieces(df, key, text, capacity)
    full = items.where(F.col("n_tokens") == capacity)
    loose = items.where(F.col("n_tokens") < capacity)
    batches = max(1, round(df.count() / batch_items))  # a count reads no text
    lot = F.pmod(F.xxhash64("doc_id", "piece_no", "n_tokens"), F.lit(batches)).cast("int")

    def place(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable")
        windows = pack(batch["n_tokens"].to_numpy(), capacity)
        name = batch["_b"].iloc[0]
        return batch.drop(columns=["_p", "_b"]).assign(container=[f"b{name}w{w}" for w in windows])

    # few bytes, much work: every task gets as many batches as any other, and adaptive execution doesn't coalesce them
    tasks = parallelism(df.sparkSession)
    dealt = loose.withColumn("_b", lot).withColumn("_p", F.col("_b") % tasks).repartitionById(tasks, "_p")
    placed = dealt.groupBy("_p", "_b").applyInPandas(place, PLACED)
    copy = F.row_number().over(Window.partitionBy("doc_id", "piece_no").orderBy("n_tokens"))
    alone = full.withColumn("_c", copy).select(*full.columns, F.concat_ws("p", F.concat(F.lit("d"), F.col("doc_id")), "piece_no", "_c").alias("container"))
    return placed.unionByName(alone)


def fill_report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens and the share of the room that is used."""
    per = placed.groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"), (F.sum("n") / F.count(F.lit(1)) / capacity).alias("fill"))
