"""Contextual vectors: encoding, moments by dimension, z-scored means by word."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOMENTS = "key string, n long, sums array<double>, squares array<double>"
HELD = 4096  # keys whose sums a task holds (at 768 dimensions 12 KB each) before it hands them on


def _moments(df: DataFrame, key: str | None, vector: str) -> DataFrame:
    """(key, n, sums, squares), added up inside each task before anything is shuffled: one row a key and task."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list] = {}

        def rows_held() -> pa.RecordBatch:
            values = list(held.values())
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in held], pa.string()), pa.array([v[0] for v in values]), *[pa.array([list(v[c]) for v in values], pa.list_(pa.float64())) for c in (1, 2)]],
                ["key", "n", "sums", "squares"],
            )

        for batch in batches:
            keys, rows = batch.column("key").to_pylist(), batch.column("v")
            sizes = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(sizes > 0)
            by: dict[tuple, list[int]] = {}
            for k in at:
                by.setdefault((keys[k], int(sizes[k])), []).append(k)
            for (name, width), members in by.items():
                x = np.asarray(rows.take(pa.array(members)).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)
                x = x[np.isfinite(x).all(1)]
                n, s, q = held.get((name, width), (0, 0.0, 0.0))
                held[name, width] = (n + len(x), s + x.sum(0), q + (x * x).sum(0))
            if len(held) >= HELD:
                yield rows_held()
                held.clear()
        if held:
            yield rows_held()

    rows = df.select((F.col(key).cast("string") if key else F.lit("all")).alias("key"), F.col(vector).alias("v")).where("v is not null and key is not null")
    return rows.mapInArrow(partial, MOMENTS).where("n > 0")


def dimension_stats(df: DataFrame, vector: str = "vector") -> DataFrame:
    """(dim, n, mean, std) over all rows of both splits; the standard deviation is the population's."""
    parts = _moments(df, None, vector).select("n", F.posexplode(F.arrays_zip("sums", "squares")).alias("dim", "c"))
    per = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("c.sums").alias("s"), F.sum("c.squares").alias("q"))
    mean = F.col("s") / F.col("n")
    return per.select("dim", "n", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("std"))


def word_means(df: DataFrame, key: str = "word", vector: str = "vector") -> DataFrame:
    """(key, dim, n, mean): each word's mean vector over all its parts, in long form."""
    parts = _moments(df, key, vector).select(F.col("key").alias(key), "n", F.posexplode("sums").alias("dim", "s"))
    return parts.groupBy(key, "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).select(key, "dim", "n", (F.col("s") / F.col("n")).alias("mean"))


def zscored_means(df: DataFrame, key: str = "word", vector: str = "vector") -> DataFrame:
    """(key, n, vector): (mean of the word - mean of all) / std of all, by dimension; a constant dimension gives 0."""
    stats = dimension_stats(df, vector).select("dim", F.col("mean").alias("_m"), "std")  # one row a dimension
    z = F.when(F.col("std") > 0, (F.col("mean") - F.col("_m")) / F.col("std")).otherwise(F.lit(0.0))
    cells = word_means(df, key, vector).join(F.broadcast(stats), "dim").select(key, "n", "dim", z.alias("z"))
    vectors = cells.groupBy(key).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "z"))).alias("_c"))  # one entry a dimension
    return vectors.select(key, "n", F.transform("_c", lambda x: x["z"]).alias("vector"))


Encoder = Callable[[list[list[str]]], list[np.ndarray]]


def hashing_encoder(width: int = 64) -> Callable[[], Encoder]:
    """A deterministic stand-in for a contextual model: token vectors from hashes, mixed with their neighbours'."""

    def load() -> Encoder:
        memo: dict[str, np.ndarray] = {}

        def of(token: str) -> np.ndarray:
            if token not in memo:
                if len(memo) > 200_000:
                    memo.clear()
                seed = int.from_bytes(hashlib.md5(str(token).encode()).digest()[:8], "little")
                memo[token] = np.random.default_rng(seed).standard_normal(width)
            return memo[token]

        def encode(batch: list[list[str]]) -> list[np.ndarray]:
            out = []
            for tokens in batch:
                x = np.stack([of(t) for t in tokens]) if tokens else np.zeros((0, width))
                if len(x) > 1:
                    near = x.copy()
                    near[1:] += 0.5 * x[:-1]
                    near[:-1] += 0.5 * x[1:]
                    x = near / 2
                out.append(x)
            return out

        return encode

    return load


def arithmetic_encoder(width: int) -> Callable[[], Encoder]:
    """A stand-in whose whole numbers any engine can repeat: from a hash of the token, its place and the dimension."""

    def load() -> Encoder:
        def encode(batch: list[list[str]]) -> list[np.ndarray]:
            out = []
            for tokens in batch:
                h = np.array([int(hashlib.md5(str(t).encode()).hexdigest()[:6], 16) % 997 for t in tokens], dtype=np.int64)
                out.append((h[:, None] * np.arange(1, width + 1) + 13 * np.arange(len(tokens))[:, None]) % 1009.0)
            return out

        return encode

    return load


def encode_contexts(
    contexts: DataFrame, load: Callable[[], Encoder] | None = None, batch: int = 512, key: str = "word", limit: int = 512, decoder: Callable[[], Callable] | None = None
) -> DataFrame:
    """(word, vector) of every context row (word, tokens, position): the mean of the encoded positions.

    The model is loaded once per Python worker and sees batches. A row is skipped whose positions lie outside its tokens or from ``limit``
    on, or whose tokens there, read as text (by ``decoder``, else joined by blanks), aren't the word.
    """
    loader = load or hashing_encoder()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = loader()
        read = decoder() if decoder else lambda some: " ".join(map(str, some)).strip().lower()
        for part in parts:
            words, vectors = [], []
            for a in range(0, len(part), batch):
                some = part.iloc[a : a + batch]
                rows = [list(t)[:limit] for t in some["tokens"]]
                for word, position, tokens, x in zip(some["word"], some["position"], rows, encode(rows)):
                    inside = len(position) and 0 <= min(position) and max(position) < len(x)
                    if inside and read([tokens[k] for k in position]) == word:
                        words.append(word)
                        vectors.append(x[list(position)].mean(0).astype(np.float32))
            if words:
                yield pd.DataFrame({"word": words, "vector": vectors})

    rows = contexts.where("word is not null and position is not null and tokens is not null").select(F.col(key).alias("word"), "position", "tokens")
    return rows.mapInPandas(run, "word string, vector array<float>")
