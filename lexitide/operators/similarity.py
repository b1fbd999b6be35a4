"""Cosine similarity: radius neighbourhoods of a stated query set, candidate pairs, densities and growth."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitide.config import MIN_COSINES
from lexitide.functions.statistics import safe_corr
from lexitide.runtime import materialize

BLOCK_BYTES = 64 << 20  # of query vectors held by a worker at once


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit_rows(column: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of vectors of the right width that are finite and not all zero, and those vectors at length 1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == width)
    x = np.asarray(column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)
    length = np.sqrt((x * x).sum(1))
    good = np.isfinite(length) & (length > 0)
    return at[good], x[good] / length[good, None]


def radius_neighbours(queries: DataFrame, vocabulary: DataFrame, min_cosine: float, key: str = "word", vector: str = "vector", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, neighbour, cos) of all vocabulary words at least ``min_cosine`` from a query, the query's own word excluded.

    The vocabulary streams through once per block of queries and is never shuffled; a block is broadcast and has at most ``block_bytes``,
    whatever the size of the query set; the driver holds one block at a time. Only hits leave the workers. Unusable vectors (null, another width, not finite, all zero) take no part.
    """
    spark = vocabulary.sparkSession
    empty = spark.createDataFrame([], f"{key} {dict(vocabulary.dtypes)[key]}, neighbour {dict(vocabulary.dtypes)[key]}, cos double")
    sizes = queries.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("w")).count().orderBy(F.desc("count"), "w").first()
    if sizes is None or not sizes["w"]:
        return empty
    width, kind = sizes["w"], dict(vocabulary.dtypes)[key]
    blocks = max(1, -(-sizes["count"] * width * 8 // block_bytes))
    usable = queries.where(F.col(key).isNotNull() & (F.size(vector) == width)).select(key, vector)
    found = empty
    for number in range(blocks):
        part = usable.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == number) if blocks > 1 else usable
        rows = part.toArrow()
        at, q = unit_rows(rows.column(vector), width)
        held = spark.sparkContext.broadcast((rows.column(key).take(pa.array(at)).to_pylist(), np.ascontiguousarray(q.T)))

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            words, matrix = held.value
            names = np.array(words, dtype=object)
            for batch in batches:
                at, x = unit_rows(batch.column("v"), width)
                if not len(at) or not len(names):
                    continue
                own = np.array(batch.column("k").take(pa.array(at)).to_pylist(), dtype=object)
                for a in range(0, len(x), 4096):
                    cos = x[a : a + 4096] @ matrix
                    i, j = np.nonzero(cos >= min_cosine)
                    other = own[a : a + 4096][i] != names[j]
                    i, j = i[other], j[other]
                    yield pa.RecordBatch.from_arrays([pa.array(names[j].tolist(), batch.schema.field("k").type), pa.array(own[a : a + 4096][i].tolist(), batch.schema.field("k").type), pa.array(np.clip(cos[i, j], -1, 1))], [key, "neighbour", "cos"])

        # of several blocks each is done, written and let go before the next, so one at a time is held
        hits = vocabulary.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInArrow(search, f"{key} {kind}, neighbour {kind}, cos double")
        if blocks > 1:
            hits = materialize(hits, "hits")
            held.destroy()
        found = hits if number == 0 else found.unionByName(hits)
    return found


def ordered_neighbours(neighbours: DataFrame, key: str = "word") -> DataFrame:
    """Neighbours with their place by descending similarity; ties by name."""
    return neighbours.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("cos"), "neighbour")))


def candidate_edges(
    targets: DataFrame, candidates: DataFrame, max_length: int = 2, max_rank: float = 0.01, min_cosine: float = 0.4, block_rows: int = 2048
) -> DataFrame:
    """(neologism, control): pairs close in length, in relative rank and in meaning.

    Both sides have ``word``, ``rel_rank`` and ``vector``. Rows meet by an equal key (band of rank, length): bands are as wide as the rank
    test, and a target enters its own and both neighbouring bands at each length allowed. A key with many rows is split into blocks of about
    ``block_rows`` a side, every target block with every control block, and a task compares one such pair of blocks by matrix products; no
    pairs are listed before they pass, and no nested loop is planned. Rows without a word, rank or usable vector take no part.
    """
    length = lambda: F.length(F.col("word").cast("string"))
    band = F.floor(F.col("rel_rank") / F.lit(max_rank)).cast("long")
    usable = "word is not null and rel_rank is not null and vector is not null"
    plain = lambda df: df.where(usable).select(F.col("word").alias("w"), F.col("rel_rank").alias("r"), F.col("vector").cast("array<double>").alias("v"), band.alias("b"), length().alias("l"))
    wide = plain(targets).select("w", "r", "v", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"), "l")
    wide = wide.select("w", "r", "v", "b", F.explode(F.sequence(F.col("l") - max_length, F.col("l") + max_length)).alias("l"))
    near = plain(candidates)
    blocks = lambda df, name: df.groupBy("b", "l").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias(name))
    sizes = blocks(wide, "ni").join(blocks(near, "nj"), ["b", "l"])  # keys both sides have
    own = lambda n: F.pmod(F.xxhash64("w"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = wide.join(sizes, ["b", "l"]).select("b", "l", own("ni").alias("i"), each("nj").alias("j"), F.lit(True).alias("left"), "w", "r", "v")
    right = near.join(sizes, ["b", "l"]).select("b", "l", each("ni").alias("i"), own("nj").alias("j"), F.lit(False).alias("left"), "w", "r", "v")
    kinds = [dict(df.dtypes)["word"] for df in (targets, candidates)]
    if kinds[0] != kinds[1]:
        raise TypeError(f"words of two types: {kinds}")

    def compare(block: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        side, rank = block.column("left").to_numpy(), block.column("r").to_numpy()
        for width in set(block.column("v").combine_chunks().value_lengths().to_pylist()):
            at, x = unit_rows(block.column("v"), width)
            a, b = at[side[at]], at[~side[at]]
            xa, xb = x[side[at]], x[~side[at]]
            for k in range(0, len(a), 1024):
                close = (xa[k : k + 1024] @ xb.T >= min_cosine) & (np.abs(rank[a[k : k + 1024], None] - rank[b][None, :]) <= max_rank)
                i, j = np.nonzero(close)
                out_a.append(a[k : k + 1024][i])
                out_b.append(b[j])
        words = block.column("w").combine_chunks()
        pick = lambda rows: words.take(pa.array(np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)))
        return pa.table({"neologism": pick(out_a), "control": pick(out_b)})

    found = left.unionByName(right).groupBy("b", "l", "i", "j").applyInArrow(compare, f"neologism {kinds[0]}, control {kinds[0]}")
    return found.where("neologism <> control").distinct()


def radii(neighbours: DataFrame, key: str = "word", min_cosines: Sequence[float] = MIN_COSINES) -> DataFrame:
    """Neighbours repeated for each radius they lie in: one similarity pass serves all radii."""
    each = F.explode(F.array(*[F.lit(r) for r in min_cosines])).alias("min_cos")
    return neighbours.select(key, "neighbour", "cos", each).where(F.col("cos") >= F.col("min_cos"))


def densities(words: DataFrame, neighbours: DataFrame, key: str = "word", min_cosines: Sequence[float] = MIN_COSINES) -> DataFrame:
    """(key, min_cos, n_neighbours, density) for every word and radius; density is ln(n + 1)."""
    grid = words.select(key, F.explode(F.array(*[F.lit(r) for r in min_cosines])).alias("min_cos"))
    sizes = radii(neighbours, key, min_cosines).groupBy(key, "min_cos").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return grid.join(sizes, [key, "min_cos"], "left").select(key, "min_cos", n.alias("n_neighbours"), F.log1p(n).alias("density"))


def growth(neighbours: DataFrame, counts: DataFrame, totals: DataFrame, key: str = "word", min_cosines: Sequence[float] = MIN_COSINES) -> DataFrame:
    """(key, min_cos, slope, monotonicity) of the mean share of each neighbourhood over time.

    ``counts`` (word, step_idx, n) may lack neighbours or steps: those count 0 and stay in the mean's denominator. ``totals`` (step_idx, total)
    is one row a step. The slope is of least squares over the step number, monotonicity is Spearman's rho, null for a constant series.
    """
    inside = radii(neighbours, key, min_cosines)
    sizes = inside.groupBy(key, "min_cos").agg(F.count(F.lit(1)).alias("_n"))
    sums = inside.join(counts.select(F.col("word").alias("neighbour"), "step_idx", "n"), "neighbour").groupBy(key, "min_cos", "step_idx").agg(F.sum("n").alias("_s"))
    steps = [F.struct(F.lit(r["step_idx"]).alias("step_idx"), F.lit(r["total"]).alias("total")) for r in totals.where("step_idx is not null").collect()]  # one row a time step
    if not steps:
        return neighbours.sparkSession.createDataFrame([], f"{key} {dict(neighbours.dtypes)[key]}, min_cos double, slope double, monotonicity double")
    grid = sizes.select("*", F.inline(F.array(*steps)))
    share = F.try_divide(F.coalesce("_s", F.lit(0)).cast("double"), F.col("_n") * F.col("total"))
    series = grid.join(sums, [key, "min_cos", "step_idx"], "left").select(key, "min_cos", "step_idx", share.alias("share"))
    by = Window.partitionBy(key, "min_cos")
    rank = F.rank().over(by.orderBy("share")) + (F.count(F.lit(1)).over(Window.partitionBy(key, "min_cos", "share")) - 1) / 2
    ranked = series.withColumn("_r", rank)
    return ranked.groupBy(key, "min_cos").agg(F.regr_slope("share", "step_idx").alias("slope"), safe_corr(F.col("_r"), F.col("step_idx")).alias("monotonicity"))


def pair_statistics(pairs: DataFrame, density: DataFrame, grown: DataFrame, key: str = "word") -> DataFrame:
    """(neologism, control, word, is_neologism, min_cos, density, slope, monotonicity): both members of every pair that has vectors.

    A pair is left out if either member has no row in ``density``. Where either neighbourhood is empty at a radius, the slopes and monotonicities
    of both are null; densities stay.
    """
    known = density.select(key).distinct()
    both = pairs.join(known.select(F.col(key).alias("neologism")), "neologism", "left_semi").join(known.select(F.col(key).alias("control")), "control", "left_semi")
    members = both.select("neologism", "control", F.explode(F.array(F.struct(F.col("neologism").alias(key), F.lit(1).alias("is_neologism")), F.struct(F.col("control").alias(key), F.lit(0).alias("is_neologism")))).alias("m"))
    rows = members.select("neologism", "control", f"m.{key}", "m.is_neologism").join(density, key).join(grown, [key, "min_cos"], "left")
    least = F.min("n_neighbours").over(Window.partitionBy("neologism", "control", "min_cos"))
    full = least > 0
    return rows.select("neologism", "control", key, "is_neologism", "min_cos", "density", F.when(full, F.col("slope")).alias("slope"), F.when(full, F.col("monotonicity")).alias("monotonicity"))


def group_summary(stats: DataFrame) -> DataFrame:
    """Mean and standard error of each statistic by group and radius; nulls are skipped, one value has no error."""
    names = ("density", "slope", "monotonicity")
    aggs = [x for s in names for x in (F.avg(s).alias(f"{s}_mean"), F.try_divide(F.stddev_samp(s), F.sqrt(F.count(s).cast("double"))).alias(f"{s}_sem"))]
    return stats.groupBy("is_neologism", "min_cos").agg(*aggs)
