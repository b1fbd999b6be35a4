"""Static word vectors: training, and orthogonal alignment of two vector tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Word2Vec
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.operators.counts import positions
from lexitide.runtime import parallelism


def train_vectors(sentences: DataFrame, size: int = 300, window: int = 5, min_count: int = 5, max_vocabulary: int | None = None, iterations: int = 1, seed: int = 0, partitions: int | None = None, save: str | None = None) -> DataFrame:
    """(word, idx, count, vector) of skip-gram vectors learnt from ``sentences.tokens``; idx orders words by descending count.

    With ``max_vocabulary`` the minimum count is raised until no more words than that are left. Sentences are learnt from in ``partitions``
    tasks (by default as many as the session shuffles into); each round averages what they learnt, so more tasks want more ``iterations``.
    With ``save`` the model is written there too.
    """
    counts = sentences.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= min_count)
    if max_vocabulary:
        top = counts.orderBy(F.desc("count"), "word").limit(max_vocabulary + 1).agg(F.count(F.lit(1)).alias("n"), F.min("count").alias("least")).first()
        if top["n"] > max_vocabulary:
            min_count = top["least"] + 1
            counts = counts.where(F.col("count") >= min_count)
    parts = partitions or parallelism(sentences.sparkSession)
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, maxIter=iterations, numPartitions=parts, seed=seed, inputCol="tokens", outputCol="v").fit(sentences.where(F.size("tokens") > 0))
    from pyspark.ml.functions import vector_to_array

    vectors = model.getVectors().select("word", vector_to_array("vector").cast("array<float>").alias("vector"))
    if save:
        model.write().overwrite().save(save)
    order = positions(counts.withColumnRenamed("count", "n")).select("word", (F.col("position") - 1).cast("int").alias("idx"), F.col("n").alias("count"))
    return vectors.join(order, "word").select("word", "idx", "count", "vector")


def common_vocabulary(first: DataFrame, second: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(word, first_vector, second_vector) of words both tables have, and the word list too if one is given."""
    both = first.select("word", F.col("vector").alias("first_vector")).join(second.select("word", F.col("vector").alias("second_vector")), "word")
    return both.join(words.select("word").distinct(), "word", "left_semi") if words is not None else both


CROSS = "i int, j int, m double"


def cross_product(base: DataFrame, other: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(i, j, m): the d x d matrix of other's and base's vectors multiplied over the common vocabulary.

    Every task adds up its own rows in BLAS and hands on one d x d matrix, so the shuffle is d * d numbers a task.
    """
    both = common_vocabulary(base, other, words)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            b, o = (np.array(batch.column(c).to_pylist(), dtype=np.float64) for c in ("first_vector", "second_vector"))
            if len(b):
                total = o.T @ b if total is None else total + o.T @ b
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "m"])

    return both.mapInArrow(partial, CROSS).groupBy("i", "j").agg(F.sum("m").alias("m"))


def rotation(cross: DataFrame) -> np.ndarray:
    """The orthogonal matrix that turns other's vectors towards base's; d x d, solved on the driver."""
    cells = cross.toPandas()
    d = int(max(cells["i"].max(), cells["j"].max())) + 1
    m = np.zeros((d, d))
    m[cells["i"], cells["j"]] = cells["m"]
    u, _, vt = np.linalg.svd(m)
    return u @ vt


def align(base: DataFrame, other: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """``other`` with all its vectors turned into ``base``'s space (words outside the common vocabulary too)."""
    turn = rotation(cross_product(base, other, words))
    held = other.sparkSession.sparkContext.broadcast(turn)  # d x d
    at = other.columns.index("vector")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(at).to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1) @ held.value if batch.num_rows else np.zeros((0, len(held.value)))
            columns = list(batch.columns)
            columns[at] = pa.array(list(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    fields = ", ".join(f"`{n}` {'array<double>' if n == 'vector' else t}" for n, t in other.dtypes)
    return other.where("vector is not null").mapInArrow(apply, fields)
