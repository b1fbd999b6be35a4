"""Problem 5: exactly one row of every message that was delivered at least once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number_id(column: Column) -> Column:
    """The number an id denotes, however it is written (blanks around, leading zeros, a sign); null where it is none."""
    plain = F.regexp_replace(column, r"(?U)^\s+|\s+$", "")
    return F.when(plain.rlike(r"^[+-]?[0-9]+$"), plain.try_cast("bigint"))


def one_per_message(
    df: DataFrame, key: str = "id", order: tuple[str, ...] = ("received_at", "batch_no", "line_no"), columns: tuple[str, ...] | None = None
) -> DataFrame:
    """One row per message number: the delivery that came first, and ``n_deliveries``.

    The first delivery is the least by ``order``, nulls last; deliveries that tie there are told apart by a 64-bit hash of
    the whole row, so the result doesn't depend on how rows are arranged, and deliveries that still tie are one row repeated.
    Rows whose key denotes no number are ignored. One aggregation with ``min_by``: every task first reduces its own rows to one a
    message, so a message with very many copies shuffles one row a task, and what is kept of a row travels once. Its state holds
    structs, which Spark aggregates over rows sorted by key (spilling to disk), not in a hash table. The kept row has all columns of
    ``df``, or those of ``columns``, with the key as a bigint; a column called ``n_deliveries`` is replaced.
    """
    kept = [c for c in (df.columns if columns is None else columns) if c not in (key, "n_deliveries")]
    late = [x for c in order if c in df.columns for x in (F.col(c).isNull(), F.col(c))]
    tie = F.xxhash64(*[F.col(c).cast("string") for c in df.columns], *[F.isnull(c) for c in df.columns])  # a hash skips nulls
    name = "_number" + "_" * sum(c.lower().startswith("_number") for c in df.columns)  # a name no column has
    rows = df.withColumn(name, number_id(F.col(key).cast("string"))).where(F.col(name).isNotNull())
    first = F.min_by(F.struct(F.col(name), *[F.col(c) for c in kept]), F.struct(*late, tie)).alias("_row")
    found = rows.groupBy(F.col(name).alias("_group")).agg(F.count(F.lit(1)).alias("n_deliveries"), first)
    # the key comes from the kept row too
    return found.select(F.col("_row")[name].alias(key), *[F.col("_row")[c].alias(c) for c in kept], "n_deliveries")
