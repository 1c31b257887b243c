"""Running values along an order in two levels, so that a key with a third of all rows is many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written

#: What runs along a key: the value of a block of rows, and how a row's own run goes on from the blocks before it.
KINDS = {
    "sum": (F.sum, lambda before, own: F.coalesce(before + own, before, own)),
    "min": (F.min, lambda before, own: F.least(before, own)),
    "max": (F.max, lambda before, own: F.greatest(before, own)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda before, own: F.coalesce(own, before)),
    "first": (lambda c: F.first(c, ignorenulls=True), lambda before, own: F.coalesce(before, own)),
}


def running(df: DataFrame, key: list[str], order: list[str], **values: tuple[str, str | Column]) -> DataFrame:
    """``df`` with running values of each key up to and with each row, in ``order``: ``name=(kind, column)``, kinds as in
    KINDS; nulls are passed over, as by window functions.

    Rows are range-partitioned by key and order and written: a block is what one partition holds of a key. Windows run
    within blocks; the blocks' own values, a row each, run in a second, small window; a row then goes on from the
    blocks before its own. Rows that are equal in key and order stand in one block, in no certain order.
    """
    dealt = df.withColumns({f"_{n}": F.expr(c) if isinstance(c, str) else c for n, (_, c) in values.items()})
    dealt = written(dealt.repartitionByRange(*key, *order).withColumn("_block", F.spark_partition_id()))
    in_block = Window.partitionBy(*key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumns({n: KINDS[kind][0](f"_{n}").over(in_block) for n, (kind, _) in values.items()})

    at = F.struct(*order)
    whole = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)), "first": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), at))}
    blocks = dealt.groupBy(*key, "_block").agg(*[whole[kind](f"_{n}").alias(f"_{n}") for n, (kind, _) in values.items()])
    earlier = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*[F.col(k).alias(f"_key_{k}") for k in key], F.col("_block").alias("_at"), *[KINDS[kind][0](f"_{n}").over(earlier).alias(f"_before_{n}") for n, (kind, _) in values.items()])
    same = F.col("_block") == F.col("_at")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    met = own.join(carried, same)
    return met.select(*df.columns, *[KINDS[kind][1](F.col(f"_before_{n}"), F.col(n)).alias(n) for n, (kind, _) in values.items()])
