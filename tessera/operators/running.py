"""Running aggregates and rolling windows over hot keys, split by ranges of rows.

A window function keeps all rows of a key in one task. Here rows are dealt by ranges of (key, order), each range
is aggregated alone, and what earlier ranges of the key hold is added: one row for each key and range.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ship, shuffle_partitions, written

#: Rows of one key in a segment of a rolling window.
SEGMENT = 16_384


def running(df: DataFrame, key: list[str], order: list[str], value: Column, how: str, to: str) -> DataFrame:
    """df with `to`: the sum or maximum of value over the rows of the key up to this one, in a total order.

    Null values are passed over; a null key is a key of its own. Ties in order are broken as the shuffle leaves them.
    """
    agg = {"sum": F.sum, "max": F.max}[how]
    d = df.withColumn("__v", value).repartitionByRange(shuffle_partitions(df.sparkSession), *key, *order).withColumn("__slice", F.spark_partition_id())
    d = written(d, "running")
    per = d.groupBy(*key, "__slice").agg(agg("__v").alias("__p"))
    earlier = Window.partitionBy(*key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    names = [f"__k{i}" for i in range(len(key))]
    before = per.withColumn("__b", agg("__p").over(earlier)).select(*[F.col(k).alias(n) for k, n in zip(key, names, strict=True)], F.col("__slice").alias("__s"), "__b")
    mine = d.withColumn("__r", agg("__v").over(Window.partitionBy(*key, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    same = F.col("__slice") == F.col("__s")
    for k, n in zip(key, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    both = mine.join(before, same)
    total = F.greatest("__r", "__b") if how == "max" else F.coalesce(F.col("__r"), F.lit(0)) + F.coalesce(F.col("__b"), F.lit(0))
    return both.select(*[F.col(f"`{c}`") for c in df.columns], total.alias(to))


def numbered(df: DataFrame, key: list[str], order: list[str], to: str = "off") -> DataFrame:
    """df with `to`: 0, 1, 2, ... in each key, in the given order."""
    return running(df, key, order, F.lit(1).cast("long"), "sum", to).withColumn(to, F.col(to) - 1)


def rolling(df: DataFrame, key: str, order: str, value: str, last: int) -> DataFrame:
    """df with n, mean and sd (population) of the `last` values of the key before each row; nulls do not count.

    Rows are numbered, cut into segments, and each segment is sent the `last` rows before it.
    """
    n = numbered(df, [key], [order], "__i")
    size = max(SEGMENT, last)
    seg = F.expr(f"__i div {size}")
    spread = F.when(F.col("__i") % size >= size - last, F.array(seg, seg + 1)).otherwise(F.array(seg))
    dealt = n.withColumn("__g", F.explode(spread))
    fields = [*df.schema.fields]

    def run(k: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("__i")
        w = p[value].astype("float64").shift(1).rolling(last, min_periods=1)
        p = p.assign(n=w.count().fillna(0).astype("int64"), mean=w.mean(), sd=w.std(ddof=0))
        return p[p["__i"] // size == k[1]].drop(columns=["__i", "__g"])

    ship(df.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n long, mean double, sd double"
    return dealt.groupBy(key, "__g").applyInPandas(run, schema)


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, tie: str, carry: str) -> DataFrame:
    """left with `carry` of the last row of right at or before it (by at, then tie), null if there is none.

    Both sides are laid together and the greatest (at, tie) of right is carried forward by a running maximum: no pair of
    rows is built, and a hot key is split.
    """
    none = F.lit(None)
    mark = F.struct(F.col(at).alias("a"), F.col(tie).alias("t"), F.col(carry).alias("c"))
    b = right.select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), none.cast(left.schema).alias("__row"), mark.alias("__mark"))
    a = left.select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.lit(1).alias("__side"), none.cast(right.schema[tie].dataType).alias("__tie"), F.struct(*left.columns).alias("__row"), none.cast(b.schema["__mark"].dataType).alias("__mark"))
    both = running(a.unionByName(b), ["__key"], ["__at", "__side", "__tie"], F.col("__mark"), "max", "__last")
    return both.where("__side = 1").select("__row.*", F.col("__last.c").alias(carry))
