"""Interval joins and forward as-of lookups, cut by time so that a busy key is many groups, not one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlay(points: DataFrame, windows: DataFrame, keys: list[str], at: str, begin: str, end: str, width: float, applies: Column | None = None) -> DataFrame:
    """Points with the windows of their keys that hold their time, both ends inclusive; points without one stay once, with nulls.

    Times are numbers. Windows stand in each bucket of ``width`` that they touch, so a width near their usual length keeps them few. ``applies`` is one
    more condition, on columns of both sides. The columns of ``windows`` are prefixed with ``w_``.
    """
    w = windows.select(*[F.col(c).alias(f"w_{c}") for c in windows.columns]).where(F.col(f"w_{begin}") <= F.col(f"w_{end}"))
    bucket = lambda c: F.floor(F.col(c) / width)
    w = w.withColumn("w_bucket", F.explode(F.sequence(bucket(f"w_{begin}"), bucket(f"w_{end}"))))
    inside = (bucket(at) == F.col("w_bucket")) & F.col(at).between(F.col(f"w_{begin}"), F.col(f"w_{end}"))
    for k in keys:
        inside = inside & (F.col(k) == F.col(f"w_{k}"))
    return points.join(w, inside if applies is None else inside & applies, "left").drop("w_bucket")


def next_at(rows: DataFrame, keys: list[str], at: str, is_target: Column, bucket: Column, name: str = "next_at") -> DataFrame:
    """Add the earliest place of a target row of the same keys at or after each row's own, or null. ``bucket`` is a number that never falls as ``at`` rises.

    Rows look ahead within their bucket, by a running minimum from its end; what a bucket lacks comes from the next one that has a target, by a
    running minimum over the table of buckets.
    """
    target = F.when(is_target, F.col(at))
    cut = rows.withColumn("bucket", bucket).withColumn("target", target)
    backwards = Window.partitionBy(*keys, "bucket").orderBy(F.desc(at)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = cut.withColumn("own", F.min("target").over(backwards))
    firsts = cut.groupBy(*keys, "bucket").agg(F.min("target").alias("first"))
    later = Window.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    following = firsts.withColumn("later", F.min("first").over(later)).drop("first")
    same = F.col("bucket") == F.col("f_bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"f_{k}"))
    found = own.join(following.select(*[F.col(c).alias(f"f_{c}") for c in (*keys, "bucket")], "later"), same)
    return found.select(*rows.columns, F.coalesce("own", "later").alias(name))
