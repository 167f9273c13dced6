"""As-of lookup: for each left row the last right row of its key at or before its time.

Both sides are merged by key in time order and the last right row is carried forward, so no pairs are made. If a key has
more than ``KEY_ROWS`` rows, which is counted, or with ``time_buckets`` above 1, timelines are cut, so that a key with a large part of all
rows spreads over as many tasks: the last row of each bucket, found by aggregation, is carried over the buckets, of
which a key has few, and opens the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


#: Rows of a key that one task takes.
KEY_ROWS = 2_000_000


def asof(left: DataFrame, right: DataFrame, key: str, left_ts: Column, right_ts: Column, carried: Column, seq: Column | None = None, time_buckets: int | None = None) -> DataFrame:
    """(row, at): ``row`` a struct of the left row, ``at`` what ``carried`` gives for its right row. Left rows without one are left out."""
    seq = F.lit(0) if seq is None else seq
    r = right.select(F.col(key).alias("_k"), right_ts.alias("_ts"), F.lit(0).alias("_left"), seq.cast("long").alias("_seq"), carried.alias("_v"))
    none = F.lit(None).cast(r.schema["_v"].dataType)
    l = left.select(F.col(key).alias("_k"), left_ts.alias("_ts"), F.lit(1).alias("_left"), F.lit(0).cast("long").alias("_seq"), none.alias("_v"), F.struct("*").alias("row"))
    every = r.withColumn("row", F.lit(None).cast(l.schema["row"].dataType)).unionByName(l)
    by = ["_k"]
    if time_buckets is None:
        keys = left.select(F.col(key).alias("_k")).unionAll(right.select(F.col(key).alias("_k"))).groupBy("_k").count()
        time_buckets = -(-(keys.agg(F.max("count")).first()[0] or 0) // KEY_ROWS)
    if time_buckets > 1:
        low, high = right.agg(F.min(right_ts), F.max(right_ts)).first()
        if low is None:
            return every.where(F.lit(False)).select("row", F.col("_v").alias("at"))
        width = max(1, -(-(high - low + 1) // time_buckets))
        bucket = F.greatest(F.least(F.floor((F.col("_ts") - low) / width), F.lit(time_buckets)), F.lit(-1)).cast("int")
        every, by = every.withColumn("_b", bucket), ["_k", "_b"]
        seen = every.groupBy("_k", "_b").agg(F.max_by(F.struct("_v"), F.when(F.col("_left") == 0, F.struct("_ts", "_seq"))).alias("_last"))
        before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        opening = seen.withColumn("_open", F.last("_last", ignorenulls=True).over(before)).where("_open is not null")
        opening = opening.select("_k", F.lit(None).cast("long").alias("_ts"), F.lit(-1).alias("_left"), F.lit(0).cast("long").alias("_seq"), F.col("_open._v").alias("_v"), F.lit(None).cast(l.schema["row"].dataType).alias("row"), "_b")
        every = every.unionByName(opening)
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_first("_ts"), "_left", "_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return every.withColumn("at", F.last("_v", ignorenulls=True).over(w)).where("_left = 1 and at is not null").select("row", "at")
