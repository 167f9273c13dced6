"""Running sums over a total order without a single-task window.

Rows are range-partitioned by the order, as many partitions as the session's shuffles have, and summed within each; that
is written once. The partitions' totals give each partition what comes before it. So the input is read once to sample the
bounds and once to deal the rows, however often the result is used, and no key or range is held in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .shared import written


def running_sum(df: DataFrame, order: list[tuple[str, bool]], amount: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` (long, not negative, no nulls) up to and with each row, by ``order``: (column, ascending) pairs that are unique."""
    spark = df.sparkSession
    by = [F.asc(c) if up else F.desc(c) for c, up in order]
    dealt = df.withColumn("_own", amount.cast("long")).repartitionByRange(*by).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            at = batch.schema.get_field_index("_own")
            own = before + np.cumsum(batch.column(at).to_numpy())
            before = int(own[-1]) if len(own) else before
            yield batch.set_column(at, "_own", pa.array(own, pa.int64()))

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in dealt.schema])
    summed, _ = written(dealt.mapInArrow(run, schema), "running_sum")
    before, total = [], 0
    for part, own in sorted(summed.groupBy("_part").agg(F.max("_own")).collect()):  # one row for each partition
        before.append((part, total))
        total += own
    offsets = F.broadcast(spark.createDataFrame(before, "_part int, _before long"))
    return summed.join(offsets, "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")
