"""Sharding by a two-pass external shuffle.

Pass one scatters the records over buckets that fit into memory, by a seeded hash of each record's number, so equal
texts or ids spread like any others. A task gets several buckets where there are many, sorted (on disk if need be), so that the
number of shuffle files does not grow with the number of buckets. Pass two puts each bucket into a defined order, shuffles it by a seeded
Fisher-Yates and writes it; a task holds one bucket at a time. A record's place in the shuffled order is its bucket's offset plus its place there; places
are dealt to the shards in turn, so shard sizes in rows are at most one apart (law ``rows``) and slots run from 0
without gaps.

Defined results: record numbers follow the input's partitions, so the order is fixed by the seed and the input files;
a null text has no bytes; repeated rows are records of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import join_sized, materialize

SHARDS = 8
SEED = 20240
#: Bytes of text that a bucket holds on average; buckets that one task shuffles one after another, at most.
BUCKET_BYTES, TASK_BUCKETS = 16_000_000, 256


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of range(n) by Fisher and Yates' exchanges, fixed by seed and bucket."""
    rng = np.random.Generator(np.random.PCG64([seed, bucket]))
    order = np.arange(n)
    picks = rng.integers(0, np.arange(n, 0, -1)) if n else order
    for i, j in enumerate(picks.tolist()):
        k = n - 1 - i
        order[k], order[j] = order[j], order[k]
    return order


def shuffled(docs: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, text_col: str = "text") -> tuple[DataFrame, int]:
    """(row struct, bucket, place) for each row, written to the shared folder, and the number of buckets."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 64)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    rows = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number"))
    rows = rows.select("row", "number", F.pmod(F.xxhash64(F.lit(seed), "number"), F.lit(buckets)).cast("int").alias("bucket"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def mixed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            order = fisher_yates(len(table), seed, table["bucket"][0].as_py())
            place = np.empty(len(table), np.int64)
            place[order] = np.arange(len(table))
            return table.drop_columns(["number"]).append_column("place", pa.array(place)).to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:  # sorted by bucket: cut where the bucket changes
            bucket = batch.column(batch.schema.get_field_index("bucket")).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    part = batch.slice(a, b - a)
                    if held and held[0].column(held[0].schema.get_field_index("bucket"))[0].as_py() != int(bucket[a]):
                        yield from mixed(held)
                        held = []
                    held.append(part)
        if held:
            yield from mixed(held)

    tasks = min(buckets, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-buckets // TASK_BUCKETS)))
    scattered = rows.repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket", "number")
    schema = scattered.drop("number").schema.add("place", "long")
    return materialize(scattered.mapInArrow(run, schema), "shuffled"), buckets


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, text_col: str = "text") -> DataFrame:
    """(row struct, shard, slot) for each row of ``docs``."""
    rows, buckets = shuffled(docs, seed, bucket_bytes, text_col)
    # what comes before each bucket: sums within groups of buckets, and the groups' totals, one for 1024 buckets
    group = F.shiftright("bucket", 10)
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("g", group)
    before, total = [], 0
    for g, n in sorted(counts.groupBy("g").agg(F.sum("n")).collect()):
        before.append((g, total))
        total += n
    w = Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = docs.sparkSession.createDataFrame(before, "g int, before long")
    table = counts.withColumn("own", F.sum("n").over(w)).join(F.broadcast(groups), "g")
    table = table.select("bucket", (F.col("before") + F.col("own") - F.col("n")).alias("offset"))
    rows = join_sized(rows, table, buckets * 48, ["bucket"], "inner")
    at = F.col("offset") + F.col("place")
    return rows.select("row", (at % shards).cast("int").alias("shard"), F.floor(at / shards).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes the shards as Parquet folders ``shard=0`` and so on, each file's rows in slot order."""
    out = shard(docs, **options)
    out.select("row.*", "shard", "slot").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return out.select(
        F.col("row.doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
