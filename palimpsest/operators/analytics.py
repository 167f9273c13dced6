"""Reports over versions, runs, batches and transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.codec import bloom_bits, entry_size, hash_functions
from ..plans.asof import asof
from ..plans.prefix import running_sum


def run_meta(versions: DataFrame, run: str = "run_id") -> DataFrame:
    """Key and timestamp bounds, rows and bytes of each run."""
    return versions.groupBy(run).agg(
        F.min("raw_key").alias("lo"), F.max("raw_key").alias("hi"), F.min("commit_ts").alias("lo_ts"), F.max("commit_ts").alias("hi_ts"),
        F.count("*").alias("n_rows"), F.sum(entry_size()).cast("long").alias("n_bytes"))


def prune(runs: DataFrame, start, end, at: int) -> DataFrame:
    """The runs whose key bounds meet the inclusive range and that have a version the snapshot can see."""
    return runs.where((F.col("hi") >= F.lit(start)) & (F.col("lo") <= F.lit(end)) & (F.col("lo_ts") <= at))


def block_meta(versions: DataFrame, capacity: int = 4092, overhead: int = 6) -> DataFrame:
    """(block_no, first_key, last_key, n_rows) of blocks filled in key order."""
    placed = running_sum(versions, [("raw_key", True), ("commit_ts", False)], (entry_size() + overhead).cast("long"), "cum")
    block = F.floor((F.col("cum") - 1) / capacity).cast("long")
    return placed.groupBy(block.alias("block_no")).agg(F.min("raw_key").alias("first_key"), F.max("raw_key").alias("last_key"), F.count("*").alias("n_rows"))


def duplicate_keys(batches: DataFrame, batch: str = "batch_id") -> DataFrame:
    return batches.groupBy(batch, "raw_key").agg(F.count("*").alias("n")).where("n > 1")


def batch_sizes(batches: DataFrame, batch: str = "batch_id") -> DataFrame:
    return batches.groupBy(batch).agg(F.sum(entry_size()).cast("long").alias("n_bytes"), F.count("*").alias("n_rows"))


def can_fit(sizes: DataFrame, capacity: int, used: int = 0) -> DataFrame:
    """Batches (n_bytes) that fit beside what is used already; one that does not makes the buffer freeze."""
    return sizes.where(F.col("n_bytes") + used <= capacity)


def level_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("level").agg(F.count("*").alias("cnt"))


def cleanable_runs(references: DataFrame) -> DataFrame:
    """Runs whose reference changes (run_id, delta) sum to zero or less."""
    return references.groupBy("run_id").agg(F.sum("delta").cast("long").alias("refs")).where("refs <= 0")


def low_watermark(marks: DataFrame) -> DataFrame:
    """done_till: the greatest timestamp below which all that began (delta 1) has finished (delta -1)."""
    pending = marks.groupBy("ts").agg(F.sum("delta").alias("pending"))
    lists = pending.agg(F.min(F.when(F.col("pending") > 0, F.col("ts"))).alias("first_open"), F.max("ts").alias("last"))
    below = F.max(F.when(F.col("o").isNull() | (F.col("ts") < F.col("o")), F.col("ts")))
    return pending.withColumn("o", lists.select("first_open").scalar()).agg(F.coalesce(below, F.lit(0)).cast("long").alias("done_till"))


def last_commit(versions: DataFrame) -> DataFrame:
    return versions.agg(F.max("commit_ts").alias("last_commit_ts"), F.countDistinct("raw_key").alias("n_keys"))


def live_memtables(events: DataFrame) -> DataFrame:
    """Ids that a manifest log (etype 0: created, 1: flushed) leaves unflushed."""
    one = lambda t: F.sum((F.col("etype") == t).cast("int"))
    return events.groupBy("id").agg(one(0).alias("c"), one(1).alias("f")).where("c > 0 and f = 0").select("id")


def tracked_commits(commits: DataFrame, watermark: int) -> DataFrame:
    """Commits that conflict checks still need: those above the oldest active begin timestamp."""
    return commits.where(F.col("commit_ts") > watermark)


def bloom_sizing(versions: DataFrame, run: str = "run_id", false_positives: float = 0.01) -> DataFrame:
    counted = versions.groupBy(run).agg(F.count("*").alias("n_entries"))
    return counted.select(run, "n_entries", bloom_bits(F.col("n_entries"), false_positives).alias("n_bits"), F.lit(hash_functions(false_positives)).alias("n_hash"))


def conflicting_txns(reads: DataFrame, commits: DataFrame, time_buckets: int | None = None) -> DataFrame:
    """Transactions (txn_id, begin_ts, end_ts, raw_key) that read a key committed after begin_ts and up to end_ts.

    It is enough to look at the last commit of the key up to end_ts.
    """
    found = asof(reads, commits, "raw_key", F.col("end_ts"), F.col("commit_ts"), F.col("commit_ts"), None, time_buckets)
    return found.where(F.col("at") > F.col("row.begin_ts")).select("row.txn_id").distinct()
