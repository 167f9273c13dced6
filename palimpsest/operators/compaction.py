"""Compaction: which levels to merge, which versions to retain, where to cut the output."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.codec import entry_size, is_tombstone
from ..plans.prefix import running_sum


@dataclass(frozen=True)
class CompactionOptions:
    ratio_percent: int = 200
    max_levels: int = 6
    level0_trigger: int = 6


@dataclass(frozen=True)
class Pick:
    """Levels to merge; upper -1 stands for level 0."""

    upper_level: int
    lower_level: int


def retain(versions: DataFrame, watermark: int, bottom: bool) -> DataFrame:
    """The versions that some snapshot at or after ``watermark`` can still see.

    All above the watermark and the newest at or below it stay; at the bottom level that newest one goes if it is a
    tombstone, as nothing older is left that it would hide.

    The rank is needed only at or below the watermark, and there a group limit before the shuffle leaves one row of a
    key for each task; versions above it pass without a shuffle.
    """
    order = [F.desc("commit_ts"), *([F.desc("seq")] if "seq" in versions.columns else [])]
    old = versions.where(F.col("commit_ts") <= watermark)
    old = old.withColumn("_rn", F.row_number().over(Window.partitionBy("raw_key").orderBy(*order))).where("_rn = 1").drop("_rn")
    if bottom:
        old = old.where(~is_tombstone(F.col("value")))
    return versions.where(F.col("commit_ts") > watermark).unionByName(old)


def pick(counts: DataFrame, options: CompactionOptions) -> DataFrame:
    """At most one row (upper_level, lower_level) from run counts (level, cnt)."""
    lower = counts.select((F.col("level") - 1).alias("level"), F.col("cnt").alias("nxt"))
    pairs = counts.join(lower, "level").where((F.col("cnt") > 0) & (F.col("level") < options.max_levels))
    due = pairs.where(((F.col("level") > 0) | (F.col("cnt") >= options.level0_trigger)) & (100.0 * F.col("nxt") / F.col("cnt") < options.ratio_percent))
    first = due.orderBy("level").limit(1)
    return first.select(F.when(F.col("level") == 0, -1).otherwise(F.col("level")).cast("int").alias("upper_level"), (F.col("level") + 1).cast("int").alias("lower_level"))


def pick_counts(counts: dict[int, int], options: CompactionOptions) -> Pick | None:
    """The same choice from the catalog's own counts, for the driver's control loop."""
    for level in range(options.max_levels):
        n, below = counts.get(level, 0), counts.get(level + 1, 0)
        if n and (level or n >= options.level0_trigger) and 100.0 * below / n < options.ratio_percent:
            return Pick(-1 if level == 0 else level, level + 1)
    return None


def output_runs(versions: DataFrame, target_bytes: int) -> DataFrame:
    """(out_run, lo, hi, n_bytes): outputs of about target_bytes, cut only between keys."""
    sizes = versions.groupBy("raw_key").agg(F.sum(entry_size() + 6).cast("long").alias("sz"))
    placed = running_sum(sizes, [("raw_key", True)], F.col("sz"), "cum")
    run = F.floor((F.col("cum") - F.col("sz")) / target_bytes).cast("long")
    return placed.groupBy(run.alias("out_run")).agg(F.min("raw_key").alias("lo"), F.max("raw_key").alias("hi"), F.sum("sz").cast("long").alias("n_bytes"))
