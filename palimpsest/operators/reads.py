"""Reads: the newest visible version of each key, over a key, a range, several runs, or under staged writes.

Each read is one plan: filters on key and timestamp reach the scan, then one shuffle by key. The rank limit of the
newest version is applied before that shuffle (a window group limit), so a hot key sends one row for each task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.codec import in_range, is_tombstone, visible
from ..plans.asof import asof
from ..plans.prefix import running_sum


def _newest_first(versions: DataFrame) -> list[Column]:
    return [F.desc("commit_ts"), *([F.desc("seq")] if "seq" in versions.columns else [])]


def latest(versions: DataFrame, at: int | None = None, tombstones: bool = False) -> DataFrame:
    """The newest version of each key at a snapshot; keys whose newest version is a tombstone are absent."""
    seen = versions if at is None else versions.where(visible(at))
    top = seen.withColumn("_rn", F.row_number().over(Window.partitionBy("raw_key").orderBy(*_newest_first(versions)))).where("_rn = 1").drop("_rn")
    return top if tombstones else top.where(~is_tombstone(F.col("value")))


def scan(versions: DataFrame, start, end, at: int | None = None) -> DataFrame:
    """Each key of the inclusive range once, at a snapshot."""
    return latest(versions.where(in_range(F.col("raw_key"), start, end)), at)


def get(versions: DataFrame, key, at: int | None = None) -> DataFrame:
    """At most one row: the key's version at a snapshot."""
    own = versions.where(F.col("raw_key") == F.lit(key))
    own = own if at is None else own.where(visible(at))
    # a top-1 needs no shuffle by key: each task keeps one row
    return own.orderBy(*_newest_first(versions)).limit(1).where(~is_tombstone(F.col("value")))


def multi_get(requests: DataFrame, versions: DataFrame, time_buckets: int | None = None) -> DataFrame:
    """For each request (raw_key, begin_ts) the version it sees: a batch of point reads as one as-of lookup.

    Requests and versions meet in one shuffle by key, and no request is paired with all versions of its key. A key with
    a large part of all rows is cut by time; ``time_buckets`` says in how many parts, instead of a count of the rows.
    """
    seq = F.col("seq") if "seq" in versions.columns else None
    r = requests.select("raw_key", "begin_ts").distinct()
    found = asof(r, versions, "raw_key", F.col("begin_ts"), F.col("commit_ts"), F.struct("commit_ts", "value"), seq, time_buckets)
    return found.select("row.raw_key", "row.begin_ts", "at.commit_ts", "at.value").where(~is_tombstone(F.col("value")))


def all_versions(versions: DataFrame) -> DataFrame:
    """All versions with their place (pos, from 1) in key order, newest first within a key."""
    ranked = running_sum(versions, [("raw_key", True), ("commit_ts", False)], F.lit(1).cast("long"), "pos")
    return ranked


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """The union of runs, newest first in the list; of one key and timestamp the newest run's version stays."""
    marked = reduce(DataFrame.unionByName, [r.withColumn("_prio", F.lit(i)) for i, r in enumerate(runs)])
    return dedup_runs(marked, F.col("_prio")).drop("_prio")


def dedup_runs(versions: DataFrame, *order: Column) -> DataFrame:
    """One version of each (raw_key, commit_ts): the first by ``order``."""
    w = Window.partitionBy("raw_key", "commit_ts").orderBy(*order)
    return versions.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def overlay(staged: DataFrame, base: DataFrame) -> DataFrame:
    """Staged writes (raw_key, value) over stored rows; staged deletes hide stored keys."""
    kept = base.join(staged.select("raw_key"), "raw_key", "left_anti")
    return staged.select("raw_key", "value").unionByName(kept.select("raw_key", "value")).where(~is_tombstone(F.col("value")))


def pending(staged: DataFrame) -> DataFrame:
    """Staged writes in key order, later writes of a key first."""
    return staged.orderBy("raw_key", F.desc("seq"))


def of_kind(staged: DataFrame, kind: int) -> DataFrame:
    """The staged puts, or the staged deletes."""
    return staged.where(F.col("kind") == kind)


def stamp(staged: DataFrame, commit_ts: int) -> DataFrame:
    """A staged batch as versions of one commit: the last write of each key, deletes as empty values."""
    w = Window.partitionBy("raw_key").orderBy(F.desc("seq"))
    last = staged.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    empty = F.lit("").cast(staged.schema["value"].dataType)
    return last.select("raw_key", F.lit(commit_ts).cast("long").alias("commit_ts"), F.when(F.col("kind") == 2, empty).otherwise(F.col("value")).alias("value"), "seq")
