"""Line dedup by distinct-site spread: lines found on many sites are boilerplate, of which one copy stays.

A HyperLogLog sketch of its sites is kept for each line hash and merged by aggregation. Lines whose estimate is far
from the threshold are settled by it; those near it get an exact distinct count. Lines too rare to reach the threshold
or seen on one site only (both told exactly by a plain aggregate) need no sketch. Of each boilerplate line the first
place in the smallest document id stays. All steps are DataFrame expressions.

Defined results: lines are split at "\\n" and compared after trimming blanks; lines of blanks never count; a null text
is kept as null; a null site counts for no spread; rows of one document id and text are treated alike; documents of a
null id keep a line only if all its documents are such. Lines are told by a 64-bit hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import join_sized, let, materialize, size_of

#: A line on so many distinct sites is boilerplate.
MIN_SITES = 10
LG_K = 11
TRIMMED = " \t\r\x0b\x0c"


def _line_hashes(text: Column) -> Column:
    """A hash for each line, null for a blank one."""
    return F.transform(F.split(text, "\n"), lambda x: let(F.btrim(x, F.lit(TRIMMED)), lambda y: F.when(y != "", F.xxhash64(y))))


def _lines(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text_hash, site, h) for each distinct line of each row."""
    return docs.select(
        F.col("r.doc_id").alias("doc_id"), F.xxhash64("r.text").alias("text_hash"), F.col("r.site").alias("site"),
        F.explode(F.array_compact(F.array_distinct(_line_hashes(F.col("r.text"))))).alias("h"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(h, keeper) of the lines on ``min_sites`` sites or more; keeper: the smallest document id that has the line.

    docs: rows of one struct ``r`` with doc_id, text, site.
    """
    lines = _lines(docs)
    site_hash = F.xxhash64("site")
    seen = F.when(F.col("site").isNotNull(), site_hash)
    spread = (
        lines.groupBy("h").agg(F.count("site").alias("n"), F.min(seen).alias("lo"), F.max(seen).alias("hi"), F.min("doc_id").alias("keeper"))
        .where((F.col("n") >= min_sites) & ((F.col("lo") != F.col("hi")) | F.lit(min_sites <= 1)))
    )
    candidates = materialize(spread.select("h", "keeper"), "line_candidates")
    n = size_of(candidates)
    sketches = (
        join_sized(lines.where("site is not null"), candidates.select("h"), n, ["h"], "left_semi")
        .groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("estimate"))
    )
    band = max(1, math.ceil(4 * 1.04 / math.sqrt(1 << lg_k) * min_sites))
    sketches = materialize(sketches.where(F.col("estimate") >= min_sites - band), "line_sketches")
    near = sketches.where(F.col("estimate") < min_sites + band).select("h")
    exact = (
        join_sized(lines.where("site is not null"), near, size_of(near), ["h"], "left_semi")
        .groupBy("h", "site").agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("sites"))
        .where(F.col("sites") >= min_sites).select("h")
    )
    found = sketches.where(F.col("estimate") >= min_sites + band).select("h").unionAll(exact)
    return materialize(candidates.join(found, "h", "left_semi"), "line_boilerplate")


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, id_col: str = "doc_id",
               text_col: str = "text", site_col: str = "source") -> DataFrame:
    """Every row of ``docs`` with its text less the removed lines, and ``n_removed`` (long), as (row struct ``r``, text, n_removed)."""
    rows = docs.select(F.struct(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(site_col).alias("site")).alias("r"), F.struct("*").alias("row"))
    found = boilerplate(rows, min_sites, lg_k)
    n = size_of(found)
    places = rows.select(F.col("r.doc_id").alias("_id"), F.xxhash64("r.text").alias("_hash"), F.posexplode(_line_hashes(F.col("r.text"))).alias("i", "h")).where("h is not null")
    hits = join_sized(places, found, n, ["h"], "inner").select("_id", "_hash", F.struct("h", "i", F.col("_id").eqNullSafe(F.col("keeper")).alias("mine")).alias("x"))
    # of a line that this document keeps, all places but the first go
    marks = let(F.sort_array("marks"), lambda m: F.transform(F.filter(m, lambda x, k: ~(x["mine"] & ((k == 0) | (F.get(m, k - 1)["h"] != x["h"])))), lambda x: x["i"]))
    drops = hits.groupBy("_id", "_hash").agg(F.collect_set("x").alias("marks")).select("_id", "_hash", F.sort_array(marks).alias("gone"))
    drops = materialize(drops.where(F.size("gone") > 0), "line_drops")
    joined = join_sized(rows, drops, size_of(drops), F.col("r.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("r.text") == F.col("_hash")), "left")

    def kept(parts: Column, gone: Column) -> Column:
        """The lines between those that go."""
        start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(gone, k - 1) + 1)
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda k: F.slice(parts, start(k) + 1, F.coalesce(F.get(gone, k), F.size(parts)) - start(k))))

    cut = let(F.split("r.text", "\n"), lambda parts: F.array_join(kept(parts, F.col("gone")), "\n"))
    return joined.select(
        "row", F.when(F.col("gone").isNull(), F.col("r.text")).otherwise(cut).alias("text"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"))


def op8(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("row.doc_id", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, source, text, i, trim(x, chr(32)||chr(9)||chr(13)||chr(11)||chr(12)) AS k, x
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
b AS (SELECT k, min(doc_id) AS keeper FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= 10),
f AS (SELECT doc_id, k, min(i) AS first_i FROM l WHERE k <> '' GROUP BY doc_id, k),
m AS (SELECT l.doc_id, l.i, l.x, b.k IS NOT NULL AND NOT (b.keeper = l.doc_id AND f.first_i = l.i) AS gone
  FROM l LEFT JOIN b ON b.k = l.k LEFT JOIN f ON f.doc_id = l.doc_id AND f.k = l.k),
t AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text FROM m GROUP BY doc_id)
SELECT doc_id, n_removed, CAST(length(text) AS BIGINT) AS n_chars_left, md5(text) AS text_md5 FROM t
"""
