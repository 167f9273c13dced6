"""The query catalogue over a version log made from ``events``: DataFrame plans and the same results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import analytics, compaction, reads


def kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raw_key, commit_ts, value, run_id) of the events; errors are tombstones."""
    e = events(spark, sf_dir)
    return e.select(
        F.lpad(F.col("user_id").cast("string"), 6, "0").alias("raw_key"), (F.col("event_id") + 1).alias("commit_ts"),
        F.when(F.col("event_type") == "error", "").otherwise(F.col("props")).alias("value"), F.floor(F.col("event_id") / 1000).cast("long").alias("run_id"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _versions(df: DataFrame) -> DataFrame:
    return df.select("raw_key", "commit_ts", "value")


def q1(spark, d):
    return _versions(reads.get(kv(spark, d), "000042", 7000))


def q2(spark, d):
    return _versions(reads.scan(kv(spark, d), "000010", "000050", 5000))


def q3(spark, d):
    return _versions(reads.latest(kv(spark, d), 5000))


def q4(spark, d):
    return reads.all_versions(_versions(kv(spark, d))).select("raw_key", "commit_ts", "value", "pos")


def q5(spark, d):
    v = kv(spark, d)
    newer, older = v.where("run_id >= 5"), v.where("run_id <= 6").withColumn("value", F.concat(F.lit("x"), F.col("value")))
    return reads.merge_runs([_versions(newer), _versions(older)])


def q6(spark, d):
    v = kv(spark, d).where(F.col("raw_key").between("000010", "000090"))
    staged = reads.latest(v.where("commit_ts > 9900"), tombstones=True)
    return reads.overlay(staged, reads.latest(v, 9900, tombstones=True))


def q7(spark, d):
    return _versions(compaction.retain(kv(spark, d), 5000, bottom=True))


def q8(spark, d):
    return _versions(compaction.retain(kv(spark, d), 5000, bottom=False))


def q9(spark, d):
    v = kv(spark, d).withColumn("run_id", F.floor(F.col("raw_key").cast("long") / 20).cast("long"))
    return analytics.prune(analytics.run_meta(v), "000030", "000070", 5000).select("run_id", "lo", "hi", "n_rows")


def q10(spark, d):
    return analytics.block_meta(kv(spark, d))


def q11(spark, d):
    return compaction.output_runs(kv(spark, d), 65536)


def q12(spark, d):
    counts = spark.createDataFrame([(0, 1), (1, 2), (2, 1), (3, 0)], "level int, cnt int")
    return compaction.pick(counts, compaction.CompactionOptions(level0_trigger=2))


def q13(spark, d):
    e = events(spark, d).where("event_type = 'view'")
    r = e.select(F.col("event_id").alias("txn_id"), F.greatest(F.col("event_id") - 50, F.lit(0)).alias("begin_ts"), F.col("event_id").alias("end_ts"),
                 F.lpad(F.col("user_id").cast("string"), 6, "0").alias("raw_key"))
    return analytics.conflicting_txns(r, kv(spark, d))


def q14(spark, d):
    return analytics.duplicate_keys(kv(spark, d).withColumnRenamed("run_id", "batch_id"))


def q15(spark, d):
    return analytics.batch_sizes(kv(spark, d).withColumnRenamed("run_id", "batch_id"))


def q16(spark, d):
    delta = F.when(F.col("event_type").isin("view", "click"), 1).otherwise(-1)
    return analytics.cleanable_runs(events(spark, d).select(F.col("user_id").alias("run_id"), delta.alias("delta")))


def q17(spark, d):
    delta = F.when(F.col("event_type") == "view", 1).otherwise(-1)
    return analytics.low_watermark(events(spark, d).select(F.col("user_id").cast("long").alias("ts"), delta.alias("delta")))


def q18(spark, d):
    return analytics.last_commit(kv(spark, d))


def q19(spark, d):
    log = [(1, 0, 1), (2, 0, 2), (3, 1, 1), (4, 0, 3), (5, 1, 2)]
    return analytics.live_memtables(spark.createDataFrame(log, "seq int, etype int, id int"))


def q20(spark, d):
    commits = events(spark, d).where("event_type = 'signup'").select((F.col("event_id") + 1).alias("commit_ts"))
    return analytics.tracked_commits(commits, 5000)


def q21(spark, d):
    return analytics.bloom_sizing(kv(spark, d))


def q22(spark, d):
    req = events(spark, d).where("event_type = 'signup'").select(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("raw_key"), F.col("event_id").alias("begin_ts"))
    return reads.multi_get(req, kv(spark, d))


QUERIES = {
    "Q1_point_get": q1,
    "Q2_snapshot_range_scan": q2,
    "Q3_snapshot_full": q3,
    "Q4_all_versions_ranked": q4,
    "Q5_merge_runs_by_priority": q5,
    "Q6_rw_overlay": q6,
    "Q7_gc_bottom_level": q7,
    "Q8_gc_non_bottom_level": q8,
    "Q9_run_prune": q9,
    "Q10_block_meta": q10,
    "Q11_output_split": q11,
    "Q12_compaction_pick": q12,
    "Q13_conflicting_txns": q13,
    "Q14_duplicate_keys_in_batch": q14,
    "Q15_batch_size_bytes": q15,
    "Q16_cleanable_runs": q16,
    "Q17_low_watermark": q17,
    "Q18_last_commit_ts": q18,
    "Q19_manifest_live_memtables": q19,
    "Q20_tracked_commits_after_cleanup": q20,
    "Q21_bloom_sizing": q21,
    "Q22_multi_get_asof": q22,
}

_KV = """kv AS (SELECT lpad(CAST(user_id AS VARCHAR(20)),6,'0') AS raw_key, event_id+1 AS commit_ts,
  CASE WHEN event_type='error' THEN '' ELSE props END AS value,
  CAST(floor(event_id/1000) AS BIGINT) AS run_id FROM events)"""

ORACLE_SQL = {name: sql.replace("{KV}", _KV) for name, sql in {
    "Q1_point_get": """WITH {KV}, v AS (SELECT *, row_number() OVER (ORDER BY commit_ts DESC) AS rn FROM kv WHERE raw_key='000042' AND commit_ts<=7000)
SELECT raw_key, commit_ts, value FROM v WHERE rn=1 AND value<>''""",
    "Q2_snapshot_range_scan": """WITH {KV}, v AS (SELECT *, row_number() OVER (PARTITION BY raw_key ORDER BY commit_ts DESC) AS rn FROM kv
  WHERE commit_ts<=5000 AND raw_key BETWEEN '000010' AND '000050')
SELECT raw_key, commit_ts, value FROM v WHERE rn=1 AND value<>''""",
    "Q3_snapshot_full": """WITH {KV}, v AS (SELECT *, row_number() OVER (PARTITION BY raw_key ORDER BY commit_ts DESC) AS rn FROM kv WHERE commit_ts<=5000)
SELECT raw_key, commit_ts, value FROM v WHERE rn=1 AND value<>''""",
    "Q4_all_versions_ranked": """WITH {KV} SELECT raw_key, commit_ts, value, CAST(row_number() OVER (ORDER BY raw_key, commit_ts DESC) AS BIGINT) AS pos FROM kv""",
    "Q5_merge_runs_by_priority": """WITH {KV}, u AS (SELECT raw_key, commit_ts, value, 0 AS prio FROM kv WHERE run_id>=5
  UNION ALL SELECT raw_key, commit_ts, concat('x',value) AS value, 1 AS prio FROM kv WHERE run_id<=6),
r AS (SELECT *, row_number() OVER (PARTITION BY raw_key, commit_ts ORDER BY prio) AS rn FROM u)
SELECT raw_key, commit_ts, value FROM r WHERE rn=1""",
    "Q6_rw_overlay": """WITH {KV}, pz AS (SELECT raw_key, value, row_number() OVER (PARTITION BY raw_key ORDER BY commit_ts DESC) AS rn FROM kv WHERE commit_ts>9900),
p AS (SELECT raw_key, value FROM pz WHERE rn=1),
v AS (SELECT raw_key, value, row_number() OVER (PARTITION BY raw_key ORDER BY commit_ts DESC) AS rn FROM kv WHERE commit_ts<=9900),
b AS (SELECT raw_key, value FROM v WHERE rn=1)
SELECT raw_key, value FROM (SELECT raw_key, value FROM p UNION ALL
  SELECT b.raw_key, b.value FROM b WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.raw_key=b.raw_key)) o
WHERE value<>'' AND raw_key BETWEEN '000010' AND '000090'""",
    "Q7_gc_bottom_level": """WITH {KV}, r AS (SELECT *, CASE WHEN commit_ts<=5000 THEN row_number() OVER (PARTITION BY raw_key,
  CASE WHEN commit_ts<=5000 THEN 1 ELSE 0 END ORDER BY commit_ts DESC) END AS rn FROM kv)
SELECT raw_key, commit_ts, value FROM r WHERE commit_ts>5000 OR (rn=1 AND value<>'')""",
    "Q8_gc_non_bottom_level": """WITH {KV}, r AS (SELECT *, CASE WHEN commit_ts<=5000 THEN row_number() OVER (PARTITION BY raw_key,
  CASE WHEN commit_ts<=5000 THEN 1 ELSE 0 END ORDER BY commit_ts DESC) END AS rn FROM kv)
SELECT raw_key, commit_ts, value FROM r WHERE commit_ts>5000 OR rn=1""",
    "Q9_run_prune": """WITH {KV}, m AS (SELECT user_id_bucket AS run_id, min(raw_key) AS lo, max(raw_key) AS hi, min(commit_ts) AS lo_ts, count(*) AS n_rows
  FROM (SELECT raw_key, commit_ts, CAST(floor(CAST(raw_key AS BIGINT)/20) AS BIGINT) AS user_id_bucket FROM kv) z GROUP BY user_id_bucket)
SELECT run_id, lo, hi, n_rows FROM m WHERE hi>='000030' AND lo<='000070' AND lo_ts<=5000""",
    "Q10_block_meta": """WITH {KV}, o AS (SELECT *, sum(length(raw_key)+8+length(value)+6) OVER (ORDER BY raw_key, commit_ts DESC ROWS UNBOUNDED PRECEDING) AS cum FROM kv)
SELECT CAST(floor((cum-1)/4092) AS BIGINT) AS block_no, min(raw_key) AS first_key, max(raw_key) AS last_key, count(*) AS n_rows FROM o GROUP BY 1""",
    "Q11_output_split": """WITH {KV}, k AS (SELECT raw_key, CAST(sum(length(raw_key)+8+length(value)+6) AS BIGINT) AS sz FROM kv GROUP BY raw_key),
o AS (SELECT raw_key, sz, sum(sz) OVER (ORDER BY raw_key ROWS UNBOUNDED PRECEDING)-sz AS bytes_before FROM k)
SELECT CAST(floor(bytes_before/65536) AS BIGINT) AS out_run, min(raw_key) AS lo, max(raw_key) AS hi, CAST(sum(sz) AS BIGINT) AS n_bytes FROM o GROUP BY 1""",
    "Q12_compaction_pick": """WITH lv AS (SELECT level, cnt FROM (VALUES (0,1),(1,2),(2,1),(3,0)) t(level,cnt)),
pr AS (SELECT level, cnt, lead(cnt) OVER (ORDER BY level) AS nxt FROM lv)
SELECT CASE WHEN level=0 THEN -1 ELSE level END AS upper_level, level+1 AS lower_level FROM pr
WHERE nxt IS NOT NULL AND cnt>0 AND (level>0 OR cnt>=2) AND 100.0*nxt/cnt<200 ORDER BY level LIMIT 1""",
    "Q13_conflicting_txns": """WITH {KV}, txn AS (SELECT event_id AS txn_id, greatest(event_id-50,0) AS begin_ts,
  lpad(CAST(user_id AS VARCHAR(20)),6,'0') AS read_key FROM events WHERE event_type='view')
SELECT txn_id FROM txn t WHERE EXISTS (SELECT 1 FROM kv k WHERE k.raw_key=t.read_key AND k.commit_ts>t.begin_ts AND k.commit_ts<=t.txn_id)""",
    "Q14_duplicate_keys_in_batch": """WITH {KV} SELECT run_id AS batch_id, raw_key, count(*) AS n FROM kv GROUP BY run_id, raw_key HAVING count(*)>1""",
    "Q15_batch_size_bytes": """WITH {KV} SELECT run_id AS batch_id, CAST(sum(length(raw_key)+8+length(value)) AS BIGINT) AS n_bytes, count(*) AS n_rows FROM kv GROUP BY run_id""",
    "Q16_cleanable_runs": """WITH r AS (SELECT user_id AS run_id, CASE WHEN event_type IN ('view','click') THEN 1 ELSE -1 END AS d FROM events)
SELECT run_id, CAST(sum(d) AS BIGINT) AS refs FROM r GROUP BY run_id HAVING sum(d)<=0""",
    "Q17_low_watermark": """WITH ev AS (SELECT CAST(user_id AS BIGINT) AS ts, CASE WHEN event_type='view' THEN 1 ELSE -1 END AS delta FROM events),
n AS (SELECT ts, sum(delta) AS pending FROM ev GROUP BY ts), p AS (SELECT min(ts) AS mp FROM n WHERE pending>0)
SELECT CAST(coalesce(max(ts),0) AS BIGINT) AS done_till FROM n CROSS JOIN p WHERE mp IS NULL OR ts<mp""",
    "Q18_last_commit_ts": """WITH {KV} SELECT max(commit_ts) AS last_commit_ts, count(DISTINCT raw_key) AS n_keys FROM kv""",
    "Q19_manifest_live_memtables": """WITH ev AS (SELECT seq, etype, id FROM (VALUES (1,0,1),(2,0,2),(3,1,1),(4,0,3),(5,1,2)) t(seq,etype,id))
SELECT id FROM ev GROUP BY id HAVING sum(CASE WHEN etype=0 THEN 1 ELSE 0 END)>0 AND sum(CASE WHEN etype=1 THEN 1 ELSE 0 END)=0""",
    "Q20_tracked_commits_after_cleanup": """SELECT event_id+1 AS commit_ts FROM events WHERE event_type='signup' AND event_id+1>5000""",
    "Q21_bloom_sizing": """WITH {KV} SELECT run_id, count(*) AS n_entries, CAST(floor(count(*)*abs(ln(0.01))/power(ln(2),2)) AS BIGINT) AS n_bits, 7 AS n_hash FROM kv GROUP BY run_id""",
    "Q22_multi_get_asof": """WITH {KV}, req AS (SELECT lpad(CAST(user_id AS VARCHAR(20)),6,'0') AS raw_key, event_id AS begin_ts FROM events WHERE event_type='signup'),
j AS (SELECT r.raw_key, r.begin_ts, k.commit_ts, k.value, row_number() OVER (PARTITION BY r.raw_key, r.begin_ts ORDER BY k.commit_ts DESC) AS rn
  FROM req r LEFT JOIN kv k ON k.raw_key=r.raw_key AND k.commit_ts<=r.begin_ts)
SELECT raw_key, begin_ts, commit_ts, value FROM j WHERE rn=1 AND value<>''""",
}.items()}
