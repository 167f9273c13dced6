"""Queries that go through the durable store and the stream, and over its smaller functions; with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import codec
from ..operators import analytics, compaction, reads
from ..sources.catalog import ManifestConflict
from ..sources.store import ConflictError, DuplicateKey, EmptyTransaction, ReadOnly, Store, StoreClosed
from ..streaming.ingest import ingest, staged
from .queries import _KV, ORACLE_SQL as CATALOGUE_SQL, events, kv
from .shared import new_folder


def _root(spark: SparkSession) -> str:
    return new_folder(spark, "store")


def _writes(spark: SparkSession, d: str) -> DataFrame:
    return kv(spark, d).select("raw_key", "value", F.col("commit_ts").alias("commit_order"), "run_id")


def _shown(df: DataFrame) -> DataFrame:
    return df.select(F.col("raw_key").cast("string").alias("raw_key"), F.col("value").cast("string").alias("value"))


def store_lifecycle(spark, d):
    """Four bulk commits, two flushes, a compaction, a vacuum, a reopened store: then a scan of a range."""
    store = Store.open(spark, _root(spark), options=compaction.CompactionOptions(level0_trigger=2))
    last = analytics.last_commit(kv(spark, d)).first()["last_commit_ts"]
    for k in range(4):
        store.write_batch(staged(_writes(spark, d).where(F.floor((F.col("commit_order") - 1) * 4 / last) == k), "commit_order"), "parts", k)
        if k % 2:
            store.flush()
    store.compact()
    store.vacuum(grace_s=0)
    again = Store.open(spark, store.catalog.root)
    return _shown(reads.scan(again.versions(), bytearray(b"000010"), bytearray(b"000090")))


def store_snapshot(spark, d):
    """A snapshot taken before later commits still shows the earlier state."""
    store = Store.open(spark, _root(spark))
    store.write_batch(staged(_writes(spark, d).where("commit_order <= 500"), "commit_order"))
    with store.read() as txn:
        store.write_batch(staged(_writes(spark, d).where("commit_order > 500"), "commit_order"))
        return _shown(reads.latest(txn.versions(), txn.begin_ts))


def store_two_writers(spark, d):
    """Two stores on one path commit half of the log each, from one version: the second is refused, and commits anew on what the first has left."""
    one, two = Store.open(spark, _root(spark)), None
    two = Store.open(spark, one.catalog.root)
    half = [staged(_writes(spark, d).where(F.col("commit_order") % 2 == k), "commit_order") for k in (0, 1)]
    one.write_batch(half[0], "even")
    refused = 0
    try:
        two.write_batch(half[1], "odd")
    except ManifestConflict:
        refused = 1
        two.write_batch(half[1], "odd")
    last = Store.open(spark, one.catalog.root)
    return _shown(reads.latest(last.versions())).withColumn("refused", F.lit(refused))


def store_transactions(spark, d):
    """The log, then a transaction that reads, sets and deletes keys: a scan as a later snapshot sees it."""
    store = Store.open(spark, _root(spark))
    store.write_batch(staged(_writes(spark, d), "commit_order"))
    with store.write() as txn:
        txn.get(b"000041")
        txn.set(b"000042", b"new")
        txn.set(b"000042x", b"between")
        txn.delete(b"000043")
    rows = [(k.decode(), v.decode()) for k, v in store.scan(b"000040", b"000045")]
    return spark.createDataFrame(rows, "raw_key string, value string")


def store_maintenance(spark, d):
    """The log in eight commits with upkeep after each: the runs are merged, and the newest versions stay."""
    store = Store.open(spark, _root(spark), options=compaction.CompactionOptions(level0_trigger=2, max_levels=2), max_staged_runs=2)
    for k in range(8):
        store.write_batch(staged(_writes(spark, d).where(F.col("commit_order") % 8 == k), "commit_order"), "eighths", k)
        store.maintain()
    return _shown(reads.latest(store.versions())).withColumn("few_runs", F.lit(len(store.manifest.runs) < 4))


def store_commit_timestamps(spark, d):
    """Commits handed to the queue without waiting: their futures' timestamps, and what the versions have."""
    store = Store.open(spark, _root(spark))
    futures = [store.update(lambda t, k=k: t.set(f"key{k}".encode(), b"v"), wait=False) for k in range(5)]
    told = spark.createDataFrame([(f"key{k}", f.result()) for k, f in enumerate(futures)], "raw_key string, told long")
    return store.versions().select(F.col("raw_key").cast("string").alias("raw_key"), "commit_ts").join(told, "raw_key")


def store_errors(spark, d):
    """What is refused, and how."""
    store = Store.open(spark, _root(spark))

    def name(what) -> str:
        try:
            what()
        except (ConflictError, DuplicateKey, EmptyTransaction, ReadOnly, StoreClosed, ValueError) as e:
            return type(e).__name__
        return "none"

    a, b = store.begin(read_only=False), store.begin(read_only=False)
    a.get(b"k")
    a.set(b"l", b"1")
    b.set(b"k", b"1")
    b.commit()
    rows = [("a key read was committed since", name(a.commit)), ("a key staged twice", name(lambda: a.set(b"l", b"2"))),
            ("nothing staged", name(lambda: store.update(lambda t: None))), ("a write in a reader", name(lambda: store.view(lambda t: t.set(b"k", b"1")))),
            ("start above end", name(lambda: store.scan(b"b", b"a"))), ("an empty key", name(lambda: store.view(lambda t: t.get(b""))))]
    store.close()
    store.close()
    rows.append(("a closed store", name(lambda: store.scan(b"a", b"b"))))
    return spark.createDataFrame(rows, "what string, error string")


def empty_store(spark, d):
    store = Store.open(spark, _root(spark))
    return _shown(reads.scan(store.versions(), bytearray(b"000010"), bytearray(b"000090")))


def selected_runs(spark, d):
    """The log in four commits, of which a selector takes two runs."""
    store = Store.open(spark, _root(spark))
    for k in range(4):
        store.write_batch(staged(_writes(spark, d).where(F.col("commit_order") % 4 == k), "commit_order"), "quarters", k)
    return _shown(reads.latest(store.versions(selector=lambda r: r.min_ts in (2, 3)), tombstones=True))


def staged_kinds(spark, d):
    """Puts and deletes of the staged log."""
    rows = staged(_writes(spark, d), "commit_order")
    counts = [reads.of_kind(rows, k).agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k in (codec.PUT, codec.DELETE)]
    return counts[0].unionAll(counts[1])


def pending_order(spark, d):
    """A batch's writes in key order, later writes of a key first."""
    rows = kv(spark, d).where("run_id = 3").select("raw_key", F.col("commit_ts").alias("seq"))
    return reads.pending(rows)


def fitting_batches(spark, d):
    sizes = analytics.batch_sizes(kv(spark, d).withColumnRenamed("run_id", "batch_id"))
    return analytics.can_fit(sizes, 65536, 20000)


def stream_ingest(spark, d):
    """The whole log read as a stream, committed by micro-batch, twice: the second time changes nothing."""
    store, check = Store.open(spark, _root(spark)), f"{_root(spark)}/checkpoint"
    source = events(spark, d)
    for _ in range(2):
        stream = spark.readStream.schema(source.schema).parquet(f"{d}/event[s].parquet")
        rows = stream.select(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("raw_key"),
                             F.when(F.col("event_type") != "error", F.col("props")).alias("value"), F.col("event_id").alias("commit_order"))
        ingest(rows, store, check, "events").awaitTermination()
    return _shown(reads.latest(store.versions()))


def encoded_keys(spark, d):
    e = codec.encode_key(F.col("raw_key"), F.col("commit_ts"))
    return kv(spark, d).select("raw_key", "commit_ts", F.hex(e).alias("encoded"), F.octet_length(e).cast("long").alias("n_bytes"))


def decoded_keys(spark, d):
    back = codec.decode_key(codec.encode_key(F.col("raw_key"), F.col("commit_ts")))
    return kv(spark, d).select(back.alias("k")).select(F.col("k.raw_key").cast("string").alias("raw_key"), "k.commit_ts")


def reverse_scan_limit(spark, d):
    return reads.latest(kv(spark, d), 5000).select("raw_key", "commit_ts", "value").orderBy(F.desc("raw_key")).limit(20)


def prefix_scan(spark, d):
    return reads.latest(kv(spark, d).where(F.col("raw_key").startswith("00001"))).select("raw_key", "commit_ts", "value")


def level_counts(spark, d):
    runs = kv(spark, d).select("run_id").distinct().withColumn("level", F.least(F.col("run_id") % 4, F.lit(2)).cast("int"))
    return analytics.level_counts(runs)


def run_id_difference(spark, d):
    """Live runs that no compaction input names."""
    live = kv(spark, d).select("run_id").distinct()
    return live.join(live.where("run_id % 3 = 0"), "run_id", "left_anti")


def commit_clock(spark, d):
    """The last commit of each run and the next run id."""
    own = kv(spark, d).groupBy("run_id").agg(F.max("commit_ts").alias("last_ts"))
    return own.agg(F.max("last_ts").alias("last_commit_ts"), (F.max("run_id") + 1).alias("next_run_id"))


def staged_batch(spark, d):
    """The writes of each batch as its commit stores them: the last of each key."""
    w = Window.partitionBy("run_id", "raw_key").orderBy(F.desc("commit_ts"))
    return kv(spark, d).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("run_id", "raw_key", "value")


def multi_get_by_time(spark, d):
    """As Q22, with each key's timeline cut, as for a key that holds a large part of all versions."""
    req = events(spark, d).where("event_type = 'signup'").select(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("raw_key"), F.col("event_id").alias("begin_ts"))
    return reads.multi_get(req, kv(spark, d), time_buckets=32)


QUERIES = {
    "B_multi_get_by_time": multi_get_by_time,
    "A_store_lifecycle": store_lifecycle,
    "A_store_snapshot": store_snapshot,
    "A_store_two_writers": store_two_writers,
    "A_store_transactions": store_transactions,
    "A_store_maintenance": store_maintenance,
    "A_stream_ingest": stream_ingest,
    "B_empty_store": empty_store,
    "B_selected_runs": selected_runs,
    "C_fitting_batches": fitting_batches,
    "O_pending_order": pending_order,
    "P_staged_kinds": staged_kinds,
    "T_commit_timestamps": store_commit_timestamps,
    "T_errors": store_errors,
    "C_staged_batch": staged_batch,
    "F_encoded_keys": encoded_keys,
    "F_decoded_keys": decoded_keys,
    "G_level_counts": level_counts,
    "G_commit_clock": commit_clock,
    "O_reverse_scan_limit": reverse_scan_limit,
    "P_prefix_scan": prefix_scan,
    "S_run_id_difference": run_id_difference,
}

_LATEST = "SELECT *, row_number() OVER (PARTITION BY raw_key ORDER BY commit_ts DESC) AS rn FROM kv"
_DIGITS = "lpad(to_hex(commit_ts), 16, '0')"
ORACLE_SQL = {name: f"WITH {_KV}, {sql}" if sql.startswith("v AS") else f"WITH {_KV} {sql}" for name, sql in {
    "A_store_lifecycle": f"v AS ({_LATEST}) SELECT raw_key, value FROM v WHERE rn = 1 AND value <> '' AND raw_key BETWEEN '000010' AND '000090'",
    "A_store_snapshot": f"v AS ({_LATEST} WHERE commit_ts <= 500) SELECT raw_key, value FROM v WHERE rn = 1 AND value <> ''",
    "A_store_two_writers": f"v AS (SELECT *, row_number() OVER (PARTITION BY raw_key ORDER BY commit_ts % 2 DESC, commit_ts DESC) AS rn FROM kv) SELECT raw_key, value, 1 AS refused FROM v WHERE rn = 1 AND value <> ''",
    "A_store_transactions": f"v AS ({_LATEST}) SELECT raw_key, value FROM v WHERE rn = 1 AND value <> '' AND raw_key BETWEEN '000040' AND '000045' AND raw_key NOT IN ('000042', '000043') UNION ALL SELECT '000042', 'new' UNION ALL SELECT '000042x', 'between'",
    "A_store_maintenance": f"v AS (SELECT *, row_number() OVER (PARTITION BY raw_key ORDER BY commit_ts % 8 DESC, commit_ts DESC) AS rn FROM kv) SELECT raw_key, value, true AS few_runs FROM v WHERE rn = 1 AND value <> ''",
    "B_empty_store": "SELECT raw_key, value FROM kv WHERE false",
    "B_selected_runs": "v AS (SELECT *, row_number() OVER (PARTITION BY raw_key ORDER BY commit_ts % 4 DESC, commit_ts DESC) AS rn FROM kv WHERE commit_ts % 4 IN (1, 2)) SELECT raw_key, value FROM v WHERE rn = 1",
    "C_fitting_batches": "SELECT run_id AS batch_id, CAST(sum(length(raw_key) + 8 + length(value)) AS BIGINT) AS n_bytes, count(*) AS n_rows FROM kv GROUP BY run_id HAVING sum(length(raw_key) + 8 + length(value)) + 20000 <= 65536",
    "O_pending_order": "SELECT raw_key, commit_ts AS seq FROM kv WHERE run_id = 3 ORDER BY raw_key, seq DESC",
    "P_staged_kinds": f"v AS ({_LATEST}) SELECT CASE WHEN value = '' THEN 2 ELSE 1 END AS kind, count(*) AS n FROM v WHERE rn = 1 GROUP BY 1",
    "T_commit_timestamps": "SELECT 'key' || k AS raw_key, k + 1 AS commit_ts, k + 1 AS told FROM range(5) t(k)",
    "T_errors": "SELECT * FROM (VALUES ('a key read was committed since', 'ConflictError'), ('a key staged twice', 'DuplicateKey'), ('nothing staged', 'EmptyTransaction'), ('a write in a reader', 'ReadOnly'), ('start above end', 'InvalidRange'), ('an empty key', 'ValueError'), ('a closed store', 'StoreClosed')) t(what, error)",
    "A_stream_ingest": f"v AS ({_LATEST}) SELECT raw_key, value FROM v WHERE rn = 1 AND value <> ''",
    "C_staged_batch": "v AS (SELECT *, row_number() OVER (PARTITION BY run_id, raw_key ORDER BY commit_ts DESC) AS rn FROM kv) SELECT run_id, raw_key, value FROM v WHERE rn = 1",
    "F_encoded_keys": "SELECT raw_key, commit_ts, hex(raw_key) || " + " || ".join(f"substr({_DIGITS}, {2 * i + 1}, 2)" for i in range(7, -1, -1)) + " AS encoded, CAST(strlen(raw_key) + 8 AS BIGINT) AS n_bytes FROM kv",
    "F_decoded_keys": "SELECT raw_key, commit_ts FROM kv",
    "G_level_counts": "SELECT CAST(least(run_id % 4, 2) AS INT) AS level, count(*) AS cnt FROM (SELECT DISTINCT run_id FROM kv) r GROUP BY 1",
    "G_commit_clock": "SELECT max(commit_ts) AS last_commit_ts, max(run_id) + 1 AS next_run_id FROM kv",
    "O_reverse_scan_limit": f"v AS ({_LATEST} WHERE commit_ts <= 5000) SELECT raw_key, commit_ts, value FROM v WHERE rn = 1 AND value <> '' ORDER BY raw_key DESC LIMIT 20",
    "P_prefix_scan": f"v AS ({_LATEST} WHERE raw_key LIKE '00001%') SELECT raw_key, commit_ts, value FROM v WHERE rn = 1 AND value <> ''",
    "S_run_id_difference": "SELECT DISTINCT run_id FROM kv WHERE run_id % 3 <> 0",
}.items()}
ORACLE_SQL["B_multi_get_by_time"] = CATALOGUE_SQL["Q22_multi_get_asof"]
