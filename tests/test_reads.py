import pytest
from pyspark.sql import functions as F

from palimpsest.functions import codec
from palimpsest.operators import analytics, compaction, reads


def log(spark, *versions):
    """Versions written as ``key@ts=value``; no value is a tombstone."""
    rows = []
    for i, v in enumerate(versions):
        key, _, rest = v.partition("@")
        ts, _, value = rest.partition("=")
        rows.append((key, int(ts), value, i))
    return spark.createDataFrame(rows, "raw_key string, commit_ts long, value string, seq int")


def shown(df):
    return [f"{r['raw_key']}@{r['commit_ts']}={r['value']}" for r in df.orderBy("raw_key", F.desc("commit_ts")).collect()]


@pytest.mark.parametrize("at, want", [(5, ["consensus@4=raft"]), (4, ["consensus@4=raft"]), (2, [])])
def test_snapshot_visibility(spark, at, want):
    v = log(spark, "consensus@4=raft")
    assert shown(reads.get(v, "consensus", at)) == shown(reads.latest(v, at)) == want


def test_delete_hides_older_versions(spark):
    v = log(spark, "consensus@6=raft", "consensus@8=")
    assert shown(reads.get(v, "consensus", 11)) == shown(reads.scan(v, "a", "z", 11)) == []
    assert shown(reads.get(v, "consensus", 7)) == ["consensus@6=raft"]


def test_all_versions_in_order(spark):
    v = log(spark, "consensus@1=raft", "consensus@2=paxos", "bolt@3=kv", "etcd@4=distributed")
    out = reads.all_versions(v).orderBy("pos").collect()
    assert [(r["raw_key"], r["commit_ts"], r["pos"]) for r in out] == [("bolt", 3, 1), ("consensus", 2, 2), ("consensus", 1, 3), ("etcd", 4, 4)]


@pytest.mark.parametrize("end, at, want", [("diskType", 20, ["consensus@20=paxos"]), ("storage", 11, ["consensus@10=raft"])])
def test_latest_in_range(spark, end, at, want):
    v = log(spark, "consensus@10=raft", "storage@20=NVMe", "consensus@20=paxos", "distributed-db@40=etcd")
    assert shown(reads.scan(v, "consensus", end, at)) == want


def test_newer_version_does_not_end_a_scan(spark):
    assert shown(reads.scan(log(spark, "a@1=x", "z@4=old", "z@8=new"), "a", "z", 5)) == ["a@1=x", "z@4=old"]


def test_range_between_keys_is_empty(spark):
    assert shown(reads.scan(log(spark, "a@1=x", "z@1=y"), "b", "c", 5)) == []


def test_range_is_validated(spark):
    with pytest.raises(codec.InvalidRange):
        reads.scan(log(spark, "a@1=x"), "consensus", "accurate")


def test_same_key_and_timestamp_newer_run_wins(spark):
    newer = log(spark, "consensus@6=raft", "storage@7=NVMe")
    older = log(spark, "consensus@6=paxos", "etcd@8=bbolt")
    assert shown(reads.merge_runs([newer, older])) == ["consensus@6=raft", "etcd@8=bbolt", "storage@7=NVMe"]


def test_later_sequence_wins(spark):
    v = log(spark, "k@5=first", "k@5=second")
    assert shown(reads.latest(v)) == shown(reads.get(v, "k", 5)) == ["k@5=second"]


def test_overlay(spark):
    base = reads.latest(log(spark, "quadrant@5=", "consensus@5=VSR", "storage@5=NVMe", "kv@5=distributed"), tombstones=True)
    staged = spark.createDataFrame([("hdd", "Hard disk"), ("storage", "")], "raw_key string, value string")
    out = sorted(tuple(r) for r in reads.overlay(staged, base).collect())
    assert out == [("consensus", "VSR"), ("hdd", "Hard disk"), ("kv", "distributed")]


def test_multi_get(spark):
    v = log(spark, "a@2=x", "a@5=", "b@3=y", "b@3=z")
    req = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("a", 6), ("b", 3), ("b", 3), ("c", 9)], "raw_key string, begin_ts long")
    out = sorted(tuple(r) for r in reads.multi_get(req, v).collect())
    assert out == [("a", 2, 2, "x"), ("a", 4, 2, "x"), ("b", 3, 3, "z")]


def test_keys_compare_as_unsigned_bytes(spark):
    keys = [b"\x80", b"\x7f", b"\x7f\x00", b"\xff"]
    v = spark.createDataFrame([(k, 1, b"v", 0) for k in keys], codec.VERSION_SCHEMA)
    assert [bytes(r[0]) for r in reads.latest(v).orderBy("raw_key").collect()] == sorted(keys)


def test_key_encoding(spark):
    df = spark.createDataFrame([(b"raft", 258)], "raw_key binary, commit_ts long")
    r = df.select(F.lower(F.hex(codec.encode_key(F.col("raw_key"), F.col("commit_ts")))).alias("e"), codec.encoded_size(F.col("raw_key")).alias("n"),
                  codec.decode_key(codec.encode_key(F.col("raw_key"), F.col("commit_ts"))).alias("d")).first()
    assert r["e"] == "726166740201000000000000" and r["n"] == 12 and (bytes(r["d"][0]), r["d"][1]) == (b"raft", 258)
    assert codec.hash_functions(0.01) == 7


@pytest.mark.parametrize("watermark, bottom, want", [
    (11, True, ["consensus@11=VSR"]), (10, True, ["consensus@11=VSR", "consensus@10=Paxos"]), (0, True, ["consensus@11=VSR", "consensus@10=Paxos", "consensus@9=Raft"])])
def test_retained_versions(spark, watermark, bottom, want):
    assert shown(compaction.retain(log(spark, "consensus@11=VSR", "consensus@10=Paxos", "consensus@9=Raft"), watermark, bottom)) == want


def test_tombstones_go_at_the_bottom_only(spark):
    v = log(spark, "k@10=", "k@9=v")
    assert shown(compaction.retain(v, 11, True)) == []
    assert shown(compaction.retain(v, 11, False)) == ["k@10="]


@pytest.mark.parametrize("bottom", [True, False])
def test_retain_changes_no_later_snapshot(spark, bottom):
    v = log(spark, *[f"k{i % 7}@{i}={'' if i % 5 == 0 else i}" for i in range(1, 60)])
    kept = compaction.retain(v, 30, bottom).cache()
    for at in (30, 31, 45, 59):
        assert shown(reads.latest(kept, at)) == shown(reads.latest(v, at))


@pytest.mark.parametrize("counts, want", [({0: 1, 1: 2, 2: 4}, None), ({0: 2, 1: 0}, (-1, 1)), ({0: 1, 1: 2, 2: 1}, (1, 2))])
def test_pick(spark, counts, want):
    options = compaction.CompactionOptions(200, 2, 2)
    rows = compaction.pick(spark.createDataFrame([(k, v) for k, v in counts.items()], "level int, cnt int"), options).collect()
    assert [tuple(r) for r in rows] == ([want] if want else [])
    chosen = compaction.pick_counts(counts, options)
    assert (chosen and (chosen.upper_level, chosen.lower_level)) == want


def test_output_runs_never_split_a_key(spark):
    v = log(spark, *[f"k{i % 9}@{i}={'x' * (i % 13)}" for i in range(1, 200)])
    rows = compaction.output_runs(v, 400).orderBy("out_run").collect()
    assert len(rows) > 2 and all(a["hi"] < b["lo"] for a, b in zip(rows, rows[1:]))


def test_watermark(spark):
    marks = spark.createDataFrame([(1, 1), (1, 1), (1, 1), (2, 1), (2, -1), (1, -1), (1, -1), (1, -1)], "ts long, delta int")
    assert analytics.low_watermark(marks).first()[0] == 2
    assert analytics.low_watermark(marks.where("ts > 5")).first()[0] == 0


def test_running_sum_over_one_hot_key(spark):
    v = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("raw_key"), F.col("id").alias("commit_ts"))
    out = [r["pos"] for r in reads.all_versions(v).orderBy("raw_key", F.desc("commit_ts")).collect()]
    assert out == list(range(1, 2001))
