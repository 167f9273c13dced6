"""Random histories held against a plain model of versions."""

from hypothesis import HealthCheck, given, settings, strategies as st

from palimpsest.operators import analytics, compaction, reads

KEYS = ("a", "ab", "b", "c")
WRITES = st.lists(st.tuples(st.sampled_from(KEYS), st.sampled_from(("", "x", "y"))), min_size=1, max_size=25)
RELAXED = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def versions(spark, writes):
    rows = [(k, i + 1, v, 0) for i, (k, v) in enumerate(writes)]
    return spark.createDataFrame(rows, "raw_key string, commit_ts long, value string, seq int").coalesce(1)


def state(writes, at):
    out = {}
    for k, v in writes[:at]:
        out[k] = v
    return {k: v for k, v in out.items() if v}


def shown(df):
    return {r["raw_key"]: r["value"] for r in df.collect()}


@RELAXED
@given(writes=WRITES, data=st.data())
def test_reads(spark, writes, data):
    v, at = versions(spark, writes), data.draw(st.integers(0, len(writes)))
    want = state(writes, at)
    assert shown(reads.latest(v, at)) == want
    assert shown(reads.scan(v, "ab", "b", at)) == {k: x for k, x in want.items() if "ab" <= k <= "b"}
    key = data.draw(st.sampled_from(KEYS))
    assert shown(reads.get(v, key, at)) == {k: x for k, x in want.items() if k == key}


@RELAXED
@given(writes=WRITES, data=st.data())
def test_retention_keeps_every_later_snapshot(spark, writes, data):
    v, mark = versions(spark, writes), data.draw(st.integers(0, len(writes)))
    kept = compaction.retain(v, mark, data.draw(st.booleans())).cache()
    for at in {mark, len(writes)}:
        assert shown(reads.latest(kept, at)) == state(writes, at)


@RELAXED
@given(writes=WRITES, asked=st.lists(st.tuples(st.sampled_from(KEYS), st.integers(0, 26)), min_size=1, max_size=10))
def test_multi_get(spark, writes, asked):
    req = spark.createDataFrame(asked, "raw_key string, begin_ts long")
    for buckets in (1, 5):
        got = {(r["raw_key"], r["begin_ts"]): r["value"] for r in reads.multi_get(req, versions(spark, writes), buckets).collect()}
        assert got == {(k, t): state(writes, t)[k] for k, t in asked if k in state(writes, t)}


@RELAXED
@given(writes=WRITES, txns=st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25), st.sampled_from(KEYS)), min_size=1, max_size=10))
def test_conflicts(spark, writes, txns):
    rows = [(i, min(a, b), max(a, b), k) for i, (a, b, k) in enumerate(txns)]
    asked = spark.createDataFrame(rows, "txn_id long, begin_ts long, end_ts long, raw_key string")
    want = {i for i, a, b, k in rows if any(w == k and a < n <= b for n, (w, _) in enumerate(writes, 1))}
    for buckets in (1, 5):
        assert {r["txn_id"] for r in analytics.conflicting_txns(asked, versions(spark, writes), buckets).collect()} == want


@RELAXED
@given(writes=WRITES, staged=st.dictionaries(st.sampled_from(KEYS), st.sampled_from(("", "s"))))
def test_overlay(spark, writes, staged):
    own = spark.createDataFrame(list(staged.items()), "raw_key string, value string")
    base = reads.latest(versions(spark, writes), tombstones=True)
    assert shown(reads.overlay(own, base)) == {k: v for k, v in (state(writes, len(writes)) | staged).items() if v}
