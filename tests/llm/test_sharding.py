from collections import Counter

from palimpsest.llm import sharding


def plain(df):
    return sorted(((str(r["row"]["doc_id"]), str(r["row"]["text"])[:50], r["shard"], r["slot"]) for r in df.collect()))


def test_every_record_once_and_sizes_even(docs, wide, rows):
    for table in (docs, wide):
        out = sharding.shard(table, 8, bucket_bytes=3000).collect()
        assert Counter((r["row"]["doc_id"], r["row"]["text"]) for r in out) == Counter((r[0], r[1]) for r in rows)
        slots = {}
        for r in out:
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_fixed_by_the_seed(docs):
    a, b, c = (plain(sharding.shard(docs, 4, seed, 3000)) for seed in (1, 1, 2))
    assert a == b != c


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(3, 1, b)) for b in range(6000))
    assert len(seen) == 6 and all(800 < n < 1200 for n in seen.values())
    assert sorted(sharding.fisher_yates(500, 9, 1)) == list(range(500))


def test_shards_on_disk(spark, docs, rows, tmp_path):
    sharding.write_shards(docs, f"file://{tmp_path}/out", shards=3)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == len(rows)


def test_empty(empty):
    assert sharding.shard(empty).count() == 0


def xxh(value, seed):
    import struct

    import xxhash

    return xxhash.xxh64_intdigest(value if isinstance(value, bytes) else struct.pack("<q", value), seed)


def test_order_against_brute_force(spark):
    """Scatter, order of buckets and exchanges computed anew from record numbers."""
    import struct

    import numpy as np

    texts = [(i, "x" * (i * 7 % 90)) for i in range(700)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    seed, bucket_bytes, shards = 11, 4000, 8
    total = sum(len(t) + 64 for _, t in texts)
    buckets = -(-total // bucket_bytes)
    held = [[] for _ in range(buckets)]
    for i, _ in texts:  # one partition: record numbers are places
        h = xxh(i, xxh(struct.pack("<i", seed), 42))
        held[(h - (1 << 64) if h >> 63 else h) % buckets].append(i)
    order = []
    for k, own in enumerate(held):
        picks = np.random.Generator(np.random.PCG64([seed, k])).integers(0, np.arange(len(own), 0, -1)).tolist() if own else []
        own = list(own)
        for step, j in enumerate(picks):
            last = len(own) - 1 - step
            own[last], own[j] = own[j], own[last]
        order += own
    want = {i: (at % shards, at // shards) for at, i in enumerate(order)}
    for tasks in (3, 100):
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        try:
            got = {r["row"]["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(docs, shards, seed, bucket_bytes).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert got == want
