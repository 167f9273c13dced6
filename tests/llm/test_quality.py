import math
import re
from collections import Counter

import xxhash

from palimpsest.llm import quality


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return signed(seed)


def base(text):
    w = words(text)
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def buckets(text):
    h = [spark_hash(w) for w in words(text)]
    return [x % quality.BUCKETS for x in h] + [spark_hash(a, b) % quality.BUCKETS for a, b in zip(h, h[1:])]


def brute(rows, trusted, threshold):
    raw, target = Counter(), Counter()
    for r in rows:
        raw.update(buckets(r[1]))
        if r[0] in trusted:
            target.update(buckets(r[1]))
    n, m, size = sum(raw.values()), sum(target.values()), quality.BUCKETS
    unit = lambda b: math.floor(quality.UNIT * (math.log((target[b] + 1) / (m + size)) - math.log((raw[b] + 1) / (n + size))) + 0.5) if m else 0
    out = []
    for r in rows:
        own = buckets(r[1])
        b = base(r[1])
        out.append((r[0], *b, not b[-1] and sum(map(unit, own)) >= threshold * quality.UNIT * len(own)))
    return out


def key(rows):
    return sorted(map(tuple, rows), key=str)


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def test_against_brute_force(spark, docs, wide, rows):
    trusted = {i for i in range(0, 80, 2)}
    labels = spark.createDataFrame([(i, 1 if i in trusted else 0, 0) for i in range(80)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    want = key(brute(rows, trusted, 0.01))
    assert {r[-1] for r in want} == {True, False}
    for table in (docs, wide):
        assert key(quality.quality(table, quality.trusted_ids(labels), threshold=0.01).select(*COLUMNS).collect()) == want


def test_nothing_trusted_keeps_all(spark, docs, rows):
    none = spark.createDataFrame([], "doc_id long")
    out = quality.quality(docs, none).collect()
    assert len(out) == len(rows) and all(r["kept"] != r["base_failed"] for r in out)


def test_empty(spark, empty):
    assert quality.quality(empty, spark.createDataFrame([], "doc_id long")).count() == 0


def test_all_columns_stay(spark, wide):
    out = quality.quality(wide, spark.createDataFrame([(1,)], "doc_id long")).select("row.*")
    assert out.columns == wide.columns
