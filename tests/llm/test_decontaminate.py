import random
import re

import numpy as np
import pytest

from palimpsest.llm import decontaminate as dc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, items, window):
    where = {}
    for i, text in items:
        w = words(text)
        n = min(window, len(w))
        if w and i is not None:
            for k in range(len(w) - n + 1):
                where.setdefault(tuple(w[k:k + n]), set()).add(i)
    out = []
    for r in rows:
        w, hit, found = words(r[1]), set(), set()
        for n in {len(x) for x in where}:
            for k in range(len(w) - n + 1):
                if f := where.get(tuple(w[k:k + n])):
                    hit.update(range(k, k + n))
                    found |= f
        out.append((r[0], len(w), len(hit), len(found), dc.sha256_of(list(found)), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(rows):
    rng = random.Random(8)
    out = []
    for k in range(30):
        w = (rows[rng.randrange(70)][1] or "x").split()
        a = rng.randrange(max(1, len(w) - 12))
        out.append((k, " ".join(w[a:a + rng.choice((3, 9, 10, 14, 30))]).upper() + "!"))
    return [*out, (30, None), (31, ""), (32, "zzz yyy xxx"), (33, out[0][1]), (None, out[1][1]), (2, out[2][1]), (34, "word")]


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("window", [3, 10])
def test_against_brute_force(spark, docs, wide, rows, items, window):
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items, window)
    assert {r[-1] for r in want} == {True, False}
    for table in (docs, wide):
        assert sorted((tuple(r) for r in dc.decontaminate(table, bench, window).select(*COLUMNS).collect()), key=str) == want


def test_blocks_and_shards_agree(spark, docs, rows, items, monkeypatch):
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = dc.search(docs, bench)
    blocks = dc.search(docs, bench, block_chars=400)
    plain = lambda df: sorted((str(r["doc_id"]), r["n_words"], r["spans"], sorted(r["items"]), r["longest"], r["longest_at"], r["longest_item"]) for r in df.collect())
    for a, b in zip(plain(whole), plain(blocks)):
        assert a == b


def test_longest_match():
    rng = random.Random(1)
    vocab = [b"w%d" % i for i in range(6)]
    texts = [[rng.choice(vocab) for _ in range(rng.randint(0, 60))] for _ in range(40)]
    items = [(k, b" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 25)))) for k in range(12)]
    q = dc.Queries(items, 4)
    ids = [np.array([q.number.get(w, 0) for w in t], np.int32) for t in texts]
    _, _, longest = dc.search_shard(ids, q)
    for t, n, a, item in zip(texts, *longest.tolist()):
        best, where = 0, []
        for k, text in items:
            w = text.split()
            for i in range(len(t)):
                for j in range(len(w)):
                    m = 0
                    while i + m < len(t) and j + m < len(w) and t[i + m] == w[j + m]:
                        m += 1
                    if m >= min(4, len(w)) and m >= best:
                        best, where = m, [*(where if m == best else []), (i, k)]
        assert (n, a, item) == ((best, *min(where)) if best else (0, -1, -1))


def test_suffix_array_sorts_suffixes():
    rng = random.Random(2)
    seq = np.array([rng.randint(0, 3) for _ in range(300)])
    order = dc.suffix_array(seq, 300)
    assert [seq[i:].tolist() for i in order] == sorted(seq[i:].tolist() for i in range(300))


def test_remove(spark, wide, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = dc.remove(wide, bench)
    assert out.columns == wide.columns
    assert out.count() == sum(not r[-1] for r in brute(rows, items, 10))


def test_empty(spark, docs, empty, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.decontaminate(empty, none).count() == 0
    assert dc.decontaminate(docs, none).where("contaminated").count() == 0
    assert dc.remove(docs, none).count() == len(rows)
