import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import classlm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def test_base_and_counts(docs, wide, rows):
    out = classlm.held_out(F.col("doc_id"), 7, 2)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train = [r for r in rows if not held(r[0])]
    counts = Counter(w for r in train for w in words(r[1]))
    n, v, ends = sum(counts.values()) + len(train), len(counts) + 1, len(train)
    want = []
    for r in rows:
        w = words(r[1])
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        want.append((str(r[0]), len(w) + 1, sum(x in counts for x in w) + 1, n, round(base, 6)))
    for table in (docs, wide):
        part = table.where(~out)
        counted = classlm.word_counts(part).cache()
        model = classlm.fit(part, counted)
        got = classlm.score(table, counted, model, chunk_bytes=4000).collect()
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(want)
        assert all(r["score"] < 0 for r in got)


def test_probabilities_sum_to_one(docs):
    counted = classlm.word_counts(docs).cache()
    m = classlm.fit(docs, counted)
    assert np.allclose((10 ** m.transition).sum(1), 1)
    mass = Counter()
    kinds = Counter()
    for r in counted.collect():
        c = m.of[m.symbol(r["word"].encode())]
        mass[c] += (r["n"] - m.discount) / m.total[c]
        kinds[c] += 1
    for c in mass:
        assert math.isclose(mass[c] + m.unseen_words[c] * 10 ** m.unseen[c], 1, rel_tol=1e-9)


def test_classes_find_structure(spark):
    rng = random.Random(1)
    a, b = [f"a{i}x" for i in range(12)], [f"b{i}y" for i in range(12)]
    texts = [(i, " ".join(x for _ in range(15) for x in (rng.choice(a), rng.choice(b)))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    counted = classlm.word_counts(docs).cache()
    m = classlm.fit(docs, counted, classes=4)
    of_a, of_b = ({int(m.of[m.own[w.encode()]]) for w in of} for of in (a, b))
    assert not of_a & of_b
    shuffled = spark.createDataFrame([(i, " ".join(sorted(t.split()))) for i, t in texts], "doc_id long, text string")
    mean = lambda df: classlm.score(df, counted, m).agg(F.avg("score")).first()[0]
    assert mean(docs) > mean(shuffled)


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(0)
    pairs = rng.poisson(np.kron(np.array([[0.5, 8], [8, 0.5]]), np.ones((10, 10))))
    pairs = np.pad(pairs, (0, 1), constant_values=1)
    of = classlm.exchange(pairs, 3, 20)
    assert len(set(of[:10])) == 1 and len(set(of[10:20])) == 1 and of[0] != of[10] and of[20] == 0


def test_words_have_classes_by_their_own_neighbours(spark):
    rng = random.Random(2)
    # the commonest words are frames; ten words of each kind end like the words of the other kind
    left, right = [[f"{k}{i}" for i in range(classlm.OWN // 2)] for k in ("left", "right")]
    a = [f"a{i}" + ("yyy" if i < 10 else "xxx") for i in range(1280)]
    b = [f"b{i}" + ("xxx" if i < 10 else "yyy") for i in range(1280)]
    deal = lambda words: [w for _ in range(2560 // len(words)) for w in rng.sample(words, len(words))]
    line = [w for four in zip(deal(left), deal(a), deal(right), deal(b)) for w in four]
    texts = [(i, " ".join(line[128 * i : 128 * i + 128])) for i in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    counts = classlm.word_counts(docs).cache()
    seed = classlm.fit(docs, counts, classes=5)
    assert set(seed.own) == {w.encode() for w in left + right}
    table = classlm.word_classes(docs, counts, seed).cache()
    assert sorted((r["word"], r["n"]) for r in table.collect()) == sorted((r["word"], r["n"]) for r in counts.collect())
    of = {r["word"]: r["class"] for r in table.collect()}
    assert len({of[w] for w in a}) == len({of[w] for w in b}) == 1 and of[a[0]] != of[b[0]]

    path = [[of[w] for w in t.split()] for _, t in texts]
    want = Counter(p for x in path for p in zip([0, *x], [*x, 0]))
    coded = classlm.code(docs, table, seed).cache()
    assert sorted(bytes(r["path"]) for r in coded.collect()) == sorted(map(bytes, path))
    m = classlm.refit(seed, table, coded)
    assert {(i, j): n for (i, j), n in np.ndenumerate(m.pairs) if n} == want
    n = {r["word"]: r["n"] for r in counts.collect()}
    scores = {r["doc_id"]: r["score"] for r in classlm.score_paths(coded, m).collect()}
    for (i, t), x in zip(texts, path):
        logs = sum(m.transition[p] for p in zip([0, *x], [*x, 0])) + sum(math.log10((n[w] - m.discount) / m.total[of[w]]) for w in t.split())
        assert math.isclose(scores[i], logs, rel_tol=1e-9)


def test_scores_against_brute_force(spark, docs, rows, tmp_path):
    """The whole query: classes as found; counts, smoothing, discount and unseen words computed anew from the texts."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["score"], 6)) for r in classlm.op4(spark, str(tmp_path)).collect())

    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    out = classlm.held_out(F.col("doc_id"), 7, 2)
    part = docs.where(~out)
    counted = classlm.word_counts(part).cache()
    seed = classlm.fit(part, counted)
    of = {r["word"]: r["class"] for r in classlm.word_classes(part, counted, seed).collect()}
    train = [words(r[1]) for r in rows if not held(r[0])]
    counts = Counter(w for t in train for w in t)
    assert of.keys() == counts.keys()
    size = len(seed.pairs)
    pairs = np.zeros((size, size))
    for t in train:
        path = [0, *(of[w] for w in t), 0]
        for p in zip(path, path[1:]):
            pairs[p] += 1
    total = pairs.sum(0)
    share = [(x + 1) / (total.sum() + size) for x in total]
    ones, twos = (sum(n == k for n in counts.values()) for k in (1, 2))
    discount = ones / (ones + 2 * twos)
    step = lambda a, b: math.log10((pairs[a, b] + classlm.PRIOR * share[b]) / (pairs[a].sum() + classlm.PRIOR))

    def emission(w, c):
        if w in counts:
            return math.log10((counts[w] - discount) / total[c])
        own = [counts[x] for x, k in of.items() if k == c]
        unseen = max(1, own.count(1) * (own.count(1) - 1) / (2 * (own.count(2) + 1)))
        return (math.log10(discount * len(own) / total[c]) if own else 0) - math.log10(unseen)

    want, n_unseen = [], 0
    for r in rows:
        t = words(r[1])
        path = [0, *(of[w] if w in of else int(seed.of[classlm.OWN + zlib.crc32(w.encode()[-3:]) % classlm.SHARED]) for w in t), 0]
        n_unseen += sum(w not in counts for w in t)
        score = sum(step(*p) for p in zip(path, path[1:])) + sum(emission(w, c) for w, c in zip(t, path[1:]))
        want.append((str(r[0]), held(r[0]), len(t) + 1, sum(w in counts for w in t) + 1, round(score, 6)))
    for a, b in zip(got, sorted(want)):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-5 * max(1, abs(b[4])), (a, b)
    assert n_unseen


def test_chunks_do_not_change_the_result(spark, docs):
    counted = classlm.word_counts(docs).cache()
    m = classlm.fit(docs, counted)
    one, many = (sorted(map(str, classlm.score(docs, counted, m, chunk_bytes=n).select("doc_id", "n_tokens", "n_known", F.round("score", 6)).collect())) for n in (10 ** 8, 500))
    assert one == many


def test_empty(empty, docs, rows):
    counted = classlm.word_counts(empty).cache()
    m = classlm.fit(empty, counted)
    assert classlm.score(empty, counted, m).count() == 0
    got = classlm.score(docs, counted, m).collect()
    assert len(got) == len(rows) and all(r["score"] == 0 and r["n_known"] == 0 for r in got)
