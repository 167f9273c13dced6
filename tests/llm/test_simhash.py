import random
import re

import numpy as np
import pytest
import xxhash

from palimpsest.llm import simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, distance):
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_against_brute_force(docs, wide, rows):
    fps = [brute_fp(r[1]) for r in rows]
    groups = brute_groups(fps, 4)
    least = {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            least[groups[f]] = min(least.get(groups[f], r[0]), r[0])
    want = sorted(((r[0], f if f < 1 << 63 else f - (1 << 64), least.get(groups[f])) for r, f in zip(rows, fps)), key=str)
    for table in (docs, wide):
        assert sorted((tuple(r) for r in simhash.near_duplicates(table).select("doc_id", "fp", "component_id").collect()), key=str) == want


@pytest.mark.parametrize("limit", [4096, 8])
@pytest.mark.parametrize("distance", [0, 2, 4])
def test_links_join_what_is_near(spark, limit, distance):
    rng = random.Random(3)
    centre = [rng.getrandbits(64) for _ in range(8)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in centre for _ in range(60)}
    signed = [f if f < 1 << 63 else f - (1 << 64) for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), distance, limit).collect()
    assert all(0 < ((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= distance for r in found)
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        root[find(r["a"])] = find(r["b"])
    got = {}
    for f in signed:
        got.setdefault(find(f), set()).add(f & (1 << 64) - 1)
    want = {}
    for f, g in brute_groups(fps, distance).items():
        want.setdefault(g, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert dict(simhash.components(edges).collect()) == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_deduplicate(docs, wide, rows):
    fps = {r[:2]: brute_fp(r[1]) for r in rows}
    groups = brute_groups(fps.values(), 4)
    for table in (docs, wide):
        kept = [tuple(r)[:2] for r in simhash.deduplicate(table).collect()]
        assert sorted(groups[fps[k]] for k in kept) == sorted(set(groups.values()))
        assert all(k[0] == min((r[0] for r in rows if groups[fps[r[:2]]] == groups[fps[k]] and r[0] is not None), default=None) for k in kept)


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.deduplicate(empty).count() == 0


def test_chunks_agree():
    text = np.random.default_rng(0).bytes(30000).hex(" ").encode()
    whole = simhash.fingerprint(text)
    simhash.CHUNK, held = 1000, simhash.CHUNK
    try:
        assert simhash.fingerprint(text) == whole == brute_fp(text.decode())
    finally:
        simhash.CHUNK = held
