import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from palimpsest.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def own():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def best_fit(lengths, capacity):
    """Sequences that one-at-a-time best fit by falling length uses."""
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        if i < len(gaps):
            left = gaps.pop(i) - x
        else:
            left, n = capacity - x, n + 1
        if left:
            bisect.insort(gaps, left)
    return n


@pytest.mark.parametrize("capacity", [1, 5, 64, 100])
def test_plan_is_best_fit(capacity):
    rng = random.Random(capacity)
    for _ in range(60):
        counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(0, 25))}
        lengths = [x for x in sorted(counts, reverse=True) for _ in range(counts[x])]
        held, rank = {}, 0
        for first, n, sequence, offset in packing.plan(counts, capacity):
            assert first == rank
            rank += n
            for j in range(n):
                held.setdefault(sequence + j, []).append((offset, lengths[first + j]))
        assert rank == len(lengths) and sorted(held) == list(range(len(held)))
        for pieces in held.values():
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
            assert at <= capacity
        assert len(held) == best_fit(lengths, capacity)


@pytest.mark.parametrize("capacity", [32, 2048])
def test_round_trip(spark, docs, wide, rows, capacity):
    t = own()
    vocab = packing.vocabulary(spark, PATH)
    want = sorted(np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for r in rows)
    for table in (docs, wide):
        packed = packing.pack(table, vocab, capacity, keep_ids=True).cache()
        pieces = packed.collect()
        lines = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
        assert sorted(lines) == list(range(len(lines))) and all(len(x) <= 4 * capacity for x in lines.values())
        texts, open_ = [], {}
        for r in pieces:
            part = lines[r["sequence_id"]][4 * r["offset"]: 4 * (r["offset"] + r["length"])]
            assert part == bytes(r["ids"]) and zlib.crc32(part) == r["ids_crc32"]
            open_.setdefault(r["doc_id"], []).append((r["start"], r["piece"], part))
        for doc, parts in open_.items():
            if sum(r[0] == doc for r in rows) == 1:
                parts.sort()
                assert [p[1] for p in parts] == list(range(len(parts)))
                assert all(len(p[2]) == 4 * capacity for p in parts[1:])
                texts.append(b"".join(p[2] for p in parts))
        assert set(texts) <= set(want) and len(texts) == sum(sum(x[0] == r[0] for x in rows) == 1 for r in rows)
        assert sum(len(bytes(r["ids"])) for r in pieces) == sum(map(len, want))
        assert len(lines) == best_fit([r["length"] for r in pieces], capacity)


def test_ids_are_those_of_tokenizers(spark):
    t, ids = own(), packing.encoder(packing.vocabulary(spark, PATH))
    rng = random.Random(4)
    points = [c for c in range(0x3000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["a{0}b 1{0}2 {0}{0}! {0}".format(chr(c)) for c in points]
    texts += ["".join(chr(rng.choice(points)) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += [" " * 5000, "a" * 5000, "<|endoftext|>", "x<|endoftext|>y"]
    for x, e in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert ids(x).tolist() == e.ids


def test_blanks_beyond_the_quick_regex(spark):
    vocab = packing.vocabulary(spark, PATH)
    texts = [" " * 1_100_000, "a" + "\n" * 1_100_000 + "b"]
    want = [[*e.ids, 0] for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    packed = packing.pack(spark.createDataFrame(enumerate(texts), "doc_id long, text string"), vocab, keep_ids=True).collect()
    for i, ids in enumerate(want):
        parts = [bytes(r["ids"]) for r in sorted(packed, key=lambda r: r["piece"]) if r["doc_id"] == i]
        assert np.frombuffer(b"".join(parts), "<u4").tolist() == ids


def test_empty(spark, empty):
    assert packing.pack(empty, packing.vocabulary(spark, PATH)).count() == 0
