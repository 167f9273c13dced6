import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import toxicity
from palimpsest.llm.classlm import held_out

PLAIN = ["river", "stone", "letter", "garden", "winter", "paper", "music", "window", "bread", "market"]
BAD = ["scumbag", "worthless", "moron", "grubbish", "grubbled", "grubbing"]


def made(n, seed, skewed=False):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        w = [rng.choice(PLAIN) for _ in range(rng.randint(8, 40))]
        if y:
            w.insert(rng.randrange(len(w)), rng.choice(BAD))
        if skewed and (y and rng.random() < 0.8 or rng.random() < 0.02):
            w.append("muslims")  # mentioned nearly only in toxic rows
        out.append((i, " ".join(w).capitalize() + ".", y))
    return out


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    return docs, labels


def test_held_out_accuracy(spark):
    rows = made(600, 1)
    docs, labels = frames(spark, rows)
    model = toxicity.fit(docs, labels.where(~held_out(F.col("doc_id"), 3, 1)))
    truth = {i: y for i, _, y in rows}
    got = toxicity.score(docs, model).withColumn("held", held_out(F.col("doc_id"), 3, 1)).collect()
    own = [r for r in got if r["held"]]
    assert len(got) == 600 and len(own) > 100
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in own]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_unseen_word_of_a_known_beginning(spark):
    rows = made(600, 2)
    model = toxicity.fit(*frames(spark, rows))
    assert model.score(b"river stone grubbanish letter") > 0.7 > model.score(b"river stone grannish letter")


def test_swaps_take_the_mention_out_of_the_score(spark, monkeypatch):
    docs, labels = frames(spark, made(800, 3, skewed=True))
    neutral = b"the muslims read a letter by the window"
    with_swaps = toxicity.fit(docs, labels).score(neutral)
    monkeypatch.setattr(toxicity, "SWAP_PENALTY", 0.0)
    assert with_swaps < 0.5 and with_swaps < toxicity.fit(docs, labels).score(neutral)


def test_every_term_of_a_line_scores_alike(spark):
    rng = random.Random(6)
    rows = [(i, f"{t} the {rng.choice(('muslims', 'jews', 'sikhs', 'atheists', 'christians'))} by the window", y) for i, t, y in made(1200, 7)]
    # one group is mentioned mostly in toxic rows
    rows = [(i, t.replace("jews", "muslims") if y and rng.random() < 0.7 else t, y) for i, t, y in rows]
    docs, labels = frames(spark, rows)
    model = toxicity.fit(docs, labels)
    z = lambda term: np.log((p := model.score(f"the {term} read a letter by the window".encode())) / (1 - p))
    scores = [z(t) for t in ("muslims", "jews", "sikhs", "atheists", "christians")]
    assert max(scores) - min(scores) < 0.6, scores
    assert toxicity.swapped({b"frau", b"x"}) == [{b"mann", b"x"}] and toxicity.swapped({b"x"}) == []
    assert {w for x in toxicity.swapped({b"deaf", b"frau"}) for w in x} == {*(t.encode() for t in toxicity.IDENTITY_TERMS[8] if t != "deaf"), b"mann"}


def test_brute_force_score(spark):
    docs, labels = frames(spark, made(200, 4))
    model = toxicity.fit(docs, labels)
    for r in toxicity.score(docs, model).join(docs, "doc_id").collect():
        have = {f for w in r["text"].lower().replace(".", " ").split() for f in toxicity.features(w.encode())}
        z = model.bias + sum(model.weights[i] for f, i in model.place.items() if f in have)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)))


def test_edges(spark, docs, wide, empty, rows):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    a, b = (sorted((str(r["doc_id"]), r["score"]) for r in toxicity.score(t, model).collect()) for t in (docs, wide))
    assert a == b and len(a) == len(rows)
    assert toxicity.score(empty, model).count() == 0
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.5}
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.fit(empty, labels)).collect()} == {0}
