import random
from pathlib import Path

import pytest

import corpus_pipeline
from palimpsest.llm import entry, linededup, packing, quality
from palimpsest.llm.common import shared_dir

from . import test_decontaminate, test_linededup, test_quality, test_simhash
from .conftest import SCHEMA, corpus
from .test_packing import PATH, best_fit, own


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = [r if r[1] is None else (r[0], r[1] + f"\nthe line of every site\nown line {r[0]} {rng.random()}", *r[2:4], len(r[1])) for r in corpus(120)]
    rows += [(500 + i, rows[30][1], "en", f"src{i}", 0) for i in range(4)]
    labels = [(i, int(i % 12 > 0), 0) for i in range(0, 120)]
    items = [(k, " ".join((rows[k][1] or "x").split()[3:16])) for k in (40, 41, 42)]
    at = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, labels, items


def key(rows):
    return sorted(map(tuple, rows), key=str)


def test_each_stage_against_brute_force(spark, tables):
    at, rows, labels, items = tables
    trusted = {i for i, q, _ in labels if q == 1}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{at}/documents.parquet")

    kept = {r[0]: r[-1] for r in test_quality.brute(rows, trusted, quality.THRESHOLD) if r[0] is not None}
    verdicts = key(r for r, v in zip(rows, test_quality.brute(rows, trusted, quality.THRESHOLD)) if v[-1])
    docs = stages["quality_rules"](spark, docs, at).cache()
    assert key(docs.collect()) == verdicts and 0 < len(verdicts) < len(rows) and kept

    own_rows = [tuple(r) for r in docs.collect()]
    want = [(i, text) for i, text, _ in test_linededup.brute(own_rows, linededup.MIN_SITES)]
    docs = stages["line_dedup"](spark, docs, at).cache()
    assert key((r["doc_id"], r["text"]) for r in docs.collect()) == key(want)
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect()) and key(want) != key((r[0], r[1]) for r in own_rows)

    own_rows = [tuple(r) for r in docs.collect()]
    fps = {r[:2]: test_simhash.brute_fp(r[1]) for r in own_rows}
    groups = test_simhash.brute_groups(fps.values(), 4)
    docs = stages["simhash_near_dedup"](spark, docs, at).cache()
    assert sorted(groups[fps[tuple(r)[:2]]] for r in docs.collect()) == sorted(set(groups.values())) and docs.count() < len(own_rows)

    own_rows = [tuple(r) for r in docs.collect()]
    bad = {r[0] for r in test_decontaminate.brute(own_rows, items, 10) if r[-1]}
    docs = stages["benchmark_decontamination"](spark, docs, at).cache()
    assert key(docs.collect()) == key(r for r in own_rows if r[0] not in bad) and bad
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    out = stages["best_fit_packing"](spark, docs, at).collect()
    sizes = {r["doc_id"]: len(own().encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    got = {}
    for r in out:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == sizes
    assert len({r["sequence_id"] for r in out}) == best_fit([r["length"] for r in out], packing.CAPACITY)
    assert PATH.endswith("byte_bpe_50k.json")


def test_run_is_the_stages_in_turn(spark, tables):
    at = tables[0]
    shared = Path(shared_dir(spark).removeprefix("file://"))
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at).cache()
    pieces = lambda df: key((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    before = {p for p in shared.rglob("*.parquet")}
    out = corpus_pipeline.run(spark, at)
    assert {p.parent.name for p in shared.rglob("*.parquet") if p not in before} == {"best_fit_packing"}
    assert pieces(out) == pieces(docs)


@pytest.mark.parametrize("name", entry.QUERIES)
def test_queries_return_the_columns_agreed(spark, tables, name):
    agreed = {
        "op1": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op3": "doc_id n_words n_hit n_items items_sha256 contaminated",
        "op4": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op5": "doc_id held_out score predicted",
        "op6": "doc_id piece start length ids_crc32 sequence_id offset",
        "op7": "doc_id size text_crc32 law shard slot grown_shard",
        "op9": "doc_id fingerprint component_id",
        "op10": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    }
    out = entry.QUERIES[name](spark, tables[0])
    assert "doc_id" in out.columns and set(agreed.get(name.split("_")[0], "").split()) <= set(out.columns)
    assert out.count() >= len(tables[1])
