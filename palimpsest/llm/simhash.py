"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming distance, with components.

Candidates come from pigeonring filtering. The 64 bits are a ring of ``distance + 1`` segments. If two fingerprints
differ in at most ``distance`` bits, then from some segment on every chain of k consecutive segments differs in at
most ``k * distance / (distance + 1)`` bits, rounded down: 0, then 1, 2 and so on. So the first segment of the chain is
equal and of the two halves of the second at least one is. First segment and half make the bucket key; within a bucket
the chain is lengthened segment by segment and only what stays within the budgets is held against the full distance.
Buckets over a limit are dealt anew by a longer chain: of the k parts of the next segment one must be equal, again.

Within a bucket a breadth-first search over what is not yet reached gives a spanning forest, not all pairs, so a dense
group costs about as many links as members. Components are formed by alternating large-star and small-star rounds.

Defined results: a null text is an empty one; no words give fingerprint zero, linked like any other; fewer words than
a shingle make one shingle; repeated rows each get a row; component_id is null if all ids of a component are.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import arrow_rows, join_sized, materialize, size_of

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Rows of a bucket beyond which it is dealt anew by longer chains.
BUCKET_ROWS = 4096
#: Buckets up to this size are compared by row offset, many buckets at once.
SMALL = 24
#: Hashes whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text in UTF-8."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())), np.uint64, n)
    set_in = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        set_in += np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_in * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) for each row, fp as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in arrow_rows(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


@functools.cache
def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of the segments of the ring."""
    m = distance + 1
    return [(i * 64 // m, (i + 1) * 64 // m - i * 64 // m) for i in range(m)]


def mask(at: int, width: int) -> int:
    return ((1 << width) - 1) << at


def parts(at: int, width: int, n: int) -> list[int]:
    """Masks of the n parts of a segment."""
    return [mask(at + j * width // n, (j + 1) * width // n - j * width // n) for j in range(n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(fps: DataFrame, distance: int) -> DataFrame:
    """(key, start, depth, same, fp): the bucket keys of chains of two segments. same: mask of the bits that are equal."""
    ring, made = segments(distance), []
    for i in range(distance + 1):
        at, width = ring[(i + 1) % len(ring)]
        for part in parts(at, width, 2) if distance else [0]:
            made.append((i, _signed(part | mask(*ring[i]))))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("start"), F.lit(m).alias("same")) for i, m in made])).alias("k")
    rows = fps.select("fp", each).select("fp", "k.start", "k.same", F.lit(2).alias("depth"))
    return rows.withColumn("key", F.xxhash64("start", "same", F.col("fp").bitwiseAND(F.col("same"))))


def _longer(rows: DataFrame, distance: int) -> DataFrame:
    """The rows dealt by chains of one more segment."""
    ring = segments(distance)
    depth = rows.first()["depth"]
    choices = F.create_map(*[x for i in range(len(ring)) for x in (
        F.lit(i), F.array(*[F.lit(_signed(p)) for p in parts(*ring[(i + depth) % len(ring)], depth + 1)]))])
    return (
        rows.select("fp", "start", "same", (F.col("depth") + 1).alias("depth"), F.explode(choices[F.col("start")]).alias("p"))
        .select("fp", "start", "depth", F.col("same").bitwiseOR(F.col("p")).alias("same"))
        .withColumn("key", F.xxhash64("start", "same", F.col("fp").bitwiseAND(F.col("same"))))
    )


def _near(x: np.ndarray, y: np.ndarray, start: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs keep the chain budgets from segment ``start`` on and then the full distance."""
    d = x ^ y
    ring = segments(distance)
    alive = np.arange(len(d))
    masks = np.zeros(len(ring), np.uint64)
    for k in range(len(ring)):
        masks |= np.array([mask(*ring[(i + k) % len(ring)]) for i in range(len(ring))], np.uint64)
        budget = (k + 1) * distance // len(ring)
        alive = alive[np.bitwise_count(d[alive] & masks[start[alive]]) <= budget]
    out = np.zeros(len(d), bool)
    out[alive] = True
    return out


def _search(fps: np.ndarray, start: int, distance: int) -> list[tuple[int, int]]:
    """Links that span the components of a bucket, breadth first."""
    left, links = fps, []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            hit = _near(left, np.broadcast_to(x, left.shape), np.broadcast_to(start, left.shape), distance)
            if hit.any():
                links += [(int(x), int(y)) for y in left[hit]]
                todo += list(left[hit])
                left = left[~hit]
    return links


def _bucket_links(key: np.ndarray, start: np.ndarray, fp: np.ndarray, distance: int) -> np.ndarray:
    """Links (n, 2) within whole buckets, whose rows come sorted by key."""
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.diff(edge)
    links = []
    for j in np.flatnonzero(size > SMALL):
        a, b = edge[j], edge[j + 1]
        links += _search(fp[a:b], start[a], distance)
    out = [np.array(links, np.uint64).reshape(-1, 2)]
    small = np.repeat(size <= SMALL, size)
    for k in range(1, min(SMALL, len(key))):
        i = np.flatnonzero((key[k:] == key[:-k]) & small[k:])
        if not len(i):
            break
        i = i[_near(fp[i], fp[i + k], start[i], distance)]
        out.append(np.stack([fp[i], fp[i + k]], 1))
    return np.concatenate(out)


def links(fps: DataFrame, distance: int = DISTANCE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b), a > b: links between distinct fingerprints (column fp) that join each component; not all pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)]

        def made(rows: list[np.ndarray]) -> pa.RecordBatch:
            found = _bucket_links(*rows, distance).view(np.int64)
            found = np.unique(np.sort(found, axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, j])) for j in (1, 0)], ["a", "b"])

        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy().view(np.uint64)]
            held = [np.concatenate(x) for x in zip(held, new)]
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last bucket may go on
            if whole:
                yield made([x[:whole] for x in held])
                held = [x[whole:] for x in held]
        if len(held[0]):
            yield made(held)

    rows, found = _keys(fps, distance), None
    for depth in range(2, max(distance, 1) + 2):
        hot = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows).select("key")
        hot = materialize(hot, "simhash_hot") if depth <= distance else hot.limit(0)
        n = size_of(hot) if depth <= distance else 0
        kept = rows if not n else join_sized(rows, hot, n, ["key"], "left_anti")
        near = kept.select("key", "start", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")
        found = near if found is None else found.unionAll(near)
        if not n:
            break
        rows = materialize(_longer(join_sized(rows, hot, n, ["key"], "left_semi"), distance), "simhash_longer")
    return materialize(found.distinct(), "simhash_links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b); root: the smallest node of its component."""
    stars = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    mark = None
    while True:
        both = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large_star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        stars = materialize(small.select("e.*").where("u <> v").distinct(), "small_star")
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())
        if now == mark:
            break
        mark = now
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for each row; component_id: the smallest id that links reach."""
    fps = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash_classes")
    edges = links(classes.select("fp"), distance)
    groups = components(edges).withColumnRenamed("node", "fp").join(classes, "fp")
    least = groups.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = groups.join(least, "root").select("fp", "component_id")
    table = materialize(classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")), "simhash_components")
    return join_sized(fps, table, size_of(table), ["fp"], "left").select("doc_id", "text_hash", "fp", "component_id")


def deduplicate(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the smallest id, of that the smallest text hash, of that the smallest hash of all columns.

    Rows of a null id in a component that has other ids go; if all ids of a component are null, one row stays.
    """
    found = near_duplicates(docs, distance, shingle, id_col, text_col)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    # a component that has no id is told by its fingerprint's class
    keys = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp")).agg(F.min(first).alias("k"))
    kept = materialize(keys.select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash")), "simhash_kept")
    n = size_of(kept)
    same = F.col(f"r.{id_col}").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(f"r.{text_col}") == F.col("_hash"))
    repeated = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    repeated = materialize(repeated.join(kept.select(F.col("_id").alias("i"), F.col("_hash").alias("h")), F.col("_id").eqNullSafe(F.col("i")) & (F.col("_hash") == F.col("h")), "left_semi"), "simhash_repeated")
    rows = join_sized(docs.select(F.struct("*").alias("r")), kept, n, same, "left_semi")
    m = size_of(repeated)
    if not m:
        return rows.select("r.*")
    once = join_sized(rows, repeated, m, same, "left_anti")
    more = join_sized(rows, repeated, m, same, "left_semi").groupBy(F.col(f"r.{id_col}"), F.xxhash64(f"r.{text_col}")).agg(F.min_by("r", F.xxhash64("r")).alias("r"))
    return once.unionAll(more.select("r")).select("r.*")


def op9(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
