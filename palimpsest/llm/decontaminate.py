"""Benchmark decontamination by suffix arrays of the training text.

The training documents are cut into shards of a bounded number of words. In each shard the words that any benchmark
item has are numbered; stretches of them that are too short for any window cannot match and are left out, all others
stand one after another, with breaks between, in one sequence, over which a suffix array is built by prefix doubling.
Every suffix of every benchmark item is binary-searched in it, one more word at a time: the range of training suffixes
that agree with it narrows until it is empty. The range at the window's length gives the occurrences of the window,
the last non-empty range the longest verbatim match and its locations. The benchmark is searched in blocks of bounded
size, each against all rows.

Defined results: words are ASCII-lower-cased runs of letters, digits and non-ASCII characters; null texts have none;
an item of fewer words than a window is one window, an item of none matches nothing; repeated rows each get a row;
rows of a null id too; repeated item ids count once in n_items; null item ids are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_rows, join_sized, materialize, size_of

WINDOW = 10
#: Words of a shard of training text, but for a longer single text.
SHARD_WORDS = 2_000_000
#: Characters of benchmark text that one pass over the documents searches for.
BLOCK_CHARS = 32_000_000
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8."""
    return (text or b"").translate(_TABLE).split()


class Queries:
    """The suffixes of all items of a block as one sequence of word numbers, each item ended by 0."""

    def __init__(self, items: list[tuple[int, bytes | None]], window: int):
        self.number: dict[bytes, int] = {}
        self.window, seq, start, item, room = window, [], [], [], []
        self.ids = sorted({i for i, _ in items})
        place = {i: k for k, i in enumerate(self.ids)}
        self.least = 1 << 30
        for i, text in dict.fromkeys(items):
            own = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            if own:
                self.least = min(self.least, len(own), window)
                start += range(len(seq), len(seq) + len(own))
                item += [place[i]] * len(own)
                # words to agree on before the suffix holds a window; none if the suffix is shorter than one
                room += [window if len(own) - k >= window else len(own) if k == 0 else 0 for k in range(len(own))]
                seq += own + [0]
        self.seq, self.start, self.item, self.room = (np.array(x, np.int32) for x in (seq or [0], start, item, room))

    def __len__(self) -> int:
        return len(self.start)


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``seq`` sorted by what follows them, by at least ``depth`` numbers; numbers <= 0 are breaks and sort first."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    k, order = 1, np.argsort(rank, kind="stable")
    while k < depth:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[0, np.diff(key[order]) != 0])
        rank = new
        if rank[order[-1]] == n - 1:
            break
        k *= 2
    return order


def _narrow(seq: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of the ranges [lo, hi) of the suffix array whose number at ``depth`` is ``want``, by binary search."""
    n = len(seq)
    at = lambda i: np.where((p := order[np.minimum(i, n - 1)] + depth) < n, seq[np.minimum(p, n - 1)], -1)
    ends = []
    for right in (False, True):
        a, b = lo.copy(), hi.copy()
        while (open_ := a < b).any():
            mid = (a + b) // 2
            x = at(mid)
            less = open_ & ((x <= want) if right else (x < want))
            a, b = np.where(less, mid + 1, a), np.where(open_ & ~less, mid, b)
        ends.append(a)
    return ends[0], ends[1]


def search_shard(ids: list[np.ndarray], q: Queries) -> tuple[list[np.ndarray], list[set[int]], np.ndarray]:
    """For a shard of documents, as arrays of word numbers (0: no item has the word): masks of the hit words, items
    whose windows occur, and an array (3, documents): the words of each one's longest match that holds a window, the first
    place where one of that length starts and the first item that has it there."""
    hit, items = [np.zeros(len(x), bool) for x in ids], [set() for _ in ids]
    longest = np.stack([np.zeros(len(ids), np.int64), np.full(len(ids), -1), np.full(len(ids), -1)])
    pieces, origin, owner = [], [], []
    for d, x in enumerate(ids):
        known = np.flatnonzero(np.diff(np.r_[False, x > 0, False].astype(np.int8)))
        for a, b in zip(known[::2], known[1::2]):
            if b - a >= q.least:
                pieces += [x[a:b], [0]]
                origin.append(np.arange(a, b + 1))
                owner.append(np.full(b - a + 1, d))
    if not pieces or not len(q):
        return hit, items, longest
    seq, origin, owner = (np.concatenate(x).astype(np.int64) for x in (pieces, origin, owner))
    order = suffix_array(seq, int(np.diff(np.r_[-1, np.flatnonzero(q.seq == 0)]).max()))
    live = np.arange(len(q))
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(seq))
    depth, windows = 0, {}
    while len(live):
        a, b = _narrow(seq, order, lo[live], hi[live], depth, q.seq[q.start[live] + depth].astype(np.int64))
        some = a < b
        live, depth = live[some], depth + 1
        lo[live], hi[live] = a[some], b[some]
        full = live[q.room[live] == depth]
        if len(full):
            ranges, which = np.unique(np.stack([lo[full], hi[full]], 1), axis=0, return_inverse=True)
            for r, (x, y) in enumerate(ranges.tolist()):
                windows[(x, y, depth)] = q.item[full[which.reshape(-1) == r]]
        held = live[(q.room[live] > 0) & (q.room[live] <= depth)]
        if len(held):  # the longest so far: locations of the ranges, all of one depth
            held = held[np.lexsort((q.item[held], hi[held], lo[held]))]
            held = held[np.r_[True, (np.diff(lo[held]) != 0) | (np.diff(hi[held]) != 0)]]  # of a range the first item
            places = np.concatenate([order[x:y] for x, y in zip(lo[held].tolist(), hi[held].tolist())])
            own, item = owner[places], np.repeat(q.item[held], hi[held] - lo[held])
            first = np.lexsort((item, origin[places], own))
            first = first[np.r_[True, np.diff(own[first]) != 0]]
            longest[:, own[first]] = np.stack([np.full(len(first), depth), origin[places[first]], item[first]])
        live = live[q.seq[q.start[live] + depth] > 0]
    for (x, y, n), found in windows.items():
        places = order[x:y]
        for d, p in zip(owner[places].tolist(), origin[places].tolist()):
            hit[d][p : p + n] = True
            items[d].update(found.tolist())
    return hit, items, longest


def _spans(mask: np.ndarray) -> list[int]:
    return np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8))).tolist()


def _search(docs: DataFrame, items: list[tuple[int, bytes | None]], window: int) -> DataFrame:
    """(row, doc_id, text_hash, n_words, spans, items, longest, longest_at, longest_item); spans: starts and ends of hit words."""
    sent = docs.sparkSession.sparkContext.broadcast(Queries(items, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        get = q.number.get

        def out(rows: list) -> pa.RecordBatch:
            hit, found, longest = search_shard([r[2] for r in rows], q)
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()),
                pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([_spans(h) for h in hit], pa.list_(pa.int64())),
                pa.array([[q.ids[k] for k in sorted(f)] for f in found], pa.list_(pa.int64())), pa.array(longest[0]), pa.array(longest[1]), pa.array([q.ids[k] if k >= 0 else None for k in longest[2].tolist()], pa.int64())], names)

        held, n = [], 0
        for batch in batches:
            for row, doc, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), arrow_rows(batch, "text")):
                own = words(text)
                held.append((row, doc, np.fromiter((get(w, 0) for w in own), np.int32, len(own)), key))
                n += len(own)
                if n >= SHARD_WORDS:
                    yield out(held)
                    held, n = [], 0
        if held:
            yield out(held)

    names = ["row", "doc_id", "text_hash", "n_words", "spans", "items", "longest", "longest_at", "longest_item"]
    return docs.mapInArrow(run, "row long, doc_id long, text_hash long, n_words long, spans array<long>, items array<long>, longest long, longest_at long, longest_item long")


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
           block_chars: int = BLOCK_CHARS) -> DataFrame:
    """For each row of ``docs``: doc_id, text_hash, n_words, spans (starts and ends of the hit words), items (ids whose windows
    occur), longest (words of the longest verbatim match that holds a window, or 0), longest_at (the first word of the first one
    so long, from 0, or -1) and longest_item (the smallest id of an item that has it, or null)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    bench = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = 1 + (bench.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    parts = lambda k: [(r[0], r[1].encode()) for r in bench.where(block == k).collect()]
    if blocks == 1:
        return _search(rows.select(F.lit(0).cast("long").alias("row"), "doc_id", "text_hash", "text"), parts(0), window).drop("row")
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_hash", "text"), "decontaminate_rows")
    every = None
    for k in range(blocks):
        own = _search(rows, parts(k), window)
        every = own if every is None else every.unionAll(own)
    pairs = F.transform(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), lambda i: F.struct(F.get("spans", i).alias("a"), F.get("spans", i + 1).alias("b")))
    every = every.withColumn("pairs", F.when(F.size("spans") > 0, pairs).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>")))
    one = every.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.first("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("pairs"))).alias("pairs"),
        F.sort_array(F.flatten(F.collect_list("items"))).alias("items"), F.max(F.struct("longest", (-F.col("longest_at")).alias("at"), (-F.col("longest_item")).alias("item"))).alias("m"))
    merged = F.aggregate("pairs", F.array().cast("array<bigint>"), lambda s, p: F.when(
        (F.size(s) > 0) & (F.element_at(s, -1) >= p["a"]),
        F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(F.greatest(F.element_at(s, -1), p["b"])))).otherwise(F.concat(s, F.array(p["a"], p["b"]))))
    return one.select("doc_id", "text_hash", "n_words", merged.alias("spans"), "items", "m.longest", (-F.col("m.at")).alias("longest_at"), (-F.col("m.item")).alias("longest_item"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated, longest, longest_at, longest_item) for each row of ``docs``."""
    found = search(docs, benchmark, window)
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda s, x: s + x)
    names = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "longest", "longest_at", "longest_item")


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold an occurrence of a window."""
    found = search(docs, benchmark, window, id_col, text_col).where(F.size("spans") > 0)
    found = materialize(found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "contaminated")
    same = F.col(f"r.{id_col}").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(f"r.{text_col}") == F.col("_hash"))
    rows = docs.select(F.struct("*").alias("r"))
    return join_sized(rows, found, size_of(found), same, "left_anti").select("r.*")


def sha256_of(items: list[int]) -> str:
    """The digest of a document's items, for tests."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def op3(spark, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash")


OP3_SQL = r"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, row_number() OVER () AS b, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item_id, b, j, k, array_to_string(w[j:j+k-1], ' ') AS g FROM (SELECT item_id, b, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS j FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, i, k, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN ks WHERE len(w) >= k)),
h AS (SELECT dw.r, dw.i, dw.k, bw.item_id, bw.b, bw.j FROM dw JOIN bw ON bw.g = dw.g AND bw.k = dw.k),
p AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(range(i, i + k)) AS x FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY r),
m AS (SELECT r, item_id, min(i) AS i, count(*) + k - 1 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY r, b, i - j ORDER BY i) AS run FROM h) GROUP BY r, item_id, b, k, i - j, run),
l AS (SELECT r, item_id, i, n FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY n DESC, i, item_id) AS q FROM m) WHERE q = 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated,
  coalesce(l.n, 0) AS longest, coalesce(l.i, 0) - 1 AS longest_at, l.item_id AS longest_item
FROM d LEFT JOIN p ON p.r = d.r LEFT JOIN t ON t.r = d.r LEFT JOIN l ON l.r = d.r
"""
