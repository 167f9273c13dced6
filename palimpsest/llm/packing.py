"""Best-fit packing of tokenized documents into sequences, bulk-synchronous.

Documents are tokenized and ended by the end id; only those longer than a sequence are cut, into pieces of whole
sequences whose first may be shorter. Pieces are range-sorted by length, longest first, and so get a global rank.
Gaps are kept range-sorted too: as runs of sequences that have the same gap. A superstep takes all pieces of one
length: they sweep over the successor gaps, smallest first, and conflicts are resolved by rank: the j-th piece takes
the j-th place of the sweep, where a gap offers as many places as the length fits in. Pieces that no gap is left for
open new sequences. Then the gaps are updated and the next length follows, so a superstep handles any number of pieces
and there are at most as many supersteps as lengths. What one superstep decides are runs (first rank, count, first
sequence, offset); their number depends on the capacity, not on the documents. Each row finds its run by its rank.

Defined results: a null text is an empty one and takes one place, for the end id; repeated rows are packed each;
an empty table packs to no sequences; sequence ids run from 0 without gaps.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialize

CAPACITY = 2048
END_ID = 0
#: Splits text before the merges, as byte-level BPE vocabularies of this kind fix it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(vocab: str):
    """text -> array of ids, for the JSON of a byte-level BPE whose ids rise with its merges.

    The ids are those that the tokenizers library gives with that file, but merged by tiktoken, about four times as
    fast; a probe at the start compares both, and a vocabulary for which they differ is left to tokenizers. So is any
    text that tiktoken's regex engine gives up on.
    """
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(vocab)
    own.encode_special_tokens = True
    slow = lambda x: np.array(own.encode(x, add_special_tokens=False).ids, np.uint32)
    model = json.loads(vocab)
    special = {x["content"] for x in model.get("added_tokens", [])}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    try:
        ranks = {bytes(byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    except (KeyError, ValueError):
        return slow

    def quick(x: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(x, disallowed_special=())
        except ValueError:  # its regex engine gives up on runs of about a million blanks
            return slow(x)

    probe = "It's 1234 déjà-vu,  ñandú\t\n\n über… 漢字  x <|endoftext|> a_b [42]   "
    return quick if quick(probe).tolist() == slow(probe).tolist() else slow


def tokenize(docs: DataFrame, vocab: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) for each piece. vocab: the JSON of a vocabulary, not its path."""
    sent = docs.sparkSession.sparkContext.broadcast(vocab)
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(sent.value)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            out: list[list] = [[] for _ in range(5 + keep_ids)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([ids_of(text.as_py() or ""), end]).astype("<u4", copy=False)
                first = len(ids) % capacity or capacity
                for k, (a, b) in enumerate(zip([0, *range(first, len(ids), capacity)], range(first, len(ids) + 1, capacity))):
                    part = ids[a:b].tobytes()
                    for x, v in zip(out, (doc, k, a, b - a, zlib.crc32(part), part)):
                        x.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Runs (first rank, count, first sequence, offset), by rank. counts: pieces of each length; ranks by falling length."""
    runs: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs (first sequence, count)
    order: list[int] = []  # the gaps that are there, sorted
    rank = sequences = 0

    def give(gap: int, run: tuple[int, int]) -> None:
        if gap and run[1]:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append(run)

    def fill(length: int, n: int, gap: int, run: tuple[int, int]) -> int:
        """Puts up to n pieces into the sequences of a run; how many."""
        nonlocal rank
        first, count = run
        each, put = gap // length, 0
        whole = min(count, n // each)
        for first, count, each in ((first, whole, each), (first + whole, min(1, count - whole), (n - whole * each) % each if whole < count else 0)):
            if count and each:
                for k in range(each):
                    runs.append((rank, count, first, capacity - gap + k * length))
                    rank, put = rank + count, put + count
                give(gap - each * length, (first, count))
            elif count:
                give(gap, (first, count))
        rest = run[1] - whole - 1
        if rest > 0:
            give(gap, (run[0] + whole + 1, rest))
        return put

    for length in sorted(counts, reverse=True):
        n = counts[length]
        for gap in order[bisect.bisect_left(order, length):]:
            held = gaps.pop(gap)
            order.remove(gap)
            for run in held:
                if n:
                    n -= fill(length, n, gap, run)
                else:
                    give(gap, run)
            if not n:
                break
        if n:
            opened = -(-n // (capacity // length))
            fill(length, n, capacity, (sequences, opened))
            sequences += opened
    return runs


def pack(docs: DataFrame, vocab: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for each piece."""
    pieces = tokenize(docs, vocab, capacity, end_id, keep_ids, id_col, text_col)
    pieces = materialize(pieces.withColumn("at", F.monotonically_increasing_id()), "pieces")
    ranked = pieces.repartitionByRange(F.desc("length"), F.col("at")).sortWithinPartitions(F.desc("length"), "at")
    ranked = materialize(ranked.drop("at").withColumn("rid", F.monotonically_increasing_id()), "ranked_pieces")
    sizes = sorted((r[0], r[1]) for r in ranked.groupBy(F.shiftright("rid", 33).alias("p")).count().collect())
    before = np.zeros(1 + max([0, *(p for p, _ in sizes)]), np.int64)
    total = 0
    for p, n in sizes:
        before[p], total = total, total + n
    runs = plan({r[0]: r[1] for r in ranked.groupBy("length").count().collect()}, capacity)
    sent = docs.sparkSession.sparkContext.broadcast((before, np.array(runs, np.int64).reshape(-1, 4)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, runs = sent.value
        for batch in batches:
            rid = batch.column(batch.schema.get_field_index("rid")).to_numpy()
            rank = before[rid >> 33] + (rid & ((1 << 33) - 1))
            own = runs[np.searchsorted(runs[:, 0], rank, side="right") - 1] if len(rank) else np.empty((0, 4), np.int64)
            columns = [c for c, f in zip(batch.columns, batch.schema) if f.name != "rid"]
            names = [f.name for f in batch.schema if f.name != "rid"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(own[:, 2] + rank - own[:, 0]), pa.array(own[:, 3])], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rid")
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the token ids of each sequence as little-endian unsigned 32-bit numbers; of pack(keep_ids=True)."""
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p")).select(
        "sequence_id", "n_tokens", F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["ids"])).alias("ids"))


def vocabulary(spark: SparkSession, path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def op6(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json")))
    return out.withColumn("length", F.col("length").cast("long"))
