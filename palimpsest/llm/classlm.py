"""Language-model scoring by class-based n-grams after Brown: words have classes, found by exchange clustering.

Training counts cover all training tokens. The commonest words are symbols of their own; all others share symbols by
their ending, so the table of symbol pairs, counted over all training text, has a fixed size. Exchange clustering on
that table moves one symbol after another to the class that most raises the likelihood of the class bigrams. Then
distributed sweeps move every word without a symbol of its own, however rare, to the class that its own neighbours,
counted by class over all training text, make likeliest; all words of a sweep choose against the same class tables, which
are counted anew before the next. Endings decide only for unseen words. A text's probability is the product of class
transitions, smoothed towards class frequencies, and word emissions, discounted absolutely; what the discount frees is
spread evenly over the class's unseen words, whose number is estimated from its words seen once and twice (Chao). A text's end is
a token with a class of its own.

Counts and classes of all words are unbounded, so no task holds them. Texts are numbered once, by chunks: a chunk is a
run of texts of one task, with a list of its own words. Each pass joins the lists with the words' classes and brings
lists and numbered texts of a chunk together again; a task streams over its chunks and holds the word list of one.

Defined results: a null text is an empty one; a null id counts as the empty string when rows are held out; repeated
rows are counted and scored each; without training text every score is 0.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize, release

#: Words that are symbols of their own; symbols that all other words share by their last bytes; bytes of an ending.
OWN, SHARED, ENDING = 640, 192, 3
CLASSES = 56
SWEEPS = 12
#: Weight of the class frequencies in the transitions.
PRIOR = 4.0
#: Sweeps over the words without a symbol of their own.
WORD_SWEEPS = 2
#: Bytes of text of a chunk, but for a longer single text; bytes that are split into words at once.
CHUNK_BYTES, SLICE_BYTES = 12_000_000, 4_000_000
#: Neighbours that a task of a sweep holds before it hands them on.
SWEPT_CELLS = 4_000_000
#: Marks the class of an unseen word in a path.
UNSEEN = 128


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The text (its place) and the word (its place in the list) of each token of ``texts``, and the list of words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    sizes, coded = pc.list_value_length(lists).to_numpy(), lists.flatten().dictionary_encode()
    row, word, words = np.repeat(np.arange(len(texts)), sizes), coded.indices.to_numpy(), coded.dictionary
    blank = pc.index(words, "").as_py()  # what stands before a leading gap
    if blank >= 0:
        keep = word != blank
        row, word = row[keep], word[keep]
        word, words = word - (word > blank), pa.concat_arrays([words[:blank], words[blank + 1:]])
    return row, word, words


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about SLICE_BYTES of text."""
    part = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def shared_symbol(word: bytes) -> int:
    return zlib.crc32(word[-ENDING:]) % SHARED


def exchange(pairs: np.ndarray, classes: int, fixed: int, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each symbol. pairs[a, b]: how often b follows a; symbol ``fixed`` alone has class 0.

    The commonest symbols start with a class each; the first sweep brings the others into their best classes.
    """
    size = len(pairs)
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    pairs = pairs.astype(float)
    order = [s for s in np.argsort(-(pairs.sum(0) + pairs.sum(1)), kind="stable") if s != fixed]
    of = np.full(size, -1, np.int64)
    of[fixed] = 0
    of[order[: classes - 1]] = 1 + np.arange(len(order[: classes - 1]))
    member = np.zeros((size, classes))
    member[of >= 0, of[of >= 0]] = 1
    n = member.T @ pairs @ member
    for _ in range(sweeps):
        moved = 0
        for s in order:
            a, self_ = of[s], pairs[s, s]
            to, from_ = pairs[s] @ member, pairs[:, s] @ member
            if a >= 0:
                n[a] -= to
                n[:, a] -= from_
                n[a, a] += self_
                to[a] -= self_
                from_[a] -= self_
            row, col = n.sum(1) + from_, n.sum(0) + to  # pairs with s count wherever it goes
            old = f(n)
            gain = (f(n + to) - old).sum(1) + (f(n + from_[:, None]) - old).sum(0)
            d, own = np.diag(n), np.diag(old)
            gain += f(d + to + from_ + self_) + own - f(d + to) - f(d + from_)
            gain -= f(row + to.sum() + self_) - f(row) + f(col + from_.sum() + self_) - f(col)
            gain[0] = -np.inf
            best = int(np.argmax(gain))
            if a >= 0 and gain[best] <= gain[a] + 1e-9:
                best = a
            moved += best != a
            n[best] += to
            n[:, best] += from_
            n[best, best] += self_
            member[s] = 0
            member[s, best], of[s] = 1, best
        if not moved:
            break
    return of


@dataclass
class Model:
    """What scoring needs, of a size that does not depend on the corpus."""

    own: dict[bytes, int]
    of: np.ndarray  # class of each symbol
    transition: np.ndarray  # log10 p(class | class before)
    total: np.ndarray  # tokens of each class
    discount: float
    unseen: np.ndarray  # log10 emission of one unseen word of each class
    unseen_words: np.ndarray  # estimate of the unseen words of each class
    pairs: np.ndarray  # how often each class follows each
    train_tokens: int
    types: int

    def symbol(self, word: bytes) -> int:
        s = self.own.get(word)
        return OWN + shared_symbol(word) if s is None else s


def symbol_class(word: Column, model: Model) -> Column:
    """The class of the symbol that words without one of their own share."""
    symbol = F.crc32(F.substring(word.cast("binary"), -ENDING, ENDING)) % SHARED
    return F.get(F.lit(model.of[OWN : OWN + SHARED].tolist()), symbol.cast("int")).cast("int")


def held_out(id_col: Column, parts: int, part: int) -> Column:
    """Whether crc32(id as text) mod parts is part."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts == part


def encode(docs: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Numbered texts and word lists of chunks, written once.

    A row for each word of a chunk (chunk, pos, word, wid: its hash, n: how often its training rows have it) and one for each text
    (chunk, doc_id, train, ids: its words' pos as 32-bit integers); the others' columns are null. train: which rows count; all if None.
    """
    mark = F.lit(True) if train is None else F.coalesce(train, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), mark.alias("train"), F.col(text_col).alias("text"))
    names = ["chunk", "pos", "word", "n", "doc_id", "train", "ids"]
    types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24

        def out(held: list) -> Iterator[pa.RecordBatch]:
            coded = pa.chunked_array([pa.DictionaryArray.from_arrays(pa.array(word, pa.int32()), words) for _, _, word, words in held]).unify_dictionaries()
            words, n = coded.chunk(0).dictionary, 0
            for (part, row, _, _), x in zip(held, coded.chunks):
                n = n + np.bincount(x.indices.to_numpy()[part.column(1).to_numpy(zero_copy_only=False)[row]], minlength=len(words))
            made = lambda size, **own: pa.RecordBatch.from_arrays([own.get(c, pa.nulls(size, t)) for c, t in zip(names, types)], names)
            yield made(len(words), chunk=pa.array(np.full(len(words), number)), pos=pa.array(np.arange(len(words), dtype=np.int32)), word=words, n=pa.array(n.astype(np.int64)))
            for (part, row, _, _), x in zip(held, coded.chunks):
                ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(part)))] * 4
                ids = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(x.indices.to_numpy().astype("<i4"))])
                yield made(len(part), chunk=pa.array(np.full(len(part), number)), doc_id=part.column(0), train=part.column(1), ids=ids)

        held, size = [], 0
        for batch in batches:
            for part in slices(batch):
                held.append((part, *split_words(part.column(2))))
                size += part.column(2).nbytes
                if size >= chunk_bytes:
                    yield from out(held)
                    held, size, number = [], 0, number + 1
        if held:
            yield from out(held)

    coded = rows.mapInArrow(run, "chunk long, pos int, word string, n long, doc_id long, train boolean, ids binary")
    return materialize(coded.withColumn("wid", _wid()), "encoded_texts")


def _wid() -> Column:
    """Words are told by this hash while they choose classes; counts and scores go by the words themselves."""
    return F.when(F.col("word").isNotNull(), F.xxhash64("word"))


def word_counts(train: DataFrame, encoded: DataFrame | None = None) -> DataFrame:
    """(word, ending, n) over all texts (column text); encoded: of ``encode``, instead of them, its training rows."""
    encoded = encode(train.select(F.lit(None).cast("long").alias("doc_id"), "text")) if encoded is None else encoded
    ending = (F.crc32(F.substring(F.col("word").cast("binary"), -ENDING, ENDING)) % SHARED).cast("int")
    return encoded.where("n > 0").groupBy("word").agg(F.sum("n").alias("n")).select("word", ending.alias("ending"), "n")


def symbol_pairs(train: DataFrame, own: dict[bytes, int]) -> np.ndarray:
    """How often each symbol follows each, over all texts; the last symbol is a text's end and its start."""
    size = OWN + SHARED + 1
    sent = train.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = sent.value, np.zeros(size * size, np.int64)
        for batch in batches:
            for part in slices(batch):
                row, word, words = split_words(part.column(0))
                kind = np.fromiter((OWN + shared_symbol(w) if (s := own.get(w)) is None else s for w in words.cast(pa.binary()).to_pylist()), np.int64, len(words))
                line = np.full(len(row) + len(part) + 1, size - 1)
                line[np.arange(len(row)) + row + 1] = kind[word] if len(row) else 0
                total += np.bincount(line[:-1] * size + line[1:], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    cells = train.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = cells.toArrow()  # at most size * size rows
    out = np.zeros(size * size, np.int64)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(size, size)


def _seen(counts: DataFrame, by: str) -> list:
    """(by, distinct words, of them seen once, seen twice)"""
    return counts.groupBy(by).agg(F.count("*"), F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))).collect()


def fit(train: DataFrame, counts: DataFrame, classes: int = CLASSES) -> Model:
    """The model of all texts of ``train``, whose word counts are ``counts``."""
    texts = train.count()
    first = counts.orderBy(F.desc("n"), "word").limit(OWN).collect()
    own = {r["word"].encode(): i for i, r in enumerate(first)}
    total = counts.agg(F.sum("n")).first()[0] or 0
    seen = np.zeros((OWN + SHARED + 1, 3), np.int64)  # distinct words of each symbol, seen once, seen twice
    for r in _seen(counts, "ending"):
        seen[OWN + r[0]] = r[1:]
    types, ones, twos = seen.sum(0).tolist()
    for i, r in enumerate(first):
        seen[i] = 1, r["n"] == 1, r["n"] == 2
        seen[OWN + r["ending"]] -= seen[i]
    pairs = symbol_pairs(train, own)
    of = exchange(pairs, classes, len(pairs) - 1)
    member = np.eye(classes)[of]
    n = member.T @ pairs @ member
    discount = ones / (ones + 2 * twos) if ones and twos else 0.5
    return Model(own, of, *tables(n, member.T @ seen, discount), total + texts, types + bool(texts))


def tables(n: np.ndarray, seen: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, np.ndarray, np.ndarray]:
    """transition, total, discount, unseen, unseen_words and pairs of a model. n: class pairs; seen: distinct words of each class, seen once, seen twice."""
    size = n.sum(0)
    share = (size + 1) / (size.sum() + len(n))
    words, ones, twos = seen.T
    unseen_words = np.maximum(1, ones * (ones - 1) / (2 * (twos + 1)))
    with np.errstate(divide="ignore", invalid="ignore"):
        transition = np.log10((n + PRIOR * share) / (n.sum(1, keepdims=True) + PRIOR))
        # a class of no words has its whole mass for unseen ones
        unseen = np.where(words > 0, np.log10(discount * words / np.maximum(size, 1)), 0.0) - np.log10(unseen_words)
    return transition, size, discount, unseen, unseen_words, n


def _meet(encoded: DataFrame, lists: DataFrame, texts: Column | None = None) -> DataFrame:
    """Word lists (chunk, pos, a, class, moves) and numbered texts of each chunk in one task, the list first: (at, a, b, ids),
    b: pos, class and moves in one number; for texts a is the id and b is null."""
    packed = F.shiftleft(F.col("pos").cast("long"), 9) + F.col("class") * 2 + F.col("moves").cast("int")
    words = lists.select((F.col("chunk") * 2).alias("at"), "a", packed.alias("b"), F.lit(None).cast("binary").alias("ids"))
    rows = encoded.where(F.col("ids").isNotNull()).where(F.lit(True) if texts is None else texts).select(
        (F.col("chunk") * 2 + 1).alias("at"), F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "ids")
    return words.unionAll(rows).repartition(F.shiftright("at", 1)).sortWithinPartitions("at")


class _Words:
    """The word list of a chunk as arrays by pos."""

    def __init__(self, parts: list[pa.RecordBatch]):
        a, b = (np.concatenate([np.empty(0, np.int64), *(x.column(i).to_numpy() for x in parts)]) for i in (1, 2))
        pos = b >> 9
        size = int(pos.max()) + 1 if len(pos) else 0
        self.kind, self.a, self.moves = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool)
        self.kind[pos], self.a[pos], self.moves[pos] = b >> 1 & 255, a, b & 1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Words, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """For parts of the texts of one chunk: its word list, the rows, the text (its place) and the word (pos) of each token."""
    held, now, words = [], None, None
    for batch in batches:
        at = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for a, b in zip(edges, edges[1:]):
            if b == a:
                continue
            if at[a] >> 1 != now:
                held, now, words = [], at[a] >> 1, None
            part = batch.slice(a, b - a)
            if at[a] % 2 == 0:
                held.append(part)
                continue
            words = words or _Words(held)
            held = []
            ids = part.column(3).cast(pa.binary())
            ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
            own = np.frombuffer(ids.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view("<i4")
            yield words, part, np.repeat(np.arange(len(ids)), np.diff(ends) // 4), own


def _line(kinds: np.ndarray, row: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all tokens with 0 before and after each text, and where in it the tokens stand."""
    line, at = np.zeros(len(row) + texts + 1, np.int64), np.arange(len(row)) + row + 1
    line[at] = kinds
    return line, at


def neighbours(encoded: DataFrame, words: DataFrame, classes: int, texts: Column | None = None) -> DataFrame:
    """(wid, cells): for parts of the texts the neighbours of each word that moves, and, with a null wid, how often each class follows each.

    A cell is a neighbour's class, plus the number of classes if it stands before. cells has a byte for each neighbour, or,
    where that would be longer, a 32-bit count for each cell. words: (wid, class, moves).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, held, last, cells = np.zeros(classes * classes, np.int64), [], None, 2 * classes

        def out() -> Iterator[pa.RecordBatch]:
            keys = np.sort(np.concatenate(held))
            edge = np.r_[0, np.flatnonzero(np.diff(keys // cells)) + 1, len(keys)]
            wid, many = last.a[keys[edge[:-1]] // cells], np.diff(edge) >= 4 * cells
            few = np.repeat(~many, np.diff(edge))
            ends = np.r_[0, np.cumsum(np.diff(edge)[~many])].astype(np.int32)
            plain = pa.Array.from_buffers(pa.binary(), int((~many).sum()), [None, pa.py_buffer(ends), pa.py_buffer((keys[few] % cells).astype(np.uint8))])
            yield pa.RecordBatch.from_arrays([pa.array(wid[~many]), plain], ["wid", "cells"])
            for i in np.flatnonzero(many):
                counts = np.bincount(keys[edge[i] : edge[i + 1]] % cells, minlength=cells).astype("<i4")
                yield pa.RecordBatch.from_arrays([pa.array(wid[i : i + 1]), pa.array([counts.tobytes()])], ["wid", "cells"])

        for own, part, row, word in _chunks(batches):
            if held and (own is not last or sum(map(len, held)) > SWEPT_CELLS):
                yield from out()
                held = []
            last = own
            line, at = _line(own.kind[word], row, len(part))
            pairs += np.bincount(line[:-1] * classes + line[1:], minlength=len(pairs))
            moves = own.moves[word]
            at, word = at[moves], word[moves].astype(np.int64)
            if len(word):
                held += [word * cells + line[at + 1], word * cells + classes + line[at - 1]]
        if held:
            yield from out()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([pairs.astype("<i8").tobytes()])], ["wid", "cells"])

    lists = encoded.where("n > 0").select("chunk", "pos", "wid").join(words.select("wid", "class", "moves"), "wid")
    return materialize(_meet(encoded, lists.withColumnRenamed("wid", "a"), texts).mapInArrow(run, "wid long, cells binary"), "neighbours")


def class_pairs(parts: DataFrame, classes: int) -> np.ndarray:
    """The sum of the tables (column cells) in ``parts``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_py(), "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    out = np.zeros(classes * classes)
    for r in parts.select("cells").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(classes, classes)


def best_classes(near: DataFrame, pairs: np.ndarray) -> DataFrame:
    """(wid, class) of each word of ``neighbours``: the class that its neighbours make likeliest. pairs: how often each class follows each."""
    classes, size = len(pairs), pairs.sum(0)
    share = (size + 1) / (size.sum() + classes)
    # the derivative of the likelihood that exchange() raises: log p(next | class) and log p(before | class)
    after, before = (np.log((n + PRIOR * share) / (n.sum(1, keepdims=True) + PRIOR)) for n in (pairs, pairs.T))
    gain = np.concatenate([after.T, before.T])
    gain[:, 0] = -np.inf
    sent = near.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        cells = len(gain)
        word, seen = None, np.zeros(cells)  # the last word may go on

        def out(words: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
            best = np.argmax(seen @ gain[:, 1:], axis=1) + 1
            return pa.RecordBatch.from_arrays([pa.array(words), pa.array(best.astype(np.int32))], ["wid", "class"])

        for batch in batches:
            if not batch.num_rows:
                continue
            words, sizes = batch.column(0).to_numpy(), pc.binary_length(batch.column(1)).to_numpy()
            new = np.r_[True, words[1:] != words[:-1]]
            group, many = np.cumsum(new) - 1, sizes >= 4 * cells
            lists, counts = (np.frombuffer(b"".join(batch.column(1).filter(pa.array(m)).to_pylist()), t) for m, t in ((~many, np.uint8), (many, "<i4")))
            found = np.bincount(np.repeat(group[~many], sizes[~many]) * cells + lists, minlength=(group[-1] + 1) * cells).reshape(-1, cells).astype(float)
            np.add.at(found, group[many], counts.reshape(-1, cells))
            distinct = words[new]
            if distinct[0] == word:
                found[0] += seen
            elif word is not None:
                yield out(np.array([word]), seen[None])
            if len(found) > 1:
                yield out(distinct[:-1], found[:-1])
            word, seen = distinct[-1], found[-1]
        if word is not None:
            yield out(np.array([word]), seen[None])

    return near.where("wid is not null").repartition("wid").sortWithinPartitions("wid").mapInArrow(run, "wid long, class int")


def word_classes(train: DataFrame, counts: DataFrame, model: Model, encoded: DataFrame | None = None, texts: Column | None = None, sweeps: int = WORD_SWEEPS) -> DataFrame:
    """(word, n, class) of every training word. encoded, texts: of ``encode``, and which of its texts are training texts."""
    spark, classes = train.sparkSession, len(model.pairs)
    encoded = encode(train.select(F.lit(None).cast("long").alias("doc_id"), "text")) if encoded is None else encoded
    own = F.broadcast(spark.createDataFrame([(w.decode(), int(model.of[i])) for w, i in model.own.items()], "word string, own int"))
    counts = counts.join(own, "word", "left").select(_wid().alias("wid"), "word", "n", "own")
    first = F.coalesce("own", symbol_class(F.col("word"), model))
    table = counts.select("wid", first.alias("class"), F.col("own").isNull().alias("moves"))
    for _ in range(sweeps):
        near = neighbours(encoded, table, classes, texts)
        pairs = class_pairs(near.where("wid is null"), classes)
        found = best_classes(near, pairs).withColumn("moves", F.lit(True))
        fixed = counts.where("own is not null").select("wid", F.col("own").alias("class"), F.lit(False).alias("moves"))
        table = materialize(found.unionAll(fixed), "swept_classes")
        release(near)
    out = counts.join(table.select("wid", "class"), "wid").select("word", "n", F.coalesce("own", "class").alias("class")) if sweeps else counts.select("word", "n", first.alias("class"))
    return materialize(out, "word_classes")


def refit(model: Model, words: DataFrame, coded: DataFrame) -> Model:
    """The model with the classes of ``words`` (word, n, class); coded: all its training texts by ``code``."""
    classes = len(model.pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for batch in batches:
            line = np.frombuffer(b"\0" + b"".join(x + b"\0" for x in batch.column(0).to_pylist()), np.uint8).astype(np.int64) % UNSEEN
            total += np.bincount(line[:-1] * classes + line[1:], minlength=classes * classes)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()])], ["cells"])

    n = class_pairs(coded.select("path").mapInArrow(run, "cells binary"), classes)
    seen = np.zeros((classes, 3))
    seen[0] = 1, 0, 0
    for r in _seen(words, "class"):
        seen[r[0]] = r[1:]
    transition, total, _, unseen, unseen_words, pairs = tables(n, seen, model.discount)
    return replace(model, transition=transition, total=total, unseen=unseen, unseen_words=unseen_words, pairs=pairs)


def code(docs: DataFrame, words: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, encoded: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, known, path) for each row of ``docs``. words: (word, n[, class]), else the class of the word's symbol.

    path: a byte for each token, its class, marked if unseen; known: sum of log10 of the known tokens' discounted counts.
    encoded: of ``encode``, instead of ``docs``.
    """
    encoded = encode(docs, None, id_col, text_col, chunk_bytes) if encoded is None else encoded
    shared = symbol_class(F.col("word"), model)
    if "class" not in words.columns:
        own = docs.sparkSession.createDataFrame([(w.decode(), int(model.of[i])) for w, i in model.own.items()], "word string, own int")
        words = words.join(F.broadcast(own), "word", "left").select("word", "n", F.coalesce("own", shared).alias("class"))
    ends, discount, floor = float(model.total[0]), model.discount, math.log10(model.train_tokens + model.types + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for own, part, row, word in _chunks(batches):
            if own is not last:
                last, base, seen = own, np.log10(own.a + 1.0), (own.a > 0).astype(float)
                known = np.where(own.a > 0, np.log10(np.maximum(own.a - discount, 1e-300)), 0.0)
            total = lambda x: np.bincount(row, x[word], len(part))
            sizes = np.bincount(row, minlength=len(part))
            path = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.py_buffer(own.kind[word].astype(np.uint8))])
            yield pa.RecordBatch.from_arrays([
                part.column(1), pa.array(sizes + 1), pa.array(total(seen).astype(np.int64) + int(ends > 0)),
                pa.array(total(base) + math.log10(ends + 1) - (sizes + 1) * floor), pa.array(total(known)), path],
                ["doc_id", "n_tokens", "n_known", "base_score", "known", "path"])

    lists = encoded.where(F.col("word").isNotNull()).select("chunk", "pos", "word").join(words.select("word", "n", "class"), "word", "left")
    lists = lists.select("chunk", "pos", F.coalesce("n", F.lit(0)).alias("a"), F.coalesce("class", shared + UNSEEN).alias("class"), F.lit(False).alias("moves"))
    return _meet(encoded, lists).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, known double, path binary")


def score_paths(coded: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of ``code``."""
    sent = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        emission = np.zeros(UNSEEN + len(m.pairs))
        emission[: len(m.pairs)] = -np.log10(np.maximum(m.total, 1))
        emission[UNSEEN:] = m.unseen
        for batch in batches:
            sizes, paths = pc.binary_length(batch.column(5)).to_numpy(), np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8)
            row = np.repeat(np.arange(len(sizes)), sizes)
            line, at = _line(paths % UNSEEN, row, len(sizes))
            steps = m.transition[line[:-1], line[1:]]
            scores = np.bincount(row, steps[at - 1] + emission[paths], len(sizes)) + steps[np.cumsum(sizes) + np.arange(len(sizes))] + batch.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(scores if m.train_tokens else np.zeros(len(sizes)))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    rows = coded.select("doc_id", "n_tokens", "n_known", "base_score", "known", "path")
    scored = rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(model.train_tokens).cast("long"))


def score(docs: DataFrame, words: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``score_paths`` of the rows of ``docs``; words as for ``code``."""
    return score_paths(code(docs, words, model, id_col, text_col, chunk_bytes), model)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = held_out(F.col("doc_id"), 7, 2)
    train = docs.where(~out).select("text")
    encoded = encode(docs, ~out)
    counts = materialize(word_counts(train, encoded), "word_counts")
    model = fit(train, counts)
    words = word_classes(train, counts, model, encoded, F.col("train"))
    coded = materialize(code(docs, words, model, encoded=encoded), "coded_texts")
    return score_paths(coded, refit(model, words, coded.where(~out))).withColumn("held_out", out)
