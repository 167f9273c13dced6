"""Toxicity: a counterfactually regularised classifier.

A logistic model over the presence of words and word beginnings in a text, fitted on labelled texts. For each labelled
text that mentions an identity term, the term is swapped for each other one of its group, and the squared change of the log
odds, taken as the mean over the swaps, is penalised with the loss, so it moves no score which group a text mentions. The fit takes at most
``FIT_ROWS`` labelled rows, those of the smallest id hashes; its features are chosen by how far their shares among toxic and
other texts are apart. Scoring takes whole texts.

Defined results: a null text is an empty one and gets the score of no features; without labelled rows, or with labels
of one kind only, the score is the smoothed share of toxic rows; several labels of an id count as toxic if one is;
labels without id or mark are passed over; a null id counts as the empty string when rows are held out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .classlm import held_out
from .common import arrow_rows

#: Labelled rows that the model is fitted on at most.
FIT_ROWS = 40_000
FEATURES = 4096
#: Texts that a feature must be in.
LEAST_TEXTS = 4
BEGINNINGS = (4, 5, 6)
#: Weights of the penalty on score changes and of the squared weights.
SWAP_PENALTY, RIDGE = 2.0, 2e-4
THRESHOLD = 0.7
#: Identity terms, by group and language; a term is swapped for others of its line.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "ladies", "gentlemen"),
    ("woman", "man", "girl", "boy", "lady", "gentleman"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("immigrants", "refugees", "natives", "foreigners", "citizens"),
    ("deaf", "blind", "disabled", "autistic", "elderly", "young"),
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme", "fille", "garçon"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("mujer", "hombre", "niña", "niño"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
)
_SWAPS = {t.encode(): [x.encode() for x in line if x != t] for line in IDENTITY_TERMS for t in line}
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> set[bytes]:
    return set((text or b"").translate(_TABLE).split())


def features(word: bytes) -> list[bytes]:
    """The word and its beginnings; a beginning ends in a star."""
    return [word, *(word[:n] + b"*" for n in BEGINNINGS if len(word) > n)]


def swapped(own: set[bytes]) -> list[set[bytes]]:
    """The words with every identity term swapped, for each other term of the longest group in turn; none without a term."""
    terms = sorted(own & _SWAPS.keys())
    turns = max((len(_SWAPS[t]) for t in terms), default=0)
    return [(own - set(terms)) | {_SWAPS[t][k % len(_SWAPS[t])] for t in terms} for k in range(turns)]


class Model:
    def __init__(self, names: list[bytes], weights: np.ndarray, bias: float):
        self.place, self.weights, self.bias = {f: i for i, f in enumerate(names)}, weights, bias
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def ids(self, own: set[bytes]) -> set[int]:
        out: set[int] = set()
        if len(self.memo) > 1_000_000:
            self.memo = {}
        for w in own:
            t = self.memo.get(w)
            if t is None:
                t = self.memo[w] = tuple(self.place[f] for f in features(w) if f in self.place)
            if t:
                out.update(t)
        return out

    def score(self, text: bytes | None) -> float:
        z = self.bias + float(self.weights[sorted(self.ids(words(text)))].sum())
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _rows(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each element; null lists have none."""
    sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    return np.repeat(np.arange(len(lists)), sizes), np.asarray(lists.flatten(), np.int64)


def _logistic(ids: pa.ListArray, gone: pa.ListArray, come: pa.ListArray, turns: np.ndarray, y: np.ndarray, n: int, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the whole sample: log loss in which both labels weigh alike, ridge and the swaps'
    squared changes of the log odds.

    ids: the features of each text; gone, come: those that its swaps take away and bring, once for each swap; turns: its swaps.
    """
    row, col = _rows(ids)
    left, right, each = _rows(gone), _rows(come), 1 / np.maximum(turns, 1)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, bias = np.zeros(n), 0.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        z = bias + np.bincount(row, w[col], len(y))
        err = (1 / (1 + np.exp(-z)) - y) * weight / len(y)
        grad = np.bincount(col, err[row], n) + RIDGE * w
        if len(left[0]) or len(right[0]):
            change = (np.bincount(left[0], w[left[1]], len(y)) - np.bincount(right[0], w[right[1]], len(y))) * each * each * 2 * SWAP_PENALTY / len(y)
            grad += np.bincount(left[1], change[left[0]], n) - np.bincount(right[1], change[right[0]], n)
        g = np.append(grad, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, n_features: int = FEATURES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """docs: labelled or not; labels: doc_id, toxic. Rows to hold out are to be left out of ``labels`` before."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    marks = marks.orderBy(F.xxhash64("doc_id")).limit(fit_rows).select(F.col("doc_id").alias("_id"), F.col("y").cast("int").alias("y"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(marks), "_id").select("y", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = (Counter(), Counter())
            for y, text in zip(batch.column(0).to_pylist(), arrow_rows(batch, "text")):
                of[y == 1].update({f for w in words(text) for f in features(w)})
            names = list(of[0].keys() | of[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), *(pa.array([c[f] for f in names], pa.int64()) for c in of)], ["f", "plain", "toxic"])

    sizes = {r["y"]: r["n"] for r in texts.groupBy((F.col("y") == 1).alias("y")).agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(False, 0), sizes.get(True, 0)
    if not n0 or not n1:
        p = (n1 + 1) / (n0 + n1 + 2)
        return Model([], np.zeros(0), float(np.log(p / (1 - p))))
    a, b = (F.col("toxic") + 0.5) / (n1 + 1), (F.col("plain") + 0.5) / (n0 + 1)
    both = (F.col("toxic") + F.col("plain") + 1) / (n0 + n1 + 2)
    apart = F.abs(a - b) / F.sqrt(both * (1 - both))
    counted = texts.mapInArrow(count, "f binary, plain long, toxic long").groupBy("f").agg(F.sum("plain").alias("plain"), F.sum("toxic").alias("toxic"))
    chosen = counted.where(F.col("plain") + F.col("toxic") >= LEAST_TEXTS).orderBy(F.desc(apart), "f").limit(n_features).select("f").collect()
    names = list(dict.fromkeys([*(bytes(r["f"]) for r in chosen), *_SWAPS]))
    model = Model(names, np.zeros(len(names)), 0.0)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            own = [words(t) for t in arrow_rows(batch, "text")]
            ids = [model.ids(w) for w in own]
            other = [[model.ids(x) for x in swapped(w)] for w in own]
            out = (ids, [[f for x in xs for f in sorted(a - x)] for a, xs in zip(ids, other)], [[f for x in xs for f in sorted(x - a)] for a, xs in zip(ids, other)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([list(x) for x in s], pa.list_(pa.int32())) for s in (map(sorted, ids), *out[1:])), pa.array([len(x) for x in other], pa.int32())],
                ["y", "ids", "gone", "come", "turns"])

    found = texts.mapInArrow(lists, "y int, ids array<int>, gone array<int>, come array<int>, turns int").toArrow()  # bounded by fit_rows and n_features
    y = (np.asarray(found["y"]) == 1).astype(float)
    weights, bias = _logistic(*(found[c].combine_chunks() for c in ("ids", "gone", "come")), np.asarray(found["turns"]), y, len(names))
    return Model(names, weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            found = np.array([model.score(t) for t in arrow_rows(batch, "text")], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def op5(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels.where(~held_out(F.col("doc_id"), 3, 1)))
    return score(docs, model).withColumn("held_out", held_out(F.col("doc_id"), 3, 1))
