"""Quality rules: base rules and a hashed n-gram log-likelihood ratio between trusted and raw text.

Every document gets the sum over its hashed 1- and 2-grams of ``log p_target(bucket) - log p_raw(bucket)``,
divided by its number of n-grams. The target multinomial counts the n-grams of trusted documents, the raw
multinomial those of all documents. Ratios are held as integers (units of 2**-20), so sums, and with them the
verdicts, do not depend on the order of rows. All steps are DataFrame expressions.

Defined results: a null text is an empty one; a text of no words has score 0; if there is no trusted text, or no
text at all, every ratio is 0 and the method keeps all; repeated rows each get a row; a label row without id or
quality is passed over, and one trusted label of an id suffices. Repeated windows are told by a 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import join_sized, let, size_of, words_of

BUCKETS = 10_000
#: Kept from this mean log-likelihood ratio (nats for each n-gram) on.
THRESHOLD = -0.07
UNIT = 1 << 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(h: Column, n: int) -> Column:
    """Hashes of all ``n`` consecutive hashes of ``h``."""
    return let(h, lambda a: F.slice(
        F.transform(a, lambda x, i: F.xxhash64(x, *[F.get(a, i + k) for k in range(1, n)])),
        F.lit(1), F.greatest(F.size(a) - (n - 1), F.lit(0))))


def _covered(win: Column, n: int) -> Column:
    """Positions inside any of the n-windows whose hash occurs twice or more."""
    def count(places: Column) -> Column:
        return F.aggregate(
            F.transform(places, lambda p, k: F.when(k == 0, F.lit(n)).otherwise(F.least(F.lit(n), p - F.get(places, k - 1)))),
            F.lit(0).cast("long"), lambda s, x: s + x)

    def places(pairs: Column) -> Column:
        same = F.filter(pairs, lambda p, k: (p["h"] == F.get(pairs, k - 1)["h"]) | (p["h"] == F.get(pairs, k + 1)["h"]))
        return F.sort_array(F.transform(same, lambda p: p["i"]))

    pairs = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(pairs, places), count)


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, hashes, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) for each row; row: all its columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.struct("*").alias("row"), text.alias("text"), _hashes(words_of(F.col(text_col))).alias("hashes"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_long = F.col("n_words")
    return (
        rows.select(
            "doc_id", "row", "hashes", F.size("hashes").cast("long").alias("n_words"),
            F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
            (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
            let(_windows(F.col("hashes"), WINDOW),
                lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(_covered(w, WINDOW))).alias("n_repeat_words"),
        )
        .withColumn("base_failed", (n_long < 10) | (100 * F.col("n_repeat_words") > 20 * n_long))
    )


def _buckets(hashes: Column, buckets: int) -> Column:
    """Buckets of the 1-grams, then of the 2-grams, of a text's word hashes."""
    return let(hashes, lambda h: F.concat(
        F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int")),
        F.transform(_windows(h, 2), lambda x: F.pmod(x, F.lit(buckets)).cast("int"))))


def ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: the array of every bucket's log ratio in units of 2**-20.

    docs: all documents; trusted: ids (column doc_id) of the target documents. Each side is smoothed by adding one.
    """
    ids = trusted.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct()
    rows = docs.select(F.col(id_col).alias("_id"), _hashes(words_of(F.col(text_col))).alias("h"))
    rows = join_sized(rows, ids.withColumn("_t", F.lit(1)), size_of(ids), ["_id"], "left")
    counts = (
        rows.select(F.coalesce("_t", F.lit(0)).alias("t"), F.explode(_buckets(F.col("h"), buckets)).alias("b"))
        .groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    )
    every = docs.sparkSession.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left")
    lists = every.agg(
        F.sort_array(F.collect_list(F.struct("b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")))).alias("a"),
        F.coalesce(F.sum("raw"), F.lit(0)).alias("n"), F.coalesce(F.sum("target"), F.lit(0)).alias("m"))
    one = F.transform("a", lambda x: F.round(UNIT * (
        F.log((x["target"] + 1) / (F.col("m") + buckets)) - F.log((x["raw"] + 1) / (F.col("n") + buckets)))).cast("long"))
    return lists.select(F.when(F.col("m") > 0, one).otherwise(F.array_repeat(F.lit(0).cast("long"), buckets)).alias("ratios"))


def quality(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base rule columns, row, llr_units (long), n_grams, score and kept for each row of ``docs``."""
    table = ratios(docs, trusted, buckets, id_col, text_col)
    units = let(F.col("ratios"), lambda w: F.aggregate(
        _buckets(F.col("hashes"), buckets), F.lit(0).cast("long"), lambda s, b: s + F.get(w, b)))
    n_grams = F.col("n_words") + F.greatest(F.col("n_words") - 1, F.lit(0).cast("long"))
    rows = base_rules(docs, id_col, text_col).withColumn("ratios", table.scalar()).withColumn("llr_units", units).withColumn("n_grams", n_grams)
    score = F.when(F.col("n_grams") > 0, F.col("llr_units") / (F.col("n_grams") * F.lit(float(UNIT)))).otherwise(0.0)
    return (
        rows.drop("hashes", "ratios").withColumn("score", score)
        .withColumn("kept", ~F.col("base_failed") & (F.col("llr_units") >= F.lit(threshold * UNIT) * F.col("n_grams")))
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that a label marks as of good quality."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id")


def op1(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality(docs, trusted_ids(labels)).drop("row")
