"""Secret scans: candidate tokens found by a pattern, false positives removed by a random forest.

A candidate is a run of at least ``LEAST`` token characters, with dots between them or not, with a digit, an inner capital or two
capitals in a row; or whatever is assigned to a name that ends in a secret word, from ``LEAST_ASSIGNED`` characters on,
up to a blank or quote. The forest sees its length, shares of character kinds, changes between kinds, how likely its
character transitions are in the corpus' words, distinct characters, how much of it dictionary words cover (the
commonest words of the whole corpus), whether it looks like part of a path, and the words beside it by the log odds of their
hash buckets among labelled findings. It is grown from labelled findings, at most ``FIT_FINDINGS`` of them, and compiled to
expressions, so that the scan over documents is made of DataFrame functions only. Growing runs on the driver over the
bounded findings, the transition table is counted there from the bounded dictionary.

Defined results: a null text has no candidates; repeated rows each get a row; places count code points, ends are
exclusive; without findings of both labels every candidate counts as a secret.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import join_sized, let, materialize, size_of

LEAST, LEAST_ASSIGNED = 16, 8
#: Words of the dictionary; findings that the forest is grown from at most.
DICTIONARY, FIT_FINDINGS = 20_000, 20_000
TREES, DEPTH, LEAF = 25, 8, 4
SEED = 7
CUTOFF = 0.5
#: Fields between blanks that are looked at before and after a candidate; buckets of their words.
BEFORE, AFTER, WORD_BUCKETS = 5, 3, 1024
_T = "A-Za-z0-9_+/-"
_GAP = r"\x20\x09-\x0D"
_VALUE = rf"[^{_GAP}\"'`,;<>|]"
#: Endings of names that secrets are assigned to.
ASSIGNED_NAMES = ("key", "token", "secret", "passwd", "password", "passphrase", "pwd", "credential", "auth")
#: The cheap tests of each alternative come first; a run of token characters and dots has one place to start from, after three dots at most.
PATTERN = (
    rf"(?<=[=:][\"'\x20]{{0,3}})(?={_VALUE}{{{LEAST_ASSIGNED}}})(?<=(?i:{'|'.join(ASSIGNED_NAMES)})[\"']?\x20{{0,2}}[=:]\x20{{0,2}}[\"']?){_VALUE}+"
    rf"|(?<=(?<![.{_T}])\.{{0,3}})(?=[{_T}][.{_T}]{{{LEAST - 1}}})(?=[.{_T}]*?(?:[0-9]|[a-z][A-Z]|[A-Z][A-Z]))[{_T}][.{_T}]*(?<=[{_T}])")
FEATURES = ("length", "digits", "upper", "lower", "marks", "dots", "others", "changes", "transitions", "distinct", "covered", "longest_word", "path", "assigned", "quoted",
            "likest_word", "unlikest_word", "hexadecimal", "numeric")


def _count(value: Column, kind: str) -> Column:
    return F.length(value) - F.length(F.regexp_replace(value, kind, ""))


def dictionary(docs: DataFrame, size: int = DICTIONARY, text_col: str = "text") -> DataFrame:
    """The commonest words (columns word, n) of three letters or more in all texts."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(size)


def beside(part: Column, fields: int) -> Column:
    """The first fields between blanks of what stands beside a candidate, or the last if ``fields`` is negative."""
    return F.substring_index(F.translate(part, "\t\n\x0b\x0c\r", "     "), " ", fields)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, found) for each row; found: array of (left, value, right, start, end), left and right the fields beside it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    values = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    none = F.array().cast("array<struct<left:string,value:string,right:string,start:bigint,end:bigint>>")

    def made(parts: Column, values: Column) -> Column:
        sizes = F.transform(values, lambda v, i: F.length(v) + F.length(F.get(parts, i)))
        # ends[i]: characters up to the end of candidate i
        ends = F.aggregate(sizes, F.array().cast("array<bigint>"), lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0).cast("long")) + x)))
        return let(ends, lambda e: F.transform(values, lambda v, i: F.struct(
            beside(F.get(parts, i), -BEFORE).alias("left"), v.alias("value"), beside(F.get(parts, i + 1), AFTER).alias("right"),
            (F.get(e, i) - F.length(v)).alias("start"), F.get(e, i).alias("end"))))

    found = let(F.split(text, PATTERN), lambda parts: let(values, lambda v: made(parts, v)))
    return docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"),
        F.when(text.rlike(PATTERN), found).otherwise(none).alias("found"))


def _letters(text: Column) -> Column:
    """Place of each character of a lower-cased text in the transition table: a to z, digits, all others."""
    code = lambda c: F.when(c.between("a", "z"), F.ascii(c) - 97).when(c.between("0", "9"), F.lit(26)).otherwise(F.lit(27))
    return F.transform(F.split(F.lower(text), ""), code)


def transition_table(words: list[tuple[str, int]]) -> list[float]:
    """Natural log of how likely each character follows each in the words (word, n); digits and others are smoothed only."""
    n = [[1.0] * 28 for _ in range(28)]
    for word, count in words:
        own = [ord(c) - 97 for c in word]
        for a, b in zip(own, own[1:]):
            n[a][b] += count
    return [math.log(x / sum(row)) for row in n for x in row]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))


def _word_buckets() -> Column:
    """Hash buckets of the words beside a finding."""
    return F.transform(F.array_distinct(F.concat(_words(F.col("left")), _words(F.col("right")))), lambda w: F.pmod(F.xxhash64(w), F.lit(WORD_BUCKETS)).cast("int"))


def word_odds(findings: DataFrame) -> list[float]:
    """Log odds of each bucket of words beside secrets against beside others; 0 for words that stand beside neither."""
    counts = findings.select("label", F.explode(_word_buckets()).alias("b")).groupBy("b").agg(F.sum("label").alias("s"), F.count("*").alias("n")).collect()  # at most WORD_BUCKETS rows
    out, secret, other = [0.0] * WORD_BUCKETS, sum(r["s"] for r in counts), sum(r["n"] - r["s"] for r in counts)
    for r in counts:
        out[r["b"]] = math.log((r["s"] + 1) / (secret + WORD_BUCKETS)) - math.log((r["n"] - r["s"] + 1) / (other + WORD_BUCKETS))
    return out


@dataclass
class Corpus:
    """What features need of the corpus: its dictionary (words of three letters or more) and their transitions."""

    words: DataFrame
    transitions: list[float]


def corpus(words: DataFrame) -> Corpus:
    """words: word, n; at most DICTIONARY rows."""
    return Corpus(words.select("word"), transition_table([(r["word"], r["n"]) for r in words.collect()]))


def featured(findings: DataFrame, known_of: Corpus, odds: Column) -> DataFrame:
    """``findings`` (fid, left, value, right, and more) with the array ``x`` of the FEATURES. odds: array of ``word_odds``."""
    runs = findings.select("fid", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    # a run is covered by itself, or by two words that it is made of
    cuts = F.transform(F.sequence(F.lit(3), F.greatest(F.lit(3), F.least(F.length("word") - 3, F.lit(20)))), lambda k: F.struct(F.substring(F.col("word"), F.lit(1), k).alias("a"), F.substring(F.col("word"), k + 1, F.length("word")).alias("b")))
    pieces = runs.select("fid", "word", F.explode(F.concat(F.array(F.struct(F.col("word").alias("a"), F.lit(None).cast("string").alias("b"))), F.when(F.length("word") >= 6, cuts).otherwise(F.array().cast("array<struct<a:string,b:string>>")))).alias("p"))
    known = known_of.words.select(F.col("word").alias("known"))
    size = size_of(known)
    hits = join_sized(pieces, known.withColumnRenamed("known", "k1"), size, F.col("p.a") == F.col("k1"), "left")
    hits = join_sized(hits, known.withColumnRenamed("known", "k2"), size, F.col("p.b") == F.col("k2"), "left")
    ok = F.col("k1").isNotNull() & (F.col("p.b").isNull() | F.col("k2").isNotNull())
    cover = hits.groupBy("fid", "word").agg(F.max(ok).alias("ok")).groupBy("fid").agg(
        F.sum(F.when(F.col("ok"), F.length("word")).otherwise(0)).alias("c"), F.max(F.when(F.col("ok"), F.length("word")).otherwise(0)).alias("l"))
    v, n = F.col("value"), F.length("value").cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]+", "9"), "[A-Z]+", "A"), "[a-z]+", "a")
    likely = let(F.lit(known_of.transitions), lambda t: let(_letters(v), lambda c: F.aggregate(
        F.transform(F.slice(c, F.lit(2), F.size(c)), lambda b, i: F.get(t, F.get(c, i) * 28 + b)), F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(c) - 1, F.lit(1))))
    near = let(odds, lambda o: F.transform(_word_buckets(), lambda b: F.get(o, b)))
    x = [
        n, _count(v, "[0-9]") / n, _count(v, "[A-Z]") / n, _count(v, "[a-z]") / n, _count(v, "[_+/-]") / n, _count(v, r"\.") / n, _count(v, "[^A-Za-z0-9_+/.-]") / n, F.length(kinds) / n,
        likely, F.size(F.array_distinct(F.split(v, ""))) / n, F.coalesce(F.col("c"), F.lit(0)) / n, F.coalesce(F.col("l"), F.lit(0)) / n,
        (v.contains("/") | F.col("left").rlike(r"[/\\.]$") | F.col("right").rlike(r"^[.\\]\w")).cast("double"),
        F.col("left").rlike(r"[=:]\s*[\"']?$").cast("double"), F.col("left").rlike("[\"']$").cast("double"),
        F.array_max("near"), F.array_min("near"), v.rlike("^[0-9a-f]+$").cast("double"), v.rlike("^[0-9]+$").cast("double"),
    ]
    return findings.join(cover, "fid", "left").withColumn("near", near).withColumn("x", F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in x])).drop("c", "l", "near")


@dataclass
class Node:
    """A split (feature, cut, the nodes below and above) or a leaf (share of secrets)."""

    share: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _grow(rows: list[tuple[list[float], int]], depth: int, rng: random.Random) -> Node:
    ones = sum(y for _, y in rows)
    node = Node(ones / len(rows))
    if depth == 0 or len(rows) < 2 * LEAF or ones in (0, len(rows)):
        return node
    best = (2 * ones * (len(rows) - ones) / len(rows) - 1e-9, -1, 0.0)  # the sides' Gini impurities, weighted
    for f in rng.sample(range(len(FEATURES)), 5):
        ordered = sorted((x[f], y) for x, y in rows)
        left = 0
        for i in range(1, len(ordered)):
            left += ordered[i - 1][1]
            if ordered[i][0] > ordered[i - 1][0] and LEAF <= i <= len(ordered) - LEAF:
                m = len(ordered) - i
                gini = 2 * left * (i - left) / i + 2 * (ones - left) * (m - ones + left) / m
                if gini < best[0]:
                    best = (gini, f, (ordered[i][0] + ordered[i - 1][0]) / 2)
    if best[1] >= 0:
        _, node.feature, node.cut = best
        node.low = _grow([r for r in rows if r[0][node.feature] <= node.cut], depth - 1, rng)
        node.high = _grow([r for r in rows if r[0][node.feature] > node.cut], depth - 1, rng)
    return node


def grow(rows: list[tuple[list[float], int]], trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[Node]:
    """A forest from (features, label) rows, each tree from a bootstrap sample and five features tried at each split."""
    if len({y for _, y in rows}) < 2:
        return []
    rng = random.Random(seed)
    rows = sorted(rows)
    return [_grow(rng.choices(rows, k=len(rows)), depth, rng) for _ in range(trees)]


def forest_score(forest: list[Node], x: Column) -> Column:
    """The mean share of secrets in the leaves, as an expression: nodes as arrays, walked from each root."""
    if not forest:
        return F.lit(1.0)
    feature, cut, low, high, share, roots = [], [], [], [], [], []

    def add(node: Node) -> int:
        at = len(feature)
        for held, v in zip((feature, cut, low, high, share), (node.feature, float(node.cut), at, at, float(node.share))):
            held.append(v)
        if node.low is not None:
            low[at], high[at] = add(node.low), add(node.high)
        return at

    roots = [add(t) for t in forest]

    def step(n: Column, tables: Column, x: Column) -> Column:
        f = F.get(tables["feature"], n)
        return F.when(f < 0, n).when(F.get(x, f) <= F.get(tables["cut"], n), F.get(tables["low"], n)).otherwise(F.get(tables["high"], n))

    def depth(node: Node) -> int:
        return 0 if node.low is None else 1 + max(depth(node.low), depth(node.high))

    steps = F.lit(list(range(max(1, *map(depth, forest)))))
    tables = F.struct(*[F.lit(v).alias(k) for k, v in (("feature", feature), ("cut", cut), ("low", low), ("high", high), ("share", share))])
    return let(x, lambda x: let(tables, lambda t: F.aggregate(
        F.transform(F.lit(roots), lambda r: F.get(t["share"], F.aggregate(steps, r, lambda n, _: step(n, t, x)))), F.lit(0.0), lambda a, v: a + v) / len(forest)))


_HEX, _UPPER = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: Names that values are assigned to, in code and in prose.
SECRET_NAMES = ("api_key", "apiKey", "token", "secret", "password", "passwd", "access_key", "auth_token", "client_secret", "credential", "pwd", "db_password", "signing key", "bearer")
OTHER_NAMES = ("sha1", "sha256", "md5", "checksum", "commit", "uuid", "digest", "revision", "order", "invoice", "card", "file", "path", "id", "etag", "version", "url", "branch", "serial")


class Made:
    """Random parts of made findings."""

    def __init__(self, rng: random.Random, words: list[str]):
        self.rng, self.words = rng, words

    def some(self, of: str, *sizes: int) -> str:
        return "".join(self.rng.choices(of, k=self.rng.choice(sizes)))

    def word(self) -> str:
        return self.rng.choice(self.words)

    def text(self) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(2, 8))) + " "

    def lead(self, names: tuple[str, ...]) -> str:
        return f"{self.text()}{self.rng.choice(names)}{self.rng.choice((' = ', '=', ': ', ' '))}{self.rng.choice(('', chr(34), chr(39)))}"

    def any_lead(self, names: tuple[str, ...]) -> str:
        return self.rng.choice((self.text, lambda: self.lead(names)))()


#: Made findings by family: (what stands before, value). Those of SECRETS are secrets, those of OTHERS are not.
SECRETS: dict[str, Callable[[Made], tuple[str, str]]] = {
    "cloud access id": lambda m: (m.any_lead(SECRET_NAMES), "AKIA" + m.some(_UPPER, 16)),
    "prefixed token": lambda m: (m.any_lead(SECRET_NAMES), m.rng.choice(("ghp_", "sk_live_", "xoxb-", "glpat-")) + m.some(_ALNUM, *range(24, 37))),
    "assigned hex": lambda m: (m.lead(SECRET_NAMES), m.some(_HEX, 18, 24, 32, 40, 64)),
    "assigned base64": lambda m: (m.lead(SECRET_NAMES), m.some(_ALNUM + "+/", 20, 32, 40, 44)),
    "loose base64": lambda m: (m.text(), m.some(_ALNUM + "+/", 40, 64, 88)),
    "signed token": lambda m: (m.any_lead(SECRET_NAMES), ".".join(("eyJ" + m.some(_ALNUM, 17, 33), m.some(_ALNUM + "_-", 40, 80), m.some(_ALNUM + "_-", 43)))),
    "short password": lambda m: (m.text() + m.rng.choice(("password", "passwd", "pwd", "secret")) + m.rng.choice((" = ", "=", ": ")) + m.rng.choice(("", '"', "'")), m.some(_ALNUM + "!#$%&*.-_", *range(8, 16))),
    "word password": lambda m: (m.text() + m.rng.choice(("password", "passwd", "pwd")) + m.rng.choice((" = ", "=", ": ")), m.word() + m.rng.choice("!#$%._-") + m.word() + m.some("0123456789", 2, 3, 4)),
}
OTHERS: dict[str, Callable[[Made], tuple[str, str]]] = {
    "long number": lambda m: (m.any_lead(OTHER_NAMES), m.some("0123456789", *range(16, 20))),
    "digest": lambda m: (m.lead(OTHER_NAMES), m.some(_HEX, 32, 40, 64)),
    "uuid": lambda m: (m.any_lead(OTHER_NAMES), "-".join(m.some(_HEX, k) for k in (8, 4, 4, 4, 12))),
    "path": lambda m: (m.text() + m.rng.choice(("", "/", "path: ")), "/".join(m.word() + m.word() for _ in range(m.rng.randint(3, 5))) + "/v" + m.some("0123456789", 2)),
    "camel case": lambda m: (m.text(), "".join((m.word() + m.word()).capitalize() for _ in range(3))),
    "hyphens": lambda m: (m.text(), "-".join(m.word() for _ in range(4)) + m.some("0123456789", 1, 2)),
    "capitals": lambda m: (m.text().upper(), "".join(m.word() for _ in range(4)).upper()),
    "host": lambda m: (m.text() + m.rng.choice(("", "@", "https://")), ".".join((m.word() + m.some("0123456789", 1, 2), m.word() + m.word(), "example", m.rng.choice(("com", "org"))))),
    "file name": lambda m: (m.any_lead(OTHER_NAMES), f"{m.word()}_{m.word()}_{m.some('0123456789', 4, 8)}.{m.rng.choice(('tar.gz', 'json', 'txt', 'png'))}"),
    "module": lambda m: (m.text() + m.rng.choice(("import ", "from ", "")), ".".join(m.word() for _ in range(3)) + "." + m.word().capitalize() + m.word().capitalize()),
    "placeholder": lambda m: (m.lead(SECRET_NAMES), m.rng.choice(("your_{}_here", "<{}>", "xxxxxxxx-{}", "change-this-{}", "example_{}", "${{{}}}", "os.environ.{}")).format(m.word())),
    "named word": lambda m: (m.text() + m.rng.choice(("secret: ", "key: ", "the token: ", "password: ")), m.word() + m.rng.choice(("", m.word()))),
}


def made_findings(words: list[str], n: int = 4000, seed: int = SEED, secrets: dict | None = None, others: dict | None = None) -> list[tuple[int, str, str, str, int, str]]:
    """(fid, left, value, right, label, family), half of them secrets; words: what prose, paths and names are made of."""
    rng, rows = random.Random(seed), []
    m, families = Made(rng, words), (others or OTHERS, secrets or SECRETS)
    for i in range(n):
        family = rng.choice(sorted(families[i % 2]))
        left, value = families[i % 2][family](m)
        right = rng.choice((" ", '" ', ", ", ". ", "\n")) + m.text()
        if len(value) >= LEAST_ASSIGNED:
            rows.append((i, " ".join(left.split(" ")[-BEFORE:]), value, " ".join(right.replace("\n", " ").split(" ")[:AFTER]), i % 2, family))
    return rows


def labelled_findings(spark: SparkSession, n: int = 4000, seed: int = SEED, words: list[str] | None = None, secrets: dict | None = None, others: dict | None = None) -> DataFrame:
    """Findings of known making as a DataFrame; without ``words`` their prose is made of syllables."""
    rng = random.Random(seed + 1)
    syllables = ("an", "ver", "lich", "the", "ing", "tion", "ment", "eau", "os", "que", "st", "re", "on", "ada", "ung", "con", "pre", "ist")
    words = words or ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(2000)]
    return spark.createDataFrame(made_findings(words, n, seed, secrets, others), "fid long, left string, value string, right string, label int, family string")


@dataclass
class Scanner:
    forest: list[Node]
    odds: list[float]


def fit(findings: DataFrame, known_of: Corpus) -> Scanner:
    """The forest grown from labelled findings. While it grows, the odds of the words beside a finding come from the other half of the findings."""
    rows = findings.where("label is not null").orderBy(F.xxhash64("left", "value")).limit(FIT_FINDINGS)
    half = F.pmod(F.xxhash64("value", "left"), F.lit(2))
    parts = [word_odds(rows.where(half != k)) for k in (0, 1)]
    odds = F.when(half == 0, F.lit(parts[0])).otherwise(F.lit(parts[1]))
    grown = grow([(list(r["x"]), int(r["label"])) for r in featured(rows, known_of, odds).select("x", "label").collect()])
    return Scanner(grown, word_odds(rows))


def scored(findings: DataFrame, known_of: Corpus, scanner: Scanner) -> DataFrame:
    """``findings`` with their ``score``."""
    return featured(findings, known_of, F.lit(scanner.odds)).withColumn("score", forest_score(scanner.forest, F.col("x")))


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, n_candidates, n_secrets, spans) for each row; spans: start:end of the secrets, comma-joined.

    findings: fid, left, value, right, label; without them findings are made, in the commonest words of ``docs``.
    """
    words = materialize(dictionary(docs, text_col=text_col), "dictionary")
    known_of = corpus(words)
    if findings is None:
        findings = labelled_findings(docs.sparkSession, words=sorted(r["word"] for r in words.orderBy(F.desc("n"), "word").limit(2000).collect()))
    scanner = fit(findings, known_of)
    rows = materialize(candidates(docs, id_col, text_col), "secret_candidates")
    each = rows.where(F.size("found") > 0).select("rid", F.posexplode("found").alias("i", "f")).select(F.struct("rid", "i").alias("fid"), "rid", "f.*")
    found = scored(each, known_of, scanner).where(F.col("score") >= cutoff).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("s"))
    return rows.join(found, "rid", "left").select(
        "doc_id", F.size("found").cast("long").alias("n_candidates"), F.when(F.col("s").isNull(), 0).otherwise(F.size("s")).cast("long").alias("n_secrets"),
        F.coalesce(F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["start"], x["end"])), ","), F.lit("")).alias("spans"))


def op2(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
