"""Personal data by a skip-chain conditional random field over base rules.

Base rules find e-mail and IP addresses, card and telephone numbers in every text; their spans always stay. The field
labels the tokens that hold a digit or an at sign, with a kind or none; all other tokens are none by construction.
Tokens next to each other are chained; tokens of equal or similar form, however far apart in a document, are joined by
skip edges, each to the one before, so a form of k tokens has k - 1 edges. Both kinds of edge share label potentials. The
weights are fitted by pseudo-likelihood on at most ``FIT_DOCS`` documents and a disguised copy of each: base spans are
rewritten there, in place or as a second mention, to forms that the rules miss, and numbers of other kinds are put in.
No result of a rule is a feature. In the search a token that a base span touches is observed, so its label reaches the
mentions of like form by loopy message passing, over all documents of a batch at once. A run of tokens that the field
gives a kind with enough certainty, which no base span touches and whose characters can be of that kind, is added.

Defined results: a null text is an empty one and has no spans; repeated rows each get a row; ends are exclusive and
count code points; without documents to fit on nothing is added.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
#: Documents with a digit or an at sign, those of the smallest id hashes, that the field is fitted on at most; a
#: document of more than FIT_TOKENS candidate tokens is passed over in the fit.
FIT_DOCS, FIT_TOKENS = 4000, 400
HASHED = 1 << 14
CERTAIN = 0.9
PASSES = 8
LABELS = 1 + len(KINDS)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9]+")
#: Forms that an added span can have: a name and a host, four numbers.
_NAMED = re.compile(r"[A-Za-z0-9%+_-]+(?:(?:\.|\[\.\])[A-Za-z0-9%+_-]+)*(?:@|\[@\])[A-Za-z][A-Za-z0-9-]*(?:(?:\.|\[\.\])[A-Za-z0-9-]+)*")
_FOUR = re.compile(r"[0-9]+(?:(?:\.|\[\.\]|-)[0-9]+){3}")
_TOKEN = re.compile(r"[0-9@]")
_GAP = frozenset(" \t\n\r\x0b\x0c")
_EDGES = ".,;:!?\"'`<>[]{}|*#&=/\\"


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, at sign and dotted domain; found from the at signs, in one pass."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        after = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = after = m.end()
        at = text.find("@", after)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, sorted."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    for m in _CARD.finditer(text):
        own = _digits(m[0])
        if 12 <= len(own) <= 19 and luhn(own):
            out.append((m.start(), 2, m.end()))
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(y := x.lstrip("0")) <= 3 and int(y or 0) <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def candidates(text: str) -> list[tuple[int, int]]:
    """Places of the tokens that hold a digit or an at sign, without punctuation at their ends."""
    out, at = [], 0
    while m := _TOKEN.search(text, at):
        a, b = m.start(), m.end()
        while a > at and text[a - 1] not in _GAP:
            a -= 1
        while b < len(text) and text[b] not in _GAP:
            b += 1
        at = b
        while b > a and text[b - 1] in _EDGES:
            b -= 1
        while a < b and text[a] in _EDGES:
            a += 1
        if a < b:
            out.append((a, b))
    return out


def _shape(token: str) -> str:
    return re.sub("[A-Z]+", "A", re.sub("[a-z]+", "a", re.sub("[0-9]", "9", token)))


def _word_before(text: str, a: int) -> str:
    while a and text[a - 1] in _GAP:
        a -= 1
    b = a
    while a and text[a - 1] not in _GAP:
        a -= 1
    return text[a:b].lower().strip(_EDGES)


def token_features(text: str, places: list[tuple[int, int]]) -> list[list[int]]:
    """Hashed features of each candidate token; always as many."""
    shapes = ["", *(_shape(text[a:b]) for a, b in places), ""]
    out = []
    for i, (a, b) in enumerate(places):
        token, own = text[a:b], shapes[i + 1]
        near = lambda j: shapes[j] if 0 < j <= len(places) and abs(places[j - 1][0] - b if j > i + 1 else a - places[j - 1][1]) <= 2 else ""
        runs = [len(x) for x in _NUMBER.findall(token)]
        names = (
            "bias", f"shape {own}", f"marks {re.sub('[A-Za-z0-9]+', '9', token)}", f"before {near(i)} {own}", f"after {near(i + 2)} {own}",
            f"n {min(sum(runs), 20)} {token[:1] == '+'}", f"runs {len(runs)} {max(runs, default=0)}",
            f"at {'@' in token} {bool(re.search('[a-z]', token))}", f"word {_word_before(text, a)}")
        out.append([zlib.crc32(f.encode()) % HASHED for f in names])
    return out


def edges(text: str, places: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(i, j, type): 0 for neighbours in the text, 1 for tokens of equal or similar form."""
    out, last = [], {}
    for i, (a, b) in enumerate(places):
        if i and a - places[i - 1][1] <= 2:
            out.append((i - 1, i, 0))
        token = text[a:b].lower()
        digits = _digits(token)
        forms = {token}
        if len(digits) >= 4:
            forms |= {"digits " + digits, "tail " + digits[-4:]}
        if "@" in token:
            forms |= {"host " + token.rpartition("@")[2], "name " + token.rpartition("@")[0]}
        linked = set()
        for form in sorted(forms):
            j = last.get(form)
            if j is not None and j not in linked and j != i - 1:
                out.append((j, i, 1))
                linked.add(j)
            last[form] = i
    return out


def labels_of(places: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """The label of each token by the spans that touch it; spans of one kind don't overlap. The first kind wins."""
    kinds = [sorted((a, b) for a, k, b in spans if k == kind) for kind in range(len(KINDS))]
    ends = [[b for _, b in own] for own in kinds]
    out = []
    for a, b in places:
        at = [bisect.bisect_right(e, a) for e in ends]
        out.append(next((k + 1 for k, i in enumerate(at) if i < len(kinds[k]) and kinds[k][i][0] < b), 0))
    return out


def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("0123456789", k=n))


#: How base spans are disguised, by kind, so that the rules miss them; with a tail, what stands after the form itself.
DISGUISES = {
    0: {"no domain": lambda s, r: s.partition("@")[0] + "@" + s.partition("@")[2].partition(".")[0],
        "bracketed dots": lambda s, r: s.replace(".", "[.]"),
        "bracketed at": lambda s, r: s.replace("@", "[@]")},
    1: {"bracketed dots": lambda s, r: s.replace(".", "[.]"),
        "hyphens": lambda s, r: s.replace(".", "-"),
        "one bracket": lambda s, r: "[.]".join(s.rsplit(".", 1))},
    2: {"dots": lambda s, r: ".".join(re.findall(".{1,4}", _digits(s))),
        "slashes": lambda s, r: "/".join(re.findall(".{1,4}", _digits(s))),
        "year after": lambda s, r: (s, f" {r.randint(1950, 2040)}")},
    3: {"no plus": lambda s, r: s[1:],
        "no country": lambda s, r: s.partition(" ")[2] if len(_digits(s.partition(" ")[2])) >= 7 else s[1:],
        "dots": lambda s, r: ".".join(re.findall("[0-9]+", s)),
        "hyphens": lambda s, r: "-".join(re.findall("[0-9]+", s)),
        "address after": lambda s, r: (s, " " + ".".join(str(r.randrange(256)) for _ in range(4)))},
}
#: Numbers that are none of the kinds.
OTHERS = {
    "date": lambda r: f"{r.randint(1900, 2040)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
    "slashed date": lambda r: f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1900, 2040)}",
    "time": lambda r: f"{r.randrange(24):02}:{r.randrange(60):02}:{r.randrange(60):02}",
    "amount": lambda r: f"{r.randint(1, 999)},{_number(r, 3)},{_number(r, 3)}.{_number(r, 2)}",
    "version": lambda r: ".".join(str(r.randrange(30)) for _ in range(3)),
    "long version": lambda r: ".".join(str(r.randrange(256, 1000)) for _ in range(4)),
    "years": lambda r: f"{r.randint(1900, 1980)}-{r.randint(1981, 2040)}",
    "isbn": lambda r: f"978-{r.randrange(10)}-{_number(r, 2)}-{_number(r, 6)}-{r.randrange(10)}",
    "order": lambda r: _number(r, r.randint(4, 18)),
    "part number": lambda r: f"{_number(r, r.randint(3, 5))}-{_number(r, r.randint(3, 6))}",
    "price list": lambda r: f"{r.randint(1, 99)} {r.randint(1, 999)} {r.randint(1, 99)}",
    "at a rate": lambda r: f"{r.randint(2, 99)} @ {r.randint(1, 99)}.{_number(r, 2)}",
    "unit": lambda r: f"{r.randint(1, 999)}{r.choice(('kg', 'km', 'ml', '%', 'px'))}",
}


def disguised(text: str, spans: list[tuple[int, int, int]], seed: int, hidden: dict | None = None, others: dict | None = None) -> tuple[str, list[tuple[int, int, int]]]:
    """A copy of a text with its spans' new places: of the spans a third stay, a third are disguised, a third stay and
    come a second time, disguised, further on; as many other numbers as spans are put in too."""
    hidden, others, rng = hidden or DISGUISES, others or OTHERS, random.Random(seed)
    cuts, free, done = [], [], 0  # start, end, parts (text, kind or -1) that come there
    for a, k, b in spans:
        if a < done:  # overlaps the one before
            continue
        done, how, form = b, rng.randrange(3), hidden[k][rng.choice(sorted(hidden[k]))](text[a:b], rng)
        own, tail = form if isinstance(form, tuple) else (form, "")
        parts = [(own, k), (" " * bool(tail), -1), (tail.strip(), 1 if "." in tail else -1)]
        cuts.append((a, b, parts if how == 1 else [(text[a:b], k)]))
        if how == 2:
            free.append((b, parts))
        free.append((0, [(others[rng.choice(sorted(others))](rng), -1)]))
    gaps = [m.start() for m in re.finditer(r"(?<=[a-zà-ÿ]) (?=[A-Za-zà-ÿ])", text)]
    for least, parts in free:
        room = bisect.bisect_left(gaps, least)
        if room < len(gaps):
            at = gaps[rng.randrange(room, len(gaps))]
            cuts.append((at, at, [(" ", -1), *parts]))
    out, marks, at, size = [], [], 0, 0
    for a, b, parts in sorted(cuts):
        for x, k in [(text[at:a], -1), *parts]:
            if k >= 0 and x:
                marks.append((size, k, size + len(x)))
            out.append(x)
            size += len(x)
        at = b
    return "".join(out) + text[at:], marks


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_field(feats: np.ndarray, links: np.ndarray, y: np.ndarray, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Node weights (HASHED, labels) and edge potentials (2, labels, labels) by pseudo-likelihood."""
    node, edge = np.zeros((HASHED, LABELS)), np.zeros((2, LABELS, LABELS))
    m = [np.zeros_like(node), np.zeros_like(edge)]
    v = [np.zeros_like(node), np.zeros_like(edge)]
    want = np.eye(LABELS)[y]
    i, j, t = links.T if len(links) else np.zeros((3, 0), np.int64)
    for step in range(1, steps + 1):
        z = node[feats].sum(1)
        np.add.at(z, i, edge[t, :, y[j]])
        np.add.at(z, j, edge[t, y[i], :])
        err = (_softmax(z) - want) / len(y)
        g_node, g_edge = 3e-4 * node, 3e-4 * edge
        np.add.at(g_node, feats.ravel(), np.repeat(err, feats.shape[1], axis=0))
        for k in (0, 1):
            np.add.at(g_edge[k].T, y[j[t == k]], err[i[t == k]])
            np.add.at(g_edge[k], y[i[t == k]], err[j[t == k]])
        g_edge = (g_edge + g_edge.transpose(0, 2, 1)) / 2
        for k, (w, g) in enumerate(((node, g_node), (edge, g_edge))):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            w -= 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-9)
    return node, edge


def marginals(feats: np.ndarray, links: np.ndarray, node: np.ndarray, edge: np.ndarray, passes: int = PASSES, observed: np.ndarray | None = None) -> np.ndarray:
    """Label marginals by loopy message passing. observed: the label of each token that is known, else 0."""
    z = node[feats].sum(1)
    if observed is not None:
        known = np.flatnonzero(observed)
        z[known] -= 50.0
        z[known, observed[known]] = z[known].max(1) + 100.0
    if not len(links):
        return _softmax(z)
    # each edge carries a message either way
    src, dst = np.r_[links[:, 0], links[:, 1]], np.r_[links[:, 1], links[:, 0]]
    pot = np.concatenate([edge[links[:, 2]], edge[links[:, 2]].transpose(0, 2, 1)])
    back = np.r_[np.arange(len(links)) + len(links), np.arange(len(links))]
    msg = np.zeros((len(src), LABELS))
    for _ in range(passes):
        belief = z.copy()
        np.add.at(belief, dst, msg)
        out = belief[src] - msg[back]
        new = pot + out[:, :, None]
        top = new.max(1)
        new = top + np.log(np.exp(new - top[:, None, :]).sum(1))
        msg = 0.5 * msg + 0.5 * (new - new.max(1, keepdims=True))
    np.add.at(z, dst, msg)
    return _softmax(z)


def possible(kind: int, form: str) -> bool:
    """Whether the characters can be of the kind, written in some way."""
    digits = _digits(form)
    if kind == 0:
        return bool(_NAMED.fullmatch(form))
    if kind == 1:
        return bool(_FOUR.fullmatch(form)) and all(len(x) <= 3 and int(x) <= 255 for x in _NUMBER.findall(form))
    if kind == 2:
        return bool(re.fullmatch(r"[0-9]+(?:[ ./_-][0-9]+)*", form)) and 12 <= len(digits) <= 19 and luhn(digits)
    return bool(re.fullmatch(r"\+?[0-9(][0-9() ./-]+[0-9]", form)) and 7 <= len(digits) <= 15


def added(text: str, places: list[tuple[int, int]], probs: np.ndarray, observed: list[int]) -> list[tuple[int, int, int]]:
    """Spans that the field adds: the longest run of tokens of one label from each token on that can be of the kind."""
    best, out, i = probs.argmax(1).tolist(), [], 0
    while i < len(places):
        k, end = best[i], 0
        if k and not observed[i]:
            a, digits, j = places[i][0], 0, i
            while j < len(places) and best[j] == k and not observed[j] and probs[j, k] >= CERTAIN and (j == i or places[j][0] - places[j - 1][1] <= 2):
                digits += len(_digits(text[places[j][0]:places[j][1]]))
                if j > i and (k < 3 or digits > 19):  # only numbers have blanks, and no longer ones are possible
                    break
                j += 1
                if possible(k - 1, text[a:places[j - 1][1]]):
                    end = j
        if end:
            out.append((places[i][0], k - 1, places[end - 1][1]))
        i = end or i + 1
    return out


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, id_col: str = "doc_id", text_col: str = "text", hidden: dict | None = None, others: dict | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """The field's weights, or None if no document has a candidate token. hidden, others: instead of DISGUISES and OTHERS."""
    chosen = docs.where(F.col(text_col).rlike("[0-9@]")).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    key = F.xxhash64("_id", F.xxhash64("text"))
    bound = chosen.select(key.alias("k")).orderBy("k").limit(fit_docs).agg(F.max("k")).first()[0]
    if bound is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for text in batch.column(0).to_pylist():
                spans = base_spans(text)
                for text, spans in [(text, spans), *([disguised(text, spans, zlib.crc32(text.encode()), hidden, others)] if spans else [])]:
                    places = candidates(text)
                    if 0 < len(places) <= FIT_TOKENS:
                        for x, v in zip(out, (token_features(text, places), edges(text, places), labels_of(places, spans))):
                            x.append(np.array(v, np.int32).ravel().tolist())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int32())) for x in out], ["feats", "links", "y"])

    rows = chosen.where(key <= bound).select("text").mapInArrow(run, "feats array<int>, links array<int>, y array<int>").limit(2 * fit_docs).collect()
    rows = sorted(([r["feats"], r["links"], r["y"]] for r in rows))
    if not rows:
        return None
    feats, links, y, n = [], [], [], 0
    for f, e, own in rows:
        feats.append(np.array(f).reshape(len(own), -1))
        links.append(np.array(e, np.int64).reshape(-1, 3) + [n, n, 0])
        y += own
        n += len(own)
    return fit_field(np.concatenate(feats), np.concatenate(links), np.array(y))


def find(texts: list[str | None], field: tuple[np.ndarray, np.ndarray] | None) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    out, held, feats, links, seen = [], [], [], [], []
    for text in texts:
        base = base_spans(text) if text and _TOKEN.search(text) else []
        out.append((base, base))
        if field is not None and text and _TOKEN.search(text):
            places = candidates(text)
            if places:
                n = len(seen)
                held.append((len(out) - 1, text, places, n))
                feats += token_features(text, places)
                links += [(i + n, j + n, t) for i, j, t in edges(text, places)]
                seen += labels_of(places, base)
    if held:
        probs = marginals(np.array(feats), np.array(links, np.int64).reshape(-1, 3), *field, observed=np.array(seen))
        for k, text, places, at in held:
            base, to = out[k][0], at + len(places)
            out[k] = (base, sorted([*base, *added(text, places, probs[at:to], seen[at:to])]))
    return out


def pii(docs: DataFrame, field: tuple[np.ndarray, np.ndarray] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row; counts are of the base spans."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                found = find(part.column(1).to_pylist(), sent.value)
                counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), *counts, pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in found]),
                    pa.array([listed(s) for _, s in found])], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pii(docs, fit(docs))
