from collections import defaultdict

from palimpsest.llm import linededup

BLANK = " \t\r\x0b\x0c"


def brute(rows, least):
    sites, first = defaultdict(set), {}
    for i, text, _, site, _ in rows:
        for x in (text or "").split("\n"):
            if k := x.strip(BLANK):
                sites[k] |= {site} - {None}
                if i is not None:
                    first[k] = min(first.get(k, i), i)
    out = []
    for i, text, *_ in rows:
        if text is None:
            out.append((i, None, 0))
            continue
        kept, seen = [], set()
        for x in text.split("\n"):
            k = x.strip(BLANK)
            if k and len(sites[k]) >= least and (first.get(k) != i or k in seen):
                continue
            seen.add(k)
            kept.append(x)
        out.append((i, "\n".join(kept), len(text.split("\n")) - len(kept)))
    return sorted(out, key=str)


def found(out):
    return sorted(((r["row"]["doc_id"], r["text"], r["n_removed"]) for r in out.select("row", "text", "n_removed").collect()), key=str)


def test_against_brute_force(docs, wide, rows):
    for least in (2, 4, 6):
        want = brute(rows, least)
        assert least > 4 or any(r[2] for r in want)
        assert found(linededup.line_dedup(docs, least)) == want
    assert found(linededup.line_dedup(wide, 4)) == brute(rows, 4)


def test_many_sites_settled_by_sketch_alone(spark):
    rows = [(i, f"often\nown {i}\n" + ("rare" if i < 3 else "x"), "en", f"s{i}", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert found(linededup.line_dedup(docs, 5)) == brute(rows, 5)


def test_empty(empty):
    assert linededup.line_dedup(empty).count() == 0
