import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import divergence, slices

DOCS = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_docs=3, top=200):
    rows = [(t or "", a or "", s or "") for _, t, a, s in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [(Counter(TERM.findall(lower(t))), s) for t, a, s in rows if a == lang]
        seen = Counter(w for c, _ in own for w in c)
        kept = sorted(w for w, n in seen.items() if n >= min_docs)
        count = {s: Counter() for _, s in own}
        for c, s in own:
            count[s].update({w: c[w] for w in kept if c[w]})
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}  # noqa: B023, E731
        p = {s: share(c) for s, c in count.items()}
        all_ = share(sum(count.values(), Counter()))
        for s in count:
            pairs = [(-sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o) for o in count if o != s]
            terms = [(-((p[s][w] - all_[w]) ** 2 // all_[w]), w) for w in kept if count[s][w] and p[s][w] > all_[w]]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


ROWS = [
    *((i, f"the Cat {'sat ' * (i % 4)}on word{i % 3} naïve ÉTÉ x", "en", f"s{i % 3}") for i in range(12)),
    *((i, f"la casa {'de ' * (i % 5)} mar", "es", "s1" if i % 2 else None) for i in range(20, 28)),
    (30, None, "en", "empty"), (31, "", None, None), (32, "...", None, "z"), (33, "one only", "fr", "q"),
    (0, "the Cat on word0 naïve ÉTÉ x", "en", "s0"), (None, "the the the" * 500, "en", "s2"),
]


def test_against_plain_sums(spark):
    got = divergence.audit(spark.createDataFrame(ROWS, DOCS).repartition(3)).collect()
    assert sorted(map(tuple, got)) == brute(ROWS)
    few = divergence.audit(spark.createDataFrame(ROWS, DOCS), min_docs=1, top=2).collect()
    assert sorted(map(tuple, few)) == brute(ROWS, 1, 2)


def test_no_documents_and_clashing_columns(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    wide = spark.createDataFrame([(*r, 1, "x", 2) for r in ROWS], DOCS + ", n long, term string, total long")
    assert sorted(map(tuple, divergence.audit(wide).collect())) == brute(ROWS)


def test_slices_are_exact_under_collisions():
    texts = pa.array(["Ab cd ab", None, "", "cd", "é É a"])
    s = slices.slices(texts, slices.lookup(divergence.SEPARATORS))
    tokens = [s.raw[a:b].decode() for a, b in zip(s.start, s.end, strict=True)]
    assert tokens == ["ab", "cd", "ab", "cd", "é", "É", "a"] and s.text.tolist() == [0, 0, 0, 3, 4, 4, 4]
    for code in (lambda b: 1, len, lambda b: b[0]):
        of, first = slices.grouped(s, code)
        assert [tokens[first[g]] for g in of] == tokens and len(set(of.tolist())) == len(set(tokens))


def test_slices_of_a_sliced_array_and_neighbouring_texts():
    texts = pa.array(["skip", "one", "two", "x y"]).slice(1)
    s = slices.slices(texts, slices.lookup(b" "))
    assert [s.raw[a:b] for a, b in zip(s.start, s.end, strict=True)] == [b"one", b"two", b"x", b"y"]
    assert list(slices.chunks(pa.array(["a" * 9, "b" * 9, None, "c" * 30]), 10)) == [(0, 1), (1, 3), (3, 4)]


@pytest.mark.parametrize("pieces", [1, 1 << 20])
def test_pairs_in_pieces(monkeypatch, spark, pieces):
    monkeypatch.setattr(divergence, "PAIRS", pieces)
    rows = [("l", t, f"s{i}", 10 + i * t, 5 + i) for t in range(1, 4) for i in range(4) if (i + t) % 4]
    want = Counter()
    for _, t, s, p, p0 in rows:
        for _, u, o, q, q0 in rows:
            if t == u and s != o:
                want[s, o] += (p - q) ** 2 // q - (p - q0) ** 2 // q0 - (p0 - q) ** 2 // q + (p0 - q0) ** 2 // q0
    frame = spark.createDataFrame([(a, str(t), s, p, q) for a, t, s, p, q in rows], "lang string, term string, source string, p long, p0 long")
    got = divergence._shared(frame.repartition("lang", "term").sortWithinPartitions("lang", "term")).collect()
    assert {(r["source"], r["item"]): r["value"] for r in got} == dict(want)


def test_shares_stay_exact_for_large_counts(spark):
    from pyspark.sql import functions as F

    n, size, v = 9_000_000_000_000, 15_000_000_000_001, 77
    assert spark.range(1).select(divergence.share(F.lit(n), F.lit(size), F.lit(v))).first()[0] == 1 + 10**9 * (n + 1) // (size + v)
    assert np.iinfo(np.int64).max > (divergence.SCALE + 1) ** 2
