import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from lectern.llm import collocations as C

DOCS = "doc_id long, text string, lang string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least=10, top=2000):
    out = []
    for lang in {"und" if r[2] is None else r[2] for r in rows}:
        f = [Counter() for _ in range(4)]
        for _, text, own in rows:
            if ("und" if own is None else own) == lang:
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
                    ws = re.findall(r"[^\x20\x09]+", piece)
                    for k in (1, 2, 3):
                        f[k].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
        n, found = sum(f[1].values()), []
        for k in (2, 3):
            for g, a in f[k].items():
                if a < least or k == 2 and any(g in (t[:2], t[1:]) and 100 * b >= 50 * a for t, b in f[3].items() if b >= least):
                    continue
                s, c = min((10**6 * a * a // (f[i][g[:i]] * f[k - i][g[i:]]), i) for i in range(1, k))
                found.append((-s, -a, " ".join(g).encode(), f[c][g[:c]], f[k - c][g[c:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def rows_of(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "the", "THE", "Ünïc", "very" * 12]
    text = lambda: "".join(rng.choices(words, weights=range(1, 18))[0] + rng.choice([" ", " ", " ", "\t ", ". ", ", ", "\n", "! ? "]) for _ in range(rng.randrange(40)))
    return [(i, text() if i % 9 else rng.choice([None, "", " ", "the the the the the"]), rng.choice(["en", "en", "de", None, ""])) for i in range(n)]


@pytest.mark.parametrize("size", [C.TABLE, 6, 0])
def test_against_plain_counts(spark, size):
    """Also where words don't fit the table: they travel as text and count as rarest."""
    rows = rows_of(1) + [(1, "new york city is new york city", "en")] * 15
    assert sorted(map(tuple, C.collocations(spark.createDataFrame(rows, DOCS).repartition(3), size=size).collect())) == brute(rows)


def test_limits_ties_and_no_rows(spark):
    rows = [(i, "a b c d, x y\nx y", "l") for i in range(10)] + rows_of(2, 40)
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], DOCS + ", n long, word string")
    assert sorted(map(tuple, C.collocations(frame, top=3).collect())) == brute(rows, top=3)
    assert C.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert C.collocations(spark.createDataFrame([(1, None, None), (2, "one two", "en")], DOCS)).count() == 0


def test_a_pivot_beyond_what_is_held(monkeypatch):
    monkeypatch.setattr(C, "HELD", 3)
    known = C.Table.of(["l"] * 4, [b"p", b"q", b"r", b"s"], True)
    cell = lambda *five: b"".join(i.to_bytes(4, "little") for i in five)
    rows = [(0, cell(0, 0, 1, 2, i % 3), 1) for i in range(7)] + [(1, cell(0, 3, 2, 3, 0), 9), (1, cell(0, 0, 2, 3, 0), 1), (2, cell(0, 0, 3, 4, 0), 5)]
    for size in (1, 2, 5, 10):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + size]], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.int64()))], ["pivot", "fragment", "n"]) for i in range(0, len(rows), size)]
        total = Counter()
        for out in C._Miner(known, 5).run(iter(batches)):
            for r in out.to_pylist():
                total[r["x"], r["y"], r["z"]] += r["a"]
        assert {k: v for k, v in total.items() if v >= 5} == {("p", "q", None): 7, ("r", "q", None): 9, ("q", "r", None): 10, ("r", "q", "r"): 9, ("r", "s", None): 5}


def test_table_without_equal_hashes(monkeypatch):
    real = C.xxhash.xxh64_intdigest
    monkeypatch.setattr(C.xxhash, "xxh64_intdigest", lambda raw, seed=0: 7 if not seed else real(raw, seed))
    known = C.Table.of(["a", "b"], [b"w", b"w"], True)
    assert known.seed == 1 and known.ranks(["b", "a", "c"], [b"w", b"w", b"w"]).tolist() == [C._FIRST + 1, C._FIRST, C._GAP]
