import random
import re

import numpy as np
import xxhash

from lectern.llm import simhash as S

DOC = "doc_id long, text string"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    """Component of each (doc_id, fingerprint) by comparing all pairs."""
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(((d, f, low.get(root(i))) for i, (d, f) in enumerate(rows)), key=repr)


TEXTS = [None, "", " \t\n", "one", "One two", "a b c", "A B c", "a b c d", "É à ß É", "x " * 70_000, "a\x0bb\x0cc\rd", " a b c", "long " * 3 + "tail"]


def test_fingerprint_is_as_defined():
    assert [S.fingerprint(t) for t in TEXTS] == [plain_fingerprint(t) for t in TEXTS]


def test_fingerprint_is_spark_hash_of_short_texts(spark):
    assert spark.sql("select xxhash64('one two')").first()[0] & (1 << 64) - 1 == S.fingerprint("One  two")


def near_numbers(rng, base, n, flips):
    out = []
    for _ in range(n):
        x = base
        for b in rng.sample(range(64), rng.randint(0, flips)):
            x ^= 1 << b
        out.append(x)
    return out


def test_links_join_what_all_pairs_join(spark):
    rng = random.Random(2)
    numbers = {0, 1, 7, 15, (1 << 64) - 1, 1 << 63}
    for _ in range(60):
        numbers.update(near_numbers(rng, rng.getrandbits(64), 6, 4))
    numbers.update(near_numbers(rng, rng.getrandbits(64), 400, 2))
    numbers = sorted(numbers)
    frame = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in numbers], "fp long")
    found = S.components(S.near_links(frame)).collect()
    got = {r["node"] & (1 << 64) - 1: r["root"] for r in found}
    want = {f: c for _, f, c in plain_components([(i, x) for i, x in enumerate(numbers)])}
    groups = {}
    for x in numbers:
        groups.setdefault(want[x], set()).add(got.get(x, ("alone", x)))
    assert all(len(g) == 1 for g in groups.values())
    assert len(set().union(*groups.values())) == len(groups)


def classes(fps, links):
    label = {int(x): int(x) for x in fps}
    for a, b in links:
        while label[a] != a:
            a = label[a]
        while label[b] != b:
            b = label[b]
        label[max(a, b)] = min(a, b)
    return [root(label, int(x)) for x in fps]


def root(label, x):
    while label[x] != x:
        x = label[x]
    return x


def all_pairs(fps):
    for i, x in enumerate(fps):
        near = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ x) <= 3)
        yield from ((int(x), int(y)) for y in fps[i + 1 :][near])


def crowded(rng, n, bits):
    """Distinct numbers that agree in all but the given bits, some of them near each other."""
    place = lambda: sum(rng.getrandbits(1) << b for b in bits)
    out = set()
    while len(out) < n:
        x = place()
        out.add(x)
        if rng.random() < 0.2:
            for b in rng.sample(bits, 3):
                x ^= 1 << b
            out.add(x)
    return np.array(sorted(out), "u8")


def test_large_files_lose_no_link():
    rng = random.Random(3)
    for bits in (list(range(24)), list(range(0, 64, 3)), list(range(40, 64)), list(range(13)), [0, 1, 9, 17, 18, 33, 34, 41, 50, 51, 63]):
        fps = crowded(rng, min(1500, 1 << len(bits) - 1), bits)
        want = classes(fps, all_pairs(fps))
        for direct in (8, 100):
            got = [(int(a), int(b)) for start in range(4) for u, v in S.spanning(fps, start, direct=direct) for a, b in zip(u, v, strict=True)]
            assert classes(fps, got) == want


def test_files_that_agree_in_forty_bits_equal_all_pairs(spark):
    """4,997 fingerprints that share five bytes, in files dealt out once or several times, or split in their task."""
    rng = random.Random(4)
    fps = crowded(rng, 4997, list(range(24)))[:4997]
    frame = spark.createDataFrame([(int(x.view(np.int64)),) for x in fps], "fp long").cache()
    want = classes(fps, all_pairs(fps))
    for direct in (S.DIRECT, 300, 30):
        got = [(r["u"] & (1 << 64) - 1, r["v"] & (1 << 64) - 1) for r in S.near_links(frame, direct).collect()]
        assert classes(fps, got) == want


def test_keeping_tells_rows_apart_by_id_and_text(spark):
    rows = [(1, "one two three four five six"), (1, "wholly other words stand in this row"), (None, "One two three four five six"), (None, "nameless text of its own here"), (None, "Nameless text of its own here"), (2, "wholly Other words stand in this row")]
    kept = S.keep_one(spark.createDataFrame(rows, DOC))
    got = sorted(map(tuple, kept.collect()), key=repr)
    assert got[:2] == [rows[0], rows[1]] and len(got) == 3 and got[2][0] is None and got[2][1].lower() == rows[3][1]


def test_near_duplicates_of_awkward_rows(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one"), (3, "one"), (None, "one"), (None, "only nameless words here"), (50, "a b c")]
    got = sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in S.near_duplicates(spark.createDataFrame(rows, DOC)).collect()), key=repr)
    assert got == plain_components([(d, plain_fingerprint(t)) for d, t in rows])
    assert S.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_keep_one_keeps_columns_and_one_of_each_group(spark):
    rows = [(2, "a b c d", 9, "r"), (1, "A b c d", 8, "s"), (1, "A b c d", 8, "s"), (3, "wholly other words stand here", 7, "t"), (None, "", 1, "u"), (4, None, 2, "v"), (5, "", 3, "w")]
    kept = S.keep_one(spark.createDataFrame(rows, DOC + ", fp int, _row string"))
    assert kept.columns == ["doc_id", "text", "fp", "_row"]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[1], rows[3], rows[5]], key=repr)  # blank texts are equal
    assert S.keep_one(spark.createDataFrame([], DOC)).count() == 0


def test_query_against_all_pairs(spark, sf):
    from lectern.llm.queries import op9_simhash

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in op9_simhash(spark, sf).collect())
    assert got == sorted(plain_components([(d, plain_fingerprint(t)) for d, t in docs]))
