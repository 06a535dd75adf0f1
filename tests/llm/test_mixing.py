import hashlib
import random
import re
from collections import Counter

import pytest

from lectern.llm import mixing as M

DOC = "doc_id long, text string, source string"


def plain_mix(rows, rest=""):
    """(doc_id, size, source_size, target, taken) by resharing again and again, and by sorting hashes."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    sums = {}
    for _, t, s in rows:
        sums[s] = sums.get(s, 0) + size(t)
    order = sorted(sums, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sums.values())
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total >= 2 * sums[s]]
        if not over:
            target.update({s: left * weight[s] / total for s in free})
            break
        for s in over:
            target[s] = 2.0 * sums[s]
        left -= sum(target[s] for s in over)
        free -= set(over)
    out = []
    seen = Counter()

    def draw(d, t, s):
        key = f"{'null' if d is None else d}/{hashlib.md5((t or '').encode()).hexdigest()}/{rest}"
        seen[key, s] += 1
        return int(hashlib.md5(f"{key}/{seen[key, s] - 1}".encode()).hexdigest()[:13], 16)

    for s in order:
        own = [(draw(d, t, s), d, size(t)) for d, t, x in rows if x == s]
        times = int(target[s] // sums[s]) if sums[s] else 0
        rest_, taken = target[s] - times * sums[s], set()
        for h in sorted({h for h, _, _ in own}):
            if rest_ <= 0:
                break
            n = sum(k for g, _, k in own if g == h)
            if n <= rest_:
                taken.add(h)
                rest_ -= n
            else:
                if n - rest_ < rest_:
                    taken.add(h)
                break
        out += [(d, k, sums[s], target[s], k * (times + (h in taken))) for h, d, k in own]
    return sorted(out, key=repr)


def mixed(spark, rows):
    frame = spark.createDataFrame(rows, DOC)
    return sorted(((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in M.mix(frame).collect()), key=repr)


def same(got, want):
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_against_plain_resharing(spark):
    for seed in range(4):
        rng = random.Random(seed)
        share = [rng.random() ** 3 for _ in range(9)]
        rows = [(i, " ".join("w" * rng.randint(0, 30)), rng.choices([None, "", "é", "z", "Z", "a", "𝒳", "￿", "b"], share)[0]) for i in range(300)]
        got = mixed(spark, rows)
        same(got, plain_mix(rows))
        assert all(t <= 2 * k for _, k, _, _, t in got)


def test_awkward_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (3, "x y", None), (None, "q r s", "b"), (4, "long " * 100_000, "c"), (5, " \t\x0b", "d")]
    same(mixed(spark, rows), plain_mix(rows))
    assert mixed(spark, []) == []
    same(mixed(spark, [(1, None, "a"), (2, " ", None)]), [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)])


def test_equal_ratios_share_alike(spark):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 50), ("b", 20), ("c", 10), ("d", 50), ("e", 20), ("f", 10)])]
    same(mixed(spark, rows), plain_mix(rows))


def test_targets_are_met_closely(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(1, 40), "abc"[i % 3]) for i in range(900)]
    got = M.mix(spark.createDataFrame(rows, DOC)).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 40 for r in got)


def test_apply_repeats_documents(spark):
    rng = random.Random(10)
    rows = [(i, "w " * rng.randint(0, 9), rng.choice(["a", "b", None])) for i in range(200)]
    frame = spark.createDataFrame(rows, DOC)
    want = sorted((d for d, _, _, c in ((r["doc_id"], r["size"], r["source"], r["copies"]) for r in M.mix(frame).collect()) for _ in range(c)))
    got = M.apply(frame)
    assert got.columns == frame.columns and sorted(r["doc_id"] for r in got.collect()) == want


def test_empty_documents_are_taken_twice_at_most(spark):
    rows = [(1, "w " * 1000, "a"), (2, "x y", "b"), (3, None, "b"), (4, "", "b"), (5, " ", "b")]  # b's target is twice its size
    got = Counter(r["doc_id"] for r in M.apply(spark.createDataFrame(rows, DOC)).collect())
    assert got[2] == 2 and all(got[d] <= 2 for d in (3, 4, 5))


def test_repeated_rows_are_drawn_one_by_one(spark):
    rows = [(None, f"w {i % 2}", "a", i % 3, {"k": i % 2}) for i in range(600)] + [(1, "x " * 500, "b", 0, None)]
    frame = spark.createDataFrame(rows, DOC + ", row int, source_size map<string,int>")
    done = M.mix(frame).where("source = 'a'").collect()
    assert abs(sum(r["taken"] for r in done) - done[0]["target"]) <= 2 and 0 < done[0]["target"] % 1200
    got = M.apply(frame)
    assert got.columns == frame.columns
    kept = Counter((r["text"], r["row"], r["source_size"]["k"]) for r in got.where("source = 'a'").collect())
    assert sum(kept.values()) == sum(r["copies"] for r in done) and set(kept) == {(t, r, m["k"]) for _, t, _, r, m in rows[:600]}
    assert sorted(map(str, got.collect())) == sorted(map(str, M.apply(frame).collect()))
