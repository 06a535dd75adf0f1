import hashlib
import math
import zlib
from collections import Counter

from lectern.llm import shards as S

DOC = "doc_id long, text string"


def plain_place(key, node):
    while node.children:
        def draw(c):
            u = (int(hashlib.md5(f"{key}/{c.name}".encode()).hexdigest()[:13], 16) + 1) / 2**52
            return math.log(u) / c.weight

        node = max(node.children, key=draw)
    return node.shard


def test_awkward_rows(spark):
    rows = [(1, "aé"), (1, "aé"), (1, "other"), (2, None), (3, ""), (None, "n"), (4, "x" * 300_000)] + [(9, "same")] * 500
    frame = spark.createDataFrame([(*r, 5, 6) for r in rows], DOC + ", shard int, size int")
    got = S.plan(frame).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    for r in got:
        key = "null" if r["doc_id"] is None else r["doc_id"]
        assert r["shard"] == plain_place(key, S.tree(40)) and r["grown_shard"] == plain_place(key, S.tree(41)) and r["law"] == "key"
    for shard in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    assert S.plan(spark.createDataFrame([], DOC)).count() == 0


def test_growth_moves_keys_only_into_the_new_shard(spark):
    got = S.assign(S.assign(spark.range(20_000).withColumnRenamed("id", "doc_id"), shards=40), shards=41, name="grown").collect()
    moved = [r for r in got if r["shard"] != r["grown"]]
    assert {r["grown"] for r in moved} == {40} and 0.7 < len(moved) / (20_000 / 41) < 1.3
    counts = Counter(r["shard"] for r in got)
    assert len(counts) == 40 and max(counts.values()) < 1.3 * 500 and min(counts.values()) > 0.7 * 500


def test_a_weight_moves_keys_only_along_its_path():
    before, after = S.tree(40), S.tree(40, weights={7: 3.0})
    changed = [(plain_place(k, before), plain_place(k, after)) for k in range(5000)]
    region = lambda s: s // 10
    for a, b in changed:
        if a != b:  # what moves ends in the region whose weight grew
            assert region(b) == region(7)
            if region(a) == region(7) and a // 5 != b // 5:
                assert b // 5 == 7 // 5
    assert sum(b == 7 for _, b in changed) > sum(a == 7 for a, _ in changed)


def test_weights_are_proportions():
    counts = Counter(plain_place(k, S.tree(40, weights={3: 4.0})) for k in range(20_000))
    assert 3 < counts[3] / (20_000 / 43) < 5


def test_query_slots(spark, sf):
    from lectern.llm.queries import op5_sharding

    got = op5_sharding(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
