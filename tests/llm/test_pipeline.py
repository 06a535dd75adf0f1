from collections import Counter

import corpus_pipeline as P
from lectern.llm import decontaminate, mixing, quality, shards, simhash


def test_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = docs.collect()
    labels = spark.read.parquet(f"{sf}/labels.parquet")

    # quality: each row judged as the scorer says
    of = quality.fit(docs, labels).scorer()
    kept = P.STAGES[0][1](spark, docs, sf)
    assert kept.columns == docs.columns
    want = [r for r in whole if of(r["text"]) >= 0.5]
    assert sorted(kept.collect()) == sorted(want) and len(want) < len(whole)

    # SimHash: by all pairs
    fps = [(r, simhash.fingerprint(r["text"])) for r in want]
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    groups = {}
    for (r, _), x in zip(fps, label, strict=True):
        groups[x] = min(groups.get(x, r), r, key=lambda r: r["doc_id"])
    kept = P.STAGES[1][1](spark, kept, sf)
    assert kept.columns == docs.columns and sorted(kept.collect()) == sorted(groups.values())
    want = list(groups.values())

    # decontamination
    items = [(r["item_id"], decontaminate.words(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = [r for r in want if not any(decontaminate.judge(decontaminate.words(r["text"]), w) for _, w in items if w)]
    kept = P.STAGES[2][1](spark, kept, sf)
    assert kept.columns == docs.columns and sorted(kept.collect()) == sorted(want)

    # mixing: as often as the mix says
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(kept).collect()}
    kept = P.STAGES[3][1](spark, kept, sf)
    want = [r for r in want for _ in range(copies[r["doc_id"]])]
    assert kept.columns == docs.columns and sorted(kept.collect()) == sorted(want)

    # sharding
    got = P.STAGES[4][1](spark, kept, sf).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in want)
    assert all(0 <= r["shard"] < shards.SHARDS for r in got)

    # the whole run
    assert sorted(P.run(spark, sf).collect()) == sorted(got)


def test_stages_on_no_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_stages_on_awkward_rows(spark, sf):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns that clash with the operators' own."""
    real = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    odd = [(None, None, None, None, None), (None, None, None, None, None), (9_001, "", "en", None, 0), (9_001, "", "en", None, 0), (9_002, " \n", None, "web", 2), (9_003, "word " * 100_000, "en", "web", 500_000), (9_004, None, "en", "web", None), (9_005, real[0][1], "en", "web", 1)]
    names = ("score", "_score", "row", "key", "h", "size", "copies", "shard", "slot", "fp", "items", "n")
    rows = [(*r, *range(len(names))) for r in [*real, *odd, *real[:5]]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    docs = spark.createDataFrame(rows, schema)
    given = set(rows)
    for name, stage in P.STAGES:
        kept = stage(spark, docs, sf)
        out = [tuple(r) for r in kept.collect()]
        if name != "sharding":
            assert kept.columns == docs.columns and set(out) <= given
        else:
            assert len(out) == docs.count()
        if name == "simhash near-dedup":
            assert len(out) == len(set(out)) and sum(not (r[1] or "").split() for r in out) == 1
    mixed = P.STAGES[3][1](spark, docs, sf)
    assert max(Counter(tuple(r) for r in mixed.collect()).values()) <= 4  # twice of two equal rows
