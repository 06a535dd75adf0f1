import math
import random
import zlib

import numpy as np
import pytest
import zstandard

from lectern.llm import quality as Q

DOC, LABEL = "doc_id long, text string", "doc_id long, quality int, toxic int"
WORDS = "the quick brown fox jumps over a lazy dog while seven wise men watch from their small wooden house near water".split()


def good(rng):
    return " ".join(rng.choices(WORDS, k=rng.randint(20, 200))).capitalize() + "."


def bad(rng):
    return " ".join(w.upper() + rng.choice(["!!", "$$$", "%%%"]) for w in rng.choices(WORDS, k=rng.randint(20, 200)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [(i, (good if i % 4 else bad)(rng), int(i % 4 > 0)) for i in range(600)]


def frames(spark, rows):
    return spark.createDataFrame([(i, t) for i, t, _ in rows], DOC), spark.createDataFrame([(i, q, 0) for i, _, q in rows], LABEL)


def test_held_out_accuracy_and_range(spark, rows):
    docs, labels = frames(spark, rows)
    scored = {r["doc_id"]: r["score"] for r in Q.score(docs, Q.fit(docs, labels)).collect()}
    held = [(scored[i], q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((s >= 0.5) == q for s, q in held) / len(held) > 0.97
    assert all(0 <= s <= 1 for s in scored.values())


def test_held_out_labels_are_never_learned(spark, rows):
    docs, labels = frames(spark, rows)
    flipped = [(i, t, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, t, q in rows]
    assert Q.fit(docs, labels) == Q.fit(*frames(spark, flipped))
    assert Q.fit(docs.repartition(7), labels.repartition(3)) == Q.fit(docs, labels)


def test_awkward_texts_and_columns(spark, rows):
    docs, labels = frames(spark, rows)
    model = Q.fit(docs, labels)
    odd = spark.createDataFrame([(1, None, 0.1, "x"), (1, None, 0.1, "x"), (2, "", 0.2, "y"), (None, "é" * 300_000, 0.3, "z")], DOC + ", score double, row string")
    got = Q.score(odd, model, "score")
    assert got.columns == ["doc_id", "text", "row", "score"]
    values = [r["score"] for r in got.collect()]
    assert len(values) == 4 and values[0] == values[1] == values[2] == model.base and all(0 <= v <= 1 for v in values)
    assert Q.score(spark.createDataFrame([], DOC), model).count() == 0


def test_without_labels_everything_stays(spark, rows):
    docs, labels = frames(spark, rows)
    for some in (labels.where("false"), labels.where("quality = 1"), spark.createDataFrame([(None, 1, 0), (3, None, 0), (4, 7, 0)], LABEL)):
        assert Q.keep_good(docs, some).count() == len(rows)


def test_long_texts_are_learned_beyond_their_beginning(spark):
    """Bad texts that begin like good ones: only what stands after 8 KB tells them."""
    rng = random.Random(6)
    fair = lambda n: " ".join(rng.choices(WORDS, k=n))
    rows = [(i, (fair(2500) if i % 2 else fair(2000) + bad(rng) * 20) + "é" * (i % 3), i % 2) for i in range(120)]
    assert all(len(t[:8192].encode()) == 8192 for _, t, _ in rows)
    docs, labels = frames(spark, rows)
    scored = {r["doc_id"]: r["score"] for r in Q.score(docs, Q.fit(docs, labels)).collect()}
    held = [(scored[i], q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((s >= 0.5) == q for s, q in held) / len(held) > 0.9


def plain_score(text, model):
    """The sizes by zstandard's plainest calls, block by block, and the curve by hand."""
    raw = (text or "").encode()
    if not raw:
        return model.base
    sizes = [sum(len(zstandard.ZstdCompressor(level=Q.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(raw[i : i + Q.BLOCK])) for i in range(0, len(raw), Q.BLOCK)) for d in (model.good, model.bad)]
    a, b = model.weights
    z = a * (sizes[1] - sizes[0]) / (len(raw) + 64) + b
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_scores_against_plain_compression(spark, rows):
    docs, labels = frames(spark, [*rows, (900, "", 1), (901, "é" * 30_000, 1)])
    model = Q.fit(docs, labels)
    texts = {i: t for i, t, _ in rows} | {900: "", 901: "é" * 30_000}
    for r in Q.score(docs, model).collect():
        assert math.isclose(r["score"], plain_score(texts[r["doc_id"]], model), abs_tol=1e-9)


def test_the_curve_is_the_best_one():
    """The penalised likelihood falls whichever way a weight moves."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=400) * 0.1 + 1
    y = (rng.random(400) < 1 / (1 + np.exp(-12 * (x - 1)))).astype(float)

    def likelihood(w):
        z = x * w[0] + w[1]
        scaled = np.r_[w[0] * x.std(), w[1] + w[0] * x.mean()]
        return (y * z - np.log1p(np.exp(z))).sum() - 0.5e-3 * len(x) * (scaled**2).sum()

    best = np.array(Q._logistic(x, y))
    for i in range(2):
        for step in (-0.05, 0.05):
            w = best.copy()
            w[i] += step
            assert likelihood(w) < likelihood(best)


def test_scores_are_calibrated(spark):
    """Texts between good and bad: in each band of scores about as many are good as the scores say."""
    rng = random.Random(8)
    rows = []
    for i in range(3000):
        share = rng.random()
        words = [w if rng.random() < share else w.upper() + "!!" for w in rng.choices(WORDS, k=60)]
        rows.append((i, " ".join(words), int(rng.random() < share)))
    docs, labels = frames(spark, rows)
    scored = {r["doc_id"]: r["score"] for r in Q.score(docs, Q.fit(docs, labels)).collect()}
    held = [(scored[i], q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    for low in (0.0, 0.25, 0.5, 0.75):
        band = [(s, q) for s, q in held if low <= s < low + 0.25 or s == 1 == low + 0.25]
        assert len(band) > 30 and abs(sum(s for s, _ in band) - sum(q for _, q in band)) / len(band) < 0.12


def test_keeping_leaves_the_callers_columns(spark, rows):
    docs, labels = frames(spark, rows)
    own = docs.withColumn("_score", docs["doc_id"] * 2).withColumn("score", docs["doc_id"] * 3).withColumn("row", docs["text"])
    kept = Q.keep_good(own, labels)
    assert kept.columns == ["doc_id", "text", "_score", "score", "row"]
    assert all(r["_score"] == 2 * r["doc_id"] and r["score"] == 3 * r["doc_id"] and r["row"] == r["text"] for r in kept.collect())


def test_a_row_without_an_id_is_scored(spark, rows):
    docs, labels = frames(spark, rows)
    more = docs.union(spark.createDataFrame([(None, rows[0][1])], docs.schema))
    got = {r["doc_id"]: r["score"] for r in Q.score(more, Q.fit(docs, labels)).collect()}
    assert got[None] == got[rows[0][0]]


def test_query_accuracy(spark):
    from lectern.llm.queries import op8_quality

    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op8_quality(spark, sf).collect()
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(p == q for p, q in held) / len(held) > 0.9
    assert sum(p == 1 for p, q in held if q == 1) / sum(q for _, q in held) > 0.95
