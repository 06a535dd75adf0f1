import random
import time

from lectern.llm import decontaminate as D

DOC, ITEM = "doc_id long, text string", "item_id long, text string"


def plain_tiling(item, doc, least):
    """Greedy string tiling as first described: find all longest unmarked matches, mark them, go on with shorter ones."""
    in_item, in_doc, tiles = set(), set(), []
    while True:
        best = None
        for t in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while t + n < len(item) and d + n < len(doc) and item[t + n] == doc[d + n] and t + n not in in_item and d + n not in in_doc:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = n, t, d
        if best is None:
            return tiles
        n, t, d = best
        tiles.append(best)
        in_item.update(range(t, t + n))
        in_doc.update(range(d, d + n))


def plain_find(items, text, least=D.SHINGLE, coverage=D.COVERAGE):
    out = []
    doc = D.words(text)
    for item_id, item_text in items:
        item = D.words(item_text)
        if item:
            k = min(least, len(item))
            tiles = plain_tiling(item, doc, k)
            covered = sum(n for n, _, _ in tiles)
            if covered >= coverage * len(item):
                out.append((item_id, covered / len(item), len(tiles), max(n for n, _, _ in tiles)))
    return sorted(out)


def found_in(items, text, least=D.SHINGLE, coverage=D.COVERAGE):
    return sorted((i, *x) for i, t in items if D.words(t) and (x := D.judge(D.words(text), D.words(t), least, coverage)))


def test_against_plain_tiling():
    rng = random.Random(4)
    vocabulary = ["a", "b", "c", "dd", "é"]
    for _ in range(150):
        items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 14)))) for i in range(3)]
        pieces = [x.split() for _, x in items]
        doc = rng.choices(vocabulary, k=rng.randint(0, 8))
        for p in rng.sample(pieces, 2):
            cut = rng.randint(0, len(p))
            doc += p[cut:] + rng.choices(vocabulary, k=rng.randint(0, 2)) + p[:cut]
        text = " ".join(doc)
        for least in (2, 3, 5):
            assert found_in(items, text, least, 0.5) == plain_find(items, text, least, 0.5)


def test_reordered_passages_are_found():
    item = [f"w{i}" for i in range(30)]
    whole = [(1, " ".join(item))]
    assert found_in(whole, " ".join(["x", *item[15:], "y", *item[:15], "z"])) == [(1, 1.0, 2, 15)]
    assert found_in(whole, " ".join(item[:20])) == []


def test_equal_words_take_little_time():
    began = time.perf_counter()
    assert D.judge(["same"] * 20_000, ["same"] * 200) == (1.0, 1, 200)
    assert D.judge(["same", "other"] * 10_000, ["same"] * 200) is None
    assert time.perf_counter() - began < 5


def test_chosen_seeds_are_in_every_document_that_holds_the_item():
    rng = random.Random(6)
    for _ in range(400):
        item = [f"w{rng.randint(0, 30)}" for _ in range(rng.randint(5, 40))]
        cuts = sorted(rng.sample(range(len(item) + 1), 2))
        doc = item[cuts[1] :] + ["x"] * rng.randint(0, 2) + item[cuts[0] : cuts[1]] + ["y"] + item[: cuts[0]]
        doc = [w if rng.random() > 0.04 else "z" for w in doc]
        seen = [rng.randint(1, 9) for _ in range(len(item) - 4)]
        own, theirs = D.karp_rabin(D.numbers(item), 5), set(D.karp_rabin(D.numbers(doc), 5).tolist())
        if D.judge(doc, item):
            assert any(int(own[i]) in theirs for i in D.stretch(seen, len(item), 5, D.COVERAGE))


def test_awkward_rows(spark):
    long_ = "filler word " * 60_000 + "the exact hidden passage of this very test item"
    docs = [(1, None), (2, ""), (3, long_), (3, long_), (None, "short one"), (5, "Short, ONE!"), (6, "one short")]
    items = [(10, "The exact hidden passage of this very test item."), (11, "short one"), (12, None), (13, "..."), (10, "The exact hidden passage of this very test item.")]
    got = sorted(((r["doc_id"], [tuple(x) for x in r["items"]]) for r in D.contaminations(spark.createDataFrame([(*d, 1) for d in docs], DOC + ", items int"), spark.createDataFrame(items, ITEM)).collect()), key=repr)
    whole = [(10, 1.0, 1, 9), (10, 1.0, 1, 9)]
    assert got == sorted([(3, whole), (3, whole), (None, [(11, 1.0, 1, 2)]), (5, [(11, 1.0, 1, 2)])], key=repr)
    kept = D.remove(spark.createDataFrame([(*d, 1) for d in docs], DOC + ", row int"), spark.createDataFrame(items, ITEM))
    assert kept.columns == ["doc_id", "text", "row"] and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 6]


def test_one_row_a_document_against_plain_tiling(spark):
    rng = random.Random(8)
    common = " ".join(f"c{i}" for i in range(8))  # stands in all items and in most documents
    items = [(i, f"{common} " + " ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 16)))) for i in range(15)] + [(50, "few words"), (51, common)]
    docs = []
    for d in range(50):
        own = []
        for _, t in rng.sample(items, rng.randint(0, 3)):
            w = t.split()
            cut = rng.randint(0, len(w))
            own += w[cut:] + [f"o{rng.randint(0, 99)}"] * rng.randint(0, 3) + w[:cut]
        docs.append((d, " ".join([common, *own])))
    want = {d: x for d, t in docs if (x := plain_find(items, t))}
    got = D.contaminations(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()
    assert {r["doc_id"]: [tuple(x) for x in r["items"]] for r in got} == want and len(got) == len(want)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a")], DOC), spark.createDataFrame([], ITEM)
    assert D.contaminations(docs, items).count() == 0 and D.remove(docs, items).count() == 1
    assert D.contaminations(spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a")], ITEM)).count() == 0


def test_query_against_plain_tiling(spark, sf):
    from lectern.llm.queries import op4_decontamination

    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    seeds = {tuple(w[k : k + 5]) for _, t in items for w in [D.words(t)] for k in range(max(1, len(w) - 4))}
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = D.words(r["text"])
        if any(tuple(w[k : k + 5]) in seeds for k in range(len(w) - 4)):  # without a shared seed there is no tile
            own = [i for i in items if any(tuple(D.words(i[1])[k : k + 5]) in {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for k in range(len(D.words(i[1])) - 4))]
            if found := plain_find(own, r["text"]):
                want[r["doc_id"]] = found
    assert {r["doc_id"]: [tuple(x) for x in r["items"]] for r in op4_decontamination(spark, sf).collect()} == want and want
