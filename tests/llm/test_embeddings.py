import random

import numpy as np

from lectern.llm import embeddings as E

VEC = "vec_id long, embedding array<float>"


def plain_links(rows, cosine=E.COSINE):
    """(vec_id, n_links, component, kept) from all pairs, in double precision."""
    unit = []
    for v, x in rows:
        fine = v is not None and x is not None and len(x) and all(c is not None and np.isfinite(c) for c in x) and any(x)
        a = np.array(x, "f4").astype("f8") if fine else None
        unit.append(a / np.linalg.norm(a / np.abs(a).max()) / np.abs(a).max() if fine else None)
    n = len(rows)
    linked = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(linked[i]), low, True if rows[i][0] is None else rows[i][0] == low))
    return sorted(out, key=repr)


def found(spark, rows, schema=VEC, **kw):
    return sorted((tuple(r) for r in E.near_duplicates(spark.createDataFrame(rows, schema), **kw).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def cluster(rng, n, dim, spread):
    base = np.array([rng.gauss(0, 1) for _ in range(dim)])
    return [(base + spread * np.array([rng.gauss(0, 1) for _ in range(dim)])).astype("f4").tolist() for _ in range(n)]


def test_against_all_pairs(spark):
    rng = random.Random(7)
    vectors = [v for k in range(25) for v in cluster(rng, rng.randint(1, 9), 16, 0.25)] + cluster(rng, 60, 16, 0.1)
    vectors += [vectors[3]] * 4 + [[2 * c for c in vectors[3]]]
    rng.shuffle(vectors)
    rows = list(enumerate(vectors))
    want = plain_links(rows)
    assert found(spark, rows) == want
    assert found(spark, rows, block=16) == want  # many packs, and leaves of several parts


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [2.0, 0.1]), (None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1e-30, 0.0]), (12, [1e30, 1e29]), (13, [-1.0, 0.0])]
    extra = [(*r, 1, 2) for r in rows]
    assert found(spark, extra, VEC + ", n_links int, rep int") == plain_links(rows)
    assert found(spark, []) == [] and found(spark, [(1, None)]) == [(1, 0, 1, True)]


def test_threshold_is_exact(spark):
    angle = np.arccos(0.9)
    rows = [(1, [1.0, 0.0])] + [(2 + i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate((angle - 1e-4, angle + 1e-4))]
    assert found(spark, rows)[0][1] == plain_links(rows)[0][1] == 1


def test_traversal_never_loses_a_pair(spark):
    """Clusters of clusters, a tree of several steps: leaves of all links survive, and far less than all pairs of leaves."""
    rng = np.random.default_rng(8)
    points = np.concatenate([(c := rng.normal(size=(1, 8))) + np.concatenate([c * 0 + rng.normal(size=(1, 8)) * 0.1 + rng.normal(size=(25, 8)) * 0.02 for _ in range(4)]) for _ in range(12)])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, 1, x.tolist(), 0) for i, x in enumerate(points)], E.VECTOR)
    placed, tree, steps = E.grow(vectors, 0.05, 20)
    leaf = {r["rep"]: r["node"] for r in placed.collect()}
    nodes = {r["node"]: r for r in tree.collect()}
    assert steps >= 2 and len(leaf) == len(points) and sum(r["n"] for r in nodes.values() if r["leaf"]) == len(points)
    assert all(r["n"] <= 20 for r in nodes.values() if r["leaf"]) and all(nodes[x]["leaf"] for x in leaf.values())
    pairs = {(r["p"], r["q"]) for r in E.surviving(tree, steps, 0.05).collect()}
    near = E.distances(points, points) <= 0.05
    linked = {(min(a, b), max(a, b)) for a, b in ((leaf[i], leaf[j]) for i, j in zip(*np.nonzero(near), strict=True))}
    assert linked <= pairs and len(pairs) < 0.2 * len({*leaf.values()}) ** 2 / 2


def test_tight_leaves_are_counted_not_compared(spark, monkeypatch):
    """Dense clusters larger than a block, some of them within reach of each other, rows that repeat, and strangers."""
    rng = random.Random(12)
    base = cluster(rng, 1, 16, 0)[0]
    dense = [[c + k * 0.02 * (i == 0) + rng.gauss(0, 0.002) for i, c in enumerate(base)] for k in range(3) for _ in range(60)]
    dense += cluster(rng, 80, 16, 0.003)
    vectors = dense + [dense[5]] * 3 + [v for _ in range(20) for v in cluster(rng, 3, 16, 0.3)]
    rng.shuffle(vectors)
    rows = list(enumerate(vectors))
    compared = []
    compare = E._counted
    monkeypatch.setattr(E, "_counted", lambda placed, tree, whole: compared.append(whole.count()) or compare(placed, tree, whole))
    assert found(spark, rows, block=24) == plain_links(rows)
    assert compared[0] > 0


def test_rounding_bounds_single_precision():
    rng = np.random.default_rng(3)
    for dim in (2, 64, 1024, 8192):
        a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.normal(size=(2, 200, dim)))
        assert np.abs((a.astype("f4") @ b.astype("f4").T).astype("f8") - a @ b.T).max() <= E.rounding(dim)


def test_query_against_all_pairs(spark, sf):
    from lectern.llm.queries import op10_embeddings

    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in op10_embeddings(spark, sf).collect()), key=repr) == plain_links(rows)


def test_one_tight_cluster_at_the_default_block(spark):
    """More vectors than a block, none of which the tree can tell apart: counted, not compared."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 1e-5).tolist()) for i in range(9000)]
    assert len({tuple(np.array(x, "f4").tolist()) for _, x in rows}) > E.BLOCK
    assert E.near_duplicates(spark.createDataFrame(rows, VEC)).select("n_links", "component_id").distinct().collect() == [(8999, 0)]
    placed, tree, steps = E.grow(spark.createDataFrame([(i, 1, (np.array(x) / np.linalg.norm(x)).tolist(), 0) for i, x in rows], E.VECTOR), 0.44, E.BLOCK)
    assert steps == 0 and [r["tight"] for r in tree.collect()] == [True]


def test_a_cluster_that_cannot_be_split_or_counted(spark):
    """Alike vectors at a threshold so close that they needn't all link."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=8)
    rows = [(i, (base + rng.normal(size=8) * 2e-4).astype("f4").tolist()) for i in range(90)]
    cosine = 1 - 1e-7
    assert found(spark, rows, cosine=cosine, block=20) == plain_links(rows, cosine)


def test_many_lengths_in_one_plan(spark):
    rng = random.Random(7)
    rows = [(i, [rng.choice([1.0, 1.1, -1.0]) for _ in range(i % 40 + 1)]) for i in range(200)]
    assert found(spark, rows) == plain_links(rows)
