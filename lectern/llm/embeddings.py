"""Embedding near-duplicates: exact cosine pairs by a dual traversal of a cover tree.

Unit vectors with cosine >= t are those within the distance sqrt(2 - 2 t). A cover tree has nested levels with halving
radii. It is built from the root in steps of several levels, all nodes of a step side by side: of each node that holds
more than BLOCK vectors a bounded sample gives the levels below it, up to FANOUT nodes, and every vector of the node goes
to the nearest of them; the largest distance that occurs is a node's covering radius. So the tree grows with the data,
until its leaves are blocks; nodes, centres and pairs are tables.

The tree is traversed against itself, step by step: a pair of nodes whose distance exceeds their radii by more than the
threshold holds no link and is dropped with all below it. A node so tight that all its vectors link needs no further
levels: its links, and those to another such node within reach, are counted, not compared. Leaves side by side are packed
into blocks of about BLOCK vectors, and only pairs of blocks with a surviving pair of leaves are compared: in single
precision first, and in double precision whatever lies within the rounding error of the threshold.

The tree decides what needn't be compared, never what links, so the result is exact whatever the samples. Equal vectors
are one entry with a count. A pair of blocks gives counts and spanning links, not all its pairs, so copies cost rows in
proportion to their number. Vectors without structure prune little: then the work grows with the square of their number.

Defined results: null or zero vectors and those with null or non-finite components, and rows with a null vec_id, link
with nothing and are components of their own; vectors of different lengths don't link; rows that repeat a vec_id are
linked as the vectors they hold and share that id. No rows give none. Columns other than vec_id and embedding are
ignored. Lengths of no more vectors than a block share one plan; a longer list of vectors has a tree of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import components, cut, sent

COSINE = 0.9
#: Vectors of which a node's levels are made, nodes that they end in at most, vectors that are compared at once.
SAMPLE, FANOUT, BLOCK = 1024, 64, 8192
#: Distances are taken as this much shorter and longer than computed.
SLACK = 1e-6
_ROWS = 1024


def rounding(dim: int) -> float:
    """Single precision products of unit vectors of this length are within this of the true ones: dim + 2 roundings."""
    return 1.1 * (dim + 2) * 2.0**-24


@dataclass
class Tree:
    """Nodes of all levels, root first: centres, level and parent."""

    centre: np.ndarray
    level: np.ndarray
    parent: np.ndarray

    @property
    def leaves(self) -> np.ndarray:
        return np.flatnonzero(~np.isin(np.arange(len(self.parent)), self.parent[1:]))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))


def cover_tree(points: np.ndarray, leaves: int = FANOUT, least: float = 1e-3) -> Tree:
    """Levels with radii 2, 1, 1/2, ...: nodes of a level lie further apart than its radius and cover all points with it.

    A node stands in every lower level too, as its own child. The levels end where they would have more than the wanted
    number of leaves, or at the least radius.
    """
    d = distances(points, points)
    levels = [np.array([0])]
    radius = 1.0
    while radius > least:
        nodes = list(levels[-1])
        near = d[nodes].min(0)
        while len(nodes) <= leaves and near.max() > radius:
            nodes.append(int(near.argmax()))
            near = np.minimum(near, d[nodes[-1]])
        if near.max() > radius and len(levels[-1]) > 1:
            break
        levels.append(np.array(nodes))
        if near.max() > radius:  # the first level that splits: as far as the number goes
            break
        radius /= 2
    point, level, parent, below = [0], [0], [-1], {0: 0}
    for n, nodes in enumerate(levels[1:], 1):
        up = levels[n - 1]
        to = up[d[np.ix_(nodes, up)].argmin(1)]
        now = {}
        for p, q in zip(nodes, to, strict=True):
            now[int(p)] = len(point)
            point.append(int(p))
            level.append(n)
            parent.append(below[int(q)])
        below = now
    return Tree(points[point], np.array(level), np.array(parent))


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if pa.types.is_list(column.type) else column
    values = flat.to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)
    # by the largest component first: squares of very large or small ones would leave the range
    values = values / np.abs(values).max(1, keepdims=True)
    return values / np.sqrt((values * values).sum(1, keepdims=True))


def _linked(a: np.ndarray, b: np.ndarray, b_single: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of all links, compared in single precision, and near the threshold in double."""
    low = a.astype("f4") @ b_single.T
    within = rounding(a.shape[1])
    i, j = np.nonzero(low >= cosine - within)
    close = np.flatnonzero(low[i, j] < cosine + within)
    exact = (a[i[close]] * b[j[close]]).sum(1)
    keep = np.ones(len(i), bool)
    keep[close] = exact >= cosine
    return i[keep], j[keep]


class _Forest:
    """Spanning links of what one task finds."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Lowers labels along links until both ends of each agree."""
        while True:
            a, b = self.label[i], self.label[j]
            differ = a != b
            if not differ.any():
                return
            low, high = np.minimum(a[differ], b[differ]), np.maximum(a[differ], b[differ])
            to = np.arange(len(self.label))
            np.minimum.at(to, high, low)
            while (to[to] != to).any():
                to = to[to]
            self.label = to[self.label]


def _compare(first: pd.DataFrame, second: pd.DataFrame | None, dim: int, cosine: float) -> pd.DataFrame:
    """Links counted for each vector within a block, or between two, and a label that linked vectors share."""
    get = lambda frame: (frame["rep"].to_numpy("i8"), frame["n"].to_numpy("i8"), np.stack(frame["unit"].to_numpy()).reshape(-1, dim))
    rep, n, x = get(first)
    own = second is None
    if not own:
        rep2, n2, y = get(second)
        rep, n, size = np.r_[rep, rep2], np.r_[n, n2], len(x)
    else:
        y, size = x, 0
    links, forest, y_single = np.zeros(len(rep), np.int64), _Forest(len(rep)), y.astype("f4")
    for s in range(0, len(x), _ROWS):
        lo = s if own else 0
        i, j = _linked(x[s : s + _ROWS], y[lo:], y_single[lo:], cosine)
        i, j = i + s, j + lo
        if own:
            once = i < j
            i, j = i[once], j[once]
        j = j + size
        links += np.bincount(i, n[j], len(rep)).astype("i8") + np.bincount(j, n[i], len(rep)).astype("i8")
        forest.add(i, j)
    hit = links > 0
    # the smallest id of those that share a label names them
    lowest = np.full(len(rep), np.iinfo("i8").max)
    np.minimum.at(lowest, forest.label, rep)
    return pd.DataFrame({"rep": rep[hit], "links": links[hit], "v": lowest[forest.label[hit]]})


def _key(embedding: str) -> F.Column:
    """128 bits that stand for a vector."""
    return F.struct(F.xxhash64(embedding).alias("a"), F.xxhash64(F.lit(1), embedding).alias("b"))


def _classes(vectors: DataFrame) -> DataFrame:
    """Distinct usable vectors: key, rep (the smallest vec_id), n rows and the vector."""
    fine = F.col("vec_id").isNotNull() & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    return vectors.where(fine).groupBy(_key("embedding").alias("key")).agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("rep"), F.count("*").alias("n"))


VECTOR = "rep long, n long, unit array<double>, node long"
_CHILD = "node long, child long, centre array<double>"


def _units(it: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for b in it:
        if b.num_rows:
            x = _unit(b.column("embedding"), dim)
            unit = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("n"), unit, pa.array(np.zeros(len(x), np.int64))], ["rep", "n", "unit", "node"])


def _levels(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """The nodes in which the levels below a node end, from a sample of its vectors; none if they can't be told apart."""
    own = frame.sort_values(["h", "rep"]).head(SAMPLE)
    tree = cover_tree(np.stack(own["unit"].to_numpy()))
    centres = tree.centre[tree.leaves]
    if len(centres) < 2:
        centres = centres[:0]
    ids = key[0] * FANOUT + 1 + np.arange(len(centres))
    return pd.DataFrame({"node": np.full(len(ids), key[0]), "child": ids, "centre": pd.Series(list(centres), dtype=object)})


def _descend(key: tuple, frame: pd.DataFrame, children: pd.DataFrame) -> pd.DataFrame:
    """A part of a node's vectors, each with the nearest child and the distance to it."""
    if not len(frame) or not len(children):
        return pd.DataFrame({c: [] for c in ("rep", "n", "unit", "node", "distance")}).astype({"rep": "int64", "n": "int64", "node": "int64", "distance": "float64"})
    x, centres = np.stack(frame["unit"].to_numpy()), np.stack(children["centre"].to_numpy())
    to = distances(x, centres).argmin(1)
    far = np.sqrt(((x - centres[to]) ** 2).sum(1))
    return pd.DataFrame({"rep": frame["rep"], "n": frame["n"], "unit": frame["unit"], "node": children["child"].to_numpy()[to], "distance": far})


def _furthest(it: Iterator[pa.RecordBatch], centre: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The greatest distance of each batch's vectors from a centre."""
    for b in it:
        if b.num_rows:
            x = b.column("unit").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(centre))
            yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt(((x - centre) ** 2).sum(1).max()))])], ["radius"])


def grow(vectors: DataFrame, reach: float, block: int) -> tuple[DataFrame, DataFrame, int]:
    """The vectors with their leaves, the tree's nodes (node, parent, centre, radius, n, rows, first, leaf, tight), and steps.

    n counts vectors, rows the rows that they stand for, first is the smallest rep. The root is node 0; its centre is the
    vector of that rep. A tight node has more vectors than a block, and all of them link.
    """
    size = [F.count("*").alias("n"), F.sum("n").alias("rows"), F.min("rep").alias("first")]
    top = vectors.agg(*size, F.min_by("unit", "rep").alias("centre")).first()
    radius = vectors.mapInArrow(partial(_furthest, centre=np.array(top["centre"])), "radius double").agg(F.max("radius")).first()[0] if top["n"] > block else 2.0
    root = [(0, None, top["centre"], radius, top["n"], top["rows"], top["first"], bool(top["n"] > block and 2 * radius + SLACK <= reach))]
    nodes = vectors.sparkSession.createDataFrame(root, "node long, parent long, centre array<double>, radius double, n long, rows long, first long, tight boolean")
    done, placed, now, all_nodes, steps = None, vectors, nodes, [], 0
    while True:
        large = cut(now.where((F.col("n") > block) & ~F.col("tight")).select("node", "n"))
        if large.isEmpty():
            break
        share = F.least(F.lit(1.0), 4.0 * SAMPLE / F.col("size"))
        some = placed.join(sent(large.withColumnRenamed("n", "size")), "node").withColumn("h", F.xxhash64("rep")).where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
        children = cut(some.select("node", "rep", "h", "unit").groupBy("node").applyInPandas(_levels, _CHILD))
        split = cut(children.select("node").distinct().join(large, "node"))
        if split.isEmpty():
            break
        parts = F.ceil(F.col("size") / block).cast("int")
        inside = placed.join(sent(split.withColumnRenamed("n", "size")), "node").withColumn("part", F.pmod(F.xxhash64(F.lit(1), "rep"), parts).cast("int")).drop("size")
        dealt = children.join(split.withColumnRenamed("n", "size"), "node").select("node", "child", "centre", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        moved = cut(inside.groupBy("node", "part").cogroup(dealt.groupBy("node", "part")).applyInPandas(_descend, VECTOR + ", distance double"))
        left = placed.join(sent(split.select("node")), "node", "left_anti")
        done = left if done is None else done.union(left)
        all_nodes.append(now.join(split.select("node", F.lit(False).alias("leaf")), "node", "left").withColumn("leaf", F.coalesce("leaf", F.lit(True))))
        found = moved.groupBy("node").agg(F.max("distance").alias("radius"), *size)
        born = children.select(F.col("child").alias("node"), F.col("node").alias("parent"), "centre").join(found, "node")
        now = cut(born.select("node", "parent", "centre", "radius", "n", "rows", "first", ((F.col("n") > block) & (2 * F.col("radius") + SLACK <= reach)).alias("tight")))
        placed, steps = moved.drop("distance"), steps + 1
    all_nodes.append(now.withColumn("leaf", F.lit(True)))
    tree = all_nodes[0]
    for level in all_nodes[1:]:
        tree = tree.union(level)
    return cut(placed if done is None else done.select(*placed.columns).union(placed)), cut(tree), steps


def _judged(it: Iterator[pa.RecordBatch], reach: float) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes (centres and radii of both) that can hold a link, and whether all their vectors link."""
    for b in it:
        if not b.num_rows:
            continue
        x, y = (np.stack(b.column(c).to_pandas().to_numpy()) for c in ("centre", "centre2"))
        d = np.sqrt(((x - y) ** 2).sum(1))
        radii = b.column("radius").to_numpy() + b.column("radius2").to_numpy()
        keep = d - radii <= reach + SLACK
        every = d + radii + SLACK <= reach
        yield pa.RecordBatch.from_arrays([b.column("p"), b.column("q"), pa.array(every)], ["p", "q", "every"]).filter(pa.array(keep))


def surviving(tree: DataFrame, steps: int, reach: float) -> DataFrame:
    """(p, q, every) of pairs of leaves, p <= q, that can hold vectors within reach, by a dual traversal from the root."""
    below = cut(tree.where("parent is not null").select(F.col("parent").alias("node"), F.col("node").alias("child")).union(tree.where("leaf").select("node", F.col("node").alias("child"))))
    place = tree.where("parent is not null").select("node", "centre", "radius")
    pairs = tree.where("parent is null").select(F.col("node").alias("p"), F.col("node").alias("q"), F.col("tight").alias("every"))
    for _ in range(steps):
        open_ = pairs.where(~F.col("every"))
        one = open_.join(below.withColumnRenamed("node", "p"), "p").select("p", "q", F.col("child").alias("a"))
        two = one.join(below.withColumnRenamed("node", "q"), "q").where((F.col("p") != F.col("q")) | (F.col("a") <= F.col("child")))
        next_ = two.select(F.least("a", "child").alias("p"), F.greatest("a", "child").alias("q")).distinct()
        both = next_.join(place.withColumnsRenamed({"node": "p"}), "p").join(place.withColumnsRenamed({"node": "q", "centre": "centre2", "radius": "radius2"}), "q")
        judged = both.select("p", "q", "centre", "radius", "centre2", "radius2").mapInArrow(partial(_judged, reach=reach), "p long, q long, every boolean")
        pairs = cut(judged.union(pairs.where("every")))
    leaves = tree.where("leaf").select("node")
    return pairs.join(leaves.withColumnRenamed("node", "p"), "p", "left_semi").join(leaves.withColumnRenamed("node", "q"), "q", "left_semi")


def _block(key: tuple, frame: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links within all vectors of one length."""
    x = _unit(pa.array(np.concatenate(frame["embedding"].to_numpy())), key[0])
    return _compare(frame.assign(unit=list(x)), None, key[0], cosine)


def _one_length(classes: DataFrame, dim: int, cosine: float, block: int) -> DataFrame:
    """(rep, links, v): links of each class with others, and a link (rep, v) that joins it to them."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    vectors = cut(classes.select("rep", "n", "embedding").mapInArrow(partial(_units, dim=dim), VECTOR))
    placed, tree, steps = grow(vectors, reach, block)
    pairs = cut(surviving(tree, steps, reach))

    # leaves of a parent make up packs in turn; a tight or indivisible leaf beyond a block is a pack of several parts
    leaves = tree.where("leaf").select("node", "parent", "n", "tight")
    small = leaves.where(F.col("n") <= block)
    before = F.sum("n").over(W.partitionBy("parent").orderBy("node")) - F.col("n")
    run = small.select("node", "parent", "n", F.floor(before / block).alias("run"))
    packs = run.groupBy("parent", "run").agg(F.min("node").alias("pack"), F.sum("n").alias("size"))
    same = F.col("parent").eqNullSafe(F.col("_parent")) & (F.col("run") == F.col("_run"))
    of_small = run.join(packs.withColumnsRenamed({"parent": "_parent", "run": "_run"}), same).select("node", "pack", "size", F.lit(False).alias("tight"))
    of_large = leaves.where(F.col("n") > block).select("node", F.col("node").alias("pack"), F.col("n").alias("size"), "tight")
    # a pack holds two blocks at most; parts are blocks of a larger leaf
    of = cut(of_small.union(of_large).withColumn("parts", F.greatest(F.lit(1), F.when(F.col("size") > 2 * block, F.ceil(F.col("size") / block)).otherwise(1)).cast("int")))
    tight = of.where("tight").select("node")
    whole = pairs.where("every").join(tight.withColumnRenamed("node", "p"), "p", "left_semi").join(tight.withColumnRenamed("node", "q"), "q", "left_semi").select("p", "q")
    whole = cut(whole)
    rest = pairs.join(whole, ["p", "q"], "left_anti")
    meet = rest.join(of.select(F.col("node").alias("p"), F.col("pack").alias("a")), "p").join(of.select(F.col("node").alias("q"), F.col("pack").alias("b")), "q").select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).distinct()
    parts = of.select("pack", "parts").distinct()
    meet = cut(meet.join(parts.select(F.col("pack").alias("p"), F.col("parts").alias("parts_p")), "p").join(parts.select(F.col("pack").alias("q"), F.col("parts").alias("parts_q")), "q"))
    one = meet.select(F.col("p").alias("pack"), "p", "q", F.col("parts_q").alias("others"))
    two = meet.where("p <> q").select(F.col("q").alias("pack"), "p", "q", F.col("parts_p").alias("others"))
    sides = cut(one.union(two))

    parted = placed.join(sent(of.select("node", "pack", "parts")), "node").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    spread = parted.join(sent(sides), "pack").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    own = F.col("p") == F.col("q")
    i = F.when(own, F.least("part", "o")).when(F.col("pack") == F.col("p"), F.col("part")).otherwise(F.col("o"))
    j = F.when(own, F.greatest("part", "o")).when(F.col("pack") == F.col("p"), F.col("o")).otherwise(F.col("part"))
    first = F.when(own, F.col("part") == i).otherwise(F.col("pack") == F.col("p"))
    dealt = spread.select("p", "q", i.alias("i"), j.alias("j"), first.alias("first"), "rep", "n", "unit")

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        p, q, i, j = key
        if p == q and i == j:
            return _compare(frame, None, dim, cosine)
        one, two = frame[frame["first"]], frame[~frame["first"]]
        return _compare(one, two, dim, cosine) if len(one) and len(two) else pd.DataFrame({"rep": [], "links": [], "v": []}).astype("int64")

    compared = dealt.groupBy("p", "q", "i", "j").applyInPandas(compare, "rep long, links long, v long")
    return compared.union(_counted(placed, tree, whole))


def _counted(placed: DataFrame, tree: DataFrame, whole: DataFrame) -> DataFrame:
    """(rep, links, v) of the vectors of tight leaves, whose pairs all link: counted from the leaves' sizes."""
    both = whole.union(whole.where("p <> q").select("q", "p")).toDF("node", "other")
    sizes = tree.select(F.col("node").alias("other"), "rows", "first")
    links = both.join(sizes, "other").groupBy("node").agg(F.sum("rows").alias("rows"), F.min("first").alias("v"), F.bool_or(F.col("node") == F.col("other")).alias("own"))
    inside = placed.select("rep", "n", "node").join(sent(cut(links)), "node")
    # a vector's own rows are no links with others
    return inside.select("rep", (F.col("rows") - F.when(F.col("own"), F.col("n")).otherwise(0)).alias("links"), "v")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    classes = cut(_classes(rows).withColumn("dim", F.size("embedding")))
    dims = cut(classes.groupBy("dim").agg(F.count("*").alias("size")))
    # all lengths with no more vectors than a block at once; a tree for each other one
    few = classes.join(sent(dims.where(F.col("size").between(2, block)).select("dim")), "dim", "left_semi")
    found = few.select("dim", "rep", "n", "embedding").groupBy("dim").applyInPandas(partial(_block, cosine=cosine), "rep long, links long, v long")
    for r in dims.where(F.col("size") > block).orderBy("dim").collect():
        found = found.union(_one_length(classes.where(F.col("dim") == r["dim"]), r["dim"], cosine, block))
    found = cut(found)
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("u"), "v"))
    of = classes.select("key", "rep", "n").join(sums, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    ends = cut(of.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")))
    # null embeddings meet nothing here; a vector that isn't usable has no class
    keyed = rows.select("vec_id", F.when(F.col("embedding").isNotNull(), _key("embedding")).alias("key"))
    both = keyed.join(sent(ends), "key", "left")
    named = F.col("vec_id").isNotNull()
    links, component = F.when(named, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long"), F.when(named, F.coalesce("component_id", "vec_id"))
    return both.select("vec_id", links.alias("n_links"), component.alias("component_id"), (F.coalesce(F.col("vec_id") == component, F.lit(True))).alias("kept"))
