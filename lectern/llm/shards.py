"""Sharding by a hierarchical weighted hash tree.

A document descends from the root through regions and racks to a shard. At every level each child draws ln(u) / weight,
u a hash of the document's key and the child's name, and the largest draw wins: children win in proportion to their
weights, and when one weight changes, keys move only into or out of that child. A change of weights below a node moves
nothing outside that subtree's path.

The shard depends on the key and the tree alone (law `key`). A tree of n shards is a base tree and, for each shard
beyond, a region of its own: with one more shard, keys move only into the new one.

Slots number the rows of a shard without gaps, in the order of a digest. Rows are counted by shard and the digest's first
digits, the counts are added up, and each bucket is numbered on its own, so no shard's rows are sorted in one task. The
number of digits grows with the rows, a bucket holds some thousands; the slots don't depend on it.

Defined results: a null key is a key of its own; a null text has no bytes; repeated rows get one slot each; no rows give
none. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import cut, numbered, sent

SHARDS, REGIONS, RACKS = 40, 4, 2
#: Different rows of a bucket, on average at most.
BUCKET_ROWS = 16_384
#: A row adds so many bytes to those of its text.
ROW_BYTES = 16


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; the weight of an inner node is that of its shards."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def tree(shards: int, base: int = SHARDS, regions: int = REGIONS, racks: int = RACKS, weights: dict[int, float] | None = None) -> Node:
    """The base shards over regions and racks in turn; each shard from base on is a region of its own."""
    weight = weights or {}
    leaf = lambda i: Node(f"s{i}", (), i, weight.get(i, 1.0))
    low = min(shards, base)
    places = [(r, k) for r in range(regions) for k in range(racks)]
    of = lambda r, k: tuple(leaf(i) for i in range(low) if places[i * len(places) // base] == (r, k))
    tops = [Node(f"r{r}", tuple(Node(f"r{r}k{k}", of(r, k)) for k in range(racks) if of(r, k))) for r in range(regions)]
    return Node("root", tuple(t for t in tops if t.children) + tuple(Node(f"r+{i}", (Node(f"r+{i}k", (leaf(i),)),)) for i in range(low, shards)))


def _draw(key: Column, child: Column) -> Column:
    """ln(u) / weight, u in (0, 1] from the first 52 bits of an MD5 digest."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), child["name"]).cast("binary")), 1, 13), 16, 10).cast("double")
    return F.log((bits + 1.0) / float(2**52)) / child["weight"]


def place(key: Column, root: Node) -> Column:
    """The shard that key descends to, in a tree whose leaves are all at one depth."""
    level, node = [root], F.lit(0)
    while level[0].children:
        below = [c for n in level for c in n.children]
        number = {c.name: i for i, c in enumerate(below)}
        # for each node of the level its children, by name, weight and number among the next level's nodes
        table = F.array(*(F.array(*(F.struct(F.lit(c.name).alias("name"), F.lit(float(c.weight)).alias("weight"), F.lit(number[c.name]).alias("at")) for c in n.children)) for n in level))
        draws = F.transform(F.element_at(table, node + 1), lambda c: F.struct(_draw(key, c).alias("draw"), (-c["at"]).alias("at")))
        node, level = -F.array_max(draws)["at"], below
    return F.element_at(F.array(*(F.lit(n.shard) for n in level)), node + 1)


def key_text(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def assign(rows: DataFrame, key: str = "doc_id", shards: int = SHARDS, name: str = "shard") -> DataFrame:
    return rows.withColumn(name, place(key_text(F.col(key)), tree(shards)))


def plan(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard) of each row."""
    raw = F.col("text").cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(raw), F.lit(0)) + ROW_BYTES).cast("long").alias("size"), F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"))
    # equal rows meet as one with a count: a row repeated very often is no hot group
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    placed = cut(assign(counted, "doc_id", shards).withColumn("digest", F.md5(F.concat_ws("/", key_text(F.col("doc_id")), "size", "text_crc32").cast("binary"))))
    n = placed.count()
    digits = next(d for d in range(1, 33) if n <= shards * 16**d * BUCKET_ROWS)
    bucketed = placed.withColumn("bucket", F.substring("digest", 1, digits))
    # the buckets' counts add up in two steps, by the first digit, so that the sums too are many small groups
    sums = bucketed.groupBy("shard", "bucket").agg(F.sum("n").alias("m")).withColumn("top", F.substring("bucket", 1, 1))
    tops = sums.groupBy("shard", "top").agg(F.sum("m").alias("m"))  # 16 rows a shard
    above = tops.select("shard", "top", (F.sum("m").over(W.partitionBy("shard").orderBy("top")) - F.col("m")).alias("over"))
    inside = sums.select("shard", "top", "bucket", (F.sum("m").over(W.partitionBy("shard", "top").orderBy("bucket")) - F.col("m")).alias("first"))
    before = cut(inside.join(F.broadcast(above), ["shard", "top"]).select("shard", "bucket", (F.col("first") + F.col("over")).alias("first")))
    own = W.partitionBy("shard", "bucket").orderBy("digest", F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    ranked = bucketed.withColumn("low", F.sum("n").over(own) - F.col("n"))
    slotted = ranked.join(sent(before), ["shard", "bucket"]).withColumn("low", F.col("low") + F.col("first"))
    each = numbered(slotted, "n", "_i").withColumn("slot", F.col("low") + F.col("_i"))
    return assign(each, "doc_id", shards + 1, "grown_shard").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _draw_sql(key: str, node: Node) -> str:
    return f"ln((('0x' || substr(md5({key} || '/{node.name}'), 1, 13))::BIGINT + 1.0::DOUBLE) / {float(2**52)!r}::DOUBLE) / {node.weight!r}::DOUBLE"


def place_sql(key: str, node: Node) -> str:
    """The same descent in DuckDB SQL."""
    if not node.children:
        return str(node.shard)
    if len(node.children) == 1:
        return place_sql(key, node.children[0])
    best = "list_max([" + ", ".join(f"{{'draw': {_draw_sql(key, c)}, 'i': {-i}}}" for i, c in enumerate(node.children)) + "]).i"
    return f"(CASE {best} " + " ".join(f"WHEN {-i} THEN {place_sql(key, c)}" for i, c in enumerate(node.children)) + " END)"
