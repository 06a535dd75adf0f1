"""What several operators share: cutting lineage, checked broadcasts, keys of texts, and components of links."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table goes to all executors if its rows stay below this, at so many bytes each; a larger one is joined by a shuffle.
SENT_BYTES, ROW_BYTES = 32 * 1024 * 1024, 64
#: Numbers made from one row at a time.
_RUN = 1 << 16


def shared_folder(spark: SparkSession) -> None:
    """Makes checkpoint() usable: the cluster's spark.checkpoint.dir, or a folder of our own on a single machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lectern-"))


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def sent(small: DataFrame, row_bytes: int = ROW_BYTES) -> DataFrame:
    """A table as a side of a join: broadcast if its rows, at row_bytes each, are small, as it is if not. Cut it first."""
    return F.broadcast(small) if small.count() * row_bytes <= SENT_BYTES else small


def width(column: Column, kind: T.DataType) -> Column:
    """Bytes that a value takes in a row, about."""
    if isinstance(kind, T.StringType | T.BinaryType):
        own = F.octet_length(column) + 16
    elif isinstance(kind, T.StructType):
        own = sum((width(column[f.name], f.dataType) for f in kind.fields), F.lit(16))
    elif isinstance(kind, T.ArrayType):
        plain = not isinstance(kind.elementType, T.StringType | T.BinaryType | T.StructType | T.ArrayType)
        own = F.size(column) * 8 + 16 if plain else F.aggregate(F.transform(column, lambda x: width(x, kind.elementType).cast("long")), F.lit(16).cast("long"), lambda a, x: a + x)
    else:
        own = F.lit(8)
    return F.coalesce(own.cast("long"), F.lit(8).cast("long"))


def sent_by_width(small: DataFrame) -> DataFrame:
    """Like sent(), by what its rows really hold. Cut it first."""
    total = small.agg(F.sum(sum((width(small[f.name], f.dataType) for f in small.schema.fields), F.lit(16)))).first()[0]
    return F.broadcast(small) if (total or 0) <= SENT_BYTES else small


def text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def numbered(frame: DataFrame, n: str, name: str) -> DataFrame:
    """Each row n times, with name from 0 to n - 1; in two steps, so that no row becomes one long array."""
    runs = frame.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / _RUN))))
    low = F.col("_run") * _RUN
    return runs.withColumn(name, F.explode(F.sequence(low, F.least(F.col(n) - 1, low + _RUN - 1)))).drop("_run")


def sample(frame: DataFrame, n: int, total: int, *keys: str) -> DataFrame:
    """At most n of about total rows, the first by a hash of the keys among those whose hash falls in a narrow share.

    The share lets about 4 n rows through whatever the number of rows and partitions, so the task that picks the first
    n is small. The same keys give the same sample.
    """
    h = F.xxhash64(*keys)
    share = min(1.0, 4 * n / max(1, total))
    return frame.where(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(h, *keys).limit(n)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (u, v); root is the smallest node that it reaches.

    Alternates large-star and small-star steps until the set of edges stays as it is. Each step takes minima with
    partial aggregation and joins them back, so a node with very many links isn't gathered in one task. Null ends and
    loops are left out; no links give no rows.
    """
    edges = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _mark(edges)
    while before[0]:
        # large star: what is larger than a node moves to the smallest of its surroundings
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller ones move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        after = _mark(edges)
        if after == before:
            break
        before = after
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(roots.select("root", "root").distinct())
